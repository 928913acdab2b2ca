"""Audits of model parameters and outputs, as long tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions import columns as C

INF = float("inf")


def _finite(w: str = "w"):
    return ~F.isnan(w) & (F.abs(w) != INF)


def bad_layers(params: DataFrame) -> DataFrame:
    """Layers of (layer, w) with a weight that is no number or is infinite."""
    return params.groupBy("layer").agg(F.count_if(~_finite()).alias("n_bad")).where("n_bad > 0")


def parameter_statistics(params: DataFrame, sigma: float = 4.0) -> DataFrame:
    """One row over all weights: counts, moments, sparsity, and weights beyond |mean| + sigma sd."""
    s = params.agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.avg(F.when(F.col("w") == 0, 1.0).otherwise(0.0)).alias("sparsity"))
    bound = F.abs("mean") + sigma * F.col("sd")
    out = params.crossJoin(F.broadcast(s.select(bound.alias("bound")))).agg(F.count_if(F.abs("w") > F.col("bound")).alias("outliers"))  # one row
    d = s.crossJoin(F.broadcast(out))
    return d.select("n", "mean", "sd", "lo", "hi", "sparsity", bound.alias("bound"), "outliers", F.coalesce(F.try_divide("outliers", "n") > 0.001, F.lit(False)).alias("flagged"))


def outlier_weights(params: DataFrame, sigma: float = 4.0) -> DataFrame:
    """(layer, n_outliers) of the layers that hold some."""
    s = params.agg((F.abs(F.avg("w")) + sigma * F.stddev_pop("w")).alias("bound"))
    return params.crossJoin(F.broadcast(s)).where(F.abs("w") > F.col("bound")).groupBy("layer").agg(F.count(F.lit(1)).alias("n_outliers"))  # one row


def graph_hash(layers: DataFrame) -> DataFrame:
    """Digest of `name:shape:type` of all layers, in order of name."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("name", "shape", "dtype"))), lambda x: F.concat_ws(":", x["name"], x["shape"], x["dtype"]))
    return layers.agg(F.sha2(F.array_join(parts, ";"), 256).alias("graph_hash"))


def weight_digest(params: DataFrame) -> DataFrame:
    """(layer, digest) over the name and the 32-bit weights in order of idx. A layer is digested as a stream of
    sorted batches, so that one of any size takes time but no memory; model_digest() combines them."""

    def fold(batches):
        name, h = None, None
        for pdf in batches:
            for layer, part in pdf.groupby("layer", sort=False):
                if layer != name:
                    if h is not None:
                        yield pd.DataFrame({"layer": [name], "digest": [h.hexdigest()]})
                    name, h = layer, hashlib.sha256(str(layer).encode())
                h.update(part["w"].to_numpy(np.float32).tobytes())
        if h is not None:
            yield pd.DataFrame({"layer": [name], "digest": [h.hexdigest()]})

    rows = params.select(F.col("layer").cast("string").alias("layer"), "idx", "w").repartition("layer").sortWithinPartitions("layer", "idx")
    return rows.mapInPandas(fold, "layer string, digest string")


def model_digest(layers: DataFrame) -> DataFrame:
    """One digest of all layers' digests (layer, digest), in order of name."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("layer", "digest"))), lambda x: F.concat_ws(":", x["layer"], x["digest"]))
    return layers.agg(F.sha2(F.array_join(parts, ";"), 256).alias("digest"))


def output_agreement(outputs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """One row of agreement of (probe_id, registered, current): top class, squares, largest difference."""
    d = F.zip_with("registered", "current", lambda a, b: a.cast("double") - b.cast("double"))
    each = outputs.select((C.argmax("registered") == C.argmax("current")).cast("double").alias("same"), d.alias("d"))
    x = each.select("same", F.posexplode("d").alias("pos", "d"))
    g = x.agg(F.avg(F.when(F.col("pos") == 0, F.col("same"))).alias("agreement"), F.avg(F.col("d") * F.col("d")).alias("mse"), F.max(F.abs("d")).alias("max_diff"))
    return g.withColumn("substituted", (F.col("agreement") < 1 - tolerance) | (F.col("mse") > tolerance))


def trigger_collapse(tests: DataFrame) -> DataFrame:
    """One row over (baseline, predicted; null where prediction failed): how many tests flip the
    class, and how far they collapse into one. Ties go to the smaller class."""
    n = tests.count()
    flips = tests.where(F.col("predicted") != F.col("baseline")).groupBy("predicted").agg(F.count(F.lit(1)).alias("c"))
    g = flips.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("flips"), F.max_by("predicted", F.struct("c", -F.col("predicted"))).alias("cls"), F.max("c").alias("top"))
    rate = F.col("flips") / F.lit(max(1, n))
    d = g.select("flips", F.lit(n).cast("long").alias("tests"), rate.alias("flip_rate"), F.col("cls").cast("long").alias("collapse_class"), F.coalesce(F.try_divide("top", "flips"), F.lit(0.0)).alias("collapse_ratio"))
    return d.withColumn("sensitive", (F.col("flips") >= 8) & (F.col("flip_rate") >= 0.40) & (F.col("collapse_ratio") >= 0.75))


def top_classes(logits: DataFrame, k: int = 5) -> DataFrame:
    """(id, rank, class, probability) of the k likeliest classes of (id, v)."""
    p = F.transform(C.softmax("v"), lambda x, i: F.struct((-x).alias("neg"), i.alias("cls")))
    return logits.select("id", F.posexplode(F.slice(F.array_sort(p), 1, k)).alias("pos", "x")).select("id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.cls").cast("long").alias("cls"), (-F.col("x.neg")).alias("probability"))
