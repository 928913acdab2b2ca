"""Fingerprints of models and the roll-up of a model's audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions import crypto
from auditlake.operators import models

# Confidence of an audit by what of the model could be read.
CONFIDENCE = {"white": 0.94, "black": 0.85, "none": 0.50}


def probes(spark: SparkSession, n: int = 20, size: int = 64, seed: int = 42) -> DataFrame:
    """(probe_id, v): fixed inputs, the same at each audit."""
    return spark.createDataFrame([(k, np.random.default_rng(seed + k).normal(size=size).tolist()) for k in range(n)], "probe_id int, v array<double>")


def unprobed_findings(outputs: DataFrame, model: str, n: int = 20, ts: str = "") -> DataFrame:
    """A finding where (probe_id, current) has outputs of fewer than the ``n`` probes that the setting ``models.probes`` asks
    for: agreement over the others says less than it seems to."""
    d = outputs.agg(F.count_distinct(F.when(F.col("current").isNotNull(), F.col("probe_id"))).alias("answered")).where(F.col("answered") < n)
    return d.select(*C.finding(F.lit(f"FIND-MA-PROBES-{model}"), "model_auditor", F.lit(model), F.lit("Outputs of some probes are missing"), {"answered": F.col("answered"), "asked": F.lit(n)}, "MEDIUM", 1.0, "REVIEW", "Run the probes that are missing", ts))


def fingerprint(outputs: DataFrame) -> str:
    """Digest of the few probes' outputs (probe_id, output), in order."""
    return crypto.canonical_hash([r["output"] for r in outputs.orderBy("probe_id").collect()])


def fingerprint_findings(registered: DataFrame, current: DataFrame, model: str, ts: str = "") -> DataFrame:
    """Equal outputs pass; else top classes and squares decide. Outputs of other number or length
    can't be compared and are a mismatch."""
    pair = registered.select("probe_id", F.col("output").alias("registered")).join(current.select("probe_id", F.col("output").alias("current")), "probe_id", "full")
    g = pair.agg(F.coalesce(F.bool_and(F.coalesce(F.size("registered") == F.size("current"), F.lit(False))), F.lit(True)).alias("comparable"), F.coalesce(F.bool_and(F.col("registered").eqNullSafe(F.col("current"))), F.lit(True)).alias("equal"))
    agreed = models.output_agreement(pair.where(F.size("registered") == F.size("current")))
    d = g.crossJoin(F.broadcast(agreed)).where("not equal and (not comparable or substituted)")  # one row each
    odd = ~F.col("comparable")
    id_ = F.concat(F.when(odd, "FIND-MA-HASH-MISMATCH-").otherwise("FIND-MA-SUBSTITUTION-"), F.lit(model))
    return d.select(*C.finding(id_, "model_auditor", F.lit(model), F.lit("Outputs on fixed probes differ from those registered"), {c: F.col(c) for c in ("agreement", "mse", "max_diff")}, "CRITICAL", F.when(odd, 0.95).otherwise(0.96), "QUARANTINE", "Hold the model", ts))


def trigger_findings(tests: DataFrame, model: str, ts: str = "") -> DataFrame:
    d = models.trigger_collapse(tests).where("sensitive")
    evidence = {c: F.col(c) for c in ("collapse_class", "flip_rate", "collapse_ratio", "tests")}
    return d.select(*C.finding(F.lit(f"FIND-MA-TRIGGER-SENSITIVITY-{model}"), "model_auditor", F.lit(model), F.lit("Perturbed inputs flip into one class"), evidence, "HIGH", 0.85, "REVIEW", "Search for a trained trigger", ts))


def activation_statistics(activations: DataFrame) -> DataFrame:
    """(layer, mean, sd, zeros) of (layer, w)."""
    return activations.groupBy("layer").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), F.avg((F.col("w") == 0).cast("double")).alias("zeros"))


def result(findings: DataFrame, access: str) -> DataFrame:
    """(disposition, confidence) of a model's audit; access: white, black or none."""
    return findings.agg(C.worst("disposition").alias("disposition")).withColumn("confidence", F.lit(CONFIDENCE[access]))
