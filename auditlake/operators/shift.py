"""Distribution shift between a baseline and an evaluation side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.operators.samples import centroids

# Weights and scales of the composite score, and its thresholds.
WEIGHTS = {"brightness": 0.15, "contrast": 0.15, "sharpness": 0.20, "color": 0.20, "embedding": 0.30}
PSI_SCALE, SHARPNESS_SCALE, COLOR_SCALE, DRIFT_SCALE = 0.40, 0.50, 0.25, 0.25
CRITICAL, MODERATE = 0.60, 0.25


def histogram(rows: DataFrame, bins: int = 20, by: str | None = None) -> DataFrame:
    """(by, bin, baseline, evaluation) counts of (side, value) over equal bins of the pooled
    range, whose last one is closed. Bins without a value aren't listed."""
    keys = [by] if by else []
    limits = rows.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # without a key the limits are one row; with one, Spark measures them
    d = rows.join(limits, by) if by else rows.crossJoin(F.broadcast(limits))
    d = d.where("hi > lo")
    b = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    return d.groupBy(*keys, b.alias("bin")).agg(F.count_if(F.col("side") == "baseline").alias("baseline"), F.count_if(F.col("side") == "evaluation").alias("evaluation"))


def psi(rows: DataFrame, bins: int = 20, by: str | None = None) -> DataFrame:
    """Population stability index of each feature; 0 where the values don't differ."""
    keys = [by] if by else []
    h = histogram(rows, bins, by)
    totals = rows.groupBy(*keys).agg(F.count_if(F.col("side") == "baseline").alias("n"), F.count_if(F.col("side") == "evaluation").alias("m"))
    d = h.join(totals, by) if by else h.crossJoin(F.broadcast(totals))
    share = lambda c, n: F.greatest(F.col(c) / (F.col(n) + 1e-6), F.lit(1e-6))
    e, b = share("evaluation", "m"), share("baseline", "n")
    filled = d.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum((e - b) * F.ln(e / b))).alias("psi"))
    return totals.join(filled, by, "left").select(by, F.coalesce("psi", F.lit(0.0)).alias("psi")) if by else filled.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("psi"))


#: Ranges of values in which running counts are taken.
RANGES = 256


def wasserstein(rows: DataFrame, by: str | None = None) -> DataFrame:
    """First Wasserstein distance of each feature: the area between the two distribution
    functions. Equal values are summed first. The running counts are taken in ranges of
    values: within each by a window, across them by a window over the ranges' totals."""
    keys = [by] if by else []
    points = rows.where("value is not null").groupBy(*keys, "value").agg(F.count_if(F.col("side") == "baseline").alias("b"), F.count_if(F.col("side") == "evaluation").alias("e"))
    # ranges of about as many values each, however they are spread: at most RANGES cuts of each feature
    cuts = F.percentile_approx("value", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10 * RANGES))
    ends = points.groupBy(*keys).agg(cuts.alias("cuts"), F.sum("b").alias("n"), F.sum("e").alias("m"))
    d = points.join(ends, by) if by else points.crossJoin(F.broadcast(ends))
    d = d.withColumn("r", F.size(F.filter("cuts", lambda c: c <= F.col("value")))).drop("cuts")
    ranges = d.groupBy(*keys, "r").agg(F.sum("b").alias("rb"), F.sum("e").alias("re"), F.min("value").alias("first"))
    over = Window.partitionBy(*keys).orderBy("r") if keys else Window.partitionBy(F.lit(0)).orderBy("r")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "r", F.coalesce(F.sum("rb").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("re").over(before), F.lit(0)).alias("e0"), F.lead("first").over(over).alias("then"))
    d = d.join(ranges, [*keys, "r"])
    w = Window.partitionBy(*keys, "r").orderBy("value")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.coalesce(F.lead("value").over(w), F.col("then")) - F.col("value")
    f = F.abs((F.col("b0") + F.sum("b").over(run)) / F.col("n") - (F.col("e0") + F.sum("e").over(run)) / F.col("m"))
    return d.where("n > 0 and m > 0").select(*keys, (f * gap).alias("area")).groupBy(*keys).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("wasserstein"))


def centroid_drift(rows: DataFrame) -> DataFrame:
    """1 - cosine of the two sides' centroids of (side, v), within 0 and 1."""
    c = centroids(rows, "side").select("side", C.unit("total").alias("u"))
    pair = c.agg(F.max_by("u", F.when(F.col("side") == "baseline", 1)).alias("a"), F.max_by("u", F.when(F.col("side") == "evaluation", 1)).alias("b"))
    return pair.select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - C.dot("a", "b"))).alias("drift"))


def composite(m: DataFrame, drift_scale: float = DRIFT_SCALE) -> DataFrame:
    """Adds composite_risk and disposition to one row of measures. ``drift_scale``: the embedding drift of full weight."""
    part = lambda c, scale: F.least(F.lit(1.0), F.col(c) / scale)
    risk = (
        WEIGHTS["brightness"] * part("brightness_psi", PSI_SCALE) + WEIGHTS["contrast"] * part("contrast_psi", PSI_SCALE) + WEIGHTS["sharpness"] * part("sharpness_wasserstein", SHARPNESS_SCALE)
        + WEIGHTS["color"] * part("color_divergence", COLOR_SCALE) + WEIGHTS["embedding"] * part("embedding_drift", drift_scale)
    )
    m = m.withColumn("composite_risk", F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)))
    return m.withColumn("disposition", F.when(F.col("composite_risk") >= CRITICAL, "QUARANTINE").when(F.col("composite_risk") >= MODERATE, "REVIEW").otherwise("ACCEPT"))


def characterization() -> Column:
    """What the measures say, from their sizes and the signs of the means' differences."""
    two = lambda c: F.format_string("%.2f", c)
    parts = [
        F.when(F.col("brightness_psi") > 0.15, F.concat(F.lit("brightness "), F.when(F.col("brightness_diff") < 0, "drop").otherwise("surge"), F.lit(" (PSI "), two("brightness_psi"), F.lit(")"))),
        F.when(F.col("contrast_psi") > 0.15, F.concat(F.lit("contrast "), F.when(F.col("contrast_diff") < 0, "loss").otherwise("surge"), F.lit(" (PSI "), two("contrast_psi"), F.lit(")"))),
        F.when(F.col("sharpness_wasserstein") > 0.20, F.concat(F.lit("sharpness: "), F.when(F.col("sharpness_diff") < 0, "blur").otherwise("noise"))),
        F.when(F.col("color_divergence") > 0.15, F.concat(F.lit("color divergence ("), two("color_divergence"), F.lit(")"))),
        F.when(F.col("embedding_drift") > 0.20, F.concat(F.lit("embedding drift ("), two("embedding_drift"), F.lit(")"))),
    ]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "Stable: all measures within tolerance.").otherwise(F.concat(F.lit("Observed: "), text, F.lit(".")))


FEATURES = ("brightness", "contrast", "sharpness", "color_r", "color_g", "color_b")


def diagnose(features: DataFrame, vectors: DataFrame, bins: int = 20, drift_scale: float = DRIFT_SCALE) -> DataFrame:
    """One row of all measures from (side, six features) and (side, v)."""
    long = features.select("side", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES])).alias("x")).select("side", "x.feature", "x.value")
    means = long.groupBy("feature").agg(F.avg(F.when(F.col("side") == "baseline", F.col("value"))).alias("b"), F.avg(F.when(F.col("side") == "evaluation", F.col("value"))).alias("e"))
    per = psi(long, bins, "feature").join(wasserstein(long, "feature"), "feature").join(means, "feature")
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c)))
    row = per.agg(
        of("brightness", "psi").alias("brightness_psi"), of("contrast", "psi").alias("contrast_psi"), (of("sharpness", "wasserstein") / F.greatest(F.lit(1.0), of("sharpness", "b"))).alias("sharpness_wasserstein"),
        F.avg(F.when(F.col("feature").startswith("color_"), F.col("wasserstein"))).alias("color_divergence"),
        *[(of(f, "e") - of(f, "b")).alias(f"{f}_diff") for f in FEATURES[:3]],
    )
    row = composite(row.crossJoin(F.broadcast(centroid_drift(vectors).withColumnRenamed("drift", "embedding_drift"))), drift_scale)  # one row each
    return row.withColumn("characterization", characterization())


def shift_findings(row: DataFrame, evaluation_id: str, ts: str = "") -> DataFrame:
    measures = ("brightness_psi", "contrast_psi", "sharpness_wasserstein", "color_divergence", "embedding_drift", "composite_risk")
    critical = F.col("composite_risk") >= CRITICAL
    id_ = F.concat(F.when(critical, "FIND-SD-CRITICAL-SHIFT-").otherwise("FIND-SD-MODERATE-SHIFT-"), F.lit(evaluation_id))
    return row.where("disposition <> 'ACCEPT'").select(*C.finding(id_, "shift_diagnostician", F.lit(evaluation_id), F.col("characterization"), {m: F.round(m, 4) for m in measures}, F.when(critical, "CRITICAL").otherwise("MEDIUM"), F.when(critical, 0.91).otherwise(0.85), F.col("disposition"), F.when(critical, "Hold the stream; retrain or adapt").otherwise("Review the environment"), ts))
