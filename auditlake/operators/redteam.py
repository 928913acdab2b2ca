"""Scores of detectors against known attacks, and attacks to score them with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(truth: DataFrame, flags: DataFrame, empty_precision: float = 0.0) -> DataFrame:
    """(attack, tp, fp, fn, precision, recall, f1) of truth (attack, sample_id, is_attack) and
    flags (attack, sample_id). Without a flag precision is 1 where nothing was to be
    found, else ``empty_precision``; without an attack recall is 1."""
    hit = flags.select("attack", "sample_id").distinct().withColumn("hit", F.lit(True))
    d = truth.join(hit, ["attack", "sample_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    g = d.groupBy("attack").agg(F.count_if(F.col("hit") & F.col("is_attack")).alias("tp"), F.count_if(F.col("hit") & ~F.col("is_attack")).alias("fp"), F.count_if(~F.col("hit") & F.col("is_attack")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).when(F.col("fn") == 0, 1.0).otherwise(empty_precision)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).otherwise(1.0)
    g = g.withColumns({"precision": p, "recall": r})
    return g.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).otherwise(0.0))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def outcome_sets(injected: DataFrame, detected: DataFrame) -> DataFrame:
    """(outcome, id): found, false alarm or missed, by set operations on ids."""
    a, b = injected.select("id"), detected.select("id")
    named = lambda d, n: d.select(F.lit(n).alias("outcome"), "id")
    return named(b.intersect(a), "found").union(named(b.subtract(a), "false_alarm")).union(named(a.subtract(b), "missed"))


def attacked_chain(records: DataFrame, kind: str, at: int, *more: int, order: str = "pos") -> DataFrame:
    """A chain with a fault: outputs or models of some records edited, two swapped, one deleted
    or one replayed."""
    pos = F.col(order)
    if kind in ("output", "model"):
        c = {"output": "output_digest", "model": "model_digest"}[kind]
        return records.withColumn(c, F.when(pos.isin(at, *more), F.sha2(F.concat(c, F.lit("x")), 256)).otherwise(F.col(c)))
    if kind == "swap":
        return records.withColumn(order, F.when(pos == at, at + 1).when(pos == at + 1, at).otherwise(pos))
    if kind == "delete":
        return records.where(pos != at)
    if kind == "replay":
        # the copy stands behind the original, all later ones a place on
        moved = records.withColumn(order, F.when(pos > at, pos + 1).otherwise(pos))
        return moved.union(records.where(pos == at).withColumn(order, pos + 1))
    raise ValueError(kind)


def poisoned(samples: DataFrame, kind: str, every: int, classes: int = 10) -> DataFrame:
    """(idx, label, v, is_attack): each ``every``-th sample relabelled, copied over by its
    predecessor's vector, turned round, or given a patch (of ``patches``) that all of them share."""
    hit = F.col("idx") % every == 0
    d = samples.withColumn("is_attack", hit)
    if kind == "label":
        return d.withColumn("label", F.when(hit, (F.col("label") + 1) % classes).otherwise(F.col("label")))
    if kind == "ood":
        return d.withColumn("v", F.when(hit, F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    if kind == "trigger":
        mark = F.array(F.struct(F.lit(0).alias("place"), F.lit("c0_trigger").alias("key")))
        return d.withColumn("patches", F.when(hit, F.concat(mark, F.filter("patches", lambda x: x["place"] != 0))).otherwise(F.col("patches")))
    if kind == "copy":
        d = d.withColumn("is_attack", hit & (F.col("idx") > 0))
        first = samples.select((F.col("idx") + 1).alias("idx"), F.col("v").alias("before"))
        return d.join(first, "idx", "left").withColumn("v", F.when(hit, F.coalesce("before", "v")).otherwise(F.col("v"))).drop("before")
    raise ValueError(kind)


def evaluated(attacks: DataFrame, pattern: str) -> DataFrame:
    """Whether an attack whose name or family matches was run."""
    return attacks.agg(F.coalesce(F.bool_or(F.concat_ws(" ", "name", "family").rlike(f"(?i){pattern}")), F.lit(False)).alias("evaluated"))


def benchmark(vectors: DataFrame, records: DataFrame, every: int = 25) -> DataFrame:
    """Scores of all scenarios: attacks on vectors (idx, label, v; with ``patches``, an array of
    (place, key), repeated patches too) and on a chain of at least eight records, each against the detector that should see it; macro() averages them. A
    swap also breaks the link of the record behind it, so its precision is two thirds."""
    from auditlake.operators import chain, samples

    truth, flags = [], []

    def scenario(name: str, table: DataFrame, found: DataFrame) -> None:
        truth.append(table.select(F.lit(name).alias("attack"), F.col("idx").alias("sample_id"), "is_attack"))
        flags.append(found.select(F.lit(name).alias("attack"), F.col("idx").alias("sample_id")))

    p = poisoned(vectors, "label", every)
    scenario("label_flip", p, samples.label_flips(p.select("idx", "label", "v"), samples.neighbours(p.select("idx", "v"), 5)).select(F.col("i").alias("idx")))
    p = poisoned(vectors, "ood", every)
    scenario("ood_insertion", p, samples.outlier_scores(p.select("idx", "v")).where("is_ood"))
    p = poisoned(vectors, "copy", every)
    digest = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)
    rows = p.select("idx", F.col("idx").cast("string").alias("sample_id"), F.lit("c").alias("contributor_id"), F.lit("b").alias("batch_id"), "v")
    scenario("duplicate_flooding", p, samples.exact_duplicates(rows, digest).select("idx"))
    if "patches" in vectors.columns:
        p = poisoned(vectors, "trigger", every)
        scenario("trigger_poisoning", p, samples.repeated_patterns(p.select("idx", F.inline("patches").alias("place", "key"))))
    for kind, at in (("output", (3, 7)), ("model", (4,)), ("swap", (2, 3))):
        v = chain.verify_long(attacked_chain(records, kind, *at))
        d = v.select(F.col("expected_seq").alias("idx"), F.col("expected_seq").isin(*at).alias("is_attack"), (F.col("tampered") | F.col("seq_anomaly") | F.col("broken_link")).alias("hit"))
        scenario(f"chain_{kind}", d, d.where("hit"))
    import functools

    both = [functools.reduce(lambda a, b: a.union(b), x) for x in (truth, flags)]
    return metrics(*both)


#: The least F1 of a scenario that passes.
GATE = 0.50


def gate(scores: DataFrame) -> DataFrame:
    """(attack, passed) of scored scenarios."""
    return scores.select("attack", (F.col("f1") >= GATE).alias("passed"))


def clustered(vectors: DataFrame, pull: float = 4.0) -> DataFrame:
    """Vectors (idx, label, v) drawn towards an axis of their label and scaled to length 1, as those of an embedder that tells
    classes apart are."""
    n = F.size("v")
    moved = F.transform("v", lambda x, k: x.cast("double") + F.when(k == F.pmod("label", n), pull).otherwise(0.0))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    d = vectors.withColumn("m", moved).withColumn("norm", norm)
    return d.withColumn("v", F.transform("m", lambda x: x / F.col("norm"))).drop("m", "norm")


def demo_variants(samples: DataFrame, at: int = 0) -> DataFrame:
    """(idx, label, v, patches, kind, is_attack) of (idx, label, v, patches): the samples, and behind them an exact copy of the
    one at ``at``, a look-alike of it with another label, one turned round, and three with one shared patch."""
    clean = samples.select("idx", "label", "v", "patches", F.lit("clean").alias("kind"), F.lit(False).alias("is_attack"))
    n = samples.agg((F.max("idx") + 1).alias("next"))  # one row
    first = samples.where(F.col("idx") == at)
    mark = F.array(F.struct(F.lit(0).alias("place"), F.lit("c0_checkerboard").alias("key")))
    moved = lambda k: F.transform("v", lambda x, i: F.when(i == k, x.cast("double") + 0.01).otherwise(x.cast("double")))
    made = [
        ("copy", 0, F.col("label"), F.col("v"), F.col("patches")),
        ("look_alike", 1, F.col("label") + 1, F.transform("v", lambda x: x.cast("double") * 0.97), F.col("patches")),
        ("noise", 2, F.col("label"), F.transform("v", lambda x: -x.cast("double")), F.col("patches")),
        *[("patch", 3 + k, F.col("label"), moved(k), mark) for k in range(3)],
    ]
    kinds = {f.name: f.dataType for f in clean.schema}
    rows = F.array(*[F.struct((F.col("next") + k).cast(kinds["idx"]).alias("idx"), label.cast(kinds["label"]).alias("label"), v.cast(kinds["v"]).alias("v"), patches.cast(kinds["patches"]).alias("patches"), F.lit(kind).alias("kind")) for kind, k, label, v, patches in made])
    extra = first.crossJoin(F.broadcast(n)).select(F.inline(rows)).withColumn("is_attack", F.lit(True))
    return clean.union(extra.select(*clean.columns))


def assets_benchmark(vectors: DataFrame, records: DataFrame, features: DataFrame, sides: DataFrame, signed: dict, every: int = 25) -> DataFrame:
    """Scores of all scenarios of benchmark() and of five more, each measured: untouched vectors, a model whose outputs
    are replaced, a stream under a worse camera, the same stream untouched, and a signed summary that is edited (beside
    one that isn't). ``features``: (side, six features) of equal sides; ``sides``: (side, v)."""
    from auditlake.operators import governance, models, samples, shift

    spark = vectors.sparkSession
    units: list[tuple[str, str, bool, bool]] = []  # attack, id, whether it is one, whether it was found
    v = F.transform("v", lambda x: x.cast("double"))
    outputs = vectors.select(F.col("idx").alias("probe_id"), v.alias("registered"), v.alias("current"))
    for name, table in (("kept", outputs), ("replaced", outputs.withColumn("current", F.reverse("registered")))):
        units.append(("model_replacement", name, name == "replaced", bool(models.output_agreement(table).first()["substituted"])))
    worse = [F.when(F.col("side") == "evaluation", F.col(f) * (0.3 if f == "sharpness" else 0.45)).otherwise(F.col(f)).alias(f) for f in shift.FEATURES]
    for name, table in (("kept", features), ("worse", features.select("side", *worse))):
        units.append(("environmental_shift", name, name == "worse", shift.diagnose(table, sides).first()["disposition"] != "ACCEPT"))
    for name, document in (("kept", signed), ("edited", signed | {"overall_disposition": "ACCEPT", "confidence": 1.0})):
        units.append(("summary_tampering", name, name == "edited", not governance.verify_summary(document)[0]))
    rows = spark.createDataFrame(units, "attack string, sample_id string, is_attack boolean, hit boolean")
    clean = vectors.select(F.lit("clean").alias("attack"), F.col("idx").alias("sample_id"), F.lit(False).alias("is_attack"))
    digest = F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)
    found = samples.exact_duplicates(vectors.select("idx", F.col("idx").cast("string").alias("sample_id"), F.lit("c").alias("contributor_id"), F.lit("b").alias("batch_id"), "v"), digest)
    extra = metrics(rows.drop("hit"), rows.where("hit")).union(metrics(clean, found.select(F.lit("clean").alias("attack"), F.col("idx").alias("sample_id"))))
    return benchmark(vectors, records, every).union(extra)
