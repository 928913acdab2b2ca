"""Target-distribution importance resampling: documents drawn in proportion to how much
likelier their hashed n-grams are in a target set than in the whole table.

Features (all runs of 1 to max_n words) fall into ``buckets`` buckets by CRC-32. Both sides'
bucket counts give one integer gain a bucket, a smoothed log ratio in thousandths; the gains are an array of fixed size that each
task reads. A document's weight is the floored mean of its features' gains, and its score is the weight plus
Gumbel noise made from its id, so that the highest scores are a draw without replacement
in proportion to exp(weight / 1000).

The draw sorts no table: scores are integers of a bounded range (some ten thousands), so they are counted
exactly; sums from above give each score's rank offset, and the cutoff is the last score with an offset below the
number to draw. Only rows of surviving scores are numbered, by doc_id within each score.

Null and empty texts have no words: no features, weight 0. Documents under min_words
words have a score but are not drawn. A row without doc_id has the noise of an empty id
and the last place in a tie. Repeated rows are rows of their own, each drawn or not. An empty table gives no rows; an empty target leaves gains that
follow from the table alone. Columns of the names of results give way.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from auditlake.llm.common import earlier, stored, table

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, NO_WORD), "")


def features_of(words: str, max_n: int) -> Column:
    """All runs of 1 to ``max_n`` words of an array column, repeats kept."""
    def runs(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    return functools.reduce(F.concat, [runs(n) for n in range(2, max_n + 1)], F.col(words))


def bucket_of(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, max_n: int) -> DataFrame:
    """(bucket, n) over all texts; counted in each task before the few buckets are exchanged."""
    found = docs.select(words_of(docs[text_col]).alias("w")).select(F.explode(features_of("w", max_n)).alias("f"))
    return found.groupBy(bucket_of(F.col("f"), buckets).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N) -> list[int]:
    """The gain of each bucket, in order: ``buckets`` numbers, whatever the tables' sizes."""
    s = bucket_counts(docs, text_col, buckets, max_n).withColumnRenamed("n", "s")
    t = bucket_counts(target, text_col, buckets, max_n).withColumnRenamed("n", "t")
    both = {r["bucket"]: (r["s"] or 0, r["t"] or 0) for r in s.join(t, "bucket", "full").collect()}
    total_s, total_t = sum(x for x, _ in both.values()), sum(x for _, x in both.values())
    rows = docs.sparkSession.createDataFrame([(b, *map(float, both.get(b, (0, 0)))) for b in range(buckets)], "bucket int, s double, t double")
    ratio = (F.col("t") + 1) * F.lit(float(total_s + buckets)) / ((F.col("s") + 1) * F.lit(float(total_t + buckets)))
    return [r["gain"] for r in rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()]


def weighted(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", max_n: int = MAX_N, seed: str = SEED) -> DataFrame:
    """``docs`` with n_words, n_features, weight and score."""
    own = [c for c in docs.columns if c not in RESULTS]
    # one constant of the plan, not an expression for each bucket
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")
    df = docs.select(*[docs[c] for c in own], docs[id_col].cast("string").alias("__id"), words_of(docs[text_col]).alias("__w"))
    df = df.select(*own, "__id", F.size("__w").cast("long").alias("n_words"), features_of("__w", max_n).alias("__f"))
    total = F.aggregate("__f", F.lit(0).cast("long"), lambda a, f: a + F.get(known, bucket_of(f, len(gain)).cast("int")))
    df = df.select(*own, "__id", "n_words", F.size("__f").cast("long").alias("n_features"), total.alias("__sum"))
    n = F.col("n_features")
    weight = F.when(n > 0, ((F.col("__sum") - F.pmod("__sum", n)) / n).cast("long")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("__id", F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return df.withColumn("weight", weight).select(*own, "n_words", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"))


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``scored`` with rank: 1, 2, ... by falling score, then id, of the rows that are drawn; null for others.
    ``scored`` is read several times, so it should be a written table."""
    fit = F.col("n_words") >= min_words
    # (score, n): as many rows as there are scores
    counts = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.lit(0).alias("all"), (-F.col("score")).alias("place"), "n")
    offsets = stored(earlier(counts, "all", "place", "n", "offset", 256).join(counts.select("place", "n"), "place").select((-F.col("place")).alias("score"), "offset", "n"), "score-offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0
    take = percent * total // 100
    cutoff = offsets.where(F.col("offset") < take).agg(F.min("score")).first()[0]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return scored.select("*", none)
    alive = fit & (F.col("score") >= cutoff)
    # one row a score: bounded by the range of scores
    upper = scored.where(alive).join(F.broadcast(offsets.select("score", "offset")), "score")
    place = F.col("offset") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features"))
    upper = upper.withColumn("__rank", place).select(*scored.columns, F.when(F.col("__rank") <= take, F.col("__rank")).cast("long").alias("rank"))
    return upper.unionByName(scored.where(~alive).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N, min_words: int = MIN_WORDS, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep`` of it) with n_words, n_features, weight, score and rank; the draw is ``rank is not null``."""
    found = weighted(docs, gains(docs, target, text_col, buckets, max_n), id_col, text_col, max_n, seed)
    if keep is not None:
        found = found.select(*keep, *RESULTS[:-1])
    return ranked(stored(found, "resampling"), percent, min_words, id_col)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The same over counted words; CRC-32 by its table, made from its rule.
SQL = rf"""WITH crc AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) x(b)),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{NO_WORD}'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT unnest(list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{NO_WORD}'), lambda x: x <> '')) AS f FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS f FROM d), n AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM (SELECT f FROM u UNION ALL SELECT f FROM q))),
b AS (SELECT f, xor(list_reduce(list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]), 4294967295), 4294967295) % {BUCKETS} AS k FROM n, crc),
s AS (SELECT k, count(*) AS s FROM u JOIN b ON b.f = u.f GROUP BY k), t AS (SELECT k, count(*) AS t FROM q JOIN b ON b.f = q.f GROUP BY k),
z AS (SELECT (SELECT count(*) FROM u) AS ss, (SELECT count(*) FROM q) AS tt),
g AS (SELECT s.k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (ss + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * (tt + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.k = s.k, z),
m AS (SELECT doc_id, sum(gain) AS total FROM u JOIN b ON b.f = u.f JOIN g ON g.k = b.k GROUP BY doc_id),
v AS (SELECT d.doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(CAST(total AS DOUBLE) / len(w)) AS BIGINT) END AS weight,
CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
e AS (SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS BIGINT) AS score FROM v),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM e WHERE n_features >= {MIN_WORDS})
SELECT e.doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN CAST(r AS BIGINT) END AS rank FROM e LEFT JOIN r ON r.doc_id = e.doc_id"""
