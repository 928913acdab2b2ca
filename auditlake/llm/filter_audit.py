"""Filter interaction audit: what each filter takes, in every order, from one CUBE.

Documents are counted by part and by which of the filters they fail, and these counts are
cubed. A grouping set that keeps a subset of the flags, at the row where all of them are
false, counts the documents that survive this subset of filters. Whatever order filters run in, a step goes from one
subset to the same with one filter more; so each step is a join of two subsets' counts, and the
k * 2**(k - 1) such pairs answer all k! orders. The Shapley sum of a filter weighs
each pair by the number of orders that pass through it.

Only flags, ids and digests are shuffled, never texts; what is cubed is at most 2**k rows a part.

audit() takes any table with one boolean column for each filter (null: not failed) and
returns, for every part, order and step, the contract's counts; with ``whole`` also
those of all parts together (part null).

The query's filters: A under 200 words, B under half of the words distinct, C over 2 % capitals A-Z,
D any of #$%&*|, E a text that a smaller doc_id has too. Null and empty texts have no words
and fail A only (and E, as equal texts). A row without doc_id is nobody's
successor and does not fail E, nor do rows of one doc_id each other. A null part is the empty string. Several labels
of one doc_id count as one that says 1 if any does; a row without label is neither good nor toxic. Repeated rows count each. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import stored, table, with_group

SPACE = r"\x20\x09-\x0D"
FILTERS = "ABCDE"
LEAST_WORDS = 200


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    df = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("t"))
    df = df.withColumn("w", F.array_remove(F.split("t", f"[{SPACE}]+"), ""))
    capitals = F.length("t") - F.length(F.translate("t", string.ascii_uppercase, ""))
    df = df.select(
        "doc_id", "part", F.sha2("t", 256).alias("digest"), (F.size("w") < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct("w")) < 50 * F.size("w")).alias("B"),
        (100 * capitals.cast("long") > 2 * F.length("t")).alias("C"), F.col("t").rlike(r"[#$%&*|]").alias("D"),
    )
    # texts may have copies of any number: ids are compared by parts of a group
    df = with_group(df, "digest", "doc_id", first=(F.min("doc_id"), "min"))
    return df.select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def survivors(flagged: DataFrame, filters: str, part_col: str, marks: tuple[str, ...]) -> DataFrame:
    """(part, all_parts, mask, n, *marks): documents that pass all filters of the subset ``mask``, for every
    subset, zeros included; all_parts is 1 in the rows of all parts together."""
    sums = [F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in marks]]
    each = flagged.select(part_col, *[F.coalesce(f, F.lit(False)).alias(f) for f in filters], *marks)
    each = each.groupBy(part_col, *filters).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(m)).alias(m) for m in marks])
    mask = functools.reduce(operator.add, [(1 - F.grouping(f).cast("int")) * (1 << i) for i, f in enumerate(filters)])
    cube = each.cube(part_col, *filters).agg(*sums, mask.alias("mask"), F.grouping(part_col).cast("int").alias("all_parts"))
    # a flag that a grouping set leaves out is null there
    passing = cube.where(functools.reduce(operator.and_, [~F.coalesce(f, F.lit(False)) for f in filters]))
    passing = stored(passing.select(F.coalesce(part_col, F.lit("")).alias("part"), "all_parts", "mask", "n", *marks), "filter-cube")
    # the empty subset has a row for each part
    grid = passing.where("mask = 0 and n > 0").select("part", "all_parts", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", *marks)]
    return grid.join(passing, ["part", "all_parts", "mask"], "left").select("part", "all_parts", "mask", *counts)


def audit(flagged: DataFrame, filters: str = FILTERS, part_col: str = "part", marks: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley, and lost_<mark> for
    each mark) over every order of ``filters``, single letters that name boolean columns. ``marks``: boolean
    columns whose rows are counted where a step removes them. There are k! orders, so k is small."""
    k = len(filters)
    found = survivors(flagged, filters, part_col, marks)
    if not whole:
        found = found.where("all_parts = 0")
    key = ["part", "all_parts"]
    bits = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(filters)])).alias("b")
    before = found.select("*", bits).select(*key, F.col("mask").alias("before"), "b.filter", "b.bit", *[F.col(c).alias(f"{c}_before") for c in ("n", *marks)])
    before = before.where(F.col("before").bitwiseAND(F.col("bit")) == 0).withColumn("mask", F.col("before") + F.col("bit"))
    lost = [(F.col(f"{c}_before") - F.col(c)).alias(f"lost_{c}") for c in ("n", *marks)]
    pairs = stored(before.join(found, [*key, "mask"]).select(*key, "before", "filter", "bit", F.col("n").alias("kept"), *lost), "filter-pairs")
    n_before = F.bit_count("before")
    orders = functools.reduce(lambda w, s: w.when(n_before == s, math.factorial(s) * math.factorial(k - 1 - s)), range(1, k), F.when(n_before == 0, math.factorial(k - 1)))
    alone = pairs.groupBy(*key, "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("lost_n"))).alias("fails"),
        F.sum(F.when(F.col("before") + F.col("bit") == (1 << k) - 1, F.col("lost_n"))).alias("unique_fails"),
        F.sum(orders * F.col("lost_n")).alias("shapley"),
    )
    # fixed size: k * k! steps of the orders
    rows = [("".join(o), s + 1, f, sum(1 << filters.index(x) for x in o[:s])) for o in itertools.permutations(filters) for s, f in enumerate(o)]
    steps = flagged.sparkSession.createDataFrame(rows, "filter_order string, step int, filter string, before int")
    out = pairs.join(F.broadcast(steps), ["before", "filter"]).join(alone, [*key, "filter"])
    return out.select(
        F.when(F.col("all_parts") == 0, F.col("part")).alias("part"), "filter_order", "step", "filter", "kept", F.col("lost_n").alias("removed"),
        (F.col("fails") - F.col("lost_n")).alias("redundant"), "unique_fails", "shapley", *[f"lost_{m}" for m in marks],
    )


def labelled(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """``flagged`` with good and toxic, by doc_id."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return flagged.join(one, "doc_id", "left").select(*flagged.columns, *marks)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = labelled(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    out = audit(flagged, marks=("good", "toxic"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


#: The same without subsets: each document goes through each order.
SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < {LEAST_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
|| CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
|| CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM d),
m AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN m ON m.doc_id = f.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT g.*, filter_order, (SELECT min(strpos(filter_order, x)) FROM (SELECT unnest(string_split(nullif(fails, ''), '')) AS x)) AS gone FROM g, o),
s AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, count(*) FILTER (WHERE gone IS NULL OR gone > step) AS kept, count(*) FILTER (WHERE gone = step) AS removed,
count(*) FILTER (WHERE contains(fails, substr(filter_order, step, 1)) AND gone < step) AS redundant, count(*) FILTER (WHERE fails = substr(filter_order, step, 1)) AS unique_fails,
count(*) FILTER (WHERE gone = step AND good) AS good_lost, count(*) FILTER (WHERE gone = step AND toxic) AS toxic_lost FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM s"""
