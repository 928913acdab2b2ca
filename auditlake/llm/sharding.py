"""Uniform sharding through a hypergeometric communication matrix.

Rows lie in GROUPS groups of virtual partitions by hash; a partition has about ROWS rows, so
that their number grows with the table. Shard sizes are exact: N // S
or one more. The number of rows that each partition sends to each shard is drawn
from the multivariate hypergeometric law, which is the law of these counts under
a uniformly random shuffle: first for the groups, on the driver, then, given a group's
counts, for its partitions, in tasks. Within a partition rows are permuted by hash, and
runs of the drawn lengths go to the shards; behind the exchange each shard is
permuted again, its slots counted from 0. Which rows meet in a shard, and their
order, is thus as uniform as the hashes are, and sizes are exact.

Only the GROUPS counts and the groups' matrix (GROUPS x shards numbers) pass
through the driver; both are parameters and don't grow with the input.

Law `rows`: counts of shards differ by one at most. Null texts have 16 bytes and a
null check sum. Repeated rows are rows of their own: each gets its own slot. Rows that are equal in all
columns of their identity have one hash, and lie in one partition, which is then larger; the query's and the pipeline's identity
has, for ids that many rows have, each row's place in its written table, so that these are spread. An
empty table gives no rows. Extra columns are carried by shard(); the query drops them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import PLACE, earlier, placed, table

GROUPS = 256
#: Rows of a partition, and of a part of a shard in which slots are ranked, about.
ROWS = 512
#: Standard deviations on each side of the mode beyond which a law has no mass (under 1e-30).
TAIL = 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of good + bad, at any size: NumPy's sampler within its limits, else
    inversion of the law itself, made outwards from its mode by the ratios of
    neighbours and normalised, so that no large logarithms cancel."""
    if good == 0 or draws == 0:
        return 0
    if bad == 0 or draws == good + bad:
        return min(good, draws)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    lo, hi = max(0, draws - bad), min(draws, good)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(TAIL * math.sqrt(max(1.0, draws * share * (1 - share) * ((total - draws) / (total - 1))))) + 2 * TAIL**2
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    # log p(k + 1) - log p(k)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(weights - weights.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split(rng: np.random.Generator, n: int, room: list[int]) -> list[int]:
    """How many of ``n`` rows each shard gets, of those it has room for."""
    rest, row = sum(room), []
    for r in room:
        k = hypergeometric(rng, r, rest - r, n)
        rest -= r
        n -= k
        row.append(k)
    return row


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each group (of these sizes) to each shard."""
    rng = np.random.default_rng(seed)
    total = sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in sizes:
        out.append(split(rng, n, room))
        room = [a - b for a, b in zip(room, out[-1])]
    return out


def _partition_rows(groups: DataFrame, seed: int) -> DataFrame:
    """(__g, __p, __ends): where each partition's runs end, by shard, from (__g, sizes: of its partitions
    from the 0th on, room: the group's row of the matrix)."""

    def draw(pdfs):
        for pdf in pdfs:
            rows = []
            for g, sizes, room in zip(pdf["__g"], pdf["sizes"], pdf["room"]):
                rng, room = np.random.default_rng([seed, int(g)]), [int(x) for x in room]
                for x in sizes:
                    row = split(rng, int(x["n"]), room)
                    room = [a - b for a, b in zip(room, row)]
                    rows.append((g, x["p"], np.cumsum(row).tolist()))
            yield pd.DataFrame(rows, columns=["__g", "__p", "__ends"])

    return groups.mapInPandas(draw, "__g int, __p long, __ends array<long>")


def _key(cols: list[Column], salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *cols)


def _part(h: str, parts: int | Column) -> Column:
    """A place from 0 to parts - 1 by the upper bits of a hash; parts up to 2 ** 23."""
    return F.shiftright(F.shiftrightunsigned(h, 24) * parts, 40)


def dealt_rows(rows: DataFrame, identity: list[str], seed: int) -> DataFrame:
    """``rows`` with a group and two hashes of their identity."""
    ids = [F.col(c) for c in identity]
    return rows.withColumns({"__g": F.pmod(_key(ids, seed), F.lit(GROUPS)).cast("int"), "__a": _key(ids, seed + 1), "__b": _key(ids, seed + 2)})


def shard(rows: DataFrame, shards: int, identity: list[str], seed: int = 6, size: int = ROWS) -> DataFrame:
    """``rows`` with shard and slot. ``identity``: columns whose hash deals the rows;
    rows equal in them are told apart by their number within a partition. Columns that
    ``rows`` has under the names of results give way to these. placed() adds a column that tells equal rows apart."""
    spark = rows.sparkSession
    dealt = dealt_rows(rows, identity, seed)
    sizes = {r["__g"]: r["n"] for r in dealt.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).collect()}
    at, total = sorted(sizes), sum(sizes.values())
    parts, slices = max(1, -(-total // (GROUPS * size))), max(1, -(-total // (shards * size)))
    matrix = spark.createDataFrame(list(zip(at, communication_matrix([sizes[g] for g in at], shards, seed))), "__g int, room array<bigint>")
    dealt = dealt.withColumn("__p", _part("__a", F.lit(parts)))
    # a row for each group, of `parts` sizes
    each = dealt.groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("n")).groupBy("__g").agg(F.array_sort(F.collect_list(F.struct(F.col("__p").alias("p"), "n"))).alias("sizes"))
    bounds = _partition_rows(each.join(matrix, "__g"), seed)
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__p").orderBy("__a", *identity)) - 1)
    sent = ranked.join(bounds, ["__g", "__p"]).withColumn("__shard", F.size(F.filter("__ends", lambda e: e <= F.col("__r"))).cast("int")).drop("__ends")
    sent = sent.withColumn("__q", _part("__b", F.lit(slices)))
    before = earlier(sent.groupBy("__shard", "__q").agg(F.count(F.lit(1)).alias("__n")), "__shard", "__q", "__n", "__before")
    slots = sent.withColumn("__s", F.row_number().over(Window.partitionBy("__shard", "__q").orderBy("__b", "__g", "__p", "__r")) - 1)
    slots = slots.join(before, ["__shard", "__q"]).withColumn("__slot", (F.col("__before") + F.col("__s")).cast("long"))
    return slots.select(*[c for c in rows.columns if c not in ("shard", "slot")], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def in_turn(docs: DataFrame, shards: int) -> DataFrame:
    """``docs`` with shard and slot (law `rows`), dealt to the shards in turn in the order in which they are written: files by name, rows
    by place. What decided that order, a mix, thus holds in each shard and up to each slot. ``docs`` must read written Parquet; a
    table in memory (tests) has the order of its partitions."""
    rows = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    try:
        at = rows.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        at = rows.withColumn("__id", F.monotonically_increasing_id())
        at = at.withColumns({"__file": F.format_string("%010d", F.shiftright("__id", 33)), "__row": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")
    # a row for each file
    files = at.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("__file", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__row")
    return at.join(before, "__file").select(*rows.columns, F.pmod(rank, F.lit(shards)).cast("int").alias("shard"), F.floor(rank / shards).alias("slot"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = placed(docs).select(PLACE, "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    out = shard(rows, 40, ["doc_id", "text_crc32", "size", PLACE])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
