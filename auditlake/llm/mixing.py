"""Mixing sources to target weights by Pfair scheduling.

Each source is a task that wants its weight's share of all slots, a slot being a block
of documents. In the fluid schedule every source is served at its weight over that of the
sources that still have blocks: by virtual time v source s has had min(w v, n) of its n
blocks, and t(v), the sum of these over all sources, is how many slots have passed. Block k
of s is released at floor(t(k / w)) and due at ceil(t((k + 1) / w)). One slot after another
goes to the released block with the earliest deadline (EDF). A slot holds one block and the
fluid schedule fills every slot, so EDF meets all deadlines, and at every moment, to the last
slot, each source has had its fluid share within less than one block. Weights are exact
fractions; a source that is used up leaves the schedule and the others go on by their weights.

Targets default to tempered shares, rows ** TEMPER, normalised. Documents of a source
are put in a random order by hash and cut into blocks. A block holds rows / SLOTS documents
(rounded up), so that there are about SLOTS slots at any size of the table, and a source's share of
the whole is kept within 1 / SLOTS. Rows are ranked in hash ranges of about RANGE_ROWS, so that a
source of any size is spread over many tasks. The schedule decides order only: every document of
a source with a weight has a position, and positions have no gaps.

Null sources are a source of their own; the text is only carried. Repeated rows
are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import PLACE, earlier, placed, table

#: Slots of a schedule, about: what the driver draws and what is broadcast have as many rows
#: (and one more a source, for its last block).
SLOTS = 1 << 15
TEMPER = 0.9
#: Rows in a hash range, about, in which the documents of a source are ranked.
RANGE_ROWS = 512
#: Sources of a mixture, at most; a column of more holds something else.
MOST_SOURCES = 100_000
RESULTS = ("mix_block", "mix_position", "target", "in_mix")


def whole_weights(weights: list) -> list[int]:
    """The same weights as whole numbers, exactly."""
    exact = [Fraction(w) for w in weights]
    d = lcm(*(w.denominator for w in exact)) if exact else 1
    return [int(w * d) for w in exact]


def windows(blocks: list[int], weights: list[int]) -> list[list[tuple[int, int]]]:
    """(release, deadline) of each block of each source, from numbers of blocks and whole weights."""
    order = sorted(range(len(blocks)), key=lambda s: Fraction(blocks[s], weights[s]))
    # until the j-th source in this order is used up: slots of those used up, weight of the others
    gone, left, phases = 0, sum(weights), []
    for s in order:
        phases.append((blocks[s], weights[s], gone, left))
        gone, left = gone + blocks[s], left - weights[s]
    out = []
    for n, w in zip(blocks, weights):
        j, times = 0, []
        for k in range(n + 1):
            while k * phases[j][1] > phases[j][0] * w:
                j += 1
            gone, left = phases[j][2:]
            times.append((gone + left * k // w, gone - -left * k // w))
        out.append([(times[k][0], times[k + 1][1]) for k in range(n)])
    return out


def schedule(blocks: list[int], weights: list[int]) -> list[tuple[int, int]]:
    """(source, block) of each slot: of the blocks that are released, the one that is due first."""
    spans = windows(blocks, weights)
    waiting = [(spans[s][0][0], s, 0) for s in range(len(blocks)) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (spans[s][k][1], s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, (spans[s][k + 1][0], s, k + 1))
    return out


def tempered_shares(counts: dict, power: float = TEMPER) -> dict:
    return {s: n**power for s, n in counts.items()}


def _scheduled(docs: DataFrame, weights: dict | None, source_col: str, id_col: str, block: int | None, seed: int, place_col: str | None = None) -> DataFrame:
    """``docs`` with __slot, mix_position, target and in_mix; null where the source has no weight."""
    spark = docs.sparkSession
    # bounded: a row for each source, the parts of a mixture
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    shares = weights or tempered_shares(counts)
    names = sorted((s for s in counts if shares.get(s, 0) > 0), key=lambda s: (s is not None, str(s)))
    size = block or max(1, -(-sum(counts[s] for s in names) // SLOTS))
    blocks = [-(-counts[s] // size) for s in names]
    whole = whole_weights([shares[s] for s in names])
    slots = schedule(blocks, whole)
    # shares hold for all sources until the first is used up
    ends = [Fraction(n, w) for n, w in zip(blocks, whole)]
    end = int(min(ends, default=0) * sum(whole))
    total = sum(whole)
    rows, base = {"__sid": [], "__k": [], "__slot": [], "__base": []}, 0
    for t, (s, k) in enumerate(slots):
        for c, x in zip(rows, (s, k, t, base)):
            rows[c].append(x)
        base += min(size, counts[names[s]] - k * size)
    plan = spark.createDataFrame(pa.table({"__sid": pa.array(rows["__sid"], pa.int32()), **{c: pa.array(rows[c], pa.int64()) for c in ("__k", "__slot", "__base")}}))
    kind = docs.schema[source_col].dataType.simpleString()
    sources = spark.createDataFrame([(s, k, max(1, -(-counts[s] // RANGE_ROWS)), w / total) for k, (s, w) in enumerate(zip(names, whole))], f"__name {kind}, __sid int, __ranges long, target double")
    own = docs.select(*[c for c in docs.columns if c not in RESULTS])
    # bounded: the parts of a mixture
    found = own.join(F.broadcast(sources), own[source_col].eqNullSafe(sources["__name"]), "left").drop("__name")
    h = F.xxhash64(F.lit(seed), id_col, *([place_col] if place_col else []))
    found = found.withColumn("__h", h).withColumn("__q", F.shiftright(F.shiftrightunsigned("__h", 24) * F.col("__ranges"), 40))
    before = earlier(found.where("__sid is not null").groupBy("__sid", "__q").agg(F.count(F.lit(1)).alias("__n")), "__sid", "__q", "__n", "__before")
    ranked = found.where("__sid is not null").withColumn("__r", F.row_number().over(Window.partitionBy("__sid", "__q").orderBy("__h", id_col, *([place_col] if place_col else []))) - 1).join(before, ["__sid", "__q"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__r")).withColumn("__k", F.floor(F.col("__rank") / size))
    # bounded: SLOTS rows and one for each source
    placed = ranked.join(F.broadcast(plan), ["__sid", "__k"])
    placed = placed.withColumns({"mix_position": F.col("__base") + F.col("__rank") % size, "in_mix": F.col("__slot") < end})
    columns = [*own.columns, "__slot", "mix_position", "target", "in_mix"]
    if len(names) == len(counts):
        return placed.select(*columns)
    rest = found.where("__sid is null").withColumns({"__slot": F.lit(None).cast("long"), "mix_position": F.lit(None).cast("long"), "in_mix": F.lit(False)})
    return placed.select(*columns).union(rest.select(*columns))


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", block: int | None = None, seed: int = 3, place_col: str | None = None) -> DataFrame:
    """``docs`` with mix_position (0, 1, ... without a gap), mix_block (the slot), target (the source's
    share of all slots) and in_mix: whether no source had run out before the slot. Sources without a
    weight are in no mix: their position is null. Columns that ``docs`` has under these names give way
    to them. ``block``: documents in a block, in place of the default. ``place_col``: a column that tells rows of equal id
    apart (see common.placed), without which one task ranks them all. Sources are the parts of a mixture: their
    weights and counts and the slots pass through the driver."""
    out = _scheduled(docs, weights, source_col, id_col, block, seed, place_col)
    return out.withColumnRenamed("__slot", "mix_block").select(*[c for c in docs.columns if c not in RESULTS], "mix_block", "mix_position", "target", "in_mix")


def _in_order(docs: DataFrame, weights: dict | None, chunk: int, whole: bool, source_col: str = "source", id_col: str = "doc_id", block: int | None = None, seed: int = 3, place_col: str | None = None) -> DataFrame:
    own = [c for c in RESULTS if c in docs.columns]
    out = _scheduled(docs.withColumnsRenamed({c: f"__own_{c}" for c in own}), weights, source_col, id_col, block, seed, place_col)
    out = out.where("mix_position is not null" if whole else "in_mix").withColumn("__run", F.floor(F.col("mix_position") / chunk))
    out = out.repartitionByRange("__run").sortWithinPartitions("mix_position").drop("__slot", "mix_position", "target", "in_mix", "__run")
    return out.withColumnsRenamed({f"__own_{c}": c for c in own}).select(*docs.columns)


def ordered(docs: DataFrame, weights: dict | None = None, chunk: int = 4096, **names) -> DataFrame:
    """Every row of ``docs`` whose source has a weight (all rows, by default), all columns, written
    in the order of the mix, from the first partition to the last: each holds whole runs of ``chunk`` places."""
    return _in_order(docs, weights, chunk, True, **names)


def mixed(docs: DataFrame, weights: dict | None = None, chunk: int = 4096, **names) -> DataFrame:
    """As ordered(), but only the rows that are `in_mix`: those behind the first source's
    end are left out, for a mixture that must hold its shares to the last row."""
    return _in_order(docs, weights, chunk, False, **names)


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(placed(table(spark, sf_dir, "documents")).select("doc_id", "source", PLACE), place_col=PLACE).drop(PLACE)
