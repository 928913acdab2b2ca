"""Merkle trees of logs as mountain ranges.

The tree is that of pairwise levels whose odd last hash is paired with itself. Its whole subtrees
of 2**k leaves don't depend on what follows, so a log of n leaves has one peak for each
binary digit of n that is one, and the root follows from the peaks alone.

forest() makes peaks in passes: a pass deals nodes by runs of 2**SPAN places, and a task folds its runs
from left to right over a stack of at most two nodes a level. Each pass leaves a 2**SPAN-th of its nodes, the last fits one
task, and three passes reach 2**36 leaves at SPAN = 12; for more leaves runs are longer. Peaks are nodes too, so a log
that grows folds its peaks together with the new leaves: nothing that is hashed is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_ROOT = "EMPTY_MERKLE_TREE"
#: log2 of the leaves in a run; PASSES passes reach 2 ** (PASSES * SPAN) leaves.
SPAN, PASSES = 12, 3
PEAKS = "level int, idx long, h string"


def _joined(a: str, b: str) -> str:
    return hashlib.sha256((a + b).encode()).hexdigest()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one level that make a whole subtree become one node, in one walk over nodes in order."""
    stack: list[tuple[int, int, str]] = []

    def told(nodes: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = list(zip(*nodes)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string()))], ["level", "idx", "h"])

    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for level, idx, h in zip(*(c.to_pylist() for c in batch.columns)):
            if stack and (stack[-1][1] + 1) << stack[-1][0] != idx << level:  # a run begins that doesn't go on from the last
                done += stack
                stack = []
            stack.append((level, idx, h))
            while len(stack) > 1 and stack[-2][0] == stack[-1][0] and stack[-2][1] % 2 == 0:
                _, _, b = stack.pop()
                level, idx, a = stack.pop()
                stack.append((level + 1, idx // 2, _joined(a, b)))
        yield told(done)
    yield told(stack)


def _leaves(idx: str) -> Column:
    return F.expr(f"shiftleft(cast({idx} as bigint), level)")


def forest(nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """(level, idx, h) of the peaks of (level, idx, h) nodes that cover places 0 to n - 1 without gap or overlap: node
    idx of a level stands for the leaves from idx * 2**level on."""
    end = _leaves("idx + 1")
    n = nodes.select(F.max(end)).first()[0] or 0
    bits = max(1, (n - 1).bit_length())
    span = max(span, -(-bits // PASSES))
    out = nodes.select(F.col("level").cast("int").alias("level"), F.col("idx").cast("long").alias("idx"), "h")
    first = _leaves("idx")
    passes = -(-bits // span)
    for k in range(1, passes + 1):
        run = F.shiftright(first, k * span)
        # the last pass has one run, of as many nodes as a run of the others
        dealt = out.withColumn("__at", first).repartition(run) if k < passes else out.withColumn("__at", first).repartition(1)
        out = dealt.sortWithinPartitions("__at").drop("__at").mapInArrow(_fold, PEAKS)
    return out


def root_of(peaks: list[tuple[int, int, str]]) -> str:
    """The tree's root from its (level, idx, h) peaks, at most one a binary digit of the number of leaves."""
    if not peaks:
        return hashlib.sha256(EMPTY_ROOT.encode()).hexdigest()
    peaks = sorted(peaks, key=lambda p: p[1] << p[0])
    at = 0
    for (level, idx, _), after in zip(peaks, [*peaks[1:], None]):
        if idx << level != at or (after and after[0] >= level):
            raise ValueError("leaves have gaps or overlap")
        at = (idx + 1) << level
    level, _, h = peaks.pop()
    while peaks:
        up, _, left = peaks.pop()
        for _ in range(up - level):
            h = _joined(h, h)
        level, h = up + 1, _joined(left, h)
    return h


def leaf_nodes(leaves: DataFrame, after: int = 0) -> DataFrame:
    """Nodes of (pos, h), behind ``after`` leaves that are there already."""
    return leaves.select(F.lit(0).alias("level"), (F.col("pos") + after).cast("long").alias("idx"), "h")


def appended(peaks: DataFrame, leaves: DataFrame) -> DataFrame:
    """The peaks of a log that had ``peaks`` and got ``leaves``, (pos, h) with pos gapless from 0."""
    old = peaks.select("level", "idx", "h")
    n = old.select(F.max(_leaves("idx + 1"))).first()[0] or 0
    return forest(old.unionByName(leaf_nodes(leaves, n)))


def collected(peaks: DataFrame) -> list[tuple[int, int, str]]:
    """Peaks as rows; there are no more than binary digits in the number of leaves."""
    return [(r["level"], r["idx"], r["h"]) for r in peaks.collect()]
