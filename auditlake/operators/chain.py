"""Hash-chained inference records: building, verifying, Merkle roots, spot checks.

Verifying needs each record and the one before it: a window by chain. One chain is one
window partition, streamed and sorted on disk where it is large; where a single
chain is most of the log, verify_long() cuts it into ranges of positions and
carries each range's last hash over, so that no task holds more than a range.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions.tables import written
from auditlake.operators import merkle

#: Slices of the hash range by which a chain's records are counted for its sample.
SLICES = 4096


def recomputed(output_digest: Column, configurations: bool = False) -> Column:
    more = [F.sha2("preprocessing_config", 256), F.sha2("inference_config", 256)] if configurations else []
    return C.record_hash(F.col("sequence_number"), F.col("previous_record_hash"), F.col("input_sha256"), F.col("model_digest"), output_digest, F.col("nonce"), F.col("timestamp"), *more)


#: Records of a chain that one task sorts, about.
SPAN = 1_000_000


def build(records: DataFrame, chain: str = "chain_id", order: str = "pos", more: tuple[str, ...] = ()) -> DataFrame:
    """Fills sequence_number, previous_record_hash and record_hash of (chain, pos, input_sha256,
    model_digest, output_digest, nonce, timestamp). A chain is a fold from its first
    record to its last: each partition holds whole chains, sorted, and is folded as a
    stream of batches. A chain of over SPAN records is cut into ranges of about so many, which are sorted side by side into files and folded
    one after another, each from the last hash of the one before, so that a long chain takes time but no memory. ``more``: columns of
    records that are carried along, longs."""
    rows = records.select(chain, F.col(order).cast("long").alias(order), "input_sha256", "model_digest", "output_digest", "nonce", "timestamp", *more)
    long = rows.groupBy(chain).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPAN)
    total = long.agg(F.sum("n")).first()[0]
    if not total:
        return _folded(rows.repartition(chain), chain, order, more)
    names = written(long.select(chain), "long-chains")
    ranges_ = rows.join(names, chain, "left_semi").repartitionByRange(-(-total // SPAN), chain, order).withColumn("__at", F.spark_partition_id())
    ranges_ = written(ranges_, "ranges")
    # one row for each chain and range that holds some of it, each of SPAN records: few
    places = ranges_.groupBy(chain).agg(F.array_sort(F.collect_set("__at")).alias("at")).select(chain, F.posexplode("at").alias("__turn", "__at"))
    places = written(places, "turns")
    turns: dict[int, list[int]] = {}
    for r in places.select("__turn", "__at").distinct().collect():
        turns.setdefault(r["__turn"], []).append(r["__at"])
    out = _folded(rows.join(names, chain, "left_anti").repartition(chain), chain, order, more)
    last = None
    for turn in sorted(turns):
        part = ranges_.where(F.col("__at").isin(turns[turn])).join(places.where(F.col("__turn") == turn), [chain, "__at"]).drop("__turn", "__at")
        if last is not None:
            part = part.join(last, chain)
        done = written(_folded(part.repartition(chain), chain, order, more), "folded")
        last = done.groupBy(chain).agg((F.max("sequence_number") + 1).alias("__k"), F.max_by("record_hash", "sequence_number").alias("__prev"))
        out = out.union(done)
    return out


def _folded(rows: DataFrame, chain: str, order: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Partitions of whole chains, folded; from (__k, __prev) on where rows have these."""
    schema = f"{chain} {rows.schema[chain].dataType.simpleString()}, {order} long, sequence_number long, input_sha256 string, model_digest string, output_digest string, nonce string, timestamp string, previous_record_hash string, record_hash string" + "".join(f", {c} long" for c in more)
    begun_ = "__k" in rows.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, prev, k, begun = None, C.GENESIS, 0, False
        for pdf in batches:
            numbers, prevs, hashes = [], [], []
            starts = zip(pdf["__k"], pdf["__prev"]) if begun_ else itertools.repeat((0, C.GENESIS))
            columns = [pdf[c] for c in (chain, "input_sha256", "model_digest", "output_digest", "nonce", "timestamp")]
            for (name, i, m, o, nonce, t), start in zip(zip(*columns), starts):
                if not begun or name != at:
                    at, begun = name, True
                    k, prev = int(start[0]), start[1]
                numbers.append(k)
                prevs.append(prev)
                prev = hashlib.sha256(f"{k}:{prev}:{i}:{m}:{o}:{nonce}:{t}".encode()).hexdigest()
                hashes.append(prev)
                k += 1
            yield pdf.assign(sequence_number=numbers, previous_record_hash=prevs, record_hash=hashes)[[f.split()[0] for f in schema.split(", ")]]

    return rows.sortWithinPartitions(chain, order).mapInPandas(fold, schema)


def verify(records: DataFrame, chain: str = "chain_id", order: str = "pos", output_digest: Column | None = None, valid_signature: Column | None = None) -> DataFrame:
    """Adds expected_seq, expected_prev and the flags seq_anomaly, broken_link, tampered."""
    w = Window.partitionBy(chain).orderBy(order)
    d = records.withColumns({"expected_seq": F.row_number().over(w).cast("long") - 1, "expected_prev": F.lag("record_hash", 1, C.GENESIS).over(w)})
    return _flags(d, output_digest, valid_signature)


def _flags(d: DataFrame, output_digest: Column | None, valid_signature: Column | None) -> DataFrame:
    tampered = ~recomputed(F.col("output_digest") if output_digest is None else output_digest).eqNullSafe(F.col("record_hash"))
    if valid_signature is not None:
        tampered = tampered | ~F.coalesce(valid_signature, F.lit(False))
    return d.withColumns({"seq_anomaly": ~F.col("sequence_number").eqNullSafe(F.col("expected_seq")), "broken_link": ~F.col("previous_record_hash").eqNullSafe(F.col("expected_prev")), "tampered": tampered})


def verify_long(records: DataFrame, chain: str = "chain_id", order: str = "pos", span: int = 100_000, **how: Column) -> DataFrame:
    """As verify(), with each chain cut into ranges of ``span`` positions."""
    d = records.withColumn("_range", F.floor(F.col(order) / span))
    ends = ranges(records, "record_hash", chain, order, span)
    w = Window.partitionBy(chain, "_range").orderBy(order)
    d = d.join(ends, [chain, "_range"])
    d = d.withColumns({"expected_seq": F.row_number().over(w).cast("long") - 1 + F.col("_before"), "expected_prev": F.coalesce(F.lag("record_hash").over(w), F.col("_prev"))})
    return _flags(d.drop("_range", "_before", "_prev"), how.get("output_digest"), how.get("valid_signature"))


FAULTS = ("tampered", "seq_anomaly", "broken_link")


def summary(verified: DataFrame, chain: str = "chain_id") -> DataFrame:
    """(chain, total, n of each fault, first_fault, valid, disposition). One early deletion puts every
    later number out of order, so faults are counted here; fault_positions() has them as rows."""
    bad = F.col("tampered") | F.col("seq_anomaly") | F.col("broken_link")
    counts = [F.count_if(F.col(c)).alias(f"n_{c}") for c in FAULTS]
    g = verified.groupBy(chain).agg(F.count(F.lit(1)).alias("total"), *counts, F.min(F.when(bad, F.col("expected_seq"))).alias("first_fault"))
    g = g.withColumn("valid", F.col("first_fault").isNull())
    return g.withColumn("disposition", F.when(F.col("valid"), "ACCEPT").otherwise("QUARANTINE"))


def fault_positions(verified: DataFrame, chain: str = "chain_id") -> DataFrame:
    """(chain, fault, pos): a row for each fault of each record."""
    kinds = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in FAULTS]))
    return verified.select(chain, F.explode(kinds).alias("fault"), F.col("expected_seq").alias("pos"))


def faulty(verified: DataFrame, chain: str = "chain_id") -> DataFrame:
    """(chain, pos): the union of all faults' positions, each once."""
    return fault_positions(verified, chain).select(chain, "pos").distinct()


def ranges(records: DataFrame, hash_col: str, chain: str, order: str, span: int) -> DataFrame:
    """(chain, _range, _before, _prev) of ranges of ``span`` positions: the records before each, and the last hash before it."""
    ends = records.groupBy(chain, F.floor(F.col(order) / span).alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.max_by(hash_col, order).alias("_last"))
    over = Window.partitionBy(chain).orderBy("_range")
    return ends.select(chain, "_range", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_last", 1, C.GENESIS).over(over).alias("_prev"))


def findings(verified: DataFrame, ts: str = "", asset: str = "record_id") -> DataFrame:
    """One finding for each fault of each record."""
    kinds = (
        ("seq_anomaly", "SEQ-ANOMALY", "HIGH", "Sequence number out of order", {"expected_seq": F.col("expected_seq"), "actual_seq": F.col("sequence_number")}),
        ("broken_link", "BROKEN-LINK", "CRITICAL", "Previous hash is not that of the record before", {"expected_prev": F.col("expected_prev"), "actual_prev": F.col("previous_record_hash")}),
        ("tampered", "RECORD-TAMPER", "CRITICAL", "Recomputed hash or signature differs", {"stored_hash": F.col("record_hash"), "sequence": F.col("sequence_number")}),
    )
    out = [verified.where(flag).select(*C.finding(F.format_string(f"FIND-PE-{name}-%04d", "expected_seq"), "provenance_engine", asset, F.lit(reason), evidence, severity, 1.0, "QUARANTINE", "Hold the record", ts)) for flag, name, severity, reason, evidence in kinds]
    return out[0].unionByName(out[1]).unionByName(out[2])


def leaves(rows: DataFrame, order: Column, h: Column, span: int = 100_000) -> DataFrame:
    """(pos, h) of all rows, numbered from 0 without a gap in an order that may have gaps; rows
    are ranked within ranges of ``span``."""
    spans = rows.select(order.alias("p"), h.alias("h"), F.floor(order / span).alias("g"))
    sizes = spans.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("g", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return spans.join(before, "g").select((F.col("b") + F.row_number().over(Window.partitionBy("g").orderBy("p")) - 1).alias("pos"), "h")


def merkle_root(leaves: DataFrame) -> DataFrame:
    """Root of (pos, h), pos gapless from 0: pairs of hashes are joined as text and digested,
    an odd last one is paired with itself. At most three exchanges at any size."""
    root = merkle.root_of(merkle.collected(merkle.forest(merkle.leaf_nodes(leaves))))
    return leaves.sparkSession.createDataFrame([(root,)], "root string")


def spot_sample(records: DataFrame, rate: float = 0.25, seed: str = "42", chain: str | None = None, id_col: str = "record_id") -> DataFrame:
    """``records`` that are sampled: of each chain of n the max(1, floor(n * rate)) with the smallest hashes, exactly.

    No chain is sorted. Records are counted by chain and SLICES slices of the hash range; slices that lie under the
    chain's number are taken whole, and only in the one slice that the number falls into are
    records ranked. Without ``chain`` all are one log."""
    log = F.lit(0) if chain is None else F.col(chain)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    d = records.withColumns({"__log": log, "__h": h}).withColumn("__slice", F.coalesce(F.floor(F.col("__h") * SLICES / (1 << 32)), F.lit(-1)))
    counts = d.groupBy("__log", "__slice").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("__log")
    before = F.coalesce(F.sum("n").over(w.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    most = F.greatest(F.lit(1), F.floor(F.sum("n").over(w) * F.lit(rate)))
    room = counts.select("__log", "__slice", "n", (most - before).alias("__room")).where("__room > 0")
    room = room.select(F.col("__log").alias("__l"), F.col("__slice").alias("__s"), (F.col("n") <= F.col("__room")).alias("__whole"), "__room")
    met = d.join(room, F.col("__log").eqNullSafe(F.col("__l")) & (F.col("__slice") == F.col("__s")))
    whole = met.where("__whole")
    rank = F.row_number().over(Window.partitionBy("__l", "__s").orderBy("__h", id_col))
    part = met.where("not __whole").withColumn("__rank", rank).where(F.col("__rank") <= F.col("__room"))
    return whole.select(*records.columns).unionByName(part.select(*records.columns))


def spot_check(records: DataFrame, inputs: DataFrame, rate: float = 0.25, tolerance: float = 1e-4, seed: str = "42", chain: str | None = None) -> DataFrame:
    """(record_id[, chain], max_diff, verdict) of the sampled records, (record_id, logged[, chain]), against
    (record_id, replayed). A record without an input is sampled but not checked."""
    d = spot_sample(records, rate, seed, chain).join(inputs, "record_id", "left")
    diff = C.max_abs_diff("logged", "replayed")
    verdict = F.when(F.col("replayed").isNull(), "UNCHECKED").when(F.size("logged") != F.size("replayed"), "DIM").when(diff > tolerance, "DIFF").otherwise("OK")
    return d.select("record_id", *([chain] if chain else []), diff.alias("max_diff"), verdict.alias("verdict"))


def spot_summary(checked: DataFrame, chain: str | None = None) -> DataFrame:
    """([chain, ]n_sampled, n_passed, n_discrepancies, n_unchecked) of spot checks."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return checked.groupBy(*([chain] if chain else [])).agg(F.count(F.lit(1)).alias("n_sampled"), n("OK").alias("n_passed"), n("DIM", "DIFF").alias("n_discrepancies"), n("UNCHECKED").alias("n_unchecked"))
