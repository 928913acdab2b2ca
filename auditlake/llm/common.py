"""Shared pieces: reading tables, cutting lineage, and hashing words in NumPy."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that the NumPy code takes at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(4095, _BASE, U64)]), dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; workers are told where this package lies."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Put this package's folder on the Python path of the workers."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: a temporary one of our own in
    local mode (tests), else one in the warehouse, which a cluster shares."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = os.path.join(tempfile.gettempdir(), f"auditlake-{os.getpid()}")
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/auditlake").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and
    survives the loss of executors. What dropped() doesn't remove goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes what stored() wrote, once nothing that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


PLACE = "__place"
#: Rows of one id that stay together, and ids of more rows, at most.
LEAST_HOT, MOST_HOT = 512, 100_000


def placed(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``scan`` with a number that tells the rows of an id apart which LEAST_HOT rows have, and one in MOST_HOT of all: a row's file
    and its place there, the same however files are split, so that jobs that read it again, after executors were lost too,
    see the same. It is 0 for all other rows, whose results thus don't hang on the layout of files. ``scan`` must read written Parquet and
    nothing else; a table in memory (tests) numbers its rows, and one behind an exchange has no places that last."""
    key = F.xxhash64(id_col)
    total = scan.count()
    # bounded: at most MOST_HOT ids have more than one in MOST_HOT of all rows
    hot = scan.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(LEAST_HOT, total // MOST_HOT))
    hot = stored(hot.select("__key", F.lit(True).alias("__hot")), "hot-ids")
    try:
        out = scan.withColumn(PLACE, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        out = scan.withColumn(PLACE, F.monotonically_increasing_id())
    out = out.withColumn("__key", key).join(F.broadcast(hot), "__key", "left")
    return out.select(*scan.columns, F.when(F.col("__hot"), F.col(PLACE)).otherwise(F.lit(0).cast("long")).alias(PLACE))


#: Parts of a hot key, at most; a key of fewer rows has no more parts than rows.
SALTS = 128


def salt(by: str | Column) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def with_group(df: DataFrame, key: str, by: str, **parts: tuple[Column, str]) -> DataFrame:
    """``df`` with aggregates over the rows of equal ``key``, one column for each of ``parts``: the aggregate
    and the function (sum, min, max) that merges it. Rows are dealt by (key, part of ``by``) and only
    the parts' aggregates, at most SALTS a key, meet in one place."""
    # dealt once, for the aggregates and for the rows that are joined with them
    dealt = df.withColumn("__salt", salt(by)).repartition(key, "__salt")
    each = dealt.groupBy(key, "__salt").agg(*[a.alias(n) for n, (a, _) in parts.items()])
    w = Window.partitionBy(key)
    whole = each.select(key, "__salt", *[getattr(F, how)(n).over(w).alias(n) for n, (_, how) in parts.items()])
    return dealt.join(whole, [key, "__salt"]).drop("__salt")


def attached(df: DataFrame, other: DataFrame, key: str, by: str | Column) -> DataFrame:
    """``df`` joined with ``other`` on ``key``, which may be hot in ``df``: the rows of ``other`` are copied
    once for each part of the key that ``df`` has, at most SALTS times."""
    dealt = df.withColumn("__salt", salt(by))
    copies = dealt.select(key, "__salt").distinct().join(other, key)
    return dealt.join(copies, [key, "__salt"]).drop("__salt")


def earlier(counts: DataFrame, key: str, place: str, n: str, name: str, span: int = 4096) -> DataFrame:
    """(key, place, name): the sum of ``n`` over all smaller places of the key, in two levels, so that
    no task holds more than ``span`` places of a key or its number of spans."""
    each = counts.withColumn("__span", F.floor(F.col(place) / span))
    spans = each.groupBy(key, "__span").agg(F.sum(n).alias("__sum"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "__span", F.coalesce(F.sum("__sum").over(up_to(Window.partitionBy(key).orderBy("__span"))), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum(n).over(up_to(Window.partitionBy(key, "__span").orderBy(place))), F.lit(0))
    return each.withColumn("__within", within).join(spans, [key, "__span"]).select(key, place, (F.col("__base") + F.col("__within")).alias(name))


def fmix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about ``limit`` bytes at most."""
    n = batch.num_rows
    if not n:
        return
    # value lengths, without copying the texts
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and n + 1 offsets into them; null is empty."""
    values = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def hash_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = _IS_WORD, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all words (runs of bytes other than ASCII white space, or
    of those that ``inside`` marks, A-Z lower-cased) in order, and n + 1 offsets of
    each text's words; then the hashes of the words' first bytes, for each length asked."""
    inside = inside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of_text] = inside[starts_of_text]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, U64), np.zeros(len(offsets), np.int64), *(np.zeros(0, U64) for _ in prefixes))
    heads = np.flatnonzero(first[at])
    sizes = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, sizes)
    longest = int(sizes.max())
    powers = _POWERS
    if longest > len(powers):
        powers = np.cumprod(np.concatenate([[U64(1)], np.full(longest, _BASE, U64)]), dtype=U64)
    parts = _BYTE[_LOWER[data[at]]] * powers[place]
    # a prefix that is the whole word has a hash of its own kind
    cut = (fmix(np.add.reduceat(np.where(place < n, parts, U64(0)), heads) + U64(n)) for n in prefixes)
    return (fmix(np.add.reduceat(parts, heads)), np.searchsorted(at[heads], offsets, side="left"), *cut)


def hash_shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each text, in order with repeats,
    and their offsets; a shorter text gives its whole sequence once."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(out_offsets[-1], U64)
    if len(words) >= size:
        h = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            h = h * _STEP + words[k : len(words) - size + 1 + k]
        text_of = np.repeat(np.arange(len(counts)), counts)
        out[np.repeat(counts >= size, n)] = h[text_of[: len(h)] == text_of[size - 1 :]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = U64(counts[i])
        for w in words[offsets[i] : offsets[i + 1]]:
            h = U64((int(h) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_offsets[i]] = h
    return fmix(out), out_offsets


def words_of(text: str) -> list[str]:
    """The words that hash_words hashes, for tests and small inputs."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)
