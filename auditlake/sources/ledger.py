"""An append-only ledger of findings with a commit protocol, as a Spark data source.

Each task writes a segment, in which every entry holds the hash of the one before. A commit chains the segments of one write: it
lists their names, lengths and last hashes, and holds the hash of the commit before. Entries count once their commit is
there, so tasks that are tried again, or fail, leave no gap and no double; a batch id that has been committed is not committed
again. Only a line a segment passes through the driver. One write at a time may commit: a commit's file is made under its number, and
a number that is taken is an error.

    spark.dataSource.register(ledger.LedgerSource)
    findings.write.format("ledger").option("batch", "7").mode("append").save(folder)
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from auditlake.functions import columns as C

ENTRY = "n long, previous_hash string, timestamp string, finding string, entry_hash string"
COMMIT = "number long, previous_hash string, batch string, segments array<struct<name: string, n: long, first: long, head: string>>, commit_hash string"


def seed(segment: str) -> str:
    """What the first entry of a segment holds as the hash before it: its segment's name can't be another's."""
    return hashlib.sha256(f"segment:{segment}".encode()).hexdigest()


def entry_hash(previous: str, timestamp: str, finding: str) -> str:
    return hashlib.sha256(f"{previous}\n{timestamp}\n{finding}".encode()).hexdigest()


def commit_hash(number: int, previous: str, batch: str, segments: list[dict[str, Any]]) -> str:
    parts = [f"{s['name']}:{s['n']}:{s['first']}:{s['head']}" for s in segments]
    return hashlib.sha256("\n".join([str(number), previous, batch, *parts]).encode()).hexdigest()


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


@dataclass
class Segment(WriterCommitMessage):
    name: str
    n: int
    head: str


class LedgerWriter(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, rows: Iterator) -> Segment:
        name = uuid.uuid4().hex
        fs, folder = _place(self.path)
        fs.create_dir(f"{folder}/segments", recursive=True)
        n, previous = 0, seed(name)
        with fs.open_output_stream(f"{folder}/segments/{name}.jsonl", compression=None) as out:
            for row in rows:
                finding = row.asDict(recursive=True)
                stamp, text = str(finding.get("timestamp") or ""), json.dumps(finding, sort_keys=True, default=str)
                own = entry_hash(previous, stamp, text)
                out.write((json.dumps({"n": n, "previous_hash": previous, "timestamp": stamp, "finding": text, "entry_hash": own}) + "\n").encode())
                n, previous = n + 1, own
        return Segment(name, n, previous)

    def commit(self, messages: list[Segment | None]) -> None:
        fs, folder = _place(self.path)
        fs.create_dir(f"{folder}/commits", recursive=True)
        done = commits_of(fs, folder)
        made = sorted((m for m in messages if m and m.n), key=lambda m: m.name)
        if any(c["batch"] == self.batch for c in done):
            return self.abort(messages)
        number, first = len(done), sum(s["n"] for c in done for s in c["segments"])
        segments = []
        for m in made:
            segments.append({"name": m.name, "n": m.n, "first": first, "head": m.head})
            first += m.n
        previous = done[-1]["commit_hash"] if done else C.GENESIS
        c = {"number": number, "previous_hash": previous, "batch": self.batch, "segments": segments, "commit_hash": commit_hash(number, previous, self.batch, segments)}
        target = f"{folder}/commits/{number:012d}.json"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            raise RuntimeError(f"another write has made commit {number}")
        part = f"{folder}/commits/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(c).encode())
        fs.move(part, target)
        for m in messages:  # tasks without rows
            if m and not m.n:
                fs.delete_file(f"{folder}/segments/{m.name}.jsonl")

    def abort(self, messages: list[Segment | None]) -> None:
        fs, folder = _place(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{folder}/segments/{m.name}.jsonl")


def commits_of(fs: pafs.FileSystem, folder: str) -> list[dict[str, Any]]:
    """The commits so far, in order."""
    names = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(f"{folder}/commits", allow_not_found=True)) if re.search(r"/\d+\.json$", i.path))
    out = []
    for name in names:
        with fs.open_input_stream(name) as f:
            out.append(json.loads(f.read()))
    return out


class LedgerSource(DataSource):
    """Writes findings to a ledger in the folder ``path``; ``batch``: an id under which nothing is committed twice."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return "finding_id string, timestamp string"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is appended to")
        return LedgerWriter(self.options["path"], self.options.get("batch") or uuid.uuid4().hex)


def append(findings: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends findings as one commit."""
    findings.sparkSession.dataSource.register(LedgerSource)
    writer = findings.write.format("ledger").mode("append")
    (writer.option("batch", batch) if batch else writer).save(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/commits")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(seq, previous_hash, timestamp, finding, entry_hash) of all committed entries. The first entry of a segment holds the last
    hash that the commits give the segment before it, if its own holds its segment's seed, so that the whole is one chain."""
    segments = commits(spark, path).select(F.explode("segments").alias("s")).select("s.*")
    # a row a segment
    before = segments.select("name", "first", F.lag("head", 1, C.GENESIS).over(Window.partitionBy(F.lit(0)).orderBy("first")).alias("__before"))
    rows = spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/segments").withColumn("name", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1))
    d = rows.join(before, "name")
    own = F.sha2(F.concat(F.lit("segment:"), "name"), 256)
    link = F.when((F.col("n") == 0) & (F.col("previous_hash") == own), F.col("__before")).otherwise(F.col("previous_hash"))
    return d.select((F.col("first") + F.col("n")).alias("seq"), link.alias("previous_hash"), "timestamp", "finding", "entry_hash")


def edited(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) of committed entries that don't have the hash of what they hold."""
    names = commits(spark, path).select(F.explode("segments.name").alias("name"))
    rows = spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/segments").withColumn("name", F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1)).join(names, "name")
    return rows.where(F.sha2(F.concat_ws("\n", "previous_hash", "timestamp", "finding"), 256) != F.col("entry_hash")).select("name", "n")


def commit_breaks(spark: SparkSession, path: str) -> DataFrame:
    """(number, reason) of commits whose own hash, link, or segments don't hold: a segment has as many entries as its commit
    says, and the last of them the hash that it says."""
    c = commits(spark, path)
    lines = F.transform("segments", lambda s: F.concat_ws(":", s["name"], s["n"].cast("string"), s["first"].cast("string"), s["head"]))
    own = F.sha2(F.concat_ws("\n", F.col("number").cast("string"), "previous_hash", "batch", lines), 256)
    link = F.lag("commit_hash", 1, C.GENESIS).over(Window.partitionBy(F.lit(0)).orderBy("number"))  # a row a commit
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("number")) - 1
    seen = c.withColumns({"own": own, "link": link, "place": place})
    out = seen.where("own <> commit_hash").select("number", F.lit("hash").alias("reason")).union(seen.where("link <> previous_hash or place <> number").select("number", F.lit("link")))
    last = spark.read.schema(ENTRY).json(f"{path.rstrip('/')}/segments").groupBy(F.regexp_extract("_metadata.file_name", r"^(.*)\.jsonl$", 1).alias("name")).agg(F.count(F.lit(1)).alias("got"), F.max_by("entry_hash", "n").alias("end"))
    s = c.select("number", F.explode("segments").alias("s")).select("number", "s.*").join(last, "name", "left")
    return out.union(s.where("got is null or got <> n or end <> head").select("number", F.lit("segment")))
