"""WARC archives: round trips, normalised streams, revisits, faults."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from auditlake.llm import warc

LONG = "<p>" + "é漢 text " * 40
ROWS = [
    (3, "http://a/x y\r\nInjected: 1", LONG), (1, "http://b", LONG), (2, None, LONG), (9, "http://c", "short"), (4, "http://c", "short"), (5, "http://d", None), (6, "u", ""),
    (None, "http://e", LONG), (7, "v", "A" * 99), (8, "v", "A" * 99), (10, "v", "B" * 100), (11, "v", "B" * 100), (11, "v", "B" * 100), (12, "w", "\r\n\r\nWARC/1.1\r\n" * 20),
]


def brute(rows):
    """(payload_bytes, digest, type, first id) of each row, rows of equal id alike."""
    firsts, out = {}, []
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            firsts[p] = min(firsts.get(p, i), i)
    seen = set()
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (h or "").encode()
        again = len(p) >= 100 and p in seen
        seen.add(p)
        out.append((repr(i), len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", firsts[p] if again else None))
    return sorted(out, key=repr)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, record_type string, number int").repartition(3)


def query(spark, pages, folder):
    pages.write.parquet(f"{folder}/in/pages.parquet")
    return warc.op11_warc(spark, f"{folder}/in")


def test_warc_query(spark, pages, tmp_path):
    got = query(spark, pages, str(tmp_path))
    assert sorted(((repr(r[0]), *r[1:]) for r in got.collect()), key=repr) == brute(ROWS)


def test_warc_of_no_pages(spark, pages, tmp_path):
    assert query(spark, pages.limit(0), str(tmp_path)).collect() == []


@pytest.mark.parametrize("most", [2, 50_000])
def test_every_record_is_a_member_with_an_index(spark, pages, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", most)
    index = warc.archived(pages, str(tmp_path / "out")).where("error is null").collect()
    assert len(index) == len(ROWS) and not os.path.exists(tmp_path / "out/streams")
    by_file = {}
    for r in index:
        by_file.setdefault(r["archive"], []).append(r)
    assert len(by_file) >= len(ROWS) // most
    for path, rows in by_file.items():
        data = open(path, "rb").read()
        rows.sort(key=lambda r: r["offset"])
        assert rows[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:])) and rows[-1]["offset"] + rows[-1]["length"] == len(data)
        side = [json.loads(x) for x in open(f"{path}.jsonl")]
        assert [(x["offset"], x["length"], x["record_id"]) for x in side] == [(r["offset"], r["length"], r["record_id"]) for r in rows]
        for r in rows:
            one = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {r['record_id']}\r\n".encode() in one
            assert b"Injected: 1\r\n" not in one
            assert (b"WARC-Type: revisit" in one) == (r["record_type"] == "revisit") == (b"WARC-Profile" in one)


def test_payloads_are_read_by_offset(spark, pages, tmp_path):
    index = warc.archived(pages, str(tmp_path / "out"), least=1 << 40)
    got = warc.read_records(index, payload=True).collect()
    assert sorted((warc.row_id(r["record_id"]) or "", bytes(r["payload"])) for r in got) == sorted(("" if i is None else str(i), (h or "").encode()) for i, _, h in ROWS)
    # what revisits refer to are the ids of records that are there
    index = warc.archived(pages, str(tmp_path / "more"))
    got = warc.read_records(index).collect()
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(ROWS) and all(ids[r["refers_to"]]["payload_digest"] == r["payload_digest"] for r in got if r["refers_to"])


def record(kind, body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:%d>\r\n" % len(body) + extra + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_other_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    noise = os.urandom(200_000)
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    whole = record(b"warcinfo", b"software: x") + record(b"resource", noise, b"X-Long: a\r\n b\r\n") + record(b"response", http, b"Content-Type: application/http\r\n") + record(b"metadata", b"")
    files = {
        "one.warc.gz": gzip.compress(whole), "plain.warc": whole, "members.warc.gz": gzip.compress(whole[:300]) + gzip.compress(whole[300:]), "cut.warc.gz": gzip.compress(whole)[:100_000],
        "short.warc": whole[:-100], "other.gz": gzip.compress(b"no warc"), "empty.warc.gz": b"", "length.warc": b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", "colon.warc": b"WARC/1.0\r\nhello\r\n\r\n",
    }
    for n, data in files.items():
        (tmp_path / n).write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / n),) for n in files], "archive string")
    index = warc.stored(warc.normalise(archives, str(tmp_path / "out"), tasks=3), "test")
    rows = index.collect()
    of = lambda n: sorted((r for r in rows if f"/{n.split('.')[0]}-" in r["archive"]), key=lambda r: r["number"])
    for n in ("one.warc.gz", "plain.warc", "members.warc.gz"):
        assert [(r["record_type"], r["payload_bytes"], r["error"]) for r in of(n)] == [("warcinfo", 11, None), ("resource", 200_000, None), ("response", 5, None), ("metadata", 0, None)]
        assert of(n)[1]["payload_digest"] == hashlib.sha256(noise).hexdigest()
    assert [r["error"] is None for r in of("cut.warc.gz")] == [True, False] and [r["error"] is None for r in of("short.warc")] == [True, True, False]
    assert [r["error"] is None for r in of("other.gz")] == [False] and of("empty.warc.gz") == [] and all(r["error"] for n in ("length", "colon") for r in of(n))
    read = warc.read_records(index, payload=True).collect()
    assert len(read) == sum(r["error"] is None for r in rows) and {bytes(r["payload"]) for r in read} == {b"software: x", noise, b"hello", b""}
    # a second pass changes nothing but names
    again = warc.normalise(index.where("error is null").select("archive"), str(tmp_path / "again")).collect()
    key = lambda r: (r["record_id"], r["payload_digest"], r["payload_bytes"], r["record_type"])
    assert sorted(map(key, again)) == sorted(key(r) for r in rows if r["error"] is None)


def test_one_payload_of_many_pages(spark):
    m = spark.range(3000).select(F.lit("f/a.warc.gz").alias("archive"), F.col("id").alias("number"), (F.lit(5000) - F.col("id")).alias("id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), F.lit(200).alias("payload_bytes"), F.lit("d").alias("payload_digest"))
    got = warc.revisits(m).collect()
    assert len(got) == 2999 and {r["refers_to"] for r in got} == {"r2999"}
