"""Windowed shift, chains that come out of order, restarts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import chain, redteam
from auditlake.streaming import windows


def run(out, where, name="out"):
    q = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/{name}")
    q.awaitTermination()


def brute_psi(base, now, bins):
    lo, hi = min(base), max(base)
    at = lambda v: max(0, min(bins - 1, math.floor((v - lo) / (hi - lo) * bins) if hi > lo else (bins - 1 if v > hi else 0)))
    share = lambda x, k: max(sum(at(v) == k for v in x) / (len(x) + 1e-6), 1e-6)
    return max(0.0, sum((share(now, k) - share(base, k)) * math.log(share(now, k) / share(base, k)) for k in range(bins)))


@pytest.mark.parametrize("base", [[0.0, 1.0, 2.0, 2.5, 9.0], [3.0, 3.0]])
def test_frozen_histogram(spark, base):
    now = [-5.0, 0.5, 2.0, 3.0, 3.5, 100.0]
    b = windows.frozen(spark.createDataFrame([(x,) for x in [*base, None]], "value double"), 4)
    e = spark.createDataFrame([(f"2024-01-01 00:00:0{k}", v) for k, v in enumerate([*now, None])], "ts string, value double")
    got = windows.windowed_shift(e, b, "1 day").collect()
    assert [(r["n"], pytest.approx(r["psi"])) for r in got] == [(6, brute_psi(base, now, 4))]
    assert windows.windowed_shift(e, windows.frozen(b.select(F.lit(0.0).alias("value")).limit(0), 4), "1 day").count() == 0


def test_windows_of_a_stream_and_late_rows(spark, tmp_path):
    r = random.Random(2)
    base = [(k, r.gauss(0, 1)) for k in "ab" for _ in range(200)]
    b = windows.written(windows.frozen(spark.createDataFrame(base, "kind string, value double"), 10, "kind"), "test")
    rows = [(k, f"2024-01-0{d} {h:02d}:30:00", r.gauss(d / 3, 1)) for d in (1, 2, 3, 4) for h in range(24) for k in "abc"]
    schema = "kind string, ts string, value double"
    batches = [[x for x in rows if x[1] < "2024-01-02 12"], [x for x in rows if "2024-01-02 12" <= x[1] < "2024-01-03 12" and x[1] != "2024-01-03 01:30:00"], [x for x in rows if x[1] >= "2024-01-03 12"]]
    late = [x for x in rows if x[1] == "2024-01-03 01:30:00"] + [("a", "2024-01-01 05:00:00", 1e9)]  # the first within the watermark, the last behind it
    batches[2] += late
    for batch in batches:  # each with the engine started anew, from its checkpoint
        spark.createDataFrame(batch, schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        out = windows.windowed_shift(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), b, "1 day", "12 hours", "kind")
        run(out, tmp_path)
    got = {(x["kind"], str(x["start"])[:10]): (x["n"], x["psi"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for k in "ab":
        for d in ("2024-01-01", "2024-01-02", "2024-01-03"):
            now = [v for kk, t, v in rows if kk == k and t.startswith(d)]
            want[k, d] = (len(now), pytest.approx(brute_psi([v for kk, v in base if kk == k], now, 10)))
    assert got == want


def chains(spark, n):
    rows = [(c, k, "i" * 64, "m" * 64, f"o{c}{k}", f"n{k}", f"2024-01-01 00:{k:02d}:00") for c in ("x", "y") for k in range(n)]
    built = chain.build(spark.createDataFrame(rows, "chain_id string, pos long, input_sha256 string, model_digest string, output_digest string, nonce string, timestamp string"))
    return built.withColumns({"record_id": F.concat("chain_id", F.lit("-"), "pos"), "ts": F.col("timestamp").cast("timestamp")})


def test_records_in_any_order(spark, tmp_path):
    log = windows.written(chains(spark, 40), "test")
    log = log.where("not (chain_id = 'x' and pos = 7)").withColumn("output_digest", F.when(F.expr("chain_id = 'y' and pos = 20"), "edited").otherwise(F.col("output_digest")))
    rows = log.collect()
    r = random.Random(4)
    # each record comes with a delay of up to ten minutes
    arrival = {x["record_id"]: x["pos"] + r.randint(0, 10) for x in rows}
    parts = [[x for x in rows if lo <= arrival[x["record_id"]] < lo + 13] for lo in (0, 13, 26, 39)]
    # nothing else moves the watermark over the last records
    for k, part in enumerate([*parts, [rows[0].asDict() | {"chain_id": "z", "ts": rows[0]["ts"].replace(hour=9)}]]):
        spark.createDataFrame(part, log.schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        run(windows.verify_chain_in_order(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), "15 minutes"), tmp_path)
        if k == 1:  # what comes behind the watermark is dropped
            done = spark.read.parquet(f"{tmp_path}/out")
            assert 0 < done.count() < 40
    names = ["chain_id", "record_id", "sequence_number", "expected_seq", "seq_anomaly", "broken_link", "tampered"]
    want = sorted(tuple(x[n] for n in names) for x in chain.verify(log).collect())
    assert sorted(tuple(x[n] for n in names) for x in spark.read.parquet(f"{tmp_path}/out").where("chain_id <> 'z'").collect()) == want
    assert sum(x[4] for x in want) == 32 and sum(x[5] for x in want) == 1 and sum(x[6] for x in want) == 1


def test_a_record_behind_the_watermark_leaves_a_gap(spark, tmp_path):
    log = windows.written(chains(spark, 30).where("chain_id = 'x'"), "test")
    for part in ("pos < 25 and pos <> 3", "pos = 3 or pos >= 25"):
        log.where(part).write.mode("append").parquet(f"{tmp_path}/in")
        run(windows.verify_chain_in_order(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), "5 minutes"), tmp_path)
    got = {x["sequence_number"]: x["broken_link"] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert 3 not in got and got[4] and sum(got.values()) == 1 and max(got) == 24


def test_attacks_are_judged_as_at_once(spark, tmp_path):
    log = windows.written(chains(spark, 12).where("chain_id = 'x'"), "test")
    swapped = redteam.attacked_chain(log, "output", 4)
    last = log.where("pos = 11").withColumns({"chain_id": F.lit("z"), "ts": F.lit("2024-01-02").cast("timestamp")})
    swapped.unionByName(last).write.parquet(f"{tmp_path}/in")
    run(windows.verify_chain_in_order(spark.readStream.schema(swapped.schema).parquet(f"{tmp_path}/in"), "5 minutes"), tmp_path)
    assert [x["sequence_number"] for x in spark.read.parquet(f"{tmp_path}/out").where("tampered and chain_id = 'x'").collect()] == [4]


@pytest.mark.parametrize("ordered", [True, False])
def test_many_short_chains_share_their_state(spark, tmp_path, ordered):
    n = 3 * windows.GROUPS
    rows = spark.range(2 * n).select(F.concat(F.lit("c"), F.expr(f"id % {n}")).alias("chain_id"), F.expr(f"id div {n}").alias("pos"), F.lit("i").alias("input_sha256"), F.lit("m").alias("model_digest"), F.lit("o").alias("output_digest"), F.col("id").cast("string").alias("nonce"))
    rows = rows.withColumns({"timestamp": F.lit("t"), "us": F.expr("1704067200000000 + pos * 60000000")})
    log = windows.written(chain.build(rows, more=("us",)).withColumns({"record_id": F.col("nonce"), "ts": F.timestamp_micros("us")}), "test")
    # a chain without an id, one without its first record, an edited record
    log = log.where("not (chain_id = 'c1' and pos = 0)").withColumn("output_digest", F.when(F.expr("chain_id = 'c2' and pos = 1"), "edited").otherwise(F.col("output_digest")))
    log = windows.written(log.withColumn("chain_id", F.nullif("chain_id", F.lit("c0"))), "test")
    last = log.where("chain_id = 'c3' and pos = 1").withColumns({"chain_id": F.lit("z"), "ts": F.expr("ts + interval 1 hour")})
    for part in ("pos = 0", "pos = 1"):
        log.where(part).unionByName(last.where(part)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
        out = windows.verify_chain_in_order(stream, "5 minutes") if ordered else windows.verify_chain(stream)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= windows.GROUPS
    names = ["chain_id", "record_id", "sequence_number", "expected_seq", "seq_anomaly", "broken_link", "tampered"]
    got = spark.read.parquet(f"{tmp_path}/out").where("chain_id is null or chain_id <> 'z'")
    assert sorted(repr(tuple(x[n] for n in names)) for x in got.collect()) == sorted(repr(tuple(x[n] for n in names)) for x in chain.verify(log).collect())
