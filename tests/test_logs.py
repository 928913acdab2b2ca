"""Exact spot-check samples, Merkle mountain ranges, checkpoints that grow."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import crypto
from auditlake.operators import chain, merkle, provenance


def hashes(n):
    return [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]


def root(h):
    while len(h) > 1:
        h = h + h[-1:] * (len(h) % 2)
        h = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(h[::2], h[1::2])]
    return h[0] if h else hashlib.sha256(b"EMPTY_MERKLE_TREE").hexdigest()


def leaves(spark, h, start=0):
    return spark.createDataFrame([(k, x) for k, x in enumerate(h, start)], "pos long, h string").repartition(3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 64, 100, 515])
def test_peaks_in_passes(spark, n):
    h = hashes(n)
    peaks = merkle.collected(merkle.forest(merkle.leaf_nodes(leaves(spark, h)), span=3))
    assert sorted(p[0] for p in peaks) == [k for k in range(12) if n >> k & 1]
    assert merkle.root_of(peaks) == root(h)


def test_append_is_rebuild(spark):
    h = hashes(300)
    r = random.Random(1)
    for _ in range(5):
        a, b = sorted((r.randint(0, 300), r.randint(0, 300)))
        first = merkle.forest(merkle.leaf_nodes(leaves(spark, h[:a])))
        grown = merkle.collected(merkle.appended(first, leaves(spark, h[a:b])))
        assert sorted(grown) == sorted(merkle.collected(merkle.forest(merkle.leaf_nodes(leaves(spark, h[:b]))))) and merkle.root_of(grown) == root(h[:b])


def test_at_most_three_exchanges(spark):
    for n in (1000, 1 << 20, 1 << 33, 1 << 45):  # as if the log had n leaves
        nodes = spark.createDataFrame([(0, n - 1, "x")], merkle.PEAKS)
        plan = merkle.forest(nodes)._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("Exchange ") <= 3, plan


def test_gaps_have_no_root(spark):
    h = hashes(10)
    with pytest.raises(ValueError):
        merkle.root_of(merkle.collected(merkle.forest(merkle.leaf_nodes(leaves(spark, h[:4]).union(leaves(spark, h[5:], 5))))))


def test_a_checkpoint_grows(spark):
    key, other = crypto.KeyPair(bytes(range(32))), crypto.KeyPair(bytes(32))
    log = spark.createDataFrame([(k, x) for k, x in enumerate(hashes(50))], "pos long, record_hash string")
    c = provenance.checkpoint(log.where("pos < 13"), "c", key, "t")
    grown = provenance.extended(c, log.where("pos >= 13"), key, "u")
    assert grown == provenance.checkpoint(log, "c", key, "u") and grown["sequence_length"] == 50
    assert provenance.checkpoint_findings(log, grown).count() == 0 and provenance.extended(grown, log.where("pos > 99"), key, "v") == grown
    for bad, new in ((c, log.where("pos > 13")), (c | {"peaks": c["peaks"][1:]}, log.where("pos >= 13")), (c | {"sequence_length": 12}, log.where("pos >= 12"))):
        with pytest.raises(ValueError):
            provenance.extended(bad, new, key, "u")
    with pytest.raises(ValueError):
        provenance.extended(c, log.where("pos >= 13"), other, "u")


@pytest.mark.parametrize("slices", [1, 16, 4096])
def test_each_chain_has_its_exact_sample(spark, slices, monkeypatch):
    monkeypatch.setattr(chain, "SLICES", slices)
    sizes = {"none": 0, "one": 1, "two": 2, "three": 3, "four": 4, "eleven": 11, "long": 1003, None: 6}
    rows = [(c, f"{c}-{k}") for c, n in sizes.items() for k in range(n)]
    records = spark.createDataFrame(rows, "chain_id string, record_id string")
    got = chain.spot_sample(records, chain="chain_id").collect()
    by = {c: [r["record_id"] for r in got if r["chain_id"] == c] for c in sizes}
    rank = lambda r: (hashlib.md5(f"42:{r}".encode()).hexdigest()[:8], r)
    for c, n in sizes.items():
        want = sorted((f"{c}-{k}" for k in range(n)), key=rank)[: max(1, int(n * 0.25)) if n else 0]
        assert sorted(by[c]) == sorted(want), c
    assert chain.spot_sample(records, rate=0.1).count() == len(rows) // 10
    assert chain.spot_sample(records, rate=1.0).count() == len(rows) and chain.spot_sample(records.limit(0)).count() == 0


def test_equal_and_null_ids_are_sampled_by_number(spark):
    records = spark.createDataFrame([(None,)] * 40 + [("a",)] * 40, "record_id string")
    assert chain.spot_sample(records).count() == 20


def test_spot_totals(spark):
    records = spark.range(40).select((F.col("id") % 4).cast("string").alias("chain_id"), F.col("id").cast("string").alias("record_id"), F.array(F.lit(1.0)).alias("logged"))
    inputs = records.where("chain_id <> '3'").select("record_id", F.when(F.col("chain_id") == "1", F.array(F.lit(2.0))).otherwise(F.array(F.lit(1.0))).alias("replayed"))
    got = {r["chain_id"]: tuple(r)[1:] for r in chain.spot_summary(chain.spot_check(records, inputs, chain="chain_id"), "chain_id").collect()}
    assert got == {"0": (2, 2, 0, 0), "1": (2, 0, 2, 0), "2": (2, 2, 0, 0), "3": (2, 0, 0, 2)}


def test_long_chains_are_built_range_by_range(spark, monkeypatch):
    """Chains of over SPAN records beside short ones and one without a name: the same records."""
    rows = [(c, p, f"i{p}", "m", f"o{c}{p}", f"n{p}", "t") for c, n in (("a", 53), ("b", 3), ("c", 21), (None, 4)) for p in range(n, 0, -1)]
    d = spark.createDataFrame(rows, "chain_id string, pos long, input_sha256 string, model_digest string, output_digest string, nonce string, timestamp string")
    want = sorted(map(repr, chain.build(d).collect()))
    monkeypatch.setattr(chain, "SPAN", 10)
    got = chain.build(d).collect()
    assert sorted(map(repr, got)) == want
    a = sorted((r for r in got if r["chain_id"] == "a"), key=lambda r: r["pos"])
    assert [r["sequence_number"] for r in a] == list(range(53)) and all(x["record_hash"] == y["previous_record_hash"] for x, y in zip(a, a[1:]))
