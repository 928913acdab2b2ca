"""The pipeline's stages against brute force on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline as cp
from auditlake.llm import toxicity
from tests.llm.test_operators import brute_components, brute_contamination


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in docs.collect()}
        if name != "sharding":
            assert docs.columns == columns
            rows = {r["doc_id"]: r for r in before}
            assert all(r == rows[r["doc_id"]] for r in docs.collect())
        if name == "toxicity":
            assert after == {r["doc_id"] for r in toxicity.op8_toxicity(spark, data).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert after == {i for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in before]).items() if i == c}
        elif name == "decontamination":
            bad = brute_contamination([r["text"] for r in before], items)
            assert after == {r["doc_id"] for r, b in zip(before, bad) if not b[-1]}
        elif name == "mixing":
            assert after == {r["doc_id"] for r in before} and docs.count() == len(before)
        else:
            sizes = Counter(r["shard"] for r in docs.collect())
            assert len(after) == len(before) and max(sizes.values()) - min(sizes.values()) <= 1
            assert all(sorted(r["slot"] for r in docs.where(f"shard = {s}").collect()) == list(range(k)) for s, k in sizes.items())


def test_run(spark, data, tmp_path):
    out = cp.run(spark, data)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    # the same rows as the stages one after another, each of which test_stages holds against brute force
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = lambda d: sorted((r["doc_id"], r["text"], r["source"], r["shard"], r["slot"]) for r in d.collect())
    got = rows(out)
    assert got == rows(docs) and len(got) > 50


def test_awkward_rows_pass(spark, tmp_path):
    """A tiny source, null ids, texts and sources, copies and repeated rows: only copies and bad documents go."""
    words = [f"w{k}" for k in range(400)]
    text = lambda k: " ".join(random.Random(k).choices(words, k=80))
    rows = [(k, text(k), "en", "big" if k % 5 else "small") for k in range(60)] + [(100, text(1), "en", "big"), (None, text(2), None, None), (None, text(2), None, None), (None, text(70), None, "one"), (101, None, None, None), (102, "", "en", "lone"), (3, text(3), "en", "big")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(5))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r["doc_id"], r["text"]) for r in cp.run(spark, str(tmp_path)).collect())
    want = {(k, text(k)) for k in range(60) if k != 5} | {(None, text(70)), (101, None), (102, "")}
    assert set(got) == want and set(got.values()) == {1}


def test_the_mix_decides_shards(spark, data, tmp_path):
    """Slot by slot the shards hold the documents as mixed: other files or splits change nothing, another order does."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    order = [r["doc_id"] for r in cp.mixing.mix(cp.placed(docs), place_col=cp.PLACE).orderBy("mix_position").collect()]
    cp.mix(spark, docs, data).write.parquet(f"{tmp_path}/mixed")
    dealt = {r["doc_id"]: (r["slot"], r["shard"]) for r in cp.shard(spark, spark.read.parquet(f"{tmp_path}/mixed"), data).collect()}
    assert sorted(dealt, key=dealt.get) == order and all(dealt[x] == divmod(k, cp.SHARDS) for k, x in enumerate(order))
    docs.orderBy("doc_id").write.parquet(f"{tmp_path}/plain")
    assert dealt != {r["doc_id"]: (r["slot"], r["shard"]) for r in cp.shard(spark, spark.read.parquet(f"{tmp_path}/plain"), data).collect()}
