"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.llm import resampling


def features(text, max_n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[k : k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, percent, buckets, max_n, min_words):
    h = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(h(f) for x in texts for f in features(x, max_n)[1]) for texts in ([x for _, x in rows], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x, max_n)
        weight = sum(gain[h(y)] for y in f) // len(f) if f else 0
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(fit):
        r.append(k + 1 if k < percent * len(fit) // 100 else None)
    return sorted(((*r, None)[:6] for r in out), key=repr)


def rows_of(n):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "x" * 5000]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, texts[3]), (10_000, None), (10_001, ""), (10_002, " 12 --"), (10_003, "W1 " * 30_000)]


@pytest.mark.parametrize("percent, max_n, min_words", [(10, 1, 20), (33, 2, 5), (100, 1, 0), (0, 1, 20)])
def test_resampling(spark, percent, max_n, min_words):
    rows, target = rows_of(300), ["w1 w2 w3 É", None, "W2, w3", ""]
    d = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, score string, rank int")
    b = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(d, b, percent, buckets=500, max_n=max_n, min_words=min_words)
    assert out.columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((tuple(r) for r in out.drop("text").collect()), key=repr)
    assert got == brute(rows, target, percent, 500, max_n, min_words)


def test_resampling_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(d.limit(0), d).collect() == []
    assert [(r["n_features"], r["rank"]) for r in resampling.resample(d, d.limit(0), min_words=1, percent=100).collect()] == [(3, 1)]


def test_ties_of_many_equal_rows(spark):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).alias("n_words"), F.lit(30).alias("n_features"), F.lit(0).alias("weight"), (F.col("id") % 3).alias("score"))
    ranks = {r["doc_id"]: r["rank"] for r in resampling.ranked(scored, 50).collect()}
    order = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [ranks[i] for i in order] == [*range(1, 2501), *[None] * 2500]


def test_a_draw_favours_what_the_target_has(spark):
    r = random.Random(3)
    text = lambda own: " ".join(r.choice(own) for _ in range(40))
    near, far = [f"n{k}" for k in range(30)], [f"f{k}" for k in range(30)]
    d = spark.createDataFrame([(k, text(near if k % 10 == 0 else far)) for k in range(1000)], "doc_id long, text string")
    drawn = resampling.resample(d, spark.createDataFrame([(text(near),) for _ in range(50)], "text string"), percent=8).where("rank is not null").collect()
    assert len(drawn) == 80 and sum(r["doc_id"] % 10 == 0 for r in drawn) > 60
