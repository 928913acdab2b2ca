"""Operators of the llm subpackage against brute force, on awkward rows."""

import binascii
import hashlib
import math
import time
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import common, decontam, langid, license_scan, mixing, neardup, pii, quality, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score double, kept boolean, shard int, h string, n int, w string, key string, tokens string"
R = random.Random(1)
VOCABULARY = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 6))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def awkward():
    base = prose(120, 7)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    texts = [
        base, base, near, base.upper(), None, "", "   \n\t ", "one", "two words", "one", prose(40, 8), prose(30_000, 9), "é " * 80, base + " " + prose(60, 10), "a a a a a a a",
        "mail me: x@y.org or +49 170 1234567, card 4111 1111 1111 1111, ip 10.0.0.1", "Licensed under the Apache License, Version 2.0.", " ".join(words[20:40]),
    ]
    rows = [(k, t, ["en", None, "de"][k % 3], ["a", None, "b", "a"][k % 4]) for k, t in enumerate(texts)]
    rows += [rows[0], (None, prose(50, 11), None, None), (None, None, None, None)]
    return [(*r, 1.0, True, 3, "h", 1, "w", "k", "t") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted((repr(r["doc_id"]), *(r[c] for c in columns)) for r in df.collect())


# --- hashing -----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\n\t x ", max_size=30)), max_size=6))
def test_word_and_shingle_hashes_tell_words_apart(texts):
    data, at = common.text_bytes(pa.array(texts, pa.string()))
    h, word_at = common.hash_words(data, at)
    words = [w for t in texts for w in common.words_of(t or "")]
    assert len(words) == len(h) and np.diff(word_at).tolist() == [len(common.words_of(t or "")) for t in texts]
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    s, s_at = common.hash_shingles(h, word_at)
    lists = [common.words_of(t or "") for t in texts]
    want = [tuple(x[k : k + 5]) for x in lists for k in range(max(len(x) - 4, min(1, len(x))))]
    assert len(want) == len(s) and len(set(zip(want, s.tolist()))) == len(set(want)) == len(set(s.tolist()))


# --- 1: language -------------------------------------------------------------


def substring_phrases(text, learned):
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in learned:
            end += 1
        at = max(at + 1, end - 1)
        n += 1
    return n


def test_cross_parsing_is_longest_match():
    learned = {"x": "abracadabra abrac", "y": "hocus pocus hocus"}
    p = langid.CrossParser(learned)
    for text in ("abracabra", "pocus abra", "zzz", "a", "hocus pocus"):
        n, _ = p.phrases([text])
        sym = lambda t: "".join(chr(c) for c in langid.symbols(t).tolist())
        assert n[0].tolist() == [substring_phrases(sym(text), sym(learned[k])) for k in p.langs], text


@pytest.mark.parametrize("piece", [48, 1 << 21])
def test_cross_parsing_over_blocks(monkeypatch, piece):
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "PIECE", piece)
    r = random.Random(4)
    learned = {"x": "".join(r.choice("ab") for _ in range(200)), "y": "".join(r.choice("abc é漢") for _ in range(300))}
    p = langid.CrossParser(learned)
    texts = ["".join(r.choice("abc é漢字") for _ in range(n)) for n in (1, 15, 16, 17, 100, 333)] + ["ab" * 200, learned["x"] * 2, ""]
    n, sizes = p.phrases(texts)
    sym = lambda t: "".join(chr(c) for c in langid.symbols(t).tolist())
    assert n.tolist() == [[substring_phrases(sym(t), sym(learned[k])) for k in p.langs] for t in texts] and sizes.tolist() == [len(sym(t)) for t in texts]


def test_languages_of_large_scripts(monkeypatch):
    r = random.Random(6)
    letters = {"ja": range(0x3041, 0x30F0), "zh": range(0x5000, 0x5600), "zy": range(0x5600, 0x5C00), "ko": range(0xAC00, 0xB400), "am": range(0x1200, 0x1350), "ru": range(0x430, 0x450), "en": range(97, 123)}
    words = {k: ["".join(chr(r.choice(v)) for _ in range(r.randint(1, 4))) for _ in range(400)] for k, v in letters.items()}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    p = langid.CrossParser({k: text(k, 3000) for k in letters})
    ask = [(k, text(k, 30)) for k in letters for _ in range(5)]
    lang, score, _ = p.predict([t for _, t in ask])
    assert lang == [k for k, _ in ask] and min(score) > 0.9
    # the bound on tables shortens what is learned of each language
    monkeypatch.setattr(langid, "TABLE_BYTES", 1 << 20)
    small = langid.CrossParser({k: text(k, 3000) for k in letters})
    assert sum(t.nbytes for t in small.tables) <= 1.1 * (1 << 20) and small.predict([text("ja", 30)])[0] == ["ja"]


def test_language(spark, docs, empty):
    en = "the quick brown fox jumps over the lazy dog and runs away from the house " * 30
    de = "der schnelle braune fuchs springt über den faulen hund und läuft vom haus weg " * 30
    rows = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([(en, "en"), (de, "de")] * 4)], "doc_id long, text string, lang string")
    learned = langid.learning_texts(rows)
    ask = spark.createDataFrame([(1, "the dog runs over the house"), (2, "der hund läuft über den fuchs"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    assert by_id(langid.detect_language(ask, learned), "lang_pred") == [("1", "en"), ("2", "de"), ("3", "und"), ("4", "und"), ("5", "und")]
    assert langid.detect_language(docs, learned).count() == docs.count() and langid.detect_language(empty, learned).count() == 0
    assert {r["lang_pred"] for r in langid.detect_language(docs, {}).collect()} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in langid.detect_language(docs, learned).collect())


def test_languages_of_unequal_size():
    r = random.Random(12)
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 6))) for _ in range(300)] for k, v in {"en": "abcdefghiklmno", "de": "abcdefghjklpru", "small": "cdefgilmnoprstu"}.items()}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    learned = {"en": text("en", 12_000), "de": text("de", 12_000), "small": text("small", 1200)}
    ask = [(k, text(k, n)) for k in learned for n in (4, 20, 300) for _ in range(10)]
    base = langid.CrossParser(learned).predict([t for _, t in ask])
    assert sum(a == k for a, (k, _) in zip(base[0], ask)) >= 87
    for extra in ("ok", "123", "", "ni hao", "e", "the quick brown fox jumps over the lazy dog", "漢字"):
        assert langid.CrossParser(learned | {"zz": extra}).predict([t for _, t in ask])[0] == base[0], extra
    assert langid.CrossParser({"zz": "12 34", "yy": ""}).predict(["ab", None]) == (["und"] * 2, [0.0] * 2, [0.0] * 2)


def test_language_query_against_brute_force(spark, tmp_path):
    r = random.Random(13)
    words = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 6))) for _ in range(80)] for k, v in {"aa": "abcdefghi", "bb": "efghijklm"}.items()}
    rows = [(k, " ".join(r.choice(words[lang]) for _ in range(r.randint(1, 60))), lang) for k in range(60) for lang in [r.choice(["aa", "bb"])]]
    rows += [(100, None, "aa"), (101, "12 !!", "cc"), (102, "É ß 漢", None), (103, "ok", "dd"), (104, "", "bb"), (None, "fgh ihg", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda i: None if i is None else binascii.crc32(str(i).encode()) % 3
    fit = spark.createDataFrame([x for x in rows if crc(x[0]) not in (1, None)], "doc_id long, text string, lang string")
    learned = langid.learning_texts(fit)
    sym = lambda t: "".join(chr(c) for c in langid.symbols(t).tolist())
    cost = {k: (sym(v), math.log2(max(4096, len(sym(v))))) for k, v in learned.items() if re.search(r"[^\W\d_]", v)}
    for x in langid.op1_langid(spark, str(tmp_path)).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"])
        assert x["held_out"] == (crc(x["doc_id"]) == 1)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (x["lang_pred"], x["score"]) == ("und", 0)
            continue
        bits = {k: substring_phrases(sym(text), own) * c / len(sym(text)) for k, (own, c) in cost.items()}
        best = min(sorted(bits), key=lambda k: bits[k])
        assert x["lang_pred"] == best and x["score"] == pytest.approx(1 / sum(2 ** (-8 * (b - bits[best]) / bits[best]) for b in bits.values()))


def test_language_refuses_a_column_of_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 3)
    with pytest.raises(ValueError):
        langid.learning_texts(spark.createDataFrame([(k, "abc", str(k)) for k in range(9)], "doc_id long, text string, lang string"))


def test_language_held_out_accuracy(spark, data):
    d = langid.op1_langid(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert d.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


# --- 2: decontamination ------------------------------------------------------


def brute_contamination(texts, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("most", [64, 1 << 27])
def test_decontamination(spark, docs, empty, most, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_HASHES", 0 if most == 64 else most)
    monkeypatch.setattr(decontam, "MOST_BITS", most)  # a table so small lets nearly all pass
    words = prose(120, 7).split()
    items = [(1, " ".join(words[20:40])), (2, "Two  WORDS"), (3, None), (4, ""), (5, "one"), (6, " ".join(words[25:45])), (7, prose(20, 99)), (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = awkward()
    got = decontam.contaminated_documents(docs, bench)
    want = sorted((repr(r[0]), *b) for r, b in zip(rows, brute_contamination([r[1] for r in rows], items)))
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontam.contaminated_documents(empty, bench).count() == 0
    assert decontam.contaminated_documents(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_of_equal_ids_and_common_windows(spark):
    shared = prose(20, 3)
    items = [(k, shared) for k in range(30)] + [(50, prose(15, 5)), (51, "x y")]
    rows = [(1, shared + " " + prose(30, 8)), (1, prose(15, 5)), (1, "a x y b"), (None, shared), (None, shared), (2, prose(60, 9)), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated_documents(d, spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((repr(r[0]), *b) for r, b in zip(rows, brute_contamination([t for _, t in rows], items)))
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_bit_tables_hold_all_and_little_else(spark):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("h"))
    table, bits = decontam.bit_table(hashes, 2000)
    others = spark.range(10_000, 110_000).select(F.xxhash64("id").alias("h"))
    assert hashes.where(decontam._maybe(F.col("h"), table, bits)).count() == 2000
    assert others.where(decontam._maybe(F.col("h"), table, bits)).count() < 200 and bits == 1 << 16
    assert others.where(decontam._maybe(F.col("h"), *decontam.bit_table(hashes.limit(0), 0))).count() == 0


def test_decontamination_reads_documents_twice(spark, monkeypatch):
    reads = []
    monkeypatch.setattr(decontam, "positions", lambda *a, real=decontam.positions: reads.append(1) or real(*a))
    items = spark.range(400).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.concat(F.lit("w"), F.col("id") * 7 + k)), " ").alias("text"))
    d = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), F.substring("text", 1, 120)).alias("text"))
    got = decontam.contaminated_documents(d, items)
    assert got.where("contaminated").count() == 400 and len(reads) == 2


def test_decontamination_plan_is_native(spark, docs):
    bench = spark.createDataFrame([(1, prose(20, 7))], "item_id long, text string")
    plan = decontam.contaminated_documents(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_langid_learns_from_long_texts(spark):
    rows = [(1, "ab " * 9000, "long"), (2, "cd " * 20, "short")]
    t = langid.learning_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {k: len(v) for k, v in t.items()} == {"long": langid.SAMPLE_CHARS, "short": 60}


# --- 3: mixing ---------------------------------------------------------------


def worst_lag(blocks, weights, slots):
    """The largest distance, after any slot, of a source's blocks so far from its exact fluid share;
    sources that are used up leave."""
    left, done, worst = [Fraction(n) for n in blocks], [0] * len(blocks), Fraction(0)
    for s, k in slots:
        assert k == done[s]
        done[s] += 1
        time = Fraction(1)
        while time > 0:
            alive = [i for i, n in enumerate(left) if n > 0]
            total = sum(weights[i] for i in alive)
            step = min([time, *(left[i] * total / weights[i] for i in alive)])
            for i in alive:
                left[i] -= step * weights[i] / total
            time -= step
        worst = max([worst, *(abs(done[i] - blocks[i] + left[i]) for i in range(len(blocks)))])
    assert done == blocks
    return worst


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 25), st.integers(1, 1000)), min_size=1, max_size=8))
def test_lag_is_less_than_one_block(tasks):
    blocks, weights = map(list, zip(*tasks))
    assert worst_lag(blocks, weights, mixing.schedule(blocks, weights)) < 1


@pytest.mark.parametrize("blocks, shares", [([3, 300, 200], [1e-5, 0.5, 0.3]), ([1, 1, 500], [1, 1, 1]), ([400, 40, 4], [1e-9, 1e-3, 1]), ([1] * 300, list(range(1, 301)))])
def test_lag_of_awkward_weights(blocks, shares):
    weights = mixing.whole_weights(shares)
    assert all(Fraction(a) * weights[0] == Fraction(shares[0]) * b for a, b in zip(shares, weights))
    assert worst_lag(blocks, weights, mixing.schedule(blocks, weights)) < 1


def test_many_sources_keep_their_weights():
    weights = list(range(1, 1501))
    slots = mixing.schedule([20] * 1500, weights)
    done = Counter(s for s, _ in slots[:10_000])
    first_end = 20 * sum(weights) // 1500
    assert all(abs(done[s] - 10_000 * w / sum(weights)) < 1 for s, w in enumerate(weights)) and first_end > 10_000


def test_mixing(spark, docs, empty):
    d = spark.createDataFrame([(k, "a" if k % 3 else "b" if k % 2 else None) for k in range(3000)], "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, None: 0.2}
    m = mixing.mix(d, weights, block=4).collect()
    assert sorted(r["mix_position"] for r in m) == list(range(3000))
    # rows of the query's result, in order, are the schedule's blocks
    count = Counter(r["source"] for r in m)
    names = sorted(count, key=lambda s: (s is not None, str(s)))
    places = sorted((r["mix_position"], r["mix_block"], r["source"]) for r in m)
    slots, seen = {}, Counter()
    for _, slot, s in places:
        assert slots.setdefault(slot, s) == s
    done = Counter()
    order = [(names.index(slots[t]), done.update([slots[t]]) or done[slots[t]] - 1) for t in range(len(slots))]
    assert worst_lag([-(-count[s] // 4) for s in names], mixing.whole_weights([weights[s] for s in names]), order) < 1
    assert all(n <= 4 for n in Counter(t for _, t, _ in places).values())
    inside = sum(r["in_mix"] for r in m)
    assert inside > 1000 and mixing.mix(docs).count() == docs.count() and mixing.mix(empty).count() == 0
    out = mixing.mixed(d.withColumn("target", F.lit("own")), weights, block=4)
    assert out.columns == ["doc_id", "source", "target"] and out.count() == inside


def test_mix_query(spark, data):
    m = mixing.op3_mix(spark, data).collect()
    assert sorted(r["mix_position"] for r in m) == list(range(len(m)))
    count = Counter(r["source"] for r in m)
    names = sorted(count, key=lambda s: (s is not None, str(s)))
    done, order = Counter(), []
    for r in sorted(m, key=lambda r: r["mix_position"]):  # blocks of one document here
        order.append((names.index(r["source"]), done[r["source"]]))
        done[r["source"]] += 1
    assert worst_lag([count[s] for s in names], mixing.whole_weights([count[s] ** mixing.TEMPER for s in names]), order) < 1


def test_mixing_keeps_all_rows_when_small_sources_run_out(spark):
    d = spark.createDataFrame([(k, None if k < 3 else f"tiny{k % 4}" if k < 20 else "ab"[k % 3 > 0]) for k in range(20_000)], "doc_id long, source string")
    m = sorted((r["mix_position"], r["doc_id"]) for r in mixing.mix(d).collect())
    assert [p for p, _ in m] == list(range(20_000))
    out = mixing.ordered(d)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20_000))
    # runs lie whole and in order within the parts written
    place = {i: p for p, i in m}
    for part in out.rdd.glom().collect():
        at = [place[r["doc_id"]] for r in part]
        assert at == sorted(at)
    # the large sources go on at their weights behind the end of the small ones
    source = {r["doc_id"]: r["source"] for r in d.collect()}
    shares = mixing.tempered_shares(Counter(source.values()))
    late = [source[i] for p, i in m if 10_500 <= p < 17_000]
    assert set(late) == {"a", "b"} and abs(late.count("a") - len(late) * shares["a"] / (shares["a"] + shares["b"])) <= 2
    gone = mixing.mix(d, {"a": 1.0}).collect()
    assert len(gone) == 20_000 and all((r["mix_position"] is None) == (r["source"] != "a") for r in gone)


# --- 4: licences -------------------------------------------------------------


def test_licence_texts_of_any_length():
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefghijkl") for _ in range(7)) for _ in range(6000))
    t = license_scan.Templates({"long": text})
    found, _ = t.matches(pa.array(["before it " * 20 + text + " behind", text[: len(text) // 4], None], pa.string()))
    assert [[m[0] for m in f] for f in found] == [["long"], [], []]
    assert all(license_scan.guaranteed(m) > 0.999 for m in (2049, 3073, 4097, 6000, 6145, 9000, 100_000))


def brute_outermost(m):
    inside = lambda x, y: x[0] != y[0] and y[1] <= x[1] and x[2] <= y[2] and (y[2] - y[1], y[0]) > (x[2] - x[1], x[0])
    return sorted((x for x in m if not any(inside(x, y) for y in m)), key=lambda x: (x[1], x[0]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(1, 8)), max_size=6), min_size=1, max_size=4))
def test_licence_matches_within_others(gaps):
    matches = []
    for k, own in enumerate(gaps):  # those of one name don't overlap
        at = 0
        for gap, size in own:
            matches.append((f"t{k}", at + gap, at + gap + size, 1.0))
            at += gap + size
    assert license_scan.outermost(matches) == brute_outermost(matches)


def test_many_licence_lines_in_one_text():
    t, began = license_scan.Templates(license_scan.TEMPLATES), time.time()
    found, _ = t.matches(pa.array(["Licensed under the Apache License, Version 2.0.\nline of code\n" * 100_000], pa.string()))
    assert len(found[0]) == 100_000 and time.time() - began < 60


def brute_containment(text, templates):
    """Templates of which some window of words, as long as a window of their class, holds enough."""
    split = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", t.lower())
    w, out = split(text), set()
    for name, template in templates.items():
        x = split(template)
        k = min(5, len(x))
        own = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        got = [tuple(w[i : i + k]) in own and tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        width = 2 * license_scan.block_of(len(own))
        for i in range(0, max(1, len(got)), width // 2):
            if len(own) and len({g for g in got[i : i + width] if g}) >= 0.75 * len(own):
                out.add(name)
    return out


def test_licences_against_brute_force():
    r = random.Random(9)
    templates = dict(license_scan.TEMPLATES) | {"mit:name": "MIT License", "own:one": "Publicdomainish", "own:four": "all rights are reserved"}
    names, texts = sorted(templates), []
    for k in range(240):
        words = templates[names[k % len(names)]].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = "changed"
        texts.append(prose(r.randint(0, 80), k) + " " + " ".join(words[: len(words) - r.randint(0, len(words) // 6)]) + " " + prose(r.randint(0, 80), k + 999))
    known = license_scan.Templates(templates)
    found, n_words = known.matches(pa.array(texts, pa.string()))
    want = [brute_containment(t, templates) for t in texts]
    # matches within a longer match are left out
    covered = lambda m, name, n: any(y - x >= n for _, x, y, _ in m)
    hits = [(name in {x[0] for x in m} or covered(m, name, 1)) for m, w in zip(found, want) for name in w]
    assert len(hits) > 150 and sum(hits) >= 0.99 * len(hits)
    assert all({x[0] for x in m} <= w for m, w in zip(found, want))
    assert all(x[2] <= n and x[1] < x[2] for m, n in zip(found, n_words) for x in m)


def test_short_licence_names():
    t = license_scan.Templates({"mit": "MIT License", "gpl": "GNU General Public License", "long": "a b c d e f"})
    found, _ = t.matches(pa.array(["the MIT license here and the MIT License again", "mit", "license mit", "gnu general public license", None], pa.string()))
    assert [[x[:3] for x in m] for m in found] == [[("mit", 1, 3), ("mit", 6, 8)], [], [], [("gpl", 0, 4)], []]


def test_licenses(spark, docs, empty):
    notice = license_scan.TEMPLATES["apache-2.0:notice"]
    words = notice.split()
    edited = " ".join(words[:40] + ["altered"] + words[41:])
    rows = [(1, prose(300, 1) + "\n" + edited + " " + prose(300, 2)), (2, prose(50, 3)), (3, "released under the mit license"), (4, " ".join(words[:20]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(license_scan.license_matches(d), "licenses")
    assert got == [("1", "apache-2.0"), ("2", ""), ("3", "mit"), ("4", "apache-2.0")]
    m = {r["doc_id"]: r["matches"] for r in license_scan.license_matches(d).collect()}
    assert [x["template"] for x in m[1]] == ["apache-2.0:notice"] and [x["template"] for x in m[4]] == ["apache-2.0:line"]
    assert license_scan.license_matches(docs).where("n_matches > 0").count() == 1
    assert license_scan.license_matches(empty).count() == 0 and license_scan.license_matches(docs, {}).where("n_matches > 0").count() == 0
    known = license_scan.Templates(license_scan.TEMPLATES)
    assert all(license_scan.guaranteed(len(s)) > 0.999 for s in known.sets)


# --- 5: near duplicates ------------------------------------------------------


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = common.words_of(t or "")
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and find(a) != find(b) and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("small", [2, 32])
def test_near_duplicates(spark, empty, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    r, rows = random.Random(5), []
    for g in range(6):
        words = prose(100, 50 + g).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            rows.append(" ".join(w[: r.randint(85, 100)]))
    rows += [prose(80, 200 + k) for k in range(10)] + [None, "", " ", "one", "one", "two words"]
    shared = prose(60, 400)
    rows += [shared + " " + prose(40, 500 + k) for k in range(10)]
    rows = list(enumerate(rows))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_components(rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want
    assert {x["doc_id"] for x in got.where("kept").collect()} == {i for i, (_, c) in want.items() if i == c}
    assert neardup.near_duplicates(empty).count() == 0


def test_one_of_each_group(spark, docs):
    kept = neardup.one_of_each_group(docs)
    rows = awkward()
    want = {i for i, (_, c) in brute_components([(r[0], r[1]) for r in rows if r[0] is not None]).items() if i == c}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2
    # copies without an id: one of each group stays, one with an id where there is any
    a, b, c = prose(90, 70), prose(90, 71), prose(90, 72)
    mixed = [(None, a), (None, a), (None, a + " end"), (None, b), (None, b), (7, b), (8, c), (None, None), (None, None), (9, None), (10, ""), (8, c)]
    for kind in ("long", "string"):
        d = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t) for i, t in mixed], f"doc_id {kind}, text string")
        left = [(r["doc_id"] and int(r["doc_id"]), r["text"]) for r in neardup.one_of_each_group(d).collect()]
        assert sorted(i for i, _ in left if i) == [7, 8, 9, 10] and sum(i is None for i, _ in left) == 2 and sum(t in (a, a + " end") for _, t in left) == 1


def test_groups_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "SALTS", 8)
    d = spark.createDataFrame([(k % 3 and 1 or k, k) for k in range(300)], "key long, v long")
    got = {(r["key"], r["v"]): (r["n"], r["hi"]) for r in common.with_group(d, "key", "v", n=(F.count(F.lit(1)), "sum"), hi=(F.max("v"), "max")).collect()}
    n = Counter(k % 3 and 1 or k for k in range(300))
    assert len(got) == 300 and all(x[0] == n[k] and x[1] == (299 if k == 1 else k) for (k, _), x in got.items())
    other = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (999, "d")], "key long, w string")
    assert Counter(r["w"] for r in common.attached(d, other, "key", "v").collect()) == {"a": 200, "b": 200, "c": 1}
    before = common.earlier(d.select("key", F.col("v").alias("p"), F.lit(1).alias("x")), "key", "p", "x", "b", span=7).collect()
    assert all(r["b"] == (0 if r["key"] != 1 else sum(k % 3 > 0 for k in range(r["p"]))) for r in before)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_components(spark, pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = neardup.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in parent}


# --- 6: sharding -------------------------------------------------------------


@pytest.mark.parametrize("n, shards", [(0, 4), (3, 4), (1001, 7)])
def test_sharding(spark, n, shards):
    d = spark.range(n).select((F.col("id") % 500).alias("doc_id"), F.lit("own").alias("slot"))
    got = sharding.shard(d, shards, ["doc_id"], size=1)
    rows = got.collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == n and (n < shards or max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards)
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k)) for s, k in sizes.items())
    assert got.columns == ["doc_id", "shard", "slot"]


def test_sharding_awkward(spark, docs, empty):
    assert sharding.shard(docs, 5, ["doc_id", "text"]).count() == docs.count() and sharding.shard(empty, 5, ["doc_id"]).count() == 0


def test_hypergeometric():
    rng = np.random.default_rng(1)
    m = sharding.communication_matrix([10, 0, 33, 7], 4, 1)
    assert [sum(r) for r in m] == [10, 0, 33, 7] and sorted(map(sum, zip(*m))) == [12, 12, 13, 13]
    big = [sharding.hypergeometric(rng, 2 * 10**9, 10**9, 3000) for _ in range(300)]
    assert abs(np.mean(big) - 2000) < 8 and 18 < np.std(big) < 34


@pytest.mark.parametrize("total", [10**9, 10**12, 10**15])
def test_hypergeometric_of_large_tables(total):
    rng, good, draws = np.random.default_rng(2), total // 40, min(total // 256, 10**7)
    x = np.array([sharding.hypergeometric(rng, good, total - good, draws) for _ in range(400)])
    mean, sd = draws / 40, np.sqrt(draws / 40 * (39 / 40) * (total - draws) / (total - 1))
    assert abs(x.mean() - mean) < 4 * sd / 20 and 0.85 * sd < x.std() < 1.15 * sd
    # small enough to be enumerated: the inversion is the law
    y = [sharding.hypergeometric(rng, total, 2 * total, 3) for _ in range(4000)]
    assert np.allclose(np.bincount(y, minlength=4) / 4000, [8 / 27, 12 / 27, 6 / 27, 1 / 27], atol=0.03)


def test_shard_query_is_uniform(spark, data):
    rows = sharding.op6_shard(spark, data).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    # runs of ids come to all shards and to all parts of them alike: 27 and 9 degrees of freedom
    d = sharding.shard(spark.range(4000).select(F.col("id").alias("doc_id")), 4, ["doc_id"]).collect()
    by_shard, by_slot = (Counter(x) for x in ([(r["doc_id"] // 400, r["shard"]) for r in d], [(r["doc_id"] // 1000, r["slot"] // 250) for r in d]))
    assert sum((by_shard[a, b] - 100) ** 2 / 100 for a in range(10) for b in range(4)) < 60
    assert sum((by_slot[a, b] - 250) ** 2 / 250 for a in range(4) for b in range(4)) < 30


def test_equal_rows_are_spread_over_partitions(spark, tmp_path):
    spark.createDataFrame([(1, "same", "a")] * 20_000 + [(2, "x", None)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = common.placed(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    part = sharding._part("__a", F.lit(40))
    sizes = lambda identity: max(r["count"] for r in sharding.dealt_rows(d, identity, 6).groupBy("__g", part.alias("p")).count().collect())
    assert sizes(["doc_id", "text"]) == 20_000 and sizes(["doc_id", "text", common.PLACE]) < 40
    got = sharding.op6_shard(spark, str(tmp_path)).collect()
    by = Counter(r["shard"] for r in got)
    assert len(got) == 20_001 and max(by.values()) - min(by.values()) <= 1 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in by.items())
    assert sorted(r["mix_position"] for r in mixing.op3_mix(spark, str(tmp_path)).collect()) == list(range(20_001))


# --- 7: quality --------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered.update((k, k + 1, k + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, docs, empty):
    rows = awkward()
    got = quality.quality(docs)
    assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((repr(r[0]), *brute_quality(r[1])) for r in rows)
    assert got.where("base_failed and kept").count() == 0 and quality.quality(empty).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("a b\n|é\t", max_size=60), min_size=1, max_size=5))
def test_quality_counts(spark, texts):
    d = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = with_features(d).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got] == [brute_quality(t) for t in texts]


def with_features(d):
    return quality.features(d, quality.common_words(d, "text", "lang"), "doc_id", "text", "lang")


def test_quality_of_small_languages(spark):
    r = random.Random(8)
    letters = {"ru": range(0x430, 0x450), "el": range(0x3B1, 0x3CA), "zh": range(0x5000, 0x5600)}
    words = {k: ["".join(chr(r.choice(v)) for _ in range(r.randint(1, 7))) for _ in range(300)] for k, v in letters.items()}
    # a few words are frequent, as in every language
    text = lambda k, n: "".join(f"{r.choice(words[k][:9] if r.random() < 0.4 else words[k])}{r.choice(['', '', '', ',', '.'])} " for _ in range(n))
    rows = [(k, prose(300, k), "en") for k in range(400)]
    rows += [(1000 + 100 * n + k, text(lang, 300), label) for n, (lang, label) in enumerate([("ru", "ru"), ("el", "el"), ("zh", "zh"), ("ru", None), ("zh", "en")]) for k in range(15)]
    rows += [(5000, text("el", 90), "one"), (5001, "%$ 12 | " * 5 + " ".join(f"{k} |" for k in range(150)), "en"), (5002, "12 | " * 3 + " ".join(f"{k} |" for k in range(150)), "digits")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality(d).collect()}
    assert [i for i, (failed, kept) in got.items() if not failed and not kept] == [5001] and not any(failed for failed, _ in got.values())


def test_quality_words_are_learned(spark):
    rows = [(k, "The cat The CAT the dog", "a") for k in range(3)] + [(9, "dog bird", "a"), (10, "x y", None), (11, None, "a"), (12, "  ", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = {r["lang"]: r["common"] for r in quality.common_words(d, "text", "lang").collect()}
    assert common == {"a": ["dog", "cat", "the", "bird"], None: ["x", "y"]}
    f = {r["doc_id"]: r["known"] for r in with_features(d).collect()}
    assert f[0][:4] == [1, 2, 3, 0] and f[0][-1] == 0 and f[9] == [1, 0, 0, 1] + [0] * (quality.COMMON - 3) and f[10][:2] == [1, 1] and sum(f[12]) == 0


def test_quality_scripts(spark):
    texts = {"a b": "Latin", "Ünïcödé É": "Latin", "привет a": "Cyrillic", "漢字かな漢": "Han", "αβγ 12": "Greek", "12 !!": "", "": "", "ꦏꦏ": "other", "a привет": "Cyrillic", "한글 b": "Hangul"}
    d = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert [r["script"] for r in with_features(d).orderBy("doc_id").collect()] == list(texts.values())


def brute_toxicity(model, text):
    """Evidence and score, word by word."""
    known = dict(zip(model.keys.tolist(), model.values.tolist()))
    scores, before = [], None
    for w in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", text or ""):
        levels = toxicity.tokens_of(pa.array([w]))[0][:, 0].tolist()
        value = next((known[h] for h in levels if h in known), 0.0)
        scores.append((0.0 if levels[0] == before else min(toxicity.CLIP, max(-toxicity.CLIP, value))) - toxicity.DRIFT)
        before = levels[0]
    each = [model.lam * s - math.log(max(1e-9, model.k * len(scores))) for *_, s in toxicity.maximal_segments(scores)]
    strong = [e for e in each if e >= -math.log(toxicity.EXPECT)]
    evidence = sum(strong) if strong else max([-10.0, *each])
    return evidence, 1 / (1 + math.exp(-model.slope * min(15.0, max(-10.0, evidence)) - model.shift))


def test_toxicity_scores_against_brute_force(spark, docs):
    rows = []
    for k in range(240):
        w = prose(60, 2000 + k).split()
        if k % 4 == 0:
            w[20:24] = ["vile", "nasty", "vile", "awful"]
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(d, d.select("doc_id", "toxic"))
    texts = {r[0]: r[1] for r in rows[:40]} | {1000 + k: r[1] for k, r in enumerate(awkward()) if r[0] is not None and len(r[1] or "") < 2000}
    asked = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxicity.toxicity(asked, model).collect():
        evidence, score = brute_toxicity(model, texts[r["doc_id"]])
        assert (r["evidence"], r["score"]) == pytest.approx((evidence, score)) and r["predicted"] == int(score >= 0.5)


def test_toxicity_query_held_out(spark, data):
    got = toxicity.op8_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.8


def test_js_distance(spark):
    d = spark.createDataFrame([([1.0, 1.0, 0.0], [0.0, 2.0, 2.0]), ([1.0, 3.0, 0.0], [2.0, 6.0, 0.0]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in d.select(quality.js_distance(quality.shares("a"), quality.shares("b"))).collect()]
    assert got == pytest.approx([np.sqrt(0.5), 0, 1])


# --- 8: toxicity -------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=25))
def test_segments_are_maximal(scores):
    got = toxicity.maximal_segments([float(s) for s in scores])
    assert got == sorted(got) and all(s == sum(scores[a:b]) > 0 for a, b, s in got)
    best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
    assert max([0, *(s for *_, s in got)]) == best
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:])) and {k for k, s in enumerate(scores) if s > 0} <= {k for a, b, _ in got for k in range(a, b)}


def test_toxicity(spark, docs, empty):
    rows = []
    for k in range(300):
        w = prose(60, 1000 + k).split()
        if k % 5 == 0:
            w[20:24] = ["vile", "nasty", "vile", "awful"]
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(d.where("doc_id < 200"), d.where("doc_id < 200").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(d, model).collect()}
    assert sum(got[k] == t for k, _, t in rows if k >= 200) >= 97
    p = toxicity.toxicity(d.where("doc_id = 250"), model).first()["passages"]
    assert len(p) == 1 and 15 <= p[0]["start"] <= 20 and 24 <= p[0]["end"] <= 30
    out = toxicity.toxicity(docs, model)
    assert out.count() == docs.count() and all(0 <= r["score"] <= 1 for r in out.collect()) and toxicity.toxicity(empty, model).count() == 0
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 0").count()
    # a class of one or two rows still learns and calibrates
    few = d.where("toxic = 0 or doc_id in (0, 5)")
    assert 0 <= toxicity.learn(few, few.select("doc_id", "toxic")).score(3.0) <= 1
    assert 0 <= toxicity.learn(few, few.where("doc_id <> 5").select("doc_id", "toxic")).score(3.0) <= 1
    none = toxicity.learn(d, d.where("doc_id < 0").select("doc_id", "toxic"))
    assert toxicity.toxicity(docs, none).where("predicted = 1").count() == 0
    assert toxicity.learn(empty.select("doc_id", "text"), empty.select("doc_id", F.lit(1).alias("toxic"))).score(0.0) == 0.0


# --- 9: personal data --------------------------------------------------------


def brute_spans(t):
    out = {}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("a@.b-+0159 (%é", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text("1.0x", max_size=30))
def test_base_spans_of_digits(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("piece", ["1", "1.", "1.1.", "1 ", "+1 ", "+1", "@", "a@b.", "a.", "DE89 ", "123-45-"])
def test_long_runs_take_linear_time(piece):
    began = time.time()
    pii.find_spans(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


def test_pii(spark, docs, empty):
    text = "é x@y.org@z.com +1 (555) 010-9999 card 4111-1111-1111-1111 bank DE89 3704 0044 0532 0130 00 social security 123-45-6789" + " x" * 60 + " part 123-45-6789"
    spans = pii.find_spans(text)
    assert [s[0] for s in spans] == ["email", "card", "phone", "iban", "ssn"] and spans[3][3] > 0.9
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(d).collect()}
    assert rows[1]["n_email"] == 1 and rows[1]["n_card"] == 1 and rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3]["spans"] == ""
    base = ",".join(f"{k}:{a}:{b}" for k, x in brute_spans(text).items() for a, b in x)
    assert rows[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert pii.personal_data(docs).count() == docs.count() and pii.personal_data(empty).count() == 0
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


# --- 10: token counts --------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    tokenizers = pytest.importorskip("public_tokenizers")
    return token_counts.counter(str(tokenizers.path("piece_bpe_32k.model")))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tabeé▁<>/s.漢 \u0000"), st.characters(codec="utf-8")), max_size=40))
def test_prefix_tables(counter, text):
    want = [len(counter.model.encode(text[:end])) for end in range(len(text) + 1)]
    assert counter.by_segment and counter.count(text) == want[-1] and list(counter.prefix_table(text)) == want
    assert [counter.prefix_count(text, end) for end in range(len(text) + 1)] == want
    for budget in (0, 1, 3, 9):
        assert counter.cut(text, budget) == max(e for e in range(len(text) + 1) if want[e] <= budget)


@pytest.mark.parametrize("kind", range(5))
def test_prefix_tables_of_long_segments(counter, kind):
    r = random.Random(kind)
    letters = ["abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", [chr(c) for c in range(0x4E00, 0x9FFF)], " ", "ab %$#.é", [chr(c) for c in range(0xAC00, 0xD7A3)]][kind]
    text = "".join(r.choice(letters) for _ in range(300))
    assert list(counter.prefix_table(text)) == [len(counter.model.encode(text[:end])) for end in range(len(text) + 1)]
    # both ways of making tables agree
    part = " " + text.replace(" ", "_")[:60]
    assert counter.segment_table(part) == list(counter.segment_table(part + "x" * 50))[:62]


def test_tokens_of_very_long_texts(counter, monkeypatch):
    r = random.Random(2)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(200_000))
    n = len(counter.model.encode(text))
    encode, counter.model = counter.model.encode, None  # nothing is encoded
    try:
        cut = counter.cut(text, 4096)
        assert counter.count(text) == n
    finally:
        counter.model = encode.__self__
    assert len(counter.model.encode(text[:cut])) <= 4096 < len(counter.model.encode(text[: cut + 1]))
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 2000)
    texts = [prose(300, k) for k in range(5)]
    assert [counter.count(t) for t in texts] == [len(counter.model.encode(t)) for t in texts]


def test_token_budget(spark, docs, empty, counter):
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    text = prose(200, 3)
    for budget in (0, 1, 7, 100):
        cut = counter.cut(text, budget)
        assert len(counter.model.encode(text[:cut])) <= budget and all(len(counter.model.encode(text[:e])) > budget for e in range(cut + 1, min(cut + 40, len(text))))
    got = token_counts.token_counts(docs, path)
    rows = awkward()
    assert by_id(got, "n_bytes", "n_tokens") == sorted((repr(r[0]), len((r[1] or "").encode()), len(counter.model.encode(r[1] or ""))) for r in rows)
    assert got.where("over_limit").count() == 1 and token_counts.token_counts(empty, path).count() == 0


# --- registry ----------------------------------------------------------------


def test_every_operator_has_a_query():
    from auditlake.llm.queries import QUERIES

    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_license_scan", "op5_neardup", "op6_shard", "op7_quality", "op9_pii", "op10_token_counts"])
def test_queries_on_tables(spark, data, name):
    from auditlake.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = QUERIES[name](spark, data)
    if name == "op2_decontaminate":
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
        assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted((repr(i), *b) for (i, _), b in zip(docs, brute_contamination([t for _, t in docs], items)))
    elif name == "op4_license_scan":
        # every match is one by brute force, and of the templates that brute force finds at least 99 % are there or lie within another
        want = {i: brute_containment(t, license_scan.TEMPLATES) for i, t in docs}
        found = {r["doc_id"]: {m["template"] for m in r["matches"]} for r in got.collect()}
        texts = dict(license_scan.TEMPLATES)
        assert all(found[i] <= want[i] for i in want) and any(found.values())
        covered = lambda x, own: x in own or any(" ".join(texts[x].split()).lower() in " ".join(texts[y].split()).lower() for y in own)
        pairs = [(i, x) for i in want for x in want[i]]
        assert sum(covered(x, found[i]) for i, x in pairs) >= 0.99 * len(pairs)
    elif name == "op10_token_counts":
        library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=str(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")))
        n = {i: len(library.encode(t or "")) for i, t in docs}
        assert by_id(got, "n_bytes", "n_tokens", "over_limit") == sorted((repr(i), len((t or "").encode()), n[i], n[i] > 4096) for i, t in docs)
    elif name == "op5_neardup":
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_components(docs)
    elif name == "op6_shard":
        import zlib

        assert by_id(got, "size", "text_crc32") == sorted((repr(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in docs)
    elif name == "op7_quality":
        assert by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted((repr(i), *brute_quality(t)) for i, t in docs)
    else:
        assert by_id(got, "n_email", "n_ip", "n_card", "n_phone") == sorted((repr(i), *(len(x) for x in brute_spans(t).values())) for i, t in docs)
