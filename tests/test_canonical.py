"""Canonical JSON in the JVM against Python's reader and writer."""

import json
import random
import struct

from pyspark.sql import functions as F

from auditlake.functions import canonical, crypto

TEXTS = [
    None, "", " ", "no", "null", "tru", '""', '"\\""', '"\\\\"', '"\\\\\\""', '"\\x"', '"\\u12"', '"a\tb"', '"\x00"', '"\ufeff"', "\ufeff1", "1\x00", '"\\\U0001f600"',
    "[1,2", "1,2", "1],[2", '1, "e"]', '"e"', '["e"]', "{1:2}", "{NaN:1}", '{"a"}', '"a":1', "[]x", '{"a":"b"} {"c"', "[,]", "[1,]", "[1 2]", '"a" "b"', '"n1":2', "true1", "1true", 'null"x"',
    "[NaN,-Infinity,Infinity,-0,-0.0,0e5,1E5,1e400,-1e400,1e-400]", "-NaN", "NaNNaN", "01", "1.", ".5", "+1", "-", "--1", "- 1", "1e", "1e5", "1E+05", "123456789012345678901234567890",
    "5e-324", "4.9e-324", "3e-324", "2.2250738585072014e-308", "1e23", "8.41E21", "9007199254740993.0", "2.4389741323762014e25", "1e22", "1e16", "1e15", "123456789012345680.0", "0.0001", "0.00001", "0.1000", "100.0e-2",
    '{"\\ud83d\\ude00":1,"\\uffff":2,"\uffffz":3,"\U0001f600a":4,"\ue000":5,"z":6,"":7,"\\ud7ff":8,"\\ud800":9,"\\uDC00x":10}', '"\\ud800\\ud83d\\ude00\\udc00\\uDBFF"', '"\\\\ud800"',
    '"\\u001F\\u000b\\b\\f\\n\\r\\t\\/\x7f\\u00E9é中"', '{"a":{"b":[{"d":1,"c":"\\u0022\\u005c"}]},"A":"n1","_":"s"}', "  [ 1 , { } , [ ] , true , false , null ] \n",
    '"' + "a\\n" * 50_000 + "é" * 1_000 + '"', "[" * 900 + "]" * 900, "9" * 3_000,
]


def python(text):
    try:
        return None if text is None else crypto.canonical(json.loads(text))
    except ValueError:
        return None


def value(r, depth=0):
    kind = r.randrange(8)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return r.randrange(-(10**20), 10**20)
    if kind == 2:
        return struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
    if kind == 3:
        return r.choice([r.random(), r.gauss(0, 1) * 10 ** r.randrange(-9, 9), round(r.random(), r.randrange(8))])
    if kind in (4, 5) or depth > 3:
        return "".join(r.choice('ab"\\/\n\x01\x7fé中\ue000\uffff\ud7ff😀𝒳 {}[],:0-') for _ in range(r.randrange(8)))
    if kind == 6:
        return [value(r, depth + 1) for _ in range(r.randrange(5))]
    return {"".join(r.choice('abéz\ue000😀\uffff"\\') for _ in range(r.randrange(4))): value(r, depth + 1) for _ in range(r.randrange(6))}


def test_same_as_python(spark):
    r = random.Random(5)
    texts = TEXTS + [json.dumps({"k": value(r), "j": value(r)}, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", crypto.canonical_column("j").alias("c"))
    assert "Python" not in d._jdf.queryExecution().executedPlan().toString()
    got = dict(d.collect())
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != python(t)] == []


def test_own_rules(spark):
    """A key that an object has twice leaves no one form; so do texts that nest too deep."""
    d = spark.createDataFrame([('{"a":1,"a":2}',), ('[{"b":{"":1,"":2}}]',), ('{"a":1,"A":2}',), ("[" * 2_000 + "]" * 2_000,)], "j string")
    assert [x[0] for x in d.select(crypto.canonical_column("j")).collect()] == [None, None, '{"A":2,"a":1}', None]


def test_a_double_has_one_form(spark):
    r = random.Random(6)
    xs = [struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0] for _ in range(5_000)] + [r.random() * 10 ** r.randrange(-12, 38) for _ in range(5_000)] + [r.getrandbits(52) * 5e-324 for _ in range(300)]
    xs = [x for x in xs if x == x and abs(x) != float("inf")]
    d = spark.createDataFrame([(repr(x), f"{x:.25e}") for x in xs], "t string, long string")
    assert d.where(canonical.number(F.col("t")) != F.col("t")).collect() == []
    # other spellings of the same double
    assert d.where(F.coalesce(canonical.number(F.col("long")), F.lit("")) != F.col("t")).collect() == []
