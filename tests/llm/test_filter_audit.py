"""Filter audit against documents that go through each order one by one."""

import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.llm import filter_audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "lost_good", "shapley")


def brute(rows, filters, parts):
    """rows: (part, failed letters, good)."""
    out = {}
    for part in parts:
        own = [r for r in rows if part is None or r[0] == part]
        for order in itertools.permutations(filters):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), f]
    sums = {}
    for (part, _, _), v in out.items():
        sums[part, v[5]] = sums.get((part, v[5]), 0) + v[1]
    return {k: (*v[:5], sums[k[0], v[5]]) for k, v in out.items()}


def audited(spark, rows, filters):
    d = spark.createDataFrame([(p, *[None if p == "null" and f not in fails else f in fails for f in filters], g) for p, fails, g in rows], f"part string, {', '.join(f'{f} boolean' for f in filters)}, good boolean")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in filter_audit.audit(d, filters, marks=("good",), whole=True).collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "", "null"]), st.sets(st.sampled_from("XYZ")), st.booleans()), max_size=30))
def test_audit_is_that_of_each_order(spark, rows):
    assert audited(spark, rows, "XYZ") == (brute(rows, "XYZ", [*{r[0] for r in rows}, None]) if rows else {})


def test_five_filters(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), {f for f in "ABCDE" if r.random() < 0.3}, r.random() < 0.5) for _ in range(300)]
    got = audited(spark, rows, "ABCDE")
    assert got == brute(rows, "ABCDE", ["a", "b", None]) and len(got) == 3 * 120 * 5


def test_failures_of_awkward_texts(spark):
    many = " ".join(f"w{k}" for k in range(200))
    texts = [
        (1, None, None), (2, "", ""), (3, "   \n", "x"), (4, many, None), (5, many, "x"), (5, many, "x"), (None, many, "x"), (6, "W " * 200, "x"), (7, many + " #", "y"), (8, "AB" + "c" * 98, "y"), (9, "ABC" + "c" * 97, "y"),
        (10, " ".join(["x"] * 300), "y"), (11, "É" * 50, "y"), (0, many + " #", "y"), (12, (many + " ") * 2 + "end", "y"), (13, (many + " ") * 2, "y"), (14, "long " * 200_000, "y"),
    ]
    d = spark.createDataFrame([(*t, True, "z") for t in texts], "doc_id long, text string, source string, A boolean, part string")
    got = [(r["doc_id"], r["part"], "".join(f for f in "ABCDE" if r[f])) for r in filter_audit.failures(d).collect()]
    want = [
        (1, "", "A"), (2, "", "AE"), (3, "x", "A"), (4, "", ""), (5, "x", "E"), (5, "x", "E"), (None, "x", ""), (6, "x", "BC"), (7, "y", "DE"), (8, "y", "A"), (9, "y", "AC"),
        (10, "y", "A"), (11, "y", "A"), (0, "y", "D"), (12, "y", ""), (13, "y", ""), (14, "y", "B"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    marked = {(r["doc_id"], r["part"]): (r["good"], r["toxic"]) for r in filter_audit.labelled(filter_audit.failures(d), labels).collect()}
    assert marked[1, ""] == (True, True) and sum(map(any, marked.values())) == 1
    assert filter_audit.audit(filter_audit.failures(d.limit(0))).collect() == []


def test_copies_of_any_number(spark):
    d = spark.range(4000).select((F.lit(4000) - F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"))
    assert [r["doc_id"] for r in filter_audit.failures(d).where("not E").collect()] == [1]
