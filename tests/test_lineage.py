"""Reachability in few rounds, radii of all nodes, impact traces."""

import random
from collections import deque

import pytest

from auditlake.operators import lineage


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def walk(pairs, roots):
    nexts = {}
    for a, b in pairs:
        nexts.setdefault(a, set()).add(b)
    depth, queue = {r: 0 for r in roots}, deque(roots)
    while queue:
        for b in nexts.get(x := queue.popleft(), ()):
            if b not in depth:
                depth[b] = depth[x] + 1
                queue.append(b)
    return {k: d for k, d in depth.items() if k not in roots}


def graph(r, n):
    """Random edges among long chains, with rings, loops and repeats."""
    hubs = [f"h{k}" for k in range(6)]
    out = []
    for c in range(n):
        a, b, length = r.choice(hubs), r.choice(hubs), r.randint(0, 40)
        nodes = [a, *(f"c{c}-{k}" for k in range(length)), b]
        out += list(zip(nodes, nodes[1:]))
    ring = [f"ring{k}" for k in range(5)]
    return out + list(zip(ring, ring[1:] + ring[:1])) + [("h0", "h0"), out[0], ("lone", "end"), ("self", "self")]


@pytest.mark.parametrize("seed, plain", [(1, 1), (2, 12)])
def test_reach_over_contracted_chains(spark, monkeypatch, seed, plain):
    monkeypatch.setattr(lineage, "PLAIN_ROUNDS", plain)
    r = random.Random(seed)
    pairs = graph(r, 9)
    roots = ["h0", "c1-3", "ring2", "nobody", "self"][: 1 + 2 * seed]
    upstream = seed == 2
    got = lineage.reachable(frame(spark, pairs), spark.createDataFrame([(x,) for x in roots], "id string"), upstream=upstream)
    assert {x["id"]: x["depth"] for x in got.collect()} == walk([(b, a) for a, b in pairs] if upstream else pairs, roots)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n, count = 10_000, [0]
    real = lineage.written
    monkeypatch.setattr(lineage, "written", lambda *a: count.__setitem__(0, count[0] + 1) or real(*a))
    edges = spark.range(n).selectExpr("'n' || id as src", "'n' || (id + 1) as dst")
    got = lineage.reachable(edges, spark.createDataFrame([("n0",)], "id string"))
    assert [tuple(r) for r in got.selectExpr("count(*)", "max(depth)", "count_if(depth = cast(substr(id, 2) as int))").collect()] == [(n, n, n)]
    assert count[0] < 40
    with pytest.raises(RuntimeError):
        lineage.reachable(edges, spark.createDataFrame([("n0",)], "id string"), most=n - 1)


def test_radii_of_all_nodes(spark):
    pairs = graph(random.Random(4), 5)
    ids = sorted({x for p in pairs for x in p})
    got = {r["id"]: r["n_reached"] for r in lineage.blast_radii(frame(spark, pairs)).collect()}
    assert got == {x: len(walk(pairs, [x])) for x in ids}


def test_radii_beyond_a_sketch(spark):
    n = 1000
    edges = spark.range(n).selectExpr("'n' || id as src", "'n' || (id + 1) as dst")
    got = {int(r["id"][1:]): r["n_reached"] for r in lineage.blast_radii(edges, lg=6).collect()}
    assert len(got) == n + 1 and all(got[k] == n - k for k in range(n - 50, n + 1))
    # the error stated is about 1 / sqrt(64): 12 %, and these sets overlap
    assert max(abs(got[k] / (n - k) - 1) for k in range(n - 100)) < 0.5


def test_traces(spark):
    n1, e1 = lineage.branch("C_B", "B17", "DX", "MY", ("R1", "R2"))
    n2, e2 = lineage.branch("C_C", "B99", "DS")
    nodes, edges = spark.createDataFrame(n1 + n2, "id string, type string"), frame(spark, e1 + e2)
    roots = spark.createDataFrame([("C_B",), ("B99",), ("DS",), ("nobody",), ("MY",)], "id string")
    got = {r["root"]: tuple(r)[1:] for r in lineage.trace(nodes, edges, roots).collect()}
    assert {k: (v[0], *v[1:5], v[5]) for k, v in got.items()} == {
        "C_B": ("contributor", 1, 1, 2, 4, "CRITICAL"), "B99": ("batch", 1, 0, 0, 1, "MEDIUM"), "DS": ("dataset", 0, 0, 0, 0, "LOW"), "MY": ("model", 0, 0, 2, 2, "CRITICAL"), "nobody": (None, 0, 0, 0, 0, None),
    }
    assert got["nobody"][-1] == "Node 'nobody' not found in the lineage graph" and "2 inference records" in got["C_B"][-1]
    ids = {(r["root"], r["type"], r["id"]) for r in lineage.affected(nodes, edges, roots).collect()}
    assert ids == {("C_B", "dataset", "DX"), ("C_B", "model", "MY"), ("C_B", "inference", "R1"), ("C_B", "inference", "R2"), ("B99", "dataset", "DS"), ("MY", "inference", "R1"), ("MY", "inference", "R2")}
    assert lineage.affected(nodes, edges, roots.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 5])
def test_thinned_chains(spark, monkeypatch, seed):
    """Long and short chains, hubs of many chains and rings, ranked with most nodes taken out first."""
    monkeypatch.setattr(lineage, "THIN", 4)
    r = random.Random(seed)
    pairs = graph(r, 7) + [(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("two", "one"), ("one", "two")]
    nexts, into = {}, {}
    for a, b in set(pairs):
        nexts.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    inner = {x for x in nexts if len(nexts[x]) == 1 and len(into.get(x, [])) == 1 and into[x][0] != x} - {"c1-3"}
    want = {}
    for x in inner:
        at, n = x, 0
        while at in inner and n <= len(inner):
            at, n = into[at][0], n + 1
        if at not in inner:
            want[x] = (nexts[x][0], at, n)
    steps = spark.createDataFrame(list(set(pairs)), "id string, next string")
    got = lineage.chains(steps, spark.createDataFrame([("c1-3",)], "id string")).collect()
    assert len(got) == len(want) and {x["id"]: (x["next"], x["head"], x["dist"]) for x in got} == want


def test_exact_radii_beyond_a_sketch(spark):
    pairs = graph(random.Random(6), 5)
    ids = sorted({x for p in pairs for x in p})
    got = [tuple(x) for x in lineage.exact_radii(frame(spark, pairs), lg=4).collect()]
    assert len(got) == len(ids) and dict(got) == {x: len(walk(pairs, [x])) for x in ids}


def test_one_walk_for_all_roots(spark, monkeypatch):
    """Repeated edges and nodes, and more roots for the same number of written rounds."""
    monkeypatch.setattr(lineage, "PLAIN_ROUNDS", 2)
    pairs, count = graph(random.Random(7), 5), [0]
    real = lineage.written
    monkeypatch.setattr(lineage, "written", lambda *a: count.__setitem__(0, count[0] + 1) or real(*a))
    roots, took = ["h0", "h1", "c1-3", "ring2", "self", "nobody"], []
    for some in (roots[:1], roots):
        count[0] = 0
        got = {(x["root"], x["id"]): x["depth"] for x in lineage.reachable_each(frame(spark, pairs + pairs), spark.createDataFrame([(x,) for x in some], "id string")).collect()}
        assert got == {(r, k): d for r in some for k, d in walk(pairs, [r]).items()}
        took.append(count[0])
    assert took[0] <= took[1] <= 20
    n, e = lineage.branch("C", "B", "D", "M", ("R",))
    nodes = spark.createDataFrame(n + n, "id string, type string")
    assert tuple(lineage.impact(nodes, frame(spark, e + e), "C").first())[1:4] == (1, 1, 1)
    assert lineage.trace(nodes, frame(spark, e + e), spark.createDataFrame([("C",), ("B",)], "id string")).select("total").collect() == [(3,), (3,)]


def test_exact_radii_write_no_leaves(spark, monkeypatch):
    """Shallow graphs, with rings, loops, repeats and nulls, are counted from pairs of inner nodes: neither all edges nor a set of each node is written."""
    real, rows = lineage.written, []
    monkeypatch.setattr(lineage, "written", lambda *a: (rows.append(0), (d := real(*a)), rows.__setitem__(-1, d.count()))[1])
    r = random.Random(8)
    pairs = [(f"a{r.randrange(3)}", f"b{k}") for k in range(20)] + [(f"b{r.randrange(20)}", f"c{k}") for k in range(40)] + [(f"c{r.randrange(40)}", f"leaf{r.randrange(900)}") for _ in range(4000)]
    pairs += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("r2", "leaf3"), ("a0", "leaf1"), ("self", "self"), ("leaf7", "leaf7")] + pairs[::9]
    edges = frame(spark, pairs + [(None, "leaf1"), ("b1", None), (None, None), ("lone", None)])
    for up in (False, True):
        rows.clear()
        got = [tuple(x) for x in lineage.exact_radii(edges, upstream=up).collect()]
        turned = [(b, a) for a, b in pairs] if up else pairs
        assert len(got) == len(dict(got)) and dict(got) == {x: len(walk(turned, [x])) for p in pairs for x in p} | {None: 0, "lone": 0}
        assert up or sum(rows) < 1000


def test_radii_of_very_large_keys(spark, tmp_path):
    """Keys that leave no bits for a kind, negative keys and nulls."""
    from auditlake.plans.queries import QUERIES

    for shift, folder in ((0, "small"), (1 << 60, "large")):
        d = f"{tmp_path}/{folder}"
        spark.createDataFrame([(shift - 7, 3), (None, 4), (5, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
        spark.createDataFrame([(shift - 7, 1), (5, shift + 2), (5, None)], "o_custkey long, o_orderkey long").write.parquet(f"{d}/orders.parquet")
        spark.createDataFrame([(1, 1, 1), (1, 2, -1), (shift + 2, 2, None)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
        got = {x["id"]: x["n_reached"] for x in QUERIES["blast_radii"](spark, d).collect()}
        want = {"nation-3": 6, "nation-4": 0, f"cust-{shift - 7}": 3, "cust-5": 2, "order-1": 2, f"order-{shift + 2}": 1, "supp-1": 1, "supp--1": 1, "model-1": 0, "model-2": 0, None: 0}
        assert got == want
