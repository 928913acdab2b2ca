"""Lineage graphs: reachability, impact, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.tables import written


#: Rounds of a plain walk, after which chains are contracted.
PLAIN_ROUNDS = 12


def reachable(edges: DataFrame, roots: DataFrame, upstream: bool = False, most: int | None = None) -> DataFrame:
    """(id, depth) of all nodes reached from (id) by (src, dst), roots left out. Each round
    joins the last round's nodes with the edges and drops those seen before, so cycles
    end; only the frontier is joined, and it is written so that plans stay short. Where nodes lie behind PLAIN_ROUNDS
    rounds, chains (runs of nodes with one edge in and one out) are contracted to an edge each, so that a path of any length
    takes rounds in the logarithm of it. ``edges`` are read once a round, repeats and all: write them first if they cost more than
    a scan. ``most``: an error is raised if nodes lie deeper."""
    return _walk(edges, roots.select("id").distinct(), [], upstream, most)


def reachable_each(edges: DataFrame, roots: DataFrame, upstream: bool = False) -> DataFrame:
    """(root, id, depth) of all nodes reached from each of ``roots`` (id), in the rounds of one walk; a root on a cycle isn't its own."""
    return _walk(edges, roots.select(F.col("id").alias("root"), "id").distinct(), ["root"], upstream, None)


def _walk(edges: DataFrame, roots: DataFrame, keys: list[str], upstream: bool, most: int | None) -> DataFrame:
    a, b = ("dst", "src") if upstream else ("src", "dst")
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    seen = written(roots.withColumn("depth", F.lit(0)), "lineage")
    frontier, depth = seen, 0
    while True:
        depth += 1
        new = frontier.join(steps, "id").select(*keys, F.col("next").alias("id")).distinct().join(seen, [*keys, "id"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(new, "lineage")
        if frontier.isEmpty():
            return seen.where("depth > 0")
        if most is not None and depth > most:
            raise RuntimeError(f"nodes lie deeper than {most} rounds")
        seen = seen.union(frontier)
        if depth >= PLAIN_ROUNDS:
            break
    seen = written(_contracted_walk(written(steps.distinct(), "lineage"), seen, frontier, keys), "lineage")
    if most is not None and not seen.where(F.col("depth") > most).isEmpty():
        raise RuntimeError(f"nodes lie deeper than {most} rounds")
    return seen.where("depth > 0")


#: Nodes of chains that are ranked by doubling alone; where there are more, they are thinned out first.
THIN = 1 << 17


def chains(steps: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, next, head, dist) of the nodes of (id, next) edges that have one edge in and one out and aren't in ``ends`` (id):
    the node before their chain and the steps from there. Nodes of a closed ring of such nodes have no head and are left out.

    While there are many, nodes that have a smaller hash than both their neighbours leave, about a third in each round,
    and their neighbours are linked past them; the last are ranked by doubling, and those that left by their heads, in reverse. So
    what is written and shuffled in all rounds together is a few times the nodes."""
    into = steps.groupBy("next").agg(F.count(F.lit(1)).alias("n_in"), F.min("id").alias("head")).withColumnRenamed("next", "id")
    out = steps.groupBy("id").agg(F.count(F.lit(1)).alias("n_out"), F.min("next").alias("next"))
    inner = into.join(out, "id").where("n_in = 1 and n_out = 1 and head <> id").join(ends, "id", "left_anti").select("id", "next", "head", F.lit(1).cast("long").alias("dist"))
    inner = written(inner, "lineage")
    rest, gone, rings = inner, [], []
    while rest.count() > THIN:
        h = lambda c, k=len(gone): F.xxhash64(F.lit(k), c)
        low = (h("id") < h("next")) & (h("id") < h("head"))
        gone.append(written(rest.where(low), "lineage"))
        # an inner node has one neighbour on each side; of others' messages, which nobody reads, one a task is left
        behind = gone[-1].groupBy(F.col("next").alias("id")).agg(F.max("head").alias("__head"), F.max("dist").alias("__dist"))
        before = gone[-1].groupBy(F.col("head").alias("id")).agg(F.max("next").alias("__next"))
        linked = rest.where(~low).join(behind, "id", "left").join(before, "id", "left")
        linked = written(linked.select("id", F.coalesce("__next", "next").alias("next"), F.coalesce("__head", "head").alias("head"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist")), "lineage")
        rings.append(linked.where("head = id"))
        rest = linked.where("head <> id")
    # without a head: what hangs on a ring
    known = _doubled(rest).select("id", "head", "dist")
    for r in rings:
        known = known.union(r.select("id", F.lit(None).cast(r.schema["head"].dataType).alias("head"), "dist"))
    for left in reversed(gone):
        at = known.select(F.col("id").alias("head"), F.col("head").alias("__head"), F.col("dist").alias("__dist"))
        more = left.join(at, "head", "left").select("id", F.when(F.col("__dist").isNull(), F.col("head")).otherwise(F.col("__head")).alias("head"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"))
        known = known.union(written(more, "lineage"))
    return inner.select("id", "next").join(known.where("head is not null"), "id").select("id", "next", "head", "dist")


def _doubled(inner: DataFrame) -> DataFrame:
    """``inner`` (id, next, head, dist) with heads outside of it and distances from there, by doubling; heads of rings are null."""
    most = inner.count()
    known, rounds = inner, 0
    # a chain of n nodes is ranked after log2(n) rounds; what is not is a ring
    while 1 << rounds <= most:
        before = known.select(F.col("id").alias("head"), F.col("head").alias("__head"), F.col("dist").alias("__dist"))
        open_ = known.join(inner.select(F.col("id").alias("head")), "head", "left_semi")
        if open_.isEmpty():
            break
        known = known.join(before, "head", "left").select("id", "next", F.coalesce("__head", "head").alias("head"), (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"))
        known, rounds = written(known, "lineage"), rounds + 1
    ids = inner.select(F.col("id").alias("head"), F.lit(True).alias("__in"))
    return known.join(ids, "head", "left").select("id", "next", F.when(F.col("__in").isNull(), F.col("head")).alias("head"), "dist")


def _contracted_walk(steps: DataFrame, seen: DataFrame, frontier: DataFrame, keys: list[str]) -> DataFrame:
    """([keys, ]id, depth) of a walk that goes on from ``frontier`` over chains as edges of their length."""
    inner = written(chains(steps, frontier.select("id").distinct()), "lineage")
    ids = inner.select("id")
    last = inner.join(ids.withColumnRenamed("id", "next"), "next", "left_anti").select(F.col("head").alias("id"), "next", (F.col("dist") + 1).alias("length"))
    plain = steps.join(ids, "id", "left_anti").join(ids.withColumnRenamed("id", "next"), "next", "left_anti").select("id", "next", F.lit(1).cast("long").alias("length"))
    graph = written(plain.union(last).groupBy("id", "next").agg(F.min("length").alias("length")), "lineage")
    at = [*keys, "id"]
    best = written(seen.select(*at, F.col("depth").cast("long").alias("depth")), "lineage")
    frontier, rounds = frontier.select(*at, F.col("depth").cast("long").alias("depth")), 0
    while not frontier.isEmpty():
        near = frontier.join(graph, "id").groupBy(*keys, "next").agg(F.min(F.col("depth") + F.col("length")).alias("depth")).withColumnRenamed("next", "id")
        # a node may be found again by fewer steps
        known = best.groupBy(*at).agg(F.min("depth").alias("__depth"))
        frontier = written(near.join(known, at, "left").where("__depth is null or depth < __depth").select(*at, "depth"), "lineage")
        best, rounds = best.union(frontier), rounds + 1
        if rounds % 20 == 0:
            best = written(best.groupBy(*at).agg(F.min("depth").alias("depth")), "lineage")
    within = best.withColumnRenamed("id", "head").join(inner, "head").select(*at, (F.col("depth") + F.col("dist")).alias("depth"))
    return best.union(within).groupBy(*at).agg(F.min("depth").cast("int").alias("depth"))


#: log2 of the entries of a sketch: sets of fewer nodes are counted exactly, others with an error of about 1 / sqrt(entries).
SKETCH = 10


def blast_radii(edges: DataFrame, upstream: bool = False, lg: int = SKETCH) -> DataFrame:
    """(id, n_reached) of every node at once: how many other nodes lie downstream of it, by bottom-k (theta) sketches of bounded
    size. A round merges into a node the sketches of the nodes that its edges, and the shortcuts of nodes with one edge out, lead to;
    only nodes of which a target changed are merged anew. Unions of sets that overlap count once, so cycles need no condensation and end by
    themselves; shortcuts double in each round, so a path takes rounds in the logarithm of its length. Counts are exact up to
    2**lg nodes."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    return _sketched(written(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct(), "radius"), lg)


def exact_radii(edges: DataFrame, upstream: bool = False, lg: int = 12) -> DataFrame:
    """As blast_radii(), exact at any size. Pairs of a node and a node reached are walked among inner nodes alone (those with an edge in and
    one out), which are few where most nodes are leaves; leaves are met once, in the count. ``edges`` are scanned a few times,
    repeats and all: write them first if they cost more than a scan. Graphs that are deeper than PLAIN_ROUNDS go by sketches."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    told = edges.select(F.col(a).alias("id"), F.col(b).alias("next"))
    steps = told.where("id <> next")
    pairs = _inner_pairs(steps)
    if pairs is None:
        return _radii_by_sketches(told, lg)
    counted = lambda d, key: written(d.distinct().groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")), "radius")
    # exchanged by both columns: a node that reaches any number of others is spread
    n = counted(pairs.join(steps, "id").where("root <> next").select("root", "next"), "root")
    _freed(steps)
    # of a node with inner ones behind it this is a part, and the smaller count
    n = n.union(counted(steps, "id"))
    _freed(steps)
    none = told.select(F.col("next").alias("id")).union(told.where("not coalesce(id <> next, false)").select("id")).withColumn("n", F.lit(0).cast("long"))
    return n.union(none).groupBy("id").agg(F.max("n").alias("n_reached"))


def _inner_pairs(steps: DataFrame) -> DataFrame | None:
    """(root, id): the inner nodes reached from each node of (id, next) that has an edge to any, itself among them, by a walk from all at
    once; None if it takes over PLAIN_ROUNDS."""
    inner = written(steps.join(steps.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id", "next").distinct(), "radius")
    frontier = seen = inner.select(F.col("id").alias("root"), F.col("next").alias("id"))
    for _ in range(PLAIN_ROUNDS):
        _freed(steps)
        new = frontier.join(inner, "id").where("root <> next").select("root", F.col("next").alias("id")).distinct()
        frontier = written(new.join(seen, ["root", "id"], "left_anti"), "radius")
        if frontier.isEmpty():
            _freed(steps)
            return seen.union(inner.select(F.col("id").alias("root"), "id").distinct())
        seen = seen.union(frontier)
    return None


def _freed(df: DataFrame) -> None:
    """Exchanges that nothing refers to any more are removed from disk when the driver collects garbage, which it may not do for long."""
    df.sparkSession._jvm.System.gc()


def _radii_by_sketches(told: DataFrame, lg: int) -> DataFrame:
    """Sets of under 2**lg nodes by their sketches, which hold them whole, and those of the other
    nodes, which may be few, by one walk from all of these at once, whose pairs of node and node reached are counted."""
    steps = written(told.distinct(), "radius")
    radii = written(_sketched(steps, lg), "radius")
    full = F.col("n_reached") >= (1 << lg) - 1
    pairs = reachable_each(steps.select(F.col("id").alias("src"), F.col("next").alias("dst")), radii.where(full))
    return radii.where(~full).union(pairs.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("n_reached")))


def _sketched(steps: DataFrame, lg: int) -> DataFrame:
    own = steps.select(F.explode(F.array("id", "next")).alias("id")).distinct().select("id", F.xxhash64("id").alias("h"))
    state = written(own.groupBy("id").agg(F.theta_sketch_agg("h", lg).alias("s")), "radius")
    jumps = written(steps.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")).where("n = 1").select("id", "next"), "radius")
    changed = state
    while True:
        over = jumps.select(F.col("id").alias("next"), F.col("next").alias("then"))
        longer = written(jumps.join(over, "next").where("then <> id").select("id", F.col("then").alias("next")), "radius")
        links = steps.union(longer).distinct()
        got = links.join(changed.withColumnRenamed("id", "next"), "next").select("id", "s")
        # of a node of any number of edges only partial unions meet
        merged = got.groupBy("id").agg(F.theta_union_agg("s", lg).alias("more"))
        both = state.join(merged, "id").select("id", F.col("s").alias("was"), F.theta_union("s", "more", lg).alias("s"))
        moved = written(both.where("was <> s").select("id", "s"), "radius")
        if moved.isEmpty():
            break
        state = written(state.join(moved.select("id"), "id", "left_anti").union(moved), "radius")
        # what a new shortcut leads to counts as changed, though it did not change now
        targets = longer.select(F.col("next").alias("id")).distinct().join(moved.select("id"), "id", "left_anti")
        changed = moved.union(state.join(targets, "id", "left_semi"))
        jumps = longer
    return state.select("id", F.greatest(F.lit(0), F.theta_sketch_estimate("s") - 1).cast("long").alias("n_reached"))


KINDS = ("dataset", "model", "inference")


def affected(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, type, id): the data sets, models and inferences downstream of each of a few roots (id), a row each. Roots are
    walked from together. ``nodes`` may be told again and again, and are compared only where they are reached."""
    reached = written(reachable_each(edges, roots).select("root", "id"), "lineage")
    return nodes.where(F.col("type").isin(*KINDS)).join(reached, "id").select("root", "type", "id").distinct()


def trace(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, root_type, n_datasets, n_models, n_inferences, total, severity, description) of a few roots (id); a root that is no
    node is described as not found, and has no severity."""
    n = lambda t: F.count_if(F.col("type") == t)
    known = roots.select(F.col("id").alias("root")).distinct()
    types = written(nodes.select(F.col("id").alias("root"), F.col("type").alias("root_type")).join(known, "root", "left_semi").distinct(), "lineage")
    hits = affected(nodes, edges, types.select(F.col("root").alias("id"))).groupBy("root").agg(n("dataset").alias("n_datasets"), n("model").alias("n_models"), n("inference").alias("n_inferences"))
    d = known.join(types, "root", "left").join(hits, "root", "left").fillna(0, ["n_datasets", "n_models", "n_inferences"])
    d = d.withColumn("total", F.col("n_datasets") + F.col("n_models") + F.col("n_inferences"))
    found = F.col("root_type").isNotNull()
    text = F.format_string("Downstream of %s '%s': %d data sets, %d models, %d inference records", "root_type", "root", "n_datasets", "n_models", "n_inferences")
    missing = F.format_string("Node '%s' not found in the lineage graph", "root")
    return d.select("root", "root_type", "n_datasets", "n_models", "n_inferences", "total", F.when(found, _severity()).alias("severity"), F.when(found, text).otherwise(missing).alias("description"))


def _severity() -> Column:
    return F.when(F.col("n_inferences") > 0, "CRITICAL").when(F.col("n_models") > 0, "HIGH").when(F.col("n_datasets") > 0, "MEDIUM").otherwise("LOW")


def impact(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """(root, n_datasets, n_models, n_inferences, severity) of what lies downstream of a node;
    targets without a node row are walked through but not counted."""
    spark = nodes.sparkSession
    reached = written(reachable(edges, spark.createDataFrame([(root,)], "id string")).select("id"), "lineage")
    hit = nodes.select("id", "type").join(reached, "id", "left_semi").distinct()
    n = lambda t: F.count_if(F.col("type") == t)
    g = hit.agg(n("dataset").alias("n_datasets"), n("model").alias("n_models"), n("inference").alias("n_inferences"))
    return g.select(F.lit(root).alias("root"), "n_datasets", "n_models", "n_inferences", _severity().alias("severity"))


def branch(contributor: str, batch: str, dataset: str, model: str | None = None, inferences: tuple[str, ...] = ()) -> tuple[list[tuple], list[tuple]]:
    """Node and edge rows of one five-level branch."""
    nodes = [(contributor, "contributor"), (batch, "batch"), (dataset, "dataset")]
    edges = [(contributor, batch), (batch, dataset)]
    if model:
        nodes.append((model, "model"))
        edges.append((dataset, model))
        nodes += [(i, "inference") for i in inferences]
        edges += [(model, i) for i in inferences]
    return nodes, edges


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """A line of a Mermaid chart for each edge."""
    return edges.distinct().select(F.format_string("    %s --> %s", "src", "dst").alias("line"))


def parse_mermaid(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines such as `a[text] --> b`."""
    p = r"^\s*([\w.-]+)(?:\[[^\]]*\])?\s*-->\s*([\w.-]+)"
    return lines.where(F.col("line").rlike(p)).select(F.regexp_extract("line", p, 1).alias("src"), F.regexp_extract("line", p, 2).alias("dst"))


def as_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node as JSON with its targets in order; a row a node, so that no graph meets in one task."""
    out = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("targets"))
    d = nodes.join(out, nodes["id"] == out["src"], "left")
    return d.select("id", F.to_json(F.struct("id", "type", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))).alias("document"))


def findings_at(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(finding_id, id): findings whose asset begins with a node's id, or the other way round. Ids
    are matched by equal beginnings of every length that a node's id or an asset has: an
    equi-join, so that not every finding meets every node."""
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(c, F.lit(1), n)))
    a = findings.where(F.length("asset") > 0).select("finding_id", "asset", heads(F.col("asset")).alias("head"))
    n = nodes.where(F.length("id") > 0).select("id", heads(F.col("id")).alias("head"))
    down = a.join(nodes.select("id", F.col("id").alias("head")), "head").select("finding_id", "id")
    up = n.join(findings.select("finding_id", F.col("asset").alias("head")), "head").select("finding_id", "id")
    return down.union(up).distinct()


def columns_linked(nodes: DataFrame) -> DataFrame:
    """(src, dst): each node of a column of a drawing with each of the next one."""
    a, b = nodes.select(F.col("id").alias("src"), (F.col("column") + 1).alias("column")), nodes.select(F.col("id").alias("dst"), "column")
    return a.join(b, "column").select("src", "dst")
