"""Near-duplicate groups from MinHash signatures, joined coordinate by coordinate.

A document's set holds its distinct shingles of five words. Its signature has
COORDINATES minima. Every document is posted under each (coordinate, value) pair,
and two documents whose signatures agree in at least MATCHES coordinates are
candidates. At the link threshold of 0.75 a pair agrees in 48 of 64 coordinates
in the mean; that fewer than 32 agree has a probability of 3e-6.

Postings are cut down before they are joined:

* equal sets are one node from the start;
* a value that one node alone has can't collide; a node with fewer than MATCHES
  shared values has no partner at all;
* prefix: of a node's values, rarest first, only COORDINATES - MATCHES + 1 are
  posted: two nodes that agree in MATCHES coordinates share one of these;
* skip: a list of up to SMALL nodes is joined with itself; in a longer one, all
  are joined with one pivot (the node whose values are the most frequent, the
  centre of a group of copies). When the links so found have made components,
  the nodes outside a long list's largest component are joined with all of the
  list in other components. Pairs within one component need no test, all others
  get theirs, so no link is lost and no list is expanded into all its pairs;
* bound: in long lists each node knows how many of its shingles any node of another
  component has. Independent edits of one text are far from each other and near to
  no one else, and this bound rules them out before any pair is made. A finer
  signature (FINE one-bit coordinates) then tells similarities under 0.68 apart.

Agreement is counted in the join condition itself: eight bits of each coordinate
lie in eight 64-bit planes, so that one bit_count of the or-ed differences gives
the coordinates that differ (a bound from above that never loses a match).

Candidates are confirmed on their full sets, and links become components by
alternating large-star and small-star rounds, each written to the shared folder.

Null or empty texts, or those without a word, have no shingles and no links:
n_shingles 0, their own component. Rows of equal doc_id count as one document and
get a row each. Rows with a null doc_id are never kept. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import U64, attached, dropped, fmix, hash_shingles, hash_words, stored, table, text_bytes, text_chunks, with_group

COORDINATES, MATCHES = 64, 32
PREFIX = COORDINATES - MATCHES + 1
SMALL = 32
#: Nodes in a part of a long list that is joined with its pivot, about.
PART = 256
#: One-bit coordinates of the finer signature, and those that must agree.
FINE, FINE_MATCHES = 2048, 1721
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
SHINGLE = 5
PLANES = [f"p{k}" for k in range(8)]
_r = np.random.default_rng(5)
_MULTIPLY = (_r.integers(1, 2**63, COORDINATES, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_ADD = _r.integers(0, 2**63, COORDINATES, dtype=np.int64).astype(U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their offsets."""
    s, at = hash_shingles(*hash_words(*text_bytes(column)), size)
    sets = [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:])]
    return (np.concatenate(sets) if sets else s), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts with shingles, COORDINATES) minima of 57 bits."""
    starts = at[:-1][at[:-1] < at[1:]]
    out = np.empty((len(starts), COORDINATES), U64)
    for k in range(COORDINATES):
        x = sets * _MULTIPLY[k]
        x += _ADD[k]
        x ^= x >> U64(29)
        x *= U64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(x, starts) >> U64(7)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, k1, k2: a digest of the set, tokens: coordinate-value pairs, p0..p7: planes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n", "k1", "k2", "tokens", *PLANES]

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                sets, at = shingle_sets(part.column("text"))
                n = np.diff(at)
                full = np.flatnonzero(n)
                low = minima(sets, at) if len(full) else np.zeros((0, COORDINATES), U64)
                starts = at[:-1][full]
                k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                if len(full):
                    k1[full] = signed(np.add.reduceat(fmix(sets ^ U64(0x51ED270B)), starts))
                    k2[full] = signed(np.add.reduceat(fmix(sets ^ U64(0xA3B19535)), starts))
                tokens = signed(low | (np.arange(COORDINATES, dtype=U64) << U64(57))[None, :])
                token_at = np.zeros(len(n) + 1, np.int32)
                token_at[1:] = np.cumsum((n > 0) * COORDINATES)
                bits = fmix(low) & U64(255)
                planes = np.zeros((8, len(n)), np.int64)
                for b in range(8):
                    ones = (bits >> U64(b)) & U64(1)
                    planes[b, full] = signed((ones << np.arange(COORDINATES, dtype=U64)[None, :]).sum(1, dtype=U64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(pa.array(token_at), pa.array(tokens.ravel())), *map(pa.array, planes)], names
                )

    schema = f"doc_id {kind}, n long, k1 long, k2 long, tokens array<long>, " + ", ".join(f"{p} long" for p in PLANES)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def sets_of(docs: DataFrame) -> DataFrame:
    """(node, set) of (node, text) rows."""
    kind = docs.schema["node"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                sets, at = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(sets)))], ["node", "set"])

    return docs.select("node", "text").mapInArrow(run, f"node {kind}, set array<long>")


def fine_signatures(sets: DataFrame) -> DataFrame:
    """(node, fine): the lowest bits of FINE minima in words of 64. Two sets agree in a
    share of (1 + J) / 2 of them: at J = 0.75 fewer than FINE_MATCHES have a probability of
    2e-6, at J = 0.65 as many have one of 3 percent."""
    kind = sets.schema["node"].dataType.simpleString()

    def run(batches):
        r = np.random.default_rng(55)
        multiply = (r.integers(1, 2**63, FINE, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column("set")
                sizes = np.asarray(pc.list_value_length(column))
                values = np.asarray(column.flatten()).view(U64)
                starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                out = np.zeros((part.num_rows, FINE // 64), U64)
                for k in range(FINE):
                    x = values * multiply[k]
                    x ^= x >> U64(32)
                    x *= U64(0x9E3779B97F4A7C15)
                    # the upper half orders, a bit below is the coordinate's value
                    low = np.minimum.reduceat(x, starts)
                    out[:, k // 64] |= ((low >> U64(7)) & U64(1)) << U64(k % 64)
                fine = pa.FixedSizeListArray.from_arrays(pa.array(signed(out.ravel())), FINE // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("node"), fine], ["node", "fine"])

    return sets.mapInArrow(run, f"node {kind}, fine array<long>")


def fine_agreement(a: str, b: str) -> Column:
    # 32 terms written out make a method that the JVM doesn't compile
    differ = F.zip_with(f"{a}.fine", f"{b}.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.lit(FINE) - F.aggregate(differ, F.lit(0), operator.add)


def agreement(a: str, b: str) -> Column:
    """Coordinates in which two signatures may agree."""
    differ = [F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")) for p in PLANES]
    return F.lit(COORDINATES) - F.bit_count(functools.reduce(lambda x, y: x.bitwiseOR(y), differ))


def alike(a: str, b: str) -> Column:
    """What two nodes must have in common before their sets are compared."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (agreement(a, b) >= MATCHES) & (100 * F.least(x, y) >= THRESHOLD * F.greatest(x, y))


def overlap(a: str, b: str) -> Column:
    """Whether two nodes can overlap enough, from the shingles (c) that they don't have alone:
    inter / (n + m - inter) >= 0.75 takes inter >= 0.75 / 1.75 * (n + m)."""
    return (100 + THRESHOLD) * F.least(F.col(f"{a}.c"), F.col(f"{b}.c")) >= THRESHOLD * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n, planes, weight): the prefix of each node that can have a partner. Counts are
    written before they are joined: then both sides of the join are plain exchanges, whose partitions Spark
    splits at run time where a token is in very many nodes."""
    posted = nodes.select("node", F.explode("tokens").alias("token"))
    shared = stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "neardup-tokens")
    rare = posted.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("l"), F.sum("f").alias("weight")).where(F.size("l") >= MATCHES)
    rare = rare.select("node", "weight", F.slice("l", 1, F.size("l") - (COORDINATES - PREFIX)).alias("l")).where(F.size("l") > 0)
    with_planes = rare.join(nodes.select("node", "n", *PLANES), "node")
    return with_planes.select("node", "n", "weight", *PLANES, F.explode("l.token").alias("token"))


def pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Distinct (a, b), a < b, of nodes that meet in a list and are alike."""
    alike_fine = alike("x", "y")
    if "fine" in left.columns:
        # and of all lists in which they meet, only the first makes the pair
        alike_fine &= (fine_agreement("x", "y") >= FINE_MATCHES) & (F.col("x.token") == F.array_min(F.array_intersect("x.tokens", "y.tokens")))
    joined = left.alias("x").join(right.alias("y"), (F.col("x.token") == F.col("y.token")) & condition & alike_fine)
    return joined.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def confirmed(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; a node of several texts may repeat them. A pivot has
    a pair with every node of its list: both sides of these joins are plain exchanges, and no
    aggregate rests on their partitions, so that Spark splits such a node's partition at run time."""
    both = found.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= THRESHOLD * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def shared_sizes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, c) from (node, component): how many shingles of each node some node of
    another component has. No overlap across components can be larger."""
    each = sets.join(nodes, "node").select("node", "component", F.explode("set").alias("s"))
    common = each.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("s")
    return each.join(stored(common, "neardup-common"), "s", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("c"))


def components(links: DataFrame, name: str = "neardup-links") -> DataFrame:
    """(node, component) of all nodes that have a link; component: the smallest node."""

    def stamp(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # a: the larger end, b: the smaller
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), name)
    before, now = None, stamp(edges)
    while now != before:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        # a node may have any number of neighbours
        large = with_group(both, "u", "v", m=(F.min("v"), "min")).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        small = with_group(large, "a", "b", m=(F.min("b"), "min"))
        new = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        last, edges = edges, stored(new, name)
        before, now = now, stamp(edges)
        dropped(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, n_copies) of each row."""
    sig = stored(signatures(docs, id_col, text_col), "neardup-signatures")
    filled = sig.where("n > 0")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal within a set
    nodes = stored(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_copies"), *map(first, ["n", "tokens", *PLANES])), "neardup-nodes")
    prefixes = stored(postings(nodes.where("node is not null")), "neardup-postings")
    lists = stored(prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "neardup-counts")
    posted = stored(prefixes.join(lists, "token"), "neardup-lists")
    sets = docs.select(docs[id_col].alias("node"), docs[text_col].alias("text")).join(posted.select("node").distinct(), "node", "left_semi")
    sets = stored(sets_of(sets), "neardup-sets")

    short, long = posted.where(F.col("m") <= SMALL), posted.where(F.col("m") > SMALL)
    pivot = long.groupBy("token").agg(F.max_by(F.struct("node", "n", *PLANES), F.struct("weight", "node")).alias("pivot"), F.max("m").alias("m")).select("token", "pivot.*", "m")
    # a list of any length is dealt in parts, its one pivot to all of them
    parts = F.ceil(F.col("m") / PART)
    long_parts = long.withColumn("salt", F.pmod(F.xxhash64("node"), parts))
    pivot = pivot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    star = pairs(long_parts, pivot, (F.col("x.salt") == F.col("y.salt")) & (F.col("x.node") != F.col("y.node")))
    found = pairs(short, short, F.col("x.node") < F.col("y.node")).union(star).distinct()
    found = stored(found, "neardup-pairs")
    links = stored(confirmed(found, sets), "neardup-found")
    groups = stored(components(links), "neardup-groups")

    # long lists: whoever is outside the largest component meets the rest. A row for each
    # node of these lists, with all that is known of it; its tokens put it back into the lists
    member = long.groupBy("node").agg(*map(first, ["n", *PLANES]), F.collect_set("token").alias("tokens"))
    member = stored(member.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "neardup-members")
    in_lists = member.select("component", F.explode("tokens").alias("token"))
    largest = in_lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("largest"))
    # the smaller set of a link has at least 0.75 of the larger one in common
    able = stored(member.join(shared_sizes(member.select("node", "component"), sets), "node").where(100 * F.col("c") >= THRESHOLD * F.col("n")), "neardup-able")
    named = able.join(fine_signatures(sets.join(able.select("node"), "node", "left_semi").select("node", "set")), "node")
    rows = stored(named.select("*", F.explode("tokens").alias("token")), "neardup-long")
    outside = stored(attached(rows, largest, "token", "node").where("component <> largest").select(*rows.columns), "neardup-outside")
    more = stored(pairs(outside, rows, (F.col("x.component") != F.col("y.component")) & overlap("x", "y")), "neardup-pairs")
    if not more.isEmpty():
        groups = stored(components(links.union(confirmed(more, sets))), "neardup-groups")
    dropped(prefixes, posted, sets, found, links, member, able, rows, outside, more)
    by_set = nodes.select("k1", "k2", "node", "n_copies").join(groups, "node", "left").select("k1", "k2", "n_copies", F.coalesce("component", "node").alias("component_id"))
    out = filled.select("doc_id", "n", "k1", "k2").join(by_set, ["k1", "k2"]).select("doc_id", "n", "component_id", "n_copies")
    out = out.union(sig.where("n = 0").select("doc_id", "n", F.col("doc_id"), F.lit(1).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "n_copies")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __id: its id, or, where that is null, one made of the text, behind all usual ids."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        made, own = F.lit(1 << 62) + F.xxhash64(text_col).bitwiseAND((1 << 62) - 1), F.col(id_col).cast("long")
    else:
        made, own = F.concat(F.lit("\uffff"), F.hex(F.xxhash64(text_col)), F.hex(F.xxhash64(F.lit(1), text_col))), F.col(id_col).cast("string")
    return docs.withColumn("__id", F.coalesce(own, made))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each near-duplicate group, one with a doc_id
    if there is any. Of rows with one doc_id one stays; rows without a doc_id are told apart by
    their texts, so that of equal ones (those without text too) one stays."""
    rows = identified(docs, id_col, text_col)
    found = near_duplicates(rows, "__id", text_col).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    kept = rows.join(found, rows["__id"] == found["__kept"], "left_semi")
    # only the first of a partition's rows with one id leave it
    first = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(*[c for c, t in docs.dtypes if not t.startswith(("map", "variant"))])))
    return kept.withColumn("__first", first).where("__first = 1").select(*docs.columns)


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("n_copies")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 5], ' ') AS x FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
