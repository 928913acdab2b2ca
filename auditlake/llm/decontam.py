"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

Words are runs of letters A-Z (lower-cased), digits and characters beyond ASCII.
Each benchmark item has windows of WINDOW consecutive words; a shorter item is one
window. A window is the set of its shingles of up to SHINGLE words, and a document
holds the window only if it holds every one of them. So:

* rarity: the shingles of all windows are counted over all documents;
* prefix: since all must be held, one shingle is a sufficient prefix. Each window
  is posted under its rarest one, and a window with a shingle that no document
  has is dropped;
* bounds: a document's shingle at position p that stands at offset o of a window
  of n words puts the window at p - o, which must lie within the document;
* verification: the document's words from there must equal the window's words.

The documents are read twice, whatever the size of the benchmark: once to count shingles and once to probe. In either
pass shingles are made in one generated stage, without a shuffle, and held against the hashes that are asked for: up to MOST_HASHES
of them are broadcast; of more, a bit table is, of BITS bits for each and MOST_BITS at most. What passes is nearly only what the
benchmark has: counts, or positions with the words around them, which an ordinary join then tells for certain. A table that is
too full lets more pass and changes no result. A window is named by
two hashes of its words; the items that have it are joined to the hits last, by window and part of the documents, as a window may
be in any number of items and documents. Texts are never shuffled.

Null texts have no words. Documents without words have 0 words and no hit. Rows that
agree in doc_id and text are told apart only by their number; each gets a row. An
empty benchmark or table gives no hits or no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import attached, stored, table

WINDOW, SHINGLE = 13, 4
#: Hashes that are broadcast as they are (8 MB).
MOST_HASHES = 1 << 20
#: Bits of the table for each hash that is asked for, places of a hash in it, and bits in all: 16 MB that each task reads.
BITS, PLACES, MOST_BITS = 32, 4, 1 << 27
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    # lower() is the fast way where all characters are ASCII
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, NO_WORD), ""), F.array().cast("array<string>"))


def shingle_at(array: str, position: Column, size: int) -> Column:
    """Hash of ``size`` words from a position; the size is part of it."""
    return F.xxhash64(F.lit(size), *[F.get(array, position + k) for k in range(size)])


def window_ids(window: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), window).alias(f"id{k}") for k in (1, 2)]


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, window, id1, id2): the distinct windows of each item."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))).alias("at"))
    return w.select("item", F.slice("w", F.col("at") + 1, WINDOW).alias("window")).distinct().select("*", *window_ids("window"))


def positions(docs: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """(keep, w, at, h): a row for each position of each document and each of these sizes, with the hash of the
    shingle of that size that begins there (null where there is none), and one at -1.
    One generated sequence, as a second one would copy the words into every row, and
    explode_outer, as Spark would make the words twice to drop what has no positions."""
    rows = docs.select(*keep, "w", F.explode_outer(F.sequence(F.lit(-1), F.size("w") * len(sizes) - 1)).alias("p"))
    at = F.floor(F.col("p") / len(sizes)).cast("int")
    rows = rows.select(*keep, "w", "p", at.alias("at"))
    fits = lambda k, n: (F.col("at") >= 0) & (F.pmod("p", F.lit(len(sizes))) == k) & (F.col("at") + n <= F.size("w"))
    return rows.select(*keep, "w", "at", F.coalesce(*[F.when(fits(k, n), shingle_at("w", F.col("at"), n)) for k, n in enumerate(sizes)]).alias("h"))


def hashed_positions(docs: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """As positions(), with the hashes made before they are rows: a condition on h then has them as they are, where Spark would
    make them anew for each time that it names h."""
    n = len(sizes)
    fits = lambda p, k, size: (p >= 0) & (F.pmod(p, F.lit(n)) == k) & (F.floor(p / n).cast("int") + size <= F.size("w"))
    made = F.transform(F.sequence(F.lit(-1), F.size("w") * n - 1), lambda p: F.coalesce(*[F.when(fits(p, k, size), shingle_at("w", F.floor(p / n).cast("int"), size)) for k, size in enumerate(sizes)]))
    rows = docs.select(*keep, "w", F.posexplode_outer(made).alias("p", "h"))
    return rows.select(*keep, "w", F.floor((F.col("p") - 1) / n).cast("int").alias("at"), "h")


def _places(h: Column, bits: int) -> list[Column]:
    """Where a hash stands in a table of ``bits`` bits."""
    first, step = h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(first + k * step).bitwiseAND(bits - 1) for k in range(PLACES)]


def bit_table(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """The bits of ``n`` different hashes (h), as one value of longs, and their number."""
    bits = min(MOST_BITS, max(64, 1 << (BITS * n - 1).bit_length()))
    at = hashes.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
    longs = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(one).alias("long"))
    # bounded: MOST_BITS / 64 rows
    all_ = hashes.sparkSession.range(bits // 64).join(longs, "id", "left").select("id", F.coalesce("long", F.lit(0).cast("long")).alias("long"))
    whole = stored(all_, "decontam-bits").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "long"))), lambda x: x["long"]).alias("bits"))
    return whole.scalar(), bits


def _maybe(h: Column, table: Column, bits: int) -> Column:
    """Whether a hash may be one of the table's; those that are always may."""
    bit = lambda at: F.call_function("shiftrightunsigned", F.get(table, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(1) == 1
    return functools.reduce(operator.and_, map(bit, _places(h, bits)))


def asked_for(read: DataFrame, keep: list[str], sizes: list[int], hashes: DataFrame, always: Column) -> DataFrame:
    """The positions() of ``read`` whose h is one of the different hashes (h), and few others; rows that are ``always`` taken too."""
    n = hashes.count()
    if n <= MOST_HASHES:
        return positions(read, keep, sizes).join(F.broadcast(hashes.withColumn("__asked", F.lit(True))), "h", "left").where(always | F.col("__asked")).drop("__asked")
    return hashed_positions(read, keep, sizes).where(always | F.col("h").isNotNull() & _maybe(F.col("h"), *bit_table(hashes, n)))


def contaminated_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated) of each row;
    key tells texts of equal doc_id apart."""
    read = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("key"), words(docs[text_col]).alias("w"))
    owners = stored(benchmark_windows(items, item_col, item_text_col), "decontam-windows")
    windows = stored(owners.select("window", "id1", "id2").distinct().withColumn("size", F.size("window")), "decontam-distinct")
    sizes = sorted(windows.agg(F.collect_set(F.least("size", F.lit(SHINGLE)))).first()[0])
    if not sizes:
        none = read.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("size", "int"), ("id1", "long"), ("id2", "long"))])
        return _summed(none, owners)
    own = F.least("size", F.lit(SHINGLE))
    parts = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - own)).alias("offset"))
    shingle = F.coalesce(*[F.when(own == n, shingle_at("window", F.col("offset"), n)) for n in sizes])
    parts = stored(parts.withColumn("h", shingle), "decontam-shingles")
    asked = stored(parts.select("h").distinct(), "decontam-asked")

    # how often the documents have each shingle of the benchmark
    seen = asked_for(read, [], sizes, asked, F.lit(False)).select("h")
    seen = stored(seen.groupBy("h").agg(F.count(F.lit(1)).alias("f")), "decontam-rarity")
    ranked = parts.join(seen, "h", "left")
    rarest = ranked.groupBy("window", "id1", "id2", "size").agg(F.min(F.coalesce("f", F.lit(0))).alias("low"), F.min_by(F.struct("h", "offset"), F.struct("f", "offset")).alias("prefix")).where("low > 0")
    probe = stored(rarest.select("window", "id1", "id2", "size", "prefix.*"), "decontam-prefix")

    # positions that may begin a prefix, with the words that a window can have around it, and a row a document
    asked = stored(probe.select("h").distinct(), "decontam-asked")
    at = asked_for(read, ["doc_id", "key"], sizes, asked, F.col("at") < 0)
    left = F.least(F.col("at"), F.lit(WINDOW - 1))
    around = F.when(F.col("at") >= 0, F.slice("w", F.greatest(F.col("at") - left + 1, F.lit(1)), F.greatest(left, F.lit(0)) + WINDOW))
    near = stored(at.select("doc_id", "key", F.when(F.col("at") < 0, F.size("w").cast("long")).alias("n_words"), "at", "h", around.alias("around"), left.alias("left")), "decontam-near")
    met = near.where("at >= 0").join(probe, "h")
    begin = F.col("left") - F.col("offset")
    held = (begin >= 0) & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("size")) == F.col("window"))
    hits = met.where(held).select("doc_id", "key", F.lit(None).cast("long").alias("n_words"), (F.col("at") - F.col("offset")).alias("start"), "size", "id1", "id2")
    none = near.where("at < 0").select("doc_id", "key", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("size", "int"), ("id1", "long"), ("id2", "long"))])
    return _summed(none.union(hits), owners)


def _summed(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """From rows of documents (n_words) and of hits (start, size, id1, id2) to one a document row."""
    hits = stored(hits, "decontam-hits")
    spans = F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("size")).alias("end")))))
    grouped = hits.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), spans.alias("spans"))
    held = hits.where("start is not null").select("doc_id", "key", F.struct("id1", "id2").alias("id")).distinct()
    held = attached(held, owners.select(F.struct("id1", "id2").alias("id"), "item"), "id", F.struct("doc_id", "key"))
    own = held.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    grouped = grouped.join(own, grouped["doc_id"].eqNullSafe(own["_doc"]) & grouped["key"].eqNullSafe(own["_key"]), "left")
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate("spans", zero, lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(x["end"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n")), lambda a: a["n"])
    out = grouped.select("doc_id", "key", "n_words", union.alias("n_hit"), F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.select(
        "doc_id", "key", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = contaminated_documents(docs, items, id_col, text_col, **names).where("contaminated").select(F.col("doc_id").alias("_bad"), F.col("key").alias("_key"))
    same = docs[id_col].eqNullSafe(bad["_bad"]) & F.xxhash64(docs[text_col]).eqNullSafe(bad["_key"])
    return docs.join(bad, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contaminated_documents(docs, table(spark, sf_dir, "benchmark")).drop("key")


SQL = r"""
WITH t AS (SELECT 'd' AS k, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark),
w AS (SELECT k, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
i AS (SELECT id AS item, w, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM w WHERE k = 'b' AND len(w) > 0),
v AS (SELECT array_to_string(w[s + 1:s + 13], ' ') AS x, len(w[s + 1:s + 13]) AS n, list(DISTINCT item) AS items FROM i GROUP BY 1, 2),
z AS (SELECT DISTINCT n FROM v),
p AS (SELECT id, w, z.n, unnest(range(0, len(w) - z.n + 1)) AS s FROM w, z WHERE k = 'd' AND len(w) >= z.n),
h AS (SELECT p.id, p.s, p.n, v.items FROM p JOIN v ON v.n = p.n AND v.x = array_to_string(p.w[p.s + 1:p.s + p.n], ' ')),
c AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(s, s + n)) AS q FROM h) GROUP BY id),
f AS (SELECT id, list_sort(list(DISTINCT item)) AS items FROM (SELECT id, unnest(items) AS item FROM h) GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, len(w.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(len(f.items), 0) AS n_items, sha256(coalesce(array_to_string(f.items, ','), '')) AS items_sha256,
coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(w.w) AS contaminated FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN f ON f.id = w.id WHERE w.k = 'd'
"""
