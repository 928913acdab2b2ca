"""Quality rules by distribution divergence, in DataFrame operations only.

For each document two histograms are counted: characters by class, and the COMMON words of its language
that most documents of that language have (all other words together). The same, summed over all documents of
a language and script that pass the base rules, are that group's references. The
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of the
document to its group's references tells prose from tables, symbol noise,
shouting and word salad. Histograms of few words are noise, so each distance has a least length
under which it is not judged.

Every group has a reference, however few documents it has: documents of a rare language or script are compared with
each other, never with those of another, and a lone one with itself, which it passes. The script is that of most
letters; a document without a letter is compared with its language's most frequent script. Documents without language
are a language of their own.

Base rules fail documents of under MIN_WORDS words, and those of whose words more
than half lie in three-word windows that the text repeats.

Null and empty texts have no words and fail the base rules. Repeated rows give a row each. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import dropped, stored, table

MIN_WORDS = 50
#: Words from which each distance is judged, and the largest distance that is kept.
CHAR_WORDS, CHAR_MOST = 50, 0.26
WORD_WORDS, WORD_MOST = 100, 0.29
#: Words of a language that are counted one by one: those that most of its documents have.
COMMON = 24
SPACE = r"\x20\x09-\x0D"
#: What is taken out of a text in turn; the lengths tell how many characters of each class it has.
CLASSES = {"lower": "[a-z]+", "space": f"[{SPACE}]+", "symbol": r"[#*$%&|<>]+", "upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[.,;:!?'\"()\-]+", "letter": r"\p{L}+"}
#: The same of the letters other than A-Z; letters of no script named here are one more.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from h: the words in windows (hashes by position) that occur
    twice or more. Each step is a column of its own, so that none is made again for
    each use, and null (no work) where no window repeats."""
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    behind = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    twins = F.zip_with("placed", behind("placed"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("twins", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins)))))
    step = F.zip_with("twins", behind("twins"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), operator.add), F.lit(0)).cast("long"))


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, common): the COMMON words, lower-cased, that most documents of each language have."""
    words = F.array_distinct(F.array_remove(F.split(F.lower(docs[text_col]), f"[{SPACE}]+"), ""))
    counts = docs.select(docs[lang_col].alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # Spark takes the first COMMON of each task's words before they meet
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counts.withColumn("rank", rank).where(F.col("rank") <= COMMON)
    return first.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("common"))


def _script(df: DataFrame, letters: str) -> DataFrame:
    """Adds script, of the most of a text's letters; empty if it has none. ``letters``: those other than A-Z, as text."""
    df = df.withColumn("s0", F.col(letters))
    for k, name in enumerate(SCRIPTS):
        df = df.withColumn(f"s{k + 1}", F.regexp_replace(f"s{k}", f"\\p{{Is{name}}}+", ""))
    n = [F.length(f"s{k}") - F.length(f"s{k + 1}") for k in range(len(SCRIPTS))] + [F.length(f"s{len(SCRIPTS)}")]
    n[0] = n[0] + F.col("ascii_letters")
    most = F.array_max(F.array(*[F.struct(x.alias("n"), F.lit(name).alias("script")) for x, name in zip(n, (*SCRIPTS, "other"))]))
    return df.withColumn("most", most).withColumn("script", F.when(F.col("most.n") > 0, F.col("most.script")).otherwise(""))


def features(docs: DataFrame, common: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Counts of each document: base figures, its script, and the two histograms."""
    df = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    common = common.withColumnRenamed("lang", "of")
    df = df.join(common, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    df = df.withColumn("w", F.array_remove(F.split("t", f"[{SPACE}]+"), ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn("h", F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = _with_repeat_words(df)
    lowered = F.array_remove(F.split(F.lower("t"), f"[{SPACE}]+"), "")
    # words have no spaces, so each stands alone between two
    df = df.withColumn("found", F.concat(F.lit(" "), F.array_join(F.filter(lowered, lambda x: F.array_contains("common", x)), "  "), F.lit(" ")))
    each = lambda x: ((F.length("found") - F.length(F.replace("found", F.concat(F.lit(" "), x, F.lit(" ")), F.lit("")))) / (F.length(x) + 2)).cast("long")
    known = F.transform(F.sequence(F.lit(0), F.lit(COMMON - 1)), lambda i: F.coalesce(each(F.get("common", i)), F.lit(0).cast("long")))
    df = df.withColumn("r0", F.col("t"))
    for k, pattern in enumerate(CLASSES.values()):
        df = df.withColumn(f"r{k + 1}", F.regexp_replace(f"r{k}", pattern, ""))
    by_class = {name: F.length(f"r{k}") - F.length(f"r{k + 1}") for k, name in enumerate(CLASSES)}
    by_class["other"] = F.length(f"r{len(CLASSES)}")
    df = df.withColumn("ascii_letters", by_class["lower"] + by_class["upper"]).withColumn("letters", F.regexp_replace(f"r{len(CLASSES) - 1}", r"\P{L}+", ""))
    df = _script(df, "letters").select(
        "doc_id", "lang", "script", F.size("w").cast("long").alias("n_words"), (F.length("t") - by_class["space"]).cast("long").alias("word_chars"), by_class["symbol"].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*[c.cast("long") for c in by_class.values()]).alias("chars"), known.alias("known"),
    )
    sum_known = F.aggregate("known", F.lit(0).cast("long"), operator.add)
    df = df.withColumn("known", F.concat("known", F.array(F.col("n_words") - sum_known)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def shares(counts: str) -> Column:
    """A count array as shares of its sum; null if that is 0. The sum is taken once
    and handed to the elements through a one-element array."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.exists(counts, lambda x: x > 0), F.get(F.transform(F.array(total), lambda n: F.transform(counts, lambda x: x / n)), F.lit(0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    bits = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), bits / 2))


def references(counted: DataFrame) -> DataFrame:
    """(of, refs): the references of each language by script, a struct each of script, number of documents, and shares."""
    passed = counted.where(~F.col("base_failed"))
    sums = [F.array(*[F.sum(F.get(c, i)).cast("double") for i in range(n)]).alias(f"ref_{c}") for c, n in (("chars", len(CLASSES) + 1), ("known", COMMON + 1))]
    each = passed.groupBy(F.col("lang").alias("of"), "script").agg(F.count(F.lit(1)).alias("docs"), *sums)
    each = each.select("of", "script", "docs", shares("ref_chars").alias("ref_chars"), shares("ref_known").alias("ref_known"))
    return each.groupBy("of").agg(F.collect_list(F.struct("script", "docs", "ref_chars", "ref_known")).alias("refs"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance) of each row."""
    common = stored(common_words(docs, text_col, lang_col), "quality-words")
    counted = stored(features(docs, common, id_col, text_col, lang_col), "quality-features")
    dropped(common)
    # a row a language
    df = counted.join(stored(references(counted), "quality-references"), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    own = F.get(F.filter("refs", lambda r: r["script"] == F.col("script")), F.lit(0))
    main = F.get(F.array_sort(F.filter("refs", lambda r: r["script"] != ""), lambda a, b: F.when(a["docs"] > b["docs"], -1).when(a["docs"] < b["docs"], 1).when(a["script"] < b["script"], -1).otherwise(1)), F.lit(0))
    df = df.withColumn("ref", F.when(F.col("script") == "", F.coalesce(main, own)).otherwise(own)).drop("refs")
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    df = df.withColumns({"chars": as_double("chars"), "known": as_double("known")}).withColumns({"chars": shares("chars"), "known": shares("known")})
    df = df.withColumns({"char_distance": js_distance(F.col("chars"), F.col("ref.ref_chars")), "word_distance": js_distance(F.col("known"), F.col("ref.ref_known"))})
    bad = [(F.col("n_words") >= n) & (F.col(d) > most) for n, d, most in ((CHAR_WORDS, "char_distance", CHAR_MOST), (WORD_WORDS, "word_distance", WORD_MOST))]
    kept = ~F.col("base_failed") & ~F.coalesce(functools.reduce(operator.or_, bad), F.lit(False))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_distance", "word_distance")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _sql() -> str:
    """The same in DuckDB."""
    counts = []
    steps, before = ["f0 AS (SELECT *, t AS r0 FROM d)"], "f0"
    for k, (name, pattern) in enumerate(CLASSES.items()):
        quoted = pattern.replace("'", "''")
        steps.append(f"f{k + 1} AS (SELECT *, regexp_replace(r{k}, '{quoted}', '', 'g') AS r{k + 1} FROM {before})")
        before = f"f{k + 1}"
        counts.append(f"length(r{k}) - length(r{k + 1})")
    counts.append(f"length(r{len(CLASSES)})")
    scripts = ", ".join(f"(length(regexp_replace(r{len(CLASSES) - 1}, '[^\\p{{{x}}}]', '', 'g')){f' + {counts[0]} + {counts[3]}' if x == 'Latin' else ''}, '{x}')" for x in SCRIPTS)
    rest = f"(length(regexp_replace(regexp_replace(r{len(CLASSES) - 1}, '[^\\p{{L}}]', '', 'g'), '[{''.join(chr(92) + f'p{{{x}}}' for x in SCRIPTS)}]', '', 'g')), 'other')"
    share = "list_transform({0}, lambda x: x / list_sum({0}))"
    js = "sqrt(greatest(0, list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2))"
    words = f"list_filter(string_split_regex(%s, '[{SPACE}]+'), lambda x: x <> '')"
    sums = lambda c: f"SELECT lang, script, k, sum(c) AS s FROM (SELECT lang, script, unnest({c}) AS c, generate_subscripts({c}, 1) AS k FROM a WHERE NOT base_failed) GROUP BY lang, script, k"
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {words % "coalesce(text, '')"} AS w, {words % "lower(coalesce(text, ''))"} AS lw, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM documents),
{", ".join(steps)},
p3 AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS k FROM d WHERE len(w) > 2), x3 AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k + 1:k + 3]) AS c FROM p3),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS q FROM x3 WHERE c > 1) GROUP BY doc_id),
voc AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k FROM (SELECT lang, unnest(list_distinct(lw)) AS word FROM d) GROUP BY lang, word QUALIFY k <= {COMMON}),
top AS (SELECT lang, list(word ORDER BY k) AS common FROM voc GROUP BY lang),
b AS (SELECT {before}.doc_id, {before}.lang, list_max([{scripts}, {rest}]) AS m, len(w) AS n_words, length(t) - ({counts[1]}) AS word_chars, {counts[2]} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
[{", ".join(counts)}] AS chars, list_transform(range(1, {COMMON} + 1), lambda i: len(list_filter(list_filter(lw, lambda y: list_contains(common, y)), lambda x: x = common[i]))) AS known0 FROM {before} LEFT JOIN rep ON rep.doc_id = {before}.doc_id LEFT JOIN top ON top.lang IS NOT DISTINCT FROM {before}.lang),
a AS (SELECT *, CASE WHEN m[1] > 0 THEN m[2] ELSE '' END AS script, list_append(known0, n_words - list_sum(known0)) AS known, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
n AS (SELECT lang, script, count(*) AS docs FROM a WHERE NOT base_failed GROUP BY lang, script),
rc AS ({sums("chars")}), rk AS ({sums("known")}),
lc AS (SELECT lang, script, list(CAST(s AS DOUBLE) ORDER BY k) AS c FROM rc GROUP BY lang, script), lk AS (SELECT lang, script, list(CAST(s AS DOUBLE) ORDER BY k) AS c FROM rk GROUP BY lang, script),
ref AS (SELECT lc.lang, lc.script, docs, {share.format("lc.c")} AS chars, {share.format("lk.c")} AS known FROM lc JOIN lk ON lc.lang IS NOT DISTINCT FROM lk.lang AND lc.script = lk.script JOIN n ON n.lang IS NOT DISTINCT FROM lc.lang AND n.script = lc.script),
main AS (SELECT lang, script AS main FROM ref QUALIFY row_number() OVER (PARTITION BY lang ORDER BY script = '', docs DESC, script) = 1),
g AS (SELECT a.* EXCLUDE (chars, known, known0), CASE WHEN script = '' THEN coalesce(main, '') ELSE script END AS use, CASE WHEN list_sum(chars) > 0 THEN {share.format("chars")} END AS chars, CASE WHEN n_words > 0 THEN {share.format("known")} END AS known FROM a LEFT JOIN main ON main.lang IS NOT DISTINCT FROM a.lang),
v AS (SELECT g.*, {js.format("g.chars", "ref.chars")} AS cd, {js.format("g.known", "ref.known")} AS wd FROM g LEFT JOIN ref ON ref.lang IS NOT DISTINCT FROM g.lang AND ref.script = g.use)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT coalesce((n_words >= {CHAR_WORDS} AND cd > {CHAR_MOST}) OR (n_words >= {WORD_WORDS} AND wd > {WORD_MOST}), false) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM v"""


SQL = _sql()
