"""Queries over the test tables, one or more for each operator, with SQL of the same result.

Stand-ins: a sample is a document or a vector, its contributor the source, its batch
the language, its label the vector's label; a log record is an event.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions import crypto
from auditlake.functions.tables import file_system, shared_folder, written
from auditlake.operators import chain, governance, lineage, merkle, model_audit, models, provenance, redteam, samples, shift
from auditlake.sources import datasets, ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def document_samples(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("doc_id")
    return read(spark, d, "documents").select(x.alias("idx"), x.cast("string").alias("sample_id"), F.col("source").alias("contributor_id"), F.col("lang").alias("batch_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return samples.exact_duplicates(document_samples(spark, d), F.sha2("text", 256))


def outliers(spark: SparkSession, d: str) -> DataFrame:
    return samples.outlier_scores(vectors(spark, d))


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates and outliers as findings."""
    return duplicates(spark, d).select("finding_id", "module", "asset", "severity", "disposition", "confidence", "recommended_action").union(
        samples.outlier_findings(outliers(spark, d)).select("finding_id", F.lit("shift_diagnostician"), "asset", "severity", "disposition", "confidence", "recommended_action")
    )


DUP = """d AS (SELECT doc_id, sha256(text) AS h, source, lang FROM documents),
g AS (SELECT h, count(*) AS c, min(doc_id) AS p FROM d GROUP BY h HAVING count(*) > 1),
dup AS (SELECT d.doc_id, d.h, d.source, d.lang, g.c, g.p FROM d JOIN g ON d.h = g.h WHERE d.doc_id <> g.p)"""
VEC = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
m AS (SELECT pos, sum(x) AS s FROM x GROUP BY pos),
c AS (SELECT list(s / (SELECT sqrt(sum(s * s)) + 1e-12 FROM m) ORDER BY pos) AS c FROM m),
dist AS (SELECT vec_id, 1 - list_dot_product(v, c.c) AS dist FROM e, c),
st AS (SELECT avg(dist) AS mean, stddev_pop(dist) AS sd, quantile_cont(dist, 0.95) AS cutoff FROM dist),
ood AS (SELECT vec_id, dist, (dist - mean) / (sd + 1e-8) AS z, cutoff FROM dist, st),
bad AS (SELECT * FROM ood WHERE (z >= 2.2 AND dist >= 0.25) OR (z >= 2.0 AND dist > cutoff AND dist >= 0.30))"""
FINDINGS = f"""WITH {DUP}, {VEC},
f AS (SELECT printf('FIND-DS-EXACT-DUP-%04d', doc_id) AS finding_id, 'data_sentinel' AS module, CAST(doc_id AS VARCHAR) AS asset, 'HIGH' AS severity, 'QUARANTINE' AS disposition, 1.0::DOUBLE AS confidence, 'Keep one sample of the group' AS recommended_action FROM dup
UNION ALL SELECT printf('FIND-DS-OOD-%04d', vec_id), 'shift_diagnostician', CAST(vec_id AS VARCHAR), 'MEDIUM', 'REVIEW', round(least(0.95, 0.65 + z * 0.1), 2), 'Check that the sample belongs to the domain' FROM bad)"""


# --- samples -----------------------------------------------------------------


@query(f"WITH {DUP} SELECT printf('FIND-DS-EXACT-DUP-%04d', doc_id) AS finding_id, 'data_sentinel' AS module, CAST(doc_id AS VARCHAR) AS asset, 'HIGH' AS severity, 1.0::DOUBLE AS confidence, 'QUARANTINE' AS disposition, h AS sha256, CAST(p AS VARCHAR) AS original_sample_id, c AS duplicate_count FROM dup")
def exact_duplicates(spark, d):
    return duplicates(spark, d).select("finding_id", "module", "asset", "severity", "confidence", "disposition", "sha256", "original_sample_id", "duplicate_count")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS idx FROM documents GROUP BY 1")
def duplicate_survivors(spark, d):
    return samples.survivors(document_samples(spark, d), F.sha2("text", 256)).select("sha256", "idx")


def _risk_sql(key: str) -> str:
    return f"""WITH {DUP}, r AS (SELECT documents.{key} AS k, count(*) AS total, count(dup.doc_id) AS flagged FROM documents LEFT JOIN dup ON documents.doc_id = dup.doc_id GROUP BY 1)
SELECT k AS id, total, flagged, round(flagged / total, 4) AS violation_rate, CASE WHEN flagged / total < 0.10 THEN 'ACCEPT' WHEN flagged / total > 0.30 THEN 'QUARANTINE' ELSE 'REVIEW' END AS disposition FROM r"""


@query(_risk_sql("source"))
def contributor_risk(spark, d):
    return samples.risk(document_samples(spark, d), duplicates(spark, d), "contributor_id", review=0.10).withColumnRenamed("contributor_id", "id")


@query(_risk_sql("lang"))
def batch_risk(spark, d):
    return samples.risk(document_samples(spark, d), duplicates(spark, d), "batch_id", review=0.10).withColumnRenamed("batch_id", "id")


@query(f"""WITH {DUP}, r AS (SELECT documents.source AS k, count(*) AS total, count(dup.doc_id) AS flagged FROM documents LEFT JOIN dup ON documents.doc_id = dup.doc_id GROUP BY 1)
SELECT 'FIND-DS-CONTRIB-' || k AS finding_id, k AS asset, CASE WHEN flagged / total < 0.3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 0.92::DOUBLE AS confidence, CASE WHEN flagged / total > 0.30 THEN 'QUARANTINE' ELSE 'REVIEW' END AS disposition FROM r WHERE flagged / total >= 0.10""")
def contributor_findings(spark, d):
    by = samples.risk(document_samples(spark, d), duplicates(spark, d), "contributor_id", review=0.10)
    return samples.risk_findings(by).select("finding_id", "asset", "severity", "confidence", "disposition")


@query(f"""WITH {DUP}, j AS (SELECT documents.source, documents.lang, dup.doc_id AS hit FROM documents LEFT JOIN dup ON documents.doc_id = dup.doc_id),
r AS (SELECT 'contributor' AS kind, source AS id, count(*) AS total, count(hit) AS flagged FROM j GROUP BY source UNION ALL SELECT 'batch', lang, count(*), count(hit) FROM j GROUP BY lang)
SELECT kind, id, total, flagged, round(flagged / total, 4) AS violation_rate, CASE WHEN flagged / total < 0.15 THEN 'ACCEPT' WHEN flagged / total > 0.30 THEN 'QUARANTINE' ELSE 'REVIEW' END AS disposition FROM r""")
def risk_grouping_sets(spark, d):
    return samples.risk_grouping_sets(document_samples(spark, d), duplicates(spark, d))


def _bits_sql(n: int) -> str:
    return " + ".join(f"CASE WHEN embedding[{k + 1}] > 0 THEN {1 << k} ELSE 0 END" for k in range(n))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST({_bits_sql(16)} AS BIGINT) AS h FROM embeddings)
SELECT a.vec_id AS i, b.vec_id AS j, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance, round(list_dot_product(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 3 AND list_dot_product(a.v, b.v) >= 0.3""")
def near_duplicate_pairs(spark, d):
    rows = vectors(spark, d).select("idx", "v", C.sign_bits("v", 16).alias("h"))
    return samples.near_duplicates(rows, 3, 0.3, 16).withColumn("cosine", F.round("cosine", 6))


@query("""WITH h AS (SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 4) AS BIGINT) AS h FROM documents)
SELECT a.doc_id AS i, b.doc_id AS j FROM h a JOIN h b ON a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 1""")
def hash_banding_pairs(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), C.hex_to_long(F.left(F.sha2("text", 256), F.lit(4))).alias("h"))
    return samples.hamming_pairs(rows, 1, 16).select(F.col("a.idx").alias("i"), F.col("b.idx").alias("j"))


KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label, b.label AS vote, list_dot_product(a.v, b.v) AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(cosine, 12) DESC, j) AS r FROM s QUALIFY r <= 5),
v AS (SELECT i, label, vote, count(*) AS n, min(r) AS first FROM k GROUP BY ALL),
p AS (SELECT i, any_value(label) AS label, arg_max(vote, n * 100 - first) AS dominant, max(n) / 5 AS dominant_ratio, coalesce(sum(n) FILTER (vote = label), 0) / 5 AS purity FROM v GROUP BY i)"""


@query(f"WITH {KNN} SELECT i, j, round(cosine, 6) AS cosine, r AS rank FROM k")
def knn_topk(spark, d):
    return samples.nearest(vectors(spark, d), 5).select("i", "j", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {KNN} SELECT i, max(round(cosine, 6)) FILTER (r = 1) AS cosine FROM k WHERE i % 100 = 0 GROUP BY i")
def knn_nearest_one(spark, d):
    """The exact nearest neighbour of every hundredth vector among all."""
    rows = vectors(spark, d)
    return samples.nearest(rows, 1, queries=rows.where("idx % 100 = 0")).select("i", F.round("cosine", 6).alias("cosine"))


@query("SELECT count(*) AS rows, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def knn_index(spark, d):
    """How many of the queries (every hundredth vector) the index answers, and whether it finds nine tenths of their exact neighbours."""
    rows = vectors(spark, d)
    asked = rows.where("idx % 100 = 0")
    found = samples.nearest_indexed(rows, 5, samples.fit_index(rows, 5, 0.99), asked)
    both = samples.nearest(rows, 5, queries=asked).select("i", "j").join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left")
    return both.agg(F.count_distinct("i").alias("rows"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))


@query(f"WITH {KNN} SELECT i, CAST(label AS BIGINT) AS label, CAST(dominant AS BIGINT) AS dominant, round(dominant_ratio, 6) AS dominant_ratio, round(purity, 6) AS purity FROM p")
def label_purity(spark, d):
    rows = vectors(spark, d)
    return samples.label_purity(rows, samples.neighbours(rows, 5)).select("i", "label", "dominant", F.round("dominant_ratio", 6).alias("dominant_ratio"), F.round("purity", 6).alias("purity"))


@query(f"""WITH {KNN}, x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), t AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM x GROUP BY label, pos),
c AS (SELECT label, list(s ORDER BY pos) AS total, max(n) AS n FROM t GROUP BY label),
q AS (SELECT p.*, e.v, list_transform(list_zip(o.total, e.v), lambda z: z[1] - z[2]) AS own, w.total AS other FROM p JOIN e ON e.vec_id = p.i JOIN c o ON o.label = p.label JOIN c w ON w.label = p.dominant WHERE purity <= 0.40 AND dominant <> p.label AND dominant_ratio >= 0.60),
z AS (SELECT *, 1 - list_dot_product(v, own) / sqrt(list_dot_product(own, own)) AS dist_own, 1 - list_dot_product(v, other) / sqrt(list_dot_product(other, other)) AS dist_other FROM q)
SELECT i, CAST(label AS BIGINT) AS label, CAST(dominant AS BIGINT) AS dominant, round(dist_own, 6) AS dist_own, round(dist_other, 6) AS dist_other, round(least(0.98, greatest(dominant_ratio, 0.75)), 2) AS confidence FROM z WHERE dist_other < dist_own""")
def label_flips(spark, d):
    rows = vectors(spark, d)
    return samples.label_flips(rows, samples.neighbours(rows, 5)).select("i", "label", "dominant", F.round("dist_own", 6).alias("dist_own"), F.round("dist_other", 6).alias("dist_other"), "confidence")


@query("WITH x AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) SELECT CAST(label AS BIGINT) AS label, CAST(pos - 1 AS BIGINT) AS pos, count(*) AS n, round(avg(x), 6) AS mean FROM x GROUP BY label, pos")
def class_centroids(spark, d):
    c = samples.centroids(vectors(spark, d))
    return c.select("label", "n", F.posexplode("total").alias("pos", "s")).select("label", F.col("pos").cast("long").alias("pos"), "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@query(f"WITH {VEC} SELECT vec_id AS idx, round(dist, 6) AS dist, round(z, 6) AS z, round(cutoff, 6) AS cutoff, vec_id IN (SELECT vec_id FROM bad) AS is_ood FROM ood")
def ood_scores(spark, d):
    return outliers(spark, d).select("idx", *[F.round(c, 6).alias(c) for c in ("dist", "z", "cutoff")], "is_ood")


@query(f"WITH {VEC} SELECT printf('FIND-DS-OOD-%04d', vec_id) AS finding_id, 'MEDIUM' AS severity, 'REVIEW' AS disposition, round(least(0.95, 0.65 + z * 0.1), 2) AS confidence FROM bad")
def ood_findings(spark, d):
    return samples.outlier_findings(outliers(spark, d)).select("finding_id", "severity", "disposition", "confidence")


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, unnest(l) AS key, unnest(range(0, len(l))) AS place FROM t),
g AS (SELECT key, count(DISTINCT doc_id) AS members, min(doc_id) AS d, arg_min(place, (doc_id, place)) AS p FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
h AS (SELECT DISTINCT k.doc_id, k.key, g.members, g.d, g.p FROM k JOIN g ON k.key = g.key), o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, p, key) = 1),
f AS (SELECT key, list(DISTINCT doc_id) AS m FROM k GROUP BY key) SELECT o.doc_id AS idx, md5(o.key) AS key_md5, o.members, array_to_string(list_sort(f.m)[1:5], ',') AS first_members FROM o JOIN f ON f.key = o.key""")
def repeated_patterns(spark, d):
    """Lines that documents share, at any place."""
    keys = read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.posexplode(F.split("text", "\n")).alias("place", "key"))
    return samples.repeated_patterns(keys).select("idx", F.md5("key").alias("key_md5"), "members", F.array_join(F.transform("first_members", lambda x: x.cast("string")), ",").alias("first_members"))


@query("SELECT doc_id AS idx FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (WITH " + DUP + " SELECT doc_id FROM dup))")
def not_duplicates(spark, d):
    return samples.without(document_samples(spark, d), duplicates(spark, d)).select("idx")


@query("SELECT 'FIND-DS-CORRUPT-' || doc_id AS finding_id, CAST(doc_id AS VARCHAR) AS asset, 'HIGH' AS severity, 'QUARANTINE' AS disposition, 1.0::DOUBLE AS confidence FROM documents WHERE n_chars % 17 = 0")
def corrupt_findings(spark, d):
    mark = F.create_map(F.lit("is_corrupted"), F.when(F.col("n_chars") % 17 == 0, "true").otherwise("false"))
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), mark.alias("metadata"))
    return samples.corrupt_findings(rows).select("finding_id", "asset", "severity", "disposition", "confidence")


@query("SELECT 'orders' AS rows, o_orderkey AS id FROM orders WHERE (SELECT count(*) >= 6 AND count(DISTINCT o_orderstatus) >= 2 FROM orders) UNION ALL SELECT 'region', r_regionkey FROM region WHERE (SELECT count(*) >= 6 FROM region)")
def guarded_rows(spark, d):
    """Tables that have six rows and two classes; the regions are five."""
    orders = samples.guarded(read(spark, d, "orders"), 6, "o_orderstatus").select(F.lit("orders").alias("rows"), F.col("o_orderkey").alias("id"))
    return orders.union(samples.guarded(read(spark, d, "region"), 6).select(F.lit("region"), F.col("r_regionkey").cast("long")))


@query(f"""WITH {DUP}, r AS (SELECT documents.source AS k, count(*) AS total, count(dup.doc_id) AS flagged FROM documents LEFT JOIN dup ON documents.doc_id = dup.doc_id GROUP BY 1)
SELECT k AS asset, 'Many samples flagged: ' || flagged || '/' || total || printf(' (%.1f%%)', 100 * flagged / total) AS reason FROM r WHERE flagged / total >= 0.05""")
def contributor_reasons(spark, d):
    by = samples.risk(document_samples(spark, d), duplicates(spark, d), "contributor_id", review=0.05)
    return samples.risk_findings(by).select("asset", "reason")


@query("SELECT arg AS p, quantile_cont(o_totalprice, arg) AS value FROM orders, (VALUES (0.5), (0.95)) v(arg) GROUP BY arg".replace("quantile_cont(o_totalprice, arg)", "CASE WHEN arg = 0.5 THEN quantile_cont(o_totalprice, 0.5) ELSE quantile_cont(o_totalprice, 0.95) END").replace("arg AS p", "CAST(arg AS DOUBLE) AS p"))
def exact_quantiles(spark, d):
    rows = read(spark, d, "orders")
    return spark.createDataFrame([(p, samples.quantile(rows, "o_totalprice", p)) for p in (0.5, 0.95)], "p double, value double").withColumn("value", F.col("value"))


# --- governance --------------------------------------------------------------


@query(f"{FINDINGS} SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM f")
def severity_summary(spark, d):
    return governance.severity_counts(all_findings(spark, d))


@query(f"{FINDINGS} SELECT module, CASE WHEN bool_or(disposition = 'QUARANTINE') THEN 'QUARANTINE' WHEN bool_or(disposition = 'REVIEW') THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition FROM f GROUP BY module")
def module_dispositions(spark, d):
    return governance.overall(all_findings(spark, d), ["module"])


@query(f"{FINDINGS} SELECT CASE WHEN bool_or(disposition = 'QUARANTINE') THEN 'QUARANTINE' WHEN bool_or(disposition = 'REVIEW') THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition FROM f")
def overall_disposition(spark, d):
    return governance.overall(all_findings(spark, d))


@query(f"{FINDINGS} SELECT coalesce(round(avg(confidence), 2), 0.85) AS confidence FROM f")
def mean_confidence(spark, d):
    return governance.mean_confidence(all_findings(spark, d))


@query(f"WITH {DUP} SELECT count(*) AS clean_samples FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dup)")
def clean_samples(spark, d):
    return governance.clean_samples(document_samples(spark, d), duplicates(spark, d))


@query(f"{FINDINGS} SELECT finding_id, severity, asset FROM f ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, finding_id LIMIT 5")
def top_findings(spark, d):
    return governance.top(all_findings(spark, d)).select("finding_id", "severity", "asset")


@query(f"{FINDINGS} SELECT row_number() OVER (ORDER BY min(r)) AS position, recommended_action AS action FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, finding_id) AS r FROM f) WHERE r <= 5 GROUP BY recommended_action")
def remediation_list(spark, d):
    return governance.remediations(all_findings(spark, d))


@query(f"{FINDINGS} SELECT module, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'critical' WHEN bool_or(severity IN ('HIGH', 'MEDIUM')) THEN 'flagged' ELSE 'clear' END AS state FROM f GROUP BY module")
def stage_states(spark, d):
    return governance.stage_states(all_findings(spark, d))


@query(f"{FINDINGS} SELECT string_split(module || '/' || asset, '/')[-1] AS batch, count(*) AS n, CAST(min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS BIGINT) AS gravest FROM f GROUP BY 1")
def findings_by_batch(spark, d):
    return governance.by_batch(all_findings(spark, d).withColumn("asset", F.concat_ws("/", "module", "asset")))


@query(f"{FINDINGS} SELECT count(DISTINCT asset) AS assets, count(*) FILTER (severity = 'CRITICAL') AS criticals, count(*) FILTER (disposition = 'REVIEW') AS open_reviews, count(DISTINCT CASE WHEN regexp_matches(asset, '(?i)model') THEN asset END) AS models, count(DISTINCT CASE WHEN regexp_matches(asset, '(?i)data|batch') THEN asset END) AS datasets FROM f")
def headline_counts(spark, d):
    return governance.headline(all_findings(spark, d))


@query(f"{FINDINGS} SELECT finding_id, asset FROM f WHERE contains(finding_id, 'EXACT-DUP')")
def findings_by_id_text(spark, d):
    return governance.with_id(all_findings(spark, d), "EXACT-DUP").select("finding_id", "asset")


@query("SELECT p_partkey AS id, p_size / 1.0::DOUBLE AS blur, CASE WHEN p_size < 25 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition FROM part")
def blur_reviews(spark, d):
    return governance.blur_reviews(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("blur")))


@query(f"{FINDINGS} SELECT finding_id, CASE WHEN regexp_matches(lower(recommended_action || ' ' || asset || ' ' || finding_id), 'dup') THEN 'duplicate' WHEN regexp_matches(lower(recommended_action || ' ' || asset || ' ' || finding_id), 'label|mislabel') THEN 'label' WHEN regexp_matches(lower(recommended_action || ' ' || asset || ' ' || finding_id), 'ood|out-of-distribution') THEN 'ood' ELSE 'other' END AS category FROM f")
def finding_categories(spark, d):
    return all_findings(spark, d).select("finding_id", C.evidence_category(F.col("recommended_action"), F.col("asset"), F.col("finding_id")).alias("category"))


@query("SELECT event_id AS id, event_type AS label FROM events WHERE contains(lower(concat_ws(' ', event_id, event_type, props)), 'click')")
def history_search(spark, d):
    h = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("label"), F.col("props").alias("assets"))
    return governance.search(h, "CLICK").select("id", "label")


@query("""SELECT event_id AS id, 'value' AS key, value, 100.0::DOUBLE AS threshold FROM events WHERE value > 100.0""")
def value_over_threshold(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.create_map(F.lit("value"), F.col("value"), F.lit("value_threshold"), F.lit(100.0)).alias("numbers"))
    return governance.over_thresholds(e)


@query(f"WITH {DUP} SELECT printf('FIND-DS-EXACT-DUP-%04d', doc_id) AS finding_id, 'expected' AS side, 'original_sample_id' AS key, CAST(p AS VARCHAR) AS value FROM dup")
def evidence_pairs(spark, d):
    return governance.evidence_pairs(duplicates(spark, d))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < -900 THEN 'CORRUPT' WHEN c_acctbal < -800 THEN 'TRIGGER SUSPECTED' WHEN c_nationkey = 0 THEN 'GROUND TRUTH UNAVAILABLE'
WHEN NOT contains(lower(c_mktsegment), 'auto') AND c_nationkey <> 1 AND c_acctbal / 10000 >= 0.5 THEN 'LABEL INCONSISTENCY' WHEN NOT contains(lower(c_mktsegment), 'auto') AND c_nationkey <> 1 THEN 'OUT OF DISTRIBUTION'
WHEN NOT contains(lower(c_mktsegment), 'auto') THEN 'REVIEW REQUIRED' WHEN c_nationkey < 5 THEN 'REVIEW REQUIRED' ELSE 'CLEAN' END AS status FROM customer""")
def assurance_status(spark, d):
    c = read(spark, d, "customer")
    nation = F.col("c_nationkey")
    images = c.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < -900).alias("corrupt"), (F.col("c_acctbal") < -800).alias("trigger"), F.when(nation != 0, "Auto").alias("expected"), F.col("c_mktsegment").alias("top1"), F.array("c_mktsegment", F.when(nation == 1, "automobile").otherwise("-")).alias("top5"), (F.col("c_acctbal") / 10000).alias("confidence"), F.when(nation < 5, 10.0).otherwise(99.0).alias("blur"))
    return governance.assurance_status(images)


@query("SELECT 'MODEL' || p_partkey AS id, 'model' AS kind FROM part UNION ALL SELECT 'inf-' || o_orderkey, 'inference' FROM orders UNION ALL SELECT c_name, 'dataset' FROM customer")
def node_kinds(spark, d):
    ids = read(spark, d, "part").select(F.concat(F.lit("MODEL"), "p_partkey").alias("id")).union(read(spark, d, "orders").select(F.concat(F.lit("inf-"), "o_orderkey"))).union(read(spark, d, "customer").select("c_name"))
    return ids.select("id", C.node_kind("id").alias("kind"))


@query("SELECT p_partkey AS id, CASE WHEN length(sha256(p_name)) <= 13 THEN sha256(p_name) ELSE left(sha256(p_name), 8) || '…' || right(sha256(p_name), 4) END AS short, CASE WHEN p_retailprice / 10000 < 0.10 THEN 'stable' WHEN p_retailprice / 10000 < 0.25 THEN 'moderate' ELSE 'significant' END AS band FROM part")
def display_texts(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.shorten(F.sha2("p_name", 256)).alias("short"), C.psi_band(F.col("p_retailprice") / 10000).alias("band"))


@query("SELECT page_id, sha256(html) AS digest, page_id % 10 <> 0 AS accepted FROM pages")
def ingest_integrity(spark, d):
    claimed = F.when(F.col("page_id") % 10 == 0, F.sha2("url", 256)).otherwise(F.upper(F.sha2("html", 256)))
    uploads = read(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"), claimed.alias("claimed"))
    return datasets.checked_uploads(uploads).select("page_id", "digest", "accepted")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def registry_join(spark, d):
    return governance.registered(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").where("quality = 1"), "doc_id")


# --- shift -------------------------------------------------------------------

CUT = "2024-01-16"
SIDES = f"ev AS (SELECT CASE WHEN ts < TIMESTAMP '{CUT}' THEN 'baseline' ELSE 'evaluation' END AS side, value FROM events)"
BINS = f"""{SIDES}, l AS (SELECT min(value) AS lo, max(value) AS hi, count(*) FILTER (side = 'baseline') AS n, count(*) FILTER (side = 'evaluation') AS m FROM ev),
h AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) FILTER (side = 'baseline') AS baseline, count(*) FILTER (side = 'evaluation') AS evaluation FROM ev, l GROUP BY 1)"""
PSI = f"""{BINS}, q AS (SELECT greatest(baseline / (n + 1e-6), 1e-6) AS b, greatest(evaluation / (m + 1e-6), 1e-6) AS e FROM h, l), ps AS (SELECT greatest(0, sum((e - b) * ln(e / b))) AS psi FROM q)"""
AREA = f"""{SIDES}, pt AS (SELECT value, count(*) FILTER (side = 'baseline') AS b, count(*) FILTER (side = 'evaluation') AS e FROM ev GROUP BY value),
cdf AS (SELECT sum(b) OVER w / (SELECT sum(b) FROM pt) AS fb, sum(e) OVER w / (SELECT sum(e) FROM pt) AS fe, lead(value) OVER (ORDER BY value) - value AS gap FROM pt WINDOW w AS (ORDER BY value))"""


def event_sides(spark, d):
    return read(spark, d, "events").select(F.when(F.col("ts") < F.to_timestamp_ntz(F.lit(CUT)), "baseline").otherwise("evaluation").alias("side"), "value")


@query(f"WITH {BINS} SELECT bin, baseline, evaluation FROM h")
def shift_histogram(spark, d):
    return shift.histogram(event_sides(spark, d))


@query(f"WITH {PSI} SELECT round(psi, 6) AS psi FROM ps")
def psi(spark, d):
    return shift.psi(event_sides(spark, d)).select(F.round("psi", 6).alias("psi"))


@query(f"WITH {AREA} SELECT round(sum(abs(fb - fe) * gap), 6) AS wasserstein FROM cdf")
def wasserstein(spark, d):
    return shift.wasserstein(event_sides(spark, d)).select(F.round("wasserstein", 6).alias("wasserstein"))


DRIFT = """ex AS (SELECT vec_id % 2 AS s, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), em AS (SELECT s, pos, sum(x) AS t FROM ex GROUP BY s, pos),
ec AS (SELECT s, list(t ORDER BY pos) AS c FROM em GROUP BY s),
dr AS (SELECT least(1, greatest(0, 1 - list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c)) / sqrt(list_dot_product(b.c, b.c)))) AS drift FROM ec a, ec b WHERE a.s = 0 AND b.s = 1)"""


def vector_sides(spark, d):
    return vectors(spark, d).select(F.when(F.col("idx") % 2 == 0, "baseline").otherwise("evaluation").alias("side"), "v")


@query(f"WITH {DRIFT} SELECT round(drift, 6) AS drift FROM dr")
def centroid_drift(spark, d):
    return shift.centroid_drift(vector_sides(spark, d)).select(F.round("drift", 6).alias("drift"))


COMPOSITE = f"""WITH {PSI}, {AREA.removeprefix(SIDES + ", ")}, {DRIFT}, w AS (SELECT sum(abs(fb - fe) * gap) AS w FROM cdf), mean AS (SELECT avg(value) FILTER (side = 'baseline') AS mb, avg(value) FILTER (side = 'evaluation') AS me FROM ev),
r AS (SELECT psi AS bp, psi AS cp, w / greatest(1, mb) AS sw, w AS cd, drift AS ed, me - mb AS diff FROM ps, w, dr, mean),
k AS (SELECT *, least(1, greatest(0, 0.15 * least(1, bp / 0.40) + 0.15 * least(1, cp / 0.40) + 0.20 * least(1, sw / 0.50) + 0.20 * least(1, cd / 0.25) + 0.30 * least(1, ed / 0.25))) AS risk FROM r)"""


@query(f"""{COMPOSITE}, t AS (SELECT *, concat_ws('; ', CASE WHEN bp > 0.15 THEN 'brightness ' || CASE WHEN diff < 0 THEN 'drop' ELSE 'surge' END || printf(' (PSI %.2f)', bp) END, CASE WHEN cp > 0.15 THEN 'contrast ' || CASE WHEN diff < 0 THEN 'loss' ELSE 'surge' END || printf(' (PSI %.2f)', cp) END, CASE WHEN sw > 0.20 THEN 'sharpness: ' || CASE WHEN diff < 0 THEN 'blur' ELSE 'noise' END END, CASE WHEN cd > 0.15 THEN printf('color divergence (%.2f)', cd) END, CASE WHEN ed > 0.20 THEN printf('embedding drift (%.2f)', ed) END) AS s FROM k)
SELECT round(bp, 4) AS brightness_psi, round(cp, 4) AS contrast_psi, round(sw, 4) AS sharpness_wasserstein, round(cd, 4) AS color_divergence, round(ed, 4) AS embedding_drift, round(risk, 4) AS composite_risk, CASE WHEN risk >= 0.60 THEN 'QUARANTINE' WHEN risk >= 0.25 THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition, CASE WHEN s = '' THEN 'Stable: all measures within tolerance.' ELSE 'Observed: ' || s || '.' END AS characterization FROM t""")
def composite_risk(spark, d):
    v = F.col("value")
    features = event_sides(spark, d).select("side", *[v.alias(f) for f in shift.FEATURES])
    row = shift.diagnose(features, vector_sides(spark, d))
    measures = ("brightness_psi", "contrast_psi", "sharpness_wasserstein", "color_divergence", "embedding_drift", "composite_risk")
    return row.select(*[F.round(m, 4).alias(m) for m in measures], "disposition", "characterization")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_pop(value), 0), 6) AS sd FROM events GROUP BY 1, 2")
def event_window_shift(spark, d):
    from auditlake.streaming import windows

    g = windows.window_statistics(read(spark, d, "events"), "1 day")
    return g.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


# --- chains ------------------------------------------------------------------

REC = """r0 AS (SELECT event_id AS pos, event_id AS seq, sha256(event_type) AS i, repeat('a', 64) AS m, sha256(props) AS o, md5(CAST(event_id AS VARCHAR)) AS nonce, CAST(user_id AS VARCHAR) AS t FROM events)"""


def event_records(spark, d, *more):
    """Events as records, ten chains by user. A record's previous hash is left to be filled."""
    e = read(spark, d, "events")
    return e.select(F.lit("events").alias("chain_id"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("record_id"), F.sha2("event_type", 256).alias("input_sha256"), F.lit("a" * 64).alias("model_digest"), F.sha2("props", 256).alias("output_digest"), F.md5(F.col("event_id").cast("string")).alias("nonce"), F.col("user_id").cast("string").alias("timestamp"), *more)


def linked(spark, d):
    """Records whose stored hashes hold the digest of the record before (not its hash), so
    that SQL can make the same chain."""
    r = event_records(spark, d).withColumn("own", F.sha2(F.concat_ws(":", "pos", "nonce"), 256))
    prev = r.select((F.col("pos") + 1).alias("pos"), F.col("own").alias("p"))
    r = r.join(prev, "pos", "left").withColumns({"sequence_number": F.col("pos"), "previous_record_hash": F.coalesce("p", F.lit(C.GENESIS))})
    return r.withColumn("record_hash", F.col("own")).drop("p", "own")


@query(f"WITH {REC} SELECT pos, sha256(concat_ws(':', seq, repeat('0', 64), i, m, o, nonce, t)) AS record_hash FROM r0")
def record_hashes(spark, d):
    r = event_records(spark, d).withColumns({"sequence_number": F.col("pos"), "previous_record_hash": F.lit(C.GENESIS)})
    return r.select("pos", chain.recomputed(F.col("output_digest")).alias("record_hash"))


LINKED = "r AS (SELECT event_id AS pos, event_id AS seq, sha256(event_id || ':' || md5(CAST(event_id AS VARCHAR))) AS h, CASE WHEN event_id = (SELECT min(event_id) FROM events) THEN repeat('0', 64) ELSE sha256((event_id - 1) || ':' || md5(CAST(event_id - 1 AS VARCHAR))) END AS prev FROM events)"


def _verify_sql(attacked: str) -> str:
    return f"""WITH {LINKED}, a AS ({attacked}), w AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS eseq, lag(h, 1, repeat('0', 64)) OVER (ORDER BY pos) AS eprev FROM a)
SELECT pos, CAST(seq AS BIGINT) AS sequence_number, CAST(eseq AS BIGINT) AS expected_seq, seq <> eseq AS seq_anomaly, prev <> eprev AS broken_link FROM w"""


def _verified(spark, d, attack: str | None = None):
    r = linked(spark, d)
    r = redteam.attacked_chain(r, attack, 5) if attack else r
    return chain.verify_long(r, span=1000).select("pos", "sequence_number", "expected_seq", "seq_anomaly", "broken_link")


@query(_verify_sql("SELECT * FROM r"))
def chain_verify_clean(spark, d):
    return _verified(spark, d)


@query(_verify_sql("SELECT CASE pos WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE pos END AS pos, seq, h, prev FROM r"))
def chain_verify_swapped(spark, d):
    return _verified(spark, d, "swap")


@query(_verify_sql("SELECT * FROM r WHERE pos <> 5"))
def chain_verify_deleted(spark, d):
    return _verified(spark, d, "delete")


@query(_verify_sql("SELECT CASE WHEN pos > 5 THEN pos + 1 ELSE pos END AS pos, seq, h, prev FROM r UNION ALL SELECT pos + 1, seq, h, prev FROM r WHERE pos = 5"))
def chain_verify_replayed(spark, d):
    return _verified(spark, d, "replay")


FAULTS = f"""WITH {LINKED}, w AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS eseq, lag(h, 1, repeat('0', 64)) OVER (ORDER BY pos) AS eprev FROM r WHERE pos <> 5)"""


def deleted(spark, d):
    return chain.verify_long(redteam.attacked_chain(linked(spark, d), "delete", 5), span=1000).withColumn("tampered", F.lit(False))


@query(f"""{FAULTS} SELECT 'events' AS chain_id, count(*) AS total, count(*) FILTER (seq <> eseq) AS n_seq_anomaly, count(*) FILTER (prev <> eprev) AS n_broken_link, min(eseq) FILTER (seq <> eseq OR prev <> eprev) AS first_fault, NOT bool_or(seq <> eseq OR prev <> eprev) AS valid FROM w""")
def chain_summary(spark, d):
    return chain.summary(deleted(spark, d)).select("chain_id", "total", "n_seq_anomaly", "n_broken_link", "first_fault", "valid")


@query(f"""{FAULTS} SELECT 'events' AS chain_id, 'seq_anomaly' AS fault, eseq AS pos FROM w WHERE seq <> eseq UNION ALL SELECT 'events', 'broken_link', eseq FROM w WHERE prev <> eprev""")
def chain_fault_positions(spark, d):
    return chain.fault_positions(deleted(spark, d))


@query(f"{FAULTS} SELECT 'events' AS chain_id, eseq AS pos FROM w WHERE seq <> eseq OR prev <> eprev")
def chain_faulty_records(spark, d):
    return chain.faulty(deleted(spark, d))


USER_CHAINS = """n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, sha256(event_type) AS i, sha256(props) AS o, md5(CAST(event_id AS VARCHAR)) AS nonce FROM events),
c AS (SELECT user_id, event_id, k, repeat('0', 64) AS prev, sha256(concat_ws(':', k, repeat('0', 64), i, repeat('a', 64), o, nonce, user_id)) AS h FROM n WHERE k = 0
UNION ALL SELECT n.user_id, n.event_id, n.k, c.h, sha256(concat_ws(':', n.k, c.h, n.i, repeat('a', 64), n.o, n.nonce, n.user_id)) FROM c JOIN n ON n.user_id = c.user_id AND n.k = c.k + 1)"""


def user_chains(spark, d, **more):
    """A chain for each user, folded record by record; ``more``: columns of events, longs."""
    return chain.build(event_records(spark, d, *[c.alias(name) for name, c in more.items()]).withColumn("chain_id", F.col("timestamp")), more=tuple(more))


@query(f"WITH RECURSIVE {USER_CHAINS} SELECT CAST(user_id AS VARCHAR) AS chain_id, event_id AS pos, k AS sequence_number, prev AS previous_record_hash, h AS record_hash FROM c")
def chain_records(spark, d):
    return user_chains(spark, d).select("chain_id", "pos", "sequence_number", "previous_record_hash", "record_hash")


@query("""SELECT CAST(user_id AS VARCHAR) AS chain_id, count(*) AS total, 0::BIGINT AS n_faults, true AS valid FROM events GROUP BY 1""")
def chain_build_verify(spark, d):
    """Chains by user, folded and verified in full."""
    s = chain.summary(chain.verify(user_chains(spark, d)))
    return s.select("chain_id", "total", (F.col("n_tampered") + F.col("n_seq_anomaly") + F.col("n_broken_link")).alias("n_faults"), "valid")


def edited_chains(spark, d):
    """The users' chains with the outputs of records 3 and 7 edited, verified."""
    k, o = F.col("sequence_number"), F.col("output_digest")
    records = user_chains(spark, d).withColumn("output_digest", F.when(k.isin(3, 7), F.sha2(F.concat(o, F.lit("x")), 256)).otherwise(o))
    return chain.verify(records.withColumn("record_id", provenance.record_ids(F.concat("chain_id", F.lit("--------")), k)))


@query("""WITH n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
SELECT printf('FIND-PE-RECORD-TAMPER-%04d', k) AS finding_id, 'REC-' || left(user_id || '--------', 8) || '-' || lpad(CAST(k AS VARCHAR), 6, '0') AS asset, 'CRITICAL' AS severity, 'QUARANTINE' AS disposition FROM n WHERE k IN (3, 7)""")
def chain_edited_findings(spark, d):
    return chain.findings(edited_chains(spark, d)).select("finding_id", "asset", "severity", "disposition")


def _merkle_sql(leaves: str) -> str:
    """Levels of a tree of up to 2 ** 24 leaves (pos, h); a level of one row stays as it is."""
    levels = [f"l0 AS MATERIALIZED ({leaves})"]
    for k in range(24):
        levels.append(f"l{k + 1} AS MATERIALIZED (SELECT pos // 2 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(arg_min(h, pos) || arg_max(h, pos)) ELSE min(h) END AS h FROM (SELECT *, count(*) OVER () AS n FROM l{k}) GROUP BY pos // 2)")
    return ", ".join(levels)


@query(f"WITH {_merkle_sql('SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, sha256(CAST(event_id AS VARCHAR)) AS h FROM events')} SELECT h AS root FROM l24")
def merkle_root(spark, d):
    i = F.col("event_id")
    return chain.merkle_root(chain.leaves(read(spark, d, "events"), i, F.sha2(i.cast("string"), 256)))


PEAKS = " UNION ALL ".join(f"SELECT {k} AS level, CAST(pos AS BIGINT) AS idx, h FROM l{k} WHERE ((SELECT count(*) FROM l0) >> {k}) & 1 = 1 AND pos = ((SELECT count(*) FROM l0) >> {k}) - 1" for k in range(25))


@query(f"WITH {_merkle_sql('SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, sha256(CAST(event_id AS VARCHAR)) AS h FROM events')} {PEAKS}")
def merkle_peaks(spark, d):
    """Peaks over the first third of the events, to which the others are appended."""
    i = F.col("event_id")
    leaves = written(chain.leaves(read(spark, d, "events"), i, F.sha2(i.cast("string"), 256)), "leaves")
    cut = leaves.count() // 3
    first = written(merkle.forest(merkle.leaf_nodes(leaves.where(F.col("pos") < cut))), "peaks")
    return merkle.appended(first, leaves.where(F.col("pos") >= cut).withColumn("pos", F.col("pos") - cut))


KEY = crypto.KeyPair(bytes(range(32)))
CHECKPOINT = f"WITH {LINKED}, {_merkle_sql('SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, h FROM r')}"


@query(f"{CHECKPOINT} SELECT 'events' AS chain_id, (SELECT count(*) FROM r) AS sequence_length, (SELECT arg_max(h, pos) FROM r) AS head_record_hash, l24.h AS merkle_root FROM l24")
def chain_checkpoint(spark, d):
    c = provenance.checkpoint(linked(spark, d), "events", KEY, "t")
    return spark.createDataFrame([tuple(c[k] for k in ("chain_id", "sequence_length", "head_record_hash", "merkle_root"))], "chain_id string, sequence_length long, head_record_hash string, merkle_root string")


@query(f"""{CHECKPOINT}, t AS (SELECT * FROM r WHERE pos < (SELECT max(pos) FROM r)), x AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT arg_max(h, pos) FROM t) AS head)
SELECT 'FIND-PE-CHECKPOINT-LEN-MISMATCH' AS finding_id, 'checkpoint:events' AS asset FROM x WHERE n <> (SELECT count(*) FROM r) UNION ALL SELECT 'FIND-PE-MERKLE-ROOT-MISMATCH', 'checkpoint:events' FROM x WHERE n <> (SELECT count(*) FROM r)
UNION ALL SELECT 'FIND-PE-CHECKPOINT-HEAD-MISMATCH', 'checkpoint:events' FROM x WHERE head <> (SELECT arg_max(h, pos) FROM r)""")
def checkpoint_truncated(spark, d):
    """A signed checkpoint against the log without its last record."""
    r = linked(spark, d)
    c = provenance.checkpoint(r, "events", KEY, "t")
    last = r.agg(F.max("pos")).first()[0]
    return provenance.checkpoint_findings(r.where(F.col("pos") < last), c).select("finding_id", "asset")


#: Of each user's events the floor of a quarter, at least one, with the smallest hashes.
SPOT = """sr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY substr(md5('42:' || event_id), 1, 8), CAST(event_id AS VARCHAR)) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT event_id, user_id, CASE WHEN user_id % 7 = 0 THEN 'UNCHECKED' WHEN user_id % 5 = 0 THEN 'DIM' WHEN event_id % 3 = 0 THEN 'DIFF' ELSE 'OK' END AS verdict FROM sr WHERE k <= greatest(1, floor(n * 0.25)))"""


@query(f"""WITH {SPOT}, n AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), t AS (SELECT count(*) AS n FROM n WHERE k IN (3, 7)),
c AS (SELECT count(*) AS n_sampled, count(*) FILTER (verdict = 'OK') AS n_passed, count(*) FILTER (verdict IN ('DIM', 'DIFF')) AS n_discrepancies, count(*) FILTER (verdict = 'UNCHECKED') AS n_unchecked FROM s)
SELECT t.n AS n_tampered, 0::BIGINT AS n_seq_anomaly, 0::BIGINT AS n_broken_link, 0::BIGINT AS n_checkpoint, n_discrepancies AS n_spot_check, t.n + n_discrepancies AS n_findings, CASE WHEN t.n + n_discrepancies > 0 THEN 'QUARANTINE' ELSE 'ACCEPT' END AS disposition, n_sampled, n_passed, n_discrepancies, n_unchecked FROM c, t""")
def provenance_audit(spark, d):
    """Edited chains and spot checks, rolled up."""
    checked = written(_spot(spark, d), "spot-checks")
    return provenance.result(chain.findings(edited_chains(spark, d)).unionByName(provenance.spot_check_findings(checked)), checked=checked)


@query(f"""WITH {LINKED}, l AS (SELECT pos, h, prev FROM r WHERE pos <> 7), g AS (SELECT pos, CASE WHEN pos = 20 THEN sha256('x') ELSE h END AS h, CASE WHEN pos = 30 THEN sha256('y') ELSE prev END AS prev FROM l)
SELECT pos AS seq, prev AS previous_hash FROM (SELECT g.*, b.h AS e FROM g LEFT JOIN g b ON b.pos = g.pos - 1) WHERE prev IS DISTINCT FROM CASE WHEN pos = 0 THEN repeat('0', 64) ELSE e END""")
def ledger_breaks(spark, d):
    """A ledger without its entry 7, with another hash in entry 20 and another link in 30."""
    e, seq = linked(spark, d).where("pos <> 7"), F.col("pos")
    e = e.select(seq.alias("seq"), F.when(seq == 30, F.sha2(F.lit("y"), 256)).otherwise(F.col("previous_record_hash")).alias("previous_hash"), F.when(seq == 20, F.sha2(F.lit("x"), 256)).otherwise(F.col("record_hash")).alias("entry_hash"))
    return governance.ledger_breaks(e).select("seq", "previous_hash")


@query(f"WITH {DUP} SELECT printf('FIND-DS-EXACT-DUP-%04d', doc_id) AS finding_id, true AS linked, true AS committed FROM dup UNION ALL SELECT 'f' || s_suppkey, true, true FROM supplier")
def ledger_segments(spark, d):
    """Two batches of findings in a ledger, the first given twice: each entry with whether its link and its commit hold."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    dups = duplicates(spark, d).select("finding_id", F.lit("t").alias("timestamp"))
    more = read(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("finding_id"), F.lit("u").alias("timestamp")).repartition(4)
    for batch, findings in (("a", dups), ("a", dups), ("b", more)):
        ledger.append(findings, path, batch)
    fs, place = file_system(spark, path)
    fs.deleteOnExit(place)
    e = ledger.entries(spark, path)
    broken = governance.ledger_breaks(e).select("seq", F.lit(False).alias("linked"))
    faults = ledger.commit_breaks(spark, path).count() + ledger.edited(spark, path).count()
    name = F.get_json_object("finding", "$.finding_id").alias("finding_id")
    return e.join(broken, "seq", "left").select(name, F.coalesce("linked", F.lit(True)).alias("linked"), F.lit(not faults).alias("committed"))


@query("SELECT event_id, replace(props, ' ', '') AS canonical, sha256(replace(props, ' ', '')) AS digest FROM events")
def canonical_json(spark, d):
    c = crypto.canonical_column("props")
    return read(spark, d, "events").select("event_id", c.alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


@query("SELECT event_id, '{\"a\":{\"tiny\":' || CAST(value * 1e-9 AS VARCHAR) || ',\"vast\":' || CAST(value * 1e20 AS VARCHAR) || '},\"b\":[' || CAST(value AS VARCHAR) || ',null],\"kind\":\"' || event_type || ' \\u00e9\"}' AS canonical FROM events")
def canonical_measures(spark, d):
    """Nested objects out of order, doubles as the JVM prints them, and a letter beyond ASCII."""
    v = F.col("value")
    text = F.concat(F.lit('{"kind": "'), "event_type", F.lit(' \u00e9", "b": [ '), v.cast("string"), F.lit(' , null], "a": {"vast": '), (v * 1e20).cast("string"), F.lit(', "tiny": '), (v * 1e-9).cast("string"), F.lit("} }"))
    return read(spark, d, "events").select("event_id", crypto.canonical_column(text).alias("canonical"))


@query("SELECT page_id, 'REG-' || upper(left(sha256(html), 8)) AS registration_id, 'REC-' || left(sha256(url), 8) || '-' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS record_id, upper(hex(encode(url))) AS hexed FROM pages")
def identifiers(spark, d):
    return read(spark, d, "pages").select("page_id", provenance.registration_id(F.sha2("html", 256)).alias("registration_id"), provenance.record_ids(F.sha2("url", 256), F.col("page_id")).alias("record_id"), F.hex(F.encode("url", "UTF-8")).alias("hexed"))


@query(f"WITH {SPOT} SELECT CAST(user_id AS VARCHAR) AS chain_id, CAST(event_id AS VARCHAR) AS record_id, verdict FROM s")
def spot_check(spark, d):
    """A quarter of each user's log, exactly."""
    return _spot(spark, d).select("chain_id", "record_id", "verdict")


@query(f"WITH {SPOT} SELECT CAST(user_id AS VARCHAR) AS chain_id, count(*) AS n_sampled, count(*) FILTER (verdict = 'OK') AS n_passed, count(*) FILTER (verdict IN ('DIM', 'DIFF')) AS n_discrepancies, count(*) FILTER (verdict = 'UNCHECKED') AS n_unchecked FROM s GROUP BY user_id")
def spot_check_totals(spark, d):
    return chain.spot_summary(_spot(spark, d), "chain_id")


def _spot(spark, d):
    e = read(spark, d, "events")
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    records = e.select(u.cast("string").alias("chain_id"), i.cast("string").alias("record_id"), F.array(v, v).alias("logged"))
    inputs = e.where(u % 7 != 0).select(i.cast("string").alias("record_id"), F.when(u % 5 == 0, F.array(v)).when(i % 3 == 0, F.array(v, v + 0.01)).otherwise(F.array(v, v)).alias("replayed"))
    return chain.spot_check(records, inputs, chain="chain_id")


def _walk_sql(attacked: str) -> str:
    return f"WITH {LINKED}, a AS ({attacked}), w AS (SELECT *, lag(h) OVER (ORDER BY pos) AS p FROM a) SELECT 'events' AS chain_id, min(pos) FILTER (p IS NOT NULL AND p <> prev) AS first_break FROM w"


def _walk(r):
    return provenance.walk(r.select("chain_id", "pos", F.col("record_hash").alias("hash"), F.col("previous_record_hash").alias("prev_hash")), span=1000)


@query(_walk_sql("SELECT * FROM r"))
def link_walk(spark, d):
    return _walk(linked(spark, d))


@query(_walk_sql("SELECT * FROM r WHERE pos <> 1000"))
def link_walk_deleted(spark, d):
    return _walk(redteam.attacked_chain(linked(spark, d), "delete", 1000))


@query(_walk_sql("SELECT CASE pos WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE pos END AS pos, seq, h, prev FROM r"))
def link_walk_swapped(spark, d):
    return _walk(redteam.attacked_chain(linked(spark, d), "swap", 5))


@query(f"""WITH {SPOT} SELECT CASE WHEN verdict = 'DIM' THEN 'FIND-PE-SPOTCHECK-DIM-' ELSE 'FIND-PE-SPOTCHECK-DIFF-' END || event_id AS finding_id, CAST(CASE WHEN verdict = 'DIM' THEN 1.0 ELSE 0.98 END AS DOUBLE) AS confidence FROM s WHERE verdict IN ('DIM', 'DIFF')""")
def spot_check_findings(spark, d):
    return provenance.spot_check_findings(_spot(spark, d)).select("finding_id", "confidence")


# --- lineage -----------------------------------------------------------------

EDGES = """ed AS (SELECT 'nation-' || c_nationkey AS src, 'cust-' || c_custkey AS dst FROM customer UNION SELECT 'cust-' || o_custkey, 'order-' || o_orderkey FROM orders UNION SELECT 'order-' || l_orderkey, 'model-' || l_partkey FROM lineitem UNION SELECT 'supp-' || l_suppkey, 'model-' || l_partkey FROM lineitem)"""


def lineage_edges(spark, d):
    return edge_rows(spark, d).distinct()


def edge_rows(spark, d):
    """Edges as the tables tell them, some again and again: walks need them no other way."""
    n = lambda p, c: F.concat(F.lit(p + "-"), F.col(c).cast("string"))
    li = read(spark, d, "lineitem")
    e = read(spark, d, "customer").select(n("nation", "c_nationkey").alias("src"), n("cust", "c_custkey").alias("dst"))
    e = e.union(read(spark, d, "orders").select(n("cust", "o_custkey"), n("order", "o_orderkey")))
    return e.union(li.select(n("order", "l_orderkey"), n("model", "l_partkey"))).union(li.select(n("supp", "l_suppkey"), n("model", "l_partkey")))


def lineage_nodes(spark, d):
    return node_rows(lineage_edges(spark, d)).distinct()


def node_rows(edges):
    kind = F.when(F.col("id").startswith("order-"), "dataset").when(F.col("id").startswith("model-"), "model").when(F.col("id").startswith("cust-"), "batch").otherwise("contributor")
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).select("id", kind.alias("type"))


def _reach_sql(root: str, up: bool = False) -> str:
    a, b = ("dst", "src") if up else ("src", "dst")
    return f"WITH RECURSIVE {EDGES}, re AS (SELECT '{root}' AS id UNION SELECT ed.{b} FROM ed JOIN re ON ed.{a} = re.id)"


@query(_reach_sql("cust-7") + " SELECT id FROM re WHERE id <> 'cust-7'")
def downstream(spark, d):
    return lineage.reachable(edge_rows(spark, d), spark.createDataFrame([("cust-7",)], "id string")).select("id")


@query(_reach_sql("model-5", True) + " SELECT id FROM re WHERE id <> 'model-5'")
def upstream(spark, d):
    return lineage.reachable(edge_rows(spark, d), spark.createDataFrame([("model-5",)], "id string"), upstream=True).select("id")


def _impact_sql(root: str) -> str:
    return _reach_sql(root) + f""", c AS (SELECT count(*) FILTER (id LIKE 'order-%') AS n_datasets, count(*) FILTER (id LIKE 'model-%') AS n_models FROM re WHERE id <> '{root}')
SELECT '{root}' AS root, n_datasets, n_models, 0::BIGINT AS n_inferences, CASE WHEN n_models > 0 THEN 'HIGH' WHEN n_datasets > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c"""


def _impact(spark, d, root: str):
    edges = edge_rows(spark, d)
    return lineage.impact(node_rows(edges), edges, root)


@query(_impact_sql("cust-7"))
def blast_radius_customer(spark, d):
    return _impact(spark, d, "cust-7")


@query(_impact_sql("supp-3"))
def blast_radius_supplier(spark, d):
    return _impact(spark, d, "supp-3")


@query(f"""WITH RECURSIVE {EDGES}, re AS (SELECT src AS root, dst AS id FROM ed WHERE src IN ('cust-7', 'cust-8', 'model-5') UNION SELECT re.root, ed.dst FROM ed JOIN re ON ed.src = re.id)
SELECT root, CASE WHEN id LIKE 'order-%' THEN 'dataset' ELSE 'model' END AS type, id FROM re WHERE id LIKE 'order-%' OR id LIKE 'model-%'""")
def affected_ids(spark, d):
    """What lies downstream of three nodes and of one that is not there, by kind."""
    edges = edge_rows(spark, d)
    return lineage.affected(node_rows(edges), edges, spark.createDataFrame([("cust-7",), ("cust-8",), ("model-5",), ("nobody",)], "id string"))


@query(f"""WITH RECURSIVE {EDGES}, re AS (SELECT src AS root, dst AS id FROM ed WHERE src IN ('cust-7', 'supp-3', 'model-5') UNION SELECT re.root, ed.dst FROM ed JOIN re ON ed.src = re.id),
q AS (SELECT unnest(['cust-7', 'supp-3', 'model-5', 'nobody']) AS root, unnest(['batch', 'contributor', 'model', NULL]) AS root_type), c AS (SELECT q.root, root_type, count(*) FILTER (id LIKE 'order-%') AS n_datasets, count(*) FILTER (id LIKE 'model-%') AS n_models FROM q LEFT JOIN re ON re.root = q.root GROUP BY 1, 2)
SELECT root, root_type, n_datasets, n_models, n_datasets + n_models AS total, CASE WHEN root_type IS NULL THEN NULL WHEN n_models > 0 THEN 'HIGH' WHEN n_datasets > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
CASE WHEN root_type IS NULL THEN printf('Node ''%s'' not found in the lineage graph', root) ELSE printf('Downstream of %s ''%s'': %d data sets, %d models, 0 inference records', root_type, root, n_datasets, n_models) END AS description FROM c""")
def impact_trace(spark, d):
    edges = edge_rows(spark, d)
    roots = spark.createDataFrame([("cust-7",), ("supp-3",), ("model-5",), ("nobody",)], "id string")
    return lineage.trace(node_rows(edges), edges, roots).drop("n_inferences")


@query(f"""WITH RECURSIVE {EDGES}, re AS (SELECT src AS root, dst AS id FROM ed UNION SELECT re.root, ed.dst FROM ed JOIN re ON ed.src = re.id), n AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed)
SELECT n.id, count(re.id) AS n_reached FROM n LEFT JOIN re ON re.root = n.id GROUP BY n.id""")
def blast_radii(spark, d):
    """The radius of every node, exactly. Ids are numbers until the end, a kind in three bits beside the key; keys too large for that stay text."""
    kinds = ("nation", "cust", "order", "model", "supp")
    c, o, li = (read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    wide = lambda *cols: F.max(F.greatest(*[F.shiftright(F.col(x).cast("long"), 60) != F.shiftright(F.col(x).cast("long"), 63) for x in cols]))
    if any(t.agg(wide(*cols)).first()[0] for t, *cols in ((c, "c_nationkey", "c_custkey"), (o, "o_custkey", "o_orderkey"), (li, "l_orderkey", "l_partkey", "l_suppkey"))):
        return lineage.exact_radii(edge_rows(spark, d))
    n = lambda p, col: F.col(col).cast("long") * 8 + kinds.index(p)
    e = c.select(n("nation", "c_nationkey").alias("src"), n("cust", "c_custkey").alias("dst")).union(o.select(n("cust", "o_custkey"), n("order", "o_orderkey")))
    e = e.union(li.select(n("order", "l_orderkey"), n("model", "l_partkey"))).union(li.select(n("supp", "l_suppkey"), n("model", "l_partkey")))
    kind = F.get(F.array(*[F.lit(k + "-") for k in kinds]), F.pmod("id", F.lit(8)).cast("int"))
    return lineage.exact_radii(e).select(F.concat(kind, F.shiftright("id", 3).cast("string")).alias("id"), "n_reached")


@query("SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS depth FROM events QUALIFY depth > 0")
def log_descent(spark, d):
    """Each event follows from the one before: one path, as deep as the log is long."""
    e = F.col("event_id")
    at = written(chain.leaves(read(spark, d, "events"), e, e), "positions")
    edges = at.select("pos", F.col("h").alias("src")).join(at.select((F.col("pos") - 1).alias("pos"), F.col("h").alias("dst")), "pos").select("src", "dst")
    return lineage.reachable(written(edges, "path"), at.where("pos = 0").select(F.col("h").alias("id"))).withColumn("depth", F.col("depth").cast("long"))


@query(f"WITH {EDGES} SELECT DISTINCT '    ' || src || ' --> ' || dst AS line FROM ed")
def lineage_mermaid(spark, d):
    return lineage.mermaid_lines(lineage_edges(spark, d))


@query(f"WITH {EDGES} SELECT DISTINCT src, dst FROM ed")
def mermaid_round_trip(spark, d):
    return lineage.parse_mermaid(lineage.mermaid_lines(lineage_edges(spark, d)))


@query("SELECT 'f' || s_suppkey AS finding_id, 'S' || n_nationkey AS id FROM supplier JOIN nation ON starts_with('S' || s_suppkey, 'S' || n_nationkey) OR starts_with('S' || n_nationkey, 'S' || s_suppkey)")
def findings_at_nodes(spark, d):
    f = read(spark, d, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("finding_id"), F.concat(F.lit("S"), "s_suppkey").alias("asset"))
    return lineage.findings_at(f, read(spark, d, "nation").select(F.concat(F.lit("S"), "n_nationkey").alias("id")))


@query("SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey + 1")
def columns_linked(spark, d):
    return lineage.columns_linked(read(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("column")))


@query(f"WITH {EDGES}, n AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed), t AS (SELECT src, list_sort(list(DISTINCT dst)) AS l FROM ed GROUP BY src) SELECT n.id, md5(coalesce(array_to_string(t.l, ','), '')) AS targets FROM n LEFT JOIN t ON t.src = n.id")
def lineage_documents(spark, d):
    doc = lineage.as_document(lineage_nodes(spark, d), lineage_edges(spark, d))
    targets = F.from_json("document", "targets array<string>")["targets"]
    return doc.select("id", F.md5(F.array_join(targets, ",")).alias("targets"))


# --- models ------------------------------------------------------------------

PARAMS = "p AS (SELECT label AS layer, CASE WHEN vec_id % 97 = 0 THEN 9.0 ELSE unnest(CAST(embedding AS DOUBLE[])) END AS w FROM embeddings)"


def parameters(spark, d):
    return vectors(spark, d).select(F.col("label").alias("layer"), "idx", F.posexplode("v").alias("pos", "w")).select("layer", (F.col("idx") * 100000 + F.col("pos")).alias("idx"), F.when(F.col("idx") % 97 == 0, 9.0).otherwise(F.col("w").cast("double")).alias("w"))


@query(f"""WITH {PARAMS}, s AS (SELECT count(*) AS n, avg(w) AS mean, stddev_pop(w) AS sd, min(w) AS lo, max(w) AS hi, avg(CASE WHEN w = 0 THEN 1.0 ELSE 0.0 END) AS sparsity FROM p), b AS (SELECT *, abs(mean) + 4 * sd AS bound FROM s), o AS (SELECT count(*) AS outliers FROM p, b WHERE abs(w) > bound)
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(round(sparsity, 6) AS DOUBLE) AS sparsity, outliers, outliers / n > 0.001 AS flagged FROM b, o""")
def param_stats(spark, d):
    return models.parameter_statistics(parameters(spark, d)).select("n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "lo", "hi", "sparsity")], "outliers", "flagged")


@query(f"WITH {PARAMS}, b AS (SELECT abs(avg(w)) + 4 * stddev_pop(w) AS bound FROM p) SELECT CAST(layer AS BIGINT) AS layer, count(*) AS n_outliers FROM p, b WHERE abs(w) > bound GROUP BY layer")
def weight_outliers(spark, d):
    return models.outlier_weights(parameters(spark, d))


@query("SELECT CAST(label AS BIGINT) AS layer, 64 * count(*) AS n_bad FROM embeddings WHERE vec_id % 89 = 0 GROUP BY label")
def nan_layers(spark, d):
    bad = F.when((F.col("idx") / 100000).cast("long") % 89 == 0, F.lit(float("nan"))).otherwise(F.col("w"))
    return models.bad_layers(parameters(spark, d).withColumn("w", bad))


@query("SELECT sha256(string_agg(n || ':' || s || ':float32', ';' ORDER BY n)) AS graph_hash FROM (SELECT 'layer' || label AS n, '[' || count(*) || ', 64]' AS s FROM embeddings GROUP BY label)")
def model_graph_hash(spark, d):
    layers = vectors(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("layer"), "label").alias("name"), F.format_string("[%d, 64]", "n").alias("shape"), F.lit("float32").alias("dtype"))
    return models.graph_hash(layers)


@query()
def weight_digests(spark, d):
    return models.weight_digest(parameters(spark, d))


OUT = "o AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN vec_id % 10 = 0 AND i = 1 THEN x + 1 ELSE x END) AS b FROM embeddings)"


@query(f"""WITH {OUT}, f AS (SELECT list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same FROM o), x AS (SELECT unnest(a) - unnest(b) AS d FROM o), g AS (SELECT (SELECT avg(CAST(same AS INT)) FROM f) AS agreement, avg(d * d) AS mse, max(abs(d)) AS max_diff FROM x)
SELECT round(agreement, 6) AS agreement, round(mse, 6) AS mse, round(max_diff, 6) AS max_diff, agreement < 0.95 OR mse > 0.05 AS substituted FROM g""")
def output_agreement(spark, d):
    v = F.transform("v", lambda x: x.cast("double"))
    current = F.transform(v, lambda x, i: F.when((F.col("idx") % 10 == 0) & (i == 0), x + 1).otherwise(x))
    return models.output_agreement(vectors(spark, d).select(F.col("idx").alias("probe_id"), v.alias("registered"), current.alias("current"))).select(*[F.round(c, 6).alias(c) for c in ("agreement", "mse", "max_diff")], "substituted")


@query("""WITH t AS (SELECT label AS b, CASE WHEN vec_id % 2 = 0 THEN 3 WHEN vec_id % 11 = 0 THEN NULL ELSE label END AS p FROM embeddings), f AS (SELECT p, count(*) AS c FROM t WHERE p <> b GROUP BY p), s AS (SELECT CAST(sum(c) AS BIGINT) AS flips, (SELECT count(*) FROM t) AS tests, max(c) AS top, arg_max(p, c) AS cls FROM f)
SELECT flips, tests, round(flips / tests, 6) AS flip_rate, CAST(cls AS BIGINT) AS collapse_class, round(top / flips, 6) AS collapse_ratio, flips >= 8 AND flips / tests >= 0.40 AND top / flips >= 0.75 AS sensitive FROM s""")
def trigger_collapse(spark, d):
    predicted = F.when(F.col("idx") % 2 == 0, 3).when(F.col("idx") % 11 == 0, F.lit(None)).otherwise(F.col("label"))
    g = models.trigger_collapse(vectors(spark, d).select(F.col("label").alias("baseline"), predicted.alias("predicted")))
    return g.select("flips", "tests", F.round("flip_rate", 6).alias("flip_rate"), "collapse_class", F.round("collapse_ratio", 6).alias("collapse_ratio"), "sensitive")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS cls, list_max(v) AS m FROM e), s AS (SELECT vec_id, cls, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS p, x FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, cls) AS rank FROM s QUALIFY rank <= 5) SELECT vec_id AS id, rank, CAST(cls AS BIGINT) AS cls, round(p, 6) AS probability FROM k""")
def softmax_top5(spark, d):
    t = models.top_classes(vectors(spark, d).select(F.col("idx").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")))
    return t.withColumn("probability", F.round("probability", 6))


@query(f"WITH {PARAMS} SELECT CAST(layer AS BIGINT) AS layer, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS sd, CAST(round(avg(CASE WHEN w = 0 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS zeros FROM p GROUP BY layer")
def activation_stats(spark, d):
    a = model_audit.activation_statistics(parameters(spark, d))
    return a.select("layer", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "zeros")])


@query(f"WITH {OUT}, f AS (SELECT avg(CAST(list_position(a, list_max(a)) = list_position(b, list_max(b)) AS INT)) AS agreement FROM o) SELECT 'FIND-MA-SUBSTITUTION-net' AS finding_id, 'CRITICAL' AS severity, 0.96::DOUBLE AS confidence FROM f WHERE agreement < 0.95")
def fingerprint_findings(spark, d):
    v = F.transform("v", lambda x: x.cast("double"))
    o = vectors(spark, d).select(F.col("idx").alias("probe_id"), v.alias("output"))
    current = o.select("probe_id", F.transform("output", lambda x, i: F.when((F.col("probe_id") % 10 == 0) & (i == 0), x + 1).otherwise(x)).alias("output"))
    return model_audit.fingerprint_findings(o, current, "net").select("finding_id", "severity", "confidence")


# --- red team ----------------------------------------------------------------

ATTACKS = "tr AS (SELECT l.doc_id, d.lang AS attack, l.toxic = 1 AS is_attack, l.quality = 0 AS hit FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _truth(spark, d):
    t = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    truth = t.select(F.col("lang").alias("attack"), F.col("doc_id").alias("sample_id"), (F.col("toxic") == 1).alias("is_attack"))
    return truth, t.where("quality = 0").select(F.col("lang").alias("attack"), F.col("doc_id").alias("sample_id"))


SCORES = f"""WITH {ATTACKS}, c AS (SELECT attack, count(*) FILTER (hit AND is_attack) AS tp, count(*) FILTER (hit AND NOT is_attack) AS fp, count(*) FILTER (NOT hit AND is_attack) AS fn FROM tr GROUP BY attack),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)"""


@query(f"{SCORES} SELECT attack, tp, fp, fn, CAST(round(p, 6) AS DOUBLE) AS precision, CAST(round(r, 6) AS DOUBLE) AS recall, CAST(round(f1, 6) AS DOUBLE) AS f1 FROM f")
def redteam_metrics(spark, d):
    return redteam.metrics(*_truth(spark, d)).select("attack", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{SCORES} SELECT CAST(round(avg(p), 6) AS DOUBLE) AS macro_precision, CAST(round(avg(r), 6) AS DOUBLE) AS macro_recall, CAST(round(avg(f1), 6) AS DOUBLE) AS macro_f1 FROM f")
def redteam_macro(spark, d):
    m = redteam.macro(redteam.metrics(*_truth(spark, d)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'found' WHEN quality = 0 THEN 'false_alarm' ELSE 'missed' END AS outcome, doc_id AS id FROM labels WHERE toxic = 1 OR quality = 0")
def redteam_sets(spark, d):
    l = read(spark, d, "labels")
    return redteam.outcome_sets(l.where("toxic = 1").select(F.col("doc_id").alias("id")), l.where("quality = 0").select(F.col("doc_id").alias("id")))


@query("SELECT bool_or(regexp_matches(event_type || ' ' || props, '(?i)click')) AS evaluated FROM events")
def attack_evaluated(spark, d):
    return redteam.evaluated(read(spark, d, "events").select(F.col("event_type").alias("name"), F.col("props").alias("family")), "click")


@query(f"""WITH {VEC.replace("SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", "SELECT vec_id, label, CASE WHEN vec_id % 25 = 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings")}
SELECT count(*) FILTER (vec_id % 25 = 0 AND vec_id IN (SELECT vec_id FROM bad)) AS tp, count(*) FILTER (vec_id % 25 <> 0 AND vec_id IN (SELECT vec_id FROM bad)) AS fp, count(*) FILTER (vec_id % 25 = 0 AND vec_id NOT IN (SELECT vec_id FROM bad)) AS fn FROM e""")
def redteam_ood_attack(spark, d):
    p = redteam.poisoned(vectors(spark, d), "ood", 25)
    truth = p.select(F.lit("ood").alias("attack"), F.col("idx").alias("sample_id"), "is_attack")
    flags = samples.outlier_scores(p.select("idx", "v")).where("is_ood").select(F.lit("ood").alias("attack"), F.col("idx").alias("sample_id"))
    return redteam.metrics(truth, flags).select("tp", "fp", "fn")


def patched_vectors(spark, d):
    """Vectors whose first and last quarter stand in for two corners."""
    q = lambda k, at: F.struct(F.lit(k).alias("place"), F.concat(F.lit(f"c{k}_"), F.md5(F.array_join(F.transform(at, lambda x: x.cast("string")), ","))).alias("key"))
    n = F.floor(F.size("v") / 4).cast("int")
    return vectors(spark, d).withColumn("patches", F.array(q(0, F.slice("v", F.lit(1), n)), q(1, F.slice("v", -n, n))))


@query()
def redteam_benchmark(spark, d):
    """All scenarios; chains are folded, which SQL can't express."""
    return redteam.benchmark(patched_vectors(spark, d), written(chain.build(event_records(spark, d)), "chain"))


@query("SELECT unnest(['label_flip', 'ood_insertion', 'duplicate_flooding', 'trigger_poisoning', 'chain_output', 'chain_model', 'chain_swap']) AS attack, true AS passed")
def redteam_gate(spark, d):
    """Whether each detector passes its gate on attacked vectors that have classes, made of the table's."""
    v = written(redteam.clustered(patched_vectors(spark, d)), "clustered")
    return redteam.gate(redteam.benchmark(v, written(chain.build(event_records(spark, d)), "chain")))


@query()
def assets_benchmark(spark, d):
    """All scenarios and those on models, streams and summaries. The two sides are the events of even and odd ids."""
    e, v = read(spark, d, "events"), F.col("value")
    features = e.select(F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("evaluation").alias("side"), *[v.alias(f) for f in shift.FEATURES])
    signed = governance.sign({"overall_disposition": "QUARANTINE", "confidence": 0.9}, KEY)
    records = written(chain.build(event_records(spark, d)), "chain")
    return redteam.assets_benchmark(patched_vectors(spark, d), records, features, vector_sides(spark, d), signed)


@query("""WITH m AS (SELECT max(vec_id) + 1 AS n, (SELECT label FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) AS l FROM embeddings)
SELECT vec_id AS idx, CAST(label AS BIGINT) AS label, 'clean' AS kind, false AS is_attack, 2::INT AS n_patches FROM embeddings UNION ALL SELECT n + k, CASE WHEN kind = 'look_alike' THEN l + 1 ELSE l END, kind, true, CASE WHEN kind = 'patch' THEN 1 ELSE 2 END
FROM m, (VALUES (0, 'copy'), (1, 'look_alike'), (2, 'noise'), (3, 'patch'), (4, 'patch'), (5, 'patch')) x(k, kind)""")
def demo_variants(spark, d):
    v = patched_vectors(spark, d)
    return redteam.demo_variants(v, v.agg(F.min("idx")).first()[0]).select("idx", "label", "kind", "is_attack", F.size("patches").alias("n_patches"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n, count(*) FILTER (value > 400) AS flagged, round(count(*) FILTER (value > 400) / count(*), 6) AS rate FROM s GROUP BY user_id, k""")
def session_risk(spark, d):
    from auditlake.streaming import windows

    return windows.session_risk(read(spark, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "flagged", F.round("rate", 6).alias("rate"))


# --- streams -----------------------------------------------------------------


def streamed(spark, rows: DataFrame, work, arrival: str | None = None, parts: int = 4) -> DataFrame:
    """What a stream over these rows, read from files of the shared folder until all are taken, has written. ``arrival``: a column of
    0 to parts - 1; rows come in so many batches in order of it, and are made once. What the stream needed goes at once, its results when the session ends."""
    source = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    own = [c for c in rows.columns if c != arrival]
    files = max(4, spark.sparkContext.defaultParallelism)
    if arrival:
        rows.write.partitionBy(arrival).parquet(f"{source}/parts")
        parted = spark.read.schema(rows.schema).parquet(f"{source}/parts")
    for k in range(parts if arrival else 1):
        # as many files in each part as a batch takes
        (parted.where(F.col(arrival) == k).select(*own).repartition(files, *own) if arrival else rows).write.mode("append").parquet(f"{source}/in")
    read_ = spark.readStream.schema(rows.select(*own).schema)
    out = work((read_.option("maxFilesPerTrigger", files) if arrival else read_).parquet(f"{source}/in"))
    run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{source}/checkpoint").trigger(availableNow=True).start(f"{source}/out")
    run.awaitTermination()
    fs, place = file_system(spark, source)
    for folder in ("parts", "in", "checkpoint"):
        fs.delete(file_system(spark, f"{source}/{folder}")[1], True)
    fs.deleteOnExit(place)
    return spark.read.schema(out.schema).parquet(f"{source}/out")


#: A stream's watermark two days behind the last event, in whole milliseconds.
OVER = "(SELECT epoch_ms(max(ts)) - 2 * 86400000 AS over FROM events)"


@query(f"""WITH n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS e FROM n WHERE k <> 5)
SELECT CAST(user_id AS VARCHAR) AS chain_id, CAST(event_id AS VARCHAR) AS record_id, CAST(k AS BIGINT) AS sequence_number, CAST(e AS BIGINT) AS expected_seq, k <> e AS seq_anomaly, k = 6 AS broken_link, k = 7 AS tampered FROM a, {OVER} WHERE epoch_us(ts) <= over * 1000""")
def stream_chain_in_order(spark, d):
    """The users' chains without their sixth records and with an edited eighth, in four parts; every other record comes a part late."""
    from auditlake.streaming import windows

    rows = user_chains(spark, d, us=F.unix_micros(F.col("ts").cast("timestamp"))).where("sequence_number <> 5").withColumns({"ts": F.timestamp_micros("us"), "record_id": F.col("pos").cast("string")}).drop("us")
    rows = rows.withColumn("output_digest", F.when(F.col("sequence_number") == 7, F.sha2("output_digest", 256)).otherwise(F.col("output_digest")))
    # within the last two days of a part, odd records are late
    days = F.datediff("ts", F.lit("2024-01-01"))
    rows = rows.withColumn("part", F.least(F.lit(3), F.floor(days / 8) + F.when((F.col("pos") % 2 == 1) & (days % 8 == 7), 1).otherwise(0)).cast("int"))
    return streamed(spark, rows, lambda e: windows.verify_chain_in_order(e, "2 days"), "part")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 AS e FROM n WHERE k <> 5)
SELECT CAST(user_id AS VARCHAR) AS chain_id, CAST(k AS BIGINT) AS sequence_number, CAST(e AS BIGINT) AS expected_seq, k <> e AS seq_anomaly, k = 6 AS broken_link, false AS tampered FROM a""")
def stream_chain_verify(spark, d):
    """The users' chains without their sixth records, as a stream."""
    from auditlake.streaming import windows

    rows = user_chains(spark, d).where("sequence_number <> 5").withColumn("record_id", F.col("pos").cast("string"))
    return streamed(spark, rows, windows.verify_chain).drop("record_id")


@query("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def stream_first_seen(spark, d):
    """The first event of each type and user: one watermark is longer than the log."""
    from auditlake.streaming import windows

    rows = read(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts")).withColumn("key", F.concat_ws("|", "event_type", "user_id"))
    rows = rows.withColumn("part", (F.pmod(F.xxhash64("ts", "key"), F.lit(2))).cast("int"))
    return streamed(spark, rows, lambda e: windows.first_seen(e, "key", "400 days"), "part", 2).select("event_type", "user_id")


@query(f"""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE ts < TIMESTAMP '{CUT}' AND value IS NOT NULL GROUP BY 1),
v AS (SELECT e.event_type, ts, date_trunc('day', ts) AS start, greatest(0, least(CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 20) WHEN value > hi THEN 19 ELSE 0 END, 19)) AS bin FROM events e JOIN b ON b.event_type = e.event_type WHERE value IS NOT NULL),
k AS (SELECT unnest(range(0, 20)) AS bin), bh AS (SELECT b.event_type, k.bin, count(v.bin) AS c FROM b CROSS JOIN k LEFT JOIN v ON v.event_type = b.event_type AND v.bin = k.bin AND v.ts < TIMESTAMP '{CUT}' GROUP BY 1, 2),
w AS (SELECT DISTINCT event_type, start FROM v WHERE ts >= TIMESTAMP '{CUT}'), wh AS (SELECT w.event_type, w.start, k.bin, count(v.bin) AS c FROM w CROSS JOIN k LEFT JOIN v ON v.event_type = w.event_type AND v.start = w.start AND v.ts >= TIMESTAMP '{CUT}' AND v.bin = k.bin GROUP BY 1, 2, 3),
s AS (SELECT wh.event_type, wh.start, wh.c, greatest(wh.c / (sum(wh.c) OVER (PARTITION BY wh.event_type, wh.start) + 1e-6), 1e-6) AS e, greatest(bh.c / (sum(bh.c) OVER (PARTITION BY wh.event_type, wh.start) + 1e-6), 1e-6) AS b FROM wh JOIN bh ON bh.event_type = wh.event_type AND bh.bin = wh.bin)
SELECT event_type, start, CAST(sum(c) AS BIGINT) AS n, round(greatest(0, sum((e - b) * ln(e / b))), 6) AS psi FROM s, {OVER} WHERE epoch_ms(start + INTERVAL 1 DAY) <= over GROUP BY event_type, start""")
def stream_shift(spark, d):
    """Each type's values by day behind the cut, in two batches, against the frozen histogram of those before it."""
    from auditlake.streaming import windows

    e = read(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("ts") < F.to_timestamp_ntz(F.lit(CUT))).alias("before"))
    base = written(windows.frozen(e.where("before"), by="event_type"), "baseline")
    # two batches of days; the watermark is two days behind
    rows = e.where("not before").drop("before").withColumn("part", (F.datediff("ts", F.lit(CUT[:10])) >= 7).cast("int"))
    out = streamed(spark, rows, lambda s: windows.windowed_shift(s, base, "1 day", "2 days", "event_type"), "part", 2)
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("psi", 6).alias("psi"))
