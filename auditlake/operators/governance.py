"""Roll-ups of findings, the signed summary, and the hash-chained ledger."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions import crypto
from auditlake.functions.schemas import SEVERITIES

DEFAULT_CONFIDENCE = 0.85
NO_ACTION = "No action needed."


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: how many findings of each severity, and in all."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))


def overall(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The gravest disposition, of all findings or by the given columns."""
    return findings.groupBy(*(by or [])).agg(C.worst("disposition").alias("disposition"))


def mean_confidence(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.round(F.avg("confidence"), 2), F.lit(DEFAULT_CONFIDENCE)).alias("confidence"))


def clean_samples(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """Samples without a finding. Assets that are no samples (contributors) don't count."""
    return samples.join(findings.select(F.col("asset").alias("sample_id")).distinct(), "sample_id", "left_anti").agg(F.count(F.lit(1)).alias("clean_samples"))


def _order(findings: DataFrame) -> list[Column]:
    """The order among findings of one severity: the modules' own, then by id."""
    return [*([C.module_order("module")] if "module" in findings.columns else []), F.col("finding_id")]


def top(findings: DataFrame, k: int = 5, order: list[Column] | None = None) -> DataFrame:
    """The k gravest, in the order of ``order`` among equals, by default that of modules, then ids."""
    return findings.orderBy(C.severity_order("severity"), *(order or _order(findings))).limit(k)


def with_id(findings: DataFrame, text: str) -> DataFrame:
    """Findings whose id holds a text."""
    return findings.where(F.contains("finding_id", F.lit(text)))


def registered(ids: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows whose key the registry has."""
    return ids.join(registry.select(key), key, "left_semi")


def blur_reviews(images: DataFrame, least: float = 25.0) -> DataFrame:
    """(id, blur, disposition) of (id, blur: the Laplacian's variance): under ``least`` an image is reviewed."""
    return images.select("id", "blur", F.when(F.col("blur") < least, "REVIEW").otherwise("ACCEPT").alias("disposition"))


def remediations(findings: DataFrame, k: int = 5, order: list[Column] | None = None) -> DataFrame:
    """(position, action): the distinct actions of the top findings in their order."""
    t = top(findings, k, order)
    # k rows: one window over all of them is bounded
    w = Window.partitionBy(F.lit(0)).orderBy(C.severity_order("severity"), *(order or _order(findings)))
    first = t.withColumn("r", F.row_number().over(w)).groupBy("recommended_action").agg(F.min("r").alias("r"))
    return first.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("r")).cast("long").alias("position"), F.col("recommended_action").alias("action"))


def by_batch(findings: DataFrame) -> DataFrame:
    """Findings by the last part of the asset's path, most first, with the gravest severity."""
    batch = F.element_at(F.split("asset", "/"), -1)
    g = findings.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min(C.severity_order("severity")).cast("long").alias("gravest"))
    return g.orderBy(F.desc("n"), "batch")


def headline(findings: DataFrame) -> DataFrame:
    """Counts for an overview: assets, critical findings, open reviews, models, datasets."""
    assets = lambda p: F.count_distinct(F.when(F.col("asset").rlike(p), F.col("asset")))
    return findings.agg(F.count_distinct("asset").alias("assets"), F.count_if(F.col("severity") == "CRITICAL").alias("criticals"), F.count_if(F.col("disposition") == "REVIEW").alias("open_reviews"), assets("(?i)model").alias("models"), assets("(?i)data|batch").alias("datasets"))


def stage_states(findings: DataFrame) -> DataFrame:
    """State of each module: critical, flagged or clear."""
    state = F.when(F.bool_or(F.col("severity") == "CRITICAL"), "critical").when(F.bool_or(F.col("severity").isin("HIGH", "MEDIUM")), "flagged").otherwise("clear")
    return findings.groupBy("module").agg(state.alias("state"))


def search(history: DataFrame, text: str, disposition: str | None = None) -> DataFrame:
    """Rows of (id, label, assets, disposition) that hold the text in any case."""
    found = history.where(F.contains(F.lower(F.concat_ws(" ", "id", "label", "assets")), F.lit(text.lower())))
    return found if disposition is None else found.where(F.col("disposition") == disposition)


def over_thresholds(evidence: DataFrame) -> DataFrame:
    """(id, key, value, threshold) of (id, numbers: map): values over their `<key>_threshold`."""
    pairs = evidence.select("id", F.explode("numbers").alias("key", "value"), "numbers").where(~F.col("key").endswith("_threshold"))
    limit = F.try_element_at("numbers", F.concat("key", F.lit("_threshold")))
    return pairs.select("id", "key", "value", limit.alias("threshold")).where("value > threshold")


def evidence_pairs(findings: DataFrame) -> DataFrame:
    """(finding_id, side, key, value) of evidence that says what was expected and what was seen."""
    m = F.from_json("evidence", "map<string,string>")
    e = findings.select("finding_id", F.explode(m).alias("key", "value"))
    side = F.when(F.col("key").rlike("(?i)expected|baseline|registered|original"), "expected").when(F.col("key").rlike("(?i)actual|observed|current|recomputed|stored"), "observed")
    return e.select("finding_id", side.alias("side"), "key", "value").where("side is not null")


def assurance_status(images: DataFrame) -> DataFrame:
    """Decision ladder of (id, corrupt, trigger, expected, top1, top5, confidence, blur): the first rule that holds."""
    match1, match5 = C.labels_match(F.col("expected"), F.col("top1")), F.exists("top5", lambda n: C.labels_match(F.col("expected"), n))
    status = (
        F.when(F.col("corrupt"), "CORRUPT").when(F.col("trigger"), "TRIGGER SUSPECTED").when(F.col("expected").isNull(), "GROUND TRUTH UNAVAILABLE")
        .when(~match5 & (F.col("confidence") >= 0.5), "LABEL INCONSISTENCY").when(~match5, "OUT OF DISTRIBUTION").when(~match1, "REVIEW REQUIRED").when(F.col("blur") < 25, "REVIEW REQUIRED").otherwise("CLEAN")
    )
    return images.select("id", status.alias("status"))


def summary_document(findings: DataFrame, results: DataFrame, assets: dict[str, Any], summary_id: str, timestamp: str) -> dict[str, Any]:
    """The summary before it is signed, from small aggregates of the findings."""
    return {
        "summary_id": summary_id,
        "timestamp": timestamp,
        "audited_assets": assets,
        "severity_counts": severity_counts(findings).first().asDict(),
        "overall_disposition": overall(findings).first()[0],
        "confidence": mean_confidence(results).first()[0],
        "top_findings": [r.asDict() for r in top(findings).collect()],
        "remediations": [r["action"] for r in remediations(findings).orderBy("position").collect()] or [NO_ACTION],
    }


def sign(document: dict[str, Any], key: crypto.KeyPair) -> dict[str, Any]:
    """The document with the digest of its canonical form, the public key and a signature."""
    digest = crypto.canonical_hash(document)
    return document | {"content_hash": digest, "public_key": key.public.hex(), "signature": key.sign(digest.encode()).hex()}


def verify_summary(signed: dict[str, Any], trusted: set[str] | None = None) -> tuple[bool, str]:
    """Recomputes the digest, then checks the signature and, if given, that the key is trusted."""
    body = {k: v for k, v in signed.items() if k not in ("content_hash", "public_key", "signature")}
    if crypto.canonical_hash(body) != signed.get("content_hash"):
        return False, "content does not match its digest"
    if not crypto.verify_hex(signed.get("public_key", ""), signed["content_hash"].encode(), signed.get("signature", "")):
        return False, "signature is not valid"
    if trusted is not None and signed["public_key"] not in trusted:
        return False, "key is not trusted"
    return True, "valid"


def ledger_entries(findings: list[dict[str, Any]], previous: str = C.GENESIS, start: int = 0) -> list[dict[str, Any]]:
    """Entries of an append-only ledger; each holds the hash of the one before."""
    out = []
    for k, f in enumerate(findings):
        entry = {"seq": start + k, "previous_hash": previous, "timestamp": f.get("timestamp", ""), "finding": f}
        previous = crypto.sha256(json.dumps(entry, sort_keys=True))
        out.append(entry | {"entry_hash": previous})
    return out


def ledger_head(ledger: DataFrame) -> DataFrame:
    """(last_hash, n) of a ledger, to go on with."""
    return ledger.agg(F.max_by("entry_hash", "seq").alias("last_hash"), F.count(F.lit(1)).alias("n"))


def ledger_breaks(ledger: DataFrame) -> DataFrame:
    """Entries (seq, previous_hash, entry_hash) whose predecessor's hash they don't hold. A
    join on seq + 1 rather than one window over all."""
    before = ledger.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("expected"))
    d = ledger.join(before, "seq", "left").withColumn("expected", F.when(F.col("seq") == 0, C.GENESIS).otherwise(F.col("expected")))
    return d.where(~F.col("previous_hash").eqNullSafe(F.col("expected"))).select("seq", "previous_hash", "expected")
