"""The full audit: findings of all branches that have input, rolled up and signed."""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions import crypto
from auditlake.functions.schemas import FINDING
from auditlake.operators import chain, governance, lineage, model_audit, models, provenance, samples, shift
from auditlake.sources.config import Config

NAMES = [f.name for f in FINDING]


@dataclass
class Audit:
    findings: DataFrame
    summary: dict[str, Any]
    contributors: DataFrame | None = None
    batches: DataFrame | None = None
    impact: DataFrame | None = None
    #: How many records were spot-checked, passed, differed, and had no input.
    spot_checks: dict[str, int] | None = None


def sample_findings(rows: DataFrame, config: Config, ts: str) -> DataFrame:
    """Findings of (idx, sample_id, contributor_id, batch_id, digest, h, label, v, metadata), and of
    repeated patches where rows have ``patches`` (see samples.pattern_findings).
    Corrupt samples are reported and taken out before any feature is compared."""
    corrupt = samples.corrupt_findings(rows, ts)
    valid = rows.where(F.coalesce(F.try_element_at("metadata", F.lit("is_corrupted")), F.lit("false")) != "true")
    exact = samples.exact_duplicates(valid, F.col("digest"), ts)
    out = [corrupt, exact]
    firsts = valid.join(exact.select("idx"), "idx", "left_anti")
    s = config.samples
    out.append(samples.near_duplicate_findings(samples.near_duplicates(firsts.select("idx", "h", "v"), s.hash_distance, s.cosine), ts))
    stats = valid.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes")).first()
    vectors = valid.select("idx", "label", "v")
    if stats["n"] >= s.neighbours + 1 and stats["classes"] >= 2:
        k = samples.effective_k(stats["n"], stats["classes"], s.neighbours)
        flips = samples.label_flips(vectors, samples.neighbours(vectors, k))
        evidence = {c: F.col(c) for c in ("label", "dominant", "purity", "dist_own", "dist_other")}
        out.append(flips.select(*C.finding(F.format_string("FIND-DS-LABEL-FLIP-%04d", "i"), "data_sentinel", "i", F.lit("Neighbours and centroids say another label"), evidence, "HIGH", F.col("confidence"), "QUARANTINE", "Label the sample anew", ts)))
    out.append(samples.outlier_findings(samples.outlier_scores(vectors, s.outlier_percentile / 100), ts))
    if "patches" in rows.columns:
        out.append(samples.pattern_findings(valid, s.pattern_samples, ts))
    return _union(out)


def model_findings(params: DataFrame | None, outputs: DataFrame | None, name: str, config: Config, ts: str) -> list[DataFrame]:
    out = []
    if params is not None:
        bad = models.bad_layers(params)
        out.append(bad.select(*C.finding(F.concat(F.lit("FIND-MA-PARAM-NANINF-"), "layer"), "model_auditor", F.concat(F.lit(name + ":"), "layer"), F.lit("Weights that are no number or infinite"), {"layer": F.col("layer"), "n_bad": F.col("n_bad")}, "CRITICAL", 1.0, "QUARANTINE", "Hold the model", ts)))
        finite = params.where(~F.isnan("w") & (F.abs("w") != float("inf")))
        st = models.parameter_statistics(finite, config.models.outlier_sigma).where("flagged")
        out.append(st.select(*C.finding(F.lit(f"FIND-MA-PARAM-OUTLIER-{name}"), "model_auditor", F.lit(name), F.lit("Weights far from the others"), {c: F.col(c) for c in ("outliers", "mean", "sd", "bound")}, "HIGH", 0.85, "REVIEW", "Look at these weights", ts)))
    if outputs is not None:
        g = models.output_agreement(outputs, config.models.tolerance).where("substituted")
        out.append(g.select(*C.finding(F.lit(f"FIND-MA-SUBSTITUTION-{name}"), "model_auditor", F.lit(name), F.lit("Outputs differ from those registered"), {c: F.col(c) for c in ("agreement", "mse", "max_diff")}, "CRITICAL", 0.96, "QUARANTINE", "Hold the model", ts)))
        out.append(model_audit.unprobed_findings(outputs, name, config.models.probes, ts))
    if params is None and outputs is None:
        out.append(_note(None, f"FIND-MA-UNAVAILABLE-{name}", name, ts))
    return out


def _note(spark: SparkSession | None, id_: str, asset: str, ts: str) -> DataFrame:
    spark = spark or SparkSession.getActiveSession()
    return spark.range(1).select(*C.finding(F.lit(id_), "model_auditor", F.lit(asset), F.lit("Neither weights nor outputs can be read"), {"asset": F.lit(asset)}, "MEDIUM", 1.0, "REVIEW", "Provide the model", ts))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), [p.select(*NAMES) for p in parts])


def run(
    spark: SparkSession,
    ts: str,
    key: crypto.KeyPair,
    sample_rows: DataFrame | None = None,
    params: DataFrame | None = None,
    outputs: DataFrame | None = None,
    model: str | None = None,
    records: DataFrame | None = None,
    shift_features: DataFrame | None = None,
    shift_vectors: DataFrame | None = None,
    config: Config | None = None,
    checkpoint: dict[str, Any] | None = None,
    trusted_key: str | None = None,
    replay: tuple[DataFrame, DataFrame] | None = None,
    lineage_of: tuple[DataFrame, DataFrame, str] | None = None,
) -> Audit:
    """Runs the branches whose input is given; only the summary's few rows reach the driver.
    Signatures of records and of their ``checkpoint`` are checked against ``trusted_key``, by
    default the audit's own key. ``replay``: (record_id, logged) and (record_id, replayed) for spot checks;
    ``lineage_of``: nodes, edges and the root whose impact is traced."""
    config = config or Config()
    parts: list[DataFrame] = []
    confidences = []
    contributors = batches = checks = None
    if sample_rows is not None:
        found = sample_findings(sample_rows, config, ts)
        s = config.samples
        # findings name samples by id or by position
        named = found.join(sample_rows.select(F.col("idx").cast("string").alias("asset"), "sample_id"), "asset", "left").select(F.coalesce("sample_id", "asset").alias("asset"))
        contributors, batches = (samples.risk(sample_rows, named, k, s.review_ratio, s.quarantine_ratio) for k in ("contributor_id", "batch_id"))
        parts += [found, samples.risk_findings(contributors, "contributor_id", ts)]
        confidences.append(0.90)
    if model is not None:
        parts += model_findings(params, outputs, model, config, ts)
        confidences.append(0.90 if params is not None else 0.75)
    if records is not None:
        trusted = trusted_key or key.public.hex()
        parts.append(provenance.audit(records, ts, trusted if trusted_key or "signature" in records.columns else None, checkpoint))
        if replay:
            checked = chain.spot_check(*replay, rate=config.provenance.spot_check_rate, tolerance=config.provenance.spot_check_tolerance)
            checks = chain.spot_summary(checked).first().asDict()
            parts.append(provenance.spot_check_findings(checked, ts))
        if checkpoint and checkpoint["public_key"] != trusted:
            parts.append(provenance.untrusted_checkpoint(spark, checkpoint, ts))
        confidences.append(1.0)
    if shift_features is not None and shift_vectors is not None:
        parts.append(shift.shift_findings(shift.diagnose(shift_features, shift_vectors, config.shift.bins, config.shift.drift_threshold), "evaluation", ts))
        confidences.append(0.90)
    findings = _union(parts) if parts else spark.createDataFrame([], FINDING)
    results = spark.createDataFrame([(c,) for c in confidences], "confidence double")
    document = governance.summary_document(findings, results, {"samples": sample_rows is not None, "model": model, "records": records is not None}, ts[:10] + "-" + key.public.hex()[:8], ts)
    return Audit(findings, governance.sign(document, key), contributors, batches, trace(*lineage_of) if lineage_of else None, checks)


def trace(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    return lineage.impact(nodes, edges, root)
