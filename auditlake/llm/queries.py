"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from auditlake.llm import decontam, filter_audit, langid, license_scan, mixing, neardup, pii, quality, resampling, sharding, token_counts, toxicity, warc

QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_mix": mixing.op3_mix,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_neardup": neardup.op5_neardup,
    "op6_shard": sharding.op6_shard,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pii": pii.op9_pii,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_warc": warc.op11_warc,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_resample": resampling.op13_resample,
}

#: The others have no SQL: learned scores, random draws, hashes, offsets, tokens; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_decontaminate": decontam.SQL, "op5_neardup": neardup.SQL, "op7_quality": quality.SQL, "op11_warc": warc.SQL, "op12_filter_audit": filter_audit.SQL, "op13_resample": resampling.SQL}
