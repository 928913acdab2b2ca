"""Row types that operators share, and the orders of their enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of findings.
MODULES = ("data_sentinel", "model_auditor", "provenance_engine", "shift_diagnostician", "blast_radius", "red_team", "governance")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")

FINDING = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("asset", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("evidence", T.StringType()),  # JSON
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("idx", T.LongType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("labels", T.ArrayType(T.IntegerType())),
        T.StructField("label_names", T.ArrayType(T.StringType())),
        T.StructField("bounding_boxes", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("contributor_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

RECORD = T.StructType(
    [
        T.StructField("sequence_number", T.LongType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("input_sha256", T.StringType()),
        T.StructField("model_digest", T.StringType()),
        T.StructField("preprocessing_config", T.StringType()),
        T.StructField("inference_config", T.StringType()),
        T.StructField("output", T.StringType()),  # canonical JSON
        T.StructField("nonce", T.StringType()),
        T.StructField("previous_record_hash", T.StringType()),
        T.StructField("record_hash", T.StringType()),
        T.StructField("signature", T.StringType()),
    ]
)

ALL = {"finding": FINDING, "sample": SAMPLE, "record": RECORD}


def json_schema(t: T.DataType) -> dict:
    """A type as JSON Schema; every field may be null."""
    if isinstance(t, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in t}, "required": t.names, "additionalProperties": False}
    if isinstance(t, T.ArrayType):
        return {"type": ["array", "null"], "items": json_schema(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": ["object", "null"], "additionalProperties": json_schema(t.valueType)}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number"}
    return {"type": [next((n for k, n in names.items() if isinstance(t, k)), "integer"), "null"]}
