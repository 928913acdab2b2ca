"""Column expressions: vectors, hashes, dispositions, findings, texts."""

from __future__ import annotations

import datetime
import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.schemas import MODULES

GENESIS = "0" * 64


def now() -> str:
    """The time of a run, taken once on the driver, so that plans stay the same from task to task."""
    return datetime.datetime.now(datetime.timezone.utc).isoformat()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), operator.add)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector over its length (+ 1e-12); the length is taken once."""
    return F.get(F.transform(F.array(norm(a) + 1e-12), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hex_to_long(h: Column | str) -> Column:
    """Up to 16 hex digits as a signed 64-bit number of the same bits."""
    return F.conv(h, 16, -10).cast("long")


def sign_bits(v: Column | str, n: int) -> Column:
    """Bit k: component k is positive."""
    bits = [F.when(F.get(v, F.lit(k)) > 0, F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(n)]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def argmax(v: Column | str) -> Column:
    """Position of the first largest element, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def softmax(v: Column | str) -> Column:
    e = F.get(F.transform(F.array(F.array_max(v)), lambda m: F.transform(v, lambda x: F.exp(x - m))), F.lit(0))
    return F.get(F.transform(F.array(F.aggregate(e, F.lit(0.0), operator.add)), lambda s: F.transform(e, lambda x: x / s)), F.lit(0))


def max_abs_diff(a: Column | str, b: Column | str) -> Column:
    """Largest difference of two vectors; null where their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def severity_order(c: Column | str) -> Column:
    return F.when(col(c) == "CRITICAL", 0).when(col(c) == "HIGH", 1).when(col(c) == "MEDIUM", 2).otherwise(3)


def module_order(c: Column | str) -> Column:
    """The place of a module among all."""
    return F.coalesce(*[F.when(col(c) == m, F.lit(k)) for k, m in enumerate(MODULES)], F.lit(len(MODULES)))


def worst(c: Column | str) -> Column:
    """Aggregate: the gravest disposition of a group, ACCEPT for none."""
    return F.when(F.coalesce(F.bool_or(col(c) == "QUARANTINE"), F.lit(False)), "QUARANTINE").when(F.coalesce(F.bool_or(col(c) == "REVIEW"), F.lit(False)), "REVIEW").otherwise("ACCEPT")


def ratio_disposition(ratio: Column, review: float = 0.15, quarantine: float = 0.30) -> Column:
    """At least ``review``: REVIEW; over ``quarantine``: QUARANTINE."""
    return F.when(ratio < review, "ACCEPT").when(ratio > quarantine, "QUARANTINE").otherwise("REVIEW")


def record_hash(seq: Column, prev: Column, input_: Column, model: Column, output: Column, nonce: Column, ts: Column, *more: Column) -> Column:
    """Digest of a log record. ``more``: the configurations too, which the customary
    payload leaves out, so that a change to them shows."""
    return F.sha2(F.concat_ws(":", seq.cast("string"), prev, input_, model, output, nonce, ts, *more), 256)


def finding(id_: Column, module: str, asset: Column | str, reason: Column, evidence: dict[str, Column], severity: Column | str, confidence: Column | float, disposition: Column | str, action: Column | str, timestamp: str) -> list[Column]:
    """The columns of a finding, in the order of its schema."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [
        id_.alias("finding_id"), F.lit(module).alias("module"), col(asset).cast("string").alias("asset"), reason.alias("reason"),
        F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()]), {"ignoreNullFields": "false"}).alias("evidence"),
        lit(severity).alias("severity"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), lit(confidence).cast("double"))).alias("confidence"),
        lit(disposition).alias("disposition"), lit(action).alias("recommended_action"), F.lit(timestamp).alias("timestamp"),
    ]


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * x)


def shorten(s: Column | str, head: int = 8, tail: int = 4) -> Column:
    """Beginning, ellipsis and end of a long identifier."""
    return F.when(F.length(s) <= head + tail + 1, col(s)).otherwise(F.concat(F.left(s, F.lit(head)), F.lit("…"), F.right(s, F.lit(tail))))


def psi_band(psi: Column | str) -> Column:
    """Wording of a stability index."""
    return F.when(col(psi) < 0.10, "stable").when(col(psi) < 0.25, "moderate").otherwise("significant")


def evidence_category(reason: Column, asset: Column, evidence: Column) -> Column:
    """Kind of evidence by what a finding says."""
    hay = F.lower(F.concat_ws(" ", reason, asset, evidence))
    kinds = (("duplicate", "dup"), ("label", "label|mislabel"), ("ood", "ood|out-of-distribution"), ("trigger", "trigger|patch|backdoor"), ("batch", "batch|contributor"))
    out = F.lit("other")
    for name, pattern in reversed(kinds):
        out = F.when(hay.rlike(pattern), name).otherwise(out)
    return out


def node_kind(id_: Column | str) -> Column:
    return F.when(col(id_).rlike("(?i)^model"), "model").when(col(id_).rlike("(?i)^inf"), "inference").otherwise("dataset")


def labels_match(a: Column, b: Column) -> Column:
    """One name holds the other, in any case."""
    return (F.instr(F.lower(a), F.lower(b)) > 0) | (F.instr(F.lower(b), F.lower(a)) > 0)
