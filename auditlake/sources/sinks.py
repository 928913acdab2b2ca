"""Where results go: signed summaries, reports, schemas, sidecars, ledgers."""

from __future__ import annotations

import html
import json
import os
from typing import Any

from pyspark.sql import DataFrame

from auditlake.functions import crypto, schemas
from auditlake.operators.governance import ledger_entries, ledger_head


def write_json(value: Any, path: str) -> str:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
    return path


def write_summary(signed: dict[str, Any], folder: str) -> str:
    return write_json(signed, os.path.join(folder, f"summary_{signed['summary_id']}.json"))


def read_summary(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def export_schemas(folder: str) -> list[str]:
    """A JSON Schema for each row type."""
    return [write_json({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name} | schemas.json_schema(t), os.path.join(folder, f"{name}.schema.json")) for name, t in schemas.ALL.items()]


def sidecar(record: dict[str, Any], key: crypto.KeyPair, output_sha256: str | None = None) -> dict[str, Any]:
    """A signed claim about one inference, to lie beside its output."""
    claim = {k: record[k] for k in ("record_id", "sequence_number", "timestamp", "input_sha256", "model_digest", "record_hash")} | {"output_sha256": output_sha256}
    digest = crypto.canonical_hash(claim)
    return {"claim": claim, "claim_hash": digest, "public_key": key.public.hex(), "signature": key.sign(digest.encode()).hex()}


def verify_sidecar(s: dict[str, Any]) -> bool:
    return crypto.canonical_hash(s["claim"]) == s["claim_hash"] and crypto.verify_hex(s["public_key"], s["claim_hash"].encode(), s["signature"])


def append_ledger(findings: DataFrame, path: str) -> int:
    """Appends findings to a local ledger of JSON lines, by one writer, in order of id."""
    previous, start = "0" * 64, 0
    if os.path.exists(path):
        from auditlake.sources.datasets import ledger

        head = ledger_head(ledger(findings.sparkSession, path)).first()
        previous, start = head["last_hash"] or previous, head["n"]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "a", encoding="utf-8") as f:
        for row in findings.orderBy("finding_id").toLocalIterator():
            entry = ledger_entries([row.asDict()], previous, start + n)[0]
            f.write(json.dumps(entry | {"finding": json.dumps(entry["finding"], sort_keys=True)}) + "\n")
            previous, n = entry["entry_hash"], n + 1
    return n


def write_watermarked(images: DataFrame, folder: str, policy: str = "INVISIBLE") -> None:
    """Images (record_id, image) as PNG files, in a table (record_id, content) of any store. ``policy`` is the setting
    ``provenance.watermark``: the record's id is shown (VISIBLE), hidden in the pixels (INVISIBLE), BOTH or NONE."""
    from auditlake.functions.images import watermarked_column

    images.select("record_id", watermarked_column("image", "record_id", policy in ("VISIBLE", "BOTH"), policy in ("INVISIBLE", "BOTH")).alias("content")).write.mode("append").parquet(folder)


def html_report(signed: dict[str, Any], coverage: dict[str, Any] | None = None, limitations: list[str] | None = None, impact: dict[str, Any] | None = None) -> str:
    """A page of the summary by itself: findings, what the audit covered and left out, and what lies downstream
    of a traced node (a row of lineage.impact). All values are escaped."""
    e = lambda x: html.escape(str(x))
    rows = "".join(f"<tr><td>{e(f.get('finding_id'))}</td><td>{e(f.get('severity'))}</td><td>{e(f.get('asset'))}</td><td>{e(f.get('reason', ''))}</td></tr>" for f in signed["top_findings"])
    counts = "".join(f"<li>{e(k)}: {e(v)}</li>" for k, v in signed["severity_counts"].items())
    pairs = lambda d: "".join(f"<li>{e(k)}: {e(v)}</li>" for k, v in d.items())
    more = f"<h2>Coverage</h2><ul>{pairs(coverage or signed.get('audited_assets') or {})}</ul>"
    more += "<h2>Limitations</h2><ul>" + "".join(f"<li>{e(x)}</li>" for x in limitations or ["Only what was handed in was audited."]) + "</ul>"
    more += f"<h2>Downstream of {e(impact['root'])}</h2><ul>{pairs({k: v for k, v in impact.items() if k != 'root'})}</ul>" if impact else ""
    actions = "".join(f"<li>{e(a)}</li>" for a in signed["remediations"])
    return (
        f"<!doctype html><meta charset=utf-8><title>Assurance {e(signed['summary_id'])}</title><h1>Assurance summary {e(signed['summary_id'])}</h1>"
        f"<p>Disposition <b>{e(signed['overall_disposition'])}</b>, confidence {e(signed['confidence'])}, {e(signed['timestamp'])}</p><ul>{counts}</ul>"
        f"<h2>Gravest findings</h2><table><tr><th>Id<th>Severity<th>Asset<th>Reason</tr>{rows}</table>{more}<h2>What to do</h2><ol>{actions}</ol><p>Digest {e(signed.get('content_hash'))}</p>"
    )


def text_table(df: DataFrame, n: int = 50) -> str:
    """The first ``n`` rows as aligned text, for the command line, with a notice where more are left out."""
    more = df.count() - n
    rows = [df.columns, *[[("" if v is None else str(v)) for v in r] for r in df.limit(n).collect()]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    rows += [[f"... and {more} more rows"]] if more > 0 else []
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in rows)
