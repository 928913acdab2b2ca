"""Signed records, head checkpoints, and the audit that joins all checks of a log."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.functions import columns as C
from auditlake.functions import crypto
from auditlake.operators import chain, merkle


def record_id(chain_id: str, seq: int) -> str:
    return f"REC-{chain_id[:8]}-{seq:06d}"


@dataclass
class Log:
    """A chain that grows record by record, for the service that writes it (one writer)."""

    chain_id: str
    key: crypto.KeyPair
    head: str = C.GENESIS
    length: int = 0

    def append(self, payload: bytes | str, model_digest: str, output: Any, nonce: str, timestamp: str, preprocessing: Any = None, inference: Any = None) -> dict[str, Any]:
        """The next record, hashed, linked and signed."""
        data = payload.encode() if isinstance(payload, str) else payload
        r = {
            "chain_id": self.chain_id, "pos": self.length, "sequence_number": self.length, "record_id": record_id(self.chain_id, self.length), "timestamp": timestamp, "input_sha256": crypto.sha256(data), "model_digest": model_digest,
            "preprocessing_config": crypto.canonical(preprocessing or {}), "inference_config": crypto.canonical(inference or {}), "output": crypto.canonical(output), "nonce": nonce, "previous_record_hash": self.head,
        }
        text = f"{r['sequence_number']}:{self.head}:{r['input_sha256']}:{model_digest}:{crypto.canonical_hash(output)}:{nonce}:{timestamp}"
        r["record_hash"] = self.head = crypto.sha256(text)
        r["signature"] = self.key.sign(self.head.encode()).hex()
        self.length += 1
        return r


def _payload(c: dict[str, Any]) -> bytes:
    return ":".join(str(c[k]) for k in ("chain_id", "sequence_length", "head_record_hash", "merkle_root", "timestamp")).encode()


def checkpoint(records: DataFrame, chain_id: str, key: crypto.KeyPair, timestamp: str, order: str = "pos") -> dict[str, Any]:
    """The signed length, head and Merkle root of one chain whose positions are gapless from 0; ``peaks`` are
    what extended() goes on from."""
    head = records.agg(F.count(F.lit(1)).alias("n"), F.max_by("record_hash", order).alias("head")).first()
    peaks = merkle.collected(merkle.forest(merkle.leaf_nodes(records.select(F.col(order).alias("pos"), F.col("record_hash").alias("h")))))
    return _signed(chain_id, head["n"], head["head"] or C.GENESIS, peaks, timestamp, key)


def _signed(chain_id: str, n: int, head: str, peaks: list[tuple[int, int, str]], timestamp: str, key: crypto.KeyPair) -> dict[str, Any]:
    c = {"chain_id": chain_id, "sequence_length": n, "head_record_hash": head, "merkle_root": merkle.root_of(peaks), "timestamp": timestamp, "public_key": key.public.hex()}
    return c | {"signature": key.sign(_payload(c)).hex(), "peaks": sorted(map(list, peaks), reverse=True)}


def extended(c: dict[str, Any], new: DataFrame, key: crypto.KeyPair, timestamp: str, order: str = "pos") -> dict[str, Any]:
    """The checkpoint of a log that has grown by ``new`` records since ``c``, from those alone. ``c`` must be the
    key's own, its peaks must give the root that it signs, and the new positions must follow on."""
    peaks = [tuple(p) for p in c["peaks"]]
    n = c["sequence_length"]
    if c["public_key"] != key.public.hex() or not crypto.verify_hex(c["public_key"], _payload(c), c["signature"]) or merkle.root_of(list(peaks)) != c["merkle_root"] or sum(1 << p[0] for p in peaks) != n:
        raise ValueError("checkpoint doesn't hold")
    got = new.agg(F.count(F.lit(1)).alias("n"), F.max_by("record_hash", order).alias("head"), F.min(order).alias("first"), F.max(order).alias("last")).first()
    if not got["n"]:
        return c
    if (got["first"], got["last"]) != (n, n + got["n"] - 1):
        raise ValueError("new records don't follow on")
    leaves = merkle.leaf_nodes(new.select(F.col(order).alias("pos"), F.col("record_hash").alias("h")))
    old = new.sparkSession.createDataFrame(peaks, merkle.PEAKS)
    return _signed(c["chain_id"], n + got["n"], got["head"], merkle.collected(merkle.forest(old.unionByName(leaves))), timestamp, key)


def checkpoint_findings(records: DataFrame, c: dict[str, Any], ts: str = "", order: str = "pos") -> DataFrame:
    """What a checkpoint says against the records: its signature, length, Merkle root and head."""
    # positions may have gaps after a deletion: leaves are numbered anew, in ranges
    leaves = chain.leaves(records, F.col(order), F.col("record_hash"))
    found = records.agg(F.count(F.lit(1)).alias("n"), F.max_by("record_hash", order).alias("head")).first()
    root = chain.merkle_root(leaves).first()["root"]
    rows = []
    if not crypto.verify_hex(c["public_key"], _payload(c), c["signature"]):
        rows.append(("FIND-PE-CHECKPOINT-SIG-FAIL", "Checkpoint's signature is not valid", ""))
    if c["sequence_length"] != found["n"]:
        rows.append(("FIND-PE-CHECKPOINT-LEN-MISMATCH", "Checkpoint counts other records", f"{c['sequence_length']} {found['n']}"))
    if c["merkle_root"] != root:
        rows.append(("FIND-PE-MERKLE-ROOT-MISMATCH", "Merkle root of the records differs", root))
    if c["head_record_hash"] != (found["head"] or C.GENESIS):
        rows.append(("FIND-PE-CHECKPOINT-HEAD-MISMATCH", "Checkpoint ends in another record", found["head"] or ""))
    d = records.sparkSession.createDataFrame(rows, "id string, reason string, seen string")
    return d.select(*C.finding(F.col("id"), "provenance_engine", F.lit(f"checkpoint:{c['chain_id']}"), F.col("reason"), {"seen": F.col("seen")}, "CRITICAL", 1.0, "QUARANTINE", "Reject the log", ts))


def untrusted_checkpoint(spark: SparkSession, c: dict[str, Any], ts: str = "") -> DataFrame:
    """The finding on a checkpoint that another key than the trusted one has signed."""
    return spark.range(1).select(*C.finding(F.lit("FIND-PE-CHECKPOINT-SIG-FAIL"), "provenance_engine", F.lit(f"checkpoint:{c['chain_id']}"), F.lit("Checkpoint is not signed by the trusted key"), {"seen": F.lit(c["public_key"])}, "CRITICAL", 1.0, "QUARANTINE", "Reject the log", ts))


def spot_check_findings(checked: DataFrame, ts: str = "") -> DataFrame:
    dim = F.col("verdict") == "DIM"
    id_ = F.concat(F.when(dim, "FIND-PE-SPOTCHECK-DIM-").otherwise("FIND-PE-SPOTCHECK-DIFF-"), "record_id")
    return checked.where("verdict in ('DIM', 'DIFF')").select(*C.finding(id_, "provenance_engine", "record_id", F.lit("Replayed output differs from the logged one"), {"max_diff": F.col("max_diff"), "verdict": F.col("verdict")}, "CRITICAL", F.when(dim, 1.0).otherwise(0.98), "QUARANTINE", "Hold the record", ts))


def audit(records: DataFrame, ts: str = "", trusted_key: str | None = None, c: dict[str, Any] | None = None, replay: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All findings of one log. ``trusted_key``: signatures are checked against this key alone, never
    against one that the log itself names. ``replay``: (record_id, logged), (record_id, replayed)."""
    digest = F.sha2(crypto.canonical_column("output"), 256) if "output" in records.columns else None
    signed = crypto.verify_column(F.lit(trusted_key), "record_hash", "signature") if trusted_key else None
    out = chain.findings(chain.verify_long(records, output_digest=digest, valid_signature=signed), ts)
    if c:
        out = out.unionByName(checkpoint_findings(records, c, ts))
    if replay:
        out = out.unionByName(spot_check_findings(chain.spot_check(*replay), ts))
    return out


def walk(links: DataFrame, span: int = 100_000) -> DataFrame:
    """(chain_id, first_break) of (chain_id, pos, hash, prev_hash): the position of the first record
    whose previous hash isn't that of the record before it, over gaps too; null if all links hold. The
    first record has none before it. Chains are walked in ranges of positions."""
    d = links.withColumn("_range", F.floor(F.col("pos") / span)).join(chain.ranges(links, "hash", "chain_id", "pos", span), ["chain_id", "_range"])
    w = Window.partitionBy("chain_id", "_range").orderBy("pos")
    first = (F.row_number().over(w) == 1) & (F.col("_before") == 0)
    broken = ~first & ~F.col("prev_hash").eqNullSafe(F.coalesce(F.lag("hash").over(w), F.col("_prev")))
    return d.withColumn("broken", broken).groupBy("chain_id").agg(F.min(F.when(F.col("broken"), F.col("pos"))).alias("first_break"))


def registration_id(digest):
    """A registered asset's id from its digest."""
    return F.concat(F.lit("REG-"), F.upper(F.left(digest, F.lit(8))))


def record_ids(chain_id, seq):
    """record_id() as a column."""
    return F.concat(F.lit("REC-"), F.left(chain_id, F.lit(8)), F.lit("-"), F.lpad(seq.cast("string"), 6, "0"))


def result(findings: DataFrame, total: int | None = None, checked: DataFrame | None = None) -> DataFrame:
    """One row of a log's audit: how many findings of each kind, and the disposition, which any failed
    spot check, checkpoint or record makes QUARANTINE. With spot checks also how many
    records were sampled, passed, differed, and had no input."""
    n = lambda pattern: F.count_if(F.col("finding_id").rlike(pattern))
    kinds = {"n_tampered": "RECORD-TAMPER", "n_seq_anomaly": "SEQ-ANOMALY", "n_broken_link": "BROKEN-LINK", "n_checkpoint": "CHECKPOINT|MERKLE", "n_spot_check": "SPOTCHECK"}
    d = findings.agg(*[n(p).alias(k) for k, p in kinds.items()], F.count(F.lit(1)).alias("n_findings"))
    d = d.withColumn("disposition", F.when(F.col("n_findings") > 0, "QUARANTINE").otherwise("ACCEPT"))
    if checked is not None:
        d = d.join(F.broadcast(chain.spot_summary(checked)))  # one row each
    return d if total is None else d.withColumn("total", F.lit(total))


def predictions(inputs: DataFrame, predict, id_col: str = "record_id", input_col: str = "v") -> DataFrame:
    """(id, output) of a model over vectors, a batch of rows at a time. ``predict``: a function
    that returns a function from (rows, features) to (rows, classes); it is called once a task."""
    kind = inputs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np

        f = predict()
        for pdf in batches:
            if len(pdf):
                out = f(np.stack(pdf["v"].to_list()))
                yield pd.DataFrame({id_col: pdf[id_col], "output": [row.astype(float).tolist() for row in out]})

    return inputs.select(id_col, F.col(input_col).alias("v")).mapInPandas(run, f"{id_col} {kind}, output array<double>")


def onnx(path: str):
    """A model file for predictions()."""

    def load():
        import onnxruntime

        s = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = s.get_inputs()[0].name
        return lambda x: s.run(None, {name: x.astype("float32")})[0]

    return load


@dataclass
class Loaded:
    """A model, or why there is none."""

    path: str
    available: bool
    reason: str = ""
    predict: Any = None  # for predictions()
    inputs: tuple = ()


def load_model(path: str) -> Loaded:
    """A model file, by its name's end; never raises. TorchScript needs torch; pickled weights are refused, as reading
    them runs what they hold."""
    try:
        if path.endswith(".onnx"):
            import onnxruntime

            s = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            return Loaded(path, True, predict=onnx(path), inputs=tuple((i.name, tuple(i.shape)) for i in s.get_inputs()))
        if path.endswith((".pt", ".pth", ".bin")):
            import torch

            torch.jit.load(path)

            def load():
                m = torch.jit.load(path).eval()
                return lambda x: m(torch.as_tensor(x, dtype=torch.float32)).detach().numpy()

            return Loaded(path, True, predict=load)
        return Loaded(path, False, "no model format has this ending")
    except Exception as e:  # whatever a broken file makes a library raise
        return Loaded(path, False, f"{type(e).__name__}: {e}"[:200])
