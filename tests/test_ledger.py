"""The ledger's commits: segments, retries, edits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from auditlake.operators import governance
from auditlake.sources import datasets, ledger


def findings(spark, n, start=0, parts=3):
    return spark.range(start, start + n).select(F.concat(F.lit("F"), "id").alias("finding_id"), F.lit("t").alias("timestamp"), F.struct(F.lit("é\n\"").alias("text")).alias("evidence")).repartition(parts)


def checked(spark, path):
    e = ledger.entries(spark, path)
    assert sorted(r["seq"] for r in e.collect()) == list(range(e.count()))
    return e.count(), governance.ledger_breaks(e).count(), ledger.commit_breaks(spark, path).count(), ledger.edited(spark, path).count()


def test_segments_are_one_chain(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.append(findings(spark, 100), path, "a")
    ledger.append(findings(spark, 50, 100), path, "b")
    ledger.append(findings(spark, 50, 100), path, "b")  # once more
    ledger.append(findings(spark, 0), path, "none")
    ledger.append(findings(spark, 1, 900), path)
    assert checked(spark, path) == (151, 0, 0, 0)
    names = {json.loads(r["finding"])["finding_id"] for r in datasets.ledger(spark, path).collect()}
    assert names == {f"F{k}" for k in [*range(150), 900]}
    assert len(os.listdir(f"{path}/segments")) == sum(len(r["segments"]) for r in ledger.commits(spark, path).collect())


def test_failed_and_repeated_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.append(findings(spark, 10), path, "a")
    bad = findings(spark, 10).withColumn("x", F.when(F.col("finding_id") == "F7", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception):
        ledger.append(bad, path, "b")
    # an attempt that was lost before the commit
    (tmp_path / "l/segments/lost.jsonl").write_text('{"n": 0, "previous_hash": "x", "timestamp": "", "finding": "{}", "entry_hash": "y"}\n')
    ledger.append(findings(spark, 10, 10), path, "b")
    assert checked(spark, path) == (20, 0, 0, 0)
    with pytest.raises(Exception):
        findings(spark, 1).write.format("ledger").mode("overwrite").save(path)


@pytest.mark.parametrize("attack", ["edit", "cut", "drop", "swap", "commit", "forge"])
def test_edits_are_found(spark, tmp_path, attack):
    path = str(tmp_path / "l")
    for k in range(3):
        ledger.append(findings(spark, 12, 12 * k, 2), path, str(k))
    commits = sorted(os.listdir(f"{path}/commits"))
    commits = [c for c in commits if c.endswith(".json") and not c.startswith(".")]
    second = json.load(open(f"{path}/commits/{commits[1]}"))
    a, b = (f"{path}/segments/{s['name']}.jsonl" for s in second["segments"])
    lines = open(a).read().splitlines()
    for folder in ("segments", "commits"):  # Hadoop's check sums would tell as well
        for f in os.listdir(f"{path}/{folder}"):
            if f.endswith(".crc"):
                os.unlink(f"{path}/{folder}/{f}")
    if attack == "edit":
        open(a, "w").write("\n".join([lines[0].replace("F", "G", 1), *lines[1:]]) + "\n")
    elif attack == "cut":
        open(a, "w").write("\n".join(lines[:-1]) + "\n")
    elif attack == "drop":
        os.unlink(a)
    elif attack == "swap":
        x, y = open(a).read(), open(b).read()
        open(a, "w").write(y)
        open(b, "w").write(x)
    elif attack == "commit":
        os.unlink(f"{path}/commits/{commits[1]}")
    else:  # a commit rewritten with its own hash made anew
        second["batch"] = "other"
        second["commit_hash"] = ledger.commit_hash(second["number"], second["previous_hash"], "other", second["segments"])
        json.dump(second, open(f"{path}/commits/{commits[1]}", "w"))
    e = ledger.entries(spark, path)
    assert governance.ledger_breaks(e).count() + ledger.commit_breaks(spark, path).count() + ledger.edited(spark, path).count() > 0
