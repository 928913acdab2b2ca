"""Large files read by ranges, against whole reads."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from auditlake.sources import datasets, files

NASTY = ["a", "", '"', "\\", '\\"', "{[", "]}", "é漢", '\\\\"', "images", '"images": [', "\n\t", "\\" * 9]


def document(r, n):
    value = lambda d: r.choice([1, 1.5, None, True, r.choice(NASTY), [value(d - 1) for _ in range(r.randint(0, 3))], {r.choice(NASTY): value(d - 1) for _ in range(r.randint(0, 3))}] if d else [0, r.choice(NASTY)])
    doc = {
        "info": {"images": [{"id": 9}], "text": r.choice(NASTY)}, "images": [{"id": k, "file_name": r.choice(NASTY) + str(k), "extra": value(2)} for k in range(n)], "licenses": [[{"id": 1}], {"id": 2}],
        "annotations": [{"id": k, "image_id": r.randrange(n), "category_id": r.randint(0, 3), "bbox": [0.5, k], "more": value(3)} for k in range(2 * n)], "categories": [{"id": k, "name": r.choice(NASTY)} for k in range(3)], "x": r.choice(NASTY),
    }
    keys = list(doc)
    r.shuffle(keys)
    return {k: doc[k] for k in keys}


@pytest.mark.parametrize("block, indent", [(13, None), (100, 1), (1 << 20, None)])
def test_json_elements(spark, tmp_path, block, indent):
    r = random.Random(block)
    doc = document(r, 12)
    path = f"{tmp_path}/a b.json"
    with open(path, "w") as f:
        json.dump(doc, f, indent=indent, ensure_ascii=bool(indent))
    rows = files.json_elements(spark, path, ("images", "annotations", "categories", "none"), block).collect()
    for key in ("images", "annotations", "categories"):
        assert [json.loads(x["element"]) for x in sorted(rows, key=lambda x: x["place"]) if x["key"] == key] == doc[key]
    assert {x["key"] for x in rows} == {"images", "annotations", "categories"}


@pytest.mark.parametrize("text", ["", "[]", "{}", '{"images": []}', '{"images": [{"id": 1}', '{"images": [{"id": 1}]', '{"images": [{"id": "1}]}', '"images"', "]{", '{"images": {"id": 1}, "annotations": 3}', '{"images": [1, null, "x", [{"id": 2}]]}', "no json"])
def test_files_without_elements(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    assert files.json_elements(spark, str(tmp_path / "x.json"), ("images", "annotations"), 5).collect() == []


def test_coco_by_ranges_is_that_of_the_whole(spark, tmp_path, monkeypatch):
    doc = document(random.Random(3), 20)
    path = str(tmp_path / "coco.json")
    for text in (json.dumps(doc), json.dumps(doc)[:-1], json.dumps(doc).replace('"id": 3', '"id": 3.5'), '{"images": [{"id": 1, "file_name": "a"}], "images": [{"id": 2, "file_name": "b"}]}'):
        (tmp_path / "coco.json").write_text(text)
        got = sorted(map(repr, datasets.coco(spark, path).collect()))
        with monkeypatch.context() as m:
            m.setattr(files, "known", lambda p: False)
            assert got == sorted(map(repr, datasets.coco(spark, path).collect()))


def test_words_over_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 7)
    (tmp_path / "a").write_bytes(b"x" * 20 + b'"images"' + b"y" * 9)
    (tmp_path / "b").write_bytes(b"")
    got = files.holding(spark.createDataFrame([(str(tmp_path / n),) for n in "ab"], "path string"), (b'"images"', b'"none"')).collect()
    assert sorted((r["path"][-1], r["has"]) for r in got) == [("a", [True, False]), ("b", [False, False])]


def test_zip_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MEMBERS", 3000)
    path, noise = str(tmp_path / "a.zip"), {f"d{k % 3}/é {k}.bin": os.urandom(1000) for k in range(20)}
    with zipfile.ZipFile(path, "w") as z:
        for n, data in noise.items():
            z.writestr(n, data, zipfile.ZIP_DEFLATED if len(n) % 2 else zipfile.ZIP_STORED)
        z.writestr("d0/", b"")
        z.writestr("../out", b"x")
        z.writestr("big", b"0" * 5000)
        z.writestr("empty", b"")
    listing = files.zip_listing(spark, path)
    assert listing.agg(F.count_distinct("task")).first()[0] > 5
    got = {r["member"]: r for r in files.zip_members(spark, path, most=4999).collect()}
    assert {n: bytes(r["content"]) for n, r in got.items() if r["error"] is None} == noise | {"empty": b""}
    assert got["../out"]["error"] == "outside of its folder" and got["big"]["error"] == "too large" and len(got) == 23
    with pytest.raises(datasets.DatasetError, match="outside"):
        datasets.unpacked(spark, path)


def test_unzipping(spark, tmp_path):
    path, noise = str(tmp_path / "a.zip"), {f"d/{k}.bin": os.urandom(2000 + k) for k in range(9)}
    with zipfile.ZipFile(path, "w") as z:
        for n, data in noise.items():
            z.writestr(n, data)
    out = datasets.unpacked(spark, path)
    assert {n: open(f"{out}/{n}", "rb").read() for n in noise} == noise
    data = bytearray(open(path, "rb").read())
    data[data.find(noise["d/4.bin"]) + 7] ^= 1
    open(path, "wb").write(bytes(data))
    assert {r["member"] for r in files.zip_members(spark, path).where("error is not null").collect()} == {"d/4.bin"}
    with pytest.raises(datasets.DatasetError, match=r"d/4\.bin"):
        datasets.unpacked(spark, path, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out/d/4.bin") and os.path.getsize(tmp_path / "out/d/5.bin") == 2005
    open(path, "wb").write(b"no archive")
    with pytest.raises(datasets.DatasetError, match="not a ZIP"):
        datasets.unpacked(spark, path)
    with zipfile.ZipFile(path, "w"):
        pass
    with pytest.raises(datasets.DatasetError, match="empty"):
        datasets.unpacked(spark, path)
