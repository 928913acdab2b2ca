"""Large single files, read by ranges: elements of JSON arrays, members of ZIP archives.

A JSON file is cut into blocks wherever they fall. A first pass tells for each block, once as if it began outside of a string and
once as if inside, what its quotes and brackets add up to; from these few numbers a block each the driver
knows the true state at every border. In a second pass each task finds the elements that begin
in its blocks. So one array of any length is read by many tasks, in memory for a block and an element.

A ZIP archive's members are listed by one task, from its central directory alone, and read or written by many, by ranges.

Files are opened through pyarrow.fs; known() tells whether it reaches a path's store.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a block; compressed bytes of members that one task reads; bytes of a member that a row may hold.
BLOCK, MEMBERS, MOST_CONTENT = 16 << 20, 32 << 20, 512 << 20
PIECE = 1 << 20
_STEP = np.zeros(256, np.int64)
_STEP[[123, 91]], _STEP[[125, 93]] = 1, -1


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def known(path: str) -> bool:
    """Whether tasks can open the path's store by ranges."""
    try:
        _place(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def opened(path: str) -> Any:
    fs, name = _place(path)
    return fs.open_input_file(name)


# --- JSON --------------------------------------------------------------------


class _Block:
    """The brackets outside of strings in a range of a file, if the range begins inside of a string or not."""

    def __init__(self, raw: Any, at: int, size: int):
        raw.seek(at)
        self.at, self.data = at, np.frombuffer(raw.read(size), np.uint8)
        quotes = np.flatnonzero(self.data == 34)
        slash = self.data == 92
        if slash.any() or (at and len(quotes) and quotes[0] == 0):
            before = np.maximum.accumulate(np.where(slash, -1, np.arange(len(slash))))
            last = np.where(quotes > 0, before[quotes - 1], -1)
            run = quotes - 1 - last
            run[last < 0] += self._slashes_before(raw, at)
            quotes = quotes[run % 2 == 0]
        self.odd = len(quotes) % 2
        self.places = np.flatnonzero(_STEP[self.data])
        self.within = np.searchsorted(quotes, self.places) % 2

    @staticmethod
    def _slashes_before(raw: Any, at: int) -> int:
        n = 0
        while at:
            size = min(at, 4096)
            raw.seek(at - size)
            data = raw.read(size)
            run = size - len(data.rstrip(b"\\"))
            n, at = n + run, at - size
            if run < size:
                break
        return n

    def steps(self, inside: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the brackets that count, and +1 or -1 of each."""
        places = self.places[self.within == inside]
        return places, _STEP[self.data[places]]


def _blocks(spark: SparkSession, path: str, rows: DataFrame, make, schema: str) -> DataFrame:
    """Rows of ``make(raw, *row)`` for each row, in tasks."""
    names, kinds = [f.split()[0] for f in schema.split(", ")], [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as raw:
                    found, held = [], 0
                    for x in make(raw, *row):
                        found.append(x)
                        held += len(x[-1]) if isinstance(x[-1], str) else 0
                        if held > PIECE << 2:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)
                            found, held = [], 0
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return rows.mapInArrow(run, schema)


def _spread(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10_000)), schema.split()[0])


def json_elements(spark: SparkSession, path: str, keys: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """(key, place, element): the objects in the arrays that a JSON file's top object has under ``keys``, as text, by their byte place.
    A file whose brackets or strings don't end has none; of two arrays of one key the last counts."""
    fs, name = _place(path)
    size = fs.get_file_info(name).size or 0
    starts = list(range(0, size, block))

    def totals(raw: Any, at: int) -> Iterator[tuple]:
        b = _Block(raw, at, block)
        out: list[int] = []
        for inside in (0, 1):
            depth = np.cumsum(b.steps(inside)[1])
            out += [int(depth[-1]), int(depth.min())] if len(depth) else [0, 0]
        yield (at, b.odd, *out)

    empty = spark.createDataFrame([], "key string, place long, element string")
    if not starts:
        return empty
    rows = _blocks(spark, path, _spread(spark, [(x,) for x in starts], "at long"), totals, "at long, odd long, d0 long, m0 long, d1 long, m1 long").collect()
    inside, depth, state = 0, 0, []
    for r in sorted(rows):
        state.append((r["at"], inside, depth, depth + min(0, r[f"m{inside}"])))
        depth, inside = depth + r[f"d{inside}"], inside ^ r["odd"]
    if inside or depth or min(s[3] for s in state) < 0:
        return empty

    def borders(raw: Any, at: int, inside: int, depth: int) -> Iterator[tuple]:
        """Arrays that begin or end one level below the top."""
        b = _Block(raw, at, block)
        places, step = b.steps(inside)
        after = depth + np.cumsum(step)
        for k in np.flatnonzero(((step > 0) & (after == 2)) | ((step < 0) & (after == 1))).tolist():
            here = at + int(places[k])
            begin = max(0, here - 65536)
            raw.seek(begin)
            m = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', raw.read(here - begin)) if step[k] > 0 and b.data[places[k]] == 91 else None
            yield (here, int(step[k]), json.loads(b'"' + m[1] + b'"') if m else None)

    top = [s[:3] for s in state if s[3] <= 1 or s[2] <= 1]
    found = sorted(_blocks(spark, path, _spread(spark, top, "at long, inside long, depth long"), borders, "place long, step long, key string").collect())
    spans = {a["key"]: (a["place"], b["place"]) for a, b in zip(found[::2], found[1::2]) if a["key"] in keys}

    def elements(raw: Any, at: int, inside: int, depth: int) -> Iterator[tuple]:
        b = _Block(raw, at, block)
        places, step = b.steps(inside)
        after = depth + np.cumsum(step)
        begins = np.flatnonzero((step > 0) & (after == 3) & (b.data[places] == 123))
        ends = np.flatnonzero((step < 0) & (after == 2))
        for key, (first, last) in spans.items():
            for k in begins[(at + places[begins] > first) & (at + places[begins] < last)].tolist():
                j = np.searchsorted(ends, k)
                start = int(places[k])
                if j < len(ends):
                    text = b.data[start : int(places[ends[j]]) + 1].tobytes()
                else:  # the element goes on behind the block
                    text = b.data[start:].tobytes() + _rest(raw, at + len(b.data), inside ^ b.odd, int(after[-1]))
                yield (key, at + start, text.decode("utf-8", "replace"))

    def _rest(raw: Any, at: int, inside: int, depth: int) -> bytes:
        out = []
        while True:
            b = _Block(raw, at, block)
            places, step = b.steps(inside)
            end = np.flatnonzero(depth + np.cumsum(step) == 2)
            if len(end):
                return b"".join([*out, b.data[: int(places[end[0]]) + 1].tobytes()])
            out.append(b.data.tobytes())
            at, inside, depth = at + len(b.data), inside ^ b.odd, depth + int(step.sum())

    within = [s[:3] for s, e in zip(state, [*starts[1:], size]) if any(first < e and last > s[0] for first, last in spans.values())]
    if not within:
        return empty
    return _blocks(spark, path, _spread(spark, within, "at long, inside long, depth long"), elements, "key string, place long, element string")


def holding(files: DataFrame, words: tuple[bytes, ...]) -> DataFrame:
    """(path, has: a boolean for each of ``words``) of files (path): whether their bytes have it, read piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = max(map(len, words)) - 1
        for batch in batches:
            paths = batch.column(0).to_pylist()
            out = []
            for path in paths:
                has, tail = [False] * len(words), b""
                with opened(path) as raw:
                    while not all(has) and (piece := raw.read(PIECE)):
                        data = tail + piece
                        has = [h or w in data for h, w in zip(has, words)]
                        tail = data[-keep:]
                out.append(has)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.list_(pa.bool_()))], ["path", "has"])

    return files.select("path").mapInArrow(run, "path string, has array<boolean>")


# --- ZIP ---------------------------------------------------------------------


class _Ranges(io.RawIOBase):
    """A file of any store as Python's own: a place before its start is an OSError."""

    def __init__(self, path: str):
        self.raw = opened(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, room: Any) -> int:
        return self.raw.readinto(room)

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, to: int, whence: int = 0) -> int:
        to += (0, self.raw.tell(), self.raw.size())[whence] if whence else 0
        if to < 0:
            raise OSError("before the start of the file")
        self.raw.seek(to)
        return to

    def close(self) -> None:
        self.raw.close()
        super().close()


def _archive(path: str) -> io.BufferedReader:
    return io.BufferedReader(_Ranges(path), PIECE)


LISTING = "member string, bytes long, task long"


def zip_listing(spark: SparkSession, archive: str) -> DataFrame:
    """(member, bytes, task) of a ZIP archive's files, dealt to tasks of about MEMBERS compressed bytes. One task reads
    the central directory; a file that has none gives a row without member."""
    share = MEMBERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64())
        for _ in batches:
            try:
                with _archive(archive) as raw, zipfile.ZipFile(raw) as z:
                    rows, total = [], 0
                    for i in z.infolist():
                        if not i.is_dir():
                            rows.append((i.filename, i.file_size, total // share))
                            total += i.compress_size
            except zipfile.BadZipFile:
                rows = [(None, None, None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["member", "bytes", "task"])

    return spark.range(1).coalesce(1).mapInArrow(run, LISTING)


def outside(member: str) -> bool:
    """Whether a member's name leads out of the folder that it is unpacked to."""
    base = "/base"
    return os.path.commonpath([base, os.path.normpath(os.path.join(base, member))]) != base


def _dealt(listing: DataFrame) -> DataFrame:
    n = listing.agg(F.max("task")).first()[0]
    return listing.repartition(max(1, min((n or 0) + 1, 10_000)), "task").sortWithinPartitions("task", "member")


def zip_members(spark: SparkSession, archive: str, listing: DataFrame | None = None, most: int = MOST_CONTENT) -> DataFrame:
    """(member, bytes, content, error) of an archive's files. A member outside of the archive's folder, of over ``most``
    bytes, or whose content doesn't have its check sum has an error and no content."""
    listing = zip_listing(spark, archive) if listing is None else listing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["member", "bytes", "content", "error"]
        for batch in batches:
            with _archive(archive) as raw, zipfile.ZipFile(raw) as z:
                for member, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    content, error = None, None
                    if outside(member):
                        error = "outside of its folder"
                    elif size > most:
                        error = "too large"
                    else:
                        try:
                            content = z.read(member)
                        except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, OSError) as e:
                            error = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((member, size, content, error), (pa.string(), pa.int64(), pa.binary(), pa.string()))], names)

    return _dealt(listing.where("member is not null")).mapInArrow(run, "member string, bytes long, content binary, error string")


def unzipped(spark: SparkSession, archive: str, folder: str, listing: DataFrame | None = None) -> DataFrame:
    """(member, written, error): writes an archive's files below ``folder``, each in pieces and by one task; those with an error are
    left out."""
    listing = zip_listing(spark, archive) if listing is None else listing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            with _archive(archive) as raw, zipfile.ZipFile(raw) as z:
                for member in batch.column(0).to_pylist():
                    rows.append((member, *_unzip(z, member, folder)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["member", "written", "error"])

    return _dealt(listing.where("member is not null")).mapInArrow(run, "member string, written long, error string")


def _unzip(z: zipfile.ZipFile, member: str, folder: str) -> tuple[int, str | None]:
    if outside(member):
        return 0, "outside of its folder"
    fs, name = _place(f"{folder.rstrip('/')}/{os.path.normpath(member)}")
    fs.create_dir(os.path.dirname(name), recursive=True)
    n, error = 0, None
    with fs.open_output_stream(name, compression=None) as out:
        try:
            with z.open(member) as part:
                while piece := part.read(PIECE):
                    out.write(piece)
                    n += len(piece)
        except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError, OSError) as e:
            error = f"{type(e).__name__}: {e}"
    if error:
        fs.delete_file(name)
    return n, error
