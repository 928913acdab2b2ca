"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds every substring of some labelled text.
A document is parsed against it from left to right into longest matches; a
language whose text shares long stretches with the document needs few phrases.
Phrases are normalised to bits a character, phrases * log2(size of the
language's text) / characters, and the language with the fewest wins (the first
by name on a tie). A phrase costs what a text of LEAST_SYMBOLS would make it cost where a language's
own text is shorter: a few letters must not make cheap phrases of every letter.

Symbols are the UTF-8 bytes of lower-cased letters, and one gap for any run of other
characters, so that scripts of any size are learned whole. The automaton is completed
to a table (state, symbol) -> (state, new phrase) over the bytes that its language has;
any other byte is a phrase of its own. Many blocks of BLOCK symbols step through the
table at once in NumPy. A block that isn't the first of its text is parsed from the start
of a phrase, then anew from the state in which the block before it ends, until both
parses meet; so the parse is that of the whole text.

Learning reads text and label of a bounded, hashed sample (SAMPLE_DOCS documents
a language, of each at most SAMPLE_CHARS characters from a place drawn by hash, in all SAMPLE_TOTAL symbols a
language, or fewer where all tables would take more than TABLE_BYTES: nothing is cut up to 18 languages of 30 different
bytes each, or 9 of 60); every document is predicted from its whole text alone. A label of which no sampled text has a
letter is no language. More than MOST_LANGS labels are an error: such a column holds something else.

Null texts and texts without a letter are `und` with score 0. Repeated rows give
a row each; other columns are not read. Without any learned language all are `und`.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import table, text_chunks

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 120, 8000, 60_000
#: Symbols of a text by whose number a phrase is normalised, at least.
LEAST_SYMBOLS = 4096
MOST_LANGS = 1000
#: Bytes of the tables of all languages, at most.
TABLE_BYTES = 256 << 20
BLOCK = 512
#: Symbols of one text that are parsed at once; a longer text goes on from the last state.
PIECE = 1 << 21
GAP = 0x20
UND = "und"


def suffix_automaton(symbols: np.ndarray, size: int) -> np.ndarray:
    """Transitions (state, symbol) -> state, -1 where there is none; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), size), -1, np.int64)
    for s, edges in enumerate(nxt):
        for c, t in edges.items():
            out[s, c] = t
    return out


@functools.cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; GAP for what is no letter."""
    out = np.full(0x110000, GAP, np.uint32)
    for u in range(0x110000):
        c = chr(u)
        if c.isalpha():
            out[u] = ord(c.lower()[0])
    return out


def symbols(text: str) -> np.ndarray:
    """The bytes of a text's letters and gaps."""
    s = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    gap = s == GAP
    if len(s):
        gap[1:] &= s[:-1] == GAP
        gap[0] = False
    return np.frombuffer(s[~gap].tobytes().decode("utf-32-le").encode(), np.uint8)


def _blocks(parsed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of one symbol or more cut into columns of BLOCK symbols, the symbols in each, and the text of each."""
    blocks = [-(-len(s) // BLOCK) for s in parsed]
    grid, used, at = np.zeros((sum(blocks), BLOCK), np.uint8), np.full(sum(blocks), BLOCK), 0
    for s, n in zip(parsed, blocks):
        grid[at : at + n].reshape(-1)[: len(s)] = s
        used[at + n - 1] = len(s) - (n - 1) * BLOCK
        at += n
    return np.ascontiguousarray(grid.T), used, np.repeat(np.arange(len(parsed)), blocks)


class CrossParser:
    """Tables of all languages."""

    def __init__(self, texts: dict[str, str]):
        parsed = {lang: symbols(texts[lang])[:SAMPLE_TOTAL] for lang in sorted(texts)}
        self.langs = [lang for lang, s in parsed.items() if (s != GAP).any()]
        self.classes, self.tables, self.starts, self.bits = [], [], [], []
        for lang in self.langs:
            s = parsed[lang]
            size = len(np.unique(s)) + 1
            # an automaton has at most two states a symbol; a row has four bytes a class
            s = s[: max(1, TABLE_BYTES // (8 * size * len(self.langs)))]
            # class 0: bytes that the language's text doesn't have
            known = np.unique(s)
            classes = np.zeros(256, np.uint8)
            classes[known] = np.arange(1, len(known) + 1)
            size = len(known) + 1
            t = suffix_automaton(classes[s], size)
            # one more state, where a phrase has just ended: whatever follows begins one. It is the
            # first of a text, and follows a symbol that the language's text doesn't have
            ended = len(t)
            t = np.concatenate([t, np.full((1, size), -1)])
            miss = t < 0
            go = np.where(miss, np.where(t[0] < 0, ended, t[0])[None, :], t)
            flat = ((go * size) << 1) | miss
            self.classes.append(classes)
            self.starts.append(ended * size)
            self.tables.append(flat.astype(np.int32).ravel())
            self.bits.append(math.log2(max(LEAST_SYMBOLS, len(s))))

    def _parse(self, k: int, grid: np.ndarray, used: np.ndarray, follows: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """New phrases in each column of ``grid`` (BLOCK, columns), of which the first ``used`` symbols count, for
        language k, and the last column's last state. ``follows``: whether a column goes on from the one before;
        the very first one begins at ``start``."""
        # columns by length, so that those that go on are the first ones
        order = np.argsort(-used, kind="stable")
        step, grid, used = self.tables[k], np.take(self.classes[k], grid[:, order]), used[order]
        place = np.argsort(order)
        before = place[order - 1]
        path = np.zeros(grid.shape, np.int32)
        began = np.full(len(order), self.starts[k], np.int32)
        began[place[0]] = start
        state = began.copy()
        for j, n in enumerate(np.searchsorted(-used, -np.arange(1, BLOCK + 1), side="right").tolist()):
            if not n:
                break
            path[j, :n] = v = step[state[:n] + grid[j, :n]]
            state[:n] = v >> 1
        follows = follows[order]
        while True:
            due = np.flatnonzero(follows & (state[before] != began))
            if not len(due):
                break
            began[due] = now = state[before[due]]
            for j in range(BLOCK):
                v = step[now + grid[j, due]]
                apart = (v ^ path[j, due]) > 1
                path[j, due] = v
                due, now = due[apart], v[apart] >> 1
                ends = used[due] == j + 1
                state[due[ends]] = now[ends]
                due, now = due[~ends], now[~ends]
                if not len(due):
                    break
        return (path & 1).sum(0)[place], int(state[place[-1]])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and the symbols of each."""
        parsed = [symbols(t) for t in texts]
        sizes = np.array([len(s) for s in parsed], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        short = np.flatnonzero((sizes > 0) & (sizes <= PIECE))
        if len(short):
            grid, used, owner = _blocks([parsed[i] for i in short])
            follows = np.concatenate([[False], owner[1:] == owner[:-1]])
            for k in range(len(self.langs)):
                np.add.at(out[:, k], short[owner], self._parse(k, grid, used, follows, self.starts[k])[0])
        for i in np.flatnonzero(sizes > PIECE):
            states = list(self.starts)
            for at in range(0, len(parsed[i]), PIECE):
                grid, used, owner = _blocks([parsed[i][at : at + PIECE]])
                for k in range(len(self.langs)):
                    n, states[k] = self._parse(k, grid, used, np.arange(len(owner)) > 0, states[k])
                    out[i, k] += n.sum()
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score in 0..1 and bits a character of each text."""
        letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        counts, sizes = self.phrases([t if ok else "" for t, ok in zip(texts, letters)])
        bits = counts * np.array(self.bits)[None, :] / np.maximum(1, sizes)[:, None]
        best = bits.argmin(1)
        low = bits[np.arange(len(texts)), best]
        weight = np.exp2(-8 * (bits - low[:, None]) / np.maximum(low, 1e-9)[:, None]).sum(1)
        return (
            [self.langs[b] if ok else UND for b, ok in zip(best, letters)],
            [float(s) if ok else 0.0 for s, ok in zip(1 / weight, letters)],
            [float(x) if ok else 0.0 for x, ok in zip(low, letters)],
        )


_PARSERS: dict[str, CrossParser] = {}


def parser(texts: dict[str, str]) -> CrossParser:
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).hexdigest()
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(texts)
    return _PARSERS[key]


def learning_texts(labelled: DataFrame) -> dict[str, str]:
    """A bounded sample of text by language from (doc_id, text, lang) rows.

    A share of each language's rows is drawn by hash, so that about SAMPLE_DOCS
    remain, of each SAMPLE_CHARS characters in a row; the smallest hashes are taken until SAMPLE_TOTAL characters."""
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in fit.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()}
    if not counts:
        return {}
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} labels")
    h = F.xxhash64(F.lit(11), "doc_id").bitwiseAND((1 << 40) - 1)
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 40)))])
    sample = (
        fit.withColumn("h", h)
        .where(F.col("h") <= F.try_element_at(limit, F.col("lang")))
        .select("lang", "h", "doc_id", F.substr("text", F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text"))
        .collect()
    )
    out: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"], str(r["doc_id"]), r["text"])):
        if sizes.get(r["lang"], 0) < SAMPLE_TOTAL:
            out.setdefault(r["lang"], []).append(r["text"])
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(r["text"])
    return {k: "\n".join(v)[:SAMPLE_TOTAL] for k, v in out.items()}


def detect_language(docs: DataFrame, learned: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_char) for each row; ``learned``: text by language."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches):
        p = parser(shared.value)
        for batch in batches:
            for part in text_chunks(batch):
                lang, score, bits = p.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                    ["doc_id", "lang_pred", "score", "bits_per_char"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, bits_per_char double"
    )


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    learned = learning_texts(docs.where(~held).select("doc_id", "text", "lang"))
    found = detect_language(docs, learned)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_char")
