"""Token counts by prefix dynamic programming.

A BPE encoding is the one sequence of pieces in which each two neighbours, taken
alone, encode to themselves. So the last piece of a prefix's encoding is found from
those of shorter prefixes: of the pieces that end there, the one that fits behind the
last piece of what is left. One pass over the characters stores the last piece and the
exact count of every prefix, count[i] = count[i - length of the piece] + 1; no text is
encoded, and counts, truncations and budgets are read off the table. Whether two
pieces fit is found by merging their few characters, once for each pair. A character
that the vocabulary lacks counts its UTF-8 bytes and fits to anything.

Where no piece holds two adjacent characters side by side, no merge crosses between
them, and the table starts anew there. For vocabularies whose pieces have the space mark
only in front and never a line feed, these cuts lie before each run of spaces and around each
line feed. The segments between repeat: the ends of their tables are remembered, as far as
MEMO_BYTES, and the tables of all new segments of a batch are made side by side in NumPy.
Other vocabularies have one table for the whole text.

Null texts count as empty: 0 bytes, 0 tokens. Empty texts have 0 tokens. Repeated
rows give one row each; columns other than the id and the text are not read. A text
without spaces of any length takes time and memory in proportion to it.
"""

from __future__ import annotations

import bisect
import itertools
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import U64, fmix, table, text_chunks

#: Bytes of remembered segments, about, in a worker; beyond them, that memory starts anew.
MEMO_BYTES = 128 << 20
#: Places of the table of pairs of pieces that were found to fit or not; a new pair takes an old one's place.
PAIRS = 1 << 21
#: Characters of a segment that is remembered, at most.
REMEMBERED = 64
#: Multipliers of the hash of a piece, by distance from its end.
_STEPS = np.cumprod(np.concatenate([[U64(1)], np.full(255, 0x9E3779B97F4A7C15, U64)]), dtype=U64)
_SEGMENT = re.compile(r" +[^ \n]*|[^ \n]+|\n")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(U64)


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes for one sentence-piece BPE model."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        real = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # pieces with spaces for the mark, as texts have them
        self.pieces = [model.id_to_piece(i).replace("▁", " ") for i in real]
        self.rank = dict(zip(self.pieces, map(model.get_score, real)))
        self.longest = max(map(len, self.pieces), default=1)
        self.by_segment = not any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces)
        # by size, sorted hashes of pieces and their numbers from 1; 0 is the start, the last one any unknown character
        self.unknown = len(self.pieces) + 1
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(p) for p in self.pieces}):
            numbers = np.array([k + 1 for k, p in enumerate(self.pieces) if len(p) == size], np.int32)
            codes = _codes("".join(self.pieces[k - 1] for k in numbers)).reshape(-1, size)
            h = fmix((codes * _STEPS[:size][::-1]).sum(1, dtype=U64))
            order, maybe = np.argsort(h), np.zeros(1 << 18, bool)
            maybe[(h >> U64(46)).astype(np.int64)] = True
            self.found[size] = h[order], numbers[order], maybe
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.memo: dict[str, int] = {}
        self.used = 0
        self.long: tuple[str, array] = ("", array("i", [0]))  # the last long segment's table
        probe = "a  b\n c\tﬁ 漢字 d "
        if self.count(probe) != len(model.encode(probe)) or model.decode(model.encode(probe)) != probe:
            raise ValueError("not a byte-fallback BPE model that keeps texts as they are")

    def _merged(self, text: str) -> list[str]:
        """The pieces of a few characters: the best-ranked pair is merged, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether two pieces (by number) encode to themselves."""
        key = before.astype(np.int64) << 32 | piece
        slot = (fmix(key.view(U64)) >> U64(43)).astype(np.int64) % PAIRS
        new = np.flatnonzero((self.pair_keys[slot] != key) & (before != self.unknown))
        if len(new):
            out = np.ones(len(key), bool)
            known = self.pair_keys[slot] == key
            out[known] = self.pair_fits[slot[known]]
            keys, where = np.unique(key[new], return_inverse=True)
            fits = np.empty(len(keys), bool)
            for k, x in enumerate(keys.tolist()):
                a, b = x >> 32, self.pieces[(x & 0xFFFFFFFF) - 1]
                fits[k] = self._merged(self.pieces[a - 1] + b) == [self.pieces[a - 1], b] if a else self._merged(b) == [b]
            out[new] = fits[where]
            self.pair_keys[slot[new]] = key[new]
            self.pair_fits[slot[new]] = out[new]
            return out
        return self.pair_fits[slot] | (before == self.unknown)

    def tables(self, segments: list[str]) -> list[np.ndarray]:
        """Of each segment the token counts of its prefixes, of one character and more. The i-th
        characters of all segments are taken in one step."""
        order = sorted(range(len(segments)), key=lambda k: -len(segments[k]))
        text = "".join(segments[k] for k in order)
        sizes = np.array([len(segments[k]) for k in order], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes, place = _codes(text), np.arange(len(text)) - np.repeat(starts, sizes)
        ends_with: dict[int, np.ndarray] = {}
        h = np.zeros(len(codes), U64)
        for size in range(1, min(self.longest, int(sizes.max(initial=0))) + 1):
            h[size - 1 :] += codes[: len(codes) - size + 1] * _STEPS[size - 1]
            if size in self.found:
                keys, numbers, maybe = self.found[size]
                mixed = fmix(h)
                at = np.flatnonzero((place >= size - 1) & maybe[(mixed >> U64(46)).astype(np.int64)])
                near = np.minimum(np.searchsorted(keys, mixed[at]), len(keys) - 1)
                hit = keys[near] == mixed[at]
                ends_with[size] = np.zeros(len(codes), np.int32)
                ends_with[size][at[hit]] = numbers[near[hit]]
        last, count = np.full(len(codes), self.unknown, np.int32), np.zeros(len(codes), np.int32)
        alive = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for i, n in enumerate(alive):
            todo = starts[:n] + i
            for size in sorted((x for x in ends_with if x <= i + 1), reverse=True):
                piece = ends_with[size][todo]
                at = np.flatnonzero(piece)
                if not len(at):
                    continue
                end, piece = todo[at], piece[at]
                ok = self._fit(last[end - size] if size <= i else np.zeros(len(end), np.int32), piece)
                end = end[ok]
                last[end], count[end] = piece[ok], 1 + (count[end - size] if size <= i else 0)
                left = np.ones(len(todo), bool)
                left[at[ok]] = False
                todo = todo[left]
                if not len(todo):
                    break
            if len(todo):
                c = codes[todo]
                wide = 1 + (c >= U64(0x80)).astype(np.int32) + (c >= U64(0x800)) + (c >= U64(0x10000))
                count[todo] = wide + (count[todo - 1] if i else 0)
        out: list[np.ndarray] = [count[:0]] * len(segments)
        for k, a, n in zip(order, starts.tolist(), sizes.tolist()):
            out[k] = count[a : a + n]
        return out

    def learn(self, segments: Iterable[str]) -> None:
        """Remembers the counts of those of these segments that are new."""
        memo = self.memo
        new = [s for s in {s for s in segments if s not in memo} if len(s) <= REMEMBERED]
        if not new:
            return
        self.used += sum(180 + len(s) for s in new)
        if self.used > MEMO_BYTES:
            self.memo, self.used = {}, 0
        self.memo.update(zip(new, (int(t[-1]) for t in self.tables(new))))

    def segment_table(self, text: str) -> list[int] | array:
        """Tokens of each prefix of one segment, of none first."""
        if len(text) <= REMEMBERED:
            return [0, *self.tables([text])[0].tolist()]
        if text == self.long[0]:
            return self.long[1]
        rank, n = self.rank, len(text)
        last, count, fits = [""] * (n + 1), array("i", bytes(4 * (n + 1))), {}
        for i in range(1, n + 1):
            for size in range(min(self.longest, i), 0, -1):
                piece = text[i - size : i]
                if piece in rank:
                    before = last[i - size]
                    ok = fits.get((before, piece))
                    if ok is None:
                        fits = {} if len(fits) > PAIRS else fits
                        ok = fits[before, piece] = self._merged(before + piece) == ([before, piece] if before else [piece])
                    if ok:
                        last[i], count[i] = piece, count[i - size] + 1
                        break
            else:
                count[i] = count[i - 1] + len(text[i - 1].encode("utf-8", "replace"))
        self.long = text, count
        return count

    def segments(self, text: str) -> tuple[list[str], list[int]]:
        """The segments of a text, with the added space in front, and their counts."""
        if not text:
            return [], []
        parts = self.split(text)
        counts = list(map(self.memo.get, parts))
        if None in counts:
            self.learn(parts)
            counts = [self.memo[s] if s in self.memo else self.segment_table(s)[-1] for s in parts]
        return parts, counts

    def split(self, text: str) -> list[str]:
        spaced = " " + text.replace("▁", " ") if text else ""
        return _SEGMENT.findall(spaced) if self.by_segment else [spaced]

    def count(self, text: str) -> int:
        return sum(self.segments(text)[1])

    def prefix_table(self, text: str) -> array:
        """The token count of each prefix of the text, of none first."""
        out, base = array("i"), 0
        for part in self.segments(text)[0]:
            t = self.segment_table(part)
            out.extend([base + x for x in t[1:]])
            base += t[-1]
        # the added space is a place of its own, and belongs to no prefix of the text
        return array("i", [0]) + out[1:]

    def prefix_counts(self, text: str) -> tuple[list[str], list[int], list[int]]:
        """The segments, their ends in characters of the text, and the token count of each such prefix."""
        parts, counts = self.segments(text)
        return parts, [e - 1 for e in itertools.accumulate(map(len, parts))], list(itertools.accumulate(counts))

    def prefix_count(self, text: str, end: int, stored: tuple[list[str], list[int], list[int]] | None = None) -> int:
        """Tokens of text[:end], from the stored counts and one segment's table."""
        if end <= 0 or not text:
            return 0
        parts, ends, sums = stored or self.prefix_counts(text)
        k = min(bisect.bisect_left(ends, end), len(ends) - 1)
        before = sums[k - 1] if k else 0
        return before + self.segment_table(parts[k])[min(end, len(text)) - (ends[k - 1] if k else -1)]

    def cut(self, text: str, budget: int, stored: tuple[list[str], list[int], list[int]] | None = None) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        parts, ends, sums = stored or self.prefix_counts(text)
        k = bisect.bisect_right(sums, budget)
        if k >= len(sums):
            return len(text)
        # a longer prefix may have fewer tokens, but sums never fall: later segments are over budget
        start, before, t = (ends[k - 1] if k else -1), (sums[k - 1] if k else 0), self.segment_table(parts[k])
        return max(0, start + next(e for e in range(len(t) - 1, -1, -1) if before + t[e] <= budget or start + e <= 0))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PrefixCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chars_in_budget) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(model_path)
        for batch in batches:
            for part in text_chunks(batch):
                n_bytes, n_tokens, fits = [], [], []
                texts = [t or "" for t in part.column("text").to_pylist()]
                c.learn(itertools.chain.from_iterable(map(c.split, texts)))
                for text in texts:
                    n_bytes.append(len(text.encode()))
                    stored = c.prefix_counts(text) if len(text) > budget else None
                    n = stored[2][-1] if stored else c.count(text)
                    n_tokens.append(n)
                    fits.append(len(text) if n <= budget else c.cut(text, budget, stored))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars_in_budget"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chars_in_budget long"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
