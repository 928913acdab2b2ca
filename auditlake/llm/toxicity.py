"""Toxic passages by maximum-scoring segments.

Learning: for words and their first 5 and 4 bytes, the number of toxic and of
clean documents that hold them gives log-odds under an informative Dirichlet
prior (the token's share of all, of mass PRIOR). Tokens whose log-odds are
Z standard errors from 0 make the model. A word
scores by the most specific of its three tokens that the model has, less DRIFT;
a word that repeats the one before it is neutral.

Scan: one linear pass finds all maximal scoring segments of a document (after
Ruzzo and Tompa); passages of neutral words end a segment by their drift.

Calibration: scores of clean text make segments whose maxima follow an
extreme-value law, P(max >= s) = 1 - exp(-K n exp(-lambda s)) for n words. lambda
solves sum p(s) exp(lambda s) = 1, K follows from the mean of the maxima. A document's
evidence is the sum of lambda s - ln(K n) over its significant segments (or the
best one's), and a logistic curve fitted on documents kept out of the counts turns
it into a score.

Learning takes about LABELLED labelled rows, drawn by hash, which bounds the model too; of each
class three quarters are counted and one quarter calibrates. A class of one row has none to
calibrate with; then the counted rows do. All documents are scored over their whole texts.

Null and empty texts have no words and the score of a document without evidence.
Repeated rows give a row each; other columns are not read. Without toxic or
without clean labels every score is the share of toxic ones, kept under 0.5 unless
all labels are toxic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import U64, hash_words, table, text_bytes, text_chunks

LABELLED = 20_000
PRIOR, Z = 0.02, 1.96
DRIFT, CLIP = 0.3, 6.0
#: Evidence outside of it counts as at its ends.
RANGE = (-10.0, 15.0)
#: Expected number of chance segments under which a passage is significant.
EXPECT = 0.05
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(3, words) hashes: word, first 5 bytes, first 4 bytes; and offsets of texts."""
    words, at, five, four = hash_words(*text_bytes(column), _INSIDE, (5, 4))
    return np.stack([words, five, four]), at


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time."""
    total, segs = 0.0, []  # of each: start, end, sum before it, sum at its end
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = k, before
        while True:
            j = len(segs) - 1
            while j >= 0 and segs[j][2] >= low:
                j = segs[j][4]
            if j < 0 or segs[j][3] >= total:
                segs.append((start, k + 1, low, total, j))
                break
            start, low = segs[j][0], segs[j][2]
            del segs[j:]
    return [(a, b, r - l) for a, b, l, r, _ in segs]


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    values: np.ndarray  # their log-odds
    lam: float
    k: float
    slope: float
    shift: float
    constant: float | None = None  # the score of all, where nothing can be learned

    def word_scores(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(tokens.shape[1])
        if not len(self.keys):
            return out - DRIFT
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.keys >> U64(44)).astype(np.int64)] = True
        for level in (2, 1, 0):
            hit = np.flatnonzero(maybe[(tokens[level] >> U64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, tokens[level][hit]), len(self.keys) - 1)
            same = self.keys[place] == tokens[level][hit]
            out[hit[same]] = self.values[place[same]]
        again = np.zeros(len(out), bool)
        again[1:] = tokens[0][1:] == tokens[0][:-1]
        again[at[:-1][at[:-1] < len(out)]] = False
        return np.where(again, 0.0, np.clip(out, -CLIP, CLIP)) - DRIFT

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximal segments of one document; runs between positive words are one step each."""
        up = np.flatnonzero(scores > 0)
        if not len(up):
            return []
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        edges = np.empty(2 * len(up), np.int64)
        edges[0::2], edges[1::2] = up, up + 1
        steps = np.diff(sums[np.concatenate([[0], edges])])
        steps[0::2] = np.minimum(steps[0::2], 0)
        place = edges.tolist()
        # step 2j leads to the j-th positive word, step 2j + 1 is that word
        return [(place[a - 1] if a else 0, place[b - 1], s) for a, b, s in maximal_segments(steps.tolist())]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's evidence and its significant segments."""
        if not n:
            return -10.0, []
        base = math.log(max(1e-9, self.k * n))
        each = [(self.lam * s - base, (a, b, s)) for a, b, s in segments]
        strong = [(e, x) for e, x in each if e >= -math.log(EXPECT)]
        if strong:
            return sum(e for e, _ in strong), [x for _, x in strong]
        return max([-10.0, *(e for e, _ in each)]), []

    def score(self, evidence: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-self.slope * min(RANGE[1], max(RANGE[0], evidence)) - self.shift))


def _score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """(id, score, evidence, passages) of (id, text) rows; passages in words."""
    kind = docs.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch):
                tokens, at = tokens_of(part.column("text"))
                scores = m.word_scores(tokens, at)
                positive = np.concatenate([[0], np.cumsum(scores > 0)])
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    found = m.segments(scores[a:b]) if positive[b] > positive[a] else []
                    e, strong = m.evidence(found, b - a)
                    out.append((m.score(e), e, [{"start": x, "end": y, "score": s} for x, y, s in strong]))
                score, evidence, passages = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(score, pa.float64()), pa.array(evidence, pa.float64()), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    ["id", "score", "evidence", "passages"],
                )

    return docs.mapInArrow(run, f"id {kind}, score double, evidence double, passages array<struct<start:int,end:int,score:double>>")


def _document_counts(rows: DataFrame) -> DataFrame:
    """(token, a, b): toxic and clean documents of (text, toxic) rows that hold each token."""

    def run(batches):
        for batch in batches:
            for part in text_chunks(batch):
                tokens, at = tokens_of(part.column("text"))
                toxic = np.asarray(part.column("toxic")).astype(bool)
                seen = [np.unique(tokens[:, a:b]) for a, b in zip(at[:-1], at[1:])]
                if not seen:
                    continue
                flat = np.concatenate(seen)
                mark = np.repeat(toxic, [len(x) for x in seen])
                keys, place = np.unique(flat, return_inverse=True)
                a = np.bincount(place, mark, len(keys)).astype(np.int64)
                n = np.bincount(place, None, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(n - a)], ["token", "a", "b"])

    return rows.select("text", "toxic").mapInArrow(run, "token long, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, segments, scores, times) of (text, toxic) rows: the number of words, the scores
    of the segments, and which word scores there are how often."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch):
                tokens, at = tokens_of(part.column("text"))
                scores = m.word_scores(tokens, at)
                out = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    values, times = np.unique(np.round(scores[a:b], 3), return_counts=True)
                    out.append((b - a, [s for *_, s in m.segments(scores[a:b])], values.tolist(), times.tolist()))
                kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.bool_()), *columns], ["toxic", "n", "segments", "scores", "times"])

    return rows.select("text", F.col("toxic").cast("boolean").alias("toxic")).mapInArrow(run, "toxic boolean, n long, segments array<double>, scores array<double>, times array<long>")


def _evidence(measured: DataFrame, model: Model) -> DataFrame:
    """(toxic, evidence): two numbers of each measured row."""

    def run(batches):
        for batch in batches:
            found = zip(batch.column("segments").to_pylist(), batch.column("n").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([model.evidence([(0, 0, s) for s in x], n)[0] for x, n in found], pa.float64())], ["toxic", "evidence"])

    return measured.select("toxic", "segments", "n").mapInArrow(run, "toxic boolean, evidence double")


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    p = weights / weights.sum()
    f = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum()) - 1
    if (p * values).sum() >= 0 or values.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and shift by penalised Newton steps, each halved until it helps."""
    x = np.clip(x, *RANGE)
    w, design = np.array([0.5, 0.0]), np.stack([x, np.ones_like(x)], 1)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, design @ w).sum() - (y * (design @ w)).sum() + 0.05 * ((w[0] - 0.5) ** 2 + 0.01 * w[1] ** 2))

    for _ in range(100):
        p = 1 / (1 + np.exp(-(design @ w)))
        g = design.T @ (p - y) + np.array([0.1 * (w[0] - 0.5), 0.001 * w[1]])
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.1, 0.001])
        step, t, now = np.linalg.solve(h, g), 1.0, loss(w)
        while t > 1e-6 and loss(w - t * step) > now:
            t /= 2
        w = w - t * step
    return max(0.05, float(w[0])), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from documents with labels (doc_id, toxic 0/1), of at most LABELLED rows."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    h = F.xxhash64(F.lit(8), id_col).bitwiseAND((1 << 40) - 1)
    n = marked.count()
    share = min(1.0, LABELLED / max(1, n))
    # bounded: about LABELLED rows of a few numbers; a quarter is kept out, and of each class the row of
    # the least hash at least, while that of the largest is counted
    chosen = marked.where(h < int(share * (1 << 40))).withColumn("g", F.xxhash64(F.lit(8), id_col))
    ends = chosen.groupBy("toxic").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))  # a row for each class
    held = (F.col("g") == F.col("lo")) | (F.pmod(F.shiftright("g", 42), F.lit(4)) == 0)
    chosen = chosen.join(F.broadcast(ends), "toxic").select(id_col, "toxic", (held & (F.col("g") < F.col("hi"))).cast("int").alias("fold"))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").where("text is not null")
    counted = rows.where("fold = 0")
    tally = counted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n_toxic, n_clean = (sum(r["n"] for r in tally if bool(r["toxic"]) == side) for side in (True, False))
    none = np.zeros(0, U64), np.zeros(0)
    if not n_toxic or not n_clean:
        return Model(*none, 1.0, 1.0, 1.0, 0.0, 1.0 if n_toxic else 0.0)
    counts = _document_counts(counted).persist()
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    na, nb = float(total["a"]), float(total["b"])
    if not na or not nb:
        return Model(*none, 1.0, 1.0, 1.0, 0.0, min(0.49, n_toxic / (n_toxic + n_clean)))
    prior = (F.col("a") + F.col("b")) * PRIOR
    odds = F.log((F.col("a") + prior) / (na * (1 + PRIOR * (na + nb) / na) - F.col("a") - prior)) - F.log((F.col("b") + prior) / (nb * (1 + PRIOR * (na + nb) / nb) - F.col("b") - prior))
    z = odds / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior))
    kept = counts.withColumn("odds", odds).withColumn("z", z).where(F.abs("z") >= Z).select("token", "odds", "z").toArrow()
    counts.unpersist()
    keys = kept.column("token").to_numpy().astype(np.int64).view(U64)
    order = np.argsort(keys)
    # by a standard error nearer to 0: what few documents show counts less
    odds, z = kept.column("odds").to_numpy(), kept.column("z").to_numpy()
    values = odds - odds / z * np.sign(odds)
    model = Model(keys[order], values[order], 1.0, 1.0, 1.0, 0.0)

    # segments of the rows kept out, and the scores of their clean words: numbers, no texts
    held = rows.where("fold = 1")
    measured = _measured(held, model)
    if measured.select("toxic").distinct().count() < 2:
        measured = _measured(counted, model)
    measured = measured.persist()
    words = measured.where(~F.col("toxic")).select(F.explode(F.arrays_zip("scores", "times")).alias("x")).groupBy("x.scores").agg(F.sum("x.times").alias("times")).toArrow()
    if words.num_rows:
        model.lam = _lambda(words.column("scores").to_numpy(), words.column("times").to_numpy().astype(float))
    # the mean of the law is (ln(K n) + 0.5772) / lambda
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    k = measured.where("not toxic and n > 0").agg(F.avg(F.lit(model.lam) * best - 0.5772 - F.log("n"))).first()[0]
    if k is not None:
        model.k = float(np.clip(np.exp(k), 1e-6, 1.0))
    each = _evidence(measured, model).toArrow()
    measured.unpersist()
    toxic, evidence = each.column("toxic").to_numpy(zero_copy_only=False).astype(bool), each.column("evidence").to_numpy()
    model.slope, model.shift = _logistic(evidence, toxic.astype(float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, evidence, passages) of each row."""
    out = _score_rows(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), model)
    return out.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not predict to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in text_chunks(batch, text_col):
                tokens, at = tokens_of(part.column(text_col))
                scores = m.word_scores(tokens, at)
                clean = [m.score(m.evidence(m.segments(scores[a:b]), b - a)[0]) < 0.5 for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    out = toxicity(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "passages")
