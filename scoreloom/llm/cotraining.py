"""Quality classifier by co-training.

Two views see different things: the content view the text (presence of hashed
words, and shares of character classes), the metadata view what comes with the
page (language, source, size). Each round, both fit a logistic regression on the
labelled rows and the pseudo-labels received so far; each then scores all unlabelled
documents on the executors and hands the most confident of either class, over the
whole corpus, to the other. At the end each view is calibrated on held-out labelled
rows, and a logistic combination of the calibrated views, fitted on other held-out
rows, scores all documents.

A document is good if its label says quality 1 and toxic 0. Fitting is bounded: at
most ``most_labels`` labelled documents, those with the smallest hash of doc_id, and
at most ``exchange`` pseudo-labels a view and round. With labels of one class
alone, every score is the smoothed share of good labels. Null text is empty, null
language or source is a value of its own. Labels that repeat a doc_id count once
(the largest); repeated documents each get a score, and the text of the smallest hash
serves for fitting. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import U64

BITS, META_BITS = 18, 12
RIDGE, SIGMAS = 1e-4, 3.5
SHARES = 7  # symbols, capitals, digits, punctuation, word length, repeated words, runs of a word
LEVELS = 16  # a share enters the model by its level on a logarithmic scale
FEATURES = "doc_id long, words array<int>, shares array<float>, meta array<int>"

_KIND = np.zeros((4, 256), bool)
_KIND[0, [ord(c) for c in "#*$%&|<>"]] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, [ord(c) for c in ".,;:!?\"'()"]] = True
PUNCTUATION = C.SPACE | _KIND[0] | _KIND[3]


def content(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row: distinct hashed words, and the shares."""
    low = C.LOWER[data]
    s, e, at = C.words(low, off, PUNCTUATION)
    col = (C.span_hash(low, s, e) >> U64(64 - BITS)).astype(np.int64)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    key = np.unique(row << BITS | col)
    cut = np.searchsorted(key >> BITS, np.arange(len(n) + 1))
    size = np.maximum(np.diff(off), 1)
    shares = np.zeros((len(n), SHARES), np.float32)
    for k in range(4):
        total = np.r_[0, np.cumsum(_KIND[k][data])]
        shares[:, k] = (total[off[1:]] - total[off[:-1]]) / size
    shares[:, 4] = np.minimum(size / np.maximum(n, 1), 40) / 40
    shares[:, 5] = 1 - np.diff(cut) / np.maximum(n, 1)
    again = np.zeros(len(col), bool)
    again[1:] = (col[1:] == col[:-1]) & (row[1:] == row[:-1])
    shares[:, 6] = np.bincount(row[again], minlength=len(n)) / np.maximum(n, 1)
    return [(key[a:z] & ((1 << BITS) - 1)).astype(np.int32) for a, z in zip(cut, cut[1:], strict=False)], shares


def _bin(*parts: object) -> int:
    h = C.mix(np.array([2], U64))
    for b in "\0".join(map(str, parts)).encode():
        h = C.mix(h * U64(31) + U64(b))
    return int(h[0] >> U64(64 - META_BITS))


def metadata(lang: list, source: list, size: np.ndarray, known: dict) -> list[list[int]]:
    """Hashed language, source, both together and size class of each row."""
    out = []
    for l, s, n in zip(lang, source, np.log2(size + 1).astype(int).tolist(), strict=True):
        key = (l, s, n)
        if key not in known:
            if len(known) > 100_000:
                known.clear()
            known[key] = [_bin("lang", l), _bin("source", s), _bin("both", l, s), _bin("size", n)]
        out.append(known[key])
    return out


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for rows, data, off in C.slices(batches):
            w, shares = content(data, off)
            meta = metadata(rows.column(2).to_pylist(), rows.column(3).to_pylist(), np.diff(off), known)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(w, pa.list_(pa.int32())), pa.array(list(shares), pa.list_(pa.float32())), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "words", "shares", "meta"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(C.lean(run), FEATURES)


# ------------------------------------------------------------------- models


@dataclass
class Sparse:
    """Rows of columns with values, without a row loop."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    rows: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.rows)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], width)

    def take(self, pick: np.ndarray) -> Sparse:
        new = np.full(self.rows, -1)
        new[pick] = np.arange(len(pick))
        keep = new[self.row] >= 0
        return Sparse(new[self.row[keep]], self.col[keep], self.val[keep], len(pick))


def content_matrix(words: list[np.ndarray], shares: np.ndarray) -> Sparse:
    n = np.array([len(w) for w in words], np.int64)
    rows = len(words)
    level = np.clip(np.log2(shares * 1024 + 1) * 1.4, 0, LEVELS - 1).astype(np.int64)
    level += (1 << BITS) + LEVELS * np.arange(SHARES)
    level = np.hstack([level, np.full((rows, 1), CONTENT_WIDTH - 1)])
    row = np.r_[np.repeat(np.arange(rows), n), np.repeat(np.arange(rows), SHARES + 1)]
    col = np.r_[np.concatenate(words) if rows else np.zeros(0, np.int64), level.ravel()]
    return Sparse(row.astype(np.int64), col.astype(np.int64), np.ones(len(col), np.float32), rows)


def meta_matrix(meta: np.ndarray) -> Sparse:
    rows, k = meta.shape
    full = np.hstack([meta, np.full((rows, 1), 1 << META_BITS)])
    return Sparse(np.repeat(np.arange(rows), k + 1), full.ravel().astype(np.int64), np.ones(full.size, np.float32), rows)


CONTENT_WIDTH, META_WIDTH = (1 << BITS) + SHARES * LEVELS + 1, (1 << META_BITS) + 1


def telling(x: Sparse, y: np.ndarray, width: int, sigmas: float, always: int) -> np.ndarray:
    """Columns whose rows hold more or fewer good labels than chance gives, by ``sigmas`` standard deviations; from ``always`` on all."""
    n, good, share = np.bincount(x.col, minlength=width), x.back(y, width), y.mean()
    z = (good - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 0.25))
    return (np.abs(z) >= sigmas) | (np.arange(width) >= always)


def fit(x: Sparse, y: np.ndarray, width: int, ridge: float, steps: int = 150, rate: float = 0.1, sigmas: float = 0.0, always: int = 0) -> np.ndarray:
    """Logistic regression on the telling columns: full-batch Adam, squared penalty."""
    live = telling(x, y, width, sigmas, always)
    keep = live[x.col]
    x = Sparse(x.row[keep], x.col[keep], x.val[keep], x.rows)
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))
        g = (x.back(p - y, width) / len(y) + ridge * w) * live
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def stack(z: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of the columns of z and a constant, last: a small penalized logistic fit by Newton steps."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(min(steps, 50)):
        p = logistic(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Both views, their calibrations and the combination."""

    content: np.ndarray
    meta: np.ndarray
    calibrations: np.ndarray  # slope and constant of either view
    combine: np.ndarray
    prior: float

    def scores(self, words: list[np.ndarray], shares: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: content, metadata, combined."""
        z = np.stack([content_matrix(words, shares).dot(self.content), meta_matrix(meta).dot(self.meta)], 1)
        z = z * self.calibrations[:, 0] + self.calibrations[:, 1]
        return np.column_stack([logistic(z), logistic(z @ self.combine[:-1] + self.combine[-1])])


@dataclass
class Rows:
    """Features of documents on the driver."""

    ids: np.ndarray
    words: list[np.ndarray]
    shares: np.ndarray
    meta: np.ndarray

    def take(self, pick: np.ndarray) -> Rows:
        at = np.flatnonzero(pick) if pick.dtype == bool else pick
        return Rows(self.ids[at], [self.words[i] for i in at.tolist()], self.shares[at], self.meta[at])

    def view(self, k: int) -> Sparse:
        return meta_matrix(self.meta) if k else content_matrix(self.words, self.shares)

    @classmethod
    def join(cls, parts: list[Rows]) -> Rows:
        return cls(np.concatenate([p.ids for p in parts]), [w for p in parts for w in p.words], np.concatenate([p.shares for p in parts]), np.concatenate([p.meta for p in parts]))


def gather(docs: DataFrame, chosen: DataFrame) -> tuple[Rows, pa.Table]:
    """Features of the documents in ``chosen`` (bounded, unique doc_id), and its rows in their order."""
    used = docs.select("doc_id", "text", "lang", "source").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    one = used.groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "source"), F.struct(F.xxhash64("text"), "lang", "source")).alias("x")).select("doc_id", "x.*")
    got = features(one).join(F.broadcast(chosen), "doc_id").toArrow().sort_by("doc_id")
    return Rows(got.column("doc_id").to_numpy(), *unpack(got)), got


VIEWS = ((CONTENT_WIDTH, SIGMAS, 1 << BITS), (META_WIDTH, 0.0, 0))


def train(docs: DataFrame, labels: DataFrame, *, most_labels: int = 8000, exchange: int = 800, rounds: int = 3, sure: float = 0.95, hold: float = 0.3) -> Model:
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int") * (F.coalesce("toxic", F.lit(0)) != 1).cast("int")).alias("good"))
    own = C.materialize(own, "labels")
    picked = C.materialize(own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels), "labelled")
    rows, got = gather(docs, picked)
    y = got.column("good").to_numpy().astype(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    place = C.mix(rows.ids.astype(U64) + U64(77)) / 2.0**64
    held, apart = place < hold / 2, (place >= hold / 2) & (place < hold)  # for calibration, and for the combination
    own_part = ~held & ~apart
    if any(len(set(y[part].tolist())) < 2 for part in (own_part, held | apart)):
        odds = float(np.log(prior / (1 - prior)))
        return Model(np.zeros(CONTENT_WIDTH), np.zeros(META_WIDTH), np.array([[0, odds], [0, odds]]), np.array([0.5, 0.5, 0]), prior)
    if any(len(set(y[part].tolist())) < 2 for part in (held, apart)):
        held = apart = held | apart  # too few to part
    received: list[list[tuple[Rows, np.ndarray]]] = [[], []]  # pseudo-labels that each view has got
    for i in range(rounds + 1):
        weights = []
        for k, (width, sigmas, always) in enumerate(VIEWS):
            fit_on = Rows.join([rows.take(own_part), *(r for r, _ in received[k])])
            weights.append(fit(fit_on.view(k), np.concatenate([y[own_part], *(v for _, v in received[k])]), width, RIDGE, sigmas=sigmas, always=always))
        cal = np.array([stack(rows.take(held).view(k).dot(weights[k])[:, None], y[held]) for k in (0, 1)])
        model = Model(weights[0], weights[1], cal, np.array([0.5, 0.5, 0]), prior)
        if i == rounds:
            break
        scored = C.materialize(score(docs, model).select("doc_id", "p_content", "p_metadata").where("doc_id is not null").join(own, "doc_id", "left_anti"), "views")
        for k, column in enumerate(("p_content", "p_metadata")):
            known = [int(x) for r, _ in received[1 - k] for x in r.ids]
            asked = []
            for label, sure_of in ((1, F.col(column)), (0, 1 - F.col(column))):
                # of each class as many as its share among the labels asks for; a distributed top-n
                n = max(1, int(exchange * (prior if label else 1 - prior)))
                best = scored.where((sure_of >= sure) & ~F.col("doc_id").isin(known)).orderBy(sure_of.desc(), "doc_id").limit(n)
                asked.append(best.select("doc_id", F.lit(label).alias("good")))
            chosen = C.materialize(asked[0].unionAll(asked[1]).groupBy("doc_id").agg(F.min("good").alias("good")), "chosen")
            more, got = gather(docs, chosen)
            if len(more.ids):
                received[1 - k].append((more, got.column("good").to_numpy().astype(float)))
    last = rows.take(apart)
    z = np.stack([last.view(k).dot(weights[k]) for k in (0, 1)], 1)
    model.combine = stack(z * cal[:, 0] + cal[:, 1], y[apart])
    return model


def unpack(got: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    words = [np.asarray(x.as_py(), np.int64) for x in got.column("words")]
    return words, np.array(got.column("shares").to_pylist(), np.float32).reshape(-1, SHARES), np.array(got.column("meta").to_pylist(), np.int64).reshape(-1, 4)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, p_content, p_metadata, p_good, kept."""
    model = Model(model.content.astype(np.float32), model.meta.astype(np.float32), model.calibrations, model.combine, model.prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for rows, data, off in C.slices(batches):
            w, shares = content(data, off)
            meta = np.array(metadata(rows.column(2).to_pylist(), rows.column(3).to_pylist(), np.diff(off), known), np.int64)
            p = model.scores(w, shares, meta)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] >= threshold)], ["doc_id", "p_content", "p_metadata", "p_good", "kept"])

    return docs.select("doc_id", "text", "lang", "source").mapInArrow(C.lean(run), "doc_id long, p_content double, p_metadata double, p_good double, kept boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return score(docs, train(docs, C.table(spark, sf_dir, "labels")))
