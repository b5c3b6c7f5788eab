"""Quality by ordinal regression: a cumulative-link model of graded ratings over hashed words.

A text's features are its distinct words, lower-cased and hashed into 2**BITS places, each with its tf dampened by
log(1 + count), and three shares: of words that repeat the word before, of characters that are neither letters nor blanks,
and of words that are only such characters.  One vector of weights w is shared by all grades; ordered thresholds t1 < t2 cut
its score: P(grade >= k) = logistic(score - t_k).  So a text gets its expected grade and the tail probability that selects.

Ratings: grade = quality + (1 - toxic), from 0 to 2.  Fitted by gradient steps with shrinkage on a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slim, texts

#: Bounds of the sample: rated texts, and bytes of one of them.
SAMPLE, TEXT_BYTES = 4000, 65_536
BITS, GRADES, STEPS, SHRINK, SPARSE = 16, 3, 300, 1.0, 0.1
#: Least number of sampled texts that hold a word which counts.
FEW = 5
SELECT = 0.7
_MARK = re.compile(rb"[^A-Za-z\x80-\xff\s]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TRIM = b".,;:!?\"'()[]#$%&*|"


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(_TRIM)
        at = self[word] = zlib.crc32(bare) & ((1 << BITS) - 1) if bare else 1 << BITS
        return at


def features(text: bytes, places: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, their values, and the three shares."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(3)
    at, n = np.unique(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), return_counts=True)
    bare, real = n[at == 1 << BITS].sum(), at < 1 << BITS
    again = sum(map(bytes.__eq__, words, words[1:]))
    return at[real], np.log1p(n[real]), np.array([again, len(_MARK.findall(text)) / 2, bare]) / len(words)


@dataclass
class Model:
    weights: np.ndarray
    shares: np.ndarray
    cuts: np.ndarray

    def tails(self, rows: list[tuple]) -> np.ndarray:
        """P(grade >= k) for k from 1, of each text."""
        score = np.array([self.weights[a] @ v + self.shares @ s for a, v, s in rows])
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -500, 500)))


@dataclass
class Data:
    """Sampled texts as one sparse matrix (places that few texts share left out), their shares and grades."""

    who: np.ndarray
    at: np.ndarray
    val: np.ndarray
    dense: np.ndarray
    grades: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], grades: np.ndarray) -> Data:
        who = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        at, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        ok = np.bincount(at, minlength=1 << BITS)[at] >= FEW
        return cls(who[ok], at[ok], val[ok], np.stack([r[2] for r in rows]), grades)


def loss(p: np.ndarray, data: Data, shrink: float = SHRINK) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with shrinkage, and its gradient.  `p`: weights, shares, first cut, log of the cuts' distance."""
    n, size, grades = len(data.grades), 1 << BITS, data.grades
    w, d, cuts = p[:size], p[size : size + 3], np.array([p[-2], p[-2] + np.exp(p[-1])])
    score = np.bincount(data.who, data.val * w[data.at], n) + data.dense @ d
    tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
    edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    slope, r = edge * (1 - edge), np.arange(n)
    prob = np.maximum(edge[r, grades] - edge[r, grades + 1], 1e-9)
    gs = -(slope[r, grades] - slope[r, grades + 1]) / prob / n  # by score
    g = np.empty_like(p)
    g[:size] = np.bincount(data.at, data.val * gs[data.who], size) + shrink * w / n
    g[size : size + 3] = data.dense.T @ gs + 0.1 * d / n
    gc = np.array([(((grades == k) * 1.0 - (grades == k - 1)) * slope[:, k] / prob).sum() for k in (1, 2)]) / n  # by cut
    g[-2], g[-1] = gc.sum(), gc[1] * np.exp(p[-1])
    return float(-np.log(prob).sum() / n + shrink * (w @ w) / 2 / n + 0.1 * (d @ d) / 2 / n), g


def fit(rows: list[tuple], grades: np.ndarray, steps: int = STEPS, shrink: float = SHRINK) -> Model:
    """Adam on the loss, the cuts kept in order by their logarithmic distance."""
    size, data = 1 << BITS, Data.of(rows, grades)
    p = np.zeros(size + 3 + GRADES - 1)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES)[:-1]) / len(rows), 0.01, 0.99)
    p[-2] = np.log(share[0] / (1 - share[0]))
    p[-1] = np.log(max(0.1, np.log(share[1] / (1 - share[1])) - p[-2]))
    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, data, shrink)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        p = p - 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        p[:size] = np.sign(p[:size]) * np.maximum(0, np.abs(p[:size]) - 0.1 * SPARSE)  # words that chance explains go to 0
    return Model(p[:size].copy(), p[size : size + 3].copy(), np.array([p[-2], p[-2] + np.exp(p[-1])]))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most SAMPLE rated texts, those of least hash; rows without id, rating or text, and texts over TEXT_BYTES, are none."""
    # an id that is rated twice has its least rating, one with several texts the text of least hash: reruns agree
    rated = slim(labels, "doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("r")).select("doc_id", "r.*")
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    fit_in = slim(docs, "doc_id", "text").where((F.octet_length("text") <= TEXT_BYTES) & (F.octet_length("text") > 0))
    grade = F.greatest(F.lit(0), F.least(F.lit(GRADES - 1), F.col("quality") + 1 - F.col("toxic"))).cast("int")
    # broadcast: SAMPLE rows at most
    got = fit_in.join(F.broadcast(rated), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first(grade).alias("grade"))
    rows = sorted(got.select("doc_id", "t.text", "grade").collect(), key=lambda r: r["doc_id"])
    return [r["text"].encode() for r in rows], np.array([r["grade"] for r in rows], np.int64)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_low and p_top (probabilities of grade 1 or more, and of 2), kept.

    A text that is null or has no words has no evidence: its grade is the thresholds' alone.  Without ratings every grade is
    as likely as the next, and all are kept.  Repeated rows stay.
    """
    got, grades = sample(docs, labels)
    places = _Places()
    model = fit([features(t, places) for t in got], grades) if len(got) else Model(np.zeros(1 << BITS), np.zeros(3), np.array([-np.log(2), -np.log(2) + 0.0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = _Places(), shared.value
        for batch in batches:
            p = m.tails([features(t, known) for t in texts(batch.column(1))]) if batch.num_rows else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(p[:, 1] >= SELECT)], names=["doc_id", "expected_grade", "p_low", "p_top", "kept"])

    schema = docs.select("doc_id").schema.add("expected_grade", "double").add("p_low", "double").add("p_top", "double").add("kept", "boolean")
    return arrow_map(slim(docs, "doc_id", "text"), run, schema)
