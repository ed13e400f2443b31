"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document becomes a vector of statistics of its whole text (sizes, shares of kinds of bytes,
word and line shapes, repetition), made near-normal by logarithms.  Per class, the labelled rows'
sums of values and of products are added up by Spark; the class covariance is shrunk towards the
pooled one and towards a multiple of the identity, and its Cholesky factor is computed once and
cached in the model.  A score is the logistic of the difference of the classes' log densities
(Mahalanobis distance through the factor, log determinant, log prior).

What reaches the driver is one row per class and entry of the product matrix, whatever the input's
size.  Defined cases: null text is empty; empty texts are scored like any other; labels that are
null or not 0/1 are ignored; no documents give an empty result; with learnt rows of one class only
every text gets the share of class 1 as its score (0 or 1); without any learnt row every score is 0.5
and ``keep_good``, which has no ground to reject a text, keeps all; several labels of one document all count; repeated documents are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairgate.llm.common import raw_texts, small_text_batches, stash

#: Kinds of bytes whose shares are statistics.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:",
    "shout": b"!?",
    "mark": b"#$%&*@^~",
    "bracket": b"()[]{}<>/\\|=_+\"'`-",
    "high": bytes(range(128, 256)),
}
NAMES = (
    *KINDS, "length", "words", "word_length", "word_spread", "new_words", "lines", "new_lines",
    "line_length", "ended", "new_word_length", "squeezed",
)
#: Bytes of text that are compressed at once for the redundancy statistic.
SQUEEZE = 1 << 14
_TABLE = np.full(256, len(KINDS), np.int64)
for _i, _k in enumerate(KINDS.values()):
    _TABLE[list(_k)] = _i
_ONE_HOT = np.eye(len(KINDS) + 1)[_TABLE]


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text."""
    size = len(text)
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _ONE_HOT
    shares = np.log((kinds[:-1] + 0.5) / (size + 20.0))
    words = text.split()
    n_words = len(words)
    lengths = np.fromiter(map(len, words), np.float64, n_words)
    mean = lengths.mean() if n_words else 0.0
    spread = lengths.std() if n_words else 0.0
    kept = dict.fromkeys(words, 0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = len(lines)
    new_lines = len(set(lines))
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines)
    new_length = np.fromiter(map(len, kept), np.float64, len(kept)).mean() if n_words else 0.0
    squeezed = sum(len(zlib.compress(text[i : i + SQUEEZE], 1)) for i in range(0, size, SQUEEZE))
    return [
        *shares,
        np.log1p(size),
        np.log1p(n_words),
        np.log1p(mean),
        np.log1p(spread),
        np.log((len(kept) + 0.5) / (n_words + 1.0)),
        np.log1p(n_lines),
        np.log((new_lines + 0.5) / (n_lines + 1.0)),
        np.log1p(size / (n_lines + 1.0)),
        np.log((ended + 0.5) / (n_lines + 1.0)),
        np.log1p(new_length),
        np.log((squeezed + 10.0) / (size + 20.0)),
    ]


@dataclass
class Discriminant:
    """Two Gaussians over standardised statistics; the factors are computed once, on construction."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    priors: np.ndarray
    factors: np.ndarray = field(init=False)
    constants: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        lower = np.linalg.cholesky(self.covariances)
        # Kept inverted: a distance is then one product per batch.
        self.factors = np.linalg.inv(lower)
        self.constants = np.log(self.priors) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1)

    def score(self, values: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        z = (values - self.centre) / self.scale
        density = [
            k - 0.5 * np.square((z - m) @ f.T).sum(axis=1)
            for m, f, k in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0], -500.0, 500.0)))


@dataclass
class Prior:
    """The same score for every text: there is nothing to tell two classes apart by."""

    value: float
    learnt: bool = True

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.full(len(values), self.value)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics): one row per document."""
    small_text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))],
                names=["doc_id", "statistics"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, statistics array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of a partition, the sums of products of (1, statistics)."""
    k = len(NAMES) + 1
    total = np.zeros((2, k, k))
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        x = np.ones((len(label), k))
        x[:, 1:] = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, k - 1)
        for c in (0, 1):
            total[c] += x[label == c].T @ x[label == c]
    c, i, j = (a.ravel() for a in np.indices(total.shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array(c), pa.array(i), pa.array(j), pa.array(total.ravel())], names=["c", "i", "j", "value"]
    )


def fit(labelled: DataFrame, pool: float = 0.1, ridge: float = 0.01) -> Discriminant | Prior:
    """Fit on (statistics, label).  A class covariance is ``1 - pool`` of its own and ``pool`` of the
    pooled one, then ``1 - ridge`` of that and ``ridge`` of its mean variance on the diagonal."""
    k = len(NAMES) + 1
    sums = np.zeros((2, k, k))
    parts = labelled.select("statistics", F.col("label").cast("long").alias("label")).where("label IN (0, 1)")
    entries = parts.mapInArrow(_moments, "c long, i long, j long, value double")
    for row in entries.groupBy("c", "i", "j").agg(F.sum("value").alias("value")).collect():
        sums[row.c, row.i, row.j] = row.value
    n = sums[:, 0, 0]
    if n.sum() < 1:
        return Prior(0.5, learnt=False)
    if n.min() < 1:
        return Prior(n[1] / n.sum())
    total = sums.sum(0)
    centre = total[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n.sum() - centre**2, 1e-12))
    means = (sums[:, 0, 1:] / n[:, None] - centre) / scale
    own = np.empty((2, k - 1, k - 1))
    for c in (0, 1):
        raw = sums[c, 1:, 1:] / n[c] - np.outer(sums[c, 0, 1:], sums[c, 0, 1:]) / n[c] ** 2
        own[c] = raw / np.outer(scale, scale)
    pooled = (own * (n / n.sum())[:, None, None]).sum(0)
    shrunk = (1 - pool) * own + pool * pooled
    width = np.trace(shrunk, axis1=1, axis2=2) / (k - 1)
    shrunk = (1 - ridge) * shrunk + ridge * np.maximum(width, 1e-6)[:, None, None] * np.eye(k - 1)
    return Discriminant(centre, scale, means, shrunk, n / n.sum())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit_labels(values: DataFrame, labels: DataFrame, label_col: str = "quality") -> Discriminant | Prior:
    known = labels.select("doc_id", F.col(label_col).alias("label")).where("label IN (0, 1)")
    return fit(values.where(~held_out(F.col("doc_id"))).join(known, "doc_id"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    values = stash(document_statistics(docs))
    model = fit_labels(values, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("statistics").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"]
            )

    scored = values.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` predicted good, all columns.  Rows are judged where they are scanned,
    so nothing is joined back; the statistics are computed once to fit and once to judge."""
    model = fit_labels(document_statistics(docs), labels)
    if isinstance(model, Prior) and not model.learnt:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            x = np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
