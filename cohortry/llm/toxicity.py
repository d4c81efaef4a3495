"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a draw from all documents, whatever their label says, counts as
unlabelled text in which a share (the class prior) is toxic. The risk of a linear classifier is estimated
as ``prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))``: when the bracket turns negative, the step
goes back up instead, which is what keeps the estimate from overfitting.

Features are the distinct words of a text and their first four and five letters, hashed to ``DIMS``. The
``TERMS`` ones that tell positives from unlabelled text best enter the model. Fitting uses at most about
``POSITIVES`` toxic and ``UNLABELLED`` other documents, chosen by a hash of their ids.

Nulls: a null text is empty and scores like a text without any term. Null ids and labels teach nothing;
repeated labels of an id count by their largest. Without positives every score is 0. Empty tables give empty
results; repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortry.llm.common import drawn, fold, remembered

DIMS = 1 << 20
TERMS = 1500
POSITIVES = 3000
UNLABELLED = 9000
EPOCHS = 300
#: Price of a unit of weight; terms of a few copied documents are not worth it.
THRIFT = 0.0015
LEAST_WEIGHT = 0.1
#: Standard errors a term must stand out by; high because a million terms are tried.
LEAST_Z = 4.5
#: How far below zero the corrected part of the risk may go; covers the sampling error of the prior.
SLACK = 0.05
#: Words remembered at a time; more cost memory and save little, as most words of a corpus are rare.
_CACHE = 60_000
_EDGE = b".,;:!?#*$%&<>|\"'()[]-_"


class Terms:
    """Hashed features of a word, remembered per distinct word."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _make(self, word: bytes) -> tuple[int, ...]:
        if len(self.known) > _CACHE:
            self.known.clear()
        text = word.strip(_EDGE).decode("utf-8", "replace").lower()
        out = (zlib.crc32(text.encode("utf-8")) % DIMS,)
        for n in (4, 5):
            if len(text) > n:
                out += (zlib.crc32(f"{text[:n]}-".encode()) % DIMS,)
        self.known[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        words = set((text or "").encode("utf-8", "replace").split())
        known = self.known
        return np.fromiter({t for w in words for t in (known[w] if w in known else self._make(w))}, dtype=np.int32)


class Model:
    """Weights of the chosen terms; a term not chosen weighs nothing."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, bias: float):
        self.table = np.zeros(DIMS, dtype=np.float32)
        self.table[terms] = weights
        self.bias = bias

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.table[features].sum(dtype=np.float64) + self.bias, -40, 40))))


def choose_terms(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, limit: int = TERMS) -> np.ndarray:
    """Terms by how far their rate among positives exceeds their rate in unlabelled text, in standard errors.

    A term that only toxic text uses has in unlabelled text the prior's share of its rate among positives;
    terms of more than twice that share are left out.
    """
    a = np.bincount(np.concatenate(pos), minlength=DIMS) / len(pos)
    b = np.bincount(np.concatenate(unl), minlength=DIMS) / len(unl)
    z = (a - b) / np.sqrt(b * (1 - b) / len(pos) + 1.0 / len(pos) ** 2)
    best = np.argsort(-z, kind="stable")[:limit]
    return np.sort(best[(z[best] > LEAST_Z) & (b[best] <= 2 * prior * a[best] + 1.0 / len(unl))])


def _descend(sets: list[tuple[np.ndarray, np.ndarray, int]], n_terms: int, prior: float, thrift: float, epochs: int = EPOCHS, rate: float = 0.05, slack: float = SLACK) -> tuple[np.ndarray, float]:
    """Weights and bias of least risk; ``sets`` holds row, column and number of rows of positives and unlabelled."""
    w, bias = np.zeros(n_terms), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, epochs + 1):
        slopes, risks = [], []
        for row, col, n in sets:
            z = np.bincount(row, weights=w[col], minlength=n) + bias
            slope = 1 / (1 + np.exp(-np.clip(z, -40, 40))) / n  # of the mean loss for label -1; for label +1 it is one n-th less
            slopes.append((np.bincount(col, weights=slope[row], minlength=n_terms), slope.sum(), np.bincount(col, minlength=n_terms) / n))
            risks.append(np.logaddexp(0, z).mean())
        (gp, bp, mean), (gu, bu, _) = slopes
        if risks[1] - prior * risks[0] >= -slack:
            g, gb = gu - prior * mean, bu - prior
        else:  # the corrected part went below zero: climb back
            g, gb = -(gu - prior * gp), -(bu - prior * bp)
        g = g + thrift  # on weights that cannot be negative, a price on every term
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = np.maximum(0, w - rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        bias -= rate * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, bias


def nn_pu_fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, thrift: float = THRIFT) -> Model:
    """Linear model of least non-negative risk with the logistic loss.

    The chosen terms are evidence for toxicity only, so their weights stay at or above zero and a long clean
    text cannot outweigh what it says. A first descent with a price on weights leaves the terms worth
    having; a second one without the price sets their weights.
    """

    def matrix(rows: list[np.ndarray], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        column = np.full(DIMS, -1, dtype=np.int64)
        column[terms] = np.arange(len(terms))
        cols = [c[c >= 0] for c in (column[r] for r in rows)]
        return np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([*cols, np.zeros(0, np.int64)]), len(rows)

    terms = choose_terms(pos, unl, prior)
    w, _ = _descend([matrix(pos, terms), matrix(unl, terms)], len(terms), prior, thrift)
    terms = terms[w > LEAST_WEIGHT]
    w, bias = _descend([matrix(pos, terms), matrix(unl, terms)], len(terms), prior, 0.0)
    return Model(terms, w, bias)


def fit(texts: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from ``texts(doc_id, text)`` and the toxic rows of ``labels(doc_id, toxic)``; None without any."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    total = texts.where("doc_id is not null").count()
    sure = known.where("toxic > 0").where(drawn("doc_id", positives, toxic)).select("doc_id", F.lit(True).alias("sure"))
    marked = texts.where("doc_id is not null").join(F.broadcast(sure), "doc_id", "left")  # `sure` is bounded by `positives`
    marked = marked.withColumn("drawn", drawn("doc_id", unlabelled, total))
    chosen = marked.where(F.col("sure") | F.col("drawn"))

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered(("toxicity",))
        terms = Terms()
        for frame in parts:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype(str), "sure": frame["sure"].notna(), "drawn": frame["drawn"], "f": [np.sort(terms.of(t)).tobytes() for t in frame["text"]]})

    got = chosen.mapInPandas(features, "doc_id string, sure boolean, drawn boolean, f binary").collect()  # bounded by the two parameters
    got.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    pos = [np.frombuffer(r["f"], dtype=np.int32) for r in got if r["sure"]]
    unl = [np.frombuffer(r["f"], dtype=np.int32) for r in got if r["drawn"]]
    if not pos or not unl:
        return None
    return nn_pu_fit(pos, unl, toxic / n)


def score_column(spark, model: Model | None, text: str = "text") -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered(("toxicity",))
        terms, own = Terms(), shared.value
        for texts in parts:
            yield pd.Series([own.score(terms.of(t)) if own else 0.0 for t in texts], dtype="float64")

    return score(F.col(text))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold, then score every document."""
    model = fit(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text"), labels.where(fold("doc_id", 4) != 2))
    out = docs.select("doc_id", score_column(docs.sparkSession, model).alias("score"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows scored below ``least`` by a model fitted as in ``score_all``; all columns are kept."""
    model = fit(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text"), labels.where(fold("doc_id", 4) != 2))
    return docs.where(score_column(docs.sparkSession, model) < least)
