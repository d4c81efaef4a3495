"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Texts become hashed counts of letter n-grams (1 to 3 bytes of the lower-cased UTF-8 text, other characters
as blanks), damped, weighted by inverse document frequency and scaled to length one. Each language has
several centroids from spherical k-means; the nearest by cosine names the language. A text farther from its
nearest centroid than nearly all of that centroid's own training texts is marked ``rejected``.

Document frequencies count all training documents. Centroids are fitted on at most about ``SAMPLE``
documents a language, chosen by a hash of their ids (all of them where there are fewer).

Nulls: a null text, or one without letters, is ``und`` with score 0; rows with null lang or id teach nothing.
Empty tables give empty results; without training rows every text is ``und``. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import drawn, fold

DIMS = 4096
SAMPLE = 300
CENTROIDS = 3
ROUNDS = 12
#: Share of a centroid's training texts that may lie beyond its rejection distance.
OUTSIDE = 0.005
_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.random.default_rng(7).integers(0, 1 << 32, size=(3, 256), dtype=np.uint32)
_SLICE = 1 << 20


def ngram_counts(text: str, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams; works in slices, so long texts take no more memory."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEEP) + b" ", dtype=np.uint8)
    total = np.zeros(dims, dtype=np.int64)
    shift = np.uint32(32 - dims.bit_length() + 1)
    for lo in range(0, len(raw), _SLICE):
        part = raw[lo : lo + _SLICE + 2]  # two bytes more, for the n-grams that start in this slice
        one = _MIX[0][part]
        two = one[:-1] ^ _MIX[1][part[1:]]
        three = two[:-1] ^ _MIX[2][part[2:]]
        letters = one[:_SLICE][part[:_SLICE] != 32]
        for codes, factor in ((letters, 2654435761), (two[:_SLICE], 2246822519), (three[:_SLICE], 3266489917)):
            total += np.bincount((codes * np.uint32(factor)) >> shift, minlength=dims)
    return total


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted rows of length one."""
    rows = np.log1p(counts).astype(np.float32) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _document_frequency(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with letters, and of texts each dimension occurs in."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(DIMS, dtype=np.int64), 0
        for frame in parts:
            for text in frame["text"]:
                if has_letter(text):
                    seen += ngram_counts(text) > 0
                    n += 1
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.concatenate([[n], seen])})

    rows = docs.select("text").mapInPandas(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows
    got = {r["dim"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(DIMS)])


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-point starts; fewer centroids if the rows are fewer."""
    picked = [int(np.argmax(rows @ rows.mean(axis=0)))]
    while len(picked) < min(k, len(rows)):
        picked.append(int(np.argmin((rows @ rows[picked].T).max(axis=1))))
    centres = rows[picked]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    """Centroids with their languages, rejection cosines and term weights."""

    def __init__(self, idf: np.ndarray, names: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.names, self.centres, self.least = idf, names, centres, least

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            if not self.names or not has_letter(text):
                out.append(("und", 0.0, True))
                continue
            cosine = self.centres @ weigh(ngram_counts(text), self.idf)
            j = int(np.argmax(cosine))
            out.append((self.names[j], float(np.clip(cosine[j], 0, 1)), bool(cosine[j] < self.least[j])))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])


def fit(training: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from ``training(doc_id, text, lang)``; rows without lang are left out."""
    rows = training.where("lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    n, seen = _document_frequency(rows)
    idf = (np.log((1 + n) / (1 + seen)) + 0.05).astype(np.float32)
    # a share of each language by hash: the expected number of rows is the bound
    share = F.lit(False)
    for lang, size in sizes.items():
        share = share | ((F.col("lang") == lang) & drawn("doc_id", sample, size))

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            frame = frame[[has_letter(t) for t in frame["text"]]]
            yield pd.DataFrame({"lang": frame["lang"], "v": [weigh(ngram_counts(t), idf).astype(np.float16).tobytes() for t in frame["text"]]})

    sampled = rows.where(share).select("lang", "text").mapInPandas(vectors, "lang string, v binary").collect() if sizes else []
    names, centres, least = [], [], []
    for lang in sorted({r["lang"] for r in sampled}):
        own = np.stack([np.frombuffer(r["v"], dtype=np.float16).astype(np.float32) for r in sorted((r for r in sampled if r["lang"] == lang), key=lambda r: bytes(r["v"]))])
        middle = cluster(own, k)
        cosine = own @ middle.T
        nearest = np.argmax(cosine, axis=1)
        for j in range(len(middle)):
            mine = cosine[nearest == j, j]
            names.append(lang)
            least.append(np.quantile(mine, OUTSIDE) if len(mine) else 0.0)
        centres.append(middle)
    return Model(idf, names, np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32), np.array(least))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield shared.value.predict(texts)

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


def identify_all(docs: DataFrame) -> DataFrame:
    """Fit on the documents outside the held-out fold, then identify all."""
    part = fold("doc_id", 3)
    model = fit(docs.where(part != 1).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
