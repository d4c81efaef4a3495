"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Random indexing gives every word (hashed to one of ``VOCAB`` rows) a sparse ternary index vector; a word's
vector is the sum of the index vectors of its neighbours over the whole corpus plus its own. Sums are whole
numbers, so they add up to the same in any order. The vector table has a fixed size and is the only thing
that is sent to the tasks.

Each word also carries marks (its letter case and ending, and whether the word or the three words ending
here occurred before in the text); marks are tokens with index vectors of their own. A document is the mean
of its word vectors, the mean of its mark vectors, and the largest mark means over its lines. A network with
one hidden layer is trained in numpy on at most about ``SAMPLE`` labelled documents; its temperature is
then set on a fifth of them that training left out.

Nulls: a null text is empty and scored from zero vectors. Labels that are null, and ids that are null, teach
nothing; repeated labels of an id count by their largest. Without labels every score is 0.5. Empty tables
give empty results; repeated rows are scored each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortry.llm.common import drawn, fold, keep

VOCAB = 1 << 13
DIM = 24
NONZERO = 4
REACH = 2
SAMPLE = 6000
HIDDEN = 24
EPOCHS = 250
_CASES, _ENDS = 4, 6
#: case and ending of a word, word seen just before, three words seen before
MARKS = _CASES * _ENDS + 2
FEATURES = DIM * 3 + 2
_CACHE = 400_000
_END = re.compile(r"([!?]{2,}|[#*$%&<>^~]+)$")


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of every row: words, marks, and a last row for gaps."""
    rng = np.random.default_rng(11)
    n = VOCAB + MARKS + 1
    places = np.argsort(rng.random((n, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
    signs = rng.choice(np.array([-1.0, 1.0]), size=(n, NONZERO))
    signs[-1] = 0
    return places, signs


PLACES, SIGNS = _index_vectors()


def index_matrix() -> np.ndarray:
    out = np.zeros((len(PLACES), DIM))
    np.put_along_axis(out, PLACES, SIGNS, axis=1)
    return out


def shape(word: str) -> int:
    """Letter case times ending of a word."""
    case = 1 if word.istitle() else 2 if word.isupper() else 0 if word.islower() else 3
    tail = _END.search(word)
    end = (2 if tail[0][0] in "!?" else 3) if tail else 1 if word[-1:] in ".,;:!?" else 4 if not any(map(str.isalnum, word)) else 5 if any(map(str.isdigit, word)) else 0
    return case * _ENDS + end


class Lexicon:
    """Row and shape of every word, remembered per distinct word."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __missing(self, word: bytes) -> int:
        if len(self.known) > _CACHE:
            self.known.clear()
        text = word.decode("utf-8", "replace")
        bare = text.lower().strip(".,;:!?#*$%&<>|\"'()") or text
        code = (zlib.crc32(bare.encode("utf-8")) % VOCAB) * (_CASES * _ENDS) + shape(text)
        self.known[word] = code
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        known, missing = self.known, self.__missing
        return np.array([known[w] if w in known else missing(w) for w in words], dtype=np.int64)


def neighbour_sums(rows: np.ndarray, sums: np.ndarray) -> None:
    """Add every word's neighbours within ``REACH``; gaps between texts hold the last row."""
    flat = sums.reshape(-1)
    for off in range(1, REACH + 1):
        left, right = rows[:-off], rows[off:]
        for a, b in ((left, right), (right, left)):
            for z in range(NONZERO):
                flat += np.bincount(a * DIM + PLACES[b, z], weights=SIGNS[b, z], minlength=flat.size)


def _context_sums(docs: DataFrame) -> np.ndarray:
    """Neighbour sums of all texts, one row per vocabulary row."""
    n = VOCAB + MARKS + 1

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, sums, gap = Lexicon(), np.zeros((n, DIM)), np.full(REACH, n - 1, dtype=np.int64)
        for frame in parts:
            pending, size = [], 0
            for text in frame["text"]:
                words = (text or "").encode("utf-8", "replace").split()
                for lo in range(0, len(words), 1 << 20):
                    pending += [lexicon.codes(words[lo : lo + (1 << 20) + REACH if lo + (1 << 20) < len(words) else None]) // (_CASES * _ENDS), gap]
                    size += len(pending[-2])
                if size > 1 << 20:
                    neighbour_sums(np.concatenate(pending), sums)
                    pending, size = [], 0
            if pending:
                neighbour_sums(np.concatenate(pending), sums)
        used = np.flatnonzero(np.abs(sums[:VOCAB]).sum(axis=1))
        out = pd.DataFrame(sums[used].astype(np.int64), columns=[f"c{i}" for i in range(DIM)])
        out.insert(0, "row", used)
        yield out

    schema = "row long, " + ", ".join(f"c{i} long" for i in range(DIM))
    total = docs.select("text").mapInPandas(add, schema).groupBy("row").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIM)])
    out = np.zeros((n, DIM))
    got = total.toPandas()  # at most VOCAB rows, whatever the corpus
    out[got["row"].to_numpy(np.int64)] = got[[f"c{i}" for i in range(DIM)]].to_numpy(np.float64)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all vocabulary rows and marks, float32, scaled to length one."""
    sums = _context_sums(docs)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1.0)
    both = sums + index_matrix() / np.sqrt(NONZERO)
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_vector(text: str | None, vectors: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Pooled vectors of one text, and the logs of its numbers of words and lines."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(FEATURES, dtype=np.float32)
    lines = [x.split() for x in raw.split(b"\n")]
    words = [w for x in lines for w in x]
    n = len(words)
    if not n:
        return out
    code = lexicon.codes(words)
    row, kind = code // (_CASES * _ENDS), code % (_CASES * _ENDS)
    out[:DIM] = np.bincount(row, minlength=VOCAB)[:VOCAB].astype(np.float32) @ vectors[:VOCAB] / n if n > 2000 else vectors[row].mean(axis=0)
    again = np.zeros(n, dtype=bool)
    again[1:] = row[1:] == row[:-1]
    trail = np.zeros(n, dtype=bool)
    if n > 3:
        key = (row[:-2] * VOCAB + row[1:-1]) * VOCAB + row[2:]
        first = np.unique(key, return_index=True)[1]
        trail[2:] = True
        trail[2 + first] = False
    line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    marks = np.zeros((len(lines), MARKS), dtype=np.float32)
    marks[:, : MARKS - 2] = np.bincount(line * (MARKS - 2) + kind, minlength=len(lines) * (MARKS - 2)).reshape(len(lines), -1)
    marks[:, MARKS - 2] = np.bincount(line, weights=again, minlength=len(lines))
    marks[:, MARKS - 1] = np.bincount(line, weights=trail, minlength=len(lines))
    table = vectors[VOCAB : VOCAB + MARKS]
    out[DIM : 2 * DIM] = marks.sum(axis=0) @ table / n
    size = np.bincount(line, minlength=len(lines))
    full = size >= min(5, size.max())
    out[2 * DIM : 3 * DIM] = (marks[full] @ table / size[full][:, None]).max(axis=0)
    out[3 * DIM :] = np.log1p(n) / 5, np.log1p(full.sum()) / 5
    return out


def document_vectors(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and the pooled vector as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.pandas_udf("binary")
    def pool(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon()
        for texts in parts:
            yield pd.Series([document_vector(t, shared.value, lexicon).tobytes() for t in texts])

    return docs.select("doc_id", pool("text").alias("v"))


class Network:
    """Two layers: tanh, then one logit divided by a temperature."""

    def __init__(self, inputs: int = FEATURES, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 1)), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden, (hidden @ self.w[2] + self.w[3])[:, 0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale)[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-3) -> Network:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, epochs + 1):
            hidden, z = self._forward(x)
            d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y))[:, None]
            back = d @ self.w[2].T * (1 - hidden**2)
            grads = [x.T @ back + decay * self.w[0], back.sum(axis=0), hidden.T @ d + decay * self.w[2], d.sum(axis=0)]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.w[i] -= rate * m[i] / (1 - 0.9**step) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Temperature of least log loss on rows that training has not seen."""
        z = self.logits(x)
        grid = np.exp(np.linspace(-2, 2.5, 91))
        p = 1 / (1 + np.exp(-np.clip(z / grid[:, None], -40, 40)))
        loss = -(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)).mean(axis=1)
        self.temperature = float(grid[np.argmin(loss)])
        return self


def labelled(rows: DataFrame, labels: DataFrame, target: str, bound: int) -> DataFrame:
    """``rows`` joined with their label as ``y``, thinned by a hash of the id to about ``bound`` rows."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    return rows.join(known.where(drawn("doc_id", bound, known.count())), "doc_id")


def train_network(pooled: DataFrame, labels: DataFrame, target: str = "quality", bound: int = SAMPLE) -> Network | None:
    """Fit on labelled rows of ``pooled(doc_id, v)``; None without both labels."""
    got = sorted(labelled(pooled, labels, target, bound).collect(), key=lambda r: (r["doc_id"], bytes(r["v"])))
    if len({r["y"] for r in got}) < 2:
        return None
    x = np.stack([np.frombuffer(r["v"], dtype=np.float32) for r in got]).astype(np.float64)
    y = np.array([float(r["y"] > 0) for r in got])
    aside = np.array([zlib.crc32(f"aside {r['doc_id']}".encode()) % 5 == 0 for r in got])
    net = Network().train(x[~aside], y[~aside])
    return net.calibrate(x[aside], y[aside]) if len(set(y[aside])) == 2 else net


def score_vectors(pooled: DataFrame, net: Network | None) -> DataFrame:
    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        if not len(v) or net is None:
            return pd.Series(0.5, index=v.index, dtype="float64")
        return pd.Series(net.score(np.stack([np.frombuffer(b, dtype=np.float32) for b in v]).astype(np.float64)))

    return pooled.select("doc_id", score("v").alias("score"))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Word vectors of all texts, a network from the labels outside the held-out fold, scores of all."""
    texts = docs.select("doc_id", "text")
    pooled = keep(document_vectors(texts, word_vectors(texts)), "pooled")
    net = train_network(pooled, labels.where(fold("doc_id", 5) != 0))
    out = score_vectors(pooled, net)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
