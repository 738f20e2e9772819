"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network.

Random indexing: each word has a sparse ternary index vector that its hash gives; its word vector is the sum of the
index vectors of what stands within two words of it, wherever it occurs in the corpus. A word is what stands between
ASCII white space, as written, and has the row of its hash in a table of 2^18; unrelated words seldom share one. How a
word is written (case, digits, the marks it ends in, whether it repeats the word before) is a second symbol at its
place, with an index vector and a vector of its own, so words that were never met still tell something. The sums run
over all documents in whole numbers, so partitioning doesn't change them; blocks of the table are summed by a shuffle.

A document is the mean of its words' vectors beside the mean of their forms', drawn to the mean of the learning rows as if
it had ``PRIOR`` more words of it, so that a text of a few odd words isn't judged by them alone. A network with one
hidden layer maps that to a logit; a temperature fitted on a fifth of the learning rows, which the network doesn't see,
turns logits to probabilities. The network learns from at most ``max_rows`` labelled documents.

Defined results: a null or empty text is that mean and scored as such; without learning rows every score is
1, with rows of one class every score is the smoothed share of label 1. Repeated rows are scored alike; of a labelled
doc_id with several texts one is learnt from, that of the least hash. An empty table gives no rows. Extra columns are
ignored, whatever their names. Very long texts are read whole, in parts of ``PART`` bytes cut at white space; words on
the two sides of such a cut aren't neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..plans.cut import bounded_batches
from . import labelled
from .memo import forget

#: Rows of words, as a power of two, and of forms.
WORD_BITS, FORMS = 18, 4096
ROWS = (1 << WORD_BITS) + FORMS
DIMENSIONS, NONZERO, REACH = 32, 4, 2
#: Length of a word vector, in whole numbers of a byte.
SCALE = 127
HIDDEN, EPOCHS, RATE, DECAY = 16, 400, 0.02, 1e-4
PRIOR = 8
THRESHOLD = 0.3
#: Bytes of text that are looked at together, and the longest part of a text.
PART = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LOWER, _UPPER, _DIGIT, _HIGH, _MARK, _SPACE = range(6)
_KIND = np.array([_SPACE if c in b" \t\n\v\f\r" else _LOWER if 97 <= c <= 122 else _UPPER if 65 <= c <= 90 else _DIGIT if 48 <= c <= 57 else _HIGH if c >= 128 else _MARK for c in range(256)], np.uint8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    """base^0, base^1, ..., modulo 2^64."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        more = min(k, n - k)
        out[k : k + more] = out[:more] * np.uint64(pow(base, k, 1 << 64))
        k += more
    return out


class Symbols(NamedTuple):
    """Of each word of some texts in turn: the number of its text, the row of the word and the row of its form."""

    text: np.ndarray
    word: np.ndarray
    form: np.ndarray


def symbols(parts: list[bytes], texts: list[int]) -> Symbols:
    """``parts`` of texts, and the number of the text that each belongs to; words of two parts don't repeat each other."""
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    kind = _KIND[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], kind == _SPACE]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    size = 1 << max(19, len(raw).bit_length())
    # a word's hash: the sum of its bytes times powers of an odd number, read off running sums modulo 2^64
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(size, _MIX[0])[: len(raw)])])
    hashes = _mixed((sums[end] - sums[start]) * _powers(size, pow(_MIX[0], -1, 1 << 64))[start])
    part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), start, side="right")
    count = lambda k: np.concatenate([[0], np.cumsum(kind == k)])
    upper, digit, mark = (c[end] - c[start] for c in map(count, (_UPPER, _DIGIT, _MARK)))
    length = end - start
    case = np.where(upper == 0, 0, np.where(upper + mark + digit >= length, 2, np.where((upper == 1) & (kind[start] == _UPPER), 1, 3)))
    tail, closed = np.zeros(len(start), np.uint64), np.ones(len(start), bool)
    for back in (1, 2, 3):  # the marks that the word ends in, three at most
        at = np.maximum(end - back, 0)
        closed &= (length >= back) & (kind[at] == _MARK)
        tail = tail * np.uint64(256) + np.where(closed, raw[at], 0).astype(np.uint64)
    again = np.zeros(len(start), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (part[1:] == part[:-1])
    shape = ((case * 2 + (digit > 0)) * 2 + again).astype(np.uint64)
    form = (_mixed((tail * np.uint64(64) + shape + np.uint64(1)) * np.uint64(_MIX[2])) % np.uint64(FORMS)).astype(np.int64)
    return Symbols(np.asarray(texts, dtype=np.int64)[part], (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), form + (1 << WORD_BITS))


def parted(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of at most ``PART`` bytes and the rest of a word."""
    at = 0
    while len(text) - at > PART:
        end = at + PART
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def blocks(texts: Iterable[pa.Scalar]) -> Iterator[tuple[Symbols, int]]:
    """The symbols of texts, a block of bounded size at a time, and the number of texts so far; a text may span blocks."""
    parts: list[bytes] = []
    of: list[int] = []
    held = number = 0
    for text in texts:
        for part in parted((text.as_py() or "").encode()):
            parts.append(part)
            of.append(number)
            held += len(part)
            if held >= PART:
                yield symbols(parts, of), number + 1
                parts, of, held = [], [], 0
        number += 1
    if parts:
        yield symbols(parts, of), number


@cache
def index_vectors() -> np.ndarray:
    """Of each row, ``NONZERO`` ones and as many minus ones at places that its number gives."""
    out = np.zeros((ROWS, DIMENSIONS), np.int8)
    for at in range(0, ROWS, 1 << 14):
        some = out[at : at + (1 << 14)]
        drawn = _mixed((np.arange(some.size, dtype=np.uint64) + np.uint64(at * DIMENSIONS)) * np.uint64(_MIX[0]) + np.uint64(1))
        order = np.argsort(drawn.reshape(some.shape), axis=1)
        np.put_along_axis(some, order[:, :NONZERO], 1, 1)
        np.put_along_axis(some, order[:, NONZERO : 2 * NONZERO], -1, 1)
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    """The rows of ``raw`` at a length of ``SCALE``, in whole numbers, so that sums of them don't depend on their order."""
    out = np.empty(raw.shape, np.int8)
    for at in range(0, len(raw), 1 << 14):
        some = raw[at : at + (1 << 14)].astype(np.float64)
        out[at : at + len(some)] = np.rint(SCALE * some / (np.linalg.norm(some, axis=1, keepdims=True) + 1e-9))
    return out


def contexts(batches: Iterable[pa.Array]) -> np.ndarray:
    """Summed index vectors of what stands near each symbol in the texts."""
    forget()
    index, out, whole, held = index_vectors(), np.zeros((ROWS, DIMENSIONS), np.int32), 0, 0
    for texts in batches:
        for (text, *rows), _ in blocks(texts):
            held += len(text)
            if held * 4 * REACH >= 1 << 31:  # what 32 bits can hold in any case
                whole, held = whole + out.astype(np.int64), len(text)
                out[:] = 0
            own = index[rows[0]].astype(np.int16) + index[rows[1]]
            near = np.zeros_like(own)
            for reach in range(1, REACH + 1):
                same = (text[reach:] == text[:-reach])[:, None]
                near[reach:] += own[:-reach] * same
                near[:-reach] += own[reach:] * same
            for row in rows:
                order = np.argsort(row, kind="stable")
                first = np.flatnonzero(np.diff(row[order], prepend=-1))
                if len(first):
                    out[row[order[first]]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int32)
    return whole + out


def sums(texts: Iterable[pa.Scalar], vectors: np.ndarray) -> np.ndarray:
    """The sums of the word vectors and of the form vectors of each text and, last, the number of its words."""
    forget()
    out = np.zeros((0, 2 * vectors.shape[1] + 1))
    for (text, word, form), number in blocks(texts):
        out = np.concatenate([out, np.zeros((number - len(out), out.shape[1]))])
        first = np.flatnonzero(np.diff(text, prepend=-1))
        if len(first):
            both = [np.add.reduceat(vectors[row], first, axis=0, dtype=np.int64) / SCALE for row in (word, form)]
            out[text[first]] += np.concatenate([*both, np.diff(first, append=len(text))[:, None]], axis=1)
    return out


def pooled(summed: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Mean vectors of what ``sums`` gives, with ``PRIOR`` words of the mean ``prior`` added."""
    return (summed[:, :-1] + PRIOR * prior) / (summed[:, -1:] + PRIOR)


@dataclass
class Network:
    """Two layers over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Full-batch Adam on the log loss; the caller orders the rows."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(z @ p[0] + p[1])
        error = (sigmoid(h @ p[2] + p[3]) - y) / len(y)
        back = np.outer(error, p[2]) * (1 - h * h)
        grads = [z.T @ back + DECAY * p[0], back.sum(0), h.T @ error + DECAY * p[2], np.array([error.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a fine search in the logarithm."""
    if len(set(y.tolist())) < 2:
        return 1.0
    grid = np.exp(np.linspace(-2, 3, 251))
    loss = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    """Word vectors and network; ``constant`` instead where nothing could be learnt."""

    vectors: Broadcast
    prior: np.ndarray
    network: Network | None
    constant: float

    def scorer(self):
        """A UDF from texts to scores, for use on a column."""
        vectors, prior, network, constant = self.vectors, self.prior, self.network, self.constant

        @F.arrow_udf(DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            if network is None:
                return pa.array(np.full(len(texts), constant))
            return pa.array(network.probabilities(pooled(sums(texts, vectors.value), prior)))

        return score


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = labelled.MAX_ROWS) -> Model:
    """Word vectors from all of ``docs`` (doc_id, text), the network from ``labels`` (doc_id, quality)."""
    bounded_batches(docs.sparkSession)
    vectors = docs.sparkSession.sparkContext.broadcast(labelled.summed_rows(docs, "text", contexts, ROWS, DIMENSIONS, finish=unit, kind=np.int8))  # of fixed size

    @F.arrow_udf(BinaryType())
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in sums(texts, vectors.value)], pa.binary())

    rows = labelled.learning_rows(docs, labels, "quality", max_rows).select("doc_id", "y", features("text").alias("x"))
    got = sorted(((str(r.doc_id), r.y, r.x) for r in rows.collect()), key=lambda r: r[0])  # one of a doc_id
    y = np.array([r[1] for r in got], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return Model(vectors, np.zeros(2 * DIMENSIONS), None, float((y.sum() + 1) / (len(y) + 2)) if len(y) else 1.0)
    found = np.frombuffer(b"".join(r[2] for r in got)).reshape(len(got), -1)
    prior = found[:, :-1].sum(0) / max(found[:, -1].sum(), 1)
    x = pooled(found, prior)
    apart = np.array([zlib.crc32(f"calibrate {r[0]}".encode()) % 5 == 0 for r in got])
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    network = train(x[~apart], y[~apart])
    network.temperature = calibrate(network.logits(x[apart]), y[apart])
    return Model(vectors, prior, network, 0.0)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    scored = docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), model.scorer()("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
