"""Toxicity: a counterfactual-regularised linear classifier over the words a text has and how they begin.

A text's marks are its distinct words and, for insults that come with many endings, the first four, five and six
letters of them. A word counts 1; a beginning counts by the share of the text's distinct words that have it, as long
texts have any beginning by chance. The fit uses the marks of the learning rows that tell the classes apart best, by
chi-square, at most ``max_marks`` of those that ``LEAST_ROWS`` rows have, and a fixed list of identity terms. Learning
rows that are near copies, told by min-hashes of their shingles, share one row's weight, lest the odd words of a text
with many copies pass for insults. Each learning row is paired with a counterfactual: its identity terms swapped for
others of their group or, if it has none, one inserted. The fit minimises the log loss plus a ridge plus a penalty on
the squared change of the logit between a row and its counterfactual, so naming a group doesn't by itself move a score.

The fit takes at most ``max_rows`` labelled documents, half of each class. Defined results: null and empty texts have no
words and get the score of the bias; without learning rows every score is 0, with rows of one class the smoothed share
of label 1. Repeated rows are scored alike; of a labelled doc_id with several texts one is learnt from, that of the
least hash. An empty table gives no rows. Extra columns are ignored, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..operators.graph import least_labels
from ..plans.cut import bounded_batches, cut
from . import labelled
from .jaccard_join import shingles
from .quality import sigmoid

WORD = re.compile(r"[^\W_]+")
MAX_MARKS, LEAST_ROWS = 600, 5
#: Min-hashes of a learning row, in bands of so many, and how many near copies share.
HASHES, BAND, ALIKE = 16, 2, 11
RIDGE, COUNTERFACTUAL = 1.0, 50.0
SWEEPS = 3
THRESHOLD = 0.5
LONGEST = 40
BEGINNINGS = (4, 5, 6)
#: Marks counted in a task before it hands over what it has, and words whose marks a worker remembers.
HELD = 300_000
#: Learning rows that the fit makes dense at a time.
DENSE = 1024
#: Identity terms by group, in the languages of the corpus: fixed values.
IDENTITY = [
    "women men woman man girls boys female male mujeres hombres mujer hombre frauen männer frau mann femmes hommes femme homme".split(),
    "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists musulmanes cristianos judíos muslime christen juden musulmans chrétiens juifs".split(),
    "black white asian latino african european arab indigenous negros blancos asiáticos schwarze weiße asiaten noirs blancs asiatiques".split(),
    "gay lesbian straight bisexual transgender queer heterosexual homosexual homosexuales lesbianas homosexuelle lesben homosexuels lesbiennes".split(),
    "immigrant immigrants refugee refugees migrant migrants foreigner foreigners inmigrantes refugiados einwanderer flüchtlinge ausländer immigrés réfugiés étrangers".split(),
    "disabled blind deaf autistic elderly young old discapacitados ciegos sordos behinderte blinde gehörlose handicapés aveugles sourds".split(),
]
GROUP = {term: group for group in IDENTITY for term in group}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def share(n: int, words: int) -> float:
    """What a beginning of ``n`` of a text's ``words`` distinct words counts: nothing if one word has it, 1 from about one in 100."""
    return min(1.0, 100 * (n - 1) / (words + 50))


def marks_of(words: set[str]) -> dict[str, float]:
    """Words and, as ``^begin``, their beginnings, with what they count."""
    starts = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) >= k)
    return dict.fromkeys((w for w in words if len(w) <= LONGEST), 1.0) | {f"^{b}": share(n, len(words)) for b, n in starts.items() if n > 1}


class Known(dict):
    """Of a word, its own weight and the known beginnings it has; None if it has no mark of the model."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.begins = {m[1:] for m in weights if m[0] == "^"}

    def __missing__(self, word: str) -> tuple[float, tuple[str, ...]] | None:
        if len(self) >= HELD:
            self.clear()
        own = self.weights.get(word, 0.0)
        begins = tuple(word[:k] for k in BEGINNINGS if len(word) >= k and word[:k] in self.begins)
        found = (own, begins) if own or begins else None
        if len(word) <= LONGEST:
            self[word] = found
        return found


def counterfactual(words: set[str], doc_id: object) -> set[str]:
    """``words`` with each identity term swapped for the next of its group; without any, with one inserted."""
    named = words & GROUP.keys()
    if not named:
        terms = sorted(GROUP)
        return words | {terms[zlib.crc32(str(doc_id).encode()) % len(terms)]}
    swapped = set()
    for term in sorted(named):
        group = GROUP[term]
        turn = 1 + zlib.crc32(f"{doc_id} {term}".encode()) % (len(group) - 1)
        swapped.add(group[(group.index(term) + turn) % len(group)])
    return words - named | swapped


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def known(self) -> Known:
        return Known(self.weights)

    def score_text(self, text: str | None, known: Known | None = None) -> float:
        known = self.known() if known is None else known
        starts: Counter = Counter()
        own = []
        words = words_of(text)
        for hit in filter(None, map(known.__getitem__, words)):
            own.append(hit[0])
            starts.update(hit[1])
        own += [self.weights[f"^{b}"] * share(n, len(words)) for b, n in starts.items()]
        return float(sigmoid(np.float64(self.bias + math.fsum(own))))

    def scorer(self):
        """A UDF from texts to scores, for use on a column."""
        model, known = self, self.known()

        @F.arrow_udf(DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            return pa.array([model.score_text(t.as_py(), known) for t in texts], pa.float64())

        return score


class Sparse(NamedTuple):
    """A matrix by rows: where each row begins among the columns and values. A block of rows at a time is made dense."""

    starts: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of(cls, rows: list[bytes], width: int) -> Sparse:
        """``rows``: a column and its value in turn, as 32-bit floats."""
        starts = np.cumsum([0, *(len(r) // 8 for r in rows)])
        column, value = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(-1, 2).T
        return cls(starts, column.astype(np.int32), value.copy(), width)

    def block(self, rows: slice) -> np.ndarray:
        starts = self.starts[rows.start : rows.stop + 1]
        out = np.zeros((len(starts) - 1, self.width), np.float32)
        here = slice(starts[0], starts[-1])
        out[np.repeat(np.arange(len(out)), np.diff(starts)), self.column[here]] = self.value[here]
        return out


def solve(x: Sparse, y: np.ndarray, other: Sparse, each: np.ndarray | None = None, ridge: float = RIDGE, penalty: float = COUNTERFACTUAL) -> np.ndarray:
    """Weights and, last, bias of the penalised logistic fit, by Newton's method; both classes weigh alike, and in them rows as ``each`` says.

    The ridge of a word is then divided by its weight and the fit repeated, so words that only go with others that
    explain the label lose theirs. other: the counterfactual of each row. The penalty is quadratic in the weights, so its part of
    the second derivative is constant. Sums over rows are made ``DENSE`` rows at a time, so no matrix is held whole.
    """
    n, width = len(y), x.width + 1
    blocks = [slice(at, min(at + DENSE, n)) for at in range(0, n, DENSE)]
    fixed = np.zeros((width, width))
    each = np.ones(n) if each is None else each
    for rows in blocks:
        change = other.block(rows) - x.block(rows)
        fixed[:-1, :-1] += penalty * (change.T @ (change * each[rows, None].astype(np.float32)))
    fixed[-1, -1] = 1e-6
    w = np.zeros(width)
    weight = each * each.sum() * np.where(y == 1, 0.5 / (each * y).sum(), 0.5 / (each * (1 - y)).sum())
    for sweep in range(SWEEPS):
        shrink = ridge if not sweep else ridge / (np.abs(w[:-1]) + 0.1)
        held = fixed.copy()
        held[range(len(w) - 1), range(len(w) - 1)] += shrink
        for _ in range(25):
            bend, slope = held.copy(), held @ w
            for rows in blocks:
                a = np.concatenate([x.block(rows), np.ones((rows.stop - rows.start, 1), np.float32)], axis=1)
                p = sigmoid((a @ w.astype(np.float32)).astype(np.float64))
                bend += (a * (weight[rows] * p * (1 - p) + 1e-9).astype(np.float32)[:, None]).T @ a
                slope += a.T @ (weight[rows] * (p - y[rows])).astype(np.float32)
            step = np.linalg.solve(bend, slope)
            norm = np.abs(step).max()
            w = w - step * min(1.0, 2.0 / max(norm, 1e-12))  # no step of more than 2, against overshooting
            if norm < 1e-4:
                break
    return w


def vocabulary(rows: DataFrame, n1: float, n: float, max_marks: int) -> list[str]:
    """The marks of most chi-square among learning rows ``rows`` (text, y, weight), at most ``max_marks``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: tuple[Counter, ...] = Counter(), Counter(), Counter()  # weights of the classes, and rows

        def handed() -> pa.RecordBatch:
            every = list(met[2])
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([m[w] for w in every], pa.float64()) for m in met)], names=["word", "n0", "n1", "rows"])
            for m in met:
                m.clear()
            return out

        for batch in batches:
            for text, y, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for mark, value in marks_of(words_of(text.as_py())).items():
                    met[y][mark] += value * weight
                    met[2][mark] += 1
                if len(met[2]) > HELD:
                    yield handed()
        yield handed()

    summed = rows.select("text", "y", "weight").mapInArrow(counted, "word string, n0 double, n1 double, rows double").groupBy("word")
    total = summed.agg(F.round(F.sum("n0"), 6).alias("n0"), F.round(F.sum("n1"), 6).alias("n1"), F.sum("rows").alias("rows"))
    a, b, n0 = F.col("n1"), F.col("n0"), n - n1
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / ((a + b) * (n - a - b + F.lit(1e-9)) * n1 * n0)
    best = total.where((F.col("rows") >= LEAST_ROWS) & (a + b > 0)).withColumn("chi", chi).orderBy(F.round("chi", 4).desc(), "word").limit(max_marks)
    return [r.word for r in best.collect()]


def signature(texts: pa.Array) -> pa.Array:
    """``HASHES`` min-hashes of the shingles of each text; null if it has none."""
    factors = np.array([(2 * zlib.crc32(f"hash {i}".encode()) + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for i in range(HASHES)], dtype=np.uint64)
    out = []
    for t in texts:
        found = shingles((t.as_py() or "").encode())
        out.append(np.array([(found * f).min() for f in factors]).tobytes() if len(found) else None)
    return pa.array(out, pa.binary())


def copies(signatures: list[bytes | None]) -> np.ndarray:
    """How many rows are near copies of each, itself included: those of which links of ``ALIKE`` equal min-hashes make one group."""
    known = [i for i, s in enumerate(signatures) if s is not None]
    held = np.array([np.frombuffer(signatures[i], dtype=np.uint64) for i in known]).reshape(-1, HASHES)
    first: dict[tuple[int, bytes], int] = {}
    pairs = set()
    for row, hashes in enumerate(held):
        for band in range(0, HASHES, BAND):  # rows that share a band meet its first
            other = first.setdefault((band, hashes[band : band + BAND].tobytes()), row)
            if other != row and (held[other] == hashes).sum() >= ALIKE:
                pairs.add((other, row))
    a, b = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2).T
    label = least_labels(len(known), a, b)
    out = np.ones(len(signatures), dtype=np.int64)
    out[known] = np.bincount(label, minlength=len(known))[label] if known else 1
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = labelled.MAX_ROWS, max_marks: int = MAX_MARKS, penalty: float = COUNTERFACTUAL) -> Model:
    """Learns from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text), at most ``max_rows`` rows, half of each class."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = labelled.learning_rows(docs, labels, "toxic", max_rows, balanced=True).withColumn("y", F.col("y").cast("int"))
    rows = cut(rows.withColumn("signature", F.arrow_udf(signature, BinaryType())("text")))
    known = sorted(rows.select("doc_id", "y", "signature").collect(), key=lambda r: str(r.doc_id))
    y = np.array([r.y for r in known], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model({}, float(np.log(rate / (1 - rate))) if len(y) else -40.0)
    each = 1 / copies([r.signature for r in known])
    weights = spark.createDataFrame(pa.table({"doc_id": [r.doc_id for r in known], "weight": each}))
    names = sorted({*vocabulary(rows.join(F.broadcast(weights), "doc_id"), float(each @ y), float(each.sum()), max_marks), *GROUP})
    place = {w: i for i, w in enumerate(names)}

    @F.arrow_udf("struct<own:binary,other:binary>")
    def features(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, t in zip(ids.to_pylist(), texts, strict=True):
            words = words_of(t.as_py())
            both = ([v for m, n in sorted(marks_of(x).items()) if m in place for v in (place[m], n)] for x in (words, counterfactual(words, i)))
            out.append(dict(zip(("own", "other"), (np.array(v, dtype=np.float32).tobytes() for v in both), strict=True)))
        return pa.array(out, pa.struct([("own", pa.binary()), ("other", pa.binary())]))

    at = {str(r.doc_id): k for k, r in enumerate(known)}
    got = sorted(rows.select("doc_id", features("doc_id", "text").alias("x")).collect(), key=lambda r: at[str(r.doc_id)])
    own, other = (Sparse.of([r.x[side] for r in got], len(names)) for side in ("own", "other"))
    w = solve(own, y, other, each, penalty=penalty)
    return Model({n: float(v) for n, v in zip(names, w[:-1], strict=True) if abs(v) > 1e-9}, float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    scored = docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), model.scorer()("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
