"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of marks; numbers, units and capitalised words become typed placeholders, whose
values are kept as slots. Items that have one template and one pattern of equal slots are one class, told apart by
their least item_id. Windows of eight words are hash-joined between texts and classes, twice: by their raw words, of
each item of the class, so the case of letters doesn't matter; and by their template. Where a window has few literal
words, a longer one around it (or the whole item) stands for it, of which ``SHARE`` and ``LITERALS`` at least are
literal; failing that, the same with the marks that stand alone, as + or =, each told apart counting once beside a
literal word. What has no such window is matched by its raw words only, so placeholders alone never match.

Matches of one text and one class on one diagonal (place in the text less place in the item) are a candidate: it is a
leak if it covers half of the item's windows, or 13 in number, and its slots are consistent: wherever the item repeats
a value, the text repeats its own. So a question asked again with other numbers or names is caught, and a text that
only shares the shape of a sentence is not.

Texts are read whole, in one pass; a table of fixed width that the items' windows mark lets through the text windows
that may match, and these are shuffled.

Defined results: null and empty texts match nothing, nor do items without words; items of fewer than eight words are one
window. Repeated rows of a doc_id give one row a class. Of several diagonals of one text and class the one of most
windows is told, on ties the first in the text. Without items there are no rows. Very long texts are read whole. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..plans.cut import bounded_batches, cut
from . import labelled
from .memo import remembered

WINDOW, LITERALS = 8, 4
COVERAGE, ENOUGH = 0.5, 13
#: Sizes of longer windows, and what share of them is literal; shorter items than ``WHOLE`` are also taken whole.
LONGER, SHARE, WHOLE = (12, 16, 24, 32, 48, 64), 0.25, 16
#: Bits of the table of marked windows, and words a worker remembers.
TABLE, REMEMBERED = 24, 400_000
#: Units: fixed values.
UNITS = frozenset(
    "mm cm dm km kg mg gram grams gramm gramos grammes kilogram kilograms kilo kilos ton tons tonne tonnes liter liters litre litres litros ml"
    " inch inches foot feet yard yards mile miles millas meilen meter meters metre metres metros mètres kilometer kilometers kilometre kilometres"
    " second seconds sekunden segundos secondes minute minutes minuten minutos hour hours stunden horas heures week weeks wochen semanas semaines"
    " month months monate meses mois year years jahre años ans dollar dollars euro euros pound pounds cent cents percent prozent kmh mph watt watts"
    " volt volts joule joules newton newtons degree degrees celsius fahrenheit".split()
)
EDGE = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
#: Letters, then marks that EDGE strips: most pieces.
PLAIN = re.compile(r"([^\W\d_]+)[.,;:!?]*")
LITERAL, NUMBER, UNIT, NAME, MARK = 0, 1, 2, 3, 4
PLACEHOLDERS = ("", "<num>", "<unit>", "<name>", "")
#: What a window is matched by: its canonical words, its raw ones, or its canonical words and the marks between.
TEMPLATE, RAW, MARKED = 0, 1, 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def token(piece: str) -> tuple[int, str]:
    """The kind of a piece between white space, and its lower-cased core; an empty core is no word."""
    plain = PLAIN.fullmatch(piece)
    core = plain[1] if plain else EDGE.sub("", piece)
    low = core.lower()
    if not plain and any(c.isdigit() for c in core):
        return NUMBER, low
    if low in UNITS or low in ("%", "$", "€", "£"):
        return UNIT, low
    if len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME, low
    return LITERAL, low


def told(piece: str) -> tuple[int, str]:
    """As ``token``, but what is no word is a mark, as it stands."""
    kind, low = token(piece)
    return (kind, low) if low else (MARK, piece)


class Tokens(dict):
    """Of a piece, 17 bytes: the hash of its placeholder or word, the hash of its word, and its kind."""

    held = tuple(xxhash.xxh3_64_digest(p) for p in PLACEHOLDERS)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        kind, low = told(piece)
        own = xxhash.xxh3_64_digest(low)
        found = (self.held[kind] if PLACEHOLDERS[kind] else own) + own + bytes((kind,))
        if len(piece) <= 64:
            self[piece] = found
        return found

    def arrays(self, pieces: list[str]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Of ``pieces``, the hashes by TEMPLATE, RAW and MARKED, and whether each is a word."""
        raw = np.frombuffer(b"".join(map(self.__getitem__, pieces)), dtype=np.uint8).reshape(-1, 17)
        one, two = (np.ascontiguousarray(raw[:, i : i + 8]).view("<u8").ravel() for i in (0, 8))
        word = raw[:, 16] != MARK
        return ((one, two, one) if word.all() else (one[word], two[word], one)), word


def known_tokens() -> Tokens:
    """One for a worker, whatever tasks it runs."""
    return remembered("known_tokens", Tokens)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * _MIX[0] + b) * _MIX[1]
    out ^= out >> np.uint64(29)
    return out


def windows(levels: list[np.ndarray], size: int, by: int) -> np.ndarray:
    """The hash of each window of ``size`` words. ``levels``: the words' hashes, and then those of windows of 2, 4, 8 .. words, added as needed."""
    n = len(levels[0]) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at = _MIX[2 + by], 0
    for k in range(size.bit_length()):
        step = 1 << k
        if k == len(levels):
            levels.append(_mixed(levels[-1][: -step // 2], levels[-1][step // 2 :]))
        if size & step:
            out = _mixed(out, levels[k][at : at + n])
            at += step
    return out


def _told(held: list[tuple[int, str]], by: int) -> str:
    """A window spelt out."""
    return " ".join(w if by == RAW else PLACEHOLDERS[k] or w for k, w in held)


def _values(held: list[tuple[int, str]]) -> list[str]:
    return [w for k, w in held if k not in (LITERAL, MARK)]


def _around(held: list[tuple[int, str]], where: Sequence[int], at: int, size: int) -> tuple[int, int] | None:
    """The first word and the size of the least longer window of ``held``, whose words lie at ``where``, around that of ``size`` words at ``at``."""
    for longer in sorted({*LONGER, *([len(held)] if len(held) < WHOLE else [])}):
        if longer > len(held):
            return None
        word = min(at, bisect_right(where, len(held) - longer) - 1)
        if word < 0 or where[word] + longer <= where[at + size - 1]:
            continue
        within = held[where[word] : where[word] + longer]
        literal = sum(k == LITERAL for k, _ in within)
        if literal and literal + len({w for k, w in within if k == MARK}) >= max(LITERALS, SHARE * longer):
            return word, longer
    return None


def _keys(pieces: list[tuple[int, str]]) -> tuple[int, set[tuple[int, int, int, int]], set[int]]:
    """Of an item: how many windows it has; the keys that stand for them, as by, first word, last window covered and size; and by what all its windows are matched."""
    where = [i for i, (k, _) in enumerate(pieces) if k != MARK]
    words = [pieces[i] for i in where]
    size = min(WINDOW, len(words))
    n = len(words) - size + 1
    keys, used = {(RAW, at, at, size) for at in range(n)}, set()
    for at in range(n):
        if sum(k == LITERAL for k, _ in words[at : at + size]) >= min(LITERALS, size):
            keys.add((TEMPLATE, at, at, size))
            used.add(TEMPLATE)
        elif found := _around(words, range(len(words)), at, size):
            keys.add((TEMPLATE, found[0], sum(found) - size, found[1]))
            used.add(TEMPLATE)
        elif found := _around(pieces, where, at, size):
            keys.add((MARKED, found[0], bisect_left(where, where[found[0]] + found[1]) - size, found[1]))
            used.add(MARKED)
        else:
            used.add(RAW)
    return n, keys, used


def _classes(items: DataFrame) -> DataFrame:
    """item_id, n_items and text: each item's own text, with the least item_id of its class and the number of its items."""

    @F.arrow_udf(StringType())
    def template(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            marked = list(map(told, (t.as_py() or "").split()))
            pieces = [p for p in marked if p[0] != MARK]
            if not pieces:
                out.append(None)
                continue
            first: dict[tuple[int, str], int] = {}
            pattern = [first.setdefault(p, i) for i, p in enumerate(pieces) if p[0] != LITERAL]
            # what only values or marks tell apart, they tell apart as a class too
            used = _keys(marked)[2]
            words = [w if RAW in used else PLACEHOLDERS[k] or w for k, w in (marked if MARKED in used else pieces)]
            out.append(" ".join(words) + "|" + ",".join(map(str, pattern)))
        return pa.array(out, pa.string())

    known = cut(items.select("item_id", "text", template("text").alias("template")).where("template is not null"))
    classes = known.groupBy("template").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n_items"))
    return known.select("template", "text").distinct().join(classes, "template").select("item_id", "n_items", "text")


def _item_windows(classes: DataFrame) -> DataFrame:
    """Each key of each class: item_id, n_items, at, last (the last window it stands for), windows, by, size, hash, window, and of each slot the first place of its value and the value."""
    schema = StructType([classes.schema["item_id"], *(StructField(n, LongType()) for n in ("n_items", "at", "last", "windows", "by", "size", "hash"))]).add("window", "string").add("slots", ArrayType(IntegerType())).add("own", ArrayType(StringType()))
    rows = classes.select("item_id", "n_items", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = known_tokens()
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                split = text.split()
                marked = list(map(told, split))
                where = [k for k, p in enumerate(marked) if p[0] != MARK]
                words = [marked[k] for k in where]
                first: dict[tuple[int, str], int] = {}
                slot = [first.setdefault(p, k) if p[0] != LITERAL else -1 for k, p in enumerate(words)]
                levels = [[h] for h in tokens.arrays(split)[0]]
                n, keys, _ = _keys(marked)
                hashes = {by_size: windows(levels[by_size[0]], by_size[1], by_size[0]).view(np.int64) for by_size in {(by, size) for by, _, _, size in keys}}
                for by, at, last, size in sorted(keys):
                    start, end = (where[at], bisect_left(where, where[at] + size)) if by == MARKED else (at, at + size)
                    held = (marked if by == MARKED else words)[start : start + size]
                    row.append(i)
                    # what is matched by raw words has the item's own values; else the text tells its values
                    out.append((at, last, n, by, size, int(hashes[by, size][start]), _told(held, by), [s for s in slot[at:end] if s >= 0], _values(held) if by == RAW else None))
            take = pa.array(row, pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates(["item_id", "at", "by", "size", "hash", "window"])


def _text_windows(docs: DataFrame, wanted: list[tuple[int, int]], table: np.ndarray) -> DataFrame:
    """Those windows of each text, of each ``wanted`` (by, size), that the table lets through: doc_id, place, by, size, hash, window, values."""
    held = docs.sparkSession.sparkContext.broadcast(table)  # of fixed width
    rows = docs.select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], *(StructField(n, LongType()) for n in ("place", "by", "size", "hash"))]).add("window", "string").add("values", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, marked = known_tokens(), held.value.view(np.uint8)
        for batch in batches:
            row, out = [], []
            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                if not text:
                    continue
                split = text.split()
                hashes, word = tokens.arrays(split)
                levels = [[h] for h in hashes]
                words = None
                for by, size in wanted:
                    found = windows(levels[by], size, by)
                    slot = found >> np.uint64(64 - TABLE)
                    hit = np.flatnonzero((marked[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
                    if len(hit) and words is None:
                        words = [split[k] for k in np.flatnonzero(word)]
                        before = np.cumsum(word) - 1
                    for at in hit.tolist():
                        pieces = [told(p) for p in (split if by == MARKED else words)[at : at + size]]
                        row.append(i)
                        place = int(before[at]) if by == MARKED else at
                        out.append((place, by, size, int(found[at : at + 1].view(np.int64)[0]), _told(pieces, by), None if by == RAW else _values(pieces)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, enough: int = ENOUGH) -> DataFrame:
    """doc_id and item_id of each text of ``docs`` (doc_id, text) that holds an item of ``items`` (item_id, text).

    More columns: n_items (items of the class), place (of the item's first word among the text's words), matched and
    windows (the item's windows that were found, and all), and coverage, their quotient.
    """
    bounded_batches(docs.sparkSession)
    known = cut(_item_windows(_classes(items)))
    wanted = sorted(tuple(r) for r in known.select("by", "size").distinct().collect())  # few sizes, whatever the items

    def marked(arrays: Iterable[pa.Array]) -> np.ndarray:
        bits = np.zeros(1 << TABLE, bool)
        for x in arrays:
            bits[x.to_numpy().view(np.uint64) >> np.uint64(64 - TABLE)] = True
        return np.packbits(bits).view(np.int64)

    table = labelled.summed(known, "hash", marked, np.bitwise_or)
    found = _text_windows(docs, wanted, np.zeros((1 << TABLE) // 64, np.int64) if table is None else table)
    met = found.join(known, ["hash", "by", "size", "window"])
    diagonal = ["doc_id", "item_id", "n_items", "windows", "diagonal"]
    slots = F.explode_outer(F.arrays_zip("slots", F.coalesce("values", "own").alias("values"))).alias("slot")
    each = met.select(*diagonal[:4], (F.col("place") - F.col("at")).alias("diagonal"), F.sequence("at", "last").alias("at"), slots)
    each = each.select(*diagonal, "at", "slot.slots", "slot.values")
    by_slot = each.groupBy(*diagonal, "slots").agg((F.min("values") != F.max("values")).alias("odd"), F.collect_set("at").alias("at"))
    whole = by_slot.groupBy(*diagonal).agg(F.max(F.coalesce("odd", F.lit(False))).alias("odd"), F.size(F.array_distinct(F.flatten(F.flatten(F.collect_list("at"))))).cast("long").alias("matched"))
    sure = whole.where(~F.col("odd") & ((F.col("matched") >= coverage * F.col("windows")) | (F.col("matched") >= enough)))
    best = sure.groupBy(*diagonal[:4]).agg(F.max(F.struct("matched", (-F.col("diagonal")).alias("back"))).alias("b"))
    return best.select("doc_id", "item_id", "n_items", (-F.col("b.back")).alias("place"), "b.matched", "windows", (F.col("b.matched") / F.col("windows")).alias("coverage"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text leaks no item: each row is judged by its own text, also of a null or repeated doc_id."""
    key, m1, m2 = labelled.unused_names(docs, 3)
    marked = docs.withColumns({m1: F.xxhash64("text"), m2: F.xxhash64(F.lit(7919), F.col("text"))})
    own = F.struct(F.col("doc_id").alias("doc_id"), F.col(m1).alias("m1"), F.col(m2).alias("m2"))
    found = leaks(marked.select(own.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    texts = found.select(F.col(f"{key}.m1").alias(m1), F.col(f"{key}.m2").alias(m2)).distinct()
    return marked.join(texts, [m1, m2], "left_anti").select(*docs.columns)
