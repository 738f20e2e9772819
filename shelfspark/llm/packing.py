"""Best-fit packing of documents into sequences, in bulk-synchronous supersteps.

Documents are tokenised and cut into pieces, the pieces range-sorted by length, longest first, and numbered. A
superstep takes all pieces of one length; each sweeps to its successor, the smallest gap that holds it. Pieces
of one length want the same gaps: conflicts are resolved by rank, the first pieces by rank getting the gaps in
order, the rest sweeping on. Gaps are updated, and the step repeats until no piece of the length is left; a
piece without successor opens a new sequence.

Pieces of one length are alike and so are gaps of one size, so a sweep's state is runs: (length, ranks) against
(gap size, sequences). There are at most ``capacity`` lengths and as many gap sizes, whatever the input; only
these counts reach the driver, and the plan that goes back is bounded in the same way. The match of each piece to
its place is made where the piece lies, by a sweep over the plan's runs in rank order.

Defined results: null and empty texts are one end token; repeated rows are packed each for itself; pieces of
``capacity`` fill a sequence; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer, pre_tokenizers

from ..plans.cut import bounded_batches, cut, ranked
from .memo import remembered

CAPACITY = 2048
#: Characters that str.split() takes for white space and the tokenizer's \s does not: fixed values.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Words, and pieces between white space, that a worker remembers before it forgets all and begins again.
REMEMBERED = 400_000
LONGEST = 48
#: Letters that the normaliser only lower-cases and that a split never parts, then marks that always stand apart.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(rf"([{LETTERS}]+)([.,!?:;]*)")


class WordIds(dict):
    """Ids of a piece between white space, as little-endian 32-bit bytes.

    The tokenizer drops white space, and neither its normaliser nor its splits look across it, so a text's ids are
    those of its pieces in turn. A piece of plain letters and then plain marks is split there by any rule it has, so
    its ids are those of the two; any other piece, and all pieces if the file has other rules, go to it whole.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        kinds = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])], [x["type"] for x in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_piece = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and rules["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        self.words: dict[str, bytes] = {}
        if self.by_piece:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if PLAIN.fullmatch(chr(i))}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, letters: str) -> bytes:
        found = self.words.get(letters)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            ids = [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.letters))]
            found = struct.pack(f"<{len(ids)}I", *ids)
            self.words[letters] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONGEST:
            return self.encoded(piece)
        if len(self) >= REMEMBERED:
            self.clear()
        parts = PLAIN.fullmatch(piece)
        if not parts:
            found = self.encoded(piece)
        else:
            found = self.word(parts[1].lower())
            if parts[2]:
                found += self[parts[2]]
        self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        if not self.by_piece or any(c in text for c in ODD_SPACE):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.split()))


def word_ids(tokenizer: str) -> WordIds:
    """One for a worker, whatever tasks it runs."""
    import public_tokenizers

    return remembered(("word_ids", tokenizer), lambda: WordIds(public_tokenizers.path(tokenizer)))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces; ``tokenizer``: a name of public_tokenizers."""
    rows = docs.select("doc_id", "text")
    schema = StructType(
        [rows.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for i in range(len(texts)):
                ids = words.ids(texts[i].as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in a sequence, offset) that place ``counts`` pieces of each length.

    A run holds the pieces of its length from its first rank to the next run's.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs (first sequence, count), last in first out
    sizes: list[int] = []
    opened = 0

    def add(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):  # no successor: new sequences, each with as many as fit
                each = capacity // length
                full, rest = divmod(left, each)
                for n, held in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        runs.append((length, rank, opened, held, 0))
                        add(capacity - held * length, opened, n)
                        opened += n
                        rank += n * held
                left = 0
                continue
            size = sizes[k]
            first, n = gaps[size].pop()
            if not gaps[size]:
                del gaps[size], sizes[k]
            each = size // length  # what is left of a gap is a smaller one, and so the next piece's successor
            full = min(n, left // each)
            part = left % each if full < n and left < (full + 1) * each else 0
            for used, held in ((full, each), (1 if part else 0, part)):
                if used:
                    runs.append((length, rank, first, held, capacity - size))
                    add(size - held * length, first, used)
                    first, n = first + used, n - used
                    rank, left = rank + used * held, left - used * held
            if n:
                add(size, first, n)
    return runs


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Texts are read and tokenised once; what is shuffled, once, is five numbers a piece. Returns doc_id, piece,
    start, length, ids_crc32, sequence_id and offset.
    """
    bounded_batches(docs.sparkSession)
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id))
    counts = {int(r.length): r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    out, _ = ranked(pieces, order, "_rank")
    runs = sorted(best_fit(counts, capacity), key=lambda r: (-r[0], r[1]))
    begins: dict[int, int] = {}  # of each length in the order of ranks
    total = 0
    for length in sorted(counts, reverse=True):
        begins[length] = total
        total += counts[length]
    first = np.array([begins[r[0]] + r[1] for r in runs], dtype=np.int64)
    plan = np.array(runs, dtype=np.int64).reshape(-1, 5)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(5).to_numpy()
            run = np.searchsorted(first, rank, side="right") - 1
            turn, nth = np.divmod(rank - first[run], plan[run, 3])
            offset = plan[run, 4] + nth * plan[run, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(plan[run, 2] + turn), pa.array(offset)], names=schema.names)

    return out.mapInArrow(place, schema)
