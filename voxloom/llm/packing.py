"""Pack the token ids of documents into sequences of a fixed length, best fit first.

Documents arrive one after the other. A task keeps a bounded number of open sequences in a
bitset keyed by free space: one shift and the lowest set bit name the fullest sequence that
still holds a piece. If too many are open, the fullest closes. What is open when a task ends
is carried up a tree of folds, where the pieces of a few tasks are packed together again, so
no sequence stays half empty for want of documents in its own task.

Only documents longer than a sequence are cut. The texts are read where they lie, and only
numbers about their pieces move on.

Odd input: a null or empty text is the end id alone. Repeated rows are documents of their
own, a null ``doc_id`` stays null. Other columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import stored

END_ID = 0
SEQUENCE_TOKENS = 2048
OPEN_SEQUENCES = 2048
FAN_IN = 16
CACHED_PIECES, CACHED_LENGTH = 1 << 19, 64

_FORMATS = [f"<{n}I" for n in range(9)]
_NODE_SHIFT, _ROUND_SHIFT = 28, 58
_COLUMNS = "piece int, start long, length long, ids_crc32 long"


class OpenSequences:
    """Open sequences by free space. Bit ``f`` of the set says that one has ``f`` places."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.set = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.set &= ~(1 << free)
        return number

    def place(self, length: int) -> tuple[int, int, list[int]]:
        """The sequence and the offset of a piece, and the sequences that close with it."""
        fits = self.set >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.n
            self.n += 1
            self.n_open += 1
        left = free - length
        if not left:
            self.n_open -= 1
            return number, self.capacity - free, [number]
        self.by_free[left].append(number)
        self.set |= 1 << left
        return number, self.capacity - free, self.close_to(self.most_open)

    def close_to(self, most_open: int) -> list[int]:
        """Close the fullest sequences until at most so many are open."""
        closed = []
        while self.n_open > most_open:
            closed.append(self._take((self.set & -self.set).bit_length() - 1))
            self.n_open -= 1
        return closed


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library that drops white space.

    Such a tokenizer never joins what a blank or a line end parts, so the ids of a piece
    between them are looked up where it was seen before. A new piece of plain Latin letters
    and signs is lowered and cut by the tokenizer's own pattern, and its cuts are looked up
    in turn or given to the library's model; the library encodes every other piece whole.
    With ``special_as_text`` the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        # A pool of threads in every worker would only fight the other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self._library(["a b\nc"]) != [b"".join(self._library(["a", "b", "c"]))]:
            raise ValueError("a tokenizer that drops white space is asked for")
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        strings = [] if special_as_text else [t.content for t in added]
        self.special = re.compile("|".join(map(re.escape, strings)) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.known_cuts: dict[str, bytes] = {}
        self.cuts = self._own_cuts(json.loads(self.tokenizer.to_str()))
        # Letters that have one lower-case form and no other composition.
        self.plain = re.compile("[!-~À-ÖØ-öø-ÿ]*")
        # The byte-level alphabet shows the bytes that print as themselves, the others from 256 on.
        shown = set(ByteLevel.alphabet())
        others = [b for b in range(256) if chr(b) not in shown or b == 32]
        self.letters = {b: 256 + i for i, b in enumerate(others)}

    @staticmethod
    def _own_cuts(spec: dict):
        """The tokenizer's pattern, or None if it does more than lower a text and cut it."""
        normal = (spec["normalizer"] or {}).get("normalizers", [])
        cutting = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [n["type"] for n in normal] != ["NFC", "Replace", "Lowercase"] or len(cutting) != 2:
            return None
        split, level = cutting
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            return None
        if level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            return None
        # The letters and digits among the plain characters, in lower case.
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")
        return None if r"\p" in pattern else re.compile(pattern)

    def _library(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [_little(e.ids) for e in found]

    def _cut(self, cut: str) -> bytes:
        found = self.known_cuts.get(cut)
        if found is None:
            shown = cut if cut.isascii() else cut.encode().decode("latin-1").translate(self.letters)
            found = self.known_cuts[cut] = _little([t.id for t in self.model.tokenize(shown)])
        return found

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
            self.known_cuts.clear()
        found, others = {}, []
        for piece in pieces:
            if self.cuts and self.plain.fullmatch(piece) and not self.special.search(piece):
                cuts = self.cuts.findall(piece.lower())
                found[piece] = self._cut(cuts[0]) if len(cuts) == 1 else b"".join(map(self._cut, cuts))
            else:
                others.append(piece)
        if others:
            found |= zip(others, self._library(others))
        self.known.update({p: ids for p, ids in found.items() if len(p) <= CACHED_LENGTH})
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        pieces = text.replace("\n", " ").split(" ")
        out = [*map(self.known.get, pieces)]
        if None in out:
            fresh = self._new(list(dict.fromkeys([p for p, ids in zip(pieces, out) if ids is None])))
            out = [fresh[p] if ids is None else ids for p, ids in zip(pieces, out)]
        return b"".join(out)


def _little(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes() if len(ids) > 8 else struct.pack(_FORMATS[len(ids)], *ids)


def worker_encoder(path: str, special_as_text: bool) -> WordEncoder:
    """The encoder of this Python worker, which serves one task after the other."""
    name = "voxloom_worker_word_encoders"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (path, special_as_text)
    if held.get("key") != key:
        held["encoder"], held["key"] = WordEncoder(*key), key
    return held["encoder"]


class _Kept:
    """Rows of sequences, held back until each is closed."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.waiting, self.ready = schema, {}, []

    def add(self, number: int, row: tuple) -> None:
        self.waiting.setdefault(number, []).append(row)

    def finish(self, numbers: list[int], is_open: bool = False) -> None:
        for number in numbers:
            self.ready += [(*row, is_open) for row in self.waiting.pop(number)]

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.ready) if self.ready else [[] for _ in self.schema]
        arrays = [pa.array(list(c), f.type) for c, f in zip(columns, self.schema)]
        self.ready = []
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _schema(doc_type: pa.DataType) -> pa.Schema:
    names = ["piece", "start", "length", "ids_crc32", "node", "sequence", "offset"]
    kinds = [pa.int32(), *[pa.int64()] * 6]
    fields = [("doc_id", doc_type), *zip(names, kinds), ("is_open", pa.bool_())]
    return pa.schema(fields)


def _arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def pack_arrivals(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, most_open: int, special_as_text: bool
) -> DataFrame:
    """Pieces placed in the sequences of their own task, in the order of the scan."""
    schema = _schema(_arrow_type(docs))
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, special_as_text)
        sequences, kept = OpenSequences(capacity, most_open), _Kept(schema)
        node = TaskContext.get().partitionId()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (encoder.encode(text) if text else b"") + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    length = len(part) // 4
                    number, offset, closed = sequences.place(length)
                    row = (doc_id, piece, at // 4, length, zlib.crc32(part), node, number, offset)
                    kept.add(number, row)
                    kept.finish(closed)
            if kept.ready:
                yield kept.batch()
        kept.finish(list(kept.waiting), is_open=True)
        yield kept.batch()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        packed, f"doc_id {kind}, {_COLUMNS}, node long, sequence long, offset long, is_open boolean"
    )


def pack_again(rows: DataFrame, capacity: int, most_open: int) -> DataFrame:
    """Pack the pieces of every ``node`` anew, longest first; the fullest sequences close.

    A node has at most ``FAN_IN * most_open`` sequences of pieces.
    """
    arrow = _schema(_arrow_type(rows))

    def packed(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by(
            [("length", "descending"), ("ids_crc32", "ascending"), ("node_before", "ascending"),
             ("sequence", "ascending"), ("offset", "ascending")]
        )
        sequences, placed, closed = OpenSequences(capacity, pieces.num_rows), [], []
        for length in pieces.column("length").to_pylist():
            number, offset, full = sequences.place(length)
            placed.append((number, offset))
            closed += full
        closed = set(closed + sequences.close_to(most_open))
        numbers, offsets = zip(*placed)
        is_open = [n not in closed for n in numbers]
        out = pieces.drop_columns(["node_before", "sequence", "offset"])
        for name, values in (("sequence", numbers), ("offset", offsets), ("is_open", is_open)):
            out = out.append_column(name, pa.array(values, arrow.field(name).type))
        return out.select(arrow.names)

    given = ["doc_id", "piece", "start", "length", "ids_crc32", "node", "node_before", "sequence", "offset"]
    return rows.select(*given).groupBy("node").applyInArrow(packed, rows.drop("node_before").schema)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = SEQUENCE_TOKENS,
    most_open: int = OPEN_SEQUENCES,
    special_as_text: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece.

    ``docs`` has ``doc_id, text``. ``most_open`` bounds the memory of a task and how much
    each task passes up the tree, not which rows are packed.
    """
    rows = stored(pack_arrivals(docs, tokenizer, end_id, capacity, most_open, special_as_text))
    nodes = (rows.agg(F.max("node")).first()[0] or 0) + 1
    done, number = [], 0
    # Even a single task's open sequences are packed once more, longest piece first.
    while nodes > 1 or not number:
        done.append(_named(rows.where(~F.col("is_open")), number))
        number, nodes = number + 1, -(-nodes // FAN_IN)
        waiting = rows.where("is_open").withColumnRenamed("node", "node_before")
        waiting = waiting.withColumn("node", F.floor(F.col("node_before") / FAN_IN).cast("bigint"))
        rows = stored(pack_again(waiting, capacity, most_open))
    # What the root holds open has nothing to wait for.
    out = _named(rows, number)
    for table in done:
        out = out.unionByName(table)
    return out


def _named(rows: DataFrame, number: int) -> DataFrame:
    """Numbers of sequences that no other task or round gives."""
    name = F.lit(number << _ROUND_SHIFT) + F.shiftleft("node", _NODE_SHIFT) + F.col("sequence")
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32", name.alias("sequence_id"), "offset"
    )
