"""Token ids of documents in wavelet matrix files, one shard of documents a file.

A wavelet matrix keeps a sequence as bit-planes: plane 0 holds the top bit of every id in
order, then the sequence is dealt stably into zeros and ones, plane 1 holds the next bit,
and so on. With rank counts on the planes an id, the number of times a token occurs before
a place, and the place of its k-th occurrence are each one walk over the planes.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.columns import number_all, shuffle_partitions

END_ID = 0
SHARD_TOKENS = 1 << 19
CACHED_PIECES = 1 << 20

_MAGIC = b"WVM1"


class WaveletMatrix:
    """Access, rank, select and full decoding of a sequence of ids below ``2 ** bits``."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self._words: list[tuple[np.ndarray, np.ndarray]] | None = None

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        left = ids.astype(kind)
        zeros, planes = [], []
        for b in range(bits - 1, -1, -1):
            one = (left & kind(1 << b)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low = left.take(np.flatnonzero(~one))
            zeros.append(len(low))
            left = np.concatenate((low, left.take(np.flatnonzero(one))))
        return cls(len(ids), zeros, planes)

    def to_bytes(self) -> bytes:
        """Header (count, planes, zeros and compressed length of each), then the planes."""
        packed = [zstandard.compress(p.tobytes(), 1) for p in self.planes]
        head = struct.pack("<4sQI", _MAGIC, self.n, len(packed))
        table = b"".join(struct.pack("<QQ", z, len(p)) for z, p in zip(self.zeros, packed))
        return b"".join([head, table, *packed])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, bits = struct.unpack_from("<4sQI", data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        place = 16
        table = [struct.unpack_from("<QQ", data, place + 16 * i) for i in range(bits)]
        place += 16 * bits
        planes = []
        for _, length in table:
            plane = zstandard.decompress(data[place : place + length])
            planes.append(np.frombuffer(plane, dtype=np.uint8))
            place += length
        return cls(n, [z for z, _ in table], planes)

    def decode(self) -> np.ndarray:
        """The whole sequence, undoing the deals from the last plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        left = np.zeros(self.n, dtype=kind)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            out = np.empty_like(left)
            out[np.flatnonzero(~one)] = left[:z]
            out[np.flatnonzero(one)] = left[z:] | kind(1 << (bits - 1 - level))
            left = out
        return left

    def _ranked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of 64 bits of each plane and the ones before each word."""
        if self._words is None:
            self._words = []
            for plane in self.planes:
                padded = np.zeros(-(-(self.n + 1) // 64) * 8, dtype=np.uint8)
                padded[: len(plane)] = plane
                words = padded.view("<u8")
                before = np.zeros(len(words) + 1, dtype=np.int64)
                np.cumsum(np.bitwise_count(words), out=before[1:])
                self._words.append((words, before))
        return self._words

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ones the plane has before each place."""
        words, before = self._ranked()[level]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places ``at``."""
        at = np.asarray(at, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the sequence")
        out = np.zeros(len(at), dtype=np.int64)
        for level, (words, _) in enumerate(self._ranked()):
            bit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            out = (out << 1) | bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _bit(self, token: int, level: int) -> int:
        return (token >> (len(self.planes) - 1 - level)) & 1

    def _walk(self, token: int, at: np.ndarray) -> np.ndarray:
        for level in range(len(self.planes)):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if self._bit(token, level) else at - ones
        return at

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """How often the token occurs before each of the places ``at`` (up to n)."""
        if token < 0 or token >> len(self.planes):
            return np.zeros(len(at), dtype=np.int64)
        at = np.asarray(at, dtype=np.int64)
        return self._walk(token, at) - self._walk(token, np.zeros_like(at))

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th occurrences, k from 0."""
        k = np.asarray(k, dtype=np.int64)
        if len(k) and (k.min() < 0 or k.max() >= self.count(token)):
            raise IndexError("fewer occurrences")
        at = self._walk(token, np.zeros_like(k)) + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = self._bit(token, level)
            wanted = at - self.zeros[level] if one else at
            low, high = np.zeros_like(wanted), np.full_like(wanted, self.n)
            # The first place with more than ``wanted`` such bits up to it.
            while (low < high).any():
                middle = (low + high) >> 1
                ones = self._ones(level, np.minimum(middle + 1, self.n))
                seen = ones if one else np.minimum(middle + 1, self.n) - ones
                enough = seen > wanted
                high = np.where(enough, middle, high)
                low = np.where(enough, low, middle + 1)
            at = low
        return at

    def occurrences(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))


class PieceEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Such a tokenizer cuts a text by a pattern and encodes each cut alone, so the ids of a
    blank-separated piece are looked up where it was seen before; the model of the library
    encodes the others. Two blanks in a row, or one beside other white space, can belong to
    one cut, and texts with those are cut by the pattern itself.

    As in the library, a text is first parted at the strings of added tokens, which are one
    id each, and what stands between them is encoded by itself. With ``special_as_text``
    those strings are ordinary text. Only texts that hold one pay for it.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        import public_tokenizers

        tokenizer = Tokenizer.from_file(path)
        before = tokenizer.pre_tokenizer
        if not isinstance(before, ByteLevel) or before.add_prefix_space or tokenizer.normalizer:
            raise ValueError("a plain byte-level tokenizer is asked for")
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take more than their own string are not read")
        self.model = tokenizer.model
        self.kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.bits = 16 if self.kind is np.uint16 else 32
        self.code = np.dtype(self.kind).char
        shown = {} if special_as_text else added
        self.added = {t.content: np.array([i], dtype=self.kind).tobytes() for i, t in shown.items()}
        # The longest of those that begin at one place.
        strings = sorted(self.added, key=len, reverse=True)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.cuts = regex.compile(public_tokenizers.PATTERN)
        shown = ByteLevel.alphabet()
        # Bytes that print stand for themselves, the others for the code points from 256.
        plain = [b for b in range(256) if chr(b) in shown and b != 32]
        others = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.cached: dict[str, bytes] = {}
        # The same for pieces after a blank, by the piece without it; none that could blend.
        self.after_blank: dict[str, bytes] = {}
        self.cut_ids: dict[str, bytes] = {}
        self.blended = regex.compile(r"(?:^|\s) (?:\s|$)")

    def _cut(self, cut: str) -> bytes:
        found = self.cut_ids.get(cut)
        if found is None:
            mapped = cut.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(mapped)]
            found = self.cut_ids[cut] = array(self.code, ids).tobytes()
        return found

    def _piece(self, piece: str, held: dict[str, bytes], name: str) -> bytes:
        """The ids of a piece, which ``held`` keeps under ``name``."""
        found = held.get(name)
        if found is None:
            if len(self.cached) + len(self.after_blank) >= CACHED_PIECES:
                self.cached.clear()
                self.after_blank.clear()
                self.cut_ids.clear()
            # A blank and plain letters are one cut.
            single = piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())
            cuts = [piece] if single else self.cuts.findall(piece)
            found = held[name] = b"".join([self._cut(c) for c in cuts])
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian numbers of ``kind``."""
        if not any(t in text for t in self.added):
            return self._ordinary(text)
        parts = self.parts.split(text)
        return b"".join(
            [self.added[p] if i % 2 else self._ordinary(p) if p else b"" for i, p in enumerate(parts)]
        )

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        out = [*map(self.after_blank.get, rest)]
        if None in out:
            # A blank that blends has nothing or white space behind it.
            unknown = [i for i, found in enumerate(out) if found is None]
            odd = any(not rest[i] or rest[i][0].isspace() for i in unknown)
            if odd and self.blended.search(text):
                return b"".join([self._cut(c) for c in self.cuts.findall(text)])
            for i in unknown:
                piece, whole = rest[i], " " + rest[i]
                if piece and not piece[0].isspace():
                    out[i] = self._piece(whole, self.after_blank, piece)
                else:
                    out[i] = self._piece(whole, self.cached, whole)
        return self._piece(first, self.cached, first) + b"".join(out)


def worker_encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """The encoder of this Python worker, which serves one task after the other."""
    name = "voxloom_worker_encoders"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (path, special_as_text)
    if held.get("key") != key:
        held["encoder"], held["key"] = PieceEncoder(*key), key
    return held["encoder"]


SHARD = (
    "part int, place int, n_docs long, n_tokens long, doc_ids {doc_ids}, lengths binary, "
    "matrix binary"
)


def token_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    special_as_text: bool = False,
) -> DataFrame:
    """One row for each shard: its documents in order, their lengths, the wavelet matrix.

    Documents are dealt by ranges of ``doc_id`` (null first, equal ids by hash of the
    text). A shard takes documents until it holds ``shard_tokens`` ids, so a longer
    document is a shard by itself.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def packed(part: int, place: int, ids: list, lengths: list[int], stream: list[bytes], enc):
        flat = np.frombuffer(b"".join(stream), dtype=enc.kind)
        return pd.DataFrame(
            {
                "part": [part],
                "place": [place],
                "n_docs": [len(lengths)],
                "n_tokens": [len(flat)],
                "doc_ids": [ids],
                "lengths": [np.array(lengths, dtype="<u8").tobytes()],
                "matrix": [WaveletMatrix.build(flat, enc.bits).to_bytes()],
            }
        )

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = worker_encoder(tokenizer, special_as_text)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        width = len(end)
        part = TaskContext.get().partitionId()
        place, size, ids, lengths, stream = 0, 0, [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = (enc.encode(text) if text else b"") + end
                ids.append(None if doc_id is None or doc_id != doc_id else doc_id)
                lengths.append(len(data) // width)
                stream.append(data)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield packed(part, place, ids, lengths, stream, enc)
                    place, size, ids, lengths, stream = place + 1, 0, [], [], []
        if lengths:
            yield packed(part, place, ids, lengths, stream, enc)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    dealt = docs.select("doc_id", "text").repartitionByRange(
        shuffle_partitions(docs.sparkSession), *order[:2]
    )
    return dealt.sortWithinPartitions(*order).mapInPandas(
        encoded, SHARD.format(doc_ids=f"array<{doc_type}>")
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
    special_as_text: bool = False,
) -> None:
    """Write the ids of all documents as a folder of shard files, one shard a file."""
    shards = token_shards(docs, tokenizer, end_id, shard_tokens, special_as_text)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, place, start``: the ids of all shards before each one."""
    heads = spark.read.parquet(path).select("part", "place", "n_tokens")
    numbered = number_all(
        heads, [F.col("part").asc(), F.col("place").asc()], "start", F.col("n_tokens")
    )
    return numbered.drop("n_tokens")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (binary, little-endian 32 bits) from the files."""
    return _per_document(spark, path, "ids binary", lambda ids: ids.tobytes())


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""
    return _per_document(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.data))


def _per_document(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    shards = spark.read.parquet(path)
    doc_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    name = column.split()[0]

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, place, ids, lengths, matrix in zip(
                batch["part"], batch["place"], batch["doc_ids"], batch["lengths"], batch["matrix"]
            ):
                flat = WaveletMatrix.from_bytes(matrix).decode().astype("<u4")
                n = np.frombuffer(lengths, dtype="<u8").astype(np.int64)
                ends = np.cumsum(n)
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(list(ids), dtype="Int64")
                        if doc_type in ("bigint", "int")
                        else list(ids),
                        "part": part,
                        "place": place,
                        "first": ends - n,
                        "n_tokens": n,
                        name: [value(flat[e - k : e]) for e, k in zip(ends, n)],
                    }
                )

    rows = shards.select("part", "place", "doc_ids", "lengths", "matrix").mapInPandas(
        decoded, f"doc_id {doc_type}, part int, place int, first long, n_tokens long, {column}"
    )
    return rows.join(shard_starts(spark, path), ["part", "place"]).select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", name
    )


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each token occurs in all files, by rank queries."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for matrix in batch["matrix"]:
                shard = WaveletMatrix.from_bytes(matrix)
                yield pd.DataFrame({"token": tokens, "n": [shard.count(t) for t in tokens]})

    rows = spark.read.parquet(path).select("matrix").mapInPandas(counted, "token long, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """``place``: all places of a token in the sequence of all files, by select queries."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, place, matrix in zip(batch["part"], batch["place"], batch["matrix"]):
                at = WaveletMatrix.from_bytes(matrix).occurrences(token)
                yield pd.DataFrame({"part": part, "place": place, "at": at})

    rows = spark.read.parquet(path).select("part", "place", "matrix").mapInPandas(
        found, "part int, place int, at long"
    )
    return rows.join(shard_starts(spark, path), ["part", "place"]).select(
        (F.col("start") + F.col("at")).alias("place")
    )
