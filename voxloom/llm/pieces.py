"""SentencePiece encoding and decoding with a relational lattice.

A text is cut into units at blanks and line ends, which no piece crosses. The distinct
units of all texts meet once. Substrings up to the longest piece are exploded and equi-joined
to the piece table, the edges are grouped by unit, and a fold by Spark's higher-order
``aggregate`` picks the pieces: Viterbi over the scores for a unigram model, and for a BPE
model the merges in the order of their scores, since that is what such a model file means
(its scores are ranks, and the best sum of ranks is another segmentation).

Documents are dealt into parts of bounded size. A part asks for its distinct units by
number, the answers come back by part and number, and the part is put together in one task,
so no word travels more than once a part and no dictionary of the corpus is broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.columns import let, shuffle_partitions

BLANK = "▁"
UNIGRAM, BPE = 1, 2
#: Places of a unit fit a long; longer units go to the library.
LONGEST_UNIT = 60
PART_CHARS = 4_000_000
UNKNOWN_PENALTY = 10.0
#: A piece table is broadcast, so its size is checked.
MOST_PIECES = 1_000_000

_UNITS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


@dataclass(frozen=True)
class PieceModel:
    """The pieces of a model file: text and score by id, and ids of the 256 bytes."""

    path: str
    kind: int
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_ids: tuple[int, ...]
    normal: tuple[int, ...]


def _model_type(data: bytes) -> int:
    """Field 3 of the trainer settings (field 2 of the file); 1 if it is not there."""

    def fields(block: bytes):
        place = 0

        def number() -> int:
            nonlocal place
            out = shift = 0
            while True:
                byte = block[place]
                place += 1
                out |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return out

        while place < len(block):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number()
            elif kind == 2:
                size = number()
                yield key >> 3, block[place : place + size]
                place += size
            else:
                place += 4 if kind == 5 else 8

    for field, value in fields(data):
        if field == 2:
            return next((v for f, v in fields(value) if f == 3), UNIGRAM)
    return UNIGRAM


def load_model(path: str) -> PieceModel:
    """Read a model with an identity normaliser, a blank in front and byte pieces."""
    import sentencepiece

    with open(path, "rb") as file:
        data = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    n = model.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces are more than {MOST_PIECES}")
    pieces = tuple(model.id_to_piece(i) for i in range(n))
    normal = tuple(
        i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    )
    if any(re.search(f"[^{BLANK}]{BLANK}|\n", pieces[i]) for i in normal):
        raise ValueError("a piece crosses a blank or a line end")
    byte_ids = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    return PieceModel(
        path, _model_type(data), pieces, tuple(model.get_score(i) for i in range(n)), byte_ids, normal
    )


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def units_of(text: str | None) -> list[str]:
    """The units of a text in order; none for a null or empty one."""
    return _UNITS.findall(BLANK + text.replace(" ", BLANK)) if text else []


def _byte_ids(model: PieceModel, char: Column) -> Column:
    table = F.array(*[F.lit(i) for i in model.bytes_ids])
    digits = F.hex(F.encode(char, "UTF-8"))
    at = F.sequence(F.lit(0), (F.length(digits) / 2 - 1).cast("int"))
    return F.transform(
        at,
        lambda i: F.get(
            table, F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        ),
    )


def _merged(edges: Column, n: Column) -> Column:
    """Places where pieces begin and end after all merges, as bits of a long.

    The best merge is the one of the highest score, the leftmost of equal ones; it joins the
    two symbols that an edge spans. ``edges`` are in that order.
    """
    many = F.filter(edges, lambda e: e["inner"] != 0)
    all_places = _shift_left(F.lit(2).cast("long"), n) - 1

    def merge(mask: Column, options: Column) -> Column:
        def fits(e: Column) -> Column:
            return (mask.bitwiseAND(e["ends"]) == e["ends"]) & (
                F.bit_count(mask.bitwiseAND(e["inner"])) == 1
            )

        return let(
            F.get(F.filter(options, fits), F.lit(0)),
            lambda e: F.coalesce(mask.bitwiseAND(F.bitwise_not(e["inner"])), mask),
        )

    rounds = F.slice(F.sequence(F.lit(1), n), F.lit(1), n - 1)
    return let(
        many,
        lambda options: F.aggregate(rounds, all_places, lambda mask, _: merge(mask, options)),
    )


def _merge_ids(model: PieceModel, unit: Column, edges: Column, n: Column) -> Column:
    """Ids of a unit under a BPE model."""

    def ids(mask: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: mask.bitwiseAND(_shift_left(F.lit(1).cast("long"), i)) != 0,
        )

        def symbol(begin: Column, end: Column) -> Column:
            found = F.filter(edges, lambda e: (e["begin"] == begin) & (e["end"] == end))
            one = F.get(found, F.lit(0))["id"]
            return F.when(one.isNotNull(), F.array(one)).otherwise(
                _byte_ids(model, F.substring(unit, begin + 1, F.lit(1)))
            )

        return let(
            places,
            lambda p: F.flatten(
                F.transform(
                    F.slice(p, F.lit(1), F.size(p) - 1),
                    lambda begin, i: symbol(begin, F.get(p, i + 1)),
                )
            ),
        )

    return let(_merged(edges, n), ids)


def _viterbi_ids(model: PieceModel, unit: Column, edges: Column, n: Column) -> Column:
    """Ids of a unit under a unigram model: the path with the highest sum of scores.

    ``edges`` are in the order of their end, then begin. The state holds the best score and
    path to every place so far; of equal scores the longest last piece stays.
    """
    state_type = "array<struct<score:double,ids:array<int>>>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

    def step(state: Column, e: Column) -> Column:
        def reached(before: Column) -> Column:
            own = F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(
                _byte_ids(model, F.substring(unit, e["begin"] + 1, F.lit(1)))
            )
            new = F.struct(
                (before["score"] - e["cost"]).alias("score"),
                F.concat(before["ids"], own).alias("ids"),
            )
            last = F.get(state, e["end"])
            return (
                F.when(last.isNull(), F.concat(state, F.array(new)))
                .when(
                    before["score"] - e["cost"] > last["score"],
                    F.concat(F.slice(state, F.lit(1), e["end"]), F.array(new)),
                )
                .otherwise(state)
            )

        return let(F.get(state, e["begin"]), reached)

    return F.aggregate(edges, start.cast(state_type), step, lambda s: F.get(s, n)["ids"])


def encode_units(units: DataFrame, model: PieceModel) -> DataFrame:
    """``unit, ids`` for distinct units of at most ``LONGEST_UNIT`` characters.

    If the units are partitioned by ``unit``, nothing but the piece table moves.
    """
    spark: SparkSession = units.sparkSession
    table = spark.createDataFrame(
        pd.DataFrame(
            {
                "piece": [model.pieces[i] for i in model.normal],
                "id": np.array(model.normal, dtype=np.int32),
                "score": [float(model.scores[i]) for i in model.normal],
            }
        ),
        "piece string, id int, score double",
    )
    longest = max(len(model.pieces[i]) for i in model.normal)
    n = F.length("unit")
    begins = units.select("unit", F.explode(F.sequence(F.lit(0), n - 1)).alias("begin"))
    ends = F.sequence(F.col("begin") + 1, F.least(n, F.col("begin") + longest))
    parts = begins.select("unit", "begin", F.explode(ends).alias("end")).withColumn(
        "piece", F.substring("unit", F.col("begin") + 1, F.col("end") - F.col("begin"))
    )
    found = parts.join(F.broadcast(table), "piece", "left")
    # A single character without a piece becomes bytes, at a score below all others.
    lowest = min(model.scores[i] for i in model.normal) - UNKNOWN_PENALTY
    found = found.where(F.col("id").isNotNull() | (F.col("end") == F.col("begin") + 1))
    one = F.lit(1).cast("long")
    cost = -F.coalesce("score", F.lit(lowest))
    inner = _shift_left(one, F.col("end")) - _shift_left(one, F.col("begin") + 1)
    marks = _shift_left(one, F.col("begin")).bitwiseOR(_shift_left(one, F.col("end")))
    order = ["begin", "end"] if model.kind == BPE else ["end", "begin"]
    lead = [cost.alias("cost"), *order] if model.kind == BPE else [*order, cost.alias("cost")]
    edge = F.struct(*lead, "id", inner.alias("inner"), marks.alias("ends"))
    grouped = found.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("_edges"))
    fold = _merge_ids if model.kind == BPE else _viterbi_ids
    return grouped.select("unit", fold(model, F.col("unit"), F.col("_edges"), n).alias("ids"))


def _encode_long(path: str, units: list[str]) -> list[list[int]]:
    """Ids of units that are too long for the fold, by the library itself.

    It sets a blank in front of a text: a unit that has one lends it, and another unit is
    encoded after a line end, whose two ids (blank and byte) are dropped.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for unit in units:
        plain = unit.replace(BLANK, " ")
        led = plain.startswith(" ")
        ids = library.encode(plain[1:] if led else "\n" + plain)
        out.append(ids if led else ids[2:])
    return out


def _decoder(model: PieceModel):
    """A function from an array of ids to its text."""
    number = {i: b for b, i in enumerate(model.bytes_ids)}
    raw = [
        bytes([number[i]]) if i in number else p.replace(BLANK, " ").encode("utf-8")
        for i, p in enumerate(model.pieces)
    ]

    def text_of(ids: np.ndarray) -> str:
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    return text_of


def encode(
    docs: DataFrame, model: PieceModel, part_chars: int = PART_CHARS, checked: bool = False
) -> DataFrame:
    """``doc_id, text, ids`` of every row; ``ids`` are the piece ids of the whole text.

    A null or empty text has no ids. Rows that repeat are encoded each; an empty table
    gives no rows; other columns are ignored. Parts hold about ``part_chars`` characters.
    ``checked`` gives ``round_trip``, whether the decoded ids are the text, for the text.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    # Several parts for each task, so that their sizes even out.
    n_parts = max(4 * shuffle_partitions(spark), math.ceil(chars / part_chars))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int")
    dealt = docs.select("doc_id", "text", part.alias("part")).repartition(n_parts, "part")

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, set[str]] = {}
        for batch in batches:
            for own, text in zip(batch["part"], batch["text"]):
                seen.setdefault(own, set()).update(units_of(text))
        for own in list(seen):
            ordered = sorted(u for u in seen.pop(own) if len(u) <= LONGEST_UNIT)
            for start in range(0, len(ordered), 1 << 16):
                some = ordered[start : start + (1 << 16)]
                yield pd.DataFrame(
                    {"part": own, "number": range(start, start + len(some)), "unit": some}
                )

    requests = dealt.mapInPandas(asked, "part int, number int, unit string").repartition(
        n_parts, "unit"
    )
    # The other columns are read too, so that both readers share one shuffle of requests.
    distinct = requests.groupBy("unit").agg(F.min("part").alias("_p"), F.min("number").alias("_n"))
    answers = encode_units(distinct.where("_p >= 0 and _n >= 0").select("unit"), model)
    answered = requests.join(answers, "unit").select("part", "number", "ids")
    path = model.path

    def put_together(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        split = [units_of(t) for t in pdf["text"]]
        distinct = {u for units in split for u in units}
        ordered = sorted(u for u in distinct if len(u) <= LONGEST_UNIT)
        data: list[bytes] = [b""] * len(ordered)
        for number, ids in zip(found["number"], found["ids"]):
            data[number] = np.asarray(ids, dtype=np.int32).tobytes()
        known = dict(zip(ordered, data))
        long_ones = [u for u in distinct if len(u) > LONGEST_UNIT]
        if long_ones:
            for unit, ids in zip(long_ones, _encode_long(path, long_ones)):
                known[unit] = np.array(ids, dtype=np.int32).tobytes()
        ids = [
            np.frombuffer(b"".join([known[u] for u in units]), dtype=np.int32) for units in split
        ]
        if not checked:
            return pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"], "ids": ids})
        same = [
            text_of(i) == (t or "").replace(BLANK, " ") for i, t in zip(ids, pdf["text"])
        ]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "round_trip": same})

    text_of = _decoder(model) if checked else None
    last = "ids array<int>, round_trip boolean" if checked else "text string, ids array<int>"
    together = dealt.groupBy("part").cogroup(answered.groupBy("part"))
    return together.applyInPandas(put_together, f"doc_id {doc_type}, {last}")


def decode(ids: Column, model: PieceModel) -> Column:
    """The text of an array of ids: pieces joined, byte pieces as UTF-8, blanks back.

    Null stays null; bytes that are no UTF-8 become replacement characters.
    """
    text_of = _decoder(model)

    @F.pandas_udf("string")
    def decoded(arrays: pd.Series) -> pd.Series:
        out = [None if array is None else text_of(array) for array in arrays]
        return pd.Series(out, dtype="object")

    return decoded(ids)


def encode_report(docs: DataFrame, model: PieceModel) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip``: whether the decoded ids are the text again.

    The blank mark U+2581 of a text is the same piece as a blank and comes back as one.
    """
    encoded = encode(docs, model, checked=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
