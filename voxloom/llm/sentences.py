"""Substring dedup over sliding runs of sentences.

Runs are sized by words: from each sentence the shortest run forward, and to each sentence
the shortest run back, of 2 sentences and 16 words or of 3 sentences and 8 words. Their
hashes of all documents meet, and a sentence goes if any run that covers it is not the first
of its kind. The first is the one with the smallest ``doc_id`` (null first), then the
smallest row key, then place.

A sentence of over 16 words is cut into pieces at words that the 16 words around them
choose, so a repeated passage is cut alike wherever its edges lie: at most 16 words at each
edge differ, and of any passage of 49 words or more a run lies in the rest.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 2
RUN_WORDS = 16
#: So many whole sentences are a run of MIN_WORDS words already.
SHORT_RUN = 3
MIN_WORDS = 8
LONG_SENTENCE = 16
WINDOW = 16

# A sentence ends after . ! ? and white space, at a line end, or after a full-width mark.
_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*|(?<=[。！？])\s*")
_WORD = re.compile(r"\S+")


def _least_places(values: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest value (the first on a tie) of every window, ascending."""
    out: list[int] = []
    least = -1
    for end in range(window - 1, len(values)):
        begin = end - window + 1
        if least < begin:
            part = values[begin : end + 1]
            least = begin + part.index(min(part))
            out.append(least)
        elif values[end] < values[least]:
            least = end
            out.append(least)
    return out


def _pieces(text: str) -> list[tuple[int, int, bool]]:
    """``(end, words, whole)`` of every piece; ``whole``: the piece is a sentence."""
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out: list[tuple[int, int, bool]] = []
    start = 0
    for end in ends:
        piece = text[start:end]
        n = len(piece.split())
        if not n:
            # White space belongs to the sentence before it.
            if out and end > start:
                out[-1] = (end, *out[-1][1:])
                start = end
            continue
        if n <= LONG_SENTENCE:
            out.append((end, n, True))
        else:
            found = list(_WORD.finditer(piece))
            marks = [zlib.crc32(m.group().encode("utf-8", "surrogatepass")) for m in found]
            # The next piece begins with the word after the chosen one.
            cuts = [i + 1 for i in _least_places(marks) if i + 1 < len(found)]
            out += [
                (start + found[b].start(), b - a, False) for a, b in zip([0, *cuts], cuts)
            ]
            out.append((end, len(found) - cuts[-1], False))
        start = end
    return out


def sentence_ends(text: str) -> list[int]:
    """Ends of the sentences; the pieces between them make up the whole text.

    A sentence of over 16 words is cut after the word with the smallest hash of every 16
    words in a row, so equal passages are cut at equal places.
    """
    return [end for end, _, _ in _pieces(text)]


def _runs(
    pieces: list[tuple[int, int, bool]], run: int, min_words: int, run_words: int
) -> list[tuple[int, int, int]]:
    """``(place, first, last + 1)`` of every run, in ascending order of ``place``.

    ``place`` is even for a run that begins at a piece, odd for one that ends there. A text
    that has no run is one, if it has ``min_words``.
    """
    n = len(pieces)
    words = [0, *accumulate(p[1] for p in pieces)]
    whole = [0, *accumulate(int(p[2]) for p in pieces)]
    # The smallest end that reaches the words of both kinds of run.
    stops, stop = [], 0
    for i in range(n):
        stop = max(stop, i + 1)
        while stop <= n and not (
            (words[stop] - words[i] >= run_words and stop - i >= run)
            or (words[stop] - words[i] >= min_words and whole[stop] - whole[i] >= SHORT_RUN)
        ):
            stop += 1
        if stop > n:
            break
        stops.append(stop)
    if not stops:
        return [(0, 0, n)] if words[n] >= min_words else []
    out = [(2 * i, i, stop) for i, stop in enumerate(stops)]
    for stop in range(stops[0] + 1, n + 1):
        # The last run that ends here or before, unless it ends just here.
        i = bisect_left(stops, stop + 1) - 1
        if stops[i] < stop:
            out.append((2 * stop - 1, i, stop))
    return sorted(out)


def run_hashes(
    text: str, run: int = RUN, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS
) -> list[tuple[int, int]]:
    """``(place, hash)`` of every run of the text; see ``_runs``.

    Fewer than ``min_words`` words have no hash: such short phrases repeat by chance. White
    space counts as one blank.
    """
    pieces = _pieces(text)
    parts, start = [], 0
    for end, _, _ in pieces:
        parts.append(" ".join(text[start:end].split()))
        start = end
    out = []
    for place, first, stop in _runs(pieces, run, min_words, run_words):
        joined = " ".join(parts[first:stop])
        digest = xxhash.xxh3_64_intdigest(joined.encode("utf-8", "surrogatepass"))
        out.append((place, digest - (1 << 64) if digest >= 1 << 63 else digest))
    return out


def sentence_runs(rows: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, key, place, hash`` of every run of every text of ``doc_id, key, text``."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [run_hashes(t, run, min_words) if t else [] for t in batch["text"]]
            n = [len(f) for f in found]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].repeat(n).to_numpy(),
                    "key": batch["key"].repeat(n).to_numpy(),
                    "place": pd.Series([p for f in found for p, _ in f], dtype="int32"),
                    "hash": pd.Series([h for f in found for _, h in f], dtype="int64"),
                }
            )

    return rows.select("doc_id", "key", "text").mapInPandas(
        hashed, f"doc_id {doc_type}, key long, place int, hash long"
    )


def _cut(
    text: str | None, starts: set[int], run: int = RUN, min_words: int = MIN_WORDS
) -> tuple[str | None, int, int]:
    """The text without the sentences under a flagged run, with both counts."""
    if not text:
        return text, 0, 0
    pieces = _pieces(text)
    ends = [end for end, _, _ in pieces]
    if not starts:
        return text, len(ends), 0
    runs = _runs(pieces, run, min_words, RUN_WORDS)
    gone = {i for place, a, b in runs if place in starts for i in range(a, b)}
    begins = [0, *ends[:-1]]
    kept = "".join(text[a:b] for i, (a, b) in enumerate(zip(begins, ends)) if i not in gone)
    return kept, len(ends), len(gone)


def repeated_runs(rows: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, starts``: places of the runs of a row that were seen before."""
    # Both readers take all columns of one shuffle, so the texts are hashed once. The filter
    # holds for every row; the joins would put it above one of the readers only.
    runs = sentence_runs(rows, run, min_words).where("hash is not null and key is not null")
    runs = runs.repartition("hash")
    at = F.struct("doc_id", "key", "place")
    firsts = (
        runs.groupBy("hash")
        .agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("hash", "_first")
    )
    again = runs.join(firsts, "hash").where(~at.eqNullSafe(F.col("_first")))
    return again.groupBy("key").agg(F.collect_set("place").alias("starts"))


def remove_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated spans, and ``n_sentences, n_removed``.

    All rows stay, with their other columns (one that is named like a count is replaced);
    a text may become empty. Null and empty texts stay as they are (0 sentences). Rows that
    are equal in ``doc_id`` and ``text`` are one document: they keep the same sentences. An
    empty table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"),
        "doc_id",
        "text",
        F.xxhash64("doc_id", "text").alias("key"),
    )
    flagged = repeated_runs(keyed, run, min_words)
    joined = keyed.select("row", "text", "key").join(flagged, "key", "left")
    cut_type = T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("n_sentences", T.IntegerType()),
            T.StructField("n_removed", T.IntegerType()),
        ]
    )

    @F.pandas_udf(cut_type)
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        done = [_cut(t, set() if s is None else set(s), run, min_words) for t, s in zip(texts, starts)]
        return pd.DataFrame(done, columns=["text", "n_sentences", "n_removed"])

    done = joined.select("row", cut("text", "starts").alias("_c"))
    return done.select(
        *[F.col("_c.text") if c == "text" else F.col("row")[c].alias(c) for c in names],
        "_c.n_sentences",
        "_c.n_removed",
    )
