"""Language mixtures of documents from character n-gram likelihoods.

Counts of letter n-grams (1 to 3 letters, hashed into a fixed number of bins) over all
labelled documents give each language a smoothed distribution. For a document,
expectation-maximisation finds the shares of the languages under which its n-grams are
most likely, and the set of languages is the one with the best penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1 << 15
ORDERS = 3
SMOOTHING = 0.5
ROUNDS = 50
UNKNOWN = "und"

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def letter_table() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str | None, letters: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Count of every bin over the lower-cased words of a text; null without a letter.

    Other characters than letters end a word; a word begins and ends with a blank.
    """
    if not text:
        return None
    codes = np.frombuffer(
        text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32
    )
    is_letter = letters[codes]
    if not is_letter.any():
        return None
    codes = np.concatenate(([32], np.where(is_letter, codes, 32), [32])).astype(np.uint64)
    blank = codes == 32
    codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
    counts = np.zeros(bins, dtype=np.int64)
    key = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, ORDERS + 1):
        n = len(codes) - order + 1
        if n <= 0:
            break
        key = key[:n] * _FACTORS[0] + codes[order - 1 :] * _FACTORS[1] + _FACTORS[2]
        place = ((key ^ (key >> np.uint64(29))) * _FACTORS[1]) >> np.uint64(40)
        counts += np.bincount(place.astype(np.int64) % bins, minlength=bins)
    return counts


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4 (a null id: as '')."""
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(digits.cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, bins: int = BINS) -> tuple[list[str], np.ndarray]:
    """Languages in order and ``log p(bin | language)``, a row each.

    All rows of ``docs`` with a text and a ``lang`` count. What the driver collects has at
    most one number for each language and bin.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, totals = letter_table(), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = ngram_counts(text, letters, bins)
                if found is not None:
                    if lang not in totals:
                        totals[lang] = found
                    else:
                        totals[lang] += found
        for lang, found in totals.items():
            used = np.flatnonzero(found)
            yield pd.DataFrame({"lang": lang, "bin": used, "n": found[used]})

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(counted, "lang string, bin int, n long")
    table = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique().tolist())
    found = np.zeros((len(langs), bins))
    places = {lang: i for i, lang in enumerate(langs)}
    found[table["lang"].map(places).to_numpy(dtype=int), table["bin"].to_numpy(dtype=int)] = table[
        "n"
    ].to_numpy()
    found += SMOOTHING
    return langs, np.log(found / found.sum(axis=1, keepdims=True)) if langs else found


def shares(likelihood: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
    """EM from equal shares: the shares of the rows and the log likelihood."""
    share = np.full(len(likelihood), 1.0 / len(likelihood))
    total = counts.sum()
    mixed = share @ likelihood
    for _ in range(rounds if len(likelihood) > 1 else 0):
        new = share * (likelihood @ (counts / mixed)) / total
        new /= new.sum()
        mixed = new @ likelihood
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(counts @ np.log(mixed))


def mixture(counts: np.ndarray, logs: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """``(languages, shares, score)`` of a document, the largest share first.

    Languages join in the order of their share in the mixture of all. A larger set is
    taken while it raises the likelihood by more than ``ORDERS * log(n)`` for the language
    it adds: each letter is in n-grams of ``ORDERS`` lengths, so their likelihood counts it
    that many times. The score is the share of the first language times its
    probability against the others taken alone.
    """
    used = np.flatnonzero(counts)
    n, log_p = counts[used].astype(float), logs[:, used]
    top = log_p.max(axis=0)
    likelihood, floor = np.exp(log_p - top), float(n @ top)
    alone = log_p @ n
    # One language: the most likely one. Ties go to the first by name.
    best = [int(np.argmax(alone))]
    kept, value = np.ones(1), float(alone[best[0]])
    if len(logs) > 1:
        order = np.argsort(-shares(likelihood, n)[0], kind="stable")
        penalty = ORDERS * np.log(max(2.0, n.sum()))
        for k in range(2, len(logs) + 1):
            chosen = sorted(order[:k].tolist())
            share, found = shares(likelihood[chosen], n)
            if found + floor <= value + penalty:
                break
            value = found + floor
            best, kept = chosen, share
    ranked = sorted(range(len(best)), key=lambda i: (-kept[i], best[i]))
    weight = np.exp((alone - alone.max()) / ORDERS)
    against = [i for i in range(len(logs)) if i not in best] + [best[ranked[0]]]
    sure = weight[best[ranked[0]]] / max(weight[against].sum(), 1e-300)
    score = float(np.clip(kept[ranked[0]] * sure, 0.0, 1.0))
    return [best[i] for i in ranked], kept[ranked], score


RESULT = "lang_pred string, score double, langs array<string>, shares array<double>"


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred, score, langs, shares``.

    ``und`` with score 0 and no languages for a null text, one without a letter, or if no
    language was learned. Whole texts count; the other columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))

    @F.pandas_udf(RESULT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        names, table = model.value
        for batch in texts:
            out = []
            for text in batch:
                counts = ngram_counts(text, letters, table.shape[1]) if names else None
                if counts is None:
                    out.append((UNKNOWN, 0.0, [], []))
                    continue
                found, share, score = mixture(counts, table)
                chosen = [names[i] for i in found]
                out.append((chosen[0], score, chosen, share.tolist()))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "langs", "shares"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score", "langs", "shares")]
    found = docs.select(*[F.col(f"`{c}`") for c in names], predict("text").alias("_found"))
    return found.select(*[F.col(f"`{c}`") for c in names], "_found.*")


def identify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs, shares`` of every row.

    Learned from the rows that are not held out and have a ``lang``; an empty table gives
    no rows. The prediction looks at the text alone.
    """
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    langs, logs = train(rows.where(~F.col("held_out")))
    found = identify(rows.select("doc_id", "held_out", "text"), langs, logs)
    return found.drop("text")
