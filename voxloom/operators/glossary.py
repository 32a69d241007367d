"""Glossary features: count of contained terms (RC), covered positions (RP)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxloom.checks import require_choice, require_columns
from voxloom.functions.text import shifted, words
from voxloom.session import cut_lineage

# A glossary up to this many terms travels with the plan as one array.
MAX_ARRAY_TERMS = 2_000
# Characters in a sequence of the filter, and bits of the Bloom filter in front of the join
# (128 KB in the plan at any size of the glossary; more terms only let more sequences pass).
GRAM = 3
BLOOM_BITS = 1 << 20
# A glossary up to so many distinct terms and characters is held by every task; a task keeps
# the terms of so many runs of a text, none of them longer than that.
MAX_HELD_TERMS, MAX_HELD_CHARS = 1 << 18, 1 << 22
CACHED_RUNS, CACHED_LENGTH = 1 << 18, 64


def tokenised_glossary(glossary: DataFrame) -> DataFrame:
    """Each term with its words as an array."""
    require_columns(glossary, ["Term"])
    return glossary.withColumn("tokens", words(F.col("Term")))


def relevant_count(
    df: DataFrame,
    glossary: DataFrame,
    text: str = "Review",
    key: str = "review_id",
    method: str = "auto",
) -> DataFrame:
    """Add ``rc``: how many glossary rows occur in the text as a substring.

    A small glossary (its rows are counted first) is one array inside the plan
    and the whole job is a map. A larger one of bounded size is held by the tasks, which
    look up the words of a text (``_counts_by_runs``). One beyond that
    is joined by its ``rarest_grams``: a text sends only sequences that pass a Bloom filter
    of the keys, and a text and a term that share a key are compared. A key is as rare as
    the texts allow; one that many texts share all the same is left to the skew join of
    adaptive execution.
    """
    require_choice("method", method, ("auto", "array", "join"))
    terms = glossary.select("Term").where(F.col("Term").isNotNull())
    if method == "auto":
        size = terms.limit(MAX_ARRAY_TERMS + 1).count()
        method = "array" if size <= MAX_ARRAY_TERMS else "join"
    if method == "array":
        listed = terms.agg(F.collect_list("Term")).scalar()
        hits = F.filter(F.col("_terms"), lambda t: F.contains(F.col(text), t))
        return df.withColumn("_terms", listed).withColumn("rc", F.size(hits)).drop("_terms")
    weighted = terms.groupBy("Term").agg(F.count(F.lit(1)).alias("_w"))
    n, chars = weighted.agg(F.count(F.lit(1)), F.sum(F.length("Term"))).first()
    if n <= MAX_HELD_TERMS and (chars or 0) <= MAX_HELD_CHARS:
        own = _counts_by_runs({r["Term"]: r["_w"] for r in weighted.collect()}, F.col(text))
        # A row without a key meets no term, and rows that share one meet each other's.
        found = df.withColumn("rc", F.when(F.col(key).isNotNull(), own).otherwise(0))
        shared = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
        if shared.isEmpty():
            return found
        met = _counts_by_join(df, terms, text, key, shared).withColumnRenamed("rc", "_met")
        return found.join(met, key, "left").withColumn("rc", F.coalesce("_met", "rc")).drop("_met")
    return df.join(_counts_by_join(df, terms, text, key), key, "left").withColumn(
        "rc", F.coalesce("rc", F.lit(0))
    )


def _grams(text: Column, lengths: list[int]) -> Column:
    """The distinct sequences of so many characters (0 to ``GRAM``) of a text."""
    here = shifted(F.split(text, ""), GRAM)

    def of_length(n: int) -> Column:
        if n == 0:
            return F.when(text.isNotNull(), F.array(F.lit("")))
        # A sequence that would reach past the end is null.
        return F.transform(here, lambda place: F.concat(*[place[f"w{i}"] for i in range(n)]))

    every = F.concat(*[of_length(n) for n in lengths])
    return F.array_distinct(F.filter(every, lambda g: g.isNotNull()))


def _lengths(strings: DataFrame, column: str) -> list[int]:
    """The lengths up to ``GRAM`` that occur, a handful of numbers."""
    length = F.least(F.length(column), F.lit(GRAM)).alias("_l")
    return [r["_l"] for r in strings.select(length).distinct().orderBy("_l").collect()] or [GRAM]


def _place(gram: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(gram, F.lit(seed)), F.lit(BLOOM_BITS))


def _bloom(keys: DataFrame) -> Column:
    """A Bloom filter over the column ``_k``: one array of ``BLOOM_BITS / 64`` words."""
    places = keys.select(F.explode(F.array(_place(F.col("_k"), 1), _place(F.col("_k"), 2))).alias("_bit"))
    filled = places.groupBy(F.shiftright("_bit", 6).alias("_at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_bit & 63 AS INT))")).alias("_word")
    )
    slots = keys.sparkSession.range(BLOOM_BITS // 64).withColumnRenamed("id", "_at")
    words_of = slots.join(filled, "_at", "left").select(
        F.struct("_at", F.coalesce("_word", F.lit(0)).alias("_word")).alias("_slot")
    )
    listed = F.transform(F.array_sort(F.collect_list("_slot")), lambda slot: slot["_word"])
    return words_of.agg(listed).scalar()


def _may_hold(bloom: Column, gram: Column) -> Column:
    found = F.lit(True)
    for seed in (1, 2):
        place = _place(gram, seed)
        word = F.get(bloom, F.shiftright(place, 6).cast("int"))
        bit = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int"))
        found = found & (bit.bitwiseAND(F.lit(1)) == 1)
    return found


def rarest_grams(df: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """``Term, _w, _k, _n``: each term that may occur, its weight and its rarest sequence.

    A text that holds a term holds all its sequences of ``GRAM`` characters (the whole term
    if it is shorter), so the one that the fewest texts hold (``_n`` texts) is its key. A
    term with a sequence that no text holds is left out: it occurs nowhere.
    """
    weighted = terms.groupBy("Term").agg(F.count(F.lit(1)).alias("_w"))
    length = F.least(F.length("Term"), F.lit(GRAM))
    longest = F.filter(_grams(F.col("Term"), list(range(GRAM + 1))), lambda g: F.length(g) == length)
    grams = weighted.select("Term", "_w", F.explode(longest).alias("_k"))
    lengths = _lengths(weighted, "Term")
    held = _held(df.select(text), grams, text, lengths).groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    texts = F.coalesce("_n", F.lit(0))
    keyed = grams.join(held, "_k", "left").groupBy("Term", "_w").agg(
        F.min_by("_k", F.struct(texts, "_k")).alias("_k"), F.min(texts).alias("_n")
    )
    return keyed.where(F.col("_n") > 0)


def _held(df: DataFrame, keys: DataFrame, text: str, lengths: list[int]) -> DataFrame:
    """One row for every text and sequence in it that may be one of ``keys._k``."""
    bloom = _bloom(keys.select("_k").distinct())
    others = [c for c in df.columns if c != text]
    sequences = df.select(*others, F.explode(_grams(F.col(text), lengths)).alias("_k"))
    return sequences.where(_may_hold(bloom, F.col("_k")))


def _counts_by_runs(weights: dict[str, int], text: Column) -> Column:
    """The sum of the weights of the terms that a text holds.

    A term without a blank is held by a text if a run of the terms' own characters in it
    holds it, so a task finds the terms of each distinct run once: where a term's first
    characters are, the pieces of the lengths of such terms are looked up. Of a term with
    blanks the longest part is looked up, and the text decides.
    """
    held: dict[str, int] = {}
    own, spaced = [], {}
    for term, weight in sorted(weights.items()):
        run = max(term.split(" "), key=len)
        i = held.setdefault(run, len(held))
        if i == len(own):
            own.append(0)
        if run and run == term:
            own[i] = weight
        else:
            spaced.setdefault(i, []).append((term, weight))
    starts: dict[str, set[int]] = {}
    for run in held:
        if len(run) >= GRAM:
            starts.setdefault(run[:GRAM], set()).add(len(run))
    short = sorted({len(run) for run in held if 0 < len(run) < GRAM})
    letters = "".join(map(re.escape, sorted({c for run in held for c in run})))
    cuts = re.compile(f"[{letters}]+" if letters else "(?!)")
    always = [held[""]] if "" in held else []
    single = not spaced and all(w == 1 for w in own)
    shared = SparkSession.active().sparkContext.broadcast((held, starts, own, spaced))

    @pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, starts, own, spaced = shared.value
        known: dict[str, tuple[int, ...]] = {}

        def found_in(run: str) -> tuple[int, ...]:
            found = set()
            for i in range(len(run)):
                head = run[i : i + GRAM]
                for size in starts.get(head, ()):
                    if (piece := run[i : i + size]) in number:
                        found.add(number[piece])
                for size in short:
                    if (piece := head[:size]) in number:
                        found.add(number[piece])
            if len(run) <= CACHED_LENGTH:
                if len(known) >= CACHED_RUNS:
                    known.clear()
                known[run] = tuple(found)
            return tuple(found)

        def count(value: str | None) -> int:
            if value is None:
                return 0
            listed = [(run, known.get(run)) for run in set(cuts.findall(value))]
            held = set(always).union(*[found_in(run) if ids is None else ids for run, ids in listed])
            if single:
                return len(held)
            more = [w for i in held & spaced.keys() for term, w in spaced[i] if term in value]
            return sum([own[i] for i in held]) + sum(more)

        for values in batches:
            yield pd.Series([count(v) for v in values], dtype="int32")

    return counted(text)


def _counts_by_join(
    df: DataFrame, terms: DataFrame, text: str, key: str, only: DataFrame | None = None
) -> DataFrame:
    """``key, rc`` of the keys that meet a term; ``only`` names the keys that are asked for."""
    keyed = cut_lineage(rarest_grams(df, terms, text))
    if only is not None:
        df = df.join(only, key, "left_semi")
    candidates = _held(df.select(key, text), keyed, text, _lengths(keyed, "_k")).join(keyed, "_k")
    verified = candidates.select(key, "Term", "_w").join(df.select(key, text), key)
    verified = verified.where(F.contains(F.col(text), F.col("Term")))
    return verified.groupBy(key).agg(F.sum("_w").cast("int").alias("rc"))


def count_vector(df: DataFrame, size: int, full: bool = True, out: str = "rc_vector") -> DataFrame:
    """``rc`` in every slot of a vector, or in slot 0 with zeros after it."""
    count = F.col("rc").cast("double")
    if full:
        values = F.array_repeat(count, size)
    else:
        values = F.concat(F.array(count), F.array_repeat(F.lit(0.0), size - 1))
    return df.withColumn(out, array_to_vector(values))


def covered_positions(
    df: DataFrame, glossary: DataFrame, text: str = "Review", key: str = "review_id"
) -> DataFrame:
    """One row per word position of a text that some glossary term covers.

    Word sequences of each term length (a handful of numbers, read first) meet
    the terms in an equality join; a match at position p of a term with m words
    covers p to p + m - 1.
    """
    return _covered(df, glossary, text, key).distinct()


def _covered(df: DataFrame, glossary: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``covered_positions``, a position once for each term that covers it."""
    terms = (
        tokenised_glossary(glossary)
        .select(F.array_join("tokens", " ").alias("_gram"), F.size("tokens").alias("_m"))
        .where(F.col("_m") > 0)
        .distinct()
    )
    lengths = [r["_m"] for r in terms.select("_m").distinct().orderBy("_m").collect()]
    if not lengths:
        lengths = [1]
    tokens = df.select(key, words(F.col(text)).alias("_tokens")).where(F.size("_tokens") > 0)
    starts = tokens.select(
        key, F.posexplode(shifted(F.col("_tokens"), lengths[-1])).alias("_p", "_w")
    )
    here = [F.col("_w")[f"w{i}"] for i in range(lengths[-1])]
    sequences = [
        F.when(
            here[m - 1].isNotNull(),
            F.struct(F.lit(m).alias("_m"), F.concat_ws(" ", *here[:m]).alias("_gram")),
        )
        for m in lengths
    ]
    grams = (
        starts.select(key, "_p", F.explode(F.array(*sequences)).alias("_g"))
        .where(F.col("_g").isNotNull())
        .select(key, "_p", "_g.*")
    )
    matches = grams.join(terms, ["_gram", "_m"])
    return matches.select(
        key, F.explode(F.sequence(F.col("_p"), F.col("_p") + F.col("_m") - 1)).alias("position")
    )


def position_vector(
    df: DataFrame,
    glossary: DataFrame,
    size: int,
    text: str = "Review",
    key: str = "review_id",
    out: str = "rp_vector",
) -> DataFrame:
    """0/1 vector of ``size`` slots: the covered word positions, counted round and round.

    Position p is in slot p mod ``size``, so a text of at most ``size`` words has its
    own positions, and every hit of a longer text is in the vector too.
    """
    place = F.col("position") % size
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)
    # A bit for each slot, 64 to a number: the tasks combine them before the shuffle.
    masks = [
        F.coalesce(F.bit_or(F.when(F.floor(place / 64) == i, one)), F.lit(0)).alias(f"_bits{i}")
        for i in range(-(-size // 64))
    ]
    covered = _covered(df, glossary, text, key).groupBy(key).agg(*masks)
    held = [F.coalesce(f"_bits{i}", F.lit(0)) for i in range(len(masks))]
    slots = [
        F.shiftright(held[i // 64], i % 64).bitwiseAND(F.lit(1)).cast("double") for i in range(size)
    ]
    joined = df.join(covered, key, "left").withColumn(out, array_to_vector(F.array(*slots)))
    return joined.drop(*[f"_bits{i}" for i in range(len(masks))])
