"""Bounds that a requirement states: direction, amount and unit, and which is stricter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words before an amount that make it the most, or the least, that is allowed.
MOST = [
    "no more than", "not more than", "no longer than", "not exceeding", "not exceed", "no later than",
    "less than", "fewer than", "lower than", "shorter than", "at most", "up to", "a maximum of",
    "maximum of", "within", "under", "below",
]
LEAST = [
    "no less than", "not less than", "no fewer than", "more than", "greater than", "higher than",
    "longer than", "at least", "a minimum of", "minimum of", "above", "over",
]

# Unit words by what they measure, each with its size in the smallest unit of that kind.
UNITS = {
    "time": {
        "ms": 1, "millisecond": 1, "milliseconds": 1, "s": 1_000, "sec": 1_000, "secs": 1_000,
        "second": 1_000, "seconds": 1_000, "min": 60_000, "mins": 60_000, "minute": 60_000,
        "minutes": 60_000, "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
        "day": 86_400_000, "days": 86_400_000,
    },
    "size": {"kb": 1, "mb": 1_000, "gb": 1_000_000, "tb": 1_000_000_000},
    "share": {"%": 1, "percent": 1},
}

_SIGNS_MOST = ["<", "<=", "≤"]


def _any(words: list[str]) -> str:
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return "|".join(w.replace(" ", r"\s+") for w in ordered)


_UNIT = _any([word for kind in UNITS.values() for word in kind])
BOUND = (
    rf"(?i)(?:(?<![\p{{L}}\p{{Nd}}])(?<!(?:not|never)\s)({_any(MOST + LEAST)})\s+|([<>]=?|[≤≥])\s*)"
    rf"([0-9]+(?:[.,][0-9]+)*)(?:\s*({_UNIT}))?(?!\p{{L}}|\p{{Nd}}|[.,]\p{{Nd}})"
)


def _amount(text: Column) -> Column:
    """A comma before three digits parts thousands, any other one is a decimal sign."""
    plain = F.regexp_replace(text, r",(?=[0-9]{3}(?![0-9]))", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def bounds_of(col: Column) -> Column:
    """The bounds of a text in order: ``phrase, most, kind, amount`` (in the smallest unit).

    A direction word or sign must stand right before the amount ("within 2 s", "> 5"); an amount
    after "not" or without a direction is no bound. An amount of no known unit has kind ''.
    """
    phrases = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(BOUND), 0)
    sizes = F.create_map(
        *[F.lit(v) for kind in UNITS.values() for w, size in kind.items() for v in (w, float(size))]
    )
    kinds = F.create_map(*[F.lit(v) for kind, words in UNITS.items() for w in words for v in (w, kind)])
    most = F.array(*[F.lit(w) for w in MOST + _SIGNS_MOST])

    def read(phrase: Column) -> Column:
        word, sign, amount, unit = (F.lower(F.regexp_extract(phrase, BOUND, i)) for i in range(1, 5))
        direction = F.regexp_replace(F.concat(word, sign), r"\s+", " ")
        return F.struct(
            phrase.alias("phrase"),
            F.array_contains(most, direction).alias("most"),
            F.coalesce(F.try_element_at(kinds, unit), F.lit("")).alias("kind"),
            (_amount(amount) * F.coalesce(F.try_element_at(sizes, unit), F.lit(1.0))).alias("amount"),
        )

    return F.transform(phrases, read)


def without_bounds(col: Column) -> Column:
    """The text with a blank in place of each bound."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), BOUND, " ")


def bound_kinds(bounds: Column) -> Column:
    """Directions and kinds in order, as one text: only equal ones can be compared."""
    named = F.transform(
        bounds, lambda b: F.concat(F.when(b["most"], F.lit("<")).otherwise(F.lit(">")), b["kind"])
    )
    return F.array_join(named, " ")


def strictest(rows: DataFrame, group: str, key: str, bounds: str) -> DataFrame:
    """``group, phrases``: at each place the phrase that allows least (the first on a tie).

    The least of the most, the most of the least. Totals of a group are one row a place, so a
    group of any size is combined before it is shuffled.
    """
    places = rows.select(group, key, F.posexplode(bounds).alias("_i", "_b"))
    strict = F.when(F.col("_b.most"), F.col("_b.amount")).otherwise(-F.col("_b.amount"))
    best = places.groupBy(group, "_i").agg(
        F.min_by("_b.phrase", F.struct(strict, F.col(key))).alias("_phrase")
    )
    return best.groupBy(group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_i", "_phrase"))), lambda x: x["_phrase"]
        ).alias("phrases")
    )


def with_phrases(col: Column, phrases: Column) -> Column:
    """The text with its bounds replaced by ``phrases``, place by place."""
    around = F.split(col, BOUND, -1)
    woven = F.zip_with(
        around, phrases, lambda text, phrase: F.concat(text, F.coalesce(phrase, F.lit("")))
    )
    return F.when(F.size(phrases) > 0, F.array_join(woven, "")).otherwise(col)
