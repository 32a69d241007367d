"""Quality rules: ordered decision lists learned from labelled text statistics.

``text_statistics`` counts words, symbols, repeated lines and repeated passages inside
each row. ``learn_rules`` grows a conjunction of thresholds on two thirds of the labelled
rows, one condition at a time by information gain, prunes it on the other third, keeps it
if it is precise there, takes the rows it covers away and starts the next one. The result
is an ordered list that ``rule_number`` turns into one conditional Spark expression.
Every step is an aggregate whose result has one row per feature, bin, side and label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.columns import words
from voxloom.llm.labelled import SAMPLE_ROWS, labelled_sample
from voxloom.session import cut_lineage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_STATISTICS = ["n_lines", "n_upper", "n_marks"]


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of ``STATISTICS`` and ``MORE_STATISTICS`` (longs).

    A null or empty text has only zeros. Columns of ``docs`` that have the name of a
    count are replaced. Nothing is shuffled: a text is worked on inside its row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [*STATISTICS, *MORE_STATISTICS]
    docs = docs.drop(*[c for c in docs.columns if c in names])
    split = docs.withColumn("_w", words(F.col("text"))).withColumn("_n", F.size("_w"))

    def window(first: Column, i: Column) -> Column:
        return F.xxhash64(first, *[F.get("_w", i + k) for k in range(1, WINDOW)])

    starts = F.slice("_w", F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = split.withColumn("_h", F.transform(starts, window)).withColumn("_lines", lines)
    # Only a text that holds an equal pair of windows pays for the search of their places.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    sort = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("_s", F.when(repeats, sort))

    def again(x: Column, j: Column) -> Column:
        before, after = F.get("_s", j - 1)["h"], F.get("_s", j + 1)["h"]
        return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(
            x["h"] == after, F.lit(False)
        )

    places = F.sort_array(F.transform(F.filter("_s", again), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, p: F.struct(
            (p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n")
        ),
        lambda s: s["n"],
    )
    joined = F.array_join("_w", "")
    counts = {
        "n_words": F.col("_n"),
        "word_chars": F.length(joined),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count(text, F.lit("[!?]")),
    }
    return sorted_.withColumns({k: v.cast("bigint") for k, v in counts.items()}).drop(
        "_w", "_n", "_h", "_lines", "_s"
    )


def base_failed() -> Column:
    """The fixed rule: fewer than 10 words, or over a fifth of them in repeated passages."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def features() -> dict[str, Column]:
    """What the conditions of a rule speak of."""

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "word_chars"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "marks_per_word": ratio("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def holds(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value >= F.lit(self.cut) if self.at_least else value < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut!r}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    hits: int
    false_hits: int

    def holds(self, values: dict[str, Column]) -> Column:
        return conjunction([c.holds(values) for c in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def conjunction(parts: list[Column]) -> Column:
    out = F.lit(True)
    for part in parts:
        out = out & part
    return out


def rule_number(rules: list[Rule], values: dict[str, Column]) -> Column:
    """1 for rows the first rule holds for, 2 for the second one's, ... else null."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.holds(values), F.lit(number)).otherwise(out)
    return out


def _best_condition(counts: list, cuts: dict[str, list[float]], base: tuple[int, int]):
    """The condition with the largest information gain over what holds so far."""
    old = math.log2(base[0] / (base[0] + base[1]))
    table: dict[tuple[str, int], list[int]] = {}
    for name, place, target, n in counts:
        table.setdefault((name, place), [0, 0])[0 if target else 1] += n
    best = (0.0, None, base)
    for name in sorted(cuts):
        above = [0, 0]
        for place in range(len(cuts[name]), 0, -1):
            p, n = table.get((name, place), [0, 0])
            above = [above[0] + p, above[1] + n]
            below = [base[0] - above[0], base[1] - above[1]]
            for at_least, (hits, misses) in ((True, above), (False, below)):
                if hits <= 0:
                    continue
                gain = hits * (math.log2(hits / (hits + misses)) - old)
                if gain > best[0] + 1e-9:
                    condition = Condition(name, at_least, cuts[name][place - 1])
                    best = (gain, condition, (hits, misses))
    return best[1], best[2]


def learn_rules(
    labelled: DataFrame,
    target: Column,
    max_rules: int = 12,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_hits: int = 5,
    bins: int = 48,
) -> list[Rule]:
    """Ordered rules for the rows of ``text_statistics`` where ``target`` is true.

    Thresholds are quantiles of a feature, over all rows and over the target rows. A rule
    enters the list if at least ``min_hits`` rows of the pruning side fall under it and
    ``min_precision`` of those are targets (one row of doubt is added). Rows with a null
    target are left out; no rows, or no target among them, give an empty list.
    """
    values = features()
    rows = cut_lineage(
        labelled.where(target.isNotNull()).select(
            target.alias("_target"),
            (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) < 2).alias("_grow"),
            *[v.alias(k) for k, v in values.items()],
        )
    )
    wanted = [i / bins for i in range(1, bins)]
    quantiles = rows.select(
        *[F.percentile_approx(k, wanted).alias(k) for k in values],
        *[
            F.percentile_approx(F.when(F.col("_target"), F.col(k)), wanted).alias(f"_{k}")
            for k in values
        ],
    ).first()
    cuts = {
        k: sorted({float(v) for v in [*(quantiles[k] or []), *(quantiles[f"_{k}"] or [])]})
        for k in values
    }
    plain = {k: F.col(k) for k in values}

    def place(name: str) -> Column:
        """How many cuts lie at or below the value."""
        ascending = F.array(*[F.lit(c) for c in cuts[name]])
        below = F.size(F.filter(ascending, lambda c: c <= F.col(name)))
        return F.struct(F.lit(name).alias("name"), below.alias("place"))

    places = F.array(*[place(k) for k in values if cuts[k]])
    rules: list[Rule] = []
    while len(rules) < max_rules and any(cuts.values()):
        left = rows.where(rule_number(rules, plain).isNull())
        conditions: list[Condition] = []
        base = None
        while len(conditions) < max_conditions:
            here = left.where(F.col("_grow")).where(conjunction([c.holds(plain) for c in conditions]))
            counts = (
                here.select("_target", F.explode(places).alias("f"))
                .groupBy("f.name", "f.place", "_target")
                .count()
                .collect()
            )
            if base is None:
                first = [r for r in counts if r[0] == counts[0][0]]
                base = (sum(r[3] for r in first if r[2]), sum(r[3] for r in first if not r[2]))
                if not base[0]:
                    break
            if not base[1]:
                break
            condition, after = _best_condition(counts, cuts, base)
            if condition is None:
                break
            conditions.append(condition)
            base = after
        if not conditions:
            break
        # Pruning: the shortest prefix with the best balance on rows that didn't grow it.
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        held = [conjunction([c.holds(plain) for c in p]) for p in prefixes]
        found = left.where(~F.col("_grow")).agg(
            *[F.count(F.when(h & F.col("_target"), 1)) for h in held],
            *[F.count(F.when(h & ~F.col("_target"), 1)) for h in held],
        ).first()
        hits, misses = found[: len(held)], found[len(held) :]
        best = max(
            range(len(held)), key=lambda i: ((hits[i] - misses[i]) / max(1, hits[i] + misses[i]), -i)
        )
        precision = (hits[best] + 1) / (hits[best] + misses[best] + 2)
        enough = hits[best] >= min_hits and hits[best] >= min_precision * (
            hits[best] + misses[best]
        )
        if not enough or precision < 0.5:
            break
        rules.append(Rule(tuple(prefixes[best]), hits[best], misses[best]))
    return rules


def quality_rules(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules that reject documents like those labelled ``quality`` 0.

    They are learned from about ``sample_rows`` labelled documents at most.
    """
    sample = labelled_sample(docs.select("doc_id", "text"), labels, sample_rows)
    return learn_rules(text_statistics(sample), F.col("quality") == 0)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with their counts, ``base_failed``, ``rule`` (null: none holds), ``kept``.

    An empty table gives an empty result; null and empty texts fail the base rule.
    """
    counted = text_statistics(docs)
    counted = counted.withColumn("base_failed", base_failed())
    counted = counted.withColumn("rule", rule_number(rules, features()))
    return counted.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns and rows of ``docs`` that no rule rejects."""
    taken = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_row"), "doc_id", "text")
    judged = judge(inner, quality_rules(docs, labels))
    # A filter would be pushed below the counts, with each of them written out in full again
    # and again; it stays above a column that isn't deterministic.
    keep = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    judged = judged.withColumn("_keep", keep).where("_keep")
    return judged.select(*[F.col("_row")[c].alias(c) for c in taken])
