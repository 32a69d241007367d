"""Merge similar requirements of the same kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.ranking import id_bucket, number_rows
from voxloom.operators.bounds import (
    bound_kinds,
    bounds_of,
    strictest,
    with_phrases,
    without_bounds,
)
from voxloom.operators.components import connected_components
from voxloom.operators.responses import comment_ids
from voxloom.session import cut_lineage

GROUP_ROWS = 4_096
LISTED_IDS = 10_000


def requirement_tokens(col: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, as an array."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), 0)


def stated_numbers(col: Column) -> Column:
    """The numbers a text states, in ascending order of their digits, as one text."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), 0)
    return F.array_join(F.sort_array(found), " ")


def token_sets(df: DataFrame, text: str, key: str, within: list[str]) -> DataFrame:
    """One row per distinct token set: its smallest key, the set as token numbers.

    Tokens are numbered from the rarest to the most frequent, so a sorted set
    starts with its rarest token and later steps move numbers, not text.
    """
    sets = (
        df.withColumn("_set", F.sort_array(F.array_distinct(requirement_tokens(F.col(text)))))
        .where(F.size("_set") > 0)
        .groupBy(*within, "_set")
        .agg(F.min(key).alias("node"))
    )
    tokens = sets.select("node", F.explode("_set").alias("_t"))
    frequency = tokens.groupBy("_t").agg(F.count(F.lit(1)).alias("_f"))
    numbers = number_rows(
        frequency.withColumn("_h", F.xxhash64("_t")),
        ["_f", "_h", "_t"],
        {"f": F.col("_f"), "h": F.shiftright("_h", 52)},
        out="_no",
    )
    ordered = (
        tokens.join(numbers.select("_t", "_no"), "_t")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list("_no")).alias("tokens"))
    )
    return sets.select("node", *within).join(ordered, "node")


def _prefix(threshold: float) -> Column:
    """Two sets with Jaccard >= threshold share a token among these first ones."""
    size = F.size("tokens")
    keep = size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    return F.slice("tokens", F.lit(1), keep)


def similar_pairs(
    df: DataFrame,
    text: str = "description",
    key: str = "requirement_no",
    within: list[str] | None = None,
    threshold: float = 0.6,
) -> DataFrame:
    """All pairs of distinct token sets with Jaccard >= ``threshold``, each once.

    Pairs meet on a rare shared token: the tokens of a set are ordered by
    frequency and only its first ones can be the first shared one. A token held
    by many sets is split into sub-groups, so its pairs are tested in many
    tasks, and a pair is emitted only after the test inside the join.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    within = within or []
    sets = cut_lineage(token_sets(df, text, key, within)).withColumn("prefix", _prefix(threshold))
    rows = sets.select("node", *within, "tokens", "prefix", F.explode("prefix").alias("_t"))
    groups = rows.groupBy(*within, "_t").agg(F.count(F.lit(1)).alias("_c"))
    groups = groups.where("_c > 1").withColumn("_subs", F.ceil(F.col("_c") / GROUP_ROWS).cast("int"))
    rows = rows.join(groups.drop("_c"), within + ["_t"])
    left = rows.select(
        *within, "_t", F.pmod(F.xxhash64("node"), F.col("_subs")).cast("int").alias("_sub"),
        F.col("node").alias("a"), F.col("tokens").alias("_ta"), F.col("prefix").alias("_pa"),
    )
    right = rows.select(
        *[F.col(c).alias(f"_r_{c}") for c in within],
        F.col("_t").alias("_rt"),
        F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("_rsub"),
        F.col("node").alias("b"), F.col("tokens").alias("_tb"), F.col("prefix").alias("_pb"),
    )
    common = F.size(F.array_intersect("_ta", "_tb"))
    jaccard = common / (F.size("_ta") + F.size("_tb") - common)
    shorter = F.least(F.size("_ta"), F.size("_tb"))
    longer = F.greatest(F.size("_ta"), F.size("_tb"))
    condition = (F.col("_t") == F.col("_rt")) & (F.col("_sub") == F.col("_rsub"))
    for c in within:
        condition = condition & (F.col(c) == F.col(f"_r_{c}"))
    condition = (
        condition
        & (F.col("a") < F.col("b"))
        & (shorter >= longer * threshold - 1e-9)
        & (F.array_intersect("_pa", "_pb")[0] == F.col("_t"))
        & (jaccard >= threshold - 1e-9)
    )
    return left.join(right, condition).select("a", "b", jaccard.alias("jaccard"))


def merge_groups(
    df: DataFrame, key: str, within: list[str], threshold: float, text: str = "description"
) -> DataFrame:
    """``key, group`` for every row: rows linked by similar token sets share a group.

    Likeness leaves stated bounds aside ("within 2 s", "under 3 seconds"): rows whose bounds
    have the same directions and kinds may share a group. Rows that state different numbers
    otherwise ("in 2 seconds", "version 30") are different requirements however alike their
    words are, and never share one.
    """
    kinds = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in within]
    within = [*within, "_numbers", "_bounds"]
    plain = without_bounds(F.col(text))
    rows = df.select(
        key, plain.alias(text), *kinds, stated_numbers(plain).alias("_numbers"),
        bound_kinds(bounds_of(F.col(text))).alias("_bounds"),
    )
    rows = rows.withColumn("_set", F.sort_array(F.array_distinct(requirement_tokens(F.col(text)))))
    nodes = rows.where(F.size("_set") > 0).groupBy(*within, "_set").agg(F.min(key).alias("_node"))
    edges = similar_pairs(rows.drop("_set"), text, key, within, threshold)
    components = connected_components(edges, "a", "b")
    return (
        rows.join(nodes, within + ["_set"], "left")
        .withColumn("_node", F.coalesce("_node", F.col(key)))
        .join(components, F.col("_node") == F.col("node"), "left")
        .select(key, F.coalesce("component", "_node").alias("group"))
    )


def require_unique(df: DataFrame, key: str) -> None:
    """A key that two rows share would multiply them in the joins on it."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} is on {twice[0][1]} rows")


def consolidate_tables(
    requirements: DataFrame,
    key: str = "requirement_no",
    threshold: float = 0.6,
    listed_ids: int = LISTED_IDS,
) -> tuple[DataFrame, DataFrame]:
    """``(unified, citations)``: similar requirements of one kind merged, comments united.

    The description is the longest of a group (the first one on a tie); where members
    state different bounds, it states the strictest of them. Ids run
    per kind in the order of the first member. ``unified`` has one row for each
    requirement; ``based_on_comments`` lists its comments in order, the first
    ``listed_ids`` of ``n_comments``, and ``citations`` (``requirement_id, ID``)
    has all of them. A group that cites no number keeps the text of its first
    member that has one.
    """
    require_unique(requirements, key)
    within = ["type", "nfr_type"]
    groups = merge_groups(requirements, key, within, threshold)
    joined = requirements.join(groups, key)
    best = F.max_by(F.struct("description", *within), F.struct(F.length("description"), -F.col(key)))
    said = F.trim(F.col("based_on_comments"))
    said = F.when(said != "", said)
    merged = joined.groupBy("group").agg(
        best.alias("_best"),
        F.min(key).alias("_first"),
        F.count(F.lit(1)).alias("n_merged"),
        F.min_by(said, F.when(said.isNotNull(), F.col(key))).alias("_said"),
    ).select("group", "_best.*", "_first", "n_merged", "_said")
    stated = joined.select("group", key, bounds_of(F.col("description")).alias("_bounds"))
    merged = (
        merged.join(strictest(stated, "group", key, "_bounds"), "group", "left")
        .withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
        .withColumn("description", with_phrases(F.col("description"), F.col("phrases")))
        .drop("phrases")
    )
    kind = F.when(F.upper("type") == "FUNCTIONAL", "FR").otherwise("NFR")
    numbered = number_rows(
        merged.withColumn("_kind", kind), ["_first"], {"slice": id_bucket("_first")},
        within=["_kind"], out="_no",
    )
    numbered = numbered.withColumn("requirement_id", F.format_string("%s%03d", "_kind", "_no"))
    cited = joined.select(
        "group", F.explode(comment_ids(F.col("based_on_comments"))).alias("ID")
    ).distinct()
    ranked = number_rows(cited, ["ID"], {"slice": id_bucket("ID")}, within=["group"], out="_rank")
    ids = F.sort_array(F.collect_list(F.when(F.col("_rank") <= listed_ids, F.col("ID"))))
    lists = ranked.groupBy("group").agg(
        F.array_join(ids.cast("array<string>"), ", ").alias("_list"),
        F.count(F.lit(1)).alias("n_comments"),
    )
    unified = numbered.join(lists, "group", "left").select(
        "requirement_id",
        "type",
        "description",
        F.coalesce("_list", "_said", F.lit("Unknown")).alias("based_on_comments"),
        "nfr_type",
        "n_merged",
        F.coalesce("n_comments", F.lit(0)).alias("n_comments"),
    )
    return unified, cited.join(numbered.select("group", "requirement_id"), "group").select(
        "requirement_id", "ID"
    )


def consolidate(
    requirements: DataFrame, key: str = "requirement_no", threshold: float = 0.6
) -> DataFrame:
    """The unified table of ``consolidate_tables``: one row for each requirement."""
    return consolidate_tables(requirements, key, threshold)[0]
