"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; the target over the source's size is the
expected number of copies of each of its documents. The whole part is taken as it
is. The fractional parts are rounded together: two documents with fractions trade
words in a random direction until one fraction is 0 or 1, the other goes on to the
next document. The words of a pair never change by a trade, and a trade keeps the
expected copies of both. The last open document of a source is rounded to the nearer
side, so a source ends within half a document of its target.

The trades run as a reduction tree. Documents of a source are dealt over groups by
hash, a group is folded inside one row and leaves at most one document with a
fraction, and those meet in the groups of the next level, until one is left. A source
with a third of all documents is many groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.columns import let, number_all, uniform, words
from voxloom.session import cut_lineage

GROUP = 64
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: list[float], ceiling: float) -> DataFrame:
    """``source, n_docs, source_size, target`` from ``source, size`` rows.

    Sources in code-point order, null last, take the weights in turn and share the
    words of all; a target stops at ``ceiling`` times its source's size and the
    excess is shared again by weight until no target is above.
    """
    per_source = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("size").alias("source_size"),
        F.count(F.when(F.col("size") > 0, 1)).alias("n_items"),
    )
    numbered = number_all(
        per_source, [F.col("source").isNull().asc(), F.col("source").asc()], "_place"
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.pmod(F.col("_place"), F.lit(len(weights))).cast("int")
    table = cut_lineage(
        numbered.withColumn("_weight", F.get(cycle, place))
        .withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
        .drop("_place")
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    # Every round adds sources to the capped ones, so the level only rises.
    level, capped = 0.0, -1
    while True:
        is_capped = F.col("_cap") < F.col("_weight") * F.lit(level)
        held, free, n = table.agg(
            F.coalesce(F.sum(F.when(is_capped, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_capped, F.col("_weight"))), F.lit(0.0)),
            F.count(F.when(is_capped, 1)),
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level))
    return table.select("source", "n_docs", "n_items", "source_size", target.alias("target"))


def _trade(state: Column, item: Column, seed: int, level: int) -> Column:
    """One trade between the open document of the state and the next one."""
    a, b = state["open"], item
    up = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
    down = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
    draw = uniform(a["h"], b["h"], F.lit(seed), F.lit(level))

    def with_p(row: Column, p: Column) -> Column:
        return row.withField("p", p)

    def settled(rows: tuple[Column, Column]) -> Column:
        done, open_ = rows
        return F.struct(open_.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))

    def after(t: Column) -> Column:
        zero, one = F.lit(0.0), F.lit(1.0)
        a_to_one = settled((with_p(a, one), with_p(b, b["p"] - t["up"] / b["size"])))
        b_to_zero = settled((with_p(b, zero), with_p(a, a["p"] + t["up"] / a["size"])))
        a_to_zero = settled((with_p(a, zero), with_p(b, b["p"] + t["down"] / b["size"])))
        b_to_one = settled((with_p(b, one), with_p(a, a["p"] - t["down"] / a["size"])))
        raises = t["draw"] * (t["up"] + t["down"]) < t["down"]
        return (
            F.when(raises & (a["size"] * (1 - a["p"]) <= b["size"] * b["p"]), a_to_one)
            .when(raises, b_to_zero)
            .when(a["size"] * a["p"] <= b["size"] * (1 - b["p"]), a_to_zero)
            .otherwise(b_to_one)
        )

    return let(F.struct(up.alias("up"), down.alias("down"), draw.alias("draw")), after)


def _fold(items: DataFrame, groups: int, seed: int, level: int) -> DataFrame:
    """Fold every group: ``source, state`` with the settled documents and the open one."""
    kind = items.schema["item"].dataType.simpleString()
    key = F.pmod(F.xxhash64("item.h", F.lit(seed), F.lit(-1 - level)), F.lit(groups))
    grouped = (
        items.withColumn("_group", key)
        .groupBy("source", "_group")
        .agg(F.sort_array(F.collect_list("item")).alias("_items"))
    )
    start = F.struct(
        F.get("_items", F.lit(0)).alias("open"), F.array().cast(f"array<{kind}>").alias("done")
    )
    rest = F.slice("_items", F.lit(2), F.size("_items"))
    state = F.aggregate(rest, start, lambda s, x: _trade(s, x, seed, level))
    return cut_lineage(grouped.select("source", state.alias("state")))


def mix_sizes(
    sizes: DataFrame,
    weights: list[float],
    ceiling: float = 3.0,
    seed: int = 17,
    group: int = GROUP,
) -> DataFrame:
    """Copies of every row of ``key, doc_id, source, size``.

    Returns those columns with ``source_size, target, copies``. Each row is a unit of
    its own, rows that repeat included. A row of size 0 takes no part (0 copies). A
    rerun over the same rows gives the same copies; ``key`` is a long that tells the
    rows apart and steers the draws.
    """
    sizes = cut_lineage(sizes)
    targets = cut_lineage(source_targets(sizes, weights, ceiling))
    n_sources, largest = targets.agg(F.count(F.lit(1)), F.max("n_items")).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
    rates = targets.select(
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.least(F.floor(F.coalesce(rate, F.lit(0.0))), F.lit(int(ceiling))).alias("_whole"),
        F.coalesce(rate, F.lit(0.0)).alias("_rate"),
    )
    # The table of sources is sent whole only while it is counted to be small.
    small = n_sources <= BROADCAST_SOURCES
    rates = F.broadcast(rates) if small else rates
    same = F.col("source").eqNullSafe(F.col("_source"))
    rated = sizes.join(rates, same).withColumn("_p", F.col("_rate") - F.col("_whole"))
    item = F.struct(
        F.xxhash64("key", F.lit(seed)).alias("h"),
        "key",
        "doc_id",
        F.col("size").cast("double").alias("size"),
        F.col("_p").alias("p"),
    )
    moving = (F.col("size") > 0) & (F.col("_p") > 0)
    items = rated.where(moving).select("source", item.alias("item"))
    still = rated.where(~moving).select(
        "source", "key", "doc_id", "size", F.lit(0).alias("bit")
    )
    parts, level = [still], 0
    groups = max(1, math.ceil((largest or 0) / group))

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select(
            "source",
            "item.key",
            "item.doc_id",
            F.col("item.size").cast("bigint").alias("size"),
            F.when(F.col("item.p") >= 0.5, 1).otherwise(0).alias("bit"),
        )

    while True:
        folded = _fold(items, groups, seed, level)
        parts.append(rows_of(folded.select("source", F.explode("state.done").alias("item"))))
        items = folded.select("source", F.col("state.open").alias("item"))
        if groups == 1:
            parts.append(rows_of(items))
            break
        groups, level = math.ceil(groups / group), level + 1
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    copies = F.when(F.col("size") > 0, F.col("_whole") + F.col("bit")).otherwise(0)
    return rounded.join(rates, same).select(
        "key",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("bigint").alias("copies"),
    )


def row_key() -> Column:
    """A number for a document row: equal rows share it, others differ."""
    return F.xxhash64("doc_id", "text", "source")


def sized(docs: DataFrame) -> DataFrame:
    """``key, doc_id, source, size``; the size counts words, 0 for a null text."""
    return docs.select(
        row_key().alias("key"),
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
    )


def mix_documents(docs: DataFrame, weights: list[float], ceiling: float = 3.0) -> DataFrame:
    """The mixed corpus: every document as many times as the mix takes it.

    Columns are those of ``docs`` (``doc_id, text, source`` among them, others of any
    name kept as they are). Rows that are equal in those three share the copies that
    were drawn for them one by one. A document without words, or an empty table, gives
    no rows; null ids, texts and sources are values like others.
    """
    drawn = (
        mix_sizes(sized(docs), weights, ceiling)
        .groupBy(F.col("key").alias("_key"))
        .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    )
    # The columns of a row travel as one, so no name of theirs meets one in here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(whole.alias("row"), row_key().alias("_key"))
    joined = keyed.join(drawn.where("_copies > 0"), "_key")
    # Equal rows: the first ones take what doesn't divide evenly.
    place = F.row_number().over(W.partitionBy("_key").orderBy("_copies"))
    own = F.floor(F.col("_copies") / F.col("_rows")) + F.when(
        place <= F.col("_copies") % F.col("_rows"), 1
    ).otherwise(0)
    repeated = joined.withColumn("_times", F.array_repeat(F.lit(0), own.cast("int")))
    repeated = repeated.select("row", F.explode("_times").alias("_time"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, weights: list[float], ceiling: float = 3.0) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document row."""
    return mix_sizes(sized(docs), weights, ceiling).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )
