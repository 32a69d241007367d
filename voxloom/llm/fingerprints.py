"""SimHash fingerprints of documents and the search for close ones.

Every word of a text votes with a weight on the 64 bits of its hash, and the sign of a
bit's votes is the bit. Votes are counted without Python: three counters of 20 bits share
a long, so a word adds 22 longs, in generated code, to the sums of its text.

``near_fingerprints`` finds all fingerprints within a Hamming radius by permuted block
tables: the 64 bits are cut into ``radius + spare`` blocks, and two fingerprints within
the radius agree on ``spare`` blocks at least, so each choice of that many blocks is one
table, keyed by those blocks.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.columns import shuffle_partitions, words
from voxloom.session import cut_lineage

BITS = 64
LANE = 20
LANES = 3
SUMS = math.ceil(BITS / LANES)
PIECE = 30_000
LONGEST = 30
TILE = 64


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def term_weight(word: Column) -> Column:
    """Long words tell more: 1 up to four code points, then one more for each, 27 at most."""
    return F.greatest(F.lit(1), F.least(F.length(word), F.lit(LONGEST)) - 3).cast("bigint")


def _spread(hash_: Column, i: int) -> Column:
    """Bits 3i, 3i+1 and 3i+2 of a hash at places 0, 20 and 40 of a long."""
    three = F.shiftrightunsigned(hash_, LANES * i).bitwiseAND(F.lit(7).cast("bigint"))
    apart = three * F.lit(1 + (1 << (LANE - 1)) + (1 << (2 * LANE - 2)))
    return apart.bitwiseAND(F.lit(1 + (1 << LANE) + (1 << 2 * LANE)))


def fingerprints(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """``by`` columns and ``fingerprint`` (long): one row for each value of ``by``.

    Texts with the same ``by`` values count as one. A null text or one without words has
    the fingerprint 0. If the input is partitioned by some of ``by``, nothing is shuffled;
    else the sums of each text are.
    """
    # outer: a text without words keeps a row.
    term = texts.select(*by, F.posexplode_outer(words(F.col(text))).alias("_pos", "_word"))
    term = term.select(
        *by,
        # A counter holds 2^20: 30,000 words of weight 27 fit.
        F.floor(F.coalesce("_pos", F.lit(0)) / PIECE).alias("_piece"),
        F.xxhash64("_word").alias("_hash"),
        F.when(F.col("_word").isNull(), F.lit(0).cast("bigint"))
        .otherwise(term_weight(F.col("_word")))
        .alias("_weight"),
    )
    sums = term.groupBy(*by, "_piece").agg(
        F.sum("_weight").alias("_total"),
        *[F.sum(_spread(F.col("_hash"), i) * F.col("_weight")).alias(f"_s{i}") for i in range(SUMS)],
    )

    def votes(bit: int) -> Column:
        packed = F.shiftrightunsigned(f"_s{bit // LANES}", LANE * (bit % LANES))
        return F.sum(packed.bitwiseAND(F.lit((1 << LANE) - 1)))

    counted = sums.groupBy(*by).agg(
        F.sum("_total").alias("_total"), *[votes(b).alias(f"_v{b}") for b in range(BITS)]
    )
    out = F.lit(0).cast("bigint")
    for b in range(BITS):
        up = 2 * F.col(f"_v{b}") > F.col("_total")
        out = out.bitwiseOR(F.when(up, F.lit(_signed(1 << b))).otherwise(F.lit(0)).cast("bigint"))
    return counted.select(*by, out.alias("fingerprint"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - distance(a, b) / float(BITS)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def block_masks(radius: int, spare: int = 3) -> list[int]:
    """One mask for each choice of ``spare`` of ``radius + spare`` blocks of the bits."""
    blocks = radius + spare
    ends = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(ends)]
    return [_signed(sum(c)) for c in itertools.combinations(parts, spare)]


def spare_blocks(n: int, radius: int) -> int:
    """Blocks in a key, so that it has 6 bits more than are needed to count ``n``.

    Any choice finds the same pairs; fewer blocks mean fewer tables, more blocks fewer
    chance meetings.
    """
    spare = 1
    while BITS * spare / (radius + spare) < math.log2(max(2, n)) + 6 and spare < 8:
        spare += 1
    return spare


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``fingerprint, n_near``: how many other distinct values lie within ``radius`` bits.

    Only fingerprints that have one are returned; nulls and repeats are dropped first, so
    copies are one. Rows that share a key are worked on in tiles of bounded size, each row
    of a tile counts its own partners there, and a pair counts in the first table that
    brings it together; pairs are never written out.
    """
    distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
    distinct = cut_lineage(distinct)
    masks = block_masks(radius, spare_blocks(distinct.count(), radius))
    # A key travels as one hash; what meets by chance of it fails the test of the bits.
    keys = F.transform(
        F.array(*[F.lit(m) for m in masks]),
        lambda m, t: F.struct(
            t.cast("short").alias("table"),
            F.xxhash64(t, m.bitwiseAND(F.col("fingerprint"))).alias("key"),
        ),
    )
    keyed = distinct.select("fingerprint", F.explode(keys).alias("_k")).select(
        "fingerprint", "_k.table", "_k.key"
    )
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / TILE)
    own = F.pmod(F.xxhash64("fingerprint", F.lit(3)), parts).cast("int")
    members = keyed.join(shared, "key").withColumn("_own", own)
    # A tile is a pair of parts; a row goes to the tiles of its own part.
    tiles = F.transform(
        F.sequence(F.lit(0), (parts - 1).cast("int")),
        lambda o: F.struct(F.least("_own", o).alias("a"), F.greatest("_own", o).alias("b")),
    )
    tiled = (
        members.withColumn("_tile", F.explode(tiles))
        .groupBy("table", "key", "_tile")
        .agg(F.collect_list(F.struct("fingerprint", "_own")).alias("_rows"))
    )

    def first_meeting(diff: Column) -> Column:
        tables = F.array(*[F.lit(m) for m in masks])
        earlier = F.slice(tables, F.lit(1), F.col("table").cast("int"))
        meet = F.get(tables, F.col("table").cast("int")).bitwiseAND(diff) == 0
        return meet & ~F.exists(earlier, lambda m: m.bitwiseAND(diff) == 0)

    def partner(x: Column, y: Column) -> Column:
        diff = x["fingerprint"].bitwiseXOR(y["fingerprint"])
        # In a tile of two parts, partners are in the other part.
        here = (F.col("_tile.a") == F.col("_tile.b")) | (x["_own"] != y["_own"])
        return (diff != 0) & here & (F.bit_count(diff) <= radius) & first_meeting(diff)

    counts = F.transform(
        "_rows",
        lambda x: F.struct(
            x["fingerprint"].alias("fingerprint"),
            F.size(F.filter("_rows", lambda y: partner(x, y))).alias("n"),
        ),
    )
    counted = tiled.select(F.explode(counts).alias("_c")).where("_c.n > 0")
    return counted.groupBy(F.col("_c.fingerprint").alias("fingerprint")).agg(
        F.sum("_c.n").alias("n_near")
    )


def _below(cuts: list[int], value: Column, or_equal: bool) -> Column:
    """How many of the ascending cuts lie below the value, by binary search."""
    levels = len(cuts).bit_length()
    table = F.array(*[F.lit(c).cast("bigint") for c in cuts])

    def step(place: Column, width: Column) -> Column:
        cut = F.get(table, place + width - 1)
        low = (cut <= value) if or_equal else (cut < value)
        return F.when(low, place + width).otherwise(place)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    return F.aggregate(widths, F.lit(0), step)


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` dealt into ``_bucket`` and numbered there as ``_place``.

    Buckets follow the order of ``doc_id`` (null first, ties by hash of the text). Their
    bounds are approximate quantiles of the ids, which steer only the sizes; an id that
    fills several buckets by itself is split by the hash.
    """
    lowest = F.lit(_signed(1 << 63))
    rows = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("_id"),
    ).withColumn("_tie", F.xxhash64("text"))
    levels = max(3, math.ceil(math.log2(4 * shuffle_partitions(docs.sparkSession))))
    shares = [i / (1 << levels) for i in range(1, 1 << levels)]
    cuts = rows.agg(F.percentile_approx("_id", shares, 10_000)).first()[0] or []
    if cuts:
        low, high = _below(cuts, F.col("_id"), False), _below(cuts, F.col("_id"), True)
        share = F.col("_tie") / F.lit(float(1 << 64)) + 0.5
        bucket = F.col("_low") + F.floor(share * (F.col("_high") - F.col("_low") + 1))
        last = F.col("_high")
        rows = rows.withColumn("_low", low).withColumn("_high", high)
        rows = rows.withColumn("_bucket", F.least(bucket, last).cast("int")).drop("_low", "_high")
    else:
        rows = rows.withColumn("_bucket", F.lit(0))
    order = W.partitionBy("_bucket").orderBy("_id", "_tie", "text")
    return rows.withColumn("_place", F.row_number().over(order)).withColumn(
        "_next", F.lead("text").over(order)
    )


def _following(places: DataFrame) -> DataFrame:
    """``_bucket, _after``: the next bucket that has rows; after the last comes the first.

    There are a few buckets for each shuffle partition, whatever the number of documents.
    """
    used = cut_lineage(places.select("_bucket").distinct())
    order = W.orderBy("_bucket")
    return used.select(
        "_bucket",
        F.coalesce(
            F.lead("_bucket").over(order),
            F.min("_bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        ).alias("_after"),
    )


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and of an edited form of it.

    The edited text is the text whose last ``floor(n_chars / 4)`` code points are replaced
    by the first as many of the next document, by ascending ``doc_id`` (null first, equal
    ids by hash of their text, the first document after the last). Columns: ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint`` (hex), ``near_edited,
    near_next`` (share of equal bits) and ``n_near``, the number of other distinct
    fingerprints of the table within ``radius`` bits. A null text is empty; rows that
    repeat are rows of their own; an empty table gives no rows; other columns are ignored.
    """
    placed = in_order(docs)
    following = cut_lineage(_following(placed))
    # The first text of the next bucket follows the last one of a bucket.
    first = (
        placed.where("_place = 1")
        .select(F.col("_bucket").alias("_after"), F.col("text").alias("_first"))
        .join(following, "_after")
        .select("_bucket", "_first")
    )
    last = F.col("_next").isNull()
    chained = placed.alias("p").join(
        first.alias("f"), (F.col("p._bucket") == F.col("f._bucket")) & last, "left"
    )
    chained = chained.select("p.*", "_first").withColumn("_next", F.coalesce("_next", "_first"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut)
    )
    both = chained.select("_bucket", "_place", "doc_id", "text", edited.alias("_edited"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("side"), F.col("_edited").alias("text")),
    )
    # The id goes along so that both readers of the dealt texts ask for the same columns,
    # and the texts are shuffled once.
    voted = fingerprints(
        both.select("_bucket", "_place", "doc_id", F.explode(sides).alias("_s")).select(
            "_bucket", "_place", "doc_id", "_s.side", "_s.text"
        ),
        ["_bucket", "_place", "doc_id", "side"],
    )
    pairs = voted.groupBy("_bucket", "_place").agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("_edited_print"),
    )
    facts = both.select(
        "_bucket",
        "_place",
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
    )
    rows = cut_lineage(facts.join(pairs, ["_bucket", "_place"]))
    order = W.partitionBy("_bucket").orderBy("_place")
    starts = (
        rows.where("_place = 1")
        .select(F.col("_bucket").alias("_after"), F.col("fingerprint").alias("_start"))
        .join(following, "_after")
        .select("_bucket", "_start")
    )
    chained = rows.withColumn("_next", F.lead("fingerprint").over(order)).join(starts, "_bucket")
    following_print = F.coalesce("_next", "_start")
    near = near_fingerprints(rows, radius)
    return chained.join(near, "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fingerprint")).alias("fingerprint"),
        as_hex(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("_edited_print")).alias("near_edited"),
        likeness(F.col("fingerprint"), following_print).alias("near_next"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )
