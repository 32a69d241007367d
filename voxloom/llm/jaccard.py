"""N-gram Jaccard join by MinHash banding, with every pair verified on the full sets.

A text is the set of its word shingles (five words; a shorter text is one shingle). Texts
with the same set are one node. Each node has a MinHash signature in bands, and nodes that
share a band value meet in a bucket; ``choose_bands`` picks bands and rows for a recall.

Pairs are tested in tiles of bounded size that hold the full sets. A bucket of up to
``SMALL`` nodes is a tile (equal buckets are tested once). The nodes of larger buckets are
joined to clusters, each cluster is dealt into parts, and each two parts are a tile. A tile
of a small bucket returns its links; a tile of a cluster returns what each node counts
there and a forest, so a group of m near copies never makes m * m rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.operators.components import connected_components
from voxloom.session import cut_lineage, stored

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 192
SMALL = 48
PART = 192
CHUNK = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """``(bands, rows)`` with the most rows a band that still reach the recall.

    A pair of likeness s shares a band with probability 1 - (1 - s^rows)^bands; more rows
    bring fewer unlike pairs together.
    """
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words; empty without words."""
    digest = xxhash.xxh3_64_intdigest
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    words = np.fromiter((digest(w) for w in parts), dtype=np.uint64, count=len(parts))
    width = min(n, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * _MULTIPLIER + words[i : len(words) - width + 1 + i]
    return np.unique(_mix(out))


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each of the linear hashes over the set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), CHUNK):
        values = low[start : start + CHUNK, None] * a[None, :]
        values += b[None, :]
        np.minimum(best, values.min(axis=0), out=best)
    return best


def hash_family(hashes: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    return a, draw.integers(0, 1 << 32, hashes, dtype=np.uint32)


def signed_nodes(
    docs: DataFrame, bands: int, rows: int, n: int = SHINGLE
) -> DataFrame:
    """``doc_id, key, node, bands``; node and bands are null for a text without words.

    ``node`` is a 64-bit hash of the shingle set, ``key`` one of the row.
    """
    a, b = hash_family(bands * rows)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, values = [], []
            for text in batch["text"]:
                found = shingles(text, n)
                if not len(found):
                    nodes.append(None)
                    values.append(None)
                    continue
                cut = signature(found, a, b).reshape(bands, rows)
                values.append(
                    np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in cut], dtype=np.uint64)
                    .view(np.int64)
                )
                nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64)))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "key": batch["key"],
                    "node": pd.array(nodes, dtype="Int64"),
                    "bands": pd.Series(values, dtype="object", index=batch.index),
                }
            )

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.mapInPandas(sign, f"doc_id {doc_type}, key long, node long, bands array<long>")


def links_in(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs of sets whose Jaccard likeness is at least ``threshold``."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    # Only what two sets share counts for a pair.
    number = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    rows, columns = owner[shared], number[place[shared]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    width = max(1, 4_000_000 // len(sets))
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        low, high = np.searchsorted(columns, [start, start + width])
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[rows[low:high], columns[low:high] - start] = 1
        common += block @ block.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6
    np.fill_diagonal(linked, False)
    return linked


def _forest(nodes: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges from every linked node to the smallest place of its component."""
    label = np.arange(len(nodes))
    while True:
        near = np.where(linked, label[None, :], len(nodes)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[j])) for i, j in enumerate(label) if i != j]


def tested_tiles(tiles: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n`` of every tile of ``is_cluster, members(node, part, set)``.

    ``n`` null: a link of a small bucket. Else ``a`` has ``n`` links in the tile (b null),
    or ``a, b`` is an edge of its forest (n 0). In a tile of two parts only pairs across
    them count; in a small bucket pairs of one cluster don't, its own tiles hold them.
    """

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for is_cluster, members in zip(batch["is_cluster"], batch["members"]):
                nodes = np.array([m["node"] for m in members], dtype=np.int64)
                sets = [np.frombuffer(m["set"], dtype=np.uint64) for m in members]
                linked = links_in(sets, threshold)
                out: list[tuple[int, int | None, int | None]] = []
                if is_cluster:
                    part = np.array([m["part"] for m in members])
                    if len(set(part.tolist())) > 1:
                        linked &= part[:, None] != part[None, :]
                    out += [(int(a), None, int(n)) for a, n in zip(nodes, linked.sum(1)) if n]
                    out += [(a, b, 0) for a, b in _forest(nodes, linked)]
                else:
                    group = np.array([-1 if m["part"] is None else m["part"] for m in members])
                    linked &= (group[:, None] != group[None, :]) | (group[:, None] == -1)
                    for i, j in np.argwhere(np.triu(linked)):
                        low, high = sorted((int(nodes[i]), int(nodes[j])))
                        out.append((low, high, None))
                yield pd.DataFrame(
                    {
                        "a": pd.array([o[0] for o in out], dtype="Int64"),
                        "b": pd.array([o[1] for o in out], dtype="Int64"),
                        "n": pd.array([o[2] for o in out], dtype="Int64"),
                    }
                )

    return tiles.mapInPandas(test, "a long, b long, n long")


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, set`` for the nodes of ``wanted`` (``node, key``)."""

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"node": batch["node"], "set": [shingles(t, n).tobytes() for t in batch["text"]]}
            )

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    joined = keyed.join(wanted, "key").select("node", "text")
    return joined.mapInPandas(shingled, "node long, set binary").dropDuplicates(["node"])


def near_links(
    docs: DataFrame,
    signed: DataFrame,
    threshold: float = THRESHOLD,
    n: int = SHINGLE,
) -> tuple[DataFrame, DataFrame]:
    """``node, n_links`` and the edges ``src, dst`` that connect what is linked."""
    per_node = stored(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    )
    banded = per_node.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = cut_lineage(
        banded.groupBy("band", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("node").alias("hub"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y"),
        )
        .where("n > 1")
    )
    big = buckets.where(F.col("n") > SMALL).select("band", "value", "hub")
    spokes = banded.join(big, ["band", "value"]).select("node", "hub").where("node <> hub")
    clusters = cut_lineage(
        connected_components(spokes.distinct(), "node", "hub").withColumnRenamed(
            "component", "cluster"
        )
    )
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / PART).cast("int")
    dealt = clusters.join(sizes, "cluster").withColumn(
        "_own", F.pmod(F.xxhash64("node", F.lit(4)), parts).cast("int")
    )
    pair = F.transform(
        F.sequence(F.lit(0), parts - 1),
        lambda o: F.struct(F.least("_own", o).alias("x"), F.greatest("_own", o).alias("y")),
    )
    in_clusters = dealt.withColumn("_pair", F.explode(pair)).select(
        F.lit(True).alias("is_cluster"),
        F.col("cluster").alias("tile"),
        F.col("_pair.x").cast("long").alias("x"),
        F.col("_pair.y").alias("y"),
        "node",
        F.col("_own").cast("long").alias("part"),
    )
    # Buckets with the same members are one; a bucket inside one cluster is tested there.
    chosen = (
        buckets.where(F.col("n") <= SMALL)
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("band", "value")).alias("_b"))
        .select("_b.band", "_b.value")
    )
    small = banded.join(chosen, ["band", "value"]).join(clusters, "node", "left")
    outside = small.groupBy("band", "value").agg(
        F.count("cluster").alias("_in"),
        F.count(F.lit(1)).alias("_all"),
        F.min("cluster").alias("_low"),
        F.max("cluster").alias("_high"),
    )
    outside = outside.where("_in < _all or _low <> _high").select("band", "value")
    in_buckets = small.join(outside, ["band", "value"]).select(
        F.lit(False).alias("is_cluster"),
        F.col("band").cast("long").alias("tile"),
        F.col("value").alias("x"),
        F.lit(0).alias("y"),
        "node",
        F.col("cluster").alias("part"),
    )
    members = cut_lineage(in_clusters.unionByName(in_buckets))
    wanted = members.select("node").distinct().join(per_node.select("node", "key"), "node")
    sets = stored(_sets_of(docs, wanted, n))
    tiles = (
        members.join(sets, "node")
        .groupBy("is_cluster", "tile", "x", "y")
        .agg(F.collect_list(F.struct("node", "part", "set")).alias("members"))
        .select("is_cluster", "members")
    )
    tested = cut_lineage(tested_tiles(tiles, threshold))
    links = cut_lineage(tested.where("n is null").select("a", "b").distinct())
    both = links.select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).alias("n"))
    counted = both.unionByName(tested.where("n > 0").select(F.col("a").alias("node"), "n"))
    counts = counted.groupBy("node").agg(F.sum("n").alias("n_links"))
    edges = links.unionByName(tested.where("n = 0").select("a", "b"))
    return counts, edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    n: int = SHINGLE,
    recall: float = RECALL,
    hashes: int = HASHES,
) -> DataFrame:
    """``doc_id, key, class_id, n_links, n_copies, is_first`` of every row.

    A class holds what links of likeness ``threshold`` or more connect; its id is its
    smallest ``doc_id``. ``n_links`` counts the other distinct shingle sets a text is
    linked to, ``n_copies`` the rows that have its own set. ``is_first`` marks one row of
    each class (the smallest ``doc_id``, null first, then ``key``; rows equal in ``doc_id``
    and text share the mark). A null text, or one without words, is a class by itself with
    no links. An empty table gives no rows; other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    signed = stored(signed_nodes(docs, bands, rows, n))
    counts, edges = near_links(docs, signed, threshold, n)
    components = cut_lineage(connected_components(edges))
    nodes = (
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("doc_id", "key")).alias("_first"))
        .join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    firsts = nodes.groupBy("component").agg(F.min("_first").alias("_lead"))
    facts = cut_lineage(
        nodes.join(firsts, "component")
        .join(counts, "node", "left")
        .select("node", "n_copies", "_lead", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    joined = signed.select("doc_id", "key", "node").join(facts, "node", "left")
    alone = F.col("node").isNull()
    return joined.select(
        "doc_id",
        "key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_lead.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.when(alone, True)
        .otherwise(
            F.col("doc_id").eqNullSafe(F.col("_lead.doc_id"))
            & (F.col("key") == F.col("_lead.key"))
        )
        .alias("is_first"),
    )


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, one for each class."""
    firsts = near_duplicates(docs, threshold).where("is_first").select(F.col("key").alias("_key"))
    # The columns of a row travel as one, so no name of theirs meets one in here.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(
        whole.alias("row"), has_words.alias("_words"), F.xxhash64("doc_id", "text").alias("_key")
    )
    joined = keyed.join(firsts, "_key", "left_semi")
    place = F.row_number().over(W.partitionBy("_key").orderBy("_key"))
    # Rows that repeat are copies too; those without words are classes of their own.
    kept = joined.withColumn("_place", place).where((F.col("_place") == 1) | ~F.col("_words"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
