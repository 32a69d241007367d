"""Hard negatives for contrastive training, by exact integer products of tiles.

Vectors become integers, rows are packed into tiles, and every anchor tile meets the
candidate tiles that can matter to it in cells of bounded size. A cell multiplies its tiles
by Strassen's recursion in 64-bit integers, where sums that wrap cancel exactly, and keeps
the best few candidates of every anchor. Such heaps merge: a cell folds them tile by tile,
and the cells of an anchor meet in one ranked group of a few rows each.

Two passes are needed, since the window of a negative hangs on the score of a positive:
the first finds the positives, the second the negatives inside their windows.

Odd input: rows with a null id, label or vector, or with a null or non-finite component take
no part. Rows equal in id, label and integer vector count once; rows that share only the id
are rows of their own. A shorter vector ends in zeros, an empty one is all zeros. A component
beyond the value whose products could leave 64 bits is held at that value. An anchor without
a positive, or a positive without a row in its window, gives no row. Other columns of the
input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxloom.llm.columns import number_all, shuffle_partitions
from voxloom.session import stored

LABELS, RELABELLED, SCALE, ANCHORS = 10, 7, 256, 100
POSITIVES, NEGATIVES = 5, 10
# A negative scores from 30 to 90 hundredths of its positive.
WINDOW = (30, 90)
TILE_ROWS, RUN_TILES, LEAF = 1024, 8, 16

_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers with seven products of halves in place of eight.

    An odd side gets a row or column of zeros. Blocks with a side of ``LEAF`` or less are
    multiplied plainly. Integer arithmetic modulo 2^64 is a ring, so the result is exact
    whenever it fits, whatever the sums in between.
    """
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= LEAF:
        return a @ b
    if rows % 2 or inner % 2:
        a = np.pad(a, ((0, rows % 2), (0, inner % 2)))
    if inner % 2 or columns % 2:
        b = np.pad(b, ((0, inner % 2), (0, columns % 2)))
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), dtype=np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


class Heaps:
    """The best ``k`` candidates of many groups: highest score first, then smallest id."""

    def __init__(self, k: int):
        self.k = k
        self.group = self.score = self.id = np.zeros(0, dtype=np.int64)

    def offer(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, groups: np.ndarray) -> None:
        """Merge the allowed entries of a score matrix, whose row ``i`` is of ``groups[i]``."""
        held = np.where(allowed, scores, _NONE)
        k = min(self.k, held.shape[1])
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        row, column = np.nonzero(allowed & (held >= least[:, None]))
        self.merge(groups[row], held[row, column], ids[column])

    def merge(self, group: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        group = np.concatenate((self.group, group))
        score = np.concatenate((self.score, score))
        ident = np.concatenate((self.id, ident))
        # ~score counts down as the score goes up and never overflows.
        order = np.lexsort((ident, ~score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        best = place < self.k
        self.group, self.score, self.id = group[best], score[order][best], ident[order][best]


def participants(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, relabelled, as integers."""
    bad = F.exists(
        F.col("embedding"),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    )
    return rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        moved.alias("label"),
        F.transform("embedding", lambda x: F.lit(float(SCALE)) * x.cast("double")).alias("x"),
    )


def integer_rows(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The distinct integer rows and the width of the longest."""
    rows = participants(vectors)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    most = float(math.isqrt((2**63 - 1) // max(1, width)) - 1)
    held = F.transform(
        "x", lambda x: F.floor(F.greatest(F.least(x, F.lit(most)), F.lit(-most))).cast("bigint")
    )
    return rows.select("vec_id", "label", held.alias("q")).distinct(), max(1, width)


def pack_tiles(rows: DataFrame, width: int, size: int = TILE_ROWS) -> DataFrame:
    """Tiles of up to ``size`` rows in order of label and id, numbered from 0.

    ``tile, low, high`` (labels), ``ids, labels, matrix`` (64-bit numbers). A row travels
    once; a label with any share of the rows fills as many tiles as it needs.
    """

    def packed(batches):
        def tile(frames: list[pd.DataFrame], place: int) -> pd.DataFrame:
            frame = pd.concat(frames)
            matrix = np.zeros((len(frame), width), dtype=np.int64)
            for i, q in enumerate(frame["q"]):
                matrix[i, : len(q)] = q
            labels = frame["label"].to_numpy(np.int64)
            return pd.DataFrame(
                {
                    "place": [place],
                    "low": [labels[0]],
                    "high": [labels[-1]],
                    "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                    "labels": [labels.tobytes()],
                    "matrix": [matrix.tobytes()],
                }
            )

        place, waiting, n = 0, [], 0
        for batch in batches:
            start = 0
            while start < len(batch):
                part = batch.iloc[start : start + size - n]
                waiting.append(part)
                start, n = start + len(part), n + len(part)
                if n == size:
                    yield tile(waiting, place)
                    place, waiting, n = place + 1, [], 0
        if n:
            yield tile(waiting, place)

    order = [F.col("label").asc(), F.col("vec_id").asc(), F.col("q").asc()]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order[:2])
    tiles = dealt.sortWithinPartitions(*order).mapInPandas(
        packed, "place long, low long, high long, ids binary, labels binary, matrix binary"
    )
    tiles = stored(tiles.withColumn("part", F.spark_partition_id()))
    names = number_all(
        tiles.select("part", "place"), [F.col("part").asc(), F.col("place").asc()], "tile"
    )
    return tiles.join(names, ["part", "place"]).drop("part", "place")


def _cells(anchors: DataFrame, tiles: DataFrame, same: bool, run_tiles: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the meeting, by ``cell`` (anchor tile) and ``run`` (of candidate tiles).

    A candidate tile goes to the anchor tiles whose labels can be equal (``same``) or can
    differ, and to no other.
    """
    spans = [(r["tile"], r["low"], r["high"]) for r in anchors.select("tile", "low", "high").collect()]
    runs = tiles.select(F.max(F.floor(F.col("tile") / run_tiles))).first()[0]
    if same:
        meets = lambda low, high: (F.col("low") <= high) & (F.col("high") >= low)
    else:
        meets = lambda low, high: ~((low == high) & (F.col("low") == low) & (F.col("high") == low))
    listed = F.array(*[F.struct(*[F.lit(v).cast("bigint") for v in s]) for s in spans])
    chosen = F.filter(listed, lambda s: meets(s["col2"], s["col3"]))
    right = tiles.withColumn("cell", F.explode(F.transform(chosen, lambda s: s["col1"])))
    # Both keys are bigint on both sides: a cogroup hashes them as they come.
    right = right.withColumn("run", F.floor(F.col("tile") / run_tiles).cast("bigint"))
    left = anchors.withColumnRenamed("tile", "cell").withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(runs).cast("bigint")))
    )
    return left, right


def _numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype=np.int64)


def _meet(left: DataFrame, right: DataFrame, width: int, schema: str, fold: Callable) -> DataFrame:
    """``fold(anchor tile, blocks)`` of every cell; a block is a tile with its scores."""

    def met(anchor: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        blocks = []
        if len(anchor) and len(tiles):
            one = anchor.iloc[0]
            a = _numbers(one["matrix"]).reshape(-1, width)

            def scored():
                for tile in tiles.sort_values("tile").itertuples():
                    c = _numbers(tile.matrix).reshape(-1, width)
                    yield _numbers(tile.ids), _numbers(tile.labels), c, strassen(a, c.T)

            blocks.append(fold(one, a, scored()))
        return pd.concat(blocks) if blocks else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    keys = ("cell", "run")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(met, schema)


def positives(anchors: DataFrame, tiles: DataFrame, width: int, k: int, run_tiles: int) -> DataFrame:
    """``cell, row, place, positive_id, positive_score``: the best rows of the anchor's label."""

    def fold(one, a, blocks) -> pd.DataFrame:
        ids, labels = _numbers(one["ids"]), _numbers(one["labels"])
        heaps = Heaps(k)
        for other, other_labels, c, scores in blocks:
            allowed = labels[:, None] == other_labels[None, :]
            row, column = np.nonzero(allowed & (ids[:, None] == other[None, :]))
            itself = (a[row] == c[column]).all(axis=1)
            allowed[row[itself], column[itself]] = False
            heaps.offer(scores, allowed, other, np.arange(len(ids)))
        return pd.DataFrame(
            {"cell": one["cell"], "row": heaps.group, "positive_id": heaps.id, "positive_score": heaps.score}
        )

    left, right = _cells(anchors, tiles, True, run_tiles)
    found = _meet(left, right, width, "cell long, row long, positive_id long, positive_score long", fold)
    order = W.partitionBy("cell", "row").orderBy(F.col("positive_score").desc(), "positive_id")
    return found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < k)


def negatives(
    anchors: DataFrame, tiles: DataFrame, width: int, k: int, window: tuple[int, int], run_tiles: int
) -> DataFrame:
    """``cell, row, place, rank, negative_id, negative_score`` inside each positive's window.

    Anchor tiles carry their positives as ``rows, places, tops`` (64-bit numbers).
    """
    low_share, high_share = window

    def fold(one, a, blocks) -> pd.DataFrame:
        labels, row = _numbers(one["labels"]), np.array(one["rows"], dtype=np.int64)
        place = np.array(one["places"], dtype=np.int64)
        tops = [int(t) for t in one["tops"]]
        # Bounds in Python's own integers: a hundredfold score can leave 64 bits.
        low = np.array([-(-low_share * t // 100) for t in tops], dtype=np.int64)
        high = np.array([high_share * t // 100 for t in tops], dtype=np.int64)
        wide = int(place.max()) + 1
        heaps = Heaps(k)
        for other, other_labels, _, scores in blocks:
            differ = labels[:, None] != other_labels[None, :]
            for p in range(wide):
                mine = np.flatnonzero(place == p)
                s = scores[row[mine]]
                inside = differ[row[mine]] & (s >= low[mine, None]) & (s <= high[mine, None])
                heaps.offer(s, inside, other, row[mine] * wide + p)
        return pd.DataFrame(
            {
                "cell": one["cell"],
                "row": heaps.group // wide,
                "place": heaps.group % wide,
                "negative_id": heaps.id,
                "negative_score": heaps.score,
            }
        )

    left, right = _cells(anchors, tiles, False, run_tiles)
    found = _meet(
        left, right, width, "cell long, row long, place long, negative_id long, negative_score long", fold
    )
    order = W.partitionBy("cell", "row", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    anchor_every: int = ANCHORS,
    tile_rows: int = TILE_ROWS,
    run_tiles: int = RUN_TILES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id, embedding, label``. Anchors are the rows whose id is divisible
    by ``anchor_every``. A window is given in hundredths of the positive's score.
    """
    rows, width = integer_rows(vectors)
    rows = stored(rows)
    tiles = stored(pack_tiles(rows, width, tile_rows))
    anchors = stored(pack_tiles(rows.where(F.col("vec_id") % anchor_every == 0), width, tile_rows))
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long"
    )
    if anchors.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    found = stored(positives(anchors, tiles, width, n_positives, run_tiles))
    # A tile has tile_rows anchors at most, each with n_positives at most.
    listed = found.groupBy(F.col("cell").alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct("row", "place", "positive_score"))).alias("p")
    )
    windows = anchors.join(listed, "tile").select(
        "tile", "low", "high", "labels", "matrix",
        F.col("p.row").alias("rows"), F.col("p.place").alias("places"),
        F.col("p.positive_score").alias("tops"),
    )
    windows = stored(windows)
    if windows.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    hard = negatives(windows, tiles, width, n_negatives, window, run_tiles)
    names = anchors.select("tile", F.posexplode(_ids("ids")).alias("row", "anchor_id"))
    named = found.join(names.withColumnRenamed("tile", "cell"), ["cell", "row"])
    return hard.join(named, ["cell", "row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )


def _ids(column: str):
    """The 64-bit numbers of a binary column as an array."""

    @F.pandas_udf("array<bigint>")
    def numbers(values: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(v, dtype=np.int64) for v in values], dtype="object")

    return numbers(F.col(column))
