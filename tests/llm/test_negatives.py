"""Hard negatives against plain loops, Strassen against Python's own integers."""

import math

import numpy as np
import pytest
from voxloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 17, 17), (33, 64, 47), (100, 31, 65), (2, 64, 900)])
def test_strassen_is_exact(shape):
    draw = np.random.default_rng(2)
    a = draw.integers(-(2**28), 2**28, shape[:2])
    b = draw.integers(-(2**28), 2**28, shape[1:])
    want = a.astype(object) @ b.astype(object)
    assert (negatives.strassen(a, b) == want).all()


def plain(rows):
    kept = set()
    for vec_id, vector, label, _ in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for a in (r for r in kept if r[0] % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in kept if c != a]
        scored.sort()
        for positive, positive_id, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [
                s for s in scored if s[2] != a[1] and 30 * -positive <= 100 * -s[0] <= 90 * -positive
            ]
            out += [(a[0], positive_id, k + 1, s[1], -positive, -s[0]) for k, s in enumerate(inside[:10])]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = negatives.mine_hard_negatives(frame, **options).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in got)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(4, 9))
    out = []
    for i in range(700):
        label = int(draw.integers(0, 4))
        vector = (centres[label] * 0.4 + draw.normal(size=9) * 0.5).astype(np.float32).tolist()
        out.append((i, vector, label, i))
    one = out[5][1]
    out += [(1000 + i, one, 1, 0) for i in range(150)]  # ties
    out += [(800, one, 1, 0), (800, one, 1, 0), (800, one, 2, 0), (800, out[6][1], 1, 0)]
    out += [
        (900, None, 1, 0), (901, one, None, 0), (None, one, 1, 0), (902, [*one[:8], None], 1, 0),
        (903, [*one[:8], float("nan")], 1, 0), (904, [*one[:8], float("-inf")], 1, 0),
        (905, one[:3], 1, 0), (906, [], 1, 0), (-100, out[7][1], 3, 0), (1100, one, -3, 0),
    ]
    return out


@pytest.mark.parametrize("tile_rows,run_tiles", [(1024, 8), (60, 3)])
def test_equals_plain_loops(spark, rows, tile_rows, run_tiles):
    got = found(spark, rows, tile_rows=tile_rows, run_tiles=run_tiles)
    want = plain(rows)
    assert got == want and len(want) > 100


def test_large_components_stay_in_64_bits(spark):
    rows = [(i, [3e38, -1.0 - i, 0.5], i % 2, 0) for i in range(40)]
    got = found(spark, rows)
    assert all(0 < p < 2**63 and 0 < n < 2**63 for *_, p, n in got)


def test_nothing_to_mine(spark, rows):
    assert found(spark, rows[1:50]) == []
    assert found(spark, [(0, [1.0], 1, 0)]) == []
    assert found(spark, [(0, [1.0], 1, 0), (1, [-1.0], 1, 0), (2, [1.0], 2, 0)]) == []
    assert found(spark, [(0, None, None, 0)]) == []
