"""Mixing: targets against a plain loop, exact masses, reruns."""

from collections import defaultdict

import pytest
from voxloom.llm import mixing as M

WEIGHTS = [5.0, 2.0, 1.0]


def plain_targets(sizes, weights, ceiling):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: ceiling * sizes[s] for s in names}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: cap[s] if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > cap[s]}
        if not above:
            return target
        capped |= above


def words(text):
    return len((text or "").encode().split())


def test_targets_masses_and_reruns(docs, rows):
    got = [r.asDict() for r in M.mix_report(docs, WEIGHTS).collect()]
    again = [r.asDict() for r in M.mix_report(docs.repartition(3), WEIGHTS).collect()]
    key = lambda r: tuple(map(repr, r.values()))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert len(got) == len(rows)
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += words(r["text"])
        largest[r["source"]] = max(largest[r["source"]], words(r["text"]))
    want = plain_targets(sizes, WEIGHTS, 3.0)
    drawn = [r.asDict() for r in M.mix_sizes(M.sized(docs), WEIGHTS).collect()]
    taken = defaultdict(int)
    for r in drawn:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1e-6
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_tree_of_several_levels_keeps_the_mass(spark):
    rows = [(i, i, "big", 10 + i % 7) for i in range(1500)] + [(9000, 9000, "b", 4000)]
    df = spark.createDataFrame(rows, "key long, doc_id long, source string, size long")
    got = [r for r in M.mix_sizes(df, [3.0, 1.0], group=8).collect() if r["source"] == "big"]
    assert abs(sum(r["copies"] * r["size"] for r in got) - got[0]["target"]) <= 8
    rate = got[0]["target"] / got[0]["source_size"]
    # Whole parts are taken as they are, the rest is one copy more or less.
    assert {r["copies"] for r in got} <= {int(rate), int(rate) + 1}


def test_mixed_rows_repeat_as_drawn(docs):
    extra = docs.withColumnsRenamed({"lang": "_key", "n_chars": "_copies"})
    mixed = M.mix_documents(extra, WEIGHTS)
    assert mixed.columns == extra.columns
    drawn = M.mix_sizes(M.sized(docs), WEIGHTS)
    assert mixed.count() == drawn.agg({"copies": "sum"}).first()[0]
    given = {(r["doc_id"], r["text"], r["_key"], r["_copies"]) for r in extra.collect()}
    assert {(r["doc_id"], r["text"], r["_key"], r["_copies"]) for r in mixed.collect()} <= given


def test_empty_table(empty):
    assert M.mix_report(empty, WEIGHTS).count() == 0
    assert M.mix_documents(empty, WEIGHTS).count() == 0
