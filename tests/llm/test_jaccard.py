"""N-gram Jaccard join against all pairs, with small and large close groups."""

import numpy as np
import pytest
from close_texts import near_group
from voxloom.llm import jaccard as J


def brute(rows):
    sets = {}
    for i, r in enumerate(rows):
        words = (r["text"] or "").encode().split()
        grams = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        if grams:
            sets.setdefault(frozenset(grams), []).append(i)
    keys = list(sets)
    links = {k: set() for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(a & b)
            if 5 * common >= 4 * (len(a) + len(b) - common):
                links[a].add(b)
                links[b].add(a)
    low = -(1 << 62)
    out, seen = {}, set()
    for key in keys:
        if key in seen:
            continue
        group, todo = {key}, [key]
        while todo:
            for other in links[todo.pop()] - group:
                group.add(other)
                todo.append(other)
        seen |= group
        ids = [rows[i]["doc_id"] for k in group for i in sets[k]]
        first = min(ids, key=lambda x: low if x is None else x)
        for k in group:
            for i in sets[k]:
                out[i] = (first, len(links[k]), len(sets[k]))
    return [out.get(i, (r["doc_id"], 0, 1)) for i, r in enumerate(rows)]


def check(df, rows):
    got = [
        (r["doc_id"], r["class_id"], r["n_links"], r["n_copies"])
        for r in J.near_duplicates(df).collect()
    ]
    want = [(r["doc_id"], *b) for r, b in zip(rows, brute(rows))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


def test_classes_and_links_equal_all_pairs(docs, rows):
    want = check(docs, rows)
    assert max(w[2] for w in want) >= 8
    kept = J.one_of_each_class(docs.withColumnRenamed("lang", "_key"))
    assert kept.columns == ["doc_id", "text", "_key", "source", "n_chars"]
    alone = sum(not (r["text"] or "").split() for r in rows)
    classes = {w[1] for w, r in zip(want, rows) if (r["text"] or "").split()}
    # Two different texts share the id 900007, so two classes have it.
    assert kept.count() == len(classes) + 1 + alone


def test_large_close_group_goes_through_clusters(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 6)
    monkeypatch.setattr(J, "PART", 10)
    texts = near_group(60, 150, 2, 9) + near_group(5, 60, 0, 10) + near_group(30, 40, 3, 11)
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(texts)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    check(df, rows)


@pytest.mark.parametrize("recall", [0.9, 0.999])
def test_bands_reach_the_recall(recall):
    bands, rows = J.choose_bands(0.8, recall, 192)
    assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 192


def test_signatures_estimate_likeness():
    draw = np.random.default_rng(1)
    a, b = J.hash_family(192)
    close = []
    for _ in range(60):
        shared = draw.integers(0, 2**63, 400, dtype=np.uint64)
        x = np.unique(np.concatenate((shared, draw.integers(0, 2**63, 50, dtype=np.uint64))))
        y = np.unique(np.concatenate((shared, draw.integers(0, 2**63, 50, dtype=np.uint64))))
        close.append((J.signature(x, a, b) == J.signature(y, a, b)).mean())
    assert abs(np.mean(close) - 0.8) < 0.02


def test_empty_table(empty):
    assert J.near_duplicates(empty).count() == 0
