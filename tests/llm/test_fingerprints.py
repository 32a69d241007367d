"""Fingerprints: edited texts, votes, and close fingerprints against brute force."""

import hashlib
import random

from pyspark.sql import functions as F
from voxloom.llm import fingerprints as P


def test_edited_texts_and_closeness(spark, docs, rows):
    got = [r.asDict() for r in P.fingerprint_documents(docs).collect()]
    assert len(got) == len(rows)
    hashes = {
        (r["doc_id"], r["text"]): r["h"]
        for r in docs.select(
            "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
        ).collect()
    }
    low = -(1 << 63)
    ordered = sorted(
        rows,
        key=lambda r: (
            low if r["doc_id"] is None else r["doc_id"],
            hashes[r["doc_id"], r["text"]],
            r["text"] or "",
        ),
    )
    texts = [r["text"] or "" for r in ordered]
    want = []
    for i, r in enumerate(ordered):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        want.append((r["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got]
    assert sorted(key, key=repr) == sorted(want, key=repr)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    # Rows that repeat have one fingerprint; texts without words have zero.
    assert len(by_text[900005]) == 1 and by_text[900001] == {"0" * 16}
    values = sorted({int(r["fingerprint"], 16) for r in got})
    near = {v: sum(0 < (v ^ w).bit_count() <= 3 for w in values) for v in values}
    assert all(near[int(r["fingerprint"], 16)] == r["n_near"] for r in got)


def test_votes_equal_a_plain_count(spark):
    text = "a bb ccc dddd eeeee ffffff a a bb"
    df = spark.createDataFrame([(1, text), (2, None), (3, "  ")], "id int, text string")
    got = {r["id"]: r["fingerprint"] for r in P.fingerprints(df, ["id"]).collect()}
    hashes = spark.createDataFrame([(w,) for w in text.split()], "w string").select(
        "w", F.xxhash64("w").alias("h")
    )
    votes = [0] * 64
    for r in hashes.collect():
        weight = max(1, min(len(r["w"]), P.LONGEST) - 3)
        for b in range(64):
            votes[b] += weight if (r["h"] >> b) & 1 else -weight
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    assert got[1] & ((1 << 64) - 1) == want
    assert got[2] == got[3] == 0


def test_block_tables_find_all_in_a_large_close_group(spark, monkeypatch):
    draw = random.Random(3)
    base = draw.getrandbits(63)
    values = {base}
    while len(values) < 300:
        value = base
        for _ in range(draw.randrange(1, 4)):
            value ^= 1 << draw.randrange(63)
        values.add(value)
    values |= {draw.getrandbits(63) for _ in range(200)}
    monkeypatch.setattr(P, "TILE", 16)
    df = spark.createDataFrame([(v,) for v in [*values, base]], "fingerprint long")
    got = {r["fingerprint"]: r["n_near"] for r in P.near_fingerprints(df).collect()}
    for v in values:
        assert got.get(v, 0) == sum(0 < (v ^ w).bit_count() <= 3 for w in values)


def test_empty_table_and_other_columns(spark, empty):
    assert P.fingerprint_documents(empty).count() == 0
    one = spark.createDataFrame(
        [(1, "a b", 7, "x")], "doc_id long, text string, _place int, fingerprint string"
    )
    (row,) = P.fingerprint_documents(one).collect()
    assert row["near_next"] == 1.0
