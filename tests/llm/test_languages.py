"""Language mixtures: held-out accuracy, planted mixtures, cases without letters."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from voxloom.llm import languages as L


def test_held_out_accuracy_and_flags(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in given.select("doc_id", "lang").collect()}
    # Other columns are no inputs: scrambled ones change nothing.
    got = L.identify_documents(given.withColumn("source", F.lit("x"))).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(docs, rows):
    got = L.identify_documents(docs).collect()
    assert len(got) == len(rows)
    learned = {r["lang"] for r in rows if r["lang"]}
    texts = {(r["doc_id"], (r["text"] or "")[:20]) for r in rows}
    assert len(texts) >= 1
    by_id = {r["doc_id"]: r for r in got}
    for i in (900001, 900002, 900003):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 and by_id[i]["langs"] == []
    assert {r["lang_pred"] for r in got} <= learned | {"und"}


def test_mixtures_are_found(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logs = L.train(given)
    letters = L.letter_table()
    long = {
        r["lang"]: r["text"]
        for r in given.where("n_chars > 3000").orderBy("doc_id").select("lang", "text").collect()
    }
    for a in langs:
        for b in langs:
            if a < b:
                text = long[a][:1800] + " " + long[b][:1200]
                found, share, _ = L.mixture(L.ngram_counts(text, letters), logs)
                assert [langs[i] for i in found[:2]] == [a, b]
                assert abs(share[0] - 0.6) < 0.12


def test_shares_raise_the_likelihood():
    draw = np.random.default_rng(2)
    table = draw.dirichlet(np.ones(50) * 0.2, size=3) + 1e-9
    counts = draw.multinomial(4000, 0.7 * table[0] + 0.3 * table[2]).astype(float)
    share, value = L.shares(table, counts)
    assert abs(share[0] - 0.7) < 0.06 and share[1] < 0.05
    grid = [(a, b) for a in np.linspace(0.01, 0.98, 40) for b in np.linspace(0.01, 0.98, 40)]
    best = max(
        counts @ np.log(np.array([a, b, 1 - a - b]) @ table) for a, b in grid if a + b < 0.995
    )
    assert value >= best - 1


def test_nothing_learned_and_empty(spark, empty):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    (row,) = L.identify_documents(df).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert L.identify_documents(empty).count() == 0
