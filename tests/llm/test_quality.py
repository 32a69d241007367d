"""Quality classifier: site posteriors by hand, held-out accuracy, odd tables."""

import pytest
from pyspark.sql import functions as F
from voxloom.llm import quality as Q


def test_site_posteriors_shrink(spark):
    rows = []
    for h in range(20):
        for p in range(4):
            # Host rates differ widely, paths of a host do not.
            rows += [(f"h{h}", f"p{p}", int((i * 7 + h) % 20 < h)) for i in range(60)]
    rows += [("small", "p", 1), (None, None, 0)]
    df = spark.createDataFrame(rows, "host string, path string, y int")
    paths, hosts, rate = Q.site_posteriors(df)
    n, good = len(rows), sum(r[2] for r in rows)
    assert rate == pytest.approx((good + 0.5) / (n + 1))
    by_host = {r["host"]: r["host_rate"] for r in hosts.collect()}
    assert abs(by_host["h19"] - 0.95) < 0.03 and abs(by_host["h1"] - 0.05) < 0.03
    # One row moves a sparse host less than halfway from the global rate.
    assert rate < by_host["small"] < (rate + 1) / 2 + 0.1
    assert by_host[None] < rate
    by_path = {(r["host"], r["path"]): r["path_rate"] for r in paths.collect()}
    assert len(by_path) == 82
    assert abs(by_path["h10", "p1"] - by_host["h10"]) < 0.05


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    scored = Q.score_quality(docs, labels.where(seen)).join(labels.where(~seen), "doc_id").collect()
    good = sum((r["p_quality"] >= 0.5) == (r["quality"] == 1) for r in scored) / len(scored)
    toxic = sum((r["p_toxic"] >= 0.5) == (r["toxic"] == 1) for r in scored) / len(scored)
    clean = [r for r in scored if r["quality"] == 1 and r["toxic"] == 0]
    assert good > 0.97 and toxic > 0.95
    assert sum(r["kept"] for r in clean) > 0.98 * len(clean)


def test_odd_tables(spark, docs, rows, labels, empty):
    extra = docs.withColumnsRenamed({"lang": "quality", "n_chars": "lang"})
    got = Q.score_quality(extra, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)
    nothing = {r["doc_id"]: r for r in got}[900001]
    assert nothing["p_quality"] == pytest.approx(nothing["site_quality"])
    without = Q.score_quality(docs, labels.limit(0)).collect()
    assert {round(r["p_quality"], 6) for r in without} == {0.5}
    assert Q.score_quality(empty, labels).count() == 0
