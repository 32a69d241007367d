"""Quality rules: counts against plain Python, the learned list on planted labels."""

import re

from pyspark.sql import functions as F
from voxloom.llm import rules as R


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_counts_and_base_rule(spark, docs, rows):
    extra = spark.createDataFrame(
        [(1, "a b c d e " * 3 + "z\nx y\nx y\n \n", 5), (2, "# | <> * $", 6)],
        "doc_id long, text string, n_words int",
    )
    for df in (docs.select("doc_id", "text"), extra):
        for r in R.judge(df, []).collect():
            want = plain_counts(r["text"])
            assert {k: r[k] for k in want} == want
            failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed)


def labelled(spark, n=600):
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        mark = "%$" if bad and i % 2 == 0 else ("!" if bad else "")
        words = [f"word{(i * 7 + k * 13) % 101}{mark}" for k in range(30 + i % 11)]
        rows.append((i, " ".join(words), 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_learned_list_is_ordered_and_precise(spark):
    table = labelled(spark)
    docs, labels = table.drop("quality"), table.drop("text")
    learned = R.quality_rules(docs, labels)
    assert learned and all(r.hits >= 19 * r.false_hits for r in learned)
    judged = R.judge(docs, learned).join(labels, "doc_id").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    assert right >= 0.97 * len(judged)
    # The first rule that holds names the row, by a plain walk over the list.
    values = R.judge(docs, learned).select("rule", *[v.alias(k) for k, v in R.features().items()])
    for r in values.collect():
        holds = [
            all((r[c.feature] >= c.cut) == c.at_least for c in rule.conditions) for rule in learned
        ]
        assert r["rule"] == (holds.index(True) + 1 if True in holds else None)


def test_no_labels_no_target_and_empty_tables(spark, empty):
    table = labelled(spark, 30)
    docs, labels = table.drop("quality"), table.drop("text")
    assert R.quality_rules(docs, labels.limit(0)) == []
    assert R.quality_rules(docs, labels.withColumn("quality", F.lit(1))) == []
    assert R.quality_rules(empty, labels) == []
    assert R.judge(empty, []).count() == 0


def test_kept_documents_are_unchanged(spark, docs, rows, labels):
    kept = R.keep_good(docs.withColumnRenamed("lang", "kept"), labels)
    assert kept.columns == ["doc_id", "text", "kept", "source", "n_chars"]
    texts = {r["text"] for r in rows}
    for r in kept.collect():
        assert r["text"] in texts and plain_counts(r["text"])["n_words"] >= 10
