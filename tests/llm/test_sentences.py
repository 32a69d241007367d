"""Sentence runs against a plain pass, and planted passages."""

import random

from pyspark.sql import functions as F
from voxloom.llm import sentences as S


def test_repeats_equal_a_plain_pass(spark, docs, rows):
    got = S.remove_repeats(docs.withColumnRenamed("lang", "n_removed_before")).collect()
    assert len(got) == len(rows)
    keys = {
        (r["doc_id"], r["text"]): r["k"]
        for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()
    }
    low = -(1 << 62)
    distinct = sorted(keys, key=lambda r: (low if r[0] is None else r[0], keys[r]))
    seen, want = set(), {}
    for doc_id, text in distinct:
        starts = set()
        for place, value in S.run_hashes(text or ""):
            if value in seen:
                starts.add(place)
            seen.add(value)
        want[doc_id, text] = S._cut(text, starts, S.RUN)
    expected = [(r["doc_id"], *want[r["doc_id"], r["text"]]) for r in rows]
    found = [(r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_planted_passages_stay_once(spark):
    passage = " ".join(
        f"The {w} of the long passage is told here in full, word for word." for w in
        ("first part", "second part", "third part", "fourth part", "fifth part")
    )
    texts = [
        "Own words open this one. " + passage + " Own words close it.",
        "Another start.\n" + passage + "\nAnother end.",
        "The. And. Of. In.",
        "The. And. Of. In.",
        "No marks here " + " ".join(f"w{i}" for i in range(200)),
        "Something else before it " + " ".join(f"w{i}" for i in range(200)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert out[0]["text"] == texts[0] and out[0]["n_removed"] == 0
    assert out[1]["text"] == "Another start.\nAnother end."
    # Short phrases repeat by chance and stay.
    assert out[2]["text"] == texts[2] and out[3]["text"] == texts[3]
    # Text without marks is cut by content, so the passage is found there too.
    assert out[4]["text"] == texts[4] and len(out[5]["text"].split()) < 80


def test_pieces_make_up_the_text(rows):
    for r in rows:
        text = r["text"] or ""
        ends = S.sentence_ends(text)
        assert ends == sorted(set(ends))
        if text.strip():
            assert ends[-1] == len(text)


def test_empty_table_and_clashing_names(spark, empty):
    assert S.remove_repeats(empty).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "k")], "doc_id long, text string, n_removed int, key string")
    (row,) = S.remove_repeats(df).collect()
    assert row.asDict() == {"doc_id": 1, "text": "a", "key": "k", "n_sentences": 1, "n_removed": 0}


def _passages(n):
    """``(passage, first document, second document)``: edges mid-sentence, 51-70 words."""
    rng = random.Random(5)

    def some(count):
        return [f"w{rng.randrange(400)}" for _ in range(count)]

    for i in range(n):
        shared = some(rng.randrange(51, 71))
        # One sentence, or two with a mark in any place.
        if i % 2:
            shared[rng.randrange(len(shared) - 1)] += "."
        docs = []
        for _ in range(2):
            before, after = some(rng.randrange(1, 40)), some(rng.randrange(1, 40))
            own = " ".join(some(60)) + ". "
            docs.append(own + " ".join(before + shared + after) + ". " + " ".join(some(60)) + ".")
        yield " ".join(shared), *docs


def test_passages_inside_sentences_are_found(spark):
    cases = list(_passages(150))
    texts = [t for _, *two in cases for t in two]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in S.remove_repeats(df).collect()}
    for i, (passage, first, second) in enumerate(cases):
        assert out[2 * i] == first
        left = out[2 * i + 1]
        assert passage not in left
        # Only words of the passage go.
        before, after = second.split(passage)
        assert left.startswith(before) and left.endswith(after)


def test_ends_and_quoted_short_texts_are_found(spark):
    first = "Ten words are in the first sentence of this text. "
    texts = [
        first + "The second one has ten words in it as well. Bye now.",
        "Before it stands this. " + first + "The second one has ten words in it as well. Bye now. Then more.",
        "Far away. So it goes. Nobody knew why.",
        "Here now. Far away. So it goes. Nobody knew why. And on.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in S.remove_repeats(df).collect()}
    # A text of two sentences is found inside a longer one, with its short last sentence.
    assert out[1] == "Before it stands this. Then more."
    # Three whole sentences of eight words still are a run.
    assert out[2] == texts[2] and out[3] == "Here now. And on."
