"""The pipeline, stage by stage on its own input, against plain Python.

Every stage runs once; the first test that asks for its table pays for it.
"""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from test_rules import plain_counts
from voxloom.llm import jaccard, rules
from voxloom.session import stored

STAGES = dict(corpus_pipeline.STAGES)
NAMES = list(STAGES)


@pytest.fixture(scope="module")
def learned():
    """The rules that the first stage learned, kept as it learned them."""
    held, learn = {}, rules.quality_rules

    def once(*args, **options):
        held["rules"] = learn(*args, **options)
        return held["rules"]

    rules.quality_rules = once
    yield held
    rules.quality_rules = learn


@pytest.fixture(scope="module")
def table(spark, folder, learned):
    """``table(name)``: the stored result of a stage; ``table("")``: the documents."""
    held = {"": spark.read.parquet(f"{folder}/documents.parquet")}

    def of(name):
        if name not in held:
            at = NAMES.index(name)
            given = of(NAMES[at - 1] if at else "")
            held[name] = stored(STAGES[name](spark, given, folder))
        return held[name]

    return of


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_quality_rules_keep_what_the_learned_list_keeps(table, learned):
    docs = table("")
    kept, given = texts(table("quality_rules")), texts(docs)
    assert table("quality_rules").columns == docs.columns
    # A filter would write the counts out again and again, so the rows are collected first.
    judged = rules.judge(docs, learned["rules"]).select("doc_id", "kept").collect()
    want = {r["doc_id"] for r in judged if r["kept"]}
    assert set(kept) == want and 0 < len(kept) < len(given)
    assert all(given[i] == t for i, t in kept.items())
    assert all(plain_counts(t)["n_words"] >= 10 for t in kept.values())


def test_near_duplicates_leave_no_close_pair(table):
    kept, single = texts(table("quality_rules")), texts(table("near_duplicates"))
    assert table("near_duplicates").columns == table("").columns
    assert set(single) <= set(kept)
    sets = {i: set(jaccard.shingles(t).tolist()) for i, t in single.items()}
    holders = defaultdict(list)
    for i, shingles in sets.items():
        for s in shingles:
            holders[s].append(i)
    common = Counter()
    for ids in holders.values():
        ids.sort()
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for (a, b), n in common.items():
        assert 5 * n < 4 * (len(sets[a]) + len(sets[b]) - n)


def test_repeated_spans_only_take_text_away(table):
    single, frame = texts(table("near_duplicates")), table("repeated_spans")
    assert frame.columns == table("").columns
    clean = {r["doc_id"]: r for r in frame.collect()}
    assert set(clean) == set(single)
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert any(len(clean[i]["text"]) < len(single[i]) for i in clean)


def test_mix_takes_whole_documents(table):
    clean, frame = texts(table("repeated_spans")), table("mix_sources")
    assert frame.columns == table("").columns
    many = Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert all(clean[i] == t for i, t in many) and max(many.values()) <= 3


def test_pieces_are_those_of_the_library(table):
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    mixed = table("mix_sources").collect()
    by_id = {r["doc_id"]: r["text"] for r in mixed}
    final = table("encode_pieces").collect()
    assert len(final) == len(mixed)
    assert table("encode_pieces").columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    for r in final:
        assert r["round_trip"] and list(r["ids"]) == library.encode(by_id[r["doc_id"]])


@pytest.mark.parametrize("name", NAMES[1:])
def test_odd_rows_pass_every_later_stage(spark, folder, odd_rows, docs, name):
    """Nulls, empty and repeated rows, clashing names: no stage fails or adds columns."""
    given = docs.where("doc_id >= 900000 or doc_id is null").select(
        "*", docs["text"].alias("key"), docs["doc_id"].alias("class_id"), docs["n_chars"].alias("hash")
    )
    out = STAGES[name](spark, given, folder)
    rows = out.collect()
    assert len(rows) > 0
    if name != NAMES[-1]:
        assert out.columns == given.columns


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_stays_empty(spark, folder, empty, name):
    assert STAGES[name](spark, empty, folder).count() == 0
