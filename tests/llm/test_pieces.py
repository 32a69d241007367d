"""SentencePiece: ids against the library for both kinds of model, and the round trip."""

import public_tokenizers
import pytest
import sentencepiece
from voxloom.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " lead", "trail ", "\n\nx\ty", "ﬁ ½ é é", "日本語 " * 3, "", "  ", "a\xa0b",
    "\x00a \U0001f600z", "x" * 200 + " y", "line\n" + "z" * 90, "    deep    run", "Straße " * 5,
]


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces and scores as a unigram model: field 3 of the trainer settings is 1."""
    with open(PATH, "rb") as file:
        data = file.read()
    changed = data.replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01")
    assert changed != data
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(changed)
    return str(path)


def test_ids_equal_the_library(spark, docs, rows):
    model = P.load_model(PATH)
    assert model.kind == P.BPE
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    odd = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    some = docs.where("n_chars < 3000 or n_chars is null").select("doc_id", "text").unionByName(odd)
    got = P.encode_report(some.selectExpr("*", "1 AS part", "2 AS ids"), model).collect()
    assert len(got) == some.count()
    texts = {}
    for r in some.collect():
        texts.setdefault(r["doc_id"], []).append(library.encode(r["text"] or ""))
    for r in got:
        assert list(r["ids"]) in texts[r["doc_id"]]
        assert r["n_pieces"] == len(r["ids"]) and r["round_trip"]


def test_viterbi_finds_the_best_score_of_a_unigram_model(spark, unigram, rows):
    model = P.load_model(unigram)
    assert model.kind == P.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)

    def total(ids):
        return sum(library.get_score(i) for i in ids)

    # The first of the n best paths of the library's own lattice; words of known letters.
    texts = {w for r in rows[:40] for w in (r["text"] or "").split()[:12]}
    texts = sorted(w for w in texts if not any(library.is_byte(i) for i in library.encode(w)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = P.encode(df, model)
    got = encoded.withColumn("back", P.decode(encoded["ids"], model)).collect()
    assert len(got) == len(texts) > 100
    assert all(r["back"] == r["text"] for r in got)
    for r in got:
        best = library.nbest_encode_as_ids(r["text"], 5)
        assert total(r["ids"]) == max(map(total, best))
        assert "".join(model.pieces[i] for i in r["ids"]) == P.BLANK + r["text"]


def test_units_cross_nothing(rows):
    for r in rows:
        units = P.units_of(r["text"])
        whole = P.BLANK + (r["text"] or "").replace(" ", P.BLANK) if r["text"] else ""
        assert "".join(units) == whole


def test_empty_table(empty):
    assert P.encode_report(empty, P.load_model(PATH)).count() == 0
