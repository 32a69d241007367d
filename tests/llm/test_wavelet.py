"""Wavelet matrix files: the structure against numpy, files against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from voxloom.llm import wavelet as V

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a  b", "it's we'll\n\n x \t y", "日本語 テキスト é ü \x00\x7f\x80", " lead", "trail ",
    "<|endoftext|> a", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", "in<|endoftext|>word  <|endoftext|>\n x",
    "<|endoftext", "<|endoftext|<|endoftext|>>", " <|endoftext|> ", "a \nb", "a\n b", "a   b c", "x\n  y 12 345,67!!", "　wide  　", "😀😀 ok",
]


def library(special_as_text=False):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@pytest.mark.parametrize("bits", [16, 20])
def test_access_rank_select(bits):
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 50257 if bits == 16 else 1 << 20, 3000)
    ids[::3] = 7
    matrix = V.WaveletMatrix.from_bytes(V.WaveletMatrix.build(ids, bits).to_bytes())
    assert (matrix.decode() == ids).all()
    assert (matrix.access(np.arange(3000)) == ids).all()
    for token in (7, 0, int(ids[1]), (1 << bits) - 1, 1 << bits):
        places = np.flatnonzero(ids == token)
        assert (matrix.occurrences(token) == places).all()
        before = np.concatenate(([0], np.cumsum(ids == token)))
        assert (matrix.rank(token, np.arange(3001)) == before).all()
    with pytest.raises(IndexError):
        matrix.access(np.array([3000]))
    with pytest.raises(IndexError):
        matrix.select(7, np.array([matrix.count(7)]))


@pytest.mark.parametrize("special_as_text", [False, True])
def test_pieces_encode_as_the_library_does(rows, special_as_text):
    tokenizer, encoder = library(special_as_text), V.PieceEncoder(PATH, special_as_text)
    for text in ODD + [r["text"] or "" for r in rows[:60]]:
        got = np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_known_pieces_need_no_pattern(rows):
    tokenizer, encoder = library(), V.PieceEncoder(PATH)
    words = "uno dos, tres! cuatro it's we'll café 12a 日本 a\nb c\n"
    encoder.encode(words)

    class Unused:
        def __getattr__(self, name):
            raise AssertionError("a text of known pieces is looked up only")

    blended, cuts, encoder.blended, encoder.cuts = encoder.blended, encoder.cuts, Unused(), Unused()
    assert encoder.encode(words) and encoder.encode("uno tres! dos, tres! café")
    encoder.blended, encoder.cuts = blended, cuts
    # Texts that share pieces, in which a blank may belong to the next cut or not.
    for text in ["uno  dos,", "uno c\n  tres!", "c\n dos,", "dos, \n tres!", "dos, ", " dos,", "uno \tdos, uno", "a\nb  "] * 2:
        got = np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark, docs, rows, tmp_path):
    tokenizer, path = library(), str(tmp_path / "shards")
    extra = docs.withColumnsRenamed({"lang": "part", "n_chars": "n_tokens"})
    V.write_tokens(extra, path, PATH, shard_tokens=5000)
    got = sorted(V.document_digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    ids_of = [r["doc_id"] for r in got]
    low = -(1 << 62)
    assert ids_of == sorted(ids_of, key=lambda i: low if i is None else i)
    want, start = {}, 0
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        data = np.array(ids, dtype="<u4").tobytes()
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(data)))
    for r in got:
        assert r["start"] == start
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    # The same sequence by lookups in the files.
    whole = sorted(V.read_documents(spark, path).collect(), key=lambda r: r["start"])
    flat = np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in whole])
    token = int(np.bincount(flat).argmax())
    counts = {r["token"]: r["n"] for r in V.token_counts(spark, path, [0, token]).collect()}
    assert counts == {0: int((flat == 0).sum()), token: int((flat == token).sum())}
    places = sorted(r["place"] for r in V.find_token(spark, path, token).collect())
    assert places == np.flatnonzero(flat == token).tolist()


def test_empty_table(spark, empty, tmp_path):
    path = str(tmp_path / "none")
    V.write_tokens(empty, path, PATH)
    assert V.document_digests(spark, path).count() == 0
