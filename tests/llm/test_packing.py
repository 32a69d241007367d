"""Packing against the library's ids, a plain best fit, and the gapless sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from voxloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "it's WE'LL x'sy",
    "İSTANBUL ΑΣ Σ é é ́x", "a\r\ny　z\x1c w\x1dq\x85v", "日本語テキスト 12345 !!...",
    "ÀÉß×÷ÿ»x ª²µº", "x" * 70 + " " + "é!" * 50,
]


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_gives_the_ids_of_the_library(rows, special_as_text):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = special_as_text
    encoder = packing.WordEncoder(PATH, special_as_text)
    for text in ODD + [r["text"] or "" for r in rows] + ODD:
        got = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def checked(rows, packed, capacity):
    """Every document's pieces are there, and every sequence is gapless; returns how many."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for r in rows:
        all_ids = ids(tokenizer, r["text"])
        for piece, at in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[at : at + capacity]
            want[r["doc_id"], piece, at, len(part), crc(part)] += 1
    sequences = defaultdict(list)
    for r in packed:
        want[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] -= 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert not any(want.values())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


@pytest.mark.parametrize("most_open", [1, 2048])
def test_pieces_and_sequences(spark, docs, rows, most_open):
    frame = docs.withColumnsRenamed({"lang": "piece", "n_chars": "length"}).repartition(5)
    packed = packing.pack_documents(frame, PATH, most_open=most_open).collect()
    n = checked(rows, packed, 2048)
    total = sum(r["length"] for r in packed)
    assert n <= (1.02 if most_open > 1 else 1.5) * -(-total // 2048)


def test_many_equal_documents_over_many_tasks(spark):
    rows = [{"doc_id": i if i % 3 else 7, "text": "same words here " * (i % 3 + 1)} for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    packed = packing.pack_documents(frame, PATH, capacity=64, most_open=3).collect()
    assert checked(rows, packed, 64) <= 1.02 * -(-sum(r["length"] for r in packed) // 64)


def test_open_sequences_against_a_plain_best_fit():
    draw = np.random.default_rng(5)
    lengths = draw.integers(1, 101, 3000).tolist()
    for most in (1, 7, 400):
        sequences, open_, n = packing.OpenSequences(100, most), {}, 0
        for length in lengths:
            fits = [free for free in open_.values() if free >= length]
            number, offset, closed = sequences.place(length)
            if fits:
                assert open_[number] == min(fits)
            else:
                assert number == n
                n += 1
                open_[number] = 100
            assert offset == 100 - open_[number]
            open_[number] -= length
            for c in closed:
                # The fullest closes first.
                assert open_.pop(c) <= min(open_.values(), default=100)
            assert len(open_) <= most


def test_empty_table(spark, empty):
    assert packing.pack_documents(empty, PATH).count() == 0
