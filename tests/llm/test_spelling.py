"""Spelling variants against all pairs in plain Python."""

import re
import zlib
from collections import Counter

from voxloom.llm import spelling

SCHEMA = "doc_id long, text string, n long, word string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(
        long[:i] + long[i + 1 :] == short for i in range(len(long))
    )


def plain(rows, noise=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            forms[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out[w] = (form, root, n, len(beside[w]), words[form] if form else None)
    return out


def found(frame, **options):
    rows = spelling.group_variants(frame, **options).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_variants_equal_all_pairs(spark, docs, rows):
    want = plain([(r["doc_id"], r["text"]) for r in rows])
    # Columns with the operator's own names do no harm.
    got = found(docs.withColumnsRenamed({"n_chars": "rank", "lang": "word"}))
    assert got == want and len(want) > 500


def test_runs_of_equal_letters_ties_and_chains(spark):
    texts = {
        "balloon": 200, "baloon": 30, "balooon": 6, "ballon": 30, "balloonn": 5,
        "Àérien": 5, "aérien": 5, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125,
        "xabcde": 40, "yabcde": 40, "zabcde": 8, "abcdef": 5, "bcdefg": 5,
    }
    rows = [(i, f"{w} " * n) for i, (w, n) in enumerate(texts.items())]
    rows += [(None, "nullid " * 7), (77, None), (78, ""), (79, "x" * 3000 + " " + "x" * 3001)]
    rows += [(80, ("y" * 5000 + " ") * 5), (81, ("y" * 4999 + " ") * 50)]
    frame = spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA)
    got, want = found(frame), plain(rows)
    assert got == want
    assert got["zabcde"][0] == "xabcde" and got["aaaaaa"][1] == "aaaaaaaa"
    assert got["y" * 5000][0] == "y" * 4999


def test_hot_word_and_noise(spark):
    rows = [(i, "government government " + ("goverment" if i % 3 else "tokens")) for i in range(3000)]
    got = found(spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA), noise=7)
    assert got == plain(rows, 7)


def test_node_numbers_are_those_of_one_trie(spark):
    words = sorted({w[:k] + t for w in ("prefix", "preface", "q", "zebra") for k in (1, 3, 6) for t in ("", "a", "ab")})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for backward in (False, True):
        nodes = {}
        for r in spelling.number_nodes(frame, backward).collect():
            text = r["word"][::-1] if backward else r["word"]
            for i, node in enumerate(r["nodes"]):
                assert nodes.setdefault(text[: i + 1], node) == node
        assert len(set(nodes.values())) == len(nodes) and 0 not in nodes.values()


def test_empty_table(spark, empty):
    assert spelling.group_variants(empty).count() == 0
