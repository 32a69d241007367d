"""Group spelling variants: words one inserted, deleted or replaced code point apart.

The words stand in two tries, one of the words and one of the words reversed, whose nodes
have numbers. A word cut at a place is a pair of numbers: the node of what stands before and
the node of what stands behind. Two words are one replacement apart exactly if they give the
same pair when the code point at one place is skipped, and one insertion apart exactly if
the pair of the shorter one, cut at a place, is the pair of the longer one with a code point
skipped there. So neighbours meet in one grouping by pairs of integers, without candidates
that a later test would drop.

A pair has at most one cut word and one skipping word for each letter there is, so groups
are small whatever the corpus holds, and counts and best forms come from totals of a group,
not from its pairs.

Odd input: a null text has no runs; a null ``doc_id`` is written as the empty string before
the colon. Repeated rows count as often as they stand there. Runs of any length are words.
Other columns are ignored. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.columns import shuffle_partitions
from voxloom.session import stored

RUN = r"[A-Za-zÀ-ÿ]+"
NOISE, MIN_LENGTH, MIN_COUNT, FORM_FACTOR = 199, 6, 5, 5
HELD_WORDS = 1 << 17

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def count_words(docs: DataFrame, noise: int = NOISE, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word, n`` of all runs of at least ``min_length`` code points.

    A run whose checksum with its document's id is divisible by ``noise`` loses one code
    point. A task adds up at most ``HELD_WORDS`` words at a time and Spark adds up the rest.
    """
    runs = re.compile(RUN)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            words, counts = pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lower = Counter()
                for run, n in Counter(runs.findall(text)).items():
                    if len(run) >= min_length:
                        lower[run.translate(_LOWER)] += n
                for word, n in lower.items():
                    h = zlib.crc32(f"{doc_id}:{word}".encode())
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield emptied()
        yield emptied()

    texts = docs.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text"
    )
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def number_nodes(words: DataFrame, backward: bool = False) -> DataFrame:
    """``word, n, rank, nodes``: the number of the trie node of every prefix, shortest first.

    Words are dealt by ranges in code-point order, so those that share a prefix stand
    together and each task walks its part of the trie with one stack; ``rank`` is the place
    in that order. With ``backward`` the words are read from their end, and the nodes are
    those of suffixes. The root, number 0, is not listed. Only where a range begins can its
    first word's prefixes have a number in a range before; the driver settles that from one
    row a range.
    """

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, nodes, made, place = "", [], 0, 0
        for batch in batches:
            listed = []
            for key in batch["key"]:
                shared = len(commonprefix((before, key)))
                new = len(key) - shared
                nodes = nodes[:shared] + list(range(made, made + new))
                made += new
                before = key
                listed.append(nodes)
            batch["nodes"] = listed
            batch["place"] = range(place, place + len(batch))
            place += len(batch)
            yield batch

    key = F.reverse("word") if backward else F.col("word")
    dealt = words.withColumn("key", key).repartitionByRange(
        shuffle_partitions(words.sparkSession), F.col("key").asc()
    )
    local = dealt.sortWithinPartitions("key").mapInPandas(
        walked, "word string, n long, key string, nodes array<long>, place long"
    )
    local = stored(local.withColumn("part", F.spark_partition_id()))
    edges = local.groupBy("part").agg(
        F.min_by("key", "place").alias("first"),
        F.max_by(F.struct("key", "nodes"), "place").alias("last"),
        F.count(F.lit(1)).alias("rows"),
        F.max(F.array_max("nodes")).alias("made"),
    )
    starts, start, rank, before, open_nodes = [], 1, 0, "", []
    for edge in sorted(edges.collect(), key=lambda e: e["part"]):
        same = open_nodes[: len(commonprefix((before, edge["first"])))]
        starts.append((edge["part"], start, rank, same))
        before = edge["last"]["key"]
        open_nodes = [same[x] if x < len(same) else start + x for x in edge["last"]["nodes"]]
        start += edge["made"] + 1
        rank += edge["rows"]
    table = words.sparkSession.createDataFrame(
        starts, "part int, start long, first_rank long, same array<long>"
    )
    # The first nodes of a range are the prefixes of its first word.
    number = F.transform(
        "nodes",
        lambda x: F.when(x < F.size("same"), F.get("same", x.cast("int"))).otherwise(F.col("start") + x),
    )
    # One row a range, so at most spark.sql.shuffle.partitions rows.
    return local.join(F.broadcast(table), "part").select(
        "word", "n", (F.col("first_rank") + F.col("place")).alias("rank"), number.alias("nodes")
    )


def cut_pairs(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """``prefix, suffix, rank, n, skips, leads`` of every place of every word.

    ``skips`` says that the code point behind the prefix is left out. Of equal code points in
    a row only the first ``leads``, so that a word and its neighbour meet once.
    """
    both = forward.join(backward.select("word", F.col("nodes").alias("suffixes")), "word")
    size = F.size("nodes")

    def node(nodes: str, length: Column) -> Column:
        return F.when(length == 0, F.lit(0).cast("bigint")).otherwise(F.get(nodes, length - 1))

    def pair(at: Column, skipped: int, leads: Column) -> Column:
        return F.struct(
            node("nodes", at).alias("prefix"),
            node("suffixes", F.size("suffixes") - at - skipped).alias("suffix"),
            F.lit(bool(skipped)).alias("skips"),
            leads.alias("leads"),
        )

    lettered = both.withColumn("letters", F.split("word", ""))
    new = lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, 1, new(i)))
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, 0, F.lit(False)))
    return lettered.select("rank", "n", F.explode(F.concat(skips, cuts)).alias("p")).select(
        "rank", "n", "p.*"
    )


def neighbours(pairs: DataFrame) -> DataFrame:
    """``rank, n_near, best``: how many near words, and the one of largest ``n``.

    ``best`` is a struct of ``-n`` and the rank, so that its smallest is the best.
    """
    member = F.struct((-F.col("n")).alias("less"), "rank", "leads")
    groups = pairs.groupBy("prefix", "suffix").agg(
        F.sort_array(F.collect_list(F.when(F.col("skips"), member))).alias("skipping"),
        F.collect_list(F.when(~F.col("skips"), member)).alias("cut"),
    )
    met = groups.where(F.size("skipping") + F.size("cut") > 1)
    best = lambda m: F.struct(m["less"].alias("less"), m["rank"].alias("rank"))
    cut = F.get("cut", F.lit(0))
    longer = F.filter("skipping", lambda m: m["leads"])

    def of_skipping(m: Column) -> Column:
        """Replacements: the others of the group. A deletion: the cut word."""
        other = F.when(m["rank"] == F.get("skipping", F.lit(0))["rank"], F.get("skipping", F.lit(1)))
        other = other.otherwise(F.get("skipping", F.lit(0)))
        shorter = m["leads"] & (F.size("cut") > 0)
        return F.struct(
            m["rank"].alias("rank"),
            (F.size("skipping") - 1 + shorter.cast("int")).alias("near"),
            F.array_min(
                F.array_compact(
                    F.array(
                        F.when(other.isNotNull(), best(other)), F.when(shorter, best(cut))
                    )
                )
            ).alias("best"),
        )

    of_cut = F.transform(
        "cut",
        lambda m: F.struct(
            m["rank"].alias("rank"),
            F.size(longer).alias("near"),
            F.when(F.size(longer) > 0, best(F.get(longer, F.lit(0)))).alias("best"),
        ),
    )
    found = met.select(F.explode(F.concat(F.transform("skipping", of_skipping), of_cut)).alias("f"))
    return (
        found.select("f.*").where(F.col("near") > 0)
        .groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """``rank, form, root`` of the words that have a form, by doubling the steps.

    A form has at least ``FORM_FACTOR`` times the occurrences, so chains are short and never
    turn back. A word has few neighbours, so no form is a hot key.
    """
    links = stored(forms.select("rank", "form", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        links = stored(
            links.join(further, "root", "left").select(
                "rank", "form", F.coalesce("next", "root").alias("root"),
                F.col("next").isNotNull().alias("moved"),
            )
        )
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")


def group_variants(
    docs: DataFrame,
    noise: int = NOISE,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    factor: int = FORM_FACTOR,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    Words have at least ``min_length`` code points and ``min_count`` occurrences. ``form`` is
    the near word with the most occurrences (ties: the first in code-point order) if it has
    at least ``factor`` times the word's own.
    """
    counts = count_words(docs, noise, min_length)
    words = stored(counts.where(F.col("n") >= min_count))
    forward = stored(number_nodes(words))
    near = neighbours(cut_pairs(forward, number_nodes(words, backward=True)))
    ranked = forward.select("rank", "word", "n")
    most = -F.col("best.less")
    found = ranked.join(near, "rank", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(most >= factor * F.col("n"), F.struct(F.col("best.rank").alias("rank"), most.alias("n"))).alias("form"),
    )
    found = stored(found)
    # Only words with a form take part in the joins by form, so no null is a hot key.
    chained = roots(found.where(F.col("form").isNotNull()).select("rank", F.col("form.rank").alias("form")))
    spelled = lambda name: ranked.select(F.col("rank").alias(name), F.col("word").alias(f"{name}_word"))
    named = chained.join(spelled("form"), "form").join(spelled("root"), "root")
    own = found.select("rank", "word", "n", "n_near", F.col("form.n").alias("form_n"))
    named = named.select("rank", F.col("form_word").alias("form"), "root_word")
    return own.join(named, "rank", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
