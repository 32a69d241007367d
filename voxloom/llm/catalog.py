"""The registered queries of the operators and the SQL that states their results."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import (
    chat,
    fingerprints,
    jaccard,
    languages,
    mixing,
    negatives,
    packing,
    pieces,
    quality,
    rules,
    sentences,
    spelling,
    wavelet,
)
from voxloom.session import shared_folder

SOURCE_WEIGHTS = [5.0, 2.0, 1.0]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, folder, "documents"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"), SOURCE_WEIGHTS)


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    model = pieces.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_report(table(spark, folder, "documents"), model)


def op5_token_wavelet_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    wavelet.write_tokens(table(spark, folder, "documents"), path, tokenizer)
    return wavelet.document_digests(spark, path)


def op6_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identify_documents(table(spark, folder, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return jaccard.near_duplicates(docs).drop("key")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    judged = rules.judge(docs.select("doc_id", "text"), rules.quality_rules(docs, labels))
    return judged.select("doc_id", *rules.STATISTICS, "base_failed", "kept", "rule")


def op9_chat_roles(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair_roles(table(spark, folder, "conversations"))


def op10_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentences.remove_repeats(docs)


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.group_variants(docs)


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine_hard_negatives(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mix_sources": op3_mix_sources,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_wavelet_files": op5_token_wavelet_files,
    "op6_language_mixture": op6_language_mixture,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_roles": op9_chat_roles,
    "op10_sentence_spans": op10_sentence_spans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

# All pairs of texts that share a shingle, counted on the full sets.
SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(
    regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1),
    lambda i: array_to_string(ws[i:i + 4], ' ')))) AS s FROM w WHERE len(ws) > 0),
  sets AS (SELECT s, min(doc_id) AS node, count(*) AS n_copies FROM g GROUP BY s),
  grams AS (SELECT node, len(s) AS n, unnest(s) AS t FROM sets),
  common AS (SELECT a.node AS a, b.node AS b, min(a.n) + min(b.n) AS n, count(*) AS c FROM grams a
    JOIN grams b ON a.t = b.t AND a.node < b.node GROUP BY a.node, b.node),
  near AS (SELECT a, b FROM common WHERE 5 * c >= 4 * (n - c)),
  linked AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
  reach(node, root) AS (SELECT node, node FROM sets UNION SELECT linked.b, reach.root FROM reach
    JOIN linked ON linked.a = reach.node WHERE linked.b > reach.root),
  classes AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
  counts AS (SELECT a AS node, count(*) AS n_links FROM linked GROUP BY a)
SELECT d.doc_id, coalesce(root, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
  coalesce(n_copies, 1) AS n_copies, coalesce(d.doc_id = root, true) AS is_first FROM documents d
  LEFT JOIN g USING (doc_id) LEFT JOIN sets USING (s) LEFT JOIN classes USING (node)
  LEFT JOIN counts USING (node)""",
    # Plain inner products of every anchor and every row.
    "op13_hard_negatives": r"""WITH v AS (SELECT DISTINCT vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other,
    CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c
    ON a.vec_id % 100 = 0 AND (a.vec_id <> c.vec_id OR a.label <> c.label OR a.q <> c.q)),
  pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id
    ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score,
  score AS negative_score FROM pos JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  QUALIFY rank <= 10""",
    # The checksum runs bit by bit over the bytes; neighbours share a word with a code point
    # deleted (both at one place: a replacement; one only: an insertion).
    "op11_spelling_variants": r"""WITH RECURSIVE runs AS (SELECT doc_id,
    unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    AS run, count(*) AS n FROM runs GROUP BY ALL),
  bits AS (SELECT run, n, flatten(list_transform(flatten(list_transform(
      string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)),
      lambda b: list_transform(range(8), lambda i: (b >> i) & 1))) AS b FROM lowered),
  sums AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT[])), lambda c, x:
      xor(c >> 1, 3988292384 * xor(c & 1, x))), 4294967295) AS h FROM bits),
  noisy AS (SELECT CASE WHEN h % 199 <> 0 THEN run ELSE substring(run, 1, CAST(h % length(run) AS INTEGER))
      || substring(run, CAST(h % length(run) AS INTEGER) + 2) END AS word, n FROM sums),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  skips AS (SELECT word, n, i, substring(word, 1, CAST(i AS INTEGER)) || substring(word, CAST(i AS INTEGER) + 2) AS rest
    FROM words, unnest(range(length(word))) AS t(i)),
  near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM words a JOIN skips s ON s.rest = a.word JOIN words b ON b.word = s.word
    UNION SELECT s.word, b.word, b.n FROM skips s JOIN words b ON s.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(other_n) AS most,
    arg_min(other, {'n': -other_n, 'w': encode(other)}) AS other FROM near GROUP BY word),
  formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form,
    CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)),
  steps(word, last) AS (SELECT word, word FROM formed UNION
    SELECT steps.word, formed.form FROM steps JOIN formed ON formed.word = steps.last WHERE formed.form IS NOT NULL),
  ends AS (SELECT steps.word, last AS root FROM steps JOIN formed ON formed.word = steps.last WHERE formed.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)""",
}
