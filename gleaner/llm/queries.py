"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import (
    bpe_codec,
    conversation_trie,
    exact_dedup,
    language_id,
    mixing,
    nearest_vectors,
    personal_data,
    simhash,
    source_divergence,
    substring_dedup,
    token_counts,
    url_filter,
    weighted_fingerprints,
)
from gleaner.llm.shared import table

TOKENIZER = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("factors")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of conversation prefixes; ties and nulls as conversation_trie.trie() says."""
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector; ties and nulls as nearest_vectors.nearest() says."""
    return nearest_vectors.nearest(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language, and its foremost terms; nulls as source_divergence.divergence() says."""
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_token_counts, op2_mixing, op3_simhash, op4_substring_dedup, op5_bpe_codec, op6_fingerprints, op7_language_id, op8_personal_data,
    op9_exact_dedup, op10_url_filter, op11_conversation_trie, op12_nearest_vectors, op13_source_divergence,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLES = {
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
        repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS owner FROM windows) WHERE owner < doc_id),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM repeated),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.pos) AS t
                 FROM words LEFT JOIN covered ON words.doc_id = covered.doc_id AND words.pos = covered.pos WHERE covered.pos IS NULL GROUP BY words.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op11_conversation_trie": """
        WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        turns AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS t FROM own GROUP BY conv_id),
        codes AS (SELECT conv_id, t, list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS code FROM turns),
        sums AS (SELECT conv_id, t, xor(list_reduce(code, lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 6 AS h FROM codes),
        again AS (SELECT a.conv_id, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM sums a LEFT JOIN sums b ON b.conv_id = a.conv_id - a.conv_id % 100),
        members AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM again),
        nodes AS (SELECT t[1:depth] AS k, depth, count(*) AS n, min(conv_id) AS conv_id, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(t) = depth) AS ends FROM members GROUP BY 1, 2),
        kids AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
        full_nodes AS (SELECT a.k, a.depth, a.n, a.conv_id, a.ends, coalesce(b.n, 0) AS children, CASE WHEN a.depth > 0 THEN (a.n - 1) * length(a.k[a.depth].text) ELSE 0 END AS saved FROM nodes a LEFT JOIN kids b ON a.k = b.k AND a.depth = b.depth),
        sub AS (SELECT k[1:d] AS k, d AS depth, sum(saved) AS saved, count(*) FILTER (children = 0) AS leaves FROM (SELECT k, saved, children, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1, 2)
        SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
        FROM full_nodes a JOIN sub s ON a.k = s.k AND a.depth = s.depth LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.k = a.k[1:a.depth - 1]""",
    "op13_source_divergence": """
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        words AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
        totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
              FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        both_parts AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM every_pair
              UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts) WHERE part = 'pair' OR rank <= 200""",
}
