"""The registered queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallymark.llm.bloom_lm import score_documents
from tallymark.llm.byte_bpe import encode_documents
from tallymark.llm.common import table
from tallymark.llm.embedding_dedup import near_vectors
from tallymark.llm.hard_negatives import mine_hard_negatives
from tallymark.llm.language_id import identify_languages
from tallymark.llm.line_crf import judge_documents, learn_line_crf
from tallymark.llm.mixing import mix_sources
from tallymark.llm.near_dedup import near_duplicates
from tallymark.llm.pii import pseudonymise_documents
from tallymark.llm.quality_model import score_quality
from tallymark.llm.spelling import group_variants
from tallymark.llm.token_counts import count_tokens
from tallymark.llm.warc import archive_and_read


#: Stands for the secret that a deployment keeps; pseudonyms in results follow from it.
PII_KEY = b"key of the registered queries"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise_documents(table(spark, sf_dir, "documents"), PII_KEY)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("node")


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, learn_line_crf(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        keep_ids=False,
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


def op12_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_cube_mix": op4_cube_mix,
    "op5_quality_model": op5_quality_model,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_line_crf": op8_line_crf,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_bloom_lm": op12_bloom_lm,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Smallest id reachable over ``links`` (a, b), both ways, for each of ``items`` (id).
_REACHED = """
    reach(id, other) AS (
        SELECT id, id FROM items
        UNION
        SELECT r.id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e
        ON r.other = e.a
    ),
    reached AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

ORACLES: dict[str, str] = {
    "op3_minhash_dedup": f"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
            ELSE array_to_string(w[i:i + 2], ' ') END AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM words WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    items AS (SELECT doc_id AS id FROM documents),
    links AS (
        SELECT a, b FROM (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
        ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
        WHERE 100 * common >= 85 * (p.n + q.n - common)
    ),
    {_REACHED}
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reached r ON r.id = d.doc_id
    """,
    "op6_warc": """
    WITH payloads AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ),
    sums AS (
        SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest
        FROM payloads
    ),
    placed AS (
        SELECT *, CASE WHEN payload_bytes >= 1000
            THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) ELSE page_id END AS response
        FROM sums
    )
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> response THEN response END AS refers_to
    FROM placed
    """,
    "op10_embedding_dedup": f"""
    WITH RECURSIVE vectors AS (
        SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y
        ON x.id < y.id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95
    ),
    items AS (SELECT vec_id AS id FROM embeddings),
    {_REACHED},
    ends AS (SELECT a AS id FROM links UNION ALL SELECT b FROM links),
    counts AS (SELECT id, count(*) AS n FROM ends GROUP BY id)
    SELECT r.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, r.id = component_id AS kept
    FROM reached r LEFT JOIN counts USING (id)
    """,
    "op11_spelling_variants": """
    WITH RECURSIVE crc_table AS (
        SELECT list(value ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)),
                lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS value
            FROM (SELECT unnest(range(256)) AS i)
        )
    ),
    runs AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
        WHERE length(run) >= 7
    ),
    same AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
            string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)::BIGINT]
                ELSE [192 + (ord(s) >> 6), 128 + (ord(s) & 63)] END))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM same, crc_table
    ),
    words AS (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT n, CASE WHEN h % 31 = 0
                THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word
            FROM hashed
        ) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ),
    shorter AS (
        SELECT word, n, k, word[:k] || word[k + 2:] AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
    ),
    near AS (
        SELECT x.word, y.word AS other, y.n AS other_n FROM shorter x JOIN shorter y
            ON x.rest = y.rest AND x.k = y.k WHERE x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM shorter x JOIN words y ON x.rest = y.word
        UNION SELECT y.word, x.word, x.n FROM shorter x JOIN words y ON x.rest = y.word
    ),
    best AS (
        SELECT word, count(*) AS n_near, min((-other_n, other)) AS top FROM near GROUP BY word
    ),
    forms AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near,
            CASE WHEN -top[1] >= 10 * n THEN top[2] END AS form, CASE WHEN -top[1] >= 10 * n THEN -top[1] END AS form_n
        FROM words LEFT JOIN best USING (word)
    ),
    way AS (
        SELECT word, word AS place, 0 AS steps FROM forms
        UNION ALL SELECT w.word, f.form, steps + 1 FROM way w JOIN forms f ON f.word = w.place WHERE f.form IS NOT NULL
    ),
    roots AS (SELECT word, arg_max(place, steps) AS root FROM way GROUP BY word)
    SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM forms JOIN roots USING (word)
    """,
    "op13_hard_negatives": """
    WITH vectors AS (
        SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scores AS (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
        FROM vectors a JOIN vectors b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
    ),
    positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id,
        (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5
    """,
}
