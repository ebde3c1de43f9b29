"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendline.llm import (
    block_maxscore,
    conversation_repair,
    count_rollup,
    crosspolytope,
    extendible_dedup,
    license_rules,
    order_minhash,
    piece_dropout,
    rule_ensemble,
    simhash_ring,
    source_mix,
    toxic_spans,
    warc_revisits,
)
from mendline.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_piece_dropout(spark, sf):
    """doc_id, piece_ids, n_ids, lossless of every document."""
    return piece_dropout.round_trip(read(spark, sf, "documents"))


@query
def op2_source_mix(spark, sf):
    """doc_id, source, size, source_size, target, taken of every document."""
    return source_mix.mix(read(spark, sf, "documents"))


@query
def op3_toxic_spans(spark, sf):
    """doc_id, held_out, score, predicted, passages of every document."""
    return toxic_spans.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op4_license_rules(spark, sf):
    """doc_id, licenses, sentence_ids, unknown of every document."""
    return license_rules.scan(read(spark, sf, "documents"))


@query
def op5_count_rollup(spark, sf):
    """Documents, tokens and characters by source, language and tokenizer version after three batches."""
    return count_rollup.maintained(read(spark, sf, "documents"))


@query
def op6_exact_dedup(spark, sf):
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return extendible_dedup.exact_groups(read(spark, sf, "documents")).drop("bucket")


SQL["op6_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""


@query
def op7_simhash_ring(spark, sf):
    """doc_id, fingerprint, component_id of every document."""
    return simhash_ring.near_duplicates(read(spark, sf, "documents"))


@query
def op8_rule_ensemble(spark, sf):
    """doc_id, held_out, score, predicted of every document."""
    return rule_ensemble.classify(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query
def op9_crosspolytope(spark, sf):
    """vec_id, n_links, component_id, kept of every vector."""
    return crosspolytope.near_duplicates(read(spark, sf, "embeddings"))


@query
def op10_warc_revisits(spark, sf):
    """The answer to every revisit of the captures of all pages; headers as sorted lines."""
    found = warc_revisits.resolve(warc_revisits.captures(read(spark, sf, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("revisit_id", "url_key", "ts", "status", "response_id", "digest", F.array_join(lines, "\n").alias("headers"))


SQL["op10_warc_revisits"] = r"""
WITH p AS (
    SELECT page_id, url, sha1(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n, page_id % 8 AS rest,
        (page_id % 1000000) * 60 AS sec0
    FROM pages
), visits AS (
    SELECT page_id * 2 AS record_id, 'response' AS kind, url, sec0 AS sec, digest AS etag, sec0 - 86400 AS changed, digest, n FROM p
    UNION ALL
    SELECT page_id * 2 + 1, 'revisit',
        url || CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&utm_source=again' ELSE '?utm_source=again' END,
        CASE WHEN rest = 7 THEN sec0 - 30 ELSE sec0 + 30 END,
        CASE WHEN rest IN (1, 5) THEN 'x' || digest WHEN rest IN (2, 6) THEN NULL ELSE digest END, sec0 - 86400, digest, 0
    FROM p
), bare AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM visits
), tidy AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'),
        '[?&]+$', ''), '[?]&+', '?', 'g'), '&&+', '&', 'g') AS t FROM bare
), split AS (
    SELECT *, regexp_extract(t, '^[^/?]*') AS host, substr(t, length(regexp_extract(t, '^[^/?]*')) + 1) AS tail FROM tidy
), rec AS (
    SELECT *, nullif(regexp_replace(regexp_replace(lower(host), '^(www|m)[.]', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(tail, '/+$', ''), '/+[?]', '?', 'g'), '') AS url_key FROM split
), met AS (
    SELECT v.record_id AS revisit_id, v.url_key, v.sec, v.etag, v.changed, r.record_id AS response_id, r.etag AS r_etag,
        r.changed AS r_changed, r.digest AS r_digest, r.n,
        row_number() OVER (PARTITION BY v.record_id ORDER BY r.sec DESC NULLS LAST, r.record_id DESC) AS k
    FROM rec v LEFT JOIN rec r ON r.kind = 'response' AND r.url_key = v.url_key AND r.sec < v.sec
    WHERE v.kind = 'revisit'
), judged AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'orphan'
        WHEN etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'changed' END
        WHEN changed = r_changed THEN 'resolved' ELSE 'changed' END AS status
    FROM met WHERE k = 1
)
SELECT revisit_id, url_key, TIMESTAMP '2020-01-01 00:00:00' + to_seconds(sec) AS ts, status, response_id,
    CASE WHEN status = 'resolved' THEN r_digest END AS digest,
    CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10)
        || 'content-type: text/html' || chr(10) || 'date: ' || strftime(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(sec), '%Y-%m-%d %H:%M:%S')
        || chr(10) || 'etag: ' || r_digest END AS headers
FROM judged
"""


@query
def op12_order_minhash(spark, sf):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return order_minhash.compared(read(spark, sf, "documents"))


@query
def op11_block_maxscore(spark, sf):
    """item_id, rank, doc_id, score: the ten best documents of every benchmark item."""
    return block_maxscore.top(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


SQL["op11_block_maxscore"] = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents WHERE text IS NOT NULL
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), m AS (
    SELECT doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // total AS m FROM d, s WHERE len(terms) > 0
), tf AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term
), w AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs
), scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_conversation_repair(spark, sf):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    return conversation_repair.repair(read(spark, sf, "conversations"))
