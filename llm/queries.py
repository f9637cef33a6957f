"""Registered queries over the corpus tables: each applies one operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gaugeline.session import scratch_table

from . import decontaminate, html_template, licenses, line_dedup, merkle, mixing, prefix_trie, quality_classifier, quality_rules, simhash, substring_dedup, token_files, warc
from .common import table


def op1_token_files(spark, sf_dir):
    return token_files.token_table(table(spark, sf_dir, "documents"), scratch_table(spark, "tokens"),
                                   public_tokenizers.path("word_bpe_49k.json"), by_word=True, cache_bytes=200_000_000)


def op2_warc(spark, sf_dir):
    return (warc.archive_pages(table(spark, sf_dir, "pages"), scratch_table(spark, "archive"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op3_simhash_dedup(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    return (line_dedup.remove_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5")))


def op8_substring_dedup(spark, sf_dir):
    return (substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=False)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark, sf_dir):
    return html_template.extract(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_warc, op3_simhash_dedup, op4_mixing, op5_license_scan, op6_decontaminate, op7_line_dedup, op8_substring_dedup, op9_quality_classifier, op10_quality_rules,
                                   op11_html_extraction, op12_merkle_manifest, op13_prefix_trie)}
WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE: dict[str, str] = {
    "op4_mixing": mixing.oracle_sql(WORDS),
    "op5_license_scan": licenses.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(WORDS),
    "op7_line_dedup": line_dedup.oracle_sql(),
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS x, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, payload_bytes,
               translate(upper(array_to_string(list_transform(range(8), lambda i: to_base(('0x' || substr(x, 5 * i + 1, 5))::BIGINT, 32, 4)), '')),
                         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM h""",
    "op8_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i0 FROM d),
        k AS (SELECT doc_id, i0, md5(array_to_string(w[i0:i0 + 34], ' ')) AS h FROM p),
        r AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
        g AS (SELECT doc_id, list(DISTINCT i) AS gone
              FROM (SELECT doc_id, unnest(range(i0, i0 + 35)) AS i FROM k JOIN r USING (h)) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
                   list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
}
