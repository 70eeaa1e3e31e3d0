"""The operators bound to the tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, exact_dedup, languages, licenses, line_dedup, ngram_join, packing, quality, ranked_search, repetition, substring_dedup, token_shards
from .common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.write_and_read(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(documents(spark, sf_dir))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(documents(spark, sf_dir))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_token_shards, op4_line_dedup, op5_quality_classifier, op6_byte_bpe, op7_suffix_array_dedup, op8_repetition_rules, op9_ngram_jaccard_join, op10_exact_dedup, op11_ranked_search, op12_token_alignment, op13_language_id)}
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Only where SQL says the whole result and is quick on whole tables; the other operators are tested against brute force.
SQL: dict[str, str] = {
    "op4_line_dedup": f"""WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth FROM documents),
 keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
 repeats AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
 FROM keyed LEFT JOIN repeats USING (key) GROUP BY doc_id""",
    "op9_ngram_jaccard_join": f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM pairs JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 100 * common >= 80 * (s.n + t.n - common)),
 ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reached AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT ways.y, reached.root FROM reached JOIN ways ON reached.node = ways.x)
 SELECT documents.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(root) AS component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN reached ON node = documents.doc_id GROUP BY documents.doc_id""",
    "op10_exact_dedup": """WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
 SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER best = doc_id AS kept, sha256(norm) AS text_sha256
 FROM texts WINDOW best AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)""",
    "op11_ranked_search": f"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}')) AS term FROM documents),
 sizes AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
 whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
 asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{_TERMS}')) AS term FROM benchmark) GROUP BY ALL),
 held AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
 weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), whole),
 impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS impact FROM held JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
 scores AS (SELECT item_id, doc_id, sum(times * impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
 SELECT item_id, row_number() OVER best::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20""",
}
