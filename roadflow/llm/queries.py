"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.llm import decontaminate, langid, line_dedup, media, packing, pii, quality, simhash, substring_dedup, url_rules
from roadflow.llm.common import crc_of_id, table


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)))
    langs, matrix = langid.train(docs.filter("NOT held_out AND doc_id IS NOT NULL"))
    return langid.predict(docs, langs, matrix, keep=["doc_id", "held_out"])


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, tokenizer_path()))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("plain", 256).alias("base_sha256"), "spans", *(f"n_added_{k}" for k in pii.KINDS))


#: The fixed rules of the query: verdict, host, path prefix.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(verdict, host, path)")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return near.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _held_out_quality():
    return F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))


def quality_weights(docs: DataFrame, sf_dir: str):
    """Weights learned from the labels that are not held out."""
    labels = table(docs.sparkSession, sf_dir, "labels").select("doc_id", "quality").filter(~_held_out_quality())
    return quality.train(docs.select("doc_id", "text"), labels)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.predict(docs.withColumn("held_out", _held_out_quality()), quality_weights(docs, sf_dir), keep=["doc_id", "held_out"])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_webp_media, op2_language_id, op3_best_fit_packing, op4_personal_data, op5_url_filter, op6_simhash, op7_quality, op8_line_dedup, op9_decontamination, op10_substring_dedup)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {", ".join(map(str, URL_RULES))}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS row_no, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
met AS (SELECT row_no, max_by(rhost || rpath, 1000 * (length(rhost) + length(rpath)) + length(rhost)) AS rule, max_by(verdict, 1000 * (length(rhost) + length(rpath)) + length(rhost)) AS verdict
        FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY row_no)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN met USING (row_no)
""",
    "op8_line_dedup": """
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM raw),
k AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM l),
n AS (SELECT doc_id, i, k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS s FROM k WHERE k <> ''),
w AS (SELECT doc_id, s, k || chr(10) || lead(k, 1) OVER d || chr(10) || lead(k, 2) OVER d AS w FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM w WHERE w IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i FROM n JOIN (SELECT doc_id, s + o AS s FROM late, (VALUES (0), (1), (2)) AS t(o)) USING (doc_id, s))
SELECT doc_id, count(k.i) FILTER (k <> '') AS n_lines, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM l JOIN k USING (doc_id, i) LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
""",
}
