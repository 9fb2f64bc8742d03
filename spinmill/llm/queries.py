"""One thin query for each operator: the contract's columns over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, linededup, mixing, ngram_lm, quality, simhash, suffix_dedup, toxicity, urls
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda x: x["base"])
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    return df.select(
        "doc_id", "n_words", "n_base",
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0)).alias("score"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("removed"), (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"))


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ngram_lm.fit_and_score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    near = [F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256")]
    return df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), *near)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_lm_score, op3_toxicity, op4_suffix_dedup, op5_quality_rules, op6_decontaminate, op7_mix_sources, op8_line_dedup, op9_url_filter, op10_simhash)}

#: The contract's words of a text in DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Where DuckDB can say the same over whole tables. The other queries' hashes, models or sums of them it lacks; they are
#: held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM p),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, i, grams.n, item FROM grams JOIN win ON win.n = grams.n AND win.g = grams.g),
cover AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM hit) GROUP BY 1),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY 1),
post AS (SELECT rid, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
bags AS (SELECT DISTINCT item, n, list_sort(w[i:i + n - 1]) AS g, n + n * {decontam.SLOP} // 10 AS r FROM p),
rare AS (SELECT g, r, arg_min(t, coalesce(c, 0)) AS t FROM (SELECT g, r, unnest(g) AS t FROM (SELECT DISTINCT g, r FROM bags)) LEFT JOIN (SELECT t, count(*) AS c FROM post GROUP BY 1) USING (t) GROUP BY 1, 2),
around AS (SELECT g, r, rid, i, w[greatest(i - r + 1, 1):i + r - 1] AS v, least(i, r) AS mid FROM rare JOIN post USING (t) JOIN d USING (rid) WHERE list_has_all(w[greatest(i - r + 1, 1):i + r - 1], g)),
stretch AS (SELECT g, rid, v[k:k + r - 1] AS v FROM (SELECT *, unnest(range(1, mid + 1)) AS k FROM around)),
close AS (SELECT DISTINCT rid, g FROM stretch WHERE list_has_all(v, g) AND len(list_filter(list_distinct(g), lambda t: len(list_filter(v, lambda x: x = t)) < len(list_filter(g, lambda x: x = t)))) = 0),
near AS (SELECT rid, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT rid, item FROM close JOIN bags USING (g)) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near, '')) AS near_items_sha256
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)""",
}
