"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm import embedding_dedup, line_dedup, line_quality, mips_search, mixing, oracles, packing, periodic_runs, private_data, quality_ranking, simhash_dedup, token_counts, url_reputation, whitening
from laminar.session import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_ranking.train(docs, _read(spark, sf_dir, "labels"))
    return quality_ranking.score_documents(docs, model).select("doc_id", quality_ranking.held_out().alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "repeat", "start", "length", "bin_id", "capacity", "used", "slot")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(_read(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed by this query alone

    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge_urls(_read(spark, sf_dir, "pages"), outcomes)


def op6_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings")
    return mips_search.search(table, table.where("vec_id % 20 = 0"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.kept_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private_data(_read(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS long) AS n_{k}") for k in private_data.KINDS]
    base = private_data.span_text(F.col("spans"))
    everything = private_data.span_text(F.array_sort(F.concat("spans", "added")))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), everything.alias("spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` whose texts repeat from some word on, in those one of ten documents that their id's checksum picks."""
    planted = r"""transform(array(filter(split(text, '[ \\x09-\\x0D]+'), x -> x != '')), w -> transform(array(g % size(w)), a ->
      transform(array(1 + (size(w) - a) div (3 + g % 8)), p -> array_join(transform(w, (x, i) -> IF(i < a, x, w[CAST(a + (i - a) % p AS int)])), ' '))[0])[0])[0]"""
    h = F.crc32(F.col("doc_id").cast("string"))
    pick = docs.select("doc_id", "text", h.alias("h"), F.expr("div(crc32(CAST(doc_id AS string)), 10)").alias("g"))
    return pick.select("doc_id", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^ \x09-\x0D]"), F.expr(planted)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(_read(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> named_struct('l', r.length, 's', -r.start, 'p', -r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    with_best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    columns = [(-F.col("b.s")).alias("start"), F.col("b.l").alias("length"), (-F.col("b.p")).alias("period"), F.expr("1000 * b.l div -b.p").alias("exponent_milli")]
    return with_best.select("doc_id", "n_runs", *columns, "runs_sha256", "collapsed_sha256")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_quality.judge_documents(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars", *[f"n_{r}" for r in line_quality.RULES])


def queries() -> dict:
    made = (op1_quality_ranking, op2_best_fit_packing, op3_embedding_dedup, op4_token_counts, op5_url_reputation, op6_inner_product_search, op7_simhash_dedup, op8_fuzzy_lines, op9_private_data, op10_source_mixing, op11_periodic_runs, op12_embedding_whitening, op13_line_quality)
    return {f.__name__: f for f in made}


OP5_SQL = """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
o AS (SELECT doc_id AS page_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, string_split(host, '.')[-1] AS suffix,
        CASE WHEN contains(host, '.') THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS domain,
        CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
      FROM p LEFT JOIN o USING (page_id) GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix, domain),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
s1 AS (SELECT s.*, (SELECT (sum(bad) + 0.5) / (sum(n) + 1.0) FROM s) AS above FROM s),
sk AS (SELECT coalesce(greatest(2.0, least(500.0, (sum(n * above * (1 - above)) / sum(n)) / greatest(1e-9, sum(n * (bad / n - above) ** 2) / sum(n) - sum(above * (1 - above)) / sum(n)) - 1)), 500.0) AS k FROM s1 WHERE n > 0),
sm AS (SELECT suffix, (bad + k * above) / (n + k) AS above FROM s1, sk),
d1 AS (SELECT d.*, above FROM d JOIN sm USING (suffix)),
dk AS (SELECT coalesce(greatest(2.0, least(500.0, (sum(n * above * (1 - above)) / sum(n)) / greatest(1e-9, sum(n * (bad / n - above) ** 2) / sum(n) - sum(above * (1 - above)) / sum(n)) - 1)), 500.0) AS k FROM d1 WHERE n > 0),
dm AS (SELECT suffix, domain, (bad + k * above) / (n + k) AS above FROM d1, dk),
h1 AS (SELECT h.*, above FROM h JOIN dm USING (suffix, domain)),
hk AS (SELECT coalesce(greatest(2.0, least(500.0, (sum(n * above * (1 - above)) / sum(n)) / greatest(1e-9, sum(n * (bad / n - above) ** 2) / sum(n) - sum(above * (1 - above)) / sum(n)) - 1)), 500.0) AS k FROM h1 WHERE n > 0),
hm AS (SELECT host, n, k, (bad + k * above) / (n + k) AS mean FROM h1, hk),
lo AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + k + 1)) AS low FROM hm),
r AS (SELECT p.*, low,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN lo USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > (SELECT max(above) FROM s1) THEN 'block' ELSE 'allow' END AS verdict,
  round(low, 6) AS bad_low
FROM r
"""


def oracle_sql() -> dict:
    """Operators that SQL can express; the others are tested against brute force in ``tests/llm``."""
    return {"op5_url_reputation": OP5_SQL, "op11_periodic_runs": oracles.periodic_runs(), "op13_line_quality": oracles.line_quality()}
