"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, common, flac, language_id, mixing, permutation_index, repeats, secrets, sharding, simhash, token_counts

TOKEN_LIMIT = 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_text(common.documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"))
    return counted.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {TOKEN_LIMIT} AS over_limit")


#: Domains are told from the source's number; weights of domains and languages, in whole numbers; sources weigh alike.
DOMAIN = "CASE WHEN source IS NULL THEN '' ELSE concat('d', CAST(length(source) * 7 + ascii(right(source, 1)) AS BIGINT) % 4) END"
DOMAIN_WEIGHT = "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END"
LANG_WEIGHT = "CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END"
#: Tokens are estimated from UTF-8 bytes, four to a token; a run takes as many tokens as the corpus holds.
TOKENS = "CAST((coalesce(octet_length(text), 0) + 3) div 4 AS BIGINT)"


def levels() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def weights() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN_WEIGHT), "lang": F.expr(LANG_WEIGHT), "source": F.lit(1)}


def mixed(docs: DataFrame) -> DataFrame:
    plan = mixing.plan(docs, F.expr(TOKENS), levels(), weights(), F.sum("tokens"))
    return mixing.selected(docs, plan, levels())


def op3_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", F.expr(TOKENS).alias("n_tokens"), F.col("epoch").cast("long").alias("epoch"))


def _share_sql(name: str, parent: str, node: str, weight: str, above: str) -> str:
    """CTEs that give each child its part of its parent's budget; as mixing.share."""
    part = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_n AS (SELECT {node}, sum(capacity)::HUGEINT AS c, ({weight})::HUGEINT AS w FROM leaves GROUP BY {node}),
{name}_u AS (SELECT n.*, {above}),
{name}_b AS (SELECT *, row_number() OVER o AS k, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS w_open FROM {name}_u WINDOW o AS ({part} ORDER BY c::DOUBLE / w, {node})),
{name}_f AS (SELECT *, min(CASE WHEN greatest(up - used, 0) * w < c * w_open THEN k END) OVER ({part}) AS k_open FROM {name}_b),
{name}_g AS (SELECT *, min(CASE WHEN k = k_open THEN used END) OVER ({part}) AS u0, min(CASE WHEN k = k_open THEN w_open END) OVER ({part}) AS w0 FROM {name}_f),
{name} AS (SELECT {node}, CASE WHEN k_open IS NULL OR k < k_open THEN c ELSE least(c, greatest(up - u0, 0) * w // w0) END AS budget FROM {name}_g)"""


OP3_SQL = f"""WITH t AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s, (strlen(coalesce(text, '')) + 3) // 4 AS n_tokens FROM documents),
leaves AS (SELECT domain, l AS lang, s AS source, sum(n_tokens)::HUGEINT AS tokens, (sum(n_tokens) * {mixing.EPOCHS})::HUGEINT AS capacity FROM t GROUP BY ALL),
{_share_sql("d", "", "domain", DOMAIN_WEIGHT, "(SELECT sum(tokens)::HUGEINT FROM leaves) AS up FROM d_n n").strip()},
{_share_sql("g", "domain", "domain, lang", LANG_WEIGHT, "d.budget AS up FROM g_n n JOIN d USING (domain)").strip()},
{_share_sql("q", "domain, lang", "domain, lang, source", "1", "g.budget AS up FROM q_n n JOIN g USING (domain, lang)").strip()},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM q JOIN leaves USING (domain, lang, source)),
r AS (SELECT t.*, whole, rest, sum(n_tokens) OVER (PARTITION BY t.domain, l, s ORDER BY md5(concat_ws(':', '{mixing.SEED}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))), doc_id) AS upto
  FROM t JOIN p ON t.domain = p.domain AND t.l = p.lang AND t.s = p.source)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(0, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT))::BIGINT AS epoch FROM r"""


def op6_flac_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return flac.digests(common.documents(spark, sf_dir))


def op7_permutation_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    vectors = permutation_index.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return permutation_index.search(vectors, vectors.where("id % 20 = 0"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return bpe.round_trip(common.documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return secrets.scan(common.documents(spark, sf_dir))


def op8_maximal_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return repeats.without_repeats(common.documents(spark, sf_dir))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.bounded_batches(spark)
    docs = common.documents(spark, sf_dir)
    filters = language_id.learn(language_id.training(docs))
    found = language_id.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_label_propagation_shards": op1_label_propagation_shards,
        "op2_token_counts": op2_token_counts,
        "op3_hierarchical_mixing": op3_hierarchical_mixing,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_secret_scan": op5_secret_scan,
        "op6_flac_round_trip": op6_flac_round_trip,
        "op7_permutation_neighbours": op7_permutation_neighbours,
        "op8_maximal_repeats": op8_maximal_repeats,
        "op9_simhash_components": op9_simhash_components,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_hierarchical_mixing": OP3_SQL}
