"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import ctw, decontaminate, exact_dedup, feistel_order, fill_middle, jaccard_join, language_id, pii_surrogates, quality, sampled_pieces, secret_scan, spelling_variants, token_counts
from brindle.llm.common import remainder

#: Keys are parameters of a deployment; these are those of the registered queries.
ORDER_KEY, SURROGATE_KEY = b"training order 1", "surrogates 1"
TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secret_scan.scan(docs, secret_scan.trained(spark, secret_scan.labelled_samples(docs)))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pseudonymise(documents(spark, sf_dir), SURROGATE_KEY)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(documents(spark, sf_dir), size=4, num=85, den=100)


def op5_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir), remainder("doc_id", 10) != 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_order.materialise(documents(spark, sf_dir), ORDER_KEY, tokenizer=vocabulary(PIECES))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sampled segmentations: the ids themselves are the operator's output."""
    found = sampled_pieces.segmentations(documents(spark, sf_dir), vocabulary(PIECES))
    return found.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "log_prob", "inclusion", F.xxhash64("ids").alias("ids_hash"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 3) == 1
    found = language_id.identify(docs, language_id.fit(docs, ~held_out))
    return found.withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lasts where spark.brindle.tokenCountCache names a folder; else the run has a fresh one."""
    cache = spark.conf.get("spark.brindle.tokenCountCache", None)
    found = token_counts.count_tokens(documents(spark, sf_dir), vocabulary(TOKENIZER), cache)
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the transformed texts and of what is restored from them: the texts themselves are the operator's output."""
    return fill_middle.digests(documents(spark, sf_dir), fill_middle.Choice(seed="7", rate=100, spm_rate=50))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    found = quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP6_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
from d
"""


OP11_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as h,
    string_split(coalesce(text, ''), chr(10)) as parts
  from documents
), k as (
  select *, ('0x' || h[1:8])::uinteger::bigint as h1, ('0x' || h[9:16])::uinteger::bigint as h2, ('0x' || h[17:24])::uinteger::bigint as h3, ('0x' || h[25:32])::uinteger::bigint as h4,
    len(parts) - (parts[-1] = '')::int as n
  from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from k
), e as (
  select *, case when a = 0 then 0 when a >= n then length(t) else list_sum(list_transform(parts[1:a], lambda x: length(x) + 1)) end as p,
    case when b = 0 then 0 when b >= n then length(t) else list_sum(list_transform(parts[1:b], lambda x: length(x) + 1)) end as m
  from c
), f as (
  select *, t[1:p] as prefix, t[p + 1:m] as middle, t[m + 1:] as suffix from e
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then p::bigint end as prefix_chars, case when form <> 'plain' then (m - p)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from f
"""


def queries() -> dict:
    ops = (op1_secret_scan, op2_pii_surrogates, op3_template_decontamination, op4_ngram_jaccard, op5_context_tree, op6_exact_dedup, op7_training_order, op8_sampled_pieces, op9_language_id, op10_token_counts, op11_fill_middle, op12_spelling_variants, op13_quality, pipeline)
    return {op.__name__: op for op in ops}


def oracle_sql() -> dict:
    return {"op6_exact_dedup": OP6_SQL, "op11_fill_middle": OP11_SQL}
