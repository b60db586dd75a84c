"""The operators bound to the tables of the driver contract: one thin query each, with its SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontamination, jaccard_join, language_model, license_scan, order_minhash, packing, passages, prefix_trie, secret_scan, simhash, substring_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.log_likelihood(_read(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_findings(_read(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), *(f"n_{k}" for k in secret_scan.BASE), F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_spans(_read(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_sensitivity(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversations, conversation_repair.damaged(conversations))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(_read(spark, sf_dir, "conversations"), prefix_trie.shared_turns(F.col("conv_id")))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_order_minhash": op9_order_minhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

ORACLE_SQL = {
    "op1_decontamination": rf"""
with words as (
  select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null
), wanted as (
  select distinct item_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as shingle from words
), sizes as (
  select item_id, count(*) as item_shingles from wanted group by item_id
), held as (
  select distinct doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) as shingle
  from (select doc_id, {_WORDS} as w from documents where text is not null)
), shared as (
  select doc_id, item_id, count(*) as shared from held join wanted using (shingle) group by all
)
select doc_id, item_id, shared, item_shingles, shared / item_shingles::double as containment
from shared join sizes using (item_id) where shared / item_shingles::double >= 0.8
""",
    "op4_jaccard_join": rf"""
with recursive words as (
  select row_number() over () as r, doc_id, {_WORDS} as w from (select doc_id, coalesce(text, '') as text from documents)
), classes as (
  select w, min(doc_id) as first, count(*) as n from words where len(w) > 0 group by w
), shingles as (
  select distinct first, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s from classes
), sizes as (
  select first, count(*) as n from shingles group by first
), shared as (
  select a.first as a, b.first as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.first != b.first group by all
), links as (
  select a, b from shared join sizes x on x.first = a join sizes y on y.first = b where shared.n / (x.n + y.n - shared.n)::double >= 0.8
), reach(node, other) as (
  select first, first from classes
  union
  select node, b from reach join links on a = other
), groups as (
  select node, min(other) as class_id from reach group by node
), counts as (
  select a, count(*) as n_links from links group by a
)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links, coalesce(classes.n - 1, 0) as n_copies
from words left join classes using (w) left join groups on node = first left join counts on a = first
""",
    "op10_repeated_passages": r"""
with texts as (
  select row_number() over () as r, doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') as w, regexp_split_to_array(text, '[\p{L}\p{N}]+') as gaps from documents where text is not null
), placed as (
  select r, i, sum(length(word) + length(gap)) over (partition by r order by i) as stop, length(word) as n
  from (select r, unnest(w) as word, unnest(gaps[1:len(w)]) as gap, unnest(range(len(w))) as i from texts)
), windows as (
  select r, doc_id, i, md5(lower(array_to_string(w[i + 1:i + 50], ' '))) as passage from (select r, doc_id, w, unnest(range(len(w) - 49)) as i from texts where len(w) >= 50)
), repeated as (
  select *, min({'doc': doc_id, 'word': i}) over (partition by passage) as lead from windows qualify count(*) over (partition by passage) > 1
), runs as (
  select *, i - lead.word as shift, i - row_number() over (partition by r, lead.doc, i - lead.word order by i) as run from repeated
)
select doc_id, min(i) as word, min(a.stop - a.n)::bigint as start, max(b.stop)::bigint as stop, max(i) - min(i) + 50 as n_words, lead.doc as source_doc, min(i) - shift as source_word, lead.doc = doc_id and shift = 0 as keep
from runs join placed a using (r, i) join (select r, i - 49 as i, stop from placed) b using (r, i) group by r, doc_id, lead.doc, shift, run
""",
}
