"""Tables of the data folder and SQL fragments that several oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, MACRO
from corpusloom.functions.text import WS

#: Models of model_predictions.
MODELS = ["classical_tfidf", "encoder_seed_1", "llm_zero_shot"]
CANDIDATES = ["ood_2020_dev", "ood_2021_dev"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns with null read as ''."""
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def leakage_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The pre-check's rows, null texts and ids read as ''."""
    return blanks(table(spark, folder, "ood_leakage_precheck"), ["source_id", "original_text", "processed_text"])


def sql_strip(x: str) -> str:
    """SQL: ``x`` without white space at its ends."""
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_normalized(x: str) -> str:
    """SQL: normalized raw label."""
    bare = sql_strip(f"coalesce({x}, '')")
    return f"(case when {bare} = 'United_Arab_Emirates' then 'UAE' else {bare} end)"


def sql_macro(x: str) -> str:
    """SQL: macro label of a normalized raw label."""
    return f"(case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in MACRO.items()) + " end)"


def sql_tokens(x: str) -> str:
    """SQL: tokens between white space."""
    return f"[tok for tok in regexp_split_to_array({x}, '[{WS}]+') if tok <> '']"


def sql_coerced(x: str) -> str:
    """SQL: a model's answer as target label."""
    bare = sql_strip(x)
    whens = [f"when {bare} = '{v}' then '{v}'" for v in LABELS]
    whens += [f"when lower({bare}) = '{v.lower()}' then '{v}'" for v in LABELS]
    whens += [f"when contains(lower({bare}), '{v.lower()}') then '{v}'" for v in LABELS]
    return f"(case {' '.join(whens)} end)"


LABEL_DIM = "labels(position, label) as (values " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(LABELS)) + ")"
RECORDS = f"""rec as (
  select record_id, split_name, coalesce(source_dataset, '') as source_dataset, coalesce(source_file, '') as source_file,
    {sql_strip("coalesce(source_id, '')")} as source_id, source_row_number, coalesce(text, '') as text,
    {sql_strip("coalesce(raw_label, '')")} as raw_label, {sql_normalized('raw_label')} as normalized_raw_label,
    {sql_macro(sql_normalized('raw_label'))} as macro_label, sha1({sql_strip("coalesce(text, '')")}) as text_hash
  from interim_dataset)"""
CURATED = f"""{RECORDS},
raw_train as (select distinct text_hash from rec where split_name = 'train_core'),
kept_train as (select distinct text_hash from rec where split_name = 'train_core' and macro_label is not null),
kept_dev as (select distinct text_hash from rec where split_name = 'dev_core' and macro_label is not null
  and text_hash not in (select text_hash from raw_train)),
conflicted as (select text_hash from rec where split_name = 'train_aug_candidates'
  group by text_hash having count(distinct normalized_raw_label) > 1),
cur as (select rec.*, case
  when split_name = 'dev_core' and text_hash in (select text_hash from raw_train) then 'benchmark_exact_overlap_with_train'
  when split_name = 'train_aug_candidates' and text_hash in (select text_hash from conflicted) then 'conflicting_supporting_label'
  when split_name = 'train_aug_candidates' and text_hash in (select text_hash from kept_train) then 'overlap_with_train_core'
  when split_name = 'train_aug_candidates' and text_hash in (select text_hash from kept_dev) then 'overlap_with_dev_core'
  when macro_label is null then 'out_of_scope_country' end as drop_reason
  from rec where split_name in ('train_core', 'dev_core', 'train_aug_candidates'))"""
LEAKAGE = """leak as (select record_id, split_name, coalesce(source_id, '') as source_id, raw_label, macro_label,
  coalesce(original_text, '') as original_text, coalesce(processed_text, '') as processed_text from ood_leakage_precheck),
ref as (select * from leak where split_name = 'train_core'),
cand as (select * from leak where split_name in ('ood_2020_dev', 'ood_2021_dev'))"""
PREDICTIONS = f"""pred as (select record_id, model_name, true_label, predicted_label, latency_ms, prediction_id from (
  select record_id, model_name, true_label, {sql_coerced('predicted_label')} as predicted_label, latency_ms, prediction_id,
    row_number() over (partition by record_id, model_name order by prediction_id desc) as r from model_predictions) where r = 1)"""
