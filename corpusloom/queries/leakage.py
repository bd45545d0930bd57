"""Queries on overlap, duplicates, similarity and distributions of the pre-check (2.D, 2.E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import tiers
from corpusloom.functions.labels import macro, normalized
from corpusloom.functions.text import clean, percentage
from corpusloom.operators import leakage as K
from corpusloom.operators.selection import clean_split
from corpusloom.queries.text import STEPS, chained
from corpusloom.queries.common import CANDIDATES, LABEL_DIM, LEAKAGE, RECORDS, leakage_rows, sql_macro, sql_normalized, sql_tokens, table

FIELDS = ["source_id", "original_text", "processed_text"]
THRESHOLD = 0.9


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = leakage_rows(spark, folder)
    return rows.where(F.col("split_name") == "train_core"), rows.where(F.col("split_name").isin(CANDIDATES))


def overlap_values(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values of each field that candidates share with the reference."""
    ref, cand = _sides(spark, folder)
    out = None
    for f in FIELDS:
        n = K.shared_values(ref, cand, f).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("field"), "n")
        out = n if out is None else out.union(n)
    return out


def overlap_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate ids of each split whose field occurs in the reference."""
    ref, cand = _sides(spark, folder)
    out = None
    for s in CANDIDATES:
        for f in FIELDS:
            ids = K.shared_ids(ref, cand.where(F.col("split_name") == s), f)
            part = ids.select(F.lit(s).alias("split_name"), F.lit(f).alias("field"), "source_id")
            out = part if out is None else out.union(part)
    return out


def any_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate ids with any overlap."""
    return K.any_shared_ids(*_sides(spark, folder), FIELDS)


def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten pairs of equal processed text."""
    return K.representative_pairs(*_sides(spark, folder), "processed_text", ["record_id"], 10)


def missing_processed(spark: SparkSession, folder: str) -> DataFrame:
    """Training ids of the interim table that the processed one lacks."""
    interim = table(spark, folder, "interim_dataset").where("split_name = 'train_core' and source_id is not null")
    return K.missing_ids(interim, _sides(spark, folder)[0])


def reference_index(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the reference and the ids that hold each."""
    ref = _sides(spark, folder)[0]
    interim = table(spark, folder, "interim_dataset").where("split_name = 'train_core'")
    interim = interim.select(F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = K.reference_index(interim, ref)
    return index.select("field", F.sha1("value").alias("value_hash"), "source_id")


def index_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ids and values of the reference."""
    ref = _sides(spark, folder)[0]
    return ref.agg(*[F.countDistinct(f).alias(f"n_{f}") for f in FIELDS])


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows with a reference text above the threshold, and how many reference rows have one."""
    return K.similar_rows(*_sides(spark, folder), THRESHOLD).select("record_id", "split_name", "n_links")


def near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest similar reference row of each candidate row."""
    return K.first_partners(*_sides(spark, folder), THRESHOLD)


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated processed texts of every split."""
    rows = leakage_rows(spark, folder)
    groups = rows.groupBy("split_name", "processed_text").agg(F.count(F.lit(1)).alias("n_rows"), F.min("source_id").alias("first_id")).where("n_rows > 1")
    return groups.select("split_name", F.sha1("processed_text").alias("text_hash"), "n_rows", "first_id")


def duplicate_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of repeated texts and the rows beyond the first."""
    return K.duplicate_totals(K.duplicate_groups(leakage_rows(spark, folder), "processed_text"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    label = normalized(F.col("raw_label"))
    return leakage_rows(spark, folder).select("record_id", "split_name", label.alias("normalized_raw_label"), macro(label).alias("macro_label"))


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each target label of each split."""
    return K.label_distribution(_labelled(spark, folder), ["split_name"]).select("split_name", "label", "n")


def distribution_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Distribution of the first candidate against the training rows, percent unrounded."""
    rows = _labelled(spark, folder)
    part = lambda s: K.label_distribution(rows.where(F.col("split_name") == s))
    return K.distribution_delta(part(CANDIDATES[0]), part("train_core")).select("label", "n", "benchmark_n", "delta_n", "percent", "benchmark_percent", "delta_percent")


def label_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Raw labels of the candidates and whether they are mapped."""
    return K.label_inventory(_labelled(spark, folder).where(F.col("split_name").isin(CANDIDATES)))


def mapping_check(spark: SparkSession, folder: str) -> DataFrame:
    """Raw labels that the data's own label table lists, each with our mapping and whether they agree on Levantine."""
    listed = table(spark, folder, "label_map").select(normalized(F.col("raw_label")).alias("label"), F.coalesce("macro_label", F.lit("")).alias("listed")).distinct()
    ours = F.coalesce(macro(F.col("label")), F.lit(""))
    return listed.select("label", ours.alias("macro_label"), ((ours == "Levantine") == (F.col("listed") == "Levantine")).alias("confirmed"))


def acceptance(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every candidate split from its exact overlaps."""
    ref, cand = _sides(spark, folder)
    hit = None
    for f in FIELDS:
        part = cand.join(ref.select(f).distinct(), f, "left_semi").select("split_name", "source_id")
        hit = part if hit is None else hit.union(part)
    hits = hit.distinct().groupBy("split_name").agg(F.count(F.lit(1)).alias("n_overlapping"))
    out = cand.groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows")).join(hits, "split_name", "left").fillna(0, ["n_overlapping"])
    percent = percentage(F.col("n_overlapping"), F.col("n_rows"))
    n = F.col("n_overlapping")
    return out.select("split_name", "n_rows", "n_overlapping", tiers.overlap_tier(n, percent).alias("tier"), tiers.overlap_caveat(n, percent).alias("caveat"))


def audit_status(spark: SparkSession, folder: str) -> DataFrame:
    """The three hard checks of training against dev rows, and the verdict."""
    rows = table(spark, folder, "interim_dataset").select("split_name", "source_id", "text")
    rows = rows.select("split_name", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_id", "text")]).withColumn("processed_text", clean(F.col("text")))
    train, dev = (rows.where(F.col("split_name") == s) for s in ("train_core", "dev_core"))
    return K.audit({f: K.shared_values(train, dev, f) for f in ("source_id", "text", "processed_text")})


def clean_dev(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows whose processed text is in no reference row."""
    ref, cand = _sides(spark, folder)
    return clean_split(cand, ref).select("record_id")


def duplicate_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest groups of repeated texts, ties by first id and hash."""
    groups = K.duplicate_groups(leakage_rows(spark, folder), "processed_text").withColumn("text_hash", F.sha1("processed_text"))
    top = groups.orderBy(F.desc("n_rows"), "first_id", "text_hash").limit(10)
    rank = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("n_rows"), "first_id", "text_hash"))
    return top.select(rank.alias("rank"), "text_hash", "n_rows", "first_id")


QUERIES = {
    "D4_overlap_values": overlap_values, "D5_overlap_ids": overlap_ids, "D6_H5_any_overlap_ids": any_overlap, "D4_F1_overlap_pairs": overlap_pairs,
    "D7_H4_missing_processed": missing_processed, "D12_reference_index": reference_index, "E31_index_sizes": index_sizes, "D8_near_duplicates": near_duplicates,
    "F5_near_pairs": near_pairs, "E16_duplicate_groups": duplicate_groups, "E16_duplicate_totals": duplicate_totals, "G6_largest_groups": duplicate_ranks,
    "E12_I6_label_distribution": label_distribution, "E13_C32_distribution_delta": distribution_delta, "E14_label_inventory": label_inventory,
    "E15_mapping_check": mapping_check, "C27_acceptance": acceptance, "E33_audit_status": audit_status, "N8_clean_dev": clean_dev,
}
_ANY = " or ".join(f"{f} in (select {f} from ref)" for f in FIELDS)
_TOK = sql_tokens("processed_text")
_SIM = f"""{LEAKAGE}, a as (select record_id, list_sort(list_distinct({_TOK})) as s from ref), b as (select record_id, split_name, list_sort(list_distinct({_TOK})) as s from cand),
  ta as (select record_id, s, unnest(s) as tok from a), tb as (select record_id, s, unnest(s) as tok from b),
  m as (select tb.record_id as cid, ta.record_id as rid, count(*) as i, any_value(len(ta.s)) as x, any_value(len(tb.s)) as y from ta join tb using (tok) group by 1, 2),
  sim as (select cid, rid, cast(i as double) / (x + y - i) as similarity from m where cast(i as double) / (x + y - i) > {THRESHOLD})"""
_LAB = f"""lab as (select split_name, {sql_normalized('raw_label')} as normalized_raw_label, {sql_macro(sql_normalized('raw_label'))} as macro_label from ood_leakage_precheck)"""
ORACLES = {
    "D4_overlap_values": f"with {LEAKAGE} " + " union all ".join(f"select '{f}' as field, count(distinct {f}) as n from cand where {f} in (select {f} from ref)" for f in FIELDS),
    "D5_overlap_ids": f"with {LEAKAGE} " + " union all ".join(f"select distinct split_name, '{f}' as field, source_id from cand where {f} in (select {f} from ref)" for f in FIELDS),
    "D6_H5_any_overlap_ids": f"with {LEAKAGE} select distinct source_id from cand where {_ANY}",
    "D4_F1_overlap_pairs": f"""with {LEAKAGE} select reference_id, candidate_id from (select r.source_id as reference_id, c.source_id as candidate_id
      from cand c join ref r using (processed_text) order by c.record_id, r.record_id limit 10)""",
    "D7_H4_missing_processed": f"""with {LEAKAGE} select distinct source_id from interim_dataset where split_name = 'train_core' and source_id is not null
      and source_id not in (select source_id from ref)""",
    "D12_reference_index": f"""with {LEAKAGE}, i as (select coalesce(source_id, '') as source_id, coalesce(text, '') as text from interim_dataset where split_name = 'train_core'),
      v as (select 'source_id' as field, source_id as value, source_id from i union select 'original_text', text, source_id from i
        union select 'source_id', source_id, source_id from ref union select 'original_text', original_text, source_id from ref
        union select 'processed_text', processed_text, source_id from ref)
      select field, sha1(value) as value_hash, source_id from v""",
    "E31_index_sizes": f"with {LEAKAGE} select " + ", ".join(f"count(distinct {f}) as n_{f}" for f in FIELDS) + " from ref",
    "D8_near_duplicates": f"with {_SIM} select record_id, split_name, n_links from cand join (select cid, count(*) as n_links from sim group by 1) on cid = record_id",
    "F5_near_pairs": f"with {_SIM} select cid as candidate_id, min(rid) as reference_id, arg_min(similarity, rid) as similarity from sim group by 1",
    "E16_duplicate_groups": f"with {LEAKAGE} select split_name, sha1(processed_text) as text_hash, count(*) as n_rows, min(source_id) as first_id from leak group by split_name, processed_text having count(*) > 1",
    "E16_duplicate_totals": f"with {LEAKAGE} select count(*) as n_groups, cast(coalesce(sum(n - 1), 0) as bigint) as n_additional_rows from (select count(*) as n from leak group by processed_text having count(*) > 1)",
    "G6_largest_groups": f"""with {LEAKAGE}, g as (select sha1(processed_text) as text_hash, count(*) as n_rows, min(source_id) as first_id from leak group by processed_text having count(*) > 1)
      select cast(row_number() over (order by n_rows desc, first_id, text_hash) as int) as rank, * from (select * from g order by n_rows desc, first_id, text_hash limit 10)""",
    "E12_I6_label_distribution": f"""with {_LAB}, {LABEL_DIM} select s.split_name, l.label, count(lab.macro_label) as n
      from (select distinct split_name from lab) s cross join labels l left join lab on lab.split_name = s.split_name and lab.macro_label = l.label group by 1, 2""",
    "E13_C32_distribution_delta": f"""with {_LAB}, {LABEL_DIM},
      c as (select label, count(macro_label) as n from labels left join (select * from lab where split_name = '{CANDIDATES[0]}') on macro_label = label group by 1),
      b as (select label, count(macro_label) as benchmark_n from labels left join (select * from lab where split_name = 'train_core') on macro_label = label group by 1),
      p as (select label, n, benchmark_n, n - benchmark_n as delta_n, round(100.0 * cast(n as double) / (select sum(n) from c), 2) as percent,
        round(100.0 * cast(benchmark_n as double) / (select sum(benchmark_n) from b), 2) as benchmark_percent from c join b using (label))
      select *, round(percent - benchmark_percent, 2) as delta_percent from p""",
    "E14_label_inventory": f"with {_LAB} select normalized_raw_label, count(*) as n, bool_or(macro_label is not null) as is_mapped from lab where split_name in ('ood_2020_dev', 'ood_2021_dev') group by 1",
    "E15_mapping_check": "select distinct normalized_raw_label as label, coalesce(macro_label, '') as macro_label, true as confirmed from label_map",
    "C27_acceptance": f"""with {LEAKAGE}, s as (select split_name, count(*) as n_rows, count(distinct case when {_ANY} then source_id end) as n_overlapping from cand group by 1),
      p as (select *, round(100.0 * cast(n_overlapping as double) / n_rows, 2) as pct from s)
      select split_name, n_rows, n_overlapping, case when n_overlapping = 0 then '{tiers.OOD_OK}' when pct <= 5 then '{tiers.HISTORICAL}' else '{tiers.NOT_YET}' end as tier,
        n_overlapping > 0 and pct >= 1 as caveat from p""",
    "E33_audit_status": f"""with {RECORDS}, r as (select split_name, coalesce(source_id, '') as source_id, coalesce(text, '') as text, value as processed_text
        from interim_dataset join ({chained(STEPS)}) using (record_id)),
      c as ({" union all ".join(f"select '{f}' as check_name, count(distinct {f}) as n from r where split_name = 'dev_core' and {f} in (select {f} from r where split_name = 'train_core')" for f in ("source_id", "text", "processed_text"))})
      select check_name, n, case when (select max(n) from c) > 0 then 'block' else 'pass' end as status from c""",
    "N8_clean_dev": f"with {LEAKAGE} select record_id from cand where processed_text not in (select processed_text from ref)",
}
