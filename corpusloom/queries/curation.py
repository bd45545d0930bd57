"""Queries on validation and curation (2.A, 2.D, 2.E, 2.F, 2.G, 2.H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import normalized
from corpusloom.functions.text import strip_ws, token_count
from corpusloom.operators import curate, validate
from corpusloom.queries.common import CURATED, RECORDS, sql_normalized, sql_strip, sql_tokens, table

COLUMNS = ["source_id", "text", "raw_label"]
SUPPORTING = ["dlx20/pool", "dlx21/pool"]


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "interim_dataset").withColumn("source_file", F.coalesce("source_file", F.lit("")))


def file_group(path: Column) -> Column:
    """Group of a file of the test tables by its folder."""
    kind = F.substring_index(path, "/", 2)
    return (
        F.when(kind.startswith("dlx23/anchor"), validate.GROUPS[0])
        .when(kind.isin(SUPPORTING), validate.GROUPS[1])
        .when(kind == "dlx22/forum", validate.GROUPS[2])
        .otherwise(validate.GROUPS[4])
    )


SQL_GROUP = f"""(case when source_file like 'dlx23/anchor%' then '{validate.GROUPS[0]}'
  when split_part(source_file, '/', 1) || '/' || split_part(source_file, '/', 2) in ('dlx20/pool', 'dlx21/pool') then '{validate.GROUPS[1]}'
  when split_part(source_file, '/', 1) || '/' || split_part(source_file, '/', 2) = 'dlx22/forum' then '{validate.GROUPS[2]}'
  else '{validate.GROUPS[4]}' end)"""


def scan_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, repeats, empty and short texts of every file."""
    return validate.profile(_raw(spark, folder), "source_file", COLUMNS, ["text"])


def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every label of every file."""
    return validate.class_counts(_raw(spark, folder), "source_file", ["raw_label", "macro_label"])


def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Files and rows of every group, groups without files included."""
    profile = scan_profile(spark, folder)
    return validate.with_all_groups(validate.group_summary(profile, file_group(F.col("source_file"))), validate.GROUPS)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals over all files."""
    has = lambda c: F.sum((F.col(c) > 0).cast("long"))
    return scan_profile(spark, folder).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), has("n_duplicates").alias("n_files_with_duplicates"),
        has("n_empty").alias("n_files_with_empty"), has("n_short").alias("n_files_with_short"),
    )


def repeated(spark: SparkSession, folder: str) -> DataFrame:
    """The first five rows of each file that repeat an earlier one."""
    rows = validate.repeated_rows(_raw(spark, folder), "source_file", COLUMNS, ["source_row_number", "record_id"])
    return rows.select("source_file", "rank", "record_id")


def first_short(spark: SparkSession, folder: str) -> DataFrame:
    """The first five short texts of each file."""
    short = _raw(spark, folder).where(token_count(strip_ws(F.coalesce("text", F.lit("")))) < validate.SHORT)
    return validate.first_rows(short, ["source_file"], ["source_row_number", "record_id"], 5).select("source_file", "rank", "record_id")


def _found(spark: SparkSession, folder: str, supporting: bool = False) -> DataFrame:
    rows = _raw(spark, folder)
    if supporting:
        rows = rows.where(F.substring_index("source_file", "/", 2).isin(SUPPORTING))
    return validate.occurrences(rows, "source_file", normalized(F.col("raw_label")))


def texts_in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that more than one file holds, with the number of files."""
    return validate.texts_in_several_files(_found(spark, folder))


def file_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All file pairs with texts in common, most texts first."""
    return validate.file_pairs(_found(spark, folder)).orderBy(F.desc("n_shared"), "file_a", "file_b")


def cross_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Supporting texts in several files with several labels."""
    return validate.cross_file_conflicts(_found(spark, folder, True)).withColumn("labels", F.array_join("labels", ", "))


def shared_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that the benchmark's training and dev files share."""
    rows = _raw(spark, folder)
    side = lambda s: validate.occurrences(rows.where(F.col("split_name") == s), "source_file", F.lit("")).select("text_hash")
    return side("train_core").intersect(side("dev_core"))


def safety(spark: SparkSession, folder: str) -> DataFrame:
    """One row: unique texts, texts in several files, train/dev overlap, conflicts."""
    found = _found(spark, folder)
    part = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    return (
        part("unique_texts", found.select("text_hash").distinct())
        .union(part("texts_in_several_files", validate.texts_in_several_files(found)))
        .union(part("train_dev_overlap", shared_anchor(spark, folder)))
        .union(part("supporting_texts_in_several_files", validate.texts_in_several_files(_found(spark, folder, True))))
        .union(part("supporting_conflicts", validate.cross_file_conflicts(_found(spark, folder, True))))
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return curate.records(table(spark, folder, "interim_dataset"), ["record_id"])


def curated(spark: SparkSession, folder: str) -> DataFrame:
    """Fate of every row: its drop reason, null if it is kept."""
    return curate.curate(_records(spark, folder)).select("record_id", "split_name", "drop_reason")


def _kept(split: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        kept = curate.curate(_records(spark, folder)).where((F.col("split_name") == split) & F.col("drop_reason").isNull())
        return kept.select("record_id", *curate.INTERIM)
    return query


def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and dropped rows by output and over all outputs."""
    return curate.statistics(curate.curate(_records(spark, folder)))


def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and texts removed for each reason."""
    return curate.overlap_counts(curate.curate(_records(spark, folder)))


def conflict_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Supporting texts with several labels."""
    return curate.conflicts(_records(spark, folder)).withColumn("labels", F.array_join("labels", ", "))


def conflict_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty conflicts by their first row, then by hash."""
    return curate.conflict_examples(_records(spark, folder), ["source_file", "source_row_number", "record_id"]).withColumn("labels", F.array_join("labels", ", "))


def overlap_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty dropped rows of each split and reason."""
    dropped = curate.curate(_records(spark, folder)).where("drop_reason is not null")
    rows = validate.first_rows(dropped, ["split_name", "drop_reason"], ["source_file", "source_row_number", "record_id"], 20)
    return rows.select("split_name", "drop_reason", "rank", "record_id")


def key_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the text key sets that curation uses."""
    facts = curate.text_facts(_records(spark, folder))
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    return facts.agg(total("in_raw_train"), total("in_train"), total("in_dev"), total("conflict"))


def pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the supporting pool by source, one source after the other."""
    rows = _raw(spark, folder)
    parts = [rows.where(F.col("source_dataset") == s).select("record_id", "source_dataset") for s in ("DLX20_POOL", "DLX21_POOL")]
    return parts[0].unionByName(parts[1]).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))


QUERIES = {
    "E1_E2_E3_scan_profile": scan_profile, "E4_G1_class_counts": class_counts, "E5_A6_group_summary": group_summary, "E6_totals": totals,
    "F2_repeated_rows": repeated, "F1_first_short_rows": first_short, "E11_texts_in_files": texts_in_files, "D11_G3_H6_file_pairs": file_pairs,
    "E10_G4_cross_file_conflicts": cross_conflicts, "H3_shared_anchor_texts": shared_anchor, "E32_safety": safety,
    "B4_D1_D2_D3_curate": curated, "B3_B5_curate_train": _kept(curate.TRAIN), "D1_curate_dev": _kept(curate.DEV), "D2_D3_curate_aug": _kept(curate.AUG),
    "E7_E8_curation_stats": statistics, "E7_overlap_counts": overlaps, "E9_conflict_groups": conflict_groups, "G5_G9_conflict_examples": conflict_examples,
    "F1_overlap_examples": overlap_examples, "H2_key_sets": key_sets, "H1_pool": pooled,
}
_STRIPPED = sql_strip("coalesce(text, '')")
_PROFILE = f"""prof as (select coalesce(source_file, '') as source_file, count(*) as n_rows,
    count(*) - count(distinct sha1(coalesce(source_id, '') || chr(9) || coalesce(text, '') || chr(9) || coalesce(raw_label, ''))) as n_duplicates,
    cast(sum(case when {_STRIPPED} = '' then 1 else 0 end) as bigint) as n_empty,
    cast(sum(case when len({sql_tokens(_STRIPPED)}) < 3 then 1 else 0 end) as bigint) as n_short
  from interim_dataset group by 1)"""
_HAS = ", ".join(f"cast(sum(case when n_{c} > 0 then 1 else 0 end) as bigint) as n_files_with_{c}" for c in ("duplicates", "empty", "short"))
_VALUE = lambda c: f"(case when {sql_strip(f'''coalesce({c}, '')''')} = '' then '<EMPTY>' else {sql_strip(c)} end)"
_OCC = f"""occ as (select coalesce(source_file, '') as file, split_name, sha1({_STRIPPED}) as text_hash, {sql_normalized('raw_label')} as label
  from interim_dataset where {_STRIPPED} <> '')"""
_SUPPORT = "split_part(file, '/', 1) || '/' || split_part(file, '/', 2) in ('dlx20/pool', 'dlx21/pool')"
_SHARED = "select text_hash from occ where split_name = 'train_core' intersect select text_hash from occ where split_name = 'dev_core'"
_CONFLICTS = f"""select text_hash, count(distinct file) as n_files, array_to_string(list_sort(list(distinct label)), ', ') as labels, count(*) as n_rows
  from occ where {_SUPPORT} group by 1 having count(distinct file) > 1 and count(distinct label) > 1"""
_INTERIM = "record_id, source_dataset, source_file, source_id, source_row_number, text, raw_label, normalized_raw_label, macro_label"
_FP = "sha1(coalesce(source_id, '') || chr(9) || coalesce(text, '') || chr(9) || coalesce(raw_label, ''))"
ORACLES = {
    "E1_E2_E3_scan_profile": f"with {_PROFILE} select * from prof",
    "E4_G1_class_counts": " union all ".join(
        f"select coalesce(source_file, '') as source_file, '{c}' as \"column\", {_VALUE(c)} as value, count(*) as n from interim_dataset group by all" for c in ("raw_label", "macro_label")
    ),
    "E5_A6_group_summary": f"""with {_PROFILE}, g(file_group) as (values {", ".join(f"('{x}')" for x in validate.GROUPS)}),
      s as (select {SQL_GROUP} as file_group, count(*) as n_files, cast(sum(n_rows) as bigint) as n_rows, {_HAS} from prof group by 1)
      select file_group, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("n_files", "n_rows", "n_files_with_duplicates", "n_files_with_empty", "n_files_with_short"))} from g left join s using (file_group)""",
    "E6_totals": f"with {_PROFILE} select count(*) as n_files, cast(sum(n_rows) as bigint) as n_rows, {_HAS} from prof",
    "F2_repeated_rows": f"""with a as (select coalesce(source_file, '') as source_file, record_id, source_row_number,
        row_number() over (partition by source_file, {_FP} order by source_row_number, record_id) as k from interim_dataset),
      b as (select source_file, record_id, row_number() over (partition by source_file order by source_row_number, record_id) as rank from a where k > 1)
      select source_file, rank, record_id from b where rank <= 5""",
    "F1_first_short_rows": f"""select source_file, rank, record_id from (select coalesce(source_file, '') as source_file, record_id,
        row_number() over (partition by source_file order by source_row_number, record_id) as rank from interim_dataset
        where len({sql_tokens(_STRIPPED)}) < 3) where rank <= 5""",
    "E11_texts_in_files": f"with {_OCC} select text_hash, count(distinct file) as n_files from occ group by 1 having count(distinct file) > 1",
    "D11_G3_H6_file_pairs": f"""with {_OCC}, d as (select distinct text_hash, file from occ)
      select a.file as file_a, b.file as file_b, count(*) as n_shared from d a join d b on a.text_hash = b.text_hash and a.file < b.file
      group by 1, 2""",
    "E10_G4_cross_file_conflicts": f"with {_OCC} {_CONFLICTS}",
    "H3_shared_anchor_texts": f"with {_OCC} {_SHARED}",
    "E32_safety": f"""with {_OCC} select 'unique_texts' as measure, count(distinct text_hash) as n from occ
      union all select 'texts_in_several_files', count(*) from (select text_hash from occ group by 1 having count(distinct file) > 1)
      union all select 'train_dev_overlap', count(*) from ({_SHARED})
      union all select 'supporting_texts_in_several_files', count(*) from (select text_hash from occ where {_SUPPORT} group by 1 having count(distinct file) > 1)
      union all select 'supporting_conflicts', count(*) from ({_CONFLICTS})""",
    "B4_D1_D2_D3_curate": f"with {CURATED} select record_id, split_name, drop_reason from cur",
    "B3_B5_curate_train": f"with {CURATED} select {_INTERIM} from cur where split_name = 'train_core' and drop_reason is null",
    "D1_curate_dev": f"with {CURATED} select {_INTERIM} from cur where split_name = 'dev_core' and drop_reason is null",
    "D2_D3_curate_aug": f"with {CURATED} select {_INTERIM} from cur where split_name = 'train_aug_candidates' and drop_reason is null",
    "E7_E8_curation_stats": f"""with {CURATED}, x as (
        select split_name, 'kept_by_source' as dimension, source_dataset as key from cur where drop_reason is null
        union all select split_name, 'kept_by_label', macro_label from cur where drop_reason is null
        union all select split_name, 'dropped_by_reason', drop_reason from cur where drop_reason is not null)
      select split_name as output, dimension, key, count(*) as n from x group by all
      union all select '(all)', dimension, key, count(*) from x group by all""",
    "E7_overlap_counts": f"with {CURATED} select split_name, drop_reason, count(*) as n_rows, count(distinct text_hash) as n_texts from cur where drop_reason is not null group by 1, 2",
    "E9_conflict_groups": f"""with {RECORDS} select text_hash, array_to_string(list_sort(list(distinct normalized_raw_label)), ', ') as labels, count(*) as n_rows
      from rec where split_name = 'train_aug_candidates' group by 1 having count(distinct normalized_raw_label) > 1""",
    "G5_G9_conflict_examples": f"""with {RECORDS}, g as (select text_hash, array_to_string(list_sort(list(distinct normalized_raw_label)), ', ') as labels,
        min({{'f': source_file, 'r': source_row_number, 'i': record_id}}) as first from rec where split_name = 'train_aug_candidates'
        group by 1 having count(distinct normalized_raw_label) > 1)
      select text_hash, labels from (select * from g order by first limit 20)""",
    "F1_overlap_examples": f"""with {CURATED} select split_name, drop_reason, rank, record_id from (select split_name, drop_reason, record_id,
        row_number() over (partition by split_name, drop_reason order by source_file, source_row_number, record_id) as rank from cur where drop_reason is not null) where rank <= 20""",
    "H2_key_sets": f"""with {CURATED} select (select count(*) from raw_train) as in_raw_train, (select count(*) from kept_train) as in_train,
        (select count(*) from kept_dev) as in_dev, (select count(*) from conflicted) as conflict""",
    "H1_pool": """select source_dataset, count(*) as n, min(record_id) as first_id from interim_dataset where source_dataset in ('DLX20_POOL', 'DLX21_POOL') group by 1""",
}
