"""The pN_ queries over the whole tables of the data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, metric_join, mixing, prose, quota_sample, same_record, segment_join, survivor, visual_form
from corpusloom.llm.oracles import ORACLES as ORACLES
from corpusloom.llm.tables import table, two_tables
from corpusloom.plans.lineage import cut

TARGETS = ["Saudi", "Egyptian", "Levantine", "Maghrebi"]


def _names(spark: SparkSession, folder: str) -> list[str]:
    return same_record.squeezed_names(table(spark, folder, "form_fields"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies that differ by formatting alone, within each of the two tables."""
    names = _names(spark, folder)
    found = [same_record.copies(same_record.keyed(df, names)) for _, df in two_tables(spark, folder, "processed_text")]
    return same_record.union(found)


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct record with its number of copies."""
    names = _names(spark, folder)
    out = []
    for name, df in two_tables(spark, folder, "processed_text"):
        out.append(same_record.groups(same_record.keyed(df, names)).select(F.lit(name).alias("table_name"), "first_id", "n_copies"))
    return same_record.union(out)


def _splits(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, Column, bool]]:
    """Table name, rows, side (true: training, false: evaluation) and whether source ids count."""
    (a, interim), (b, leakage) = two_tables(spark, folder, "processed_text")
    split = F.col("split_name")
    trained = F.when(split == "train_core", True)
    return [(a, interim, trained.when(split == "dev_core", False), False), (b, leakage, trained.when(split.isin("ood_2020_dev", "ood_2021_dev"), False), True)]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Training and evaluation records that are the same or almost."""
    found = []
    for _, df, side, by_source in _splits(spark, folder):
        pairs = segment_join.similar(df, side)
        found.append(pairs.union(segment_join.same_source(df, side)).distinct() if by_source else pairs)
    pairs = same_record.union(found)
    return pairs.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def p2_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps by table, evaluation split and source: pairs and evaluation records."""
    out = []
    for name, df, side, by_source in _splits(spark, folder):
        of = df.select(F.col("record_id").alias("e"), "split_name", "source_dataset")
        counted = segment_join.link_counts(df, side, by_source).join(of, "e").groupBy("split_name", "source_dataset")
        counts = counted.agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_records"))
        out.append(counts.select(F.lit(name).alias("table_name"), "split_name", "source_dataset", "n_pairs", "n_records"))
    return same_record.union(out)


def _survivor_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["loaded_at", "source_dataset", "raw_label", "macro_label"]
    rows = same_record.members(same_record.keyed(table(spark, folder, "interim_dataset"), _names(spark, folder), extra=columns))
    return survivor.prepared(rows, table(spark, folder, "source_registry"), table(spark, folder, "label_map"), TARGETS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The record that each field of a group's survivor is taken from."""
    return survivor.elected(_survivor_rows(spark, folder)).select("first_id", "field_name", "from_id")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One built record per group: the value of each field that the records' weighted vote is nearest to."""
    chosen = survivor.elected(_survivor_rows(spark, folder), weights="records")
    values = {f: F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in survivor.FIELDS}
    return chosen.groupBy("first_id").agg(*values.values())


def _leakage(spark: SparkSession, folder: str) -> DataFrame:
    return two_tables(spark, folder, "processed_text")[1][1]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that share most of their words."""
    return metric_join.similar(_leakage(spark, folder))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every record, and with how many records it is linked."""
    return metric_join.groups(_leakage(spark, folder))


def _posts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "interim_dataset"), table(spark, folder, "sample_targets")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories whose target share or least number can't be met."""
    return quota_sample.unmet(*_posts(spark, folder))


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn rows of every target."""
    return quota_sample.sample(*_posts(spark, folder))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and drawn rows and shares by target and category."""
    return quota_sample.report(*_posts(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different strings that show the same line."""
    return same_record.union([visual_form.alike(df) for _, df in two_tables(spark, folder, "original_text")])


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form."""
    out = []
    for name, df in two_tables(spark, folder, "original_text"):
        out.append(visual_form.formed(df.select("record_id", "text")).select(F.lit(name).alias("table_name"), "record_id", "form"))
    return same_record.union(out)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tokens = cut(bpe.counted(table(spark, folder, "documents")))
    return tokens, mixing.rates(tokens, table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that fall short of their weight in the mix and can't reach it."""
    tokens, rate = _mix(spark, folder)
    return mixing.unmet(mixing.copies(tokens, rate), rate)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document of a listed source."""
    return mixing.copies(*_mix(spark, folder)).select("doc_id", "copies")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted, solved and actual share of every source."""
    tokens, rate = _mix(spark, folder)
    return mixing.shares(mixing.copies(tokens, rate), rate)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return prose.not_prose(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document and how much each adds to its distance."""
    return prose.measured(table(spark, folder, "documents"), table(spark, folder, "common_words"))


QUERIES = {
    "p1_found": p1_found, "p1_records": p1_records,
    "p2_found": p2_found, "p2_overlaps": p2_overlaps,
    "p3_found": p3_found, "p3_survivors": p3_survivors,
    "p4_found": p4_found, "p4_groups": p4_groups,
    "p5_found": p5_found, "p5_sample": p5_sample, "p5_report": p5_report,
    "p6_found": p6_found, "p6_forms": p6_forms,
    "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_statistics": p9_statistics,
}

