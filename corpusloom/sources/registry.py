"""Known raw file layouts and the groups that files fall into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.operators.validate import GROUPS


@dataclass(frozen=True)
class Layout:
    """A known layout: columns a header must have, and which hold text and classes."""

    name: str
    required: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()

    def columns(self, header: list[str]) -> tuple[list[str], list[str]]:
        """Text and class columns that ``header`` has."""
        return [c for c in self.texts if c in header], [c for c in self.classes if c in header]


UNKNOWN = Layout("unknown")
# Layouts of the public shared-task files, in order of precedence.
LAYOUTS = [
    Layout("madar_2018", ("sentID.BTEC", "split", "lang", "sent", "city", "country"), ("sent",), ("country", "city")),
    Layout("nadi2020_labeled", ("#1 tweet_ID", "#2 tweet_content", "#3 country_label", "#4 province_label"), ("#2 tweet_content",), ("#3 country_label", "#4 province_label")),
    Layout("nadi2021_labeled", ("#1_tweetid", "#2_tweet", "#3_country_label", "#4_province_label"), ("#2_tweet",), ("#3_country_label", "#4_province_label")),
    Layout("nadi2023_st1_labeled", ("#1_id", "#2_content", "#3_label"), ("#2_content",), ("#3_label",)),
    Layout("nadi2023_st1_labeled_checkpoint", ("id", "content", "label"), ("content",), ("label",)),
    Layout("nadi2020_unlabeled_ids", ("#1 tweet_ID",)),
    Layout("nadi2020_test_unlabeled", ("#1 tweet_ID", "#2 tweet_content"), ("#2 tweet_content",)),
    Layout("nadi2023_st1_test_unlabeled", ("#1_id", "#2_content"), ("#2_content",)),
    Layout("nadi2023_mt_labeled", ("id", "dialect_id", "source_dialect", "target_msa"), ("source_dialect", "target_msa"), ("dialect_id",)),
    Layout("nadi2023_mt_test_unlabeled", ("#1_id", "#2_dialect_id", "#3_source_dialect"), ("#3_source_dialect",), ("#2_dialect_id",)),
]
# Path endings of the files of each group.
ENDINGS = {
    GROUPS[0]: [
        "nadi2023/NADI2023_Release_Train/Subtask1/NADI2023_Subtask1_TRAIN.tsv",
        "nadi2023/NADI2023_Release_Train/Subtask1/NADI2023_Subtask1_DEV.tsv",
    ],
    GROUPS[1]: [
        "nadi2023/NADI2023_Release_Train/Subtask1/NADI2020-TWT.tsv",
        "nadi2023/NADI2023_Release_Train/Subtask1/NADI2021-TWT.tsv",
    ],
    GROUPS[2]: [
        "nadi2020/NADI_release/train_labeled.tsv",
        "nadi2020/NADI_release/dev_labeled.tsv",
        "nadi2021/NADI2021_DEV.1.0/Subtask_1.2+2.2_DA/DA_train_labeled.tsv",
        "nadi2021/NADI2021_DEV.1.0/Subtask_1.2+2.2_DA/DA_dev_labeled.tsv",
    ],
}
#: Files from this size on, without text and class columns, aren't searched for repeats by default.
LARGE_FILE_BYTES = 50 * 1024 * 1024


def match(header: list[str]) -> Layout:
    """The layout with the most required columns that are all in ``header``; the first on a tie."""
    fitting = [x for x in LAYOUTS if set(x.required) <= set(header)]
    return max(fitting, key=lambda x: len(x.required), default=UNKNOWN)


def file_group(path: str, layout: str) -> str:
    """Group of a file by its path, then by its layout."""
    by_path = next((g for g, ends in ENDINGS.items() if path.endswith(tuple(ends))), None)
    return by_path or (GROUPS[3] if layout == "nadi2020_unlabeled_ids" else GROUPS[4])


def group_by_ending(path: Column, endings: dict[str, list[str]], other: str) -> Column:
    """Group of a path column by its endings, first group first."""
    out = F.lit(other)
    for group, ends in reversed(endings.items()):
        test = F.lit(False)
        for e in ends:
            test = test | path.endswith(e)
        out = F.when(test, group).otherwise(out)
    return out


def require(header: list[str], columns: list[str]) -> None:
    """An error that lists the columns which ``header`` lacks."""
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
