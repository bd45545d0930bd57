"""Row-wise operators over streams: cleaning, repeats and running profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import clean, fingerprint, row_fingerprint, strip_ws, token_count


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    """original_text and processed_text in place of ``text``; stateless."""
    return rows.withColumn("original_text", F.col(text)).withColumn("processed_text", clean(F.col(text))).drop(text)


def first_seen(rows: DataFrame, columns: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose values weren't seen before; with an event time the state is bounded by ``delay``."""
    marked = rows.withColumn("fp", row_fingerprint(*[F.col(c) for c in columns]))
    if event_time is None:
        return marked.dropDuplicates(["fp"]).drop("fp")
    return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fp"]).drop("fp")


def windowed_profile(rows: DataFrame, event_time: str, text: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Rows, empty and short texts per window; late rows count until ``delay`` has passed."""
    bare = strip_ws(F.coalesce(text, F.lit("")))
    return (
        rows.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width))
        .agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum((bare == "").cast("long")).alias("n_empty"), F.sum((token_count(bare) < 3).cast("long")).alias("n_short"),
            F.approx_count_distinct(fingerprint(bare)).alias("n_texts"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows", "n_empty", "n_short", "n_texts")
    )


def to_memory(rows: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """The stream as an in-memory table, all available input processed (small tests)."""
    query = rows.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    return query


def to_files(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """The stream as files, each row once."""
    return rows.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
