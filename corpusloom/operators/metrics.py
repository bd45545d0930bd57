"""Classification metrics as aggregates over (true_label, predicted_label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.labels import LABELS, TRACKED, is_tracked, label_dimension, tracked_dimension
from corpusloom.functions.text import ratio


def latest(predictions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last prediction of every key; later rows replace earlier ones."""
    others = [c for c in predictions.columns if c not in keys]
    best = predictions.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("x"))
    return best.select(*keys, "x.*")


def confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows of every (true, predicted) pair."""
    return predictions.groupBy(*keys, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per true label, one column per predicted label, in label order."""
    counts = predictions.groupBy(*keys, "true_label").pivot("predicted_label", LABELS).count()
    every = predictions.select(*keys).distinct().withColumn("true_label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    return every.join(counts, [*keys, "true_label"], "left").fillna(0, LABELS)


def accuracy(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows predicted right; a null prediction is wrong."""
    right = F.coalesce(F.col("true_label") == F.col("predicted_label"), F.lit(False))
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(right.cast("double")).alias("accuracy"))


def per_class(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every target label; 0 for 0 / 0."""
    counts = confusion(predictions, keys)
    one = lambda c, right: counts.select(*keys, F.col(c).alias("label"), F.lit(right).alias("kind"), (F.col("true_label") == F.col("predicted_label")).alias("hit"), "n")
    long = one("true_label", 0).union(one("predicted_label", 1)).where(F.col("label").isin(LABELS))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    sums = long.groupBy(*keys, "label").agg(
        total((F.col("kind") == 0) & F.coalesce("hit", F.lit(False))).alias("tp"), total(F.col("kind") == 0).alias("support"), total(F.col("kind") == 1).alias("n_predicted")
    )
    every = predictions.select(*keys).distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in LABELS])))
    full = every.join(sums, [*keys, "label"], "left").fillna(0, ["tp", "support", "n_predicted"])
    precision, recall = ratio(F.col("tp"), F.col("n_predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(F.col("tp") * 2, F.col("n_predicted") + F.col("support"))
    return full.select(*keys, "label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def averages(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Macro, weighted and present-label averages of per-class metrics."""
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return classes.groupBy(*keys).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"), weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
        F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("present_macro_f1"), F.sum("support").alias("support"),
    )


def report(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Classification report rows: each label, accuracy, macro and weighted average."""
    classes = per_class(predictions, keys)
    mean = averages(classes, keys)
    hits = accuracy(predictions, keys)
    row = lambda name, p, r, f: mean.select(*keys, F.lit(name).alias("row"), F.col(p).alias("precision"), F.col(r).alias("recall"), F.col(f).alias("f1"), "support")
    return (
        classes.select(*keys, F.col("label").alias("row"), "precision", "recall", "f1", "support")
        .union(hits.select(*keys, F.lit("accuracy"), "accuracy", "accuracy", "accuracy", "n_rows"))
        .union(row("macro avg", "macro_precision", "macro_recall", "macro_f1"))
        .union(row("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))
    )


def errors(predictions: DataFrame) -> DataFrame:
    """Rows whose prediction differs from the true label."""
    return predictions.where(F.col("true_label") != F.col("predicted_label"))


def tracked(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the tracked confusions of every key, 0 where there is none."""
    counts = confusion(predictions.where(is_tracked(F.col("true_label"), F.col("predicted_label"))), keys)
    pairs = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label")) for t, p in TRACKED])
    every = predictions.select(*keys).distinct().withColumn("x", F.explode(pairs)).select(*keys, "x.*")
    return every.join(counts, [*keys, "true_label", "predicted_label"], "left").fillna(0, ["n"])


def tracked_by_model(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Tracked confusions by model, one column per model."""
    dim = F.broadcast(tracked_dimension(predictions.sparkSession))
    counts = predictions.groupBy("true_label", "predicted_label").pivot("model_name", models).count()
    return dim.join(counts, ["true_label", "predicted_label"], "left").fillna(0, models).drop("position")


def top_confusions(predictions: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """The most frequent confusions of every key, ties by (true, predicted)."""
    counts = confusion(errors(predictions), keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "true_label", "predicted_label"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def error_shares(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each confusion among the errors of its true label."""
    counts = confusion(errors(predictions), keys)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys, "true_label")))


def usage(requests: DataFrame, keys: list[str], tokens_in: str, tokens_out: str, latency: str, price_in: float | None, price_out: float | None) -> DataFrame:
    """Totals and averages of requests, tokens, latency and cost; 0 without requests."""
    from corpusloom.functions.text import cost

    price = lambda p: F.lit(p).cast("double")
    sums = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"), F.coalesce(F.sum(tokens_in), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(latency), F.lit(0.0)).alias("total_latency_ms"),
    )
    return sums.withColumn("latency_per_request_ms", ratio(F.col("total_latency_ms"), F.col("n_requests"))).withColumn(
        "cost", cost(F.col("prompt_tokens"), F.col("completion_tokens"), price(price_in), price(price_out))
    )


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) of every label that occurs."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Mean of ``value`` weighted by ``weight``."""
    return rows.groupBy(*keys).agg(ratio(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def seed_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation of a metric across seeds; null deviation for one seed."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.array_sort(F.collect_list(F.struct("seed", value))).alias("values")
    )


def early_stop(history: Column, patience: int, least: float) -> Column:
    """Fold over epoch structs (epoch, value): best epoch, best value, last epoch run."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("best_epoch"), F.lit(0).alias("bad"), F.lit(0).alias("last_epoch"), F.lit(False).alias("stopped")
    )

    def step(state: Column, epoch: Column) -> Column:
        better = state.best.isNull() | (epoch.value > state.best + least)
        bad = F.when(better, 0).otherwise(state.bad + 1)
        moved = F.struct(
            F.when(better, epoch.value).otherwise(state.best).alias("best"), F.when(better, epoch.epoch).otherwise(state.best_epoch).cast("int").alias("best_epoch"),
            bad.cast("int").alias("bad"), epoch.epoch.cast("int").alias("last_epoch"), (bad >= patience).alias("stopped"),
        )
        return F.when(state.stopped, state).otherwise(moved)

    return F.aggregate(history, start, step)


def deltas(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """left - right of every value for equal keys, absolute and relative in percent."""
    r = right.select(*keys, *[F.col(v).alias(f"{v}_reference") for v in values])
    out = [x for v in values for x in (
        F.col(v), F.col(f"{v}_reference"), (F.col(v) - F.col(f"{v}_reference")).alias(f"{v}_delta"),
        ratio((F.col(f"{v}_reference") - F.col(v)) * 100, F.col(f"{v}_reference")).alias(f"{v}_drop_percent"),
    )]
    return left.join(r, keys).select(*keys, *out)


def robustness(scored: DataFrame, excluded: DataFrame) -> DataFrame:
    """Accuracy and macro F1 that every model loses under every perturbation family.

    ``scored`` holds the predictions of the same records clean (family 'clean')
    and once per family, ``excluded`` a flag per family.  The larger drop has no
    model on a tie; trend says what becomes of a model's lead over the mean of
    the others; n_wins counts the families kept in which the macro F1 of a model
    alone drops least.  With one model there is nothing to compare: null, and 0 wins.
    """
    keys, values = ["family", "model_name"], ["accuracy", "macro_f1"]
    measured = accuracy(scored, keys).join(averages(per_class(scored, keys), keys), keys).select(*keys, "n_rows", *values)
    clean = measured.where("family = 'clean'").select("model_name", *[F.col(v).alias(f"clean_{v}") for v in values])
    rows = measured.where("family <> 'clean'").join(clean, "model_name").join(excluded, "family")
    for v in values:
        rows = rows.withColumn(f"{v}_drop", F.col(f"clean_{v}") - F.col(v)).withColumn(f"{v}_drop_percent", ratio(F.col(f"{v}_drop") * 100, F.col(f"clean_{v}")))
    every = W.partitionBy("family")
    n = F.count(F.lit(1)).over(every)
    for c, best, flag in (("macro_f1_drop", F.max, "_most"), ("macro_f1_drop_percent", F.max, "_most_percent"), ("macro_f1_drop", F.min, "_least")):
        rows = rows.withColumn(flag, F.col(c) == best(c).over(every))
    only = lambda flag: (n > 1) & (F.sum(F.col(flag).cast("int")).over(every) == 1)
    named = lambda flag: F.when(only(flag), F.max(F.when(F.col(flag), F.col("model_name"))).over(every))
    gap = F.col("macro_f1_drop") * n - F.sum("macro_f1_drop").over(every)
    trend = F.when(n > 1, F.when(gap > 1e-12, "shrinks").when(gap < -1e-12, "grows").otherwise("stays"))
    rows = rows.withColumn("larger_drop", named("_most")).withColumn("larger_drop_percent", named("_most_percent")).withColumn("trend", trend)
    rows = rows.withColumn("won", F.col("_least") & only("_least") & ~F.col("excluded"))
    rows = rows.withColumn("n_wins", F.sum(F.col("won").cast("long")).over(W.partitionBy("model_name")))
    return rows.drop("_most", "_most_percent", "_least", "won")


def label_positions(predictions: DataFrame) -> DataFrame:
    """Predictions with the positions of both labels (null for other labels)."""
    dim = label_dimension(predictions.sparkSession)
    named = lambda n: F.broadcast(dim.select(F.col("label").alias(f"{n}_label"), F.col("position").alias(f"{n}_index")))
    return predictions.join(named("true"), "true_label", "left").join(named("predicted"), "predicted_label", "left")
