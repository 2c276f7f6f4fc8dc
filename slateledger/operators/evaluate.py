"""Evaluation: matching predictions to truth, accuracies, rates, coverage, set overlap, epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slateledger.functions import scalars as S


def last_of_id(truth: DataFrame, keys: list[str]) -> DataFrame:
    """Of truth records with the same full identifier the last one."""
    t = truth.withColumn("_id", S.norm_id("GSTIN")).where("length(_id) = 15")
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_id").orderBy(F.desc("ord")))).where("_r = 1").drop("_r")


def matches(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, field, truth, predicted, match): every prediction whose identifier the truth has."""
    t = last_of_id(truth, keys).select(*keys, "_id", *[F.col(f).alias(f"t_{f}") for f in S.MATCHED])
    p = predicted.withColumn("_id", S.norm_id("GSTIN")).select(*keys, "ord", "_id", *[F.col(f).alias(f"p_{f}") for f in S.MATCHED])
    pair = p.join(t, [*keys, "_id"])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("truth"), F.col(f"p_{f}").alias("predicted"), S.field_match(f, F.col(f"t_{f}"), F.col(f"p_{f}")).alias("match")) for f in S.MATCHED])
    return pair.select(*keys, "ord", F.explode(cells).alias("c")).select(*keys, "ord", "c.field", "c.truth", "c.predicted", "c.match")


def field_accuracy(matched: DataFrame) -> DataFrame:
    return matched.groupBy("field").agg(F.sum(F.col("match").cast("int")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 4))


def detection(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gt_count, matched, rate): all predictions count that have a counterpart, so a rate may exceed 1."""
    found = predicted.withColumn("_id", S.norm_id("GSTIN")).join(last_of_id(truth, keys).select(*keys, "_id"), [*keys, "_id"], "left_semi").groupBy(*keys).agg(F.count("*").alias("matched"))
    out = truth.groupBy(*keys).agg(F.count("*").alias("gt_count")).join(found, keys, "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return out.withColumn("rate", F.round(F.col("matched") / F.greatest("gt_count", F.lit(1)), 4))


def latest_predictions(predicted: DataFrame) -> DataFrame:
    """One prediction set for each file: the png replaces the jpg."""
    top = predicted.groupBy("file_num").agg(F.max("fmt").alias("_fmt"))
    return predicted.join(top, "file_num").where("fmt = _fmt").drop("_fmt")


def available_format(files: DataFrame, predicted: DataFrame) -> DataFrame:
    """files (file_num) that have predictions, with the format that is taken first: jpg, else png."""
    had = predicted.groupBy("file_num").agg(F.bool_or(F.col("fmt") == "jpg").alias("_jpg"))
    return files.select("file_num").distinct().join(had, "file_num").select("file_num", F.when(F.col("_jpg"), "jpg").otherwise("png").alias("fmt"))


def accuracy_by_format(rates: DataFrame) -> DataFrame:
    """rates (fmt, matched, gt_count): by format and over all."""
    out = rates.rollup("fmt").agg(F.sum("matched").alias("correct"), F.sum("gt_count").alias("total"))
    return out.select(F.coalesce("fmt", F.lit("overall")).alias("fmt"), "correct", "total", F.round(F.col("correct") / F.greatest("total", F.lit(1)), 4).alias("rate"))


def overlap(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, kind): identifiers in both (tp), predicted only (fp), in the truth only (fn)."""
    ids = lambda df: df.select(*keys, S.norm_id("GSTIN").alias("id")).where("id <> ''").distinct()
    t, p = ids(truth), ids(predicted)
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    return kind(p.join(t, [*keys, "id"], "left_semi"), "tp").unionByName(kind(p.join(t, [*keys, "id"], "left_anti"), "fp")).unionByName(kind(t.join(p, [*keys, "id"], "left_anti"), "fn"))


def precision_recall(marked: DataFrame) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0))
    got = marked.agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"))
    got = got.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    return got.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-6)))


def coverage(records: DataFrame) -> DataFrame:
    """(field, filled, total, share) for the compared fields."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.trim(f) != "").cast("int").alias("filled")) for f in S.MATCHED]))
    got = records.select(cells.alias("c")).groupBy("c.field").agg(F.sum("c.filled").alias("filled"), F.count("*").alias("total"))
    return got.withColumn("share", F.round(F.col("filled") / F.greatest("total", F.lit(1)), 4))


def self_consistency(images: DataFrame, records: DataFrame) -> DataFrame:
    """images (doc_id, confidence 0..100), records by doc_id: rates that need no truth."""
    per = images.join(records.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.trim("GSTIN") != "").alias("ids"), F.count_if(S.valid_id_calibration("GSTIN")).alias("valid")), "doc_id", "left")
    got = per.agg(F.count("*").alias("images"), F.count("n").alias("with_records"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum("ids"), F.lit(0)).alias("ids"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("_c"))
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    return got.select("images", "with_records", "records", "ids", "valid", (F.col("with_records") / least("images")).alias("extraction_rate"), (F.col("valid") / least("ids")).alias("id_validity"), (F.col("records") / least("with_records")).alias("records_per_image"), (F.col("_c") / 100).alias("mean_confidence"))


def best_epoch(rates: DataFrame, stop: float = 0.95) -> DataFrame:
    """rates (epoch, rate): the best of the epochs up to the first above `stop`, the earliest on ties."""
    last = rates.where(F.col("rate") > stop).agg(F.min("epoch").alias("_last"))
    run = rates.crossJoin(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("epoch") <= F.col("_last")))  # one row
    return run.where("rate > 0").orderBy(F.desc("rate"), "epoch").limit(1).select("epoch", "rate")
