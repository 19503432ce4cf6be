"""Preparing, weighting and judging labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved
from .ranks import numbered


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): 1 / sqrt(n), scaled so that the weights of all labels have mean 1."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    mean = n.agg(F.avg(1 / F.sqrt("n")).alias("m"))
    return n.join(F.broadcast(mean)).select("label", "n", F.round(1 / F.sqrt("n") / F.col("m"), 6).alias("weight"))


def stratified_split(rows: DataFrame, ratio: float = 0.15) -> DataFrame:
    """Rows with ``part``: of each label the share ``ratio`` with the smallest md5 of id is validation."""
    hashed = F.md5(F.col("id").cast("string"))
    placed = numbered(rows, "label", F.substring(hashed, 1, 3), hashed, "id")
    return placed.withColumn("part", F.when(F.col("place") <= F.floor(F.col("size") * ratio), "validation").otherwise("train")).drop("place", "size")


def oversample(rows: DataFrame, factors: dict[str, int], least: int = 0) -> DataFrame:
    """Each row as often as its label's factor says, with copy numbers from 0; labels with fewer than ``least`` rows then are topped up to it.

    The missing rows of a label are dealt over its rows in the order of id, as further copies.
    """
    times = F.lit(1)
    for label, factor in factors.items():
        times = F.when(F.col("label") == label, factor).otherwise(times)
    if least:
        # Only labels below ``least`` are numbered, so a group is small.
        small = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") * times < least)
        place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
        few = rows.join(F.broadcast(small), "label").withColumn("place", place)
        lacking = F.lit(least) - F.col("n") * times
        extra = F.floor(lacking / F.col("n")) + (F.col("place") <= lacking % F.col("n")).cast("int")
        topped = few.withColumn("copy", F.explode(F.sequence(F.lit(0), (times + extra - 1).cast("int")))).drop("n", "place")
        rest = rows.join(F.broadcast(small), "label", "left_anti").withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
        return rest.unionByName(topped)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))


def changed(text: Column, id_: Column, copy: Column) -> Column:
    """The text of a row, lightly changed in its copies: by a digest of id and copy in lower case, without its last mark, or with its last character x."""
    kind = F.conv(F.substring(F.md5(F.concat_ws(":", id_.cast("string"), copy.cast("string"))), 1, 2), 16, 10).cast("int") % 3
    return F.when(copy == 0, text).when(kind == 0, F.lower(text)).when(kind == 1, F.regexp_replace(text, r"[.!?]\z", "")).otherwise(F.regexp_replace(text, r"(?s).\z", "x"))


def augmented_split(rows: DataFrame, factors: dict[str, int], least: int = 0, ratio: float = 0.15) -> DataFrame:
    """(id, label, text, copy, part) of rows(id, label, text): the originals are split first, then only those to train on are oversampled and topped up, their copies with changed texts; so no
    held-out row has a copy among them."""
    split = saved(stratified_split(rows, ratio))
    train = oversample(split.where("part = 'train'").drop("part"), factors, least)
    train = train.withColumn("text", changed(F.col("text"), F.col("id"), F.col("copy"))).withColumn("part", F.lit("train"))
    return train.select("id", "label", "text", "copy", "part").unionByName(split.where("part <> 'train'").select("id", "label", "text", F.lit(0).alias("copy"), "part"))


def label_index(rows: DataFrame) -> DataFrame:
    """(label, idx) in alphabetical order: one row a label."""
    return rows.select("label").distinct().withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def _tallies(judged: DataFrame) -> DataFrame:
    long = judged.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("h")))).alias("x")).select("x.*")
    return long.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("said"), F.sum("h").alias("hits"))


def _f1() -> Column:
    return F.coalesce(F.try_divide(2 * F.col("hits"), F.col("said") + F.col("support")), F.lit(0.0))


def classification_report(judged: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of judged(truth, pred); 0 where undefined."""
    precision, recall = (F.coalesce(F.try_divide(F.col("hits"), F.col(c)), F.lit(0.0)) for c in ("said", "support"))
    return _tallies(judged).select("label", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(_f1(), 4).alias("f1"), "support")


def weighted_f1(judged: DataFrame) -> DataFrame:
    """(weighted_f1, support): the mean f1 of the labels, each as often as it is true."""
    s = _tallies(judged)
    return s.agg(F.round(F.sum(_f1() * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"), F.sum("support").alias("support"))


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(id, label, p) of scores(id, label, logit)."""
    top = F.max("logit").over(Window.partitionBy("id"))
    weight = scores.withColumn("w", F.exp((F.col("logit") - top) / temperature))
    return weight.select("id", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("id"))).alias("p"))


def thresholded(scores: DataFrame, least: float, fallback: str, temperature: float = 1.0) -> DataFrame:
    """(id, label, p): the likeliest label, the first by name at a tie, or the fallback where it is less likely than ``least``."""
    best = softmax(scores, temperature).groupBy("id").agg(F.min_by(F.struct("label", "p"), F.struct(-F.round("p", 12), "label")).alias("b"))
    return best.select("id", F.when(F.col("b.p") >= least, F.col("b.label")).otherwise(fallback).alias("label"), F.round("b.p", 6).alias("p"))


def temperature_fit(scores: DataFrame, truth: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll): the temperature of a fixed grid with the least mean negative log likelihood."""
    grids = F.explode(F.array(*map(F.lit, grid)))
    right = scores.join(truth, "id").groupBy("id").agg(F.max(F.when(F.col("label") == F.col("truth"), F.col("logit"))).alias("own"), F.collect_list("logit").alias("all"))  # one entry a label
    nll = F.log(F.aggregate(F.transform("all", lambda x: F.exp((x - F.col("own")) / F.col("t"))), F.lit(0.0), lambda a, b: a + b))
    fits = right.withColumn("t", grids).groupBy("t").agg(F.round(F.avg(nll), 6).alias("nll"))
    return fits.orderBy("nll", "t").limit(1).select(F.col("t").alias("temperature"), "nll")
