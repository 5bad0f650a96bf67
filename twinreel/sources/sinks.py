"""Groups as text, JSON and indexed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_rows(groups: DataFrame) -> DataFrame:
    """``group_id, reference, duplicates``: one row a group, duplicates in order of
    their ``place``, or of their path without one."""
    place = F.col("place") if "place" in groups.columns else F.lit(0)
    ordered = F.array_sort(F.collect_list(F.when(~F.col("is_reference"), F.struct(place.alias("place"), "path"))))
    return groups.groupBy("group_id").agg(F.max(F.when(F.col("is_reference"), F.col("path"))).alias("reference"), F.transform(ordered, lambda x: x["path"]).alias("duplicates"))


def text_lines(groups: DataFrame) -> DataFrame:
    """``group_id, text``: the reference, the duplicates, an empty line."""
    rows = as_rows(groups)
    lines = F.concat(F.when(F.col("reference").isNull(), F.array().cast("array<string>")).otherwise(F.array("reference")), F.col("duplicates"), F.array(F.lit("")))
    return rows.select("group_id", F.array_join(lines, "\n").alias("text"))


def json_objects(groups: DataFrame) -> DataFrame:
    """``group_id, json``: an object of reference and duplicates a group."""
    return as_rows(groups).select("group_id", F.to_json(F.struct("reference", "duplicates"), {"ignoreNullFields": "false"}).alias("json"))


def write_text(groups: DataFrame, folder: str) -> None:
    text_lines(groups).orderBy("group_id").select("text").write.mode("overwrite").text(folder)


def write_json(groups: DataFrame, folder: str) -> None:
    as_rows(groups).orderBy("group_id").select("reference", "duplicates").write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_index(groups: DataFrame, folder: str) -> None:
    """Objects of ``idx`` and ``matchset`` for manual verdicts."""
    rows = as_rows(groups).select(F.col("group_id").alias("idx"), F.concat(F.when(F.col("reference").isNull(), F.array().cast("array<string>")).otherwise(F.array("reference")), "duplicates").alias("matchset"))
    rows.orderBy("idx").write.mode("overwrite").json(folder)


def read_verdicts(spark, index_file: str, verdicts: DataFrame) -> DataFrame:
    """``verdict, set_id, path`` of the sets that ``verdicts`` (verdict, number)
    name by their place in the index; its own numbers do not count.  A place out
    of range is an error."""
    index = spark.read.option("multiLine", True).json(index_file)
    if index.count() == 0:
        raise ValueError("the index is empty")
    whole = spark.read.option("wholetext", True).text(index_file)
    listed = whole.select(F.posexplode(F.from_json("value", "array<struct<idx:bigint,matchset:array<string>>>")).alias("pos", "entry"))
    found = verdicts.join(listed, F.col("number") == F.col("pos"), "left")
    path = F.explode(F.when(F.col("entry").isNull(), F.raise_error(F.concat(F.lit("no such place in the index: "), F.col("number").cast("string"))).cast("array<string>")).otherwise(F.col("entry.matchset")))
    return found.select("verdict", F.col("number").alias("set_id"), path.alias("path"))
