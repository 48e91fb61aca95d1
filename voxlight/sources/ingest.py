"""Reading what instruments and programs write, and writing results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.volume import last_number

REFLECTION_TEXT = "`intensity.sum.value` string, `miller_index` string, `s1` string, `xyzobs.mm.value` string"
INSTRUMENT = "axes array<array<double>>, angles array<double>, direction array<double>"


def tuple_to_array(text: Column, kind: str = "double") -> Column:
    """'(1, 2, 3)' to an array."""
    return F.from_json(F.translate(text, "()", "[]"), f"array<{kind}>")


def typed_reflections(rows: DataFrame, key: str = "refl_id") -> DataFrame:
    """Rows of text fields to typed ones."""
    hkl = tuple_to_array(F.col("miller_index"), "int")
    return rows.select(key, F.col("`intensity.sum.value`").cast("double").alias("intensity_sum"), F.struct(hkl[0].alias("h"), hkl[1].alias("k"), hkl[2].alias("l")).alias("miller_index"), tuple_to_array(F.col("s1")).alias("s1"), tuple_to_array(F.col("`xyzobs.mm.value`")).alias("xyzobs_mm"))


def read_reflections(spark: SparkSession, path: str, lines: bool = False, by_line: bool = False) -> DataFrame:
    """A JSON list of text fields, with the place in the list as refl_id; or JSON lines that hold refl_id, which many tasks read.

    The items of a list are parsed one after the other, so it may be longer than one
    string; it is one file and one task reads it. With by_line each item has a line of its own, as
    write_json_list leaves them, and many tasks read the list, be it one file or parts in the order of their names.
    """
    if lines:
        return typed_reflections(spark.read.schema(f"refl_id long, {REFLECTION_TEXT}").json(path))
    if by_line:
        item = F.from_json(F.regexp_replace(F.trim("value"), r"^[\[,]\s*|\s*[,\]]$", ""), REFLECTION_TEXT)
        return typed_reflections(placed_lines(spark, path).select("refl_id", item.alias("item")).select("refl_id", "item.*"))
    rows = spark.read.schema(REFLECTION_TEXT).json(path, multiLine=True)
    return typed_reflections(rows.select(F.monotonically_increasing_id().alias("refl_id"), "*"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(refl_id, value): lines that hold an item with their place, by file name, block of the file and line. Only counts of blocks go through one task."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Numbers rise along the lines of a block, one after the other.
    rows = text.where(F.col("value").contains("{")).withColumn("line", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.min("line").alias("first"), F.count("*").alias("n"))
    before = blocks.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), ["file", "block"]).select((F.col("line") - F.col("first") + F.col("before")).alias("refl_id"), "value")


def write_json_list(rows: DataFrame, path: str, order: str, parts: bool = False) -> None:
    """rows as one file with a JSON list, in the order of a column, which is left out, an item a line. Sorting spreads over tasks; one writes. With parts the list is cut into files, which joined in the order of their names are the list, and many tasks write."""
    ends = rows.agg(F.min(order).alias("first"), F.max(order).alias("last"))
    item = F.to_json(F.struct(*(f"`{c}`" for c in rows.columns if c != order)))
    line = F.concat(F.when(F.col(order) == F.col("first"), "[").otherwise(","), item, F.when(F.col(order) == F.col("last"), "]").otherwise(""))
    placed = rows.crossJoin(F.broadcast(ends)).repartitionByRange(order).sortWithinPartitions(order).select(line.alias("value"))
    (placed if parts else placed.coalesce(1)).write.text(path)


def exported(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The columns whose name holds one of the patterns, as text."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if any(p in c for p in patterns)))


def export_reflections(df: DataFrame, patterns: Sequence[str], path: str) -> None:
    exported(df, patterns).write.json(path)


def read_instrument(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of goniometer and beam to one row of axes, angles and direction."""
    return parse_instrument(spark.read.text(path, wholetext=True), "value")


def parse_instrument(df: DataFrame, column: str) -> DataFrame:
    item = f"struct<{INSTRUMENT.replace('axes array', 'axes: array').replace('angles array', 'angles: array').replace('direction array', 'direction: array')}>"
    both = F.from_json(column, f"array<{item}>")
    return df.withColumn("both", both).select(*[c for c in df.columns if c != column], F.col("both")[0]["axes"].alias("axes"), F.col("both")[0]["angles"].alias("angles"), F.col("both")[1]["direction"].alias("direction"))


def stack_chunks(chunks: DataFrame) -> DataFrame:
    """(file_name, pos, factor) of many files to one list: files in the order of their last number, the one that ends in -1 last.

    Names that are not JSON or hold 'overall' are left out. A file's offset is the number
    of rows before it; only counts go through one task.
    """
    rows = chunks.where(F.col("file_name").endswith(".json") & ~F.col("file_name").contains("overall"))
    number = F.when(F.col("file_name").rlike(r"-1\.json$"), F.lit(2**31 - 1)).otherwise(last_number(F.col("file_name")))
    sizes = rows.groupBy("file_name").agg(F.count("*").alias("n")).withColumn("number", number)
    offsets = sizes.select("file_name", (F.sum("n").over(Window.orderBy("number", "file_name")) - F.col("n")).alias("offset"))
    return rows.join(offsets, "file_name").select((F.col("offset") + F.col("pos")).alias("refl_id"), "factor")


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file_path, text) of all files below a folder whose name fits the pattern, at any depth. A file is a row: logs and chunks, not whole datasets."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def read_chunks(spark: SparkSession, root: str, pattern: str = "*", level: int = -1) -> DataFrame:
    """Files with JSON lists of numbers below a folder to (file_name, pos, factor), as stack_chunks takes them. The name is a part of the path: the last, or with level -2 the folder that the file is in, without what a partition's folder has before '='."""
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), level), "^[^=]*=", "")
    items = files_below(spark, root, pattern).select(name.alias("file_name"), F.posexplode(F.from_json("text", "array<double>")).alias("pos", "factor"))
    return items.select("file_name", F.col("pos").cast("long").alias("pos"), "factor")


def write_partitioned(df: DataFrame, path: str, key: str = "refl_id", buckets: int = 64) -> None:
    """Parquet in folders of the key's hash. A rerun replaces the folders that its rows fall in, whole, and leaves the others."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    df.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def not_written(df: DataFrame, path: str, key: str = "refl_id") -> DataFrame:
    """The rows of df whose key write_partitioned or add_partitioned has not written to path yet: what an interrupted run still has to do."""
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return df
    done = spark.read.schema(f"{key} {df.schema[key].dataType.simpleString()}").parquet(path)
    return df.join(done, key, "left_anti")


def add_partitioned(df: DataFrame, path: str, key: str = "refl_id", buckets: int = 64) -> None:
    """Adds rows that not_written has let through to the folders of their buckets."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("append").partitionBy("bucket").parquet(path)


def write_path_lengths(paths: DataFrame, path: str) -> None:
    """Path lengths as Parquet, in files by reflection, so that a reflection's rays are read together."""
    paths.sortWithinPartitions("refl_id", "sample_id", "leg").write.mode("overwrite").parquet(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_samples(samples: DataFrame, path: str, method: str, ratio: float) -> DataFrame:
    """Kept by method and ratio, and read again if there."""
    place = f"{path}/method={method}/ratio={ratio:g}"
    samples.write.mode("ignore").parquet(place)
    return samples.sparkSession.read.parquet(place)
