import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlight.operators import coeff, image, order, reflections, sampling, volume
from voxlight.sources import ingest


def test_reflection_and_instrument_files(spark, tmp_path):
    rows = [{"intensity.sum.value": "12.5", "miller_index": "(1, -2, 3)", "s1": "(0.1, 0.2, -0.3)", "xyzobs.mm.value": "(1.0, 2.0, 0.5)", "other": "x"}, {"intensity.sum.value": "7", "miller_index": "(0, 0, 1)", "s1": "(1, 0, 0)", "xyzobs.mm.value": "(0, 0, 0)"}]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=1))
    got = ingest.read_reflections(spark, str(tmp_path / "r.json")).orderBy("refl_id").collect()
    assert [r["refl_id"] for r in got] == [0, 1] and tuple(got[0]["miller_index"]) == (1, -2, 3) and got[0]["s1"] == [0.1, 0.2, -0.3] and got[1]["intensity_sum"] == 7.0
    (tmp_path / "i.json").write_text(json.dumps([{"axes": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "angles": [1.5, 2, 3]}, {"direction": [0, 0, -1]}]))
    one = ingest.read_instrument(spark, str(tmp_path / "i.json")).first()
    assert one["angles"] == [1.5, 2.0, 3.0] and one["direction"] == [0.0, 0.0, -1.0] and len(one["axes"]) == 3


def test_long_list_keeps_its_order(spark, tmp_path):
    """A list that many tasks have made, written as one file and read item by item."""
    rows = spark.range(5000, numPartitions=7).selectExpr("id * 3 AS n", "cast(id AS string) AS `intensity.sum.value`", "concat('(', id, ', 0, 1)') AS miller_index")
    ingest.write_json_list(rows, str(tmp_path / "list"), "n")
    got = ingest.read_reflections(spark, str(tmp_path / "list"))
    assert got.count() == 5000 and got.where("refl_id <> intensity_sum or refl_id <> miller_index.h or s1 is not null").count() == 0


@pytest.mark.parametrize("parts", [False, True])
def test_many_tasks_read_a_list(spark, tmp_path, parts):
    """One file cut into blocks, or files in order; places are those of the list."""
    rows = spark.range(5000, numPartitions=7).selectExpr("id * 3 AS n", "cast(id AS string) AS `intensity.sum.value`", "concat('(', id, ', 0, 1)') AS miller_index")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        ingest.write_json_list(rows, str(tmp_path / "list"), "n", parts=parts)
        got = ingest.read_reflections(spark, str(tmp_path / "list"), by_line=True)
        assert got.select(F.spark_partition_id()).distinct().count() > 3
        assert got.count() == 5000 and got.where("refl_id <> intensity_sum or refl_id <> miller_index.h or s1 is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(json.loads("\n".join(p.read_text() for p in sorted((tmp_path / "list").glob("part-*"))))) == 5000


def test_rerun_of_a_bucket_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select(F.col("id").alias("refl_id"), F.lit(1).alias("v"))
    ingest.write_partitioned(rows, path, buckets=4)
    one = rows.where(F.pmod(F.xxhash64("refl_id"), F.lit(4)) == 2).withColumn("v", F.lit(2))
    ingest.write_partitioned(one, path, buckets=4)
    got = spark.read.parquet(path)
    assert got.count() == 1000 and got.where("v = 2").count() == one.count() == got.where("bucket = 2").count() > 0


def test_interrupted_run_goes_on(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100).withColumnRenamed("id", "refl_id")
    assert ingest.not_written(rows, path).count() == 100
    ingest.write_partitioned(rows.where("refl_id < 30"), path, buckets=4)
    left = ingest.not_written(rows, path)
    assert left.count() == 70
    ingest.add_partitioned(left, path, buckets=4)
    assert sorted(r["refl_id"] for r in spark.read.parquet(path).collect()) == list(range(100)) and ingest.not_written(rows, path).count() == 0


def test_chunk_files_at_any_depth(spark, tmp_path):
    for place, items in (("a/d_2000.json", [3.0]), ("a/b/d_1000.json", [1.0, 2.0]), ("d_-1.json", [4.0, 5.0]), ("overall_1.json", [9.0]), ("a/note.txt", [8.0])):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(json.dumps(items))
    got = ingest.stack_chunks(ingest.read_chunks(spark, str(tmp_path), "*.json")).orderBy("refl_id").collect()
    assert [(r["refl_id"], r["factor"]) for r in got] == [(k, k + 1.0) for k in range(5)]
    assert ingest.files_below(spark, str(tmp_path), "*.txt").count() == 1


def test_stratified_sampling_does_not_depend_on_partitions(spark):
    voxels = spark.range(3000).selectExpr("cast(id div 300 AS int) AS z", "cast(id div 15 % 20 AS int) AS y", "cast(id % 15 AS int) AS x", "3 AS label")
    found = [sorted(map(tuple, sampling.stratified(voxels.repartition(n), 12).collect())) for n in (1, 3)]
    assert found[0] == found[1] and 6 < len(found[0]) <= 12


def test_weighted_draw_follows_weights(spark):
    rows = spark.range(4000).selectExpr("cast(id % 2 AS int) AS cluster", "cast(id AS int) AS z", "0 AS y", "0 AS x", "CASE id div 2 % 4 WHEN 0 THEN 0D WHEN 1 THEN 8D ELSE 1D END AS weight")
    got = sampling.weighted_draw(rows, 400).collect()
    heavy = sum(r["weight"] == 8 for r in got)
    assert len({r["z"] for r in got}) == len(got) == 800 and 560 < heavy < 700 and all(r["weight"] for r in got)


def test_far_registration_is_exact(spark, monkeypatch):
    """Periodic, random and disjoint masks against all shifts; a few shifts tried at once, so that the search goes on."""
    monkeypatch.setattr(image, "MOST_TRIED", 20)
    rng = np.random.default_rng(6)
    stripes = [(y, x) for y in range(20) for x in range(24) if y % 4 < 2 and x % 5 < 2]
    noise = [(int(y), int(x)) for y, x in rng.integers(0, 18, (90, 2))]
    frame = lambda pixels: spark.createDataFrame(sorted(set(pixels)), "y int, x int")
    for a, b, reach in ((stripes, [(y + 5, x - 3) for y, x in stripes if (y + x) % 7], 7), (noise, noise[::2], 6), ([(0, 0)], [(50, 50)], 7)):
        found = [[tuple(r) for r in f(frame(a), frame(b), reach).collect()] for f in (image.register_shift, image.register_coarse_to_fine)]
        assert found[0] == found[1]


@pytest.mark.parametrize("parts", [1, 6])
def test_running_sums_follow_the_whole_order(spark, parts):
    """Also with nulls, ties broken by a second key, and an empty table."""
    rows = [(k * 37 % 101 % 20 or None, k, k % 4) for k in range(101)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(parts)
    got = {r["b"]: r["before"] for r in order.running_sum(df, [F.col("a").desc_nulls_last(), F.col("b")], F.col("v"), "before").collect()}
    total = 0
    for _, b, v in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        assert got[b] == total
        total += v
    assert order.running_sum(df.limit(0), [F.col("b")], F.lit(1), "before").count() == 0


def test_local_mean_beside_holes(spark):
    """All pixels of the window count, whatever is missing beside them."""
    rng = np.random.default_rng(4)
    pixels = {(int(y), int(x)): float(rng.integers(0, 9)) for y in range(9) for x in range(9) if rng.random() < 0.5}
    got = image.local_mean(spark.createDataFrame([(1, y, x, v) for (y, x), v in pixels.items()], "image_id int, y int, x int, value double"), 3).collect()
    want = {(y, x): np.mean([v for (b, a), v in pixels.items() if abs(b - y) < 2 and abs(a - x) < 2]) for y, x in pixels}
    assert {(r["y"], r["x"]) for r in got} == want.keys() and all(abs(r["local"] - want[r["y"], r["x"]]) < 1e-12 for r in got)


def test_export_keeps_matching_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x")], "`a.id` int, value double, kind string")
    ingest.export_reflections(df, ["id", "val"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a.id", "value"]


def test_chunks_in_order(spark):
    rows = [("c_2000.json", 0, 2.0), ("c_1000.json", 0, 1.0), ("c_1000.json", 1, 1.5), ("c_-1.json", 0, 9.0), ("overall.json", 0, 5.0), ("c_10000.json", 0, 3.0), ("c_1.txt", 0, 4.0)]
    got = ingest.stack_chunks(spark.createDataFrame(rows, "file_name string, pos long, factor double")).orderBy("refl_id").collect()
    assert [(r["refl_id"], r["factor"]) for r in got] == [(0, 1.0), (1, 1.5), (2, 2.0), (3, 3.0), (4, 9.0)]
    names = spark.createDataFrame([("b10.tif",), ("b9.tif",), ("plain",)], "file_name string")
    assert [r["file_name"] for r in volume.natural_order(names).orderBy("place").collect()] == ["plain", "b9.tif", "b10.tif"]


def test_misaligned_rows_are_refused(spark):
    a, b = spark.range(3).withColumnRenamed("id", "refl_id"), spark.range(1, 4).withColumnRenamed("id", "refl_id")
    reflections.assert_aligned(a, a)
    with pytest.raises(ValueError):
        reflections.assert_aligned(a, b)


def test_thresholds_of_two_hills():
    x = np.arange(256)
    counts = 1000 * np.exp(-((x - 60) ** 2) / 200) + 800 * np.exp(-((x - 190) ** 2) / 300)
    assert 90 < image.least_cross_entropy(counts) < 150 and 90 < image.valley(counts) < 160
    assert image.valley(np.eye(1, 256, 7)[0]) is None and image.least_cross_entropy(np.eye(1, 256, 7)[0]) is None


def test_erosion_and_gaps(spark):
    full = spark.range(20 * 20).select(F.floor(F.col("id") / 20).cast("int").alias("y"), (F.col("id") % 20).cast("int").alias("x"))
    assert image.erode(full, (20, 20)).count() == 16 * 16
    holed = full.where("not (y = 10 and x = 10)")
    assert image.erode(holed, (20, 20), iterations=1).count() == 16 * 16 - 9
    line = spark.createDataFrame([(0, 1), (0, 4), (0, 30)], "y int, x int")
    assert sorted(r["x"] for r in image.fill_gaps(line).collect()) == [1, 2, 3, 4, 30]


def test_strict_region_tells_mixtures(spark):
    voxels = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 3), (0, 0, 1, 2)], "z int, y int, x int, label int")
    assert coeff.region_only(voxels, 2).count() == 2 and coeff.region_only(voxels, 2, strict=True).count() == 1
