"""Columns of voxels are counted as bits of words, not as rows."""

from pyspark.sql import functions as F

from orograph import catalog
from orograph.operators import bitmaps


def test_no_column_of_voxels_is_shuffled(spark, small):
    plan = catalog.QUERIES["voxel_manifest"](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "hashpartitioning(station_id" in line]
    names = [[k.strip().split("#")[0] for k in line.split(",")] for line in keys]
    assert names and not any({"r", "c"} & set(n) for n in names)


def test_words_with_aggregates_count_a_cell_once(spark):
    rows = [(1, r, c, float(r + k)) for r in range(9) for c in range(17) for k in range(3)] + [(2, 5, 5, 1.0)]
    words = bitmaps.packed(spark.createDataFrame(rows, "id int, r int, c int, v double"), ["id"], {"word": F.lit(True)}, {"n": F.count("*"), "most": F.max("v")})
    got = words.groupBy("id").agg(F.sum("n"), F.sum(F.bit_count("word")), F.max("most")).collect()
    assert {tuple(x) for x in got} == {(1, 9 * 17 * 3, 9 * 17, 10.0), (2, 1, 1, 1.0)}
