import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources.npy import NpyReader, read_matrix, write_matrix
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan


def matrix_of(df):
    return np.array([r.vec for r in df.orderBy("row").collect()], np.float32)


@pytest.mark.parametrize("kind", ["<f4", "<f8", ">f4", "<i4"])
def test_reads_what_numpy_wrote(spark, tmp_path, kind):
    x = np.arange(70 * 5).reshape(70, 5).astype(kind)
    np.save(tmp_path / "a.npy", x)
    df = read_matrix(spark, str(tmp_path / "a.npy"), rows=16)
    assert df.rdd.getNumPartitions() == 5 and (matrix_of(df) == x.astype(np.float32)).all()
    assert [r.row for r in df.orderBy("row").collect()] == list(range(70))


def test_rows_are_pruned(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(100, 3)).astype(np.float32)
    np.save(tmp_path / "part-0.npy", x[:60])
    np.save(tmp_path / "part-1.npy", x[60:])
    df = read_matrix(spark, f"file://{tmp_path}", rows=10).filter("row >= 55 AND row < 72")
    assert (matrix_of(df) == x[55:72]).all() and df.filter("row = 99").count() == 0
    reader = NpyReader({"path": str(tmp_path), "rows": "10"})
    other = GreaterThanOrEqual(("vec",), 1)
    assert list(reader.pushFilters([GreaterThanOrEqual(("row",), 55), other, LessThan(("row",), 72)])) == [other]
    assert [(p.first, p.rows) for p in reader.partitions()] == [(55, 5), (60, 10), (70, 2)]
    assert not list(reader.pushFilters([EqualTo(("row",), 1000)])) and reader.partitions() == []


def test_round_trip(spark, tmp_path):
    df = spark.range(500).select("id", F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(4)]).alias("v"))
    path = f"file://{tmp_path}/m"
    for _ in range(2):  # the second write takes the place of the first
        write_matrix(df, path, "id", vec="v", rows=64)
    want = np.array([r.v for r in df.orderBy("id").collect()], np.float32)
    parts = sorted(p for p in os.listdir(tmp_path / "m") if p.endswith(".npy"))
    assert (np.concatenate([np.load(tmp_path / "m" / p) for p in parts]) == want).all()
    assert (matrix_of(read_matrix(spark, path)) == want).all() and sorted(os.listdir(tmp_path / "m")) == parts


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    write_matrix(spark.createDataFrame([(0, [1.0, 2.0])], "id long, vec array<double>"), path, "id")
    bad = spark.range(200).select("id", F.when(F.col("id") == 150, F.lit(None)).otherwise(F.array(F.lit(1.0))).alias("vec"))
    with pytest.raises(Exception, match="null"):
        write_matrix(bad, path, "id", rows=10)
    assert os.listdir(tmp_path / "m") == ["part-00000000.npy"] and matrix_of(read_matrix(spark, path)).tolist() == [[1.0, 2.0]]
