import numpy as np
import pytest

from quillon.functions import sql
from quillon.operators import quantised, tree
from quillon.sources import floats, tables
from quillon.streaming import ingest


def test_float_files_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((100, 8)).astype("<f4")
    path = tmp_path / "series.bin"
    path.write_bytes(x.tobytes())
    floats.register(spark)
    df = spark.read.format("float_series").option("length", 8).load(f"file://{path}")
    got = df.orderBy("vec_id").toPandas()
    assert got["vec_id"].tolist() == list(range(100)) and np.array_equal(np.stack(got["v"]), x)
    part = spark.read.format("float_series").options(length=8, skip=10, size=5).load(f"file://{path}")
    assert sorted(r[0] for r in part.select("vec_id").collect()) == [10, 11, 12, 13, 14]
    files = floats.write(df, f"file://{tmp_path}/out")
    data = b"".join((tmp_path / "out" / name).read_bytes() for name, *_ in files)
    assert data == x.tobytes() and sum(n for *_, n in files) == 100
    (tmp_path / "out" / "part-00000-99999.bin").write_bytes(b"\0" * 32)  # what a lost attempt left
    again = spark.read.format("float_series").option("length", 8).load(f"file://{tmp_path}/out").orderBy("vec_id").toPandas()
    assert again["vec_id"].tolist() == list(range(100)) and np.array_equal(np.stack(again["v"]), x)
    some = spark.read.format("float_series").options(length=8, skip=20, size=60).load(f"file://{tmp_path}/out").orderBy("vec_id").toPandas()
    assert some["vec_id"].tolist() == list(range(20, 80)) and np.array_equal(np.stack(some["v"]), x[20:80])


def test_folders_of_files_have_running_ids(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"l{i}.bin").write_bytes(np.arange(10 * i, 10 * i + 4, dtype="<i8").tobytes())
    got = floats.labels(spark, f"file://{tmp_path}").orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == list(enumerate([0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23]))


def test_histogram_files(tmp_path):
    (tmp_path / "h.txt").write_text("3\n0.5 0.1\n1.5 0.6\n2.5 1.0\n")
    held = floats.histogram(f"file://{tmp_path}/h.txt")
    assert held == [(0.5, 0.1), (1.5, 0.6), (2.5, 1.0)] and quantised.r_delta(held, 0.9) == 0.25
    (tmp_path / "odd.txt").write_text("3 0.5 0.1")
    with pytest.raises(ValueError, match="bins"):
        floats.histogram(f"file://{tmp_path}/odd.txt")


def test_a_file_of_broken_records_is_refused(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"\0" * 30)
    floats.register(spark)
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("float_series").option("length", 8).load(f"file://{tmp_path}/odd.bin").count()


def test_labels_and_text(spark, tmp_path):
    (tmp_path / "l.bin").write_bytes(np.array([4, 5, 6], "<i8").tobytes())
    assert [tuple(r) for r in floats.labels(spark, f"file://{tmp_path}/l.bin").orderBy("vec_id").collect()] == [(0, 4), (1, 5), (2, 6)]
    df = spark.createDataFrame([("1 2.5,-3 ",)], "value string")
    assert list(tables.parsed_text(df).first()["v"]) == [1.0, 2.5, -3.0]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT series_mean(array(1D, 3D)), series_sd(array(1D, 3D)), series_znorm(array(1D, 3D)), series_distance(array(0D, 0D), array(3D, 4D)), series_paa(array(1D, 3D, 5D, 7D), 2), dtw_distance(array(0D, 0D), array(3D, 4D), 0)").first()
    assert list(row)[:2] == [2.0, 1.0] and row[2] == [-1.0, 1.0] and row[3] == 5.0 and row[4] == [2.0, 6.0] and row[5] == 5.0
    spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [1.0])], "vec_id long, v array<double>").createOrReplaceTempView("t")
    got = spark.sql("SELECT * FROM nearest(TABLE(t) WITH SINGLE PARTITION, array(0.9D), 2) ORDER BY dist").collect()
    assert [r["vec_id"] for r in got] == [3, 1]


def test_streamed_series_reach_their_leaves(spark, tmp_path):
    walks = tables.random_walks(spark, 120, 16, 2)
    built = tree.build(walks.where("vec_id < 60"), 20)
    walks.where("vec_id >= 60").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(walks.schema).parquet(f"{tmp_path}/in")
    q = ingest.start(stream, built, f"{tmp_path}/out", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    held = spark.read.parquet(f"{tmp_path}/out/series").drop("batch")
    want = {(r["vec_id"], r["leaf_id"]) for r in tree.assigned(walks.where("vec_id >= 60"), built).collect()}
    assert {(r["vec_id"], r["leaf_id"]) for r in held.collect()} == want and len(want) == 60
    assert ingest.overfull(held, 0).count() >= 1
