"""Column expressions against numpy, and the cases that are easy to get wrong."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import arrays, series


@pytest.fixture(scope="module")
def walks():
    return np.random.default_rng(3).standard_normal((40, 32)).cumsum(axis=1)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")


def test_znorm_matches_numpy_and_a_constant_series_is_zero(spark, walks):
    x = np.vstack([walks, np.full(32, 7.0)])
    got = frame(spark, x).select("vec_id", series.znorm(F.col("v")).alias("z")).orderBy("vec_id").toPandas()
    assert np.allclose(np.stack(got["z"]), arrays.znorm(x))
    assert not np.stack(got["z"])[-1].any()


def test_summaries_match_numpy(spark, walks):
    v = F.col("v")
    ends = series.equal_segments(32, 5)
    assert ends == [6, 12, 18, 24, 32]
    row = frame(spark, walks).select(series.paa(v, 5, 32).alias("p"), series.segment_stats(v, ends).alias("s"), series.dft(v, 32, 4).alias("f"), series.running_sum(v).alias("c"), series.query_order(v).alias("o"), series.envelope(v, 32, 3).alias("e")).toPandas()
    assert np.allclose(np.stack(row["p"]), arrays.paa(walks, 5))
    m, s = arrays.segment_stats(walks, ends)
    assert np.allclose([[x["mean"] for x in r] for r in row["s"]], m)
    assert np.allclose([[x["sd"] for x in r] for r in row["s"]], s)
    assert np.allclose(np.stack(row["f"]), arrays.spectrum(walks, 4))
    assert np.allclose(np.stack(row["c"]), walks.cumsum(axis=1))
    assert all(list(o) == sorted(range(32), key=lambda i: (-abs(w[i]), i)) for o, w in zip(row["o"], walks, strict=True))
    up, low = arrays.envelope(walks[0], 3)
    assert np.allclose([x["upper"] for x in row["e"][0]], up)
    assert np.allclose([x["lower"] for x in row["e"][0]], low)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 400])
def test_running_sums_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = spark.createDataFrame([(x.tolist(),), (None,)], "v array<double>").select(series.running_sum(F.col("v"))).collect()
    assert np.allclose(got[0][0], x.cumsum()) and len(got[0][0]) == n
    assert got[1][0] is None


def test_a_value_on_a_breakpoint_has_the_lower_symbol(spark):
    cuts = series.breakpoints(8)
    x = [cuts[2], np.nextafter(cuts[2], 9), -50.0, 50.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(series.symbol(F.col("x"), 8)).collect()]
    assert got == [2, 3, 0, 7, 3]
    assert arrays.symbols(np.array(x), 8).tolist() == got


def test_points_beyond_the_last_segment_are_left_out(spark):
    a, b = np.arange(10.0), np.r_[np.arange(8.0), 99, 99]
    got = frame(spark, [a, b]).select(series.paa(F.col("v"), 4, 10).alias("p")).toPandas()["p"]
    assert list(got[0]) == list(got[1])


def test_words_as_bits_and_root_mask(spark):
    row = spark.createDataFrame([([5, 200],)], "w array<int>").select(series.sax_bits(F.col("w"), 8), series.root_mask(F.col("w"), 8)).first()
    assert row[0] == "00000101 11001000"
    assert row[1] == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6))
def test_warping_matches_the_recurrence(seed, band):
    r = np.random.default_rng(seed)
    x, q = r.standard_normal((4, 12)), r.standard_normal(12)

    def plain(a, b):
        cost = np.full((13, 13), np.inf)
        cost[0, 0] = 0
        for i in range(12):
            for j in range(max(0, i - band), min(12, i + band + 1)):
                cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
        return cost[12, 12]

    want = [plain(q, row) for row in x]
    assert np.allclose(arrays.dtw(x, q, band), want)
    up, low = arrays.envelope(q, band)
    assert (arrays.lb_keogh(x, up, low) <= np.array(want) + 1e-9).all()
    bound = float(np.median(want))
    got = arrays.dtw(x, q, band, bound)
    assert all(g == pytest.approx(w) or (g == np.inf and w > bound) for g, w in zip(got, want, strict=True))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6))
def test_warping_of_pairs_each_with_its_bound(seed, band):
    r = np.random.default_rng(seed)
    x, q = r.standard_normal((9, 12)), r.standard_normal((9, 12))
    want = np.array([arrays.dtw(x[[i]], q[i], band)[0] for i in range(9)])
    env = tuple(np.stack(e) for e in zip(*[arrays.envelope(y, band) for y in q], strict=True))
    most = want * r.choice([0.3, 0.9, 1.1, 3], 9)
    assert np.array_equal(arrays.dtw(x, q, band, most, env), np.where(want <= most, want, np.inf))
