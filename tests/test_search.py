"""Every exact strategy against brute force, and what must hold of the others."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays
from quillon.operators import knn, quantised, tree, warping, words
from quillon.plans import queries as plans
from quillon.sources import tables
from quillon.streaming import ingest


@pytest.fixture(scope="module")
def walks(spark):
    return tables.random_walks(spark, 400, 64, 5).cache()


@pytest.fixture(scope="module")
def matrix(walks):
    rows = walks.orderBy("vec_id").toPandas()
    return np.stack(rows["v"])


def brute(x, q_ids, k):
    out = {}
    for q in q_ids:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[q] = [(int(i), round(float(d[i]), 6)) for i in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def result(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r["q_id"], []).append((r["vec_id"], r["dist"]))
    return out


@pytest.fixture(scope="module")
def index(spark, walks, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tree')}/index"
    built = tree.build(walks, 40, segments=2)
    tree.write(walks, built, path)
    return tree.read(spark, path)


QUERIES = list(range(0, 400, 50))


def asked(df):
    return df.where("vec_id % 50 = 0")


@pytest.mark.parametrize("summary", [None, knn.SaxSummary(), knn.FourierSummary(6), knn.SegmentSummary(8)])
def test_exact_strategies_agree_with_brute_force(walks, matrix, summary):
    assert result(knn.knn_join(walks, asked(walks), 7, summary=summary)) == brute(matrix, QUERIES, 7)


@pytest.mark.parametrize("how", ["kmeans", "equidepth"])
def test_quantised_search_and_its_bounds(walks, matrix, how):
    cells = quantised.fit(walks, 64, n=6, how=how)
    assert result(knn.knn_join(walks, asked(walks), 7, summary=cells)) == brute(matrix, QUERIES, 7)
    held = cells.of(matrix)
    for q in QUERIES[:3]:
        d = arrays.squared_distances(matrix, matrix[q])
        assert (cells.lower(matrix[q], held) <= d + 1e-9).all()
        near = 2 * arrays.squared_distances(arrays.spectrum(matrix, 6), arrays.spectrum(matrix[[q]], 6)[0])
        assert (cells.upper(matrix[q], held) >= near - 1e-9).all()


def test_borders_are_exact_quantiles_with_ties_nulls_and_absent_dimensions(spark):
    rng = np.random.default_rng(3)
    x = {0: rng.normal(size=5000), 1: np.r_[np.full(700, 2.5), rng.normal(size=301)], 2: np.array([4.0])}
    rows = [(d, float(y)) for d, values in x.items() for y in values] + [(0, None)]
    got = {(r["dim"], r["border"]): r["x"] for r in quantised.equidepth(spark.createDataFrame(rows, "dim int, x double"), [5, 3, 1, 2]).collect()}
    want = {(d, i): np.quantile(x[d], i / 2**b) for d, b in enumerate([5, 3, 1]) for i in range(1, 2**b)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert quantised.equidepth(spark.createDataFrame([], "dim int, x double"), [2]).collect() == []


def test_tree_search_is_exact_and_its_bounds_hold(walks, matrix, index):
    held, built = index
    want = brute(matrix, QUERIES, 7)
    for options in ({}, {"eapca_threshold": 2.0}, {"sax_threshold": 0.0}, {"sax_threshold": 2.0}):
        assert result(tree.search(held, built, asked(walks), 7, approximate_leaves=1, **options)) == want
    leaf = built.route(matrix)
    leaves = built.leaves()
    low, up = tree.bounds(built, matrix[QUERIES]), tree.bounds(built, matrix[QUERIES], "upper")
    for i, q in enumerate(QUERIES):
        d = arrays.squared_distances(matrix, matrix[q])
        for j, n in enumerate(leaves):
            mine = d[leaf == n.id]
            assert (low[i, j] <= mine + 1e-9).all() and (mine <= up[i, j] + 1e-9).all()
    assert sum(n.size for n in leaves) == 400 and max(n.size for n in leaves) <= 40


def test_leaves_finished_in_one_task_give_the_same_tree(walks):
    trees = [tree.build(walks, 20, segments=2, local_numbers=n) for n in (0, 64 * 100, tree.LOCAL_NUMBERS)]
    for t in trees[1:]:
        assert t.nodes.keys() == trees[0].nodes.keys()
        for at, n in t.nodes.items():
            m = trees[0].nodes[at]
            assert (n.size, n.ends, n.level, n.parent) == (m.size, m.ends, m.level, m.parent)
            assert (n.split is None) == (m.split is None) and (n.split is None or np.allclose(n.split, m.split))
            assert np.allclose(n.sketch, m.sketch)


def test_approximate_answers_are_real_and_no_nearer_than_exact(walks, matrix, index):
    held, built = index
    want = brute(matrix, QUERIES, 5)
    for options in ({"probes": 1}, {"probes": 3}, {"epsilon": 0.5, "approximate_leaves": 1}, {"r_delta": 4.0, "epsilon": 0.1, "approximate_leaves": 1}):
        for q, rows in result(tree.search(held, built, asked(walks), 5, **options)).items():
            d = np.sqrt(((matrix - matrix[q]) ** 2).sum(axis=1))
            assert all(abs(d[i] - x) < 1e-5 for i, x in rows)
            assert all(x >= w - 1e-6 for (_, x), (_, w) in zip(rows, want[q], strict=False))
            if options.get("epsilon") and not options.get("r_delta"):
                assert all(x <= w * 1.5**0.5 + 1e-6 for (_, x), (_, w) in zip(rows, want[q], strict=True))


def test_progressive_search_ends_at_the_nearest(walks, index):
    held, built = index
    rows = tree.progressive(held, built, asked(walks)).orderBy("q_id", "step").collect()
    for q in QUERIES:
        mine = [r for r in rows if r["q_id"] == q]
        assert [r["bsf"] for r in mine] == sorted((r["bsf"] for r in mine), reverse=True)
        assert mine[-1]["bsf"] == 0 and mine[-1]["proven"]
        first = next(r for r in mine if r["proven"])
        assert first["bsf"] == mine[-1]["bsf"]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruned_nodes_are_the_first_on_their_path_and_nothing_is_broadcast(walks, matrix, index):
    held, built = index
    cut = tree.pruned_nodes(held, built, asked(walks), 5, approximate_leaves=1)
    assert "Broadcast" not in planned(cut)
    nodes = [n for _, n in sorted(built.nodes.items())]  # parents come first
    low, leaf = tree.bounds(None, matrix[QUERIES], nodes=nodes), built.route(matrix)
    leaves, want = np.array([n.id for n in built.leaves()]), set()
    for i, q in enumerate(QUERIES):
        home = leaves[tree.nearest_leaves(tree.bounds(built, matrix[[q]]), 1)[0]][0]
        bsf, gone = np.sort(arrays.squared_distances(matrix[leaf == home], matrix[q]))[4], set()
        for j, n in enumerate(nodes):
            if n.id >> 1 in gone:
                gone.add(n.id)
            elif low[i, j] > bsf:
                gone.add(n.id)
                want.add((q, n.id, n.level, round(float(bsf) ** 0.5, 5)))
    assert want and {(r["q_id"], r["node_id"], r["level"], round(r["bsf"], 5)) for r in cut.collect()} == want


def test_extremes_are_those_of_the_rows_under_each_node(walks, matrix, index):
    held, built = index
    got = {(r["q_id"], r["node_id"]): r for r in tree.extremes(held, asked(walks)).collect()}
    passed = {n.id: rows for n, rows in built.visited(matrix)}
    assert got.keys() == {(q, at) for q in QUERIES for at in passed}
    for (q, at), r in got.items():
        d = arrays.squared_distances(matrix[passed[at]], matrix[q])
        assert r["n"] == len(d) and abs(r["low"] - d.min()) < 1e-9 and abs(r["high"] - d.max()) < 1e-9


@pytest.mark.parametrize("name", ["node_mindists_checks", "pruned_nodes_checks"])
def test_checks_of_nodes_broadcast_no_pairs(spark, name):
    plan = planned(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert re.search(r"SortMergeJoin \[q_id#\d+L, node_id", plan)
    assert not re.search(r"BroadcastExchange((?!Exchange|Aggregate).)*MapIn", plan, re.DOTALL)


def test_words_route_to_leaves_that_hold_them(walks, matrix):
    built = words.build(walks, 40)
    w = built.words(matrix)
    leaf = built.route(w)
    for n in built.nodes.values():
        if n.cut is None:
            mine = w[leaf == n.id]
            assert len(mine) == n.size
            for s in range(16):
                assert (mine[:, s] >> (8 - n.bits[s]) == n.values[s]).all()
    for q in QUERIES[:3]:
        d, low = arrays.squared_distances(matrix, matrix[q]), built.lower(matrix[q])
        assert all(low[at] <= x + 1e-9 for at, x in zip(leaf, d, strict=True))
    home = result(words.home_leaf_join(walks, asked(walks), built, 3))
    assert all(rows[0] == (q, 0.0) for q, rows in home.items())


def test_pairs_of_the_warped_bound_make_nothing_anew(spark):
    pairs = planned(plans.QUERIES["dtw_mindist"](spark, "/root/testdata/sf0.001")).split("BroadcastNestedLoopJoin")
    assert len(pairs) == 2 and "lambda" not in pairs[0]


def test_warped_search_agrees_with_brute_force(walks, matrix):
    for summary in (False, True):
        got = result(warping.dtw_join(walks, asked(walks), 3, 4, summary=summary))
        for q in QUERIES:
            d = np.sqrt(arrays.dtw(matrix, matrix[q], 4))
            assert got[q] == [(int(i), round(float(d[i]), 6)) for i in np.lexsort((np.arange(400), d))[:3]]


def test_warped_search_compares_few_rows(matrix, monkeypatch):
    pairs, whole = [], arrays.dtw
    monkeypatch.setattr(arrays, "dtw", lambda x, *rest: pairs.append(len(x)) or whole(x, *rest))
    ids, qs = np.arange(400), matrix[QUERIES]
    best = [knn.Best(3, np.sort(arrays.squared_distances(matrix, q))[2]) for q in qs]
    live = knn.lowers(warping.WarpedSaxSummary(4), qs, warping.WarpedSaxSummary(4).of(matrix)) <= np.array([[b.bound] for b in best]) + 1e-9
    warping.offering(4)(best, matrix, ids, qs, live)
    assert 0 < sum(pairs) < 400 * len(QUERIES) / 3
    for q, b in zip(qs, best, strict=True):
        d = whole(matrix, q, 4)
        assert b.ids.tolist() == np.lexsort((ids, d))[:3].tolist() and (b.d == d[b.ids]).all()


def test_warped_vote_is_that_of_brute_force(walks, matrix):
    labelled = walks.withColumn("label", (F.col("vec_id") % 3).cast("int"))
    got = {r["q_id"]: (r["label"], r["votes"]) for r in warping.dtw_classify(labelled, asked(labelled), 5, 4, summary=True).collect()}
    for q in QUERIES:
        d = arrays.dtw(matrix, matrix[q], 4)
        labels = [int(i) % 3 for i in np.lexsort((np.arange(400), d)) if i != q][:5]
        most = max(labels.count(x) for x in labels)
        reached = {x: [i for i, y in enumerate(labels) if y == x][-1] for x in labels if labels.count(x) == most}
        assert got[q] == (min(reached, key=reached.get), most)


def rows(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None, label) for i, v, label in data], "vec_id long, v array<double>, label int")


def test_ties_nulls_and_short_tables(spark):
    df = rows(spark, [(3, [0, 0], 1), (1, [0, 0], 2), (2, [1, 0], 2), (9, None, 1), (5, [3, 4], 1)])
    q = df.where("vec_id = 3")
    assert result(knn.knn_join(df, q, 10))[3] == [(1, 0.0), (3, 0.0), (2, 1.0), (5, 5.0)]
    assert result(knn.knn_join(df, q, 3, distinct=True))[3] == [(1, 0.0), (2, 1.0), (5, 5.0)]
    assert result(knn.knn_join(df, q, 2, exclude_self=True))[3] == [(1, 0.0), (2, 1.0)]
    assert knn.knn_join(df.limit(0), q, 3).count() == 0
    assert knn.knn_join(df, q.limit(0), 3).count() == 0


def test_distinct_looks_behind_many_ties(spark):
    df = rows(spark, [(i, [0, 0], 0) for i in range(50)] + [(100 + i, [i + 1, 0], 0) for i in range(3)])
    assert result(knn.knn_join(df, df.where("vec_id = 0"), 4, distinct=True))[0] == [(0, 0.0), (100, 1.0), (101, 2.0), (102, 3.0)]


def test_a_tied_vote_goes_to_the_label_that_gets_there_first(spark):
    df = rows(spark, [(0, [0], 9), (1, [1], 7), (2, [2], 5), (3, [3], 5), (4, [4], 7)])
    got = knn.classify(df, df.where("vec_id = 0"), 4).first()
    assert (got["label"], got["votes"]) == (5, 2)


def test_equal_series_stay_in_one_leaf(spark):
    df = rows(spark, [(i, [1, 2, 3, 4], 0) for i in range(30)])
    built = tree.build(df, 5)
    assert len(built.leaves()) == 1 and built.leaves()[0].size == 30


def test_range_and_pruning(walks, matrix):
    got = knn.range_search(walks, asked(walks), 6.0, summary=knn.SaxSummary()).select("q_id", "vec_id").collect()
    want = {(q, int(i)) for q in QUERIES for i in np.flatnonzero(((matrix - matrix[q]) ** 2).sum(axis=1) < 36)}
    assert {(r[0], r[1]) for r in got} == want
    p = knn.pruning(walks, asked(walks), 5, knn.FourierSummary(8)).collect()
    assert len(p) == len(QUERIES) and all(r["n_rows"] == 400 and r["n_compared"] <= 400 for r in p)


def test_bits_go_to_the_dimension_of_most_energy():
    assert quantised.allocate([16.0, 4.0, 1.0], 2) == [3, 2, 1]


def test_histogram_gives_a_radius():
    h = [(1.0, 0.0), (2.0, 0.5), (3.0, 1.0)]
    assert quantised.r_delta(h, 1.0) == 0.0
    assert quantised.r_delta(h, 0.75) == pytest.approx(1.5**2)
    assert quantised.r_delta(h, 0.0) == pytest.approx(9.0)


def test_query_slice(walks):
    assert [r[0] for r in tables.query_slice(walks, 3, 4).orderBy("vec_id").select("vec_id").collect()] == [3, 4, 5, 6]
    assert walks.select(F.max(F.size("v"))).first()[0] == 64


def test_appended_series_are_found_by_exact_search(spark, tmp_path):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((60, 16)), 5 * r.standard_normal((40, 16)), r.standard_normal((20, 16)) + 3])
    whole = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    path = f"file://{tmp_path}/index"
    first = whole.where("vec_id < 60")
    built = tree.build(first, 10, segments=2)
    tree.write(first, built, path)
    for n, cond in ((1, "vec_id BETWEEN 60 AND 99"), (2, "vec_id >= 100"), (2, "vec_id >= 100")):  # the second batch is run again
        ingest.append(whole.where(cond), n, built, path)
    series, found = tree.read(spark, path)
    assert series.count() == 120 and found.nodes[1].size == 120 and found.leaf_size == 10
    got = result(tree.search(series, found, whole, 3, approximate_leaves=1))
    assert got == brute(x, range(120), 3)
    steps = tree.found_stepwise(series, found, whole, 3, wave=2)
    assert result(steps.drop("leaves")) == brute(x, range(120), 3)
    assert steps.agg({"leaves": "min"}).first()[0] < len(found.leaves())
    stats = tree.query_stats(series, found, whole, 3, approximate_leaves=1).collect()
    assert all(s["rows"] == 120 and 3 <= s["rows_read"] <= 120 and s["exact"] <= s["approximate"] for s in stats) and any(s["rows_read"] < 120 for s in stats)


def test_distances_by_products_find_what_differences_find(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([1e4 + r.standard_normal((300, 12)), np.zeros((3, 12)), np.full((2, 12), 1e4)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    assert result(knn.knn_join(df, df.where("vec_id % 7 = 0"), 4)) == brute(x, range(0, 305, 7), 4)
