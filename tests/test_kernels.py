import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.functions import scalar, special
from axisloom.operators import access, collection, dispersion, markers, measure, order, stats


def coo(spark, x):
    return spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "i long, j long, v double")


@pytest.fixture(scope="module")
def toy():
    rng = np.random.default_rng(1)
    return rng.poisson(0.6, (200, 15)).astype(float), np.arange(200) % 4


def grid(df, name, k, n):
    out = np.zeros((k, n))
    for r in df.collect():
        out[r["g"], r["j"]] = r[name]
    return out


def test_column_statistics(spark, toy):
    x, _ = toy
    cols = spark.range(16).select(F.col("id").alias("j"))
    got = {r["j"]: r for r in stats.col_stats(coo(spark, x), 200, cols).collect()}
    assert len(got) == 16 and got[15]["mean"] == got[15]["var"] == got[15]["nnz"] == 0
    for j in range(15):
        assert got[j]["mean"] == pytest.approx(x[:, j].mean(), abs=1e-9)
        assert got[j]["var"] == pytest.approx(x[:, j].var(ddof=1), abs=1e-9)
        assert got[j]["nnz"] == (x[:, j] != 0).sum()


def test_fused_view(spark, toy):
    x, _ = toy
    m = coo(spark, x)
    d = x.sum(1, keepdims=True)
    want = np.log1p(np.where(d > 0, x * 1000 / np.where(d > 0, d, 1), 0))
    for r in stats.col_stats(m, 200, lognorm=True, depth=stats.depth_of(m), scale=1000, population=True).collect():
        assert r["mean"] == pytest.approx(want[:, r["j"]].mean(), abs=1e-9)
        assert r["var"] == pytest.approx(want[:, r["j"]].var(), abs=1e-9)


def test_group_statistics_and_markers(spark, toy):
    x, g = toy
    groups = spark.createDataFrame([(i, int(k) if i % 10 else None) for i, k in enumerate(g)], "i long, g int")
    cols, levels = spark.range(15).select(F.col("id").alias("j")), spark.createDataFrame([(k,) for k in range(5)], "g int")
    s = stats.group_stats(coo(spark, x), groups, columns=cols, levels=levels).cache()
    keep = np.arange(200) % 10 != 0
    S = np.array([x[keep & (g == k)].sum(0) if k < 4 else np.zeros(15) for k in range(5)])
    E = np.array([(x[keep & (g == k)] != 0).sum(0) if k < 4 else np.zeros(15) for k in range(5)])
    assert np.allclose(grid(s, "sum", 5, 15), S) and np.allclose(grid(s, "n_expr", 5, 15), E)
    n = np.array([(keep & (g == k)).sum() for k in range(5)])
    mk = markers.markers(s, stats.group_sizes(groups, levels), 200)
    lfc = S / np.maximum(n, 1)[:, None] - (S.sum(0) - S) / np.maximum(200 - n, 1)[:, None]
    assert np.allclose(grid(mk, "lfc", 5, 15), lfc)
    assert np.allclose(grid(mk, "padj", 5, 15), np.clip(np.exp(-np.abs(lfc * np.sqrt(E + 1))), 1e-12, 1))


def test_markers_by_hand(spark):
    rows = [(0, 0, 2.0, 3), (0, 1, 0.0, 0), (0, 2, 4.0, 4), (1, 0, 3.0, 5), (1, 1, 6.0, 6), (1, 2, 1.0, 1)]
    s = spark.createDataFrame(rows, "g int, j long, sum double, n_expr long")
    got = {(r["g"], r["j"]): r["lfc"] for r in markers.markers(s, spark.createDataFrame([(0, 4), (1, 6)], "g int, n long"), 10).collect()}
    assert got[(0, 0)] == pytest.approx(2 / 4 - 3 / 6) and got[(1, 1)] == pytest.approx(6 / 6 - 0)


def test_top_markers_break_ties_and_skip_nan(spark):
    t = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, float("nan")), (0, 3, 2.0)], "g int, j long, lfc double")
    assert [(r["j"], r["rank"]) for r in markers.top_markers(t, top=2).orderBy("rank").collect()] == [(3, 1), (0, 2)]
    ranks = {r["j"]: r["rank"] for r in markers.rank_scores(t, "lfc").collect()}
    assert ranks[2] == 4


def test_a_versus_b(spark, toy):
    x, g = toy
    sides = spark.createDataFrame([(i, "a" if k == 0 else "b") for i, k in enumerate(g) if k < 2], "i long, side string")
    assert markers.disjoint(sides)
    got = {r["j"]: r["lfc"] for r in markers.a_versus_b(coo(spark, x), sides, 50, 50).collect()}
    for j, v in got.items():
        assert v == pytest.approx(x[g == 0, j].mean() - x[g == 1, j].mean())
    empty = {r["j"]: r["mean_b"] for r in markers.a_versus_b(coo(spark, x), sides.where("side = 'a'"), 50, 0).collect()}
    assert set(empty.values()) == {0.0}


def test_incomplete_beta():
    assert special.log_beta_inc(5, 5, 0.5) == pytest.approx(math.log(0.5), abs=1e-12)
    assert special.log_beta_inc(2, 3, 0.4) == pytest.approx(math.log(0.5248), abs=1e-9)
    assert special.log_beta_inc(400, 400, 1e-6) == -700.0
    values = [special.log_beta_inc(30, 30, 1 / (1 + f)) for f in (1, 2, 4, 8)]
    assert values == sorted(values, reverse=True)


def lowess(x, y, span=0.3, anchors=200):
    """Local linear fits at anchors evenly spaced in value, one after another."""
    order = sorted(range(len(x)), key=lambda k: x[k])
    xs, ys, n = [x[k] for k in order], [y[k] for k in order], len(x)
    width, at, fit = max(2, int(span * n)), [], []
    for a in range(anchors):
        x0 = xs[0] + (xs[-1] - xs[0]) * a / (anchors - 1)
        stop = min(n, max(0, sum(v < x0 for v in xs) - width // 2) + width)
        px, py = np.array(xs[max(0, stop - width) : stop]), np.array(ys[max(0, stop - width) : stop])
        w = (1 - (abs(px - x0) / max(1e-9, abs(px - x0).max())) ** 3) ** 3
        slope, base = np.polyfit(px - x0, py, 1, w=np.sqrt(w)) if (w * px * px).sum() * w.sum() - (w * px).sum() ** 2 >= 1e-12 else (0.0, (w * py).sum() / w.sum())
        at.append(x0)
        fit.append(base)
    return np.interp(x, at, fit)


def test_overdispersion(spark):
    rng = np.random.default_rng(2)
    mean = np.exp(rng.normal(-1, 1.5, 300))
    mean[:20] = mean[20]  # ties
    var = np.exp(1.2 * np.log(mean) + 0.1 * np.sin(3 * np.log(mean)) + rng.normal(0, 0.3, 300))
    nnz = rng.integers(1, 80, 300)
    var[50] *= 30
    var[60], mean[61] = 0.0, 0.0
    nnz[50] = 79
    s = spark.createDataFrame([(j, float(a), float(b), int(k)) for j, (a, b, k) in enumerate(zip(mean, var, nnz))], "j long, mean double, var double, nnz long").repartition(3)
    got = {r["j"]: r["od_score"] for r in dispersion.overdispersion(s).collect()}
    ok = np.flatnonzero((nnz >= 3) & (mean > 0) & (var > 0))
    x, y = np.log(mean[ok]), np.log(var[ok])
    ratio = np.exp(y - lowess(x, y))
    want = np.zeros(300)
    want[ok] = [-float(special.log_beta_inc(k / 2, k / 2, 1 / (1 + f))) for f, k in zip(ratio, nnz[ok])]
    assert np.allclose([got[j] for j in range(300)], want, rtol=1e-6, atol=1e-8)
    assert max(got, key=got.get) == 50
    assert {r["od_score"] for r in dispersion.overdispersion(s.where("j < 9")).collect()} == {0.0}


def test_trend_of_written_out_values(spark):
    """A straight line is its own trend, also where its points crowd at one end."""
    x = [0.0] * 3 + [0.01 * k for k in range(1, 30)] + [1.0, 2.0, 4.0]
    found = spark.createDataFrame([(j, v, 2.0 - 0.5 * v) for j, v in enumerate(x)], "j long, x double, y double")
    at, fit = dispersion.trend(found)
    assert len(at) == 200 and at[0] == 0.0 and at[-1] == 4.0 and np.allclose(np.diff(at), 4 / 199)
    assert np.allclose(fit, 2.0 - 0.5 * at, atol=1e-6)


def test_hilbert_curve(spark):
    cells = spark.createDataFrame([(x, y) for y in range(4) for x in range(4)], "x int, y int")
    got = {(r["x"], r["y"]): r["d"] for r in cells.withColumn("d", scalar.hilbert(F.col("x"), F.col("y"), 4)).collect()}
    assert sorted(got.values()) == list(range(16))
    path = sorted(got, key=got.get)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:]))
    assert [[got[(x, y)] for x in range(4)] for y in range(4)] in ([[0, 1, 14, 15], [3, 2, 13, 12], [4, 7, 8, 11], [5, 6, 9, 10]], [[0, 3, 4, 5], [1, 2, 7, 6], [14, 13, 8, 9], [15, 12, 11, 10]])


def test_cell_order_is_a_permutation_with_groups_together(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(300, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, x double, y double")
    groups = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(300)], "i long, g int")
    rows = order.cell_order(points, groups).join(groups, "i").orderBy("new_pos").collect()
    assert [r["new_pos"] for r in rows] == list(range(300))
    codes = [9 if r["g"] is None else r["g"] for r in rows]
    assert codes == sorted(codes)


def test_crossfilter_keeps_nan_and_both_ends(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "a"), (2, float("nan"), "a"), (3, 2.5, "b"), (4, None, "a")], "i long, v double, c string")
    f = access.Crossfilter(df).between("v", 1.0, 2.0)
    assert sorted(r["i"] for r in f.selected().collect()) == [0, 1, 2]
    assert f.keep("c", ["b"]).count() == 0 and f.keep("c", ["b"]).reset("v").count() == 1 and f.reset().count() == 5


def test_gather_keeps_order_and_duplicates(spark, toy):
    x, _ = toy
    rows = access.gather(coo(spark, x), [3, 1, 3]).collect()
    assert sorted({(r["ord"], r["j"]) for r in rows}) == [(0, 3), (1, 1), (2, 3)]


def test_dense_and_sparse(spark):
    d = spark.createDataFrame([(0, [0.0, 1.5, float("nan")]), (1, [0.0, 0.0, 0.0])], "i long, vec array<double>")
    m = measure.dense_to_sparse(d)
    assert sorted((r["i"], r["j"]) for r in m.collect()) == [(0, 1), (0, 2)]
    assert measure.sparse_to_dense(m.where("not isnan(v)"), 3).first()["vec"] == [0.0, 1.5, 0.0]
    out = m.sparkSession.createDataFrame([(0, 1, 2.0), (0, 9, 1.0), (5, 2, None), (7, 9, 1.0)], "i long, j long, v double")
    assert {r["i"]: r["vec"] for r in measure.sparse_to_dense(out, 3).collect()} == {0: [0.0, 2.0, 0.0], 5: [0.0, 0.0, 0.0], 7: [0.0, 0.0, 0.0]}
    assert stats.col_stats(m.where("not isnan(v)"), 2).count() == 1


def test_missing_values_stay_apart(spark):
    axis = spark.createDataFrame([(i, f"r{i}") for i in range(4)], "pos long, label string")
    field = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "i long, v double")
    got = {r["pos"]: (r["v"], r["is_covered"]) for r in measure.with_coverage(axis, field).collect()}
    assert got[0] == (1.0, True) and got[1] == (None, True) and math.isnan(got[2][0]) and got[3] == (None, False)


def test_first_seen_codes(spark):
    labels = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "i long, v string")
    assert {r["i"]: r["code"] for r in access.first_seen_codes(labels).collect()} == {0: 0, 1: -1, 2: 1, 3: 0}
    assert [r["label"] for r in access.factor_levels(labels).orderBy("pos").collect()] == ["a", "b"]


def test_collection_equals_its_flat_form(spark):
    rng = np.random.default_rng(3)
    genes = [f"g{k}" for k in range(12)]
    measures, rows, cols, flat, groups = {}, {}, {}, [], []
    for s, n in (("s1", 30), ("s2", 40), ("s3", 20)):
        own = [g for k, g in enumerate(genes) if k != len(measures)]
        x = rng.poisson(0.5, (n, len(own)))
        measures[s] = coo(spark, x)
        rows[s] = spark.createDataFrame([(i, f"c{i}") for i in range(n)], "pos long, label string")
        cols[s] = spark.createDataFrame(list(enumerate(own)), "pos long, label string")
        flat += [(f"{s}:c{i}", own[j], float(x[i, j])) for i in range(n) for j in range(len(own))]
        groups += [(f"{s}:c{i}", i % 4) for i in range(n)]
    c = collection.collection_from(measures, rows, cols)
    assert [r["label"] for r in c["columns"].orderBy("pos").collect()] == genes[1:] + genes[:1]
    g = spark.createDataFrame(groups, "row string, g int")
    size = {k: sum(1 for _, h in groups if h == k) for k in range(4)}
    of = dict(groups)
    for r in collection.collection_pseudobulk(c["measure"], g).collect():
        want = sum(v for row, col, v in flat if of[row] == r["g"] and col == r["col"]) / size[r["g"]]
        assert r["mean"] == pytest.approx(want)
    assert {r["sample"]: r["n_rows"] for r in collection.sample_sizes(c["rows"]).collect()} == {"s1": 30, "s2": 40, "s3": 20}
    with pytest.raises(ValueError):
        collection.collection_from(measures, rows, cols, prefix=False)
    far = measures | {"s2": measures["s2"].unionByName(spark.createDataFrame([(0, 99, 1.0)], measures["s2"].schema))}
    with pytest.raises(Exception, match="no label for the col of an entry: s2 0 99"):
        collection.collection_from(far, rows, cols)["measure"].collect()


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(i, x) for i, x in enumerate(s)], "pos long, label string") for s in ("abc", "bcd"))
    assert sorted(r["label"] for r in collection.intersect_labels(a, b).collect()) == ["b", "c"]
    assert [r["label"] for r in collection.except_labels(a, b).collect()] == ["a"]
    assert collection.same_axis(a, a) and not collection.same_axis(a, b) and collection.subset_of(a, a) and not collection.subset_of(a, b)


def test_names():
    assert scalar.strip_prefix("X_pca") == "pca" and scalar.split_last("a.b.c") == ("a.b", "c")
    assert scalar.unique_name("x", "cells", {"x", "x.cells"}) == "x.cells2"
    assert scalar.modality_axis("RNA") == "genes" and scalar.state_by_name("scale.data") == "scaled"
