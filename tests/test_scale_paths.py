"""The paths that large or skewed data takes, forced on small fixtures and checked by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import cluster_metrics, clustering, components, density, neighbors, ordering, quantiles, sequences, splitting

from . import fixtures


def points(spark, x):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(4)


def pairwise(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("copies", [False, True])
def test_narrowed_quantiles_equal_numpy(spark, copies):
    rng = np.random.default_rng(1)
    values = rng.normal(size=3000)
    if copies:  # one value holds a third of a group
        values[:1000] = 0.25
    groups = np.where(np.arange(3000) % 5 == 0, "small", "big")
    frame = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, values)], "g string, v double").repartition(4)
    found = quantiles.exact_quantiles(frame, ["v"], [0.1, 0.5, 0.93], by=["g"], builtin_rows=20).collect()
    assert len(found) == 6
    for row in found:
        assert row["value"] == pytest.approx(np.quantile(values[groups == row["g"]], row["prob"]), abs=1e-12)


def test_hot_series_windows_equal_plain_windows(spark):
    frame = fixtures.series(spark)
    args = (frame, "target_value", "timestamp", "series_id", ["signal", "temperature"])
    plain = sequences.sequence_data(*args).windows
    cut = sequences.sequence_data(*args, hot_rows=37).windows.select(*plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_row_index_is_complete_and_ordered(spark):
    frame = spark.range(2000).select((F.hash("id") % 50).alias("v"), "id").repartition(6)
    rows = ordering.add_row_index(frame, ["v", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(2000))
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)


def test_split_sizes_are_exact(spark):
    frame = spark.range(1037).withColumn("label", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))))
    assert splitting.random_split(frame, ["id"], 0.2, 1).filter("is_test").count() == 208
    assert splitting.stratified_split(frame, ["id"], "label", 0.2, 1).filter("is_test").count() == 208
    parts = {r["part"]: r["count"] for r in splitting.three_way_split(frame, ["id"], 0.1, 0.2, 1).groupBy("part").count().collect()}
    assert parts == {"test": 208, "validation": 104, "train": 725}


def test_neighbours_over_many_cells_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1.0, (150, 3)) for c in (-4, 0, 4)])
    x[100:220] = x[100]  # copies
    graph = neighbors.neighbour_graph(points(spark, x), 4, block_rows=16).toPandas()
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        want = np.lexsort((np.arange(len(x)), d[i]))[:4]
        got = graph[graph.query_id == i].sort_values("place").neighbour_id.to_numpy()
        assert (want == got).all(), i


def brute_dbscan(x, eps, m):
    near = pairwise(x) <= eps
    core = near.sum(1) >= m
    label, number = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], number
            while stack:
                u = stack.pop()
                if core[u]:
                    for v in np.flatnonzero(near[u] & (label < 0)):
                        label[v] = number
                        stack.append(v)
            number += 1
    return label


def test_dbscan_over_many_cells_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, (90, 2)) for c in ((-3, 0), (0, 0.5), (3, 0))] + [rng.uniform(-6, 6, (60, 2))])
    x[10:60] = x[10]
    found = density.dbscan(points(spark, x), 0.35, 5, block_rows=16).toPandas().sort_values("id").cluster.to_numpy()
    assert (found == brute_dbscan(x, 0.35, 5)).all()


def test_components_of_paths_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 301)]
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    expected = {n: 0 for n in range(41)} | {n: 100 for n in range(100, 160)} | {300: 300, 301: 300}
    assert {r["node"]: r["component"] for r in found} == expected


def test_medoid_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) ** 3
    x[:100] = x[0]
    distinct = density.distinct_points(points(spark, x)).withColumn("cluster", F.lit(0).cast("long"))
    found = clustering.exact_medoids(distinct, batch=8)[0]
    sums = pairwise(x).sum(1)
    assert pairwise(np.vstack([x, found[1]]))[-1, :-1].sum() == pytest.approx(sums.min(), rel=1e-12)


def test_pivot_cells_bound_the_driver(spark):
    cells = neighbors.choose_pivots(points(spark, np.random.default_rng(5).normal(size=(400, 2))), 400, 2)
    assert 1 < len(cells.points) <= neighbors.MAX_PIVOTS


def test_micro_clusters_keep_all_rows(spark):
    frame = neighbors.as_points(fixtures.blobs(spark), "id", ["feature_x", "feature_y"])
    labels = clustering.agglomerative(frame, 3, 42, limit=40)
    sizes = sorted(r["count"] for r in labels.groupBy("cluster").count().collect())
    assert sizes == [120, 120, 120]


def test_many_classes_keep_all_windows(spark):
    rows = [(i, "s", float(i % 7), f"class {i % 12_000}") for i in range(30_000)]
    frame = spark.createDataFrame(rows, "at long, series string, v double, name string").withColumn("t", F.timestamp_seconds("at"))
    data = sequences.sequence_data(frame, "name", "t", "series", ["v"], window=12, horizon=1, classification=True)
    assert len(data.labels) == 12_000 and data.labels == sorted(data.labels)
    assert data.windows.count() == 30_000 - 12
    assert data.windows.filter(F.element_at(F.array(F.lit(data.labels[77])), 1) == F.col("target")).select("label").distinct().first()[0] == 77.0


def test_birch_cells_at_fixed_width_in_many_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 12)) * 0.3 + np.repeat([[-9.0], [0.0], [9.0]], [600, 700, 700], axis=0)
    frame = points(spark, x)
    cells = {tuple(r["cell"]): r["weight"] for r in clustering.birch_cells(frame).collect()}
    keys, counts = np.unique(np.floor(x / 0.5).astype(int), axis=0, return_counts=True)
    assert cells == {tuple(k): c for k, c in zip(keys.tolist(), counts)} and len(cells) > 1000
    found = np.array([r["cluster"] for r in clustering.birch(frame, 3).orderBy("id").collect()])
    assert len({(a, b) for a, b in zip(found, np.repeat([0, 1, 2], [600, 700, 700]))}) == 3


def test_depth_beyond_the_limit_is_refused(spark):
    from tablewright import registry
    from tablewright.errors import ParameterError

    with pytest.raises(ParameterError, match="max_depth"):
        registry.run(fixtures.classification(spark), "decision_tree_classifier", key=["id"], target="target_class", parameters={"max_depth": 40})


def test_sliced_quantiles_keep_empty_columns_and_equal_the_builtin(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i % 3) if i % 3 else None, float(v), None) for i, v in enumerate(rng.integers(0, 40, 900) / 7)]
    frame = spark.createDataFrame(rows, "g int, v double, w double").repartition(5)
    for by in ([], ["g"]):
        found, plain = (
            {(r[by[0]] if by else 0, r["column"], r["prob"]): r["value"] for r in
             quantiles.exact_quantiles(frame, ["v", "w"], [0.0, 0.3, 0.5, 1.0], by=by, builtin_rows=n).collect()}
            for n in (10, 1000)
        )
        assert found == plain


def test_quantiles_above_the_builtin_bound_never_hold_a_group(spark):
    """No join by column name alone and no built-in percentile: both bring a whole column to one task."""
    frame = spark.range(quantiles.BUILTIN_ROWS + 1).select(F.col("id").cast("double").alias("v"))
    found = quantiles.exact_quantiles(frame, ["v"], [0.5])
    assert "percentile" not in found._jdf.queryExecution().toString()
    assert found.first()["value"] == quantiles.BUILTIN_ROWS / 2
    assert quantiles.BUILTIN_ROWS <= 200_000


def test_medoids_take_few_passes(spark, monkeypatch):
    """Tangents of the convex distance sum end the search after a few candidate batches."""
    x = np.random.default_rng(8).normal(size=(4000, 3))
    frame = points(spark, x).select("id", "x", F.lit(1).alias("weight"), F.lit(0).cast("long").alias("cluster")).persist()
    passes = []
    original = clustering.summed
    monkeypatch.setattr(clustering, "summed", lambda df, fold: passes.append(1) or original(df, fold))
    found = clustering.exact_medoids(frame, batch=16)
    assert found[0][0] == pairwise(x).sum(1).argmin()
    assert len(passes) <= 12


def test_long_neighbour_blocks_in_strips_equal_brute_force(spark, monkeypatch):
    """A row is shuffled once per block of the other side; strips keep the kernel's matrix small."""
    monkeypatch.setattr(neighbors, "STRIP_CELLS", 300)
    x = np.random.default_rng(9).integers(0, 6, (220, 2)).astype(float)
    sizes = []
    original = neighbors.block_join
    monkeypatch.setattr(neighbors, "block_join", lambda *a, **k: sizes.append(k.get("longer")) or original(*a, **k))
    graph = neighbors.neighbour_graph(points(spark, x), 3, block_rows=8).toPandas()
    assert sizes == [neighbors.KNN_BLOCKS]
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        got = graph[graph.query_id == i].sort_values("place").neighbour_id.to_numpy()
        assert (np.lexsort((np.arange(len(x)), d[i]))[:3] == got).all(), i


def test_rows_of_a_class_are_not_brought_together(spark):
    """The class cuts are broadcast: one task per class would read half of a table with two classes."""
    frame = spark.range(4000, numPartitions=6).withColumn("label", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    cut = splitting.stratified_split(frame, ["id"], "label", 0.2, 1)
    cut.collect()
    assert cut.rdd.getNumPartitions() == 6
    assert cut.groupBy(F.spark_partition_id()).count().count() == 6


def test_models_are_fitted_in_even_parts(spark):
    from tablewright import session

    one = spark.range(100_000, numPartitions=1)
    sizes = [len(part) for part in session.spread(one, 100_000, ["id"]).rdd.glom().collect()]
    assert len(sizes) == 5 and min(sizes) > 15_000
    assert session.spread(one.limit(50), 50, ["id"]).rdd.getNumPartitions() == 1
    assert session.slices_for(one, 40_000_000) == 80


def test_mixture_starts_share_even_parts(spark, monkeypatch):
    """A table of one row group is dealt over the cores, and a fit is left to keep its own vectors."""
    seen = []
    fit = clustering.GaussianMixture.fit

    def spy(self, data):
        seen.append((data.rdd.getNumPartitions(), data.storageLevel.useMemory))
        return fit(self, data)

    monkeypatch.setattr(clustering.GaussianMixture, "fit", spy)
    side = F.when(F.col("id") % 2 == 0, -4.0).otherwise(4.0)
    frame = spark.range(60_000, numPartitions=1).select("id", F.array(side + F.rand(1)).alias("x"))
    model = clustering.fit_gaussian_mixture(frame, 2, 1, starts=2)
    assert seen == [(3, False)] * 2
    sizes = clustering.predicted(model, frame).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [30_000, 30_000]


def brute_silhouette(x, label):
    d, scores = pairwise(x), []
    for i in np.flatnonzero(label >= 0):
        own = (label == label[i]).sum()
        b = min((d[i, label == c].mean() for c in np.unique(label[label >= 0]) if c != label[i]), default=np.nan)
        a = d[i, label == label[i]].sum() / (own - 1) if own > 1 else 0.0
        scores.append(0.0 if own == 1 or np.isnan(b) or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(scores)


@pytest.mark.parametrize("clusters", [1, 3, 90])
def test_silhouette_in_blocks_equals_brute_force(spark, monkeypatch, clusters):
    """Tiles far from the origin, with copies, noise and single rows; a task gives few values per row."""
    monkeypatch.setattr(cluster_metrics, "TILE_ROWS", 7)
    monkeypatch.setattr(cluster_metrics, "TILE_COLUMNS", 11)
    rng = np.random.default_rng(4)
    label = rng.integers(-1, clusters, 240)
    x = 1e6 + rng.normal(size=(240, 3)) + 2.0 * label[:, None] / clusters
    x[20:40], label[20:40] = x[20], label[20]
    x[50:55] = x[20]  # the same place under other labels
    x[60] = x[61] + 1e-9
    rows = spark.createDataFrame([(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, label))], "id long, x array<double>, cluster long")
    found = cluster_metrics.silhouette(rows, block_rows=4).first()["silhouette"]
    assert found == pytest.approx(brute_silhouette(x, label), abs=1e-9)


def test_silhouette_blocks_return_few_values_a_row():
    """Clusters that lie whole in a block give one smallest mean, however many there are."""
    import pandas as pd

    n = 300
    x = np.random.default_rng(5).normal(size=(n, 2))
    rows = pd.DataFrame({"id": np.arange(n), "cluster": np.arange(n) // 2, "weight": 1, "n": 2, "members": 2})
    assert len(cluster_metrics._cluster_sums(rows, rows, x, x)) == 2 * n


@pytest.mark.parametrize("columns", [1, 2, 3])
def test_dbscan_in_few_columns_compares_no_blocks(spark, monkeypatch, columns):
    """Dense cells, chains, copies and border rows on the grid, without any block of pairs."""
    monkeypatch.setattr(density, "block_join", lambda *a, **k: pytest.fail("blocks of pairs"))
    rng = np.random.default_rng(columns)
    x = np.vstack([rng.normal(0, 0.2, (80, columns)), rng.uniform(-3, 3, (120, columns)), np.round(rng.uniform(-3, 3, (60, columns)) * 4) / 4])
    x[100:104] = x[100]
    for eps, m in ((0.25, 3), (0.5, 6)):
        found = density.dbscan(points(spark, x), eps, m).toPandas().sort_values("id").cluster.to_numpy()
        assert (found == brute_dbscan(x, eps, m)).all()


def test_dbscan_in_many_columns_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.4, (60, 5)) for c in (-1, 1)])
    found = density.dbscan(points(spark, x), 0.9, 4, block_rows=16).toPandas().sort_values("id").cluster.to_numpy()
    assert (found == brute_dbscan(x, 0.9, 4)).all()


def test_boxes_keep_the_nearest_rows_and_ties():
    """The boxes of a block leave out most pairs of a plane, but no near row, tie or copy; in many columns they give way."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.integers(0, 60, (3000, 2)).astype(float), rng.normal(20, 0.01, (900, 2)), np.full((100, 2), 7.0)])
    found = neighbors._near_boxes(x, x, 6)
    assert found is not None and sorted(np.concatenate([own for own, _ in found])) == list(range(len(x)))
    assert sum(len(own) * len(other) for own, other in found) < len(x) ** 2 / 3
    for own, other in found:
        d = neighbors.distances(x[own], x)
        limit = np.partition(d, 5, axis=1)[:, 5]
        assert set(np.nonzero(d <= limit[:, None])[1]) <= set(other)
    assert neighbors._near_boxes(rng.normal(size=(600, 40)), rng.normal(size=(600, 40)), 6) is None


def test_nearest_rows_of_a_plane_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.integers(0, 40, (900, 2)) / 4.0, rng.normal(3, 0.01, (300, 2))])
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), n + 1) for i, row in enumerate(d) for n, j in enumerate(np.lexsort((np.arange(len(row)), row))[:4])}
    got = {(r.query_id, r.neighbour_id, r.place) for r in neighbors.neighbour_graph(points, 4).collect()}
    assert got == want


def _coarse_rows(spark, rows=400):
    """Features of few values, so that any binning keeps all of them, and a label without equal gains."""
    rng = np.random.default_rng(5)
    x = np.c_[rng.integers(0, 20, rows), rng.integers(0, 12, rows), rng.integers(0, 2, rows)].astype(float)
    y = 3.0 * x[:, 0] - x[:, 1] ** 2 / 3 + 7.0 * x[:, 2] * (x[:, 0] > 8) + rng.normal(0, 0.5, rows)
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")


def test_a_tree_over_cells_equals_the_builtin_tree(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    from tablewright.operators.forest import fit_forest

    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(_coarse_rows(spark)).withColumnRenamed("y", "label").repartition(3)
    facts = train.selectExpr("avg(label) AS m", "stddev_pop(label) AS s").first()
    grown = fit_forest(train, ["id"], 3, 400, facts["m"], facts["s"], trees=1, max_depth=5, bootstrap=False)
    builtin = DecisionTreeRegressor(maxDepth=5, maxBins=64).fit(train)
    answers = [[r[0] for r in m.transform(train).orderBy("id").select("prediction").collect()] for m in (grown, builtin)]
    assert np.allclose(*answers)
    assert np.allclose(grown.featureImportances.toArray(), builtin.featureImportances.toArray())


def test_large_forests_are_grown_over_cells(spark, monkeypatch, tmp_path):
    """No built-in forest, the same trees whatever the parts, as good as the built-in ones."""
    from tablewright.operators import forest, supervised

    frame = _coarse_rows(spark)
    run = lambda f: supervised.run_supervised(f, "random_forest_regressor", "y", ["id"], parameters={"n_estimators": 30, "max_depth": 6})
    builtin = {r["metric"]: r["value"] for r in run(frame).metrics.collect()}
    monkeypatch.setattr(supervised, "FOREST_ROWS", 100)
    monkeypatch.setattr(supervised, "RandomForestRegressor", None)
    done = run(frame)
    found = {r["metric"]: r["value"] for r in done.metrics.collect()}
    assert found["r2"] > 0.95 and abs(found["r2"] - builtin["r2"]) < 0.02
    assert done.tables["feature_importance"].count() == 3
    monkeypatch.setattr(forest, "PART_ROWS", 70)
    again = run(frame.repartition(5))
    rows = [{r["event"]: r["p"] for r in d.predictions.selectExpr("id AS event", "predicted AS p").collect()} for d in (done, again)]
    assert rows[0].keys() == rows[1].keys() and max(abs(rows[0][k] - rows[1][k]) for k in rows[0]) < 1e-9
    done.model.save(str(tmp_path / "forest"), spark)
    loaded = supervised.FittedModel.load(str(tmp_path / "forest"), spark)
    assert {r[0]: r[1] for r in loaded.predict(frame).select("id", "predicted").collect()}.items() >= rows[0].items()


def _loss(rows, weights, intercept, binary, sigma=None):
    """The loss of a kernel machine as it is written down: every row's, and half the squared standardised weights over the rows."""
    z, y = np.array([r["kernel_features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    value, size = z @ weights + intercept, weights * z.std(axis=0, ddof=1)
    if binary:
        return np.maximum(0.0, 1.0 - (2 * y - 1) * value).mean() + size @ size / (2 * len(y))
    r = np.abs(value - y) / sigma
    return (np.where(r <= 1.35, 1 + r * r, 1 + 2.7 * r - 1.35**2) * sigma).mean() / 2 + size @ size / (2 * len(y))


@pytest.mark.parametrize("binary", [True, False])
def test_kernel_machines_reach_the_loss_of_the_builtin_ones(spark, binary):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tablewright.operators.kernel import fit_kernel_machine
    from tablewright.operators.learners import FourierFeatures

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + rng.standard_t(2, 600) * 0.2
    y = (y > 0).astype(float) if binary else 50 + 9 * y
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, label double").repartition(3)
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame).persist()
    kernel = FourierFeatures(size=40, inputs=3, gamma=0.5, seed=7)
    lifted = kernel.transform(train).select("features", "kernel_features", "label").persist()
    rows = lifted.collect()
    found = fit_kernel_machine(train, kernel, 600, float(y.mean()), float(y.std()), binary)
    weights, intercept = found.floats("weights"), found.getOrDefault("intercept")
    if binary:
        builtin = LinearSVC(featuresCol="kernel_features", regParam=1 / 600, maxIter=60, tol=1e-4).fit(lifted)
        ours, theirs = _loss(rows, weights, intercept, True), _loss(rows, builtin.coefficients.toArray(), builtin.intercept, True)
    else:
        builtin = LinearRegression(featuresCol="kernel_features", loss="huber", epsilon=1.35, regParam=1 / 600, maxIter=2000, tol=1e-9).fit(lifted)
        scales = builtin.scale * np.linspace(0.9, 1.1, 81)
        ours = min(_loss(rows, weights, intercept, False, s) for s in scales)
        theirs = _loss(rows, builtin.coefficients.toArray(), builtin.intercept, False, builtin.scale)
    assert ours <= theirs * 1.005
    value = np.array([r["kernel_features"].toArray() for r in rows]) @ weights + intercept
    scored = np.array([r[0] for r in found.transform(lifted).select("prediction").collect()])
    assert (scored == (value > 0)).mean() > 0.99 if binary else np.allclose(scored, value, atol=1e-3)


@pytest.mark.parametrize("algorithm", ["svm_classifier", "svm_regressor"])
def test_large_kernel_machines_keep_no_lifted_rows(spark, monkeypatch, tmp_path, algorithm):
    from tablewright.operators import supervised

    binary = algorithm == "svm_classifier"
    frame = _coarse_rows(spark).selectExpr("id", "a", "b", "c", "IF(y > 15, 'high', 'low') AS t" if binary else "y AS t")
    monkeypatch.setattr(supervised, "KERNEL_ROWS", 100)
    for name in ("LinearSVC", "LinearRegression"):
        monkeypatch.setattr(supervised, name, None)
    done = supervised.run_supervised(frame, algorithm, "t", ["id"])
    found = {r["metric"]: r["value"] for r in done.metrics.collect()}
    assert found["accuracy"] > 0.9 if binary else found["r2"] > 0.95
    done.model.save(str(tmp_path / "machine"), spark)
    loaded = supervised.FittedModel.load(str(tmp_path / "machine"), spark)
    again = {r[0]: r[1] for r in loaded.predict(frame).select("id", "predicted").collect()}
    same = (lambda a, b: a == b) if binary else (lambda a, b: abs(a - b) < 1e-4)
    assert all(same(again[r["id"]], r["predicted"]) for r in done.predictions.collect())
