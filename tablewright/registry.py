"""The algorithm catalogue: ids, tasks, required roles, parameter ranges, and one entry point to run them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .constants import MIN_CLUSTER_ROWS
from .errors import ParameterError, TableError
from .operators import anova, cluster_metrics, clustering, counting, density, hierarchy, hypothesis, neighbors, profiling, reduction, sequences, spectral, supervised
from .operators.preparation import FEATURES, fit_preparation, select_features
from .operators.shape import col, long_metrics, numeric_columns


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: str  # integer, number, boolean, select
    default: object
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Algorithm:
    id: str
    task: str
    parameters: tuple[Parameter, ...] = ()
    needs: tuple[str, ...] = ()


# --- fixed values: parameter defaults and ranges ---------------------------------------------------
TREES = Parameter("n_estimators", "integer", 200, 10, 2000)
DEPTH = Parameter("max_depth", "integer", 8, 1, 64)
BOOSTING = (
    Parameter("n_estimators", "integer", 300, 10, 3000),
    Parameter("max_depth", "integer", 6, 1, 32),
    Parameter("learning_rate", "number", 0.05, 0.001, 1.0),
    Parameter("subsample", "number", 0.8, 0.1, 1.0),
)
CLUSTERS = (Parameter("n_clusters", "integer", 3, 2, 100),)
DENSITY = (Parameter("eps", "number", 0.5, 0.01, 20.0), Parameter("min_samples", "integer", 5, 2, 500))
PENALTY = Parameter("alpha", "number", 1.0, 0.000001, 10000.0)
SEQUENCE = (
    Parameter("window_size", "integer", 12, 2, 512),
    Parameter("horizon", "integer", 1, 1, 128),
    Parameter("hidden_size", "integer", 32, 4, 1024),
    Parameter("num_layers", "integer", 1, 1, 8),
    Parameter("epochs", "integer", 30, 1, 1000),
    Parameter("batch_size", "integer", 32, 1, 4096),
    Parameter("learning_rate", "number", 0.001, 0.000001, 1.0),
)
FACTORIAL = (
    Parameter("sum_squares_type", "select", "2", options=("1", "2", "3")),
    Parameter("include_interactions", "boolean", True),
)
PARAMETERS: dict[str, tuple[Parameter, ...]] = {
    "decision_tree_classifier": (DEPTH,),
    "random_forest_classifier": (TREES, DEPTH),
    "extra_trees_classifier": (TREES, DEPTH),
    "xgboost_classifier": BOOSTING,
    "ridge_regression": (PENALTY,),
    "lasso_regressor": (PENALTY,),
    "elastic_net_regressor": (PENALTY, Parameter("l1_ratio", "number", 0.5, 0.0, 1.0)),
    "huber_regressor": (Parameter("epsilon", "number", 1.35, 1.01, 10.0),),
    "poisson_regressor": (PENALTY,),
    "quantile_regressor": (Parameter("quantile", "number", 0.5, 0.01, 0.99), Parameter("alpha", "number", 1.0, 0.0, 10000.0)),
    "decision_tree_regressor": (DEPTH,),
    "random_forest_regressor": (TREES, DEPTH),
    "extra_trees_regressor": (TREES, DEPTH),
    "xgboost_regressor": BOOSTING,
    "kmeans": CLUSTERS,
    "mini_batch_kmeans": CLUSTERS,
    "agglomerative": CLUSTERS,
    "birch": CLUSTERS,
    "spectral_clustering": CLUSTERS,
    "kmedoids": CLUSTERS,
    "fuzzy_cmeans": CLUSTERS,
    "dbscan": DENSITY,
    "optics": DENSITY,
    "hdbscan": (Parameter("min_cluster_size", "integer", 5, 2, 1000),),
    "gaussian_mixture": (Parameter("n_components", "integer", 3, 2, 100),),
    "factorial_anova": FACTORIAL,
    "one_sample_t_test": (Parameter("population_mean", "number", 0.0, -1_000_000.0, 1_000_000.0),),
}
# ---------------------------------------------------------------------------------------------------

CLUSTERING = (
    "kmeans", "mini_batch_kmeans", "agglomerative", "dbscan", "hdbscan", "gaussian_mixture", "birch", "optics", "spectral_clustering",
    "kmedoids", "fuzzy_cmeans",
)
TASKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "classification": (supervised.CLASSIFIERS, ("target",)),
    "regression": (supervised.REGRESSORS, ("target",)),
    "clustering": (CLUSTERING, ()),
    "anova": (("one_way_anova", "factorial_anova"), ("target", "factors")),
    "sequence_regression": (sequences.SEQUENCE_REGRESSORS, ("target", "time")),
    "sequence_classification": (sequences.SEQUENCE_CLASSIFIERS, ("target", "time")),
    "hypothesis_test": (("one_sample_t_test", "independent_t_test", "paired_t_test", "chi_square_test"), ()),
    "dimensionality_reduction": (("pca", "truncated_svd", "tsne", "umap"), ()),
    "exploration": (("missing_value_profile", "correlation_profile"), ()),
}
ALGORITHMS: dict[str, Algorithm] = {
    name: Algorithm(name, task, PARAMETERS.get(name, SEQUENCE if task.startswith("sequence") else ()), needs)
    for task, (names, needs) in TASKS.items()
    for name in names
}


def normalise_parameters(algorithm: str, supplied: Mapping[str, object]) -> dict[str, object]:
    """Defaults filled in, kinds and ranges checked, unknown names refused."""
    if algorithm not in ALGORITHMS:
        raise ParameterError(f"unknown algorithm: {algorithm}")
    known = {p.name: p for p in ALGORITHMS[algorithm].parameters}
    unknown = sorted(set(supplied) - set(known))
    if unknown:
        raise ParameterError(f"{algorithm} has no parameter {', '.join(unknown)}")
    result: dict[str, object] = {}
    for name, p in known.items():
        value = supplied.get(name, p.default)
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = {
            "integer": number and float(value).is_integer(),
            "number": number,
            "boolean": isinstance(value, bool),
            "select": str(value) in p.options,
        }[p.kind]
        if not fits:
            raise ParameterError(f"parameter {name} is not a valid {p.kind}", value=value)
        if number and not (p.low or float("-inf")) <= value <= (p.high if p.high is not None else float("inf")):
            raise ParameterError(f"parameter {name} must lie between {p.low} and {p.high}", value=value)
        result[name] = {"integer": lambda v: int(v), "number": lambda v: float(v), "select": str}.get(p.kind, lambda v: v)(value)
    return result


@dataclass
class Result:
    """Named tables of a run; ``metrics`` is (metric, value)."""

    algorithm: str
    metrics: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    model: object | None = None


def run(
    df: DataFrame,
    algorithm: str,
    *,
    key: Sequence[str],
    target: str | None = None,
    features: Sequence[str] = (),
    factors: Sequence[str] = (),
    time: str | None = None,
    group: str | None = None,
    parameters: Mapping[str, object] | None = None,
    validation_ratio: int = 20,
    seed: int = 42,
    pairwise_silhouette: bool = False,
) -> Result:
    """Runs a catalogued algorithm on a dataset. ``key`` names the columns that identify a row.

    ``pairwise_silhouette`` adds the plain silhouette, which compares every pair of rows, to a clustering's metrics.
    """
    p = normalise_parameters(algorithm, parameters or {})
    task = ALGORITHMS[algorithm].task
    roles = {"target": target, "factors": factors, "time": time}
    for role in ALGORITHMS[algorithm].needs:
        if not roles[role]:
            raise ParameterError(f"{algorithm} needs a {role} role")
    if not 10 <= validation_ratio <= 40:
        raise ParameterError("the validation ratio must lie between 10 and 40 percent")
    ratio = validation_ratio / 100
    if task in ("classification", "regression"):
        done = supervised.run_supervised(df, algorithm, target, key, features, [c for c in (time, group) if c], p, ratio, seed)
        return Result(algorithm, done.metrics, done.tables, model=done.model)
    if task.startswith("sequence"):
        chosen = list(features) or [c for c in df.columns if c not in {target, time, group, *key}]
        ties = [k for k in key if k not in (time, group)]
        done = sequences.run_sequence(df, algorithm, target, time, group, chosen, ties, p, ratio, seed)
        return Result(algorithm, done.metrics, done.tables, model=done.model)
    if task == "clustering":
        return _cluster(df, algorithm, key, select_features(df, features, {target, time, group, *key}), p, seed, pairwise_silhouette)
    if task == "anova":
        return _variance(df, algorithm, target, factors, p)
    if task == "hypothesis_test":
        return _hypothesis(df, algorithm, target, features, factors, key, p)
    return _explore(df, algorithm, key)


def _values(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in values.items()], "metric string, value double")


def _cluster(df: DataFrame, algorithm: str, key: Sequence[str], features: list[str], p: Mapping, seed: int, pairwise_silhouette: bool = False) -> Result:
    k = p.get("n_clusters", p.get("n_components"))
    needed = max(MIN_CLUSTER_ROWS, (k or 0) + 1)
    if df.limit(needed).count() < needed:
        raise TableError("too few rows for this clustering", needed=needed)
    rows, row_id = supervised.with_long_id(df, key)
    preparation = fit_preparation(rows, features)
    points = neighbors.as_points(preparation.transform(rows), row_id, FEATURES).persist()
    model = None
    if algorithm == "kmeans":
        model = clustering.fit_kmeans(points, k, seed)
        labels = clustering.predicted(model, points)
    elif algorithm == "gaussian_mixture":
        model = clustering.fit_gaussian_mixture(points, k, seed)
        labels = clustering.predicted(model, points)
    elif algorithm == "mini_batch_kmeans":
        model = clustering.mini_batch_kmeans(points, k, seed)
        labels = clustering.nearest_centre(points, model).select("id", "cluster")
    elif algorithm == "kmedoids":
        labels, model = clustering.kmedoids(points, k, seed)
    elif algorithm == "fuzzy_cmeans":
        labels, model = clustering.fuzzy_cmeans(points, k, seed)
    elif algorithm == "dbscan":
        labels = density.dbscan(points, p["eps"], p["min_samples"])
    elif algorithm == "hdbscan":
        labels = hierarchy.hdbscan(points, p["min_cluster_size"], seed)
    elif algorithm == "optics":
        labels = hierarchy.optics(points, p["min_samples"], seed)
    elif algorithm == "birch":
        labels = clustering.birch(points, k)
    elif algorithm == "spectral_clustering":
        labels = spectral.spectral(points, k, seed)
    else:
        labels = clustering.agglomerative(points, k, seed)
    labelled = clustering.cut_lineage(points.join(labels, "id").select("id", "x", "cluster"))
    points.unpersist()
    metrics, warnings = cluster_metrics.cluster_metrics(labelled, pairwise_silhouette)
    tables = {"cluster_summary": cluster_metrics.cluster_summary(labelled), "assignments": cluster_metrics.assignment_preview(labelled)}
    return Result(algorithm, _values(df, metrics), tables, warnings, (preparation, model))


def _variance(df: DataFrame, algorithm: str, target: str, factors: Sequence[str], p: Mapping) -> Result:
    if algorithm == "one_way_anova":
        if len(factors) != 1:
            raise ParameterError("the one-way analysis needs exactly one factor")
        table, fit = anova.one_way_anova(df, target, factors[0]), anova.one_way_fit(df, target, factors[0])
        tables = {"anova": table, "tukey": anova.tukey_hsd(df, target, factors[0])}
    else:
        table, fit = anova.factorial_anova(df, target, factors, p["sum_squares_type"], p["include_interactions"])
        tables = {"anova": table}
    tables["assumptions"] = anova.anova_assumptions(df, target, factors)
    return Result(algorithm, long_metrics(fit), tables)


def _hypothesis(df: DataFrame, algorithm: str, target: str | None, features: Sequence[str], factors: Sequence[str], key: Sequence[str], p: Mapping) -> Result:
    if algorithm == "chi_square_test":
        if len(factors) != 2 or not set(factors) <= set(df.columns):
            raise ParameterError("the chi-square test needs two existing factors")
        row = hypothesis.chi_square(df, *factors)
        metrics = row.select("statistic", "p_value", "degrees_of_freedom", "samples")
        return Result(algorithm, long_metrics(metrics), {"contingency": counting.contingency(df, *factors)})
    if not target or target not in df.columns:
        raise ParameterError("a t test needs a numeric target")
    if algorithm == "one_sample_t_test":
        row, groups = hypothesis.one_sample_t(df, target, p["population_mean"]), target
    elif algorithm == "independent_t_test":
        if len(factors) != 1 or factors[0] not in df.columns:
            raise ParameterError("the independent t test needs one grouping factor")
        row = hypothesis.independent_t(df, target, factors[0])
        groups = ", ".join(str(r[0]) for r in df.select(col(factors[0])).na.drop().distinct().orderBy(col(factors[0])).limit(2).collect())
    else:
        pair = [c for c in dict.fromkeys([target, *features]) if c in numeric_columns(df)][:2]
        if len(pair) == 2:
            row, groups = hypothesis.paired_t(df, *pair), ", ".join(pair)
        elif len(factors) == 1 and len(key) == 1:
            row, groups = hypothesis.paired_t_by_key(df, key[0], factors[0], target), factors[0]
        else:
            raise ParameterError("the paired t test needs a second numeric column, or a factor and a pair key")
    return Result(algorithm, long_metrics(row.select("statistic", "p_value", "samples")), {"summary": hypothesis.test_summary(df, target, groups)})


def _explore(df: DataFrame, algorithm: str, key: Sequence[str]) -> Result:
    if algorithm in ("missing_value_profile", "correlation_profile"):
        table = profiling.missing_profile(df) if algorithm.startswith("missing") else profiling.correlation_profile(df)
        columns = len(df.columns) if algorithm.startswith("missing") else len(numeric_columns(df))
        name = "missing_profile" if algorithm.startswith("missing") else "correlation"
        return Result(algorithm, _values(df, {"columns": columns, "rows": df.count()}), {name: table})
    rows, row_id = supervised.with_long_id(df, key)
    names = [c for c in numeric_columns(df) if c not in key]
    if algorithm in ("tsne", "umap"):
        # the distributed part of both methods is the exact neighbour graph; the layout step is not built
        graph = neighbors.neighbour_graph(neighbors.as_points(rows, row_id, names), 15)
        return Result(algorithm, _values(df, {"samples": df.count(), "features": len(names)}), {"neighbour_graph": graph}, ["no layout is computed"])
    reduce = reduction.pca if algorithm == "pca" else reduction.truncated_svd
    projected, metrics, _ = reduce(rows, row_id, names)
    return Result(algorithm, _values(df, metrics), {"embedding": reduction.embedding_preview(projected)})


__all__ = ["ALGORITHMS", "Algorithm", "Parameter", "Result", "normalise_parameters", "run"]
