"""Quality rules: text statistics and robust multivariate outliers per language and source.

The statistics of a document are transformed, and every (lang, source) gets a minimum-covariance-determinant
estimate of their centre and scatter. Three deterministic starts (quartile ranges alone, with correlations of
clipped values, with correlations of directions) go through concentration steps: the rows nearest to the present
centre, three quarters of the group, give the next centre and scatter, until no determinant falls any more. The
estimate of the smallest determinant counts. Rows whose Mahalanobis distance passes a chi-square limit, corrected
for the rows behind the estimate, are rejected. Groups of few rows are pooled, first within their language.

Everything is DataFrame expressions. The transformed statistics are whole numbers (1/1024 units), so their sums are
exact and repeatable; nearest rows are found by counts of narrow distance bins, of which the last one is weighted
so that exactly three quarters count. A group never meets in one task: what is shuffled are counts and sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CHARACTERS, BLANKS, once, stored

WINDOW_WORDS = 8
SYMBOLS = "#*$%&|<>"
UNITS = 1024
NEAREST_SHARE = 0.75
STEPS = 8
# Fall of the logarithm of a determinant below which the steps of all groups end.
LEAST_FALL = 0.01
BINS_PER_DOUBLING = 1024
# Share of normal rows beyond the limit, as the normal quantile of its complement (one row in 10^7).
LIMIT_QUANTILE = 5.199
# Rows below which a group is pooled with the other small ones of its language, and those with each other.
LEAST_ROWS = 25
NAMES = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeats"]
STARTS = 3
GROUP = ["lang", "source"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five base counts and ``base_failed``. Texts are read whole; a null text has no words.

    Repeated eight-word windows are found among 64-bit window hashes of the same text.
    """
    kept = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"[{BLANKS}]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    n = F.size("__words")
    windows = F.when(
        n >= WINDOW_WORDS,
        once(
            F.transform("__words", lambda w: F.xxhash64(w)),
            lambda hashes: F.transform(
                F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW_WORDS)))
            ),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = F.when(
        F.size(F.array_distinct("__windows")) < F.size("__windows"),
        F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    twice = F.filter(
        "__placed",
        lambda x, i: ((i > 0) & (F.get("__placed", i - 1)["h"] == x["h"]))
        | F.coalesce(F.get("__placed", i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.aggregate(
        F.array_sort(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")),
        lambda state, at: F.struct(
            (at + WINDOW_WORDS).alias("upto"),
            (state["total"] + at + WINDOW_WORDS - F.greatest(state["upto"], at)).alias("total"),
        ),
        lambda state: state["total"],
    )
    return (
        docs.withColumn("__words", words)
        .withColumn("__lines", lines)
        .withColumn("__windows", windows)
        .withColumn("__placed", placed)
        .select(
            *[F.col(f"`{c}`") for c in kept if c not in (*BASE, "base_failed")],
            F.inline(  # a generator: later filters on the counts are not pushed below it, which would work them out again
                F.array(
                    F.struct(
                        n.cast("long").alias("n_words"),
                        F.length(_removed(body, BLANK_CHARACTERS)).cast("long").alias("word_chars"),
                        (F.length(body) - F.length(_removed(body, SYMBOLS))).cast("long").alias("n_symbols"),
                        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                        covered.cast("long").alias("n_repeat_words"),
                    )
                )
            ),
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def transformed() -> dict[str, Column]:
    """The statistic vector in whole 1/1024 units: log of words, log of mean word length, roots of the shares
    of symbols, repeated lines (log) and repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = (
        F.log1p(F.col("n_words").cast("double")),
        F.log(chars / words),
        F.sqrt(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.col("n_repeat_words") / words,
    )
    return {name: F.floor(value * UNITS + 0.5).cast("long") for name, value in zip(NAMES, values)}


def _chi_square_cdf(x: float, degrees: int) -> float:
    term = total = 1.0 / (degrees / 2.0)
    for i in range(1, 400):
        term *= (x / 2.0) / (degrees / 2.0 + i)
        total += term
    return total * math.exp(-x / 2.0 + degrees / 2.0 * math.log(x / 2.0) - math.lgamma(degrees / 2.0))


def consistency(share: float = NEAREST_SHARE, degrees: int = len(NAMES)) -> float:
    """Factor that makes the scatter of the nearest share of a normal sample that of the whole."""
    low, high = 1e-6, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square_cdf(middle, degrees) < share else (low, middle)
    return share / _chi_square_cdf(low, degrees + 2)


def resolution(medians: list[Column]) -> list[Column]:
    """Change of each statistic of the median document by its smallest event, in units: one word, one word of twice the length, one
    symbol, one repeated line, one repeated window. A statistic is not taken to vary less than that."""
    words = F.greatest(F.expm1(medians[0] / UNITS), F.lit(1.0))
    chars = F.greatest(words * F.exp(medians[1] / UNITS), F.lit(1.0))
    events = [1.0 / words, 1.0 / words, F.sqrt(1.0 / chars), F.lit(math.log(2.0)), F.least(2.0 * WINDOW_WORDS / words, F.lit(1.0))]
    return [F.greatest(event * UNITS, F.lit(1.0)) for event in events]


def _inverted(scatter: DataFrame, kept: list[str]) -> DataFrame:
    """kept, m_i, the precision p_i_j and the logarithm of the determinant, from the scatter s_i_j and the smallest
    deviations f_i, by a Cholesky factor in plain columns. A variance below f_i squared is raised to it; the one unit
    squared that is added to all keeps statistics that depend on each other apart."""
    d = len(NAMES)
    scatter = scatter.withColumns({f"s_{i}_{i}": F.greatest(F.col(f"s_{i}_{i}"), F.col(f"f_{i}") * F.col(f"f_{i}")) + 1.0 for i in range(d)})
    for j in range(d):
        pivot = F.col(f"s_{j}_{j}")
        for k in range(j):
            pivot = pivot - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        scatter = scatter.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(0.5))))
        below = {}
        for i in range(j + 1, d):
            value = F.col(f"s_{i}_{j}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = value / F.col(f"l_{j}_{j}")
        if below:
            scatter = scatter.withColumns(below)
    for j in range(d):  # columns of the inverse of the factor
        scatter = scatter.withColumn(f"v_{j}_{j}", 1.0 / F.col(f"l_{j}_{j}"))
        for i in range(j + 1, d):
            value = F.lit(0.0)
            for k in range(j, i):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}")
            scatter = scatter.withColumn(f"v_{i}_{j}", value / F.col(f"l_{i}_{i}"))
    precision = []
    for i in range(d):
        for j in range(i + 1):
            value = F.lit(0.0)
            for k in range(i, d):
                value = value + F.col(f"v_{k}_{i}") * F.col(f"v_{k}_{j}")
            precision.append(value.alias(f"p_{i}_{j}"))
    size = F.lit(0.0)
    for j in range(d):
        size = size + 2.0 * F.log(F.col(f"l_{j}_{j}"))
    return scatter.select(*kept, *[f"m_{i}" for i in range(d)], *precision, size.alias("log_determinant"))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with an estimate."""
    total = F.lit(0.0)
    for i in range(len(NAMES)):
        for j in range(i + 1):
            product = F.col(f"p_{i}_{j}") * (F.col(NAMES[i]) - F.col(f"m_{i}")) * (F.col(NAMES[j]) - F.col(f"m_{j}"))
            total = total + (product if i == j else product * 2.0)
    return total


def distance_limit(rows: Column) -> Column:
    """Limit of the squared distance from an estimate out of so many rows: d (m + 1)(m - 1) / (m (m - d)) times the
    quantile of F with d and m - d degrees (Paulson's approximation), which tends to the chi-square quantile."""
    d, z = len(NAMES), LIMIT_QUANTILE
    m = F.greatest(rows.cast("double"), F.lit(d + 10.0))
    a, b = 2.0 / (9.0 * d), 2.0 / (9.0 * (m - d))
    root = F.sqrt((1 - a) ** 2 * b + a * (1 - b) * (1 - b) - a * b * z * z)
    t = F.greatest(((1 - a) * (1 - b) + z * root) / ((1 - b) * (1 - b) - b * z * z), F.lit(0.0))
    return d * (m + 1) * (m - 1) / (m * (m - d)) * t * t * t


def with_estimate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimate of their language and source; the stored estimate table is broadcast only if
    Spark finds it small, otherwise it is an equi-join whose hot keys AQE splits."""
    return rows.join(
        estimates, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left"
    )


def pools(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(g_lang, g_source, pool): a group of its own, or the small groups of a language, or those of all small languages."""
    groups = rows.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "quality-groups")
    small = groups.filter(F.col("n") < least_rows)
    languages = small.groupBy(F.col("g_lang").alias("p_lang")).agg(F.sum("n").alias("together"))
    joined = groups.join(languages, F.col("g_lang").eqNullSafe(F.col("p_lang")), "left")
    lang, source = [F.col("g_lang").isNull(), "g_lang"], [F.col("g_source").isNull(), "g_source"]
    pool = (
        F.when(F.col("n") >= least_rows, F.xxhash64(F.lit(0), *lang, *source))
        .when(F.col("together") >= least_rows, F.xxhash64(F.lit(1), *lang))
        .otherwise(F.xxhash64(F.lit(2)))
    )
    return joined.select("g_lang", "g_source", pool.alias("pool"))


def _starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The estimates (pool, start, m_i, p_i_j, log_determinant) that the steps begin with, and (pool, rows, f_i)."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    quartiles = rows.groupBy("pool").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}") for i, name in enumerate(NAMES)],
    )
    floors = resolution([F.col(f"q_{i}")[1] for i in range(d)])
    spread = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, floors[i]) for i in range(d)]
    middle = stored(
        quartiles.select(
            "pool", "rows", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(d)],
            *[spread[i].alias(f"w_{i}") for i in range(d)], *[floors[i].alias(f"f_{i}") for i in range(d)],
        ),
        "quality-middle",
    )
    z = {f"z_{i}": (F.col(name) - F.col(f"m_{i}")) / F.col(f"w_{i}") for i, name in enumerate(NAMES)}
    length = F.lit(0.0)
    for name in z:
        length = length + F.col(name) * F.col(name)
    scaled = rows.join(middle, "pool").withColumns(z).withColumn("length", F.sqrt(length))
    whole = {f"t_{i}": F.floor(F.tanh(f"z_{i}") * UNITS + 0.5).cast("long") for i in range(d)}
    whole |= {f"u_{i}": F.when(F.col("length") > 0, F.floor(F.col(f"z_{i}") / F.col("length") * UNITS + 0.5)).otherwise(0).cast("long") for i in range(d)}
    sums = (
        scaled.withColumns(whole)
        .groupBy("pool")
        .agg(*[F.sum(F.col(f"{c}_{i}") * F.col(f"{c}_{j}")).alias(f"{c}_{i}_{j}") for c in ("t", "u") for i, j in pairs])
    )
    made = middle.join(sums, "pool").withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))

    def correlation(c: str, i: int, j: int) -> Column:
        size = F.sqrt(F.col(f"{c}_{i}_{i}").cast("double")) * F.sqrt(F.col(f"{c}_{j}_{j}").cast("double"))
        return F.when(size > 0, F.col(f"{c}_{i}_{j}") / size).otherwise(0.0)

    scatter = {}
    for i, j in pairs:
        both = F.when(F.col("start") == 1, correlation("t", i, j)).when(F.col("start") == 2, correlation("u", i, j)).otherwise(0.0)
        scatter[f"s_{i}_{j}"] = F.col(f"w_{i}") * F.col(f"w_{j}") * (F.lit(1.0) if i == j else both)
    estimates = stored(_inverted(made.withColumns(scatter), ["pool", "start"]), "quality-start")
    return estimates, middle.select("pool", "rows", *[f"f_{i}" for i in range(d)])


def _concentrated(rows: DataFrame, estimates: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next estimate of every pool and start from the share of rows nearest to the present one."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    need = F.ceil(F.col("rows") * NEAREST_SHARE)
    near = F.floor(F.log2(1.0 + F.greatest(distance(), F.lit(0.0))) * BINS_PER_DOUBLING)
    placed = rows.join(estimates, "pool").select("pool", "start", *NAMES, near.alias("bin"))
    upto = Window.partitionBy("pool", "start").orderBy("bin")
    counts = placed.groupBy("pool", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    last = (
        counts.withColumn("upto", F.sum("n").over(upto)).join(sizes, "pool")
        .filter((F.col("upto") >= need) & (F.col("upto") - F.col("n") < need))
        .withColumn("part", (need - (F.col("upto") - F.col("n"))) / F.col("n"))
        .select("pool", "start", "rows", "part", F.col("bin").alias("last"), *[f"f_{i}" for i in range(d)])
    )
    last = stored(last, "quality-last-bin")
    values = {f"a_{i}": F.col(name) for i, name in enumerate(NAMES)}
    values |= {f"b_{i}_{j}": F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in pairs}
    edge = (F.col("bin") == F.col("last")).alias("edge")
    sums = (
        placed.join(last.select("pool", "start", "last"), ["pool", "start"])
        .filter("bin <= last")
        .groupBy("pool", "start", edge)
        .agg(*[F.sum(value).alias(name) for name, value in values.items()])
    )
    part = F.when(F.col("edge"), F.col("part")).otherwise(1.0)
    whole = sums.join(last, ["pool", "start"]).groupBy("pool", "start").agg(
        F.first("rows").alias("rows"), *[F.first(f"f_{i}").alias(f"f_{i}") for i in range(d)],
        *[F.sum(F.col(name) * part).alias(name) for name in values],
    )
    centre = {f"m_{i}": F.col(f"a_{i}") / need for i in range(d)}
    scatter = {f"s_{i}_{j}": consistency() * (F.col(f"b_{i}_{j}") / need - F.col(f"m_{i}") * F.col(f"m_{j}")) for i, j in pairs}
    return stored(_inverted(whole.withColumns(centre).withColumns(scatter), ["pool", "start"]), "quality-step")


def fit(statistics: DataFrame, steps: int = STEPS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Estimates (g_lang, g_source, m_i, p_i_j, log_determinant, limit) from rows with ``lang``, ``source`` and the
    base counts.

    Rows that fail the base rules take no part. Groups of fewer than ``least_rows`` rows share the estimate of
    their pool; one that is still smaller has none, and its documents are judged by the base rules alone.
    """
    passing = statistics.filter(~F.col("base_failed")).select(*GROUP, *[c.alias(k) for k, c in transformed().items()])
    places = stored(pools(passing, least_rows), "quality-pools")
    rows = stored(with_estimate(passing, places).select("pool", *NAMES), "quality-values")
    estimates, sizes = _starts(rows)
    sizes = sizes.filter(F.col("rows") >= least_rows)
    found = estimates if steps == 0 else None
    for step in range(steps):
        before, estimates = estimates, _concentrated(rows, estimates, sizes)
        found = estimates if found is None else found.unionByName(estimates)
        if step:
            old = before.select("pool", "start", F.col("log_determinant").alias("old"))
            if estimates.join(old, ["pool", "start"]).filter(F.col("old") - F.col("log_determinant") > LEAST_FALL).isEmpty():
                break
    order = F.struct("log_determinant", "start", *[c for c in found.columns if c[:2] in ("m_", "p_")])
    best = found.groupBy("pool").agg(F.min(order).alias("best")).join(sizes.select("pool", "rows"), "pool")
    limit = distance_limit(F.ceil(F.col("rows") * NEAREST_SHARE)).alias("limit")
    return stored(places.join(best.select("pool", "best.*", limit), "pool").drop("pool", "start"), "quality-estimates")


def judged(statistics: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds ``distance`` (double, null without an estimate) and ``kept`` to rows with the base counts."""
    names = transformed()
    scored = with_estimate(statistics.withColumns(names), estimates).withColumn("distance", distance())
    outlier = F.coalesce(F.col("distance") > F.col("limit"), F.lit(False))
    dropped = [*names, *[c for c in estimates.columns]]
    return scored.withColumn("kept", ~F.col("base_failed") & ~outlier).drop(*dropped)


def quality_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance, one row per row of ``docs``.

    Null, empty and blank texts have no words and fail the base rule. Null languages or sources form their
    own groups. Repeated rows are judged alike, rows of equal distance weigh the same. No rows give no rows. Columns other than
    doc_id, text, lang and source are ignored.
    """
    narrow = docs.select("doc_id", "text", *GROUP)
    statistics = stored(with_statistics(narrow).drop("text"), "quality-statistics")
    return judged(statistics, fit(statistics)).select("doc_id", *BASE, "base_failed", "kept", "distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``: the verdict is worked out in the row,
    so texts are not shuffled and repeated ids do not matter."""
    narrow = docs.select("text", *GROUP)
    estimates = fit(stored(with_statistics(narrow).drop("text"), "quality-statistics"))
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(c).alias(c) for c in ("text", *GROUP)]
    )
    passed = judged(with_statistics(inner), estimates).filter("kept")
    return passed.select(*[F.col(n).alias(c) for c, n in names.items()])
