"""Secret scans through an incremental ledger of blobs.

Every version of every path is content-addressed; only pairs of a blob and a rule version that the ledger does
not hold are scanned, each blob's text once, and the ledger's findings are joined back to all paths. Everything
is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import SPAN, count_of, hex_sha256, in_order, pattern_spans, span_text, stored

LEDGER = f"blob string, rule string, version int, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """One kind of secret. A changed rule gets a higher ``version``, which makes every blob unseen for it."""

    kind: str
    rank: int
    version: int
    pattern: str
    gate: Callable[[Column], Column]
    keep: Callable[[Column], Column] | None = None


ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def _names_secret(text: Column) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        found = found | low.contains(word)
    return found


# The two run patterns hold their least length: a shorter run has no longer one inside it.
RULES = (
    Rule("assign", 1, 1, ASSIGN, _names_secret, lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= 12),
    Rule("access", 2, 1, "AKIA[A-Z0-9]{14,}", lambda t: t.contains("AKIA")),
    Rule("hex", 3, 1, "[0-9a-f]{16,}", lambda t: t.rlike("[0-9a-f]{16}")),
)


def create_ledger(spark: SparkSession, path: str) -> None:
    """An empty ledger at ``path``, a folder all executors share."""
    spark.createDataFrame([], LEDGER).write.parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(path)


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob): the content address of every version; a null text is an empty blob."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, holder, todo): blobs with rules not yet scanned, one path that holds the text, the kinds to scan."""
    pairs = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    blobs = paths.groupBy("blob").agg(F.min("path").alias("holder"))
    wanted = blobs.select("blob", "holder", F.inline(pairs))
    fresh = wanted.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
    return fresh.groupBy("blob", "holder").agg(F.collect_set("rule").alias("todo"))


def scan(versions: DataFrame, ledger_path: str, path: str = "path", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger up to date and returns (path, blob, spans), one row per row of ``versions``.

    The narrow (path, blob) table is grouped and compared with the ledger; texts are shuffled once, evenly,
    by the blob and path that hold them, and only holders of unseen blobs go on to be scanned. A run over
    known blobs scans nothing. Repeated rows share a blob; null paths are paths like others; null and empty
    texts have no findings; no rows give no rows. Other columns are ignored.
    """
    spark = versions.sparkSession
    paths = stored(addressed(versions, path, text), "secret-paths")
    todo = stored(unseen(paths, read_ledger(spark, ledger_path), rules), "secret-todo")
    texts = versions.select(
        F.col(path).alias("path"),
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("own"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    )
    holders = texts.join(todo, (texts["own"] == todo["blob"]) & texts["path"].eqNullSafe(todo["holder"]))
    scanned = holders.select(
        "blob",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(r.kind).alias("rule"),
                        F.lit(r.version).alias("version"),
                        F.when(
                            F.array_contains("todo", r.kind),
                            pattern_spans(F.col("body"), r.kind, r.rank, r.pattern, r.keep, r.gate(F.col("body"))),
                        ).alias("spans"),
                    )
                    for r in rules
                ]
            )
        ),
    )
    scanned = scanned.filter(F.col("spans").isNotNull()).dropDuplicates(["blob", "rule", "version"])
    scanned.write.mode("append").parquet(ledger_path)
    current = F.array(*[F.concat_ws("@", F.lit(r.kind), F.lit(r.version)) for r in rules])
    findings = (
        read_ledger(spark, ledger_path)
        .filter(F.array_contains(current, F.concat_ws("@", "rule", "version")) & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule", "version"])
        .groupBy("blob")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))  # one row per rule
    )
    findings = stored(findings, "secret-findings")  # a plain table, so that AQE can split a blob with many paths
    joined = paths.join(findings, "blob", "left")
    return joined.select("path", "blob", in_order(F.coalesce("spans", F.array().cast(SPAN))).alias("spans"))


def secret_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: ``scan`` of all documents under a fresh ledger.

    The ledger finds what the rules find and adds nothing, so ``spans`` are the base spans.
    """
    spark = docs.sparkSession
    ledger = scratch_path(spark, "secret-ledger")
    create_ledger(spark, ledger)
    found = scan(docs.select("doc_id", "text"), ledger, path="doc_id").withColumn("line", span_text(F.col("spans")))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count_of(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in RULES],
        hex_sha256(F.col("line")).alias("base_sha256"),
        F.col("line").alias("spans"),
    )
