"""Source and sink queries: given tables are written to scratch folders and come back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.convert import convert_strict
from ..sources import archives, datasets, delimited, files
from ..session import scratch_path
from .tables import table


def _charset_flag(spark):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def delimited_utf8(spark, sf):
    """Multi-line, quoted texts through a semicolon file."""
    path = scratch_path(spark, "turns")
    frame = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    frame.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    back = delimited.read_delimited(spark, path)
    types = {"conv_id": "integer", "turn": "integer", "role": "text", "text": "text"}
    return convert_strict(back, types)


def delimited_gb18030(spark, sf):
    """A tab file in GB18030 with Chinese headers and cells, found out by its bytes."""
    _charset_flag(spark)
    path = scratch_path(spark, "orders")
    frame = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("编号"), F.concat(F.lit("第 "), F.col("o_orderpriority"), F.lit(" 级")).alias("级别"), F.col("o_totalprice").alias("金额"),
        F.when(F.col("o_orderstatus") == "F", "是").otherwise("否").alias("完成"),
    )
    frame.write.option("header", True).option("sep", "\t").option("encoding", "GB18030").csv(path)
    back = delimited.read_delimited(spark, path)
    typed = convert_strict(back, {"编号": "integer", "级别": "text", "金额": "number", "完成": "boolean"})
    return typed.toDF("id", "level", "amount", "done")


def header_names(spark, sf):
    """Blank, padded and repeated headers; short and long rows."""
    path = scratch_path(spark, "headers")
    lines = table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(",", "s_suppkey", "s_name"))
        .when(F.col("s_suppkey") % 3 == 1, F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", F.lit("x"), F.lit("extra")))
        .otherwise(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey", F.lit("y"))).alias("value")
    )
    # one column whose name is the header line and whose values are whole lines, written unquoted
    writer = lines.toDF(" id ,name,,name").write.option("header", True).option("sep", "\u0001").option("quote", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return delimited.read_delimited(spark, path).toDF("id", "name", "third", "name_2")


def delimiter_detection(spark, sf):
    """Delimiter of three kinds of lines, one per status, with other candidates in the text."""
    o = table(spark, sf, "orders")
    comma = F.concat_ws(",", "o_orderkey", "o_custkey", "o_totalprice")
    semi = F.concat_ws(";", "o_orderkey", F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise("")), "o_custkey")
    bar = F.concat_ws("|", "o_orderkey", "o_custkey")
    lines = o.select(
        F.col("o_orderstatus").alias("path"), F.when(F.col("o_orderstatus") == "F", comma).when(F.col("o_orderstatus") == "O", semi).otherwise(bar).alias("line")
    )
    return delimited.delimiters(lines)


def charset_detection(spark, sf):
    """Files per detected charset for documents written in two encodings."""
    _charset_flag(spark)
    base = scratch_path(spark, "charsets")
    texts = table(spark, sf, "documents").select(F.concat(F.lit("文本 "), F.regexp_replace("text", r"[\r\n]", " ")).alias("value"))
    texts.write.option("encoding", "UTF-8").csv(f"{base}/a", escape='"')
    texts.write.option("encoding", "GB18030").csv(f"{base}/b", escape='"')
    found = files.charsets(spark, [f"{base}/a", f"{base}/b"])
    folder = F.element_at(F.split("path", "/"), -2)
    return found.select(folder.alias("folder"), "charset").distinct()


def archive_expansion(spark, sf):
    """Rows per unpacked member over all gzip files of a written table: their sum is the table."""
    path = scratch_path(spark, "packed")
    lines = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    lines.write.option("compression", "gzip").text(path)
    members = archives.expand_archives(spark, f"{path}/*.gz")
    rows = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))
    return members.agg(F.sum(rows).cast("long").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def asset_fingerprints(spark, sf):
    """The given table files themselves: name, size, media type and hash."""
    return files.fingerprints(spark, f"{sf}/*.parquet").select("name", "size", "media_type", "sha256")


def duplicate_assets(spark, sf):
    path = scratch_path(spark, "copies")
    rows = table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey")
    rows.write.parquet(f"{path}/a")
    rows.write.parquet(f"{path}/b")
    return files.duplicate_files(files.fingerprints(spark, [f"{path}/a/*.parquet", f"{path}/b/*.parquet"])).agg((F.min("copies") >= 2).alias("all_doubled"))


def text_import(spark, sf):
    path = scratch_path(spark, "notes")
    table(spark, sf, "pages").select("html").write.text(path)
    return files.text_assets(spark, path).agg(F.sum(F.regexp_count("text", F.lit("\n"))).cast("long").alias("lines"))


def dataset_versions(spark, sf):
    """Three stored versions of two sources and their history."""
    store = datasets.DatasetStore(spark, scratch_path(spark, "store"))
    customers = table(spark, sf, "customer")
    store.write(customers, "customer")
    store.write(customers.filter("c_acctbal > 0"), "customer")
    store.write(table(spark, sf, "nation"), "nation")
    return store.history().select("source", "version", "row_count")


def latest_dataset(spark, sf):
    store = datasets.DatasetStore(spark, scratch_path(spark, "latest"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    store.write(customers, "customer")
    store.write(customers.filter("c_acctbal > 0"), "customer")
    return store.load("customer")


def stored_results(spark, sf):
    """Result tables written per run and read back by run."""
    path = scratch_path(spark, "results")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    datasets.save_result(path, "run-1", {"status": counts})
    datasets.save_result(path, "run-2", {"status": counts.withColumn("orders", F.col("orders") * 2)})
    return spark.read.schema("o_orderstatus string, orders long, run_id string").json(f"{path}/status")


def exported_predictions(spark, sf):
    path = scratch_path(spark, "export")
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 200000).alias("predicted"))
    datasets.export_predictions(rows, path, as_csv=True)
    return spark.read.schema("o_orderkey long, predicted boolean").option("header", True).csv(path)


QUERIES = {
    f.__name__: f
    for f in (
        delimited_utf8, delimited_gb18030, header_names, delimiter_detection, charset_detection, archive_expansion, asset_fingerprints,
        duplicate_assets, text_import, dataset_versions, latest_dataset, stored_results, exported_predictions,
    )
}

ORACLES = {
    "delimited_utf8": "SELECT conv_id, turn, role, text FROM conversations",
    "delimited_gb18030": "SELECT o_orderkey AS id, '第 ' || o_orderpriority || ' 级' AS level, o_totalprice AS amount, o_orderstatus = 'F' AS done FROM orders",
    "header_names": """SELECT s_suppkey::VARCHAR AS id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::VARCHAR END AS third,
        CASE s_suppkey % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS name_2 FROM supplier""",
    "delimiter_detection": "SELECT DISTINCT o_orderstatus AS path, CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN ';' ELSE '|' END AS delimiter FROM orders",
    "charset_detection": "SELECT 'a' AS folder, 'UTF-8' AS charset UNION ALL SELECT 'b', 'GB18030'",
    "archive_expansion": "SELECT count(*) AS rows, 0::BIGINT AS errors FROM orders",
    "duplicate_assets": "SELECT true AS all_doubled",
    "text_import": "SELECT sum(length(html) - length(replace(html, chr(10), '')) + 1)::BIGINT AS lines FROM pages",
    "dataset_versions": """SELECT 'customer' AS source, 1::BIGINT AS version, count(*) AS row_count FROM customer
        UNION ALL SELECT 'customer', 2, count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'nation', 1, count(*) FROM nation""",
    "latest_dataset": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0",
    "stored_results": """SELECT o_orderstatus, count(*) AS orders, 'run-1' AS run_id FROM orders GROUP BY 1
        UNION ALL SELECT o_orderstatus, 2 * count(*), 'run-2' FROM orders GROUP BY 1""",
    "exported_predictions": "SELECT o_orderkey, o_totalprice > 200000 AS predicted FROM orders",
}
