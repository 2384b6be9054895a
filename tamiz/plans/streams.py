"""Registered queries: streams over events written as files, client output, partition replacement, and SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tamiz.functions.register import register
from tamiz.operators import logs as L
from tamiz.operators import snapshot as N
from tamiz.plans.logs import _FULL, log_lines
from tamiz.session import durable, shared_folder, table
from tamiz.sources import text as A
from tamiz.sources.sinks import replace_partition
from tamiz.streaming import signatures as S


def _event_files(spark, folder):
    """Assembled log events as JSON files in the shared folder."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    events = L.assemble_events(log_lines(spark, folder)).where("stamp RLIKE '^[0-9]{4}-'")
    events.withColumn("ts", F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss"))).where("ts IS NOT NULL").write.json(f"{path}/in")
    return path


def _upserts(stream, path: str):
    """Run a stream until its input is read; every batch's rows lie under its number, so a repeated batch writes them over."""
    def write(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/batch={epoch}")
    S.start_upserts(stream, write, f"{path}/state").awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def stream_signatures(spark, folder):
    path = _event_files(spark, folder)
    # All files in one batch: the watermark only moves between batches, so no event is late.
    rows = _upserts(S.stream_signatures(S.read_event_stream(spark, f"{path}/in", 1_000_000)), path)
    return rows.groupBy("start", "hash").agg(F.max_by("count", "epoch").alias("events")).select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "hash", "events")


def stream_first_sight(spark, folder):
    path = _event_files(spark, folder)
    seen = S.first_sight(S.read_event_stream(spark, f"{path}/in", 1_000_000))
    seen.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{path}/out").groupBy("hash").agg(F.count("*").alias("sights"))


def stream_redact(spark, folder):
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("ERROR pedido 'P"), F.col("o_custkey").cast("string"), F.lit("' cliente 12345678Z")).alias("text")).write.parquet(f"{path}/in")
    texts = spark.readStream.schema("o_orderkey bigint, text string").parquet(f"{path}/in")
    S.stream_redact(texts).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("o_orderkey bigint, text string").parquet(f"{path}/out")


def result_text(spark, folder):
    """Client output of two kinds of files: unquoted with a row of dashes, and with columns in another order. Blank lines in between."""
    c = table(spark, folder, "customer")
    key = F.col("c_custkey").cast("string")
    file = F.concat(F.lit("out"), (F.col("c_custkey") % 7).cast("string"))
    odd = F.col("c_custkey") % 7 % 2 == 1
    body = c.select(file.alias("file"), (F.col("c_custkey") + 10).alias("line_no"), F.when(F.col("c_custkey") % 5 == 0, F.lit("   ")).otherwise(
        F.when(odd, F.concat(F.lit(" "), key, F.lit(" | "), F.col("c_name"))).otherwise(F.concat("c_name", F.lit("|"), key, F.lit("|"), "c_mktsegment"))).alias("text"))
    heads = c.select(file.alias("file"), odd.alias("odd")).distinct()
    head = heads.select("file", F.lit(2).cast("bigint").alias("line_no"), F.when(F.col("odd"), " ID | NAME").otherwise("NAME|ID|SEGMENT").alias("text"))
    dashes = heads.select("file", F.lit(3).cast("bigint").alias("line_no"), F.when(F.col("odd"), "----|------").otherwise("---|---|--").alias("text"))
    return A.parse_result_text(body.unionByName(head).unionByName(dashes), "|")


def result_text_quoted(spark, folder):
    c = table(spark, folder, "customer")
    body = c.select(F.lit("q").alias("file"), (F.col("c_custkey") + 1).alias("line_no"), F.concat(
        F.lit('"'), F.replace(F.col("c_name"), F.lit("#"), F.lit('""')), F.lit(', x",'), F.col("c_custkey").cast("string"), F.lit(',"--"')).alias("text"))
    head = spark.range(1).select(F.lit("q").alias("file"), F.col("id").alias("line_no"), F.lit('"NAME, FULL",ID,"D"').alias("text"))
    return A.parse_result_text(body.unionByName(head), ",", quoted=True)


def replace_partitions(spark, folder):
    """Orders by status, then those of status F replaced by their first tenth: the other partitions stay as they were."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    replace_partition(orders, path, "o_orderstatus")
    replace_partition(orders.where("o_orderstatus = 'F' AND o_custkey % 10 = 0"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy(F.col("o_orderstatus").cast("string").alias("status")).agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


def sql_functions(spark, folder):
    register(spark)
    words = table(spark, folder, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN concat('6', lpad(CAST(c_custkey AS STRING), 8, '0')) WHEN 1 THEN CAST(c_acctbal AS STRING) "
                                                        "WHEN 2 THEN concat('c', c_custkey, '@mail.es') ELSE c_name END AS v")
    durable(words).createOrReplaceTempView("sql_function_words")
    return spark.sql("SELECT detect_form(v) AS form, is_plain_number(v) AS plain, count(*) AS rows FROM sql_function_words GROUP BY ALL")


QUERIES = {
    "q_stream_signatures": stream_signatures, "q_stream_first_sight": stream_first_sight, "q_stream_redact": stream_redact, "q_result_text": result_text,
    "q_result_text_quoted": result_text_quoted, "q_replace_partitions": replace_partitions, "q_sql_functions": sql_functions,
}

_STAMPED = "regexp_matches(stamp, '^[0-9]{4}-') AND try_strptime(stamp, '%Y-%m-%d %H:%M:%S') IS NOT NULL"
ORACLE = {
    "q_stream_signatures": _FULL + f""" SELECT strftime(date_trunc('hour', try_strptime(stamp, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M:%S') AS start, hash, count(*) AS events
FROM sig WHERE {_STAMPED} GROUP BY 1, 2""",
    "q_stream_first_sight": _FULL + f" SELECT hash, 1::BIGINT AS sights FROM sig WHERE {_STAMPED} GROUP BY hash",
    "q_stream_redact": "SELECT o_orderkey, 'ERROR pedido ''<val>'' cliente [PII]' AS text FROM orders",
    "q_result_text": """WITH b AS (SELECT 'out' || c_custkey % 7 AS file, c_custkey + 10 AS row, c_custkey % 7 % 2 = 1 AS odd, * FROM customer WHERE c_custkey % 5 <> 0)
SELECT file, row, 'ID' AS "column", c_custkey::VARCHAR AS value FROM b UNION ALL SELECT file, row, 'NAME', c_name FROM b
UNION ALL SELECT file, row, 'SEGMENT', c_mktsegment FROM b WHERE NOT odd""",
    "q_result_text_quoted": """SELECT 'q' AS file, c_custkey + 1 AS row, 'NAME, FULL' AS "column", replace(c_name, '#', '"') || ', x' AS value FROM customer
UNION ALL SELECT 'q', c_custkey + 1, 'ID', c_custkey::VARCHAR FROM customer UNION ALL SELECT 'q', c_custkey + 1, 'D', '--' FROM customer""",
    "q_replace_partitions": """SELECT o_orderstatus AS status, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus <> 'F' OR o_custkey % 10 = 0 GROUP BY 1""",
    "q_sql_functions": """SELECT CASE c_custkey % 4 WHEN 0 THEN 'telefono' WHEN 2 THEN 'email' END AS form, c_custkey % 4 = 1 AS plain, count(*) AS rows FROM customer GROUP BY 1, 2""",
}
