"""The driver's tables seen as sequences, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col: str):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({col} AS timestamp_ntz))")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: seq_id, t, label, code, score, k, big, us."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    code = (F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("event_type")) - 1).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("seq_id"), t.alias("t"), F.col("event_type").alias("label"), code.alias("code"), F.col("value").alias("score"), k.alias("k"), F.floor(F.col("value") / 60).cast("int").alias("big"), micros("ts").alias("us"))


FRAMES = """frames AS (SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t,
 event_type AS label, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS code, value AS score,
 CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(floor(value / 60) AS INTEGER) AS big, epoch_us(ts) AS us FROM events)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intervals of months: seq_id, ann_id, start, end, action, part1, part2, object, target, event."""
    o = table(spark, sf_dir, "orders")
    start = F.expr("cast(floor(datediff(cast(o_orderdate AS date), DATE'1992-01-01') / 30) AS int)")
    return o.select(
        F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("ann_id"), start.alias("start"), (start + (F.col("o_orderkey") % 5).cast("int")).alias("end"),
        (F.col("o_orderkey") % 10).cast("int").alias("action"), (F.col("o_orderkey") % 7).cast("int").alias("part1"), (F.col("o_orderkey") % 5).cast("int").alias("part2"),
        (F.col("o_orderkey") % 7).cast("int").alias("object"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise((F.col("o_orderkey") % 4).cast("int")).alias("target"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("event"),
    )


ANN = """ann AS (SELECT *, start + CAST(ann_id % 5 AS INTEGER) AS "end" FROM (SELECT o_custkey AS seq_id, o_orderkey AS ann_id,
 CAST(floor(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 30) AS INTEGER) AS start, CAST(o_orderkey % 10 AS INTEGER) AS action,
 CAST(o_orderkey % 7 AS INTEGER) AS part1, CAST(o_orderkey % 5 AS INTEGER) AS part2, CAST(o_orderkey % 7 AS INTEGER) AS object,
 CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE CAST(o_orderkey % 4 AS INTEGER) END AS target, o_orderstatus || ' ' || o_orderpriority AS event FROM orders))"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that annotations are painted on: seq_id and t from 0 to the last end."""
    last = annotations(spark, sf_dir).groupBy("seq_id").agg(F.max("end").alias("_n"))
    return last.select("seq_id", F.explode(F.sequence(F.lit(0), "_n")).alias("t"))


MONTHS = """months AS (SELECT seq_id, CAST(unnest(range(0, n + 1)) AS INTEGER) AS t FROM (SELECT seq_id, max("end") AS n FROM ann GROUP BY 1))"""


def scores(spark: SparkSession, sf_dir: str, dim: int = 10) -> DataFrame:
    """Embeddings as class scores: seq_id, t, score (the first ``dim`` parts), label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 50").alias("seq_id"), (F.col("vec_id") % 50).cast("int").alias("t"), F.transform(F.slice("embedding", 1, dim), lambda x: x.cast("double")).alias("score"), "label")


SCORES = """scores AS (SELECT vec_id // 50 AS seq_id, CAST(vec_id % 50 AS INTEGER) AS t, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS score, label FROM embeddings)"""


def part_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as actions on parts: seq_id, step, part, op (1 connect, -1 disconnect, 0 pin)."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    op = F.when(F.col("l_returnflag") == "R", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    return li.select(F.col("l_orderkey").alias("seq_id"), (F.row_number().over(order) - 1).alias("step"), (F.col("l_partkey") % 8).cast("int").alias("part"), op.alias("op"))


PARTS = """acts AS (SELECT l_orderkey AS seq_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS INTEGER) AS step,
 CAST(l_partkey % 8 AS INTEGER) AS part, CASE l_returnflag WHEN 'R' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS op FROM lineitem)"""


def with_(*views: str) -> str:
    """The head of an oracle query over these views."""
    return "WITH " + ", ".join(views) + " "


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one signal a device: seq_id, device, t, value, us, k."""
    f = frames(spark, sf_dir)
    t = F.row_number().over(Window.partitionBy("seq_id", "code").orderBy("t")) - 1
    return f.select("seq_id", F.col("code").alias("device"), t.alias("t"), F.col("score").alias("value"), "us", "k")


SIGNAL = """sig AS (SELECT seq_id, code AS device, CAST(row_number() OVER (PARTITION BY seq_id, code ORDER BY t) - 1 AS INTEGER) AS t, score AS value, us, k FROM frames)"""
PAIRS = """pairs AS (SELECT a.seq_id, a.t, a.device AS d1, b.device AS d2, a.value AS a, b.value AS b FROM sig a JOIN sig b ON a.seq_id = b.seq_id AND a.t = b.t AND a.device > b.device)"""
