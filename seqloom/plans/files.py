"""Registered queries: readers of text formats (A), on files that Spark writes from the driver's tables to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.inputs import table
from seqloom.plans.registry import query
from seqloom.sources import exports, readers
from seqloom.storage import shared_folder


def _text_file(lines: DataFrame) -> str:
    """Write one column of lines and return where they lie."""
    path = f"{shared_folder(lines.sparkSession)}/files-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query("a1_read_detections", "SELECT CAST(l_orderkey AS INTEGER) AS t, CAST(l_quantity AS DOUBLE) AS x1, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS y1, CAST(l_discount AS DOUBLE) AS x2, CASE WHEN l_linenumber % 2 <> 0 THEN CAST(l_tax AS DOUBLE) END AS y2 FROM lineitem")
def a1(s, d):
    number = lambda c: F.col(c).cast("double").cast("string")
    y1 = F.when(F.col("l_linenumber") % 3 == 0, "NaN").otherwise(number("l_extendedprice"))
    y2 = F.when(F.col("l_linenumber") % 2 == 0, "nan").otherwise(number("l_tax"))
    return readers.read_detections(s, _text_file(table(s, d, "lineitem").select(F.concat_ws(",", F.col("l_orderkey").cast("string"), number("l_quantity"), y1, number("l_discount"), y2))))


@query("a3_read_json_annotations", "SELECT 'n' || c_nationkey || '/' || c_custkey || '_' || lower(c_mktsegment) || '_lab' AS name, 'n' || c_nationkey AS furniture, CAST(c_custkey AS VARCHAR) AS person, lower(c_mktsegment) AS color, 'lab' AS place, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ann_id, CAST(o_orderkey AS INTEGER) AS start, CAST(o_orderkey + 5 AS INTEGER) AS \"end\", o_orderpriority AS event FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 10 <> 3")
def a3(s, d):
    """The orders of a customer as one document a line; every tenth customer is on the list of ignored names."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    name = F.concat(F.lit("n"), "c_nationkey", F.lit("/"), "c_custkey", F.lit("_"), F.lower("c_mktsegment"), F.lit("_lab"))
    entry = F.struct("o_orderkey", F.col("o_orderpriority").alias("label"), F.array(F.col("o_orderkey").cast("int"), (F.col("o_orderkey") + 5).cast("int")).alias("segment"))
    held = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(name.alias("name")).agg(F.array_sort(F.collect_list(entry)).alias("found"))
    annotation = F.transform("found", lambda x: F.struct(x["label"].alias("label"), x["segment"].alias("segment")))
    doc = F.to_json(F.struct(F.create_map("name", F.struct(F.lit("training").alias("subset"), annotation.alias("annotation"))).alias("database")))
    ignored = c.filter("c_custkey % 10 = 3").select(name.alias("name"))
    return readers.read_json_annotations(s, _text_file(held.select(doc)), ignored, lines=True)


@query("a4_read_coco", "SELECT 's' || l_orderkey AS seq, CAST(l_linenumber AS INTEGER) AS t, l_returnflag AS category FROM lineitem")
def a4(s, d):
    """An order is a document: its lines are images, their return flags categories that all documents list."""
    flags = ["A", "N", "R"]
    ident = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    image = F.struct(ident.alias("id"), F.format_string("s%d_%05d.jpg", "l_orderkey", "l_linenumber").alias("file_name"))
    kind = F.array_position(F.array(*[F.lit(m) for m in flags]), F.col("l_returnflag"))
    docs = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(image).alias("images"), F.collect_list(F.struct(ident.alias("image_id"), kind.alias("category_id"))).alias("annotations"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("id"), F.lit(m).alias("name")) for i, m in enumerate(flags)])
    return readers.read_coco(s, _text_file(docs.select(F.to_json(F.struct("images", names.alias("categories"), "annotations")))), lines=True)


@query("a8_stack_poses", "SELECT 'p' || l_linestatus AS part, 'small' AS marker_size, 'cam' || l_returnflag AS camera, CAST(l_orderkey AS INTEGER) AS t, CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_quantity AS DOUBLE) END AS p_x, CAST(l_discount AS DOUBLE) AS p_y, CAST(l_tax AS DOUBLE) AS p_z, 0.0 AS q_x, 0.0 AS q_y, 0.0 AS q_z, 1.0 AS q_w FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_returnflag IN ('A', 'N', 'R')")
def a8(s, d):
    li = table(s, d, "lineitem")
    zero = [F.lit(x).alias(c) for c, x in (("q_x", 0.0), ("q_y", 0.0), ("q_z", 0.0), ("q_w", 1.0))]
    root = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    for part in ("F", "O"):
        for camera in ("A", "N", "R"):
            rows = li.filter((F.col("l_linestatus") == part) & (F.col("l_returnflag") == camera))
            p_x = F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity").cast("double").cast("string")).otherwise("NaN")
            exports.write_csv(rows.select(F.col("l_orderkey").alias("t"), p_x.alias("p_x"), F.col("l_discount").alias("p_y"), F.col("l_tax").alias("p_z"), *zero), f"{root}/p{part}/small/cam{camera}.csv")
    return readers.stack_poses(s, f"{root}/*/*/*.csv")


@query("g23_part_models", "SELECT DISTINCT 'm' || (l_suppkey % 4) AS model, 'p' || l_partkey AS part, CAST(l_partkey % 5 AS INTEGER) AS bin FROM lineitem")
def g23(s, d):
    """A part's suppliers as its product models."""
    models = F.collect_set(F.concat(F.lit("m"), F.col("l_suppkey") % 4)).alias("models")
    parts = table(s, d, "lineitem").groupBy("l_partkey").agg(models)
    doc = F.to_json(F.struct(F.concat(F.lit("p"), "l_partkey").alias("part"), (F.col("l_partkey") % 5 + 1).alias("bin"), "models"))
    return readers.part_models(readers.read_part_map(s, _text_file(parts.select(doc))))


@query("a5_read_split_labels", "SELECT 'c' || o_custkey AS video_id, CAST(left(o_orderpriority, 1) AS INTEGER) AS action_id, o_orderpriority AS action_name, CAST(o_orderkey AS VARCHAR) AS start_frame, CAST(o_orderkey + 5 AS VARCHAR) AS end_frame, CASE o_orderkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split FROM orders")
def a5(s, d):
    o = table(s, d, "orders")
    rows = o.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("video_id"), F.left("o_orderpriority", F.lit(1)).alias("action_id"), F.col("o_orderpriority").alias("action_name"), F.col("o_orderkey").alias("start_frame"), (F.col("o_orderkey") + 5).alias("end_frame"), (F.col("o_orderkey") % 3).alias("part"))
    paths = {}
    for i, split in enumerate(("test", "train", "val")):
        paths[split] = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
        exports.write_csv(rows.filter(F.col("part") == i).drop("part"), paths[split])
    return readers.read_split_labels(s, paths)[0]


@query("a7_read_marker_bundles", "SELECT 'p' || p_partkey AS part, CAST(p_partkey * 3 + i AS INTEGER) AS marker, p_size + i * 0.5 AS size, i = 0 AS principal FROM part, range(0, 3) r(i) WHERE (p_partkey + i) % 2 = 1")
def a7(s, d):
    marker = lambda i: F.struct((F.col("p_partkey") * 3 + i).cast("int").alias("_id"), (F.col("p_size") + i * 0.5).cast("double").alias("_size"), ((F.col("p_partkey") + i) % 2).cast("int").alias("_status"))
    bundles = table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("_name"), F.array(*[marker(i) for i in range(3)]).alias("marker"))
    path = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    bundles.write.format("xml").option("rowTag", "bundle").option("rootTag", "bundles").save(path)
    return readers.read_marker_bundles(s, path)


@query("a11_append_results", "SELECT l_returnflag AS experiment, CAST(l_linenumber AS INTEGER) AS fold, l_orderkey AS seq_id, 'quantity' AS metric, CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
def a11(s, d):
    li = table(s, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("experiment"), F.col("l_linenumber").cast("int").alias("fold"), F.col("l_orderkey").alias("seq_id"), F.lit("quantity").alias("metric"), F.col("l_quantity").cast("double").alias("value"))
    path = f"{shared_folder(s)}/files-{uuid.uuid4().hex}"
    for part in (0, 1):
        exports.append_results(rows.filter(F.col("seq_id") % 2 == part), path)
    return s.read.parquet(path)
