"""Readers of annotation and sensor formats; every one returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.align import fill_open_ends, null_if_nan


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Hand detections (t, x1, y1, x2, y2) from CSV with the frame in the first column; NaN is missing.

    A row's place in a file is not kept when the file is split, so the frame must be stored.
    """
    schema = "t int, x1 double, y1 double, x2 double, y2 double"
    return null_if_nan(spark.read.schema(schema).option("nanValue", "NaN").option("nullValue", "nan").csv(path))


def read_action_labels(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """(seq_id, ann_id, start, end, object) from text lines ``object start end``, a file a sequence; end 0 means the next one's start."""
    lines = spark.read.schema("object string, start int, end int").option("sep", " ").csv(path).withColumn("seq_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))
    out = fill_open_ends(lines.withColumn("ann_id", F.xxhash64("object", "start")))
    return out if vocab is None else out.join(vocab.select(F.col("name").alias("object"), "id"), "object", "left")


ANNOTATION = "database MAP<STRING, STRUCT<subset: STRING, annotation: ARRAY<STRUCT<label: STRING, segment: ARRAY<INT>>>>>"


def read_json_annotations(spark: SparkSession, path: str, ignored: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """(name, furniture, person, color, place, ann_id, start, end, event): annotations keyed by sequence name ``furniture/person_color_place...``.

    A file is one document, which one task reads; with ``lines`` every line is one, and files are split among tasks.
    """
    raw = spark.read.schema(ANNOTATION).option("multiLine", not lines).json(path)
    seqs = raw.select(F.explode("database").alias("name", "entry"))
    if ignored is not None:
        seqs = seqs.join(ignored.select("name"), "name", "left_anti")
    parts = F.split("name", "[/_]")
    rows = seqs.select("name", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("furniture", "person", "color", "place"))], F.posexplode("entry.annotation").alias("ann_id", "a"))
    return rows.select("name", "furniture", "person", "color", "place", "ann_id", F.get("a.segment", F.lit(0)).alias("start"), F.get("a.segment", F.lit(1)).alias("end"), F.col("a.label").alias("event"))


COCO = "images ARRAY<STRUCT<id: BIGINT, file_name: STRING>>, categories ARRAY<STRUCT<id: BIGINT, name: STRING>>, annotations ARRAY<STRUCT<image_id: BIGINT, category_id: BIGINT>>"


def read_coco(spark: SparkSession, path: str, pattern: str = r"^(.+)_(\d+)\.\w+$", lines: bool = False) -> DataFrame:
    """(seq, t, category) of every object annotation; sequence and frame are read from the image's name.

    Documents share one set of ids: an image or category that several of them list counts once. ``lines`` as in ``read_json_annotations``.
    """
    raw = spark.read.schema(COCO).option("multiLine", not lines).json(path)
    images = raw.select(F.inline("images")).select(F.col("id").alias("image_id"), "file_name").distinct()
    names = raw.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name").alias("category")).distinct()
    tied = raw.select(F.inline("annotations")).join(images, "image_id").join(names, "category_id")
    return tied.select(F.regexp_extract("file_name", pattern, 1).alias("seq"), F.regexp_extract("file_name", pattern, 2).cast("int").alias("t"), "category")


def read_split_labels(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """All splits' label rows (video_id, action_id, action_name, start_frame, end_frame, split), and the vocabulary (id, name): the first name of each id."""
    schema = "video_id string, action_id int, action_name string, start_frame string, end_frame string"
    out = None
    for order, (split, path) in enumerate(paths.items()):
        one = spark.read.schema(schema).option("header", True).csv(path).withColumn("split", F.lit(split)).withColumn("_o", F.lit(order))
        out = one if out is None else out.unionByName(one)
    vocab = out.groupBy(F.col("action_id").alias("id")).agg(F.min_by("action_name", F.struct("_o", "video_id", "start_frame")).alias("name"))
    return out.drop("_o").sort("video_id", "start_frame"), vocab


def read_marker_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(part, marker, size, principal) from XML bundles: the first marker of a part is its principal one; only status 1 counts."""
    schema = "_name STRING, marker ARRAY<STRUCT<_id: INT, _size: DOUBLE, _status: INT>>"
    raw = spark.read.format("xml").option("rowTag", "bundle").schema(schema).load(path)
    rows = raw.select(F.col("_name").alias("part"), F.posexplode("marker").alias("pos", "m"))
    return rows.filter("m._status = 1").select("part", F.col("m._id").alias("marker"), F.col("m._size").alias("size"), (F.col("pos") == 0).alias("principal"))


def stack_poses(spark: SparkSession, path: str) -> DataFrame:
    """(part, marker_size, camera, t, pose columns) from a tree part/size/camera.csv, a file or a folder of files each: long, one row a reading."""
    schema = "t int, p_x double, p_y double, p_z double, q_x double, q_y double, q_z double, q_w double"
    rows = spark.read.schema(schema).option("header", True).csv(path).withColumn("_p", F.split(F.col("_metadata.file_path"), "/"))
    back = lambda i: F.get("_p", F.size("_p") - i)
    camera = lambda i: F.substring_index(back(i), ".", 1)
    fits = lambda i: (camera(i) != "") & (back(i) == F.concat(camera(i), F.lit(".csv"))) & (back(i + 1) != "") & (back(i + 2) != "")
    level = rows.withColumn("_i", F.when(fits(2), 2).when(fits(1), 1))  # pieces of the path from the end, without a pattern, which would search every row's path
    at = [F.coalesce(x, F.lit("")).alias(name) for x, name in ((back(F.col("_i") + 2), "part"), (back(F.col("_i") + 1), "marker_size"), (camera(F.col("_i")), "camera"))]
    return null_if_nan(level.select(*at, "t", "p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w"))


def load_part_map(spark: SparkSession, entries: dict[str, tuple[int, list[str]]]) -> DataFrame:
    """(part, bin, models) from a mapping of part to bin (counted from 1) and product models."""
    return spark.createDataFrame([(p, b - 1, m) for p, (b, m) in entries.items()], "part string, bin int, models array<string>")


def read_part_map(spark: SparkSession, path: str) -> DataFrame:
    """(part, bin, models) from lines of JSON, a part each: its bin, counted from 1 there and from 0 here, and its product models."""
    raw = spark.read.schema("part string, bin int, models array<string>").json(path)
    return raw.select("part", (F.col("bin") - 1).alias("bin"), "models")


def part_models(parts: DataFrame) -> DataFrame:
    """(model, part, bin): the parts of each product model, from (part, bin, models)."""
    return parts.select(F.explode("models").alias("model"), "part", "bin").distinct()
