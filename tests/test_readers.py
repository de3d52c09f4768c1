"""Readers on files written by hand, and results that are appended."""

import json

from seqloom.sources import exports, readers


def test_detections(spark, tmp_path):
    (tmp_path / "d.csv").write_text("0,1,2,NaN,nan\n1,NaN,NaN,3,4\n")
    rows = readers.read_detections(spark, str(tmp_path)).orderBy("t").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0, 2.0, None, None), (1, None, None, 3.0, 4.0)]


def test_action_labels(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("wheel 10 0\nbody 25 30\n")
    rows = readers.read_action_labels(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.seq_id, r.object, r.end) for r in rows] == [("s1", "wheel", 25), ("s1", "body", 30)]


def test_json_annotations(spark, tmp_path):
    entry = {"subset": "training", "annotation": [{"label": "pick up leg", "segment": [0, 5]}, {"label": "flip", "segment": [6, 9]}]}
    (tmp_path / "a.json").write_text(json.dumps({"database": {"shelf/7_white_lab": entry, "bad/1_x_y": entry}}))
    bad = spark.createDataFrame([("bad/1_x_y",)], "name string")
    rows = readers.read_json_annotations(spark, str(tmp_path / "a.json"), bad).orderBy("ann_id").collect()
    assert [(r.furniture, r.person, r.color, r.place, r.start, r.end, r.event) for r in rows] == [("shelf", "7", "white", "lab", 0, 5, "pick up leg"), ("shelf", "7", "white", "lab", 6, 9, "flip")]


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "0003_00017.jpg"}], "categories": [{"id": 4, "name": "bolt"}], "annotations": [{"image_id": 1, "category_id": 4}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in readers.read_coco(spark, str(tmp_path / "c.json")).collect()] == [("0003", 17, "bolt")]


def test_documents_by_line(spark, tmp_path):
    doc = lambda i: json.dumps({"images": [{"id": i, "file_name": f"s{i}_0004.png"}], "categories": [{"id": 1, "name": "nut"}], "annotations": [{"image_id": i, "category_id": 1}] * 2})
    (tmp_path / "c.json").write_text(doc(1) + "\n" + doc(2) + "\n")
    assert sorted(tuple(r) for r in readers.read_coco(spark, str(tmp_path / "c.json"), lines=True).collect()) == [("s1", 4, "nut")] * 2 + [("s2", 4, "nut")] * 2
    (tmp_path / "p.json").write_text('{"part": "nose", "bin": 1, "models": ["a", "b", "a"]}\n{"part": "tail", "bin": 4, "models": []}\n')
    parts = readers.read_part_map(spark, str(tmp_path / "p.json"))
    assert {r.part: r.bin for r in parts.collect()} == {"nose": 0, "tail": 3}
    assert {tuple(r) for r in readers.part_models(parts).collect()} == {("a", "nose", 0), ("b", "nose", 0)}


def test_split_labels(spark, tmp_path):
    head = "video_id,action_id,action_name,start_frame,end_frame\n"
    (tmp_path / "a.csv").write_text(head + "v1,0,take,5,9\n")
    (tmp_path / "b.csv").write_text(head + "v2,0,grab,1,2\nv2,1,put,3,4\n")
    rows, vocab = readers.read_split_labels(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "b.csv")})
    assert {(r.id, r.name) for r in vocab.collect()} == {(0, "take"), (1, "put")} and rows.filter("split = 'test'").count() == 2


def test_marker_bundles(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<root><bundle name="leg"><marker id="3" size="4.5" status="1"/><marker id="9" size="4.5" status="1"/><marker id="8" size="1" status="0"/></bundle></root>')
    assert {tuple(r) for r in readers.read_marker_bundles(spark, str(tmp_path / "m.xml")).collect()} == {("leg", 3, 4.5, True), ("leg", 9, 4.5, False)}


def test_stack_poses(spark, tmp_path):
    d = tmp_path / "leg" / "small"
    d.mkdir(parents=True)
    (d / "cam1.csv").write_text("t,p_x,p_y,p_z,q_x,q_y,q_z,q_w\n0,1,2,3,0,0,0,1\n")
    r = readers.stack_poses(spark, str(tmp_path / "*" / "*" / "*.csv")).first()
    assert (r.part, r.marker_size, r.camera, r.p_z) == ("leg", "small", "cam1", 3.0)


def test_part_map_and_results(spark, tmp_path):
    assert readers.load_part_map(spark, {"nose": (1, ["a", "b"])}).first().bin == 0
    one = spark.createDataFrame([("e1", 0, 1, "f1", 0.5)], "experiment string, fold int, seq_id long, metric string, value double")
    exports.append_results(one, str(tmp_path / "r"))
    exports.append_results(one, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2


def test_poses_are_placed_by_paths_without_patterns(spark, tmp_path):
    """Files and folders of files, odd names, and no pattern matched against the path of every row."""
    line = "t,p_x,p_y,p_z,q_x,q_y,q_z,q_w\n0,1,2,3,0,0,0,1\n"
    for at in ("leg/small/cam1.csv", "leg/big/cam2.csv/part-0.csv", "leg/big/cam2.csv/part-1", "leg.v2/y/cam3.csv", "arm/a.b/cam4.txt.csv"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(line)
    out = readers.stack_poses(spark, [str(tmp_path / "*" / "*" / "*.csv")])
    got = sorted((r.part, r.marker_size, r.camera) for r in out.collect())
    assert got == sorted([("leg", "small", "cam1"), ("leg", "big", "cam2"), ("leg", "big", "cam2"), ("leg.v2", "y", "cam3"), ("", "", "")])
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
