import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.__main__ import main
from plumbline.plans import config as c
from plumbline.plans.views import build_view
from plumbline.plans.workflows import list_workflows, run_tasks
from plumbline.sources.datasets import coco, fingerprint, from_samples, huggingface, image_folder, load_dataset, yolo
from plumbline.sources.images import difference_hash, image_stats, oriented
from plumbline.streaming.scoring import flag_outliers


def png(path, shade):
    rows = b"".join(b"\0" + bytes([shade, x * 30 % 256, 7]) * 8 for x in range(8))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


@pytest.fixture(scope="module")
def images(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for k, name in enumerate(("class_a", "class_b")):
        for i in range(4):
            png(root / name / f"img_{i}.png", 10 + 100 * k + (i > 1))
    png(root / "stray.png", 1)
    return root


def test_image_folders(spark, images):
    frames = image_folder(spark, str(images), infer_labels=True)
    assert [(r.item_index, r.class_label) for r in frames.items.orderBy("item_index").collect()] == [(i, i // 4) for i in range(8)]
    assert image_folder(spark, str(images)).items.count() == 1 and image_folder(spark, str(images), recursive=True).items.count() == 9
    assert huggingface(spark, str(images)).items.count() == 8
    with pytest.raises(ValueError, match="unknown format"):
        load_dataset(spark, str(images), "nope")


def test_image_stats(spark, images):
    rows = image_stats(spark.read.format("image").option("recursiveFileLookup", "true").load(str(images / "class_a"))).collect()
    assert len(rows) == 4 and {(r.width, r.height, r.channels) for r in rows} == {(8, 8, 3)} and len({r.xxhash for r in rows}) == 2


def test_stats_of_boxes_and_turned_images(spark, images):
    pixels = spark.read.format("image").load(str(images / "class_a"))
    path = pixels.select("image.origin").first()[0]
    boxes = spark.createDataFrame([(path, 0, 2.0, 2.0, 6.0, 4.0), (path, 1, 5.0, 5.0, 3.0, 9.0)], "path string, target_index long, x0 double, y0 double, x1 double, y1 double")
    rows = {r.target_index: r for r in image_stats(pixels, boxes).filter(F.col("path") == path).collect()}
    assert set(rows) == {None, 0, 1} and (rows[0].width, rows[0].height, rows[0].offset_x, rows[0].invalid_box) == (4, 2, 2, 0) and rows[0].center == [4.0, 3.0]
    assert rows[1].invalid_box == 1 and rows[1].mean is None and rows[None].distance_edge == 0 and sum(rows[None].histogram) == 8 * 8 * 3
    x = np.random.default_rng(1).integers(0, 255, (40, 40, 3), dtype=np.uint8)
    assert {oriented(np.rot90(y, k), difference_hash) for y in (x, x[::-1]) for k in range(4)} == {oriented(x, difference_hash)} != {difference_hash(x)}


def test_pixel_operations_in_views(spark, images):
    frames = image_folder(spark, str(images), infer_labels=True, decode=True)
    view = build_view(frames.items, [{"type": "Crop", "params": {"top": 1, "left": 2, "height": 4, "width": 3}}, {"type": "SelectChannels", "params": {"channels": [0]}}, {"type": "ToRGB"}, {"type": "Resize", "params": {"height": 2, "width": 6}}, {"type": "Limit", "params": {"size": 3}}], "item_index")
    rows = view.orderBy("view_pos").collect()
    assert [(r.image.height, r.image.width, r.image.nChannels, len(r.image.data)) for r in rows] == [(2, 6, 3, 36)] * 3 and [r.class_label for r in rows] == [0, 0, 0]
    with pytest.raises(ValueError, match="decode"):
        build_view(spark.range(3).withColumnRenamed("id", "item_index"), [{"type": "Resize", "params": {"height": 2, "width": 2}}], "item_index")


def test_hub_folders_with_boxes_and_arrow_dumps(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "metadata.jsonl").write_text(json.dumps({"file_name": "a.png", "objects": {"bbox": [[1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 1.0, 1.0]], "category": [1, 0]}}) + "\n")
    frames = huggingface(spark, str(tmp_path / "d"), task="detection")
    assert [tuple(r) for r in frames.targets.orderBy("target_index").collect()] == [(0, 0, 1.0, 2.0, 4.0, 6.0, 1), (0, 1, 0.0, 0.0, 1.0, 1.0, 0)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "data.arrow").write_bytes(b"x")
    with pytest.raises(ValueError, match="Arrow"):
        huggingface(spark, str(tmp_path / "e"))


def test_image_stats_become_metrics(spark, images):
    raw = {
        "datasets": [{"name": "d", "format": "image_folder", "path": images.name, "options": {"infer_labels": True}, "image_stats": True}], "sources": [{"name": "s", "dataset": "d"}], "tasks": [{"name": "t", "workflow": "w", "sources": "s"}],
        "workflows": [{"name": "w", "type": "data-cleaning", "outlier_method": "zscore", "metrics": ["mean", "entropy"], "content": "xxhash", "near_signatures": ["phash", "dhash"]}],
    }
    (result,) = run_tasks(spark, c.Pipeline.model_validate(raw), str(images.parent))
    assert result.success, result.errors
    assert {f.title: f for f in result.findings}["Duplicates"].data["exact_percent"] == 50.0


def test_coco(spark, tmp_path):
    raw = {"images": [{"id": 7, "file_name": "a.png"}, {"id": 3, "file_name": "b.png"}], "categories": [{"id": 1, "name": "car"}, {"id": 5, "name": "cat"}], "annotations": [{"id": 1, "image_id": 7, "category_id": 5, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"id": 2, "image_id": 7, "category_id": 1, "bbox": [0.0, 0.0, 1.0, 1.0]}]}
    (tmp_path / "annotations.json").write_text(json.dumps(raw))
    frames = coco(spark, str(tmp_path))
    assert [tuple(r) for r in frames.targets.orderBy("target_index").collect()] == [(1, 0, 1.0, 2.0, 4.0, 6.0, 1), (1, 1, 0.0, 0.0, 1.0, 1.0, 0)]


def test_yolo(spark, tmp_path):
    (tmp_path / "data.yaml").write_text("names: [car, cat]\n")
    for split, line in (("train", "1 0.5 0.5 0.2 0.4\n0 0.1 0.1 0.2 0.2\n"), ("val", "0 0.5 0.5 1 1\n")):
        (tmp_path / "labels" / split).mkdir(parents=True)
        (tmp_path / "labels" / split / "x.txt").write_text(line)
    assert yolo(spark, str(tmp_path)).targets.count() == 3 and yolo(spark, str(tmp_path), "validation").targets.count() == 1 and yolo(spark, str(tmp_path), "test").items.count() == 0
    png(tmp_path / "images" / "train" / "x.png", 5)
    png(tmp_path / "images" / "train" / "bare.png", 5)
    png(tmp_path / "images" / "train" / "empty.png", 5)
    (tmp_path / "labels" / "train" / "empty.txt").write_text("")
    assert yolo(spark, str(tmp_path), "train").items.count() == 3 and yolo(spark, str(tmp_path)).items.count() == 4 and yolo(spark, str(tmp_path)).targets.count() == 3
    row = yolo(spark, str(tmp_path), "train").targets.orderBy("target_index").first()
    assert (round(row.x0, 6), round(row.y1, 6), row.class_label) == (0.4, 0.7, 1)


def test_fingerprint_sees_every_row(spark):
    df = spark.range(100).selectExpr("id", "id * 2 as v")
    assert fingerprint(df) == fingerprint(df.repartition(5)) != fingerprint(df.selectExpr("id", "if(id = 50, 0, v) as v"))


def config(sf_dir, **extra):
    params = {"outlier_method": "modzscore", "metrics": ["n_chars"]}
    raw = {
        "datasets": [{"name": "docs", "format": "parquet", "path": "documents.parquet", "options": {"key": "doc_id", "label": "lang"}}, {"name": "vectors", "format": "parquet", "path": "embeddings.parquet", "options": {"key": "vec_id", "label": "label"}}],
        "views": [{"name": "half", "operations": [{"type": "Limit", "params": {"size": 100}}]}],
        "sources": [{"name": "all", "dataset": "docs"}, {"name": "some", "dataset": "docs", "view": "half"}, {"name": "v", "dataset": "vectors"}, {"name": "w", "dataset": "vectors", "view": "half"}],
        "metadata": [{"name": "bins", "continuous_factor_bins": {"n_chars": 4}}],
        "workflows": [
            {"name": "clean", "type": "data-cleaning", "content": "text", "mode": "preparatory", **params}, {"name": "look", "type": "data-analysis", "content": "text", "factors": ["source"], "balance": True, "diversity_method": "simpson", **params}, {"name": "cover", "type": "data-coverage"},
            {"name": "split", "type": "data-splitting", "num_folds": 3}, {"name": "drift", "type": "drift-monitoring", "detectors": [{"method": "univariate"}, {"method": "knn"}, {"method": "nope"}]}, {"name": "ood", "type": "ood-detection"}, {"name": "rank", "type": "data-prioritization"}, {"name": "sweep", "type": "parameter-sweep", "metrics": ["n_chars"], "outlier_threshold": [2.0, 3.5]},
        ],
        "tasks": [
            {"name": "t-clean", "workflow": "clean", "sources": "all", "metadata": "bins"}, {"name": "t-look", "workflow": "look", "sources": ["all", "some"]}, {"name": "t-cover", "workflow": "cover", "sources": "v"}, {"name": "t-split", "workflow": "split", "sources": "all"}, {"name": "t-drift", "workflow": "drift", "sources": ["v", "w"]},
            {"name": "t-ood", "workflow": "ood", "sources": ["v", "w"]}, {"name": "t-rank", "workflow": "rank", "sources": ["v", "w"]}, {"name": "t-sweep", "workflow": "sweep", "sources": "all"}, {"name": "t-off", "workflow": "sweep", "sources": "all", "enabled": False}, {"name": "t-bad", "workflow": "ood", "sources": "v"},
        ],
    }
    return c.Pipeline.model_validate(raw | extra)


def test_all_workflows(spark, sf_dir):
    results = {r.name: r for r in run_tasks(spark, config(sf_dir), sf_dir)}
    assert len(results) == 9 and "t-off" not in results
    assert not results.pop("t-bad").success
    assert all(r.success for r in results.values()), [r.errors for r in results.values()]
    assert results["t-clean"].tables["clean_indices"].count() == 200 - results["t-clean"].scalars["removed"]
    assert results["t-split"].tables["splits"].count() == 200 and results["t-drift"].errors[0].startswith("nope")
    assert results["t-sweep"].tables["results"].count() == 2
    assert any(f.title.startswith("Leakage") and f.severity == "warning" for f in results["t-look"].findings)
    text = results["t-clean"].report()
    assert "Image Outliers" in text and json.loads(results["t-clean"].export())["success"] and "findings" in results["t-clean"].export(fmt="yaml")
    assert len(list_workflows()) == 8


def test_configuration(tmp_path):
    (tmp_path / "a.yaml").write_text("datasets: [{name: d, path: x}]\n")
    (tmp_path / "b.yaml").write_text("datasets: [{name: e, path: y}]\nseed: 3\n")
    (tmp_path / "c.yaml").write_text("other: 1\n")
    found = c.load_config_folder(tmp_path)
    assert [d.name for d in found.datasets] == ["d", "e"] and found.seed == 3
    with pytest.raises(ValueError):
        c.Pipeline.model_validate({"sources": [{"name": "s", "dataset": "d"}, {"name": "s", "dataset": "d"}]})
    with pytest.raises(ValueError):
        c.MetadataPolicy(name="p", strict=True)
    with pytest.raises(ValueError):
        c.resolve_path("../x", str(tmp_path))
    assert "Pipeline" in c.export_schema() and c.resolve_path("hdfs://x/y", ".") == "hdfs://x/y"


def test_stream_scoring(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = events.schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    query = flag_outliers(stream, events, ["event_id"], "value").writeStream.format("memory").queryName("flagged").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("flagged").count() == flag_outliers(events, events, ["event_id"], "value").count() > 0


def test_samples_of_python_objects(spark):
    rng = np.random.default_rng(2)
    frames = from_samples(spark, [(rng.random((3, 5, 4)), [0, 1, 0]), (rng.integers(0, 255, (5, 4)), 2)], ["a", "b", "c"])
    assert [(r.class_label, r.image.height, r.image.width, r.image.nChannels) for r in frames.items.orderBy("item_index").collect()] == [(1, 5, 4, 3), (2, 5, 4, 1)]
    frames = from_samples(spark, [(rng.random((3, 5, 4)), {"boxes": [[0, 1, 2, 3]], "labels": [1]})])
    assert [tuple(r) for r in frames.targets.collect()] == [(0, 0, 0.0, 1.0, 2.0, 3.0, 1)] and "class_label" not in frames.items.columns


def test_command_line_with_cache_and_encoding(spark, images, tmp_path):
    raw = {
        "datasets": [{"name": "d", "format": "image_folder", "path": images.name, "options": {"infer_labels": True}, "image_stats": True}], "sources": [{"name": "s", "dataset": "d"}], "metadata": [{"name": "m", "continuous_factor_bins": {"mean": 2}}],
        "workflows": [{"name": "w", "type": "data-cleaning", "outlier_method": "zscore", "metrics": ["mean"]}], "tasks": [{"name": "t", "workflow": "w", "sources": "s", "metadata": "m"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(raw))
    common = ["-c", str(tmp_path / "c.json"), "-d", str(images.parent), "-k", str(tmp_path / "kept")]
    for _ in range(2):  # the second run finds the metrics kept
        assert main([*common, "-o", str(tmp_path / "out")]) == 0
    assert len(list((tmp_path / "kept" / "v1").iterdir())) == 1 and (tmp_path / "out" / "t" / "result.json").exists()
    assert main(["encoding", *common, "-t", "t", "-o", str(tmp_path / "e.json")]) == 0
    assert (tmp_path / "e.json").read_text() == (tmp_path / "out" / "encoding.json").read_text()
