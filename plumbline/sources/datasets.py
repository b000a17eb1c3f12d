"""Readers: a dataset on disk, a table or a DataFrame becomes ``items`` (and ``targets``), keyed by item_index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Image files that a folder is searched for.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff")
# Names under which a split may be asked for.
SPLIT_ALIASES = {"training": "train", "validation": "val", "valid": "val", "dev": "val", "testing": "test"}


@dataclass
class SourceFrames:
    """What a dataset gives: items, targets (detection only), the label dimension, and where labels come from."""

    items: DataFrame
    targets: DataFrame | None = None
    classes: DataFrame | None = None
    label_source: str | None = None
    lineage: list | None = None  # steps that changed the items' pixels


def _numbered(df: DataFrame, order: str = "path") -> DataFrame:
    """Adds item_index in the order of the path. The order is global: files are a dimension beside their content."""
    return df.withColumn("item_index", (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    glob = "*.{" + ",".join(x for s in IMAGE_SUFFIXES for x in (s, s.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")


def decoded(spark: SparkSession, items: DataFrame) -> DataFrame:
    """Items with ``image`` (Spark's struct of height, width, channels and bytes) of the file at their path."""
    folders = [r.folder for r in items.select(F.regexp_replace("path", "[^/]+$", "").alias("folder")).distinct().collect()]
    pixels = spark.read.format("image").load(folders).select(F.col("image.origin").alias("__path"), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    bare = lambda col: F.regexp_replace(col, "^[a-z]+:/*", "/")
    return items.join(pixels, bare(F.col("path")) == bare(F.col("__path")), "left").drop("__path")


def image_folder(spark: SparkSession, path: str, recursive: bool = False, infer_labels: bool = False, decode: bool = False) -> SourceFrames:
    """Images of a folder in path order. ``infer_labels``: the folders directly below are the classes, numbered by name;
    empty ones don't count, images beside them are left out. ``decode``: items carry their pixels, for pixel operations
    of views."""
    if decode:
        frames = image_folder(spark, path, recursive, infer_labels)
        frames.items = decoded(spark, frames.items)
        return frames
    if not infer_labels:
        return SourceFrames(_numbered(_files(spark, path, recursive)).withColumn("class_label", F.lit(None).cast("int")))
    root = path.rstrip("/").rsplit("/", 1)[-1]
    files = _files(spark, path, True).withColumn("class_name", F.regexp_extract("path", rf"/{_quoted(root)}/([^/]+)/[^/]+$", 1)).filter("class_name <> ''")
    names = files.select("class_name").distinct()
    classes = names.withColumn("class_label", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("int"))
    return SourceFrames(_numbered(files.join(classes, "class_name")), None, classes, "folder")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def coco(spark: SparkSession, path: str, annotations_file: str = "annotations.json", images_dir: str = "images") -> SourceFrames:
    """A COCO detection file: items in image-id order, a target a box (x, y, w, h become corners)."""
    raw = spark.read.option("multiLine", True).json(f"{path}/{annotations_file}")
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").cast("long").alias("image_id"), F.concat(F.lit(f"{path}/{images_dir}/"), F.col("i.file_name")).alias("path"))
    items = images.withColumn("item_index", (F.row_number().over(Window.orderBy("image_id")) - 1).cast("long"))
    names = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").cast("long").alias("category_id"), F.col("c.name").alias("class_name"))
    classes = names.withColumn("class_label", (F.row_number().over(Window.orderBy("category_id")) - 1).cast("int"))
    boxes = raw.select(F.explode("annotations").alias("a")).select(F.col("a.id").cast("long").alias("box_id"), F.col("a.image_id").cast("long").alias("image_id"), F.col("a.category_id").cast("long").alias("category_id"), F.col("a.bbox").alias("b"))
    placed = boxes.join(items.select("image_id", "item_index"), "image_id").join(classes, "category_id")
    targets = placed.select("item_index", (F.row_number().over(Window.partitionBy("item_index").orderBy("box_id")) - 1).cast("long").alias("target_index"), F.col("b")[0].alias("x0"), F.col("b")[1].alias("y0"), (F.col("b")[0] + F.col("b")[2]).alias("x1"), (F.col("b")[1] + F.col("b")[3]).alias("y1"), "class_label")
    return SourceFrames(items, targets, classes.select("class_label", "class_name"), "annotations")


def yolo(spark: SparkSession, path: str, split: str | None = None, yaml_file: str = "data.yaml", ann_dir: str = "labels", images_dir: str = "images") -> SourceFrames:
    """A YOLO folder: ``<ann_dir>/<split>/<image>.txt`` with class and relative centre, width and height a line. A split
    that matches nothing selects nothing; none selects all. Boxes stay relative (0 to 1).

    Items are the images, and label files that have lines, by their names without suffix: an image without labels (no file,
    or an empty one) is an item without targets. Where the YAML file names the splits' image folders, those are the splits."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(f"{path}/{yaml_file}").withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect())
    raw = yaml.safe_load(text) or {}
    names = raw.get("names", [])
    pairs = sorted(names.items()) if isinstance(names, dict) else list(enumerate(names))
    classes = spark.createDataFrame([(int(i), str(n)) for i, n in pairs], "class_label int, class_name string")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(f"{path}/{ann_dir}").select("value", F.col("_metadata.file_path").alias("path"))
    folder, stem = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    lines = lines.withColumn("split", folder).withColumn("stem", stem)
    labelled = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/{ann_dir}").select("path").withColumn("split", folder).withColumn("stem", stem)
    # splits that the YAML file gives by their image folders
    named = {k: str(raw[k]).rstrip("/").rsplit("/", 1)[-1] for k in ("train", "val", "test") if isinstance(raw.get(k), str)}
    try:
        images = _files(spark, f"{path}/{images_dir}", True).select("path").withColumn("split", folder).withColumn("stem", stem)
        images = images.select("split", "stem", F.col("path").alias("image"))
    except Exception as e:  # labels alone are a dataset too
        if "PATH_NOT_FOUND" not in str(e):
            raise
        images = spark.createDataFrame([], "split string, stem string, image string")
    found = labelled.select("split", "stem", "path").join(images, ["split", "stem"], "full").select("split", "stem", F.coalesce("image", "path").alias("path"))
    if split is not None:
        wanted = SPLIT_ALIASES.get(split, split)
        found = found.filter(F.col("split") == named.get(wanted, wanted))
    items = _numbered(found)
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: parts[i].cast("double")
    rows = lines.filter(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id()).select("split", "stem", "n", parts[0].cast("int").alias("class_label"), (number(1) - number(3) / 2).alias("x0"), (number(2) - number(4) / 2).alias("y0"), (number(1) + number(3) / 2).alias("x1"), (number(2) + number(4) / 2).alias("y1"))
    targets = rows.join(items.select("split", "stem", "item_index"), ["split", "stem"]).withColumn("target_index", (F.row_number().over(Window.partitionBy("item_index").orderBy("n")) - 1).cast("long"))
    return SourceFrames(items.drop("stem"), targets.select("item_index", "target_index", "x0", "y0", "x1", "y1", "class_label"), classes, "annotations")


def huggingface(spark: SparkSession, path: str, split: str | None = None, task: str = "classification") -> SourceFrames:
    """A local folder of a dataset hub: class folders, or a ``metadata`` file (csv, jsonl, parquet) beside the images.
    ``split``: a subfolder. ``task``: classification, or detection, where the metadata's ``objects`` (bbox: x, y, width,
    height; category) are the targets. Dumps of Arrow files are refused."""
    if task not in ("classification", "detection"):
        raise ValueError(f"unknown task {task!r}; classification or detection")
    at = f"{path}/{SPLIT_ALIASES.get(split, split)}" if split else path
    for suffix, kind, options in (("parquet", "parquet", {}), ("jsonl", "json", {}), ("csv", "csv", {"header": "true", "inferSchema": "true"})):
        try:
            rows = spark.read.options(**options).format(kind).load(f"{at}/metadata.{suffix}")
        except Exception as e:  # only a missing file leads on
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if task == "detection":
            if "objects" not in rows.columns:
                raise ValueError("detection needs a column 'objects' in the metadata")
            items = _numbered(rows.withColumn("path", F.concat(F.lit(f"{at}/"), F.col("file_name"))))
            boxes = items.select("item_index", F.posexplode(F.arrays_zip(F.col("objects.bbox").alias("b"), F.col("objects.category").alias("c"))).alias("i", "o"))
            corner = lambda k: F.col("o.b")[k].cast("double")
            targets = boxes.select("item_index", F.col("i").cast("long").alias("target_index"), corner(0).alias("x0"), corner(1).alias("y0"), (corner(0) + corner(2)).alias("x1"), (corner(1) + corner(3)).alias("y1"), F.col("o.c").cast("int").alias("class_label"))
            return SourceFrames(items.drop("objects"), targets, None, "metadata")
        name = "label" if "label" in rows.columns else None
        items = _numbered(rows.withColumn("path", F.concat(F.lit(f"{at}/"), F.col("file_name"))))
        return SourceFrames(items.withColumn("class_label", F.col(name).cast("int")) if name else items, None, None, "metadata")
    try:
        dump = not spark.read.format("binaryFile").option("pathGlobFilter", "*.arrow").option("recursiveFileLookup", "true").load(at).select("path").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        dump = False
    if dump:
        raise ValueError(f"{at!r} is a dump of Arrow files; export it as image folders or with a metadata file")
    return image_folder(spark, at, infer_labels=True)


def table_source(spark: SparkSession, path: str, key: str | None = None, label: str | None = None) -> SourceFrames:
    """A Parquet table: rows are items, by its key or its own order of keys."""
    rows = spark.read.parquet(path)
    items = rows.withColumn("item_index", F.col(key).cast("long")) if key else rows.withColumn("item_index", F.monotonically_increasing_id())
    return SourceFrames(items.withColumn("class_label", F.col(label)) if label else items, None, None, "column" if label else None)


def from_samples(spark: SparkSession, dataset, classes: list[str] | None = None) -> SourceFrames:
    """A dataset of Python objects by index (as vision libraries have them), for what fits in the driver: ``dataset[i]`` is an
    image (height x width x channels; channels first, if floats) and a label: a class number, its one-hot vector, or a mapping
    with boxes (x0, y0, x1, y1) and labels."""
    import numpy as np

    items, targets = [], []
    for i in range(len(dataset)):
        pixels, label = dataset[i][:2]
        x = np.asarray(pixels)
        x = x[:, :, None] if x.ndim == 2 else np.moveaxis(x, 0, 2) if x.shape[0] in (1, 3) and (x.dtype.kind == "f" or x.shape[2] not in (1, 3, 4)) else x
        x = np.ascontiguousarray((x * 255).round() if x.dtype.kind == "f" and x.size and x.max() <= 1 else x).astype(np.uint8)
        own = None
        if isinstance(label, dict):
            for t, (box, c) in enumerate(zip(label["boxes"], label["labels"])):
                targets.append((i, t, *map(float, box), int(c)))
        else:
            flat = np.asarray(label).ravel()
            own = int(flat.argmax()) if flat.size > 1 else int(flat[0])
        items.append((i, (x.shape[0], x.shape[1], x.shape[2], x.tobytes()), own))
    frame = spark.createDataFrame(items, "item_index long, image struct<height:int,width:int,nChannels:int,data:binary>, class_label int")
    boxes = spark.createDataFrame(targets, "item_index long, target_index long, x0 double, y0 double, x1 double, y1 double, class_label int") if targets else None
    names = spark.createDataFrame(list(enumerate(classes)), "class_label int, class_name string") if classes else None
    return SourceFrames(frame.drop("class_label") if targets else frame, boxes, names, "samples")


FORMATS = {"image_folder": image_folder, "coco": coco, "yolo": yolo, "huggingface": huggingface, "parquet": table_source}


def load_dataset(spark: SparkSession, path: str, dataset_format: str = "huggingface", **options) -> SourceFrames:
    """Reads a dataset by its format; an empty one is an error that says what was expected."""
    if dataset_format not in FORMATS:
        raise ValueError(f"unknown format {dataset_format!r}; one of {sorted(FORMATS)}")
    found = FORMATS[dataset_format](spark, path, **options)
    if found.items.isEmpty():
        raise ValueError(f"no items in {path!r} as {dataset_format}: {FORMATS[dataset_format].__doc__.splitlines()[0]}")
    return found


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """Of the whole table: row count and order-free sums of row hashes."""
    names = sorted(columns or df.columns)
    one, two = F.xxhash64(F.lit(1), *names), F.xxhash64(F.lit(2), *names)
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("a"), F.coalesce(F.sum(F.shiftright(two, 16)), F.lit(0)).alias("b")).first()
    return f"{r.n}-{r.a & (2**64 - 1):016x}-{r.b & (2**64 - 1):016x}"
