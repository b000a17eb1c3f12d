"""Views: ordered operations on the rows of a dataset, each a DataFrame transformation carrying the position."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ordering import numbered, ranked, renumbered, shuffled
from plumbline.operators import embedding
from plumbline.operators.embedding import transformed
from plumbline.operators.splitting import rebalanced
from plumbline.sources.transforms import STEPS

POSITION = "view_pos"
MAX_INDICES = 1_000_000


def positioned(df: DataFrame, key: str) -> DataFrame:
    """Adds the position, from 0, in the order of the key; a key that is no number is ranked in one task (as few datasets
    have: keys are item indices)."""
    if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return numbered(df, key, key, POSITION).withColumn(POSITION, (F.col(POSITION) - 1).cast("long"))
    return df.withColumn(POSITION, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def limit(df: DataFrame, size: int) -> DataFrame:
    return df.orderBy(POSITION).limit(size)


def expand_indices(spec) -> list[int]:
    """A list of positions, or {start, stop, step}."""
    out = list(range(spec.get("start", 0), spec["stop"], spec.get("step", 1))) if isinstance(spec, dict) else list(spec)
    if len(out) > MAX_INDICES:
        raise ValueError(f"at most {MAX_INDICES} indices")
    return out


def indices(df: DataFrame, indices) -> DataFrame:
    """The listed positions, in that order, as often as they are listed."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(expand_indices(indices))), "__at long, __pos long")
    return df.join(F.broadcast(wanted), F.col(POSITION) == F.col("__pos")).drop(POSITION, "__pos").withColumnRenamed("__at", POSITION).select(*df.columns)


def class_filter(df: DataFrame, classes: Sequence, label: str = "class_label") -> DataFrame:
    return renumbered(df.filter(F.col(label).isin(*classes)), POSITION)


def class_balance(df: DataFrame, key: str, method: str = "global", label: str = "class_label", seed: int = 0) -> DataFrame:
    return renumbered(rebalanced(df, key, label, method, seed), POSITION)


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    ordered = ranked(df.drop(POSITION).withColumn("__h", shuffled(key, seed)), [], "__h", key, POSITION)
    return ordered.drop("__h").withColumn(POSITION, (F.col(POSITION) - 1).cast("long"))


def reverse(df: DataFrame) -> DataFrame:
    return renumbered(df, POSITION, descending=True)


def relabel(df: DataFrame, map: dict, label: str = "class_label") -> DataFrame:
    """Labels replaced by a mapping; those it doesn't name stay."""
    kind = dict(df.dtypes)[label]
    table = F.create_map(*(x for k, v in map.items() for x in (F.lit(k).cast(kind), F.lit(v).cast(kind))))
    return df.withColumn(label, F.coalesce(F.try_element_at(table, F.col(label)), F.col(label)))


def detection_crops(items: DataFrame, targets: DataFrame, item: str = "item_index", label: str = "class_label") -> tuple[DataFrame, DataFrame]:
    """Each ground-truth box as an item of its own (with its pixels, if items are decoded), in the order of items, then boxes;
    degenerate boxes are dropped and counted. Returns the crops and that count."""
    targets = targets if label in targets.columns else targets.withColumn(label, F.lit(None).cast("int"))
    crops = renumbered(embedding.detection_crops(items, targets, item, label), POSITION, then=("target_index",))
    here = targets.join(items.select(item), item, "left_semi").agg(F.count("*").alias("n"))
    return crops, here.crossJoin(F.broadcast(crops.agg(F.count("*").alias("m")))).select((F.col("n") - F.col("m")).alias("dropped"))


def crops_as_items(items: DataFrame, targets: DataFrame | None, key: str, label: str = "class_label") -> DataFrame:
    """A view's items after DetectionCrops: their key is the crop's position, ``source_item`` that of their item."""
    if targets is None:
        raise ValueError("DetectionCrops needs targets")
    crops, _ = detection_crops(items, targets, key, label)
    return crops.withColumnRenamed(key, "source_item").withColumn(key, F.col(POSITION))


def pixels(df: DataFrame, step: str, **params) -> DataFrame:
    """The pixels (``image``) of every item after a step of the image transforms; other columns stay."""
    return transformed(df, [{"type": step, "params": params}])


def selection_key(df: DataFrame, key: str) -> str:
    """Names what a view selects and in which order: ``sel:n=<rows>:<digest of positions and keys>``."""
    h = F.xxhash64(POSITION, key)
    n, a, b = df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0))).first()
    return f"sel:n={n}:{hashlib.sha256(f'{n},{a},{b}'.encode()).hexdigest()[:16]}"


OPERATIONS = {"Limit": limit, "Indices": indices, "ClassFilter": class_filter, "ClassBalance": class_balance, "Shuffle": shuffle, "Reverse": reverse, "Relabel": relabel, "DetectionCrops": crops_as_items, **{step: partial(pixels, step=step) for step in STEPS}}


def build_view(df: DataFrame, operations: Sequence[dict], key: str, label: str = "class_label", targets: DataFrame | None = None) -> DataFrame:
    """Applies ``[{type, params}]`` in order; an unknown type is an error that lists the known. ``targets``: the boxes that
    DetectionCrops makes items of."""

    def step(rows: DataFrame, op: dict) -> DataFrame:
        if op["type"] not in OPERATIONS:
            raise ValueError(f"unknown view operation {op['type']!r}; one of {sorted(OPERATIONS)}")
        params = dict(op.get("params") or {})
        if op["type"] in ("ClassFilter", "ClassBalance", "Relabel"):
            params.setdefault("label", label)
        if op["type"] == "DetectionCrops":
            params |= {"targets": targets, "key": key, "label": label}
        if op["type"] in ("ClassBalance", "Shuffle"):
            params.setdefault("key", key)
        return OPERATIONS[op["type"]](rows, **params)

    return reduce(step, operations, positioned(df, key))
