"""Density clusters (HDBSCAN) and what rests on their tree.

Core distances come from exact neighbours, the spanning tree of mutual reachability from Boruvka rounds on neighbours.
Its edges, from short to long, merge components; they are taken in windows of at most ``WINDOW`` edges, so that neither the
driver nor a task holds the tree: a window's merges are found in memory, and what they made of the components they met is
joined to the edges and points that are left. A component of ``min_cluster_size`` points is a cluster; it ends where
another one joins it. Stability decides between a cluster and those it is made of (excess of mass), as they end.

Definitions that the literature fixes: the core distance counts the point itself; edges of one length merge at once, so the
tree is the same however ties fall; the whole is never a cluster; an edge of length 0 counts as long as the shortest other
one. Clusters are named by their smallest member; points of no cluster (noise) have a null one and membership 0. Rows
without a key or vector are left out; equal vectors are points of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.duplicates import merged_groups
from plumbline.operators.neighbors import knn, spanning_tree

#: Edges of the tree that are merged in memory at once (all of one length stay together).
WINDOW = 100_000


def core_distances(df: DataFrame, key: str, vector: str, min_samples: int = 5) -> DataFrame:
    """``key, core``: the distance to the ``min_samples``-th nearest row, itself counted; to the farthest if there are
    fewer, 0 without another."""
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key))
    if min_samples < 2:
        return rows.withColumn("core", F.lit(0.0))
    far = knn(df, df, key, vector, min_samples - 1).groupBy(key).agg(F.max("dist").alias("core"))
    return rows.join(far, key, "left").withColumn("core", F.coalesce("core", F.lit(0.0)))


def reachability_tree(df: DataFrame, key: str, vector: str, min_samples: int = 5) -> DataFrame:
    """``a, b, d``: a minimum spanning tree of mutual reachability distances."""
    core = core_distances(df, key, vector, min_samples)
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector)
    return spanning_tree(rows.join(core, key), key, vector, core="core")


@dataclass
class Window:
    """What the merges of some edges make of the components they meet: by component (an index), and by new cluster."""

    size: list[int]
    cluster: list[int | None]
    mass: list[float]  # of a cluster's points, the sum of the densities (1 / length) at which they left it
    below: list[float]  # the stability of the clusters that it is made of
    least: int  # clusters below this number have names already
    root: list[int] = field(default_factory=list)
    left: dict[int, tuple[float, int]] = field(default_factory=dict)  # points of a component that left, when, and which cluster
    ended: list[tuple[int, int | None, float, float, bool]] = field(default_factory=list)  # cluster, the one it is part of, birth, stability, chosen

    def __post_init__(self) -> None:
        self.root = list(range(len(self.size)))
        self.held = {i: [i] for i, c in enumerate(self.cluster) if c is None}  # components in those that are no cluster yet
        self.next = self.least

    def find(self, v: int) -> int:
        while self.root[v] != v:
            self.root[v] = v = self.root[self.root[v]]
        return v

    def merge(self, parts: list[int], density: float, least_size: int) -> None:
        """The components ``parts`` become one, under the name of the first."""
        clusters = [c for c in parts if self.cluster[c] is not None]
        small = [c for c in parts if self.cluster[c] is None]
        total, loose = sum(self.size[c] for c in parts), sum(self.size[c] for c in small)
        if len(clusters) == 1:
            one = clusters[0]
            name, mass, below = self.cluster[one], self.mass[one] + loose * density, self.below[one]
        elif total >= least_size:
            name, mass, below = self.next, total * density, 0.0
            self.next += 1
            for c in clusters:
                below += self.end(c, name, density)
        else:
            name, mass, below = None, 0.0, 0.0
        first = parts[0]
        waiting = [x for c in small for x in self.held.pop(c)]
        if name is None:
            self.held[first] = waiting
        else:
            self.left.update((x, (density, name)) for x in waiting)
        for c in parts:
            self.root[c] = first
        self.size[first], self.cluster[first], self.mass[first], self.below[first] = total, name, mass, below

    def end(self, c: int, into: int | None, density: float) -> float:
        """A cluster ends as part of another one; the better of its stability and that of what it is made of."""
        own = self.mass[c] - self.size[c] * density
        self.ended.append((self.cluster[c], into, density, own, into is not None and own >= self.below[c]))
        return max(own, self.below[c])


def merged_window(a: np.ndarray, b: np.ndarray, d: np.ndarray, state: Window, least_size: int, shortest: float) -> None:
    """Merges along edges between components (indices), from short to long; those of one length at once."""
    order = np.lexsort((b, a, d))
    a, b, d = a[order].tolist(), b[order].tolist(), d[order]
    cuts = [*np.flatnonzero(np.append(True, d[1:] != d[:-1])).tolist(), len(d)] if len(d) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        density = 1.0 / max(float(d[lo]), shortest)
        if hi == lo + 1:
            state.merge([state.find(a[lo]), state.find(b[lo])], density, least_size)
            continue
        group: dict[int, list[int]] = {}  # the components that edges of this length join, by any one of them
        owner: dict[int, int] = {}
        for i in range(lo, hi):
            u, v = state.find(a[i]), state.find(b[i])
            gu, gv = owner.setdefault(u, u), owner.setdefault(v, v)
            group.setdefault(gu, [gu])
            group.setdefault(gv, [gv])
            if gu != gv:
                if len(group[gu]) < len(group[gv]):
                    gu, gv = gv, gu
                for c in group[gv]:
                    owner[c] = gu
                group[gu] += group.pop(gv)
        for parts in group.values():
            state.merge(sorted(parts), density, least_size)


def condensed(tree: DataFrame, points: DataFrame, key: str, min_cluster_size: int = 5, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The condensed tree: ``key, cluster, density`` of every point that was in a cluster (the first one, and when it left
    it), and ``cluster, parent, birth, stability, chosen`` of every cluster (numbers; the whole has no parent)."""
    spark = tree.sparkSession
    tree = tree.select("a", "b", "d").checkpoint()
    n, shortest = tree.agg(F.count("*"), F.min(F.when(F.col("d") > 0, F.col("d")))).first()
    shortest = shortest or 1.0
    loose, edges = points.select(F.col(key).cast("long").alias("k")).withColumn("c", F.col("k")), tree.filter("d > 0")
    states = spark.createDataFrame([], "c long, size long, cluster long, mass double, below double")
    placed, count = [], 0
    if not tree.filter("d = 0").isEmpty():
        # points at length 0 are one component from the start; if there are enough, a cluster (these are numbered below 0)
        here = merged_groups(tree.filter("d = 0")).select(F.col("key").alias("k"), F.col("group_id").alias("c"))
        large = F.col("size") >= min_cluster_size
        number = F.when(large, -1 - F.monotonically_increasing_id())
        states = here.groupBy("c").agg(F.count("*").alias("size")).select("c", "size", number.alias("cluster"), F.when(large, F.col("size") / F.lit(float(shortest))).otherwise(0.0).alias("mass"), F.lit(0.0).alias("below")).checkpoint()
        first = loose.select("k").join(here, "k", "left").withColumn("c", F.coalesce("c", "k")).join(states.select("c", "cluster"), "c", "left").checkpoint()
        placed.append(first.filter("cluster is not null").select("k", "cluster", F.lit(1.0 / shortest).alias("density")))
        loose = first.filter("cluster is null").select("k", "c")
        for end in ("a", "b"):
            edges = edges.join(here.withColumnRenamed("k", end), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    clusters: list[DataFrame] = []
    parts = max(1, math.ceil(n / window))
    cuts = sorted(set(edges.agg(F.percentile_approx("d", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    for cut in [*cuts, math.inf]:
        held = edges.filter(F.col("d") <= cut)
        for end in ("a", "b"):
            held = held.join(states.select(F.col("c").alias(end), *(F.col(x).alias(f"{x}_{end}") for x in ("size", "cluster", "mass", "below"))), end, "left")
        rows = held.toArrow().to_pydict()
        names, at = np.unique(np.array(rows["a"] + rows["b"], np.int64), return_inverse=True)
        known: list[tuple] = [(1, None, 0.0, 0.0)] * len(names)
        for end, half in (("a", at[: len(rows["a"])]), ("b", at[len(rows["a"]) :])):
            for i, *s in zip(half.tolist(), *(rows[f"{x}_{end}"] for x in ("size", "cluster", "mass", "below"))):
                if s[0] is not None:
                    known[i] = tuple(s)
        state = Window(*map(list, zip(*known)), least=count) if known else Window([], [], [], [], count)
        m = len(rows["a"])
        merged_window(at[:m], at[m:], np.array(rows["d"], np.float64), state, min_cluster_size, shortest)
        count = state.next
        if cut == math.inf:  # all is one component by now
            for c in {state.find(i) for i in range(len(names))}:
                if state.cluster[c] is not None:
                    state.end(c, None, 0.0)
        roots = [state.find(i) for i in range(len(names))]
        ended = pa.table(dict(zip(("cluster", "parent", "birth", "stability", "chosen"), (pa.array(c, t) for c, t in zip(zip(*state.ended) if state.ended else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))))))
        clusters.append(spark.createDataFrame(ended))
        went = pa.table({"c": names[list(state.left)] if state.left else pa.array([], pa.int64()), "density": pa.array([x[0] for x in state.left.values()], pa.float64()), "cluster": pa.array([x[1] for x in state.left.values()], pa.int64())})
        placed.append(loose.join(spark.createDataFrame(went), "c").select("k", "cluster", "density").checkpoint())
        if cut == math.inf:
            break
        new = pa.table({"c": names, "to": names[roots], "out": pa.array([i in state.left for i in range(len(names))])})
        moved = spark.createDataFrame(new)
        loose = loose.join(moved, "c", "left").filter("out is null or not out").select("k", F.coalesce("to", "c").alias("c")).checkpoint()
        edges = edges.filter(F.col("d") > cut)
        for end in ("a", "b"):
            edges = edges.join(moved.select(F.col("c").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = edges.checkpoint()
        live = sorted(set(roots))
        update = pa.table({"c": names[live], "size": pa.array([state.size[i] for i in live], pa.int64()), "cluster": pa.array([state.cluster[i] for i in live], pa.int64()), "mass": pa.array([state.mass[i] for i in live], pa.float64()), "below": pa.array([state.below[i] for i in live], pa.float64())})
        states = states.join(moved.select("c"), "c", "left_anti").union(spark.createDataFrame(update)).checkpoint()
    out = placed[0]
    for p in placed[1:]:
        out = out.union(p)
    found = clusters[0]
    for c in clusters[1:]:
        found = found.union(c)
    return out.select(F.col("k").alias(key), "cluster", "density"), found.checkpoint()


def outermost(clusters: DataFrame) -> DataFrame:
    """``cluster, top``: the outermost chosen cluster that holds each cluster (itself counted), by pointers that jump to
    their pointer's end; null if there is none."""
    known = clusters.select("cluster", "parent", F.when(F.col("chosen"), F.col("cluster")).alias("top")).checkpoint()
    while not known.filter("parent is not null").isEmpty():
        above = known.select(F.col("cluster").alias("parent"), F.col("parent").alias("further"), F.col("top").alias("higher"))
        known = known.join(above, "parent", "left").select("cluster", F.col("further").alias("parent"), F.coalesce("higher", "top").alias("top")).checkpoint()
    return known.select("cluster", "top")


def hdbscan(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5, min_samples: int | None = None, window: int = WINDOW) -> DataFrame:
    """``key, cluster_id, membership`` of every row with a vector: the cluster (null: noise), and how dense the point is
    beside its cluster's densest, from 0 to 1."""
    tree = reachability_tree(df, key, vector, min_samples or min_cluster_size)
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key))
    points, clusters = condensed(tree, rows, key, min_cluster_size, window)
    inside = points.join(outermost(clusters), "cluster").filter("top is not null").select(key, "top", "density").checkpoint()
    names = inside.groupBy("top").agg(F.min(key).alias("cluster_id"), F.max("density").alias("most"))
    found = inside.join(names, "top").select(key, "cluster_id", (F.col("density") / F.col("most")).alias("membership"))
    return rows.join(found, key, "left").select(key, "cluster_id", F.coalesce("membership", F.lit(0.0)).alias("membership"))


def centres(clusters: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
    """``cluster_id, x``: the mean of each cluster's vectors. Sums by cluster and dimension are partial aggregates."""
    rows = clusters.filter("cluster_id is not null").join(df.select(key, F.col(vector).cast("array<double>").alias("x")), key)
    means = rows.select("cluster_id", F.posexplode("x").alias("dim", "v")).groupBy("cluster_id", "dim").agg(F.avg("v").alias("c"))
    return means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("x"))


def centre_distances(df: DataFrame, reference: DataFrame, clusters: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, cluster_id, dist`` of the rows of ``df``: the nearest centre of the reference's clusters (exact, in blocks)."""
    middle = centres(clusters, reference, key, vector).select(F.col("cluster_id").alias(key), F.col("x").alias(vector)).checkpoint()
    return knn(df, middle, key, vector, 1, exclude_self=False).select(key, F.col("neighbor").alias("cluster_id"), "dist")


def density_distances(df: DataFrame, key: str, vector: str, min_cluster_size: int = 5) -> DataFrame:
    """``key, metric_value, cluster_id, deviations``: as ``quality.cluster_distances``, by density clusters: a member's
    distance to its own centre, noise to the nearest one; deviations are those of the cluster's members. Without a cluster
    there are no rows."""
    clusters = hdbscan(df, key, vector, min_cluster_size).checkpoint()
    middle = centres(clusters, df, key, vector).checkpoint()
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("x"))
    apart = F.sqrt(F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    inside = clusters.filter("cluster_id is not null").join(rows, key).join(middle.withColumnRenamed("x", "m"), "cluster_id").select(key, "cluster_id", apart.alias("metric_value")).checkpoint()
    noise = df.join(clusters.filter("cluster_id is null").select(key), key, "left_semi")
    outside = centre_distances(noise, df, clusters, key, vector).select(key, "cluster_id", F.col("dist").alias("metric_value"))
    usual = inside.groupBy("cluster_id").agg(F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("std"))
    placed = inside.union(outside).join(usual, "cluster_id")
    return placed.select(key, "metric_value", "cluster_id", F.when(F.col("std") > 0, (F.col("metric_value") - F.col("mean")) / F.col("std")).otherwise(F.lit(0.0)).alias("deviations"))


def hdbscan_scores(pool: DataFrame, reference: DataFrame, key: str, vector: str, method: str = "hdbscan_distance", min_cluster_size: int = 5) -> DataFrame:
    """``key, score`` of the pool by density clusters of the reference. hdbscan_distance: distance to the nearest centre;
    hdbscan_complexity: that, over the mean distance of the centre's own members. A reference without clusters is one."""
    if method not in ("hdbscan_distance", "hdbscan_complexity"):
        raise ValueError(f"unknown method {method!r}")
    clusters = hdbscan(reference, key, vector, min_cluster_size).checkpoint()
    if clusters.filter("cluster_id is not null").isEmpty():
        clusters = clusters.withColumn("cluster_id", F.lit(0).cast("long"))
    scored = centre_distances(pool, reference, clusters, key, vector)
    if method == "hdbscan_distance":
        return scored.select(key, F.col("dist").alias("score"))
    own = reference.join(clusters.filter("cluster_id is not null").select(key), key, "left_semi")
    usual = centre_distances(own, reference, clusters, key, vector).groupBy("cluster_id").agg(F.avg("dist").alias("usual"))
    return scored.join(usual, "cluster_id", "left").select(key, (F.col("dist") / F.greatest(F.coalesce("usual", F.lit(0.0)), F.lit(1e-12))).alias("score"))


def cluster_duplicates(df: DataFrame, key: str, vector: str, sensitivity: float, clusters: DataFrame) -> DataFrame:
    """``key, group_id, dup_type``: the single-linkage tree of each cluster (noise is one of its own) is cut at
    ``sensitivity`` times the mean length of its edges; what hangs together below the cut is a group, ``exact`` if all its
    edges are of length 0. Groups are named by their smallest member; rows in none are left out."""
    tree = spanning_tree(df.select(F.col(key).cast("long").alias(key), vector), key, vector)
    label = clusters.select(F.col(key).alias("a"), F.coalesce(F.col("cluster_id"), F.lit(-1)).alias("l"), F.col("cluster_id").isNull().alias("noise"))
    both = tree.join(label, "a").join(label.toDF("b", "l2", "noise2"), "b").filter("l = l2 and noise = noise2").checkpoint()
    scale = both.groupBy("l", "noise").agg(F.avg("d").alias("mean"))
    short = both.join(scale, ["l", "noise"]).filter((F.col("d") < sensitivity * F.col("mean")) | (F.col("d") == 0)).select("a", "b", "d").checkpoint()
    groups = merged_groups(short)
    near = short.join(groups, F.col("a") == F.col("key")).groupBy("group_id").agg((F.max("d") > 0).alias("near"))
    return groups.join(near, "group_id").select(F.col("key").alias(key), "group_id", F.when(F.col("near"), "near").otherwise("exact").alias("dup_type"))
