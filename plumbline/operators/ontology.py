"""Label hierarchies: closure, representation of the leaves, dark branches, structure checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_mapping(spark: SparkSession, tree: dict, root: str | None = None) -> DataFrame:
    """Edges ``child, parent`` of nested mappings and lists of names (None or an empty mapping: a leaf)."""
    rows: list[tuple[str, str | None]] = []

    def walk(node, parent: str | None) -> None:
        for name in node or ():
            rows.append((name, parent))
            if isinstance(node, dict):
                walk(node[name], name)

    walk(tree, root)
    return spark.createDataFrame(rows, "child string, parent string")


def from_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Edges of ``subClassOf`` triples in an N-Triples file; names are what follows the last # or /."""
    local = lambda c: F.regexp_extract(c, r"([^#/>]+)>?$", 1)
    parts = spark.read.text(path).select(F.regexp_extract("value", r"^\s*<([^>]+)>\s+<[^>]*subClassOf>\s+<([^>]+)>", 1).alias("s"), F.regexp_extract("value", r"^\s*<([^>]+)>\s+<[^>]*subClassOf>\s+<([^>]+)>", 2).alias("o")).filter("s <> ''")
    return parts.select(local("s").alias("child"), local("o").alias("parent"))


def by_concept(counts: DataFrame, concepts: DataFrame) -> DataFrame:
    """``class_name, n`` with names that are the label of just one concept replaced by it."""
    one = concepts.filter("label is not null").groupBy("label").agg(F.min("concept").alias("concept"), F.count_distinct("concept").alias("hits")).filter("hits = 1")
    found = counts.join(one, F.col("class_name") == F.col("label"), "left").select(F.coalesce("concept", "class_name").alias("class_name"), "n")
    return found.groupBy("class_name").agg(F.sum("n").alias("n"))


def flat(names: DataFrame, root: str = "classes") -> DataFrame:
    """The hierarchy of classes without one: all below a root."""
    return names.select(F.col(names.columns[0]).alias("child"), F.lit(root).alias("parent")).union(names.sparkSession.createDataFrame([(root, None)], "child string, parent string"))


def closure(edges: DataFrame) -> DataFrame:
    """``node, ancestor, depth`` (shortest; a node is its own at 0). A hierarchy is a dimension: joined level by level, each a checkpoint."""
    known = edges.filter("parent is not null").select("child", "parent").distinct()
    nodes = edges.select(F.col("child").alias("node")).union(known.select("parent")).distinct()
    out = level = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    depth = 0
    while True:  # a cycle brings a node back to itself, else a level is empty at last
        depth += 1
        level = level.join(known, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct().checkpoint()
        n, cycles = level.agg(F.count("*"), F.count(F.when(F.col("node") == F.col("ancestor"), 1))).first()
        if not n:
            return out.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        if cycles:
            raise ValueError("the hierarchy has a cycle")
        out = out.union(level)


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).distinct().join(edges.filter("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def worklist(edges: DataFrame, counts: DataFrame, expected: dict[str, float] | None = None) -> DataFrame:
    """``node, n, target, shortfall, action`` of leaves below their target: an even share of all labels, or the expected
    share of a name. ``counts``: class_name, n. acquire: none yet; augment: too few."""
    leaf = leaves(edges)
    rows = leaf.join(counts.withColumnRenamed("class_name", "node"), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).crossJoin(F.broadcast(leaf.agg(F.count("*").alias("leaf_count"))))
    share = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v))))) if expected else F.lit(None).cast("map<string,double>")
    target = F.coalesce(F.try_element_at(share, F.col("node")) * F.col("total"), F.col("total") / F.col("leaf_count"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("target", target).filter(F.col("n") < F.col("target"))
    return rows.select("node", "n", F.round("target", 3).alias("target"), F.round(F.col("target") - F.col("n"), 3).alias("shortfall"), F.when(F.col("n") == 0, "acquire").otherwise("augment").alias("action"))


def leaf_coverage(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Share of leaves that have labels."""
    return leaves(edges).join(counts.filter("n > 0").select(F.col("class_name").alias("node"), F.lit(1).alias("one")), "node", "left").agg(F.round(F.avg(F.coalesce("one", F.lit(0)).cast("double")), 6).alias("leaf_coverage"), F.count("*").alias("leaf_count"))


def dark_branches(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """Inner nodes without a label at or below them whose parents have some: the tops of dark branches."""
    lit = closure(edges).join(counts.filter("n > 0").select(F.col("class_name").alias("node")), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    inner = edges.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    dark = inner.join(lit, "node", "left_anti")
    above = edges.filter("parent is not null").select(F.col("child").alias("node"), "parent").join(lit.select(F.col("node").alias("parent")), "parent", "left_semi").select("node")
    roots = edges.filter("parent is null").select(F.col("child").alias("node"))
    return dark.join(above.union(roots).distinct(), "node", "left_semi").distinct()


def resolve(names: DataFrame, edges: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """``class_name, matches, verdict``: how many concepts have the name as their label: one, none or ambiguous. ``concepts``
    (concept, label) tells concepts from their labels; without it a node's name is its label, and a node that stands under
    two parents is one concept."""
    if concepts is None:
        nodes = edges.select(F.col("child").alias("concept")).union(edges.filter("parent is not null").select("parent")).distinct()
        concepts = nodes.withColumn("label", F.col("concept"))
    known = concepts.filter("label is not null").groupBy(F.col("label").alias("class_name")).agg(F.count_distinct("concept").alias("hits"))
    found = names.select("class_name").distinct().join(known, "class_name", "left").select("class_name", F.coalesce("hits", F.lit(0)).alias("matches"))
    return found.withColumn("verdict", F.when(F.col("matches") == 0, "none").when(F.col("matches") == 1, "one").otherwise("ambiguous"))


def lint(edges: DataFrame, pattern: str | None = None) -> DataFrame:
    """``finding, node``: roots, isolated nodes, redundant edges, unary parents, siblings of their own ancestors, ancestors
    that are no node of their own, labels that collide but for case, names
    that miss the pattern."""
    known = edges.filter("parent is not null").select("child", "parent").distinct()
    nodes = edges.select(F.col("child").alias("node")).union(known.select("parent")).distinct()
    roots = nodes.join(known.select(F.col("child").alias("node")), "node", "left_anti")
    isolated = roots.join(known.select(F.col("parent").alias("node")), "node", "left_anti")
    far = closure(edges).filter("depth > 0")
    # an edge is redundant if another parent of the child already lies below its parent
    other = known.select(F.col("child").alias("c"), F.col("parent").alias("via"))
    redundant = known.join(other, F.col("child") == F.col("c")).filter("parent <> via").join(far.select(F.col("node").alias("via"), F.col("ancestor").alias("parent")), ["via", "parent"], "left_semi").select(F.col("child").alias("node"))
    unary = known.groupBy("parent").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("parent").alias("node"))
    # siblings one of which is above the other
    pair = known.select(F.col("child").alias("low"), "parent").join(known.select(F.col("child").alias("high"), "parent"), "parent").filter("low <> high")
    sibling = pair.join(far.select(F.col("node").alias("low"), F.col("ancestor").alias("high")), ["low", "high"], "left_semi").select(F.col("high").alias("node"))
    # parents that are named nowhere as a node of their own
    external = known.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    collide = nodes.groupBy(F.lower("node").alias("low")).agg(F.collect_set("node").alias("all")).filter(F.size("all") > 1).select(F.explode("all").alias("node"))
    found = [("root", roots), ("isolated", isolated), ("redundant_edge", redundant), ("unary_parent", unary), ("ancestor_sibling", sibling), ("external_ancestor", external), ("label_collision", collide)]
    if pattern:
        found.append(("pattern", nodes.filter(~F.col("node").rlike(pattern))))
    out = None
    for name, rows in found:
        part = rows.distinct().select(F.lit(name).alias("finding"), "node")
        out = part if out is None else out.union(part)
    return out
