"""The eight workflows, their findings, and how tasks run.

A workflow composes operators into raw tables (DataFrames, lazy) and a few collected aggregates; findings grade those.
Any error becomes a failed result with its message.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import __version__
from plumbline.functions.moments import CUTOFFS
from plumbline.operators import density, duplicates, embedding, encoding, labels, neighbors, ontology, quality, shift, splitting
from plumbline.plans import config as c
from plumbline.plans.views import STEPS, build_view
from plumbline.sources import rdf
from plumbline.sources.cache import TableCache, lineage_key
from plumbline.sources.datasets import SourceFrames, fingerprint, load_dataset
from plumbline.sources.images import image_stats
from plumbline.streaming import references

KEY, LABEL = "item_index", "class_label"


@dataclass
class Finding:
    title: str
    severity: str  # ok, info, warning
    report_type: str
    data: Any
    description: str = ""


@dataclass
class Result:
    name: str
    success: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    scalars: dict[str, Any] = field(default_factory=dict)
    findings: list[Finding] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    envelope: dict[str, Any] = field(default_factory=dict)
    descriptor: str | None = None
    cache: TableCache | None = field(default=None, repr=False)  # where the task's embeddings and clusters are kept

    def to_dict(self) -> dict:
        return {"name": self.name, "success": self.success, "metadata": self.envelope, "scalars": self.scalars, "findings": [vars(f) for f in self.findings], "errors": self.errors, "tables": {n: df.columns for n, df in self.tables.items()}}

    def export(self, path: str | Path | None = None, fmt: str = "json") -> str:
        """As JSON or YAML: into a file (a folder gets ``results.<fmt>``), or returned."""
        plain = json.loads(json.dumps(self.to_dict(), default=str))
        text = json.dumps(plain, indent=2) if fmt == "json" else yaml.safe_dump(plain, sort_keys=False)
        if path:
            at = Path(path)
            (at / f"results.{fmt}" if at.is_dir() else at).write_text(text)
        return text

    def write_tables(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    def report(self, detailed: bool = True, width: int = 80) -> str:
        worst = max((f.severity for f in self.findings), key=("ok", "info", "warning").index, default="ok")
        lines = ["=" * width, self.name.center(width).rstrip(), "=" * width]
        lines += [f"{k} {'.' * max(2, width - len(k) - len(str(v)) - 2)} {v}" for k, v in self.envelope.items() if not isinstance(v, (dict, list))]
        lines += ["-" * width]
        for f in self.findings:
            mark = f"[{f.severity}]"
            lines.append(f"{f.title} {'.' * max(2, width - len(f.title) - len(mark) - 2)} {mark}")
        lines += [f"Health: {worst}" if self.success else f"FAILED: {'; '.join(self.errors)}"]
        if detailed:
            for f in self.findings:
                lines += ["", f.title, "-" * len(f.title), *([f.description] if f.description else []), *(f"  {k}: {v}" for k, v in (f.data.items() if isinstance(f.data, dict) else enumerate(f.data)))]
            for title, held in (("METADATA FACTORS", self.envelope.get("metadata")), ("CONFIGURATION", self.envelope.get("resolved_config"))):
                if held:
                    lines += ["", title, "-" * len(title), *(f"  {k}: {v}" for k, v in held.items())]
        return "\n".join(lines)


def graded(value: float, warning: float, info: float = 0.0) -> str:
    return "warning" if value > warning else "info" if value > info else "ok"


def _rows(df: DataFrame) -> list[dict]:
    """A result of classes, splits or parameters (dimensions), whole, for a report."""
    return [r.asDict() for r in df.collect()]


def _percent(n: int, of: int) -> float:
    return round(100.0 * n / of, 1) if of else 0.0


def _label_counts(s: SourceFrames) -> DataFrame | None:
    """``class_name, n, missing`` of the declared classes, or of those that occur."""
    labelled = s.targets if s.targets is not None and LABEL in s.targets.columns else s.items
    if LABEL not in labelled.columns:
        return None
    if s.classes is not None and {LABEL, "class_name"} <= set(s.classes.columns):
        return labels.distribution(labelled, s.classes, LABEL, "class_name")
    return labels.label_counts(labelled, LABEL).select(F.col(LABEL).cast("string").alias("class_name"), "n", F.lit(False).alias("missing"))


def _label_finding(s: SourceFrames, limit: float, info: float | None = None, title: str = "Label Distribution") -> list[Finding]:
    counts = _label_counts(s)
    if counts is None:
        return []
    ratio = labels.imbalance(counts, positive_only=True).first()[0]
    found = _rows(counts)
    empty = sorted(r["class_name"] for r in found if r["missing"])
    severity = "warning" if empty or ratio > limit else "info" if info is not None and ratio > info else "ok"
    return [Finding(title, severity, "table", {"counts": {r["class_name"]: r["n"] for r in found}, "missing": empty, "imbalance_ratio": ratio})]


def _algorithm(name: str | None, clusters: int | None) -> str:
    return name or ("kmeans" if clusters else "hdbscan")


def _kept(cache: TableCache | None, name: str, said: list, inputs: list[tuple[DataFrame, list[str]]], compute: Callable[[], DataFrame]) -> DataFrame:
    """A table that is computed once for what it is made of: these columns of these inputs, whatever rows a view or a filter
    has left of them, and ``said``, the parameters."""
    if cache is None:
        return compute()
    return cache.table(lineage_key(name, said, *(fingerprint(df.select(*columns)) for df, columns in inputs)), name, compute)


def _cluster_distances(items: DataFrame, embedding: str, name: str | None, clusters: int | None, cache: TableCache | None = None) -> DataFrame:
    """``key, metric_value, cluster_id, deviations`` by the algorithm asked for."""
    algorithm = _algorithm(name, clusters)
    if algorithm == "hdbscan":
        return _kept(cache, "clusters", [algorithm], [(items, [KEY, embedding])], lambda: density.density_distances(items, KEY, embedding))
    return _kept(cache, "clusters", [algorithm, clusters or 10], [(items, [KEY, embedding])], lambda: quality.cluster_distances(items, KEY, embedding, clusters or 10, algorithm=algorithm))


def _cluster_groups(items: DataFrame, embedding: str, sensitivity: float, name: str | None, clusters: int | None, cache: TableCache | None = None) -> DataFrame:
    """``key, group_id`` of what hangs together below the cut in the tree of each cluster."""
    algorithm, of = _algorithm(name, clusters), [(items, [KEY, embedding])]

    def compute() -> DataFrame:
        if algorithm == "hdbscan":
            placed = _kept(cache, "members", [algorithm], of, lambda: density.hdbscan(items, KEY, embedding))
        else:
            placed = _cluster_distances(items, embedding, name, clusters, cache)
        return density.cluster_duplicates(items, KEY, embedding, sensitivity, placed.select(KEY, F.col("cluster_id").cast("long").alias("cluster_id"))).select(F.col(KEY).alias("key"), "group_id")

    return _kept(cache, "cluster_groups", [algorithm, clusters, sensitivity], of, compute)


def _near_groups(items: DataFrame, p: c.Duplicates | c.PriorCleaning, embedding: str | None = None, cache: TableCache | None = None) -> DataFrame | None:
    """``key, group_id, first`` (the group's smallest member) of near duplicates over all methods asked for; without merging,
    ``method`` too: groups by it. Groups of clusters come after the others, numbered behind them."""
    edges, wanted = [], getattr(p, "duplicate_cluster_sensitivity", None) if embedding else None
    by_tree = bool(wanted) and p.duplicate_cluster_algorithm != "neighbors"
    if p.near_signatures:
        edges.append(duplicates.signature_edges(items, KEY, {x: x for x in p.near_signatures}))
    if wanted and not by_tree:
        edges.append(duplicates.short_edges(items, KEY, embedding, wanted))
    parts = []
    if edges:
        every = reduce(DataFrame.unionByName, edges)
        if getattr(p, "duplicate_merge_near", True):
            parts = [duplicates.merged_groups(every)]
        else:
            parts = [duplicates.merged_groups(every.filter(F.col("method") == m)).withColumn("method", F.lit(m)) for (m,) in every.select("method").distinct().collect()]
        parts = [g.withColumn("first", F.col("group_id")) for g in parts]
    if by_tree:
        before = max((g.agg(F.max("group_id")).first()[0] for g in parts), default=None)
        groups = _cluster_groups(items, embedding, wanted, p.duplicate_cluster_algorithm, p.duplicate_n_clusters, cache)
        groups = groups.select("key", (F.col("group_id") + F.lit(0 if before is None else before + 1)).alias("group_id"), F.col("group_id").alias("first"))
        parts.append(groups if getattr(p, "duplicate_merge_near", True) else groups.withColumn("method", F.lit("cluster")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _duplicates(items: DataFrame, n: int, p: Any, prefix: str, title: str, out: Result) -> DataFrame:
    """Tables and finding of exact and near duplicates; returns the copies that the flag policy removes."""
    copies = items.select(KEY).limit(0)
    exact = near = 0
    if p.content:
        out.tables[f"{prefix}duplicates"] = quality.exact_duplicates(items, KEY, p.content)
        copies = quality.flagged_copies(items, KEY, p.content)
        exact = copies.count()
    groups = _near_groups(items, p, getattr(p, "embedding", None), out.cache)
    if groups is not None:
        out.tables[f"{prefix}near_duplicates"] = groups
        more = groups.filter(F.col("key") != F.col("first")).select(F.col("key").alias(KEY)).distinct()
        near = more.count()
        copies = copies.union(more).distinct()
    if exact or near:
        shares = {"exact_percent": _percent(exact, n), "near_percent": _percent(near, n)}
        warn = shares["exact_percent"] > p.exact_warning or shares["near_percent"] > p.near_warning
        out.findings.append(Finding(title, "warning" if warn else "info", "key_value", shares))
    return copies


def cleaning(sources: dict[str, SourceFrames], p: c.Cleaning, out: Result) -> None:
    source = next(iter(sources.values()))
    items = source.items
    n = items.count()
    issues = quality.outlier_issues(items, [KEY], p.chosen(items.columns), p.outlier_method, p.outlier_threshold)
    if p.outlier_cluster_threshold:
        far = _cluster_distances(items, p.embedding, p.outlier_cluster_algorithm, p.outlier_n_clusters, out.cache).filter(F.col("deviations") > p.outlier_cluster_threshold)
        issues = issues.unionByName(far.select(KEY, F.lit("cluster_distance").alias("metric_name"), "metric_value")).dropDuplicates([KEY, "metric_name"])
    out.tables |= {"outliers": issues, "outlier_summary": quality.summary_by_metric(issues, [KEY])}
    flagged = issues.select(KEY).distinct()
    count = flagged.count()
    out.findings.append(Finding("Image Outliers", graded(_percent(count, n), p.outlier_warning), "pivot_table", {"count": count, "percent": _percent(count, n), "by_metric": {r["metric_name"]: r["outlier_count"] for r in _rows(out.tables["outlier_summary"])}}))
    if p.target_metrics and source.targets is not None:
        found = quality.outlier_issues(source.targets, [KEY, "target_index"], p.target_metrics, p.outlier_method, p.outlier_threshold)
        out.tables["target_outliers"] = found
        hits, of = found.select(KEY, "target_index").distinct().count(), source.targets.count()
        if hits:
            out.findings.append(Finding("Target Outliers", graded(_percent(hits, of), p.target_warning), "key_value", {"count": hits, "percent": _percent(hits, of)}))
    copies = _duplicates(items, n, p, "", "Duplicates", out)
    if LABEL in items.columns:
        pivot = quality.classwise_pivot(issues, items, [KEY], LABEL)
        out.tables["classwise_outliers"] = pivot
        found = _rows(pivot)
        total = next((r["pct"] for r in found if r["class_name"] == "Total"), None) or 0.0
        worst = max((r for r in found if r["class_name"] != "Total"), key=lambda r: r["pct"] or 0.0, default=None)
        out.findings.append(Finding("Classwise Outliers", graded(total, p.classwise_warning), "pivot_table", {"total_percent": total, "worst_class": worst and worst["class_name"], "worst_percent": worst and worst["pct"]}))
    out.findings += _label_finding(source, p.imbalance_warning)
    out.scalars |= quality.cleaning_summary(items, KEY, issues, copies).first().asDict()
    if p.mode == "preparatory":
        out.tables |= {"clean_indices": quality.clean_rows(items, KEY, issues, copies)}


def _numeric(df: DataFrame, among: list[str] | None = None) -> list[str]:
    """Columns that can be factors: numbers and booleans, no hashes, keys or vectors."""
    kinds = dict(df.dtypes)
    return [n for n in (among or df.columns) if n in kinds and n not in (KEY, LABEL) and kinds[n].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")]


def _factors(items: DataFrame, p: c.Analysis) -> tuple[DataFrame, list[str]]:
    """Factors as they are, and metrics (if asked for) as decile codes."""
    extra = [m for m in _numeric(items, p.chosen(items.columns)) if m not in p.factors] if p.include_metrics else []
    return items.withColumns({m: b.code(F.col(m)) for m, b in encoding.uniform_counts(items, extra, 10).items()}) if extra else items, [*p.factors, *extra]


def analysis(sources: dict[str, SourceFrames], p: c.Analysis, out: Result) -> None:
    for name, s in sources.items():
        n = s.items.count()
        issues = quality.outlier_issues(s.items, [KEY], p.chosen(s.items.columns), p.outlier_method, p.outlier_threshold)
        out.tables[f"{name}.outliers"] = issues
        rate = _percent(issues.select(KEY).distinct().count(), n)
        out.findings.append(Finding(f"Image Quality: {name}", graded(rate, p.outlier_warning), "key_value", {"num_samples": n, "outlier_rate": rate}))
        out.findings += _label_finding(s, p.imbalance_warning, title=f"Label Balance: {name}")
        _duplicates(s.items, n, p, f"{name}.", f"Redundancy: {name}", out)
        coded, factors = _factors(s.items, p)
        if factors and p.balance and LABEL in s.items.columns:
            pairs = [(LABEL, f) for f in factors] + [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
            told = labels.adjusted_information(coded, pairs)
            out.tables |= {f"{name}.balance": told, f"{name}.classwise_balance": labels.classwise_information(coded, LABEL, factors)}
            high = {r["y_name"]: r["ami"] for r in _rows(told) if r["x_name"] == LABEL and r["ami"] > 0.5}
            out.findings.append(Finding(f"Bias: {name}", "warning" if high else "ok", "table", {"factors_told_by_label": high}))
        if factors and p.diversity_method:
            out.tables[f"{name}.diversity"] = labels.diversity(coded, factors, p.diversity_method)
    names = list(sources)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    kind = "key_value" if len(pairs) == 1 else "pivot_table"
    for a, b in pairs:
        x, y = sources[a].items, sources[b].items
        if LABEL in x.columns and LABEL in y.columns:
            shared = labels.overlap(x, y, LABEL)
            out.tables[f"{a}_vs_{b}.label_overlap"] = shared
            only = {r["class_name"]: r["presence"] for r in _rows(shared) if r["presence"] != "shared"}
            out.findings.append(Finding(f"Label Overlap: {a} vs {b}", "warning" if only else "ok", kind, {"only_in_one": only}))
            chi2, dof = labels.parity(y, x, LABEL).first()
            value = labels.chi2_sf(chi2, dof)
            out.tables[f"{a}_vs_{b}.label_parity"] = x.sparkSession.createDataFrame([(float(chi2), float(value), value < 0.05)], "chi2 double, p_val double, significant boolean")
            out.findings.append(Finding(f"Label Parity: {a} vs {b}", "warning" if value < 0.05 else "ok", kind, {"chi2": chi2, "p_value": value, "significant": value < 0.05}))
        if p.content:
            both = x.select(KEY, p.content, F.lit(a).alias("split")).union(y.select(KEY, p.content, F.lit(b).alias("split")))
            leaked = quality.leakage(both, KEY, p.content, "split")
            out.tables |= {f"{a}_vs_{b}.leakage": leaked, f"{a}_vs_{b}.leaked_items": quality.leaked_members(both, KEY, p.content, "split")}
            found = _rows(leaked)
            out.findings.append(Finding(f"Leakage: {a} vs {b}", "warning" if found else "ok", kind, {"rows": found}))
        if p.embedding and p.divergence_method:
            # keys are those of their sources: made unique over both
            one, two = (d.select((F.col(KEY) * 2 + i).alias(KEY), p.embedding) for i, d in enumerate((x, y)))
            value = neighbors.mst_divergence(one, two, KEY, p.embedding) if p.divergence_method == "mst" else neighbors.fnn_divergence(one, two, KEY, p.embedding).first()[0]
            level = "high" if value > p.shift_warning else "moderate" if value > 0.4 * p.shift_warning else "low"
            out.findings.append(Finding(f"Shift: {a} vs {b}", "warning" if level == "high" else "info" if level == "moderate" else "ok", kind, {"divergence": round(value, 6), "level": level}))


def coverage(sources: dict[str, SourceFrames], p: c.Coverage, out: Result) -> None:
    source = next(iter(sources.values()))
    items = source.items
    n = items.count()
    scaled = neighbors.min_max(items, KEY, p.embedding)
    uncovered, how = neighbors.coverage(scaled, KEY, "x", p.coverage_method, p.coverage_percent, p.num_observations)
    out.scalars |= {"coverage_method": how}
    if uncovered is not None:
        out.tables["uncovered"] = uncovered
        rate = _percent(uncovered.count(), n)
        out.scalars["uncovered_rate"] = rate
    else:
        rate = 0.0
    poor: dict[str, list[str]] = {}
    if LABEL in items.columns:
        profile = neighbors.class_profile(items, KEY, LABEL, p.embedding, p.min_class_samples, p.isotropy_min_samples, p.near_duplicate_factor)
        out.tables["class_profile"] = profile
        able = [r for r in _rows(profile) if r["assessable"]]
        poor = {
            "clustered": [str(r[LABEL]) for r in able if r["dispersion"] is not None and r["dispersion"] < p.dispersion_warning],
            "flat": [str(r[LABEL]) for r in able if r["isotropy"] is not None and r["isotropy"] < p.isotropy_warning],
            "padded": [str(r[LABEL]) for r in able if r["near_duplicate_fraction"] > p.near_duplicate_warning],
        }
    if uncovered is not None:
        warn = any(poor.values()) or (how == "naive" and rate > p.uncovered_warning)
        out.findings.append(Finding("Embedding Coverage", "warning" if warn else "info" if rate else "ok", "key_value", {"uncovered_rate": rate, **poor}))
    if p.run_completeness:
        score = neighbors.completeness(items, p.embedding)
        out.tables["nearest_pairs"] = neighbors.knn(items, items, KEY, p.embedding, 1).orderBy("dist", KEY)
        out.findings.append(Finding("Completeness", "warning" if score < p.completeness_warning else "info" if score < 0.8 else "ok", "scalar", {"score": round(score, 4)}))
    out.findings += _label_finding(source, p.imbalance_warning, 2)
    if p.factors and p.diversity_method:
        out.tables |= {"diversity": labels.diversity(items, p.factors, p.diversity_method)}
    if LABEL in items.columns and p.factors:
        told = labels.adjusted_information(items, [(LABEL, f) for f in p.factors])
        if p.balance:
            out.tables["balance"] = told
        if p.run_gap_analysis:
            useful = [r["y_name"] for r in _rows(told.filter(F.col("ami") >= p.gap_mi_threshold))]
            gaps = labels.metadata_gaps(items, LABEL, useful or p.factors[:0], p.gap_min_representation) if useful else None
            count = gaps.count() if gaps is not None else 0
            if gaps is not None:
                out.tables["metadata_gaps"] = gaps
            out.findings.append(Finding("Metadata Gaps", "warning" if count >= p.gap_warning else "info" if count else "ok", "table", {"count": count, "factors": useful}))
    counts = _label_counts(source)
    if counts is not None:
        try:
            _label_space(counts, p, out)
        except Exception as e:  # a hierarchy that can't be read is skipped, with the reason
            out.scalars["ontology_skipped"] = str(e)


def _label_space(counts: DataFrame, p: c.Coverage, out: Result) -> None:
    """Where the labels stand in a configured hierarchy; without one, against an even share of the classes."""
    spark, concepts = counts.sparkSession, None
    if p.ontology is None:
        edges = ontology.flat(counts.select("class_name"))
    else:
        edges, concepts = rdf.hierarchy(spark, p.ontology) if isinstance(p.ontology, str) else (ontology.from_mapping(spark, p.ontology), None)
    edges = edges.checkpoint()
    named = counts.select("class_name", "n")
    seen = named if concepts is None else ontology.by_concept(named, concepts).checkpoint()
    work = ontology.worklist(edges, seen, p.ontology_expected or None)
    out.tables["label_worklist"] = work
    todo = _rows(work)
    if p.ontology is None:
        out.findings.append(Finding("Class Balance", "warning" if any(r["action"] == "acquire" for r in todo) else "info" if todo else "ok", "table", {"worklist": todo}))
        return
    covered = ontology.leaf_coverage(edges, seen).first().asDict()
    dark = _rows(ontology.dark_branches(edges, seen))
    out.tables |= {"dark_branches": ontology.dark_branches(edges, seen), "label_names": ontology.resolve(named.select("class_name"), edges, concepts), "ontology_lint": ontology.lint(edges, p.ontology_label_pattern)}
    warn = covered["leaf_coverage"] < p.leaf_warning or len(dark) > p.dark_warning
    out.findings.append(Finding("Label Space", "warning" if warn else "info" if todo else "ok", "table", {**covered, "dark_branches": [r["node"] for r in dark], "worklist": todo}))
    wrong = [r for r in _rows(out.tables["label_names"]) if r["verdict"] != "one"]
    out.findings.append(Finding("Conformance", "warning" if len(wrong) > p.unmatched_warning else "ok", "table", {"unmatched": wrong}))
    lint = _rows(out.tables["ontology_lint"].groupBy("finding").agg(F.count("*").alias("n")))
    found = {r["finding"]: r["n"] for r in lint}
    out.findings.append(Finding("Structure", "warning" if "label_collision" in found else "info" if set(found) - {"root"} else "ok", "table", {**found, "max_depth": ontology.closure(edges).agg(F.max("depth")).first()[0]}))


def splits(sources: dict[str, SourceFrames], p: c.Splitting, out: Result) -> None:
    items = next(iter(sources.values())).items
    if p.split_on:
        assigned = splitting.grouped(items.select(KEY, p.split_on, *([LABEL] if LABEL in items.columns else [])), KEY, p.split_on, p.test_frac, p.num_folds, p.seed)
        assigned = assigned.join(items.select(KEY, LABEL), KEY) if LABEL in items.columns else assigned
    else:
        rows = items if p.stratify and LABEL in items.columns else items.withColumn(LABEL, F.lit(0))
        assigned = splitting.stratified(rows, KEY, LABEL, p.test_frac, 0.0 if p.num_folds > 1 else p.val_frac, p.num_folds, p.seed)
    if p.rebalance_method:
        train = splitting.rebalanced(assigned.filter("split = 'train'"), KEY, LABEL, p.rebalance_method, p.seed)
        assigned = assigned.filter("split <> 'train'").unionByName(train)
    out.tables["splits"] = assigned
    if LABEL in assigned.columns:
        counts = assigned.groupBy("split", LABEL).agg(F.count("*").alias("n"))
        out.tables["class_distribution"] = counts
        ratios = {r["split"]: round(r["ratio"], 1) for r in _rows(counts.groupBy("split").agg((F.max("n") / F.min("n")).alias("ratio")))}
        out.findings.append(Finding("Class Distribution", "warning" if any(r > 10 for r in ratios.values()) else "ok", "key_value", {"imbalance_ratio": ratios}))
        worst = splitting.deviation(assigned, LABEL)
        top = max((r["deviation"] for r in _rows(worst)), default=0.0)
        out.tables["deviation"] = worst
        out.findings.append(Finding("Stratification", "ok" if top <= 2 else "info" if top <= 10 else "warning", "key_value", {"max_deviation_pp": top}))
    if p.embedding:
        train = items.join(assigned.filter("split = 'train'").select(KEY), KEY, "left_semi")
        found, how = neighbors.coverage(neighbors.min_max(train, KEY, p.embedding), KEY, "x", "adaptive", p.coverage_percent, p.num_observations)
        rate = _percent(found.count(), train.count()) if found is not None else 0.0
        out.findings.append(Finding("Coverage", "warning" if rate > 5 else "ok", "key_value", {"uncovered_rate": rate, "method": how}))


def _two(sources: dict[str, SourceFrames]) -> tuple[DataFrame, DataFrame]:
    """The reference, and all other sources together."""
    frames = [s.items for s in sources.values()]
    if len(frames) < 2:
        raise ValueError("needs two sources at least; the first is the reference")
    rest = frames[1]
    for other in frames[2:]:
        rest = rest.unionByName(other, allowMissingColumns=True)
    return frames[0], rest


def _detector_names(detectors: list[dict], default: str) -> list[str]:
    """``method``, or ``method_1, method_2`` where a method comes more than once."""
    methods = [d.get("method", default) for d in detectors]
    return [m if methods.count(m) == 1 else f"{m}_{methods[: i + 1].count(m)}" for i, m in enumerate(methods)]


def detect_drift(reference: DataFrame, test: DataFrame, d: dict, vector: str) -> tuple[DataFrame, bool, dict]:
    """A detector's table, whether it sees drift, and what the finding says."""
    method, level = d.get("method", "univariate"), d.get("p_val", 0.05)
    if method == "univariate":
        tests = shift.univariate(shift.melted(reference, test, vector), ["dim"], d.get("test", "ks"), d.get("alternative", "two-sided"))
        found = shift.corrected(tests, level, d.get("correction", "bonferroni")).checkpoint()
        features = found.count()
        if d.get("n_features") not in (None, features):
            raise ValueError(f"expected {d['n_features']} features, found {features}")
        count = found.filter("drifted").count()
        return found, count > 0, {"drifted_features": count, "min_p": found.agg(F.min("p_val")).first()[0]}
    if method == "mmd":
        found = shift.drift_mmd(reference, test, KEY, vector, permutations=d.get("n_permutations", 100))
        row = found.first()
        return found, row.p_val < level, {"mmd2": row.mmd2, "p_val": row.p_val}
    if method == "knn":
        k = d.get("k", 10)
        own = neighbors.mean_distance(neighbors.knn(reference, reference, KEY, vector, k), KEY)
        new = neighbors.mean_distance(neighbors.knn(test, reference, KEY, vector, k, exclude_self=False), KEY)
        found = shift.mwu(own.select(F.col("score").alias("v"), F.lit(0).alias("is_test")).union(new.select("score", F.lit(1))), []).checkpoint()
        row = found.first()
        return found, row.z > 0 and row.p_val / 2 < level, {"z": row.z, "p_val": row.p_val / 2 if row.z > 0 else 1 - row.p_val / 2}
    if method == "domain_classifier":
        auroc, drifted, found = shift.domain_classifier(reference, test, KEY, vector, d.get("n_folds", 5), d.get("threshold", 0.55))
        return found, drifted, {"auroc": auroc}
    raise ValueError(f"unknown drift detector {method!r}")


def drift(sources: dict[str, SourceFrames], p: c.Drift, out: Result) -> None:
    reference, test = _two(sources)
    for name, d in zip(_detector_names(p.detectors, "univariate"), p.detectors):
        try:
            found, drifted, said = detect_drift(reference, test, d, p.embedding)
            out.tables[name] = found
            out.findings.append(Finding(f"Drift: {name}", ("warning" if p.drift_warning else "info") if drifted else "ok", "key_value", {"drifted": bool(drifted), **said}))
            if d.get("chunking"):
                _drift_chunks(reference, test, name, d, found, p, out)
            if d.get("classwise"):
                _drift_classes(reference, test, name, d, p, out)
        except Exception as e:  # a failing detector doesn't fail the task
            out.errors.append(f"{name}: {e}")
    if p.update_strategy:
        out.tables["updated_reference"] = references.updated(reference, test, KEY, p.update_strategy.n, p.update_strategy.type, seed=p.seed)


def _drift_chunks(reference: DataFrame, test: DataFrame, name: str, d: dict, scored: DataFrame, p: c.Drift, out: Result) -> None:
    """The detector's own statistic of each chunk, against a band around those of the reference's chunks."""
    spec, method = d["chunking"], d.get("method", "univariate")
    rows = shift.in_chunks(reference, test, p.embedding, KEY, spec.get("chunk_size"), spec.get("chunk_count"), spec.get("incomplete", "keep")).checkpoint()
    if method == "univariate":
        values = shift.univariate_chunks(reference, rows, p.embedding, d.get("test", "ks"))
    elif method == "mmd":
        values = shift.mmd_chunks(reference, rows, p.embedding)
    elif method == "knn":
        values = shift.knn_chunks(reference, rows, KEY, p.embedding, d.get("k", 10))
    else:  # what detect_drift has scored
        values = shift.classifier_chunks(scored, rows, KEY)
    values = values.checkpoint()
    found = shift.chunk_drift(values.filter("chunk < 0"), values.filter("chunk >= 0"), spec.get("threshold_multiplier", 3.0)).join(shift.chunk_spans(rows), "chunk")
    found = found.withColumn("key", F.concat(F.lit("["), "start_index", F.lit(":"), "end_index", F.lit("]"))).checkpoint()
    out.tables[f"{name}.chunks"] = found
    row = quality.longest_run(found, "chunk", "drifted").first()
    share, run = (row.pct_drifted or 0.0, row.longest_run) if row else (0.0, 0)
    warn = share >= p.chunk_warning or run >= p.run_warning
    out.findings.append(Finding(f"Chunked Drift: {name}", "warning" if warn else "info" if share else "ok", "key_value", {"percent_drifted": share, "longest_run": run}))


def _drift_classes(reference: DataFrame, test: DataFrame, name: str, d: dict, p: c.Drift, out: Result) -> None:
    """The detector in each class that has two rows on both sides. Classes are a dimension: one after the other, but for
    univariate tests, which take them all at once."""
    if LABEL not in reference.columns or LABEL not in test.columns:
        raise ValueError("classwise drift needs labels")
    sizes = {}
    for side, df in enumerate((reference, test)):
        for label, n in labels.label_counts(df, LABEL).collect():
            sizes.setdefault(label, [0, 0])[side] = n
    able = sorted((x for x, (a, b) in sizes.items() if a >= 2 and b >= 2), key=str)
    drifted: dict[str, bool] = {}
    if d.get("method", "univariate") == "univariate" and able:
        long = shift.melted(reference, test, p.embedding, LABEL).filter(F.col(LABEL).isin(able))
        found = shift.univariate(long, [LABEL, "dim"], d.get("test", "ks"), d.get("alternative", "two-sided"))
        found = shift.corrected(found, d.get("p_val", 0.05), d.get("correction", "bonferroni"), (LABEL,)).checkpoint()
        out.tables[f"{name}.classwise"] = found
        drifted = {str(r[0]): r[1] for r in found.groupBy(LABEL).agg(F.max("drifted")).collect()}
    else:
        for label in able:
            try:
                drifted[str(label)] = bool(detect_drift(reference.filter(F.col(LABEL) == label), test.filter(F.col(LABEL) == label), d, p.embedding)[1])
            except Exception as e:  # a class that can't be tested is skipped
                out.errors.append(f"{name}, class {label}: {e}")
        out.tables[f"{name}.classwise"] = reference.sparkSession.createDataFrame(list(drifted.items()), "class_name string, drifted boolean")
    hit = sorted(x for x, y in drifted.items() if y)
    skipped = sorted(str(x) for x in sizes if x not in able)
    out.findings.append(Finding(f"Classwise Drift: {name}", ("warning" if p.classwise_warning else "info") if hit else "ok", "table", {"drifted": hit, "skipped": skipped}))


def detect_ood(reference: DataFrame, test: DataFrame, d: dict, vector: str) -> DataFrame:
    """``key, score, threshold, is_ood`` of a detector."""
    method = d.get("method", "knn")
    if method == "knn":
        return neighbors.ood_knn(test, reference, KEY, vector, d.get("k", 10), d.get("metric", "cosine"), d.get("threshold_perc", 95.0))
    if method == "domain_classifier":
        return shift.ood_domain_classifier(reference, test, KEY, vector, d.get("n_folds", 5), d.get("n_repeats", 5), d.get("n_std", 2.0))
    raise ValueError(f"unknown OOD detector {method!r}")


def ood(sources: dict[str, SourceFrames], p: c.Ood, out: Result) -> None:
    reference, test = _two(sources)
    found: dict[str, DataFrame] = {}
    for name, d in zip(_detector_names(p.detectors, "knn"), p.detectors):
        scores = detect_ood(reference, test, d, p.embedding).checkpoint()
        found[name] = scores
        out.tables |= {f"{name}.scores": scores, f"{name}.histogram": neighbors.histogram(scores, "score")}
        out.scalars |= {f"{name}.{k}": v for k, v in neighbors.ood_summary(scores).first().asDict().items()}
    union = neighbors.ood_consensus(found, KEY).checkpoint()
    out.tables["consensus"] = union
    n, hits = union.count(), union.filter("any_ood").count()
    share = 100.0 * hits / n if n else 0.0
    row = {"ood_count": hits, "total_count": n, "ood_percentage": round(share, 2)}
    out.scalars |= row
    out.findings.append(Finding("Out of Distribution", "warning" if share >= p.ood_warning else "info" if share >= p.ood_info else "ok", "key_value", {**row, "detectors": {k: out.scalars[f"{k}.ood_percentage"] for k in found}}))
    factors = usable_factors(reference, test, p.factors or None) if p.metadata_insights else []
    if factors and hits:
        flagged = union.filter("any_ood").orderBy(F.col("consensus").desc(), KEY).limit(p.max_ood_insights)
        out.tables["factor_deviations"] = shift.factor_deviations(reference, test.join(flagged.select(KEY), KEY, "left_semi"), KEY, factors)
        marked = test.join(union.select(KEY, F.col("any_ood").alias("is_ood")), KEY)
        out.tables["factor_predictors"] = shift.factor_predictors(marked, "is_ood", factors).orderBy(F.col("mi_bits").desc(), "factor")


def usable_factors(reference: DataFrame, test: DataFrame, among: list[str] | None = None) -> list[str]:
    """Numeric columns of both that are finite throughout and not constant in the test: one pass each."""
    common = [f for f in _numeric(reference, among) if f in _numeric(test, among)]
    if not common:
        return []
    good = lambda f: (F.count(F.when(F.isnan(F.col(f).cast("double")) | (F.abs(F.col(f).cast("double")) == float("inf")), 1)) == 0).alias(f)
    a = reference.agg(*map(good, common)).first()
    b = test.agg(*map(good, common), *(F.coalesce(F.stddev_pop(F.col(f).cast("double")), F.lit(0.0)).alias(f"std_{f}") for f in common)).first()
    return [f for f in common if a[f] and b[f] and b[f"std_{f}"] > 0]


def prioritization(sources: dict[str, SourceFrames], p: c.Prioritization, out: Result) -> None:
    reference, pool = _two(sources)
    n = pool.count()
    if p.cleaning:
        reference, pool = _cleaned(reference, pool, p.cleaning, out)
    kept = pool.count()
    size = reference.count()
    if p.method == "knn":
        k = p.k or max(1, round(size**0.5))
        scores = neighbors.mean_distance(neighbors.knn(pool, reference, KEY, p.embedding, k, exclude_self=False), KEY)
    elif p.method.startswith("hdbscan"):
        compute = lambda: density.hdbscan_scores(pool, reference, KEY, p.embedding, p.method, p.min_cluster_size)
        sides = [(df, [KEY, p.embedding]) for df in (pool, reference) if df is not None]
        scores = _kept(out.cache, "scores", [p.method, p.min_cluster_size], sides, compute)
    else:
        scores = neighbors.kmeans_scores(pool, reference, KEY, p.embedding, p.c or max(2, round(size**0.5)), p.method)
    if p.policy == "class_balanced":
        scores = scores.join(pool.select(KEY, LABEL), KEY)
    out.tables["prioritized"] = neighbors.prioritize(scores, KEY, p.order, p.policy, p.num_bins, LABEL)
    removed = _percent(n - kept, n)
    out.findings.append(Finding("Pruning", "warning" if removed >= p.removed_warning else "info" if removed else "ok", "key_value", {"original_size": n, "cleaned_size": kept, "removed_percent": removed}))


def _cleaned(reference: DataFrame, pool: DataFrame, p: c.PriorCleaning, out: Result) -> tuple[DataFrame, DataFrame]:
    """Both without the outliers of each and without copies; of a group over both, the reference's first row stays."""
    kept = []
    for name, df in (("reference", reference), ("pool", pool)):
        if p.metrics:
            issues = quality.outlier_issues(df, [KEY], p.metrics, p.outlier_method, p.outlier_threshold)
            out.tables[f"{name}.outliers"] = issues
            df = df.join(issues.select(KEY).distinct(), KEY, "left_anti")
        kept.append(df)
    signed = {"content": p.content} if p.content else {}
    signed |= {} if p.duplicate_exact_only else {s: s for s in p.near_signatures}
    for column in signed.values():
        digest = F.when(F.col(column).isNotNull() & (F.col(column).cast("string") != ""), F.sha2(F.col(column).cast("binary"), 256))
        known = kept[0].select(digest.alias("d")).filter("d is not null").distinct()
        fresh = kept[1].withColumn("d", digest).join(known, "d", "left_anti").drop("d")
        kept = [df.join(quality.flagged_copies(df.filter(digest.isNotNull()), KEY, column), KEY, "left_anti") for df in (kept[0], fresh)]
    return kept[0].checkpoint(), kept[1].checkpoint()


def sweep(sources: dict[str, SourceFrames], p: c.Sweep, out: Result) -> None:
    """Counts of every combination of the swept lists: statistics once, embeddings' neighbours and clusters once each."""
    items = next(iter(sources.values())).items
    own = [t for t in p.outlier_threshold if t is not None]
    metrics = p.chosen(items.columns)
    parts = []
    if own:
        parts.append(quality.outlier_sweep(items, [KEY], metrics, p.outlier_method, own).select(F.lit("outliers").alias("kind"), "method", "threshold", F.col("outlier_count").alias("n")))
    if None in p.outlier_threshold:  # each method's own cutoff
        for m in p.outlier_method:
            parts.append(quality.outlier_sweep(items, [KEY], metrics, [m], [CUTOFFS[m]]).select(F.lit("outliers").alias("kind"), "method", F.lit(None).cast("double").alias("threshold"), F.col("outlier_count").alias("n")))
    if p.embedding and p.outlier_cluster_threshold:
        for algorithm in p.outlier_cluster_algorithm:  # clusters once for each
            far = _cluster_distances(items, p.embedding, algorithm, p.outlier_n_clusters, out.cache).checkpoint()
            algorithm = _algorithm(algorithm, p.outlier_n_clusters)
            for t in p.outlier_cluster_threshold:
                parts.append(far.filter(F.col("deviations") > t).agg(F.count("*").alias("n")).select(F.lit("cluster_outliers").alias("kind"), F.lit(algorithm).alias("method"), F.lit(float(t)).alias("threshold"), "n"))
    signatures = {x: x for x in p.near_signatures}
    if p.content:
        parts.append(quality.flagged_copies(items, KEY, p.content).agg(F.count("*").alias("n")).select(F.lit("exact_duplicates").alias("kind"), F.lit("content").alias("method"), F.lit(None).cast("double").alias("threshold"), "n"))
    signed = [duplicates.signature_edges(items, KEY, signatures)] if signatures else []
    wanted = [(t, a) for t in p.duplicate_cluster_sensitivity for a in p.duplicate_cluster_algorithm] if p.embedding else []
    for sensitivity, asked in wanted or ([(None, None)] if signatures else []):
        by_edges = sensitivity is not None and asked == "neighbors"
        edges = signed + ([duplicates.short_edges(items, KEY, p.embedding, sensitivity)] if by_edges else [])
        every = reduce(DataFrame.unionByName, edges).checkpoint() if edges else None
        more = None
        if sensitivity is not None and not by_edges:
            more = _cluster_groups(items, p.embedding, sensitivity, asked, p.duplicate_n_clusters, out.cache).filter("key <> group_id").select("key").checkpoint()
        for merge in p.duplicate_merge_near:
            chosen = [] if every is None else [every] if merge else [every.filter(F.col("method") == m) for (m,) in every.select("method").distinct().collect()]
            found = [duplicates.merged_groups(e).filter("key <> group_id").select("key") for e in chosen] + ([more] if more is not None else [])
            n = reduce(DataFrame.union, found).distinct().count() if merge else sum(f.count() for f in found)
            method = ("merged" if merge else "by method") + (f", {asked}" if asked else "")
            parts.append(items.sparkSession.createDataFrame([("near_duplicates", method, sensitivity, n)], "kind string, method string, threshold double, n long"))
    counts = reduce(DataFrame.unionByName, parts).checkpoint()
    out.tables["results"] = counts
    out.findings.append(Finding("Sweep", "ok", "table", _rows(counts.orderBy("kind", "method", "threshold"))))


WORKFLOWS: dict[str, Callable[[dict[str, SourceFrames], Any, Result], None]] = {
    "data-cleaning": cleaning, "data-analysis": analysis, "data-coverage": coverage, "data-splitting": splits, "drift-monitoring": drift, "ood-detection": ood, "data-prioritization": prioritization, "parameter-sweep": sweep,
}


def list_workflows() -> list[str]:
    return list(WORKFLOWS)


def policy_of(p: c.MetadataPolicy, df: DataFrame, root: str = ".", factors: tuple[str, ...] = ()) -> encoding.Policy:
    """Declared encodings, after those of a descriptor file; a bin count is fitted to the data by the policy's method. Of the
    ``factors`` that a workflow reads, continuous ones that nothing declares are binned, unless the policy is strict."""
    fit = {"uniform_width": encoding.uniform_width, "uniform_count": encoding.uniform_count, "clusters": encoding.cluster_bins}[p.auto_bin_method]
    encodings: dict = dict(encoding.from_descriptor(Path(c.resolve_path(p.encoding, root)).read_text()).encodings) if p.encoding else {}
    encodings |= {f: encoding.Levels(tuple(v)) for f, v in p.factor_levels.items()}
    encodings |= {f: fit(df, f, v) if isinstance(v, int) else encoding.Bins(tuple(v)) for f, v in p.continuous_factor_bins.items()}
    if not p.strict:
        continuous = {f for f, kind in df.dtypes if kind in ("float", "double")}
        encodings |= encoding.auto_bins(df, [f for f in factors if f in continuous and f not in encodings and f not in p.exclude], p.auto_bin_method)
    return encoding.Policy(encodings, tuple(p.exclude), p.strict, p.auto_bin_method, p.factor_source)


def with_image_stats(spark: SparkSession, frames: SourceFrames, cache: str | None = None) -> SourceFrames:
    """Items with the metrics and hashes of their images, joined by path; kept in ``cache`` under what the items are."""
    files = [r.path for r in frames.items.select(F.regexp_replace("path", "[^/]+$", "").alias("path")).distinct().collect()]  # folders
    compute = lambda: image_stats(spark.read.format("image").load(files)).drop("target_index")
    if cache:
        sized = [c for c in ("path", "length", "modificationTime") if c in frames.items.columns]
        stats = TableCache(spark, cache).table(lineage_key(fingerprint(frames.items, sized), "image_stats"), "image_stats", compute)
    else:
        stats = compute()
    stats = stats.withColumnRenamed("path", "__path")
    bare = lambda col: F.regexp_replace(col, "^[a-z]+:/*", "/")
    frames.items = frames.items.join(stats, bare(F.col("path")) == bare(F.col("__path")), "left").drop("__path")
    return frames


def with_embeddings(sources: dict[str, SourceFrames], e: c.Extractor, config: c.Pipeline, cache: TableCache | None = None) -> None:
    """Items with ``embedding`` of their pixels, after the extractor's preprocessing; all sources share the vocabulary of the
    first. Kept in ``cache`` under the items' files (pixels, where items are no whole files), the views' steps, which ``lineage``
    names, and the extractor's; labels and factors don't count."""
    steps = [s.model_dump() for s in config.get("preprocessors", e.preprocessor).steps] if e.preprocessor else []
    ready: dict[str, DataFrame] = {}
    made_of: dict[str, tuple[DataFrame, list[str]]] = {}
    for name, frames in sources.items():
        if "image" not in frames.items.columns:
            raise ValueError(f"extractor {e.name!r} needs decoded items (dataset option decode)")
        ready[name] = embedding.transformed(frames.items, steps) if steps else frames.items
        files = ("path", "length", "modificationTime")
        whole = set(files) <= set(frames.items.columns) and not any(o["type"] == "DetectionCrops" for o in frames.lineage or [])
        made_of[name] = (frames.items, [KEY, *(files if whole else ["image"])])
    first = next(iter(sources))
    words: list = []

    def compute(name: str) -> DataFrame:
        if e.model == "flatten":
            made = embedding.flattened(ready[name])
        else:
            if not words:  # only if an embedding isn't kept
                words.append(embedding.vocabulary(ready[first], e.vocab_size, seed=e.seed))
            made = embedding.bag_of_words(ready[name], words[0], e.vocab_size)
        return made.select(KEY, "embedding")

    said = [e.model_dump(exclude={"name", "preprocessor"}), steps]
    for name, frames in sources.items():
        inputs = [made_of[name]] if e.model == "flatten" else [made_of[name], made_of[first]]
        steps_of = [sources[n].lineage for n in ([name] if e.model == "flatten" else [name, first])]
        made = _kept(cache, "embeddings", [*said, steps_of], inputs, lambda name=name: compute(name))
        made = made if cache else made.checkpoint()
        frames.items = frames.items.drop("image", "embedding").join(made, KEY, "left")


def bind(spark: SparkSession, task: c.Task, config: c.Pipeline, root: str, frames_of: dict[str, SourceFrames] | None = None, cache: str | None = None) -> tuple[dict[str, SourceFrames], encoding.Policy | None]:
    """The task's sources and the policy that they share: fitted on the reference split (else each source's own; then the
    first one's is returned)."""
    out, shared = {}, None
    policy = config.get("metadata", task.metadata) if task.metadata else None
    if policy and policy.reference_split and policy.reference_split not in task.names:
        raise ValueError(f"reference split {policy.reference_split!r} is none of the sources {task.names}")
    for name in task.names:
        source = config.get("sources", name)
        dataset = config.get("datasets", source.dataset)
        held = (frames_of or {}).get(source.dataset)
        frames = replace(held) if held else load_dataset(spark, c.resolve_path(dataset.path, root), dataset.format, **dataset.options)
        if dataset.image_stats:
            frames = with_image_stats(spark, frames, cache)
        if source.view:
            operations = config.get("views", source.view).operations
            frames.items = build_view(frames.items, operations, KEY, targets=frames.targets)
            frames.lineage = [o for o in operations if o["type"] in STEPS or o["type"] == "DetectionCrops"]  # what the items' rows don't show
            if any(o["type"] == "DetectionCrops" for o in operations):
                frames.targets = None  # they are the items now
        out[name] = frames
    if task.extractor:
        with_embeddings(out, config.get("extractors", task.extractor), config, TableCache(spark, cache) if cache else None)
    if policy:
        first = policy.reference_split or task.names[0]
        factors = tuple(getattr(config.get("workflows", task.workflow), "factors", ()))
        shared = policy_of(policy, out[first].items, root, factors)
        for name, frames in out.items():
            frames.items = (shared if policy.reference_split or name == first else policy_of(policy, frames.items, root, factors)).apply(frames.items)
    return out, shared


def run_task(spark: SparkSession, task: c.Task, config: c.Pipeline, root: str = ".", frames: dict[str, SourceFrames] | None = None, cache: str | None = None) -> Result:
    """``frames``: datasets that are in memory, by name; they are not read from their paths."""
    params = config.get("workflows", task.workflow)
    out = Result(task.name, cache=TableCache(spark, cache) if cache else None)
    began = time.time()
    metadata: dict = {}
    binning: dict = {}
    try:
        sources, policy = bind(spark, task, config, root, frames, cache)
        if policy:
            out.descriptor = encoding.descriptor(policy)
            metadata = {f: type(e).__name__.lower() for f, e in policy.encodings.items()}
            asked = config.get("metadata", task.metadata)
            binning = encoding.binning_record(sources[asked.reference_split or task.names[0]].items, policy, asked.continuous_factor_bins)
        WORKFLOWS[params.type](sources, params, out)
    except Exception as e:
        out.success = False
        out.errors.append(f"{type(e).__name__}: {e}")
    out.envelope = {"version": __version__, "timestamp": datetime.now(UTC).isoformat(), "workflow": params.type, "sources": task.names, "seed": config.seed, "metadata": metadata, "metadata_binning": binning, "resolved_config": params.model_dump(), "execution_time_s": round(time.time() - began, 3)}
    return out


def run_tasks(spark: SparkSession, config: c.Pipeline, root: str = ".", only: list[str] | None = None, frames: dict[str, SourceFrames] | None = None, cache: str | None = None) -> list[Result]:
    """All enabled tasks in order, or those named; each result belongs to its own task."""
    chosen = [config.get("tasks", n) for n in only] if only else [t for t in config.tasks if t.enabled]
    return [run_task(spark, t, config, root, frames, cache) for t in chosen]
