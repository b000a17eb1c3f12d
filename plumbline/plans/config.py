"""Declarative configuration: named datasets, views, sources, policies, workflows and tasks; loading and merging."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Dataset(Strict):
    name: str
    format: Literal["huggingface", "image_folder", "coco", "yolo", "parquet"] = "huggingface"
    path: str
    options: dict[str, Any] = Field(default_factory=dict)
    image_stats: bool = False  # metrics and hashes of the images become columns of the items


class View(Strict):
    name: str
    operations: list[dict[str, Any]]


class Source(Strict):
    name: str
    dataset: str
    view: str | None = None


class MetadataPolicy(Strict):
    name: str
    factor_levels: dict[str, list[str]] = Field(default_factory=dict)
    continuous_factor_bins: dict[str, int | list[float]] = Field(default_factory=dict)
    exclude: list[str] = Field(default_factory=list)
    strict: bool = False
    auto_bin_method: Literal["uniform_width", "uniform_count", "clusters"] = "uniform_width"
    factor_source: Literal["coded", "values", "auto"] = "coded"
    reference_split: str | None = None
    encoding: str | None = None  # a descriptor file; declared encodings go before its own

    @model_validator(mode="after")
    def declared_once(self) -> MetadataPolicy:
        twice = set(self.factor_levels) & set(self.continuous_factor_bins)
        if twice:
            raise ValueError(f"declared twice: {sorted(twice)}")
        if self.strict and not (self.factor_levels or self.continuous_factor_bins or self.encoding):
            raise ValueError("a strict policy needs declared encodings")
        return self

    def cache_key(self) -> str:
        """What names the encoded factors: all that changes them, so neither the policy's name nor which of codes and values
        a statistic reads nor which split was encoded first."""
        said = self.model_dump(exclude={"name", "factor_source", "reference_split"})
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()[:16]


class Base(Strict):
    name: str
    mode: Literal["advisory", "preparatory"] = "advisory"


# Names and defaults of the workflows' parameters are the documented public surface: fixed values.
Method = Literal["adaptive", "zscore", "modzscore", "iqr"]
#: None: k-means where a number of clusters is given, else density clusters.
Algorithm = Literal["hdbscan", "kmeans", "bisecting"] | None


class Duplicates(Strict):
    """What marks duplicates: equal content, equal signatures (hash columns), short edges between embeddings."""

    content: str | None = None
    near_signatures: list[str] = Field(default_factory=list)
    duplicate_merge_near: bool = True
    duplicate_cluster_sensitivity: float | None = Field(None, gt=0)
    #: neighbors: short edges of the nearest-neighbour graph, merged with the signatures' groups; the others cut the tree of
    #: each cluster, and their groups stand beside those of the signatures.
    duplicate_cluster_algorithm: Literal["neighbors", "hdbscan", "kmeans", "bisecting"] | None = None
    duplicate_n_clusters: int | None = Field(None, ge=2)


# Names of the groups and their metrics: fixed values.
GROUPS = {
    "pixel": ("mean", "std", "var", "skew", "kurtosis", "entropy", "missing", "zeros"),
    "visual": ("brightness", "contrast", "darkness", "sharpness"),
    "dimension": ("offset_x", "offset_y", "width", "height", "channels", "size", "aspect_ratio", "depth", "distance_center", "distance_edge", "invalid_box"),
}
Group = Literal["dimension", "pixel", "visual"]


class Outliers(Strict):
    """The metrics that are looked at: those named, and those of whole groups that the items have."""

    metrics: list[str] = Field(default_factory=list)
    outlier_flags: list[Group] = Field(default_factory=list)

    @model_validator(mode="after")
    def some_metric(self):
        if not (self.metrics or self.outlier_flags):
            raise ValueError("name metrics or outlier_flags")
        return self

    def chosen(self, columns: list[str]) -> list[str]:
        grouped = [m for g in self.outlier_flags for m in GROUPS[g] if m in columns]
        found = list(dict.fromkeys([*self.metrics, *grouped]))
        if not found:
            raise ValueError(f"the items have no metrics of {self.outlier_flags}; dataset option image_stats makes them")
        return found


class Cleaning(Base, Duplicates, Outliers):
    type: Literal["data-cleaning"]
    outlier_method: Method
    outlier_threshold: float | None = Field(None, ge=0)
    target_metrics: list[str] = Field(default_factory=list)
    embedding: str | None = None
    outlier_cluster_threshold: float | None = Field(None, gt=0)
    outlier_cluster_algorithm: Algorithm = None
    outlier_n_clusters: int | None = Field(None, ge=2)
    exact_warning: float = 0
    near_warning: float = 5
    outlier_warning: float = 3
    target_warning: float = 3
    classwise_warning: float = 3
    imbalance_warning: float = 5

    @model_validator(mode="after")
    def clusters_need_vectors(self) -> Cleaning:
        if self.embedding is None and (self.outlier_cluster_threshold or self.duplicate_cluster_sensitivity):
            raise ValueError("cluster parameters need an embedding")
        return self


class Analysis(Base, Duplicates, Outliers):
    type: Literal["data-analysis"]
    outlier_method: Method
    outlier_threshold: float | None = Field(None, ge=0)
    factors: list[str] = Field(default_factory=list)
    balance: bool = False
    include_metrics: bool = False  # metrics are factors too
    diversity_method: Literal["simpson", "shannon"] | None = None
    embedding: str | None = None
    divergence_method: Literal["mst", "fnn"] | None = None
    outlier_warning: float = 3
    exact_warning: float = 0
    near_warning: float = 5
    imbalance_warning: float = 5
    shift_warning: float = 0.5


class Coverage(Base):
    type: Literal["data-coverage"]
    embedding: str = "embedding"
    factors: list[str] = Field(default_factory=list)
    coverage_method: Literal["adaptive", "naive"] = "adaptive"
    coverage_percent: float = Field(0.01, gt=0, le=1)
    num_observations: int = Field(50, ge=1)
    min_class_samples: int = Field(20, ge=1)
    isotropy_min_samples: int | None = None
    near_duplicate_factor: float = Field(0.5, gt=0)
    run_completeness: bool = True
    balance: bool = True
    diversity_method: Literal["simpson", "shannon"] | None = "simpson"
    run_gap_analysis: bool = True
    gap_mi_threshold: float = 0.1
    gap_min_representation: int = 5
    ontology: dict[str, Any] | str | None = None
    ontology_expected: dict[str, float] = Field(default_factory=dict)
    ontology_label_pattern: str | None = None
    uncovered_warning: float = 10
    completeness_warning: float = 0.5
    imbalance_warning: float = 5
    gap_warning: int = 3
    dispersion_warning: float = 0.5
    isotropy_warning: float = 0.5
    near_duplicate_warning: float = 0.1
    leaf_warning: float = 0.9
    dark_warning: int = 0
    unmatched_warning: int = 0

    @model_validator(mode="after")
    def shares(self) -> Coverage:
        if any(not 0 <= v <= 1 for v in self.ontology_expected.values()):
            raise ValueError("expected shares lie in [0, 1]")
        return self


class Splitting(Base):
    type: Literal["data-splitting"]
    test_frac: float = Field(0.2, ge=0, lt=1)
    val_frac: float = Field(0.1, ge=0, lt=1)
    num_folds: int = Field(1, ge=1)
    stratify: bool = True
    split_on: str | None = None
    rebalance_method: Literal["global", "interclass"] | None = None
    seed: int = 0
    embedding: str | None = None
    coverage_percent: float = Field(0.01, gt=0, le=1)
    num_observations: int = Field(50, ge=1)


class UpdateStrategy(Strict):
    """How the reference goes on after a run: the last ``n`` rows, or a uniform sample of all."""

    type: Literal["last_seen", "reservoir_sampling"]
    n: int = Field(gt=0)


class Drift(Base):
    type: Literal["drift-monitoring"]
    embedding: str = "embedding"
    detectors: list[dict[str, Any]] = Field(min_length=1)
    drift_warning: bool = True
    chunk_warning: float = 10
    run_warning: int = 3
    classwise_warning: bool = True
    update_strategy: UpdateStrategy | None = None
    seed: int = 0


class Ood(Base):
    type: Literal["ood-detection"]
    embedding: str = "embedding"
    detectors: list[dict[str, Any]] = Field(default_factory=lambda: [{"method": "knn"}], min_length=1)
    factors: list[str] = Field(default_factory=list)
    metadata_insights: bool = True
    max_ood_insights: int = Field(50, ge=0)
    ood_warning: float = 10
    ood_info: float = 1


class PriorCleaning(Strict):
    """Rows that leave before ranking: outliers of every source, and duplicates over all of them."""

    outlier_method: Method = "adaptive"
    metrics: list[str] = Field(default_factory=list)
    outlier_threshold: float | None = Field(None, ge=0)
    content: str | None = None
    near_signatures: list[str] = Field(default_factory=list)
    duplicate_exact_only: bool = False


class Prioritization(Base):
    type: Literal["data-prioritization"]
    embedding: str = "embedding"
    method: Literal["knn", "kmeans_distance", "kmeans_complexity", "hdbscan_distance", "hdbscan_complexity"] = "knn"
    k: int | None = Field(None, ge=1)
    c: int | None = Field(None, ge=2)
    min_cluster_size: int = Field(5, ge=2)
    order: Literal["hard_first", "easy_first"] = "hard_first"
    policy: Literal["difficulty", "stratified", "class_balanced"] = "difficulty"
    num_bins: int = Field(50, ge=1)
    cleaning: PriorCleaning | None = None
    removed_warning: float = 20


class Sweep(Base, Outliers):
    type: Literal["parameter-sweep"]
    embedding: str | None = None
    outlier_method: list[Method] = Field(default_factory=lambda: ["adaptive"])
    outlier_threshold: list[float | None] = Field(default_factory=lambda: [None])
    outlier_cluster_threshold: list[float] = Field(default_factory=list)
    outlier_cluster_algorithm: list[Algorithm] = Field(default_factory=lambda: [None])
    outlier_n_clusters: int | None = Field(None, ge=2)
    content: str | None = None
    near_signatures: list[str] = Field(default_factory=list)
    duplicate_cluster_sensitivity: list[float] = Field(default_factory=list)
    duplicate_cluster_algorithm: list[Literal["neighbors", "hdbscan", "kmeans", "bisecting"] | None] = Field(default_factory=lambda: [None])
    duplicate_n_clusters: int | None = Field(None, ge=2)
    duplicate_merge_near: list[bool] = Field(default_factory=lambda: [True])


Workflow = Cleaning | Analysis | Coverage | Splitting | Drift | Ood | Prioritization | Sweep


class Step(Strict):
    step: str
    params: dict[str, Any] = Field(default_factory=dict)


class Preprocessor(Strict):
    name: str
    steps: list[Step]


class Extractor(Strict):
    """Makes the column ``embedding`` of decoded images; a vocabulary is fitted on a task's first source."""

    name: str
    model: Literal["flatten", "bovw"]
    preprocessor: str | None = None
    vocab_size: int = Field(2048, ge=256, le=4096)
    seed: int = 0


class Task(Strict):
    name: str
    workflow: str
    sources: str | list[str]
    extractor: str | None = None
    metadata: str | None = None
    enabled: bool = True

    @property
    def names(self) -> list[str]:
        return [self.sources] if isinstance(self.sources, str) else list(self.sources)


class Pipeline(Strict):
    seed: int | None = None
    datasets: list[Dataset] = Field(default_factory=list)
    preprocessors: list[Preprocessor] = Field(default_factory=list)
    extractors: list[Extractor] = Field(default_factory=list)
    views: list[View] = Field(default_factory=list)
    sources: list[Source] = Field(default_factory=list)
    metadata: list[MetadataPolicy] = Field(default_factory=list)
    workflows: list[Workflow] = Field(default_factory=list)
    tasks: list[Task] = Field(default_factory=list)

    @model_validator(mode="after")
    def names_once(self) -> Pipeline:
        for pool in ("datasets", "preprocessors", "extractors", "views", "sources", "metadata", "workflows", "tasks"):
            names = [x.name for x in getattr(self, pool)]
            if len(names) != len(set(names)):
                raise ValueError(f"names in {pool} must be unique")
        return self

    def get(self, pool: str, name: str):
        found = [x for x in getattr(self, pool) if x.name == name]
        if not found:
            raise ValueError(f"no {name!r} in {pool}; there are {[x.name for x in getattr(self, pool)]}")
        return found[0]


def merged(a: Any, b: Any) -> Any:
    """Mappings merge, lists extend, anything else is replaced."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merged(a[k], v) if k in a else v for k, v in b.items()}
    return a + b if isinstance(a, list) and isinstance(b, list) else b


def _read(path: Path) -> dict:
    text = path.read_text()
    return (json.loads(text) if path.suffix == ".json" else yaml.safe_load(text)) or {}


def load_config(path: str | Path) -> Pipeline:
    return Pipeline.model_validate(_read(Path(path)))


def load_config_folder(path: str | Path) -> Pipeline:
    """All YAML and JSON files of a folder in the order of their names; files with unknown keys are skipped; none left is
    an error."""
    out: dict = {}
    used = 0
    for file in sorted(p for p in Path(path).iterdir() if p.suffix in (".yaml", ".yml", ".json")):
        part = _read(file)
        if isinstance(part, dict) and set(part) <= set(Pipeline.model_fields):
            out = merged(out, part)
            used += 1
    if not used:
        raise ValueError(f"no configuration files in {path}")
    return Pipeline.model_validate(out)


def resolve_path(path: str, root: str) -> str:
    """Paths in configurations are relative and stay below the root; URIs pass as they are."""
    if "://" in path:
        return path
    if Path(path).is_absolute():
        raise ValueError(f"{path!r} must be relative")
    full = (Path(root) / path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path!r} leaves {root!r}")
    return str(full)


def export_schema(path: str | Path | None = None) -> str:
    text = json.dumps(Pipeline.model_json_schema(), indent=2, sort_keys=True)
    if path:
        Path(path).write_text(text)
    return text
