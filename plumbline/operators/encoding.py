"""Encodings of factors: bins and levels, their fit, digest and comparability."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.quantiles import exact_quantiles


@dataclass(frozen=True)
class Bins:
    """Edges of a numeric factor: codes 1..n for [edge, next), 0 below, n + 1 above, n + 2 missing."""

    edges: tuple[float, ...]
    provenance: str = "declared"
    method: str | None = None

    def __post_init__(self) -> None:
        if len(self.edges) < 2 or any(a >= b for a, b in zip(self.edges, self.edges[1:])):
            raise ValueError("bin edges must rise strictly and be two at least")

    @property
    def count(self) -> int:
        return len(self.edges) - 1

    def code(self, value: Column) -> Column:
        value = value.cast("double")
        out = F.when(value.isNull() | F.isnan(value), F.lit(self.count + 2)).when(value < self.edges[0], F.lit(0))
        for i, edge in enumerate(self.edges[1:], 1):
            out = out.when(value < edge, F.lit(i))
        closed = self.edges[-1] if math.isfinite(self.edges[-1]) else None
        return (out.when(value == closed, F.lit(self.count)) if closed is not None else out.when(value == math.inf, F.lit(self.count))).otherwise(F.lit(self.count + 1))

    def names(self) -> list[str]:
        show = lambda v: repr(int(v)) if v == int(v) else repr(v)
        out = []
        for a, b in zip(self.edges, self.edges[1:]):
            out.append(f"< {show(b)}" if math.isinf(a) else f">= {show(a)}" if math.isinf(b) else f"[{show(a)}, {show(b)})")
        return out


@dataclass(frozen=True)
class Levels:
    """The vocabulary of a discrete factor, in order; it only grows at its end."""

    levels: tuple[str, ...]
    provenance: str = "declared"

    def code(self, value: Column) -> Column:
        value = value.cast("string")
        table = F.create_map(*(x for i, v in enumerate(self.levels) for x in (F.lit(v), F.lit(i)))) if self.levels else F.create_map().cast("map<string,int>")
        return F.try_element_at(table, value)

    def extended(self, seen: list[str]) -> Levels:
        return Levels((*self.levels, *sorted(set(seen) - set(self.levels))), self.provenance)


@dataclass
class Policy:
    """What is declared of a dataset's factors."""

    encodings: dict[str, Bins | Levels] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()
    strict: bool = False
    auto_bin_method: str = "uniform_width"
    factor_source: str = "coded"

    def __post_init__(self) -> None:
        if self.strict and not self.encodings:
            raise ValueError("a strict policy needs declared encodings")
        derived = [f for f, e in self.encodings.items() if e.provenance == "derived"]
        if self.strict and derived:
            raise ValueError(f"a strict policy can't rest on derived encodings: {derived}")

    def digest(self) -> str:
        """Covers what is declared, not the rows."""
        shown = {f: {"kind": type(e).__name__.lower(), **{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(e).items() if k in ("edges", "levels")}} for f, e in sorted(self.encodings.items())}
        return hashlib.sha256(json.dumps({"encodings": shown, "exclude": sorted(self.exclude)}, sort_keys=True).encode()).hexdigest()

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds ``<factor>_code`` for every declared factor; drops the excluded."""
        return df.drop(*self.exclude).withColumns({f"{f}_code": e.code(F.col(f)) for f, e in self.encodings.items() if f in df.columns and f not in self.exclude})


def comparable(a: Bins | Levels, b: Bins | Levels) -> Bins | Levels | None:
    """The encoding both agree with, or None: bins must be the same, levels one the start of the other."""
    if type(a) is not type(b):
        return None
    if isinstance(a, Bins):
        return a if a.edges == b.edges else None
    short, long = sorted((a, b), key=lambda x: len(x.levels))
    return long if long.levels[: len(short.levels)] == short.levels else None


def shared_digest(policies: list[Policy]) -> str | None:
    """The digest of all splits, None where they differ."""
    found = {p.digest() for p in policies}
    return found.pop() if len(found) == 1 else None


def opened(edges: list[float]) -> tuple[float, ...]:
    """Outer edges to infinity, repeated edges once."""
    inner = sorted(set(edges[1:-1]) - {edges[0], edges[-1]}) if len(edges) > 2 else []
    return (-math.inf, *inner, math.inf)


def measured(df: DataFrame, factors: list[str]) -> DataFrame:
    """``factor, v``: the values of numeric factors, a row a value; null and NaN are missing."""
    long = df.select(*(F.col(f).cast("double").alias(f) for f in factors)).unpivot([], factors, "factor", "v")
    return long.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def equal_widths(lo: float | None, hi: float | None, count: int) -> Bins:
    if lo is None or lo == hi or count < 2 or not math.isfinite(hi - lo):
        return Bins((-math.inf, math.inf), "derived", "uniform_width")
    return Bins(opened([lo + (hi - lo) * i / count for i in range(count + 1)]), "derived", "uniform_width")


def uniform_width(df: DataFrame, factor: str, count: int) -> Bins:
    return equal_widths(*df.agg(F.min(F.col(factor).cast("double")), F.max(F.col(factor).cast("double"))).first(), count)


def uniform_counts(df: DataFrame, factors: list[str], count: int) -> dict[str, Bins]:
    """Edges at exact quantiles, of all factors at once: tied values are never torn apart."""
    found = {r.factor: r.q for r in exact_quantiles(measured(df, factors), "factor", "v", [i / count for i in range(count + 1)]).collect()}
    return {f: Bins(opened(found[f]) if f in found else (-math.inf, math.inf), "derived", "uniform_count") for f in factors}


def uniform_count(df: DataFrame, factor: str, count: int) -> Bins:
    return uniform_counts(df, [factor], count)[factor]


def cluster_bins(df: DataFrame, factor: str, count: int, seed: int = 1) -> Bins:
    """Edges halfway between the centres of a one-dimensional k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select(F.col(factor).cast("double").alias("v")).filter("v is not null and not isnan(v)").select(array_to_vector(F.array("v")).alias("features"))
    centres = sorted({float(c[0]) for c in KMeans(k=count, seed=seed).fit(data).clusterCenters()})
    return Bins((-math.inf, *((a + b) / 2 for a, b in zip(centres, centres[1:])), math.inf), "derived", "clusters")


#: Least and most bins that a count is derived to.
LEAST_BINS, MOST_BINS = 2, 64


def derived_count(n: int, lo: float, q1: float, q3: float, hi: float) -> int:
    """Freedman and Diaconis's number of bins; Sturges's if the middle half is one value."""
    if not n or not math.isfinite(hi - lo):
        return LEAST_BINS
    width = 2 * (q3 - q1) / n ** (1 / 3)
    return max(LEAST_BINS, min(MOST_BINS, math.ceil((hi - lo) / width) if width else math.ceil(math.log2(n)) + 1))


def auto_bins(df: DataFrame, factors: list[str], method: str = "uniform_width") -> dict[str, Bins]:
    """Bins of factors that nobody has declared. Numbers of bins and edges of all factors come from shared quantile passes
    (one, and one more for each number of bins with ``uniform_count``); ``clusters`` fits factor by factor."""
    if not factors:
        return {}
    if method not in ("uniform_width", "uniform_count", "clusters"):
        raise ValueError(f"unknown auto_bin_method {method!r}")
    seen = {r.factor: (r.n, *r.q) for r in exact_quantiles(measured(df, factors), "factor", "v", [0.0, 0.25, 0.75, 1.0]).collect()}
    counts = {f: derived_count(*seen[f]) for f in factors if f in seen}
    out = {f: Bins((-math.inf, math.inf), "derived", method) for f in factors}
    for f, k in counts.items():
        if method == "uniform_width":
            out[f] = equal_widths(seen[f][1], seen[f][4], k)
        elif method == "clusters":
            out[f] = cluster_bins(df, f, k)
    if method == "uniform_count":
        for k in sorted(set(counts.values())):
            out |= uniform_counts(df, [f for f, n in counts.items() if n == k], k)
    return out


def binning_record(df: DataFrame, policy: Policy, requested: dict[str, int | list[float]] | None = None) -> dict:
    """How each factor was encoded and how that fits the rows (``fit``: rows by code, with the smallest and largest value of
    bins; one pass over all factors), what was asked for, what names no factor, what nobody has reviewed, and what can't be a
    factor."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    used = {f: e for f, e in policy.encodings.items() if f in kinds and f not in policy.exclude}
    cells = [F.struct(F.lit(f).alias("factor"), e.code(F.col(f)).cast("int").alias("code"), (F.col(f).cast("double") if isinstance(e, Bins) else F.lit(None).cast("double")).alias("v")) for f, e in used.items()]
    fits: dict[str, dict] = {f: {} for f in used}
    if cells:
        for r in df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.factor", "c.code").agg(F.count("*").alias("n"), F.min("c.v").alias("lo"), F.max("c.v").alias("hi")).collect():
            fits[r.factor][r.code] = (r.n, r.lo, r.hi)
    shown = json.loads(descriptor(policy))["factors"]
    factors = {}
    for f, e in used.items():
        codes = range(1, e.count + 1) if isinstance(e, Bins) else range(len(e.levels))
        names = e.names() if isinstance(e, Bins) else list(e.levels)
        fit = [{"code": k, "name": name, "count": fits[f].get(k, (0,))[0]} | (dict(zip(("min", "max"), fits[f][k][1:])) if isinstance(e, Bins) and k in fits[f] else {}) for k, name in zip(codes, names)]
        other = {"below": 0, "above": e.count + 1, "missing": e.count + 2} if isinstance(e, Bins) else {"missing": None}
        factors[f] = {"encoding": shown[f], "fit": fit, **{name: fits[f].get(k, (0,))[0] for name, k in other.items()}}
    out = {
        "auto_bin_method": policy.auto_bin_method, "encoding_digest": policy.digest(), "descriptor_version": 1, "factor_source": policy.factor_source, "requested_bins": dict(requested or {}), "excluded": sorted(policy.exclude),
        "factors": factors, "unreviewed": sorted(f for f, e in used.items() if e.provenance == "derived"), "dropped": {f: [k] for f, k in kinds.items() if k.startswith(("array", "struct", "map", "binary")) and f not in policy.exclude},
    }
    unmatched = sorted(set(requested or {}) - set(kinds))
    return out | ({"unmatched_bin_requests": unmatched} if unmatched else {})


def bin_fit(df: DataFrame, factor: str, bins: Bins) -> DataFrame:
    """``code, n, min, max`` of every declared code (0 rows where empty), and of below, above and missing if any."""
    v = F.col(factor).cast("double")
    found = df.select(bins.code(v).alias("code"), v.alias("v")).groupBy("code").agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    declared = df.sparkSession.range(1, bins.count + 1).select(F.col("id").cast("int").alias("code"))
    return declared.join(found, "code", "full").select(F.col("code").cast("long").alias("code"), F.coalesce("n", F.lit(0)).alias("n"), "min", "max")


def level_fit(df: DataFrame, factor: str, levels: Levels) -> DataFrame:
    """``code, level, n`` of every level of the vocabulary, 0 where it is empty."""
    found = df.groupBy(levels.code(F.col(factor)).alias("code")).agg(F.count("*").alias("n"))
    table = df.sparkSession.createDataFrame(list(enumerate(levels.levels)), "code int, level string")
    return table.join(found, "code", "left").select(F.col("code").cast("long").alias("code"), "level", F.coalesce("n", F.lit(0)).alias("n"))


def digitize(df: DataFrame, factor: str) -> DataFrame:
    """``value, code, n``: ordinals of the values in order, as a table (for vocabularies too large for a driver)."""
    counts = df.filter(F.col(factor).isNotNull()).groupBy(F.col(factor).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("code", (F.row_number().over(Window.orderBy("value")) - 1).cast("long"))


def propagate(unit: DataFrame, instance: DataFrame, key: str, factors: list[str]) -> DataFrame:
    """Unit factors on every instance row, named by level where both measure one."""
    both = {c for c in factors if c in instance.columns and c != key}
    up = unit.select(key, *(F.col(c).alias(f"unit_{c}" if c in both else c) for c in factors))
    down = instance.select(*(F.col(c).alias(f"instance_{c}" if c in both else c) for c in instance.columns))
    return down.join(up, key, "left")


def descriptor(policy: Policy) -> str:
    """The policy as JSON: sorted keys, two spaces, infinities as text."""
    edge = lambda v: v if math.isfinite(v) else ("inf" if v > 0 else "-inf")
    shown = {f: {"kind": "bins", "edges": [edge(v) for v in e.edges], "names": e.names(), "provenance": e.provenance, "method": e.method} if isinstance(e, Bins) else {"kind": "levels", "levels": list(e.levels), "provenance": e.provenance} for f, e in policy.encodings.items()}
    return json.dumps({"descriptor_version": 1, "encoding_digest": policy.digest(), "factor_source": policy.factor_source, "auto_bin_method": policy.auto_bin_method, "excluded": sorted(policy.exclude), "factors": shown}, indent=2, sort_keys=True, allow_nan=False)


def from_descriptor(text: str) -> Policy:
    raw = json.loads(text)
    made = {f: Bins(tuple(float(v) for v in e["edges"]), e["provenance"], e.get("method")) if e["kind"] == "bins" else Levels(tuple(e["levels"]), e["provenance"]) for f, e in raw["factors"].items()}
    return Policy(made, tuple(raw["excluded"]), False, raw["auto_bin_method"], raw["factor_source"])
