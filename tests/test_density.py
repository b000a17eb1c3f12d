import numpy as np
import pytest

from plumbline.operators import density
from plumbline.plans import catalog
from plumbline.plans import config as c
from plumbline.plans.workflows import WORKFLOWS, Result, SourceFrames

SCHEMA = "k long, x array<double>"


def by_hand(keys, x, least, samples):
    """Clusters from the whole matrix of mutual reachability distances, from the top down: a set of points loses those that
    no shorter edge ties to it, splits where two sets of ``least`` points or more come apart, and is kept where its points
    stay longer than in what it splits into. Returns (name, membership) by key."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(samples, n) - 1] if samples > 1 else np.zeros(n)
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    off = m[~np.eye(n, dtype=bool)]
    shortest = off[off > 0].min() if (off > 0).any() else 1.0

    def parts(members, below):
        """The sets that edges shorter than ``below`` tie together; at 0 or less none do."""
        left, out = set(members), []
        while left:
            seen = {left.pop()}
            front = list(seen)
            while front:
                new = left & set(np.flatnonzero((m[front] < below).any(0)).tolist())
                left -= new
                seen |= new
                front = list(new)
            out.append(sorted(seen))
        return out

    def turns(members):
        """The lengths at which the set can come apart, long ones first: those of some spanning tree of it."""
        inside, near, used = {members[0]}, m[members[0]].copy(), set()
        while len(inside) < len(members):
            j = min((i for i in members if i not in inside), key=lambda i: near[i])
            used.add(near[j])
            inside.add(j)
            near = np.minimum(near, m[j])
        return sorted(used, reverse=True)

    left_at = {}

    def grow(members, birth):
        """Stability, chosen clusters and densities at which the points leave."""
        born, kept = members, {}
        for w in turns(members):
            now = parts(members, w)
            if len(now) == 1:
                continue
            density_ = 1 / max(w, shortest)
            large = [p for p in now if len(p) >= least]
            if len(large) == 1:
                for p in now:
                    if p is not large[0]:
                        kept.update({i: density_ for i in p})
                members = large[0]
                continue
            kept.update({i: density_ for i in members})
            below, chosen = 0.0, []
            if len(large) > 1:
                for p in large:
                    s, c = grow(p, density_)
                    below += s
                    chosen += c
            break
        own = sum(kept.get(i, 1 / shortest) - birth for i in born)
        for i in born:
            left_at.setdefault(i, kept.get(i, 1 / shortest))
        if birth and own >= below:
            return own, [born]
        return below, chosen

    chosen = grow(list(range(n)), 0.0)[1] if n >= least else []
    found = {int(k): (None, 0.0) for k in keys}
    for c in chosen:
        most = max(left_at[i] for i in c)
        name = int(min(keys[i] for i in c))
        found.update({int(keys[i]): (name, left_at[i] / most) for i in c})
    return found


def blobs(seed, sizes, dims, noise):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (len(sizes), dims))
    x = np.concatenate([middle[i] + rng.normal(0, rng.uniform(0.2, 0.9), (s, dims)) for i, s in enumerate(sizes)] + [rng.uniform(-9, 9, (noise, dims))])
    return rng.permutation(len(x) * 3)[: len(x)], x


def found(df):
    return {r.k: (r.cluster_id, r.membership) for r in df.collect()}


def same(got, wanted):
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 1e-9 for k in wanted)


@pytest.mark.parametrize(("seed", "sizes", "dims", "noise", "least", "samples"), [(1, (60, 40, 50, 30), 2, 30, 5, 5), (2, (90, 25, 25), 3, 20, 8, 3), (3, (50, 50), 5, 0, 12, 5)])
def test_equals_the_definition(spark, seed, sizes, dims, noise, least, samples):
    keys, x = blobs(seed, sizes, dims, noise)
    df = spark.createDataFrame(list(zip(keys.tolist(), x.tolist())), SCHEMA)
    wanted = by_hand(keys, x, least, samples)
    assert len({v[0] for v in wanted.values()}) >= 2
    same(found(density.hdbscan(df, "k", "x", least, samples)), wanted)


def test_windows_and_equal_lengths_do_not_matter(spark):
    """On a grid many edges have one length; repeated points have length 0; whatever is merged in one window."""
    rng = np.random.default_rng(7)
    x = np.concatenate([np.round(rng.normal(0, 1.2, (70, 2)) * 2) / 2, np.round(rng.normal(8, 1.2, (60, 2)) * 2) / 2, np.tile([[20.0, 3.0]], (9, 1)), np.tile([[21.0, 3.0]], (3, 1)), [[50.0, 50.0]]])
    keys = rng.permutation(len(x))
    df = spark.createDataFrame(list(zip(keys.tolist(), x.tolist())), SCHEMA)
    wanted = by_hand(keys, x, 6, 4)
    assert len({v[0] for v in wanted.values()}) >= 3
    for window in (density.WINDOW, 40):
        same(found(density.hdbscan(df, "k", "x", 6, 4, window)), wanted)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 1.0]), (4, [5.0, 5.0])], SCHEMA)
    assert found(density.hdbscan(df, "k", "x")) == {1: (None, 0.0), 4: (None, 0.0)}
    assert density.hdbscan(df.limit(0), "k", "x").count() == 0
    copies = spark.createDataFrame([(i, [1.0]) for i in range(8)], SCHEMA)
    assert {v[0] for v in found(density.hdbscan(copies, "k", "x")).values()} == {None}  # the whole is no cluster


def test_scores_and_outliers_by_clusters(spark):
    keys, x = blobs(1, (60, 40, 50, 30), 2, 30)
    df = spark.createDataFrame(list(zip(keys.tolist(), x.tolist())), SCHEMA)
    names = by_hand(keys, x, 5, 5)
    at = {int(k): i for i, k in enumerate(keys)}
    label = np.array([names[int(k)][0] if names[int(k)][0] is not None else -1 for k in keys])
    middle = {c: x[label == c].mean(0) for c in set(label) - {-1}}
    d = {c: np.sqrt(((x - mid) ** 2).sum(1)) for c, mid in middle.items()}
    for r in density.density_distances(df, "k", "x").collect():
        i = at[r.k]
        c = label[i] if label[i] != -1 else min(d, key=lambda c: d[c][i])
        own = d[c][label == c]
        assert r.cluster_id == c and abs(r.metric_value - d[c][i]) < 1e-9 and abs(r.deviations - (d[c][i] - own.mean()) / own.std()) < 1e-9
    pool = spark.createDataFrame([(1000, [0.0, 0.0]), (1001, [3.0, -4.0])], SCHEMA)
    apart = {k: {c: float(np.sqrt(((np.array(p) - mid) ** 2).sum())) for c, mid in middle.items()} for k, p in ((1000, [0, 0]), (1001, [3, -4]))}
    scores = {r.k: r.score for r in density.hdbscan_scores(pool, df, "k", "x").collect()}
    assert all(abs(scores[k] - min(apart[k].values())) < 1e-9 for k in scores) and len(scores) == 2
    nearest = np.array([min(d, key=lambda c: d[c][i]) for i in range(len(x))])
    usual = {c: np.mean([d[c][i] for i in range(len(x)) if label[i] != -1 and nearest[i] == c]) for c in d}
    scores = {r.k: r.score for r in density.hdbscan_scores(pool, df, "k", "x", "hdbscan_complexity").collect()}
    assert all(abs(scores[k] - min(apart[k].values()) / usual[min(apart[k], key=apart[k].get)]) < 1e-9 for k in scores)


def test_duplicates_are_cut_from_each_cluster_s_tree(spark):
    """Tight pairs in a wide cluster are groups, as near points of a tight cluster are not; copies are exact groups."""
    wide = [[float(i * 10), 0.0] for i in range(12)] + [[0.4, 0.0], [0.8, 0.0], [50.3, 0.0]]
    tight = [[1000.0 + 0.3 * i, 0.0] for i in range(12)] + [[1000.0, 0.0]]
    lone = [[5000.0, 0.0], [5000.0, 0.0]]
    rows = list(enumerate(wide + tight + lone))
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 0 if x[0] < 500 else 15 if x[0] < 2000 else None, 1.0) for k, x in rows], "k long, cluster_id long, membership double")
    got = {r.k: (r.group_id, r.dup_type) for r in density.cluster_duplicates(df, "k", "x", 0.5, labels).collect()}
    assert got == {0: (0, "near"), 12: (0, "near"), 13: (0, "near"), 5: (5, "near"), 14: (5, "near"), 15: (15, "exact"), 27: (15, "exact"), 28: (28, "exact"), 29: (28, "exact")}


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def test_registered_queries(spark, sf_dir, vectors):
    """Over the whole table: clusters by the definition, outliers and duplicates from them."""
    keys, x = vectors
    wanted = by_hand(keys, x, 5, 5)
    got = {r.vec_id: (r.cluster_id, r.membership) for r in catalog.QUERIES["hdbscan_clusters"](spark, sf_dir).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 1e-5 for k in wanted)
    label = np.array([-1 if wanted[int(k)][0] is None else wanted[int(k)][0] for k in keys])
    middle = {c: x[label == c].mean(0) for c in set(label.tolist()) - {-1}}
    d = {c: np.sqrt(((x - mid) ** 2).sum(1)) for c, mid in middle.items()}
    at = [c if c != -1 else min(d, key=lambda c: d[c][i]) for i, c in enumerate(label.tolist())] if d else []
    far = {int(keys[i]): round(float(d[c][i]), 6) for i, c in enumerate(at) if d[c][label == c].std() > 0 and d[c][i] - d[c][label == c].mean() > 1.5 * d[c][label == c].std()}
    assert {r.vec_id: r.metric_value for r in catalog.QUERIES["cluster_outliers_hdbscan"](spark, sf_dir).collect()} == pytest.approx(far)


def test_registered_duplicates_are_those_below_each_cluster_s_cut(spark, sf_dir, vectors):
    keys, x = vectors
    names = by_hand(keys, x, 5, 5)
    label = [names[int(k)][0] for k in keys]
    m = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
    near, parent, done, edges = m[0].copy(), np.zeros(len(x), int), {0}, []
    while len(done) < len(x):
        j = min((i for i in range(len(x)) if i not in done), key=lambda i: near[i])
        edges.append((int(parent[j]), j, near[j]))
        done.add(j)
        parent[m[j] < near] = j
        near = np.minimum(near, m[j])
    edges = [e for e in edges if label[e[0]] == label[e[1]]]
    mean = {c: np.mean([e[2] for e in edges if label[e[0]] == c]) for c in {label[e[0]] for e in edges}}
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, w in edges:
        if w < 0.5 * mean[label[a]] or w == 0:
            root[find(a)] = find(b)
    groups = {}
    for i in range(len(x)):
        groups.setdefault(find(i), []).append(int(keys[i]))
    wanted = {k: min(g) for g in groups.values() if len(g) > 1 for k in g}
    assert {r.vec_id: r.group_id for r in catalog.QUERIES["cluster_duplicates"](spark, sf_dir).collect()} == wanted


def run(name, p, **sources):
    out = Result(name, [p.name])
    WORKFLOWS[name](sources, p, out)
    return out


def test_workflows_use_density_clusters(spark):
    keys, x = blobs(4, (40, 40), 2, 6)
    x[:2] = x[2] + [[1e-4, 0], [0, 1e-4]]
    items = spark.createDataFrame([(int(k), v.tolist(), float(i % 3), f"t{i // 2}" if i > 79 else f"s{i}") for i, (k, v) in enumerate(zip(keys, x))], "item_index long, embedding array<double>, lux double, sig string")
    p = c.Cleaning(name="x", type="data-cleaning", outlier_method="iqr", metrics=["lux"], embedding="embedding", outlier_cluster_threshold=2.0, near_signatures=["sig"], duplicate_cluster_sensitivity=0.1)
    out = run("data-cleaning", p, a=SourceFrames(items))
    far = {r.item_index for r in density.density_distances(items, "item_index", "embedding").filter("deviations > 2").collect()}
    assert far and {r.item_index for r in out.tables["outliers"].filter("metric_name = 'cluster_distance'").collect()} == far
    groups = out.tables["near_duplicates"].collect()
    signed, tied = [r for r in groups if r.group_id == r.first], [r for r in groups if r.group_id != r.first]
    assert len(signed) == 6 and {int(keys[i]) for i in range(3)} <= {r.key for r in tied}
    assert min(r.group_id for r in tied) > max(r.group_id for r in signed)
    q = c.Sweep(name="x", type="parameter-sweep", metrics=["lux"], embedding="embedding", outlier_cluster_threshold=[2.0], outlier_cluster_algorithm=["hdbscan", "bisecting"], duplicate_cluster_sensitivity=[0.1], duplicate_cluster_algorithm=["hdbscan", "neighbors", "kmeans"])
    rows = {(r["kind"], r["method"]): r["n"] for r in run("parameter-sweep", q, a=SourceFrames(items)).findings[-1].data}
    assert rows["cluster_outliers", "hdbscan"] == len(far) and ("cluster_outliers", "bisecting") in rows
    assert rows["near_duplicates", "merged, hdbscan"] == len({r.key for r in tied} - {r.first for r in tied})
    assert {("near_duplicates", "merged, kmeans"), ("near_duplicates", "merged, neighbors")} <= set(rows)
    for method in ("hdbscan_distance", "hdbscan_complexity"):
        r = c.Prioritization(name="x", type="data-prioritization", method=method)
        ranked = run("data-prioritization", r, a=SourceFrames(items), b=SourceFrames(items.filter("item_index % 2 = 0"))).tables["prioritized"].orderBy("position").collect()
        assert [t.position for t in ranked] == list(range(1, len(ranked) + 1)) and all(a.score >= b.score for a, b in zip(ranked, ranked[1:]))


def test_the_driver_holds_few_edges_at_once():
    """Of a tree of any size: its merges are Python objects on the driver (500,000 edges before)."""
    from plumbline.operators import neighbors

    assert density.WINDOW <= 100_000 and neighbors.DRIVER_EDGES <= 100_000
