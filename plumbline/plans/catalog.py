"""The registered queries of the engine and the SQL that states the same results.

The driver's tables stand in for an image dataset: line items, events and documents are items with metrics, labels are
classes, orders and parts carry factors, line items of an order are its targets, embeddings are feature vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ordering import shuffled
from plumbline.operators import density, duplicates, encoding, labels, neighbors, ontology, quality, shift, splitting
from plumbline.plans import views
from plumbline.session import table

QUERIES: dict = {}
ORACLES: dict = {}

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_linenumber"]


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(metrics: list[str], source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric_name, CAST({m} AS DOUBLE) AS v FROM {source} WHERE {m} IS NOT NULL" for m in metrics)


PROFILE = """p AS (SELECT metric_name, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1),
s AS (SELECT x.metric_name, quantile_cont(abs(v - med), 0.5) AS mad, avg(abs(v - med)) AS mead, avg(power(v - mean, 3)) / power(max(std), 3) AS skew, avg(power(v - mean, 4)) / power(max(std), 4) - 3 AS kurt FROM x JOIN p USING (metric_name) GROUP BY 1)"""
Z = "abs(v - mean) / std"
MODZ = "CASE WHEN mad > 0 THEN 0.6745 * abs(v - med) / mad WHEN mead > 0 THEN abs(v - med) / (1.2533 * mead) ELSE 0 END"
HEAVY = "(abs(skew) > 1 OR kurt > 3)"


def _issues_sql(metrics: list[str], source: str, keys: str, condition: str) -> str:
    return f"WITH x AS ({_long(metrics, source, keys)}), {PROFILE} SELECT {keys}, metric_name, v AS metric_value FROM x JOIN p USING (metric_name) JOIN s USING (metric_name) WHERE {condition}"


@register(_issues_sql(METRICS, "lineitem", "l_orderkey, l_linenumber", f"{Z} > 1.7"))
def outliers_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_issues(table(spark, sf_dir, "lineitem"), LINE, METRICS, "zscore", 1.7)


@register(_issues_sql(["value"], "events", "event_id", f"{MODZ} > 3.5"))
def outliers_modzscore(spark, sf_dir):
    return quality.outlier_issues(table(spark, sf_dir, "events"), ["event_id"], ["value"], "modzscore")


@register(_issues_sql(["value"], "events", "event_id", "v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)"))
def outliers_iqr(spark, sf_dir):
    return quality.outlier_issues(table(spark, sf_dir, "events"), ["event_id"], ["value"], "iqr")


@register(_issues_sql(["n_chars"], "documents", "doc_id", f"(CASE WHEN {HEAVY} THEN {MODZ} ELSE {Z} END) > 3.5"))
def outliers_adaptive(spark, sf_dir):
    return quality.outlier_issues(table(spark, sf_dir, "documents"), ["doc_id"], ["n_chars"], "adaptive")


@register(f"""WITH i AS ({_issues_sql(METRICS, "lineitem", "l_orderkey, l_linenumber", f"{Z} > 1.7")})
SELECT metric_name, count(DISTINCT (l_orderkey, l_linenumber)) AS outlier_count FROM i GROUP BY 1 UNION ALL SELECT 'Total', count(DISTINCT (l_orderkey, l_linenumber)) FROM i""")
def outlier_summary_by_metric(spark, sf_dir):
    return quality.summary_by_metric(outliers_zscore(spark, sf_dir), LINE)


@register(f"""WITH i AS (SELECT DISTINCT doc_id FROM ({_issues_sql(["n_chars"], "documents", "doc_id", f"{MODZ} > 3.5")})),
l AS (SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unlabeled') AS class_name FROM documents d LEFT JOIN labels USING (doc_id)),
c AS (SELECT class_name, count(*) AS k FROM i JOIN l USING (doc_id) GROUP BY 1), n AS (SELECT class_name, count(*) AS n FROM l GROUP BY 1)
SELECT class_name, k AS outlier_count, round(100.0 * k / n, 1) AS pct FROM c JOIN n USING (class_name) UNION ALL SELECT 'Total', CAST(sum(k) AS BIGINT), round(100.0 * sum(k) / (SELECT count(*) FROM l), 1) FROM c""")
def classwise_outlier_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    issues = quality.outlier_issues(docs, ["doc_id"], ["n_chars"], "modzscore")
    classes = docs.select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return quality.classwise_pivot(issues, classes, ["doc_id"], "quality")


GROUPS = "SELECT sha256(text) AS h, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


@register(f"SELECT first AS group_id, doc_id, n AS n_items FROM documents d JOIN ({GROUPS}) g ON sha256(d.text) = g.h")
def exact_duplicate_groups(spark, sf_dir):
    return quality.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@register(f"SELECT doc_id FROM documents d JOIN ({GROUPS}) g ON sha256(d.text) = g.h WHERE doc_id > first")
def duplicate_flag_policy(spark, sf_dir):
    return quality.flagged_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


def _split(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("split", F.element_at(F.array(F.lit("a_train"), F.lit("b_val"), F.lit("c_test")), (F.col("doc_id") % 3 + 1).cast("int")))


@register("""WITH x AS (SELECT sha256(text) AS h, CASE doc_id % 3 WHEN 0 THEN 'a_train' WHEN 1 THEN 'b_val' ELSE 'c_test' END AS split, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS groups, CAST(sum(a.n) AS BIGINT) AS members_a, CAST(sum(b.n) AS BIGINT) AS members_b FROM x a JOIN x b ON a.h = b.h AND a.split < b.split GROUP BY 1, 2""")
def cross_split_leakage(spark, sf_dir):
    return quality.leakage(_split(spark, sf_dir), "doc_id", "text", "split")


@register(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents d JOIN ({GROUPS}) g ON sha256(d.text) = g.h WHERE doc_id > first) AND doc_id NOT IN (SELECT doc_id FROM ({_issues_sql(['n_chars'], 'documents', 'doc_id', f'{MODZ} > 3.5')}))")
def clean_indices(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.clean_rows(docs, "doc_id", quality.outlier_issues(docs, ["doc_id"], ["n_chars"], "modzscore"), quality.flagged_copies(docs, "doc_id", "text"))


@register(f"""WITH o AS (SELECT DISTINCT doc_id FROM ({_issues_sql(['n_chars'], 'documents', 'doc_id', f'{MODZ} > 3.5')})), d AS (SELECT DISTINCT doc_id FROM documents d JOIN ({GROUPS}) g ON sha256(d.text) = g.h WHERE doc_id > first)
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS original_size, (SELECT count(*) FROM o) AS outliers, (SELECT count(*) FROM d) AS duplicates, (SELECT count(*) FROM (SELECT * FROM o UNION SELECT * FROM d)) AS removed""")
def cleaning_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.cleaning_summary(docs, "doc_id", quality.outlier_issues(docs, ["doc_id"], ["n_chars"], "modzscore"), quality.flagged_copies(docs, "doc_id", "text"))


@register("""SELECT (SELECT count(DISTINCT quality) FROM labels) AS class_count, (SELECT count(quality) FROM labels) AS label_count, (SELECT count(DISTINCT doc_id) FROM labels WHERE quality IS NOT NULL) AS labeled_items,
(SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)) AS empty_items""")
def label_stats(spark, sf_dir):
    return labels.label_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "quality")


@register("SELECT n_name AS class_name, count(s_suppkey) AS n, count(s_suppkey) = 0 AS missing FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def label_distribution_missing(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return labels.distribution(table(spark, sf_dir, "supplier"), nation, "s_nationkey", "n_name")


@register("SELECT round(max(n) / min(n), 1) AS imbalance_ratio FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY lang)")
def imbalance_ratio(spark, sf_dir):
    return labels.imbalance(labels.label_counts(table(spark, sf_dir, "documents"), "lang"))


@register("""WITH a AS (SELECT lang AS c, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang AS c, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT coalesce(a.c, b.c) AS class_name, CASE WHEN a.n IS NULL THEN 'b_only' WHEN b.n IS NULL THEN 'a_only' ELSE 'shared' END AS presence, round(coalesce(a.n * 1.0 / (SELECT sum(n) FROM a), 0), 4) AS p_a, round(coalesce(b.n * 1.0 / (SELECT sum(n) FROM b), 0), 4) AS p_b,
round(abs(a.n * 1.0 / (SELECT sum(n) FROM a) - b.n * 1.0 / (SELECT sum(n) FROM b)), 4) AS diff FROM a FULL JOIN b ON a.c = b.c""")
def label_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return labels.overlap(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "lang")


@register("""WITH o AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1), e AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
r AS (SELECT coalesce(o.n, 0) AS o, e.n AS e FROM e LEFT JOIN o USING (lang)), t AS (SELECT o, e * 1.0 * (SELECT sum(o) FROM r) / (SELECT sum(e) FROM r) AS e FROM r)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, count(*) - 1 AS dof FROM t""")
def label_parity_chi2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return labels.parity(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "lang")


@register(" UNION ALL ".join(f"SELECT '{m}' AS factor, count(*) - count({m}) AS null_count, min({m}) AS min, max({m}) AS max, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std FROM lineitem" for m in METRICS))
def metadata_summary_continuous(spark, sf_dir):
    return labels.continuous_summary(table(spark, sf_dir, "lineitem"), METRICS)


@register(" UNION ALL ".join(f"SELECT * FROM (SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS value, count(*) AS n, count(*) OVER () AS n_unique FROM part GROUP BY 2 ORDER BY n DESC, value LIMIT 10)" for f in ("p_brand", "p_type", "p_size")))
def metadata_summary_discrete(spark, sf_dir):
    return labels.discrete_summary(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@register("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, CASE WHEN value IS NULL THEN 8 ELSE 1 + (SELECT count(*) FROM range(1, 6) t(i) WHERE value >= lo + (hi - lo) * i / 6) END AS code FROM events, b""")
def factor_bins_uniform_width(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", encoding.uniform_width(events, "value", 6).code(F.col("value")).cast("long").alias("code"))


@register("""WITH b AS (SELECT quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM events)
SELECT event_id, 1 + (value >= q[1])::BIGINT + (value >= q[2])::BIGINT + (value >= q[3])::BIGINT AS code FROM events, b""")
def factor_bins_uniform_count(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", encoding.uniform_count(events, "value", 4).code(F.col("value")).cast("long").alias("code"))


DECLARED = encoding.Bins((0.0, 10.0, 20.0, 40.0))
DECLARED_SQL = "CASE WHEN l_quantity IS NULL THEN 5 WHEN l_quantity < 0 THEN 0 WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END"


@register(f"SELECT l_orderkey, l_linenumber, CAST({DECLARED_SQL} AS BIGINT) AS code FROM lineitem")
def factor_bins_declared(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE, DECLARED.code(F.col("l_quantity")).cast("long").alias("code"))


@register(f"""WITH f AS (SELECT CAST({DECLARED_SQL} AS BIGINT) AS code, count(*) AS n, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY 1)
SELECT coalesce(d.i, f.code) AS code, coalesce(n, 0) AS n, min, max FROM range(1, 4) d(i) FULL JOIN f ON d.i = f.code""")
def bin_fit(spark, sf_dir):
    return encoding.bin_fit(table(spark, sf_dir, "lineitem"), "l_quantity", DECLARED)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE")


@register("SELECT CAST(i AS BIGINT) AS code, level, (SELECT count(*) FROM orders WHERE o_orderpriority = level) AS n FROM (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '9-NONE')) t(i, level)")
def level_fit(spark, sf_dir):
    return encoding.level_fit(table(spark, sf_dir, "orders"), "o_orderpriority", encoding.Levels(PRIORITIES))


@register("SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM part GROUP BY 1")
def factor_levels_digitized(spark, sf_dir):
    return encoding.digitize(table(spark, sf_dir, "part"), "p_brand")


def _mi_sql(pairs: list[tuple[str, str]], source: str) -> str:
    tables = " UNION ALL ".join(f"SELECT '{a}' AS x_name, '{b}' AS y_name, CAST({a} AS VARCHAR) AS x, CAST({b} AS VARCHAR) AS y, count(*) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 3, 4" for a, b in pairs)
    return f"""WITH c AS ({tables}), t AS (SELECT x_name, y_name, n / sum(n) OVER w AS p, sum(n) OVER (PARTITION BY x_name, y_name, x) / sum(n) OVER w AS px, sum(n) OVER (PARTITION BY x_name, y_name, y) / sum(n) OVER w AS py FROM c WINDOW w AS (PARTITION BY x_name, y_name)),
m AS (SELECT x_name, y_name, sum(p * ln(p / (px * py))) AS mi, -sum(p * ln(px)) AS hx, -sum(p * ln(py)) AS hy FROM t GROUP BY 1, 2)
SELECT x_name, y_name, round(greatest(mi, 0), 6) AS mi, round(hx, 6) AS hx, round(hy, 6) AS hy, round(CASE WHEN hx + hy > 0 THEN greatest(mi, 0) / ((hx + hy) / 2) ELSE 0 END, 6) AS nmi FROM m"""


@register(_mi_sql([("lang", "source"), ("lang", "long_text")], "(SELECT *, n_chars > 1000 AS long_text FROM documents)"))
def balance_mi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("long_text", F.col("n_chars") > 1000)
    return labels.mutual_information(labels.pair_tables(docs, [("lang", "source"), ("lang", "long_text")]))


FACTOR_PAIRS = [("p_brand", "p_type"), ("p_brand", "p_size"), ("p_type", "p_size")]


@register(_mi_sql(FACTOR_PAIRS, "part"))
def balance_factor_pairs(spark, sf_dir):
    return labels.mutual_information(labels.pair_tables(table(spark, sf_dir, "part"), FACTOR_PAIRS))


@register()
def balance_adjusted(spark, sf_dir):
    return labels.adjusted_information(table(spark, sf_dir, "part"), FACTOR_PAIRS)


@register("""WITH l AS (SELECT DISTINCT lang AS class_name FROM documents), d AS (SELECT class_name, lang = class_name AS m, source AS y, count(*) AS n FROM documents, l GROUP BY 1, 2, 3),
t AS (SELECT class_name, n / sum(n) OVER (PARTITION BY class_name) AS p, sum(n) OVER (PARTITION BY class_name, m) / sum(n) OVER (PARTITION BY class_name) AS pm, sum(n) OVER (PARTITION BY class_name, y) / sum(n) OVER (PARTITION BY class_name) AS py FROM d)
SELECT class_name, 'source' AS factor, round(greatest(sum(p * ln(p / (pm * py))), 0), 6) AS mi FROM t GROUP BY 1""")
def balance_classwise(spark, sf_dir):
    return labels.classwise_information(table(spark, sf_dir, "documents"), "lang", ["source"])


def _diversity_sql(value: str, factors: tuple[str, ...], source: str, by: str | None = None) -> str:
    group = f"CAST({by} AS VARCHAR)" if by else "'all'"
    counts = " UNION ALL ".join(f"SELECT {group} AS g, '{f}' AS factor, CAST({f} AS VARCHAR) AS v, count(*) AS n FROM {source} WHERE {f} IS NOT NULL GROUP BY 1, 3" for f in factors)
    return f"WITH c AS ({counts}), p AS (SELECT g, factor, n / sum(n) OVER (PARTITION BY g, factor) AS p FROM c) SELECT {'g AS \"group\", ' if by else ''}factor, round(CASE WHEN count(*) > 1 THEN {value} ELSE 0 END, 6) AS diversity FROM p GROUP BY g, factor"


@register(_diversity_sql("(1 / sum(p * p) - 1) / (count(*) - 1)", ("o_orderpriority", "o_orderstatus"), "orders"))
def diversity_simpson(spark, sf_dir):
    return labels.diversity(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "simpson")


@register(_diversity_sql("-sum(p * ln(p)) / ln(count(*))", ("lang", "source"), "documents"))
def diversity_shannon(spark, sf_dir):
    return labels.diversity(table(spark, sf_dir, "documents"), ["lang", "source"], "shannon")


@register(_diversity_sql("(1 / sum(p * p) - 1) / (count(*) - 1)", ("source",), "documents", "lang"))
def diversity_classwise(spark, sf_dir):
    return labels.diversity(table(spark, sf_dir, "documents"), ["source"], "simpson", by="lang")


@register("""WITH c AS (SELECT lang AS class_name, count(*) AS n_class FROM documents GROUP BY 1), v AS (SELECT source AS value, count(*) AS n_value FROM documents GROUP BY 1), a AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2),
g AS (SELECT class_name, value, coalesce(n, 0) AS actual, n_value / (SELECT count(*) FROM documents) * n_class AS expected FROM c CROSS JOIN v LEFT JOIN a ON lang = class_name AND source = value)
SELECT class_name, 'source' AS factor, value, actual, round(expected, 1) AS expected, round(greatest(0, least(1, 1 - actual / expected)), 3) AS deficit FROM g WHERE actual < 5 AND expected > 5""")
def metadata_gaps(spark, sf_dir):
    return labels.metadata_gaps(table(spark, sf_dir, "documents"), "lang", ["source"])


@register("SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def level_propagation(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return encoding.propagate(orders, table(spark, sf_dir, "lineitem").select(*LINE), "l_orderkey", ["o_orderpriority", "o_orderstatus"])


VIEW = [{"type": "ClassFilter", "params": {"classes": ["click", "view", "purchase"]}}, {"type": "Relabel", "params": {"map": {"purchase": "buy"}}}, {"type": "Shuffle", "params": {"seed": 7}}, {"type": "Limit", "params": {"size": 500}}, {"type": "Reverse"}]


@register("""WITH f AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy' ELSE event_type END AS event_type, row_number() OVER (ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id) - 1 AS pos FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT event_id, event_type, row_number() OVER (ORDER BY pos DESC) - 1 AS view_pos FROM f WHERE pos < 500""")
def view_pipeline(spark, sf_dir):
    return views.build_view(table(spark, sf_dir, "events").select("event_id", "event_type"), VIEW, "event_id", "event_type")


DIMS = """d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)"""


@register(f"""WITH {DIMS}, b AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM d GROUP BY 1)
SELECT vec_id, round(sum(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END), 6) AS total, round(max(CASE WHEN dim = 1 THEN (v - lo) / (hi - lo) END), 6) AS first FROM d JOIN b USING (dim) GROUP BY 1""")
def embedding_minmax(spark, sf_dir):
    scaled = neighbors.min_max(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return scaled.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda t, v: t + v), 6).alias("total"), F.round(F.col("x")[0], 6).alias("first"))


@register("""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label, dim, avg(v) AS c FROM d GROUP BY 1, 2),
x AS (SELECT vec_id, d.label, sqrt(sum((v - c) * (v - c))) AS r FROM d JOIN c ON d.label = c.label AND d.dim = c.dim GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(r), 6) AS dispersion FROM x GROUP BY 1""")
def class_dispersion(spark, sf_dir):
    return neighbors.dispersion(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "n", F.round("dispersion", 6).alias("dispersion"))


EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"
KNN = f"{EMB}, k AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbor, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id)"


@register(f"WITH {KNN} SELECT vec_id, rank, neighbor, round(dist, 6) AS dist FROM k WHERE rank <= 5")
def knn_self(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return neighbors.knn(e, e, "vec_id", "embedding", 5).select("vec_id", F.col("rank").cast("long").alias("rank"), "neighbor", F.round("dist", 6).alias("dist"))


@register(f"WITH {KNN} SELECT vec_id, round(dist, 6) AS radius FROM k WHERE rank = 50 ORDER BY dist DESC, vec_id LIMIT CAST((SELECT ceil(0.01 * count(*)) FROM embeddings) AS BIGINT)".replace("LIMIT CAST((SELECT ceil(0.01 * count(*)) FROM embeddings) AS BIGINT)", "LIMIT (SELECT CAST(ceil(0.01 * count(*)) AS BIGINT) FROM embeddings)"))
def coverage_adaptive(spark, sf_dir):
    found, _ = neighbors.coverage(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", F.round("radius", 6).alias("radius"))


@register(f"WITH {KNN} SELECT vec_id, round(dist, 6) AS radius FROM k WHERE rank = 50 AND dist > exp((lgamma(33) + ln(50.0 / (SELECT count(*) FROM e))) / 64) / sqrt(pi())")
def coverage_naive(spark, sf_dir):
    found, _ = neighbors.coverage(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "naive")
    return found.select("vec_id", F.round("radius", 6).alias("radius"))


COSINE = f"""{EMB}, t AS (SELECT * FROM e WHERE vec_id % 4 = 0), r AS (SELECT * FROM e WHERE vec_id % 4 <> 0),
rs AS (SELECT a.vec_id, b.vec_id AS n, 1 - list_cosine_similarity(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.x, b.x), b.vec_id) AS k FROM r a JOIN r b ON a.vec_id <> b.vec_id),
th AS (SELECT quantile_cont(s, 0.95) AS threshold FROM (SELECT avg(d) AS s FROM rs WHERE k <= 10 GROUP BY vec_id)),
ts AS (SELECT a.vec_id, 1 - list_cosine_similarity(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.x, b.x), b.vec_id) AS k FROM t a CROSS JOIN r b),
o AS (SELECT vec_id, score, threshold, score > threshold AS is_ood FROM (SELECT vec_id, avg(d) AS score FROM ts WHERE k <= 10 GROUP BY 1), th)"""


def _populations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.filter("vec_id % 4 <> 0"), e.filter("vec_id % 4 = 0")


def _ood(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    return neighbors.ood_knn(test, reference, "vec_id", "embedding")


@register(f"WITH {COSINE} SELECT vec_id, round(score, 6) AS score, is_ood FROM o")
def ood_knn(spark, sf_dir):
    return _ood(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"), "is_ood")


@register(f"WITH {COSINE} SELECT count(*) FILTER (is_ood) AS ood_count, count(*) AS total_count, round(100.0 * avg(is_ood::INT), 2) AS ood_percentage, round(coalesce(max(score) FILTER (NOT is_ood), min(score)), 6) AS threshold_score, round(max(threshold), 6) AS fitted_threshold FROM o")
def ood_summary(spark, sf_dir):
    return neighbors.ood_summary(_ood(spark, sf_dir))


@register(f"""WITH {COSINE}, b AS (SELECT vec_id, score, 1.1 * threshold AS threshold, score > 0.97 * threshold AS is_ood FROM o), u AS (SELECT * FROM o UNION ALL SELECT * FROM b)
SELECT vec_id, round(avg(score / threshold), 6) AS consensus, count(*) FILTER (is_ood) > 0 AS any_ood, count(*) FILTER (is_ood) = 2 AS mutual, count(*) FILTER (is_ood) = 1 AS "unique" FROM u GROUP BY 1""")
def ood_consensus(spark, sf_dir):
    one = _ood(spark, sf_dir)
    two = one.select("vec_id", "score", (1.1 * F.col("threshold")).alias("threshold"), (F.col("score") > 0.97 * F.col("threshold")).alias("is_ood"))
    return neighbors.ood_consensus({"knn": one, "loose": two}, "vec_id")


@register("""WITH b AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT CAST(least(floor((value - a) / ((b - a) / 10)), 9) AS BIGINT) AS bin, round(a + min(least(floor((value - a) / ((b - a) / 10)), 9)) * ((b - a) / 10), 6) AS lo, round(a + (min(least(floor((value - a) / ((b - a) / 10)), 9)) + 1) * ((b - a) / 10), 6) AS hi, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1, a, b""")
def score_histogram(spark, sf_dir):
    return neighbors.histogram(table(spark, sf_dir, "events"), "value").select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n")


RANKED = f"""{EMB}, t AS (SELECT * FROM e WHERE vec_id % 4 = 0), r AS (SELECT * FROM e WHERE vec_id % 4 <> 0),
ts AS (SELECT a.vec_id, a.label, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS k FROM t a CROSS JOIN r b), s AS (SELECT vec_id, label, avg(d) AS score FROM ts WHERE k <= 10 GROUP BY 1, 2)"""


def _scores(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    found = neighbors.knn(test, reference, "vec_id", "embedding", 10, exclude_self=False)
    return neighbors.mean_distance(found, "vec_id").join(test.select("vec_id", "label"), "vec_id")


def _positions(df):
    return df.select("vec_id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@register(f"WITH {RANKED} SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS position FROM s")
def prioritize_knn(spark, sf_dir):
    return _positions(neighbors.prioritize(_scores(spark, sf_dir), "vec_id"))


@register(f"""WITH {RANKED}, g AS (SELECT *, floor((row_number() OVER (ORDER BY score, vec_id) - 1) * 10 / count(*) OVER ()) AS g FROM s), t2 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, vec_id) AS turn FROM g)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY turn, g, vec_id) AS position FROM t2""")
def prioritize_stratified(spark, sf_dir):
    return _positions(neighbors.prioritize(_scores(spark, sf_dir), "vec_id", "easy_first", "stratified", 10))


@register(f"""WITH {RANKED}, t2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS turn FROM s)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY turn, label, vec_id) AS position FROM t2""")
def prioritize_class_balanced(spark, sf_dir):
    return _positions(neighbors.prioritize(_scores(spark, sf_dir), "vec_id", "hard_first", "class_balanced", label="label"))


POOL = """d AS (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim, (vec_id % 4 = 0)::INT AS t FROM embeddings), c AS (SELECT dim, v, sum(1 - t) AS r, sum(t) AS t FROM d GROUP BY 1, 2),
p AS (SELECT dim, v, r, t, sum(r) OVER w AS cr, sum(t) OVER w AS ct, sum(r) OVER (PARTITION BY dim) AS m, sum(t) OVER (PARTITION BY dim) AS n FROM c WINDOW w AS (PARTITION BY dim ORDER BY v))"""


def _test(spark, sf_dir, name):
    out = shift.TESTS[name](shift.melted(*_populations(spark, sf_dir), "embedding"), ["dim"])
    return out.select(F.col("dim").cast("long").alias("dim"), F.round("statistic", 6).alias("statistic"), F.round("p_val", 6).alias("p_val"))


def _with_p(sql: str, p: str) -> str:
    """SQL of ``dim, x`` (the statistic) and what p needs, with both rounded."""
    return f"SELECT dim, round(x, 6) AS statistic, round({p}, 6) AS p_val FROM ({sql})"


KS_P = """CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda j: CASE j % 2 WHEN 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * lam * lam))))) END"""


@register(f"WITH {POOL} " + _with_p("SELECT CAST(dim AS BIGINT) AS dim, max(abs(cr / m - ct / n)) AS x, max(abs(cr / m - ct / n)) * sqrt(max(m) * max(n) / (max(m) + max(n))) AS lam FROM p GROUP BY 1", KS_P))
def drift_ks(spark, sf_dir):
    return _test(spark, sf_dir, "ks")


@register(f"WITH {POOL} " + _with_p("SELECT CAST(dim AS BIGINT) AS dim, sum((r + t) * (cr / m - ct / n) * (cr / m - ct / n)) * max(m) * max(n) / ((max(m) + max(n)) * (max(m) + max(n))) AS x FROM p GROUP BY 1", shift.cvm_p("x")))
def drift_cvm(spark, sf_dir):
    return _test(spark, sf_dir, "cvm")


@register(f"WITH {POOL}, u AS (SELECT CAST(dim AS BIGINT) AS dim, sum(t * (cr - r + r / 2.0)) AS x, max(m) AS m, max(n) AS n, sum(power(r + t, 3) - (r + t)) AS ties FROM p GROUP BY 1), z AS (SELECT dim, x, (x - m * n / 2.0) / sqrt(m * n / 12.0 * (m + n + 1 - ties / ((m + n) * (m + n - 1)))) AS z FROM u) " + _with_p("SELECT * FROM z", shift.normal_p("z")))
def drift_mwu(spark, sf_dir):
    return _test(spark, sf_dir, "mwu")


@register(f"""WITH {POOL}, q AS (SELECT *, m + n AS tt, r + t AS sz, cr + ct - (r + t) / 2.0 AS b FROM p)
""" + _with_p("""SELECT CAST(dim AS BIGINT) AS dim, sum(CASE WHEN b * (tt - b) - tt * sz / 4.0 > 0 THEN sz / tt / (b * (tt - b) - tt * sz / 4.0) * (power(tt * (cr - r / 2.0) - m * b, 2) / m + power(tt * (ct - t / 2.0) - n * b, 2) / n) ELSE 0 END) * (max(tt) - 1) / max(tt) AS x FROM q GROUP BY 1""", shift.ad_p("x")))
def drift_anderson(spark, sf_dir):
    return _test(spark, sf_dir, "anderson")


CHUNKED = """a AS (SELECT value, event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS chunk FROM events WHERE event_id % 2 = 0), b AS (SELECT value, event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS chunk FROM events WHERE event_id % 2 = 1),
ra AS (SELECT chunk, avg(value) AS value FROM a GROUP BY 1), rb AS (SELECT chunk, avg(value) AS value FROM b GROUP BY 1), band AS (SELECT avg(value) - 1 * stddev_pop(value) AS lo, avg(value) + 1 * stddev_pop(value) AS hi FROM ra),
r AS (SELECT chunk, value, lo, hi, value < lo OR value > hi AS drifted FROM rb, band)"""


def _chunks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    value = lambda rest: shift.chunks(events.filter(f"event_id % 2 = {rest}"), "event_id", size=500).groupBy("chunk").agg(F.avg("value").alias("value"))
    return shift.chunk_drift(value(0), value(1), 1.0)


@register(f"WITH {CHUNKED} SELECT chunk, round(value, 6) AS value, round(lo, 6) AS lower_threshold, round(hi, 6) AS upper_threshold, drifted FROM r")
def drift_chunked(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk", *(F.round(c, 6).alias(c) for c in ("value", "lower_threshold", "upper_threshold")), "drifted")


@register(f"""WITH {CHUNKED}, g AS (SELECT drifted, row_number() OVER (ORDER BY chunk) - row_number() OVER (PARTITION BY drifted ORDER BY chunk) AS g FROM r), k AS (SELECT drifted, g, count(*) AS n FROM g GROUP BY 1, 2)
SELECT round(100.0 * coalesce(sum(n) FILTER (drifted), 0) / sum(n), 1) AS pct_drifted, coalesce(max(n) FILTER (drifted), 0) AS longest_run FROM k""")
def drift_chunk_runs(spark, sf_dir):
    return quality.longest_run(_chunks(spark, sf_dir), "chunk", "drifted")


def _event_chunks(spark, sf_dir):
    """Even events are the reference, odd ones the test, in chunks of 500 each."""
    events = table(spark, sf_dir, "events").filter("value is not null").select("event_id", F.array("value").alias("x"))
    reference, test = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    return reference, shift.in_chunks(reference, test, "x", "event_id", size=500).checkpoint()


EVENT_CHUNKS = """g AS (SELECT value AS v, (row_number() OVER (PARTITION BY event_id % 2 ORDER BY event_id) - 1) // 500 AS c, event_id % 2 AS side FROM events WHERE value IS NOT NULL), h AS (SELECT v, CASE side WHEN 0 THEN -1 - c ELSE c END AS chunk FROM g),
rv AS (SELECT v, count(*) AS r, sum(count(*)) OVER (ORDER BY v) AS cr, sum(count(*)) OVER () AS m FROM h WHERE chunk < 0 GROUP BY 1), o AS (SELECT chunk, v, count(*) AS t FROM h GROUP BY 1, 2),
w AS (SELECT chunk, o.v, t, sum(t) OVER (PARTITION BY chunk ORDER BY o.v) AS ct, sum(t) OVER (PARTITION BY chunk) AS n, coalesce(rv.cr, 0) AS cr, CASE WHEN rv.v = o.v THEN rv.r ELSE 0 END AS r, (SELECT max(m) FROM rv) AS m FROM o ASOF LEFT JOIN rv ON o.v >= rv.v)"""


@register(f"WITH {EVENT_CHUNKS} SELECT chunk, round(max(greatest(abs(ct / n - cr / m), abs((ct - t) / n - (cr - r) / m))), 6) AS value FROM w GROUP BY 1")
def drift_chunks_ks(spark, sf_dir):
    return shift.univariate_chunks(*_event_chunks(spark, sf_dir), "x", "ks").select("chunk", F.round("value", 6).alias("value"))


@register(f"""WITH {EVENT_CHUNKS}, k AS (SELECT sum(power(r, 3) - r) AS ties FROM rv), u AS (SELECT chunk, sum(t * (cr - r / 2.0)) AS u, sum(power(r + t, 3) - (r + t) - power(r, 3) + r) AS more, max(m) AS m, max(n) AS n FROM w GROUP BY 1)
SELECT chunk, round(abs(u - m * n / 2.0) / sqrt(m * n / 12.0 * (m + n + 1 - (ties + more) / ((m + n) * (m + n - 1)))), 6) AS value FROM u, k""")
def drift_chunks_mwu(spark, sf_dir):
    return shift.univariate_chunks(*_event_chunks(spark, sf_dir), "x", "mwu").select("chunk", F.round("value", 6).alias("value"))


VECTOR_CHUNKS = f"""{EMB}, g AS (SELECT *, (row_number() OVER (PARTITION BY vec_id % 4 = 0 ORDER BY vec_id) - 1) // 25 AS c FROM e), h AS (SELECT vec_id, x, CASE WHEN vec_id % 4 = 0 THEN c ELSE -1 - c END AS chunk FROM g)"""


def _vector_chunks(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    return reference, shift.in_chunks(reference, test, "embedding", "vec_id", size=25).checkpoint()


@register(f"""WITH {VECTOR_CHUNKS}, d AS (SELECT a.chunk, a.vec_id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS k FROM h a JOIN h b ON b.chunk < 0 AND a.vec_id <> b.vec_id)
SELECT chunk, round(avg(s), 6) AS value FROM (SELECT chunk, vec_id, avg(d) AS s FROM d WHERE k <= 10 GROUP BY 1, 2) GROUP BY 1""")
def drift_chunks_knn(spark, sf_dir):
    return shift.knn_chunks(*_vector_chunks(spark, sf_dir), "vec_id", "embedding").select("chunk", F.round("value", 6).alias("value"))


@register(f"""WITH {VECTOR_CHUNKS}, d AS MATERIALIZED (SELECT a.chunk AS ca, b.chunk AS cb, a.vec_id AS i, b.vec_id AS j, power(list_distance(a.x, b.x), 2) AS d FROM h a JOIN h b ON true), s AS (SELECT quantile_cont(d, 0.5) AS s FROM d WHERE i < j),
k AS (SELECT ca, cb, i, j, exp(-d / (2 * s)) AS k FROM d, s), n AS (SELECT chunk, count(*) AS n FROM h GROUP BY 1), m AS (SELECT count(*) AS m FROM h WHERE chunk < 0), rr AS (SELECT sum(k) / (max(m) * (max(m) - 1)) AS rr FROM k, m WHERE ca < 0 AND cb < 0 AND i <> j),
own AS (SELECT ca AS chunk, sum(k) AS o FROM k WHERE ca = cb AND i <> j GROUP BY 1), crossed AS (SELECT ca AS chunk, sum(k) AS x FROM k WHERE cb < 0 GROUP BY 1)
SELECT chunk, round(rr + coalesce(o, 0) / (n * (n - 1)) - 2 * x / (n * m), 5) AS value FROM n JOIN crossed USING (chunk) LEFT JOIN own USING (chunk), m, rr WHERE n > 1""")
def drift_chunks_mmd(spark, sf_dir):
    return shift.mmd_chunks(*_vector_chunks(spark, sf_dir), "embedding").select("chunk", F.round("value", 5).alias("value"))


@register("""WITH c AS (SELECT event_type AS class_name, value AS v, sum((event_id % 3 <> 0)::INT) AS r, sum((event_id % 3 = 0)::INT) AS t FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
p AS (SELECT class_name, sum(r) OVER w AS cr, sum(t) OVER w AS ct, sum(r) OVER (PARTITION BY class_name) AS m, sum(t) OVER (PARTITION BY class_name) AS n FROM c WINDOW w AS (PARTITION BY class_name ORDER BY v))
SELECT class_name, round(max(abs(cr / m - ct / n)), 6) AS statistic, CAST(max(m) AS BIGINT) AS m, CAST(max(n) AS BIGINT) AS n FROM p WHERE m >= 2 AND n >= 2 GROUP BY 1""")
def drift_classwise(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return shift.classwise(events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0"), "event_type", "value").select("class_name", F.round("statistic", 6).alias("statistic"), "m", "n")


@register(f"""WITH {RANKED}, rr AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS k FROM r a JOIN r b ON a.vec_id <> b.vec_id), own AS (SELECT avg(d) AS score FROM rr WHERE k <= 10 GROUP BY vec_id)
SELECT round(avg(u), 6) AS mean_share, count(*) AS n FROM (SELECT (SELECT count(*) FROM own WHERE own.score < s.score) * 1.0 / (SELECT count(*) FROM own) AS u FROM s)""")
def drift_knn(spark, sf_dir):
    reference, _ = _populations(spark, sf_dir)
    own = neighbors.mean_distance(neighbors.knn(reference, reference, "vec_id", "embedding", 10), "vec_id").select(F.col("score").alias("v"), F.lit(0).alias("is_test"))
    found = shift.mwu(own.union(_scores(spark, sf_dir).select("score", F.lit(1))), [])
    return found.select(F.round(F.col("statistic") / (F.col("m") * F.col("n")), 6).alias("mean_share"), "n")


@register()
def drift_mmd(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    return shift.drift_mmd(reference, test, "vec_id", "embedding")


@register(f"""WITH {KNN}, m AS (SELECT count(*) FILTER (vec_id % 4 <> 0) AS m, count(*) FILTER (vec_id % 4 = 0) AS n FROM e), c AS (SELECT count(*) FILTER ((vec_id % 4 = 0) <> (neighbor % 4 = 0)) AS crossing FROM k WHERE rank = 1)
SELECT round(greatest(0, 1 - crossing * (m + n) / (2.0 * m * n)), 6) AS divergence, crossing FROM c, m""")
def divergence_fnn(spark, sf_dir):
    return neighbors.fnn_divergence(*_populations(spark, sf_dir), "vec_id", "embedding")


@register()
def divergence_mst(spark, sf_dir):
    return spark.createDataFrame([(neighbors.mst_divergence(*_populations(spark, sf_dir), "vec_id", "embedding"),)], "divergence double")


STRATIFIED = "r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents), s AS (SELECT doc_id, lang, CASE WHEN k <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS split, CASE WHEN k > floor(0.2 * n + 0.5) THEN CAST(k - floor(0.2 * n + 0.5) - 1 AS BIGINT) % 3 END AS fold FROM r)"


@register(f"WITH {STRATIFIED} SELECT * FROM s")
def split_stratified(spark, sf_dir):
    return splitting.stratified(table(spark, sf_dir, "documents"), "doc_id", "lang", folds=3, seed=3)


@register("""SELECT o_orderkey, o_custkey, CASE WHEN ('0x' || substr(md5('5:' || CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT < 858993459 THEN 'test' ELSE 'train' END AS split,
CASE WHEN ('0x' || substr(md5('5:' || CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT >= 858993459 THEN ('0x' || substr(md5('5:' || CAST(o_custkey AS VARCHAR)), 9, 8))::BIGINT % 5 END AS fold FROM orders""")
def split_grouped(spark, sf_dir):
    return splitting.grouped(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", seed=5)


@register(f"""WITH {STRATIFIED}, w AS (SELECT lang, count(*) * 1.0 / (SELECT count(*) FROM s) AS p FROM s GROUP BY 1), z AS (SELECT split, count(*) AS size FROM s GROUP BY 1),
g AS (SELECT z.split, w.lang AS class_name, round(100 * abs(coalesce(c.k, 0) * 1.0 / size - p), 1) AS deviation FROM z CROSS JOIN w LEFT JOIN (SELECT split, lang, count(*) AS k FROM s GROUP BY 1, 2) c ON c.split = z.split AND c.lang = w.lang)
SELECT split, class_name, deviation FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY deviation DESC, class_name) AS r FROM g) WHERE r = 1""")
def stratification_deviation(spark, sf_dir):
    return splitting.deviation(split_stratified(spark, sf_dir), "lang")


@register("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('2:' || CAST(event_id AS VARCHAR)), event_id) AS k FROM events), (SELECT min(n) AS goal FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) WHERE k <= goal")
def class_balance_global(spark, sf_dir):
    return splitting.rebalanced(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", "global", 2)


@register(f"""WITH x AS ({_long(METRICS, "lineitem", "l_orderkey, l_linenumber")}), {PROFILE}, t AS (SELECT unnest([1.5, 2.0, 2.5])::DOUBLE AS threshold), m AS (SELECT unnest(['modzscore', 'zscore']) AS method),
d AS (SELECT l_orderkey, l_linenumber, method, threshold, max(CASE WHEN method = 'zscore' THEN {Z} ELSE {MODZ} END) AS d FROM x JOIN p USING (metric_name) JOIN s USING (metric_name) CROSS JOIN t CROSS JOIN m GROUP BY 1, 2, 3, 4)
SELECT method, threshold, count(*) FILTER (d > threshold) AS outlier_count FROM d GROUP BY 1, 2""")
def sweep_outlier_threshold(spark, sf_dir):
    return quality.outlier_sweep(table(spark, sf_dir, "lineitem"), LINE, METRICS, ["modzscore", "zscore"], [1.5, 2.0, 2.5])


def _hierarchy(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    counts = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("class_name")).agg(F.count("*").alias("n"))
    return edges.union(region.select("r_name", F.lit("WORLD"))).union(spark.createDataFrame([("WORLD", None)], "child string, parent string")), counts


LABELED = "c AS (SELECT n_nationkey, n_regionkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"


@register(f"WITH {LABELED}, g AS (SELECT sum(n) / count(*) AS target FROM c) SELECT n_name AS node, n, round(target, 3) AS target, round(target - n, 3) AS shortfall, CASE WHEN n = 0 THEN 'acquire' ELSE 'augment' END AS action FROM c, g WHERE n < target")
def ontology_worklist(spark, sf_dir):
    return ontology.worklist(*_hierarchy(spark, sf_dir))


@register(f"WITH {LABELED} SELECT round(avg((n > 0)::INT), 6) AS leaf_coverage, count(*) AS leaf_count FROM c")
def ontology_leaf_coverage(spark, sf_dir):
    return ontology.leaf_coverage(*_hierarchy(spark, sf_dir))


@register(f"WITH {LABELED} SELECT r_name AS node FROM region JOIN c ON n_regionkey = r_regionkey GROUP BY 1 HAVING sum(n) = 0")
def ontology_dark_branches(spark, sf_dir):
    return ontology.dark_branches(*_hierarchy(spark, sf_dir))


@register("""WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region), n AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
t(node, ancestor, depth) AS (SELECT node, node, 0 FROM n UNION ALL SELECT t.node, e.parent, depth + 1 FROM t JOIN e ON e.child = t.ancestor) SELECT node, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM t GROUP BY 1, 2""")
def ontology_closure(spark, sf_dir):
    return ontology.closure(_hierarchy(spark, sf_dir)[0]).select("node", "ancestor", F.col("depth").cast("long").alias("depth"))


@register()
def cluster_outliers(spark, sf_dir):
    return quality.cluster_outliers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, 1.5)


@register()
def hdbscan_clusters(spark, sf_dir):
    return density.hdbscan(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("membership", F.round("membership", 6))


@register(f"WITH {KNN} SELECT vec_id, round(max(dist), 6) AS core FROM k WHERE rank <= 4 GROUP BY 1")
def core_distances(spark, sf_dir):
    return density.core_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("core", 6).alias("core"))


@register()
def cluster_outliers_hdbscan(spark, sf_dir):
    far = density.density_distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter("deviations > 1.5")
    return far.select("vec_id", F.lit("cluster_distance").alias("metric_name"), F.round("metric_value", 6).alias("metric_value"), "cluster_id")


@register()
def cluster_duplicates(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return density.cluster_duplicates(vectors, "vec_id", "embedding", 0.5, density.hdbscan(vectors, "vec_id", "embedding"))


@register()
def prioritize_hdbscan(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    return neighbors.prioritize(density.hdbscan_scores(test, reference, "vec_id", "embedding", "hdbscan_complexity"), "vec_id")


@register()
def domain_classifier_drift(spark, sf_dir):
    auroc, drifted, _ = shift.domain_classifier(*_populations(spark, sf_dir), "vec_id", "embedding")
    return spark.createDataFrame([(auroc, drifted)], "auroc double, drifted boolean")


@register("""WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b FROM lineitem WHERE l_orderkey % 10 <> 0), f AS (SELECT * FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT l_orderkey, l_linenumber, 'l_quantity' AS factor, round(abs(l_quantity - a[2]) / ((a[3] - a[1]) / 1.349), 4) AS deviation FROM f, q UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', round(abs(l_extendedprice - b[2]) / ((b[3] - b[1]) / 1.349), 4) FROM f, q""")
def factor_deviations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct(*LINE))
    found = shift.factor_deviations(lines.filter("l_orderkey % 10 <> 0"), lines.filter("l_orderkey % 10 = 0"), "at", ["l_quantity", "l_extendedprice"])
    return found.select("at.*", "factor", "deviation")


def _coded(metric: str) -> str:
    """SQL: the decile code of a metric; repeated edges are one."""
    return f"(SELECT 1 + count(DISTINCT e) FROM unnest(q_{metric}[2:10]) t(e) WHERE e > q_{metric}[1] AND e < q_{metric}[11] AND {metric} >= e)"


PREDICTED = f"(SELECT CASE WHEN l_discount > 0.08 THEN 'true' ELSE 'false' END AS flag, {', '.join(f'{_coded(m)} AS {m}' for m in METRICS)} FROM lineitem, (SELECT {', '.join(f'quantile_cont({m}, [{chr(44).join(str(i / 10) for i in range(11))}]) AS q_{m}' for m in METRICS)} FROM lineitem))"


@register(f"SELECT y_name AS factor, round(mi / ln(2), 4) AS mi_bits FROM ({_mi_sql([('flag', m) for m in METRICS], 'coded').replace('WITH c AS', f'WITH coded AS MATERIALIZED {PREDICTED}, c AS')})")
def factor_predictors(spark, sf_dir):
    return shift.factor_predictors(table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_discount") > 0.08), "flag", METRICS)


@register("SELECT doc_id, md5('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents")
def shuffle_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", shuffled("doc_id", 1).alias("h"))


SIGNATURES = "s AS (SELECT doc_id, sha256(lower(text)) AS folded, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS bare FROM documents WHERE text IS NOT NULL)"


def _signature_edges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    signed = docs.select("doc_id", F.sha2(F.lower("text").cast("binary"), 256).alias("folded"), F.sha2(F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), " ").cast("binary"), 256).alias("bare"))
    return duplicates.signature_edges(signed, "doc_id", {"folded": "folded", "bare": "bare"})


@register(f"""WITH RECURSIVE {SIGNATURES}, e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON (a.folded = b.folded OR a.bare = b.bare) AND a.doc_id <> b.doc_id),
r(node, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y) SELECT node AS key, min(root) AS group_id FROM r GROUP BY 1""")
def near_duplicates_merged(spark, sf_dir):
    return duplicates.merged_groups(_signature_edges(spark, sf_dir))


@register(f"""WITH {KNN}, m AS (SELECT quantile_cont(dist, 0.5) AS scale FROM k WHERE rank = 1) SELECT vec_id AS a, neighbor AS b, 'cluster' AS method FROM k, m WHERE rank <= 5 AND dist < 0.9 * scale""")
def cluster_duplicate_edges(spark, sf_dir):
    return duplicates.short_edges(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


@register()
def ood_domain_classifier(spark, sf_dir):
    return shift.ood_domain_classifier(*_populations(spark, sf_dir), "vec_id", "embedding")


@register()
def prioritize_kmeans(spark, sf_dir):
    reference, test = _populations(spark, sf_dir)
    return neighbors.prioritize(neighbors.kmeans_scores(test, reference, "vec_id", "embedding", 10, "kmeans_complexity"), "vec_id")


@register(f"WITH {POOL} " + _with_p("""SELECT CAST(dim AS BIGINT) AS dim, (sum(r * power(cr + ct - (r + t - 1) / 2.0 - (m + n) / m * (cr - (r - 1) / 2.0), 2) / ((cr - (r - 1) / 2.0) / (m + 1) * (1 - (cr - (r - 1) / 2.0) / (m + 1)) * n * (m + n) / m)) / max(m)
 + sum(t * power(cr + ct - (r + t - 1) / 2.0 - (m + n) / n * (ct - (t - 1) / 2.0), 2) / ((ct - (t - 1) / 2.0) / (n + 1) * (1 - (ct - (t - 1) / 2.0) / (n + 1)) * m * (m + n) / n)) / max(n)) / 2 AS x FROM p GROUP BY 1""", shift.ad_p("x")))
def drift_bws(spark, sf_dir):
    return _test(spark, sf_dir, "bws")
