"""SQL (DuckDB) for the queries whose results SQL can state exactly."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reached(links: str) -> str:
    """CTEs ``b`` (both directions of links a, b) and ``r`` (node, root): all that each root reaches downwards."""
    return f"b AS (SELECT a AS x, b AS y FROM {links} UNION SELECT b, a FROM {links}), r(node, root) AS (SELECT DISTINCT x, x FROM b UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.node WHERE r.root < b.y)"


OP3 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {reached('l')},
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id"""

OP5 = f"""WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13), x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM k),
f AS (SELECT s, min(doc_id) AS first FROM x GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM x JOIN f USING (s) WHERE first < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
t AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY 1),
c AS (SELECT doc_id, count(*) AS gone FROM g GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP7 = f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.label = q.label AND p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.93), {reached('l')},
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1), k AS (SELECT x, count(*) AS n FROM b GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM e LEFT JOIN k ON k.x = vec_id LEFT JOIN m ON node = vec_id"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(s, 1 + 5 * CAST(k // 4 AS INT), 5))::INT >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""

ORACLES = {"op3_minhash": OP3, "op5_substring_dedup": OP5, "op7_embedding_dedup": OP7, "op10_warc": OP10}
