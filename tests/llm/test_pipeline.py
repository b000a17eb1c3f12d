import sentencepiece as library
from test_minhash import brute as linked
from test_mixing import reshared
from test_substrings import brute as cut

import corpus_pipeline as p
from plumbline.llm import langid, queries


def test_stages_as_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        after = docs.collect()
        found[name] = (before, after)
        if name != "sentencepiece":
            assert tuple(docs.columns) == p.COLUMNS
            docs = spark.createDataFrame(after, docs.schema)

    before, after = found["language_id"]
    assert set(after) <= set(before) and {r.doc_id for r in before if langid.has_letter(r.text) and len(r.text) > 20} <= {r.doc_id for r in after}

    before, after = found["near_dedup"]
    assert {r.doc_id for r in after} == {k for k, _, _, kept in linked({r.doc_id: r.text for r in before}, 5) if kept} and set(after) <= set(before)

    before, after = found["substring_dedup"]
    expected = {k: (n, m, t) for k, n, m, t in cut([(r.doc_id, r.text) for r in before], 13)}
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id: r.text for r in after} == {k: t if m else texts[k] for k, (n, m, t) in expected.items() if not m or m < n}

    before, after = found["mixing"]
    assert set(after) <= set(before)
    sizes, taken = {}, {}
    for rows, into in ((before, sizes), (after, taken)):
        for r in rows:
            into[r.source] = into.get(r.source, 0) + len((r.text or "").encode().split())
    longest = max(len((r.text or "").encode().split()) for r in before)
    for s, t in reshared(sizes).items():
        assert abs(taken.get(s, 0) - t) <= longest
    assert max(sum(r.doc_id == k for r in after) for k in {r.doc_id for r in after}) <= 2

    before, after = found["sentencepiece"]
    raw = library.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert sorted((r.doc_id, r.n_tokens, r.ids, r.decoded) for r in after) == sorted((r.doc_id, len(i := raw.encode(r.text or "", add_eos=True)), i, raw.decode(i)) for r in before)


def test_run_is_the_stages(spark, sf_dir):
    rows = queries.QUERIES["pipeline"](spark, sf_dir).collect()
    assert rows and rows[0].n_tokens == len(rows[0].ids)


def test_null_and_repeated_ids(spark):
    words = lambda a, n: " ".join(f"w{i}" for i in range(a, a + n))
    texts = [(None, words(0, 40)), (None, words(100, 40)), (5, words(200, 40)), (5, words(300, 40)), (5, words(200, 40)), (None, words(300, 40)), (7, words(200, 15) + " " + words(500, 30))]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    near = p.near_dedup(spark, docs, "")
    clean = [(None, words(0, 40)), (None, words(100, 40)), (5, words(200, 40)), (5, words(300, 40)), texts[-1]]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=key) == sorted(clean, key=key)
    cut = [*clean[:-1], (7, words(500, 30))]
    found = p.substring_dedup(spark, near, "").collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=key) == sorted(cut, key=key)


def test_odd_rows_pass_every_stage(spark, sf_dir):
    """Nulls in any column, junk, empty and very long texts, ties, repeated rows: a defined result at each stage."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*p.COLUMNS)
    schema = real.schema
    good = [tuple(r) for r in real.filter("n_chars > 200").limit(60).collect()]
    junk = [(900_001, "0x3f 1234 {} ;; 77", None, "web", 18), (900_002, "Привет, как дела сегодня вечером", None, None, 32), (900_003, None, None, None, None), (900_004, "", "en", "", 0), (900_005, "\u200b \u3000", None, "a", 3)]
    long_one = " ".join(good[0][1].split()[::-1] * 400)
    odd = [(None, good[3][1], None, None, None), (good[5][0], good[5][1], "en", None, 1), good[7], good[7], (900_010, long_one, "en", "long", len(long_one)), (900_011, "a", "en", "web", 1)]
    docs = spark.createDataFrame([*good, *junk, *odd], schema)
    kept = p.language_id(spark, docs, sf_dir)
    after = kept.collect()
    assert {r.doc_id for r in after} & {900_001, 900_002, 900_003, 900_004, 900_005} == set()  # planted junk goes
    assert sum(r.doc_id in {g[0] for g in good} for r in after) >= 0.9 * len(good) and any(r.doc_id == 900_010 for r in after)
    for _, stage in p.STAGES[1:]:
        kept = stage(spark, spark.createDataFrame(kept.collect(), kept.schema), sf_dir)
    rows = kept.collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)
    texts = [r.decoded for r in rows]
    assert max(map(texts.count, texts)) <= 2  # copies are gone, a mix takes no text more than twice


def test_empty_table_passes_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
