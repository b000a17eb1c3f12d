import base64
import math
import zlib

import numpy as np

from plumbline.llm import langid, queries

TEXTS = {"en": "the cat sat on the mat and then it went away with the other things", "de": "der hund und die katze sind nicht im haus weil es schön ist", "fr": "le chat est sur la table et nous avons été très contents"}


def train(spark):
    rows = [(i, " ".join(sorted(t.split(), key=lambda w, i=i: hash((w, i)))), lang, "x") for i, (lang, t) in enumerate(list(TEXTS.items()) * 5)]
    return spark.createDataFrame(rows + [(99, None, "en", "x"), (98, "123", "xx", "x"), (97, "ok", None, "x")], "doc_id long, text string, lang string, score string")


def test_languages_and_rejection(spark):
    model = langid.fit(train(spark))
    assert model.languages == ("de", "en", "fr")
    names, scores, rejected = langid.classify(model, ["the cat and the mat", "der hund ist nicht schön", "nous avons été sur la table", None, "", "12 !?", "Привет как дела", "the cat " * 20_000])
    assert names[:6] == ["en", "de", "fr", "und", "und", "und"] and names[7] == "en"
    assert rejected == [False, False, False, True, True, True, True, False]
    assert all(0 <= s <= 1 for s in scores) and scores[3] == 0


def test_operator_keeps_rows_and_columns(spark):
    df = train(spark)
    rows = langid.predict(df, langid.fit(df)).collect()
    assert len(rows) == df.count() and set(rows[0].asDict()) == {"doc_id", "text", "lang", "lang_pred", "score", "rejected"}
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0


def test_nothing_to_learn_from(spark):
    df = train(spark)
    model = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}


def test_sample_is_bounded_and_reruns_agree(spark):
    one, two = (langid.fit(train(spark), per_label=2) for _ in range(2))
    assert np.array_equal(one.centroids, two.centroids) and np.array_equal(one.idf, two.idf)


def test_held_out_accuracy(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert not [r for r in rows if r.rejected and len(docs[r.doc_id].text or "") > 5]


FOREIGN = [
    "Wczoraj wieczorem poszliśmy do kina, aby zobaczyć nowy film o przygodach młodego chłopca, który szukał swojego ojca w dalekim kraju",
    "Eilen illalla menimme elokuviin katsomaan uutta elokuvaa nuoren pojan seikkailuista, joka etsi isäänsä kaukaisesta maasta",
    "Dün akşam uzak bir ülkede babasını arayan genç bir çocuğun maceralarını anlatan yeni filmi izlemek için sinemaya gittik",
    "Tối qua chúng tôi đi xem phim mới về cuộc phiêu lưu của một cậu bé đi tìm cha ở một đất nước xa xôi",
]


def test_foreign_prose_and_noise_are_rejected_and_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs)
    raw = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8).tobytes()
    letters = "".join(chr(97 + b % 26) + " " * (b % 7 == 0) for b in raw)
    assert langid.classify(model, [*FOREIGN, base64.b64encode(raw).decode(), letters, raw.hex()])[2] == [True] * 7
    texts = [r.text for r in docs.select("text").limit(3000).collect() if langid.has_letter(r.text)]
    assert sum(langid.classify(model, texts)[2]) <= len(texts) / 1000


def plainly(model, text):
    """The classification from its definition, n-gram by n-gram."""
    if not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    clean = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    raw = f" {' '.join(x for x in clean.split(' ') if x)} ".encode()
    seen = {}
    for n, mark in ((2, 1 << 24), (3, 0)):
        for i in range(len(raw) - n + 1):
            at = (int.from_bytes(raw[i : i + n], "big") | mark) * 2654435761 % 2**32 >> 19
            seen[at] = seen.get(at, 0) + 1
    x = {at: math.log(1 + c) * model.idf[at] for at, c in seen.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    best = max(((sum(v / norm * c[at] for at, v in x.items()), -i) for i, c in enumerate(model.centroids)))
    language = model.owner[-best[1]]
    return model.languages[language], best[0], best[0] < model.reject_below[language][min(13, int(math.log2(len(x))))]


def test_classification_from_its_definition(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.select("text").limit(60).collect()] + [None, "", "12", "ñandú Ünïcode 漢字", "a", *FOREIGN]
    for text, *found in zip(texts, *langid.classify(model, texts)):
        name, score, rejected = plainly(model, text)
        assert (found[0], found[2]) == (name, rejected) and abs(found[1] - score) < 1e-5
