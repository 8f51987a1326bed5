import base64
import random
import zlib

import corpus_pipeline as pipeline
import pytest
from tessaly.llm import langid

from .cases import SCHEMA, documents

WORDS = {"en": "the of and to in that was with his for", "fr": "le la les des une est dans pour qui sur", "de": "der die und das nicht ein mit von sich auf"}


def test_known_languages_and_awkward_documents(spark):
    rows, n = [], 0
    for lang, text in WORDS.items():
        w = text.split()
        for k in range(40):
            rows.append((n, " ".join(w[(k * j + j) % 10] for j in range(1, 60)), lang))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where(~langid.held_out()), texts=20, longest=400)
    assert sorted(model) == ["de", "en", "fr"] and all(len(v) <= 20 * 401 for v in model.values())
    got = langid.classify(docs.withColumn("held_out", langid.held_out()), model, keep=["doc_id", "lang", "held_out"]).select("carried.*", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred and 0.3 < r.score <= 1 for r in got) >= 0.9 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = documents(spark)
    out = langid.classify(odd, model).select("carried.*", "lang_pred", "score").collect()
    assert len(out) == odd.count() and out[0].length == "x"
    for r in out:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    assert langid.learn(spark.createDataFrame([], SCHEMA)) == {}
    assert {r.lang_pred for r in langid.classify(odd, {}).collect()} == {"und"}
    assert langid.classify(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_margins_are_relative_to_the_size(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(data)
    noise = [base64.b64encode(random.Random(k).randbytes(22500)).decode() for k in range(6)]
    clean = [("The answer was with his for.", "en"), ("Die und nicht ein.", "de"), ("Éaux dans pour les.", "fr"), ("Que los una por ción.", "es"), ("This.", "en"), ("Avec.", "fr"), ("Erö.", "de")]
    upper = [(r.text.upper(), r.lang) for r in data.where("length(text) between 1000 and 1500 and doc_id < 200").orderBy("doc_id").limit(20).collect()]
    rows = [(k, t, lang) for k, (t, lang) in enumerate([*clean, *upper, *((t, None) for t in noise)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r.doc_id: r for r in langid.classify(docs, model).select("carried.*", "lang_pred", "score").collect()}
    assert all(told[k].lang_pred == lang and told[k].score > 0.5 for k, _, lang in rows if lang)
    assert all(told[k].score < 0.3 for k, _, lang in rows if not lang)
    kept = pipeline.language_id(spark, data.unionByName(docs.withColumn("doc_id", docs.doc_id + 10**6)), "").where("doc_id >= 1000000").collect()
    assert sorted(r.doc_id - 10**6 for r in kept) == [k for k, _, lang in rows if lang]
    one = langid.classify(docs.where("doc_id < 3"), {"en": model["en"]}).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("en", 1.0)}


def test_whole_texts_ties_and_very_long_texts(spark):
    rows = [(k, f"{a} " * n, lang) for k, (a, n, lang) in enumerate([("le chat noir", 40, "fr"), ("the black cat", 40, "en"), ("the " * 3000, 1, "en"), ("le lion", 2, "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, texts=5, longest=1000)
    # Texts come whole or not at all.
    assert set(model["fr"].split(b"\n")) == {t.encode() for _, t, lang in rows if lang == "fr"} and model["en"].decode() == rows[1][1]
    twins = {"aa": model["en"], "bb": model["en"]}
    told = langid.classify(docs, twins).collect()
    assert {(r.lang_pred, r.score) for r in told} == {("aa", 0.0)}
    long = spark.createDataFrame([(1, "the black cat " * 200_000)], "doc_id long, text string")
    r = langid.classify(long, model).collect()[0]
    assert r.lang_pred == "en" and r.score > 0.5 and r.carried.doc_id == 1
    many = spark.createDataFrame([(k, "text", f"l{k}") for k in range(6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(many, most=5)


def test_against_plain_sizes(spark):
    """Where the lead in compressed size isn't narrow, it alone decides."""
    import zstandard as z

    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(data.where(~langid.held_out()))
    told = {r.carried.doc_id: r for r in langid.classify(data, model).collect()}
    checked = 0
    for r in data.collect():
        body = (r.text or "").lower().encode()
        if len(body) < langid.SHORT or told[r.doc_id].lang_pred == "und":
            continue
        sizes = {}
        for lang, words in model.items():
            coder = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(words, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(body[k : k + 2048])) for k in range(0, len(body), 2048))
        first, second = sorted(sizes.values())[:2]
        if (second - first) / first >= 2 * langid.NARROW:
            checked += 1
            assert told[r.doc_id].lang_pred == min(sizes, key=sizes.get)
    assert checked > 50
