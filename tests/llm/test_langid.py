"""Language identification: held-out accuracy, families, and defined cases."""

import numpy as np
import pytest

from gristmill.llm import langid
from gristmill.llm.langid import LanguageParams, features, has_letter, identify, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op13_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = [r for r in got if r.lang_pred == r.lang]
    assert len(got) > 200 and len(right) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def rows():
    said = {
        "en": "the cat and the dog were with this house that is there", "de": "der Hund und die Katze waren mit diesem Haus das ist dort",
        "fr": "le chat et le chien étaient avec cette maison qui est là", "es": "el gato y el perro estaban con esta casa que está allí", "xx": "zuq zaq qiz qoz zzuq qazz quzq",
    }
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.permutation(said[x].split())), x) for i in range(60) for x in said]


def test_families_and_unknown_codes(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = train(docs, "text", "lang", "doc_id", F.lit(True))
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"], "xx": ["xx"]}
    assert sorted(model.pairs) == [("family", "germanic", "romance"), ("family", "germanic", "xx"), ("family", "romance", "xx"), ("language", "de", "en"), ("language", "es", "fr")]
    tests = [(1, "the house is there"), (2, "das Haus ist dort"), (3, "la maison est là"), (4, "esta casa está allí"), (5, "ZUQ zaq"), (6, None), (7, ""), (8, "12 — 34 ²"), (9, "the house " * 200_000)]
    got = {r.c0: (r.lang_pred, r.score) for r in identify(spark.createDataFrame(tests, "doc_id long, text string"), "text", ["doc_id"], model).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["en", "de", "fr", "es", "xx", "und", "und", "und", "en"]
    assert all(got[i][1] == 0 for i in (6, 7, 8)) and all(0.5 < got[i][1] <= 1 for i in (1, 2, 3, 4, 5, 9))


def test_same_model_each_time_and_repeats_count_once(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows[:100], "doc_id long, text string, lang string")
    more = docs.union(docs.where("doc_id < 5"))
    a, b = (train(d, "text", "lang", "doc_id", F.lit(True)) for d in (docs.repartition(7), more))
    assert a.pairs == b.pairs and (a.weights == b.weights).all()


def test_nothing_or_one_language_learnt(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some text", None), (None, None, "en"), (3, "more", "en")], "doc_id long, text string, lang string")
    none = train(docs, "text", "lang", "doc_id", F.lit(False))
    assert [tuple(r) for r in identify(docs, "text", ["doc_id"], none).collect()] == [(1, "und", 0.0), (None, "und", 0.0), (3, "und", 0.0)]
    one = train(docs, "text", "lang", "doc_id", F.lit(True))
    assert [r.lang_pred for r in identify(docs, "text", ["doc_id"], one).collect()] == ["en", "und", "en"]


def test_empty_table_and_clashing_names(spark, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert langid.op13_language_id(spark, str(tmp_path)).collect() == []
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, h long")
    model = train(docs, "text", "lang", "doc_id", F.lit(True))
    assert identify(docs, "text", ["lang_pred", "h"], model).first()[:2] == ("k", 1)


def test_features_stand_alone():
    dims = LanguageParams().dims
    texts = ["The cat", "Über alles, ça va", "x", "a" * 70_000 + " b"]
    together = features(texts, dims)
    for row, text in zip(together, texts):
        assert np.allclose(row, features([text], dims)[0])
    assert np.allclose((together**2).sum(1), 1)


def test_blocks_change_nothing(monkeypatch):
    texts = ["some words of a text " * 9, "andere Wörter " * 7, "q"]
    whole = features(texts, 1 << 12)
    monkeypatch.setattr(langid, "BLOCK", 13)
    assert np.allclose(whole, features(texts, 1 << 12))


def test_letters():
    assert has_letter("1a") and has_letter("字") and not has_letter("1²_—") and not has_letter("") and not has_letter(None)
