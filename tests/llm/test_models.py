import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from hoopframe.llm import language_id, quality, secret_scan
from hoopframe.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    got = QUERIES["op2_language_id"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(lang, "doc_id").collect()
    assert len(rows) == lang.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", "fr"), (5, "123 !!!", "en"), (6, "le chat", None), (7, "the dog " * 30_000, "en"), (7, "the dog", "en")]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_languages_of_odd_texts(small):
    got = language_id.predict(small, language_id.fit(small)).collect()
    for r in got:
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in got if r.doc_id == 6} == {"fr"} and {r.lang_pred for r in got if r.doc_id == 7} == {"en"}
    nothing = language_id.predict(small, language_id.fit(small.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_languages_keep_all_columns(spark):
    rows = spark.createDataFrame([("the cat", "en", 1, 2, "y")], ["text", "lang", "_p", "a.b", "score"])
    got = language_id.predict(rows, language_id.fit(rows))
    assert got.columns == ["text", "lang", "_p", "a.b", "lang_pred", "score"] and tuple(got.first())[:5] == ("the cat", "en", 1, 2, "en")


def test_a_score_doesnt_depend_on_neighbours(spark, small):
    model = language_id.fit(small)
    alone = {r.doc_id: r.score for i in (1, 2, 6) for r in language_id.predict(small.where(f"doc_id = {i}"), model).collect()}
    together = {r.doc_id: r.score for r in language_id.predict(small.coalesce(1), model).collect()}
    assert all(abs(alone[i] - together[i]) < 1e-6 for i in alone)


def test_quality_held_out(spark):
    got = QUERIES["op6_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_without_labels_and_with_odd_texts(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F

    got = quality.score_documents(small, none, F.lit(False)).collect()
    assert len(got) == small.count() and {r.score for r in got} == {0.5}
    assert quality.score_documents(small.limit(0), none, F.lit(False)).collect() == []
    one = spark.createDataFrame([(1, 1), (2, None), (1, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score_documents(small, one, F.lit(False)).collect())


def test_quality_where_nothing_tells_labels_apart(spark):
    docs = spark.range(60).selectExpr("id as doc_id", "'one text for all' as text")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    from pyspark.sql import functions as F

    got = quality.score_documents(docs, labels, F.lit(False)).collect()
    assert len(got) == 60 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}
    long = spark.createDataFrame([(1, "word of a very long text.\n" * 100_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score_documents(long, labels, F.lit(False)).collect())


def test_tree_rules_read_printed_trees():
    text = """RandomForestClassificationModel
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 1.5E-4)
      Predict: 0.0
     Else (feature 1 > 1.5E-4)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    rules = quality.tree_rules(text, ["a", "b"])
    low, high = quality.Condition("a", False, 0.5), quality.Condition("a", True, 0.5)
    assert set(rules) == {(low,), (low, quality.Condition("b", False, 1.5e-4)), (low, quality.Condition("b", True, 1.5e-4)), (high,)}


def _base(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(secret_scan.BASE_RULES[0].pattern, text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


SECRETS = ["password = hunter22", "PassWD:'abcdef'", "api_key=abc", "token: token=abcdefgh", "ſecret=abcdefg", "AKIA" + "A1" * 8, "AKIA" + "a" * 16, "é" * 5 + "f" * 24 + "g" + "0" * 23, None, "", "ghp_" + "a" * 36 + " -----BEGIN RSA PRIVATE KEY-----", "x" * 50_000 + "apikey=" + "z" * 50_000]


def test_secrets_equal_a_plain_scan(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS * 3)], "doc_id long, text string, spans string").coalesce(1)
    for r in secret_scan.scan_secrets(docs, index_docs=5).collect():
        want = _base(r.text or "")
        assert [(s.start, s.end, s.kind) for s in r.secrets if s.kind in ("assign", "access", "hex")] == [(a, b, k) for a, _, b, k in want]
        assert r.spans == "x"
    assert secret_scan.scan_secrets(docs.limit(0)).collect() == []


def test_secret_digest(spark):
    got = {r.doc_id: r for r in QUERIES["op4_secret_scan"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = ",".join(f"{k}:{a}:{b}" for a, _, b, k in _base(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_trigram_queries_are_sound_and_masks_cover():
    by = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.BASE_RULES + secret_scan.MORE_RULES}
    assert by["hex"] == secret_scan.ALWAYS and by["access"] == ("and", "aki", "kia")
    assert by["assign"][0] == "or" and "tok" in secret_scan._terms(by["assign"]) and "api" in secret_scan._terms(by["assign"])


def test_mask(spark):
    docs = secret_scan.scan_secrets(spark.createDataFrame([(1, "a token=abcdefgh b"), (2, None)], "doc_id long, text string"))
    assert [r.text for r in secret_scan.mask_secrets(docs).orderBy("doc_id").collect()] == ["a [secret] b", ""]


def test_posteriors_equal_a_plain_count(spark, small):
    """Naive Bayes over the grams of whole texts, counted and scored in plain Python."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    letters = language_id._letters()

    def grams(text):
        buckets, _ = language_id.gram_buckets([text or ""], letters)
        return buckets.tolist()

    model = language_id.fit(docs)
    counts, n = {}, Counter(x for _, _, x in rows if x is not None)
    for _, t, x in rows:
        if x is not None:
            counts.setdefault(x, Counter()).update(grams(t))
    langs = sorted(counts)
    assert model.langs == langs
    total = {x: sum(counts[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    for r in language_id.predict(docs, model).collect():
        own = grams(r.text)
        logs = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][g] + 0.5) / total[x]) for g in own) for x in langs}
        best = max(logs.values())
        if own and r.lang_pred != "und":
            share = 1 / sum(math.exp(v - best) for v in logs.values())
            assert logs[r.lang_pred] == pytest.approx(best, abs=1e-2) and r.score == pytest.approx(share, abs=1e-2)


def test_score_is_the_sum_over_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    stats = quality.with_statistics(docs.select("doc_id", "text", "quality")).drop("text").cache()
    model = quality.fit(stats, "quality")
    assert model.rules
    for r in stats.withColumn("score", model.score()).collect():
        logit = model.intercept + sum(w for rule, w in model.rules if all((r[c.feature] > c.threshold) == c.above for c in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-12)
