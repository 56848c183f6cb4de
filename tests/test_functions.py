from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from presswerk.functions import dates as D
from presswerk.functions import scoring as S
from presswerk.functions import similarity as M
from presswerk.functions import text as X
from presswerk.functions import url as U


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://www.nzz.ch/article?utm_source=google&utm_medium=social&id=123", "https://www.nzz.ch/article?id=123"),
        ("https://WWW.NZZ.CH/article/", "https://www.nzz.ch/article"),
        ("https://www.nzz.ch/article#section", "https://www.nzz.ch/article"),
        ("https://a.ch/x?b=&REF=1&c=2", "https://a.ch/x?c=2"),
        ("", ""),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, U.normalize_url(F.lit(url))) == want
    assert one(spark, U.url_hash(F.lit(url))) == hashlib.sha256(want.encode()).hexdigest()


def test_url_parts(spark):
    assert one(spark, U.normalize_url(F.lit(None).cast("string"))) is None
    assert set(one(spark, U.slug_tokens(F.lit("https://nzz.ch/wirtschaft/ubs-meldet-konkurs-2026")))) == {"wirtschaft", "ubs", "meldet", "konkurs"}
    assert one(spark, U.is_image_url(F.lit("https://a.ch/p.JPG"))) and not one(spark, U.is_image_url(F.lit("ftp://a.ch/p.jpg"))) and not one(spark, U.is_image_url(F.lit("https://a.ch/logo.png")))
    assert one(spark, U.pixels(F.lit("600px"))) == 600 and one(spark, U.pixels(F.lit("wide"))) is None
    assert one(spark, U.largest_source(F.lit("a.jpg 300w, b.jpg 1200w, c.jpg 600w"))) == "b.jpg"
    assert one(spark, U.title_from_path(F.lit("https://a.ch/big-news_today.html?x=1"))) == "Big News Today"
    assert one(spark, U.is_article_link(F.lit("https://a.ch/tag/x"), F.lit("https://a.ch/"))) is False


def test_text(spark):
    assert one(spark, X.clean_whitespace(F.lit("Hello\t\n\r\nworld "))) == "Hello world"
    assert one(spark, X.truncate(F.lit("x" * 51), 20)) == "x" * 17 + "..."
    assert one(spark, X.sentences(F.lit("One. Two!  Three? "))) == ["One.", "Two!", "Three?"]
    assert one(spark, X.count_words(F.lit("  a b  c "))) == 3
    assert one(spark, X.safe_filename(F.lit('a<b>: "c".txt'))) == "ab_c.txt"
    assert len(one(spark, X.safe_filename(F.lit("x" * 300 + ".txt")))) == 200
    assert one(spark, X.split_list(F.lit(" a , ,b"))) == ["a", "b"]
    assert one(spark, X.normalize_company(F.lit(" Müller & Co. Holding AG "))) == "müller co"
    assert {"ubs", "chf", "500"} <= set(one(spark, X.entity_tokens(F.lit("UBS zahlt CHF 500 Millionen"))))
    assert one(spark, X.smart_truncate(F.lit("Kurz. " + "lang " * 100))) == "Kurz."
    assert one(spark, X.without(F.array(F.lit("a"), F.lit("Unavailable")), "unavailable")) == ["a"]
    assert one(spark, X.icon_entity(F.lit("&#128512;"))) == "&#8226;" and one(spark, X.icon_entity(F.lit("&#9888;"))) == "&#9888;"


def test_dates(spark):
    assert str(one(spark, D.parse_german_date(F.lit("am 17. März 2026")))) == "2026-03-17"
    assert one(spark, D.parse_german_date(F.lit("31. Februar 2026"))) is None and one(spark, D.parse_german_date(F.lit("17. Foo 2026"))) is None
    day = F.lit("2026-03-17").cast("date")
    assert one(spark, D.german_date(day)) == "17. März 2026"
    assert one(spark, D.relative_day(day, F.lit("2026-03-18").cast("date"))) == "Gestern"


def test_scores(spark):
    assert one(spark, S.impact(F.lit("elevated_risk"))) == "negative" and one(spark, S.impact(F.lit(None).cast("string"))) == "neutral"
    assert one(spark, S.error_class(F.lit("SSL handshake failed"))) == "SSL handshake failed" and one(spark, S.error_class(F.lit("HTTP 403"))) == "Blocked (403)" and one(spark, S.error_class(F.lit("x" * 80))) == "x" * 50
    assert [one(spark, S.error_class(F.lit(m))) for m in ("", "Read Timeout", "page not found", "Connection reset", "both methods failed")] == ["Unknown", "Timeout", "Not Found (404)", "Connection Error", "Content Extraction Failed"]
    assert [one(spark, S.impact_rank(F.lit(x).cast("string"))) for x in ("negative", None, "positive", "odd", "elevated")] == [0, 1, 2, 2, 0]
    assert [one(spark, S.provider(F.lit(m), S.PROVIDERS_4, "Other")) for m in ("GPT-4o", "o1-mini", "gemini:x", "ox-nano")] == ["OpenAI", "OpenAI", "Gemini", "Other"]
    assert one(spark, S.quality(F.lit(2000), F.lit(True), F.lit(True))) == 1.0
    assert one(spark, S.provider(F.lit("DeepSeek:x"), S.PROVIDERS_4, "Other")) == "DeepSeek"


def test_similarity(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, M.jaccard(a, b)) == pytest.approx(1 / 3)
    assert one(spark, M.jaccard(a, F.array().cast("array<string>"))) == 0.0
    assert one(spark, M.hamming(F.lit(-1), F.lit(0))) in (32, 64)
    assert one(spark, M.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1.0)


def brute_simhash(text):
    words = text.lower().split()
    if len(words) < 3:
        return None
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = int(hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest(), 16)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    value = sum(1 << b for b in range(64) if votes[b] > 0)
    return (value - (1 << 64) if value >= 1 << 63 else value) or None


def test_simhash_against_bit_by_bit(spark):
    texts = ["", "ab", "a b", "one two three four", "Ümlaut wörter zählen mit " * 30, "x " * 500]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "id int, t string")
    got = {r["id"]: r["simhash"] for r in M.simhash(df, "id", "t").collect()}
    assert [got[i] for i in range(len(texts))] == [brute_simhash(t) for t in texts] and got[len(texts)] is None
