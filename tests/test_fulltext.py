from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cordwood.functions.fulltext import query_terms, tokens, where_text
from cordwood.functions.stemming import stem_words

# Published example pairs of the English stemmer.
PAIRS = """consign consign consigned consign consigning consign consignment consign
consistency consist consistently consist consolation consol consolatory consolatori
conspicuously conspicu conspirator conspir constable constabl constancy constanc
knackeries knackeri knavish knavish kneaded knead knightly knight knitting knit
knives knive happy happi cry cri say say by by ties tie cries cri gas gas this this
gaps gap kiwis kiwi hoping hope hopping hop luxuriated luxuri agreed agre feed feed
generate generat generally general communism communism relational relat conditional condit
rationally ration electricity electr hopefulness hope goodness good formative format
adoption adopt replacement replac controlling control rolling roll rate rate cease ceas
apology apolog analogously analog youth youth dying die skies sky news news innings inning
proceeds proceed succeeded succeed bled bled exceedingly exceed usage usag foxes fox
snowed snow fixing fix played play hated hate disabled disabl nationalization nation
sensitivity sensit decisiveness decis differently differ triplicate triplic feudalism feudal
dogs dog failed fail failure failur running run early earli only onli possibly possibl""".split()


def test_stems(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2]))
    frame = spark.createDataFrame(pairs, "word string, stem string")
    found = frame.withColumn("found", F.expr(stem_words("array(word)")).getItem(0))
    assert [(r.word, r.found) for r in found.collect()] == pairs


@pytest.mark.parametrize(
    "text, terms",
    [
        ("The quick-brown foxes failed at login", {"quick-brown", "quick", "brown", "fox", "fail", "login"}),
        ("don't e-mail bob@example.com", {"e-mail", "e", "mail", "bob@example.com"}),
        ("see https://docs.example.org/guide now", {"see", "docs.example.org/guide", "docs.example.org", "/guide"}),
        ("ftp://x", {"x"}),
        ("wrote /srv/mail/queue.db, not ~/tmp/x", {"wrote", "/srv/mail/queue.db", "~/tmp/x"}),
        ("in src/main.rs line", {"src/main.rs", "line"}),
        ("db.internal.net:5432 refused", {"db.internal.net:5432", "refus"}),
        ("10.1.2.3:80/x", {"10.1.2.3:80/x", "10.1.2.3:80", "/x"}),
        ("www.example.com/a?b=1 v2 -5 3.14", {"www.example.com/a?b=1", "www.example.com", "/a?b=1", "v2", "-5", "3.14"}),
        ("a v1.2.3 end.Next state-of-1 x-1.y-2", {"v1", "2", "3", "end.next", "state-of-1", "state", "1", "x-1.y-2"}),
        ("user_id=42 ÉTATS", {"user", "id", "42", "état"}),
        ("the of and", set()),
        ("", set()),
    ],
)
def test_query_terms(spark, text, terms):
    assert set(query_terms(spark, text)) == terms


def test_every_word_begins_like_its_stem(spark, tables):
    """What the substring test relies on, over every word of the documents."""
    words = spark.read.parquet(f"{tables}/documents.parquet").select(
        F.explode(F.expr(tokens("lower(text)"))).alias("word")
    )
    stems = words.distinct().where(r"word RLIKE '^[\\p{L}-]+$'").withColumn(
        "stem", F.expr(stem_words("array(word)")).getItem(0)
    )
    assert stems.count() > 1000
    assert stems.where("NOT startswith(word, left(stem, length(stem) - 2))").count() == 0


def test_substring_test_loses_no_row(spark, tables):
    """The same rows as the full analysis of every message."""
    from cordwood.functions.fulltext import message_terms

    documents = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    analysed = documents.withColumn("terms", message_terms("text")).cache()
    for query in ("annotation", "licensed versions", "anating", "er", "http"):
        terms = query_terms(spark, query)
        full = analysed
        for term in terms:
            full = full.where(F.array_contains("terms", term))
        quick = {r.doc_id for r in where_text(documents, "text", terms).collect()}
        assert quick == {r.doc_id for r in full.select("doc_id").collect()}


def test_very_long_tokens(spark):
    """Neither stack nor time runs out, and what is too long is not indexed."""
    size = 30_000
    texts = [
        "failed " + text
        for text in (
            "a" * size,
            "a-" * size,
            "a." * size,
            "a_" * size,
            "1." * size,
            "a-b." * size,
            "bo" * 450 + "ing",
            "y" * 1500 + "ing",
            "a.b/" + "c" * size,
            " " * size + "x",
        )
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    assert where_text(frame, "text", ["fail"]).count() == len(texts)
    assert where_text(frame, "text", ["bo" * 450]).count() == 1
    assert where_text(frame, "text", ["y" * 1500 + "ing"]).count() == 1
    assert where_text(frame, "text", ["a" * 1000]).count() == 0
