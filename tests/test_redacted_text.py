import re

from tidemark.functions import envelope as V
from tidemark.functions import fixed
from tidemark.plans import registry


def brute(text):
    text = text or ""
    for pattern, label in fixed.POST_REDACTIONS:
        text = re.sub(pattern, label, text)
    return re.sub(r"\s+", " ", text).strip()


def test_whole_texts_are_redacted(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: brute(r.text) for r in registry.t(spark, d, "documents").collect()}
    assert {r.doc_id: r.text for r in registry.QUERIES["redacted_text"](spark, d).collect()} == want
    assert max(map(len, want.values())) > 500


def test_the_cut_is_an_option(spark):
    df = spark.createDataFrame([("word " * 200 + "me@x.org",)], "x string")
    whole, cut = df.select(V.clean_text(df.x, None), V.clean_text(df.x)).first()
    assert whole == "word " * 200 + "[redacted-email]" and cut == whole[:500]
