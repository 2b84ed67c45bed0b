"""A group of near copies in one host keeps a member in the quality stage, however large the group."""

import pytest

import corpus_pipeline
from tidemark.llm import jaccard_join, line_frequency

KIND = "doc_id long, text string, lang string, source string"


def variant(group, i):
    """Ten lines of twelve words, one word of which is the variant's own."""
    words = [f"g{group}w{k}" for k in range(120)]
    words[(7 * i) % 120] = f"own{i}"
    return "\n".join(" ".join(words[k : k + 12]) for k in range(0, 120, 12))


def other(i):
    return " ".join(f"o{i}w{k}" for k in range(80))


ROWS = [(i, variant(0, i), "en", "hot") for i in range(300)] + [(1000 + i, other(i), "en", "hot") for i in range(300)]
ROWS += [(2000 + i, variant(1, i), "en", "small") for i in range(4)] + [(3000 + i, other(3000 + i), "en", "small") for i in range(4)]


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_one_of_a_group_stays_whole(spark, monkeypatch, bound):
    monkeypatch.setattr(line_frequency, "BROADCAST_LINES", bound)
    df, text = spark.createDataFrame(ROWS, KIND), {r[0]: r[1] for r in ROWS}
    got = {r.doc_id: r.text for r in line_frequency.clean_documents(df).collect()}
    hot, small = [i for i in got if i < 1000], [i for i in got if 2000 <= i < 3000]
    assert len(hot) == 1 and len(small) == 1 and set(got) - {*hot, *small} == {r[0] for r in ROWS if r[0] // 1000 in (1, 3)}
    assert all(got[i] == text[i] for i in got)
    again = {r.doc_id for r in line_frequency.clean_documents(df.repartition(5)).collect()}
    assert again == set(got)
    without = {r.doc_id for r in line_frequency.clean_documents(df, first_stays=False).collect()}
    assert without == set(got) - {*hot, *small}


def test_copies_and_keys(spark):
    rows = [(i, variant(2, 0), "en", "s") for i in range(150)] + [(None, other(1), "en", "s")]
    df = spark.createDataFrame(rows, KIND)
    assert line_frequency.clean_documents(df).count() == 151  # copies count once
    kept = [r.doc_id for r in line_frequency.clean_documents(df, copies_once=False).collect()]
    assert len(kept) == 2 and None in kept  # each copy counts, the first one stays


def test_the_stages_leave_one_of_each_group(spark):
    df = spark.createDataFrame(ROWS, KIND)
    left = jaccard_join.keep_first(corpus_pipeline.quality(spark, df, "")).collect()
    ids = {r.doc_id for r in left}
    assert sum(i < 1000 for i in ids) == 1 and sum(2000 <= i < 3000 for i in ids) == 1 and len(ids) == 306
