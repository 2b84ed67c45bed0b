"""Rows that repeat a key over different texts lose no link, in any order of the rows."""

import itertools
import random

import pytest

from tidemark.llm import jaccard_join as J


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def near(seed, k=1):
    """The text of a seed with one word changed near its end."""
    return " ".join([*words(seed)[:-k], "changed"])


def brute(rows):
    sets = []
    for doc, text in rows:
        w = (text or "").split()
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()))
    group = {doc: doc for doc, s in sets if s}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((root(a), root(b)))
            group[y] = x
    return sorted((doc, len(s), root(doc) if s else doc) for doc, s in sets)


A, B, C = (" ".join(words(i)) for i in (1, 2, 3))


@pytest.mark.parametrize("order", [0, 1, 2])
def test_both_links_stay(spark, order):
    rows = [(5, A), (5, B), (7, near(1)), (9, near(2)), (9, C), (4, near(3)), (11, "x"), (11, None), (12, " ".join(words(8)))]
    random.Random(order).shuffle(rows)
    got = J.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert sorted(map(tuple, got)) == want
    assert {c for d, _, c in want if d in (5, 7, 9, 4)} == {4}


def test_keep_first_keeps_one_of_a_tied_class(spark):
    rows = [(5, A), (5, B), (7, near(1)), (9, near(2)), (12, C)]
    for turn in (rows, rows[::-1]):
        got = J.keep_first(spark.createDataFrame(turn, "doc_id long, text string")).collect()
        assert sorted(r.doc_id for r in got) == [5, 12]


def test_null_keys_beside_repeated_ones(spark):
    rows = [(None, A), (5, near(1)), (5, B), (None, near(2)), (None, C)]
    got = J.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "5"), ("None", "None")]
