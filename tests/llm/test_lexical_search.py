import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidemark.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, query in set(items):
        scored = []
        for doc, c in counts:
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * c.total() * n_docs // length))) for t in set(terms(query)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=10):
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, n int, terms string").repartition(3)
    i = spark.createDataFrame([(*x, 1, "y") for x in items], "item_id string, text string, item int, h string")
    return sorted(map(tuple, L.search(d, i, k).collect()), key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 40)))) for i in range(n)]
    items = [(f"i{j}", " ".join(rng.choices(words, weights, k=rng.randrange(1, 12)))) for j in range(15)]
    return docs + docs[:20], items


@pytest.mark.parametrize("k", [1, 10])
def test_equals_brute_force(spark, k):
    docs, items = corpus(k)
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_rounds(spark, monkeypatch):
    docs, items = corpus(7)
    monkeypatch.setattr(L, "ROUND_TERMS", 12)
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .. !"), (4, "Äpfel ÄPFEL apfel_Apfel"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "ONE\x00two"), (7, "x" * 50_000 + " one"), (8, "one " * 30_000), (2**53 + 1, "one"), (-1, "中文 one٣ three")]
    items = [("a", "one"), ("a", "one"), ("a", "two one"), ("b", None), (None, "three Äpfel"), ("c", ""), ("d", "absent"), ("e", "apfel 中文"), ("f", "x" * 50_000)]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []


def test_terms_are_cut_at_texts_and_marks():
    distinct, codes, first = L.split_terms(pa.array(["ab CD,ef", None, "", "gh", "ij-", "-ij kl", "é1"]))
    assert [[distinct[c].decode() for c in codes[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)] == [["ab", "cd", "ef"], [], [], ["gh"], ["ij"], ["ij", "kl"], ["é1"]]


def test_bounds_leave_terms_out():
    import numpy as np

    weights, most, kth = np.array([1, 50, 100]), np.array([10, 10, 10]), np.array([9, 8, 7])
    item = L.plan_item(np.array([2, 0, 1]), weights, most, kth)
    assert item.terms.tolist() == [0, 1, 2] and item.floor == 700 and item.bounds.tolist() == [10, 510, 1510]
    p = L.Postings(np.array([0, 2, 4, 6]), np.array([0, 1, 1, 2, 2, 3]), np.array([10, 10, 10, 10, 10, 2]))
    rows, score = L.best_rows(p, item, item.floor, 4)  # rows 0 and 1 have no term that could reach 700
    assert rows.tolist() == [2] and score.tolist() == [1500]
    rows, score = L.best_rows(p, item, 0, 4)
    assert dict(zip(rows.tolist(), score.tolist(), strict=True)) == {0: 10, 1: 510, 2: 1500, 3: 200}
