"""Depletion with production parameters on hosts of every size."""

from collections import Counter, defaultdict

from tidemark.llm import line_frequency

PAGE = " ".join(f"site{k}" for k in range(60))


def own(i, n=55):
    return " ".join(f"w{i}_{k}" for k in range(n))


def judged(spark, rows):
    return {r.doc_id: r for r in line_frequency.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}


def test_a_small_host_loses_the_line_of_all_its_pages(spark):
    out = judged(spark, [(i, f"{PAGE}\n{own(i)}", "small") for i in range(12)] + [(100 + i, f"{PAGE}\n{own(i)}", "two") for i in range(2)])
    assert all(out[i].n_left == 55 and not out[i].kept and not out[i].base_failed for i in range(12))
    assert all(out[100 + i].n_left == 115 and out[100 + i].kept for i in range(2))  # two texts show no habit


def test_a_hot_host_loses_a_line_of_a_fixed_number_of_texts(spark):
    rows = [(i, f"{PAGE}\n{own(i)}" if i < 101 else f"rare words\n{own(i)}" if i < 201 else own(i), "hot") for i in range(8000)]
    out = judged(spark, rows)
    assert all(out[i].n_left == 55 and not out[i].kept for i in range(101))
    assert all(out[i].n_left == 57 and out[i].kept for i in range(101, 201)) and all(out[i].kept for i in range(201, 8000))


def test_frequent_lines_match_brute_force(docs, rows):
    texts, count = defaultdict(set), defaultdict(Counter)
    for _, text, _, source in rows:
        if text is not None and text not in texts[source or ""]:
            texts[source or ""].add(text)
            count[source or ""].update({" ".join(x.split()).lower() for x in text.split("\n") if x.strip()})
    want = {h: sum(n > max(2, min(max(0.02 * len(texts[h]), 20), 0.05 * len(texts[h]), 100)) for n in c.values()) for h, c in count.items()}
    got = {r.host: len(r.bad) for r in line_frequency.frequent_lines(docs).collect()}
    assert got == {h: n for h, n in want.items() if n} and len(got) > 15
