"""corpus_pipeline.run on a small table with null, empty and repeated rows, and on odd and empty tables."""

from collections import Counter, defaultdict

import corpus_pipeline

from .conftest import ODD, SMALL
from .test_tables import brute_base, brute_contamination

KIND = "doc_id long, text string, lang string, source string"


def brute_quality(rows):
    """(doc_id, text) of what the quality stage keeps."""
    texts, count = defaultdict(set), defaultdict(Counter)
    norm = lambda x: " ".join(x.split()).lower()
    for _, text, _, host in rows:
        if text is not None and text not in texts[host]:
            texts[host].add(text)
            count[host].update({norm(x) for x in text.split("\n") if x.strip()})
    out = []
    for i, text, _, host in rows:
        limit = max(2, min(max(0.02 * len(texts[host]), 20), 0.05 * len(texts[host]), 100))
        left = None if text is None else "\n".join(x for x in text.split("\n") if not x.strip() or count[host][norm(x)] <= limit)
        n = len((text or "").split())
        if not brute_base(text)[-1] and len((left or "").split()) >= 0.5 * n:
            out.append((i, left))
    return sorted(out)


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_run_and_its_stages(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(10_001, None, None, None), (10_002, "", "en", "src0"), *rows[:20]]
    line = " ".join(f"site{k}" for k in range(9))
    rows += [(20_000 + i, f"{line}\n" + " ".join(f"own{i}x{k}" for k in range(60)), "en", "new") for i in range(5)]
    d = folder(spark, tmp_path, rows)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        kept[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert kept["quality"] == brute_quality(rows) and all(line not in t for _, t in kept["quality"])
    assert not Counter(kept["language"]) - Counter(kept["quality"]) and not Counter(kept["near_copies"]) - Counter(kept["language"])
    assert len(kept["leaks"]) > 50 and {t for _, t in kept["near_copies"]} <= {t for _, t in kept["language"]}
    assert len({t for _, t in kept["near_copies"]}) == len(set(kept["near_copies"]))
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_contamination(kept["near_copies"], items) if not r[-1]}
    assert kept["leaks"] == [x for x in kept["near_copies"] if x[0] in clean]

    pieces = corpus_pipeline.run(spark, d).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in kept["leaks"]}
    want = {p.doc_id: p.doc_tokens for p in pieces}
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    ids = Counter(i for i, _ in kept["leaks"])
    assert all(got[i] == want[i] * n for i, n in ids.items()) and all(p.offset + p.length <= p.sequence_tokens <= 2048 for p in pieces)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    odd = folder(spark, tmp_path / "odd", [r[:4] for r in ODD])
    assert corpus_pipeline.run(spark, odd).count() == 0  # none has fifty words of which half are new
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [])).count() == 0
