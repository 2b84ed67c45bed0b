"""Large and null keys, rows that repeat a key, names that clash, bounds of samples, hard pages, mid-size groups."""

import io
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bit_packing, decontamination, html_extraction, jaccard_join, language_id, line_frequency, packing, sharding, toxicity, training, warc

BPE, WORD_BPE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Neighbours that doubles can't tell apart, and the ends of the range.
IDS = [2**60 + i for i in range(1, 6)] + [2**53 + 1, 2**53 + 2, 2**63 - 1, -(2**63), 2**61, 2**62 + 5, None, None]
KIND = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def large(spark):
    return spark.createDataFrame([(i, f"text number {k} of a few words", "en", "s") for k, i in enumerate(IDS)], KIND).coalesce(1)


def test_every_operator_returns_the_keys_it_got(spark, large):
    want = Counter(IDS)
    model = language_id.train(["one two", "un deux"], ["en", "fr"])
    tox = toxicity.train(["bad bad", "good"], [1, 0])
    bench = spark.createDataFrame([(1, "never there at all")], "item_id long, text string")
    outs = {
        "1": sharding.assign_shards(large, 3), "2": decontamination.score_contamination(large, bench), "3": line_frequency.judge_documents(large), "4": toxicity.score_toxicity(large, tox), "6": packing.pack_documents(large, BPE),
        "7": jaccard_join.near_classes(large), "8": language_id.identify(large, model), "10": bit_packing.round_trip(large, WORD_BPE),
        "5": html_extraction.extract_pages(large.selectExpr("doc_id AS page_id", "source AS url", "text AS html")).withColumnRenamed("page_id", "doc_id"),
        "9": warc.archive_round_trip(large.selectExpr("doc_id AS page_id", "source AS url", "repeat(text, 9) AS html")).withColumnRenamed("page_id", "doc_id"),
    }
    for n, out in outs.items():
        assert Counter(r.doc_id for r in out.select("doc_id").distinct().collect() if r.doc_id is not None) == Counter(i for i in set(IDS) if i is not None), n
        assert n == "6" or Counter(r.doc_id for r in out.select("doc_id").collect()) == want, n
    starts = [(r.start, r.doc_id) for r in outs["10"].collect()]
    assert [i for _, i in sorted(starts, key=lambda x: x[0])] == sorted(IDS, key=lambda i: (i is not None, i or 0))


def test_record_ids_hold_all_64_bits():
    for n in (0, 1, -1, 2**61, -(2**61), 2**62 + 5, 2**63 - 1, -(2**63)):
        assert warc.row_of(f"<{warc.record_id(n)}>") == n


def test_archives_refer_to_large_keys_by_either_join(spark):
    body = "<p>" + "w" * 200
    pages = [(2**62 + 5, "u", body), (2**62 + 6, "u", body), (2**62 + 6, "u", body + "other"), (7, "v", "tiny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (10, 0):
        folder = warc.new_folder(spark, "archives")
        out = warc.read_archives(warc.write_archives(df, folder, broadcast_digests=most))
        assert sorted((r.row, r.record_type, r.refers_to or 0) for r in out.collect()) == [(7, "response", 0), (2**62 + 5, "response", 0), (2**62 + 6, "response", 0), (2**62 + 6, "revisit", 2**62 + 5)]


def test_arc_files_are_read_and_converted(spark, tmp_path):
    import gzip

    rec = [(f"http://h/{i}", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * i) for i in range(50)]
    (tmp_path / "a.arc").write_bytes(warc.arc_file(1, rec))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(warc.arc_file(2, rec)))
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = warc.read_arc_files(spark, str(tmp_path)).collect()
    assert Counter((r.url, bytes(r.block)) for r in got) == Counter({(u, b): 2 for u, _, _, _, b in rec})
    out = warc.convert_arc_files(spark, str(tmp_path)).collect()
    read = [next(warc.read_warc(io.BytesIO(bytes(r.warc)))) for r in out]
    assert len(read) == 100 and {h["warc-type"] for h, _ in read} == {"response"} and sorted(b for _, b in read) == sorted(2 * [r[-1] for r in rec])


def test_groups_of_middle_size_stay_whole_and_spread_over_tasks(spark):
    """At 16 rows a bucket, groups of 3 rows and more are placed by their sums, under a large group's share each."""
    rng = random.Random(2)
    texts = [f"group {g} " + "x" * rng.randrange(200) for g in range(1500) for _ in range(rng.choice([1, 1, 2, 4, 5]))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = sharding.assign_shards(df, 2, 16).collect()
    assert Counter(r.doc_id for r in out) == Counter(range(len(texts)))
    where, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        where[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert all(len(x) == 1 for x in where.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_stages_keep_columns_whose_names_clash(spark):
    own = ["_h", "_g", "_bad", "_host", "_left", "_w", "_k", "_t", "row", "x", "w", "left", "bad", "host", "good", "rep", "k", "t", "hits", "items", "id", "g", "doc", "component"]
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "s"), (2, "b " + text, "en", "s"), (3, "short", "en", None)], KIND)
    df = df.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in own})
    bench = spark.createDataFrame([(9, "short")], "item_id long, text string")
    model = language_id.train(["word1 word2", "mot"], ["en", "fr"])
    for out, ids in ((line_frequency.clean_documents(df), [1, 2]), (decontamination.decontaminate(df, bench), [1, 2]), (decontamination.decontaminate(df, bench, max_share=0.5), [1, 2]), (language_id.keep_identified(df, model, 0.0), [1, 2, 3]), (jaccard_join.keep_first(df), [1, 3])):
        assert out.columns == df.columns
        assert sorted(out.collect()) == sorted(df.where(F.col("doc_id").isin(ids)).collect())


def test_keep_first_with_repeated_and_null_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    rows = [(5, a), (5, a), (5, near), (7, near), (None, a), (None, b), (None, b), (None, b + " more"), (8, None), (8, None), (8, " \n"), (9, c), (9, c)]
    df = spark.createDataFrame([(*r, "en", "s") for r in rows], KIND)
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard_join.keep_first(df).collect())
    blank = [x for x in got if x[0] == 8]
    assert blank == [(8, ""), (8, ""), (8, " \n")]
    rest = [x for x in got if x[0] != 8]
    assert [i for i, _ in rest] == [0, 5, 9] and rest[0][1].startswith(b) and rest[1][1] in (a, near) and rest[2][1] == c
    assert rest == sorted((r.doc_id or 0, r.text) for r in jaccard_join.keep_first(df.repartition(3)).collect() if r.doc_id != 8)
    out = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_classes(df).collect())
    assert out[5, 36, 5] == 2 and out[None, 36, 5] == 1 and out[None, 36, None] == 2 and out[8, 0, 8] == 3


def test_null_and_empty_hosts_are_hosts_of_their_own(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"same line\n{good} {i}", "en", None if i < 2 else "") for i in range(4)]
    assert line_frequency.frequent_lines(spark.createDataFrame(rows, KIND)).count() == 0
    rows += [(9, f"same line\n{good} 9", "en", None)]
    assert [r.host for r in line_frequency.frequent_lines(spark.createDataFrame(rows, KIND)).collect()] == [None]


def test_copies_count_as_documents_unless_told_otherwise(spark, monkeypatch):
    good = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, good, "en", "s") for i in range(50)] + [(99, "own " + good, "en", "s"), (99, "own " + good, "en", "s")], KIND)
    for lines in (1_000_000, 0):  # broadcast, and by a shuffle of the lines' hashes
        monkeypatch.setattr(line_frequency, "BROADCAST_LINES", lines)
        out = [(r.doc_id, r.n_left, r.kept) for r in line_frequency.judge_documents(df, copies_once=False).collect()]
        assert sorted(out) == [(i, 0, False) for i in range(50)] + 2 * [(99, 61, True)]
        assert all(r.kept for r in line_frequency.judge_documents(df).collect())


def test_samples_keep_their_bounds(spark):
    one = spark.range(20_000).selectExpr("IF(id < 19900, 7, id) AS doc_id", "IF(id < 19900, 'the same text', concat('t', id)) AS text", "IF(id % 2000 = 1, 'rare', 'common') AS label")
    got = training.sample(one, 60, 1 << 20).collect()
    assert len(got) <= 60 and {r.label for r in got} == {"rare", "common"} and len({r.text for r in got}) > 30
    many = spark.range(20_000).selectExpr("7L AS doc_id", "concat('text ', id) AS text", "'x' AS label")
    assert 90 <= training.sample(many, 100, 1 << 20).count() <= 100
    long = spark.range(500).selectExpr("id AS doc_id", "repeat('abcdefgh ', 1000) || id AS text", "'x' AS label")
    held = [len(r.text) for r in training.sample(long, 100, 100_000).collect()]
    assert 8 <= len(held) <= 12 and sum(held) <= 100_000
    assert training.sample(long, 100, 10).count() == 1


def test_language_model_memory_and_letters():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(700)) for _ in range(600)]
    tracemalloc.start()
    language_id.train(texts, ["a" if i % 2 else "b" for i in range(600)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, texts))
    model = language_id.train(["one two", "un deux"], ["en", "fr"])
    assert model.predict(__import__("pyarrow").array(["½ ² ① 12", "é", None]))[0][::2] == ["und", "und"]


def test_ftrl_matches_plain_steps():
    """The update, written out one weight at a time."""
    rng = np.random.default_rng(4)
    x = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3)) for _ in range(12)]
    y = rng.integers(0, 3, 12)
    got = language_id.ftrl(x, y, 6, 3, epochs=2, seed=5)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        if abs(z[i, c]) <= 0.05:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * 0.05) / ((1.0 + n[i, c] ** 0.5) / 0.5 + 0.05)

    order = np.random.default_rng(5)
    for _ in range(2):
        for r in order.permutation(12):
            w = {(i, c): weight(i, c) for i in x[r][0] for c in range(3)}
            s = np.exp([sum(w[i, c] * v for i, v in zip(*x[r], strict=True)) for c in range(3)])
            p = s / s.sum()
            for i, v in zip(*x[r], strict=True):
                for c in range(3):
                    g = (p[c] - (c == y[r])) * v
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / 0.5 * w[i, c]
                    n[i, c] += g * g
    assert np.allclose(got, [[weight(i, c) for c in range(3)] for i in range(6)])


def test_toxicity_evidence_matches_brute_force():
    """Signed scores: the best segments of all tokens' scores, clean-leaning ones included."""
    import pyarrow as pa

    model = toxicity.Model({"bad": 3.0, "worse": 2.0, "nice": -1.5}, drift=0.25, scale=1.0, log_k=-1.0)
    text = "so bad nice worse and x y z nice nice nice bad bad nice"
    flat = [model.token(w) for w in text.split()]
    assert flat[:4] == [-0.25, 3.0, -1.75, 2.0]

    def best(lo, hi):
        if lo >= hi:
            return []
        top = max(((sum(flat[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), key=lambda x: (round(x[0], 9), -(x[2] - x[1])))
        return [] if top[0] <= 1e-9 else best(lo, top[1]) + [top] + best(top[2], hi)

    base = -1.0 + np.log(len(flat))
    want = [(a, b - 1, s - base) for s, a, b in best(0, len(flat)) if s > base]
    total, found = model.evidence(pa.array([text]))
    assert [(a, b) for a, b, _ in found[0]] == [(a, b) for a, b, _ in want] and np.isclose(total[0], sum(e for *_, e in want))


def test_segments_take_linear_time():
    rng = np.random.default_rng(0)
    n = 1_000_000
    began = time.time()
    got = toxicity.maximal_segments(rng.uniform(0.1, 3, n).tolist(), rng.uniform(0, 4, n).tolist())
    assert time.time() - began < 30 and len(got) > 1000


def test_density_matches_brute_force():
    """The measure itself, by recursion over the tree."""
    import math

    source = "<body><nav><a>n</a></nav><div><h1>Head</h1><p>one two <a>link</a> three</p><p>four <b>five</b></p></div><ul><li><a>a</a></li><li><a>b</a></li></ul></body>"
    root = html_extraction.parse(source)
    nodes = html_extraction.measure(root)

    def count(x):
        kids = [count(k) for k in x.kids if isinstance(k, html_extraction.Node) and not k.aside]
        chars = sum(len(" ".join(k.split())) for k in x.kids if isinstance(k, str)) + sum(k[0] for k in kids)
        tags, linked, links = sum(k[1] + 1 for k in kids), sum(k[2] for k in kids), sum(k[3] for k in kids)
        return (chars, tags, chars, links + 1) if x.tag == "a" else (chars, tags, linked, links)

    whole = count(root)
    for x in nodes:
        c, t, lc, lt = count(x)
        want = 0.0
        if lc < c:
            base = math.log(c / (c - lc) * lc + whole[2] / whole[0] * c + math.e)
            want = max(c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0), 0.0)
        assert math.isclose(x.density, want, rel_tol=1e-12, abs_tol=1e-12)


P = "<p>" + "word " * 40 + "</p>"


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<form><article><h1>T</h1>{P}{P}</article></form>", 3), (f'<div class="no-sidebar"><article>{P}</article></div>', 1), (f'<div class="with-header">{P}{P}</div>', 2), (f'<div class="layout sidebar"><main><h1>a</h1>{P}</main></div><nav>x</nav>', 2),
        (f'<article>{P}</article><div class="comments">{P * 5}</div><form>say <textarea>x</textarea></form>', 1),
    ],
)
def test_wrappers_are_not_asides(source, want):
    assert len(html_extraction.extract(source).split("\n")) == want


def test_broken_marks():
    x = html_extraction.extract
    assert x(f"<article>{P}<p>so <math><mi>x</mi></math> is</p></article>").endswith("so x is")
    assert x('<div><p class="x>one two three</p><p>four</p></div>') == "one two three\nfour"
    assert x("<p>a < b and c > d</p>") == "a < b and c > d" and x("<p it's>x</p><p>it's</p>") == "x\nit's"
    assert x('<p title="a > b">text</p>') == "text" and x("<!-- open <p>gone</p>") == ""


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "<p>deep</p>", '<p class="x ' * 850_000, '<a b="' * 1_600_000, "</foo>" * 1_600_000, "<b>" * 100_000 + "<p>x</p>" * 100_000, "<" * 1_000_000, "<!--" * 2_000_000])
def test_hard_pages_end_in_seconds(source):
    began = time.time()
    html_extraction.extract(source)
    assert time.time() - began < 40


def test_article_tags_change_nothing_on_the_given_pages():
    import re

    import pyarrow.parquet as pq

    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    for source in pages:
        assert html_extraction.extract(source) == html_extraction.extract(re.sub(r"</?article[^>]*>", "", source)) != ""


def test_benchmark_in_rounds(spark, monkeypatch):
    """More n-grams, or longer lists of ids, than a broadcast may hold."""
    monkeypatch.setattr(decontamination, "ITEMS_A_ROW", 2)
    bench = spark.createDataFrame([(i, "one two three four") for i in range(7)] + [(50 + i, f"w{i} x{i}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say one TWO three four w3 x3"), (2, "one two three"), (3, "w9, x9 w9")], "doc_id long, text string")
    for most in (1_000_000, 4):
        got = sorted((r.doc_id, r.n_hit, r.n_items) for r in decontamination.score_contamination(docs, bench, broadcast_grams=most).collect())
        assert got == [(1, 6, 8), (2, 0, 0), (3, 2, 1)]
