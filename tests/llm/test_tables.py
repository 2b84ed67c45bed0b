"""Each operator against a brute-force version, on a whole small table and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bit_packing, decontamination, jaccard_join, line_frequency, packing, sharding, toxicity, language_id, warc

from .conftest import ODD, SF


def by_id(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# 1 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    src = [(r.doc_id, r.text or "") for r in df.collect()]
    out = sharding.assign_shards(df, 24, 512).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in src)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    if which == "docs":
        sizes = Counter()
        for r in out:
            sizes[r.shard] += r["size"]
        mean = sum(sizes.values()) / 24
        print(sorted(round(x / mean, 3) for x in sizes.values()))
        assert max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
        where = defaultdict(set)
        text = dict(src)
        for r in out:
            where[text[r.doc_id]].add(r.shard)
        assert all(len(s) == 1 for t, s in where.items())


def test_sharding_splits_a_hot_group(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot hot hot' ELSE concat('t', id) END AS text")
    sizes = Counter()
    for r in sharding.assign_shards(df, 24, 1000).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) < 1.1 * min(sizes.values())


# 2 ---------------------------------------------------------------------------------------------------------------
def doc_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(src, items, n=10):
    index = defaultdict(set)
    for i, t in items:
        w = doc_words(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            index[tuple(w[a : a + n])].add(str(i))
    lengths = {len(g) for g in index}
    out = []
    for i, t in src:
        w, hit, found = doc_words(t), set(), set()
        for k in lengths:
            for a in range(len(w) - k + 1):
                if own := index.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_contamination(spark, docs, rows):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = by_id(decontamination.score_contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_contamination([r[:2] for r in rows], [tuple(r) for r in bench.collect()])
    assert got == want and sum(r[5] for r in want) > 10


@pytest.mark.parametrize("bound", [1_000_000, 1])
def test_contamination_of_odd_rows(spark, odd, none, bound):
    items = [(1, "ONE two"), (2, "b c d e f g h i j k l"), (3, None), (4, "  "), (5, "one, two"), (12, "word " * 12), (10, "word " * 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.score_contamination(odd, bench, broadcast_grams=bound), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute_contamination([r[:2] for r in ODD], items)
    assert decontamination.score_contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.score_contamination(odd, bench.limit(0)).collect())
    kept = {r.doc_id for r in decontamination.decontaminate(odd, bench).collect()}
    assert kept == {1, 2, 3, 7, 8, 10, 11, 12}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, bench, max_share=0.9).collect()}
    assert cut[4] == "three" and cut[6] == "a m n o p" and 9 not in cut and cut[1] is None


# 3 ---------------------------------------------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_statistics(request, which):
    df = request.getfixturevalue(which)
    got = by_id(line_frequency.judge_documents(df), "doc_id", *BASE)
    assert got == sorted((r.doc_id, *brute_base(r.text)) for r in df.collect())


def test_frequent_lines(spark, none):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"Shared  LINE here\n{good} {i}", "a") for i in range(40)]
    rows += [(100 + i, "shared line here\n" * 1 + " ".join(f"x{k}" for k in range(20)) + "\n" + " ".join(f"rare{i}_{k}" for k in range(35)), "b") for i in range(30)]
    rows += [(200 + i, f"copy {good}", "a") for i in range(50)]  # copies are one text
    rows += [(300, "only once " + good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in line_frequency.judge_documents(df).collect()}
    assert all(out[i].kept and out[i].n_left == 61 for i in range(40)) and all(out[i].kept for i in (200, 300))
    assert out[100].n_left == 35 and out[100].kept
    strict = {r.doc_id: r.kept for r in line_frequency.judge_documents(df, min_left=0.7).collect()}
    assert not strict[100] and strict[0]
    text = {r.doc_id: r.text for r in line_frequency.clean_documents(df).collect()}
    assert text[0] == f"{good} 0" and text[300] == rows[-1][1]
    assert line_frequency.judge_documents(none).count() == 0 and line_frequency.clean_documents(none).count() == 0


def test_cleaned_documents_are_those_kept(docs):
    kept = {r.doc_id for r in line_frequency.judge_documents(docs).where("kept").select("doc_id").collect()}
    got = line_frequency.clean_documents(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(kept)


# 4, 8 ------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_model(docs, labels)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert out.score.between(0, 1).all()
    hit = out[out.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.9 and (out[out.toxic == 1].predicted == 1).mean() > 0.7
    assert all(len(p) > 0 for p in hit.passages)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit_model(odd, labels)
    out = toxicity.score_toxicity(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(none, toxicity.fit_model(none, labels.limit(0))).count() == 0


def test_segments_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        k = int(rng.integers(1, 9))
        scores, gaps = rng.uniform(0.1, 3, k).round(3).tolist(), [0.0, *rng.uniform(0, 3, k - 1).round(3).tolist()]
        flat = []
        for s, g in zip(scores, gaps, strict=True):
            flat += [-g, s]

        def best(lo, hi):  # the definition: take the best segment, then search on either side of it
            if lo >= hi:
                return []
            top = max(((sum(flat[a:b]), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), key=lambda x: (round(x[0], 9), -(x[2] + x[1])))
            if top[0] <= 1e-9:
                return []
            a, b = -top[1], top[2]
            return best(lo, a) + [(a, b, round(top[0], 6))] + best(b, hi)

        got = [(2 * a + 1, 2 * b + 2, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores, gaps)]
        assert got == best(0, len(flat))


def test_language_held_out(spark, docs, odd, none):
    model = language_id.fit_model(docs)
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.97 and out.score.between(0, 1).all()
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 10)) and got[4][0] != "und"
    assert language_id.identify(none, model).count() == 0 and language_id.fit_model(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    kept = {r.doc_id for r in language_id.keep_identified(odd, model, 0.0).collect()}
    assert kept == {4, 5, 6, 7, 8, 9, 11, 12}


# 6, 10 -----------------------------------------------------------------------------------------------------------
def encoded(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which).dropDuplicates(["doc_id"])
    out = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    src = df.collect()
    ids = dict(zip((r.doc_id for r in src), encoded("byte_bpe_50k.json", (r.text for r in src)), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, own in pieces.items():
        at = 0
        for s, n in sorted(own):
            assert s == at and n > 0
            at += n
        assert at == len(ids[d])
    assert set(pieces) == set(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_bit_packing(request, which):
    df = request.getfixturevalue(which)
    out = bit_packing.round_trip(df, public_tokenizers.path("word_bpe_49k.json")).collect()
    src = sorted((r.doc_id, r.text or "") for r in df.collect())
    want, at = [], 0
    for (d, _), x in zip(src, encoded("word_bpe_49k.json", [t for _, t in src]), strict=True):
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in out) == sorted(want)


def test_bits_and_files(tmp_path):
    rng = np.random.default_rng(1)
    for bits in (1, 7, 15, 16, 17, 32):
        ids = rng.integers(0, 1 << bits, 3001, dtype=np.uint64).astype("<u4")
        assert (bit_packing.unpack_bits(bit_packing.pack_bits(ids, bits), bits, len(ids)) == ids).all()
        offs = np.array([0, 0, 5, 1000, 3000, 3001])
        (tmp_path / "f").write_bytes(b"".join(bit_packing.encode_file(ids, offs, bits, 64)))
        with open(tmp_path / "f", "rb") as f:
            r = bit_packing.Reader(f)
            assert all((r.document(i) == ids[offs[i] : offs[i + 1]]).all() for i in range(5))
    with pytest.raises(ValueError):
        list(bit_packing.encode_file(np.array([8], "<u4"), np.array([0, 1]), 3))


def test_empty_tables(none):
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bit_packing.round_trip(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert sharding.assign_shards(none).count() == 0
    assert jaccard_join.near_classes(none).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------
def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_classes(src):
    sets, root = [(i, shingles(t)) for i, t in src], {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            index[g].append(k)
    seen = {(a, b) for own in index.values() for x, a in enumerate(own) for b in own[x + 1 :]}
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        if 100 * len(s & t) >= 75 * len(s | t):
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_near_classes(docs, rows):
    got = by_id(jaccard_join.near_classes(docs), "doc_id", "n_shingles", "component_id")
    want = brute_classes([r[:2] for r in rows])
    assert got == want and sum(i != c for i, _, c in want) > 30


def test_near_classes_of_odd_rows(odd):
    assert by_id(jaccard_join.near_classes(odd), "doc_id", "n_shingles", "component_id") == brute_classes([r[:2] for r in ODD])


def test_near_classes_of_hot_groups(spark, monkeypatch):
    """Chains of near copies, a passage shared by unlike short texts, and many frequent tokens."""
    monkeypatch.setattr(jaccard_join, "PART", 1)
    rng = np.random.default_rng(5)
    vocab = [f"v{i}" for i in range(500)]
    base = rng.choice(vocab, 80).tolist()
    passage = rng.choice(vocab, 30).tolist()
    src = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 80, int(rng.integers(0, 4))):
            w[k] = f"e{i}"
        src.append((i, " ".join(w)))
    for i in range(150, 300):
        src.append((i, " ".join(passage + rng.choice(vocab, int(rng.integers(3, 14))).tolist())))
    for i in range(300, 340):
        src.append((i, " ".join(base[: 60 + i % 20])))
    got = by_id(jaccard_join.near_classes(spark.createDataFrame(src, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == brute_classes(src)


@pytest.mark.parametrize("common", [1, 60, 151])
def test_signatures_of_linked_sets_meet(common):
    """Linked sets share a key, on both sides of the size up to which combinations are used; and where they share a
    token's place, the room that it leaves is no less than their overlap."""
    rng = np.random.default_rng(9)
    order = jaccard_join.Order(np.sort(rng.choice(1200, 150, replace=False).astype(np.uint64)), rng.permutation(150) + 1, common)
    linked = 0
    for _ in range(600):
        a = np.sort(rng.choice(1200, int(rng.integers(2, 60) if rng.random() < 0.6 else rng.integers(120, 240)), replace=False).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) - int(rng.integers(0, len(a) // 7 + 1)), replace=False), rng.choice(1200, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and len(b) > 1 and not np.array_equal(a, b):
            linked += 1
            (x, _, p), (y, _, q) = jaccard_join.signatures(a, order, 75), jaccard_join.signatures(b, order, 75)
            assert len(np.intersect1d(x, y)) or len(np.intersect1d(p, q))
            _, i, j = np.intersect1d(x, y, return_indices=True)
            assert (np.minimum(i, j) + np.minimum(len(a) - i, len(b) - j) >= both).all()
    assert linked > 300


# 9 ---------------------------------------------------------------------------------------------------------------
def test_archives(spark):
    pages = [(i, f"http://h/{i} x", ("<p>" + "é" * 60 + str(i % 7)) if i % 3 else ("tiny" if i % 2 else None)) for i in range(40, 0, -1)] + [(None, None, "<b>" + "n" * 200), (99, "", "")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload_bytes string")
    got = sorted((tuple(r) for r in warc.archive_round_trip(df).collect()), key=str)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        ref = first.get(h) if i is not None and len(b) >= 100 else None
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if ref not in (None, i) else "response", ref if ref != i else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_arc_versions():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload\nwith lines"
    rec = [("http://h/a b", "1.2.3.4", "20200102030405", "text/html", body), ("dns:x", "-", "2001", "text/dns", b"x")]
    for v in (1, 2):
        got = list(warc.parse_arc(warc.arc_file(v, rec)))
        assert [(r.ip, r.date, r.type, r.block) for r in got] == [r[1:] for r in rec]
        data = b"".join(map(warc.convert, got))
        import io

        (h, block), (h2, _) = warc.read_warc(io.BytesIO(data))
        assert block == body and h["warc-type"] == "response" and h["warc-date"] == "2020-01-02T03:04:05Z" and h2["warc-type"] == "resource"
    for bad in (b"nonsense\n", warc.arc_file(1, rec)[:-20]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))
    for n in (0, 1, -5, (1 << 61) - 1):
        assert warc.row_of(f"<{warc.record_id(n)}>") == n
