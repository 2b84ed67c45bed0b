import math
import random
import re
import statistics

import numpy as np

from tidemark.functions import fixed
from tidemark.functions import images as I
from tidemark.functions import text as X
from tidemark.operators import near as N
from tidemark.plans import registry


def classes(keys, linked):
    group = {k: k for k in keys}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    return {k: root(k) for k in keys}


def far(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def brute(rows):
    """(doc_id, set_id, class_id), and the distances of the links."""
    words = {i: frozenset(w for w in re.findall(fixed.POST_TOKEN, (s or "").lower()) if w not in fixed.POST_STOP and not w.isdigit()) for i, s in rows}
    rep = {}
    for i in sorted(words):
        rep.setdefault(words[i] or i, i)
    fp = {i: X.simhash_bits(sorted(words[i])) for i in rep.values() if words[i]}
    near = [(a, b) for a in fp for b in fp if a < b and far(fp[a], fp[b]) <= 6 and words[a] & words[b]]
    own = classes(words, near + [(rep[w], i) for i, w in words.items() if w])
    return {(i, rep[w or i], own[i]) for i, w in words.items()}, {far(fp[a], fp[b]) for a, b in near}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_near_fingerprints_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(1, None), (2, "the and"), (3, "")]
    for g in range(40):
        own = [f"w{rng.randrange(5000):04d}" for _ in range(120)]
        for _ in range(6):  # variants beyond the 24th word, copies in another order
            k = rng.randrange(30, 120)
            rows += [(len(rows) + 1, " ".join([*own[:k], f"v{g}x{rng.randrange(999)}", *own[k + 1 :]]))]
        rows += [(len(rows) + 1, " ".join(reversed(own))), (len(rows) + 2, " ".join(own))]
    want, distances = brute(rows)
    assert distances >= set(range(7))
    assert found(N.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")) == want


def test_near_fingerprints_of_no_rows(spark):
    assert N.near_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_every_document_has_its_representative(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in registry.t(spark, d, "documents").collect()]
    assert found(registry.QUERIES["simhash_near"](spark, d)) == brute(rows)[0]


def test_chains_and_chance_meetings(spark):
    """Fingerprints in chains of up to the distance, in one large group, and at random: components of brute force."""
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(60):
        x = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randrange(1, 12)):
            x ^= 1 << bit
        fps.append(x)
    group = rng.getrandbits(64)
    fps += [group ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)]
    fps = list(dict.fromkeys(x - (1 << 64) if x >> 63 else x for x in fps))
    df = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    for most in (6, 8):
        got = dict(map(tuple, N.near_classes(df, most).collect()))
        want = classes(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if far(fps[a], fps[b]) <= most])
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_keys_grow_with_the_rows():
    for most in (6, 8):
        sizes = []
        for n in (10**3, 10**5, 10**7, 10**9):
            masks = N.key_masks(n, most)
            bits = [(m & (1 << 64) - 1).bit_count() for m in masks]
            sizes.append(min(bits))
            assert len(masks) <= N.MOST_KEYS and len(masks) * n / 2 ** (sum(bits) / len(bits) + 1) < 40 * n**0.5
            rng = random.Random(n)
            for _ in range(50):
                off = sum(1 << b for b in rng.sample(range(64), most))
                assert any(off & m & (1 << 64) - 1 == 0 for m in masks)
        assert sizes == sorted(sizes) and sizes[-1] > sizes[0]


def test_images_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["image_near"](spark, d).collect()
    rows = {r.vec_id: r.phash for r in got}
    want = classes(rows, [(a, b) for a in rows for b in rows if a < b and far(rows[a], rows[b]) <= 8])
    assert {r.vec_id: r.class_id for r in got} == want and len(rows) == 500
    pixels = {r.vec_id: r.embedding for r in registry.t(spark, d, "embeddings").collect()}
    for i in list(rows)[:20]:  # the transform written out
        grid = [pixels[i][8 * y : 8 * y + 8] for y in range(8)]
        wave = lambda u, x: math.cos(math.pi * u * (2 * x + 1) / 16)
        low = [sum(grid[y][x] * wave(u, y) * wave(v, x) for y in range(8) for x in range(8)) for u in range(8) for v in range(8)]
        bits = "".join("1" if c > statistics.median(low[1:]) else "0" for c in low)
        assert int(bits, 2) == rows[i] & (1 << 64) - 1


def test_views_survive_crops_and_odd_images(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:120, 0:160]
    image = np.sin(x / 17) * 50 + np.cos(y / 23 + x / 31) * 70 + rng.normal(0, 1, (120, 160)) + 100
    flat = lambda g: [float(v) for v in g.reshape(-1)]
    rows = [(0, flat(image), 160), (1, flat(image[12:108, 16:144]), 128), (2, flat(image[:6, :6]), 6), (3, [1.0, None], 2), (4, [1.0], 2), (5, None, 3), (6, [], 0)]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, p array<double>, w int").select("i", I.view_hashes("p", "w").alias("h")).collect()}
    assert set(got[0]) == {"full", "center", "center60", "top87", "square"} and got[0]["center"] == got[1]["full"]
    assert got[0]["full"] != got[1]["full"] and list(got[2]) == ["full"] and [got[i] for i in (3, 4, 5, 6)] == [None] * 4
    two = spark.createDataFrame([(1, flat(image[:8, :8])), (2, None), (3, [0.0] * 63), (4, flat(image[:8, :8] + 1)), (4, [float("nan")] * 64)], "k long, p array<double>")
    assert sorted(tuple(r)[::2] for r in N.near_images(two, "k", "p", 8).collect()) == [(1, 1), (2, 2), (3, 3), (4, 1), (4, 4)]


def test_fingerprints_are_exact_beside_nulls(spark):
    df = spark.createDataFrame([([],), (["alpha", "beta", "gamma"],)], "x array<string>").coalesce(1)
    assert [r[0] for r in df.select(X.simhash("x")).collect()] == [None, X.simhash_bits(["alpha", "beta", "gamma"])]
