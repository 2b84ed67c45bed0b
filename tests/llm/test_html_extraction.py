"""op5 against a brute-force choice of subtrees, on pages with none, one and several articles, odd and empty tables."""

import random

from tidemark.llm import html_extraction as H


def para(rng, n):
    return " ".join(f"w{rng.randrange(10**6):06d}" for _ in range(n))


def brute(source):
    """The definition, by recursion: the subtree of the greatest sum, its article, and what is dense beside its path."""
    root = H.parse(source)
    nodes = H.measure(root)
    best = max(nodes, key=lambda x: x.sum)
    best = best if best.sum > 0 else root
    up = lambda x: [] if x is None else [x, *up(x.parent)]
    limit = max(min(x.density for x in up(best)), 1e-9)
    best = next(x for x in up(best) if x.tag in H.BLOCK)
    best = ([x for x in up(best) if x.tag == "article"] or [best])[0]
    on = set(map(id, up(best)))
    for x in nodes:  # names with a subject of their own go only where they are thin, or links
        if x.weak and id(x) not in on:
            x.aside = x.density < limit if x.tag in H.BLOCK else bool(x.link_chars)
    below = lambda x: [x, *(z for k in x.kids if isinstance(k, H.Node) and not k.aside for z in below(k))]
    good = lambda x: x.tag in H.BLOCK and x.density >= limit

    def pick(x):
        on = any(x is y for y in up(best))
        if x is best or not on and (good(x) or x.tag == "article" and any(map(good, below(x)))):
            return [x]
        return [] if not on and x.tag == "article" else [z for k in x.kids if isinstance(k, H.Node) and not k.aside for z in pick(k)]

    return "\n".join(H.blocks(pick(root)))


def page(rng, articles):
    part = lambda: "".join(f"<p>{para(rng, rng.randrange(3, 40))}</p>" for _ in range(rng.randrange(1, 5)))
    links = lambda: "<ul>" + "".join(f"<li><a href=/{i}>{para(rng, 2)}</a></li>" for i in range(rng.randrange(2, 9))) + "</ul>"
    parts = [f"<article><h2>{para(rng, 3)}</h2>{part()}</article>" for _ in range(articles)] + [f"<div>{part()}</div>", f"<div class='{rng.choice(['share-price', 'social-history', 'tags', 'related-posts'])}'>{part()}</div>", f"<p class=promo-code><a href=/>{para(rng, 5)}</a></p>", f"<section>{links()}{part()}</section>", links()]
    rng.shuffle(parts)
    return f"<html><body><nav>{links()}</nav><main>{''.join(parts)}</main><footer>{para(rng, 9)}</footer></body></html>"


def test_pages_match_brute_force():
    rng = random.Random(7)
    for k in range(120):
        source = page(rng, k % 4)
        assert H.extract(source) == brute(source) != ""


def test_text_in_several_articles_and_beside_one_is_kept():
    rng = random.Random(1)
    a, b, c, e, f, g = (para(rng, n) for n in (60, 55, 50, 40, 45, 50))
    nav = "<ul>" + "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(12)) + "</ul>"
    first, second = f"<article><p>{a}</p><p>{b}</p><p>{c}</p><p>short</p></article>", f"<article><p>{e}</p><p>{f}</p><p>tail</p></article>"
    assert H.extract(f"<body>{nav}{first}{second}</body>") == "\n".join([a, b, c, "short", e, f, "tail"])
    assert H.extract(f"<body>{nav}<main>{first}<p>{e}</p><div><p>{g}</p></div></main></body>") == "\n".join([a, b, c, "short", e, g])
    assert H.extract(f"<body>{nav}{first}</body>") == "\n".join([a, b, c, "short"])
    assert H.extract(f"<body>{nav}<div><p>{a}</p><p>{b}</p></div></body>") == f"{a}\n{b}"


def test_a_name_with_its_own_subject_removes_only_what_is_thin():
    rng = random.Random(4)
    a, b, c, d = (para(rng, n) for n in (60, 50, 40, 30))
    links = "".join(f"<a href=/{i}>go {i}</a> " for i in range(9))
    for name in ("class='share-price'", "id=social-history", "class=promo-code-review", "class='x relatedWork'"):
        assert H.extract(f"<body><article><h1>t</h1><p>{a}</p><div {name}><p>{b}</p></div><p>{c}</p></article></body>") == "\n".join(["t", a, b, c])
        assert H.extract(f"<body><article><h1>t</h1><p>{a}</p><div {name}>{links}</div><p>{c}</p></article></body>") == "\n".join(["t", a, c])
        assert H.extract(f"<body><article><p>{a} <span {name}>five</span> left</p><p>{c}</p></article></body>") == f"{a} five left\n{c}"
    for name in ("class=comments", "class='comment-list'", "id=related-posts", "class=share-buttons", "class='site-header'", "class='adBox2'", "id=newsletter_form"):
        assert H.extract(f"<body><article><p>{a}</p><div {name}><p>{d}</p></div><p>{c}</p></article></body>") == f"{a}\n{c}"


def test_white_space_folds_and_zero_width_characters_stay():
    assert H.extract("<p>foo\u200bbar \ufeffx\u00a0 \n\ty&#8203;z&nbsp; </p>") == "foo\u200bbar \ufeffx y\u200bz"


def test_deep_pages():
    assert H.extract("<div>" * 5000 + "<p>deep words here</p>") == "deep words here"


def test_odd_and_empty_tables(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<p>text"), (3, "w", "plain"), (4, "x", "<nav><p>only aside</p></nav>"), (5, "y", "\x00<br>")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, extra int")
    out = sorted(map(str, H.extract_pages(df).collect()))
    want = ["", "", "", "text", "plain", "", ""]
    assert out == sorted(str(r) for r in spark.createDataFrame([(i, u, t, len(t)) for (i, u, _), t in zip(rows, want, strict=True)], "page_id long, url string, text string, n_chars long").collect())
    assert H.extract_pages(df.limit(0)).collect() == []
