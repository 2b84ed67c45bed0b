"""Post envelopes: text, links and canonical object URLs. Built-in functions; Python where Spark has no such function
(NFKD, URL quoting, character references, JSON of any depth)."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

#: An object of a platform: hosts, what its path looks like, and its canonical form. For ``?v=`` the query names it.
OBJECTS = [
    ({"x.com"}, re.compile(r"/status/(\d+)"), "x.com/status/{0}"), ({"tiktok.com", "vm.tiktok.com"}, re.compile(r"/video/(\d+)"), "tiktok.com/video/{0}"), ({"youtu.be"}, re.compile(r"^/+([^/]+)"), "youtube.com/video/{0}"),
    ({"youtube.com"}, re.compile(r"^/shorts/([^/]+)"), "youtube.com/video/{0}"), ({"reddit.com"}, re.compile(r"/comments/([a-z0-9]+)", re.I), "reddit.com/comments/{0}"), ({"instagram.com"}, re.compile(r"/(p|reel|reels)/([^/?#]+)", re.I), "instagram.com/{0}/{1}"),
]


#: Hosts whose first part is the same in any case of letters.
LOWER_FIRST = {"reddit.com", "instagram.com"}


def _known_object(host: str, path: str, query: str) -> str | None:
    for hosts, pattern, form in OBJECTS:
        if host in hosts and (m := pattern.search(path)):
            first, *rest = m.groups()
            return form.format(first.lower() if host in LOWER_FIRST else first, *rest)
    if host == "youtube.com" and path == "/watch":
        video = dict(reversed(parse_qsl(query))).get("v")
        return f"youtube.com/video/{video}" if video else None
    return None


def _parts(url: str) -> tuple[str, str, str]:
    u = urlsplit(url)
    host = (u.hostname or "").removeprefix("www.")
    return "x.com" if host == "twitter.com" else host, u.path, u.query


def object_url_text(url: str | None) -> str | None:
    """Canonical form without scheme: a platform's object by its id, else host, path and sorted query without tracking."""
    if not url:
        return None
    url = html.unescape(url.strip())
    try:
        host, path, query = _parts(url if url.startswith(("http://", "https://")) else f"https://{url}")
    except ValueError:
        return None
    path = re.sub("/+", "/", path).rstrip("/")
    if known := _known_object(host, path, query):
        return known
    pairs = sorted(p for p in parse_qsl(query) if p[0].lower() not in fixed.TRACKING_KEYS)
    return host + (path or "/") + (f"?{urlencode(pairs)}" if pairs else "")


def exact_object_text(url: str | None) -> str | None:
    """Only a post or video; profiles, tags and roots are none."""
    try:
        host, path, query = _parts(html.unescape(url or "").rstrip(fixed.LINK_TAIL))
    except ValueError:
        return None
    return _known_object("reddit.com" if host == "old.reddit.com" else host, path, query)


def _each(kind: str, f, *columns: Column) -> Column:
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*values) for values in zip(*series, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)(*columns)


def normalize_object_url(url: Column) -> Column:
    return _each("string", object_url_text, url)


def exact_object_url(url: Column) -> Column:
    return _each("string", exact_object_text, url)


def normalize_text(text: str | None) -> str:
    """NFKD, case folded, combining marks removed; runs of letters and digits joined by blanks."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text or "").casefold() if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", t))


def normalize(text: Column) -> Column:
    return _each("string", normalize_text, text)


def semantic_tokens(normal: Column) -> Column:
    """Sorted distinct words of a normalised text: of three characters or not ASCII, and no stop words."""
    words = F.array_distinct(F.split(normal, " "))
    return F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(fixed.TITLE_STOP) & ((F.length(w) >= 3) | w.rlike(r"[^\x00-\x7F]"))))


def clean_text(text: Column, most: int | None = fixed.POST_LENGTH) -> Column:
    """Links out, mail addresses, phone numbers and mentions redacted, white space folded; the first ``most`` characters (None: all)."""
    t = F.coalesce(text, F.lit(""))
    for pattern, label in fixed.POST_REDACTIONS:
        t = F.regexp_replace(t, f"(?U){pattern}", label)
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return t if most is None else F.substring(t, 1, most)


def html_to_text(source: Column) -> Column:
    """Tags out, character references decoded, white space folded."""
    return _each("string", lambda x: " ".join(html.unescape(x or "").split()), F.regexp_replace(F.coalesce(source, F.lit("")), fixed.TAG, " "))


def text_tokens(text: Column, most: int | None = 24) -> Column:
    """The first ``most`` (None: all) distinct lower-case tokens that are neither stop words nor numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(fixed.POST_TOKEN), F.lit(0))
    own = F.array_distinct(F.filter(found, lambda w: ~w.isin(fixed.POST_STOP) & ~w.rlike(r"^\d+$")))
    return own if most is None else F.slice(own, 1, most)


def allowed_links(values: Column, most: int = 12) -> Column:
    """Sorted distinct links of the allowed hosts in an array of texts, the first ``most``."""

    def run(texts) -> list[str]:
        out = set()
        for text in texts if texts is not None else ():
            for link in [*([text] if (text or "").startswith("http") else []), *re.findall(fixed.POST_URL, text or "")]:
                link = html.unescape(link).rstrip(fixed.LINK_TAIL)
                try:
                    if urlsplit(link).hostname in fixed.LINK_HOSTS:
                        out.add(link[:500])
                except ValueError:
                    continue
        return sorted(out)[:most]

    return _each("array<string>", run, values)


def recursive_urls(payload: Column) -> Column:
    """All strings of a JSON text, at any depth, that stand under ``uri``, ``url`` or ``href`` or start with ``http``, in
    order; strings that stand directly in a list are none."""

    def run(text: str | None) -> list[str]:
        try:
            stack, out = [json.loads(text or "null")], []
        except ValueError:
            return []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, dict):
                found = [(v,) if isinstance(v, str) else v for k, v in x.items() if not isinstance(v, str) or k.lower() in ("uri", "url", "href") or v.startswith("http")]
                stack.extend(reversed(found))
            elif isinstance(x, list):
                stack.extend(v for v in reversed(x) if isinstance(v, dict | list))
        return out

    return _each("array<string>", run, payload)


def canonical_json_text(text: str | None) -> str | None:
    """Sorted keys, no blanks; None for what isn't JSON."""
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text else None
    except (ValueError, RecursionError):
        return None


def canonical_json_hash(payload: Column) -> Column:
    """SHA-256 of a JSON text with sorted keys and no blanks, which order and spacing of the input don't change. Null for a payload that isn't
    JSON: its row stays and shows the gap."""
    return F.sha2(_each("string", canonical_json_text, payload), 256)


#: Which canonical URL is a post's object, by the start of its source: the first pattern that any of its links fits. The last
#: pattern of a list is what is left; without one the first link stands.
_POST = r"/(?:status|video|comments|gallery|reel|p)/"
_NO_PROFILE = r"(?i)^(?!(?:x\.com|twitter\.com)/[^/?#]+/?$|reddit\.com/(?:r|user)/[^/?#]+/?$|youtube\.com/(?:@|channel/|c/|user/))"
PREFERENCES = [
    ("reddit_rss", ["^reddit[.]com/comments/", "^reddit[.]com/gallery/", "^redd[.]it/", "^(?:external-)?preview[.]redd[.]it/", "(?i)^(?!reddit[.]com/(?:r|user)/)", ""]), ("youtube", ["^youtube[.]com/video/", ""]), ("tiktok", ["^tiktok[.]com/video/", "^tiktok[.]com/tag/", ""]),
    ("bluesky_jetstream", ["/(?:status|statuses|post|posts|video|comments|gallery|reel|p)/", _NO_PROFILE]), ("mastodon_public", ["/(?:status|statuses|post|posts|video|comments|gallery|reel|p)/", _NO_PROFILE]), ("", [_POST, _NO_PROFILE]),
]


def choose_canonical_url(source: Column, urls: Column) -> Column:
    """The object of a post among its normalised links, by what its source prefers; null if it has only profiles."""
    own = F.filter(urls, lambda u: u.isNotNull())
    adapter = F.substring_index(F.coalesce(source, F.lit("")), ":", 1)
    out = F.lit(None).cast("string")
    for start, patterns in reversed(PREFERENCES):
        pick = F.coalesce(*[F.get(F.filter(own, _fits(p)), F.lit(0)) for p in patterns])
        out = F.when(adapter == start if start in ("reddit_rss", "bluesky_jetstream", "mastodon_public") else adapter.startswith(start), pick).otherwise(out)
    return out


def _fits(pattern: str):
    return lambda u: u.rlike(pattern) if pattern else F.lit(True)


def is_crypto(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){fixed.CRYPTO_TERMS}"), F.lit(False))


def hex_long(x: Column) -> Column:
    """``0x1f`` as 31; null counts as 0. A number of over 63 bits, or what is no hexadecimal number, is null: a gap, not a wrong number."""
    digits = F.regexp_replace(F.lower(F.coalesce(x, F.lit("0x0"))), "^0x0*", "")
    number = F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).try_cast("long")
    return F.when(digits.rlike("^[0-9a-f]{0,15}$") | digits.rlike("^[0-7][0-9a-f]{15}$"), number)


def hex_decimal(x: Column) -> Column:
    """``0x1f`` as a decimal of 38 digits, for words of up to 120 bits; null for a longer one or what is no hexadecimal number."""
    digits = F.lpad(F.regexp_replace(F.lower(x), "^0x0*", ""), 30, "0")
    part = lambda at: F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(38,0)")
    return F.when(x.rlike("^(0[xX])?0*[0-9a-fA-F]{0,30}$"), part(1) * F.lit(16**15).cast("decimal(19,0)") + part(16))


def topic_address(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(F.regexp_replace(x, "^0x", ""), F.lit(40))))


def word_address(data: Column, index: int) -> Column:
    """Address in the 32-byte word of a log's data; null if the data are too short."""
    word = F.substring(F.regexp_replace(data, "^0x", ""), index * 64 + 1, 64)
    return F.when(F.length(word) == 64, F.concat(F.lit("0x"), F.lower(F.right(word, F.lit(40)))))
