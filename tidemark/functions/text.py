"""Text, URL and number functions as column expressions; Python only where Spark has no built-in."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed

def matched_buckets(text: Column, links: Column | None = None, patterns: dict[str, list[str]] | None = None) -> Column:
    """Sorted names of the buckets of which a pattern occurs in the lower-cased text and links."""
    hay = F.lower(F.concat_ws(" ", text, *([F.array_join(links, " ")] if links is not None else [])))
    found = [F.when(F.greatest(F.lit(False), *[F.contains(hay, F.lit(p)) for p in ps]), F.lit(b)) for b, ps in sorted((patterns or fixed.SOCIAL_BUCKETS).items())]
    return F.array_sort(F.array_compact(F.array(*found)))


def match_score(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    """1 if equal; for two or more shared tokens 0.6 + 0.1 each up to 0.95; 0.72 for one of six letters that is a whole side; else 0."""
    both = F.array_intersect(a_tokens, b_tokens)
    n = F.size(both)
    single = (n == 1) & (F.length(F.get(both, 0)) >= 6) & ((F.size(a_tokens) == 1) | (F.size(b_tokens) == 1))
    return F.when(a == b, 1.0).when(n >= 2, F.least(F.lit(0.95), 0.6 + 0.1 * n)).when(single, 0.72).otherwise(0.0)


def metric(text: Column) -> Column:
    """``1.2M`` as 1200000; K, M and B; null for anything else."""
    t = F.upper(F.trim(F.regexp_replace(text, ",", "")))
    n = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*[KMB]?$", 1)
    unit = F.when(t.endswith("K"), 1e3).when(t.endswith("M"), 1e6).when(t.endswith("B"), 1e9).otherwise(1.0)
    return F.when(n != "", F.bround(F.try_to_number(n, F.lit("999999999999.999999")).cast("double") * unit).cast("long"))


def age_minutes(text: Column) -> Column:
    """``3 hours ago`` in minutes; null for what doesn't say how long ago it was."""
    ago = r"(\d+)\s*(second|minute|hour|day|week|month|year)s?\s+ago"
    n, unit = F.regexp_extract(F.lower(text), ago, 1), F.regexp_extract(F.lower(text), ago, 2)
    per = {"second": 1 / 60, "minute": 1.0, "hour": 60.0, "day": 1440.0, "week": 10080.0, "month": 43200.0, "year": 525600.0}
    case = F.lit(None).cast("double")
    for k, v in per.items():
        case = F.when(unit == k, F.lit(v)).otherwise(case)
    return F.when(n != "", n.try_cast("double") * case)


def short_id(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts joined by U+001F; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def same_address(a: Column, b: Column) -> Column:
    """Equal; without regard to case only if both start with 0x. Null and empty are never equal."""
    return F.coalesce((a != "") & F.when(a.startswith("0x") & b.startswith("0x"), F.lower(a) == F.lower(b)).otherwise(a == b), F.lit(False))


def snowflake_time(x: Column) -> Column:
    return F.timestamp_millis(F.shiftright(x, 22) + F.lit(1288834974657))


def timely(published: Column, observed: Column, most: int = 120) -> Column:
    """Age in minutes from -5 to ``most``; an unknown time is not timely."""
    age = (F.unix_timestamp(observed) - F.unix_timestamp(published)) / 60
    return F.coalesce(age.between(-5, most), F.lit(False))


def simhash_bits(words: list[str]) -> int | None:
    """64-bit SimHash over 8-byte BLAKE2b of each word, as a signed integer; a tie sets the bit; no words give none."""
    if not len(words):
        return None
    digests = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words), np.uint8)
    ones = np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(words)).tobytes(), "big", signed=True)


def simhash(words: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(pd.array([simhash_bits(w) for w in x], "Int64"))  # map() would round to doubles beside a null

    return F.pandas_udf(run, "long")(words)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(x: Column, n: int = 4) -> Column:
    """The fingerprint in n equal runs of bits, highest first: all pairs within n - 1 bits share one at its place."""
    w = 64 // n
    return F.array(*[F.shiftrightunsigned(x, 64 - w * (i + 1)).bitwiseAND(F.lit((1 << w) - 1)) for i in range(n)])


def cpmm_impact(probe: Column, reserve: Column) -> Column:
    """Price impact p / (r/2 + p) of a constant-product pool; null without a positive reserve."""
    return F.when(reserve > 0, probe / (reserve / 2 + probe))


def leader_score(reserve: Column, volume: Column, buys: Column, sells: Column, external: Column, n: Column) -> Column:
    z = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    b, s = z(buys), z(sells)
    return F.round(1.4 * F.log1p(z(reserve)) + F.log1p(z(volume)) + 0.4 * F.log1p(b + s) + b / F.greatest(b + s, F.lit(1.0)) + 0.8 * F.log1p(z(external)) + 0.5 * F.log1p(z(n)), 6)
