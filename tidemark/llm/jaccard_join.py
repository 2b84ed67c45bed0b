"""Exact n-gram Jaccard self-join with token-combination prefixes, and its linked classes.

Documents are sets of hashed word n-grams (tokens). In one global order, tokens of few documents first, two sets with
Jaccard >= t share at least K tokens of their K-extended prefixes (n - ceil(t n) + K tokens). They therefore share a
token outside the class of common ones, each of which is indexed alone, or K common ones, of which combinations of K are
indexed. The order and the class are estimated on a part of the documents: any estimate gives the same links, only the
work differs.

Postings are first verified against one hub each (the member with the smallest part of tokens of its own), which is
linear in their length and joins most of a large group of near copies. Pairs are then formed only between different
components of a posting, where the shared token's places in both prefixes leave room for the overlap that a link needs,
and verified exactly. So a group of copies isn't expanded into all pairs, and no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import buffers, slices, word_chunks
from tidemark.llm.components import connected_components
from tidemark.shared import materialize, release

K = 2
#: One of so many texts, by hash, serves the frequency estimate; a token in so many of them is listed; as many are told.
PART, LISTED, MOST_LISTED = 16, 4, 2_000_000
#: A listed token in one of so many of these texts is common: sets of up to COMBINED * 100 / percent tokens index
#: combinations of common tokens, sets of COMBINED tokens or more each of them alone (a link's sets share one form).
COMMON, COMBINED = 10, 150
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(column, n: int = 5) -> Iterator[np.ndarray]:
    """For each text of an Arrow column, the sorted distinct 64-bit hashes of its n-word shingles (A-Z lower-cased);
    fewer words are one shingle, no words none."""
    data, offs = buffers(column)
    distinct, codes, first = word_chunks(data, offs)
    hashes = np.array([xxhash.xxh3_64_intdigest(w.strip(b" \t\n\x0b\x0c\r").lower()) for w in distinct], np.uint64)
    blank = np.array([not w.strip(b" \t\n\x0b\x0c\r") for w in distinct], bool)
    words = hashes[codes] if len(distinct) else np.zeros(0, np.uint64)
    # A text's leading white space is a chunk without a word.
    lead = blank[codes] if len(distinct) else np.zeros(0, bool)
    m = max(len(words) - n + 1, 0)
    with np.errstate(over="ignore"):
        grams = np.zeros(m, np.uint64)
        for j in range(n):
            grams = grams * MIX + words[j : j + m]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            a += a < b and bool(lead[a])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                h = np.uint64(b - a)
                for x in words[a:b]:
                    h = h * MIX + x
                yield mix(np.array([h], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set at the threshold."""
    return -(-percent * n // 100)


class Order(NamedTuple):
    """The listed tokens, sorted, with their ranks from 1 (few documents first); ranks from ``common`` on are common."""

    tokens: np.ndarray
    ranks: np.ndarray
    common: int


def signatures(tokens: np.ndarray, order: Order, percent: int, k: int = K) -> tuple[np.ndarray, int, np.ndarray]:
    """Index keys of a set: the tokens of its extended prefix that are indexed alone, in order; how many of them, the
    first ones, aren't listed; and k-combinations of the common ones. Order: by rank, unlisted ones first, then by hash."""
    none = np.zeros(0, np.uint64)
    n = len(tokens)
    if n < 2:
        return none, 0, none  # a set of one is near equal sets only
    rank = np.zeros(n, np.int64)
    if len(order.tokens):
        at = np.minimum(np.searchsorted(order.tokens, tokens), len(order.tokens) - 1)
        rank = np.where(order.tokens[at] == tokens, order.ranks[at], 0)
    first = np.argsort(rank, kind="stable")[: n - needed(n, percent) + k]
    prefix, rank = tokens[first], rank[first]
    common = rank >= order.common
    alone = prefix if n >= COMBINED else prefix[~common]
    often = prefix[common] if n * percent <= COMBINED * 100 else none
    fresh = int((rank == 0).sum())
    if len(often) < k:
        return alone, fresh, none
    i, j = np.triu_indices(len(often), 1)
    with np.errstate(over="ignore"):
        return alone, fresh, mix(mix(often[i]) * MIX + often[j])


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), _long(flat))


def token_order(docs: DataFrame, n: int, text: str) -> Order:
    """The tokens that LISTED or more distinct texts of a PART-th of the documents contain, the MOST_LISTED most frequent
    ones at most (32 MB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                sets = [s for s in token_sets(piece.column(0), n) if len(s)]
                if sets:
                    token, count = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([_long(token), pa.array(count, pa.int64())], names=["token", "n"])

    part = docs.select(text).where(F.pmod(F.xxhash64(F.col(text), F.lit("part")), F.lit(PART)) == 0).distinct()
    part = materialize(part, "part")
    counts = part.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LISTED)
    got = counts.orderBy(F.desc("n"), "token").limit(MOST_LISTED).toArrow()
    common = int((got.column(1).to_numpy() * COMMON >= part.count()).sum())
    tokens = got.column(0).to_numpy().view(np.uint64)
    release(part)
    by = np.argsort(tokens)
    return Order(tokens[by], (len(tokens) - np.arange(len(tokens)))[by].astype(np.int32), len(tokens) - common + 1)


def _hubs(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a posting's hub and its other members, where the sizes allow a link: for each set the two hubs of
    most of its postings, of three tokens in a hundred at least. This only merges components early; what it leaves out is
    decided afterwards."""
    own = postings.groupBy("doc", "n").agg(F.count("*").alias("shared"))
    own = own.select("doc", (F.col("shared") / (F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + K)).alias("part"))
    hub = postings.join(own, "doc").groupBy("token").agg(F.max_by(F.struct(F.col("doc").alias("a"), F.col("n").alias("m")), F.struct("part", -F.col("doc"))).alias("hub")).select("token", "hub.*")
    near = postings.join(hub, "token").where((F.col("a") != F.col("doc")) & (F.least("m", "n") * 100 >= F.greatest("m", "n") * percent))
    near = near.groupBy("a", F.col("doc").alias("b"), "n").agg(F.count("*").alias("often")).where(F.col("often") * 100 >= F.col("n") * 3)
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("often"), "a"))
    return near.withColumn("rank", best).where(F.col("rank") <= 2).select("a", "b")


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int, broadcast_ids: int, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets are at the threshold. Only texts that occur in a pair are moved, compressed (a text is a
    third of its hashed set then); their ids are broadcast up to ``broadcast_ids`` of them (counted first) and joined by
    a shuffle beyond. A hub of very many members is a skewed key of the pairs, whose other side has one row of it: Spark
    splits such partitions, and nothing here needs the pairs of a key together."""
    ids = materialize(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "pair-ids")
    small = ids.count() <= broadcast_ids
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("t")).join(F.broadcast(ids) if small else ids, "doc", "left_semi")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            rows = [pack((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, pa.binary())], names=["doc", "packed"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                a, b, x, y = batch.slice(at, 256).columns
                texts = dict(zip(a.to_pylist(), x.to_pylist(), strict=True)) | dict(zip(b.to_pylist(), y.to_pylist(), strict=True))
                sets = dict(zip(texts, token_sets(pa.array([open_(t).decode() for t in texts.values()], pa.large_string()), n), strict=True))
                keep = []
                for i, j in zip(a.to_pylist(), b.to_pylist(), strict=True):
                    p, q = sets[i], sets[j]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    held = materialize(own.mapInArrow(squeeze, "doc long, packed binary"), "pair-texts")
    joined = pairs.join(held.select(F.col("doc").alias("a"), F.col("packed").alias("x")), "a").join(held.select(F.col("doc").alias("b"), F.col("packed").alias("y")), "b")
    out = materialize(joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")
    release(held)
    release(ids)
    return out


def stand_in(key: Column, text: Column) -> Column:
    """The key as a long; for a null key a number of 2^62 and more that equal texts share, above any usual key."""
    return F.coalesce(key.cast("long"), F.shiftrightunsigned(F.xxhash64(text, F.lit("null key")), 2).bitwiseOR(F.lit(1 << 62)))


def _apart(docs: DataFrame, repeated: DataFrame, n: int, percent: int, broadcast_ids: int, key: str, text: str) -> DataFrame:
    """``_classes`` where keys repeat over different texts: each text of such a key is a document of its own, with a number
    of 2^62 and more, while links are sought; then the classes that share a key are tied together."""
    keys = materialize(repeated, "repeated-keys")
    told = F.broadcast(keys) if keys.count() <= broadcast_ids else keys
    own = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(told.withColumn("again", F.lit(True)), "doc", "left")
    rows = rows.select(F.when(F.col("again"), own).otherwise(F.col("doc")).alias("id"), "doc", "again", "text")
    found = materialize(_classes(rows.select("id", "text"), n, percent, broadcast_ids, "id", "text"), "apart")
    names = rows.where("again").select("id", F.col("doc").alias("name")).distinct()
    found = found.withColumnRenamed("doc", "id").join(names, "id", "left").select(F.coalesce("name", "id").alias("doc"), F.col("name").isNotNull().alias("again"), "n", "component")
    found = materialize(found, "named")
    tied = found.where("again AND n > 0").select("doc", "component").distinct()
    tied = tied.join(tied.groupBy("doc").agg(F.min("component").alias("least")), "doc").select(F.col("component").alias("a"), F.col("least").alias("b"))
    merged = connected_components(tied).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    found = found.join(merged, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    least = found.where("n > 0").groupBy("whole").agg(F.min("doc").alias("least"))
    return found.join(least, "whole", "left").select("doc", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc")).alias("component"))


def _classes(docs: DataFrame, n: int, percent: int, broadcast_ids: int, key: str, text: str) -> DataFrame:
    """(doc, n, component) for every row of ``docs``; ``key`` is a long without nulls."""
    told = docs.sparkSession.sparkContext.broadcast(tuple(token_order(docs, n, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*told.value)
        for batch in batches:
            for piece in slices(batch, text):
                sets = list(token_sets(piece.column(1), n))
                prints = [fingerprint(s) if len(s) else None for s in sets]
                alone, fresh, combos = zip(*(signatures(s, order, percent) for s in sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), _lists(list(alone)), pa.array(fresh, pa.int32()), _lists(list(combos))],
                    names=["doc", "n", "print", "keys", "fresh", "combos"],
                )

    signed = materialize(docs.select(key, text).mapInArrow(run, "doc long, n long, print binary, keys array<long>, fresh int, combos array<long>"), "signed")
    told.unpersist()
    slim = signed.select("doc", "n", "print")
    repeated = slim.where(F.col("n") > 0).groupBy("doc").agg(F.min("print").alias("p"), F.max("print").alias("q")).where(F.col("p") != F.col("q")).select("doc")
    if repeated.limit(1).count():
        return _apart(docs, repeated, n, percent, broadcast_ids, key, text)
    first = materialize(slim.where(F.col("n") > 0).groupBy("print").agg(F.min("doc").alias("doc")), "prints")
    # One posting entry per distinct set: its first row.
    entries = materialize(signed.where(F.col("n") > 1).join(first.select("print", "doc"), ["print", "doc"], "left_semi").dropDuplicates(["print", "doc"]).drop("print"), "entries")
    alone = entries.select("doc", "n", "fresh", F.posexplode("keys").alias("pos", "token"))
    # Listed tokens are known to be shared. The others are seldom: those of one set only go, and no key is a hot one.
    unlisted = alone.where(F.col("pos") < F.col("fresh")).withColumn("docs", F.count("*").over(Window.partitionBy("token"))).where(F.col("docs") > 1).drop("docs")
    single = unlisted.unionByName(alone.where(F.col("pos") >= F.col("fresh"))).drop("fresh")
    # Of the tokens before one in order only those in postings, ``before`` of them, can be shared.
    single = single.withColumn("before", F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).withColumn("combo", F.lit(False))
    combo = entries.select("doc", "n", F.explode("combos").alias("token")).selectExpr("doc", "n", "-1 AS pos", "token", "-1 AS before", "true AS combo")
    postings = materialize(single.unionByName(combo), "postings")
    release(entries)
    chain = materialize(_hubs(postings.where(~F.col("combo")), percent), "hubs")
    links = _verify(chain, docs, n, percent, broadcast_ids, key, text)
    merged = connected_components(links)
    # What remains of the postings are pairs of different components.
    long = postings.join(merged.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = long.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(F.col("low") < F.col("high")).select("token")
    rest = materialize(long.join(mixed, "token").select("token", "doc", "n", "pos", "before", "combo", "component"), "mixed")
    x, y = rest.alias("x"), rest.alias("y")
    fits = (F.col("x.component") != F.col("y.component")) & (F.col("x.doc") < F.col("y.doc")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    # A link needs this overlap: shared tokens before this one, itself, and those after it are no more than there are.
    room = F.least("x.before", "y.before") + 1 + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1
    fits &= F.col("x.combo") | (room >= F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent) - 1e-9))
    shared = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.combo") == F.col("y.combo")) & fits)
    shared = shared.groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.count_if(~F.col("x.combo")).alias("rare"), F.count_if("x.combo").alias("pairs"))
    # Beyond the prefix that ends first, a set has (needed - K) tokens: a link needs the rest of its overlap in the prefixes.
    # So many shared combinations of two come from so many shared tokens; without one there may be one such token.
    often = F.when(F.col("pairs") > 0, F.floor((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2 + 1e-6)).otherwise(1)
    overlap, least = F.ceil(percent * (F.col("m") + F.col("n")) / (100 + percent) - 1e-9), F.ceil(percent * F.greatest("m", "n") / 100 - 1e-9)
    able = shared.where(F.col("rare") + often >= overlap - least + K).select("a", "b")
    cross = able.join(chain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = _verify(materialize(cross, "cross"), docs, n, percent, broadcast_ids, key, text)
    final = connected_components(links.unionByName(more)).withColumnRenamed("node", "doc")
    classes = first.join(final, "doc", "left").select("print", F.coalesce("component", "doc").alias("component"))
    out = slim.join(classes, "print", "left")
    return out.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def near_classes(docs: DataFrame, n: int = 5, percent: int = 75, broadcast_ids: int = 2_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for every row: set size and the smallest key reachable by links.

    Keys are integers. Null, empty and blank texts have the empty set and link with nothing; equal sets of any number
    are one posting entry, the row of the smallest key; rows that repeat a key are linked through it. A row with a null key
    is linked by its text alone; its component has the smallest key that isn't null, or null if there is none. An empty
    table gives no rows; extra columns are ignored. Hot groups: copies are merged before any pairing, hubs are linear, and
    pairs cross components only.
    """
    kind = docs.schema[key].dataType.simpleString()
    out = _classes(docs.select(stand_in(F.col(key), F.col(text)).alias("doc"), F.col(text).alias("text")), n, percent, broadcast_ids, "doc", "text")
    if docs.where(F.col(key).isNull()).limit(1).count():
        known = docs.select(F.col(key).cast("long").alias("doc")).where(F.col("doc").isNotNull()).distinct()
        out = out.join(known.withColumn("known", F.lit(True)), "doc", "left")
        least = out.where("known").groupBy("component").agg(F.min("doc").alias("least"))
        out = out.join(least, "component", "left").select(F.when(F.col("known"), F.col("doc")).alias("doc"), "n", F.col("least").alias("component"))
    return out.select(F.col("doc").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 75, broadcast_ids: int = 2_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, with its own columns whatever their names, with one row of each class of near copies: that of the smallest
    key, null keys last; of rows that repeat this key, that of the least hash of its text, then of the whole row.

    Null, empty and blank texts are no copies of anything: all stay. An empty table gives no rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), stand_in(F.col(key), F.col(text)).alias("id"), F.col(text).alias("x"))
    classes = materialize(_classes(rows.select(F.col("id").alias("doc"), F.col("x").alias("text")), n, percent, broadcast_ids, "doc", "text").where(F.col("n") > 0), "classes")
    filled = F.coalesce(F.col("x").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def told(ids: DataFrame) -> tuple[DataFrame, int]:
        """Broadcast up to the bound (counted first), joined by a shuffle beyond."""
        return (F.broadcast(ids), m) if (m := ids.count()) <= broadcast_ids else (ids, m)

    gone, _ = told(classes.where(F.col("doc") != F.col("component")).select(F.col("doc").alias("g")).distinct())
    left = rows.join(gone, filled & (F.col("id") == F.col("g")), "left_anti")
    twice, m = told(classes.where(F.col("doc") == F.col("component")).groupBy("doc").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(F.col("doc").alias("g")))
    if m:
        again = filled & (F.col("id") == F.col("g"))
        one = left.join(twice, again, "left_semi").groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("x"), F.xxhash64(F.to_json("row")))).alias("row"))
        left = left.join(twice, again, "left_anti").select("row").unionByName(one.select("row"))
    return left.select("row.*")
