"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised n-grams are the small side: their 64-bit hashes, with the n-grams and item ids, are broadcast in
rounds of a bounded size. Documents are scanned once a round, whatever the lengths of the n-grams: every window is probed by
its hash, and only windows whose hash is found are built as text and compared, so a hit is an equal n-gram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of ASCII digits and letters and of all characters above U+007F.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same word before it is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds of one broadcast; ids of an item list that stand in one row of the index.
BROADCAST_GRAMS, BROADCAST_BYTES, ITEMS_A_ROW = 1_000_000, 128 << 20, 1_000


def words(text: Column) -> Column:
    """Lower-case (A-Z only) words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def grams(w: Column, n: int) -> Column:
    """All windows of n words, in order, each joined by blanks; none if there are fewer words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def benchmark_grams(benchmark: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, n, items): each distinct window of the benchmark with the sorted ids, as text, of the items that have it.
    An item with fewer than n words, but not none, is one window. Items with a null id count as the text ``null``."""
    w = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    each = w.select("item", "n", F.explode(F.when(F.size("w") <= n, F.array(F.array_join("w", " "))).otherwise(grams(F.col("w"), n))).alias("gram"))
    return each.groupBy("gram", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _windows(n: int) -> Column:
    """(hash, place from 1, n) of each window of n words, from the words' hashes ``hw``."""
    each = F.transform(F.sequence(F.lit(1), F.size("hw") - n + 1), lambda i: F.struct(F.xxhash64(F.slice("hw", i, n)).alias("h"), i.alias("i"), F.lit(n).alias("n")))
    return F.when(F.size("hw") >= n, each).otherwise(F.array().cast("array<struct<h:bigint,i:int,n:int>>"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_grams: int = BROADCAST_GRAMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, hits array of word positions from 0, items array of sorted item ids) for each distinct document
    with a hit. Row identity is the key ``k`` with a hash ``t`` of the text, so repeated rows agree and equal keys with different
    texts stay apart. A document is scanned whole; null or empty texts have no windows, an empty benchmark no grams.
    """
    index = benchmark_grams(benchmark, n).withColumn("h", F.xxhash64(F.transform(F.split("gram", " "), lambda x: F.xxhash64(x))))
    # A long list of ids takes several rows, so that no row of the broadcast is large.
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / ITEMS_A_ROW).cast("int")), lambda i: F.slice("items", i * ITEMS_A_ROW + 1, ITEMS_A_ROW))
    index = materialize(index.withColumn("items", F.explode(pieces)), "benchmark-grams")
    lengths = sorted(r[0] for r in index.select("n").distinct().collect())  # at most n rows
    size = F.octet_length("gram") + F.octet_length(F.array_join("items", " ")) + 64
    rows_n, rows_b = index.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    rounds = max(1, -(-rows_n // broadcast_grams), -(-rows_b // BROADCAST_BYTES))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), words(F.col(text)).alias("w"))
    rows = rows.withColumn("hw", F.transform("w", lambda x: F.xxhash64(x)))
    if not lengths:
        none = rows.limit(0).select("k", "t", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
        return none
    each = [_windows(k) for k in lengths]
    # The windows are a column before they are exploded: so the rows of a document share its words, which aren't copied
    # (generated code). explode_outer: for the inner form Spark infers a filter that computes all windows a second time.
    rows = rows.withColumn("x", each[0] if len(each) == 1 else F.concat(*each))
    windows = rows.select("k", "t", "w", F.explode_outer("x").alias("x")).select("k", "t", "w", "x.*")
    found = None
    for r in range(rounds):
        own = index if rounds == 1 else index.where(F.pmod(F.xxhash64("h", F.size("items"), F.get("items", 0)), F.lit(rounds)) == r)
        part = windows.join(F.broadcast(own.select(F.col("h").alias("g"), "gram", "items")), F.col("h") == F.col("g"))
        part = part.where(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ") == F.col("gram")).select("k", "t", (F.col("i") - 1).alias("at"), "n", "items")
        found = part if found is None else found.unionByName(part)
    # Hits are folded per document: as many as the document has words at most.
    return found.groupBy("k", "t").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1)))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def score_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, broadcast_grams: int = BROADCAST_GRAMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and empty texts have no words and no hits; repeated rows get equal results, rows that repeat a key but not its
    text their own; a null key is as good as any; extra columns are ignored; an empty table gives no rows."""
    hits = contamination(docs, benchmark, n, broadcast_grams, key, text)
    hits = hits.select("k", "t", F.size("hits").cast("long").alias("h"), F.size("items").cast("long").alias("i"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("s"))
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_key"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
    out = slim.join(hits, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_key") == F.col("t")), "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("h", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("i", F.lit(0)).cast("long").alias("n_items"), F.coalesce("s", none).alias("items_sha256"), (F.coalesce("h", F.lit(0)) > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_share: float = 0.0, broadcast_grams: int = BROADCAST_GRAMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contamination, with its own columns whatever their names: a document of which more than
    ``max_share`` of the words are hit goes; from the others the hit words go, each with the separators before it. At 0
    every hit document goes. Null and empty texts stay, repeated rows fare alike, null keys need no care; an empty table
    gives no rows and an empty benchmark changes none."""
    hits = contamination(docs, benchmark, n, broadcast_grams, key, text).select("k", "t", "hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.col(text).alias("x"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.xxhash64("x") == F.col("t"))
    if max_share <= 0:
        return rows.join(hits.drop("hits"), same, "left_anti").select("row.*")
    joined = rows.join(hits, same, "left")
    pieces = F.regexp_extract_all("x", F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("hits")))
    cut = F.ltrim(F.array_join(F.transform(keep, lambda i: F.get(pieces, i)), ""))
    joined = joined.where(F.col("hits").isNull() | (F.size("hits") <= max_share * F.size(words(F.col("x")))))
    return joined.select(*[(F.when(F.col("hits").isNotNull(), cut).otherwise(F.col("x")) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
