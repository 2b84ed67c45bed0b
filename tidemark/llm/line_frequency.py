"""Cross-document line frequency with DataFrame functions only.

Lines are normalised and hashed; a line that too many distinct documents of one host carry is boilerplate there and is
removed; a document that loses too many of its words this way is depleted and rejected. With ``copies_once`` exact copies
of a text count as one document, so that they do not condemn each other before a later stage removes them. Near copies
count each; with ``first_stays`` the first document of a host with a frequent line isn't depleted by it, so that one of a
group whose members condemn each other stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialize

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Most line hashes and hosts (8 bytes each, and names) that are broadcast.
BROADCAST_LINES = 1_000_000
#: Bounds of ``line_limit``.
LEAST_DOCS, SMALL_SHARE, MAX_DOCS = 2, 0.05, 100


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def line_key(line: Column) -> Column:
    """64-bit hash of a line: white space trimmed and folded, lower case."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, WHITE, " "))))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def with_repeat_words(df: DataFrame, w: str, out: str, n: int = 3) -> DataFrame:
    """Adds the number of words that lie in an n-word window found twice or more in the list ``w``.

    Each step is a column of its own, so that what a lambda refers to is computed once a row."""
    df = df.withColumn("_h", F.transform(w, lambda x: F.xxhash64(x)))
    grams = F.transform(F.sequence(F.lit(1), F.size("_h") - n + 1), lambda i: F.struct(F.xxhash64(F.slice("_h", i, n)).alias("g"), i.alias("i")))
    df = df.withColumn("_g", F.sort_array(F.when(F.size("_h") >= n, grams).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))))
    # In hash order a window that repeats has an equal neighbour; the covered words are counted along the starts in text order.
    same = F.filter("_g", lambda x, k: F.coalesce(x["g"] == F.get("_g", k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_g", k + 1)["g"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    fold = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    # A generated column: no filter on it moves below and puts the lists into lambdas.
    return df.withColumn(out, F.explode(F.array(fold.cast("long")))).drop("_h", "_g")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    own = F.filter(lines(text), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(own) - F.size(F.array_distinct(own))).cast("long")


def _whole(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows as one column ``row`` beside columns of the operator's own: names in ``docs`` can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def line_limit(texts: Column, max_share: float, min_docs: int) -> Column:
    """Most documents of a host with ``texts`` of them that may carry a line: ``max_share`` of them, ``min_docs`` at least;
    but SMALL_SHARE, which hosts of few texts can reach, and MAX_DOCS, however large the host, bound it. LEAST_DOCS documents are never too many."""
    return F.greatest(F.lit(LEAST_DOCS), F.least(F.greatest(texts * max_share, F.lit(min_docs)), texts * SMALL_SHARE, F.lit(MAX_DOCS)))


def identity(text: str, key: str | None) -> Column:
    """Hash by which documents are told apart."""
    return F.xxhash64(F.col(text)) if key is None else F.xxhash64(F.col(key), F.col(text))


def frequent_lines(docs: DataFrame, max_share: float = 0.02, min_docs: int = 20, host: str = "source", text: str = "text", key: str | None = None) -> DataFrame:
    """(host, bad, firsts): sorted hashes of the lines that more than ``line_limit`` of the host's documents contain, and in
    the same order a hash of each line with its first document, that of the smallest hash (``identity``).

    Documents are told apart by ``key`` and text, or by the text alone without a key, so that exact copies count once. A
    null host is a host of its own; null texts have no lines; repeated rows are one document."""
    each = docs.select(F.col(host).cast("string").alias("host"), identity(text, key).alias("t"), F.col(text).alias("x")).where(F.col("x").isNotNull())
    totals = each.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("texts")).withColumnRenamed("host", "h")
    keys = F.array_distinct(F.transform(F.filter(lines(F.col("x")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), line_key))
    # distinct() first merges copies within each task; the second count then merges (host, line) before its shuffle.
    freq = each.select("host", "t", F.explode_outer(keys).alias("line")).where(F.col("line").isNotNull()).distinct().groupBy("host", "line").agg(F.count("*").alias("n"), F.min("t").alias("t")).where(F.col("n") > LEAST_DOCS)
    bad = freq.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > line_limit(F.col("texts"), max_share, min_docs))
    pairs = F.sort_array(F.collect_list(F.struct("line", F.xxhash64("line", "t").alias("first"))))
    return bad.groupBy("host").agg(pairs.alias("pairs")).select("host", F.col("pairs.line").alias("bad"), F.col("pairs.first").alias("firsts"))


def _judged(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """``rows`` (x text, t identity, host, further columns) with ``left``, the text without its host's frequent lines, and
    ``spared``, the text without those of them that the document isn't the first to carry.

    The lists are broadcast once they are known to be small. Beyond that only (document, place, line) hashes of the lines
    are shuffled, by host and line, where Spark splits the hot ones; then each document meets its own list of places."""
    bad = materialize(bad.select(F.col("host").alias("bad_host"), "bad", "firsts"), "frequent-lines")
    n = bad.agg(F.sum(F.size("bad") + 1)).first()[0] or 0
    own = lines(F.col("x"))
    if n <= BROADCAST_LINES:
        # Parts of about eight hashes, chosen by the hash, so that a line isn't compared with the whole list.
        parts = F.greatest(F.lit(1), F.floor(F.size("bad") / 8)).cast("int")
        part = lambda i: F.filter(F.arrays_zip("bad", "firsts"), lambda s: F.pmod(s["bad"], parts) == i)
        bad = bad.select("bad_host", F.transform(F.sequence(F.lit(0), parts - 1), part).alias("zipped"))
        bad = bad.select("bad_host", F.transform("zipped", lambda z: z["bad"]).alias("bad"), F.transform("zipped", lambda z: z["firsts"]).alias("firsts"))
        rows = rows.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("bad_host")), "left")
        keyed = F.transform(own, lambda x: F.struct(x.alias("x"), line_key(x).alias("k")))
        at = lambda lists, k: F.element_at(lists, (F.pmod(k, F.size("bad")) + 1).cast("int"))
        kept = F.filter(keyed, lambda s: ~F.array_contains(at("bad", s["k"]), s["k"]))["x"]
        spared = F.filter(keyed, lambda s: ~F.array_contains(at("bad", s["k"]), s["k"]) | F.array_contains(at("firsts", s["k"]), F.xxhash64(s["k"], F.col("t"))))["x"]
    else:
        same = [F.xxhash64("host", "t", "x").alias("d1"), F.xxhash64("x", "host", "t", F.lit(7)).alias("d2")]
        each = rows.where(F.col("x").isNotNull()).select("host", "t", *same, F.transform(own, line_key).alias("line")).select("host", "t", "d1", "d2", F.posexplode("line").alias("at", "line"))
        bad = bad.select(F.col("bad_host"), F.explode(F.arrays_zip("bad", "firsts")).alias("b")).select("bad_host", F.col("b.bad").alias("bad_line"), F.col("b.firsts").alias("first"))
        met = each.join(bad, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line")))
        later = F.when(F.col("first") != F.xxhash64("line", "t"), F.col("at"))
        places = met.groupBy("d1", "d2").agg(F.collect_set("at").alias("bad"), F.collect_set(later).alias("later"))
        rows = rows.withColumns({"d1": same[0], "d2": same[1]}).join(places, ["d1", "d2"], "left")
        kept = F.filter(own, lambda x, i: ~F.array_contains("bad", i))
        spared = F.filter(own, lambda x, i: ~F.array_contains("later", i))
    touched = F.col("bad").isNotNull() & F.col("x").isNotNull()
    return rows.withColumns({"left": F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("x")), "spared": F.when(touched, F.array_join(spared, "\n")).otherwise(F.col("x"))})


def judge_documents(docs: DataFrame, max_share: float = 0.02, min_docs: int = 20, min_left: float = 0.5, key: str = "doc_id", text: str = "text", host: str = "source", copies_once: bool = True) -> DataFrame:
    """One row per document: base statistics, base_failed and kept.

    kept: not base_failed, and at least ``min_left`` of the words remain once frequent lines are gone. Null and empty
    texts have no words, so base_failed holds; a null host is a host of its own; repeated rows are judged alike; null keys
    and long texts need no care; ties do not arise. An empty table gives no rows. Further columns of ``docs`` are ignored.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("x"), F.col(host).cast("string").alias("host"), identity(text, None if copies_once else key).alias("t"))
    out = _judged(base, frequent_lines(base, max_share, min_docs, "host", "x", None if copies_once else "key"))
    whole = F.coalesce(F.col("x"), F.lit(""))
    out = out.select("key", "left", whole.alias("x"), words(whole).alias("w"))
    out = with_repeat_words(out, "w", "n_repeat_words")
    n = F.size("w").cast("long")
    out = out.select(
        F.col("key").alias(key), n.alias("n_words"), F.length(F.translate("x", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), (F.length("x") - F.length(F.translate("x", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("x")).alias("n_dup_lines"), "n_repeat_words", F.size(words(F.coalesce("left", F.lit("")))).cast("long").alias("n_left"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= min_left * F.col("n_words")))


def clean_documents(docs: DataFrame, max_share: float = 0.02, min_docs: int = 20, min_left: float = 0.5, text: str = "text", host: str = "source", copies_once: bool = True, key: str = "doc_id", first_stays: bool = True) -> DataFrame:
    """``docs``, with its own columns whatever their names, without rejected documents and with frequent lines removed from
    the others. With ``first_stays`` a document that those removals deplete stays if it has ``min_left`` of its words once the
    lines that it is the host's first to carry count as its own, and it keeps these. Null, empty and short texts are rejected, repeated rows are judged alike, a null host is a host of its
    own, null keys need no care; whole texts of any length are read; an empty table gives no rows."""
    rows = _whole(docs, x=F.col(text), host=F.col(host).cast("string"), t=identity(text, None if copies_once else key))
    out = _judged(rows, frequent_lines(docs, max_share, min_docs, host, text, None if copies_once else key))
    out = with_repeat_words(out.withColumn("w", words(F.coalesce("x", F.lit("")))), "w", "rep")
    n = F.size("w")
    enough = lambda c: F.size(words(F.coalesce(c, F.lit("")))) >= min_left * n
    if first_stays:
        out = out.withColumn("left", F.when(enough("left"), F.col("left")).otherwise(F.col("spared")))
    good = (n >= 50) & (100 * F.col("rep") <= 50 * n) & enough("left")
    # As a generated column the verdict stays where it is: a filter that moves below would put whole word lists into lambdas.
    out = out.withColumn("good", F.explode(F.array(good))).where("good")
    return out.select(*[(F.col("left") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
