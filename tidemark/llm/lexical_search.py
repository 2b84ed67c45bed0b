"""Ranked lexical search: the best documents of every item of a query set, by integer term weights.

One pass over the texts writes a forward index (key, length, ids and counts of the terms that some item holds). From it come
each term's document frequency and its greatest and k-th greatest impact. A term's k-th impact is reached by k documents, so
the greatest of an item's terms bounds its k-th score from below. An item's terms are put in order of their greatest impact;
those whose sum stays under the bound can't lift a document into the best k by themselves, so only documents with one of
the others are candidates. Candidates are completed term by term, dropped once the rest can't carry them to the bound, and
scored exactly; the bound rises with what a task has found. Only the best k of each item and task are shuffled.

Items are taken in rounds of bounded size; what is broadcast or collected is bounded by the round, never by the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import buffers, slices
from tidemark.shared import materialize, release

#: Terms of all items of a round, unless a single item has more.
ROUND_TERMS = 200_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of terms: ASCII letters and digits, and all of every other character.
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def split_terms(column) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lower-case terms of a string column, the code of each occurrence, and n + 1 offsets of the texts."""
    data, offs = buffers(column)
    own = TERM[data]
    starts = own.copy()
    starts[1:] &= ~own[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    starts[edge] = own[edge]
    begin = np.flatnonzero(starts)
    # Without the other bytes a term reaches to the start of the next one.
    kept = LOWER[data[own]]
    at = (np.cumsum(own) - own)[begin]
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(at, len(kept)).astype(np.int64)), pa.py_buffer(kept)]).dictionary_encode()
    return array.dictionary.to_pylist(), array.indices.to_numpy(zero_copy_only=False), np.searchsorted(begin, offs)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Values sorted by their owner as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, terms) of (item, text): the distinct terms of each text."""
    for batch in batches:
        distinct, codes, first = split_terms(batch.column(1))
        terms = [[distinct[c].decode() for c in np.unique(codes[a:b])] for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["item", "terms"])


def forward_index(batches: Iterator[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(doc, n, terms, counts) of (doc, text): how many terms a text has, and those that have a number. Texts without
    any term are left out."""
    for whole in batches:
        for batch in slices(whole, "text"):
            distinct, codes, first = split_terms(batch.column(1))
            number = np.fromiter((numbers.get(x, -1) for x in distinct), np.int64, len(distinct))[codes] if len(codes) else np.zeros(0, np.int64)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)[number >= 0]
            pair, count = np.unique(doc * max(len(numbers), 1) + number[number >= 0], return_counts=True)
            doc, number = np.divmod(pair, max(len(numbers), 1))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(number.astype(np.int32), doc, len(n)), _lists(count.astype(np.int32), doc, len(n))], ["doc", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))


class Postings(NamedTuple):
    """Of a batch of documents: rows and impact factors of each term, term t at ``first[t]`` to ``first[t + 1]``, rows ascending."""

    first: np.ndarray
    rows: np.ndarray
    factors: np.ndarray


def postings(batch: pa.RecordBatch, n_terms: int, n_docs: int, length: int) -> Postings:
    flat = lambda c: (x := batch.column(c)).values.to_numpy()[x.offsets[0].as_py() : x.offsets[len(x)].as_py()].astype(np.int64)
    terms, counts, sizes = flat("terms"), flat("counts"), np.diff(np.asarray(batch.column("terms").offsets))
    m = 10 + 90 * batch.column("n").to_numpy() * n_docs // length
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    factors = 1_000_000_000 * counts // (1000 * counts + 8 * m[rows])
    order = np.argsort(terms, kind="stable")
    return Postings(np.append(0, np.cumsum(np.bincount(terms, minlength=n_terms))), rows[order], factors[order])


def term_impacts(batches: Iterator[pa.RecordBatch], n_terms: int, n_docs: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """(term, df, top) of a task: documents with the term and its k greatest impact factors."""
    df, top = np.zeros(n_terms, np.int64), np.zeros((n_terms, k), np.int64)
    for batch in batches:
        first, _, factors = postings(batch, n_terms, n_docs, length)
        df += np.diff(first)
        for t in np.flatnonzero(np.diff(first)):
            own = factors[first[t] : first[t + 1]]
            own = own[own > top[t, 0]]
            if len(own):
                top[t] = np.partition(np.append(top[t], own), len(own))[len(own) :]
                top[t].sort()
    seen = np.flatnonzero(df)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * k), pa.array(top[seen].reshape(-1)))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(df[seen]), lists], ["term", "df", "top"])


class Item(NamedTuple):
    """An item's terms by ascending bound, their weights, the sums of the bounds up to each, and what its k-th score reaches."""

    terms: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    floor: int


def plan_item(terms: np.ndarray, weights: np.ndarray, most: np.ndarray, kth: np.ndarray) -> Item:
    """``most`` and ``kth``: greatest and k-th greatest impact factor of each of all terms (0 where there are fewer)."""
    terms = terms[weights[terms] * most[terms] > 0]
    terms = terms[np.argsort(weights[terms] * most[terms], kind="stable")]
    return Item(terms, weights[terms], np.cumsum(weights[terms] * most[terms]), int((weights[terms] * kth[terms]).max(initial=0)))


def best_rows(p: Postings, item: Item, floor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, exact score) of the rows that score at least ``floor`` and more than 0; a superset never, a part never."""
    essential = int(np.searchsorted(item.bounds, floor, "left"))  # the terms before it sum to less than the floor
    total = np.zeros(n, np.int64)
    for t, w in zip(item.terms[essential:], item.weights[essential:], strict=True):
        s = slice(p.first[t], p.first[t + 1])
        total[p.rows[s]] += w * p.factors[s]
    rest = int(item.bounds[essential - 1]) if essential else 0
    rows = np.flatnonzero((total > 0) & (total + rest >= floor))
    for i in range(essential - 1, -1, -1):
        if not len(rows):
            break
        own = p.rows[p.first[item.terms[i]] : p.first[item.terms[i] + 1]]
        if len(own):
            at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            total[rows] += np.where(own[at] == rows, item.weights[i] * p.factors[p.first[item.terms[i]] + at], 0)
        rest = int(item.bounds[i - 1]) if i else 0
        rows = rows[total[rows] + rest >= floor]
    return rows, total[rows]


def search_batches(batches: Iterator[pa.RecordBatch], items: list[Item], n_terms: int, n_docs: int, length: int, k: int) -> Iterator[pa.RecordBatch]:
    """(item, doc, score): the best ``k`` documents of a task for each item, among them all that belong to the best of all."""
    found = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
    floors = [x.floor for x in items]
    for batch in batches:
        p = postings(batch, n_terms, n_docs, length)
        docs, none = pc.fill_null(batch.column("doc"), 0).to_numpy(), batch.column("doc").is_null().to_numpy(zero_copy_only=False)
        for i, item in enumerate(items):
            rows, score = best_rows(p, item, floors[i], batch.num_rows)
            if not len(rows):
                continue
            score, gone, doc = (np.concatenate(x) for x in zip(found[i], (score, none[rows], docs[rows]), strict=True))
            order = np.lexsort((doc, gone, -score))[:k]
            found[i] = score[order], gone[order], doc[order]
            if len(order) == k:
                floors[i] = max(floors[i], int(score[order[-1]]))
    score, gone, doc = (np.concatenate([x[j] for x in found]) if found else np.zeros(0) for j in range(3))
    which = np.repeat(np.arange(len(items), dtype=np.int32), [len(x[0]) for x in found])
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(doc, pa.int64(), mask=gone.astype(bool)), pa.array(score, pa.int64())], ["item", "doc", "score"])


def _rounds(items: DataFrame) -> int:
    """How many rounds by a hash keep each below ROUND_TERMS, but for single items."""
    n = 1
    while True:
        sizes = items.groupBy(F.pmod("h", F.lit(n))).agg(F.sum(F.size("terms")).alias("terms"), F.count("*").alias("items"))
        if not sizes.where((F.col("terms") > ROUND_TERMS) & (F.col("items") > 1)).limit(1).count() or n >= 1 << 20:
            return n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text") -> DataFrame:
    """(item, rank, doc, score) under the given names: the ``k`` documents with the highest score above 0 for each item.

    A term is a run of ASCII letters and digits and other characters than ASCII, A-Z lower-cased. With N documents that have
    terms and L terms in them, a term that df of them hold weighs floor(1000 * ln((2N + 2) / (2df + 1))); a document of n terms that holds it tf times
    gets that weight times (10^9 * tf) div (1000 * tf + 8 * (10 + 90 * n * N div L)).

    Ranks run from 1, the highest score first, then the smaller key, a null key last. Null and empty texts have no terms;
    an item without one, or with none that a document holds, has no rows, nor have empty tables. Equal items count once; items of one id with other texts
    are ranked apart. Each row of ``docs`` is a document, repeated ones too; keys are long integers, and other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    rows = items.select(F.col(item).alias("item"), F.col(query).cast("string").alias("text")).distinct()
    schema = rows.select("item").schema.add("terms", T.ArrayType(T.StringType()))
    rows = materialize(rows.mapInArrow(item_terms, schema).withColumn("h", F.xxhash64("item", "terms")), "query-terms")
    n_rounds, parts, done = _rounds(rows), [], [rows]
    for r in range(n_rounds):
        own = rows.where((F.pmod("h", F.lit(n_rounds)) == r) & (F.size("terms") > 0)).collect()  # bounded, see _rounds
        names = sorted({t for x in own for t in x.terms})
        if not names:
            continue
        numbers = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(names)})
        told = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
        index = materialize(told.mapInArrow(lambda x, numbers=numbers: forward_index(x, numbers.value), "doc long, n long, terms array<int>, counts array<int>"), "forward-index")
        n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            release(index)
            continue
        n_terms = len(names)
        each = materialize(index.mapInArrow(lambda x, a=(n_terms, n_docs, length, k): term_impacts(x, *a), "term int, df long, top array<long>"), "term-impacts")
        tops = each.select("term", F.explode("top").alias("q")).where("q > 0").withColumn("nth", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("q")))).where(F.col("nth") <= k)
        tops = tops.groupBy("term").agg(F.max("q").alias("most"), F.max(F.when(F.col("nth") == k, F.col("q"))).alias("kth"))
        df, most, kth = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for x in each.groupBy("term").agg(F.sum("df").alias("df")).join(tops, "term").collect():  # a row for each term of the round
            df[x.term], most[x.term], kth[x.term] = x.df, x.most, x.kth or 0
        release(each)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        place = {t: i for i, t in enumerate(names)}
        plans = spark.sparkContext.broadcast([plan_item(np.array([place[t] for t in x.terms]), weights, most, kth) for x in own])
        best = index.mapInArrow(lambda x, plans=plans, a=(n_terms, n_docs, length, k): search_batches(x, plans.value, *a), "item int, doc long, score long")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, x.item) for i, x in enumerate(own)], rows.select(F.lit(0).alias("at")).schema.add("id", kind))
        parts.append(materialize(best.join(F.broadcast(ids), F.col("item") == F.col("at")).select(F.col("id").alias(item), "rank", F.col("doc").alias(key), "score"), "best-documents"))
        done.append(index)
    for x in done:
        release(x)
    if not parts:
        return spark.createDataFrame([], rows.select(F.col("item").alias(item)).schema.add("rank", "integer").add(key, "long").add("score", "long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
