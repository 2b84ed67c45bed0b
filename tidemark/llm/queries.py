"""One query per operator, with production parameters, over its whole table; and the SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bit_packing, decontamination, hard_negatives, html_extraction, jaccard_join, language_id, lexical_search, line_frequency, packing, piece_encoding, sharding, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 24)
    return out.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.score_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge_documents(table(spark, sf_dir, "documents"), copies_once=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2048)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit_model(docs))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op10_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_packing.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 49408)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0, positives=5, negatives=5, percent=80)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_encoding.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    digest = lambda x: F.sha2(F.encode(x, "utf-8"), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_line_frequency": op3_line_frequency,
    "op4_toxicity": op4_toxicity,
    "op5_html_extraction": op5_html_extraction,
    "op6_packing": op6_packing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_bit_packing": op10_bit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_lexical_search": op13_lexical_search,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(decontamination.WORD)} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS.format(decontamination.WORD)} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram FROM b WHERE len(w) > 0),
v AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) AS k WHERE len(w) >= n),
h AS (SELECT rid, i, v.n, item FROM v JOIN g ON v.n = g.n AND array_to_string(w[i:i + v.n - 1], ' ') = gram),
o AS (SELECT rid, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM h GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN o USING (rid)""",
    "op3_line_frequency": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, source, text, i, ls[i] AS line, lower(array_to_string(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'), ' ')) AS k, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL)),
t AS (SELECT source, count(*) AS docs FROM (SELECT DISTINCT source, doc_id, text FROM d WHERE text IS NOT NULL) GROUP BY source),
f AS (SELECT source, k, count(*) AS c FROM (SELECT DISTINCT source, doc_id, text, k FROM l WHERE n > 0) GROUP BY source, k),
bad AS (SELECT f.source, k FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source WHERE c > greatest(2, least(greatest(docs * 0.02, 20), docs * 0.05, 100))),
left_n AS (SELECT rid, sum(CASE WHEN bad.k IS NULL THEN n ELSE 0 END) AS n_left FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.k = bad.k GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE n > 0 GROUP BY rid),
g AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT rid, len(list_distinct(flatten(list([i, i + 1, i + 2])))) AS n_rep FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1 GROUP BY rid),
a AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, CAST(coalesce(n_left, 0) AS BIGINT) AS n_left FROM d LEFT JOIN dup USING (rid) LEFT JOIN r USING (rid) LEFT JOIN left_n USING (rid)),
e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a) SELECT *, NOT base_failed AND n_left >= 0.5 * n_words AS kept FROM e""",
    "op7_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("[^\x20\x09-\x0D]+")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s), e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u AS x JOIN u AS y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(g) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON s.doc_id = r.a GROUP BY s.doc_id, len(g)""",
    "op9_warc": """WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5""",
    "op13_lexical_search": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(_TERM)} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT k, item_id, unnest(list_distinct(w)) AS t FROM (SELECT row_number() OVER () AS k, item_id, {_WORDS.format(_TERM)} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark))),
s AS (SELECT k, item_id, rid, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * docs) // total)))) AS BIGINT) AS score, any_value(doc_id) AS doc_id
 FROM q JOIN tf USING (t) JOIN df USING (t) JOIN d USING (rid), c GROUP BY k, item_id, rid)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10""",
}
