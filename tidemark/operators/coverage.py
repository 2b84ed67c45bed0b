"""What a run could see: source health, decisions per lane, first funders of wallets, objects that two sides share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

PARSED_TX = "struct<transaction:struct<message:struct<accountKeys:array<string>>>,meta:struct<preBalances:array<bigint>,postBalances:array<bigint>>>"
PARSED_KEY = "struct<pubkey:string,signer:boolean>"


def coverage_states(health: DataFrame, geos: list[str], networks: list[str], run: str = "run", candidates: DataFrame | None = None) -> DataFrame:
    """Per run, from its (source, ok) rows: attention_sources_ok, attention_quorum, usable_lanes, candidates_complete and
    coverage_state.

    Sources are ``trends:<geo>``, ``pools:<network>``, ``fees`` and, for each candidate, ``tokeninfo:<network>:<token>``. A source without a
    row was not seen and counts as failed; of several rows of a source one that failed counts. ``candidates`` (run, network, token) are those that a run had
    to ask for: one without a good row leaves the run incomplete, so nothing that was never asked counts as seen. Without the table the candidates are
    those with a row. Names are counted, not collected, so a run may have any number of candidates."""
    attention, pools = [f"trends:{g}" for g in geos], [f"pools:{n}" for n in networks]
    rows = health.select(run, "source", F.coalesce("ok", F.lit(False)).alias("ok"))
    if candidates is not None:
        due = candidates.select(run, F.concat_ws(":", F.lit("tokeninfo"), "network", F.col("token").cast("string")).alias("source")).distinct()
        asked = due.join(rows.select(run, "source").distinct(), [run, "source"], "left_anti")
        rows = rows.unionByName(asked.withColumn("ok", F.lit(False)))
    each = rows.groupBy(run, "source").agg(F.bool_and("ok").alias("ok"))
    here = lambda names: F.count_if(F.col("ok") & F.col("source").isin(names))
    lanes = F.array_sort(F.collect_set(F.when(F.col("ok") & F.col("source").isin(pools), F.substring_index("source", ":", -1))))
    out = each.groupBy(run).agg(
        here(attention).alias("attention_sources_ok"), lanes.alias("usable_lanes"), here([*attention, *pools, "fees"]).alias("_base"),
        (F.count_if(F.col("source").startswith("tokeninfo:") & ~F.col("ok")) == 0).alias("candidates_complete"),
    )
    quorum = F.col("attention_sources_ok") >= max(2, len(geos) - 1)
    whole = F.col("_base") == len(attention) + len(pools) + 1
    state = F.when(whole & F.col("candidates_complete"), "COMPLETE").when(quorum & (F.size("usable_lanes") > 0) & F.col("candidates_complete"), "PARTIAL_USABLE").otherwise("INSUFFICIENT")
    return out.withColumns({"attention_quorum": quorum, "coverage_state": state}).drop("_base")


def lane_decisions(states: DataFrame, observed: DataFrame, networks: list[str], run: str = "run") -> DataFrame:
    """(run, network, decision) for every network of every run. What couldn't be seen is UNKNOWN, never "no trade"."""
    seen = observed.select(run, "network").distinct().withColumn("_seen", F.lit(True))
    lanes = states.withColumn("network", F.explode(F.array(*[F.lit(n) for n in networks]))).join(seen, [run, "network"], "left")
    decision = F.when(~F.col("attention_quorum"), "UNKNOWN_ATTENTION_COVERAGE").when(~F.array_contains("usable_lanes", F.col("network")), "UNKNOWN_SOURCE_COVERAGE").when(F.col("_seen"), "LEADER_REVIEW").otherwise("NO_TRADE_OBSERVED")
    return lanes.select(run, "network", decision.alias("decision"))


def run_decision(passes: Column, matches: Column, candidates_complete: Column, coverage_state: Column) -> Column:
    """Decision of a whole run: a pass outweighs gaps, and a match without full candidates is a gap."""
    return F.when(passes, "REVIEW_REQUIRED").when((matches > 0) & ~candidates_complete, "CANDIDATE_COVERAGE_INSUFFICIENT").when(coverage_state == "INSUFFICIENT", "COVERAGE_INSUFFICIENT").otherwise("NO_TRADE_OBSERVED_LANES")


def funding_roots(pages: DataFrame, transactions: DataFrame, max_pages: int = 5, page_size: int = 1000) -> DataFrame:
    """(wallet, state, funding_root, signature, wallet_delta, funder_delta): who paid a wallet's earliest transaction.

    ``pages``: (wallet, page from 1, n_rows, oldest, error), one row per page of a wallet's history, newest first;
    ``transactions``: (signature, tx), parsed transactions as JSON. Only a history whose last page is short is complete; any error leaves it
    unverified, and so does a transaction that wasn't fetched or can't be read."""
    at = lambda c: F.max_by(c, "page")
    last = pages.groupBy("wallet").agg(F.max("page").alias("n_pages"), at("n_rows").alias("n_rows"), F.max_by("oldest", F.when(F.col("n_rows") > 0, F.col("page"))).alias("signature"), F.bool_or(F.col("error").isNotNull()).alias("failed"))
    known = transactions.groupBy("signature").agg(F.max("tx").alias("tx"))
    x = last.join(known, "signature", "left").withColumn("_t", F.from_json("tx", PARSED_TX))
    # A key is a plain string or an object that says whether it signed.
    raw = F.coalesce(F.col("_t.transaction.message.accountKeys"), F.array().cast("array<string>"))
    one = lambda k: F.when(k.startswith("{"), F.from_json(k, PARSED_KEY)).otherwise(F.struct(k.alias("pubkey"), F.lit(False).alias("signer")))
    none = F.array().cast("array<bigint>")
    x = x.select("wallet", "n_pages", "n_rows", "signature", "failed", F.transform(raw, one).alias("_k"), F.coalesce("_t.meta.preBalances", none).alias("_pre"), F.coalesce("_t.meta.postBalances", none).alias("_post"))
    moved = F.zip_with("_k", F.zip_with("_post", "_pre", lambda a, b: a - b), lambda k, d: F.struct(k["pubkey"].alias("pubkey"), F.coalesce(k["signer"], F.lit(False)).alias("signer"), d.alias("delta")))
    x = x.withColumn("_m", moved)
    own = F.get(F.filter("_m", lambda m: m["pubkey"] == F.col("wallet")), F.lit(0))
    paid = F.transform(F.filter("_m", lambda m: (m["pubkey"] != F.col("wallet")) & m["signer"] & (m["delta"] < 0)), lambda m: F.struct((-m["delta"]).alias("delta"), m["pubkey"].alias("pubkey")))
    x = x.withColumns({"_own": own, "_by": F.array_max(paid)})
    readable = F.col("_own").isNotNull() & (F.size("_pre") == F.size("_post")) & (F.size("_pre") == F.size("_k"))
    state = (
        F.when(F.col("failed"), "RPC_UNVERIFIED").when((F.col("n_pages") >= max_pages) & (F.col("n_rows") >= page_size), "HISTORY_TRUNCATED").when(F.col("n_rows") >= page_size, "RPC_UNVERIFIED").when(F.col("signature").isNull(), "NO_HISTORY")
        .when(~readable, "EARLIEST_TX_UNDECODABLE").when((F.col("_own.delta") <= 0) | F.col("_by").isNull(), "EARLIEST_TX_NOT_FUNDING").otherwise("INDEPENDENT_VERIFIED")
    )
    x = x.withColumn("state", state)
    sure = F.col("state") == "INDEPENDENT_VERIFIED"
    return x.select("wallet", "state", F.when(sure, F.col("_by.pubkey")).alias("funding_root"), "signature", F.when(F.col("state").isin("INDEPENDENT_VERIFIED", "EARLIEST_TX_NOT_FUNDING"), F.col("_own.delta")).alias("wallet_delta"), F.when(sure, F.col("_by.delta")).alias("funder_delta"))


def object_crossover(envelopes: DataFrame, posts: DataFrame, horizon: str = "48 HOURS") -> DataFrame:
    """(post_hash, by_post, object_url, published_at) of later posts that link the very object of an envelope.

    ``envelopes``: (post_hash, object_url, published_at); ``posts``: (post_hash, linked_object_urls, published_at). An envelope's own post
    and posts from before it or beyond the horizon are none; repeated links count once. One equi-join on the object and an eighth of the
    horizon: each side is made distinct before, an envelope's overlapping spans into one, so no pair arises twice and the pairs, whose number
    is the result's own, aren't shuffled or held."""
    on = ["post_hash", "object_url"]
    e = envelopes.select(*on, F.col("published_at").alias("_from"), (F.col("published_at") + F.expr(f"INTERVAL {horizon}")).alias("_upto")).where("post_hash IS NOT NULL AND object_url IS NOT NULL AND _from IS NOT NULL")
    order = Window.partitionBy(*on).orderBy("_from")
    apart = F.coalesce(F.col("_from") > F.max("_upto").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    e = e.withColumn("_apart", apart.cast("int")).withColumn("_span", F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.groupBy(*on, "_span").agg(F.min("_from").alias("_from"), F.max("_upto").alias("_upto"))
    p = posts.select(F.col("post_hash").alias("by_post"), F.explode(F.array_distinct("linked_object_urls")).alias("object_url"), "published_at").where("by_post IS NOT NULL AND object_url IS NOT NULL AND published_at IS NOT NULL").distinct()
    width = F.greatest(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {horizon}")) / 8, F.lit(1))
    number = lambda c, kind: F.floor(_clock(F.col(c), kind) / width)
    e = e.withColumn("_bin", F.explode(F.sequence(number("_from", e.schema["_from"].dataType), number("_upto", e.schema["_upto"].dataType))))
    p = p.withColumn("_bin", number("published_at", p.schema["published_at"].dataType))
    j = p.join(e, ["object_url", "_bin"]).where((F.col("by_post") != F.col("post_hash")) & F.col("published_at").between(F.col("_from"), F.col("_upto")))
    return j.select("post_hash", "by_post", "object_url", "published_at")


def _clock(time: Column, kind: DataType) -> Column:
    """Seconds that never run back as a time grows; a time without zone is not read in the session's."""
    if isinstance(kind, TimestampNTZType):
        return F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    return F.unix_seconds(time.cast("timestamp"))


def semantic_hint(a: Column, b: Column, common: list[str], least: int = 2) -> Column:
    """Whether two token lists share ``least`` tokens besides the ``common`` ones: a hint, never proof of the same object."""
    shared = F.array_except(F.array_intersect(a, b), F.array(*[F.lit(c) for c in common]).cast("array<string>"))
    return F.size(shared) >= least
