"""Filters, ladders, quotas, poll coverage, flows and converters over evidence tables; each ladder's first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions import text as X


def future_only(df: DataFrame, at: str, started, observed) -> DataFrame:
    """Rows from the start to the observation, both included; what happened before the start is rejected, not counted."""
    return df.where(F.col(at).between(started, observed))


def recent(df: DataFrame, at: str, as_of, interval: str) -> DataFrame:
    """Rows of the interval before ``as_of``, which is given so that a run can be repeated."""
    return df.where(F.col(at) >= F.lit(as_of) - F.expr(f"INTERVAL {interval}"))


def with_source_presence(df: DataFrame, buckets: str, links: str) -> DataFrame:
    """Rows with a bucket or a link."""
    return df.where((F.size(F.coalesce(buckets, F.array())) > 0) | (F.size(F.coalesce(links, F.array())) > 0))


def refresh_targets(df: DataFrame, fetched: str, created: str, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` rows that were never fetched or not for the longest, and one row (seen, truncated): a cut never hides."""
    best = df.orderBy(F.col(fetched).isNotNull(), F.coalesce(fetched, created), created, key).limit(most)
    return best, df.agg(F.count("*").alias("seen")).withColumn("truncated", F.col("seen") > most)


def provenance(wallet: Column, developer: Column) -> Column:
    """EXCLUDED for the developer's own wallet in any case of letters, CLEAR for others, UNVERIFIED without a developer."""
    known = F.coalesce(developer, F.lit("")) != ""
    return F.when(known & (F.lower(wallet) == F.lower(developer)), "DEVELOPER_EXCLUDED").when(known, "DEVELOPER_CLEAR").otherwise("DEVELOPER_UNVERIFIED")


def flow_states(trades: DataFrame, token: str = "token", wallet: str = "wallet", side: str = "side", usd: str = "usd", developer: str = "developer") -> DataFrame:
    """Per token: trades, buyers, sellers and their dollars without the developer's, and the diversity of addresses.

    Purchases are summed per wallet first, which is also the partial aggregation of a hot token. Null dollars count 0."""
    own = X.same_address(F.col(wallet), F.col(developer))
    each = trades.select(F.col(token).alias("token"), F.col(wallet).alias("wallet"), F.col(side).alias("side"), F.coalesce(F.col(usd).cast("double"), F.lit(0.0)).alias("usd"), F.col(developer).alias("developer"), own.alias("own"))
    out = ~F.col("own") & (F.coalesce("wallet", F.lit("")) != "")
    each = each.groupBy("token", "wallet").agg(
        F.count("*").alias("n"), F.sum(F.when(out & (F.col("side") == "buy"), F.col("usd"))).alias("b"), F.sum(F.when(out & (F.col("side") == "sell"), F.col("usd"))).alias("s"), F.bool_or("own").alias("seen"), F.max("developer").alias("developer"),
    )
    flow = each.groupBy("token").agg(
        F.sum("n").alias("trade_count"), F.count("b").alias("distinct_buyers"), F.count("s").alias("distinct_sellers"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("external_buy_usd"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("external_sell_usd"),
        F.when(F.sum("b") != 0, F.max("b") / F.sum("b")).alias("max_buyer_share"), F.bool_or("seen").alias("developer_seen"), F.max("developer").alias("developer"),
    )
    diverse = (F.col("distinct_buyers") >= 5) & (F.col("external_buy_usd") >= 5 * fixed.PROBE_USD) & (F.col("max_buyer_share") <= 0.5)
    state = F.when(F.coalesce("developer", F.lit("")) == "", "DEVELOPER_UNVERIFIED").when(diverse, "ADDRESS_DIVERSE").otherwise("INSUFFICIENT_DIVERSITY")
    return flow.withColumn("address_diversity_state", state).drop("developer")


def wallet_qualification(ledger: DataFrame, wallet: str = "wallet", closed: int = 3, wins: int = 2, rate: float = 0.6, factor: float = 1.5, share: float = 0.7) -> DataFrame:
    """Scores of closed tokens with realised profit and loss, and whether they persist."""
    c = ledger.where("closed")
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    out = c.groupBy(wallet).agg(
        F.count("*").alias("closed_tokens"), F.count_if(F.col("pnl") > 0).alias("profitable_tokens"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.sum("pnl").alias("realized_pnl_usd"),
        F.when(loss > 0, gain / loss).when(gain > 0, 999.0).otherwise(0.0).alias("profit_factor"), F.when(gain > 0, F.max("pnl") / gain).otherwise(1.0).alias("top_winner_share"),
    )
    good = (F.col("closed_tokens") >= closed) & (F.col("profitable_tokens") >= wins) & (F.col("win_rate") >= rate) & (F.col("realized_pnl_usd") > 0) & (F.col("profit_factor") >= factor) & (F.col("top_winner_share") <= share)
    return out.withColumn("state", F.when(good, "QUALIFIED").otherwise("INSUFFICIENT_PERSISTENCE"))


def quota_with_refill(df: DataFrame, group: str, caps: dict[str, int], order: list[Column], most: int, never: str) -> DataFrame:
    """Up to its cap of each group, then whatever is left, but for the group ``never`` refills with, up to ``most`` rows.

    A group that ``caps`` doesn't name has cap 0. The ranks inside a group come first, so only the rows that a cap or the
    limit can still choose reach the one global order."""
    cap = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in caps.items() for x in p]), F.col(group)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    df = df.withColumn("nth", rank).withColumn("refill", F.col("nth") > cap)
    able = df.where(~F.col("refill") | (F.col(group) != never)).where(F.col("nth") <= F.lit(most) + cap)
    return able.orderBy("refill", *order).limit(most).drop("nth", "refill")


def round_robin(df: DataFrame, key: list[str], order: list[Column], lanes: int) -> DataFrame:
    """Adds ``lane``, from 0 in order of the rows of a key."""
    return df.withColumn("lane", F.pmod(F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1, F.lit(lanes)))


def crossing_times(df: DataFrame, key: str, at: str, value: str, tie: str, up: tuple[float, ...] = (3.0, 5.0, 10.0), down: float = 0.65) -> DataFrame:
    """First times at which a key's value reaches multiples of its first, highest and lowest multiple; by two aggregations."""
    base = df.groupBy(key).agg(F.min_by(value, F.struct(at, tie)).alias("base"))
    m = F.try_divide(F.col(value), F.col("base"))
    firsts = [F.min(F.when(m >= u, F.col(at))).alias(f"t{u:g}x") for u in up]
    return df.join(base, key).groupBy(key).agg(*firsts, F.min(F.when(m <= down, F.col(at))).alias("dd35"), F.max(m).alias("high"), F.min(m).alias("low"))


def retention_bucket(request_id: Column, processed_at: Column, created: Column, as_of) -> Column:
    """Ownership of a response: unprocessed, processed, unowned for under two hours, unowned."""
    fresh = created >= F.lit(as_of) - F.expr("INTERVAL 2 HOURS")
    return F.when(request_id.isNotNull() & processed_at.isNull(), "A_UNPROCESSED").when(request_id.isNotNull(), "C_PROCESSED").when(fresh, "B_UNOWNED_RECENT_LT_2H").otherwise("D_UNOWNED_OLD_GE_2H")


def bucket_census(df: DataFrame, bucket: str, size: str, at: str) -> DataFrame:
    """One row: a JSON array, in order of the buckets, of their rows, bytes, oldest and newest; ``[]`` without rows."""
    each = df.groupBy(F.col(bucket).alias("bucket")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min(at).alias("oldest"), F.max(at).alias("newest"))
    return each.agg(F.coalesce(F.to_json(F.sort_array(F.collect_list(F.struct("bucket", "rows", "bytes", "oldest", "newest")))), F.lit("[]")).alias("classification"))


def listing_poll(first: Column, errors: Column, items: Column, overlap: Column) -> Column:
    """OK only if the page reaches the last cursor; UNKNOWN only if an error left nothing; PARTIAL otherwise."""
    return F.when(~first & (overlap >= 0), "OK").when((errors > 0) & (items == 0), "UNKNOWN").otherwise("PARTIAL")


def signature_poll(first: Column, errors: Column, rows: Column, complete: Column) -> Column:
    """A poll that ended with a short page is complete; the first one proves no interval."""
    return F.when((errors > 0) & (rows == 0), "UNKNOWN").when(~complete | first, "PARTIAL").otherwise("OK")


def advances(status: Column, first: Column) -> Column:
    """Whether a listing's cursor moves: at the first poll and after one that reached it."""
    return first | (status == "OK")


def block_range(cursor: Column, head: Column, most: int = 2000, back: int = 120, lag: int = 2) -> Column:
    """(start, end, complete) of the blocks to read: up to ``lag`` below the head, at most ``most``, at first ``back``."""
    target = F.greatest(F.lit(0), head - lag)
    start = F.coalesce(cursor + 1, F.greatest(F.lit(0), target - back))
    end = F.least(target, start + most - 1)
    return F.struct(start.alias("start"), end.alias("end"), ((end >= target) & (start <= end)).alias("complete"))


def buffered(df: DataFrame, cut: str, order: list[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """What a bounded buffer keeps of each cut, and (cut, kept, dropped): what doesn't fit is counted, never just gone."""
    ranked = df.withColumn("nth", F.row_number().over(Window.partitionBy(cut).orderBy(*order)))
    counts = df.groupBy(cut).agg(F.count("*").alias("n")).select(cut, F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))
    return ranked.where(F.col("nth") <= most).drop("nth"), counts


def route_state(probe: Column, out: Column, floor: Column, buy_impact: Column, sell_impact: Column, most: float = 0.03, most_impact: float = 0.02) -> Column:
    """Quoted and worst cost of a round trip, and whether cost and both impacts pass; an unknown impact never does."""
    quoted = F.try_divide(probe - out, probe)
    good = (quoted <= most) & (buy_impact <= most_impact) & (sell_impact <= most_impact)
    return F.struct(quoted.alias("quoted_cost"), F.try_divide(probe - F.coalesce(floor, out), probe).alias("worst_cost"), F.when(F.coalesce(good, F.lit(False)), "ROUTED_QUOTE_PASS").otherwise("ROUTED_QUOTE_FAIL").alias("state"))


def gas_route_state(probe: Column, out: Column, gas_usd: Column, probe_usd: float = fixed.PROBE_USD, slippage_bps: int = 300, most: float = 0.03) -> Column:
    """The same with gas in the cost; the worst case slips twice."""
    quoted = F.try_divide(probe - out, probe) + F.coalesce(gas_usd, F.lit(0.0)) / probe_usd
    return F.struct(quoted.alias("quoted_cost"), (quoted + 2 * slippage_bps / 10_000).alias("worst_cost"), F.when(quoted <= most, "ROUTED_QUOTE_PASS").otherwise("ROUTED_QUOTE_FAIL").alias("state"))


def hard_gate(df: DataFrame, group: str, actor: str, creative: str) -> DataFrame:
    """Actors, creative actors and the largest actor's share of a group, and whether they pass the gate before a launch."""
    each = df.groupBy(group, actor).agg(F.count("*").alias("n"), F.bool_or(creative).alias("c"))
    out = each.groupBy(group).agg(F.count(actor).alias("actors"), F.count_if("c").alias("creative_actors"), (F.max("n") / F.sum("n")).alias("dominance"))
    return out.withColumn("passes", (F.col("actors") >= 3) & (F.col("creative_actors") >= 2) & (F.col("dominance") <= 0.67))


def matched_sample(df: DataFrame, stratum: list[str], case: str, key: str, most: int) -> DataFrame:
    """Up to ``most`` cases and as many controls of each stratum, in the order of a hash: the same rows in every run."""
    w = Window.partitionBy(*stratum, case).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def tape_quality(df: DataFrame, at: str, cadence: int, slack: int = 30, most_gap: int = 300, key: str | None = None) -> DataFrame:
    """Share of cuts within ``slack`` seconds of the cadence, the longest gap, and whether the tape is sound, per ``key``."""
    own = [key] if key else []
    gap = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    d = df.select(*own, gap.alias("s")).withColumn("gap", F.col("s") - F.lag("s").over(Window.partitionBy(*own).orderBy("s"))).where(F.col("gap").isNotNull())
    out = d.groupBy(*own).agg(F.avg((F.abs(F.col("gap") - cadence) <= slack).cast("double")).alias("on_time"), F.max("gap").alias("longest_gap"))
    return out.withColumn("sound", (F.col("on_time") >= 0.95) & (F.col("longest_gap") <= most_gap))


def outcome_labels(cases: DataFrame, obs: DataFrame, key: str, at: str, value: str, horizons: dict[str, str], levels: dict[str, float]) -> DataFrame:
    """For each case (key, ``at``): per horizon the best level that an observation in it reaches; null without one."""
    o = obs.select(F.col(key).alias("okey"), F.col(at).alias("oat"), F.col(value).alias("v"))
    j = cases.join(o, (F.col(key) == F.col("okey")) & (F.col("oat") >= F.col(at)), "left")
    best = [F.max(F.when(F.col("oat") <= F.col(at) + F.expr(f"INTERVAL {span}"), F.col("v"))).alias(f"best_{name}") for name, span in horizons.items()]
    out = j.groupBy(key, at).agg(*best)
    for name in horizons:
        label = F.lit(None).cast("string")
        for level, least in sorted(levels.items(), key=lambda x: x[1]):
            label = F.when(F.col(f"best_{name}") >= least, level).otherwise(label)
        out = out.withColumn(f"label_{name}", F.when(F.col(f"best_{name}").isNotNull(), F.coalesce(label, F.lit("Y0"))))
    return out


def wallet_trades(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Trades of pool pages (network, pool_id, token_id, developer, payload): side-aware amount and price; rows that lack an
    id, wallet, time, amount or dollars, or have 0 of these, are no evidence and go."""
    kind = "struct<data:array<struct<id:string,attributes:struct<kind:string,tx_from_address:string,block_timestamp:string,to_token_address:string,from_token_address:string,to_token_amount:string,from_token_amount:string,price_to_in_usd:string,price_from_in_usd:string,volume_in_usd:string>>>>"
    a = F.col("x.attributes")
    rows = payloads.withColumn("x", F.explode(F.from_json(payload, kind)["data"])).withColumn("base", F.regexp_replace("token_id", "^[^_]*_", ""))
    side = F.lower(a["kind"])
    buy, sell = (side == "buy") & X.same_address(a["to_token_address"], F.col("base")), (side == "sell") & X.same_address(a["from_token_address"], F.col("base"))
    pick = lambda x, y: F.when(buy, a[x].try_cast("double")).when(sell, a[y].try_cast("double"))
    rows = rows.select(F.col("x.id").alias("trade_id"), "network", "pool_id", "token_id", a["tx_from_address"].alias("wallet"), a["block_timestamp"].alias("block_timestamp"), F.when(buy | sell, side).alias("kind"), pick("to_token_amount", "from_token_amount").alias("token_amount"), a["volume_in_usd"].try_cast("double").alias("usd_value"), pick("price_to_in_usd", "price_from_in_usd").alias("token_price_usd"), F.col("developer").alias("developer_address"))
    return rows.where((F.coalesce("trade_id", F.lit("")) != "") & (F.coalesce("wallet", F.lit("")) != "") & (F.coalesce("block_timestamp", F.lit("")) != "") & F.col("kind").isNotNull() & (F.coalesce("token_amount", F.lit(0.0)) != 0) & (F.coalesce("usd_value", F.lit(0.0)) != 0))


def token_info(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Holder and authority facts of token pages; what a page doesn't say is null, not 0, and ``unknown`` for the trap."""
    a = "$.data.attributes."
    say = lambda path: F.get_json_object(payload, a + path)
    return payloads.withColumns({"developer": say("developer_address"), "holders_count": say("holders.count").try_cast("long"), "top10_pct": say("holders.distribution_percentage.top_10").try_cast("double"), "mint_authority": say("mint_authority"), "freeze_authority": say("freeze_authority"), "honeypot": F.coalesce(say("is_honeypot"), F.lit("unknown")), "description": F.coalesce(say("description"), F.lit(""))})


def feed_commits(events: DataFrame, payload: str = "payload") -> DataFrame:
    """(did, post_id, text) of created or updated posts, whichever of the two wire shapes carries them."""
    at = lambda path: F.get_json_object(payload, path)
    typed = at("$.$type")
    inner = F.when(typed == "message", "$.payload").otherwise("$")
    rows = events.withColumn("shape", F.when(at("$.kind") == "commit", "commit").when(F.when(inner == "$.payload", at("$.payload.$type")).otherwise(typed).endswith("#commit"), inner))
    pick = lambda c, p, r: F.when(F.col("shape") == "commit", at(c)).when(F.col("shape") == "$.payload", at(p)).otherwise(at(r))
    field = lambda name: pick(f"$.commit.{name}", f"$.payload.{name}", f"$.{name}")
    did, key = pick("$.did", "$.payload.did", "$.did"), field("rkey")
    good = F.col("shape").isNotNull() & (field("collection") == "app.bsky.feed.post") & F.coalesce(field("operation").isin("create", "update"), F.lit(True))
    return rows.where(good).select(did.alias("did"), F.concat(F.lit("at://"), did, F.lit("/app.bsky.feed.post/"), key).alias("post_id"), field("record.text").alias("text"))
