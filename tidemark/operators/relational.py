"""Ranking, quota, latest-per-key, ledger and ladder operators as DataFrame transforms; every rank has a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.ordered import ordered_fold


def latest_per_key(df: DataFrame, key: str, order: list[Column], cols: list[str]) -> DataFrame:
    """The row of the greatest ``order`` of each key, by one aggregation (no sort, no window)."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(key, "r.*")


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def two_level_quota(df: DataFrame, group: str, linked: str, order: list[Column], cap: int, share: float = 0.65) -> DataFrame:
    """Up to ``cap`` rows a group: bround(cap * share) linked ones first, then unlinked ones, then whatever is left."""
    first = int(round(cap * share))
    w = Window.partitionBy(group, linked).orderBy(*order)
    df = df.withColumn("_r", F.row_number().over(w)).withColumn("_tier", F.when(F.col(linked) & (F.col("_r") <= first), 0).when(~F.col(linked) & (F.col("_r") <= cap - first), 1).otherwise(2))
    v = Window.partitionBy(group).orderBy("_tier", *order)
    return df.withColumn("_n", F.row_number().over(v)).where(F.col("_n") <= cap).drop("_r", "_tier", "_n")


def trade_flow(df: DataFrame, token: str, wallet: str, side: str, usd: str) -> DataFrame:
    """Per token: distinct buyers and sellers, sums, and the largest buyer's share (null without buys)."""
    each = df.groupBy(token, wallet).agg(F.sum(F.when(F.col(side) == "buy", F.col(usd))).alias("b"), F.sum(F.when(F.col(side) == "sell", F.col(usd))).alias("s"))
    return each.groupBy(token).agg(F.count("b").alias("buyers"), F.count("s").alias("sellers"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("buy_usd"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("sell_usd"), F.try_divide(F.max("b"), F.sum("b")).alias("max_buyer_share"))


def _cost_step(state: tuple, row: tuple) -> tuple[tuple, None]:
    held, cost, bought, sold, pnl = state
    side, amount, usd = row
    if side == "buy":
        return (held + amount, cost + usd, bought + amount, sold, pnl), None
    take = min(amount, held)
    basis = cost * take / held if held > 0 else 0.0
    return (held - take, cost - basis, bought, sold + take, pnl + usd * take / amount - basis), None


def average_cost(df: DataFrame, keys: list[str], ts: str, tie: str, side: str, amount: str, usd: str) -> DataFrame:
    """Ordered average-cost fold of each key's trades: a sale takes what is held at most, at the average cost so far.
    Closed if at least half of what was bought is sold. A trade without an amount or dollars, or with none above 0, is
    skipped, and a key without any other has zeros. A task holds one trade and one key's five sums."""
    able = F.coalesce((F.col(amount) > 0) & (F.col(usd) > 0), F.lit(False))
    rows = df.select(*keys, F.col(ts).alias("_t"), F.col(tie).alias("_i"), F.when(able, F.col(side)).alias("_k"), F.col(amount).cast("double").alias("_a"), F.col(usd).cast("double").alias("_u"))
    step = lambda s, x: _cost_step(s, x) if x[0] is not None else (s, None)
    out = ordered_fold(rows, keys, ["_t", "_i"], ["_k", "_a", "_u"], "bought double, sold double, pnl double", lambda: (0.0,) * 5, step, lambda s: s[2:])
    return out.withColumn("closed", F.coalesce(F.try_divide("sold", "bought"), F.lit(0.0)) >= 0.5)


def wallet_scores(ledger: DataFrame, wallet: str) -> DataFrame:
    """Closed tokens, wins, win rate, profit factor (999 without a loss, 0 without either) and the top winner's share (1 by default)."""
    c = ledger.where("closed")
    gain, loss = F.sum(F.greatest("pnl", F.lit(0.0))), -F.sum(F.least("pnl", F.lit(0.0)))
    return c.groupBy(wallet).agg(
        F.count("*").alias("closed_n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, 999.0).otherwise(0.0).alias("profit_factor"), F.coalesce(F.try_divide(F.max(F.greatest("pnl", F.lit(0.0))), gain), F.lit(1.0)).alias("top_share"),
    )


def launch_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """State: the boundary and the last cut; row: (cut, oldest, newest, error). A cut that isn't after the last one is LATE_CUT."""
    edge, last = state
    cut, oldest, newest, error = row
    if last is not None and cut <= last:
        return state, (cut, "LATE_CUT", edge)
    if error or oldest is None or newest is None:
        name = "SOURCE_ERROR"
    elif edge is None:
        name, edge = "BASELINE_ONLY", newest
    elif oldest <= edge <= newest:
        name, edge = "COMPLETE_INTERVAL", newest
    else:
        name = "GAP"
    return (edge, cut), (cut, name, edge)


def launch_coverage(cuts: DataFrame, stream: str, order: str, oldest: str, newest: str, error: str) -> DataFrame:
    """State of each cut: SOURCE_ERROR (also without entries), BASELINE_ONLY, COMPLETE_INTERVAL if the boundary lies in it, else
    GAP. Only a baseline or a complete cut moves the boundary to its newest entry. A fold over one stream's cuts, a cut at a time."""
    rows = cuts.select(stream, F.col(order).cast("long").alias("_o"), F.col(oldest).cast("long").alias("_a"), F.col(newest).cast("long").alias("_b"), F.coalesce(F.col(error), F.lit(False)).alias("_e"))
    return ordered_fold(rows, [stream], ["_o"], ["_o", "_a", "_b", "_e"], f"`{order}` long, state string, boundary long", lambda: (None, None), launch_step)


def family_lane(births: DataFrame, econ: DataFrame, veto: list[str] | None = None, as_of=None, hours: int = 48) -> DataFrame:
    """Families of births by shared token: counts, fees, leader and lane state; births need (mint, name, symbol,
    created_at, identity, external, backfill, tokens), econ (mint, observed_at, fee). With ``as_of`` only births of the
    ``hours`` before it count."""
    if as_of is not None:
        births = births.where(F.col("created_at") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    fees = latest_per_key(econ.where(F.col("fee").isNotNull()), "mint", [F.col("observed_at"), F.col("fee")], ["fee"])
    each = births.join(fees, "mint", "left").withColumn("family_key", F.explode("tokens")).withColumn("f", F.coalesce("fee", F.lit(0.0)))
    # The group limit leaves two rows of a family in each task before the shuffle, however large the family.
    two = each.select("family_key", "f", "mint").withColumn("nth", F.row_number().over(Window.partitionBy("family_key").orderBy(F.desc("f"), "mint"))).where(F.col("nth") <= 2)
    second = two.where(F.col("nth") == 2).select("family_key", F.col("f").alias("second_fee"))
    agg = each.groupBy("family_key").agg(
        F.count("*").alias("births"), F.countDistinct(F.lower("name")).alias("unique_names"), F.countDistinct(F.lower("symbol")).alias("unique_symbols"), F.count_if("identity").alias("identity_n"), F.count_if("external").alias("external_n"),
        F.max("f").alias("leader_fee"), F.sum("f").alias("total_fee"), F.count_if(F.col("f") >= 5000).alias("n5"), F.count_if(F.col("fee") < 1000).alias("nlt1"),
        F.max_by("mint", F.struct(F.col("f"), -F.unix_micros("created_at"), -F.col("mint"))).alias("leader_mint"), F.bool_or("backfill").alias("backfill_contaminated"),
    ).where(F.col("births") >= 3).join(second, "family_key", "left")
    names, ident = F.col("unique_names") / F.col("births"), F.col("identity_n") / F.col("births")
    state = (
        F.when(F.col("family_key").isin(veto or []), "VETO")
        .when((F.col("births") >= 4) & (F.col("leader_fee") >= 10000) & (names >= 0.55) & (ident >= 0.5) & (F.col("second_fee") >= 1000) & ((F.col("external_n") >= 1) | (F.col("leader_fee") >= 25000)), "FAMILY_EXPANSION_STRONG")
        .when((F.col("births") >= 3) & (F.col("leader_fee") >= 5000) & (names >= 0.45) & (ident >= 0.35), "FAMILY_EXPANSION_WATCH")
        .when((F.col("births") >= 5) & (names < 0.35), "COPY_SPAM_VETO").otherwise("SHADOW")
    )
    return agg.withColumn("lane_state", state)


def interval_token_join(events: DataFrame, pools: DataFrame, hours: int = 48, least: float = 0.72) -> DataFrame:
    """(event_id, pool_id, score) of pairs that ``match_score`` gives ``least`` or more, the pool created up to ``hours`` after the event.

    events need (event_id, published, phrase, tokens), pools (pool_id, created, phrase, tokens); phrase is the normalised
    title or base name, and an empty or null one matches nothing. Equi-joins on tokens and on equal phrases, then the interval."""
    side = lambda df, key, time, p: df.where(F.col("phrase") != "").select(key, F.unix_micros(F.col(time).cast("timestamp")).alias(time), F.col("phrase").alias(f"{p}_phrase"), F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias(f"{p}_tokens"))
    e, p = side(events, "event_id", "published", "e"), side(pools, "pool_id", "created", "p")
    by_token = e.withColumn("token", F.explode("e_tokens")).join(p.withColumn("token", F.explode("p_tokens")), "token").drop("token")
    by_phrase = e.join(p, F.col("e_phrase") == F.col("p_phrase"))
    both = by_token.unionByName(by_phrase).where((F.col("created") - F.col("published")).between(0, hours * 3_600_000_000))
    score = X.match_score(F.col("e_phrase"), F.col("p_phrase"), F.col("e_tokens"), F.col("p_tokens"))
    return both.withColumn("score", score).where(F.col("score") >= least).groupBy("event_id", "pool_id").agg(F.max("score").alias("score"))
