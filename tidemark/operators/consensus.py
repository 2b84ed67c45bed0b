"""Wallet consensus and family baskets: joins, windows and aggregates; one fold per family where order decides."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_state(network: Column, honeypot: Column, top10_pct: Column, mint_authority: Column, freeze_authority: Column, holders: Column) -> Column:
    """VETO, UNVERIFIED if a fact is missing, else PROXY_PASS; the first that holds."""
    trap = F.lower(F.coalesce(honeypot.cast("string"), F.lit("unknown")))
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when((trap == "true") | (F.coalesce(top10_pct, F.lit(0.0)) >= 90), "VETO").when((network == "solana") & (named(mint_authority) | named(freeze_authority)), "VETO").when(holders.isNull() | (trap == "unknown"), "UNVERIFIED").otherwise("PROXY_PASS")


def family_state(geos: Column, news_sources: Column, tokens: Column, developers: Column) -> Column:
    """State of a family from its distinct counts; two geographies or two news sources verify the source."""
    return F.when(~((geos >= 2) | (news_sources >= 2)), "SOURCE_UNVERIFIED").when(tokens < 2, "TOKEN_FAMILY_TOO_SMALL").when(developers < 2, "DEPLOYER_UNVERIFIED").otherwise("FROZEN")


def consensus_signals(candidates: DataFrame, buys: DataFrame, qualified: DataFrame, identities: DataFrame, as_of, least: int = 3, roots: int = 3, most_share: float = 0.5, most_move: float = 3.0) -> DataFrame:
    """A signal per candidate (network, pool_id, token_id, price, first_price, route_state, contract_state).

    Only wallets qualified strictly before ``as_of`` count, so that a cut never judges by itself. Buys are summed per
    wallet before they meet the candidates; what is unknown never passes."""
    able = qualified.where((F.col("state") == "QUALIFIED") & (F.col("qualified_at") < as_of)).select("network", "wallet")
    known = identities.where((F.col("provenance_state") == "INDEPENDENT_VERIFIED") & F.col("funding_root").isNotNull()).groupBy("network", "wallet").agg(F.min("funding_root").alias("root"))
    each = buys.join(able, ["network", "wallet"], "left_semi").groupBy("network", "token_id", "wallet").agg(F.sum("usd").alias("usd")).join(known, ["network", "wallet"], "left")
    flow = each.groupBy("network", "token_id").agg(F.count("*").alias("wallets"), F.count("root").alias("verified"), F.countDistinct("root").alias("roots"), F.sum("usd").alias("total_usd"), F.try_divide(F.max("usd"), F.sum("usd")).alias("top_share"))
    out = candidates.join(flow, ["network", "token_id"], "left").fillna(0, ["wallets", "verified", "roots", "total_usd"])
    move = F.try_divide(F.col("price"), F.coalesce("first_price", "price"))
    state = (
        F.when(F.col("wallets") < least, "NO_CONSENSUS").when((F.col("roots") < roots) | (F.col("verified") < least), "CONSENSUS_INDEPENDENCE_UNVERIFIED")
        .when(F.col("top_share").isNull() | (F.col("top_share") > most_share), "CONSENSUS_CONCENTRATED").when(F.col("move").isNull() | (F.col("move") > most_move), "MOVE_CONSUMED_OR_UNKNOWN")
        .when(~(F.col("route_state").eqNullSafe(F.lit("ROUTED_QUOTE_PASS")) & F.col("contract_state").eqNullSafe(F.lit("PROXY_PASS"))), "CONSENSUS_PENDING_EXECUTION").otherwise("PAPER_PROBE_CANDIDATE")
    )
    return out.withColumn("move", move).withColumn("signal_state", state)


def with_shares(obs: DataFrame) -> DataFrame:
    """Adds each member's share of its family's purchases and buyers in the same cut; 0 where the family has none."""
    w = Window.partitionBy("family_id", "cut")
    for c, out in (("buy_usd", "buy_share"), ("buyers", "buyer_share")):
        v = F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        total = F.sum(v).over(w)
        obs = obs.withColumn(out, F.when(total > 0, v / total).otherwise(0.0))
    return obs


BASKET_EVENTS = "family_id string, event string, cut long, pool_id string, value_usd double, units double, siblings_down long"


def family_baskets(obs: DataFrame, budget: float = 50.0, most: int = 3, cost_cap: float = 3.0, buyer_cap: float = 0.35, least_gain: float = 0.05, route_ok: str = "ROUTE_PASS") -> DataFrame:
    """Events of each family's paper basket: OPEN per member, then at most one ROTATE into the leader.

    ``obs``: family_id, cut, network, pool_id, rank, score, price, execution, contract, cost_pct, buyers, buy_usd,
    sell_usd, max_buyer_share, diversity. A basket opens in the first cut with two executable members. It rotates when
    the same leader ranks first in consecutive cuts, gains buyers and share while a sibling loses share, and every
    position has a value. Shares and eligibility are columns; only the narrow rows of one family reach the fold."""
    able = (F.col("price") > 0) & (F.col("execution") == route_ok) & (F.col("contract") == "PROXY_PASS") & F.col("cost_pct").between(0, cost_cap)
    lead = (F.col("rank") == 1) & able & (F.col("diversity") == "ADDRESS_DIVERSE") & (F.col("buyers") >= 2) & (F.coalesce("buy_usd", F.lit(0.0)) > F.coalesce("sell_usd", F.lit(0.0))) & (F.col("max_buyer_share") <= buyer_cap)
    no = F.lit(False)
    keep = F.when(F.col("cost_pct").between(0, cost_cap), 1 - F.col("cost_pct") / 100)
    narrow = with_shares(obs).select("family_id", F.col("cut").cast("long").alias("cut"), "network", "pool_id", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("price").cast("double").alias("price"), keep.alias("left"), F.coalesce("buyers", F.lit(0)).alias("buyers"), "buy_share", "buyer_share", F.coalesce(able, no).alias("able"), F.coalesce(lead, no).alias("lead"))

    def fold(family: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_basket(family, budget, most, least_gain)), columns=[c.split()[0] for c in BASKET_EVENTS.split(", ")])

    return narrow.groupBy("family_id").applyInPandas(fold, BASKET_EVENTS)


def _basket(family: pd.DataFrame, budget: float, most: int, least_gain: float) -> Iterator[tuple]:
    held: dict[tuple, float] = {}
    before: pd.DataFrame | None = None
    name = family["family_id"].iloc[0]
    for cut, rows in family.groupby("cut", sort=True):
        now = rows.set_index(["network", "pool_id"])
        if not held:
            best = now[now["able"]].sort_values(["score", "network", "pool_id"], ascending=[False, True, True])
            if len(best) < 2:
                continue
            best = best.head(most)
            for key, r in best.iterrows():
                held[key] = budget / len(best) * r["left"] / r["price"]
                yield name, "OPEN", cut, key[1], budget / len(best), held[key], None
        last, before = before, now
        leaders = now[now["lead"]]
        if last is None or leaders.empty or leaders.index[0] not in last.index:
            continue
        key, new, old = leaders.index[0], leaders.iloc[0], last.loc[leaders.index[0]]
        grown = old["rank"] == 1 and new["buyers"] > old["buyers"] and new["buy_share"] - old["buy_share"] >= least_gain and new["buyer_share"] >= old["buyer_share"]
        both = now.join(last[["buy_share"]], rsuffix="_old", how="inner")
        down = int(((both["buy_share"] < both["buy_share_old"]) & (both.index.get_level_values("pool_id") != key[1])).sum())
        if not grown or not down or any(k not in now.index or not now.loc[k, "price"] > 0 or pd.isna(now.loc[k, "left"]) for k in held):
            continue
        value = sum(u * now.loc[k, "price"] * now.loc[k, "left"] for k, u in held.items())
        yield name, "ROTATE", cut, key[1], value, value * new["left"] / new["price"], down
        return
