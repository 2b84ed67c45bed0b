"""Small summaries of large tables: state counts as one JSON text, turnover of a launch's first minutes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_summary(df: DataFrame, state: Column, version: str, totals: dict[str, Column] | None = None) -> DataFrame:
    """One row with ``summary``: JSON of the version, the number of rows, aggregates of ``totals`` and the rows of each state,
    states sorted. A null state is ``UNKNOWN``; an empty table has the states ``{}``. Counts come first, so that what one
    task gathers is a row a state."""
    totals = totals or {}
    parts = df.groupBy(F.coalesce(state, F.lit("UNKNOWN")).alias("_state")).agg(F.count("*").alias("_n"), *[c.alias(f"_t{i}") for i, c in enumerate(totals.values())])
    entries = F.array_sort(F.collect_list(F.struct("_state", "_n")))
    counts = F.when(F.count("*") > 0, F.to_json(F.map_from_entries(entries))).otherwise("{}")
    texts = [F.format_string('"%s":%s,', F.lit(n), F.coalesce(F.sum(f"_t{i}"), F.lit(0)).cast("string")) for i, n in enumerate(totals)]
    return parts.agg(F.concat(F.lit(f'{{"version":"{version}","rows":'), F.coalesce(F.sum("_n"), F.lit(0)).cast("string"), F.lit(","), *texts, F.lit('"states":'), counts, F.lit("}")).alias("summary"))


def first_turnover(launches: DataFrame, trades: DataFrame, key: str, at: str, wallet: str, usd: str, created: str, creator: str, length_us: int = 300_000_000) -> DataFrame:
    """(key, trades, gross, addresses, creator_share, largest_share) of each launch's trades from its creation on, before
    ``length_us`` microseconds are over. Launches without a trade have 0 and null shares; trades without a wallet count in trades
    and gross only, those without an amount as 0. Times are microseconds. ``launches`` has a row a key.

    Wallets are summed before keys, so a hot key's trades are added up where they are read and its wallets are many rows."""
    inside = trades.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.col(wallet).alias("_w"), F.coalesce(F.col(usd), F.lit(0.0)).alias("_usd"))
    own = launches.select(key, F.col(created).alias("_from"), F.col(creator).alias("_by"))
    near = own.join(inside, (F.col(key) == F.col("_k")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + length_us), "left")
    by_wallet = near.groupBy(key, "_by", "_w").agg(F.count("_k").alias("n"), F.sum("_usd").alias("usd"))
    out = by_wallet.groupBy(key).agg(
        F.sum("n").alias("trades"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("gross"), F.count("_w").alias("addresses"),
        F.coalesce(F.sum(F.when(F.col("_w") == F.col("_by"), F.col("usd"))), F.lit(0.0)).alias("_own"), F.max(F.when(F.col("_w").isNotNull(), F.col("usd"))).alias("_top"),
    )
    share = lambda c: F.when(F.col("gross") > 0, F.col(c) / F.col("gross"))
    return out.select(key, "trades", "gross", "addresses", share("_own").alias("creator_share"), share("_top").alias("largest_share"))
