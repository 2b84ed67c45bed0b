"""Queries of as-of joins, panes and folds over the driver's tables, with their SQL; stand-ins as in ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ordered as R
from tidemark.plans.registry import query, t

# Orders of seven years stand for state changes within the month of the events: their time runs 80 times as fast.
_ORDERS = "o AS (SELECT o_custkey % 150 AS user_id, o_orderkey, o_totalprice, 1704067200000000 + (epoch_us(o_orderdate) - 788918400000000) // 80 AS us FROM orders)"


@query(f"""WITH {_ORDERS}, one AS (SELECT user_id, us, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM o GROUP BY 1, 2),
e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events)
SELECT e.event_id, e.user_id, e.us, one.us AS asof_us, one.o_orderkey AS asof_o_orderkey, one.o_totalprice AS asof_o_totalprice FROM e ASOF LEFT JOIN one ON e.user_id = one.user_id AND e.us >= one.us""")
def asof_orders(spark, d):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    o = t(spark, d, "orders").select((F.col("o_custkey") % 150).alias("user_id"), "o_orderkey", "o_totalprice", (F.lit(1704067200000000) + F.floor((us("o_orderdate") - 788918400000000) / 80)).alias("us"))
    return R.asof_join(t(spark, d, "events").select("event_id", "user_id", us("ts").alias("us")), o, "user_id", "us", "us", "o_orderkey", ["us", "o_orderkey", "o_totalprice"])


def _panes_sql(lengths: dict[str, int]) -> str:
    cols = []
    for name, m in lengths.items():
        now, prior = f"sum(n) FILTER (p.pane - a.pane < {m})", f"coalesce(sum(n) FILTER (p.pane - a.pane >= {m} AND p.pane - a.pane < {2 * m}), 0)"
        top = f"(SELECT max(c) FROM (SELECT sum(n) AS c FROM a AS b WHERE b.k = p.k AND b.pane BETWEEN p.pane - {m - 1} AND p.pane AND actor IS NOT NULL GROUP BY actor))"
        cols += [f"CAST({now} AS BIGINT) AS n_{name}", f"CAST({prior} AS BIGINT) AS prior_{name}", f"{now} / nullif({prior}, 0) AS acceleration_{name}", f"count(DISTINCT actor) FILTER (p.pane - a.pane < {m}) AS members_{name}", f"{top} / {now} AS dominance_{name}"]
    return f"""WITH a AS (SELECT event_type AS k, epoch_us(ts) // 300000000 AS pane, user_id AS actor, count(*) AS n FROM events GROUP BY 1, 2, 3), s AS (SELECT DISTINCT k, pane FROM a)
SELECT p.k AS event_type, p.pane, {", ".join(cols)} FROM s AS p JOIN a ON a.k = p.k AND a.pane BETWEEN p.pane - {2 * max(lengths.values()) - 1} AND p.pane GROUP BY p.k, p.pane"""


_LENGTHS = {"5m": 1, "15m": 3, "30m": 6}


@query(_panes_sql(_LENGTHS))
def window_features(spark, d):
    return R.pane_features(t(spark, d, "events"), "event_type", "user_id", "ts", _LENGTHS)
