"""Fail-closed audits over nested JSON: an ordered ladder of reasons, or a sorted set of them. No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Programs, mints and log lines that the audited transactions carry.
AMM_PROGRAM = "pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA"
WRAPPED_SOL = "So11111111111111111111111111111111111111112"
COLLECT_LOG = "Instruction: CollectCoinCreatorFee"
FEES_LOG = "Instruction: GetFeesWithQuoteMint"

#: Keys and parsed instructions come as text or objects, so both are read as text first.
TRANSACTION = (
    "struct<blockTime:bigint,transaction:struct<message:struct<accountKeys:array<string>,instructions:array<struct<programId:string,parsed:string>>>>,"
    "meta:struct<err:string,fee:bigint,logMessages:array<string>,preBalances:array<bigint>,postBalances:array<bigint>,preTokenBalances:array<struct<mint:string>>,"
    "postTokenBalances:array<struct<mint:string>>,innerInstructions:array<struct<instructions:array<struct<program:string,parsed:string>>>>>>"
)
PARSED = "struct<type:string,info:struct<account:string,mint:string,source:string,destination:string,authority:string,tokenAmount:string>>"


_INNER = f"innerInstructions:array<struct<instructions:array<struct<program:string,parsed:{PARSED}>>>>"
#: What an audit needs, in the usual form, where keys and parsed instructions are objects: one pass over the text reads it.
RECEIPT = (
    f"struct<transaction:struct<message:struct<accountKeys:array<struct<pubkey:string>>,instructions:array<struct<programId:string,parsed:{PARSED}>>>>,"
    f"meta:struct<err:string,fee:bigint,logMessages:array<string>,preBalances:array<bigint>,postBalances:array<bigint>,{_INNER}>,_odd:string>"
)
FLOW = (
    "struct<transaction:struct<message:struct<accountKeys:array<struct<pubkey:string>>>>,"
    f"meta:struct<err:string,logMessages:array<string>,preTokenBalances:array<struct<mint:string>>,postTokenBalances:array<struct<mint:string>>,{_INNER}>,_odd:string>"
)


def _either(usual, text) -> Column:
    """``usual(_t)``; where the text has another form (``_odd``), ``text(_o)`` of the one whose keys and instructions are read as text."""
    return F.when(F.col("_t._odd").isNull(), usual(F.col("_t"))).otherwise(text(F.col("_o")))


def _moves(kept) -> Column:
    """Amounts of the checked token transfers that ``kept`` picks by mint, source, destination and authority."""
    inner = lambda t: F.flatten(F.filter(t["meta"]["innerInstructions"]["instructions"], lambda x: x.isNotNull()))
    checked = lambda p: (p["type"] == "transferChecked") & kept(p["info"])
    usual = lambda t: F.transform(F.filter(inner(t), lambda i: (i["program"] == "spl-token") & checked(i["parsed"])), lambda i: i["parsed"]["info"]["tokenAmount"])
    text = lambda t: F.transform(F.filter(F.transform(F.filter(inner(t), lambda i: i["program"] == "spl-token"), lambda i: F.from_json(i["parsed"], PARSED)), checked), lambda p: p["info"]["tokenAmount"])
    # Amounts count only as decimal strings.
    amounts = F.transform(_either(usual, text), lambda x: F.regexp_extract(x, r'"amount"\s*:\s*"(\d+)"', 1).try_cast("bigint"))
    return F.coalesce(F.array_compact(amounts), F.array().cast("array<bigint>"))


def _parsed(df: DataFrame, tx: str, usual: str) -> DataFrame:
    df = df.withColumn("_t", F.from_json(tx, usual, {"columnNameOfCorruptRecord": "_odd"}))
    df = df.withColumn("_o", F.when(F.col("_t._odd").isNotNull(), F.from_json(tx, TRANSACTION)))
    text = lambda t: F.transform(t["transaction"]["message"]["accountKeys"], lambda k: F.coalesce(F.get_json_object(k, "$.pubkey"), k))
    return df.withColumn("_keys", F.coalesce(_either(lambda t: t["transaction"]["message"]["accountKeys"]["pubkey"], text), F.array().cast("array<string>")))


def _meta(name: str) -> Column:
    return _either(*[lambda t: t["meta"][name]] * 2)


def _failed() -> Column:
    return _either(*[lambda t: (t["transaction"].isNull() & t["meta"].isNull()) | t["meta"]["err"].isNotNull() | t.isNull()] * 2)


def _logged(line: str) -> Column:
    return F.coalesce(F.exists(_meta("logMessages"), lambda x: x.contains(line)), F.lit(False))


def creator_receipt(df: DataFrame, tx: str = "tx", creator: str = "creator") -> DataFrame:
    """Adds reason (null if verified), classification, amount, wallet_delta and fee for transactions as JSON text.

    Verified: exactly one transfer into a wrapped account that is closed to the creator, and amount - delta == fee to
    the unit. Anything unknown or malformed stays UNVERIFIED with the first reason that holds."""
    df = _parsed(df, tx, RECEIPT).withColumn("_at", F.coalesce(F.array_position("_keys", F.col(creator)), F.lit(0)).cast("int"))
    outer = lambda t: t["transaction"]["message"]["instructions"]
    closing = _either(lambda t: outer(t)["parsed"], lambda t: F.transform(outer(t), lambda i: F.from_json(i["parsed"], PARSED)))
    df = df.withColumn("_closed", F.coalesce(F.transform(F.filter(closing, lambda p: (p["type"] == "closeAccount") & (p["info"]["destination"] == F.col(creator))), lambda p: p["info"]["account"]), F.array().cast("array<string>")))
    df = df.withColumn("_own", _moves(lambda x: (x["mint"] == WRAPPED_SOL) & F.array_contains("_closed", x["destination"])))
    before, after = (F.get(_meta(c), F.col("_at") - 1) for c in ("preBalances", "postBalances"))
    df = df.withColumn("amount", F.when(F.size("_own") == 1, F.get("_own", F.lit(0)))).withColumn("wallet_delta", after - before).withColumn("fee", _meta("fee"))
    program = F.coalesce(F.array_contains(_either(*[lambda t: outer(t)["programId"]] * 2), AMM_PROGRAM), F.lit(False))
    reason = (
        F.when(_failed(), "transaction unavailable or failed").when(F.col("_at") == 0, "creator not in account keys").when(~program, "Pump AMM program absent")
        .when(~_logged(COLLECT_LOG), "creator fee collection log absent").when(F.size("_own") != 1, "expected exactly one vault-to-closed-WSOL transfer")
        .when(F.col("wallet_delta").isNull(), "missing creator balances")
        .when((F.col("wallet_delta") <= 0) | F.col("fee").isNull() | (F.col("amount") - F.col("wallet_delta") != F.col("fee")), "claim amount, wallet credit and fee do not reconcile")
    )
    df = df.withColumn("reason", reason).withColumn("classification", F.when(F.col("reason").isNull(), "VERIFIED_CREATOR_LEVEL_AMM_FEE_RECEIPT").otherwise("UNVERIFIED"))
    return df.drop("_t", "_o", "_keys", "_at", "_closed", "_own")


def pool_fee_flow(df: DataFrame, tx: str = "tx", pool: str = "pool", mint: str = "mint", vault: str = "vault", owner: str = "owner") -> DataFrame:
    """Adds reason (null if verified), classification and fee_amount: exactly one positive transfer from pool to vault."""
    df = _parsed(df, tx, FLOW)
    mints = F.concat(*[F.coalesce(_either(*[lambda t, c=c: t["meta"][c]["mint"]] * 2), F.array().cast("array<string>")) for c in ("preTokenBalances", "postTokenBalances")])
    has = lambda a, c: F.coalesce(F.array_contains(a, F.col(c)), F.lit(False))
    absent = (
        F.when(~F.col(owner).eqNullSafe(F.lit(AMM_PROGRAM)), "pool is not owned by Pump AMM").when(_failed(), "transaction unavailable or failed")
        .when(~(has("_keys", pool) & has(mints, mint) & has("_keys", vault)), "pool, mint or vault absent in transaction")
        .when(~_logged(FEES_LOG), "Pump AMM fee calculation log absent")
    )
    df = df.withColumn("_absent", absent)
    own = _moves(lambda x: (x["mint"] == WRAPPED_SOL) & (x["authority"] == F.col(pool)) & (x["destination"] == F.col(vault)))
    df = df.withColumn("_own", F.when(F.col("_absent").isNull(), own))
    amount = F.when(F.size("_own") == 1, F.get("_own", F.lit(0)))
    df = df.withColumn("reason", F.coalesce("_absent", F.when(F.coalesce(amount, F.lit(0)) <= 0, "one direct pool-to-vault WSOL transfer not found")))
    df = df.withColumn("classification", F.when(F.col("reason").isNull(), "VERIFIED_MINT_POOL_CREATOR_VAULT_FLOW").otherwise("UNVERIFIED"))
    return df.withColumn("fee_amount", F.when(F.col("reason").isNull(), amount)).drop("_t", "_o", "_keys", "_absent", "_own")


def negative_eligibility(df: DataFrame, schema_tag: str, surface: str = "bluesky:jetstream_crypto", optional: str = "reddit:", max_lag: int = 300) -> DataFrame:
    """Adds lag_seconds, reason_codes (sorted set), stream_eligible and global_eligible to snapshots (schema, generated_at,
    cursor_us, source_health): an absence may be claimed only if nothing about the coverage is unknown."""
    h = F.get(F.filter("source_health", lambda x: x["surface"] == surface), F.lit(0))
    at = F.unix_micros(F.try_to_timestamp("generated_at"))
    lag = F.when(F.col("cursor_us").isNotNull() & at.isNotNull(), F.greatest(F.lit(0.0), (at - F.col("cursor_us")) / F.lit(1e6)))
    df = df.withColumn("_h", h).withColumn("lag_seconds", lag)
    missing = F.col("_h").isNull()
    no = lambda c: ~missing & ~F.coalesce(F.col(f"_h.{c}"), F.lit(False))
    blocked = F.coalesce(F.exists("source_health", lambda x: x["surface"].startswith(optional) & ~F.coalesce(x["ok"], F.lit(False))), F.lit(False))
    stream = {
        "WRONG_SCHEMA": ~F.col("schema").eqNullSafe(F.lit(schema_tag)), "JETSTREAM_HEALTH_MISSING": missing, "JETSTREAM_NOT_OK": no("ok"), "JETSTREAM_NOT_CAUGHT_UP": no("caught_up_near_live"),
        "JETSTREAM_PARTIAL": F.col("_h.coverage_status").isin("PARTIAL_OR_BASELINE_UNKNOWN", "STREAM_UNAVAILABLE"), "CURSOR_STALE": F.col("lag_seconds") > max_lag, "CURSOR_LAG_UNKNOWN": F.col("lag_seconds").isNull(),
    }
    df = df.withColumn("_s", F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in stream.items()]))).withColumn("_b", blocked)
    df = df.withColumn("reason_codes", F.array_sort(F.concat("_s", F.when(F.col("_b"), F.array(F.lit("REDDIT_COVERAGE_MISSING"))).otherwise(F.array().cast("array<string>")))))
    return df.withColumn("stream_eligible", F.size("_s") == 0).withColumn("global_eligible", F.col("stream_eligible") & ~F.col("_b")).drop("_h", "_s", "_b")


def trade_refresh_state(ok: Column, previous_head: Column, ids: Column, reached_end: Column) -> Column:
    """State of one refresh of a trade list: complete only if the previous head was met, or a first read met the end."""
    met = F.coalesce(F.array_contains(ids, previous_head), F.lit(False))
    return F.when(~F.coalesce(ok, F.lit(False)), "SOURCE_ERROR").when(met | (previous_head.isNull() & F.coalesce(reached_end, F.lit(False))), "COMPLETE_INTERVAL").when(previous_head.isNotNull(), "PREVIOUS_HEAD_NOT_REACHED").otherwise("FIRST_WINDOW_TRUNCATED")


def stream_state(connected: Column, dropped: Column, events: Column) -> Column:
    """State of one drained cut of a stream; silence on a live connection proves nothing."""
    return F.when(~F.coalesce(connected, F.lit(False)), "STREAM_UNAVAILABLE").when(F.coalesce(dropped, F.lit(0)) > 0, "BUFFER_GAP").when(F.coalesce(events, F.lit(0)) == 0, "CONNECTED_NO_EVENTS_UNVERIFIED").otherwise("RAW_CAPTURE_ACTIVE")
