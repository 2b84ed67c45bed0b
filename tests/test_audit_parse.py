"""How the audits read a transaction: the usual form in one pass over its text, any other form as before."""

import json

from pyspark.sql import functions as F

from tests.test_feeds_audits import receipt
from tidemark.operators import audits as A
from tidemark.plans import audit_queries as Q

SF = "/root/testdata/sf0.001"


def test_the_usual_form_is_parsed_once(spark, monkeypatch):
    # Reading keys and instructions as text parses each of them again.
    monkeypatch.setattr(A, "_either", lambda usual, text: F.when(F.col("_t._odd").isNull(), usual(F.col("_t"))).otherwise(F.raise_error(F.lit("read as text"))))
    assert Q.pool_fee_flows(spark, SF).count() > 1
    assert Q.creator_receipts(spark, SF).where("reason IS NULL").count() > 1


def test_other_forms_give_the_same(spark):
    t = receipt()
    t["meta"] |= {"logMessages": [A.COLLECT_LOG, A.FEES_LOG], "postTokenBalances": [{"mint": "m"}]}
    move = t["meta"]["innerInstructions"][0]["instructions"][0]
    move["parsed"]["info"]["authority"] = "p"
    t["transaction"]["message"] = {"accountKeys": [{"pubkey": k} for k in ("me", "p", "tmp")], "instructions": [{"programId": A.AMM_PROGRAM}, t["transaction"]["message"]["instructions"][1]]}
    said = json.dumps(t)
    keys = said.replace('{"pubkey": "me"}', '"me"').replace('{"pubkey": "tmp"}', '"tmp"')
    asked = said.replace(json.dumps(move["parsed"]), json.dumps(json.dumps(move["parsed"])))
    raw = said.replace('{"instructions": [{"program"', '{"instructions": [{"program": "spl-token", "parsed": "raw"}, {"program"')
    void = said.replace('"innerInstructions": [', '"innerInstructions": [null, {"index": 1}, ')
    assert len({said, keys, asked, raw, void}) == 5
    rows = [(i, x, "me", "p", "m", "tmp", A.AMM_PROGRAM) for i, x in enumerate([said, keys, asked, raw, void, said.replace('"105"', "105"), said[:-1]])]
    df = spark.createDataFrame(rows, "i int, tx string, creator string, pool string, mint string, vault string, owner string")
    got = A.creator_receipt(df).orderBy("i").collect()
    assert [(r.reason, r.amount, r.wallet_delta, r.fee) for r in got[:5]] == [(None, 105, 100, 5)] * 5
    assert [r.reason for r in got[5:]] == ["expected exactly one vault-to-closed-WSOL transfer", "transaction unavailable or failed"]
    got = A.pool_fee_flow(df).orderBy("i").collect()
    assert [(r.reason, r.fee_amount) for r in got[:5]] == [(None, 105)] * 5
    assert [r.reason for r in got[5:]] == ["one direct pool-to-vault WSOL transfer not found", "transaction unavailable or failed"]


def test_payloads_leave_out_nulls(spark):
    row = {"l_orderkey": 1, "l_partkey": 2, "l_suppkey": 3, "l_linenumber": 7, "l_quantity": 50.0, "l_tax": 0.0, "l_returnflag": "R", "l_linestatus": "O", "cents": 9, "fee": 5007, "pool": "p2"}
    df = spark.createDataFrame([row, {k: None for k in row}], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string, cents long, fee long, pool string")
    full, bare = (json.loads(r.tx) for r in df.withColumn("move", F.expr(Q._MOVE)).select(F.expr(Q._TX).alias("tx")).collect())
    assert full["meta"]["err"] == "failed" and full["meta"]["postBalances"] == [0, 1_000_000_000 + 9 - 5007 + 1, 0] and len(full["meta"]["innerInstructions"][0]["instructions"]) == 2
    assert full["transaction"]["message"]["accountKeys"] == [{"pubkey": k} for k in ("payer", "s3", "p2", "tmp1")]
    assert full["meta"]["innerInstructions"][0]["instructions"][0]["parsed"]["info"] == {"mint": A.WRAPPED_SOL, "source": "v", "authority": "p2", "destination": "tmp1", "tokenAmount": {"amount": "9"}}
    assert bare["transaction"]["message"]["accountKeys"] == [{"pubkey": "payer"}, {}, {}, {}] and bare["meta"]["postBalances"] == [0, None, 0] and "fee" not in bare["meta"]
    assert bare["meta"]["innerInstructions"][0]["instructions"][0]["parsed"]["info"] == {"mint": A.WRAPPED_SOL, "source": "v", "tokenAmount": {}}
