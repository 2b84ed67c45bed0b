"""What a worker holds while it packs: slices of a bounded size, and a bounded number of remembered pieces."""

import random

import pyarrow as pa
from pyspark.sql.types import StructType

from tidemark.llm import encoding, packing
from tidemark.llm.queries import tokenizer


class Rows:
    """Stands for a DataFrame whose task function is wanted."""

    schema = StructType().add("doc_id", "long").add("text", "string")

    def __getattr__(self, name):
        return lambda *a: self if name != "mapInArrow" else a[0]


def test_a_lane_is_encoded_in_bounded_slices(spark, monkeypatch):
    real, seen = encoding.encoder(tokenizer("byte_bpe_50k.json")), []

    class Spy:
        def encode(self, column):
            seen.append(sum(len(t) for t in column.to_pylist()))
            return real.encode(column)

    monkeypatch.setattr(packing, "encoder", lambda *a: Spy())
    text = "some words of a text that is packed " * 3000
    batch = pa.record_batch([pa.array(range(80)), pa.array([text] * 80), pa.array([0] * 80, pa.int64())], names=["doc_id", "text", "part"])
    out = [r for b in packing.pack_documents(Rows(), "")(iter([batch])) for r in b.to_pylist()]
    assert max(seen) <= 2 << 20 and sum(seen) == 80 * len(text)
    assert sum(r["length"] for r in out) == 80 * (24_000 + 2)  # the last space is one token, the end id another


def test_remembered_pieces_are_bounded():
    rng, e = random.Random(3), encoding.Encoder(tokenizer("byte_bpe_50k.json"))
    for _ in range(12):
        words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(20_000)]
        ids, offs = e.encode(pa.array([" ".join(words)], pa.large_string()))
        assert offs.tolist() == [0, len(ids)]
    assert len(e.pieces) <= encoding.CACHE // 6 + 20_000
