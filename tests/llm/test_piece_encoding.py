import random

import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import piece_encoding as P
from tidemark.llm.queries import op12_sentencepiece, tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a b  ", "Hello  world\nfoo\tbar ", "▁x▁ ▁", "x▁ y", "a\x00b", "ﬁ é é İ ß <s> </s> <unk> <0x41>", "🙂中文 🙂", " \n \r\n\n x▁▁ y ▁z", "①②３ ｱﾞ ﷺ ½ … ＡＢ　Ｃ", "​ a­b﻿", "한글 가", "Å Å ΑΣ", "�", "a" * 20_000, " " * 3000, "\U0010ffff", "  ﷺ  ",
]


def odd_texts():
    rng = random.Random(5)
    pick = lambda: rng.choice([32, rng.randrange(32, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x2000, 0x2200), rng.randrange(0xFB00, 0xFFFD), rng.randrange(0x3040, 0x3400)])
    return TEXTS + ["".join(chr(pick()) for _ in range(60)) for _ in range(150)]


def against_library(path, texts):
    encoder = P.PieceEncoder(path)
    got = encoder.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        want = encoder.whole.encode(text or "", return_type="proto").pieces
        own = slice(got.first[i], got.first[i + 1])
        assert got.ids[own].tolist() == [p.id for p in want], text
        assert got.ends[own].tolist() == [p.end for p in want], text
    return encoder


def test_given_model_equals_library():
    encoder = against_library(MODEL, odd_texts())
    assert encoder.normalizer.plain
    assert len(encoder.encode(pa.array([], pa.string())).ids) == 0


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("prefix", "fold"), [(0, 0), (0, 1), (1, 0), (1, 1)])
def test_compiled_maps_equal_library(tmp_path, rule, prefix, fold):
    """The given pieces under the library's own compiled character maps."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    own = [(k, v) for k, v in P.fields(spec) if k in (P.MAP_NAME, P.MAP)] + [(P.MAP_PREFIX, prefix), (P.MAP_FOLD, fold), (P.MAP_ESCAPE, 1)]
    with open(MODEL, "rb") as f:
        model = [(k, v) for k, v in P.fields(f.read()) if k != P.NORMALIZER]
    path = tmp_path / "own.model"
    path.write_bytes(P.message([*model, (P.NORMALIZER, P.message(own))]))
    encoder = against_library(str(path), odd_texts())
    assert encoder.normalizer.plain == (rule == "identity" and not fold)


def test_longest_prefix_and_places():
    spec = dict(P.fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_normalizer_spec()))
    charmap = P.CharacterMap(spec[P.MAP])
    assert charmap.longest("ｶﾞ".encode(), 0) == ("ガ".encode(), 6)  # two characters are longer than one
    assert charmap.longest("ｶx".encode(), 0) == ("カ".encode(), 3)
    assert charmap.longest(b"x", 0) is None
    out, places = P.Normalizer(charmap, True, True).text("  ½ x ".encode())
    assert out.decode() == " 1⁄2 x" and places.tolist() == [2, 2, 2, 2, 2, 2, 4, 5, 6]


def test_documents(spark, odd):
    rows = P.encode_documents(odd, MODEL).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in odd.collect()]
    want = sorted((r.doc_id, lib.encode(r.text or ""), lib.decode(lib.encode(r.text or ""))) for r in odd.collect())
    assert sorted((r.doc_id, r.ids, r.decoded) for r in rows) == want
    assert sum(len(t.encode()) for t in texts if t) == sum(r.ends[-1] for r in rows if r.ends)  # the pieces cover every byte
    small = P.encode_documents(odd, MODEL, batch_bytes=10).collect()
    assert sorted(map(str, small)) == sorted(map(str, rows))
    assert P.encode_documents(odd.limit(0), MODEL).count() == 0
    assert odd.count() == P.encode_documents(odd.withColumn("doc_id", odd.doc_id % 1), MODEL).count()


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = {r.doc_id: lib.encode(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = sorted((k, len(v), sha(",".join(map(str, v))), sha(lib.decode(v))) for k, v in ids.items())
    assert sorted(tuple(r)[:4] for r in op12_sentencepiece(spark, sf).collect()) == want
