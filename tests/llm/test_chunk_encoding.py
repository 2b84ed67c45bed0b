"""What reaches the tokenizer library: a word is encoded by the model alone, and once while it is frequent."""

import pyarrow as pa
import pytest

from tidemark.llm import encoding
from tidemark.llm.queries import tokenizer

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
MARKED = "Eaux eaux, eaux. Eaux%%%\nEaux*** ünd###\n\nünd&&& a_ (b [c \\d\n<e> f|g~ h!? i;: j`^ k{} l\"$ m+= n@ o/ p-\n"
ODD = ["it's we'll o'clock 'tis a' b'' c's. d'.", "\n\n x \ny\t\tz\r\nw  v\n", "テスト　です\u3000か。" * 40, "a\u2003b\u00a0c\u2028d\x0be é\u0301 e\u0301!", "<|endoftext|> x<|endoftext|>", "12,3 a1. 1a! ß. ÀÉ, ×y ÷z"]


def whole(e, texts):
    return [i for x in e.tokenizer.encode_batch(texts, add_special_tokens=False) for i in x.ids]


@pytest.mark.parametrize("name", FILES)
def test_a_word_with_marks_needs_no_pre_tokenizer(name):
    e, texts = encoding.Encoder(tokenizer(name), None), [MARKED.replace("<e>", "e>").replace("(b [c \\d", "b( c[ d\\").replace("\n\n", "\n").replace("f|g~", "f|").rstrip("\n")]
    want, real = whole(e, texts), e.tokenizer

    class Spy:
        def __getattr__(self, name):
            assert not name.startswith("encode"), "the library's pre-tokenizer ran"
            return getattr(real, name)

    e.tokenizer = Spy()
    assert e.encode(pa.array(texts, pa.large_string()))[0].tolist() == want


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_whole_texts(name):
    e, texts = encoding.Encoder(tokenizer(name), None), [MARKED, *ODD, *[f"Word{m} {m}word\nword{m}{m} é{m}\n{m}" for m in map(chr, range(33, 127))]]
    for _ in range(2):  # the second time from the cache
        assert e.encode(pa.array(texts, pa.large_string()))[0].tolist() == whole(e, texts)


def test_frequent_chunks_outlive_the_cache(monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 2000)
    e, seen = encoding.Encoder(tokenizer("byte_bpe_50k.json"), None), []
    real = e._chunk
    monkeypatch.setattr(e, "_chunk", lambda text: seen.append(text) or real(text))
    letters = "abcdefghij"
    for i in range(100):
        texts = [" often" + "".join(f" {letters[i // 10]}{letters[i % 10]}{letters[j // 10]}{letters[j % 10]}x" for j in range(100))]
        assert e.encode(pa.array(texts, pa.large_string()))[0].tolist() == whole(e, texts)
        assert len(e.cache) + len(e.older) <= 2000
    assert seen.count(" often") == 1 and len(seen) == 10_001
