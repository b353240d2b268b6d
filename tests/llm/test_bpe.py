import hashlib
import random

import numpy as np
import pytest
import regex

from tallyfold.llm import bpe
from tallyfold.llm.queries import tokenizer_path
from tests.llm.conftest import prose, rows, with_clashes

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = tokenizer_path()
    return bpe.Tokenizer(path), tokenizers.Tokenizer.from_file(path)


def test_against_the_library(both):
    own, library = both
    rnd = random.Random(1)
    letters = "aeinorstABC 'sdlmvre<|>endoftext019 \n\t\r.,!?-_$%éßñ中文🙂́　 ٱ٣ⅷ½\x00\x85"
    texts = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", " " * 90, "a" * 3000, "ab" * 900, "don't I'LL x's", prose(1, 400)]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 70))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice((rnd.randint(0, 0x2FFF), rnd.randint(0xE000, 0x1FFFF)))) for _ in range(12)) for _ in range(1500)]
    found = own.encode_batch(texts)
    for text, ids in zip(texts, found, strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert own.decode(ids) == library.decode(expected, skip_special_tokens=False) == text


def test_bytes_that_aren_t_text_are_replaced(both):
    own, library = both
    ids = library.encode("🙂", add_special_tokens=False).ids[:1]
    assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_each_token_encodes_itself(both):
    own, _ = both
    rnd = random.Random(2)
    for token in rnd.sample(range(len(own.bytes_of)), 3000):
        try:
            text = own.bytes_of[token].decode()
        except UnicodeDecodeError:
            continue
        if own.words.findall(text) == [text]:
            assert own.encode_batch([text]) == [own.packed[token]]


def test_a_full_cache_changes_nothing(both, monkeypatch):
    own, _ = both
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    texts = [prose(i, 50) for i in range(4)]
    first = own.encode_batch(texts)
    assert [own.encode_batch([t])[0] for t in texts] == first


def test_long_texts_are_cut_where_no_word_goes_across(both, monkeypatch):
    own, library = both
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab 1.'s\n  \t<|endoftext|>") for _ in range(400)) for _ in range(60)] + ["x" * 300, " " * 300, "a<|endoftext|> b" * 20]
    monkeypatch.setattr(bpe, "BLOCK", 11)
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, sf_dir, both):
    own, library = both
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = []
    for r in docs.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r["doc_id"], len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    assert rows(bpe.digests(docs, tokenizer_path())) == sorted(expected, key=repr)


def test_odd_rows(odd_docs, no_docs):
    path = tokenizer_path()
    df = with_clashes(odd_docs, "ids", "decoded")
    found = bpe.decode(bpe.encode(df, path), path)
    assert found.columns == [*odd_docs.columns, "ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in found.collect())
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in bpe.digests(odd_docs.where("doc_id = 1"), path).collect()] == [(1, 0, nothing, nothing)]
    assert bpe.digests(no_docs, path).collect() == []


def test_the_pattern_is_that_of_the_library(both):
    _, library = both
    text = "Hello  world's 12,5 — ok\n\n\tx"
    pieces = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
    assert regex.findall(bpe.PATTERN, text) == pieces
