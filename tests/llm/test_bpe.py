import random
import struct

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from caseloom.llm import bpe

PATH = bpe.tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def same(own, library, text):
    ids, decoded = own.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, text[:80]
    assert decoded.decode() == library.decode(want, skip_special_tokens=False), text[:80]
    assert own.decode(ids) == decoded.decode()


def test_documents(own, library, sf):
    for text in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column(0).to_pylist():
        same(own, library, text or "")


def test_odd_texts(own, library):
    for text in ["", " ", "\n\t", "I'M here, they'LL go", "ΣΑΣ Σ", "İstanbul ǅ ß ẞ", "e\u0301 é", "日本語 text 12345", "<|endoftext|>a<|startoftext|> <|endoftext|", "a" * 700, "ab" * 400 + "!" * 300, "\u00a0x\u2003y\u200b", "\U0001f600\U0001f468\u200d\U0001f469 ok", "１２３ ½ ²", "don't 'S 'tis", "\x00\x01 z", "a\u0300\u0301b", "A" * 161, "\r\n"]:
        same(own, library, text)


def test_random_characters(own, library):
    rng = random.Random(2)
    for _ in range(300):
        same(own, library, "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(32, 0x52F), rng.randint(0x530, 0xD7FF)])) for _ in range(rng.randint(1, 40))))


def test_long_words_take_the_same_merges(own):
    rng = random.Random(7)
    for _ in range(200):
        raw = "".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 150))).encode()
        ids = [own.inner[b] for b in raw[:-1]] + [own.final[raw[-1]]]
        assert own.merge(list(ids)) == own.merge_long(list(ids))


def test_rows(make_docs, odd_rows, own):
    docs = make_docs([r[:2] for r in odd_rows], clashing=True)
    got = bpe.encode_texts(docs, PATH)
    assert got.columns == [c for c in docs.columns if c != "__ids"] + ["__n_tokens", "__ids", "__decoded"]
    for r in got.collect():
        ids, decoded = own.encode(r["text"] or "")
        assert (bytes(r["__ids"]), r["__decoded"], r["__n_tokens"]) == (ids, decoded.decode(), len(ids) // 4)
    assert bpe.encode_texts(make_docs([]), PATH).count() == 0
