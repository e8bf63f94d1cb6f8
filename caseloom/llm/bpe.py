"""BPE encoding and decoding with a contiguous rank array per word.

A word is a list of parts with, beside it, the list of ranks of adjacent pairs. The encoder scans the ranks for the
minimum (leftmost on ties), merges there by deleting one boundary, and refreshes the two neighbouring ranks, until no
pair has a rank. Words of more than ``LONG`` parts, for which repeated scans would be quadratic, take the same merges
in the same order from a heap over a linked list. Words are kept in a bounded per-process cache.

The file is read with the tokenizers library's JSON layout (normalizer: NFC, white space, lower case; Split pattern;
byte-level alphabet; end-of-word suffix; added special tokens), and results equal that library's, special tokens in the
text included; decoding joins token strings with a space, as the library does for a file without a decoder.

Edge cases: null and empty texts encode to nothing and decode to ''; texts of any length are encoded whole; repeated
rows give repeated rows; an empty table gives no rows; other columns pass through, except that those named as the columns
added are replaced.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches_of, tidy, tune

LONG = 160
#: Words kept per generation; two generations are kept per process.
CACHE_WORDS = 100_000
#: Characters whose classes no Unicode version has changed; texts with others are split by the library's own tables.
SETTLED = regex.compile("[^\\x00-\u052f]")
INF = 1 << 60


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def tokenizer_file(name: str) -> str:
    """The place of an installed public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBpe:
    """An encoder built from the JSON text of a tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left = a[: -len(self.suffix)] if self.suffix and b == "" else a
            self.pairs[self.vocab[left], self.vocab[b]] = rank
            self.made.append(self.vocab[left + b])
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in special.items()}
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.final = [self.vocab[c + self.suffix] for c in alphabet]
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.spec, self.library = spec, None

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the parts of one short word."""
        get, made = self.pairs.get, self.made
        ranks = [get(p, INF) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == INF:
                break
            i = ranks.index(low)
            ids[i] = made[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), INF)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), INF)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word: lowest rank first, leftmost first."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := get((a, b), INF)) < INF]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get((ids[i], ids[k]), INF)) < INF:
                    heapq.heappush(heap, (s, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (s := get((ids[h], ids[i]), INF)) < INF:
                heapq.heappush(heap, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def pretoken(self, raw: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian uint32, token strings joined by spaces) of one pre-token."""
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        ids = self.merge(ids) if len(ids) <= LONG else self.merge_long(ids)
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.strings[i] for i in ids]).encode()

    def word(self, w: str) -> tuple[bytes, bytes]:
        """:meth:`pretoken` by way of the older generation of the cache."""
        made = self.older.get(w) or self.pretoken(w.encode())
        if len(w) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache, self.older = {}, self.cache
            self.cache[w] = made
        return made

    def by_library(self, text: str) -> list[tuple[bytes, bytes]]:
        """:meth:`segment` with the library's normalizer and splitter, whose Unicode tables decide on rare characters."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
        plain = self.library.normalizer.normalize_str(text)
        return [self.pretoken(bytes(map(self.bytes_of.__getitem__, w))) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def segment(self, text: str) -> list[tuple[bytes, bytes]]:
        """Pre-tokens of a text without special tokens, encoded."""
        if SETTLED.search(text):
            return self.by_library(text)
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # per character: no final sigma
        seen, word = self.cache.get, self.word
        return [seen(w) or word(w) for w in self.pattern.findall(text)]

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian uint32, decoded text) of a whole text."""
        parts = []
        if self.cut is not None and any(s in text for s in self.special):
            for piece in self.cut.split(text):
                if piece in self.special:
                    parts.append((np.array([self.special[piece]], "<u4").tobytes(), piece.encode()))
                elif piece:
                    parts.extend(self.segment(piece))
        else:
            parts = self.segment(text)
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def decode(self, ids: bytes) -> str:
        return " ".join(self.strings[i] for i in np.frombuffer(ids, "<u4").tolist())


_LOADED: dict[str, WordBpe] = {}


def loaded(key: str, spec: str) -> WordBpe:
    """One encoder per worker process."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with __n_tokens long, __ids binary (little-endian uint32) and __decoded string.

    The file at ``tokenizer_path`` is read on the driver and broadcast: a vocabulary, whose size no input changes.
    """
    docs = docs.drop("__n_tokens", "__ids", "__decoded")
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(spec), tokenizer_path
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for b in batches_of(batches, 2):
            bpe = bpe or loaded(key, sent.value)
            ids, texts = [], []
            for text in b.column(place).to_pylist():
                i, t = bpe.encode(text or "")
                ids.append(i)
                texts.append(t)
            made = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "__n_tokens", "__ids", "__decoded"])
        if bpe:
            bpe.cache, bpe.older = {}, {}
            tidy()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return tune(docs).mapInArrow(run, f"{ddl}, __n_tokens long, __ids binary, __decoded string")
