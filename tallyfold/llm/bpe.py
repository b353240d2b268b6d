"""BPE encoding and decoding by traversing a trie of distinct words.

The encoding of a word's prefix is fixed by its last token alone: the rest is the encoding of the prefix
without that token. A token may be the last one exactly if BPE would not merge across the border between
it and the last token before. So each trie node needs one number, the last token of the prefix it stands
for, found from its ancestors' numbers; prefixes that words share are computed once. The trie of a batch of
distinct words is the sorted list of them, and its depth-first order is that list's order: the path to the
current word is kept, and what it shares with the next word is not computed again.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.session import bounded_batches, map_arrow, widened

#: The published pattern by which this family of tokenizers cuts a text into words; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words with their encodings, and judged pairs of tokens, that a worker keeps at most before it starts
#: anew; they change no result.
KEPT_WORDS, KEPT_PAIRS = 500_000, 500_000

#: Characters of text whose words are held at a time.
BLOCK = 1 << 20

_BORDER = regex.compile(r"(?<=\S) ")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = spec.get("normalizer") is None and before["type"] == "ByteLevel" and before["use_regex"]
        if not plain or before["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE is supported")
        letters, vocab = byte_letters(), model["vocab"]
        spelt = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        # Ranks: bytes 0..255 come first, then the merged tokens in the order of their merges.
        self.bytes_of: list[bytes] = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        rank = {token: i for i, token in enumerate(self.bytes_of)}
        for merge in model["merges"]:
            a, b = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            if a + b in rank:
                raise ValueError("a token has two merges")
            pair = (rank[a], rank[b])
            rank[a + b] = self.merged[pair] = len(self.bytes_of)
            self.bytes_of.append(a + b)
            self.parts.append(pair)
        self.rank = rank
        self.id_of = [spelt[token] for token in self.bytes_of]
        self.packed = [i.to_bytes(4, "little") for i in self.id_of]
        self.suffixes = self._suffixes()
        self.spelling = {i: token for token, i in spelt.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or match words aren't supported")
        self.spelling |= {i: content.encode() for content, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    def _suffixes(self) -> dict[bytes, int]:
        """Every suffix of every token, with the token it is itself, or -1."""
        found = {token[at:]: -1 for token in self.bytes_of for at in range(1, len(token))}
        return found | self.rank

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves a border between two adjacent tokens, each encoded as itself.

        The merges of both are taken back, the latest first; if at some point the two tokens at the border
        have a merge of their own that comes before the one taken back, BPE would have merged them.
        """
        key = left << 32 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        a, b, until = left, right, len(self.bytes_of)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < until:
                apart = False
                break
            # Of merges with the same rank the left one comes first, so a right part gives way at equality.
            if a > b:
                until, a, single = a, self.parts[a][1], a < 256
                if single:
                    apart = True
                    break
            else:
                until, b, single = b + 1, self.parts[b][0], b < 256
                if single:
                    if a < 256:
                        apart = True
                        break
                    until, a = a, self.parts[a][1]
        if len(self.apart) > KEPT_PAIRS:
            self.apart.clear()
        self.apart[key] = apart
        return apart

    def _learn(self, words: Iterable[str]) -> None:
        """Encode distinct words by going through their trie depth first."""
        suffix, lengths, stays_apart = self.suffixes.get, list(map(len, self.bytes_of)), self.stays_apart
        path = b""
        last: list[int] = []  # the last token of each prefix of path, by length - 1
        for word, spelt in sorted(((w, w.encode()) for w in words), key=lambda x: x[1]):
            shared, most = 0, min(len(path), len(spelt))
            while shared < most and path[shared] == spelt[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(spelt) + 1):
                at, tokens = end - 1, []  # the tokens that end here, shortest first
                while at >= 0 and (token := suffix(spelt[at:end])) is not None:
                    if token >= 0:
                        tokens.append(token)
                    at -= 1
                for token in reversed(tokens):
                    start = end - lengths[token]
                    if not start or stays_apart(last[start - 1], token):
                        last.append(token)
                        break
            path = spelt
            found, at = [], len(spelt)
            while at:
                token = last[at - 1]
                found.append(self.packed[token])
                at -= len(self.bytes_of[token])
            self.cache[word] = b"".join(reversed(found))

    def _pieces(self, text: str) -> Iterator[str | int]:
        """Stretches of ordinary text of about BLOCK characters, and ids of added tokens between them.

        A stretch ends only where a space follows something else: no word of the pattern goes across that.
        """
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield self.special[piece]
                continue
            at = 0
            while len(piece) - at > BLOCK:
                end = _BORDER.search(piece, at + BLOCK)
                if end is None:
                    break
                yield piece[at : end.start()]
                at = end.start()
            if at < len(piece):
                yield piece[at:]

    def _encode_pieces(self, pieces: list[str | int]) -> list[bytes]:
        cut = [p if isinstance(p, int) else self.words.findall(p) for p in pieces]
        new = {w for p in cut if not isinstance(p, int) for w in p}
        if len(self.cache) > KEPT_WORDS:
            self.cache.clear()
        self._learn(new.difference(self.cache))
        get = self.cache.__getitem__
        return [p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in cut]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers; a null text has none.

        Words of about BLOCK characters of text at a time are in the trie, so memory is bounded.
        """
        found: list[list[bytes]] = [[] for _ in texts]
        owners: list[int] = []
        pieces: list[str | int] = []
        held = 0

        def flush() -> None:
            for owner, ids in zip(owners, self._encode_pieces(pieces), strict=True):
                found[owner].append(ids)
            owners.clear()
            pieces.clear()

        for i, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                owners.append(i)
                pieces.append(piece)
                held += 1 if isinstance(piece, int) else len(piece)
                if held >= BLOCK:
                    flush()
                    held = 0
        flush()
        return [b"".join(x) for x in found]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; added tokens are spelt out, and bytes that aren't UTF-8 are replaced."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.spelling.__getitem__, numbers)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per worker and file."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with a column of packed ids (little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have no ids. All other columns stay as they are; one named as the result is
    replaced. Rows are encoded where they are, without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(to) if to != text else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = pa.array(bpe.encode_batch(batch.column(text).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, to])

    return map_arrow(kept, run, widened(kept, **{to: "binary"}))


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with the text of every row's packed ids; null ids give an empty text."""
    bounded_batches(encoded.sparkSession)
    kept = encoded.drop(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, to])

    return map_arrow(kept, run, widened(kept, **{to: "string"}))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts encoded and decoded again.

    Both directions run in one Python stage, so that ids don't travel between them; the digests are of
    what encode() and decode() give. Null and empty texts have no tokens.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = bpe.encode_batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
