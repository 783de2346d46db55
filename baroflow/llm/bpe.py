"""Byte-level BPE encoding and decoding with a published vocabulary.

Short words are merged in a contiguous rank array: the word's parts and the ranks of adjacent
pairs lie in two lists, and the lowest rank is merged, its boundary deleted and the two
neighbouring ranks refreshed until no pair has a rank. Long words, where repeated scans would
cost the square of their length, take the same merges from a heap.
"""

from __future__ import annotations

import heapq
import json
import os
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT_WORD = 128
CACHE_WORDS = 150_000
_SLICE_ROWS = 256


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Vocabulary:
    """Ranks, ids and bytes read from a tokenizer file (given as its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids = spec["model"]["vocab"]
        to_byte = {c: b for b, c in byte_characters().items()}
        self.token_bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in token) for token, i in ids.items()}
        self.byte_id = [ids[c] for _, c in sorted(byte_characters().items())]
        #: Pair of ids, as left * 2^32 + right, to rank; and rank to the id made.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(ids[left] << 32 | ids[right], r)
            self.made.append(ids[left + right])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.added.items():
            self.token_bytes[i] = content.encode()
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        return self._scan(word) if len(word) <= SHORT_WORD else self._heap(word)

    def _scan(self, word: bytes) -> list[int]:
        get, made, none = self.rank.get, self.made, len(self.made)
        byte_id = self.byte_id
        parts = [byte_id[b] for b in word]
        ranks = [get(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i] = new = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 32 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | new, none)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        get, made = self.rank.get, self.made
        parts: list[int] = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (r := get(parts[i] << 32 | parts[j])) is not None:
                heap.append((r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (q := get(parts[at] << 32 | parts[after[at]])) is not None:
                    heapq.heappush(heap, (q, at, parts[at], parts[after[at]]))
        return [p for p in parts if p >= 0]


class _Cache(dict):
    """Piece of text to its packed ids; the least recent half goes when it is full."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece)
        if len(piece) <= SHORT_WORD:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Texts to packed ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PRETOKEN).findall
        # A single space between two other characters always begins a pre-token, so texts
        # are cut there first; pieces repeat far more often than texts.
        self.odd_space = regex.compile(r"\s |^ | \s| $").search
        self.word = _Cache(self._word)
        self.spaced = _Cache(lambda piece: self._piece(" " + piece))

    def forget(self) -> None:
        """Drop the pieces kept so far."""
        for cache in (self.word, self.spaced):
            cache.clear()
            cache.old = {}

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.find(piece)))

    def _word(self, word: str) -> bytes:
        ids = self.vocabulary.merge(word.encode("utf-8"))
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd_space(text):
            return self._piece(text)
        head, *rest = text.split(" ")
        return self._piece(head) + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        split = self.vocabulary.split_added
        if split is None or not any(content in text for content in self.vocabulary.added):
            return self._plain(text)
        added = self.vocabulary.added
        return b"".join(
            np.uint32(added[part]).astype("<u4").tobytes() if part in added else self._plain(part)
            for part in split.split(text)
        )

    def decode(self, packed: bytes) -> str:
        pieces = map(self.vocabulary.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())
        return b"".join(pieces).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(name: str, text: str) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(Vocabulary(text))
    return _codecs[name]


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            yield batch.slice(at, _SLICE_ROWS)


def bpe(docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` and, if asked for, ``decoded``.

    ``token_ids`` holds the ids as little-endian unsigned 32-bit integers. Every text is
    encoded whole, null as empty; an added token of the vocabulary that occurs in a text is
    one id, as in the public tokenizers library without added special tokens. ``decoded`` is
    what the ids stand for, byte sequences that are no UTF-8 replaced. Columns of those names
    are replaced. ``tokenizer`` is the path of the vocabulary on the driver; its text (some
    megabytes, whatever the data) is broadcast. A task keeps at most 4 x ``CACHE_WORDS`` short
    pieces and drops them at its end, as workers live on.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    name = os.path.basename(tokenizer)
    keep = [c for c in docs.columns if c not in ("n_tokens", "token_ids", "decoded")]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    added += [T.StructField("decoded", T.StringType())] if decode else []
    schema = T.StructType([docs.schema[c] for c in keep] + added)

    def run(batches):
        codec = _codec(name, vocabulary.value)
        try:
            for batch in _slices(batches):
                texts = batch.column(text_col).to_pylist()
                ids = [codec.encode(t or "") for t in texts]
                columns = [batch.column(c) for c in keep]
                columns += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([codec.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[f.name for f in added]])
        finally:
            codec.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)
