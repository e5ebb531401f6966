"""Byte-level BPE in two tiers, and the split of texts that it and the other tokenizers work on.

First tier: a minimal perfect hash over the vocabulary tells whether a whole pre-token is a token. Second
tier, for the rest: the pre-token's bytes as a linked list, with a heap of the pairs that may merge, lowest
rank and then leftmost first, as the tiktoken library merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import map_arrow

#: Entries of a worker's cache of encoded pieces of text; beyond it, pieces are encoded each time.
CACHED = 1 << 19
_TWO_WHITE = re.compile(r"\s\s")
#: White space in a row that the tiktoken library's pattern engine can take; it fails from some 10^6 on.
LONG_WHITE = 50_000
_LONG_WHITE = re.compile(rf"\s{{{LONG_WHITE}}}")


class Cached(dict):
    """``make(key)``, kept for the first ``CACHED`` keys."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(self) < CACHED:
            self[key] = value
        return value


class MinimalPerfectHash:
    """Distinct byte strings to 0..n-1 without a gap, by hash and displace.

    A first hash picks a bucket, whose number reseeds the hash that gives the slot; buckets of one key hold
    the slot itself (as a negative number). ``slot`` is right for the keys; the caller compares the key.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = max(1, n // 4)
        buckets: list[list[bytes]] = [[] for _ in range(self.m)]
        for key in keys:
            buckets[xxhash.xxh64_intdigest(key) % self.m].append(key)
        self.seeds = [0] * self.m
        used = bytearray(n)
        order = sorted(range(self.m), key=lambda i: -len(buckets[i]))
        for at, i in enumerate(order):
            if len(buckets[i]) <= 1:
                break
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(k, seed) % n for k in buckets[i]}
                if len(slots) == len(buckets[i]) and not any(used[s] for s in slots):
                    break
                seed += 1
            self.seeds[i] = seed
            for s in slots:
                used[s] = 1
        else:
            at = len(order)
        free = (s for s in range(n) if not used[s])
        for i in order[at:]:
            if buckets[i]:
                self.seeds[i] = -next(free) - 1

    def slot(self, key: bytes) -> int:
        seed = self.seeds[xxhash.xxh64_intdigest(key) % self.m]
        return -seed - 1 if seed < 0 else xxhash.xxh64_intdigest(key, seed) % self.n


class ByteBPE:
    """Encoder and decoder for a table of ranks (bytes -> id, also the merge order) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.hash = MinimalPerfectHash(list(ranks))
        self.keys, self.ids = [b""] * len(ranks), [0] * len(ranks)
        for key, rank in ranks.items():
            slot = self.hash.slot(key)
            self.keys[slot], self.ids[slot] = key, rank
        self.bytes_of = {rank: key for key, rank in ranks.items()}
        self.tokens = Cached(self._tokens)
        self.chunks = Cached(lambda word: self._chunk(" " + word))

    def whole(self, piece: bytes) -> int | None:
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.keys[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging."""
        ranks, n = self.ranks, len(piece)
        stop, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not stop[i] or j >= n or stop[j] != end:  # one of the two has merged meanwhile
                continue
            stop[i], stop[j] = end, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : stop[k]])) is not None:
                    heapq.heappush(heap, (r, i, stop[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = after[i]
        return out

    def _tokens(self, token: str) -> bytes:
        piece = token.encode("utf-8", "surrogatepass")
        one = self.whole(piece)
        ids = [one] if one is not None else self.merged(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        found = self.pattern.findall(chunk)
        return self._tokens(found[0]) if len(found) == 1 else b"".join(map(self.tokens.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        Without two white-space characters in a row, no match of the pattern goes on over a space, so the
        text falls into a first chunk and chunks that begin with a space; most have been met before.
        """
        if _TWO_WHITE.search(text):
            return b"".join(map(self.tokens.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return self._chunk(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def long_white(text: str) -> bool:
    """Whether a text holds a run of white space that the tiktoken library can't be trusted with."""
    return len(text) >= LONG_WHITE and _LONG_WHITE.search(text) is not None


def load_ranks(path: str) -> dict[bytes, int]:
    """The table in a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_local: dict[tuple, ByteBPE] = {}


def coder_of(ranks: dict[bytes, int], pattern: str) -> ByteBPE:
    """A coder, built once a process for a table."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _local:
        _local.clear()
        _local[key] = ByteBPE(ranks, pattern)
    return _local[key]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode every text and decode the ids again.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256) and, with ``ids``, the ids (array of long), a row
    for each row of ``docs`` in any order; other columns are not read. Null counts as the empty text, which
    has no tokens. Whole texts of any length; special tokens' strings are ordinary text. The table of ranks
    is sent to the executors: its size is that of the vocabulary.
    """
    table = docs.sparkSession.sparkContext.broadcast((load_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(*table.value)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for x in batch.column(1):
                got = coder.encode(x.as_py() or "")
                rows[0].append(len(got) // 4)
                rows[1].append(hashlib.sha256(got).hexdigest())
                rows[2].append(hashlib.sha256(coder.decode(got)).hexdigest())
                if ids:
                    rows[3].append(np.frombuffer(got, "<u4").astype(np.int64))
            out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                out.append(pa.array(rows[3], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * ids)
