"""Best-fit packing of tokenised documents, improved by swap-based local search.

Only lengths matter to a packing, and there are at most ``room`` of them, so the packing is found on their
histogram: groups of equally filled bins, each a pattern of lengths with a number of bins. Best-fit
decreasing makes the first packing. The local search then takes the least filled bins and, between underfull
bins, moves an item, exchanges one for one or two for one, whenever the sum of squared fills grows, until
bins fall empty or no exchange is left. Work and memory on the driver depend on the number of lengths, not
on the number of documents. The items are then dealt to the patterns' places by their rank among the items
of their length, which is counted in buckets of about ``BUCKET`` rows, so no length meets in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm import bpe
from tallyweave.llm.common import map_arrow, written

BUCKET = 1000
#: Donor patterns without any exchange after which the local search ends, and its steps at most (effort: a step
#: exchanges between all bins of two patterns, however many).
TRIES, STEPS = 64, 4000


@cache
def _byte_of() -> dict[str, int]:
    """Bytes of the characters that stand for them in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE in a tokenizers file whose ids follow its merges; raises if they don't."""
    model = json.loads(tokenizer_json)["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    if ids != sorted(ids):
        raise ValueError("the ids don't follow the merges")
    byte_of, single = _byte_of(), {t for t in model["vocab"] if len(t) == 1}
    kept = single | {a + b for a, b in pairs}
    return {bytes(byte_of[c] for c in t): model["vocab"][t] for t in kept}


def added_tokens(tokenizer_json: str) -> dict[str, int]:
    """The strings that the tokenizers library takes out of a text before all else, with their ids; raises for options not served here."""
    added = [t for t in json.loads(tokenizer_json).get("added_tokens") or () if t["content"]]
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not served")
    return {t["content"]: t["id"] for t in added}


class Coder:
    """Ids of whole texts: the tiktoken library's, and this package's own coder's for texts with very long runs of white space."""

    def __init__(self, tokenizer_json: str, pattern: str):
        self.ranks, self.pattern, self.added = byte_level_ranks(tokenizer_json), pattern, added_tokens(tokenizer_json)
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.added)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def encode(self, text: str, added: bool) -> np.ndarray:
        if not bpe.long_white(text):
            return self.fast.encode_to_numpy(text, allowed_special=self.fast.special_tokens_set if added else set(), disallowed_special=())
        own = bpe.coder_of(self.ranks, self.pattern)
        parts = self.marks.split(text) if added and self.marks else [text]
        ids = [np.array([self.added[x]], "<u4") if i % 2 else np.frombuffer(own.encode(x), "<u4") for i, x in enumerate(parts)]
        return np.concatenate(ids)


_local: dict[tuple, Coder] = {}


def _coder(tokenizer_json: str, pattern: str) -> Coder:
    key = zlib.crc32(tokenizer_json.encode()), pattern
    if key not in _local:
        _local.clear()
        _local[key] = Coder(tokenizer_json, pattern)
    return _local[key]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, room: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, added: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with ``end`` and cut those over ``room``; the first piece is the short one.

    Returns (doc_id, piece int, start long, length long, ids_crc32 long) and, with ``ids``, the ids. Null and
    empty texts give one piece, ``end`` alone. The ids are those of the tokenizers library for the file,
    with ``added`` by its default settings, else with ``encode_special_tokens``: added tokens' strings are text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(*shared.value)
        for batch in batches:
            doc, piece, start, length, crc, own = [], [], [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.append(coder.encode(x.as_py() or "", added), end).astype("<u4")
                first = len(got) % room or room
                cuts = [0, *range(first, len(got) + 1, room)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(got[a:b].tobytes()))
                    if ids:
                        own.append(got[a:b].astype(np.int64))
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                out.append(pa.array(own, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


Pattern = tuple[int, ...]


def best_fit(histogram: dict[int, int], room: int) -> dict[Pattern, int]:
    """Best-fit decreasing over a histogram of lengths: pattern (lengths, descending) -> number of bins."""
    free: dict[int, dict[Pattern, int]] = {}

    def put(left: int, pattern: Pattern, n: int) -> None:
        group = free.setdefault(left, {})
        group[pattern] = group.get(pattern, 0) + n

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        for left in sorted(x for x in free if x >= size):
            fit = left // size
            group = free[left]
            for pattern in list(group):
                if not n:
                    break
                bins = group.pop(pattern)
                full = min(bins, n // fit)
                if full:
                    put(left - fit * size, pattern + (size,) * fit, full)
                    n -= full * fit
                    bins -= full
                if bins and n < fit and n:
                    put(left - n * size, pattern + (size,) * n, 1)
                    n, bins = 0, bins - 1
                if bins:
                    put(left, pattern, bins)
            if not free[left]:
                del free[left]
        fit = room // size
        if n // fit:
            put(room - fit * size, (size,) * fit, n // fit)
        if n % fit:
            put(room - n % fit * size, (size,) * (n % fit), 1)
    out: dict[Pattern, int] = {}
    for group in free.values():
        for pattern, n in group.items():
            out[pattern] = out.get(pattern, 0) + n
    return out


def _without(pattern: Pattern, *items: int) -> Pattern:
    left = list(pattern)
    for x in items:
        left.remove(x)
    return tuple(left)


def _with(pattern: Pattern, *items: int) -> Pattern:
    return tuple(sorted(pattern + items, reverse=True))


def _exchange(donor: Pattern, bins: dict[Pattern, int], room: int) -> tuple[Pattern, Pattern, Pattern] | None:
    """The best exchange that makes another underfull bin fuller at the donor's cost: (other, other after, donor after).

    The other bin gains d = what comes less what goes, 0 < d <= its room; fills square best with the largest
    d / the fullest other bin. Donor items come alone or in twos, other items go not at all, alone or in twos.
    """
    ones = sorted(set(donor), reverse=True)
    twos = sorted({(a, b) for i, a in enumerate(donor) for b in donor[i + 1 :]}, key=sum, reverse=True)
    best, gain = None, 0
    fill = sum(donor)
    for other, n in bins.items():
        left = room - sum(other)
        if not left or (other == donor and n < 2) or sum(other) < fill:
            continue
        reach = 2 * (sum(other) - fill)  # squared fill grows by 2 d (d + other - donor)
        if left * (2 * left + reach) <= gain:
            continue
        goes = [(), *((x,) for x in set(other)), *{(a, b) for i, a in enumerate(other) for b in other[i + 1 :]}]
        comes = [*((x,) for x in ones), *twos]
        for out in goes:
            for into in comes:
                if len(out) == len(into) == 2:
                    continue
                d = sum(into) - sum(out)
                if 0 < d <= left and (g := d * (2 * d + reach)) > gain:
                    best, gain = (other, _with(_without(other, *out), *into), _with(_without(donor, *into), *out)), g
                    break  # comes is in falling order, all but for the twos
    return best


def local_search(bins: dict[Pattern, int], room: int) -> dict[Pattern, int]:
    """Empty underfull bins by moves and exchanges that increase the sum of squared fills."""
    bins = dict(bins)

    def change(pattern: Pattern, n: int) -> None:
        if pattern:
            bins[pattern] = bins.get(pattern, 0) + n
            if not bins[pattern]:
                del bins[pattern]
                failed.discard(pattern)

    failed: set[Pattern] = set()
    least = -(-sum(sum(p) * n for p, n in bins.items()) // room)
    for _ in range(STEPS):
        if len(failed) >= TRIES or sum(bins.values()) <= least:
            break
        open_ = [p for p in bins if p not in failed and sum(p) < room]
        if not open_:
            break
        donor = min(open_, key=sum)
        found = _exchange(donor, bins, room)
        if found is None:
            failed.add(donor)
            continue
        other, fuller, emptier = found
        # all bins that are equal to these two, at once
        n = bins[donor] // 2 if other == donor else min(bins[donor], bins[other])
        for pattern, more in ((donor, -n), (other, -n), (fuller, n), (emptier, n)):
            change(pattern, more)
    return bins


def layout(bins: dict[Pattern, int]) -> np.ndarray:
    """Places by length: rows (length, first rank, places a bin, first sequence, offset), by length and first rank.

    Equal lengths of a pattern share a row, so a pattern of ``room`` has at most sqrt(2 room) rows.
    """
    rows, used, sequence = [], {}, 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            k = pattern.count(size)
            rows.append((size, used.get(size, 0), k, sequence, offset))
            used[size] = used.get(size, 0) + n * k
            offset += k * size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(found: DataFrame, room: int = 1024) -> DataFrame:
    """Pack the rows of ``found`` (length long, 1..``room``, and other columns) into sequences of ``room``.

    ``found`` is read several times and must give the same rows each time (a written table). Adds
    sequence_id long (from 0) and offset long; the places in a sequence follow one another without a gap. Rows
    that repeat are packed each. An empty table gives no rows.
    """
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= room for x in histogram):
        raise ValueError(f"lengths must be 1 to {room}")
    places = layout(local_search(best_fit(histogram, room), room))
    shared = found.sparkSession.sparkContext.broadcast(places)
    wide = F.array(*(F.lit(-(-histogram.get(i, 1) // BUCKET)) for i in range(room + 1)))
    keyed = found.withColumn("k_bucket", F.pmod(F.xxhash64(*found.columns), F.get(wide, F.col("length").cast("int"))))
    counts = keyed.groupBy("length", "k_bucket").agg(F.count("*").alias("k_n"))
    before = Window.partitionBy("length").orderBy("k_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("length").alias("k_length"), F.col("k_bucket").alias("k_at"), F.coalesce(F.sum("k_n").over(before), F.lit(0)).alias("k_first"))
    order = Window.partitionBy("length", "k_bucket").orderBy(*(c for c, t in found.dtypes if not t.startswith(("array", "map", "struct"))))
    ranked = keyed.withColumn("k_own", F.row_number().over(order) - 1).join(
        firsts, (F.col("length") == F.col("k_length")) & (F.col("k_bucket") == F.col("k_at"))
    )
    ranked = ranked.select(*found.columns, (F.col("k_first") + F.col("k_own")).alias("k_rank"))
    at, names = found.columns.index("length"), found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            size = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            row = rows[np.searchsorted(rows[:, 0] * (1 << 44) + rows[:, 1], size * (1 << 44) + rank, side="right") - 1]
            i = rank - row[:, 1]
            sequence, offset = row[:, 3] + i // row[:, 2], row[:, 4] + i % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return map_arrow(ranked, run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str, pattern: str, room: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, added: bool = False) -> DataFrame:
    """``pieces`` of all documents, packed by ``pack``: a row for each piece.

    Rows with equal or null ids are documents of their own; columns other than the id and the text are not read.
    """
    return pack(written(pieces(docs, tokenizer_path, pattern, room, end, id_col, text_col, ids, added)), room)
