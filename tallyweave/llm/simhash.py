"""SimHash fingerprints of documents and their near-duplicate classes.

The search is a Gray-order hierarchical index. Fingerprints are sorted by Gray rank, so that neighbours
share most bits; runs of them become leaves, runs of leaves upper nodes. A node holds the bits on which all
below it agree and which no node above it holds already (mask and pattern). A query adds up its differences
with the patterns on the way down and leaves out a node, with all below it, when the sum passes the limit.

Distribution: the index has several top nodes for each third of the bits, each fixing some bits of that
third. Fingerprints at 2 or fewer differing bits agree on one third at least, so each enters the index once
a third and meets all its partners there. A top node that would hold more than ``MOST`` fingerprints is
replaced by lower ones which fix that whole third and then, by the same argument, a third of the bits that
are left, and so on. After six levels at most 7 bits are free, so no node ever holds more than 512
distinct fingerprints, whatever the data; nothing is capped. Only links that join the parts of a node into
its local components leave it, fewer than it has fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.blocks import block_links, rarest, shared_blocks
from tallyweave.llm.common import free_name, map_arrow, written
from tallyweave.llm.components import components

#: Distinct fingerprints below one top node at most, and those aimed at.
MOST, AIM = 512, 128
LEAF, FAN = 16, 8
LIMIT = 2
#: Partial fingerprints of a document.
PARTS = 6
_PART = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles as an unsigned 64-bit integer; zero without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= width:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(width))))
    n = max(1, len(found) - width + 1)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        part = np.fromiter(hashes, dtype=">u8", count=min(_PART, n - at))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; the fingerprint's 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index over distinct 64-bit words (module docstring)."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        levels, spans = [], [(i, min(i + LEAF, len(fps))) for i in range(0, len(fps), LEAF)]
        starts = np.array([a for a, _ in spans])
        pattern = self.fps[starts]
        differ = np.bitwise_or.reduceat(self.fps ^ np.repeat(pattern, [b - a for a, b in spans]), starts)
        levels.append((pattern, ~differ))
        while len(pattern) > 1:
            at = np.arange(0, len(pattern), FAN)
            sizes = np.diff(np.append(at, len(pattern)))
            upper = pattern[at]
            apart = np.bitwise_or.reduceat((pattern ^ np.repeat(upper, sizes)) | ~levels[-1][1], at)
            levels.append((upper, ~apart))
            pattern = upper
        self.levels = levels[::-1]

    def within(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions (in the given order, each pair once) at ``limit`` or fewer differing bits."""
        fps, n = self.fps, len(self.fps)
        query, node = np.arange(n), np.zeros(n, np.int64)
        above = np.zeros(1, np.uint64)
        sums = np.zeros(n, np.int64)
        for depth, (pattern, shared) in enumerate(self.levels):
            if depth:
                kids = node[:, None] * FAN + np.arange(FAN)
                query, kids, sums = np.repeat(query, FAN), kids.ravel(), np.repeat(sums, FAN)
                real = kids < len(pattern)
                query, node, sums = query[real], kids[real], sums[real]
                mask = shared & ~above[np.arange(len(pattern)) // FAN]
            else:
                mask = shared
            sums = sums + np.bitwise_count((fps[query] ^ pattern[node]) & mask[node])
            # a query looks only at leaves that hold its own place or a later one
            reach = LEAF * FAN ** (len(self.levels) - 1 - depth)
            keep = (sums <= limit) & ((node + 1) * reach > query)
            query, node, sums, above = query[keep], node[keep], sums[keep], shared
        other = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
        query, node, sums = np.repeat(query, LEAF), np.repeat(node, LEAF), np.repeat(sums, LEAF)
        real = (other < n) & (other > query)
        query, other, node, sums = query[real], other[real], node[real], sums[real]
        keep = sums + np.bitwise_count((fps[query] ^ fps[other]) & ~self.levels[-1][1][node]) <= limit
        return self.order[query[keep]], self.order[other[keep]]


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def node_masks(level: int, width: int) -> list[int]:
    """Bit masks of the top nodes: level 0 fixes ``width`` leading bits of each third, level k >= 1 whole thirds of what is free, k times."""

    def thirds(bits: list[int]) -> list[list[int]]:
        n = len(bits)
        cut = [0, n // 3, n // 3 + (n - n // 3) // 2, n]
        return [bits[cut[i] : cut[i + 1]] for i in range(3)]

    free = list(range(64))
    if level == 0:
        return [sum(1 << i for i in t[:width]) for t in thirds(free)]
    fixed = [([], free)]
    for _ in range(level):
        fixed = [(have + t, [i for i in left if i not in set(t)]) for have, left in fixed for t in thirds(left)]
    return [sum(1 << i for i in have) for have, _ in fixed]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _children(level: int) -> list[list[int]]:
    """For each node kind of ``level``, the kinds of the next level that lie below it."""
    if level == 0:
        return [[0], [1], [2]]
    return [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(3**level)]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each top node; rows (node, bits, fp, rep) come sorted by (node, bits)."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        kind, bits, fp, rep = rows
        if not len(kind):
            return None
        new = np.flatnonzero((kind[1:] != kind[:-1]) | (bits[1:] != bits[:-1])) + 1
        out = []
        for at, to in zip(np.append(0, new).tolist(), np.append(new, len(kind)).tolist()):
            if to - at > 1:
                own = rep[at:to]
                a, b = GrayIndex(fp[at:to].view(np.uint64)).within(LIMIT)
                out += [(own[x], own[y]) for x, y in _spanning(a, b, to - at)]
        if not out:
            return None
        got = np.array(out, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = np.flatnonzero((rows[0] != rows[0][-1:]) | (rows[1] != rows[1][-1:])) if len(rows[0]) else []
        cut = int(last[-1]) + 1 if len(last) else 0  # the last node may go on in the next batch
        if (found := links([x[:cut] for x in rows])) is not None:
            yield found
        held = [x[cut:] for x in rows]
    if held is not None and (found := links(held)) is not None:
        yield found


def links(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that join all classes (fp long, rep long; distinct fp) at ``limit`` differing bits."""
    if limit != LIMIT:
        raise ValueError("thirds of the bits serve a limit of 2")
    n = classes.count()
    width = min(21, max(3, math.ceil(math.log2(max(n, 1) / AIM)) if n > AIM else 3))
    out, rows, level = None, None, 0
    while True:
        masks = node_masks(level, width)
        literal = F.array(*(F.lit(_signed(m)) for m in masks))
        if rows is None:
            at = classes.select("fp", "rep", F.explode(F.array(*map(F.lit, range(3)))).alias("node"))
        else:
            below = F.array(*(F.array(*map(F.lit, k)) for k in _children(level - 1)))
            at = rows.select("fp", "rep", F.explode(F.get(below, F.col("node"))).alias("node"))
        at = at.withColumn("bits", F.col("fp").bitwiseAND(F.get(literal, F.col("node"))))
        full = written(at.groupBy("node", "bits").count().where(F.col("count") > MOST).select(F.col("node").alias("n_"), F.col("bits").alias("b_")))
        on = (F.col("node") == F.col("n_")) & (F.col("bits") == F.col("b_"))
        more = bool(full.head(1)) and level < 6
        here = at.join(full, on, "left_anti") if more else at
        dealt = here.select("node", "bits", "fp", "rep").repartition("node", "bits").sortWithinPartitions("node", "bits")
        found = map_arrow(dealt, _linked, "a long, b long")
        out = found if out is None else out.unionAll(found)
        if not more:
            return out
        rows, level = at.join(full, on, "left_semi").select("fp", "rep", "node"), level + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of documents by SimHash at 2 or fewer differing bits.

    Returns (doc_id, fingerprint, component_id), a row for each row of ``docs``; other columns are not read.
    Null, empty and white-space texts have fingerprint zero and link like any other; rows with a null id
    get a fingerprint and no component. Equal texts meet as one class before the search, so large groups of
    copies cost no more than their rows. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    classes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes))
    least = classes.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f_"), F.coalesce("component", "rep").alias("root"))
    return prints.join(least, F.col("fp") == F.col("f_"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"),
    )


def _set_and_parts(text: str | None, width: int) -> tuple[int, np.ndarray, list[int]]:
    """Fingerprint, sorted distinct shingle hashes, and the partial fingerprints: votes of three neighbours on the ring of hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0, np.zeros(0, np.uint64), []
    shingles = map(b" ".join, zip(*(found[i:] for i in range(width)))) if len(found) > width else iter([b" ".join(found)])
    n = max(1, len(found) - width + 1)
    every = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = sum(np.unpackbits(every[at : at + _PART].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, n, _PART))
    own = np.unique(every)
    first = np.searchsorted(own, np.array([(j << 64) // PARTS for j in range(PARTS)], np.uint64))
    a, b, c = (own[(first + i) % len(own)] for i in range(3))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big"), own, ((a & b) | (b & c) | (a & c)).view(np.int64).tolist()


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int, sets: bool) -> DataFrame:
    """(doc_id, fp, key, n, p0, p1, ...) of every row, or with ``sets`` (doc_id, key, own): its distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(1):
                    fp, own, parts = _set_and_parts(text.as_py(), width)
                    key = xxhash.xxh3_128_digest(own.tobytes())
                    rows.append((key, own.view(np.int64)) if sets else (fp - (1 << 64) if fp >= 1 << 63 else fp, key, len(own), *(parts or [None] * PARTS)))
                cols = list(zip(*rows))
                types = [pa.binary(), pa.list_(pa.int64())] if sets else [pa.int64(), pa.binary(), pa.int32()] + [pa.int64()] * PARTS
                names = ["key", "own"] if sets else ["fp", "key", "n", *(f"p{j}" for j in range(PARTS))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    schema = "doc_id long, key binary, own array<long>" if sets else "doc_id long, fp long, key binary, n int, " + ", ".join(f"p{j} long" for j in range(PARTS))
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """(node, k): keys of sets (node, own array) of which two at a Jaccard similarity of ``similar`` share one: they have that share of the larger set in common."""
    each = sets.select("node", F.explode("own").alias("e"))
    return rarest(each, (F.col("n") - F.ceil(F.col("n") * similar - 1e-9) + 1).cast("int"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of rows with an id: groups linked by fingerprint or by the similarity of their shingles.

    Two documents are linked if their fingerprints over ``width``-word shingles differ in 2 or fewer bits (the Gray
    index), or if one of ``PARTS`` partial fingerprints is equal and the Jaccard similarity of their distinct
    shingles is ``similar`` or more (counted exactly, by 64-bit hashes). A partial fingerprint is the vote of three
    shingles, those whose hashes follow a place on the ring of all hashes; at a similarity of 0.8 all six differ in
    about one pair of a hundred. At 2 of 64 bits alone, most copies with two changed words in 300 would stay.
    Documents of the same shingles meet as one class first. Texts without a word are one group.
    """
    rows = written(_sketched(docs, id_col, text_col, width, False).where("doc_id is not null"))
    names = [f"p{j}" for j in range(PARTS)]
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("n", *names))))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a class may have several fingerprints, as these count repeats, and a fingerprint several classes
    same = rows.select("key", "fp").distinct().join(prints, "fp").join(classes.select("key", "node"), "key").where("node != rep")
    found = links(prints).unionAll(same.select(F.col("node").alias("a"), F.col("rep").alias("b")))
    members = shared_blocks(classes.where("n > 0"), names, "n")
    some = written(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key"))
    key, node = free_name(docs, "s_key"), free_name(docs, "s_node")
    wanted = docs.join(some.select(F.col("node").alias(node)).distinct(), F.col(id_col).cast("long") == F.col(node), "left_semi")
    own = _sketched(wanted, id_col, text_col, width, True).withColumnsRenamed({"doc_id": node, "key": key})
    own = own.join(some, (F.col(node) == F.col("node")) & (F.col(key) == F.col("key"))).dropDuplicates(["node", "key"])
    own = written(own.select("node", "own", F.size("own").alias("n")))
    near = lambda least, most: least >= most * similar - 1e-9

    def verified(pairs: DataFrame) -> DataFrame:
        two = pairs.join(own.select(F.col("node").alias("b"), F.col("own").alias("own_b"), F.col("n").alias("n_b")), "b").where(near(F.least("n_a", "n_b"), F.greatest("n_a", "n_b")))
        two = two.join(own.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a").withColumn("both", F.size(F.array_intersect("own_a", "own_b")))
        return written(two.where(F.col("both") >= (F.col("n_a") + F.col("n_b") - F.col("both")) * similar - 1e-9).select("a", "b"))

    joined = components(found.unionAll(block_links(members, verified, near, PARTS, lambda nodes: _prefixes(own.join(nodes, "node", "left_semi"), similar))))
    root = classes.select("key", F.col("node").alias("k_node")).join(joined, F.col("k_node") == F.col("node"), "left").select(F.col("key").alias("r_key"), F.coalesce("component", "k_node").alias("component_id"))
    return rows.join(root, F.col("key") == F.col("r_key")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are near duplicates (``similar_documents``) of one with a smaller id; same columns.

    Of rows that repeat an id, all stay or go together; rows with a null id stay.
    """
    key = free_name(docs, "gone_id")
    gone = similar_documents(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
