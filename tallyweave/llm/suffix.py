"""Removal of repeated stretches of bytes: column-wise construction over anchored stretches.

A stretch of ``LENGTH`` bytes that starts at two places of the collection goes, wherever it starts. Every such
stretch has an *anchor*: the first of its runs of ``GRAM`` bytes with the least hash. Equal stretches have equal
anchors at equal places, so only the *contexts* of one anchor (the bytes that stretches around it can reach)
can hold equal stretches, and they are aligned by it. An anchor that occurs once rules its context out; contexts
that are equal as a whole collapse to one with a count; the others are the strings of the construction.

``repeated_columns`` is that construction: one symbol of each string is put in each round, from the last column
to the first. The strings stay in the order of their suffixes, the transform is the column to the left in that
order, and the next round is a stable sort by it; the common prefix of neighbours follows from the least prefix
between their old places. Suffixes of one column only can be equal stretches here, so a round needs the newest
column's part of the transform only and its cost does not grow with the rounds before. The collection is dealt
into buckets by anchor, each read and written once as a sequential file (Spark's shuffle and tables); a bucket
holds about ``BUCKET`` strings.

An anchor with more than ``MOST`` different contexts, such as the edge of a passage that a third of all documents
share, is subdivided: its stretches are dealt by where they start into ``PIECES`` pieces, grouped by the bytes
that all stretches of a piece share. Equal pieces collapse again; a piece that still has too many
different strings is dealt once more, one stretch to a string, and these collapse to counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import dropped, if_small, map_arrow, shipped, written

#: Bytes of a stretch, and of an anchor; places of an anchor within its stretch.
LENGTH, GRAM = 200, 32
PLACES = LENGTH - GRAM + 1
#: Strings in a bucket; different contexts of an anchor, which fill one by themselves, from which it is subdivided; pieces then.
BUCKET = MOST = 20_000
PIECES = 13
#: Bytes that are hashed at once; a place within them fits in so many bits.
_CHUNK, _BITS = 1 << 17, 20
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``GRAM`` bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    for k, m in enumerate(_MULTIPLIERS):
        h = h[: -(1 << k)] * np.uint64(m) + h[1 << k :]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(32))


def _anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all stretches that start at ``starts`` (ascending) of ``data``."""
    h = _gram_hashes(data)
    least = (h & ~np.uint64((1 << _BITS) - 1)) | np.arange(len(h), dtype=np.uint64)  # the first of equal ones
    for k in (1, 2, 4, 8, 16, 32, 64):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[: -(PLACES - 128)], least[PLACES - 128 :])
    at = (least[starts] & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at].view(np.int64)


def _chunks(texts: list[memoryview]) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """The texts in chunks: lists of (text, from, to, first start, end of starts); long texts in overlapping parts."""
    out, size = [], 0
    for i, text in enumerate(texts):
        n = len(text)
        for at in range(0, max(n - LENGTH + 1, 0), _CHUNK):
            end = min(at + _CHUNK, n - LENGTH + 1)
            out.append((i, at, end + LENGTH - 1, at, end))
            size += end + LENGTH - 1 - at
            if size >= _CHUNK:
                yield out
                out, size = [], 0
    if out:
        yield out


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text binary) to (row, pos, last, h, c): the anchors; h their hash, c that of the context, last the last start of a stretch there."""
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), [memoryview(x.as_buffer()) for x in batch.column(1)]
        sizes = np.array([len(x) for x in texts], np.int64)
        done = np.full(len(texts), -1, np.int64)  # a long text's parts overlap: places up to here are out
        for chunk in _chunks(texts):
            data = np.concatenate([np.frombuffer(texts[i][a:b], np.uint8) for i, a, b, _, _ in chunk])
            bases = np.concatenate(([0], np.cumsum([b - a for _, a, b, _, _ in chunk])))
            starts = np.concatenate([np.arange(base + s - a, base + e - a) for base, (_, a, _, s, e) in zip(bases, chunk, strict=False)])
            at, h = _anchors(data, starts)
            part = np.searchsorted(bases, at, "right") - 1
            text = np.array([x[0] for x in chunk])[part]
            pos = at - bases[part] + np.array([x[1] for x in chunk])[part]
            new = pos > done[text]
            text, pos, h = text[new], pos[new], h[new]
            if not len(pos):
                continue
            np.maximum.at(done, text, pos)
            last = np.minimum(sizes[text] - pos - LENGTH, 0)
            c = [xxhash.xxh64_intdigest(texts[i][max(0, p - PLACES + 1) : p + LENGTH], min(p, PLACES - 1)) for i, p in zip(text.tolist(), pos.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(pos.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h), pa.array(np.array(c, np.uint64).view(np.int64))], names=["row", "pos", "last", "h", "c"])


def repeated_columns(strings: list[bytes], lefts: np.ndarray, width: int, length: int = LENGTH) -> np.ndarray:
    """Where equal runs of ``length`` bytes start: [string, column], for strings whose first byte is in column ``lefts``.

    Only runs that start in the same column are compared.
    """
    m = len(strings)
    columns = np.full((width, m), 256, np.uint16)  # 256: no symbol, equal to nothing
    sizes = np.array([len(s) for s in strings], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lefts, sizes)
    columns[place, owner] = np.frombuffer(b"".join(strings), np.uint8)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[i]: prefix shared by i - 1 and i in order
    out = np.zeros((m, max(width - length + 1, 0)), bool)
    for j in range(width - 1, -1, -1):
        transform = columns[j, order]
        moved = np.argsort(transform, kind="stable")
        symbols = transform[moved]
        same = np.flatnonzero((symbols[1:] == symbols[:-1]) & (symbols[1:] < 256)) + 1
        a, b = moved[same - 1], moved[same]
        least = common[b].copy()
        apart = np.flatnonzero(b - a > 1)
        if len(apart):
            least[apart] = np.minimum.reduceat(common, np.stack([a[apart] + 1, b[apart] + 1], 1).ravel())[::2]
        order, common = order[moved], np.zeros(m + 1, np.int32)
        common[same] = least + 1
        if j < out.shape[1]:
            out[order, j] = (common[:-1] >= length) | (common[1:] >= length)
    return out


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, last) of the runs of true columns."""
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge == 1)
    return rows, first, np.nonzero(edge == -1)[1] - 1


def _construct(table: pa.Table) -> pa.Table:
    """A bucket (h, c, left, n, text) to its runs of repeated starts (h, c, first, last), places relative to the anchor."""
    table = table.combine_chunks()
    texts, left, n = table["text"].to_pylist(), table["left"].to_numpy().astype(np.int64), table["n"].to_numpy()
    sizes = np.array([len(t) for t in texts], np.int64)
    found = repeated_columns(texts, left + PLACES - 1, PLACES - 1 + LENGTH)
    copies = np.flatnonzero((n > 1) & (sizes >= LENGTH))  # what has copies is repeated throughout
    for i in copies:
        found[i, left[i] + PLACES - 1 : left[i] + PLACES + sizes[i] - LENGTH] = True
    rows, first, last = _spans(found)
    at = pa.array(rows)
    return pa.table({"h": table["h"].take(at), "c": table["c"].take(at), "first": pa.array((first - PLACES + 1).astype(np.int32)), "last": pa.array((last - PLACES + 1).astype(np.int32))})


_RUNS = "h long, c long, first int, last int"


def _subdivided(texts: DataFrame, pieces: int) -> tuple[DataFrame, DataFrame]:
    """Deal the stretches of ``texts`` (h, c, left, n, text, lo, hi) by where they start, each range in ``pieces``.

    Returns the pieces that have equals as a whole (h, c, first, last), and one of each different piece among those that
    share all bytes common to their stretches but differ around them (the columns of ``texts``, and g).
    """
    step = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(pieces)).cast("int")
    cut = texts.withColumn("step", step).select("*", F.explode(F.sequence("lo", "hi", "step")).alias("p_lo"))
    cut = cut.withColumn("p_hi", F.least(F.col("p_lo") + F.col("step") - 1, "hi"))
    size = F.length("text")
    # what all stretches of the piece share; without it no stretch of the piece lies within the text
    cut = cut.where((F.col("p_hi") >= F.col("left")) & (F.col("p_lo") + LENGTH <= F.col("left") + size))
    first = F.greatest("p_lo", "left")
    last = F.least(F.col("p_hi"), F.col("left") + size - LENGTH).cast("int")
    bytes_ = lambda a, b: F.substring(F.col("text"), a - F.col("left") + 1, b - a)
    cut = cut.withColumns({"first": first, "last": last}).where("first <= last")
    cut = cut.withColumn("g", F.md5(bytes_(F.col("p_hi"), F.col("p_lo") + LENGTH)))
    whole = F.xxhash64("first", "last", bytes_(F.col("first"), F.col("last") + LENGTH))
    cut = written(cut.select("h", "c", "n", "first", "last", "p_lo", "p_hi", "g", whole.alias("whole")))
    groups = cut.groupBy("h", "p_lo", "g").agg(F.sum("n").alias("all"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("`all` > 1")
    groups = written(groups)
    both = cut.join(if_small(groups), ["h", "p_lo", "g"])
    own = both.where("w0 != w1").groupBy("h", "p_lo", "g", "whole").agg(F.sum("n").alias("own"), *(F.min(x).alias(x) for x in ("c", "first", "last", "p_hi")))
    own = written(own)  # one of each different piece, those with copies included: others may share a part with them
    copied = if_small(written(own.where("own > 1").select("h", "p_lo", "g", "whole", "own")))
    equal = both.join(copied, ["h", "p_lo", "g", "whole"], "left").where("w0 = w1 or own is not null")
    rest = own.join(texts.select("h", "c", F.col("left").alias("t_left"), "text"), ["h", "c"])
    body = F.expr(f"substring(text, first - t_left + 1, last - first + {LENGTH})").alias("text")
    rest = rest.select("h", "c", F.col("own").alias("n"), "g", F.col("first").alias("left"), F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"), body)
    return written(equal.select("h", "c", "first", "last")), written(rest)


def _constructed(texts: DataFrame) -> DataFrame:
    """The construction over buckets of ``texts`` (h, c, left, n, text; with the group b_key that must stay together)."""
    spark = texts.sparkSession
    shipped(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // BUCKET))
    dealt = texts.select("h", "c", "left", "n", "text", F.pmod(F.xxhash64("b_key"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInArrow(_construct, _RUNS)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """Runs (h, c, first, last) of starts, relative to the anchor, of stretches of ``texts`` (h, c, left, n, k, text) found twice.

    ``k`` is the number of texts with the anchor h. Texts with n > 1 copies are repeated throughout.
    """
    out = _constructed(texts.where(F.col("k") <= MOST).withColumn("b_key", F.hex("h")))
    hot = texts.where(F.col("k") > MOST)
    if hot.isEmpty():
        return out
    hot = hot.select("h", "c", "n", "left", "text", F.lit(1 - PLACES).alias("lo"), F.lit(0).alias("hi"))
    equal, rest = _subdivided(hot, PIECES)
    parts = ("h", "lo", "g")
    many = if_small(written(rest.groupBy(*parts).agg(F.count("*").alias("k")).where(F.col("k") > MOST).select(*parts)))
    few = rest.join(many, [*parts], "left_anti").withColumn("b_key", F.concat_ws(":", F.hex("h"), "lo", "g"))
    single, _ = _subdivided(rest.join(many, [*parts], "left_semi").drop("g"), PLACES)
    return out.unionByName(equal).unionByName(_constructed(few)).unionByName(single)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text binary, marks) to (id, n_bytes, spans, kept)."""
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, marks in zip(batch.column(1), batch.column(2), strict=True):
            text, own, at, parts = text.as_py(), [], 0, []
            for a, b in sorted((m["start"], m["stop"]) for m in marks.as_py() or ()):
                if own and a <= own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], b)
                else:
                    own.append({"start": a, "stop": b})
            for s in own:
                parts.append(text[at : s["start"]])
                at = s["stop"]
            sizes.append(len(text))
            spans.append(own)
            kept.append(b"".join([*parts, text[at:]]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: ``id_col``, n_bytes, spans array<struct<start, stop>>, kept binary.

    ``spans`` are the maximal runs of UTF-8 bytes covered by stretches of ``LENGTH`` bytes that start at another place
    too, in any document or the same one; ``kept`` is the rest, joined (it may cut a character). Stretches never cross documents
    and are judged on the input. A null text counts as empty: no bytes, no spans. Rows that repeat an id, or
    are equal as a whole, are documents of their own, and so copies of each other. Ids may be null or
    of any type; other columns are ignored. An empty table gives no rows.

    Contexts are told apart by 64-bit hashes under equal 64-bit anchor hashes; those that are not alike are compared
    byte by byte.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    base = written(rows.withColumn("row", F.monotonically_increasing_id()), "zstd")
    sized = base.select("row", F.length("text").alias("n_bytes"), "text")
    anchors = map_arrow(sized.where(F.col("n_bytes") >= LENGTH).select("row", "text"), anchor_rows, "row long, pos int, last int, h long, c long")
    anchors = written(anchors, "zstd")
    groups = anchors.groupBy("h").agg(F.count("*").alias("all"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("`all` > 1")
    groups = if_small(written(groups.select("h", (F.col("c0") == F.col("c1")).alias("alike"))))
    shared = written(anchors.join(groups, "h"), "zstd")
    dropped(anchors)
    at = (F.col("row").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")).cast("decimal(38,0)")
    each = shared.where("not alike").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    per = each.groupBy("h").agg(F.count("*").alias("k"))
    each = written(each.join(per, "h").select("h", "c", "n", "k", F.expr(f"`at` div {1 << 31}L").alias("row"), (F.col("at") % (1 << 31)).cast("int").alias("pos")))
    start = F.greatest(F.col("pos") - (PLACES - 1), F.lit(0))
    body = F.substring(F.col("text"), start + 1, F.least(F.col("pos") + LENGTH, "n_bytes") - start)
    texts = written(sized.join(each, "row").select("h", "c", "n", "k", (start - F.col("pos")).cast("int").alias("left"), body.alias("text")), "zstd")
    dropped(each)
    runs = written(repeated_runs(texts))
    dropped(texts)
    whole = shared.where("alike").select("row", "pos", F.greatest(-F.col("pos"), F.lit(1 - PLACES)).alias("first"), "last")
    parts = shared.where("not alike").drop("last").join(runs, ["h", "c"]).select("row", "pos", "first", "last")
    span = F.struct((F.col("pos") + F.col("first")).cast("long").alias("start"), (F.col("pos") + F.col("last") + LENGTH).cast("long").alias("stop"))
    marks = whole.unionAll(parts).groupBy("row").agg(F.collect_list(span).alias("marks"))
    out = map_arrow(base.join(marks, "row", "left").select("id", "text", "marks"), _cut, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out


def removed(spans: Column) -> Column:
    """The number of bytes in ``spans``."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
