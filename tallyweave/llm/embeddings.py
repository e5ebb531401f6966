"""Embedding near-duplicates with a product-quantised inverted index.

Unit vectors are dealt to the nearest of a number of coarse centroids (the inverted lists); what is left of
each is coded by the nearest codeword in every subspace. A query goes to all lists that can hold a partner:
a partner within r = sqrt(2 - 2 least) whose nearest centroid is c lies on c's side of the plane between c
and the query's own centroid, so lists whose plane is farther than r are left out and nothing is lost. In
a list, distances come from a table of the query's distances to the codewords; members whose table distance
less their own quantisation error is over r are left out, again without loss, and the rest are compared by
exact cosine in double precision. The centroids and codewords are fitted on at most ``SAMPLE`` vectors; they
decide how much is compared, never what is found, so recall is 1 up to rounding.

Equal vectors of a label collapse before the search and count with their number. Lists are split into
chunks of about ``CHUNK`` members, and what leaves a chunk are counts a vector and links that join its parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import map_arrow, written
from tallyweave.llm.components import components

#: Vectors that centroids and codewords are fitted on at most (fewer if their numbers exceed SAMPLE_VALUES).
SAMPLE, SAMPLE_VALUES = 20_000, 1 << 22
LIST, MOST_LISTS, CHUNK, CODES, ROUNDS = 2048, 1024, 1024, 64, 8
#: Allowance for rounding where something is left out.
SLACK = 1e-6


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centroids of rows by Lloyd's rounds from a seeded choice of rows."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        full = counts > 0
        c[full] = sums[full] / counts[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids and a codebook for each subspace of their residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        d = sample.shape[1]
        self.coarse = k_means(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        parts = max(1, min(8, d // 4))
        self.cut = [d * i // parts for i in range(parts + 1)]
        self.books = [k_means(rest[:, a:b], CODES, seed=a + 1) for a, b in zip(self.cut, self.cut[1:])]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of rows."""
        own = nearest(x, self.coarse)
        rest = x - self.coarse[own]
        return own, np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(zip(self.cut, self.cut[1:]), self.books)], 1)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[own] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)

    def table_distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows to the members of list ``at``, by their codes."""
        rest, out = x - self.coarse[at], np.zeros((len(x), len(codes)))
        for s, ((a, b), book) in enumerate(zip(zip(self.cut, self.cut[1:]), self.books)):
            table = (rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(1)
            out += table[:, codes[:, s]]
        return np.maximum(out, 0)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Boolean (rows, lists): lists that may hold a vector within ``reach``."""
        c = self.coarse
        score = (c * c).sum(1) - 2 * x @ c.T
        apart = np.sqrt(np.maximum(((c[own][:, None, :] - c[None]) ** 2).sum(2), 1e-30)) if len(x) * c.size < 1 << 24 else None
        if apart is None:
            between = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 1e-30))
            apart = between[own]
        plane = (score - score[np.arange(len(x)), own][:, None]) / (2 * apart)
        return plane <= reach + SLACK


def _usable(vector: Column, label: Column, id_: Column) -> Column:
    """Whether a row can link: no null or non-finite part and not all zero."""
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0))))
    return F.coalesce(id_.isNotNull() & label.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros behind shorter ones."""
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of vectors of equal label and length with cosine ``least`` or more, and the classes they make.

    Returns vec_id, n_links (other rows linked directly), component_id (least vec_id reachable, itself
    included) and kept (vec_id = component_id), a row for each row; other columns are not read. Rows with a null
    id, label or vector, a zero vector or null or non-finite components link with nothing. Rows that repeat an
    id are one node, each with the links of its own vector. An empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0, 1 at most")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    base = base.withColumn("ok", _usable(F.col("v"), F.col("label"), F.col("vec_id")))
    base = base.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "v")))
    unique = base.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("label").alias("label"))
    unique = written(unique.withColumn("part", F.xxhash64("label", F.size("v"))).drop("label"))
    links = _links(unique, least)
    if links is None:
        per, root = None, None
    else:
        links = written(links)
        per = links.where("b is null").groupBy("a").agg(F.sum("n").alias("more"))
        root = components(links.where("b is not null").select("a", "b"))
    classes = unique.select("h1", "h2", "rep", "n")
    if per is not None:
        classes = classes.join(per, F.xxhash64("h1", "h2") == F.col("a"), "left").join(root, F.col("rep") == F.col("node"), "left")
        classes = classes.select("h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("root"))
    else:
        classes = classes.select("h1", "h2", (F.col("n") - 1).alias("links"), F.col("rep").alias("root"))
    rows = base.select("vec_id", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    out = rows.join(classes, (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(unique: DataFrame, least: float) -> DataFrame | None:
    """Rows (a, b, n): with b null, n further rows are linked to class a; else classes of ids a and b are joined."""
    spark = unique.sparkSession
    size = unique.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not size["n"]:
        return None
    d, reach = size["d"], math.sqrt(max(0.0, 2 - 2 * least))
    rows = unique.orderBy(F.xxhash64(F.lit(7), "h1", "h2"), "h1").limit(max(1, min(SAMPLE, SAMPLE_VALUES // d))).select("v").collect()
    sample = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        sample[i, : len(r["v"])] = r["v"]
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    shared = spark.sparkContext.broadcast(Quantiser(sample, max(1, min(MOST_LISTS, round(size["n"] / LIST)))))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            x = _matrix(batch.column(4), d)
            u = x / np.linalg.norm(x, axis=1)[:, None]
            own, codes = q.code(u)
            error = np.linalg.norm(u - q.decoded(own, codes), axis=1)
            near = q.probes(u, own, reach)
            others = [np.flatnonzero(row[at + 1 :]) + at + 1 for row, at in zip(near, own.tolist())]
            out = [*batch.columns, pa.array(own), pa.array([c.astype(np.uint8).tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(others, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["part", "id", "rep", "n", "v", "list", "codes", "error", "others"])

    kinds = "part long, id long, rep long, n long, v array<double>, list long, codes binary, error double, others array<long>"
    picked = unique.select("part", F.xxhash64("h1", "h2").alias("id"), "rep", "n", "v")
    all_ = written(map_arrow(picked, coded, kinds))
    chunks = all_.groupBy("part", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = written(chunks.select(F.col("part").alias("p_"), F.col("list").alias("l_"), "chunks"))
    on = (F.col("part") == F.col("p_")) & (F.col("list") == F.col("l_"))
    mine = all_.join(chunks, on).withColumn("chunk", F.pmod("id", F.col("chunks")).cast("int"))
    members = mine.select("part", "list", "chunk", F.lit(0).alias("kind"), "id", "rep", "n", "v", "codes", "error")
    # a query meets its own chunk and the later ones of its list, and all chunks of the later lists it probes
    later = mine.select("part", "list", F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("to"), "chunk", "id", "rep", "n", "v")
    later = later.select("part", "list", F.col("to").alias("chunk"), F.when(F.col("to") == F.col("chunk"), 1).otherwise(2).alias("kind"), "id", "rep", "n", "v")
    away = all_.select("part", F.explode("others").alias("list"), "id", "rep", "n", "v").join(chunks, on)
    away = away.select("part", "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(2).alias("kind"), "id", "rep", "n", "v")
    queries = later.unionByName(away).withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
    dealt = members.unionByName(queries).repartition("part", "list", "chunk").sortWithinPartitions("part", "list", "chunk", "kind")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, key, held = shared.value, None, []

        def flush(block: list, asked: list) -> pa.RecordBatch | None:
            ids, reps, ns, x, codes, error, where = block
            qi, qr, qn, y, own = asked
            unit = y / np.linalg.norm(y, axis=1)[:, None]
            keep = np.sqrt(q.table_distances(unit, where, codes)) <= reach + error + SLACK
            keep &= ~own[:, None] | (qi[:, None] < ids)
            a, b = np.nonzero(keep)
            cosine = np.empty(len(a))
            norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            for at in range(0, len(a), 1 << 16):
                s = slice(at, at + (1 << 16))
                cosine[s] = np.einsum("ij,ij->i", y[a[s]], x[b[s]]) / (norm_y[a[s]] * norm_x[b[s]])
            a, b = a[cosine >= least], b[cosine >= least]
            if not len(a):
                return None
            counts: dict[int, int] = {}
            for i, n in zip(qi[a].tolist(), ns[b].tolist()):
                counts[i] = counts.get(i, 0) + n
            for i, n in zip(ids[b].tolist(), qn[a].tolist()):
                counts[i] = counts.get(i, 0) + n
            root: dict[int, int] = {}

            def find(i: int) -> int:
                while (up := root.get(i, i)) != i:
                    root[i] = root.get(up, up)
                    i = up
                return i

            joined = []
            for i, j in zip(qr[a].tolist(), reps[b].tolist()):
                p, r = find(i), find(j)
                if p != r:
                    root[max(p, r)] = min(p, r)
                    joined.append((i, j))
            left = [*counts, *(i for i, _ in joined)]
            right = [None] * len(counts) + [j for _, j in joined]
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array([*counts.values(), *[0] * len(joined)], pa.int64())], ["a", "b", "n"])

        block = None
        for batch in batches:
            part, list_, chunk, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.flatnonzero((part[1:] != part[:-1]) | (list_[1:] != list_[:-1]) | (chunk[1:] != chunk[:-1]) | ((kind[1:] > 0) != (kind[:-1] > 0))) + 1
            for at, to in zip(np.append(0, new).tolist(), np.append(new, len(part)).tolist()):
                if to == at:
                    continue
                rows = batch.slice(at, to - at)
                ids, reps, ns = (rows.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6))
                x = _matrix(rows.column(7), d)
                here = (part[at], list_[at], chunk[at])
                if kind[at] == 0:
                    codes = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint8).reshape(to - at, -1).astype(np.int64)
                    now = [ids, reps, ns, x, codes, rows.column(9).to_numpy(zero_copy_only=False)]
                    held = [np.concatenate(v) for v in zip(held, now)] if key == here else now
                    key, block = here, None
                else:
                    block = block or [*held, int(list_[at])]
                    for s in range(0, to - at, 512):
                        e = slice(s, s + 512)
                        if (found := flush(block, [ids[e], reps[e], ns[e], x[e], kind[at:to][e] == 1])) is not None:
                            yield found

    return map_arrow(dealt, compared, "a long, b long, n long")
