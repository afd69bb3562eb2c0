"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans and exact reranking.

The square of a Euclidean distance is |q|^2 - 2 q.x + |x|^2, so the nearest are the largest inner
products once |x|^2, which is kept exactly, is taken off. Vectors are quantised in blocks of two
dimensions by 16 centroids each; the loss weighs the part of the residual that is parallel to the vector
more than the rest, since that part changes the products that matter. Two codes make a byte; a query's
scores against all codes are sums of table entries. Centred at c, a score is off by at most |q - c| times the
norm of the vector's residual, which is kept: the best by score are ranked exactly first, then all others
that this bound does not put behind the k-th of them, so the result is exact.

The index is laid out by coarse cells, of which the radius is known. A query has k neighbours within some
distance in the sample already; cells that lie farther off are not read for it. Queries are asked by cell, so
that those of one block leave out the same cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.shared import kept, release

#: Centroids of a block, and its dimensions.
CENTROIDS, WIDTH = 16, 2
#: Vectors that the codebooks are fitted on at most, queries that one pass over the vectors answers, and vectors scanned at a time.
SAMPLE, QUERIES_AT_ONCE, VECTORS_AT_ONCE = 8192, 2048, 4096
#: Coarse cells by which the index is laid out at most, and sample vectors to each at least.
CELLS, CELL_SAMPLE = 64, 32
#: Candidates by score that are ranked exactly first, from which on the bound rules out others, and the share of the largest products that the loss is tuned to.
RERANK, THRESHOLD = 200, 0.2


@dataclass
class Codebooks:
    centroids: np.ndarray  # blocks, 16, dimensions of a block
    dims: int
    centre: np.ndarray

    def padded(self, x: np.ndarray) -> np.ndarray:
        blocks, _, width = self.centroids.shape
        out = np.zeros((len(x), blocks * width))
        out[:, : self.dims] = x
        return out.reshape(len(x), blocks, width)


def parallel_weight(dims: int, threshold: float = THRESHOLD) -> float:
    """How much more a residual's parallel part costs than the rest, for products above threshold of the norms."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def assign(x: np.ndarray, books: Codebooks, extra: float, rounds: int = 2) -> np.ndarray:
    """Codes (rows, blocks) by coordinate descent on the anisotropic loss; extra is the parallel weight less 1."""
    parts, c = books.padded(x), books.centroids
    norm = np.linalg.norm(parts.reshape(len(x), -1), axis=1)
    unit = parts / np.maximum(norm, 1e-30)[:, None, None]
    plain = ((parts[:, :, None, :] - c[None]) ** 2).sum(-1)
    codes = plain.argmin(-1)
    at = np.arange(c.shape[0])
    along = (unit * (parts - c[at, codes])).sum(-1)  # of each block, the residual's part along the vector
    for _ in range(rounds if extra > 0 else 0):
        total = along.sum(1)
        for m in range(c.shape[0]):
            others = total - along[:, m]
            own = (unit[:, m, None, :] * (parts[:, m, None, :] - c[m][None])).sum(-1)
            codes[:, m] = (plain[:, m] + extra * (others[:, None] + own) ** 2).argmin(1)
            along[:, m] = own[np.arange(len(x)), codes[:, m]]
            total = others + along[:, m]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, width: int = WIDTH, rounds: int = 8, threshold: float = THRESHOLD, seed: int = 7) -> Codebooks:
    """Codebooks of the sample x by alternating assignment and the exact least-squares centroids of the anisotropic loss."""
    dims = x.shape[1]
    blocks = -(-dims // width)
    centre = x.mean(0)
    x = x - centre
    rng = np.random.default_rng(seed)
    books = Codebooks(np.zeros((blocks, CENTROIDS, width)), dims, centre)
    parts = books.padded(x)
    start = rng.choice(len(x), CENTROIDS, replace=len(x) < CENTROIDS)
    books.centroids[:] = parts[start].transpose(1, 0, 2) + rng.normal(0, 1e-9, (blocks, CENTROIDS, width))
    extra = parallel_weight(dims, threshold) - 1
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for step in range(rounds):
        codes = assign(x, books, extra if step >= rounds // 2 else 0.0)
        along = (unit * (parts - books.centroids[np.arange(blocks), codes])).sum(-1)
        total = along.sum(1)
        for m in range(blocks):
            own = unit[:, m]
            others = total - along[:, m]
            weight = extra if step >= rounds // 2 else 0.0
            # sum of I + extra u u' and of x + extra u (others + u.x), for each centroid
            left = np.zeros((CENTROIDS, width, width))
            right = np.zeros((CENTROIDS, width))
            np.add.at(left, codes[:, m], np.eye(width) + weight * own[:, :, None] * own[:, None, :])
            np.add.at(right, codes[:, m], parts[:, m] + weight * own * (others + (own * parts[:, m]).sum(1))[:, None])
            used = np.bincount(codes[:, m], minlength=CENTROIDS) > 0
            books.centroids[m, used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            if (~used).any():
                books.centroids[m, ~used] = parts[rng.choice(len(x), (~used).sum()), m]
            along[:, m] = (own * (parts[:, m] - books.centroids[m, codes[:, m]])).sum(1)
            total = others + along[:, m]
    return books


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, books: Codebooks) -> np.ndarray:
    """For each query and byte of codes, the 256 sums of its two blocks' products."""
    each = np.einsum("qmw,mkw->qmk", books.padded(queries), books.centroids)
    if each.shape[1] % 2:
        each = np.concatenate([each, np.zeros((len(each), 1, CENTROIDS))], 1)
    return (each[:, 1::2, :, None] + each[:, ::2, None, :]).reshape(len(each), -1, 256).astype(np.float32)


def residual(x: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """Norms of what the codes leave of the centred vectors x."""
    made = books.centroids[np.arange(books.centroids.shape[0]), codes].reshape(len(x), -1)[:, : books.dims]
    return np.linalg.norm(x - made, axis=1)


def cells(x: np.ndarray, most: int = CELLS, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Centroids of the sample x by k-means, ordered along its widest direction, so that neighbours in number tend to lie close."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), max(1, min(most, len(x) // CELL_SAMPLE)), replace=False)]
    for _ in range(rounds):
        own = distances(x, found).argmin(1)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    away = found - found.mean(0)
    return found[np.argsort(away @ np.linalg.svd(away, full_matrices=False)[2][0], kind="stable")]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, without the cancellation of the expanded square."""
    out = np.empty((len(a), len(b)))
    for j, y in enumerate(b):
        out[:, j] = np.sqrt(((a - y) ** 2).sum(1))
    return out


def within_sample(sample_ids: np.ndarray, sample: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a distance within which k sample vectors of other ids lie; infinite if there are fewer."""
    reach = np.full(len(queries), np.inf)
    square = (sample**2).sum(1)
    for lo in range(0, len(queries), 256):
        # products choose k vectors close by; whichever they are, their own distances bound the k-th nearest
        guess = square - 2 * queries[lo : lo + 256] @ sample.T
        for i, g in enumerate(guess):
            g = np.where(sample_ids == query_ids[lo + i], np.inf, np.nan_to_num(g, nan=np.inf))
            if np.isfinite(g).sum() >= k:
                rows = np.argpartition(g, k - 1)[:k]
                reach[lo + i] = np.sqrt(((sample[rows] - queries[lo + i]) ** 2).sum(1)).max()
    return reach


def open_cells(queries: np.ndarray, reach: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether a cell may hold vectors within a query's reach (queries, cells); cells without vectors hold none."""
    d = distances(queries, centres)
    # a hair more than what rounding can take off
    return (radius >= 0) & (d - radius <= reach[:, None] + 1e-12 * (d + np.abs(radius) + 1))


def scan(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, books: Codebooks, query_ids: np.ndarray, queries: np.ndarray, chosen: np.ndarray, k: int, rerank: int, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, row, distance) of those of the k nearest rows for each chosen query that lie within its reach.

    left: the norms of the residuals. reach: for each query a distance within which k vectors are known to
    lie; it is brought down to that of the k-th row here.
    """
    half = ((x - books.centre) ** 2).sum(1).astype(np.float32) / 2
    if not len(x):
        return
    tiny = np.finfo(np.float32)
    for lo in range(0, len(chosen), 64):
        some = chosen[lo : lo + 64]
        own = queries[some]
        table = tables(own - books.centre, books)
        norm = np.linalg.norm(own - books.centre, axis=1)
        # what the sums of single precision can be off by
        most = np.abs(table).max(2).sum(1, dtype=np.float64)
        terms = 2.0 * (codes.shape[1] + 2)
        score = np.repeat(half[None], len(own), 0)
        for byte in range(codes.shape[1]):
            score -= table[:, byte][:, codes[:, byte]]
        for i, number in enumerate(some):
            s, other = score[i], ids != query_ids[number]
            ahead = np.argpartition(s, rerank - 1)[:rerank] if len(s) > rerank else np.arange(len(s))
            rows = ahead[other[ahead]]
            d = np.sqrt(((x[rows] - own[i]) ** 2).sum(1))
            if len(d) >= k:
                reach[number] = min(reach[number], np.partition(d, k - 1)[k - 1])
            if len(s) > rerank:
                edge = reach[number] ** 2 / 2 - norm[i] ** 2 / 2 + 2.0**-40 * (reach[number] ** 2 + norm[i] ** 2)
                slack = terms * (tiny.eps * (half + most[i]) + tiny.tiny)
                # a score that overflows rules out nothing
                near = other & ~(s - norm[i] * left - slack > edge)
                near[ahead] = False
                more = np.flatnonzero(near)
                rows, d = np.concatenate([rows, more]), np.concatenate([d, np.sqrt(((x[more] - own[i]) ** 2).sum(1))])
            best = np.lexsort((ids[rows], d))[:k]
            best = best[d[best] <= reach[number]]
            if len(best) == k:
                reach[number] = min(reach[number], d[best[-1]])
            yield np.full(len(best), number), rows[best], d[best]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    found = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return found.where(f"{finite} and exists(v, x -> x != 0)")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims or (len(flat) // max(1, len(column))))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding", rerank: int = RERANK, sample: int = SAMPLE, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of the k nearest rows to each row whose id is divisible by every.

    Rows with a null id or vector, a zero vector, or null or non-finite components take no part; neither do
    vectors of another length than most in the sample. Ties go to the smaller id. A row is no neighbour of
    rows with its own id; repeated rows are neighbours each, and a query whose id repeats is searched once,
    with its least vector. Fewer candidates than k: all. An empty table gives no rows.

    The codebooks and cells are fitted on the sample vectors whose ids hash lowest. All vectors are coded and
    laid out by cell. Queries are taken in blocks of at_once at most, the only thing that is sent to the
    tasks besides the codebooks; each block reads the cells that may hold neighbours of its queries, and a
    task passes on its k exact nearest only. The k nearest are exact, whatever rerank is: it is the number
    that is ranked before the error bound rules out others.
    """
    spark = vectors.sparkSession
    valid = usable(vectors, id_column, vector_column)
    result, final = "query_id long, vec_id long, score double", "query_id long, rank int, vec_id long, score double"
    picked = kept(valid.orderBy(F.xxhash64("id"), "id", "v").limit(sample))
    drawn = picked.toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], final)
    lengths = pc.list_value_length(drawn.column("v"))
    dims = int(pc.mode(lengths)[0]["mode"].as_py())
    valid = valid.where(F.size("v") == dims)
    drawn = drawn.filter(pc.equal(lengths, dims))
    sample_ids, sampled = drawn.column("id").to_numpy(), matrix(drawn.column("v"), dims)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), matrix(b.column(1), dims)) for b in batches if b.num_rows]
        ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        x = x[np.lexsort((*x.T[::-1], ids))]  # whatever order the rows come in
        books = fit(x)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (books.centroids, books.centre, cells(x))], names=["centroids", "centre", "cells"])

    # one task fits, so that the driver gets no more than the codebooks
    made = picked.where(F.size("v") == dims).repartition(1).mapInArrow(fitted, "centroids binary, centre binary, cells binary").collect()[0]
    books = Codebooks(np.frombuffer(made.centroids).reshape(-1, CENTROIDS, WIDTH), dims, np.frombuffer(made.centre))
    centres = np.frombuffer(made.cells).reshape(-1, dims)
    extra = parallel_weight(dims) - 1
    sent = spark.sparkContext.broadcast((books, centres, sample_ids, sampled))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centres, _, _ = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                part = batch.slice(at, VECTORS_AT_ONCE)
                x = matrix(part.column(1), dims)
                d = distances(x, centres)
                cell = d.argmin(1)
                x = x - books.centre
                codes = assign(x, books, extra)
                columns = [part.column(0), part.column(1), pa.array([c.tobytes() for c in packed(codes)], pa.binary()), pa.array(residual(x, codes, books)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "codes", "residual", "cell", "away"])

    coded = valid.mapInArrow(encode, "id long, v array<double>, codes binary, residual double, cell int, away double")
    # ranges of cell and id: a cell with many vectors takes many files, and a file holds few cells
    index = kept(coded.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"))
    radius = np.full(len(centres), -1.0)
    for cell, far in index.groupBy("cell").agg(F.max("away")).collect():  # a row for each cell
        radius[cell] = far

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = within_sample(sent.value[2], sent.value[3], batch.column(0).to_numpy(), matrix(batch.column(1), dims), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach)], names=["id", "v", "cell", "reach"])

    # a query's least vector stands for it
    least = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")
    queries = kept(least.mapInArrow(bounded, "id long, v array<double>, cell int, reach double"))
    found = None
    for wanted in blocks({r.cell: r["count"] for r in queries.groupBy("cell").count().collect()}, at_once):
        own = queries.where(wanted).toArrow().sort_by("id")
        query_ids, of = own.column("id").to_numpy(), matrix(own.column("v"), dims)
        reach = own.column("reach").to_numpy()
        near = open_cells(of, reach, centres, radius)
        asked = spark.sparkContext.broadcast((query_ids, of, reach, near))

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            query_ids, of, reach, near = asked.value
            reach = reach.copy()
            best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query number, id, distance
            for batch in batches:
                for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
                    part = batch.slice(at, VECTORS_AT_ONCE).sort_by([("cell", "ascending"), ("id", "ascending")])
                    cell = part.column(4).to_numpy()
                    for lo, hi in zip(*(np.searchsorted(cell, np.unique(cell), side) for side in ("left", "right")), strict=True):
                        chosen = np.flatnonzero(near[:, cell[lo]])
                        rows = part.slice(lo, hi - lo)
                        ids, x = rows.column(0).to_numpy(), matrix(rows.column(1), dims)
                        codes = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                        best += [(q, ids[r], d) for q, r, d in scan(ids, x, codes, rows.column(3).to_numpy(), sent.value[0], query_ids, of, chosen, k, rerank, reach)]
                    if len(best) > 8 * len(of):
                        best = [shortened(best, k)]
            if best:
                q, ids, d = shortened(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids), pa.array(d)], names=["query_id", "vec_id", "score"])

        part = kept(index.where(F.col("cell").isin(np.flatnonzero(near.any(0)).tolist())).mapInArrow(search, result))
        found = part if found is None else found.unionByName(part)
    release(picked, index, queries)
    if found is None:
        return spark.createDataFrame([], final)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def blocks(counts: dict[int, int], at_once: int) -> list[Column]:
    """Conditions that deal queries (id, cell) into blocks of about at_once: neighbouring cells with few together, a cell with many in parts by hash."""
    out, some, held = [], [], 0
    for cell in sorted(counts):
        n = counts[cell]
        if some and held + n > at_once:
            out.append(F.col("cell").isin(some))
            some, held = [], 0
        if n > at_once:
            parts = -(-n // at_once)
            out += [(F.col("cell") == cell) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == p) for p in range(parts)]
        else:
            some, held = [*some, cell], held + n
    return [*out, F.col("cell").isin(some)] if some else out


def shortened(best: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query."""
    q, ids, d = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((ids, d, q))
    q, ids, d = q[order], ids[order], d[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], d[keep]
