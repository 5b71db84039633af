"""Nearest vectors through an inverted index of two-level cells, with quantised codes.

k-means on a bounded sample gives coarse cells, and within each the cells proper; a vector goes to the nearest coarse one, and there to the nearest of its cells. A query
looks into the cells whose centres are nearest to it. Their members are compared by codes of a byte for each few dimensions (product quantisation), and the best by code
again by the vectors themselves. Vectors that are equal up to their length are one in the index, with a list of ids kept beside it, so that a vector that a third of all rows
share is compared once. A cell's rows are dealt into blocks of bounded size. No matrix has more than MATRIX numbers, however many rows or cells there are.

exact=True leaves codes aside and looks on: the angle between a query and a cell's members is at least that to the centre less the cell's widest angle, so cells that
could hold a nearer vector than the k-th found are looked into as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vector import cosine
from millrace.operators.graph import cut

#: Vectors that centres are fitted on, at most, rows of a block, and numbers of a matrix.
SAMPLE, BLOCK_ROWS, MATRIX = 20_000, 4096, 1 << 22
#: Dimensions of a code's byte, and how many times k are taken by code before the vectors are asked.
CODE_DIMS, BY_CODE = 4, 20


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    whole = not column.null_count and not flat.null_count
    return unit(np.asarray(flat.to_numpy(zero_copy_only=False) if whole else column.to_pylist(), np.float64).reshape(len(column), -1))


def sample_rows(vectors: DataFrame, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """The first `sample` vectors by hash, at length one."""
    few = vectors.select(vector).where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).collect()  # bounded
    return unit(np.array([r[0] for r in few], np.float64))


def pieces(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows, so that a matrix of a slice by width has MATRIX numbers at most (or one row)."""
    step = max(1, MATRIX // max(1, width))
    return (slice(at, at + step) for at in range(0, n, step))


def nearest_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[p] @ centres.T).argmax(axis=1) for p in pieces(len(x), len(centres))] or [np.zeros(0, np.int64)])


def centres_of(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    centres = x[np.random.default_rng(1).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own, sums = nearest_of(x, centres), np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres


@dataclass
class Cells:
    """Coarse centres, the centres of the cells, and where each coarse one's cells start."""

    coarse: np.ndarray
    centres: np.ndarray
    starts: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, cells: int) -> Cells:
        """About `cells` cells, dealt to coarse ones by their share of the sample."""
        coarse = centres_of(x, max(1, min(len(x), round(cells**0.5))))
        own = nearest_of(x, coarse)
        fine = []
        for k in range(len(coarse)):
            mine = x[own == k]
            fine.append(centres_of(mine, max(1, min(len(mine), round(cells * len(mine) / max(1, len(x)))))) if len(mine) else coarse[k : k + 1])
        return cls(coarse, np.concatenate(fine) if fine else coarse, np.r_[0, np.cumsum([len(f) for f in fine])])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its cosine to that cell's centre."""
        top = nearest_of(x, self.coarse)
        cell, near = np.zeros(len(x), np.int64), np.zeros(len(x))
        for k in np.unique(top).tolist():
            mine, own = np.flatnonzero(top == k), self.centres[self.starts[k] : self.starts[k + 1]]
            cell[mine] = self.starts[k] + nearest_of(x[mine], own)
        for p in pieces(len(x), x.shape[1] if x.ndim == 2 else 1):
            near[p] = (x[p] * self.centres[cell[p]]).sum(axis=1)
        return cell, near


@dataclass
class Codes:
    """Of each few dimensions 256 centres at most; a vector's code has the number of the nearest one for each."""

    books: list[np.ndarray]
    edges: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, dims: int = CODE_DIMS, rounds: int = 8) -> Codes:
        edges = np.r_[np.arange(0, x.shape[1], dims), x.shape[1]]
        books = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = x[:, a:b]
            book = part[np.random.default_rng(2).permutation(len(part))[:256]].copy()
            for _ in range(rounds):
                own, sums = cls._nearest(part, book), np.zeros_like(book)
                np.add.at(sums, own, part)
                n = np.bincount(own, minlength=len(book))[:, None]
                book = np.where(n > 0, sums / np.maximum(n, 1), book)
            books.append(book)
        return cls(books, edges)

    @staticmethod
    def _nearest(part: np.ndarray, book: np.ndarray) -> np.ndarray:
        half = (book * book).sum(axis=1) / 2
        return np.concatenate([(part[p] @ book.T - half).argmax(axis=1) for p in pieces(len(part), len(book))] or [np.zeros(0, np.int64)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self._nearest(x[:, a:b], book) for a, b, book in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The sum over the parts of the query's product with the code's centre."""
        out = np.zeros((len(queries), len(codes)))
        for k, (a, b, book) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, k]]
        return out


def fit(vectors: DataFrame, vector: str, cells: int, sample: int = SAMPLE) -> Cells:
    """Cells that are fitted on a sample."""
    return Cells.fit(sample_rows(vectors, vector, sample), cells)


def probes_for(x: np.ndarray, cells: Cells, k: int, recall: float = 0.95, queries: int = 512) -> int:
    """How many cells a search has to look into to find `recall` of the k nearest, measured within the sample x against brute force.

    A sample's neighbours are farther apart than those of all vectors, so that the whole needs no more cells.
    """
    asked, found = x[:queries], []
    if not len(asked):
        return 1
    own = cells.assign(x)[0]
    for p in pieces(len(asked), max(len(x), len(cells.centres))):
        rank = np.argsort(np.argsort(-(asked[p] @ cells.centres.T), axis=1, kind="stable"), axis=1)
        near = np.argsort(-np.round(asked[p] @ x.T, 6), axis=1, kind="stable")[:, :k]
        found.append(np.take_along_axis(rank, own[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(found), recall, method="higher")) + 1


def build(vectors: DataFrame, id_col: str, vector: str, cells: Cells, codes: Codes | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, vector, code, cell, angle, block), one row for vectors that are equal, and (key, id): all ids. key: the smallest of them. code: null without codes."""
    known = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    known = known.withColumn("name", F.md5(F.to_json(F.struct("vector"))))
    firsts = cut(known.groupBy("name").agg(F.min("id").alias("key"), F.first("vector").alias("vector")))
    kind = dict(firsts.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = as_matrix(batch.column(1))
                own, near = cells.assign(x)
                coded = pa.array([c.tobytes() for c in codes.encode(x)], pa.binary()) if codes else pa.nulls(len(x), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), coded, pa.array(own.astype(np.int32)), pa.array(np.arccos(np.clip(near, -1, 1)))], names=["key", "vector", "code", "cell", "angle"])

    filed = cut(firsts.select("key", "vector").mapInArrow(run, f"key {kind}, vector array<double>, code binary, cell int, angle double"))
    sizes = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))  # one row a cell
    dealt = filed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    return dealt.select("key", "vector", "code", "cell", "angle", "block"), known.select("name", "id").join(firsts.select("name", "key"), "name").select("key", "id")


def search(index: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int, exact: bool = False, codes: Codes | None = None) -> DataFrame:
    """(q, key, similarity) of the k nearest vectors to each query (q, vector), by cosine; ties by key."""
    wide = index.groupBy("cell").agg(F.max("angle").alias("wide"), F.max("block").alias("last")).collect()  # one row a cell
    centres, probes = cells.centres, min(probes, len(cells.centres))
    blocks, width = np.zeros(len(centres), np.int64), np.full(len(centres), -1.0)
    for r in wide:
        blocks[r["cell"]], width[r["cell"]] = r["last"] + 1, r["wide"]
    reach = lambda angles: np.partition(angles, probes - 1, axis=1)[:, probes - 1 : probes]  # noqa: E731  the probes-th smallest
    asked = visits(queries, centres, blocks, lambda angles: angles <= reach(angles))
    if codes is not None and not exact:
        found = best(compared(index, asked, BY_CODE * k, codes), BY_CODE * k).select("q", "key")
        both = found.join(index.select("key", F.col("vector").alias("_v")), "key").join(queries.select("q", F.col("vector").cast("array<double>").alias("_q")), "q")
        return best(both.select("q", "key", F.round(cosine(F.col("_q"), F.col("_v")), 6).alias("similarity")), k)
    first = compared(index, asked, k)
    if not exact:
        return best(first, k)
    found = cut(best(first, k))
    bound = found.groupBy("q").agg(F.min("similarity").alias("bound"), F.count(F.lit(1)).alias("n"))
    again = queries.join(bound, "q", "left").select("q", "vector", F.when(F.col("n") >= k, F.col("bound")).otherwise(-2.0).alias("bound"))
    far = lambda angles, least: (angles - width[None, :] <= np.arccos(np.clip(least - 1e-6, -1, 1))[:, None] + 1e-9) & (angles > reach(angles))
    return best(found.unionByName(compared(index, visits(again, centres, blocks, far, True), k)), k)


def within(index: DataFrame, cells: Cells, queries: DataFrame, least: float) -> DataFrame:
    """(q, key, similarity): all vectors whose cosine to a query (q, vector) is at least `least`, to six digits. Cells that can't hold one aren't looked into."""
    wide = index.groupBy("cell").agg(F.max("angle").alias("wide"), F.max("block").alias("last")).collect()  # one row a cell
    blocks, width = np.zeros(len(cells.centres), np.int64), np.full(len(cells.centres), -1.0)
    for r in wide:
        blocks[r["cell"]], width[r["cell"]] = r["last"] + 1, r["wide"]
    reach = float(np.arccos(np.clip(least - 1e-6, -1, 1))) + 1e-9
    return compared(index, visits(queries, cells.centres, blocks, lambda angles: angles - width[None, :] <= reach), 0, least=least)


def visits(queries: DataFrame, centres: np.ndarray, blocks: np.ndarray, choose, bounded: bool = False) -> DataFrame:
    """(q, vector, cell, block): the blocks that each query looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in pieces(whole.num_rows, len(centres)):
                batch = whole.slice(piece.start, piece.stop - piece.start)
                angles = np.arccos(np.clip(as_matrix(batch.column(1)) @ centres.T, -1, 1))
                hit = choose(angles, batch.column(2).to_numpy()) if bounded else choose(angles)
                row, cell = np.nonzero(hit & (blocks > 0)[None, :])
                many = blocks[cell]
                row, cell = np.repeat(row, many), np.repeat(cell, many)
                block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32))], names=["q", "vector", "cell", "block"])

    kind = dict(queries.dtypes)["q"]
    columns = [F.col("q"), F.col("vector").cast("array<double>").alias("vector")] + [F.col("bound")] * bounded
    return queries.select(*columns).mapInArrow(run, f"q {kind}, vector array<double>, cell int, block int")


def compared(index: DataFrame, asked: DataFrame, k: int, codes: Codes | None = None, least: float | None = None) -> DataFrame:
    """(q, key, similarity): of each block the k nearest vectors to each of its queries, or with `least` those that are so similar. A block's vectors, or their codes, are held; its queries pass by."""
    kind, key_kind = dict(asked.dtypes)["q"], dict(index.dtypes)["key"]
    own = [F.lit(None).cast("array<double>").alias("vector"), "code"] if codes else ["vector", F.lit(None).cast("binary").alias("code")]
    items = index.select("cell", "block", F.lit(0).alias("side"), F.lit(None).cast(kind).alias("q"), "key", *own)
    both = items.unionByName(asked.select("cell", "block", F.lit(1).alias("side"), "q", F.lit(None).cast(key_kind).alias("key"), "vector", F.lit(None).cast("binary").alias("code")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, held = None, [], []
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1) if batch.num_rows else np.zeros((0, 3), np.int64)
            edges = np.r_[0, np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, len(names)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                part, (cell, block, side) = batch.slice(a, b - a), names[a]
                if (cell, block) != own:
                    own, keys, held = (cell, block), [], []
                if side == 0:
                    keys.append(part.column(4))
                    held.append(np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(len(part), -1) if codes else as_matrix(part.column(5)))
                elif keys:
                    held, keys = [np.concatenate(held)], [pa.concat_arrays(keys)]
                    queries, most = as_matrix(part.column(5)), min(k, len(keys[0]))
                    for p in pieces(len(queries), len(keys[0])):
                        near = codes.scores(queries[p], held[0]) if codes else queries[p] @ held[0].T
                        if least is not None:
                            row, at = np.nonzero(near >= least - 1e-6)
                            score = np.round(near[row, at], 6)
                            row, at, score = row[score >= least], at[score >= least], score[score >= least]
                        else:
                            near = np.round(near, 6)
                            row, at = np.nonzero(near >= np.partition(near, -most, axis=1)[:, -most, None])  # ties are sorted out by key
                            score = near[row, at]
                        yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(row + p.start)), keys[0].take(pa.array(at)), pa.array(score)], names=["q", "key", "similarity"])

    dealt = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
    return dealt.mapInArrow(run, f"q {kind}, key {key_kind}, similarity double")


def alike(targets: DataFrame, sources: DataFrame, least: float) -> DataFrame:
    """(q, key, similarity): all pairs of a source (q, group, vector) and a target (key, group, vector) of one group whose cosine is at least `least`, to six digits.

    A group's vectors have one length. Its targets are dealt into blocks, and every source passes by each of them: products of matrices, of bounded size, in as many tasks as there are blocks.
    Vectors of zeros alone have no cosine.
    """
    used = lambda df, k: df.select("group", k, F.col("vector").cast("array<double>").alias("vector")).where(F.exists("vector", lambda x: x != 0))
    targets, sources = used(targets, "key"), used(sources, "q")
    sizes = targets.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    index = targets.join(sizes, "group").select(F.col("group").alias("cell"), F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "vector")
    asked = sources.join(sizes, "group").select("q", "vector", F.col("group").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return compared(index, asked, 0, least=least)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
