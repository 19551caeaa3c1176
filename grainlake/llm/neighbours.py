"""Problem 4: the five most similar chunks of every usable passage vector.

Method: multiprobe p-stable hashing. Each table hashes a unit vector with floor((a·x + b) / w) over Gaussian directions a, which
lie in the leading principal directions of a bounded sample (`fit_rows`), where neighbours differ least against the rest.
The index holds every vector once for each table, in the order of its bucket code, in blocks in the shared folder. A task takes
one block of queries, lists for each query the `probes` buckets of the highest estimated success (perturbations in the order of
the squared distances to the bucket's walls), reads only the blocks that hold such codes, and merges the candidates of all
tables; whatever may reach the running fifth place is computed again in double precision (exact reranking). No bucket, no
candidate list is capped; a hot bucket is spread over as many blocks as it needs; a query whose buckets hold too few vectors is
compared with all blocks.

Equal directions are one class with one representative in the index, so that copies, however many, are searched for once;
members are given their neighbours by id afterwards. The search isn't exact; README.md states the measured recall.

Defined results: null, empty and wrong lengths, null or not finite numbers and all zeros are no vectors; a null chunk_id is left
out; rows of one chunk_id count once; cosines equal to twelve places are equal, the smaller chunk_id wins; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainlake.session import materialize

DIM, NEAREST, BLOCK_ROWS, FIT_ROWS = 64, 5, 8192, 8192
_SLACK = 1e-5  # more than single precision errs in a product of unit vectors
_HALF = 16  # a hash value takes five bits
_TILE = (2048, 512)  # queries and vectors of one product
_WINDOW = 128  # rows on either side, in code order, that give the first bound


class Hashing(NamedTuple):
    """The hash functions of all tables, and the common list of perturbations over boundary distances in ascending order."""

    directions: np.ndarray  # tables, dim, functions
    offsets: np.ndarray  # tables, functions
    widths: np.ndarray  # tables
    sets: np.ndarray  # perturbations, positions of the sorted distances, padded
    probes: int


def perturbations(functions: int, most: int) -> np.ndarray:
    """Sets of positions among the 2M sorted wall distances, by expected sum of squares; never both walls of one function."""
    m = functions
    j = np.arange(1, m + 1)
    low = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
    k = 2 * m + 1 - np.arange(m + 1, 2 * m + 1)
    expected = np.concatenate([low, 1 - k / (m + 1) + k * (k + 1) / (4.0 * (m + 1) * (m + 2))])
    found: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(found) < most:
        score, own = heapq.heappop(heap)
        if all(2 * m - 1 - p not in own for p in own):
            found.append(own)
        last = own[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*own[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*own, last + 1)))
    longest = max(map(len, found))
    return np.array([[*own, *[2 * m] * (longest - len(own))] for own in found], np.int64)


def fit(sample: np.ndarray, tables: int, functions: int, width: float, rank: int, probes: int, seed: int = 4) -> Hashing:
    """Hash functions for unit vectors like those of the sample; `width` counts in standard deviations of a projection."""
    dim = sample.shape[1]
    centred = sample - sample.mean(axis=0)
    _, basis = np.linalg.eigh(centred.T @ centred)
    basis = basis[:, ::-1][:, : min(rank, dim)]
    rng = np.random.default_rng(seed)
    directions, offsets, widths = [], [], []
    for _ in range(tables):
        mix, _ = np.linalg.qr(rng.normal(size=(basis.shape[1], basis.shape[1])))
        own = basis @ mix[:, :functions]
        w = width * float((sample @ own).std(axis=0).mean()) or 1.0
        directions.append(own)
        widths.append(w)
        offsets.append(rng.uniform(0, w, own.shape[1]))
    return Hashing(np.array(directions), np.array(offsets), np.array(widths), perturbations(directions[0].shape[1], 4 * probes), probes)


def _cells(units: np.ndarray, hashing: Hashing, table: int) -> tuple[np.ndarray, np.ndarray]:
    z = (units @ hashing.directions[table] + hashing.offsets[table]) / hashing.widths[table]
    cell = np.floor(z)
    return np.clip(cell, 2 - _HALF, _HALF - 3).astype(np.int64), z - cell


def _places(functions: int) -> np.ndarray:
    return np.left_shift(np.int64(1), 5 * np.arange(functions - 1, -1, -1, dtype=np.int64))


def bucket_codes(units: np.ndarray, hashing: Hashing, table: int) -> np.ndarray:
    """The bucket code of each vector; the first function decides most."""
    cell, _ = _cells(units, hashing, table)
    return (cell + _HALF) @ _places(cell.shape[1])


def probed_codes(units: np.ndarray, hashing: Hashing, table: int) -> np.ndarray:
    """For each vector the codes of the buckets that it visits, one row each."""
    cell, part = _cells(units, hashing, table)
    n, m = cell.shape
    place = _places(m)
    wall = np.concatenate([part, 1 - part], axis=1) ** 2  # below, above
    step = np.concatenate([-place, place])
    order = np.argsort(wall, axis=1)
    near = np.concatenate([np.take_along_axis(wall, order, 1), np.zeros((n, 1))], axis=1)
    delta = np.concatenate([step[order], np.zeros((n, 1), np.int64)], axis=1)
    sets = hashing.sets
    chosen = np.zeros((2 * m + 1, len(sets)))
    np.add.at(chosen, (sets.T, np.arange(len(sets))), 1)
    chosen[2 * m] = 0
    probes = min(hashing.probes, len(sets))
    best = np.argpartition(near @ chosen, probes - 1, axis=1)[:, :probes]
    codes = ((cell + _HALF) @ place)[:, None] + np.zeros((1, probes), np.int64)
    row = np.arange(n)[:, None]
    for k in range(sets.shape[1]):
        codes += delta[row, sets[best, k]]
    return codes


def usable_vectors(df: DataFrame, key: str = "chunk_id", vec: str = "vec", dim: int = DIM) -> DataFrame:
    """chunk_id, vec of each row whose vector has exactly `dim` finite numbers, not all zero; rows are not yet distinct."""
    rows = df.select(F.col(key).cast("bigint").alias("chunk_id"), F.col(vec).alias("vec")).filter(F.col("chunk_id").isNotNull() & (F.size("vec") == dim))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls as rows of doubles of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _digests(dim: int):
    """Rows to (chunk_id, class, vec): the class is a digest of the direction in single precision."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column(1), dim)
                rounded = units.astype(np.float32) + np.float32(0)  # no negative zeros
                names = [int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8).digest(), "little", signed=True) for row in rounded]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), batch.column(1)], names=["chunk_id", "class", "vec"])

    return digests


def _hashed(hashing: Hashing, dim: int):
    """Representatives to one row for each table: tbl, code, chunk_id, vec."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column(1), dim)
                ids = batch.column(0)
                for table in range(len(hashing.widths)):
                    codes = pa.array(bucket_codes(units, hashing, table))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), table, np.int32)), codes, ids, batch.column(1)], names=["tbl", "code", "chunk_id", "vec"])

    return hashed


class Nearest:
    """The running nearest neighbours of one block of queries, already without repeated candidates."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, nearest: int) -> None:
        self.ids, self.units, self.nearest = ids, units, nearest
        self.single = units.astype(np.float32)
        self.row, self.sim, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), -np.inf, np.float32)
        self.products = np.empty(_TILE[0] * _TILE[1], np.float32)

    def first_bounds(self) -> None:
        """Candidates among the queries that lie next to each other in code order."""
        n = len(self.ids)
        for at in range(0, n, 2 * _WINDOW):
            lo, hi = max(0, at - _WINDOW), min(n, at + 3 * _WINDOW)
            near = self.single[at : at + 2 * _WINDOW] @ self.single[lo:hi].T
            if hi - lo > self.nearest + 1:
                col = np.argpartition(near, -self.nearest - 1, axis=1)[:, -self.nearest - 1 :]
            else:
                col = np.tile(np.arange(hi - lo), (len(near), 1))
            row = np.repeat(np.arange(at, at + len(near)), col.shape[1])
            self.merge(row, self.ids[lo + col.ravel()], self.units[lo + col.ravel()])

    def merge(self, row: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Exact cosines of the candidates, then the best of each query that has new ones."""
        other = self.ids[row] != ids
        row, ids, units = row[other], ids[other], units[other]
        if not len(row):
            return
        sim = np.round(np.einsum("ij,ij->i", self.units[row], units), 12)
        new = np.zeros(len(self.ids), bool)
        new[row] = True
        old = new[self.row]
        rest = ~old
        row, sim, ids = np.concatenate([self.row[old], row]), np.concatenate([self.sim[old], sim]), np.concatenate([self.id[old], ids])
        order = np.lexsort((ids, -sim, row))
        row, sim, ids = row[order], sim[order], ids[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, sim, ids = row[once], sim[once], ids[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.nearest
        last = place == self.nearest - 1
        self.floor[row[last]] = sim[last] - _SLACK
        self.row, self.sim, self.id = (np.concatenate([x[rest], y[keep]]) for x, y in ((self.row, row), (self.sim, sim), (self.id, ids)))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query id, place, neighbour and cosine."""
        order = np.lexsort((self.id, -self.sim, self.row))
        row = self.row[order]
        place = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.int32)
        return self.ids[row], place, self.id[order], self.sim[order]

    def short(self) -> np.ndarray:
        """Queries that have found fewer neighbours than asked for."""
        return np.flatnonzero(np.bincount(self.row, minlength=len(self.ids)) < self.nearest)

    def scan(self, query: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        """Compare queries with every vector of a block."""
        single = units.astype(np.float32)
        for at in range(0, len(query), 256):
            asks = query[at : at + 256]
            near = self.single[asks] @ single.T
            most = min(self.nearest + 1, len(ids))
            col = np.argpartition(near, -most, axis=1)[:, -most:].ravel()
            self.merge(np.repeat(asks, most), ids[col], units[col])

    def visit(self, codes: np.ndarray, query: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Compare queries with the buckets that they probe; codes, sorted, with the query of each; block: codes, ids, units in code order."""
        own, ids, units = block
        bucket, start = np.unique(own, return_index=True)
        end = np.append(start[1:], len(own))
        single = units.astype(np.float32)
        first, past = np.searchsorted(codes, bucket, "left"), np.searchsorted(codes, bucket, "right")
        rows, cols, held = [], [], 0
        for k in np.flatnonzero(past > first):
            asked = query[first[k] : past[k]]
            for at in range(start[k], end[k], _TILE[1]):  # a hot bucket in parts
                part = single[at : min(end[k], at + _TILE[1])].T
                for ask in range(0, len(asked), _TILE[0]):
                    asks = asked[ask : ask + _TILE[0]]
                    near = self.products[: len(asks) * part.shape[1]].reshape(len(asks), -1)
                    np.matmul(self.single[asks], part, out=near)
                    hit = np.flatnonzero(near >= self.floor[asks][:, None])
                    if len(hit):
                        rows.append(asks[hit // part.shape[1]])
                        cols.append(hit % part.shape[1] + at)
                        held += len(hit)
                    if held > 100_000:
                        self._flush(rows, cols, ids, units)
                        rows, cols, held = [], [], 0
        self._flush(rows, cols, ids, units)

    def _flush(self, rows: list[np.ndarray], cols: list[np.ndarray], ids: np.ndarray, units: np.ndarray) -> None:
        if rows:
            col = np.concatenate(cols)
            self.merge(np.concatenate(rows), ids[col], units[col])


def _read_block(path: str, table: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    where, inner = fs.FileSystem.from_uri(path)
    with where.open_input_file(inner) as source:
        rows = pq.ParquetFile(source).read(columns=["tbl", "code", "chunk_id", "vec"])
    rows = rows.filter(pc.equal(rows.column("tbl"), table)).combine_chunks()
    code, ids = (rows.column(c).to_numpy() for c in ("code", "chunk_id"))
    vec = rows.column("vec")
    units = np.concatenate([_matrix(c, dim) for c in vec.chunks]) if len(rows) else np.zeros((0, dim))
    order = np.argsort(code, kind="stable")
    return code[order], ids[order], units[order]


def _search(blocks: list[tuple[str, int, int, int]], hashing: Hashing, nearest: int, dim: int):
    """The number of a block of table 0 to the neighbours of its vectors. blocks: file, table, least and greatest code."""
    own_blocks = [b for b in blocks if b[1] == 0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no in (int(x) for batch in batches for x in batch.column(0).to_pylist()):
            block = _read_block(own_blocks[no][0], 0, dim)
            near = Nearest(block[1], block[2], nearest)
            near.first_bounds()
            for table in range(len(hashing.widths)):
                probed = probed_codes(near.units, hashing, table)
                codes = probed.ravel()
                order = np.argsort(codes)
                codes, query = codes[order], order // probed.shape[1]
                todo = [b for b in blocks if b[1] == table]
                todo.sort(key=lambda b: b[0] != own_blocks[no][0])
                for path, _, lo, hi in todo:
                    a, z = np.searchsorted(codes, lo, "left"), np.searchsorted(codes, hi, "right")
                    if a < z:
                        near.visit(codes[a:z], query[a:z], _read_block(path, table, dim))
            if len(short := near.short()):  # too few vectors in all probed buckets: all blocks, exactly
                for path, _, _, _ in own_blocks:
                    _, ids, units = _read_block(path, 0, dim)
                    near.scan(short, ids, units)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, near.found())), names=["chunk_id", "place", "neighbour", "cosine"])

    return search


def build_index(reps: DataFrame, hashing: Hashing, block_rows: int, dim: int) -> tuple[DataFrame, list[tuple[str, int, int, int]]]:
    """The written index and its directory: one entry for each block of `block_rows` vectors."""
    rows = reps.mapInArrow(_hashed(hashing, dim), "tbl int, code bigint, chunk_id bigint, vec array<float>")
    n = reps.count()
    parts = max(1, -(-n * len(hashing.widths) // block_rows))
    ranged = rows.repartitionByRange(parts, "tbl", "code", F.xxhash64("chunk_id")).sortWithinPartitions("tbl", "code")
    index = materialize(ranged, "p4-index")
    entries = index.groupBy(F.input_file_name().alias("file"), "tbl").agg(F.min("code").alias("lo"), F.max("code").alias("hi")).orderBy("tbl", "lo", "file").collect()
    return index, [(r["file"], r["tbl"], r["lo"], r["hi"]) for r in entries]


def nearest_representatives(reps: DataFrame, dim: int = DIM, nearest: int = NEAREST, tables: int = 2, functions: int = 5, width: float = 1.2, rank: int = 10, probes: int = 70, block_rows: int = BLOCK_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """chunk_id, place, neighbour, cosine of distinct directions (chunk_id, vec)."""
    spark = reps.sparkSession
    sample = reps.orderBy(F.xxhash64("chunk_id")).limit(fit_rows).select("vec").toArrow().column("vec")
    schema = "chunk_id bigint, place int, neighbour bigint, cosine double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    hashing = fit(np.concatenate([_matrix(c, dim) for c in sample.chunks]), tables, functions, width, rank, probes)
    _, blocks = build_index(reps, hashing, block_rows, dim)
    n = sum(b[1] == 0 for b in blocks)
    return spark.range(0, n, 1, n).mapInArrow(_search(blocks, hashing, nearest, dim), schema)


def nearest_chunks(df: DataFrame, key: str = "chunk_id", vec: str = "vec", dim: int = DIM, nearest: int = NEAREST, **options: float) -> DataFrame:
    """chunk_id, place, neighbour, cosine: the `nearest` most similar chunks of each usable chunk."""
    rows = usable_vectors(df, key, vec, dim).mapInArrow(_digests(dim), "chunk_id bigint, class bigint, vec array<float>")
    reps = rows.groupBy("class").agg(F.min_by("vec", "chunk_id").alias("vec"), F.min("chunk_id").alias("chunk_id")).select("chunk_id", "vec")
    near = materialize(nearest_representatives(reps, dim, nearest, **options), "p4-near")
    # members of classes of several chunks; their few smallest ids stand for all of them as neighbours
    members = materialize(rows.select("class", "chunk_id").distinct(), "p4-members")
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("rep")).filter("n > 1")
    several = members.join(sizes, "class")
    by_id = Window.partitionBy("class").orderBy("chunk_id")
    first = several.withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= nearest + 1).groupBy("class", "rep", "n").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    first = materialize(first, "p4-first")
    copies = several.join(first.select("class", "ids"), "class").select("chunk_id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    reached = near.join(first.select(F.col("rep").alias("neighbour"), "ids"), "neighbour", "left")
    reached = reached.select("chunk_id", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "cosine")
    # a class of more than `nearest` chunks needs no neighbour but its own
    few = several.filter(F.col("n") <= nearest).select("chunk_id", "rep")
    asked = reached.join(first.select(F.col("rep").alias("chunk_id")), "chunk_id", "left_anti")
    shared = reached.withColumnRenamed("chunk_id", "rep").join(few, "rep").select("chunk_id", "neighbour", "cosine")
    every = asked.unionByName(copies).unionByName(shared).filter("chunk_id <> neighbour")
    best = Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour")
    ranked = every.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < nearest)
    return ranked.select("chunk_id", "place", "neighbour", "cosine")


def neighbour_pairs(df: DataFrame, **options: float) -> DataFrame:
    """chunk_a, chunk_b: pairs of chunks at least one of which is among the other's nearest, the smaller one first."""
    near = nearest_chunks(df, **options)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).dropDuplicates()
