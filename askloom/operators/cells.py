"""Approximate nearest neighbours by cells: coarse centres, partition folders, calibrated probing.

Vectors are placed in the cell of their nearest centre and written one folder per cell, so a
search reads the folders of the probed cells and nothing else. A query first looks into its
nearest cells; the k-th score found there says how good a vector must be to matter. A cell
is then probed when it could hold such a vector: seen from the query, the members of a cell
lie around ``cos * s`` (``cos`` the cell's mean cosine to its centre, ``s`` the query's) with
a spread of ``sin(cell) * sin(query)``, and the number of spreads that the k-th score lies
above is compared with a limit. The limit is measured when the index is built: for sampled
vectors the exact neighbours are found, and it is the quantile of what their cells needed at
which the wanted share of the neighbours is met. A query probes at most all cells, once.

Vectors in clusters need few cells, and a smaller share the more vectors there are. Vectors
without structure need a good part of the table; there the exact search is no dearer.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from askloom.functions import maths
from askloom.operators.retrieve import QUERY_BLOCK, _BestK, _matrix, by_score, dense_topk
from askloom.util import broadcast_if, scratch_dir, settle, staged, top_per_group

#: an index has a cell for each square root of its vectors, so many at most
MOST_CELLS = 4096
#: the centres are fitted on so many vectors a cell at most
SAMPLE_PER_CELL = 32
#: vectors whose exact neighbours set the limit of probing
CALIBRATION = 128
#: vectors of a cell that one group of a search by groups holds
PART = 65_536


@dataclass
class CellIndex:
    """rows(doc, embedding, cos, cell) in folders by cell; per cell its centre, size and mean cosine; the limit of probing."""

    rows: DataFrame
    doc: str
    centres: np.ndarray
    size: np.ndarray
    cos: np.ndarray
    limit: float

    def nearest(self, s: np.ndarray, k: int) -> np.ndarray:
        """Mask of the first cells of each query: the nearest ones that hold 8 k vectors."""
        order = np.argsort(-s, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        mask = np.zeros(s.shape, bool)
        np.put_along_axis(mask, order, before < 8 * k, axis=1)
        return mask & (self.size > 0)

    def needs(self, s: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Spreads by which each query's k-th score lies above what it sees of each cell."""
        spread = np.sqrt(np.maximum(1 - self.cos ** 2, 0)) * np.sqrt(np.maximum(1 - np.clip(s, -1, 1) ** 2, 0))
        return (last[:, None] - self.cos * s) / np.maximum(spread, 1e-9)


def fit_centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    """Unit centres of ``n`` cells by spherical k-means; a cell that runs empty takes a far vector."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        cell, near = _assigned(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        total[empty] = sample[np.argsort(near)[:len(empty)]]
        centres = total / np.maximum(np.linalg.norm(total, axis=1), 1e-12)[:, None]
    return centres


def _assigned(v: np.ndarray, centres: np.ndarray, tall: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(cell, cosine to its centre), some rows at a time."""
    cell, cos = np.empty(len(v), np.int64), np.empty(len(v))
    for at in range(0, len(v), tall):
        s = v[at:at + tall] @ centres.T
        cell[at:at + tall] = s.argmax(axis=1)
        cos[at:at + tall] = s.max(axis=1)
    return cell, cos


def build(vectors: DataFrame, k: int = 10, recall: float = 0.9, doc: str = "doc_id", embedding: str = "embedding", path: str | None = None) -> CellIndex:
    """Index of unit vectors, written to ``path`` (default: a folder of its own in the shared one).

    Centres come from a sample of ``SAMPLE_PER_CELL`` vectors a cell, every vector is
    indexed. A folder of very many vectors is written as several files.
    """
    spark = settle(vectors.sparkSession)
    path = path or scratch_dir(spark, "cells")
    vectors = vectors.select(doc, F.col(embedding).alias("embedding"))
    n_cells = int(max(1, min(MOST_CELLS, round(vectors.count() ** 0.5))))
    drawn = vectors.orderBy(F.xxhash64(doc), doc).limit(SAMPLE_PER_CELL * n_cells).toArrow().combine_chunks()
    sample = _matrix(drawn.column("embedding").chunk(0)) if drawn.num_rows else np.zeros((1, 1))
    centres = fit_centres(sample, n_cells)
    sent = spark.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def place(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, cos = _assigned(_matrix(b.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cos), pa.array(cell, pa.int32())], [doc, "embedding", "cos", "cell"])

    of = dict(vectors.dtypes)
    placed = vectors.mapInArrow(place, f"{doc} {of[doc]}, embedding {of['embedding']}, cos double, cell int")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    made = [[float(x) for x in c] for c in centres]
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.avg("cos").alias("cos")).toArrow()  # a row a cell
    size, cos = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    size[sizes.column("cell").to_numpy()] = sizes.column("n").to_numpy()
    cos[sizes.column("cell").to_numpy()] = sizes.column("cos").to_numpy()
    index = CellIndex(rows, doc, centres, size, cos, -np.inf)
    if drawn.num_rows:
        index.limit = _calibrated(index, vectors, drawn.slice(0, CALIBRATION), k, recall)
    table = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": made, "n": size, "cos": cos, "limit": [index.limit] * len(centres)})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    return index


def load(spark: SparkSession, path: str, doc: str = "doc_id") -> CellIndex:
    t = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow().combine_chunks()
    rows = spark.read.parquet(f"{path}/rows")
    return CellIndex(rows, doc, _matrix(t.column("centre").chunk(0)), t.column("n").to_numpy(), t.column("cos").to_numpy(), t.column("limit")[0].as_py())


def _calibrated(index: CellIndex, vectors: DataFrame, drawn: pa.Table, k: int, recall: float) -> float:
    """The limit at which the cells of a share of ``recall`` of the drawn vectors' neighbours, and half of what is missing to 1, are probed."""
    doc, spark = index.doc, vectors.sparkSession
    asked = spark.createDataFrame(drawn).withColumnRenamed(doc, "_q").select("_q", "embedding")
    exact = dense_topk(asked, vectors, k + 1, "_q", doc).filter(F.col("_q") != F.col(doc))
    near = index.rows.select(F.col(doc).alias("_d"), "cell").join(F.broadcast(exact), F.col(doc) == F.col("_d"))  # k + 1 rows a drawn vector
    near = near.select("_q", "cell").toArrow()
    s = _matrix(drawn.column("embedding").combine_chunks()) @ index.centres.T
    first = index.nearest(s, k)
    who = {v: i for i, v in enumerate(drawn.column(doc).to_pylist())}
    found = search(index, asked, k + 1, "_q", probed=first).filter(F.col("_q") != F.col(doc))
    last = np.full(len(s), -1.0)
    for r in top_per_group(found.drop("rank"), ["_q"], by_score("score", doc), k).filter(F.col("rank") == k).toLocalIterator():
        last[who[r["_q"]]] = r["score"]
    q = np.array([who[x] for x in near.column("_q").to_pylist()], np.int64)
    cell = near.column("cell").to_numpy()
    if not len(q):
        return np.inf
    needs = np.where(first[q, cell], -np.inf, index.needs(s, last)[q, cell])
    needs.sort()
    return float(max(needs[min(len(needs) - 1, int(np.ceil((recall + (1 - recall) / 2) * len(needs))))], -1e9))


def _scan(index: CellIndex, asked: pa.Table, k: int, query: str, names: list[str], schema: str) -> DataFrame:
    """Best ``k`` of up to ``QUERY_BLOCK`` queries: they travel to the folders of their cells, no vector is shuffled."""
    spark, doc = index.rows.sparkSession, index.doc
    kind = to_arrow_type(index.rows.schema[doc].dataType)
    lists = asked.column("cells").chunk(0)
    cells = np.unique(lists.flatten().to_numpy()).tolist() if len(lists) else []
    sent = spark.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        t = sent.value
        qids, q, lists = t.column(query).chunk(0), _matrix(t.column("embedding").chunk(0)), t.column("cells").chunk(0)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        cell = lists.flatten().to_numpy()
        best: dict[int, tuple[np.ndarray, _BestK]] = {}
        for b in batches:
            at = b.column(2).to_numpy()
            for c in np.unique(at).tolist():
                rows = np.flatnonzero(at == c)
                if c not in best:
                    who = owner[cell == c]
                    best[c] = who, _BestK(q[who], k)
                best[c][1].feed(b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False), _matrix(b.column(1).take(pa.array(rows))))
        for who, found in best.values():
            if found.cols is not None:
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(who[found.cols])), pa.array(found.ids, kind), pa.array(found.scores)], names)

    return index.rows.filter(F.col("cell").isin(cells)).select(doc, "embedding", "cell").mapInArrow(run, schema)


def _groups(index: CellIndex, asked: DataFrame, k: int, query: str, names: list[str], schema: str, block: int, part: int) -> DataFrame:
    """Best ``k`` of any number of queries: groups of a part of a cell and a block of its queries, both bounded."""
    doc, spark = index.doc, index.rows.sparkSession
    probes = staged(asked.select(query, F.col("embedding").alias("qv"), F.explode("cells").alias("cell")), "probes")
    plan = probes.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("n_blocks")).join(
        spark.createDataFrame(pa.table({"_c": pa.array(range(len(index.size)), pa.int32()), "n_parts": np.maximum(1, -(-index.size // part))})), F.col("cell") == F.col("_c")).drop("_c")
    plan = F.broadcast(plan)  # a row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    q_side = probes.join(plan, "cell").select("cell", query, "qv", F.pmod(F.xxhash64(query), F.col("n_blocks")).alias("block"), upto("n_parts").alias("part"))
    d_side = index.rows.join(plan, "cell").select("cell", doc, F.col("embedding").alias("dv"), F.pmod(F.xxhash64(doc), F.col("n_parts")).alias("part"), upto("n_blocks").alias("block"))
    kinds = [to_arrow_type(probes.schema[query].dataType), to_arrow_type(index.rows.schema[doc].dataType), pa.float64()]

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds)})
        best = _BestK(_matrix(q.column("qv").combine_chunks()), k)
        for b in d.to_batches():
            best.feed(b.column(doc).to_numpy(zero_copy_only=False), _matrix(b.column("dv")))
        return pa.table(dict(zip(names, [q.column(query).combine_chunks().take(pa.array(best.cols)), pa.array(best.ids, kinds[1]), pa.array(best.scores)])))

    by = ["cell", "part", "block"]
    return q_side.groupBy(*by).cogroup(d_side.groupBy(*by)).applyInArrow(cell, schema)


def probes(index: CellIndex, queries: DataFrame, k: int, query: str, last: str | None = None) -> DataFrame:
    """(query, embedding, cells) of the first cells, or with the column ``last`` (k-th score found there) of those worth a second look."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.size, index.cos))
    doc, limit = index.doc, index.limit

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        here = CellIndex(None, doc, *sent.value, limit)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                s = _matrix(some.column(1)) @ here.centres.T
                mask = here.nearest(s, k)
                if last:
                    mask = ~mask & (here.needs(s, some.column(2).to_numpy(zero_copy_only=False)) <= limit) & (here.size > 0)
                row, cell = np.nonzero(mask)
                offsets = np.searchsorted(row, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cell, pa.int32()))], [query, "embedding", "cells"])

    of = dict(queries.dtypes)
    columns = [query, "embedding", *([F.coalesce(F.col(last), F.lit(-1.0)).alias(last)] if last else [])]
    return queries.select(*columns).mapInArrow(run, f"{query} {of[query]}, embedding {of['embedding']}, cells array<int>")


def search(index: CellIndex, queries: DataFrame, k: int, query: str = "query_id", embedding: str = "embedding", probed: np.ndarray | None = None,
           block: int = QUERY_BLOCK, part: int = PART) -> DataFrame:
    """(query, doc, score, rank): approximate best ``k`` of unit vectors.

    Up to ``block`` queries travel to the folders of their cells; more are dealt out with
    the vectors by cell, a large cell in parts. Both give the same rows. ``probed`` names
    the cells of each query instead of the two looks.
    """
    doc = index.doc
    schema = f"{query} {dict(queries.dtypes)[query]}, {doc} {dict(index.rows.dtypes)[doc]}, score double"
    names = [query, doc, "score"]
    queries = queries.select(query, F.col(embedding).alias("embedding"))
    if not index.size.sum():
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")

    def look(asked: DataFrame) -> DataFrame:
        held = asked.limit(block + 1).toArrow().combine_chunks()
        if held.num_rows == 0:
            return asked.sparkSession.createDataFrame([], schema)
        return _scan(index, held, k, query, names, schema) if held.num_rows <= block else _groups(index, asked, k, query, names, schema, block, part)

    if probed is not None:
        t = queries.toArrow()
        cells = pa.array([np.flatnonzero(m).astype(np.int32) for m in probed], pa.list_(pa.int32()))
        return top_per_group(look(queries.sparkSession.createDataFrame(t.append_column("cells", cells))), [query], by_score("score", doc), k)
    first = staged(top_per_group(look(probes(index, queries, k, query)), [query], by_score("score", doc), k).drop("rank"), "first")
    found = first.unionByName(look(_second(index, queries, first, k, query)))
    return top_per_group(found, [query], by_score("score", doc), k)


def _second(index: CellIndex, queries: DataFrame, first: DataFrame, k: int, query: str) -> DataFrame:
    """The cells worth a second look, given the best rows of the first."""
    last = first.groupBy(query).agg(F.when(F.count("*") == k, F.min("score")).alias("_last"))
    return probes(index, queries.join(broadcast_if(last, queries), query, "left"), k, query, "_last")


def share_read(index: CellIndex, queries: DataFrame, k: int, query: str = "query_id", embedding: str = "embedding") -> float:
    """Share of all (query, vector) pairs that a search scores."""
    queries = queries.select(query, F.col(embedding).alias("embedding"))
    looked = probes(index, queries, k, query).withColumn("cell", F.explode("cells"))
    sizes = queries.sparkSession.createDataFrame(pa.table({"cell": pa.array(range(len(index.size)), pa.int32()), "n": index.size}))
    first = looked.select(query, "cell")
    rows = index.rows.select(index.doc, "cell", F.col("embedding").alias("dv"))
    scored = looked.join(rows, "cell").select(query, index.doc, F.round(maths.dot("embedding", "dv"), 6).alias("score"))
    best = top_per_group(scored, [query], by_score("score", index.doc), k)
    second = _second(index, queries, best, k, query).select(query, F.explode("cells").alias("cell"))
    n = first.unionByName(second).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0]
    return (n or 0) / max(1, queries.count() * int(index.size.sum()))
