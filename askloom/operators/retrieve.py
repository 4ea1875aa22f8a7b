"""Ranking a whole table of queries at once: BM25, vectors, fusion, reranking, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators import ranking
from askloom.operators.index import LexicalIndex
from askloom.util import balanced, broadcast_if, settle, spread, staged, top_per_group

QUERY_BLOCK = 2048
VECTOR_SHARD = 200_000


def by_score(score: str, *ties: str) -> list[Column]:
    return [F.desc(score), *[F.asc(t) for t in ties]]


# ---- lexical ---------------------------------------------------------------

#: weights of query terms that travel to the blocks at once
WEIGHT_ROWS = 1_000_000


def _weighted(queries: DataFrame, index: LexicalIndex, query: str, text: str) -> DataFrame:
    """(query, term, weight, avgdl) of the queries' terms in the index; repeated query terms count again."""
    asked = (
        queries.select(query, F.explode_outer(tx.tokens_bm25(text)).alias("term")).filter("term IS NOT NULL")
        .groupBy(query, "term").agg(F.count("*").alias("qtf"))
    )
    weight = (F.col("qtf") * F.col("idf")).alias("weight")
    return index.terms.select("term", "idf").join(broadcast_if(asked, queries, 4), "term").select(
        query, "term", weight, index.totals.select("avgdl").scalar().alias("avgdl"))


def _allowed_blocks(blocks: DataFrame, allowed: DataFrame, doc: str) -> DataFrame:
    """Blocks without the postings of other documents; their bounds stay valid."""
    each = blocks.select("shard", "term", "block", "max_tf", "min_dl", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    some = each.withColumn("_doc", F.col("p.docs")).join(broadcast_if(allowed.select(F.col(doc).alias("_doc"))), "_doc", "left_semi")
    lists = some.groupBy("shard", "term", "block").agg(F.array_sort(F.collect_list("p")).alias("p"), F.first("max_tf").alias("max_tf"), F.first("min_dl").alias("min_dl"))
    return lists.select("shard", "term", F.col("p.docs").alias("docs"), F.col("p.tfs").alias("tfs"), F.col("p.dls").alias("dls"), "max_tf", "min_dl")


def bm25_topk(queries: DataFrame, index: LexicalIndex, k: int = fixed.TOP_K, query: str = "query_id",
              text: str = "text", k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, allowed: DataFrame | None = None,
              held_rows: int = WEIGHT_ROWS) -> DataFrame:
    """(query, doc, score, rank): best ``k`` documents with a positive score, among ``allowed`` ones if given.

    The asked terms' blocks are placed by shard; a task ranks the queries over its shards by
    ``ranking`` and emits at most ``k`` rows per query, so no (query, document) pair is
    shuffled. Up to ``held_rows`` weights travel to the blocks. More are cut into blocks of
    queries, each with the postings of its own terms; a (shard, query block) cell is bounded
    on both sides.
    """
    settle(queries.sparkSession)
    doc, qt = index.doc, dict(queries.dtypes)[query]
    of_doc = index.blocks.schema["docs"].dataType.elementType
    schema, kind = f"{query} {qt}, {doc} {of_doc.simpleString()}, score double", to_arrow_type(of_doc)
    names = [query, doc, "score"]
    weighted = _weighted(queries, index, query, text)
    held = weighted.limit(held_rows + 1).toArrow()
    columns = ["shard", "term", "docs", "tfs", "dls", "max_tf", "min_dl"]

    def blocks_for(terms: DataFrame) -> DataFrame:
        some = index.blocks.join(terms, "term", "left_semi")
        return (some if allowed is None else _allowed_blocks(some, allowed, doc)).select(*columns)

    if held.num_rows <= held_rows:
        sent = queries.sparkSession.sparkContext.broadcast(held.combine_chunks())

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            t = sent.value
            if t.num_rows == 0:
                return
            asked = ranking.Asked(t.column(query).chunk(0), t.column("term").chunk(0), t.column("weight").to_numpy(), k)
            for rows in ranking.shards(batches):
                asked.feed(ranking.Shard(rows, asked.terms, k1, b, t.column("avgdl")[0].as_py()))
            yield asked.told(names, kind)

        terms = queries.sparkSession.createDataFrame(held.select(["term"]).group_by("term").aggregate([]), "term string")
        placed = spread(blocks_for(F.broadcast(terms)), "shard").sortWithinPartitions("shard")
        best = placed.mapInArrow(scan, schema)
    else:
        weighted = staged(weighted, "weights")
        n_blocks = -(-weighted.count() // held_rows)
        of_block = F.pmod(F.xxhash64(query), F.lit(n_blocks)).alias("_b")
        wanted = weighted.select("term", of_block).distinct()
        rows = blocks_for(broadcast_if(wanted.select("term").distinct())).join(broadcast_if(wanted), "term")
        by_query = weighted.groupBy(query).agg(F.collect_list(F.struct("term", "weight")).alias("w"), F.first("avgdl").alias("avgdl")).select(query, "w", "avgdl", of_block)
        at = rows.select(F.col("shard").alias("_s"), F.col("_b").alias("_c")).distinct()
        cells = by_query.join(at, F.col("_b") == F.col("_c"))

        def cell(q: pa.Table, d: pa.Table) -> pa.Table:
            if not q.num_rows or not d.num_rows:
                return pa.table({n: pa.array([], t) for n, t in zip(names, (q.schema.field(query).type, kind, pa.float64()))})
            q = q.combine_chunks()
            w = q.column("w").chunk(0)
            who = q.column(query).chunk(0).take(pa.array(np.repeat(np.arange(len(w)), w.value_lengths().to_numpy())))
            asked = ranking.Asked(who, w.flatten().field("term"), w.flatten().field("weight").to_numpy(), k)
            asked.feed(ranking.Shard(d, asked.terms, k1, b, q.column("avgdl")[0].as_py()))
            return pa.Table.from_batches([asked.told(names, kind)])

        best = cells.groupBy("_c", "_s").cogroup(rows.groupBy("_b", "shard")).applyInArrow(cell, schema)
    return top_per_group(best, [query], by_score("score", doc), k)


# ---- vectors ----------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


#: query-vector products that are held at once (32 MB)
_CELLS = 4_000_000


class _BestK:
    """Running best ``k`` documents of a block of queries, fed with vectors strip by strip.

    A strip is as tall as ``_CELLS`` products allow, and what cannot beat a query's k-th best
    so far is dropped at once, so the memory does not depend on the number of vectors.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.cols = self.ids = self.scores = None
        self.bound = np.full(len(q), -np.inf)

    def feed(self, ids: np.ndarray, d: np.ndarray) -> None:
        tall = max(1, _CELLS // max(1, len(self.q)))
        for at in range(0, len(d), tall):
            part = np.round(d[at:at + tall] @ self.q.T, 6)
            if len(part) > self.k:
                bound = np.maximum(self.bound, np.partition(part, len(part) - self.k, axis=0)[len(part) - self.k])
            else:
                bound = self.bound
            rows, cols = np.nonzero(part >= bound)
            score = np.round(np.einsum("ij,ij->i", d[at:at + tall][rows], self.q[cols]), 6)
            found = cols, ids[at:at + tall][rows], score
            if self.cols is not None:
                found = tuple(np.concatenate(x) for x in zip((self.cols, self.ids, self.scores), found))
            keep = ranking.best_first(*found, self.k)
            self.cols, self.ids, self.scores = (x[keep] for x in found)
            full = np.flatnonzero(np.bincount(self.cols, minlength=len(self.q)) == self.k)
            last = np.searchsorted(self.cols, full, side="right") - 1
            self.bound[full] = self.scores[last]

    def told(self, qids: pa.Array, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([qids.take(pa.array(self.cols)), pa.array(self.ids, kind), pa.array(self.scores)], names)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = fixed.TOP_K, query: str = "query_id", doc: str = "doc_id",
               embedding: str = "embedding", block: int = QUERY_BLOCK, shard: int = VECTOR_SHARD) -> DataFrame:
    """(query, doc, score, rank): exact best ``k`` by cosine of unit vectors.

    Scores are matrix products of strips inside a task, which keeps a running best ``k`` and
    emits it once. Up to ``block`` queries travel to the vectors, which are not shuffled.
    Beyond that both sides are cut into blocks and every (shard, block) cell of the grid is
    one bounded group; nothing grows with a query's or a document's popularity.
    """
    qt, dt = dict(queries.dtypes)[query], dict(vectors.dtypes)[doc]
    schema = f"{query} {qt}, {doc} {dt}, score double"
    # one row more than a block tells which plan to take, from the very rows that are used
    held = queries.select(query, embedding).limit(block + 1).toArrow().combine_chunks()

    if held.num_rows <= block:
        sent = vectors.sparkSession.sparkContext.broadcast(held)

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            t = sent.value
            if t.num_rows == 0:
                return
            qids, best, kind = t.column(query).chunk(0), _BestK(_matrix(t.column(embedding).chunk(0)), k), None
            for batch in batches:
                if batch.num_rows:
                    kind = batch.column(0).type
                    best.feed(batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)))
            if best.cols is not None:
                yield best.told(qids, kind, [query, doc, "score"])

        best = vectors.select(doc, embedding).mapInArrow(scan, schema)
    else:
        n_blocks, zero = -(-queries.count() // block), F.lit(0).cast("bigint")
        n_shards = max(1, -(-vectors.count() // shard))
        q_side = queries.select(
            query, F.col(embedding).alias("qv"), F.pmod(F.xxhash64(query), F.lit(n_blocks)).alias("block"),
            F.explode(F.sequence(zero, F.lit(n_shards - 1).cast("bigint"))).alias("shard"),
        )
        d_side = vectors.select(
            doc, F.col(embedding).alias("dv"), F.pmod(F.xxhash64(doc), F.lit(n_shards)).alias("shard"),
            F.explode(F.sequence(zero, F.lit(n_blocks - 1).cast("bigint"))).alias("block"),
        )

        best = _best_of_cells(q_side, d_side, ["shard", "block"], query, doc, k, schema)
    return top_per_group(best, [query], by_score("score", doc), k)


def _best_of_cells(q_side: DataFrame, d_side: DataFrame, grid: list[str], query: str, doc: str, k: int, schema: str) -> DataFrame:
    """The best ``k`` of each query in each cell: (query, qv, *grid) against (doc, dv, *grid)."""
    names = [query, doc, "score"]

    def cell(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (q.schema.field(query).type, d.schema.field(doc).type, pa.float64()))})
        q = q.combine_chunks()
        best = _BestK(_matrix(q.column("qv").chunk(0)), k)
        for b in d.to_batches():
            best.feed(b.column(doc).to_numpy(zero_copy_only=False), _matrix(b.column("dv")))
        return pa.Table.from_batches([best.told(q.column(query).chunk(0), d.schema.field(doc).type, names)])

    return q_side.groupBy(*grid).cogroup(d_side.groupBy(*grid)).applyInArrow(cell, schema)


def dense_topk_within(queries: DataFrame, vectors: DataFrame, k: int, group: str, query: str = "query_id", doc: str = "doc_id",
                      embedding: str = "embedding", block: int = QUERY_BLOCK, shard: int = VECTOR_SHARD // 4) -> DataFrame:
    """(query, doc, score, rank): exact best ``k`` among the vectors of the query's own ``group``.

    Both sides of a group are cut by their numbers into blocks and shards, so that a group of
    any size is a grid of bounded cells; a cell keeps a running best ``k``. Rows without a
    group or a vector take no part.
    """
    schema = f"{query} {dict(queries.dtypes)[query]}, {doc} {dict(vectors.dtypes)[doc]}, score double"
    asked, held = (df.filter(F.col(group).isNotNull() & F.col(embedding).isNotNull()) for df in (queries, vectors))
    parts = lambda df, most, name: df.groupBy(group).agg(F.ceil(F.count("*") / most).alias(name))
    cut = parts(asked, block, "_blocks").join(parts(held, shard, "_shards"), group)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    q_side = asked.join(cut, group).select(query, F.col(embedding).alias("qv"), F.col(group).alias("_g"), F.pmod(F.xxhash64(query), F.col("_blocks")).alias("block"), upto("_shards").alias("shard"))
    d_side = held.join(cut, group).select(doc, F.col(embedding).alias("dv"), F.col(group).alias("_g"), F.pmod(F.xxhash64(doc), F.col("_shards")).alias("shard"), upto("_blocks").alias("block"))
    best = _best_of_cells(q_side, d_side, ["_g", "shard", "block"], query, doc, k, schema)
    return top_per_group(best, [query], by_score("score", doc), k)


# ---- fusion ------------------------------------------------------------------

def minmax(score: str, group: str) -> Column:
    """Per-group min-max; a flat group becomes 0 when it is all zero, else 1."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < 1e-12, F.when(hi == 0, 0.0).otherwise(1.0)).otherwise((F.col(score) - lo) / (hi - lo))


def minmax_rows(rows: DataFrame, score: str, group: str, name: str = "norm") -> DataFrame:
    """``minmax`` of groups of any size: bounds are aggregated, combined per task, and joined back, so no group is gathered."""
    bounds = rows.groupBy(F.col(group).alias("_g")).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    norm = F.when(hi - lo < 1e-12, F.when(hi == 0, 0.0).otherwise(1.0)).otherwise((F.col(score) - lo) / (hi - lo))
    return rows.join(bounds, rows[group].eqNullSafe(F.col("_g"))).withColumn(name, norm).drop("_g", "_lo", "_hi")


def candidates(dense: DataFrame, sparse: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Union of both candidate lists per query with missing scores as 0, and both scores normalised over it.

    The full outer join is done as union and aggregate on rows placed by query, so the
    normalising windows need no further shuffle.
    """
    zero = F.lit(0.0)
    both = dense.select(query, doc, F.col("score").alias("d"), zero.alias("s")).unionByName(
        sparse.select(query, doc, zero.alias("d"), F.col("score").alias("s"))
    )
    merged = both.repartition(query).groupBy(query, doc).agg(F.sum("d").alias("dense_score"), F.sum("s").alias("sparse_score"))
    return merged.withColumns({"dense_norm": minmax("dense_score", query), "sparse_norm": minmax("sparse_score", query)})


def resolve_alpha(given=None, predicted=None, lo: float = fixed.ALPHA_MIN, hi: float = fixed.ALPHA_MAX,
                  default: float = fixed.ALPHA_DEFAULT) -> Column:
    """A given weight clipped, else a predicted one clipped, else the default as it is."""
    given = F.lit(None).cast("double") if given is None else given
    predicted = F.lit(None).cast("double") if predicted is None else predicted
    return F.coalesce(
        F.when(given.isNotNull(), maths.clip(given, lo, hi)), F.when(predicted.isNotNull(), maths.clip(predicted, lo, hi)), F.lit(default)
    )


def fused(cand: DataFrame, alpha, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    scored = cand.withColumn("score", F.round(a * F.col("dense_norm") + (1.0 - a) * F.col("sparse_norm"), 6))
    return top_per_group(scored, [query], by_score("score", doc), k)


def hybrid_fuse(queries: DataFrame, index: LexicalIndex, query_vectors: DataFrame, vectors: DataFrame,
                k: int = fixed.TOP_K, alpha=fixed.ALPHA_DEFAULT, query: str = "query_id",
                allowed: DataFrame | None = None, scope: str = "both") -> DataFrame:
    """Fetch ``2k`` from each side, normalise over the union, weight by ``alpha``, keep the best ``k``.

    ``allowed`` holds the documents that a metadata filter lets through; with ``scope``
    "dense" it bears on the vectors alone, with "both" on the postings too.
    """
    if allowed is not None:
        vectors = vectors.join(broadcast_if(allowed.select(index.doc)), index.doc, "left_semi")
    dense = dense_topk(query_vectors, vectors, 2 * k, query, index.doc)
    sparse = bm25_topk(queries, index, 2 * k, query, allowed=allowed if scope == "both" else None)
    return fused(candidates(dense, sparse, query, index.doc), alpha, k, query, index.doc)


# ---- reranking and citations ---------------------------------------------------

def with_texts(pairs: DataFrame, docs: DataFrame, queries: DataFrame, factor: int, doc: str = "doc_id",
               query: str = "query_id", text: str = "text") -> DataFrame:
    """Candidates with the document's and the query's text.

    When the query table is small, its candidates (at most ``factor`` per query) are
    broadcast to the documents, so texts that are not candidates are never shuffled.
    """
    q = queries.select(query, F.col(text).alias("query_text"))
    found = docs.select(doc, F.col(text).alias("doc_text")).join(broadcast_if(pairs, queries, factor), doc)
    return found.join(broadcast_if(q, queries), query)


def lexical_scorer(a: Column, b: Column) -> Column:
    """Default scorer: share of the distinct tokens of ``a`` found in ``b``."""
    return maths.overlap(tx.tokens_alnum(a), tx.tokens_alnum(b))


def pandas_scorer(score: Callable[[pd.Series, pd.Series], pd.Series], setup: Callable[[], object] | None = None):
    """A user model as a scorer: ``score(left, right)`` per Arrow batch, ``setup()`` once per Python worker."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = setup() if setup else None
        for left, right in batches:
            yield (score(left, right) if model is None else score(left, right, model)).astype("float64")

    return run


def rerank_topk(pairs: DataFrame, k: int = fixed.RERANK_K, scorer=lexical_scorer, query: str = "query_id",
                doc: str = "doc_id") -> DataFrame:
    """Replace the retrieval score by the scorer's, keep the best ``k`` (needs query_text and doc_text)."""
    scored = pairs.drop("score", "rank").withColumn("score", F.round(scorer(F.col("query_text"), F.col("doc_text")), 6))
    return top_per_group(scored, [query], by_score("score", doc), k)


def drop_seen(found: DataFrame, seen: DataFrame, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    return found.join(seen.select(query, doc).distinct(), [query, doc], "left_anti")


def build_citations(ranked: DataFrame, limit: int = fixed.MAX_CITATIONS, filtered: bool = True, share: float = 0.6,
                    query: str = "query_id", rank: str = "rank") -> DataFrame:
    """Top ``limit`` rows per query; with the filter only those at 60 % of the best score, at least two.

    The filter is off for a query whose scores are all zero or below.
    """
    top = ranked.filter(F.col(rank) <= limit)
    if not filtered:
        return top
    best = F.max("score").over(Window.partitionBy(query))
    marked = top.withColumn("_best", best)
    return marked.filter(
        (F.col("_best") <= 0) | (F.col("score") >= F.col("_best") * share) | (F.col(rank) <= 2)
    ).drop("_best")


def similarity_floor(ranked: DataFrame, queries: DataFrame, floor: float = fixed.SIMILARITY_FLOOR,
                     query: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(rows at or above the floor, queries left with none)."""
    kept = ranked.filter(F.col("score") >= floor)
    return kept, queries.join(kept.select(query).distinct(), query, "left_anti")


def containing_docs(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "query_id", text: str = "text") -> DataFrame:
    """(item, doc) where the document contains the item's text verbatim.

    An item's inner words occur in a containing document as whole words in a row, so the
    pairs come from an equi-join of the documents' distinct word runs, without their texts,
    on a run of inner words; the texts are fetched for those pairs only. Items with fewer
    than five words are looked up on a single inner word, and those with fewer than three,
    which have none, on their first characters (three at most). An item without text is in
    no document.
    """
    w = F.split(F.col(text), r"\s+")
    n = F.size(w)
    chars = F.least(F.length(text), F.lit(3))
    key = F.when(n >= 5, F.concat(F.lit("r "), F.array_join(F.slice(w, 2, 3), " "))).when(n >= 3, F.concat(F.lit("w "), F.get(w, F.lit(1)))).otherwise(
        F.concat(F.lit("c"), chars.cast("string"), F.lit(" "), F.left(text, chars)))
    asked = items.filter(F.length(text) > 0).select(item, F.col(text).alias("needle"), key.alias("key"))
    kinds = {r[0] for r in asked.select(F.substring_index("key", " ", 1)).distinct().collect()}  # five at most
    body = balanced(docs.select(doc, F.col(text).alias("hay")))

    def grams(q: int) -> Column:
        return tx.let(F.split("hay", ""), lambda c: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(c) - q, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, q), "")))

    parts = {"r": lambda: tx.ngrams(F.split("hay", r"\s+"), 3), "w": lambda: F.split("hay", r"\s+"), **{f"c{q}": (lambda q=q: grams(q)) for q in (1, 2, 3)}}
    pairs = None
    for kind in sorted(kinds):
        keys = body.select(doc, F.explode_outer(F.array_distinct(parts[kind]())).alias("k")).select(doc, F.concat(F.lit(f"{kind} "), "k").alias("key"))
        found = keys.join(broadcast_if(asked.select(item, "key"), items), "key").select(item, doc)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return asked.join(docs.select(doc).limit(0), F.lit(False)).select(item, doc)
    pairs = staged(pairs.distinct(), "pairs")  # few, and of known size: texts that are not wanted are then not moved
    checked = docs.select(doc, F.col(text).alias("hay")).join(broadcast_if(pairs), doc).join(broadcast_if(asked.select(item, "needle"), items), item)
    return checked.filter(F.contains("hay", "needle")).select(item, doc)
