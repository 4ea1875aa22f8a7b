"""The lexical index as plain tables: blocks of postings, term statistics, corpus totals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.functions import fixed
from askloom.functions import text as tx
from askloom.util import balanced, settle, staged

#: documents whose postings stand together; all postings of a document are in one shard
SHARD_DOCS = 16_384
#: tokens of a shard (more only in a single document); bounds a task's memory whatever the texts' length
SHARD_TOKENS = 1 << 20
#: postings of one term in a block, the unit that ranking skips
BLOCK = 128


@dataclass
class LexicalIndex:
    """blocks, terms(term, df, ctf, idf), totals(n_docs, avgdl, avg_idf).

    A block holds up to ``BLOCK`` postings of a term, in document order: (shard, term,
    block, n, sum_tf, docs, tfs, dls, max_tf, min_dl). The last two bound the score of its postings
    whatever the average length, so blocks stay valid when the corpus grows. A shard has one
    more row with a null term, whose ``n`` counts its documents.
    """

    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame
    doc: str

    @property
    def postings(self) -> DataFrame:
        """(doc, dl, term, tf), one row for each posting."""
        each = self.blocks.filter("term IS NOT NULL").select("term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
        return each.select(F.col("p.docs").alias(self.doc), F.col("p.dls").alias("dl"), "term", F.col("p.tfs").cast("bigint").alias("tf"))


def block_schema(doc_type: str) -> str:
    return f"shard bigint, term string, block int, n bigint, sum_tf bigint, docs array<{doc_type}>, tfs array<int>, dls array<int>, max_tf int, min_dl int"


def _shard_blocks(docs: pa.Array, tokens: pa.ListArray) -> pa.RecordBatch:
    """The blocks of one shard, terms in order."""
    order = pc.sort_indices(docs)
    docs, tokens = docs.take(order), tokens.take(order)
    dl = tokens.value_lengths().to_numpy().astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    place = np.empty(len(words), np.int64)
    by_word = pc.sort_indices(words).to_numpy()
    place[by_word] = np.arange(len(words))
    key, tf = np.unique(place[coded.indices.to_numpy()] * len(docs) + np.repeat(np.arange(len(docs)), dl), return_counts=True)
    term, doc = key // max(len(docs), 1), key % max(len(docs), 1)
    first = np.searchsorted(term, term)  # where the posting's term begins
    at = np.flatnonzero((np.arange(len(term)) - first) % BLOCK == 0)
    offsets = pa.array(np.append(at, len(term)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, x) for x in (docs.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(dl[doc], pa.int32()))]
    most, least = (f.reduceat(x, at) if len(at) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, dl[doc])))
    shard = int.from_bytes(hashlib.blake2b(str(docs[0].as_py()).encode(), digest_size=8).digest(), "little", signed=True)
    size = np.diff(np.append(at, len(term)))
    none = [pa.array([[]], x.type) for x in lists]
    rows = [
        pa.array(np.full(len(at) + 1, shard)), pa.concat_arrays([words.take(pa.array(by_word[term[at]])).cast(pa.string()), pa.nulls(1, pa.string())]),
        pa.array(np.append((at - first[at]) // BLOCK, 0), pa.int32()), pa.array(np.append(size, len(docs)), pa.int64()),
        pa.array(np.append(np.add.reduceat(tf, at) if len(at) else size, 0), pa.int64()),
        *[pa.concat_arrays([a, b]) for a, b in zip(lists, none)], pa.array(np.append(most, 0), pa.int32()), pa.array(np.append(least, 0), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(rows, ["shard", "term", "block", "n", "sum_tf", "docs", "tfs", "dls", "max_tf", "min_dl"])


def _cuts(batches: Iterable[pa.RecordBatch], docs: int, tokens: int) -> Iterable[list[pa.RecordBatch]]:
    """Rows (document, tokens) of one shard after the other: at most ``docs`` of them and, unless it is one alone, ``tokens`` tokens."""
    held: list[pa.RecordBatch] = []
    n_docs = n_tokens = 0
    for batch in batches:
        total = np.cumsum(batch.column(1).value_lengths().to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            end = min(int(np.searchsorted(total, before + tokens - n_tokens, side="right")), at + docs - n_docs)
            if end <= at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                n_docs, n_tokens, at = n_docs + end - at, n_tokens + int(total[end - 1]) - before, end
            if at < batch.num_rows:
                yield held
                held, n_docs, n_tokens = [], 0, 0
    if held:
        yield held


def blocks_of(chunks: DataFrame, doc: str, text: str = "text", shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Blocks of chunks, one row of which is one document with a key of its own.

    A task gathers up to ``shard_docs`` documents with up to ``shard_tokens`` tokens and turns
    them into blocks; nothing is shuffled.
    """
    settle(chunks.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for held in _cuts(batches, shard_docs, shard_tokens):
            yield made(held)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        return _shard_blocks(t.column(0).chunk(0), t.column(1).chunk(0))

    tokens = balanced(chunks.select(doc, text)).select(doc, F.coalesce(tx.tokens_bm25(text), F.array().cast("array<string>")).alias("_t"))
    return tokens.mapInArrow(run, block_schema(dict(chunks.dtypes)[doc]))


def counts_of(blocks: DataFrame) -> DataFrame:
    """(term, df, ctf) from blocks; the null term counts the documents."""
    return blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("sum_tf").alias("ctf"))


def from_counts(blocks: DataFrame, counts: DataFrame, doc: str, epsilon: float = fixed.BM25_EPSILON) -> LexicalIndex:
    """The index of blocks whose term counts are known; terms in over half of all documents get a floor."""
    n_docs = F.coalesce(counts.filter("term IS NULL").agg(F.sum("df").alias("n")).scalar(), F.lit(0))
    raw = counts.filter("term IS NOT NULL").withColumn("raw_idf", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    totals = raw.agg(
        F.sum("ctf").alias("tokens"), F.avg("raw_idf").alias("avg_idf"), F.max(n_docs).alias("n_docs")
    ).select("n_docs", (F.col("tokens") / F.col("n_docs")).alias("avgdl"), "avg_idf")
    floor = totals.select(F.col("avg_idf") * epsilon).scalar()
    terms = raw.select("term", "df", "ctf", F.when(F.col("raw_idf") < 0, floor).otherwise(F.col("raw_idf")).alias("idf"))
    return LexicalIndex(blocks, terms, totals, doc)


def build_index(chunks: DataFrame, doc: str, text: str = "text", epsilon: float = fixed.BM25_EPSILON) -> LexicalIndex:
    """Index of a corpus. Texts are tokenised once: the blocks are written, all else is derived from them.

    Only a (term, count) pair for each term and shard is shuffled, combined per task first.
    """
    blocks = staged(blocks_of(chunks, doc, text), "blocks")
    return from_counts(blocks, staged(counts_of(blocks), "counts"), doc, epsilon)


def extend(index: LexicalIndex, chunks: DataFrame, text: str = "text", epsilon: float = fixed.BM25_EPSILON) -> LexicalIndex:
    """The index with new documents: only their texts are tokenised, old statistics are added to."""
    new = staged(blocks_of(chunks, index.doc, text), "blocks")
    sizes = index.totals.select(F.lit(None).cast("string").alias("term"), F.col("n_docs").alias("df"), F.lit(0).cast("bigint").alias("ctf"))
    counts = index.terms.select("term", "df", "ctf").unionByName(sizes).unionByName(counts_of(new))
    counts = staged(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf")), "counts")
    return from_counts(index.blocks.unionByName(new), counts, index.doc, epsilon)


def save_index(index: LexicalIndex, path: str) -> None:
    """Write the three tables; a shard's blocks stay in term order, so that statistics of files prune terms."""
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def load_index(spark: SparkSession, path: str, doc: str, doc_type: str = "bigint") -> LexicalIndex:
    blocks = spark.read.schema(block_schema(doc_type)).parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, df bigint, ctf bigint, idf double").parquet(f"{path}/terms")
    totals = spark.read.schema("n_docs bigint, avgdl double, avg_idf double").parquet(f"{path}/totals")
    return LexicalIndex(blocks, terms, totals, doc)


def write_segment(chunks: DataFrame, path: str, segment: int, doc: str, text: str = "text") -> None:
    """Add documents to an index kept as segments; a segment that is written again replaces itself."""
    spark = settle(chunks.sparkSession)
    blocks_of(chunks, doc, text).write.mode("overwrite").parquet(f"{path}/blocks/segment={segment}")
    mine = spark.read.schema(block_schema(dict(chunks.dtypes)[doc])).parquet(f"{path}/blocks/segment={segment}")
    counts_of(mine).write.mode("overwrite").parquet(f"{path}/counts/segment={segment}")


def load_segments(spark: SparkSession, path: str, doc: str, doc_type: str = "string", epsilon: float = fixed.BM25_EPSILON) -> LexicalIndex:
    """The index over all segments: their counts are added up, no text is read."""
    settle(spark)
    blocks = spark.read.schema(f"{block_schema(doc_type)}, segment bigint").parquet(f"{path}/blocks").drop("segment")
    counts = spark.read.schema("term string, df bigint, ctf bigint, segment bigint").parquet(f"{path}/counts")
    summed = counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    return from_counts(blocks, summed, doc, epsilon)
