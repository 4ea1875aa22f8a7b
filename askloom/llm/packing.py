"""Cost-balanced packing of documents into training sequences.

Each task tokenises its part of the table and packs it by itself, so nothing is shuffled and
the work grows with the table. Full pieces of ``capacity`` tokens are sequences of their
own. What is left of each document waits in a pool; a full pool is packed in order of
descending cost (``linear`` x tokens + ``quadratic`` x tokens squared, the attention's share)
onto the sequence of lowest cost that still has room. A pool gets exactly as many sequences
as its tokens fill; a piece that fits none of them is cut, so a pool pads fewer than
``capacity`` tokens in all.

Defined results: a null or empty text is the end token alone; equal rows are packed as
separate documents; ties of cost go to the earlier document and the lower sequence. Sequence
numbers are unique over the table (partition number and a counter), and a task that is run
again gives the same ones. A null key stays null.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from askloom.llm import bpe


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one pool."""
    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    n_seq = -(-sum(lengths) // capacity)
    load, free = np.zeros(n_seq), np.full(n_seq, capacity, np.int64)
    waiting = [(-cost(n), i, 0, n) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    out = []
    while waiting:
        _, doc, start, n = heapq.heappop(waiting)
        seq = int(np.argmin(np.where(free >= n, load, np.inf)))
        if free[seq] < n:  # no room for the whole piece anywhere
            seq = int(np.argmax(free))
            rest, n = n - int(free[seq]), int(free[seq])
            heapq.heappush(waiting, (-cost(rest), doc, start + n, rest))
        out.append((doc, start, n, seq, capacity - int(free[seq])))
        free[seq] -= n
        load[seq] += cost(n)
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0,
         quadratic: float = 1.0 / 1024, pool: int = 4096, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids.

    ``ids`` False leaves the token ids out (for reports). ``pool`` bounds the memory of a
    task: at most so many partial documents of under ``capacity`` tokens wait in it.
    """
    content = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(vocabulary))
    kind = docs.schema[key].dataType
    schema = f"k {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        used = 0
        rows: list[tuple] = []
        waiting: list[tuple] = []
        arrow = None

        def emit(k, start, part, total, seq, offset):
            rows.append((k, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, first + seq, offset) + ((part,) if ids else ()))

        def close():
            nonlocal used, waiting
            for i, start, n, seq, offset in balance([len(w[2]) for w in waiting], capacity, linear, quadratic):
                k, begun, part, total = waiting[i]
                emit(k, begun + start, part[start:start + n], total, used + seq, offset)
            used += -(-sum(len(w[2]) for w in waiting) // capacity)
            waiting = []

        def out():
            nonlocal rows
            columns = list(zip(*rows))
            rows = []
            names = ["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [pa.array(c, t) for c, t in zip(columns, [arrow] + [pa.int64()] * 6)]
            if ids:
                cut = np.concatenate([[0], np.cumsum(columns[2])])
                arrays.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(columns[7]), pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * ids)

        for b in batches:
            arrow = b.column(0).type
            keys = b.column(0).to_pylist()
            for lo, hi, e in bpe.encode_pieces(content.value, b.column(1)):
                tokens, at = e.text_ids()
                tokens = np.insert(tokens, at[1:], end_id)
                at = (at + np.arange(len(at))).tolist()
                for k, a, z in zip(keys[lo:hi], at, at[1:]):
                    whole = (z - a) // capacity
                    for j in range(whole):
                        emit(k, j * capacity, tokens[a + j * capacity:a + (j + 1) * capacity], z - a, used + j, 0)
                    used += whole
                    if a + whole * capacity < z:
                        waiting.append((k, whole * capacity, tokens[a + whole * capacity:z].copy(), z - a))
                        if len(waiting) == pool:
                            close()
                    if len(rows) >= 8192:
                        yield out()
        close()
        if rows:
            yield out()

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)
