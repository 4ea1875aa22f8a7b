"""Pruned BM25: the best k documents of a table of queries from blocks of postings.

A task receives the asked terms' blocks of whole shards, one shard after the other, and keeps
a running best k of every query. For a query the terms stand in order of the most that they
can add. As long as the terms still to come could lift an unseen document to the k-th best
score so far, their blocks are added up; after that only the documents that can still get
there are looked up, in the blocks that hold one. A block whose bound leaves its documents
below the k-th best is never scored. All bounds come from ``max_tf`` and ``min_dl`` of the
blocks, and ties with the k-th best are kept, so the result is that of the full ranking.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: scores are rounded to six places; what may round up to the k-th best is not pruned
_SLACK = 2e-6


def best_first(cols: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of every column; ties go to the smaller document."""
    place = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((place, -scores, cols))
    cols = cols[order]
    return order[np.arange(len(cols)) - np.searchsorted(cols, cols, side="left") < k]


class Shard:
    """Blocks of one shard: terms, documents by their place in order, and bounds."""

    def __init__(self, rows: pa.Table, terms: pa.Array, k1: float, b: float, avgdl: float):
        rows = rows.combine_chunks()
        self.k1, self.b, self.avgdl = k1, b, avgdl
        code = pc.index_in(rows.column("term").chunk(0), value_set=terms).to_numpy()
        lists = rows.column("docs").chunk(0)
        flat = lists.flatten()
        if pa.types.is_integer(flat.type):
            self.docs, self.place = np.unique(flat.to_numpy(), return_inverse=True)
        else:
            coded = flat.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.docs = coded.dictionary.take(pa.array(order)).to_numpy(zero_copy_only=False)
            self.place = rank[coded.indices.to_numpy()]
        self.size = lists.value_lengths().to_numpy().astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.tf = rows.column("tfs").chunk(0).flatten().to_numpy()
        self.dl = rows.column("dls").chunk(0).flatten().to_numpy()
        self.bound = self._part(rows.column("max_tf").to_numpy(), rows.column("min_dl").to_numpy())
        order = np.lexsort((self.place[self.at[:-1]], code))
        self.blocks = dict(zip(*self._split(code[order], order)))
        #: postings that were scored, for measuring
        self.scored = 0

    @staticmethod
    def _split(code: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        heads, at = np.unique(code, return_index=True)
        return heads.tolist(), np.split(order, at[1:])

    def _part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))

    def gathered(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, parts of the score) of blocks of one term."""
        size = self.size[blocks]
        i = np.arange(int(size.sum())) + np.repeat(self.at[blocks] - np.cumsum(size) + size, size)
        self.scored += len(i)
        return self.place[i], self._part(self.tf[i], self.dl[i])

    def search(self, terms: list[int], weights: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that can be among the best ``k`` given the k-th best score so far."""
        mine = [(t, w, self.blocks[t]) for t, w in zip(terms, weights.tolist()) if t in self.blocks and w]
        none = np.zeros(0, np.int64), np.zeros(0)
        if not mine:
            return none
        most = np.array([max(w, 0.0) * self.bound[rows].max() for _, w, rows in mine])
        order = np.argsort(-most, kind="stable")
        mine, most = [mine[i] for i in order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the terms from here on can add
        rising = all(w > 0 for _, w, _ in mine)
        acc, found, i = np.zeros(len(self.docs)), None, 0
        while i < len(mine) and rest[i] >= bound - _SLACK:
            _, w, rows = mine[i]
            others = rest[0] - most[i]
            rows = rows[max(w, 0.0) * self.bound[rows] + others >= bound - _SLACK]
            docs, part = self.gathered(rows)
            acc[docs] += w * part
            i += 1
            if rising and i < len(mine):
                high = acc[acc > bound]
                if len(high) >= k:
                    bound = max(bound, float(np.partition(high, len(high) - k)[len(high) - k]))
        found = np.flatnonzero(acc + rest[i] >= bound - _SLACK) if i else none[0]
        found = found[acc[found] != 0]
        while i < len(mine) and len(found):
            _, w, rows = mine[i]
            first, last = self.place[self.at[rows]], self.place[self.at[rows + 1] - 1]
            rows = rows[np.searchsorted(found, first) < np.searchsorted(found, last, side="right")]
            if len(rows):
                docs, part = self.gathered(rows)
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                hit = docs[at] == found
                acc[found[hit]] += w * part[at[hit]]
            i += 1
            found = found[acc[found] + rest[i] >= bound - _SLACK]
        score = np.round(acc[found], 6)
        keep = score > 0
        found, score = found[keep], score[keep]
        best = np.lexsort((found, -score))[:k]
        return found[best], score[best]


class Asked:
    """Weights of queries' terms, and the running best ``k`` of each query over shards."""

    def __init__(self, queries: pa.Array, terms: pa.Array, weights: np.ndarray, k: int):
        q, t = queries.dictionary_encode(), terms.dictionary_encode()
        self.queries, self.terms, self.k = q.dictionary, t.dictionary, k
        code = q.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[order], np.arange(1, len(self.queries)))
        self.mine = [(t.indices.to_numpy()[i].tolist(), weights[i]) for i in np.split(order, cut)] if len(code) else []
        self.bound = np.zeros(len(self.queries))
        self.cols, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.scored = 0

    def feed(self, shard: Shard) -> None:
        found = [shard.search(t, w, self.k, self.bound[q]) for q, (t, w) in enumerate(self.mine)]
        self.scored += shard.scored
        cols = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
        if not len(cols):
            return
        ids, scores = shard.docs[np.concatenate([d for d, _ in found])], np.concatenate([s for _, s in found])
        if self.ids is not None:
            cols, ids, scores = np.concatenate([self.cols, cols]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        keep = best_first(cols, ids, scores, self.k)
        self.cols, self.ids, self.scores = cols[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.bincount(self.cols, minlength=len(self.bound)) == self.k)
        self.bound[full] = self.scores[np.searchsorted(self.cols, full, side="right") - 1]

    def told(self, names: list[str], doc_type: pa.DataType) -> pa.RecordBatch:
        ids = pa.array([] if self.ids is None else self.ids, doc_type)
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(self.cols)), ids, pa.array(self.scores)], names)


def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one shard after the other; they stand together in the input."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        cut = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for lo, hi in zip(cut, cut[1:]):
            part = batch.slice(lo, hi - lo)
            if held and held[-1].column(0)[0].as_py() != part.column(0)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
