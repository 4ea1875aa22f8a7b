"""Language identification: sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything else is a blank, blanks are joined, and the n-grams of
one to three characters are hashed into a fixed number of features, weighted by TF-IDF (term
frequency: share of the text's n-grams). The classifier is trained with
follow-the-regularised-leader and elastic-net penalties on a bounded sample of labelled
rows, then calibrated by one temperature on a part of the sample that training did not see.

The classifier is fitted on a sample that parameters bound: ``per_label`` labelled rows for each
language (distinct texts, those of smallest hash) and ``max_labels`` languages, the most frequent;
rarer ones are not learned. The document frequencies cover every row that may be learned
from, and every row is predicted, both from whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every
text when there is nothing to learn from. Equal texts get equal predictions; ties go to the
language that sorts first. Labels that are null are not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askloom.llm import spans

BITS = 16
ORDERS = (1, 2, 3)
#: pieces of texts that are worked on at once, in spans.PIECE_BYTES: some thirty numbers are held for a character
PIECE = 0.25
_SCALE = 30.0  # brings the weighted frequencies near one


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, a blank for all else."""
    table = np.full(0x110000, 0x20, np.int32)
    known = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    for run in regex.findall(r"\p{L}+", known):
        for c in run:
            low = c.lower()
            table[ord(c)] = ord(low[0])
    return table


def characters(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of each text (letters and single blanks), with offsets."""
    first = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[first]
    point = lead.astype(np.int32)
    for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        wide = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[wide].astype(np.int32) & bits
        for j in range(1, size):
            value = (value << 6) | (raw[first[wide] + j] & 0x3F)
        point[wide] = value
    point = _letters()[point]
    head = np.searchsorted(first, at)
    keep = point != 0x20
    start = np.zeros(len(point) + 1, bool)
    start[head] = True
    keep[1:] |= (point[:-1] != 0x20) & ~start[1:-1]
    kept = np.zeros(len(point) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return point[keep], kept[head]


def features(chars: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, mask of windows inside one text) for each n-gram order."""
    out = []
    values = chars.astype(np.uint64) + np.uint64(1)
    for n in ORDERS:
        out.append(((spans.grams(values, n) >> np.uint64(64 - BITS)).astype(np.int64), spans.whole_grams(offsets, n)))
    return out


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # features x labels, with the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float

    def scores(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, mask of texts with letters)."""
        n, k = len(offsets) - 1, len(self.labels)
        size = np.diff(offsets)
        some = size > 0
        total = np.zeros((len(chars), k), np.float32)
        grams = np.zeros(n)
        for feature, whole in features(chars, offsets):
            total[:len(feature)] += self.weights[feature] * whole[:, None]
            grams += spans.counts(np.append(whole, np.zeros(len(chars) - len(whole), bool)), offsets)
        sums = np.zeros((n, k))
        if some.any():
            sums[some] = np.add.reduceat(total, offsets[:-1][some], axis=0, dtype=np.float64)
        z = (sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True), some


def least_score(model: Model | None, share: float) -> float:
    """The score that lies ``share`` of the way from a guess among the model's languages to certainty."""
    k = len(model.labels) if model else 1
    return 1 / k + share * (1 - 1 / k)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def inverse_frequencies(seen: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies of features that stand in ``seen`` of ``n`` documents."""
    return np.log((1 + n) / (1 + seen)) + 1


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model | None:
    """A model of (label, feature numbers, shares) rows; every fifth row only calibrates."""
    labels = tuple(sorted({r[0] for r in rows}))
    if not labels:
        return None
    number = {x: i for i, x in enumerate(labels)}
    held = rows[4::5] or rows
    learn = [r for i, r in enumerate(rows) if i % 5 != 4]
    size, k = 1 << BITS, len(labels)
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias

    def weights(f: np.ndarray) -> np.ndarray:
        held_back = np.abs(z[f]) <= l1
        return np.where(held_back, 0.0, -(z[f] - np.sign(z[f]) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2))

    for _ in range(epochs):
        for label, f, share in learn:
            at = np.append(f, size)
            x = np.append(share * idf[f] * _SCALE, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[number[label]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    logits = np.array([(share * idf[f] * _SCALE) @ w[f] + w[size] for _, f, share in held])
    truth = np.array([number[r[0]] for r in held])
    grid = np.geomspace(0.05, 20, 121)
    doubt = 1 / (len(held) + 2)  # share of rows that could be wrong although none was: keeps scores below one

    def loss(t: float) -> float:
        s = logits / t
        top = s.max(axis=1)
        said = (1 - doubt) * s[np.arange(len(s)), truth] + doubt * s.mean(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - said))

    best = min(grid, key=loss)
    return Model(labels, (w[:size] * idf[:, None] * _SCALE).astype(np.float32), w[size], float(best))


def _distinct(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text, how often each occurs, and the offsets of the texts."""
    chars, offsets = characters(raw, at)
    f, row = [], []
    for feature, whole in features(chars, offsets):
        f.append(feature[whole])
        row.append(spans.rows_of(offsets)[:len(feature)][whole])
    pair, count = np.unique((np.concatenate(row) << BITS) | np.concatenate(f), return_counts=True)
    return pair & ((1 << BITS) - 1), count, np.searchsorted(pair, np.arange(len(at)) << BITS)


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each hashed feature stands, and how many rows have a letter.

    A task adds up its rows first, so at most 2 ** BITS + 1 numbers of each are shuffled,
    and as many reach the driver.
    """
    def run(batches):
        seen = np.zeros((1 << BITS) + 1, np.int64)  # the last is the number of rows
        for b in batches:
            for _, _, raw, at in spans.pieces(b.column(0), PIECE):
                f, _, cut = _distinct(raw, at)
                seen[:-1] += np.bincount(f, minlength=1 << BITS)
                seen[-1] += np.count_nonzero(np.diff(cut))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["f", "c"])

    got = rows.select(F.col(text).alias("t")).mapInArrow(run, "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).toArrow()
    seen = np.zeros((1 << BITS) + 1, np.int64)
    seen[got.column("f").to_numpy()] = got.column("c").to_numpy()
    return seen[:-1], int(seen[-1])


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 400, max_labels: int = 200) -> Model | None:
    """Fit on a bounded sample of labelled rows: at most ``per_label`` x ``max_labels``.

    A row of the sample has at most 2 ** BITS features, whatever its length. Only rows whose
    hash is small for their label's number of texts are ranked, so that a frequent label
    does not bring ``per_label`` rows of every task together.
    """
    labelled = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(label).alias("y"), F.xxhash64(text).alias("h"))
    known = labelled.groupBy("y", "h").agg(F.min("k").alias("k"))  # copies of a text teach nothing more
    common = known.groupBy("y").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "y").limit(max_labels)
    part = F.col("h") / 2.0 ** 64 + 0.5  # where the hash stands among all hashes
    small = known.join(F.broadcast(common), "y").filter(part * F.col("c") <= 4 * per_label)  # broadcast: max_labels rows
    chosen = small.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))).filter(F.col("r") <= per_label).select("k", "y", "h", "r")
    with_text = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")  # per_label * max_labels keys

    def run(batches):
        for b in batches:
            for lo, hi, raw, at in spans.pieces(b.column("t"), PIECE):
                f, count, cut = _distinct(raw, at)
                share = count / np.maximum(np.add.reduceat(np.append(count, 0), cut[:-1]), 1).repeat(np.diff(cut)) if len(f) else count.astype(float)
                yield pa.RecordBatch.from_arrays([
                    b.column("h").slice(lo, hi - lo), b.column("y").slice(lo, hi - lo), b.column("r").slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(share, pa.float64()))], ["h", "y", "r", "f", "x"])

    got = with_text.mapInArrow(run, "h long, y string, r int, f array<int>, x array<double>").toArrow()
    table = got.sort_by([("r", "ascending"), ("y", "ascending"), ("h", "ascending")])
    f, x = table.column("f").combine_chunks(), table.column("x").combine_chunks()
    sample = [(y, np.array(f[i].values), np.array(x[i].values)) for i, y in enumerate(table.column("y").to_pylist())]
    del got, table, f, x
    pa.default_memory_pool().release_unused()
    sample = [s for s in sample if len(s[1])]
    return fit(sample, inverse_frequencies(*document_frequencies(rows.filter(F.col(label).isNotNull()), text))) if sample else None


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score) of every row, with the ``keep`` columns passed through; a kept text travels once."""
    names_in = [f"c{i}" for i in range(len(keep) + 1)]
    place = 1 + keep.index(text) if text in keep else len(names_in)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS x max_labels weights

    def run(batches):
        m = sent.value
        for b in batches:
            for lo, hi, raw, at in spans.pieces(b.column(place), PIECE):
                if m is None:
                    names, best = ["und"] * (hi - lo), np.zeros(hi - lo)
                else:
                    p, some = m.scores(*characters(raw, at))
                    top = p.argmax(axis=1)
                    best = np.where(some, p.max(axis=1), 0.0)
                    names = [m.labels[i] if s else "und" for i, s in zip(top, some)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(len(keep) + 1)), pa.array(names, pa.string()), pa.array(best)],
                    [*names_in, "lang_pred", "score"])

    columns = [docs[c].alias(name) for c, name in zip((key, *keep), names_in)]
    kinds = "".join(f"{name} {docs.schema[c].dataType.simpleString()}, " for c, name in zip((key, *keep), names_in))
    if text not in keep:
        columns.append(docs[text].alias("t"))
    return docs.select(*columns).mapInArrow(run, f"{kinds}lang_pred string, score double").toDF(key, *keep, "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """Column: rows that are never learned from (crc32 of the key as text, modulo 3, is 1)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(True))
