"""Repeated runs of lines, found by winnowing. Column functions, one aggregate and joins only.

Three consecutive lines make a gram. Of every three consecutive grams the one of smallest
hash is a fingerprint (winnowing), so each run of five equal lines holds one, wherever it
stands. A fingerprint's first occurrence (smallest key, then position) is its source; every
later occurrence is joined with it and extended line by line both ways, as far as the
neighbouring fingerprint can lie (two lines). The lines so covered are deleted from the later
place; the first place keeps them. This alone finds no run of one or two lines, runs of three
or four by chance, and where a fingerprint first stood in another context it can leave lines
at the edges of a run.

With ``least_words`` every run of lines of so many words or more that stood earlier is deleted
as well, whole and whatever its number of lines: from each line on, the shortest window of
lines with so many words is a key, and so is the shortest one that ends at each line. A line of
a repeated run lies in such a window inside the run, so the first occurrence per window tells
exactly which lines to delete, without comparing contexts. There are at most two windows per line.

The work is proportional to the number of lines: one row per fingerprint, its counts combined
before the shuffle, and one source per fingerprint in the join; a line that stands in a third
of all documents makes no pairs of documents.

Defined results: a null text stays null and an empty one empty; without ``least_words`` texts of
fewer than three lines are left alone, and grams of blank lines only always are. Rows of equal key and text count as one
document and are treated alike; rows of equal key and different text are different documents,
ordered by a hash of the text. Null keys come first. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloom.functions.text import let

GRAM, WINDOW = 3, 3
_REACH = WINDOW - 1
_WORD = r"[^\x20\x09-\x0D]+"


def _short(c: Column) -> Column:
    """64 bits of a digest, as text."""
    return F.substring(F.md5(c), 1, 16)


def _prints(h: Column) -> Column:
    """The fingerprints of an array of line digests, with the digests around them."""
    blank = _short(F.lit(""))
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: let(
        F.concat(*[F.get(h, i + j) for j in range(GRAM)]), lambda x: F.when(x == F.concat(*[blank] * GRAM), F.lit("z")).otherwise(_short(x))))

    def chosen(g: Column) -> Column:
        places = F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(g) - _REACH, F.lit(1))),
            lambda j: let(F.slice(g, j, WINDOW), lambda part: (j + F.array_position(part, F.array_min(part)) - 2).cast("int"))))
        return F.transform(places, lambda p: F.struct(
            F.get(g, p).alias("gram"), p.alias("pos"),
            F.transform(F.array(*[F.lit(j) for j in range(1, WINDOW)]), lambda j: F.get(h, F.when(p >= j, p - j))).alias("before"),
            F.transform(F.array(*[F.lit(j) for j in range(1, WINDOW)]), lambda j: F.get(h, p + (GRAM - 1) + j)).alias("after")))

    return F.when(F.size(h) >= GRAM, let(grams, chosen))


def _agree(a: Column, b: Column) -> Column:
    """How many neighbouring lines agree before the first that differs."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(~F.get(same, F.lit(0)), 0).when(~F.get(same, F.lit(1)), 1).otherwise(_REACH)


def _windows(text: Column, least: int) -> Column:
    """(gram, pos, last) of the windows of lines that are shortest, from their first or to their last line, with ``least`` words."""
    full = least * 64  # words and lines of a window in one number: a window has ``least`` lines with words at most

    def sized(units: Column, i: Column, most: int) -> Column:
        total = F.aggregate(F.slice(units, i + 1, most), F.lit(0), lambda a, u: F.when(a >= full, a).otherwise(a + u["n"] * 64 + 1))
        return F.when(total >= full, total.bitwiseAND(63))

    def spans(units: Column, ends: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: let(F.get(ends, i), lambda e: F.transform(
            F.sequence(e, F.greatest(e, F.coalesce(F.get(ends, i + 1), F.size(units)) - 1)),
            lambda j: F.struct(F.get(units, i)["pos"].alias("pos"), F.get(units, j)["pos"].alias("last"))))))

    def keyed(rows: Column) -> Column:
        units = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("pos"), F.least(F.regexp_count(x, F.lit(_WORD)), F.lit(least)).alias("n"))), lambda u: u["n"] > 0)
        places = let(units, lambda u: let(
            F.array_compact(F.transform(u, lambda _, i: F.coalesce(sized(u, i, 8), sized(u, i, least)) + i - 1)),
            lambda ends: F.when(F.size(ends) > 0, spans(u, ends))))
        return let(F.transform(rows, lambda x: F.md5(x)), lambda h: F.transform(places, lambda w: F.struct(
            F.unhex(F.md5(F.array_join(F.slice(h, w["pos"] + 1, w["last"] - w["pos"] + 1), ""))).alias("gram"), w["pos"].alias("pos"), w["last"].alias("last"))))

    return let(F.split(text, "\n", -1), keyed)


def private(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int | None = None) -> DataFrame:
    """(k, t): key and text hash of a document; ``lines``: its sorted line numbers (from 1) to delete."""
    if least_words is not None and not 1 <= least_words <= 63:
        raise ValueError("least_words is 1 to 63")
    base = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("x"))
    prints = F.explode(let(F.transform(F.split("x", "\n", -1), _short), _prints))
    at = base.select("k", "t", prints.alias("f")).select("k", "t", "f.*").filter(F.col("gram") != "z")
    place = F.struct("k", "t", "pos", "before", "after")
    sources = at.groupBy("gram").agg(F.min(place).alias("src"), F.max(F.struct("k", "t", "pos")).alias("last")).filter(
        F.struct("src.k", "src.t", "src.pos") != F.col("last")).select("gram", "src")
    later = at.join(sources, "gram").filter(F.struct("k", "t", "pos") > F.struct("src.k", "src.t", "src.pos"))
    covered = later.select("k", "t", F.struct(
        (F.col("pos") + 1 - _agree(F.col("before"), F.col("src.before"))).alias("lo"), (F.col("pos") + GRAM + _agree(F.col("after"), F.col("src.after"))).alias("hi")).alias("c"))
    if least_words is not None:
        covered = covered.unionByName(_repeated_windows(base, least_words))
    return covered.groupBy("k", "t").agg(F.array_sort(F.array_distinct(F.flatten(
        F.transform(F.collect_set("c"), lambda c: F.sequence(c["lo"], c["hi"]))))).alias("lines"))


def _repeated_windows(base: DataFrame, least: int) -> DataFrame:
    """(k, t, c): the windows of a document that stood earlier, as first and last line number."""
    at = base.select("k", "t", F.explode(_windows(F.col("x"), least)).alias("f")).select("k", "t", "f.*")
    place = F.struct("k", "t", "pos")
    sources = at.groupBy("gram").agg(F.min(place).alias("src"), F.max(place).alias("end")).filter(F.col("src") != F.col("end")).select("gram", "src")
    return at.join(sources, "gram").filter(place > F.col("src")).select(
        "k", "t", F.struct((F.col("pos") + 1).alias("lo"), (F.col("last") + 1).alias("hi")).alias("c"))


def _without(text: Column, lines: Column) -> Column:
    """The text without the given sorted line numbers."""
    def cut(rows: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), lines, F.array(F.size(rows) + 1))
        return let(edges, lambda e: F.array_join(F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(e) - 1), lambda i: F.slice(rows, F.get(e, i - 1) + 1, F.get(e, i) - F.get(e, i - 1) - 1))), "\n"))

    return let(F.split(text, "\n", -1), cut)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int | None = None) -> DataFrame:
    """All columns with ``text`` rid of later repeated runs; n_lines and n_removed are added."""
    k, t, at = (private(docs, name) for name in ("k", "t", "lines"))
    found = repeated_lines(docs, key, text, least_words).select(F.col("k").alias(k), F.col("t").alias(t), F.col("lines").alias(at))
    joined = docs.join(found, docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(t)), "left")
    hit = F.col(at).isNotNull()
    n_lines = F.when(docs[text].isNull(), 0).otherwise(F.length(docs[text]) - F.length(F.translate(docs[text], "\n", "")) + 1)
    return joined.withColumns({
        "n_lines": n_lines.cast("long"), "n_removed": F.when(hit, F.size(at)).otherwise(0).cast("long"),
        text: F.when(hit, _without(docs[text], F.col(at))).otherwise(docs[text])}).drop(k, t, at)
