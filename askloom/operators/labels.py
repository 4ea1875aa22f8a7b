"""Training data from the engine's own retrieval: negatives, pairs, fusion-weight and confidence labels, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx
from askloom.operators import retrieve
from askloom.util import broadcast_if, global_rank, top_per_group

# Wording of the rule-made rejected answers; callers can pass other lists.
FILLERS = (" Other rules may apply to some accounts.", " Results can differ by region and plan.", " Exceptions have been reported in a few cases.")
WRONG_TOOL = ("Please hand this to a person; the documents do not cover it.", "A manual check is needed, so open a ticket.")
TONE = ("This should be clear to anyone: ", "It hardly needs saying, but: ")
GENERAL_KNOWLEDGE = " This information is general knowledge."


def hard_negatives(ranked: DataFrame, gold: DataFrame, k: int = 7, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """First ``k`` ranked documents that are not gold."""
    rest = ranked.join(gold.select(query, doc), [query, doc], "left_anti").withColumnRenamed("rank", "bm25_rank")
    return top_per_group(rest, [query], [F.asc("bm25_rank")], k)


def random_negatives(queries: DataFrame, gold: DataFrame, n: int = 2, seed: int = 42, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """``n`` passages that other queries cite, drawn by hashes; fewer only where no more exist.

    The pool stands in hash order. A query starts at a place its own hash gives and takes
    the following ones, around the end. As many more as it has gold passages are looked at,
    so ``n`` remain whatever it cites, and the join is an equi-join of n plus gold rows.
    """
    pool = gold.select(doc).distinct()
    size = pool.count()
    placed = global_rank(pool.withColumn("_h", maths.hash_order(doc, seed)), [F.col("_h"), F.col(doc)], "_at").select(doc, "_at")
    own = gold.select(query, doc).distinct().groupBy(query).agg(F.count("*").alias("_g"))
    reach = F.least(F.lit(n) + F.coalesce("_g", F.lit(0)), F.lit(size))
    draws = queries.select(query).join(own, query, "left").filter(F.lit(size) > 0).select(query, F.explode(F.sequence(F.lit(1), reach.cast("int"))).alias("j"))
    draws = draws.withColumn("_at", (maths.hash_below(query, seed, size) + F.col("j") - 1) % F.lit(max(1, size)) + 1)
    drawn = draws.join(placed, "_at").join(gold.select(query, doc), [query, doc], "left_anti")
    return top_per_group(drawn, [query], [F.asc("j")], n).select(query, doc, "rank")


def training_pairs(gold: DataFrame, hard: DataFrame, random: DataFrame | None = None, smoothing: float = 0.0,
                   query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Positives (1) with hard and random negatives (0), labels smoothed."""
    pairs = gold.select(query, doc, F.lit(1.0).alias("label")).unionByName(hard.select(query, doc, F.lit(0.0).alias("label")))
    if random is not None:
        pairs = pairs.unionByName(random.select(query, doc, F.lit(0.0).alias("label")))
    label = F.col("label")
    return pairs.withColumn("label", label * (1 - smoothing) + (1 - label) * smoothing)


def positive_passage(citations, gold_texts, answer) -> Column:
    """The first cited text over ten characters, else the first gold text, else the answer."""
    c = F.filter(F.transform(citations, lambda x: tx.strip(x["cited_text"])), lambda t: F.length(t) > 10)
    return F.coalesce(F.get(c, F.lit(0)), F.get(gold_texts, F.lit(0)), answer)


def gold_tools(queries: DataFrame, labels: DataFrame, query: str = "query_id") -> DataFrame:
    """Gold tool and its index per query; no label means SearchKB, an unknown tool has index 1."""
    tool = F.coalesce("gold_tool", F.lit("SearchKB"))
    pos = F.array_position(F.array(*[F.lit(t) for t in fixed.TOOLS]), tool)
    return queries.join(labels.select(query, "gold_tool"), query, "left").select(
        query, tool.alias("gold_tool"), F.when(pos > 0, pos - 1).otherwise(1).cast("int").alias("tool_index"))


def alpha_oracle(cand: DataFrame, gold: DataFrame, k: int = 20, steps: int = 10, balanced: bool = False,
                 query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """Per query: recall@k for every fusion weight on the grid and the best weight.

    Candidates are retrieved once and fused for all weights in one pass; ties go to the
    smallest weight. ``balanced`` gives 0.5 when all weights tie, else the median winner.
    """
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i / steps)).alias("alpha")
    n_gold = gold.groupBy(query).agg(F.count_distinct(doc).alias("n_gold"))
    marked = cand.join(broadcast_if(n_gold, gold), query).join(gold.select(query, doc, F.lit(1).alias("hit")).distinct(), [query, doc], "left")
    fused = marked.select(query, doc, "n_gold", "hit", grid, "dense_norm", "sparse_norm").withColumn(
        "score", F.round(F.col("alpha") * F.col("dense_norm") + (1 - F.col("alpha")) * F.col("sparse_norm"), 6))
    top = top_per_group(fused, [query, "alpha"], retrieve.by_score("score", doc), k)
    recall = top.groupBy(query, "alpha").agg((F.count("hit") / F.first("n_gold")).alias("recall"))
    rows = recall.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("alpha", "recall"))).alias("g"))
    best = F.array_max(F.transform("g", lambda x: x["recall"]))
    won = F.transform(F.filter("g", lambda x: x["recall"] == F.col("best")), lambda x: x["alpha"])
    keyed = F.map_from_entries(F.transform("g", lambda x: F.struct(F.format_string("%.2f", x["alpha"]), F.round(x["recall"], 6))))
    out = rows.withColumn("best", best).withColumn("won", won)
    if balanced:
        n = F.size("won")
        mid = (F.get("won", F.floor((n - 1) / 2).cast("int")) + F.get("won", F.floor(n / 2).cast("int"))) / 2
        alpha = F.when(n == steps + 1, 0.5).otherwise(F.round(mid, 6))
    else:
        alpha = F.get("won", F.lit(0))
    return out.select(query, alpha.alias("optimal_alpha"), keyed.alias("grid_scores"))


def mean_pool(top: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int, k: int = 5, query: str = "query_id",
              doc: str = "doc_id", embedding: str = "embedding") -> DataFrame:
    """Mean vector of a query's best ``k`` documents, zeros when it has none (k vectors per group at most)."""
    rows = vectors.select(doc, embedding).join(broadcast_if(top.filter(F.col("rank") <= k), queries, k), doc)
    zeros = F.array_repeat(F.lit(0.0), dim)
    held = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", embedding))).alias("v"))
    total = F.aggregate("v", zeros, lambda s, x: F.zip_with(s, x[embedding], lambda a, b: a + b.cast("double")))
    mean = held.select(query, F.transform(total, lambda x: F.round(x / F.size("v"), 6)).alias("evidence"))
    return queries.select(query).join(mean, query, "left").select(query, F.coalesce("evidence", zeros).alias("evidence"))


def resume(items: DataFrame, done: DataFrame, key: str = "query_hash") -> DataFrame:
    return items.join(done.select(key), key, "left_anti")


def corrupt(pairs: DataFrame, pool: DataFrame, key: str, chosen: str, per_type: int | None = None, seed: int = 42) -> DataFrame:
    """Preference rows: each answer in up to six rejected forms; unchanged ones drop out.

    Choices come from hashes of the key. A made-up citation takes its id from ``pool``
    (doc_id), met through hash buckets. ``per_type`` is the number of rows asked for per kind.
    """
    n_pool = max(1, pool.count() // 4)
    ids = pool.select(F.col("doc_id").cast("string").alias("fake"), maths.hash_below("doc_id", seed, n_pool).alias("b"))
    one = ids.groupBy("b").agg(F.min("fake").alias("fake"))
    base = pairs.withColumn("b", maths.hash_below(key, seed, n_pool)).join(broadcast_if(one, pool), "b", "left").drop("b")
    a, rx = F.col(chosen), fixed.CITATION_PATTERNS["word_id"]

    def pick(values):
        i = F.floor(maths.hash_unit(key, seed) * len(values)).cast("int")
        return F.get(F.array(*[F.lit(v) for v in values]), i)

    bare = tx.strip_citations(a, "word_id")
    mark = F.regexp_extract(a, rx, 0)
    fake = F.coalesce("fake", F.concat(F.lit("fa"), F.substring(F.md5(key), 1, 14)))
    new = F.concat(F.lit("["), fake, F.regexp_extract(mark, r"(:\d+-\d+\])$", 1))
    first = F.regexp_extract(a, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    forms = {
        "hallucinated_citation": F.when(mark != "", F.replace(a, mark, new)),
        "no_citation": tx.strip(F.concat(bare, F.lit(GENERAL_KNOWLEDGE))),
        "partial_truncation": tx.strip(F.when(first != "", first).otherwise(F.left(a, F.greatest(F.lit(1), F.floor(F.length(a) / 3).cast("int"))))),
        "verbose_unfaithful": tx.strip(F.concat(bare, pick(FILLERS))),
        "wrong_tool": pick(WRONG_TOOL),
        "unsafe_tone": tx.strip(F.concat(pick(TONE), F.lower(F.left(bare, F.lit(1))), F.substring(bare, F.lit(2), F.length(bare)))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("rejection_type"), v.alias("rejected")) for k, v in forms.items()])
    out = base.select(*pairs.columns, F.inline(rows)).filter((F.col("rejected") != "") & (tx.strip("rejected") != tx.strip(chosen)))
    if per_type is None:
        return out
    return top_per_group(out, ["rejection_type"], [maths.hash_order(key, seed), F.asc(key)], per_type, "_r").drop("_r")
