"""Numeric query features as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions import fixed, maths
from askloom.functions import text as tx

NAMES12 = (
    "log_query_length", "keyword_density", "domain_hash", "query_emb_norm", "has_exact_phrase", "is_wh_question",
    "numeric_density", "avg_word_len", "stopword_ratio", "capitalized_ratio", "has_definition_cue", "verb_density",
)


def _share(tokens: Column, test, n: Column) -> Column:
    return F.size(F.filter(tokens, test)) / n


def features12(text, domain, embedding_norm) -> dict[str, Column]:
    """The twelve features by name; expects the norm of the query vector (0 without one)."""
    t = F.col(text) if isinstance(text, str) else text
    tokens = tx.words(t)
    low = F.transform(tokens, lambda x: F.regexp_replace(F.lower(x), r"[?.,!;:]+$", ""))
    n = F.greatest(F.size(tokens), F.lit(1))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    total = F.aggregate(tokens, F.lit(0), lambda s, x: s + F.length(x))
    values = (
        F.log1p(n.cast("double")), F.size(F.array_distinct(low)) / n, maths.bucket_hash(domain), embedding_norm,
        flag(t.rlike('"[^"]+"')), flag(F.coalesce(F.get(low, F.lit(0)).isin(*fixed.WH_WORDS), F.lit(False))),
        _share(low, lambda x: x.rlike(r"^\d[\d,.$%]*$"), n), total / n / 10.0, _share(low, lambda x: x.isin(*fixed.FEATURE_STOPWORDS), n),
        _share(tokens, lambda x: x.rlike(r"^\p{Lu}"), n), flag(F.exists(low, lambda x: x.isin(*fixed.DEFINITION_CUES))),
        _share(low, lambda x: x.isin(*fixed.COMMON_VERBS), n),
    )
    return dict(zip(NAMES12, values))


def features4(text, embedding_norm) -> dict[str, Column]:
    t = F.col(text) if isinstance(text, str) else text
    tokens = tx.words(F.lower(t))
    return {
        "length": F.log1p(F.size(tokens).cast("double")),
        "keyword_density": F.size(F.array_distinct(tokens)) / F.greatest(F.size(tokens), F.lit(1)),
        "embedding_norm": embedding_norm,
        "has_exact_phrase": F.when(t.rlike('"[^"]+"'), 1.0).otherwise(0.0),
    }
