"""Lexical variants of a question, and the anchors that a hit must share with it.

Only the decomposition of characters, which Spark lacks, is a pandas UDF, and it sees questions and
their hits only; tokens, filters and joins are built-in functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip
from ..settings import DEFAULTS, Settings

# Names of symbols, and words that mark a question's kind.
SYMBOLS = {
    "Σ": "Sigma", "σ": "sigma", "ϑ": "vartheta theta", "θ": "theta", "τ": "tau", "ζ": "zeta", "Ξ": "Xi", "Ω": "Omega", "ω": "omega",
    "π": "pi", "Δ": "Delta", "δ": "delta", "μ": "mu", "ν": "nu", "λ": "lambda", "α": "alpha", "β": "beta", "γ": "gamma",
}
FIGURE_WORDS = ["figure", "fig", "fig.", "plot", "graph", "curve", "axis", "legend", "panel", "caption", "snippet"]
FUNDING_WORDS = ["financially", "supported", "funding", "grant", "program", "acknowledge", "acknowledgement", "acknowledgment"]
FIGURE_VARIANT = ["figure", "fig", "caption", "plot", "curve"]
FUNDING_VARIANT = ["funding", "financially supported", "program", "grant", "acknowledgement"]
ANCHOR_WORDS = [
    "sigma", "theta", "vartheta", "tau", "zeta", "xi", "omega", "delta", "lambda", "alpha", "beta", "gamma",
    "figure", "fig", "plot", "curve", "funding", "grant",
]
NOT_NAMES = ["At", "In", "On", "The", "This", "That", "Which", "What", "Where", "When", "According", "Figure", "Fig"]
NOT_LOOSE = ["which", "what", "where", "according", "value", "larger"]
# Tokens, names, names with an index and what they become, and the fields of a hit that may share an anchor.
TOKEN = r"[A-Za-z][A-Za-z0-9_.-]*|[0-9]+(?:\.[0-9]+)?"
NAME = r"\b[A-Z][A-Za-z0-9]+(?:-[A-Z][A-Za-z0-9]+)*\b|\b[A-Z]{2,}\b"
INDEXED, SPELT_INDEX = r"([A-Za-z]+)_\{?([A-Za-z0-9]+)\}?", "$1_$2 $1 $2"
ANCHOR_FIELDS = ("text", "table_markdown", "formula_latex", "caption", "ocr_text", "object_description", "title", "section")

_SPELT = str.maketrans({c: f" {name} " for c, name in SYMBOLS.items()} | dict.fromkeys("≈~", " approximately "))


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    """Symbols by name, and letters without their marks."""

    def one(x: str | None) -> str:
        # symbols that only decomposition brings out are spelt after it
        apart = unicodedata.normalize("NFKD", (x or "").translate(_SPELT))
        return "".join(c for c in apart if unicodedata.category(c) != "Mn").translate(_SPELT)

    return texts.map(one)


def one_spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def plain_symbols(text: Column) -> Column:
    """Symbols spelt out, marks removed, and a name with an index also as its two words."""
    return one_spaced(F.regexp_replace(_plain(text), INDEXED, SPELT_INDEX))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def distinct_in_order(values: Column) -> Column:
    """Values without blanks around them, each once whatever its case, where it is first seen."""

    def firsts(v: Column) -> Column:
        return F.filter(v, lambda x, i: (x != "") & (F.array_position(F.transform(v, F.lower), F.lower(x)) == i + 1))

    return F.flatten(F.transform(F.array(F.transform(values, lambda x: one_spaced(F.coalesce(x, F.lit(""))))), firsts))


def is_anchor(token: Column) -> Column:
    return token.rlike("[0-9_-]") | F.lower(token).isin(ANCHOR_WORDS)


def keyword_variant(text: Column, s: Settings = DEFAULTS) -> Column:
    """Tokens that are long enough, or have a digit or an underscore."""
    kept = F.filter(query_tokens(text), lambda t: (F.length(t) >= max(1, s.variant_min_letters)) | t.rlike("[0-9_]"))
    return F.array_join(distinct_in_order(kept), " ")


def domain_variant(text: Column, words: list[str]) -> Column:
    """Words of the kind, and the text's anchors."""
    return F.array_join(distinct_in_order(F.concat(F.array(*map(F.lit, words)), F.filter(query_tokens(text), is_anchor))), " ")


def query_variants(questions: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, variant, text): the question, its plain form, keywords, figure and funding forms.

    Each text once whatever its case, ``variants_most`` at most; blank questions have none.
    """
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower("raw").contains(w))
    asked = questions.select("query_id", one_spaced(F.coalesce("text", F.lit(""))).alias("raw")).where("raw <> ''")
    asked = asked.withColumn("plain", plain_symbols(F.col("raw")))
    base = F.coalesce(F.nullif("plain", F.lit("")), "raw")
    forms = F.array(
        "raw", "plain", keyword_variant(base, s),
        F.when(has(FIGURE_WORDS), domain_variant(base, FIGURE_VARIANT)), F.when(has(FUNDING_WORDS), domain_variant(base, FUNDING_VARIANT)),
    )
    return asked.select("query_id", F.posexplode(F.slice(distinct_in_order(forms), 1, max(1, s.variants_most))).alias("variant", "text"))


def anchors(text: Column, strong: bool = True) -> Column:
    """Lower-cased anchors of a question; also its long words where they need not be strong."""
    found = query_tokens(plain_symbols(text))
    kept = F.filter(found, is_anchor)
    if not strong:
        kept = F.concat(kept, F.filter(found, lambda t: (F.length(t) >= 5) & ~F.lower(t).isin(NOT_LOOSE)))
    names = F.filter(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(NOT_NAMES))
    return distinct_in_order(F.transform(F.concat(kept, names), F.lower))


def with_shared_anchor(hits: DataFrame, anchors: str = "anchors", fields: tuple[str, ...] = ANCHOR_FIELDS) -> DataFrame:
    """Add shares_anchor: whether one of the fields that a hit has, in its plain form, holds one of the question's anchors.

    For hits, which are few; the plain form of a text is made in Python.
    """
    there = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields if c in hits.columns]
    plain = hits.withColumn("__plain", F.lower(plain_symbols(F.concat_ws(" ", *there))))
    found = F.exists(anchors, lambda a: F.col("__plain").contains(a))
    return plain.withColumn("shares_anchor", F.coalesce(found, F.lit(False))).drop("__plain")
