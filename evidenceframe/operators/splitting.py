"""Hard splits of texts and tables to a token limit, within one row and without Python.

Pieces are packed by a fold: a piece joins the current part while the part stays within the limit;
a piece that alone is too long is cut into smaller units. Tokens are estimated by length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip, token_estimate
from ..settings import DEFAULTS, Settings

#: Ends of sentences, and line breaks.
SENTENCE_END = r"(?<=[。！？!?.])\s+|\n"
PARAGRAPH_END = r"\n\s*\n+"


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def window_parts(text: Column, s: Settings = DEFAULTS) -> Column:
    """Consecutive windows of four characters a token, without blanks at their ends."""
    width = max(256, 4 * s.split_tokens)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(width))
    return _filled(F.transform(starts, lambda a: F.substring(text, a, F.lit(width))))


def packed(pieces: Column, separator: str, cut: Callable[[Column], Column], s: Settings, head: Column | None = None) -> Column:
    """Parts of pieces in order; ``cut`` splits a piece that is too long where a part would begin."""
    whole = lambda x: F.concat(head, F.lit("\n"), x) if head is not None else x
    fits = lambda x: token_estimate(whole(x)) <= s.split_tokens

    def step(state: Column, piece: Column) -> Column:
        joined = F.when(state.open.isNull(), piece).otherwise(F.concat(state.open, F.lit(separator), piece))
        done = F.when(fits(joined), state.done).when(state.open.isNotNull(), F.array_append(state.done, whole(state.open))).otherwise(F.concat(state.done, F.transform(cut(piece), whole)))
        still = F.when(fits(joined), joined).when(state.open.isNotNull(), piece)
        return F.struct(done.alias("done"), still.alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(pieces, start, step, lambda x: F.when(x.open.isNull(), x.done).otherwise(F.array_append(x.done, whole(x.open))))


def sentence_parts(text: Column, s: Settings = DEFAULTS) -> Column:
    pieces = _filled(F.split(text, SENTENCE_END))
    return F.when(F.size(pieces) <= 1, window_parts(strip(text), s)).otherwise(packed(pieces, " ", lambda x: window_parts(x, s), s))


def paragraph_parts(text: Column, s: Settings = DEFAULTS) -> Column:
    pieces = _filled(F.split(text, PARAGRAPH_END))
    return F.when(F.size(pieces) <= 1, sentence_parts(text, s)).otherwise(packed(pieces, "\n\n", lambda x: sentence_parts(x, s), s))


def table_parts(text: Column, s: Settings = DEFAULTS) -> Column:
    """Groups of rows under the two lines of the table's header; other texts by paragraph."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: strip(x) != "")
    head = F.array_join(F.slice(lines, 1, 2), "\n")
    rows = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    is_table = (F.size(lines) >= 3) & F.coalesce(F.try_element_at(lines, F.lit(2)).contains("---"), F.lit(False))
    return F.when(is_table, packed(rows, "\n", lambda x: paragraph_parts(x, s), s, head)).otherwise(paragraph_parts(text, s))


def hard_split(text: Column, table: bool = False, s: Settings = DEFAULTS) -> Column:
    """Array of parts within the limit; null and blank texts have none, short texts are one part."""
    body = strip(F.coalesce(text, F.lit("")))

    def parts(x: Column) -> Column:
        raw = _filled(table_parts(x, s) if table else paragraph_parts(x, s))
        tight = F.flatten(F.transform(raw, lambda p: F.when(token_estimate(p) <= s.split_tokens, F.array(p)).otherwise(window_parts(p, s))))
        return F.when(token_estimate(x) <= s.split_tokens, F.array(x)).otherwise(tight)

    # as a lambda variable, the stripped text is made once a row
    return F.flatten(F.transform(F.filter(F.array(body), lambda b: b != ""), parts))
