"""Formulas in texts: spans of six grammars, of which the earliest and longest are kept.

An Arrow function scans the texts that hold a delimiter; no other text reaches Python. Each grammar
is searched once from left to right, and a closing delimiter that is not ahead is not looked for
again, so that long texts of unclosed formulas take no longer than others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

# Environments, and what is and is not a formula.
ENVIRONMENTS = r"equation\*?|align\*?|aligned|gather\*?|multline\*?|split|cases|matrix|pmatrix|bmatrix|vmatrix"
COMMAND = r"\\[a-zA-Z]+"
SYMBOLS = "=^_+-*/<>≤≥≈≠∑∫√∞π"
REFERENCE = r"^\[\d+(?:\s*[,，\-–]\s*\d+)*\]$"
NOTE = r"(?i)^\^\{?[0-9,\s*\\dagger\\ddagger\\ast†‡]+\}?$"
CJK = "[一-鿿]"
LONG, PLAIN = 80, 0.65
#: A dollar that is neither escaped nor one of several.
DOLLAR = r"(?<![\\$])\$(?!\$)"

_command, _symbol, _reference, _note, _cjk, _dollar = map(re.compile, (COMMAND, f"[{re.escape(SYMBOLS)}]", REFERENCE, NOTE, CJK, DOLLAR))
#: (kind, opening, closing for the opening's match, whether the delimiters belong to the formula)
_GRAMMARS: tuple[tuple[str, re.Pattern, Callable[[re.Match], re.Pattern], bool], ...] = (
    ("mathml", re.compile(r"<math\b", re.I), lambda m: re.compile("</math>", re.I), True),
    ("environment", re.compile(rf"\\begin\{{({ENVIRONMENTS})\}}"), lambda m: re.compile(re.escape(rf"\end{{{m[1]}}}")), True),
    ("display", re.compile(r"\$\$(?=.)", re.S), lambda m: re.compile(r"(?<=.)\$\$", re.S), False),
    ("display", re.compile(r"\\\["), lambda m: re.compile(r"\\\]"), False),
    ("inline", re.compile(r"\\\("), lambda m: re.compile(r"\\\)"), False),
)
SPANS = "array<struct<start:int,end:int,kind:string,latex:string,formulas:int>>"


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    latex: str
    formulas: int = 1


class Rules(NamedTuple):
    """``text_only`` drops all inline formulas, ``references`` those like ``[3, 4]``, ``notes`` marks of footnotes;
    ``group`` joins neighbouring display formulas."""

    least: int = DEFAULTS.formula_min
    gap_lines: int = DEFAULTS.formula_gap_lines
    text_only: bool = False
    references: bool = False
    notes: bool = False
    group: bool = False

    def keep(self, body: str, kind: str) -> bool:
        """A formula has a command or a symbol and is not prose."""
        short = " ".join(body.split())
        if not short or (kind == "inline" and (self.text_only or len(short) < self.least)):
            return False
        if (self.references and _reference.match(short)) or (self.notes and _note.match(short)):
            return False
        if _command.search(short):
            return True
        letters = sum(map(str.isalpha, short)) / (len(short) - short.count(" "))
        return bool(_symbol.search(short)) and not _cjk.search(short) and (len(short) <= LONG or letters <= PLAIN)


def _delimited(text: str, opening: re.Pattern, closing: Callable, whole: bool) -> Iterator[tuple[int, int, str]]:
    at, absent = 0, set()
    while m := opening.search(text, at):
        end, body = closing(m), m.end() if whole else m.end() + 1
        found = None if end.pattern in absent else end.search(text, body)
        if found:
            yield m.start(), found.end(), text[m.start() : found.end()] if whole else text[m.end() : found.start()]
            at = found.end()
        else:
            absent.add(end.pattern)
            at = m.start() + 1


def _between_dollars(text: str, rules: Rules) -> Iterator[Span]:
    """A dollar opens if the text up to the next one is a formula on one line; that one then closes it and opens none."""
    places, closed = [m.start() for m in _dollar.finditer(text)], -1
    for a, b in zip(places, places[1:], strict=False):
        body = text[a + 1 : b]
        if a != closed and "\n" not in body and rules.keep(body, "inline"):
            yield Span(a, b + 1, "inline", body.strip())
            closed = b


def _follows(text: str, a: Span, b: Span, gap_lines: int) -> bool:
    gap = text[a.end : b.start]
    return a.kind == b.kind == "display" and not gap.strip() and gap.count("\n") <= gap_lines + 1


def spans_of(text: str, rules: Rules) -> list[Span]:
    """Of overlapping spans the one that starts first stays, of those the longest, then by grammar."""
    found = [Span(a, b, kind, body.strip()) for kind, o, c, whole in _GRAMMARS for a, b, body in _delimited(text, o, c, whole) if rules.keep(body, kind)]
    found += _between_dollars(text, rules)
    out: list[Span] = []
    for x in sorted(found, key=lambda x: (x.start, -x.end)):
        if out and x.start < out[-1].end:
            continue
        out.append(x)
    if not rules.group:
        return out
    groups: list[list[Span]] = []
    for x in out:
        if groups and _follows(text, groups[-1][-1], x, rules.gap_lines):
            groups[-1].append(x)
        else:
            groups.append([x])
    return [Span(g[0].start, g[-1].end, g[0].kind, "\n\n".join(x.latex for x in g), len(g)) for g in groups]


def formulas(text: Column, s: Settings = DEFAULTS, **flags: bool) -> Column:
    """Array of (start, end, kind, latex, formulas) of a text, in order and in code points.

    Null and empty texts, and those without a delimiter, have none. ``formulas`` is the number of
    display formulas that a group joins. For the flags see ``Rules``.
    """
    rules = Rules(s.formula_min, s.formula_gap_lines, **flags)

    @F.arrow_udf(SPANS)
    def scanned(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("latex", pa.string()), ("formulas", pa.int32())]))
        return pa.array([[] if t is None else [s._asdict() for s in spans_of(t, rules)] for t in x.to_pylist()], kind)

    return scanned(F.when(text.rlike(r"\$|\\[\[(b]|(?i:<math)"), text))
