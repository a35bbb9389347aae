"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checks.

An Aho-Corasick automaton walks each text once. Only where it reports a keyword is the keyword's
expression tried, anchored at that place. Kinds with an embedded check (a CRC32 in base 62, a JSON
header) are kept only if it holds. Runs of hexadecimal digits have no keyword; one expression over
the whole text finds them.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, text_of, texts_of

# The expressions of the base kinds, in the order of the kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Public token formats with an embedded check.
GITHUB = re.compile(r"(gh[pousr]_)([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"(npm_)([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: What a token of this format goes on with; one that fails fails from each later start within this run.
RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]*")}
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]


def _crc_holds(m: re.Match) -> bool:
    """The last six characters are the CRC32 of those before, in base 62."""
    body, check = m[2][:30], m[2][30:]
    n, out = binascii.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0") == check


def _header_holds(m: re.Match) -> bool:
    """The first part is base64 of a JSON object that names an algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError):
        return False


RULES = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "github": (GITHUB, _crc_holds),
    "npm": (NPM, _crc_holds),
    "jwt": (JWT, _header_holds),
    "pem": (PEM, lambda m: True),
}
# Keywords in lower case, each with the kind it announces.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def spans_of(text: str, lowered: str, words: ahocorasick.Automaton) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start and then kind; leftmost and without overlap within a kind."""
    found: list[tuple[int, str, int]] = []
    past = dict.fromkeys(RULES, 0)
    for last, (size, kind) in words.iter(lowered):
        start = last + 1 - size
        if start < past[kind]:
            continue
        expression, holds = RULES[kind]
        m = expression.match(text, start)
        if m:
            past[kind] = m.end()
            if holds(m):
                found.append((start, kind, m.end()))
        elif kind in RUNS:
            past[kind] = RUNS[kind].match(text, start).end()
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return found


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def _scan(batches):
    words = automaton()
    for batch in batches:
        rows = []
        for doc, raw in zip(column_of(batch, "doc_id"), texts_of(batch), strict=True):
            text = text_of(raw)
            spans = spans_of(text, text.encode().lower().decode(), words)
            base = [s for s in spans if s[1] in BASE]
            counts = [sum(s[1] == k for s in base) for k in BASE]
            rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=list(names))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text; other columns are ignored).

    Spans are in code points, end exclusive. A null text counts as empty: no spans, the digest of
    the empty string. Bytes that are not UTF-8 count as U+FFFD. Repeated rows each return a row; a null doc_id stays null.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each secret replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, _, end in spans_of(text, text.encode().lower().decode(), automaton()):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]
