"""Text functions as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A CJK character, or a run of ASCII letters, digits and underscores.
TOKEN = r"[一-鿿]|[a-zA-Z0-9_]+"


#: Fixed value: a CJK character, or words of ASCII letters and digits joined by hyphens and underscores.
MIXED = r"[一-鿿]|[a-zA-Z0-9_]+(?:[-_][a-zA-Z0-9_]+)*"


_CJK, _TOKEN, _MIXED = re.compile("[一-鿿]"), re.compile(TOKEN), re.compile(MIXED)
#: Bytes that are in no token become blanks; those of words with hyphens keep the hyphen.
_IN_TOKENS, _IN_MIXED = (bytes(b if chr(b).isascii() and (chr(b).isalnum() or chr(b) in more) else 32 for b in range(256)) for more in ("_", "_-"))
_LOOSE = re.compile(rb"-(?![a-z0-9_])|(?<![a-z0-9_])-")


def token_bytes(text: str) -> list[bytes]:
    """What ``tokens`` gives for one text, in a task. Only a text with CJK characters needs the expression."""
    raw = text.encode().lower()  # A to Z only: no other letter is in a token
    return [t.encode() for t in _TOKEN.findall(raw.decode())] if _CJK.search(text) else raw.translate(_IN_TOKENS).split()


def mixed_bytes(low: str) -> list[bytes]:
    """What ``mixed_tokens`` gives for one text in lower case, in a task."""
    text = compatible(low)
    if _CJK.search(text):
        return [t.encode() for t in _MIXED.findall(text)]
    raw = text.encode().translate(_IN_MIXED)
    return (_LOOSE.sub(b" ", raw) if b"-" in raw else raw).split()


def compatible(text: str) -> str:
    """Compatibility form (NFKC) in lower case of a text in lower case."""
    return text if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def folded(text: Column) -> Column:
    """Compatibility form (NFKC) in lower case; null is empty.

    The form is beyond the built-in functions. Only texts beyond ASCII go to it, by pieces of a
    batch, so that a task's Python holds few texts at a time.
    """

    @F.arrow_udf("string")
    def nfkc(x: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else compatible(t) for t in x.slice(at, 256).to_pylist()], pa.string()) for at in range(0, len(x), 256)]
        return pa.concat_arrays(parts) if parts else x

    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(nfkc(F.when(F.octet_length(low) > F.length(low), low)), low)


def mixed_tokens(text: Column) -> Column:
    """Tokens that keep hyphenated words whole."""
    return mixed_of(folded(text))


def mixed_of(form: Column) -> Column:
    """The mixed tokens of a folded text."""
    return F.regexp_extract_all(form, F.lit(MIXED), F.lit(0))


def normal_text(text: Column) -> Column:
    """Letters, digits and underscores of any script, in compatibility form and lower case."""
    return normal_of(folded(text))


def normal_of(form: Column) -> Column:
    """The normal form of a folded text."""
    return F.regexp_replace(form, r"(?U)[^\p{L}\p{N}_]+", "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Tokens in order, lower-cased after they are cut out."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def compact(text: Column) -> Column:
    """Text without blanks, underscores, dots, slashes and hyphens."""
    return F.regexp_replace(text, r"[\s_./-]+", "")


def clipped(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))


def point_id(name: Column) -> Column:
    """The version-5 UUID of a name in the public URL namespace, from its SHA-1 digest."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def overlap_ratio(a: Column, b: Column) -> Column:
    """Common elements over the size of the smaller list; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)
