"""Column builders for strings. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.strip() and str.split() see it, for trimming and for patterns.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WS = r"[\s\x1c-\x1f]"

_DIGITS = r"\d+(?:_\d+)*"
# What float() accepts, after stripping.
_FLOAT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space; Spark's ``trim`` removes spaces only."""
    return F.btrim(_col(c), F.lit(_SPACES))


def is_blank(c: Column | str) -> Column:
    return _col(c).isNull() | (strip(c) == "")


def safe_double(c: Column | str) -> Column:
    """Parse as ``float()`` would; null where it would raise.

    Plain casts differ both ways: ``5d`` would be read as 5.0 and ``1_0`` as null.
    """
    text = strip(c)
    return F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def iri_encode(c: Column | str, keep_slash: bool = False) -> Column:
    """Percent-encode everything but letters, digits and ``_.-~``."""
    encoded = F.url_encode(_col(c))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    if keep_slash:
        encoded = F.replace(encoded, F.lit("%2F"), F.lit("/"))
    return encoded


def escape_literal(c: Column | str) -> Column:
    """Escape a string for a quoted N-Triples literal."""
    escaped = _col(c)
    for found, wanted in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(found), F.lit(wanted))
    return escaped


def file_stem(c: Column | str) -> Column:
    """File name without directories and without its last extension."""
    name = F.regexp_extract(_col(c), r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def token_sort(c: Column | str) -> Column:
    """White-space separated tokens in sorted order, joined by one space."""
    return F.array_join(F.array_sort(F.split(strip(c), rf"(?U){_WS}+")), " ")
