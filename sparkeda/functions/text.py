"""Text and URL column functions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Only entity unescaping and URL joining need Python; both are Arrow-batched
``pandas_udf`` helpers over the standard library.
"""

from __future__ import annotations

import html as _html
from urllib.parse import urljoin as _urljoin

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

__all__ = ["WS_CLASS", "strip_tags", "unescape_entities", "strip_html", "squeeze_spaces",
           "drop_special_chars", "lower_trim", "strip_ws", "iso_dates", "text_length", "word_count",
           "truncate", "to_numeric", "valid_url", "fixed_url", "url_scheme", "url_netloc", "origin",
           "url_join", "non_empty"]

# The characters Python's str.isspace() treats as whitespace,
# written as a regex class body that Java and RE2 read alike.
WS_CLASS = (r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# Characters kept by drop_special_chars besides letters (accented ones too), digits,
# underscore and whitespace.
KEEP_PUNCT = r".,;:!?¿¡\-()@#$%&/=+'\""

# Fixed value: a tag.
TAG_PATTERN = r"<[^>]+>"
# day/month/year patterns, slash form first, rewritten to year-month-day.
DATE_PATTERNS = [r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", r"([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_tags(col) -> Column:
    """Remove every ``<...>`` tag (the SQL-expressible half of T1)."""
    return F.regexp_replace(_c(col), TAG_PATTERN, "")


@F.pandas_udf(T.StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    """HTML entity unescape (named and numeric), Arrow-batched."""
    return s.map(lambda v: _html.unescape(v) if isinstance(v, str) and "&" in v else v)


def strip_html(col) -> Column:
    """Drop tags, then unescape entities."""
    return unescape_entities(strip_tags(col))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def squeeze_spaces(col) -> Column:
    """Every whitespace run becomes one space, then trim."""
    return F.trim(F.regexp_replace(_c(col), f"[{WS_CLASS}]+", " "))


def drop_special_chars(col) -> Column:
    """Keep letters, digits, underscore, whitespace and basic punctuation.

    Letters/digits are Unicode classes (``\\p{L}``, ``\\p{N}``) so accented
    letters survive; Java's plain ``\\w`` is ASCII-only."""
    return F.regexp_replace(_c(col), f"[^\\p{{L}}\\p{{N}}_{WS_CLASS}{KEEP_PUNCT}]", "")


def lower_trim(col) -> Column:
    """T4: lower-case and strip."""
    return strip_ws(F.lower(_c(col)))


def iso_dates(col) -> Column:
    """T5: ``d/m/yyyy`` then ``d-m-yyyy`` rewritten as ``yyyy-m-d`` (no padding)."""
    out = _c(col)
    for p in DATE_PATTERNS:
        out = F.regexp_replace(out, p, "$3-$2-$1")
    return out


def text_length(col) -> Column:
    """Length in characters."""
    return F.length(_c(col))


def word_count(col) -> Column:
    """Number of whitespace-separated words (``len(s.split())``)."""
    return F.regexp_count(_c(col), F.lit(f"[^{WS_CLASS}]+"))


def truncate(col, n: int = 200, suffix: str = "...") -> Column:
    """First ``n`` characters plus ``suffix`` when longer than ``n``."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def to_numeric(col) -> Column:
    """Number or NULL (``try_cast``; plain cast raises under ANSI)."""
    return _c(col).try_cast("double")


# The two URL shapes accepted (validator form with optional port,
# helper form without).
URL_PATTERN = (r"^https?://(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)*[a-zA-Z]{2,}"
               r"(?::[0-9]{1,5})?(?:/[^" + WS_CLASS + r"]*)?$")
URL_PATTERN_NO_PORT = (r"^https?://(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)*[a-zA-Z]{2,}"
                       r"(?:/[^" + WS_CLASS + r"]*)?$")


def fixed_url(col) -> Column:
    """``https://`` prepended when the scheme is missing (empty stays empty)."""
    c = _c(col)
    return (F.when(c.isNull() | (c == ""), c)
            .when(c.startswith("http://") | c.startswith("https://"), c)
            .otherwise(F.concat(F.lit("https://"), c)))


def valid_url(col, allow_port: bool = True) -> Column:
    """Does the (fixed) URL have a valid shape?  Empty -> false."""
    c = _c(col)
    pat = URL_PATTERN if allow_port else URL_PATTERN_NO_PORT
    return F.when(c.isNull() | (c == ""), F.lit(False)).otherwise(F.coalesce(fixed_url(c).rlike(pat), F.lit(False)))


SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def url_scheme(col) -> Column:
    return F.lower(F.regexp_extract(_c(col), SCHEME_RE, 1))


def url_netloc(col) -> Column:
    return F.regexp_extract(_c(col), NETLOC_RE, 1)


def origin(col) -> Column:
    """``scheme://netloc`` as ``urlparse`` splits it."""
    return F.concat(url_scheme(col), F.lit("://"), url_netloc(col))


def _joined(base, ref):
    """The absolute URL, or None where the reference is none (``http://[bad``)."""
    try:
        return None if ref is None else _urljoin(base or "", ref)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _urljoin_udf(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([_joined(b, r) for b, r in zip(base, ref)], dtype=object)


def url_join(base, ref) -> Column:
    """Absolute URL of ``ref`` against ``base`` (RFC 3986 via ``urllib``), Arrow-batched; null for a
    reference that cannot be read."""
    return _urljoin_udf(_c(base), _c(ref))


def non_empty(col) -> Column:
    c = _c(col)
    return c.isNotNull() & (F.length(c) > 0)
