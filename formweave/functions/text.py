"""Text functions as Column expressions: cleaning, keys, labels, titles and page pointers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The patterns that decide what counts as an item number, a title or a pointer.
ITEM_NUMBER = r"(?i)^\s*(\d+[.)]|\(\d+\)|[a-z][.)]|[ivxl]+[.)]|[-•*])\s+"
NEW_ITEM = r"(?i)^\s*(\d+[.)]|[a-z][.)]|[-•*])\s+"
TERMINATED = r"[:?]\s*$"
LIST_CONTINUES = r"[;,]\s*$"
LEADING = r"^[\s\-–•*]+"
TRAILING = r"[\s:?*]+$"
TITLE_PREFIX = r"(?i)^\s*(?:form|crf|module|page)\s*[:\-–]\s*(.+)$"
CONTINUED = r"(?i)[\s\(\[\-–]*\b(continued|cont(?:'?d)?\.?)\b\s*[\)\]]?\s*$"
SEE_PAGE = r"(?i)\bsee\s+(?:page|pg\.?)\s*(\d+)"
DOMAIN_HEADER = r"^([A-Z]{2})\s*=\s*([A-Za-z][A-Za-z0-9 /,&'\-]*)$"

_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@F.pandas_udf(T.StringType())
def _nfkc(s):
    import pandas as pd

    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in s])


def clean(text: Column, fold: bool = True) -> Column:
    """Unicode compatibility fold, white space collapsed, ends stripped; null gives "".

    The fold has no built-in form: only texts with a character beyond ASCII go to the Arrow
    function (others are sent as null).  ``fold=False`` keeps the expression inside the JVM for
    text that is known to be folded.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    if fold:
        text = F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def normalize(text: Column, fold: bool = True) -> Column:
    """``clean``, lower case, punctuation to blanks, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean(text, fold)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def field_key(form: Column, text: Column, fold: bool = True) -> Column:
    """The storable key ``form|text`` of normalised halves."""
    return F.concat_ws("|", normalize(form, fold), normalize(text, fold))


def join_lines(lines: Column) -> Column:
    """One string from an array of lines; a trailing hyphen glues a split word."""
    trimmed = F.transform(lines, lambda x: F.trim(x))
    return F.aggregate(trimmed, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.endswith("-"), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x)))


def item_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), ITEM_NUMBER, 1)


def label(text: Column) -> Column:
    """The label without its item number, leading bullets and trailing colon, mark or star."""
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), ITEM_NUMBER, "")
    return F.trim(F.regexp_replace(F.regexp_replace(rest, LEADING, ""), TRAILING, ""))


def clean_title(text: Column) -> Column:
    """A printed title without its prefix ("Form:") and its continuation mark."""
    text = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), TITLE_PREFIX, "$1")
    text = F.regexp_replace(F.regexp_replace(text, CONTINUED, ""), r"^[ \-–:()\[\]]+|[ \-–:()\[\]]+$", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def see_pages(text: Column) -> Column:
    """All page numbers that "see page N" names, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SEE_PAGE), 1), lambda x: x.try_cast("int"))
