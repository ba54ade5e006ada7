r"""Scalar text functions as column expressions.

White space is the Unicode class plus U+001C to U+001F, as in Python's \s and strip(); Java's \s is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
# Curly quotes and the dashes U+2010 to U+2014, with their ASCII forms.
CURLY, PLAIN = "‘’“”‐‑‒–—", "''\"\"-----"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column | str) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def normalized(c: Column | str) -> Column:
    """Plain quotes and dashes, runs of white space as one space, ends stripped; case is kept."""
    return F.trim(collapse(F.translate(c, CURLY, PLAIN)))


def preview(c: Column | str, n: int = 60) -> Column:
    return F.substring(c, 1, n)


def sentences(c: Column | str) -> Column:
    """Array of sentences: cut at white space after . ! or ? and before A to Z; stripped, none empty."""
    parts = F.split(c, rf"(?U)(?<=[.!?]){SPACE}+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def chars_per_page(text: Column | str, pages: Column | str) -> Column:
    """Characters between the ends' white space, per page; null without pages."""
    pages = F.col(pages) if isinstance(pages, str) else pages
    return F.when(pages > 0, F.length(strip(text)) / pages)
