"""Text rules for titles, quotes, places and pages."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terradelta import constants as K

# White space as Unicode defines it, for engines whose \s is ASCII only.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# The same, one by one, but for the blank.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_WORD = r"[^\p{L}\p{N}_]+"
MARKUP = "[*_`#>\"\u201c\u201d\u2018\u2019']"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it, also in a lambda over an array.

    A column made a layer below is put back into a lambda by the optimiser and then computed for every element; a bound variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and the single letters they decompose to."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            src.append(chr(code))
            dst.append(plain)
    return "".join(src), "".join(dst)


def plain(s: Column) -> Column:
    """Without accents: precomposed Latin letters and separate combining marks."""
    src, dst = _accent_table()
    return F.regexp_replace(F.translate(s, src, dst), r"[\u0300-\u036f]", "")


def hazard_of(title: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for hazard, words in K.HAZARD_WORDS.items():
        out = out.when(title.rlike(f"(?i){words}"), F.lit(hazard))
    return out


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), NOT_WORD, " "))


def norm_text(s: Column) -> Column:
    """Without markup and quotes, white space as single blanks, lower case: one pass for the characters, one for runs of blanks."""
    return F.lower(F.trim(F.regexp_replace(F.translate(s, SPACES + MARKUP[1:-1], " " * len(SPACES)), " {2,}", " ")))


def is_speculative(s: Column) -> Column:
    return s.rlike(f"(?i){K.SPECULATIVE}")


def iso_date(s: Column) -> Column:
    """Strict ISO date from the first ten characters; NULL when it is none."""
    head = F.substring(F.trim(s), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


# --- Fixed values: how a page becomes text -------------------------------------------------------------
DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<img\b[^>]*>|<nav\b.*?</nav>|<head\b.*?</head>"
BREAKS = r"(?i)<br\s*/?>|</p>|</h[1-6]>|</li>|</div>|</tr>"
TAGS = r"(?s)<[^>]+>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# ---------------------------------------------------------------------------------------------------------


def _readable(html: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(html, BREAKS, "\n\n"), TAGS, "")
    for entity, char in ENTITIES:
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(s, r"[ \t]*\n", "\n"), r"\n{3,}", "\n\n")


def _element(html: Column, tag: str) -> Column:
    return F.concat_ws("\n\n", F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)))


def page_text(html: Column) -> Column:
    """Story text of a page: its <article>, else its <main> (each only when longer than 500), else everything.

    Scripts, styles, comments, images and menus go; links keep their words; blank lines collapse.
    """
    def long_enough(element: Column, otherwise: Column) -> Column:
        return once(element, lambda t: F.when(F.length(t) > K.MIN_SELECTED_CHARS, t).otherwise(otherwise))

    def pick(clean: Column) -> Column:
        main = long_enough(_readable(_element(clean, "main")), _readable(clean))
        return F.regexp_replace(long_enough(_readable(_element(clean, "article")), main), r"^[\s]+|[\s]+$", "")

    return once(F.regexp_replace(html, DROPPED, ""), pick)
