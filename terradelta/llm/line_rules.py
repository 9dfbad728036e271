"""Line-first cleaning: every line is judged on its own, failing lines go, and a document that loses too much is rejected.

A line is a \\n-separated piece with a word. It fails if one of these holds:

* navigation: two or more separators of ``|`` and the arrows and bullets of menus, or nothing but menu words
* punctuation: more than a tenth of its characters are symbols, or more than a tenth of its words end in a run of ! or ?
* shouting: more than six tenths of its ASCII letters are capitals, of at least eight
* boilerplate: it holds a phrase of page furniture
* repetition: it equals an earlier line of the document

The document is rejected if its failing lines hold more than ``max_lost`` of its word characters, or by the base rules
(too few words; too many words inside repeated 8-word windows).

Defined cases: null and empty texts have no words, fail the base rule and are rejected; whole texts are judged, however
long; equal texts get equal values; only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.common import U, joined, mix64, text_blocks, word_hashes, word_spans

MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
WINDOW = 8
MAX_LOST = 0.5

# Symbols counted, menu separators, menu words and phrases of page furniture.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
MENU = ("home", "menu", "about", "about us", "contact", "contact us", "login", "log in", "sign in", "sign up", "register", "search",
        "next", "previous", "back", "back to top", "read more", "share", "sitemap", "faq", "help", "skip to content", "subscribe")
FURNITURE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript",
             "lorem ipsum", "click here", "use of cookies", "uses cookies", "page not found")

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, n_failed_lines long, lost_chars long")

_MENU = frozenset(MENU)
_FURNITURE = re.compile("|".join(map(re.escape, FURNITURE)))
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_BANG = re.compile(r"[!?]{2,}[.,]?(?=[ \t\n\x0b\x0c\r]|$)")
_TRIM = " \t\n\x0b\x0c\r"
_WORDS = re.compile("[^ \t\n\x0b\x0c\r]+")
_CAPITALS, _SMALL = re.compile("[A-Z]"), re.compile("[a-z]")
_SYMBOLS = re.compile("[" + re.escape(SYMBOLS) + "]")
_SEPARATORS = re.compile("[" + re.escape(SEPARATORS) + "]")


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, its words inside ``window``-word windows that occur twice or more in it."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(n_docs, dtype=np.int64)
    key = np.zeros(n, dtype=U)
    for j in range(window):
        key = key * U(0x9E3779B97F4A7C15) + h[j : j + n]
    inside = doc[:n] == doc[window - 1 :]
    key = mix64(key ^ mix64(doc[:n].astype(U) + U(1)))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    cover[order[twice]] += 1
    cover[order[twice] + window] -= 1
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n_docs)


def line_fails(line: str) -> bool:
    """The rules that need nothing but the line (which holds a word)."""
    low = line.lower()
    if len(_SEPARATORS.findall(line)) >= 2 or low.strip(_TRIM + ".") in _MENU:
        return True
    n_words = len(_WORDS.findall(line))
    if 10 * len(_SYMBOLS.findall(line)) > len(line) or 10 * len(_BANG.findall(line)) > n_words:
        return True
    up = len(_CAPITALS.findall(line))
    if up >= 8 and 10 * up > 6 * (up + len(_SMALL.findall(line))):
        return True
    return _FURNITURE.search(low) is not None


def judge_lines(text: str) -> tuple[list[str], list[bool], int]:
    """Lines of a text, whether each fails, and how many repeat an earlier line. Lines without a word never fail."""
    lines, seen, failed, dup = text.split("\n"), set(), [], 0
    for line in lines:
        if not line.strip(_TRIM):
            failed.append(False)
            continue
        if again := line in seen:
            dup += 1
        seen.add(line)
        failed.append(again or line_fails(line))
    return lines, failed, dup


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _TRIM))


def measures(texts: list[bytes], max_lost: float = MAX_LOST) -> list[np.ndarray]:
    buf, at = joined(texts)
    starts, ends = word_spans(buf)
    doc = np.searchsorted(at, starts, side="right") - 1
    n = len(texts)
    n_words = np.bincount(doc, minlength=n)
    repeat = repeated_words(word_hashes(buf, starts, ends), doc, n)
    symbols = np.add.reduceat(_SYMBOL[buf], at[:-1])
    rows = []
    for t in texts:
        text = t.decode()
        lines, failed, dup = judge_lines(text)
        lost = sum(word_chars(x) for x, bad in zip(lines, failed) if bad)
        rows.append((word_chars(text), dup, sum(1 for x in lines if x.strip(_TRIM)), sum(failed), lost))
    chars, dup, n_lines, n_failed, lost = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    base = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEATED * n_words)
    kept = ~base & (lost <= max_lost * chars)
    return [n_words, chars, symbols, dup, repeat, base, kept, n_lines, n_failed, lost]


def line_quality(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """One row of counts and verdicts per document (see SCHEMA)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), *map(pa.array, measures(texts, max_lost))], names=names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


def cleaned_documents(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their failing lines removed; ``n_chars`` follows the text, other columns stay."""
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(text_at)):
                kept = measures(texts, max_lost)[6]
                part = b.slice(first, len(texts)).filter(pa.array(kept))
                out = []
                for t, keep in zip(texts, kept):
                    if keep:
                        lines, failed, _ = judge_lines(t.decode())
                        out.append("\n".join(x for x, bad in zip(lines, failed) if not bad))
                cols = list(part.columns)
                cols[text_at] = pa.array(out, type=part.schema.field(text_at).type)
                cols[chars_at] = pa.array([len(x) for x in out], type=part.schema.field(chars_at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, schema)


def oracle() -> str:
    """The measures in the check engine's SQL."""
    words = r"'[^\x20\x09-\x0D]+'"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cnt = lambda text, pattern: f"len(regexp_extract_all({text}, {pattern}))"
    sep = "[|»›•·]"
    sym = r"[#*$%&|<>]"
    menu = ", ".join(q(m) for m in MENU)
    furn = "|".join(FURNITURE)
    dots = r"'^[\x20\x09-\x0D.]+|[\x20\x09-\x0D.]+$'"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, {words})) AS w, generate_subscripts(regexp_extract_all(t, {words}), 1) AS i FROM d),
g AS (SELECT r, i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o, lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS g, lead(w, 7) OVER o IS NOT NULL AS whole
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, unnest(list(i)) AS i FROM g WHERE whole GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) x(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
m AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again, lower(line) AS low, length(line) AS n, {cnt('line', words)} AS words,
    list_sum(list_transform(regexp_extract_all(line, {words}), lambda x: length(x))) AS chars, {cnt('line', "'[A-Z]'")} AS up, {cnt('line', "'[a-z]'")} AS small
  FROM l WHERE regexp_matches(line, {words})),
f AS (SELECT *, again OR {cnt('line', q(sep))} >= 2 OR regexp_replace(low, {dots}, '', 'g') IN ({menu}) OR 10 * {cnt('line', q(sym))} > n
    OR 10 * {cnt('line', r"'[!?]{2,}[.,]?([\x20\x09-\x0D]|$)'")} > words OR (up >= 8 AND 10 * up > 6 * (up + small)) OR regexp_matches(low, {q(furn)}) AS bad FROM m),
s AS (SELECT r, sum(chars) AS chars, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, coalesce(sum(chars) FILTER (bad), 0) AS lost, count(*) FILTER (again) AS dup, sum(words) AS words FROM f GROUP BY r),
a AS (SELECT doc_id, coalesce(s.words, 0) AS n_words, coalesce(s.chars, 0) AS word_chars, {cnt('t', q(sym))} AS n_symbols, coalesce(s.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_chars FROM d LEFT JOIN s USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 2 * lost_chars <= word_chars AS kept, n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars FROM b"""
