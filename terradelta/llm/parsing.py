"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed level by level into phrases of two or three symbols, whose names are the next level's symbols:

* equal neighbours become one symbol, named by the symbol and the length of its run, so neighbours differ;
* deterministic coin tossing: a symbol's label is the lowest bit in which it differs from the symbol before it (twice the
  bit's place, plus the bit). Neighbours keep different labels, and a few rounds leave labels 0 to 5; the labels 3, 4 and 5
  are then replaced by the smallest of 0, 1, 2 that neither neighbour has;
* a phrase begins at every label higher than both neighbours, and at every lower one that is not next to such a one.

Where a phrase begins depends on a few symbols around it only, and a name is a 64-bit hash of the phrase's symbols, so that
equal substrings have equal phrases in their interiors on every level, wherever they stand. Nothing is learnt from other
documents: names need no table, and a fingerprint is final as soon as its text is read.

A fingerprint holds the ``SIZE`` smallest 32-bit hashes of a text's phrase names (as hex), of phrases from the level on
whose usual length suits the text (``LEVELS``). Two fingerprints' likeness is the share of phrases two texts have in common
(2 |A and B| / (|A| + |B|)), estimated from the smallest hashes of both together.

Defined cases: a null text is the empty text; the empty text has the empty fingerprint, like itself (1) and unlike any
other (0); equal texts have equal fingerprints; texts of any length are parsed whole; a single document follows itself;
null ids come last in descending order; rows of equal ids follow each other in the order of a hash of their texts, and
repeated rows are rows of their own; an empty table gives no row. Only id and text are read, other columns may have any
name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.common import U, mix64, text_blocks
from terradelta.llm.token_bits import NO_ID

SIZE = 64
LEVELS = ((1024, 4), (192, 3), (48, 2), (0, 1))  # from so many bytes on, phrases of this level and above are sampled
PART_BYTES = 24 << 20  # of text in a range of ids
MOST_PARTS = 20_000  # the bounds of ranges are held by every task
PER_PART = 32  # sampled keys a range is cut by
BLOCK = 1 << 19
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_LOW = np.array([8] + [(x & -x).bit_length() - 1 for x in range(1, 256)], dtype=np.uint8)
_AT = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(8)], dtype=U)  # a symbol's place in its phrase


def labels(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 2 of symbols that differ from their neighbours, by coin tossing; ``first`` marks the texts' starts."""
    differ = np.empty_like(sym)
    differ[1:] = sym[1:] ^ sym[:-1]
    differ[first] = 1
    if sym.dtype == np.uint8:
        low = _LOW[differ]
    else:
        low = ((differ & (~differ + U(1))).astype(np.float64).view(np.int64) >> 52).astype(np.uint8) - np.uint8(255)  # the exponent less 1023
    out = 2 * low + ((sym >> low.astype(sym.dtype)) & sym.dtype.type(1)).astype(np.uint8)
    for _ in range(2 if sym.dtype == np.uint8 else 3):  # below 16 or 128, 8 or 14, 6 or 8, 6; as often for every text
        differ = np.empty_like(out)
        differ[1:] = out[1:] ^ out[:-1]
        differ[first] = 1
        low = _LOW[differ]
        out = 2 * low + ((out >> low) & np.uint8(1))
    last = np.append(first[1:], True)
    for v in (3, 4, 5):
        at = np.flatnonzero(out == v)
        left, right = np.where(first[at], 9, out[at - 1]), np.where(last[at], 9, out[np.minimum(at + 1, len(out) - 1)])
        out[at] = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
    return out


def phrase_starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    last = np.append(first[1:], True)
    left, right = np.empty(len(label), dtype=np.int8), np.empty(len(label), dtype=np.int8)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[first], right[last] = -1, -1
    high = (label > left) & (label > right)
    low = (label < left) & (label < right) & ~first & ~last
    low[1:] &= ~high[:-1]
    low[:-1] &= ~high[1:]
    return high | low | first


def levels(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, phrase names, their texts' numbers), until every text is one phrase."""
    sym = np.frombuffer(b"".join(texts), dtype=np.uint8)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    level = 0
    while len(sym):
        level += 1
        new = np.empty(len(sym), dtype=bool)
        new[0] = True
        new[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(new)
        length = np.diff(np.append(run, len(sym))).astype(U)
        sym, doc = sym[run], doc[run]
        first = np.ones(len(sym), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        start = np.flatnonzero(phrase_starts(labels(sym, first), first))
        inside = np.arange(len(sym)) - np.repeat(start, np.diff(np.append(start, len(sym))))
        named = mix64(sym.astype(U) * _AT[7] + length) * _AT[inside]
        sym, doc = mix64(np.add.reduceat(named, start) + U(level)), doc[start]
        yield level, sym, doc
        more = np.zeros(len(sym), dtype=bool)  # texts of one phrase are done
        more[1:] |= doc[1:] == doc[:-1]
        more[:-1] |= doc[1:] == doc[:-1]
        sym, doc = sym[more], doc[more]


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The smallest hashes of each text's phrase names, in order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    lowest = np.ones(len(texts), dtype=np.int64)
    for size, level in reversed(LEVELS):
        lowest[sizes >= size] = level
    keys, top = [np.zeros(0, dtype=np.int64)], np.zeros(len(texts), dtype=np.int64)
    for level, sym, doc in levels(texts):
        top[doc] = sym.view(np.int64) >> 32  # the last name, for texts that are one phrase below their level
        use = lowest[doc] <= level
        keys.append(doc[use] << 32 | (sym[use] >> U(32)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    doc = key >> 32
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, (lo, hi) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
        alone = [top[i] & 0xFFFFFFFF] if hi == lo and sizes[i] else []
        out.append((key[lo : min(hi, lo + SIZE)] & 0xFFFFFFFF) if not alone else np.array(alone, dtype=np.int64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of phrases that two texts have in common."""
    a, b = set(a.tolist()), set(b.tolist())
    both = sorted(a | b)[: max(SIZE, 1)]
    if not both:
        return 1.0
    jaccard = sum(x in a and x in b for x in both) / len(both)
    return 2 * jaccard / (1 + jaccard)


def spelled(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.int64)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(1), BLOCK):
                got = [spelled(f) for f in fingerprints(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(got, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def in_ranges(docs: DataFrame) -> DataFrame:
    """part, tail, doc_id, text: the documents in ranges of descending (id, hash of the text), each sorted, and after it
    (``tail`` 1) once more the document that follows: the first of the next range, or the very first after the last.

    Ranges are cut at a sample of the keys whose size is bounded by the number of ranges; it decides only where a task
    ends, and a cut's own document is the first of its range. Texts are shuffled once.
    """
    key_id = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    rows = docs.select(key_id.alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    n, size, top = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.max(F.struct("id", "tie"))).first()
    parts = max(1, min(MOST_PARTS, -(-int(size or 0) // PART_BYTES)))
    share = min(1.0, parts * PER_PART / max(n, 1))
    if parts > 1:
        drawn = F.pmod(F.xxhash64("id", "tie", F.lit("range")), F.lit(1_000_003)) < share * 1_000_003
        sample = sorted((r[0], r[1]) for r in rows.where(drawn).select("id", "tie").collect())
        cuts = sorted({sample[i * len(sample) // parts] for i in range(1, parts)} if sample else set())
    else:
        cuts = []
    bounds = [c for c in cuts if c < tuple(top)] + [tuple(top)] if n else []  # ascending, the last one is the first range's

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, part, tail = [], [], []
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                k = bisect_left(bounds, key)
                own = len(bounds) - 1 - k
                at.append(i), part.append(own), tail.append(0)
                if bounds[k] == key:
                    at.append(i), part.append((own or len(bounds)) - 1), tail.append(1)
            rows = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tail, pa.int32()), *rows.columns], names=["part", "tail", "id", "tie", "text"])

    dealt = rows.mapInArrow(deal, "part int, tail int, id long, tie long, text string").repartitionById(max(1, len(bounds)), "part")
    dealt = dealt.sortWithinPartitions("part", "tail", F.desc("id"), F.desc("tie"))
    return dealt.select("part", "tail", F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the text that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to it and to the next document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the one that follows
        for b in batches:
            parts, tails, ids = (b.column(i).to_pylist() for i in range(3))
            for first, texts in text_blocks(b.column(3), BLOCK):
                rows = [(parts[first + i], tails[first + i], ids[first + i], t.decode()) for i, t in enumerate(texts)]
                rows = ([held] if held else []) + rows
                held = rows[-1]
                pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
                if pairs:
                    yield described(rows, pairs)

    rows = in_ranges(docs).mapInArrow(run, SCHEMA)
    return rows


def described(rows: list[tuple[int, int, int | None, str]], pairs: list[int]) -> pa.RecordBatch:
    edited = [edited_text(rows[i][3], rows[i + 1][3]).encode() for i in pairs]
    prints = fingerprints([r[3].encode() for r in rows] + edited)
    own, other = prints[: len(rows)], prints[len(rows) :]
    columns = [
        pa.array([rows[i][2] for i in pairs], pa.int64()),
        pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array([spelled(own[i]) for i in pairs]),
        pa.array([spelled(f) for f in other]),
        pa.array([likeness(own[i], f) for i, f in zip(pairs, other)]),
        pa.array([likeness(own[i], own[i + 1]) for i in pairs]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in SCHEMA.split(", ")])
