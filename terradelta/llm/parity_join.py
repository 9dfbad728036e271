"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct 5-word shingles (lower-cased A-Z; fewer words: the whole sequence is one shingle).
Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. Sets of a and b shingles with a Jaccard similarity of t or more differ in at most (1 - t) / (1 + t) * (a + b)
shingles, and their sizes differ by a factor of t at most.

The join. Sizes are cut into bands; documents of a band, and those of the band below that are large enough, share a sketch
of m parts. Two documents that differ in d bits agree in m - d parts or more (pigeonhole), so they meet in a join on part
contents. The sketch is sparse (2^64 positions); a part is kept as the XOR of its flipped positions' hashes.

* Empty parts say nothing and are left out: with z of them a document still has t = m - d - z agreeing parts. Where t < 1
  (small sets), the document also takes part in a sketch with another seed; in the last one empty parts are kept.
* A pair agrees in t parts or more, so each document may leave out its t - 1 most frequent parts (by one global order)
  and still meets every partner in the rarest common one. That takes shared passages and other hot parts out.
* In what is left, every member of a bucket is verified against its smallest member; components of verified links follow.
  Buckets that still hold several components are compared in blocks of ``BLOCK_DOCS`` members: members of different
  components whose sizes fit and whose dense sketches are near enough are verified as well. So no link is lost, and the
  pairs of a group of copies are not all made.

Equal sets are one node (their smallest id): signatures are made once per set and task, and copies are joined to their
node at the end.

Defined cases: null and empty texts have no shingle and are their own component; rows that repeat an id count as one
document; a null id takes the component of equal texts with an id, else null; whole texts count, however long; an empty
table gives no row. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradelta.llm.common import U, components, joined, mix64, stored, text_blocks, word_hashes, word_spans

N = 5
JACCARD = 80  # per cent
BAND_RATIO = 1.75
SEEDS = 4
BLOCK_DOCS = 256
BROADCAST_IDS = 2_000_000  # ids of documents to fetch (16 bytes each); more are joined by shuffle

_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_STEP = U(0x9E3779B97F4A7C15)


def _salt(i: int) -> np.uint64:
    return U(i * int(_STEP) % (1 << 64))


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    buf, at = joined(texts)
    buf = _SMALL[buf]
    starts, ends = word_spans(buf)
    h = word_hashes(buf, starts, ends)
    doc = np.searchsorted(at, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)))
    key = np.zeros(max(0, len(h) - n + 1), dtype=U)
    for j in range(n):
        key = key * _STEP + h[j : j + len(key)]
    key = mix64(key)
    out = []
    for i, c in enumerate(counts.tolist()):
        lo = int(first[i])
        if c >= n:
            out.append(np.unique(key[lo : lo + c - n + 1]))
        elif c:
            whole = U(c)
            with np.errstate(over="ignore"):
                for w in h[lo : lo + c]:
                    whole = whole * _STEP + w
            out.append(mix64(np.array([whole], dtype=U)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out


@cache
def bands() -> list[tuple[int, int, int]]:
    """(smallest, largest, parts) of every size band. Sets under four shingles link with equal sets only."""
    out, lo = [], 4
    while lo < 1 << 34:
        hi = max(lo + 1, int(lo * BAND_RATIO))
        out.append((lo, hi, -(-hi // 4) + isqrt(hi) // 2 + 2))
        lo = hi + 1
    return out


def bands_of(size: int) -> list[int]:
    """The size's own band, and the next one if a set of it can link with this one."""
    all_bands = bands()
    k = next((i for i, (lo, hi, _) in enumerate(all_bands) if lo <= size <= hi), None)
    if k is None:
        return []
    return [k, k + 1] if 100 * size >= JACCARD * all_bands[k + 1][0] else [k]


def most_different(size: int, band: int) -> int:
    """Largest symmetric difference with a linked set that meets this one in ``band``."""
    partner = min(100 * size // JACCARD, bands()[band][1])
    return (100 - JACCARD) * (size + partner) // (100 + JACCARD)


def signatures(keys: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Part signatures of a set; for every sketch it takes part in its code and how many frequent parts it may leave out.

    The low 8 bits of a signature are the sketch's code (band * SEEDS + seed).
    """
    sigs, codes, spare = [], [], []
    for band in bands_of(len(keys)):
        m, d = bands()[band][2], most_different(len(keys), band)
        for seed in range(SEEDS):
            code = band * SEEDS + seed
            h = keys if seed == 0 else mix64(keys + _salt(seed))
            part = ((h >> U(32)) * U(m)) >> U(32)
            content = mix64(h ^ U(0x5851F42D4C957F2D))
            if seed:
                order = np.argsort(part, kind="stable")
                part, content = part[order], content[order]
            cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            t = len(cut) - d  # parts that hold something, less those that may differ
            ids, xor = part[cut], np.bitwise_xor.reduceat(content, cut)
            if t < 1 and seed == SEEDS - 1:
                empty = np.setdiff1d(np.arange(m, dtype=U), ids)
                ids, xor, t = np.concatenate((ids, empty)), np.concatenate((xor, np.zeros(len(empty), dtype=U))), m - d
            sig = mix64(xor ^ mix64(ids + _salt(code + 1)))
            sigs.append((sig & ~U(255)) | U(code))
            codes.append(code)
            spare.append(max(0, t - 1))
            if t >= 1:
                break
    return (np.concatenate(sigs) if sigs else np.zeros(0, dtype=U)).astype(np.int64), codes, spare


def dense_sketch(keys: np.ndarray) -> bytes:
    """A bit sketch with a width that depends on the band of the size; see :func:`hamming`."""
    k = bands_of(len(keys))
    width = 64 << (4 * bands()[k[0]][1] // 64).bit_length() if k else 64
    bits = np.bincount((keys >> U(11)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """A sketch of fewer bits: positions that share their low bits are XORed, as if hashed into it at once."""
    while sketch.shape[-1] > width:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(v) for v in values])))
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(flat, type=kind))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (a digest of the set, null if empty), codes and spare (see :func:`signatures`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                sets = shingle_sets(texts)
                parts = [signatures(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array([len(s) for s in sets], type=pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                     pa.array([c for _, c, _ in parts], type=pa.list_(pa.int32())), pa.array([s for _, _, s in parts], type=pa.list_(pa.int32()))],
                    names=["doc_id", "n", "key", "codes", "spare"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, codes array<int>, spare array<int>")


def signature_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sig: signatures of every set, made once per task (further copies in a task add nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                rows, sigs = [], []
                for i, s in enumerate(shingle_sets(texts)):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key not in seen and b.column(0)[first + i].is_valid:
                        seen.add(key)
                        rows.append(first + i)
                        sigs.append(signatures(s)[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, type=pa.int64())), _lists(sigs, pa.int64())], names=["doc_id", "sigs"])

    return docs.mapInArrow(run, "doc_id long, sigs array<long>").select("doc_id", F.explode("sigs").alias("sig"))


def fetched_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, n, keys, sketch of the documents in ``ids`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array([len(s) for s in sets], type=pa.int64()), _lists([s.astype(np.int64) for s in sets], pa.int64()),
                     pa.array([dense_sketch(s) for s in sets], type=pa.binary())], names=["node", "n", "keys", "sketch"])

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs["doc_id"] == ids["node"], "left_semi").mapInArrow(run, "node long, n long, keys array<long>, sketch binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("keys").alias("ka"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("keys").alias("kb"))
    sizes_fit = (100 * F.least("na", "nb") >= JACCARD * F.greatest("na", "nb"))
    both = pairs.join(two, "b").join(one, "a").where(sizes_fit).withColumn("same", F.size(F.array_intersect("ka", "kb")))
    return both.where(100 * F.col("same") >= JACCARD * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b").distinct()


def near_pairs(cells: DataFrame) -> DataFrame:
    """Pairs worth verifying inside cells (cell, side, node, component, n, sketch), one cell being a run of sorted rows.

    A cell compares two blocks of a bucket (or one with itself) and holds at most a few hundred rows.
    """

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        out = []
        left = [r for r in rows if r[1] == 0]
        right = [r for r in rows if r[1] == 1] or left
        width = min(len(r[5]) for r in rows)
        table = np.stack([fold(np.frombuffer(r[5], dtype=np.uint8), width) for r in right])
        node, comp, size = (np.array([r[i] for r in right], dtype=np.int64) for i in (2, 3, 4))
        for r in left:
            differ = np.bitwise_count(table ^ fold(np.frombuffer(r[5], dtype=np.uint8), width)).sum(axis=1)
            fit = (differ * (100 + JACCARD) <= (100 - JACCARD) * (size + r[4])) & (100 * np.minimum(size, r[4]) >= JACCARD * np.maximum(size, r[4])) & (comp != r[3])
            out += [(min(r[2], int(x)), max(r[2], int(x))) for x in node[fit]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*sorted(pairs)) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != row[0]:
                    found.update(compare(held))
                    held = []
                held.append(row)
            yield emit(found)
        if held:
            yield emit(set(compare(held)))

    return cells.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes that suffice for the components, and the components of the nodes with one.

    ``classes``: doc_id, node, codes, spare of every document with a set and an id.
    """
    shared = W.partitionBy("sig")
    rows = stored(signature_rows(docs).withColumn("c", F.count("*").over(shared)).where("c > 1").drop("c"), "parity-shared")
    spare = classes.select("doc_id", "node", F.explode(F.arrays_zip("codes", "spare")).alias("s")).select("doc_id", "node", F.col("s.codes").alias("code"), F.col("s.spare").alias("spare"))
    rows = rows.withColumn("code", F.col("sig").bitwiseAND(255).cast("int")).join(spare.distinct(), ["doc_id", "code"])
    rows = rows.groupBy("sig", "node", "code").agg(F.min("spare").alias("spare")).withColumn("c", F.count("*").over(shared)).where("c > 1")
    frequent = W.partitionBy("node", "code").orderBy(F.desc("c"), F.desc("sig"))
    kept = rows.withColumn("at", F.row_number().over(frequent)).where(F.col("at") > F.col("spare")).select("sig", "node")
    kept = kept.withColumns({"hub": F.min("node").over(shared), "c": F.count("*").over(shared)}).where("c > 1")
    kept = stored(kept, "parity-kept")
    sets = stored(fetched_sets(docs, kept.select("node").distinct()), "parity-sets")
    stars = kept.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = stored(verified(stars, sets), "parity-links")
    labels = components(edges, "parity-components")
    # buckets that still hold several components, in blocks
    marked = kept.where("c > 2").join(labels.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi and members > 2").select("sig", "members")
    open_rows = stored(marked.drop("c", "hub").join(mixed, "sig"), "parity-open")
    if not open_rows.isEmpty():
        blocks = F.ceil(F.col("members") / BLOCK_DOCS).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        cells = open_rows.join(sets.select("node", "n", "sketch"), "node").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        cells = cells.select(F.concat_ws(":", "sig", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"),
                             "node", "component", "n", "sketch")
        more = verified(near_pairs(cells.repartition("cell").sortWithinPartitions("cell", "side", "node")), sets)
        edges = stored(edges.union(more).distinct(), "parity-all-links")
        labels = components(edges, "parity-all-components")
    return edges, labels


def one_per_component(docs: DataFrame) -> DataFrame:
    """The documents without those linked, over any number of links, to one with a smaller id; all columns as they are.

    Of rows that repeat a kept id all stay. Ids of dropped documents are what is joined against the texts.
    """
    found = jaccard_components(docs)
    gone = stored(found.where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "parity-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select(docs["doc_id"].cast("long"), "text")
    rows = stored(profiles(docs), "parity-profiles")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("node"))
    classes = stored(rows.where("doc_id is not null").join(nodes, "key").select("doc_id", "node", "codes", "spare"), "parity-classes")
    _, labels = links(docs, classes)
    own = nodes.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return rows.join(own, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
