"""Alignment of two tokenizers' tokens over the same texts, with corpus-wide counts of linked token pairs.

Both tokenizers encode a space and the text; tokens are laid over its UTF-8 bytes. Where tokens of both end together the
text is cut into groups, and an A token is linked with every B token whose bytes it shares. The count of a pair (A id,
B id) is the number of documents that hold it linked.

Counting is external, by spilled runs:

* a task collects (pair, document, links) records up to ``RUN_RECORDS``, sorts them by pair and document, deals them by
  A id into ``BUCKETS`` radix buckets and writes each bucket as a zstd run; a run's head (pair, number of documents)
  is compressed apart from its postings (documents, links). The facts of the run's documents stand in the same file.
* per bucket the heads are merged with a k-way heap, at most ``FAN`` at a time, in as many rounds as that takes. Every
  document lies in one run, so the heads' sums are the pairs' counts. Pairs come in A-major order, hence all pairs of an
  A id follow each other and its highest count is known when the next one begins.
* the counts are streamed back over the postings, run by run, as one sum per document, bucket and run, and added up with
  the facts of the run's documents.

Both tokenizers part before a single space between two other characters and between a letter and a mark, so chunks of texts are encoded and aligned
once per worker (in a table of bounded size) and a text's groups are those of its chunks.

Only paths and offsets of runs go through Spark's rows; a task holds a few runs' blocks, or the counts of one bucket as a
memory map. Runs take their names from the task and are renamed when whole, so retried tasks do no harm.

Defined cases: null or empty texts, and texts whose joined token bytes differ from a space and the text (a piece file may
normalise), have no tokens; null and repeated ids and repeated rows are rows of their own and count as documents of their
own; texts are encoded whole; an empty table gives no row. Only id and text are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
import struct
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta.llm.common import stored, table_path, text_blocks
from terradelta.llm.files import Writer, _at
from terradelta.llm.token_bits import _byte_letters, _within

BUCKETS = 32
RUN_RECORDS = 3 << 20
FAN = 256  # heads merged at a time
MOST_TASKS = 20_000
HEAD_BLOCK = 4096  # entries of a head decoded at a time
CACHE_CHUNKS, CACHE_PAIRS = 200_000, 4_000_000  # bounds of a worker's chunk table; it only saves repeated work
CHUNK = re.compile(r"(?<=\S)(?= \S)|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])")
HEAD = np.dtype([("pair", "<i8"), ("n", "<i8")])
TOTAL = np.dtype([("pair", "<i8"), ("n", "<i8"), ("best", "<i8")])
FACTS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())])
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Aligner:
    """Chunks of texts aligned once: groups as text, token numbers and linked pairs."""

    def __init__(self, encode_a: Callable, bytes_a: list[bytes], encode_b: Callable, bytes_b: list[bytes]):
        self.encode_a, self.bytes_a, self.encode_b, self.bytes_b = encode_a, bytes_a, encode_b, bytes_b
        self.size_a, self.size_b = np.array([len(x) for x in bytes_a]), np.array([len(x) for x in bytes_b])
        self.clear()

    @classmethod
    def load(cls, byte_file: str, piece_file: str) -> Aligner:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores out
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_file)
        a.encode_special_tokens = True
        letter = {c: b for b, c in _byte_letters().items()}
        names = sorted(a.get_vocab().items(), key=itemgetter(1))
        bytes_a = [b""] * (names[-1][1] + 1)
        for name, i in names:
            bytes_a[i] = bytes([letter[c] for c in name]) if all(c in letter for c in name) else name.encode()
        sp = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p or CHUNK.search(p) for p in pieces):
            raise ValueError("a piece continues across a cut, chunks cannot be encoded apart")
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

        space, tokenize = "".join(c for c, b in letter.items() if b == 32), a.model.tokenize

        def encode_a(chunks: list[str]) -> list[list[int]]:
            """A space and ASCII letters are one word to a byte-level cutting rule; those skip it."""
            plain = [c[0] == " " and c.isascii() and c[1:].isalpha() for c in chunks]
            rest = iter(a.encode_batch_fast([c for c, p in zip(chunks, plain) if not p], add_special_tokens=False))
            return [[t.id for t in tokenize(space + c[1:])] if p else next(rest).ids for c, p in zip(chunks, plain)]

        lead = len(sp.encode("\n"))

        def encode_b(chunks: list[str]) -> list[list[int]]:
            """The piece file adds the space itself; chunks without one stand behind a line end, which no piece holds."""
            got = sp.encode([c[1:] if c[0] == " " else "\n" + c for c in chunks], num_threads=1)
            return [ids if c[0] == " " else ids[lead:] for c, ids in zip(chunks, got)]

        return cls(encode_a, bytes_a, encode_b, bytes_b)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 4), dtype=np.int64)  # tokens of A, of B, groups, links; all -1 if bytes differ
        self.pairs, self.hits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def trim(self) -> None:
        """Forget the chunks met less than twice since the last time; all if that is not half of them."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > CACHE_CHUNKS:
            return self.clear()
        links = np.maximum(self.facts[:, 3], 0)
        first, n, names = np.cumsum(links) - links, links[keep], list(self.at)
        self.pairs = self.pairs[np.repeat(first[keep], n) + _within(n)]
        self.facts, self.hits = self.facts[keep], np.zeros(len(keep), dtype=np.int64)
        self.groups = [self.groups[i] for i in keep.tolist()]
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}

    def align(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups as text, facts and linked pairs of chunks one after the other, from token ends over all their bytes."""
        n_a, n_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
        a, b = np.array(list(itertools.chain.from_iterable(a)), dtype=np.int64), np.array(list(itertools.chain.from_iterable(b)), dtype=np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        size = np.array([len(c.encode()) for c in chunks], dtype=np.int64)
        done = np.cumsum(size)
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        end = np.intersect1d(end_a, end_b, assume_unique=True)
        # pairs: from the first B token that ends behind an A token's start to the last that starts before its end
        lo, hi = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a)
        k = hi - lo
        pairs = np.repeat(a, k) << 32 | b[np.repeat(lo, k) + _within(k)]
        links = np.bincount(np.repeat(np.repeat(np.arange(len(chunks)), n_a), k), minlength=len(chunks))
        groups = np.diff(np.searchsorted(end, done, side="right"), prepend=0)
        # each group's A tokens, then its B tokens, with the mark that follows each
        group_a, group_b = np.searchsorted(end, end_a), np.searchsorted(end, end_b)
        last_a, last_b = end[group_a] == end_a, end[group_b] == end_b
        closing = np.isin(end_b, done)
        shape = np.concatenate((last_a.astype(np.int64), 2 + last_b + closing))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        ids, shape = np.concatenate((a, b))[order].tolist(), shape[order].tolist()
        text = "".join([f"{i}{',|,;#'[x]}" for i, x in zip(ids, shape)])
        return text.split("#")[:-1], np.stack((n_a, n_b, groups, links), axis=1), pairs

    def learn(self, chunks: list[str]) -> None:
        a, b = self.encode_a(chunks), self.encode_b(chunks)
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        good = [i for i, c in enumerate(chunks) if b"".join(map(bytes_a, a[i])) == (raw := c.encode()) and b"".join(map(bytes_b, b[i])) == raw]
        texts, facts = [""] * len(chunks), np.full((len(chunks), 4), -1, dtype=np.int64)
        if good:
            got, facts[good], pairs = self.align([chunks[i] for i in good], [a[i] for i in good], [b[i] for i in good])
            for i, t in zip(good, got):
                texts[i] = t
            self.pairs = np.concatenate((self.pairs, pairs))
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks))))
        self.groups += texts
        self.facts = np.concatenate((self.facts, facts))
        self.hits = np.concatenate((self.hits, np.zeros(len(chunks), dtype=np.int64)))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Facts (rows x 4) and groups of every text; pair, text number and links of the records of this block."""
        if len(self.at) > CACHE_CHUNKS or len(self.pairs) > CACHE_PAIRS:
            self.trim()
        cut = [_chunks(t) for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        if new := set(flat).difference(self.at):
            self.learn(list(new))
        idx = np.fromiter(map(self.at.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.hits += np.bincount(idx, minlength=len(self.hits))
        n = np.array([len(c) for c in cut], dtype=np.int64)
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(texts)), n)
        broken = np.zeros(len(texts), dtype=bool)
        broken[row[self.facts[idx, 0] < 0]] = True
        before = np.concatenate((np.zeros((1, 4), dtype=np.int64), np.cumsum(self.facts[idx], axis=0)))
        facts = before[ends] - before[ends - n]
        facts[broken] = 0
        names = self.groups.__getitem__
        each = idx.tolist()
        groups = ["" if x else ";".join(map(names, each[e - k : e])) for x, k, e in zip(broken.tolist(), n.tolist(), ends.tolist())]
        # each chunk of a text once, with the number of its occurrences
        key, times = np.unique((row << 32 | idx)[~broken[row]], return_counts=True)
        row, idx = key >> 32, key & 0xFFFFFFFF
        links = np.maximum(self.facts[:, 3], 0)
        first = np.cumsum(links) - links
        k = links[idx]
        return facts, groups, self.pairs[np.repeat(first[idx], k) + _within(k)], np.repeat(row, k), np.repeat(times, k)


def _chunks(text: bytes) -> list[str]:
    """The text after a space, parted before each single space between two other characters and each mark after a letter."""
    return CHUNK.split(" " + text.decode()) if text else []


def summed(pair: np.ndarray, row: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records in order of pair and row, equal ones added up."""
    names, rank = np.unique(pair, return_inverse=True)
    key = rank << 32 | row
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    return names[key[first] >> 32], key[first] & 0xFFFFFFFF, np.add.reduceat(links[order], first) if len(first) else links[:0]


class RunWriter:
    """The records of a task's documents up to RUN_RECORDS, then one file: a head and postings per bucket, then the facts."""

    def __init__(self, folder: str, part: int):
        self.folder, self.part, self.number = folder, part, 0
        self.reset()

    def reset(self) -> None:
        self.records, self.held, self.rows = [], 0, 0
        self.facts: list[pa.RecordBatch] = []

    def add(self, ids: pa.Array, facts: np.ndarray, groups: list[str], pair: np.ndarray, row: np.ndarray, links: np.ndarray) -> None:
        self.records.append((pair, row + self.rows, links))
        self.held += len(pair)
        self.rows += len(ids)
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        self.facts.append(pa.RecordBatch.from_arrays([ids, *[pa.array(c) for c in facts.T], pa.array(digests, pa.string())], schema=FACTS))

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        pair, row, links = summed(*[np.concatenate(x) for x in zip(*self.records)])
        path = f"{self.folder}/run-{self.part:06d}-{self.number:05d}"
        out, zip_, where = Writer(path), zstandard.ZstdCompressor(level=3), []
        bucket = (pair >> 32) % BUCKETS
        for k in range(BUCKETS):
            mine = bucket == k
            p, r, x = pair[mine], row[mine], links[mine]
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, dtype=np.int64)
            head = np.empty(len(first), dtype=HEAD)
            head["pair"], head["n"] = p[first], np.diff(np.append(first, len(p)))
            step = r.copy()  # rows as steps within a pair
            step[1:] -= np.where(p[1:] == p[:-1], r[:-1], 0)
            at = out.size
            out.write(zip_.compress(head.tobytes()))
            mid = out.size
            out.write(zip_.compress(step.astype("<i4").tobytes() + x.astype("<i4").tobytes()))
            where.append((at, mid, out.size))
        at = out.size
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, FACTS) as w:
            for b in self.facts:
                w.write_batch(b)
        out.write(zip_.compress(sink.getvalue().to_pybytes()))
        out.write(struct.pack("<q", at))
        out.close()
        n = len(where)
        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([self.part] * n, pa.int32()), pa.array([self.number] * n), pa.array(range(n), pa.int32()), *[pa.array(c) for c in zip(*where)]],
                                         names=["path", "part", "number", "bucket", "head", "postings", "done"])
        self.number += 1
        self.reset()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(byte_file: str, piece_file: str) -> Aligner:
    if (byte_file, piece_file) not in _ALIGNERS:
        _ALIGNERS[byte_file, piece_file] = Aligner.load(byte_file, piece_file)
    return _ALIGNERS[byte_file, piece_file]


def write_runs(docs: DataFrame, byte_file: str, piece_file: str, folder: str) -> DataFrame:
    """path, part, number, bucket and the places of head and postings of every bucket of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, out = aligner(byte_file, piece_file), RunWriter(folder, TaskContext.get().partitionId())
        for b in batches:
            for first, texts in text_blocks(b.column(1)):
                out.add(b.column(0).slice(first, len(texts)), *align.texts(texts))
                if out.held >= RUN_RECORDS:
                    yield from out.close()
        yield from out.close()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "path string, part int, number long, bucket int, head long, postings long, done long"), "align-runs")


def _section(path: str, lo: int, hi: int) -> bytes:
    store, name = _at(path)
    with store.open_input_file(name) as f:
        return f.read_at(hi - lo, lo)


def head_blocks(path: str, lo: int, hi: int) -> Iterator[list[tuple[int, int]]]:
    """(pair, documents) of a head in order, a block at a time."""
    reader = zstandard.ZstdDecompressor().stream_reader(_section(path, lo, hi))
    while data := reader.read(HEAD_BLOCK * HEAD.itemsize):
        while len(data) % HEAD.itemsize:
            data += reader.read(HEAD.itemsize - len(data) % HEAD.itemsize)
        yield np.frombuffer(data, dtype=HEAD).tolist()


def merged(heads: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """(pair, documents) over all heads, in order of A id and B id, each pair once."""
    streams = [itertools.chain.from_iterable(head_blocks(*h)) for h in heads]
    for pair, same in itertools.groupby(heapq.merge(*streams), key=itemgetter(0)):
        yield pair, sum(n for _, n in same)


def _blocks(rows: Iterator, dtype: np.dtype, size: int = 1 << 16) -> Iterator[np.ndarray]:
    while block := list(itertools.islice(rows, size)):
        yield np.array(block, dtype=dtype)


def merge_heads(runs: DataFrame, folder: str) -> DataFrame:
    """bucket, path of the bucket's counts: fixed records (pair, documents, highest of its A id), in pair order."""
    # few small rows stand for much work: the numbers of tasks are given, else they would be put together
    heads = runs.select("bucket", F.struct("path", F.col("head").alias("lo"), F.col("postings").alias("hi")).alias("head"), (F.hash("part", "number") % 1_000_003).alias("group"))
    level, most = 0, runs.select("path").distinct().count()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, group, parts in zip(*[b.column(i).to_pylist() for i in range(3)]):
                path = f"{folder}/merge-{level}-{bucket}-{group}"
                out, zip_ = Writer(path), zstandard.ZstdCompressor(level=3).compressobj()
                for block in _blocks(merged([(p["path"], p["lo"], p["hi"]) for p in parts]), HEAD):
                    out.write(zip_.compress(block.tobytes()))
                out.write(zip_.flush())
                size = out.close()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([group], pa.int32()), pa.array([path]), pa.array([size])], names=["bucket", "group", "path", "size"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = Writer(path := f"{folder}/counts-{bucket}")
                rows = merged([(p["path"], p["lo"], p["hi"]) for p in parts])
                for _, side in itertools.groupby(rows, key=lambda r: r[0] >> 32):
                    side = np.array(list(side), dtype=HEAD)  # the pairs of one A id, at most B's vocabulary
                    block = np.empty(len(side), dtype=TOTAL)
                    block["pair"], block["n"], block["best"] = side["pair"], side["n"], side["n"] == side["n"].max()
                    out.write(block.tobytes())
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([path])], names=["bucket", "counts"])

    while most > FAN:  # groups of about FAN / 2 heads, so that hashing keeps them below FAN by far
        most = -(-most * 2 // FAN)
        heads = heads.withColumn("group", F.pmod("group", F.lit(most)).cast("int")).repartition(min(MOST_TASKS, BUCKETS * most), "bucket", "group")
        groups = heads.groupBy("bucket", "group").agg(F.collect_list("head").alias("heads"))
        done = stored(groups.mapInArrow(partial, "bucket int, group int, path string, size long"), "align-merge")
        heads = done.select("bucket", F.struct("path", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")).alias("head"), (F.hash("group") % 1_000_003).alias("group"))
        level += 1
    return stored(heads.repartition(BUCKETS, "bucket").groupBy("bucket").agg(F.collect_list("head").alias("heads")).mapInArrow(total, "bucket int, counts string"), "align-counts")


def align(docs: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Per document: tokens of both, groups and links, the sum of its links' counts, the links that are their A id's most
    frequent, and the digest of its groups."""
    folder = table_path(docs.sparkSession, "alignment")
    runs = write_runs(docs, byte_file, piece_file, folder)
    counts = merge_heads(runs, folder)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, head, postings, done, counted in zip(*[b.column(i).to_pylist() for i in range(5)]):
                unzip, data = zstandard.ZstdDecompressor(), _section(path, head, done)
                heads = np.frombuffer(unzip.decompress(data[: postings - head]), dtype=HEAD)
                flat = np.frombuffer(unzip.decompress(data[postings - head :]), dtype="<i4").reshape(2, -1).astype(np.int64)
                if not len(heads):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([b""])], names=["path", "sums"])
                    continue
                totals = _map(counted)
                found = totals[np.searchsorted(totals["pair"], heads["pair"])]
                last = np.cumsum(heads["n"])
                steps = np.cumsum(flat[0])
                row = steps - np.repeat(np.concatenate(([0], steps[last[:-1] - 1])), heads["n"])
                sums = np.zeros((row.max() + 1, 2), dtype="<i8")
                np.add.at(sums[:, 0], row, flat[1] * np.repeat(found["n"], heads["n"]))
                np.add.at(sums[:, 1], row, flat[1] * np.repeat(found["best"], heads["n"]))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([zstandard.compress(sums.tobytes(), 3)])], names=["path", "sums"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, unzip = b.column(0)[i].as_py(), zstandard.ZstdDecompressor()
                facts = pa.ipc.open_stream(unzip.decompress(_facts(path))).read_all().combine_chunks()
                sums = np.zeros((len(facts), 2), dtype=np.int64)
                for blob in b.column(1)[i].as_py():
                    if blob:
                        x = np.frombuffer(unzip.decompress(blob), dtype="<i8").reshape(-1, 2)
                        sums[: len(x)] += x
                cols = [facts.column(j) for j in range(5)] + [pa.array(sums[:, 1]), pa.array(sums[:, 0]), facts.column(5)]
                yield from pa.Table.from_arrays(cols, names=[c.split(" ")[0] for c in SCHEMA.split(", ")]).to_batches(max_chunksize=10_000)

    # a third of the records may lie in one bucket: its runs are dealt over tasks by themselves
    work = runs.join(counts, "bucket").select("path", "head", "postings", "done", "counts", "bucket")
    n = runs.select("path").distinct().count()
    work = work.repartition(max(1, min(MOST_TASKS, n * BUCKETS // 8)), "path", "bucket").select("path", "head", "postings", "done", "counts")
    sums = work.mapInArrow(back, "path string, sums binary")
    per_run = sums.repartition(max(1, min(MOST_TASKS, n)), "path").groupBy("path").agg(F.collect_list("sums").alias("sums"))  # one list of BUCKETS blobs a run
    return per_run.mapInArrow(finish, SCHEMA)


def _map(path: str) -> np.ndarray:
    store, name = _at(path)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read_buffer(f.size()), dtype=TOTAL)


def _facts(path: str) -> bytes:
    store, name = _at(path)
    with store.open_input_file(name) as f:
        size = f.size()
        at = struct.unpack("<q", f.read_at(8, size - 8))[0]
        return f.read_at(size - 8 - at, at)
