"""Token ids in fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary (16 for 49,408 ids). 64 ids fill exactly ``bits`` 64-bit words, so
packing and unpacking are ``64`` shifts over whole columns of words. Ids are cut into blocks of ``BLOCK`` ids, each
starting on a word; a file ends with its index: ids and lengths of its documents and the offset of every block.

    file  = "TDBITS01" | block 0 | block 1 | ... | doc_ids int64[d] | lengths int64[d] | offsets int64[b + 1] | footer
    footer = int64[5]: bits, ids, documents, blocks, offset of the index

Files follow each other in ascending id order: documents are range-partitioned by id, sorted within a partition, and a
partition is one file. Only one row per file meets in the sum that gives the files' starts.

Defined cases: a null text is the empty text and yields the end id alone; null ids come first; repeated ids are kept, in
the order of a hash of their texts; texts are encoded whole; an empty table writes no file and gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terradelta.llm.common import stored, table_path, text_blocks
from terradelta.llm.files import Writer, read_file

MAGIC = b"TDBITS01"
BLOCK = 1 << 16
NO_ID = int(np.iinfo(np.int64).min)  # stands for a null id in a file
CACHE_PIECES = 250_000  # bound of a worker's piece table; it only saves repeated encoding


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, low bits first, padded to a multiple of 64 ids."""
    rows = -(-len(ids) // 64)
    flat = np.zeros(rows * 64, dtype=np.uint64)
    flat[: len(ids)] = ids
    table = flat.reshape(rows, 64)
    out = np.zeros((rows, bits), dtype=np.uint64)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        out[:, word] |= table[:, j] << np.uint64(off)
        if off + bits > 64:
            out[:, word + 1] |= table[:, j] >> np.uint64(64 - off)
    return out.tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    rows = -(-n // 64)
    words = np.frombuffer(data, dtype="<u8", count=rows * bits).reshape(rows, bits)
    out = np.empty((rows, 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        v = words[:, word] >> np.uint64(off)
        if off + bits > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - off))
        out[:, j] = v & mask
    return out.reshape(-1)[:n]


class BitWriter:
    def __init__(self, uri: str, bits: int):
        self.out, self.bits = Writer(uri), bits
        self.out.write(MAGIC)
        self.docs, self.lengths, self.offsets = [], [], []
        self.held, self.n_held, self.n_ids = [], 0, 0

    def add(self, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.lengths.append(lengths)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(ids[at : at + BLOCK])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.out.size)
        self.out.write(pack(ids, self.bits))
        self.n_ids += len(ids)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        self.offsets.append(self.out.size)
        at = self.out.size
        docs = np.concatenate(self.docs).astype("<i8")
        self.out.write(docs.tobytes())
        self.out.write(np.concatenate(self.lengths).astype("<i8").tobytes())
        self.out.write(np.array(self.offsets, dtype="<i8").tobytes())
        self.out.write(np.array([self.bits, self.n_ids, len(docs), len(self.offsets) - 1, at], dtype="<i8").tobytes())
        self.out.close()
        return len(docs), self.n_ids


class BitFile:
    """Reads such a file: any range of ids, any document, without unpacking the rest."""

    def __init__(self, uri: str):
        self.data = memoryview(read_file(uri))
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError(f"{uri} is not a bit-packed id file")
        self.bits, self.n_ids, d, b, at = np.frombuffer(self.data[-40:], dtype="<i8").tolist()
        self.doc_ids = np.frombuffer(self.data, dtype="<i8", count=d, offset=at)
        self.lengths = np.frombuffer(self.data, dtype="<i8", count=d, offset=at + 8 * d)
        self.offsets = np.frombuffer(self.data, dtype="<i8", count=b + 1, offset=at + 16 * d)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))

    def ids(self, lo: int, hi: int) -> np.ndarray:
        first = lo // BLOCK
        parts = [unpack(self.data[self.offsets[b] : self.offsets[b + 1]], min(BLOCK, self.n_ids - b * BLOCK), self.bits)
                 for b in range(first, -(-hi // BLOCK))]
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32))[lo - first * BLOCK : hi - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


# Characters on which the tokenizer's normaliser only lowers case: printable ASCII, white space and Latin-1 letters. In such
# text its own cutting rule (contractions, letters, single digits, other marks) is the expression below.
_ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|")
_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts, piece by piece: this tokenizer drops white space and never joins across its cuts, so the ids of a
    text are those of its pieces. A piece that was seen is not encoded again. Words with other characters than those whose
    normal form is known here are encoded as they are; a text that spells a special token is encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.lengths, self.starts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.hits = np.zeros(0, dtype=np.int64)

    def trim(self) -> None:
        """Forget the pieces met less than twice since the last time; all if that is not half of them."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > CACHE_PIECES:
            return self.clear()
        names, n = list(self.at), self.lengths[keep]
        self.at = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.flat = self.flat[np.repeat(self.starts[keep], n) + _within(n)]
        self.lengths, self.starts, self.hits = n, np.cumsum(n) - n, np.zeros(len(keep), dtype=np.int64)

    def cuts(self, text: str) -> list[str]:
        """Pieces of a text; what must be encoded as it is comes marked with a leading space."""
        if not _ODD.search(text):
            return _CUTS.findall(text.lower())
        if "<|" in text:
            return [" " + text]
        out = []
        for w in text.encode().split():  # at the white space that is no part of a word in any reading
            w = w.decode()
            out += [" " + w] if _ODD.search(w) else _CUTS.findall(w.lower())
        return out

    def _learn(self, new: list[str]) -> None:
        plain, odd = [x for x in new if x[0] != " "], [x for x in new if x[0] == " "]
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        got = [[t.id for t in tokenize(x if x.isascii() else "".join([letters[b] for b in x.encode()]))] for x in plain]
        got += [e.ids for e in self.tokenizer.encode_batch([x[1:] for x in odd], add_special_tokens=False)] if odd else []
        self.at.update(zip(plain + odd, range(len(self.at), len(self.at) + len(new))))
        self.lengths = np.concatenate((self.lengths, np.array([len(x) for x in got], dtype=np.int64)))
        self.flat = np.concatenate((self.flat, np.array([i for x in got for i in x], dtype=np.uint32)))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hits = np.concatenate((self.hits, np.zeros(len(new), dtype=np.int64)))

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the end id, and all ids."""
        if len(self.at) > CACHE_PIECES:
            self.trim()
        cuts = [self.cuts(t.decode()) for t in texts]
        flat = [x for xs in cuts for x in xs]
        if new := set(flat).difference(self.at):
            self._learn(list(new))
        idx = np.fromiter(map(self.at.__getitem__, flat), dtype=np.int64, count=len(flat))
        self.hits += np.bincount(idx, minlength=len(self.at))
        n, starts = self.lengths[idx], self.starts[idx]
        counts = np.array([len(xs) for xs in cuts], dtype=np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        lengths = total[bounds[1:]] - total[bounds[:-1]] + 1
        # ids go where their pieces stand, each document's end id after them
        doc = np.repeat(np.arange(len(texts)), counts)
        inner = _within(n)
        out = np.full(int(lengths.sum()), end, dtype=np.uint32)
        out[np.repeat(total[:-1] + doc, n) + inner] = self.flat[np.repeat(starts, n) + inner]
        return lengths, out


def _within(n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, tokenizer: str, end: int, folder: str, vocab_size: int) -> DataFrame:
    """Write the documents' ids below ``folder``; part, path, n_docs, n_ids of every file, in order."""
    bits = bits_for(vocab_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, enc = TaskContext.get().partitionId(), None, encoder(tokenizer)
        uri = f"{folder}/ids-{part:06d}.bits"
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for first, texts in text_blocks(b.column(1)):
                out = out or BitWriter(uri, bits)
                lengths, tokens = enc.encode(texts, end)
                out.add(ids[first : first + len(texts)], lengths, tokens)
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], type=pa.int32()), pa.array([uri]), pa.array([n_docs]), pa.array([n_ids])], names=["part", "path", "n_docs", "n_ids"])

    rows = docs.select(docs["doc_id"].cast("long"), "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    return stored(rows.mapInArrow(run, "part int, path string, n_docs long, n_ids long"), "bits-index")


def read_ids(index: DataFrame, window: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = index.select("path", (F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = BitFile(path)
                lo = 0
                while lo < len(f.doc_ids):  # documents of about ``window`` ids at a time
                    hi = max(lo + 1, int(np.searchsorted(f.starts, f.starts[lo] + window, side="right")) - 1)
                    at = f.starts[lo : hi + 1] - f.starts[lo]
                    ids = f.ids(int(f.starts[lo]), int(f.starts[hi])).astype("<u4")
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[lo:hi], mask=f.doc_ids[lo:hi] == NO_ID), pa.array(f.starts[lo:hi] + first), pa.array(f.lengths[lo:hi]), pa.array(crc, type=pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi

    n = max(1, index.count())
    return before.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_corpus(docs: DataFrame, tokenizer: str, end: int, vocab_size: int) -> DataFrame:
    """Write the ids of ``docs`` below the shared folder and report every document as read back."""
    return read_ids(write_ids(docs, tokenizer, end, table_path(docs.sparkSession, "token-ids"), vocab_size))
