"""Shared helpers: texts of Arrow batches as byte blocks, vectorised word hashes, ranks and connected components.

A word is a run of bytes other than space and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
Texts travel as UTF-8 bytes; a null text is the empty text.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from terradelta.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
U = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared folder and read back: lineage is cut and a lost executor loses nothing."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows holding about ``size`` bytes; a longer text is a block of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > size:
            yield first, _bytes(column.slice(first, i - first))
            first, held = i, 0
        held += n + 1
    if first < len(column):
        yield first, _bytes(column.slice(first))
    _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker serves one stage after the other and would keep the peak of each."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bytes(column: pa.Array) -> list[bytes]:
    """Only the rows of one block become Python objects at a time."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line end after every text, and the n+1 offsets of the texts in it."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return buf, np.concatenate(([0], ends))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer that ends in white space."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    return edge[::2], edge[1::2]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=U)
    out[0], done, step = 1, 1, base
    while done < n:  # doubling: out[k + i] = base^k * out[i]
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U(step)
        done, step = done + take, step * step % (1 << 64)
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    held = _POWERS.get(kind)
    if held is None or len(held) < n:
        base = {"up": _MUL, "down": _INV}[kind]
        held = _powers(base, max(n, BLOCK_BYTES + 64))
        if n <= 4 * BLOCK_BYTES:  # longer texts make their own and let it go
            _POWERS[kind] = held
    return held


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: differences of one running polynomial sum, shifted to position 0 and mixed."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    n = len(buf)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum((buf.astype(U) + U(1)) * powers("up", n)[:n], out=total[1:])
    h = (total[ends] - total[starts]) * powers("down", n)[starts]
    return mix64(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def prefix_ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its 0-based ``rank`` in ``order``: range-sorted, stored, and offset by the sizes of earlier parts.

    Only one row per part (not per row of ``df``) meets in the final prefix sum.
    """
    sort = [F.col(c) for c in order]
    local = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    local = stored(local, name).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return local.join(before, "_part").withColumn("rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: long); nodes without an edge are absent.

    Alternating large and small stars: per node only a minimum is aggregated and joined back, so that a node with any
    number of neighbours is pre-aggregated and its rows can be split. Rounds grow with the logarithm of a component's
    size; every round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, f"{name}-edges")
    for i in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = low.select("u", F.col("m").alias("v")).union(hung).where("u <> v").distinct()
        new = stored(new, f"{name}-round")
        # a star forest: every node has one parent, and no parent has a parent
        chained = new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi")
        if new.groupBy("u").count().where("count > 1").isEmpty() and chained.isEmpty():
            roots = new.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return stored(new.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), name)
        e = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
