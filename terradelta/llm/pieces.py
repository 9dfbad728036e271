"""N-best segmentation into SentencePiece pieces, and back.

The piece lattice of a text has an edge for every piece that matches at a position, with the piece's score, and one edge
for a character without a piece of its own (written as its bytes, with a score below all pieces). Forward Viterbi scores
give the best segmentation and are exact heuristics for a backward A* search, which pops the N best in order.

White space and line ends cut the lattice: no piece continues across the start of a run of spaces, so a lattice is a chain
of the lattices of its chunks (spaces and what follows them), and a path is one path per chunk. That is used twice: chunks
are solved once per worker (in blocks, by array operations over all their positions), and an N-best path of the text can
only leave the best path in one of the N - 1 chunks whose second-best path loses least. The A* search runs over those.

Piece files are read, never trained. Scores are taken as they are (in a BPE file they are merge ranks); pieces with a
score of -1e8 or less are placeholders and not used.

Defined cases: null and empty texts have no piece, a best score of 0 and nothing to choose; fewer than N paths give a
shorter list; equal scores keep the Viterbi path first; texts of any length are segmented whole. Only id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terradelta.llm.common import U, mix64, powers, text_blocks
from terradelta.llm.token_bits import _within

N_BEST = 4
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
CACHE_CHUNKS = 200_000  # bound of a worker's chunk table; it only saves repeated work
CACHE_SEARCHES = 20_000  # bound of its table of searched chunks
LONG_CHUNK = 400  # characters; longer chunks are solved one by one
BLOCK_CHUNKS = 4096
SCHEMA = "doc_id long, ids array<int>, nbest_scores array<double>, nbest_ids array<array<int>>, n_chars long, round_trip boolean"
DIGESTS = "doc_id long, n_pieces long, best_score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, n_chars long, round_trip boolean"


class PieceModel:
    """Pieces with scores, and their lattices."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], usable: list[bool]):
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, usable)) if ok}
        self.scores = np.array(scores, dtype=np.float64)
        self.byte_ids = byte_ids
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown = min((scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.text = [p.replace(SPACE, " ").encode() for p in pieces]
        for byte, i in byte_ids.items():
            self.text[i] = bytes([byte])
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece continues across a space")
        # line ends stand alone if no piece holds one; a letter and a mark that follow each other in no piece part there
        line_end = "" if any("\n" in p for p in self.ids) else "\n"
        joined = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        marks = "".join(re.escape(c) for c in "!\"#$%&'()*+,-./:;<=>?@[]^`{|}~" if c not in joined)
        word = f"[^ {line_end}]"
        self.cut = re.compile(f" *[^\\W\\d_]++(?=[ {marks}{line_end}]|\\Z)|{line_end + '|' if line_end else ''} +{word}*|{word}+")
        keys = sorted(self.ids, key=len)
        h = _hash(np.array([ord(c) for p in keys for c in p], dtype=np.int64), *_spans([len(p) for p in keys]))
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array([self.ids[p] for p in keys], dtype=np.int64)[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.keys & U((1 << 20) - 1)).astype(np.int64)] = True
        self.clear()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        pieces, scores = [sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) or scores[i] <= -1e8 for i in n]
        return cls(pieces, scores, {int(pieces[i][1:-1], 16): i for i in n if sp.is_byte(i)}, [not x for x in special])

    # -- one chunk

    def edges(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        """Per end position the edges into it: (start, score, id), -1 for a character without a piece."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(chunk) + 1)]
        for e in range(1, len(chunk) + 1):
            for s in range(max(0, e - self.longest), e):
                i = self.ids.get(chunk[s:e])
                if i is not None:
                    out[e].append((s, float(self.scores[i]), i))
            if not out[e] or out[e][-1][0] != e - 1:
                out[e].append((e - 1, self.unknown, -1))
        return out

    @staticmethod
    def forward(edges: list) -> tuple[list[float], list[tuple[int, float, int]]]:
        """Best score of every position and the edge by which it is reached (the shortest among equals)."""
        best, back = [0.0], [(0, 0.0, 0)]
        for into in edges[1:]:
            edge = max(into, key=lambda x: (best[x[0]] + x[1], x[0]))
            best.append(best[edge[0]] + edge[1])
            back.append(edge)
        return best, back

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a chunk in order: backward A* with forward Viterbi scores, the Viterbi path first."""
        text = chunk.replace(" ", SPACE)
        edges = self.edges(text)
        best, back = self.forward(edges)
        # among equals the one nearest to the start goes first, so that ties do not grow side by side
        agenda, made, found = [(-best[-1], len(text), 0, 0.0, None)], 0, []
        while agenda and len(found) < n:
            _, at, _, tail, path = heapq.heappop(agenda)
            if at == 0:
                ids = []
                while path is not None:
                    ids += self.spell(path[0], text[path[1]])
                    path = path[2]
                found.append((tail, tuple(ids)))
                continue
            for s, score, i in edges[at]:
                made += 1
                heapq.heappush(agenda, (-(best[s] + score + tail), s, made, score + tail, (i, s, path)))
        first, at = [], len(text)
        while at:
            s, _, i = back[at]
            first.append(self.spell(i, text[s]))
            at = s
        first = (best[-1], tuple(i for ids in reversed(first) for i in ids))
        return [first, *(x for x in found if x != first)][:n]

    def spell(self, piece: int, char: str) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.byte_ids.get(b, 0) for b in char.replace(SPACE, " ").encode()]

    # -- blocks of chunks

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chunks: list[str] = []
        self.flat, self.lengths = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.best, self.loss, self.starts = np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64)
        self.hits = np.zeros(0, dtype=np.int64)
        self.found: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def trim(self) -> None:
        """Forget the chunks met less than twice since the last time; all if that is not half of them."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > CACHE_CHUNKS:
            return self.clear()
        n = self.lengths[keep]
        self.chunks = [self.chunks[i] for i in keep.tolist()]
        self.at = {c: k for k, c in enumerate(self.chunks)}
        self.flat = self.flat[np.repeat(self.starts[keep], n) + _within(n)]
        self.best, self.loss, self.lengths, self.starts = self.best[keep], self.loss[keep], n, np.cumsum(n) - n
        self.hits, self.found = np.zeros(len(keep), dtype=np.int64), {}

    def learn(self, chunks: list[str]) -> None:
        """Best path and the loss of the second-best path of new chunks."""
        chunks = sorted(chunks, key=len, reverse=True)
        k = next((i for i, c in enumerate(chunks) if len(c) <= LONG_CHUNK), len(chunks))
        got = [self._long(c.replace(" ", SPACE)) for c in chunks[:k]]
        got += [self._block([c.replace(" ", SPACE) for c in chunks[lo : lo + BLOCK_CHUNKS]]) for lo in range(k, len(chunks), BLOCK_CHUNKS)]
        best, loss, lengths, flat = (np.concatenate(x) for x in zip(*got))
        self.at.update(zip(chunks, range(len(self.chunks), len(self.chunks) + len(chunks))))
        self.chunks += chunks
        self.best, self.loss = np.concatenate((self.best, best)), np.concatenate((self.loss, loss))
        self.lengths, self.flat = np.concatenate((self.lengths, lengths)), np.concatenate((self.flat, flat))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hits = np.concatenate((self.hits, np.zeros(len(chunks), dtype=np.int64)))

    def _long(self, text: str) -> tuple[np.ndarray, ...]:
        edges = self.edges(text)
        best, back = self.forward(edges)
        rest = [-np.inf] * len(text) + [0.0]
        for e in range(len(text), 0, -1):
            for s, score, _ in edges[e]:
                rest[s] = max(rest[s], score + rest[e])
        ids, at, on = [], len(text), {}
        while at:
            on[at] = back[at]
            ids.append(self.spell(back[at][2], text[back[at][0]]))
            at = back[at][0]
        off = [best[s] + score + rest[e] for e in range(1, len(text) + 1) for s, score, i in edges[e] if on.get(e) != (s, score, i)]
        flat = np.array([i for x in reversed(ids) for i in x], dtype=np.int64)
        return np.array([best[-1]]), np.array([best[-1] - max(off, default=-np.inf)]), np.array([len(flat)]), flat

    def _block(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Best scores, losses, piece counts and pieces, from forward and backward scores of all positions of a block, position
        by position; ``texts`` by falling length."""
        n = np.array([len(t) for t in texts], dtype=np.int64)
        base = np.cumsum(n + 1) - (n + 1)  # a chunk of n characters has n + 1 positions
        total, reach = int((n + 1).sum()), min(self.longest, int(n[0]))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        first = np.cumsum(n) - n
        pos = np.arange(len(chars)) - np.repeat(first, n)  # of each character in its chunk
        end_at = np.repeat(base, n) + pos + 1
        score = np.full((total, reach), -np.inf)
        piece = np.full((total, reach), -1, dtype=np.int64)
        sums = _sums(chars)
        for size in range(1, reach + 1):
            e = np.flatnonzero(pos >= size - 1)
            h = _span_hash(sums, e + 1 - size, e + 1, len(chars))
            ok = np.flatnonzero(self.maybe[(h & U((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[ok]), len(self.keys) - 1)
            hit = self.keys[at] == h[ok]
            rows = end_at[e[ok[hit]]]
            piece[rows, size - 1] = self.key_ids[at[hit]]
            score[rows, size - 1] = self.scores[self.key_ids[at[hit]]]
        alone = end_at[piece[end_at, 0] < 0]
        score[alone, 0] = self.unknown
        best, rest = np.zeros(total), np.full(total, -np.inf)
        arg = np.zeros(total, dtype=np.int64)
        steps = np.arange(1, reach + 1)
        live = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # chunks of at least 1, 2, ... characters
        for q in range(1, int(n[0]) + 1):
            e = base[: live[q - 1]] + q
            k = min(reach, q)
            value = best[e[:, None] - steps[:k]] + score[e, :k]
            arg[e] = value.argmax(axis=1)
            best[e] = value[np.arange(len(e)), arg[e]]
        tail = base + n
        rest[tail] = 0.0
        for q in range(int(n[0]) - 1, -1, -1):
            s = base[: live[q]] + q
            left = n[: live[q]] - q
            k = min(reach, int(left[0]))
            e = np.minimum(s[:, None] + steps[:k], (base + n)[: live[q], None])
            value = np.where(steps[:k] <= left[:, None], rest[e] + score[e, steps[:k] - 1], -np.inf)
            rest[s] = value.max(axis=1)
        through = np.full((total, reach), -np.inf)
        for k in range(1, reach + 1):
            rows = np.flatnonzero(np.isfinite(score[:, k - 1]))
            through[rows, k - 1] = best[rows - k] + score[rows, k - 1] + rest[rows]
        # walk the best paths back, all at once, and take their edges out
        path_rows, path_chunk, cur, left = [], [], tail.copy(), np.flatnonzero(n > 0)
        while len(left):
            rows = cur[left]
            through[rows, arg[rows]] = -np.inf
            path_rows.append(rows)
            path_chunk.append(left)
            cur[left] = rows - arg[rows] - 1
            left = left[cur[left] > base[left]]
        second = np.maximum.reduceat(through.max(axis=1), base)
        rows, chunk = np.concatenate(path_rows), np.concatenate(path_chunk)
        order = np.argsort(rows)
        rows, chunk = rows[order], chunk[order]
        ids = piece[rows, arg[rows]]
        sizes = np.bincount(chunk, minlength=len(texts))
        if (ids < 0).any():  # characters without a piece become their bytes
            spelt = [self.spell(p, texts[c][e - 1]) if p < 0 else [p] for p, c, e in zip(ids.tolist(), chunk.tolist(), (rows - base[chunk]).tolist())]
            sizes = np.bincount(chunk, weights=[len(x) for x in spelt], minlength=len(texts)).astype(np.int64)
            ids = np.array([i for x in spelt for i in x], dtype=np.int64)
        return best[tail], best[tail] - second, sizes, ids

    # -- texts

    def segment(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, list[float], list[np.ndarray], list[tuple[str, tuple]]]]:
        """Of every text (with a space put before it): best ids, the scores of the n best paths, their ids, and what other
        ids they have for which chunks."""
        for ids, scores, edits in self.edited(texts, n):
            paths = []
            for moved in edits:
                parts, at = [], 0
                for start, size, other, _ in moved:
                    parts += [ids[at:start], np.array(other, dtype=np.int64)]
                    at = start + size
                paths.append(np.concatenate([*parts, ids[at:]]) if parts else ids)
            yield ids, scores, paths, [(chunk, other) for moved in edits for _, _, other, chunk in moved]

    def edited(self, texts: list[str], n: int) -> Iterator[tuple[np.ndarray, list[float], list[list[tuple[int, int, tuple, str]]]]]:
        """Of every text: best ids, the scores of the n best paths, and each path as edits of the best ids (first place,
        number of ids that go, ids that come, their chunk), in order."""
        if len(self.at) > CACHE_CHUNKS:
            self.trim()
        if len(self.found) > CACHE_SEARCHES:
            self.found = {}
        cuts = [self.cut.findall(" " + t) if t else [] for t in texts]
        if new := {c for cs in cuts for c in cs}.difference(self.at):
            self.learn(list(new))
        starts, lengths, best, loss = self.starts, self.lengths, self.best, self.loss
        for cs in cuts:
            idx = np.fromiter(map(self.at.__getitem__, cs), dtype=np.int64, count=len(cs))
            np.add.at(self.hits, idx, 1)
            size = lengths[idx] if len(idx) else np.zeros(0, dtype=np.int64)
            ids = self.flat[np.repeat(starts[idx], size) + _within(size)] if len(idx) else np.zeros(0, dtype=np.int64)
            top = float(best[idx].sum()) if len(idx) else 0.0
            # only the n - 1 places whose second-best path loses least can leave the best path
            places = np.argsort(loss[idx], kind="stable")[: n - 1] if len(idx) else np.zeros(0, dtype=np.int64)
            options = []
            for i in idx[places].tolist():
                if i not in self.found:
                    self.found[i] = self.nbest(self.chunks[i], n)
                options.append(self.found[i])
            offsets = np.cumsum(size) - size
            scores, edits = [], []
            for total, pick in _combine(options, n):
                scores.append(top + total)
                moved = sorted((int(places[k]), options[k][j][1]) for k, j in enumerate(pick) if j)
                edits.append([(int(offsets[place]), int(size[place]), other, cs[place]) for place, other in moved])
            yield ids, scores, edits

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space put before it."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))[1:]

    def spells(self, chunk: str, ids: tuple[int, ...]) -> bool:
        return b"".join([self.text[i] for i in ids]) == chunk.encode()


def _combine(options: list[list[tuple[float, tuple]]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest losses over one choice per option list: (loss as a negative score, choices)."""
    start = (0,) * len(options)
    agenda, seen, out = [(0.0, start)], {start}, []
    while agenda and len(out) < n:
        loss, pick = heapq.heappop(agenda)
        out.append((-loss, pick))
        for k, j in enumerate(pick):
            if j + 1 < len(options[k]):
                more = (*pick[:k], j + 1, *pick[k + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(agenda, (loss + options[k][j][0] - options[k][j + 1][0], more))
    return out


def _spans(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths, dtype=np.int64)
    return ends - np.array(lengths, dtype=np.int64), ends


def _sums(chars: np.ndarray) -> np.ndarray:
    out = np.zeros(len(chars) + 1, dtype=U)
    np.cumsum((chars.astype(U) + U(1)) * powers("up", len(chars))[: len(chars)], out=out[1:])
    return out


def _span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * powers("down", n)[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _hash(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _span_hash(_sums(chars), starts, ends, len(chars))


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel.load(path)
    return _MODELS[path]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _id_lists(paths: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, paths)])
    flat = np.concatenate(paths) if paths else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), pa.array(flat.astype(np.int32)))


def segmented(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """Per document: the best ids, scores and ids of the n best paths (the best first), the text's characters, and whether
    every path decodes to the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model(path)
        for b in batches:
            for first, raw in text_blocks(b.column(1)):
                texts = [t.decode() for t in raw]
                best, scores, paths, same = [], [], [], []
                for t, (ids, values, ways, others) in zip(raw, lattice.segment(texts, n)):
                    # the other paths differ from the best in the chunks of ``others`` alone
                    same.append(lattice.decode(ids) == t and all(lattice.spells(c, other) for c, other in others))
                    best.append(ids.astype(np.int32))
                    scores.append(values)
                    paths.append([w.astype(np.int32) for w in ways])
                at = pa.array(np.cumsum([0, *map(len, paths)]), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(raw)), _id_lists(best), pa.array(scores, type=pa.list_(pa.float64())),
                     pa.ListArray.from_arrays(at, _id_lists([w for ways in paths for w in ways])),
                     pa.array([len(t) for t in texts], type=pa.int64()), pa.array(same)], names=_names(SCHEMA))

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


EDITS = "doc_id long, ids array<int>, nbest_scores array<double>, nbest_edits array<array<struct<at: int, size: int, ids: array<int>>>>, n_chars long, round_trip boolean"


def segmented_edits(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """As :func:`segmented`, the n best paths as edits of the best ids (the first has none): a long text's paths differ in a
    few ids only."""
    kind = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model(path)
        for b in batches:
            for first, raw in text_blocks(b.column(1)):
                texts = [t.decode() for t in raw]
                best, scores, edits, same = [], [], [], []
                for t, (ids, values, moves) in zip(raw, lattice.edited(texts, n)):
                    same.append(lattice.decode(ids) == t and all(lattice.spells(c, other) for moved in moves for _, _, other, c in moved))
                    best.append(ids)
                    scores.append(values)
                    edits.append([[{"at": at, "size": size, "ids": other} for at, size, other, _ in moved] for moved in moves])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(raw)), _id_lists(best), pa.array(scores, type=pa.list_(pa.float64())), pa.array(edits, type=kind),
                                                  pa.array([len(t) for t in texts], type=pa.int64()), pa.array(same)], names=_edit_names())

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, EDITS)


def _edit_names() -> list[str]:
    return ["doc_id", "ids", "nbest_scores", "nbest_edits", "n_chars", "round_trip"]


def edit_digests(rows: DataFrame) -> DataFrame:
    """:func:`digests` of rows of :func:`segmented_edits`: the paths' ids are put together one document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, ids, scores, edits, chars, same = b.columns
            at, flat = ids.offsets.to_numpy().tolist(), memoryview(ids.values.to_numpy().astype("<u4").tobytes())
            crc = []
            for lo, hi, paths in zip(at, at[1:], edits.to_pylist()):
                whole, own = flat[4 * lo : 4 * hi], []
                for moved in paths:
                    value, done = 0, 0
                    for e in moved:
                        value = zlib.crc32(np.array(e["ids"], dtype="<u4").tobytes(), zlib.crc32(whole[4 * done : 4 * e["at"]], value))
                        done = e["at"] + e["size"]
                    own.append(zlib.crc32(whole[4 * done :], value))
                crc.append(own)
            sizes = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64))
            top = pa.array([x[0] for x in scores.to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([doc, sizes, top, pa.array([x[0] for x in crc], type=pa.int64()), scores, pa.array(crc, type=pa.list_(pa.int64())), chars, same], names=_names(DIGESTS))

    return rows.select(*_edit_names()).mapInArrow(run, DIGESTS)


def decoded(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """doc_id, text: ``column`` (ids as :func:`segmented` gives them) as text again; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = model(path)
        for b in batches:
            texts = [None if x.as_py() is None else lattice.decode(np.asarray(x.as_py(), dtype=np.int64)).decode(errors="replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", column).mapInArrow(run, "doc_id long, text string")


def digests(rows: DataFrame) -> DataFrame:
    """Of rows of :func:`segmented`: pieces, score and crc32 of the best ids, scores and crc32 of the n best id sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, scores, nbest, chars, same = b.columns
            of, ids = nbest.offsets.to_numpy(), nbest.values
            at, flat = ids.offsets.to_numpy().tolist(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[lo:hi].tobytes()) for lo, hi in zip(at, at[1:])]
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            best = of[:-1].tolist()  # the best path is the first of every row
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(sizes[best], type=pa.int64()), pa.array(scores.values.to_numpy()[best], type=pa.float64()), pa.array([crc[i] for i in best], type=pa.int64()), scores,
                 pa.ListArray.from_arrays(nbest.offsets, pa.array(crc, type=pa.int64())), chars, same], names=_names(DIGESTS))

    return rows.select("doc_id", "nbest_scores", "nbest_ids", "n_chars", "round_trip").mapInArrow(run, DIGESTS)
