"""Token alignment against a plain version: every overlap compared, counts from all documents."""

import hashlib
from collections import Counter, defaultdict

import pytest

from terradelta.llm import alignment, registry
from terradelta.llm.token_bits import _byte_letters

from .conftest import ROWS

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(registry.tokenizer_path(BYTES))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path(PIECES))


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts, libraries):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), whole texts encoded by the libraries."""
    tok, sp = libraries
    letter = {c: b for b, c in _byte_letters().items()}
    linked, out = [], []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        ids = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        a = spans([(i, bytes(letter[c] for c in tok.id_to_token(i))) for i in ids])
        b = spans([(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in (sp.encode(t) if t else [])])
        joined = b"".join(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i, _, _ in b)
        if joined != whole:
            a, b = [], []
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, lo = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, s, x in a if lo <= s and x <= e) + "|" + ",".join(str(i) for i, s, x in b if lo <= s and x <= e))
            lo = e
        links = Counter((i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e)
        linked.append(links)
        out.append([len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*o[:4], sum(k for p, k in links.items() if count[p] == best[p[0]]), sum(k * count[p] for p, k in links.items()), o[4]) for o, links in zip(out, linked)]


def run(df):
    cols = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.align(df, registry.tokenizer_path(BYTES), registry.tokenizer_path(PIECES))
    return sorted(((r["doc_id"], *[r[c] for c in cols]) for r in got.collect()), key=repr)


TEXTS = ["  two  spaces\n\nand\tlines \n end ", "x▁y", "▁", " ", "\n", "a\xa0b ﬁ Å é  z", "it's 'll don't 123 4567 §$%&/", "\x00\x1f zero \x85 next", "don't<|endoftext|> <s> <unk>x"]


def test_alignment_equals_the_plain_version(spark, docs, odd, nothing, libraries):
    rows = [(r[0], r[1] if r[0] != 14 else "x" * 3000) for r in ROWS if r[0] != 11] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], libraries))), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS path", "1 AS bucket", "2 AS pair", "3L AS head").repartition(3)
    assert run(df) == want
    assert len(run(odd)) == len(ROWS) and run(nothing) == []


def test_many_runs_and_merge_rounds(spark, sf, libraries, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t[:1500]) for i, t in enumerate(texts)]
    want = sorted(((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows], libraries))), key=repr)
    monkeypatch.setattr(alignment, "FAN", 4)
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)) == want


def test_heads_merge_in_side_major_order(tmp_path):
    import numpy as np
    import zstandard

    paths, want = [], Counter()
    for k in range(5):
        pairs = np.unique(np.random.default_rng(k).integers(0, 9000, 7000))
        head = np.array([(p, k + 1) for p in pairs.tolist()], dtype=alignment.HEAD)
        want.update(dict(head.tolist()))
        paths.append((str(tmp_path / str(k)), 0, (tmp_path / str(k)).write_bytes(zstandard.compress(head.tobytes()))))
    assert list(alignment.merged(paths)) == sorted(want.items())
