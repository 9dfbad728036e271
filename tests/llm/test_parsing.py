"""Locally consistent parsing: against a symbol-by-symbol version, on shifted texts, and the query's neighbours."""

import hashlib
import random

import numpy as np
import pytest

from terradelta.llm import parsing

from .conftest import ROWS

MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def toss(seq, rounds):
    """Labels 0..2 of a sequence without equal neighbours, one symbol at a time."""
    for _ in range(rounds):
        out = []
        for i, s in enumerate(seq):
            low = 0 if i == 0 else ((s ^ seq[i - 1]) & -(s ^ seq[i - 1])).bit_length() - 1
            out.append(2 * low + (s >> low & 1))
        seq = out
    assert max(seq) <= 5
    for v in (3, 4, 5):
        for i, s in enumerate(seq):
            if s == v:
                near = {seq[j] for j in (i - 1, i + 1) if 0 <= j < len(seq)}
                seq[i] = min({0, 1, 2} - near)
    return seq


def plain_levels(text):
    at = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(8)]
    seq, out = list(text), []
    while seq:
        runs = []
        for s in seq:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        lab = toss([s for s, _ in runs], 4 if out else 3)
        n = len(lab)
        high = [all(lab[i] > lab[j] for j in (i - 1, i + 1) if 0 <= j < n) for i in range(n)]
        low = [0 < i < n - 1 and lab[i] < lab[i - 1] and lab[i] < lab[i + 1] and not high[i - 1] and not high[i + 1] for i in range(n)]
        starts = [i for i in range(n) if i == 0 or high[i] or low[i]] + [n]
        seq = [mix((sum(mix((s * at[7] + k) & MASK) * at[j] for j, (s, k) in enumerate(runs[a:b])) + len(out) + 1) & MASK) for a, b in zip(starts, starts[1:])]
        assert max(b - a for a, b in zip(starts, starts[1:])) <= 4
        out.append(seq)
        if len(seq) == 1:
            break
    return out


def test_levels_equal_the_plain_version():
    r = random.Random(1)
    texts = [b"", b"a", b"aaaaaaaa", b"ab" * 50, bytes(r.randrange(256) for _ in range(900)), "Über 日本 ".encode() * 9] + [bytes(r.choice(b"abc d") for _ in range(r.randrange(1, 90))) for _ in range(60)]
    want = [plain_levels(t) for t in texts]
    got = [[] for _ in texts]
    for _, sym, doc in parsing.levels(texts):
        for d in np.unique(doc).tolist():
            got[d].append(sym[doc == d].tolist())
    assert got == want
    for label, first in [(parsing.labels(np.frombuffer(t, dtype=np.uint8), np.arange(len(t)) == 0), None) for t in (b"abacab", bytes(range(250)))]:
        assert label.max() <= 2 and (label[1:] != label[:-1]).all()


def test_shared_interiors_have_equal_phrases():
    r = random.Random(2)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9)))
    body = " ".join(word() for _ in range(700)).encode()
    for _ in range(5):
        a, b = " ".join(word() for _ in range(r.randrange(1, 40))).encode(), " ".join(word() for _ in range(r.randrange(1, 40))).encode()
        one, two = plain_levels(a + body), plain_levels(body + b)
        for level, lost in ((1, 8), (2, 8), (3, 8), (4, 8)):
            inner = set(two[level - 1]) & set(one[level - 1])
            assert len(inner) >= len(set(plain_levels(body)[level - 1])) * 0.98 - lost


def test_fingerprints():
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(n)).encode()
    for n in (30, 120, 700, 5000):
        a, b = text(n), text(n)
        half = a[: len(a) // 2] + b[: len(b) // 2]
        fa, fb, fh, again = parsing.fingerprints([a, b, half, a])
        assert parsing.likeness(fa, fh) > 0.25 and parsing.likeness(fb, fa) < 0.1 and (fa == again).all() and parsing.likeness(fa, again) == 1
        assert (parsing.read(parsing.spelled(fa)) == fa).all() and len(fa) <= parsing.SIZE and len(fa)
    empty, one = parsing.fingerprints([b"", b"x"])
    assert len(empty) == 0 and len(one) == 1 and parsing.likeness(empty, empty) == 1 and parsing.likeness(empty, one) == 0


def neighbours(rows):
    """Text and following text of every row, in descending order of id, nulls last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(i, t or "", rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


@pytest.mark.parametrize("size", [1 << 40, 60_000, 3_000])
def test_edited_fingerprints(spark, docs, odd, nothing, monkeypatch, size):
    monkeypatch.setattr(parsing, "PART_BYTES", size)
    want = []
    for i, t, nxt in neighbours([r[:2] for r in ROWS]):
        e = parsing.edited_text(t, nxt)
        own, other, following = parsing.fingerprints([t.encode(), e.encode(), nxt.encode()])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), parsing.spelled(own), parsing.spelled(other), parsing.likeness(own, other), parsing.likeness(own, following)))
    got = parsing.edited_fingerprints(odd)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert parsing.edited_fingerprints(nothing).count() == 0
    one = parsing.edited_fingerprints(docs.where("doc_id = 7")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(20, 1.0)]


def test_fingerprinted(docs, nothing):
    got = {r.doc_id: r.fingerprint for r in parsing.fingerprinted(docs).collect()}
    assert got[4] == got[5] == "" and got[1] == got[2] != got[3] and parsing.fingerprinted(nothing).count() == 0
