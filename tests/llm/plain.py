"""Plain versions of the operators' contracts, one document at a time."""

from collections import Counter

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return (text or "").encode().split()


def shingles(text, n=5):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows):
    """(n_shingles, component) by position of (doc_id, text) rows, all pairs compared."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and a and sets[j]
            if same_id or (a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j])):
                up[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            ids[root(i)] = min(doc, ids.get(root(i), doc))
    return [(len(s), ids.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def repeated(w, k=8):
    seen, hit = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), set()
    for i in range(len(w) - k + 1):
        if seen[tuple(w[i : i + k])] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def line_counts(text):
    text, w = text or "", [x.decode() for x in words(text)]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    rep = repeated(w)
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, rep, len(w) < 20 or 100 * rep > 30 * len(w))


def targets(sizes, share=1.5, cap=2.0):
    """Words per source: shares by weight, what is above a source's cap shared out again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total >= cap * sizes[s]]
        if not full:
            break
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        free -= set(full)
    return out | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
