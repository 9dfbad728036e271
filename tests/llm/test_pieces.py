"""The segmentation's ids as columns, their texts again, and the digests of them."""

import zlib

import corpus_pipeline
from terradelta.llm import pieces, registry

from .conftest import ROWS


def crc(m, ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_ids_leave_the_operator(spark, docs, nothing):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    m = pieces.model(path)
    rows = pieces.segmented(docs, path).collect()
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in rows:
        ids, scores, paths, _ = next(iter(m.segment([texts[r.doc_id]], pieces.N_BEST)))
        assert r.ids == ids.tolist() and r.nbest_scores == scores and r.nbest_ids == [p.tolist() for p in paths]
        assert r.nbest_ids[0] == r.ids and r.n_chars == len(texts[r.doc_id])
    back = pieces.decoded(pieces.segmented(docs, path), path).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    got = pieces.digests(pieces.segmented(docs, path)).collect()
    want = [(r.doc_id, len(r.ids), r.nbest_scores[0], crc(m, r.ids), r.nbest_scores, [crc(m, p) for p in r.nbest_ids], r.n_chars, r.round_trip) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pieces.decoded(pieces.segmented(nothing, path), path).count() == 0 and pieces.digests(pieces.segmented(nothing, path)).count() == 0
    last = corpus_pipeline.piece_encoding(spark, docs, "")
    assert {"ids", "nbest_ids", "nbest_scores"} <= set(last.columns)


def test_edits_give_the_same_digests(docs, odd, nothing):
    path = registry.tokenizer_path("piece_bpe_32k.model")
    want = sorted(map(tuple, pieces.digests(pieces.segmented(docs, path)).collect()), key=repr)
    assert sorted(map(tuple, pieces.edit_digests(pieces.segmented_edits(odd, path)).collect()), key=repr) == want
    assert pieces.edit_digests(pieces.segmented_edits(nothing, path)).count() == 0
