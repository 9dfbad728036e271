"""The pipeline: its stages against plain versions, and that it can be taken out."""

import corpus_pipeline
import __spark_entry__ as entry
from terradelta.llm import line_rules

from . import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{k}")
        rows = docs.collect()
        if k == 0:
            want = {}
            for i, r in held.items():
                lines, failed, _ = line_rules.judge_lines(r.text or "")
                text = "\n".join(x for x, bad in zip(lines, failed) if not bad)
                lost = sum(len(x.decode()) for line, bad in zip(lines, failed) if bad for x in plain.words(line))
                if not plain.line_counts(r.text)[-1] and 2 * lost <= sum(len(x.decode()) for x in plain.words(r.text)):
                    want[i] = text
            assert {r.doc_id: r.text for r in rows} == want
        if k == 1:
            truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert all(truth.get(i, 0) == 0 for i in set(held) - {r.doc_id for r in rows})
        if k == 2:
            before = sorted((r.doc_id, r.text) for r in held.values())
            assert sorted(r.doc_id for r in rows) == [i for (i, _), (_, c) in zip(before, plain.components(before)) if c == i]
        if k == 3:
            assert {r.doc_id for r in rows} <= set(held) and max(map([r.doc_id for r in rows].count, {r.doc_id for r in rows})) <= 2
        if k < 4:
            assert docs.columns == columns
            held = {r.doc_id: r for r in rows}
        else:
            assert all(r.round_trip for r in rows) and sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before_last)
        before_last = rows


def test_registered():
    assert {"pipeline", *(f"op{i}_" for i in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] + "_" for n in entry.queries()}
    assert set(entry.oracle_sql()) <= set(entry.queries())
