"""Connected components: chains whose ids rise and fall."""

import random

from terradelta.llm.common import components


def found(spark, edges):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test-components").collect()}


def test_a_node_may_have_two_parents_after_a_round(spark):
    assert found(spark, [(3, 5), (4, 5), (4, 6), (2, 6)]) == dict.fromkeys((2, 3, 4, 5, 6), 2)


def test_random_chains(spark):
    r, edges, want = random.Random(7), [], {}
    for k in range(200):  # chains of their own ids, all in one run
        ids = [1000 * k + i for i in range(r.randrange(5, 40))]
        r.shuffle(ids)
        edges += [(a, b) if r.random() < 0.5 else (b, a) for a, b in zip(ids, ids[1:])]
        want |= dict.fromkeys(ids, 1000 * k)
    assert found(spark, edges) == want
