"""All registered queries and their check SQL, gathered from the topic modules."""

from terradelta.plans import q_bench, q_extents, q_geo, q_physics, q_results, q_scenes, q_events, q_streams

MODULES = (q_physics, q_scenes, q_results, q_extents, q_geo, q_bench, q_events, q_streams)

QUERIES, ORACLES = {}, {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
