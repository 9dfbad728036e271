"""Check SQL for the physics: the same published formulas, written directly over the pix fixture."""


def nd(a, b):
    return f"({a} - {b}) / ({a} + {b} + 1e-6)"


def sig(x):
    return f"CASE WHEN ({x}) IS NOT NULL THEN 1e0 / (1e0 + exp(-greatest(least({x}, 30e0), -30e0))) END"


def mean2(a, b):
    return f"coalesce(({a} + {b}) / 2e0, {a}, {b})"


def entropy(p):
    q = f"greatest(least({p}, 0.999999e0), 1e-6)"
    return f"CASE WHEN {p} IS NOT NULL THEN -({q} * log2({q}) + (1e0 - {q}) * log2(1e0 - {q})) END"


SEVERITY = ("CASE WHEN dnbr IS NULL THEN NULL WHEN dnbr < 0.1e0 THEN 0 WHEN dnbr < 0.27e0 THEN 1 WHEN dnbr < 0.44e0 THEN 2 "
            "WHEN dnbr < 0.66e0 THEN 3 ELSE 4 END")

# idx: indices; ev: sensor evidence; maps: one row per pixel and task.
IDX = "idx AS (SELECT p.*, " + ", ".join(
    f"{nd(f's2_{t}_b03', f's2_{t}_b11')} AS mndwi_{t}, {nd(f's2_{t}_b08', f's2_{t}_b04')} AS ndvi_{t}, "
    f"{nd(f's2_{t}_b08', f's2_{t}_b12')} AS nbr_{t}" for t in ("pre", "post")) + " FROM {src} p)"
EV = f"""ev0 AS (SELECT *, nbr_pre - nbr_post AS dnbr FROM idx),
ev AS (SELECT *, {sig('(-18e0 - s1_pre_vv) / 1.5e0')} AS water_s1_pre,
  greatest({sig('(-18e0 - s1_post_vv) / 1.5e0')},
           ({sig('s1_pre_vv - s1_post_vv - 3e0')}) * ({sig('(-11e0 - s1_post_vv) / 1.5e0')})) AS water_s1_post,
  {sig('mndwi_pre / 0.05e0')} AS water_s2_pre, {sig('mndwi_post / 0.05e0')} AS water_s2_post,
  ({sig('(s1_pre_vh - s1_post_vh - 2e0) / 0.6e0')}) * ({sig('s1_pre_vh + 17e0')}) AS vh_drop,
  ({sig('(dnbr - 0.1e0) / 0.025e0')}) * ({sig('(ndvi_pre - 0.1e0) / 0.03e0')}) AS burn_s2,
  ({sig('(ndvi_pre - ndvi_post - 0.2e0) / 0.04e0')}) * ({sig('(ndvi_pre - 0.5e0) / 0.05e0')}) AS disturbance_s2,
  {sig('(CASE WHEN s1_pre_vv IS NOT NULL AND s1_post_vv IS NOT NULL AND s1_pre_vh IS NOT NULL AND s1_post_vh IS NOT NULL '
       'THEN greatest(abs(s1_post_vv - s1_pre_vv), abs(s1_post_vh - s1_pre_vh)) END - 3e0) / 0.5e0')} AS change_s1,
  {sig('(CASE WHEN mndwi_pre + mndwi_post + nbr_pre + nbr_post + ndvi_pre + ndvi_post IS NOT NULL THEN '
       'greatest(abs(mndwi_post - mndwi_pre), abs(ndvi_post - ndvi_pre), abs(nbr_post - nbr_pre)) END - 0.2e0) / 0.05e0')} AS change_s2
  FROM ev0)"""
TARGET = {
    "flood": f"{mean2('water_s1_post', 'water_s2_post')} * (1e0 - coalesce({mean2('water_s1_pre', 'water_s2_pre')}, 0e0))",
    "wildfire": "coalesce(burn_s2, vh_drop)",
    "vegetation": mean2("vh_drop", "disturbance_s2"),
}
EXTRA = {
    "flood": "abs(water_s1_post - water_s2_post)",
    "wildfire": "CASE WHEN burn_s2 IS NULL AND vh_drop IS NOT NULL THEN 0.5e0 END",
    "vegetation": "abs(vh_drop - disturbance_s2)",
}


def task_maps(task: str, extra_cols: str = "") -> str:
    """SELECT of one task's maps over ev (all its columns stay available)."""
    return f"""SELECT m.*, CASE WHEN target IS NOT NULL THEN greatest({entropy('target')}, {EXTRA[task]}) END AS uncertainty,
      {SEVERITY if task == 'wildfire' else 'CAST(NULL AS INTEGER)'} AS severity
    FROM (SELECT ev.*, '{task}' AS task, {TARGET[task]} AS target, {mean2('change_s1', 'change_s2')} AS change{extra_cols} FROM ev) m"""


def chain(src: str = "pix") -> str:
    """WITH text ending in CTE ev."""
    return "WITH " + IDX.replace("{src}", src) + ", " + EV


MAPS = ", maps AS (" + " UNION ALL ".join(task_maps(t) for t in TARGET) + ")"
