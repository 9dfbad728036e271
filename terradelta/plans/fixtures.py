"""Domain inputs derived from the given tables, as SQL that Spark and other engines read alike.

``{name}`` stands for one of the given tables. Every fixture covers its whole table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

W, H = 100, 20  # pixels per request of the pix fixture

_K = "CAST(substr(props, 7, length(props) - 7) AS INT)"

SQL: dict[str, str] = {}

# Wide before/after pixels: one event is one pixel, 2000 consecutive events are one request of 20 rows x 100 columns.
SQL["pix"] = f"""
SELECT i AS pixel_id, CAST(floor(i / 2000e0) AS INT) AS request_id, CAST(floor((i % 2000) / 100e0) AS INT) AS r,
  CAST(i % 100 AS INT) AS c, t AS truth, k,
  CASE WHEN i % 11 <> 5 THEN -11e0 + 4e0 * u1 END AS s1_pre_vv,
  CASE WHEN i % 11 <> 5 THEN -17e0 + 4e0 * u2 END AS s1_pre_vh,
  CASE WHEN i % 13 <> 6 THEN -11e0 + 4e0 * u1 - CASE WHEN t = 'signup' THEN 10e0 ELSE u3 END END AS s1_post_vv,
  CASE WHEN i % 13 <> 6 THEN -17e0 + 4e0 * u2 - CASE WHEN t = 'purchase' THEN 3.5e0 WHEN t = 'signup' THEN 10e0 ELSE u4 END END AS s1_post_vh,
  CASE WHEN i % 7 <> 2 THEN 0.04e0 + 0.02e0 * u4 END AS s2_pre_b02,
  CASE WHEN i % 7 <> 2 THEN 0.05e0 + 0.04e0 * u2 END AS s2_pre_b03,
  CASE WHEN i % 7 <> 2 THEN 0.03e0 + 0.05e0 * u3 END AS s2_pre_b04,
  CASE WHEN i % 7 <> 2 THEN 0.22e0 + 0.2e0 * u1 END AS s2_pre_b08,
  CASE WHEN i % 7 <> 2 THEN 0.15e0 + 0.1e0 * u4 END AS s2_pre_b11,
  CASE WHEN i % 7 <> 2 THEN 0.06e0 + 0.06e0 * u2 END AS s2_pre_b12,
  CASE WHEN i % 7 <> 3 THEN 0.04e0 + 0.02e0 * u1 END AS s2_post_b02,
  CASE WHEN i % 7 <> 3 THEN 0.05e0 + 0.04e0 * u2 END AS s2_post_b03,
  CASE WHEN i % 7 <> 3 THEN 0.03e0 + 0.05e0 * u3 + CASE WHEN t = 'purchase' THEN 0.05e0 ELSE 0e0 END END AS s2_post_b04,
  CASE WHEN i % 7 <> 3 THEN CASE WHEN t = 'signup' THEN 0.03e0 WHEN t = 'purchase' THEN 0.12e0 ELSE 0.22e0 + 0.2e0 * u1 END END AS s2_post_b08,
  CASE WHEN i % 7 <> 3 THEN CASE WHEN t = 'signup' THEN 0.01e0 ELSE 0.15e0 + 0.1e0 * u4 END END AS s2_post_b11,
  CASE WHEN i % 7 <> 3 THEN CASE WHEN t = 'signup' THEN 0.01e0 WHEN t = 'purchase' THEN 0.2e0 ELSE 0.06e0 + 0.06e0 * u2 END END AS s2_post_b12,
  CASE WHEN i % 23 <> 7 THEN 20e0 + 30e0 * u4 END AS elev
FROM (
  SELECT event_id AS i, event_type AS t, {_K} AS k,
         ((event_id * 7919) % 997) / 997e0 AS u1, ((event_id * 104729 + 11) % 991) / 991e0 AS u2,
         ((event_id * 15485863 + 23) % 983) / 983e0 AS u3, ((event_id * 32452843 + 31) % 977) / 977e0 AS u4
  FROM {{events}}) b"""

# Long scene pixels: pixel = order, one lineitem = one observation; scenes are identified by their supplier.
SQL["scene_px"] = """
SELECT l_orderkey AS pixel_id, CASE WHEN l_shipdate < TIMESTAMP '1998-07-01 00:00:00' THEN 'pre' ELSE 'post' END AS period,
       l_suppkey AS scene_id, l_shipdate AS scene_ts, l_partkey AS k1, l_suppkey AS k2, l_linenumber AS k3,
       CASE WHEN l_suppkey % 10 = 3 AND l_quantity < 50 THEN 9 ELSE CAST(l_quantity AS INT) % 12 END AS scl,
       l_tax * 1000e0 AS cloud, l_extendedprice / 11e0 AS dn,
       CASE WHEN l_returnflag = 'A' THEN 4.0e0 WHEN l_returnflag = 'N' THEN 2.0e0 END AS processing_baseline,
       l_discount AS vv_power, l_tax AS vh_power
FROM {lineitem}"""

SQL["scene_catalog"] = """
SELECT event_id AS scene_id, CASE WHEN event_type IN ('click','view') THEN 's1' WHEN event_type = 'error' THEN 'dem' ELSE 's2' END AS sensor,
       CASE WHEN event_type <> 'error' OR event_id % 3 > 0 THEN ts END AS ts, value / 5e0 AS cloud, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 5 END AS relative_orbit,
       CASE WHEN event_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state, 'sat-' || CAST(user_id % 4 AS VARCHAR(4)) AS platform,
       CAST(user_id % 25 AS DOUBLE) AS w, CAST(user_id % 25 AS DOUBLE) + 1.5e0 AS e, 44e0 AS s, 45.5e0 AS n
FROM {events}"""

# Areas to search the catalog for: a box and two windows each.
SQL["areas"] = """
SELECT s_suppkey AS area_id, s_nationkey * 1e0 + (s_suppkey % 7) * 0.1e0 AS w, s_nationkey * 1e0 + (s_suppkey % 7) * 0.1e0 + 0.25e0 AS e,
       44.2e0 + (s_suppkey % 13) * 0.15e0 AS s, 44.2e0 + (s_suppkey % 13) * 0.15e0 + 0.15e0 AS n,
       DATE '2024-01-01' + CAST(s_suppkey % 6 AS INT) AS before_start, DATE '2024-01-01' + CAST(s_suppkey % 6 + 8 AS INT) AS before_end,
       DATE '2024-01-01' + CAST(s_suppkey % 6 + 11 AS INT) AS after_start, DATE '2024-01-01' + CAST(s_suppkey % 6 + 20 AS INT) AS after_end
FROM {supplier}"""

SQL["requests"] = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' WHEN 2 THEN 'vegetation' ELSE 'landslide' END AS task,
       CAST(o_orderdate AS DATE) AS before_start, CAST(o_orderdate AS DATE) + CAST(o_custkey % 140 AS INT) AS before_end,
       CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 + o_orderkey % 60 AS INT) AS after_start,
       CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 + o_orderkey % 60 + o_custkey % 31 AS INT) AS after_end,
       o_totalprice / 400e0 AS aoi_km2, CASE o_orderstatus WHEN 'P' THEN 'sentinel-1,S2' WHEN 'F' THEN 's2' ELSE 'landsat' END AS sensors,
       -179e0 + (o_custkey % 358) AS lon, -79e0 + (o_orderkey % 158) AS lat,
       0.02e0 + (o_custkey % 9) * 0.01e0 AS half_lon, 0.02e0 + (o_orderkey % 7) * 0.01e0 AS half_lat
FROM {orders}"""

SQL["manifest_events"] = """
SELECT s_suppkey AS event_id, CASE s_suppkey % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split,
       s_nationkey * 1e0 + (s_suppkey % 7) * 0.3e0 AS w, s_nationkey * 1e0 + (s_suppkey % 7) * 0.3e0 + 0.25e0 AS e,
       40e0 + (s_suppkey % 3) * 0.1e0 AS s, 40.15e0 + (s_suppkey % 3) * 0.1e0 AS n
FROM {supplier}"""

SQL["candidates"] = f"""
SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'flood' WHEN 'view' THEN 'wildfire' ELSE 'vegetation' END AS hazard,
       (user_id % 12) * 0.4e0 + 3e0 AS lon, k * 0.02e0 + 43e0 AS lat, CAST(ts AS DATE) AS start_date,
       CAST(ts AS DATE) + CAST(k % 9 AS INT) AS end_date,
       CASE event_id % 4 WHEN 0 THEN 'cems' WHEN 1 THEN 'gdacs' WHEN 2 THEN 'eonet' ELSE 'news' END AS kind,
       CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'id' || CAST(k % 40 AS VARCHAR(4)) END AS source_id,
       'https://n.example/' || CAST(user_id % 50 AS VARCHAR(4)) AS url,
       CASE WHEN event_id % 4 = 3 AND k % 10 <> 0 THEN 'outlet' || CAST(user_id % 6 AS VARCHAR(4)) END AS outlet,
       CASE WHEN k % 5 = 0 THEN '' ELSE 'place ' || CAST(k % 7 AS VARCHAR(4)) END AS place,
       CASE WHEN k % 11 = 0 THEN '' ELSE 'country ' || CAST(user_id % 3 AS VARCHAR(4)) END AS country,
       CASE WHEN k % 3 = 0 THEN NULL ELSE k * 0.01e0 END AS half_deg
FROM (SELECT event_id, event_type, user_id, ts, {_K} AS k FROM {{events}}) x"""

# Reports around some five hundred places of the globe, both sides of the date line and the far north among them.
SQL["spread_reports"] = f"""
SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'flood' WHEN 'view' THEN 'wildfire' ELSE 'vegetation' END AS hazard,
       (user_id % 41) * 9e0 - 181e0 + (event_id % 29) * 0.11e0 AS lon, (user_id % 13) * 13e0 - 70e0 + (k % 17) * 0.13e0 AS lat,
       CAST(ts AS DATE) AS start_date
FROM (SELECT event_id, event_type, user_id, ts, {_K} AS k FROM {{events}}) x"""

# The title of a document is its first line.
SQL["articles"] = """
SELECT doc_id, source AS outlet, lang, split_part(text, chr(10), 1) AS title, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS pub_date, text FROM {documents}"""

SQL["predictions"] = """
SELECT d.doc_id AS px, d.source AS event, l.quality AS y, l.toxic AS y_change,
       1e0 / (1e0 + exp(-((d.doc_id * 7919 % 1000) / 250e0 - 2e0 + 1.5e0 * l.quality))) AS p
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

SQL["gazetteer"] = """
SELECT n_nationkey AS hit_id, n_name AS name, r_name AS admin_area, -60e0 + n_nationkey * 5e0 AS lat, -150e0 + n_nationkey * 12e0 AS lon,
       (n_nationkey % 5) * 0.6e0 AS half_deg, CASE n_nationkey % 4 WHEN 0 THEN 'amenity' WHEN 1 THEN 'boundary' ELSE 'place' END AS category,
       CASE n_nationkey % 6 WHEN 5 THEN 'state' ELSE 'town' END AS addresstype, 8 + n_nationkey % 25 AS place_rank
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""

SQL["access_log"] = """
SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, event_type AS route,
       CASE user_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 422 ELSE 200 END AS code, value / 1000e0 AS seconds FROM {events}"""

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL (``{table}`` placeholders) over the tables of ``sf_dir``."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    escaped = sql.replace("{", "{{").replace("}", "}}")  # other braces are text, e.g. JSON
    for t in used:
        escaped = escaped.replace("{{" + t + "}}", "{" + t + "}")
    return spark.sql(escaped, **used)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark, sf_dir, SQL[name])


def oracle_text(sql: str) -> str:
    """Fixture SQL with the plain table names the check engine has registered."""
    return reduce(lambda s, t: s.replace("{" + t + "}", t), TABLES, sql)


def with_fixtures(body: str, *names: str) -> str:
    """``body`` preceded by the named fixtures as common table expressions (body may start with its own WITH)."""
    ctes = ", ".join(f"{n} AS ({oracle_text(SQL[n])})" for n in names)
    body = body.strip()
    if not names:
        return body
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if own:
        return f"WITH {'RECURSIVE ' if own.group(1) else ''}{ctes}, {body[own.end():]}"
    return f"WITH {ctes} {body}"
