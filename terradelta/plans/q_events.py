"""Registered queries: feeds, article verification, geocoding, cases and jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import text
from terradelta.operators import cases as C
from terradelta.operators import clusters
from terradelta.operators import jobs as J
from terradelta.operators import merge as MG
from terradelta.operators import verify as V
from terradelta.plans.fixtures import SQL, derive, fixture, table
from terradelta.plans.kit import Book, r6, rounded
from terradelta.session import fresh_path
from terradelta.sources import feeds, sinks

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
_K = "CAST(substr(props, 7, length(props) - 7) AS INT)"
TODAY = "2024-01-20"
today = lambda: F.lit(TODAY).cast("date")


def flat(df: DataFrame) -> DataFrame:
    """Candidate rows with the box as four columns."""
    cols = [c for c in df.columns if c != "bbox"]
    return df.select(*cols, *[F.col(f"bbox.{x}").alias(f"bbox_{x}") for x in "wsen"])


# ------------------------------------------------------------------------------------------ feeds

# Every event becomes one alert payload, as the services would send it.
GDACS_SQL = f"""SELECT CASE WHEN event_id % 2 = 0 THEN 'FL' ELSE 'WF' END AS kind,
  '{{"features":[{{"properties":{{"eventid":' || CAST(event_id AS VARCHAR(20)) || ',"name":"' || CASE WHEN k % 7 = 0 THEN '' ELSE 'Event ' || CAST(k AS VARCHAR(4)) END || '","description":"Described","alertlevel":"' ||
  CASE k % 3 WHEN 0 THEN 'Green' WHEN 1 THEN 'Orange' ELSE 'Red' END || '","country":"C' || CAST(user_id % 9 AS VARCHAR(4)) || '","fromdate":"2024-01-' || lpad(CAST(1 + k % 20 AS VARCHAR(2)), 2, '0') || 'T00:00:00","todate":"2024-01-' ||
  lpad(CAST(1 + k % 28 AS VARCHAR(2)), 2, '0') || 'T00:00:00","severitydata":{{"severity":' || CAST(k * 300 AS VARCHAR(10)) || ',"severitytext":" ' || CAST(k * 300 AS VARCHAR(10)) || ' ha "}},"url":{{"report":"https://r/' || CAST(event_id AS VARCHAR(20)) ||
  '","geometry":"https://g/' || CAST(k % 30 AS VARCHAR(4)) || '"}}}},"geometry":{{"coordinates":[' || CAST(user_id % 180 AS VARCHAR(6)) || '.25,' || CAST(k % 80 AS VARCHAR(4)) || '.5]}}}}]}}' AS payload
  FROM (SELECT event_id, user_id, {_K} AS k FROM {{events}}) x"""
EXTENT_SQL = f"""SELECT 'https://g/' || CAST(k AS VARCHAR(4)) AS url, '{{"features":[{{"properties":{{"Class":"' || CASE WHEN k % 4 = 0 THEN 'Point_C' ELSE 'Poly_A_1' END || '"}},"geometry":{{"coordinates":[[[' || CAST(k AS VARCHAR(4)) || ',1],[' ||
  CAST(k + 2 AS VARCHAR(4)) || ',3.5]]]}}}},{{"properties":{{"Class":"Poly_Z"}},"geometry":{{"coordinates":[[[-99,-99]]]}}}}]}}' AS payload FROM (SELECT DISTINCT {_K} % 30 AS k FROM {{events}}) y"""
_EV = f"e AS (SELECT event_id, user_id, event_type, ts, value, {_K} AS k FROM events)"


@book.query("load_gdacs_alerts", f"""WITH {_EV} SELECT CASE WHEN event_id % 2 = 0 THEN 'flood' ELSE 'wildfire' END AS hazard, user_id % 180 + 0.25e0 AS lon, k % 80 + 0.5e0 AS lat, DATE '2024-01-01' + k % 20 AS start_date, DATE '2024-01-01' + k % 28 AS end_date,
  '' AS place, 'C' || user_id % 9 AS country, 'gdacs' AS kind, CASE WHEN event_id % 2 = 0 THEN 'FL' ELSE 'WF' END || event_id AS source_id, 'https://r/' || event_id AS url,
  CASE WHEN k % 7 = 0 THEN 'Described' ELSE 'Event ' || k END || ' (' || CASE k % 3 WHEN 0 THEN 'Green' WHEN 1 THEN 'Orange' ELSE 'Red' END || ' alert)' AS title, CAST(DATE '2024-01-01' + k % 20 AS VARCHAR) AS date, (k * 300) || ' ha' AS detail,
  CASE WHEN k % 30 % 4 <> 0 THEN k % 30 * 1e0 END AS bbox_w, CASE WHEN k % 30 % 4 <> 0 THEN 1e0 END AS bbox_s, CASE WHEN k % 30 % 4 <> 0 THEN k % 30 + 2e0 END AS bbox_e, CASE WHEN k % 30 % 4 <> 0 THEN 3.5e0 END AS bbox_n
  FROM e WHERE NOT (event_id % 2 = 1 AND k % 3 = 0 AND k * 300 < 10000)""")
def q_gdacs(spark, sf):
    return flat(feeds.gdacs_alerts(derive(spark, sf, GDACS_SQL), feeds.gdacs_extents(derive(spark, sf, EXTENT_SQL))))


@book.query("gdacs_extent", f"WITH {_EV} SELECT DISTINCT 'https://g/' || k % 30 AS url, CASE WHEN k % 30 % 4 <> 0 THEN k % 30 * 1e0 END AS w, CASE WHEN k % 30 % 4 <> 0 THEN 3.5e0 END AS n FROM e")
def q_extent(spark, sf):
    return feeds.gdacs_extents(derive(spark, sf, EXTENT_SQL)).select("url", "bbox.w", "bbox.n")


CEMS_SQL = """SELECT 'EMSR' || CAST(event_id AS VARCHAR(20)) AS code, '{"results":[{"code":"EMSR' || CAST(event_id AS VARCHAR(20)) || '","category":"' || CASE event_id % 3 WHEN 0 THEN 'Flood' WHEN 1 THEN 'Wildfire' ELSE 'Storm' END || '","name":"Act ' || CAST(event_id AS VARCHAR(20)) ||
  '","eventTime":"2024-01-' || lpad(CAST(1 + event_id % 28 AS VARCHAR(2)), 2, '0') || 'T08:00:00","centroid":"POINT (' || CAST(user_id % 90 AS VARCHAR(4)) || '.5 -' || CAST(user_id % 50 AS VARCHAR(4)) || '.25)","countries":["A","B"]}]}' AS payload,
  '{"results":[{"code":"EMSR' || CAST(event_id AS VARCHAR(20)) || '","reason":"Why","aois":[{"name":"N1","extent":"POLYGON ((1 2, ' || CAST(user_id AS VARCHAR(20)) || ' 4))"},{"name":"N2"},{"name":"N3","extent":"POLYGON ((0.5 3, 2 9))"}]}]}' AS detail FROM {events}"""


@book.query("load_cems_activations", """SELECT CASE event_id % 3 WHEN 0 THEN 'flood' ELSE 'wildfire' END AS hazard, user_id % 90 + 0.5e0 AS lon, -(user_id % 50 + 0.25e0) AS lat, DATE '2024-01-01' + CAST(event_id % 28 AS INT) AS start_date, DATE '2024-01-01' + CAST(event_id % 28 AS INT) AS end_date,
  'N1, N2, N3' AS place, 'A, B' AS country, 'cems' AS kind, 'EMSR' || event_id AS source_id, 'https://rapidmapping.emergency.copernicus.eu/EMSR' || event_id AS url, 'Act ' || event_id AS title, CAST(DATE '2024-01-01' + CAST(event_id % 28 AS INT) AS VARCHAR) AS date, 'Why' AS detail,
  least(0.5e0, user_id) AS bbox_w, 2e0 AS bbox_s, greatest(2e0, user_id) AS bbox_e, 9e0 AS bbox_n FROM events WHERE event_id % 3 < 2 AND event_id % 28 >= 4""")
def q_cems(spark, sf):
    d = derive(spark, sf, CEMS_SQL)
    return flat(feeds.cems_activations(d.select("payload"), d.select("code", F.col("detail").alias("payload")), F.lit("2024-01-05").cast("date")))


EONET_SQL = f"""SELECT '{{"events":[{{"id":"E' || CAST(event_id AS VARCHAR(20)) || '","title":"' || CASE event_id % 5 WHEN 0 THEN 'Prescribed Burn 12' WHEN 1 THEN 'Floods  Lowmere' ELSE 'Wildfire Gorse Hill, Norland' END || '","categories":[{{"id":"' || CASE event_id % 5 WHEN 1 THEN 'floods' WHEN 4 THEN 'volcanoes' ELSE 'wildfires' END || '"}}],"sources":' ||
  CASE WHEN event_id % 2 = 0 THEN '[]' ELSE '[{{"url":"https://s/1"}}]' END || ',"geometry":[{{"magnitudeValue":1,"magnitudeUnit":"acres","date":"2024-01-02T00:00:00Z","type":"Point","coordinates":[1,2]}},{{"magnitudeValue":' || CASE WHEN k % 10 = 0 THEN 'null' ELSE CAST(k * 30 AS VARCHAR(10)) END ||
  ',"magnitudeUnit":"acres","date":"2024-01-09T00:00:00Z","type":"' || CASE WHEN event_id % 11 = 0 THEN 'Polygon' ELSE 'Point' END || '","coordinates":' || CASE WHEN event_id % 11 = 0 THEN '[]' ELSE '[-100.123456,' || CAST(k % 60 AS VARCHAR(4)) || '.5]' END || '}}]}}]}}' AS payload
  FROM (SELECT event_id, {_K} AS k FROM {{events}}) x"""


@book.query("load_eonet_events", f"""WITH {_EV} SELECT CASE event_id % 5 WHEN 1 THEN 'flood' ELSE 'wildfire' END AS hazard, -100.12346e0 AS lon, k % 60 + 0.5e0 AS lat, DATE '2024-01-02' AS start_date, DATE '2024-01-09' AS end_date, CASE event_id % 5 WHEN 1 THEN 'Lowmere' ELSE 'Gorse Hill, Norland' END AS place, '' AS country,
  'eonet' AS kind, 'E' || event_id AS source_id, CASE WHEN event_id % 2 = 0 THEN 'https://eonet.gsfc.nasa.gov/api/v3/events/E' || event_id ELSE 'https://s/1' END AS url, CASE event_id % 5 WHEN 1 THEN 'Floods  Lowmere' ELSE 'Wildfire Gorse Hill, Norland' END AS title, '2024-01-02' AS date,
  CASE WHEN k % 10 = 0 OR k = 0 THEN 'acres' ELSE (k * 30) || ' acres' END AS detail, NULL::DOUBLE AS bbox_w, NULL::DOUBLE AS bbox_s, NULL::DOUBLE AS bbox_e, NULL::DOUBLE AS bbox_n
  FROM e WHERE event_id % 11 <> 0 AND event_id % 5 IN (1, 2, 3) AND (event_id % 5 = 1 OR (k % 10 <> 0 AND k * 30 >= 1000))""")
def q_eonet(spark, sf):
    return flat(feeds.eonet_events(derive(spark, sf, EONET_SQL)))


_TITLE = """CASE k % 8 WHEN 0 THEN 'Village FLOODED again, day ' || CAST(k AS VARCHAR(4)) WHEN 1 THEN 'Blaze near mill, ' || CAST(k AS VARCHAR(4)) || ' acres!' WHEN 2 THEN 'Blaze  near mill -- ' || CAST(k - 1 AS VARCHAR(4)) || ' acres' WHEN 3 THEN 'Clearcut spreads past ridge ' || CAST(user_id AS VARCHAR(20))
  WHEN 4 THEN 'Canal overflow shuts lock ' || CAST(event_id AS VARCHAR(20)) WHEN 5 THEN 'Choir wins prize' WHEN 6 THEN 'Deforestation  brings blaze and flood ' || CAST(k AS VARCHAR(4)) ELSE '???' END"""
GDELT_SQL = f"""SELECT event_id, '{{"articles":[{{"url":"https://n/' || CAST(event_id AS VARCHAR(20)) || '","title":"' || {_TITLE} || '","seendate":"' || CASE WHEN k % 9 = 0 THEN '' ELSE '202401' || lpad(CAST(1 + k % 28 AS VARCHAR(2)), 2, '0') || 'T101500Z' END || '","domain":"d' || CAST(user_id % 20 AS VARCHAR(4)) || '.example"}}]}}' AS payload
  FROM (SELECT event_id, user_id, {_K} AS k FROM {{events}}) x"""
_HAZ = lambda t: f"CASE WHEN regexp_matches({t}, '(?i)deforest|logging|forest (loss|clearing)|clear-?cut|land clearing') THEN 'vegetation' WHEN regexp_matches({t}, '(?i)wildfire|bush ?fire|forest fire|brush ?fire|grass ?fire|blaze|burn') THEN 'wildfire' WHEN regexp_matches({t}, '(?i)flood|inundat|deluge|overflow|submerg') THEN 'flood' END"
_KEYSQL = lambda t: f"trim(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@book.query("load_gdelt_articles", f"""WITH {_EV}, t AS (SELECT *, {_TITLE} AS title FROM e), h AS (SELECT *, {_HAZ('title')} AS hazard, {_KEYSQL('title')} AS key FROM t),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id) AS n FROM h WHERE hazard IS NOT NULL AND key <> '')
  SELECT hazard, 'https://n/' || event_id AS url, title, CASE WHEN k % 9 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') END AS date, 'd' || user_id % 20 || '.example' AS outlet FROM o WHERE n = 1""")
def q_gdelt(spark, sf):
    return feeds.gdelt_articles(derive(spark, sf, GDELT_SQL), "event_id")


RSS_SQL = f"""SELECT '<item><title>' || {_TITLE} || '</title><link>' || CASE k % 3 WHEN 0 THEN 'ftp://x/' WHEN 1 THEN 'https://www.m' || CAST(user_id % 5 AS VARCHAR(4)) || '.example/a?' ELSE ' http://m.example/' END || CAST(event_id AS VARCHAR(20)) || '</link><pubDate>' ||
  CASE WHEN k % 10 = 9 THEN 'soon' ELSE 'Mon, ' || lpad(CAST(1 + event_id % 28 AS VARCHAR(2)), 2, '0') || ' Jan 2024 23:30:00 ' || CASE k % 4 WHEN 0 THEN 'GMT' WHEN 1 THEN '+0000' WHEN 2 THEN '-0200' ELSE '+0100' END END || '</pubDate><description>about ' || CASE WHEN user_id % 2 = 0 THEN 'deforestation' ELSE 'birds' END || '</description></item>' AS item,
  'vegetation' AS hazard FROM (SELECT event_id, user_id, {_K} AS k FROM {{events}}) x"""


@book.query("load_rss_items", f"""WITH {_EV}, t AS (SELECT *, {_TITLE} AS title, TIMESTAMP '2024-01-01 23:30:00' + INTERVAL 1 DAY * CAST(event_id % 28 AS INT) + INTERVAL 1 HOUR * CASE k % 4 WHEN 2 THEN 2 WHEN 3 THEN -1 ELSE 0 END AS tm FROM e)
  SELECT 'vegetation' AS hazard, CASE k % 3 WHEN 1 THEN 'https://www.m' || user_id % 5 || '.example/a?' || event_id ELSE 'http://m.example/' || event_id END AS url, title, strftime(tm, '%Y-%m-%d') AS date, CASE k % 3 WHEN 1 THEN 'm' || user_id % 5 || '.example' ELSE 'm.example' END AS outlet
  FROM t WHERE k % 3 <> 0 AND k % 10 <> 9 AND tm >= TIMESTAMP '2024-01-18 12:00:00' AND regexp_matches(title || ' about ' || CASE WHEN user_id % 2 = 0 THEN 'deforestation' ELSE 'birds' END, '(?i)deforest|logging|forest (loss|clearing)|clear-?cut|land clearing')""")
def q_rss(spark, sf):
    return feeds.rss_items(derive(spark, sf, RSS_SQL), F.lit("2024-01-20 12:00:00").cast("timestamp"), 48, K.HAZARD_WORDS["vegetation"])


# ------------------------------------------------------------------------------------------ pages and titles

_READ = lambda h: ("regexp_replace(regexp_replace(" + "replace(" * 6 + f"regexp_replace(regexp_replace({h}, '(?i)<br\\s*/?>|</p>|</h[1-6]>|</li>|</div>|</tr>', chr(10) || chr(10), 'g'), '(?s)<[^>]+>', '', 'g')"
                   + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]*\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_ELEM = lambda t: f"array_to_string(regexp_extract_all(clean, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), chr(10) || chr(10))"


@book.query("news_text", f"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<img\\b[^>]*>|<nav\\b.*?</nav>|<head\\b.*?</head>', '', 'g') AS clean FROM pages),
  r AS (SELECT page_id, {_READ(_ELEM('article'))} AS a, {_READ(_ELEM('main'))} AS m, {_READ('clean')} AS b FROM c),
  t AS (SELECT page_id, regexp_replace(CASE WHEN length(a) > 500 THEN a WHEN length(m) > 500 THEN m ELSE b END, '^[\\s]+|[\\s]+$', '', 'g') AS text FROM r)
  SELECT page_id, length(text)::INTEGER AS chars, md5(text) AS digest FROM t WHERE length(text) >= 400""")
def q_news(spark, sf):
    return V.read_pages(table(spark, sf, "pages"), "page_id").select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


TITLES = f"t AS (SELECT event_id, user_id, event_type, {_TITLE} AS title FROM (SELECT event_id, user_id, event_type, {_K} AS k FROM {{events}}) x)"


def titles(spark, sf) -> DataFrame:
    return derive(spark, sf, f"WITH {TITLES} SELECT * FROM t")


_T = TITLES.replace("{events}", "events")


@book.query("hazard_of", f"WITH {_T} SELECT event_id, {_HAZ('title')} AS hazard FROM t")
def q_hazard(spark, sf):
    return titles(spark, sf).select("event_id", text.hazard_of(F.col("title")).alias("hazard"))


@book.query("dedup_titles", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM (SELECT doc_id, {_KEYSQL('title')} AS key FROM articles) a WHERE key <> '') b WHERE n = 1", "articles")
def q_dedup_titles(spark, sf):
    return feeds.dedup_titles(fixture(spark, sf, "articles"), "doc_id").select("doc_id")


@book.query("dedup_urls", "SELECT event_id, url, channel FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY channel, event_id) AS n FROM (SELECT event_id, 'https://n/' || (user_id * 10 + event_id % 10) AS url, CAST(event_id % 4 AS INTEGER) AS channel FROM events) a) b WHERE n = 1")
def q_dedup_urls(spark, sf):
    a = table(spark, sf, "events").select("event_id", F.concat(F.lit("https://n/"), (F.col("user_id") * 10 + F.col("event_id") % 10).cast("string")).alias("url"), (F.col("event_id") % 4).cast("int").alias("channel"))
    return feeds.dedup_urls(a, "channel", "event_id")


@book.query("channel_status", """WITH f AS (SELECT event_type AS channel, event_type IN ('click', 'view') AS official, CASE WHEN value > 99 AND event_type <> 'view' OR event_type = 'error' THEN 'OSError: 503' END AS error, user_id AS items FROM events),
  p AS (SELECT channel, official, count(error) = 0 AS ok, sum(CASE WHEN error IS NULL THEN items END)::BIGINT AS items, min(error) AS error FROM f GROUP BY ALL)
  SELECT * FROM p UNION ALL SELECT '(run)', NULL, bool_or(ok AND official), sum(items)::BIGINT, NULL FROM p""")
def q_channels(spark, sf):
    t = F.col("event_type")
    bad = ((F.col("value") > 99) & (t != "view")) | (t == "error")
    f = table(spark, sf, "events").select(t.alias("channel"), t.isin("click", "view").alias("official"), F.when(bad, "OSError: 503").alias("error"), F.col("user_id").alias("items"))
    return feeds.channel_status(f)


@book.query("interleave_hazards", f"""WITH {_T}, h AS (SELECT event_id, {_HAZ('title')} AS hazard FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY hazard ORDER BY event_id) AS round FROM h WHERE hazard IS NOT NULL)
  SELECT event_id, hazard, CAST(round AS INTEGER) AS round, CASE hazard WHEN 'flood' THEN 1 WHEN 'wildfire' THEN 2 ELSE 3 END AS turn FROM n""")
def q_interleave(spark, sf):
    a = titles(spark, sf).select("event_id", text.hazard_of(F.col("title")).alias("hazard")).where("hazard IS NOT NULL")
    return feeds.interleave_hazards(a, ["event_id"])


# ------------------------------------------------------------------------------------------ verification

_SP = text.SPACE.replace("\\u", "\\x{").replace("\\x{00a0", "\\x{00a0}").replace("\\x{1680", "\\x{1680}").replace("\\x{2000-\\x{200a", "\\x{2000}-\\x{200a}").replace("\\x{2028", "\\x{2028}").replace("\\x{2029", "\\x{2029}").replace("\\x{202f", "\\x{202f}").replace("\\x{205f", "\\x{205f}").replace("\\x{3000", "\\x{3000}")
_NORM = lambda s: f"lower(trim(regexp_replace(regexp_replace({s}, '" + text.MARKUP.replace("'", "''") + f"', '', 'g'), '{_SP}', ' ', 'g')))"
WATCH = "More rain is expected to fall in the hills before the weekend"
# Each article with what a reader claimed about it: a real second sentence, an invented quote, a warning.
CLAIMS = f"""SELECT doc_id, outlet, title, pub_date, text || CASE WHEN doc_id % 4 = 0 THEN ' {WATCH}.' ELSE '' END AS text,
  CASE WHEN doc_id % 9 = 0 THEN 'The harbour gates were torn off by the surge' ELSE split_part(text, '. ', 2) || '.' END AS q1,
  '{WATCH}' AS q2, CASE WHEN doc_id % 6 = 0 THEN 'Oslo' ELSE split_part(split_part(text, '. ', 2), ' ', 1) END AS p1, split_part(title, ' ', 1) AS p2,
  CASE doc_id % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'wildfire' WHEN 2 THEN 'vegetation' ELSE 'flood' END AS hazard, doc_id % 7 <> 0 AS has_happened,
  CASE doc_id % 5 WHEN 0 THEN 'next week' WHEN 1 THEN '2019-01-01' ELSE CAST(pub_date - CAST(doc_id % 11 AS INT) AS VARCHAR(10)) || 'T00' END AS start_text, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(pub_date - CAST(doc_id % 4 AS INT) AS VARCHAR(10)) ELSE CAST(pub_date + CAST(1 AS INT) AS VARCHAR(10)) END AS end_text
  FROM ({{articles}}) art""".replace("{{articles}}", "{articles}")


def claims(spark, sf) -> DataFrame:
    df = derive(spark, sf, CLAIMS.replace("{articles}", SQL["articles"]))
    loc = lambda p: F.struct(F.col(p).alias("place"), F.lit("").alias("admin_area"), F.lit("Norland").alias("country"))
    x = F.struct(F.array("q1", "q2").alias("evidence"), F.array(loc("p1"), loc("p2")).alias("locations"), F.col("start_text").alias("start_date"),
                 F.col("end_text").alias("end_date"), F.lit("cellars under water").alias("impact"), "hazard", "has_happened")
    return df.withColumn("x", x)


CL = "cl AS (" + CLAIMS.replace("({articles})", "articles") + f"""),
  nb AS (SELECT *, {_NORM("title || ' ' || text")} AS body, {_NORM('q1')} AS n1, {_NORM('q2')} AS n2, {_NORM('p1')} AS m1, {_NORM('p2')} AS m2 FROM cl),
  ok AS (SELECT *, length(n1) > 20 AND contains(body, regexp_replace(n1, '\\.+$', '')) AS ok1, length(n2) > 20 AND contains(body, n2) AS ok2,
     regexp_matches(q1, '(?i)\\b(watch(es)?|warnings?|forecasts?|risk of|threat of|expected to|outlook|advisor(y|ies))\\b') AS sp1 FROM nb),
  su AS (SELECT *, {_NORM("title || CASE WHEN ok1 AND NOT sp1 THEN ' ' || q1 ELSE '' END")} AS support FROM ok),
  pl AS (SELECT *, p1 <> '' AND contains(support, m1) AS k1, p2 <> '' AND contains(support, m2) AS k2 FROM su),
  vd AS (SELECT *, CASE WHEN hazard = 'none' THEN 'not about a mapped hazard' WHEN NOT has_happened THEN 'not happened (forecast, warning or general story)'
     WHEN NOT ok1 AND NOT ok2 THEN 'quote not in article' WHEN NOT (ok1 AND NOT sp1) THEN 'only forecasts or warnings quoted' WHEN NOT k1 AND NOT k2 THEN 'place not in the evidence' END AS reason,
     CASE WHEN regexp_matches(start_text, '^\\d{{4}}-') AND CAST(substr(start_text, 1, 10) AS DATE) BETWEEN pub_date - 60 AND pub_date + 1 THEN CAST(substr(start_text, 1, 10) AS DATE) ELSE pub_date END AS d0 FROM pl),
  fin AS (SELECT *, greatest(d0, CASE WHEN end_text <> '' AND CAST(end_text AS DATE) BETWEEN d0 AND pub_date + 1 THEN CAST(end_text AS DATE) ELSE pub_date END) AS d1 FROM vd)""".replace("CAST(substr(start_text, 1, 10) AS DATE)", "TRY_CAST(substr(start_text, 1, 10) AS DATE)").replace("CAST(end_text AS DATE)", "TRY_CAST(end_text AS DATE)").replace("TRY_TRY_", "TRY_")


@book.query("norm_text", f"SELECT doc_id, md5({_NORM('text')}) AS digest FROM documents")
def q_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("digest"))


@book.query("verify_quotes", f"WITH {CL} SELECT doc_id, CAST(ok1::INT + ok2::INT AS INTEGER) AS quotes, CASE WHEN ok1 THEN md5(q1) WHEN ok2 THEN md5(q2) END AS first FROM ok", "articles")
def q_quotes(spark, sf):
    v = V.verify(claims(spark, sf))
    return v.select("doc_id", F.size("quotes").alias("quotes"), F.md5(F.get("quotes", F.lit(0))).alias("first"))


@book.query("drop_speculative", f"WITH {CL} SELECT doc_id, CAST((ok1 AND NOT sp1)::INT AS INTEGER) AS facts FROM ok", "articles")
def q_spec(spark, sf):
    return V.verify(claims(spark, sf)).select("doc_id", F.size("facts").alias("facts"))


@book.query("verify_places", f"WITH {CL} SELECT doc_id, CASE WHEN k1 AND k2 THEN p1 || '|' || p2 WHEN k1 THEN p1 WHEN k2 THEN p2 ELSE '' END AS places FROM pl", "articles")
def q_places(spark, sf):
    return V.verify(claims(spark, sf)).select("doc_id", F.array_join(F.transform("places", lambda p: p["place"]), "|").alias("places"))


@book.query("extraction_verdict", f"WITH {CL} SELECT doc_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, reason FROM vd", "articles")
def q_verdict(spark, sf):
    return V.verify(claims(spark, sf)).select("doc_id", "verdict", "reason")


@book.query("clamp_event_dates", f"WITH {CL} SELECT doc_id, d0 AS start_date, d1 AS end_date FROM fin", "articles")
def q_dates(spark, sf):
    a, b = V.clamp_event_dates(F.col("start_text"), F.col("end_text"), F.col("pub_date"))
    return claims(spark, sf).select("doc_id", a.alias("start_date"), b.alias("end_date"))


@book.query("append_run_logs", f"WITH {CL} SELECT doc_id, outlet, title, hazard, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, reason FROM vd", "articles")
def q_log(spark, sf):
    """The log of two passes, appended one after the other and read back."""
    log, path = V.reader_log(V.verify(claims(spark, sf)), ["doc_id", "outlet", "title", "text", "hazard"]), fresh_path(spark, "log")
    for half in (0, 1):
        sinks.append_log(log.where(F.col("doc_id") % 2 == half), path)
    return spark.read.schema("doc_id LONG, outlet STRING, title STRING, hazard STRING, verdict STRING, reason STRING").json(path)


@book.query("reader_log_stats", f"WITH {CL} SELECT hazard, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS verdict, count(*) AS articles FROM vd GROUP BY ALL", "articles")
def q_log_stats(spark, sf):
    return V.reader_log_stats(V.reader_log(V.verify(claims(spark, sf)), ["hazard"]))


# ------------------------------------------------------------------------------------------ geocoding

# Gazetteer answers: each nation is known under "name, region" and "name"; regions answer for themselves, too large.
def gazetteer(spark, sf) -> DataFrame:
    g = fixture(spark, sf, "gazetteer")
    name = F.initcap("name")
    names = F.explode(F.array(F.concat_ws(", ", name, F.initcap("admin_area")), name))
    return g.select(names.alias("query"), F.col("hit_id").alias("hit_rank"), name.alias("name"), "lat", "lon", (F.col("lat") - F.col("half_deg")).alias("s"),
                    (F.col("lat") + F.col("half_deg")).alias("n"), (F.col("lon") - F.col("half_deg")).alias("w"), (F.col("lon") + F.col("half_deg")).alias("e"),
                    "category", "addresstype", "place_rank")


def customer_places(spark, sf) -> DataFrame:
    """Every customer names a place; some only its area, some a place nobody knows."""
    return derive(spark, sf, """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Nowhere' ELSE initcap(n_name) END AS place, CASE c_custkey % 5 WHEN 0 THEN initcap(n_name) WHEN 1 THEN 'Elsewhere' ELSE '' END AS admin_area,
      CASE c_custkey % 3 WHEN 0 THEN '' ELSE initcap(r_name) END AS country FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""")


_CAP = lambda x: f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"
GEO = f"""gz AS (SELECT hit_id, {_CAP('name')} AS name, {_CAP('admin_area')} AS region, lat, lon, half_deg, category, addresstype, place_rank FROM gazetteer),
  gq AS (SELECT name || ', ' || region AS q, gz.* FROM gz UNION ALL SELECT name, gz.* FROM gz),
  mp AS (SELECT * FROM gq WHERE category IN ('place', 'boundary') AND addresstype <> 'state' AND place_rank < 30 AND sqrt(pow(2 * half_deg * 110.6, 2) + pow(2 * half_deg * 111.3 * cos(radians(lat)), 2)) <= 150),
  cu AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Nowhere' ELSE {_CAP('n_name')} END AS place, CASE c_custkey % 5 WHEN 0 THEN {_CAP('n_name')} WHEN 1 THEN 'Elsewhere' ELSE '' END AS admin_area,
     CASE c_custkey % 3 WHEN 0 THEN '' ELSE {_CAP('r_name')} END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  aq AS (SELECT id, 1 AS k, concat_ws(', ', nullif(place, ''), nullif(admin_area, ''), nullif(country, '')) AS q, place AS asked FROM cu WHERE place <> ''
    UNION ALL SELECT id, 2, concat_ws(', ', nullif(place, ''), nullif(country, '')), place FROM cu WHERE place <> '' UNION ALL SELECT id, 3, concat_ws(', ', nullif(admin_area, ''), nullif(country, '')), admin_area FROM cu WHERE admin_area <> ''),
  hi AS (SELECT aq.id, mp.lon, mp.lat, mp.name AS label, mp.lon - mp.half_deg AS w, row_number() OVER (PARTITION BY aq.id ORDER BY aq.k, mp.hit_id) AS n FROM aq JOIN mp ON mp.q = aq.q AND mp.name = aq.asked)"""


@book.query("geocode_join", f"WITH {GEO} SELECT id, lon, lat, label, {r6('w')} FROM hi WHERE n = 1", "gazetteer")
def q_geocode(spark, sf):
    g = V.geocode(customer_places(spark, sf), gazetteer(spark, sf), ["id"])
    return rounded(g.select("id", "lon", "lat", "label", F.col("bbox.w").alias("w")))


@book.query("place_candidates", f"""WITH {GEO} SELECT cu.id, CASE cu.id % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' ELSE 'vegetation' END AS hazard, hi.lon, hi.lat, concat_ws(', ', place, nullif(admin_area, '')) AS place, country, DATE '2024-01-10' AS start_date,
  CASE WHEN hi.id IS NULL THEN 'could not place ''' || place || ''' precisely' END AS reason FROM cu LEFT JOIN hi ON hi.id = cu.id AND n = 1""", "gazetteer")
def q_place_candidates(spark, sf):
    p = customer_places(spark, sf)
    d = F.lit("2024-01-10").cast("date")
    hazard = F.element_at(F.array(*[F.lit(t) for t in K.TASKS]), (F.col("id") % 3 + 1).cast("int"))
    v = p.select("id", F.lit("accepted").alias("verdict"), F.array(F.struct("place", "admin_area", "country")).alias("places"), d.alias("start_date"), d.alias("end_date"), F.lit("o").alias("outlet"), F.lit("t").alias("title"),
                 F.array(F.lit("quote")).alias("facts"), F.struct(hazard.alias("hazard"), F.lit("impact").alias("impact")).alias("x"))
    return V.place_candidates(v, gazetteer(spark, sf), "id").select("id", "hazard", "lon", "lat", "place", "country", "start_date", "reason")


# ------------------------------------------------------------------------------------------ merging

def candidates(spark, sf) -> DataFrame:
    h = F.col("half_deg")
    box = F.struct((F.col("lon") - h).alias("w"), (F.col("lat") - h).alias("s"), (F.col("lon") + h).alias("e"), (F.col("lat") + h).alias("n"))
    return fixture(spark, sf, "candidates").withColumn("bbox", F.when(h.isNotNull(), box))


# Known cases: one per supplier.
KNOWN = """SELECT s_suppkey AS case_ord, CASE s_suppkey % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' ELSE 'vegetation' END AS hazard, 3e0 + (s_suppkey % 12) * 0.4e0 AS lon, 43e0 + (s_nationkey % 20) * 0.1e0 AS lat, DATE '2024-01-01' + CAST(s_suppkey % 30 AS INT) AS event_start FROM {supplier}"""


@book.query("merge_pairs", f"""WITH kn AS ({KNOWN.replace('{supplier}', 'supplier')}) SELECT c.seq, min(kn.case_ord) AS case_ord FROM candidates c LEFT JOIN kn ON kn.hazard = c.hazard AND abs(kn.event_start - c.start_date) <= 10
  AND 2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(c.lat - kn.lat) / 2), 2) + cos(radians(kn.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - kn.lon) / 2), 2))) <= 50 GROUP BY c.seq""", "candidates")
def q_pairs(spark, sf):
    """The first known case each report belongs to."""
    return MG.first_case(candidates(spark, sf), derive(spark, sf, KNOWN))


def merged(spark, sf):
    return MG.merge_candidates(candidates(spark, sf), today())


@book.query("merge_candidates")
def q_merge(spark, sf):
    return flat(merged(spark, sf)[0]).drop("pos")


@book.query("cluster_events", """WITH RECURSIVE p AS (SELECT hazard, lon, lat, start_date, min(seq) AS id FROM spread_reports GROUP BY ALL),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.hazard = b.hazard AND a.id <> b.id AND abs(a.start_date - b.start_date) <= 10
  WHERE 2 * 6371.0088e0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) <= 50),
l(id, cluster) USING KEY (id) AS (SELECT id, id FROM p UNION SELECT e.b, min(l.cluster) FROM l JOIN e ON e.a = l.id JOIN recurring.l o ON o.id = e.b WHERE l.cluster < o.cluster GROUP BY e.b)
SELECT seq, r.hazard, cluster FROM spread_reports r JOIN p ON p.hazard = r.hazard AND p.lon = r.lon AND p.lat = r.lat AND p.start_date = r.start_date JOIN l ON l.id = p.id""", "spread_reports")
def q_clusters(spark, sf):
    return clusters.cluster_events(fixture(spark, sf, "spread_reports"))


# Sources of a case when a case is a hazard and start day.
_CASEKEY = "hazard || '-' || CAST(start_date AS VARCHAR(10))"


def day_sources(spark, sf) -> DataFrame:
    return candidates(spark, sf).withColumn("id", F.concat_ws("-", "hazard", F.col("start_date").cast("string")))


@book.query("source_dedup", f"SELECT id, seq, kind, source_id, url FROM (SELECT *, {_CASEKEY} AS id, row_number() OVER (PARTITION BY hazard, start_date, kind, coalesce(source_id, url) ORDER BY seq) AS n FROM candidates) x WHERE n = 1", "candidates")
def q_source_dedup(spark, sf):
    s = day_sources(spark, sf).select("id", "seq", "kind", "source_id", "url")
    return MG.source_dedup(s, ["id"], "seq")


_PRIO = "CASE kind WHEN 'cems' THEN 0 WHEN 'gdacs' THEN 1 WHEN 'eonet' THEN 2 ELSE 3 END"


@book.query("geometry_priority", f"SELECT id, lon, lat, kind AS geometry_from FROM (SELECT *, {_CASEKEY} AS id, row_number() OVER (PARTITION BY hazard, start_date ORDER BY {_PRIO}, seq) AS n FROM candidates) x WHERE n = 1", "candidates")
def q_geometry(spark, sf):
    return MG.geometry_priority(day_sources(spark, sf), ["id"], "seq")


# ------------------------------------------------------------------------------------------ cases

_WIN = f"""wi AS (SELECT *, CASE hazard WHEN 'flood' THEN greatest(start_date, end_date - 10) WHEN 'wildfire' THEN CASE WHEN end_date >= DATE '{TODAY}' - 2 THEN greatest(start_date + 2, DATE '{TODAY}' - 30) ELSE end_date + 1 END ELSE start_date - 60 END AS a0 FROM candidates),
  wj AS (SELECT *, CASE hazard WHEN 'flood' THEN least(a0 + 14, DATE '{TODAY}') WHEN 'wildfire' THEN least(a0 + 40, DATE '{TODAY}') ELSE least(start_date, DATE '{TODAY}') END AS a1 FROM wi),
  wk AS (SELECT *, CASE hazard WHEN 'flood' THEN start_date - 35 WHEN 'wildfire' THEN start_date - 40 ELSE a0 - 365 END AS b0, CASE hazard WHEN 'flood' THEN start_date - 5 WHEN 'wildfire' THEN start_date - 2 ELSE a1 - 365 END AS b1, a0 <= a1 AS ok FROM wj)"""


def case_rows(spark, sf) -> DataFrame:
    """Every candidate as a case of its own."""
    return candidates(spark, sf).select(F.col("seq").alias("id"), "hazard", "lon", "lat", "bbox", F.col("start_date").alias("event_start"), F.col("end_date").alias("event_end"), "place", "country")


@book.query("case_windows", f"WITH {_WIN} SELECT seq AS id, CASE WHEN ok THEN b0 END AS before_start, CASE WHEN ok THEN b1 END AS before_end, CASE WHEN ok THEN a0 END AS after_start, CASE WHEN ok THEN a1 END AS after_end FROM wk", "candidates")
def q_windows(spark, sf):
    return C.case_windows(case_rows(spark, sf), today()).select("id", "before_start", "before_end", "after_start", "after_end")


_HOLD = lambda v: f"least(greatest({v}, 5e0), 30e0)"
_AREA = f"""ar AS (SELECT *, half_deg * 2 * 111.32e0 * cos(radians(lat)) AS wk_, half_deg * 2 * 110.574e0 AS hk_ FROM wk),
  bx AS (SELECT *, CASE WHEN half_deg IS NULL THEN 15e0 ELSE {_HOLD('wk_')} END AS bw, CASE WHEN half_deg IS NULL THEN 15e0 ELSE {_HOLD('hk_')} END AS bh FROM ar)"""


@book.query("plan_case", f"""WITH {_WIN}, {_AREA} SELECT seq AS id, hazard AS task, CASE hazard WHEN 'flood' THEN 'Flood' WHEN 'wildfire' THEN 'Wildfire' ELSE 'Forest loss' END || ' · ' || CASE WHEN place = '' AND country = '' THEN 'unknown place' ELSE concat_ws(', ', nullif(place, ''), nullif(country, '')) END || ' (' || start_date || ')' AS title,
  CASE WHEN NOT ok THEN 'too recent' END AS status, {r6('lon - bw / 2 / (111.32e0 * cos(radians(lat))) AS w', 'lat + bh / 2 / 110.574e0 AS n', digits=5)}, CASE WHEN ok THEN abs(km - bw * bh) / (bw * bh) < 0.02 END AS area_ok, NULL::VARCHAR AS error FROM (SELECT *, bw * bh AS km FROM bx) z""", "candidates")
def q_plan(spark, sf):
    p = C.plan_case(case_rows(spark, sf), today())
    side = lambda lo, hi, k: (F.col(f"aoi_{hi}") - F.col(f"aoi_{lo}")) * k
    km2 = side("w", "e", 111.32 * F.cos(F.radians((F.col("aoi_s") + F.col("aoi_n")) / 2))) * side("s", "n", 110.574)
    return rounded(p.select("id", "task", "title", "status", F.col("aoi_w").alias("w"), F.col("aoi_n").alias("n"), (F.abs(F.col("aoi_km2") - km2) / km2 < 0.02).alias("area_ok"), "error"), 5)


@book.query("score_case", f"""SELECT id, round(v, 2) AS score, CASE WHEN round(v, 2) >= 0.6e0 THEN 'high' WHEN round(v, 2) >= 0.35e0 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT id, CASE WHEN bool_or(kind = 'cems') THEN 0.5e0 ELSE 0e0 END + CASE WHEN bool_or(kind IN ('gdacs', 'eonet')) THEN 0.35e0 ELSE 0e0 END
  + least(0.45e0, 0.15e0 * count(DISTINCT CASE WHEN kind = 'news' THEN coalesce(outlet, '') END)) AS v FROM (SELECT hazard || '-' || (seq % 997) AS id, kind, outlet FROM candidates) a GROUP BY id) b""", "candidates")
def q_score(spark, sf):
    s = candidates(spark, sf).select(F.concat(F.col("hazard"), F.lit("-"), (F.col("seq") % 997).cast("string")).alias("id"), "kind", "outlet")
    return C.score_case(s, ["id"])


_CASES = """cs AS (SELECT seq AS id, start_date AS event_start, hazard, CASE seq % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'partial imagery' WHEN 2 THEN 'waiting for imagery' ELSE 'too recent' END AS status, round((seq % 20) * 0.05e0, 2) AS score, seq % 6 AS n_sources,
  CASE WHEN seq % 3 = 0 THEN start_date + 5 END AS updated, start_date AS first_seen, place, country FROM candidates), old AS (SELECT id, (id % 5) AS n_sources FROM cs WHERE status <> 'too recent')"""


def listed(spark, sf) -> DataFrame:
    seq = F.col("seq")
    status = F.element_at(F.array(*[F.lit(s) for s in K.CASE_STATUS_ORDER]), (seq % 4 + 1).cast("int"))
    return candidates(spark, sf).select(
        seq.alias("id"), F.col("start_date").alias("event_start"), "hazard", status.alias("status"), F.round((seq % 20) * 0.05, 2).alias("score"), (seq % 6).alias("n_sources"),
        F.when(seq % 3 == 0, F.date_add("start_date", 5)).alias("updated"), F.col("start_date").alias("first_seen"), "place", "country")


def earlier(spark, sf) -> DataFrame:
    return listed(spark, sf).where("status <> 'too recent'").select("id", (F.col("id") % 5).alias("n_sources"))


@book.query("retain_cases", f"WITH {_CASES} SELECT id FROM cs WHERE coalesce(updated, first_seen) >= DATE '2024-02-25' - 45", "candidates")
def q_retain(spark, sf):
    return C.retain_cases(listed(spark, sf), F.lit("2024-02-25").cast("date")).select("id")


@book.query("changed_cases", f"WITH {_CASES} SELECT cs.id, cs.status FROM cs LEFT JOIN old ON old.id = cs.id WHERE old.n_sources IS DISTINCT FROM cs.n_sources OR cs.status <> 'ready'", "candidates")
def q_changed(spark, sf):
    return C.changed_cases(listed(spark, sf), earlier(spark, sf)).select("id", "status")


@book.query("new_cases", f"WITH {_CASES} SELECT id FROM cs WHERE id NOT IN (SELECT id FROM old)", "candidates")
def q_new(spark, sf):
    return C.new_cases(listed(spark, sf), earlier(spark, sf)).select("id")


@book.query("rank_cases", f"WITH {_CASES} SELECT id, status, score, event_start FROM cs", "candidates")
def q_rank(spark, sf):
    return C.rank_cases(listed(spark, sf)).select("id", "status", "score", "event_start")


@book.query("combine_cases", f"WITH {_CASES} SELECT id, CASE WHEN status = 'ready' THEN 'local' ELSE 'published' END AS origin, CASE WHEN status = 'ready' THEN 9.5e0 ELSE score END AS score FROM cs", "candidates")
def q_combine(spark, sf):
    pub = listed(spark, sf).select("id", F.lit("published").alias("origin"), "score")
    loc = listed(spark, sf).where("status = 'ready'").select("id", F.lit("local").alias("origin"), F.lit(9.5).alias("score"))
    return C.combine_cases(pub, loc)


@book.query("refresh_saved", f"WITH {_CASES} SELECT id, CASE WHEN status <> 'too recent' THEN (id % 5) ELSE n_sources END AS n_sources FROM cs", "candidates")
def q_refresh(spark, sf):
    return C.refresh_saved(listed(spark, sf).select("id", "n_sources"), earlier(spark, sf))


_SRCNAME = "CASE kind WHEN 'gdacs' THEN 'GDACS alert' WHEN 'cems' THEN 'Copernicus EMS activation' WHEN 'eonet' THEN 'NASA EONET' ELSE '' END"


@book.query("search_cases", f"""WITH {_CASES}, src AS (SELECT (seq // 2) * 2 AS id, lower(concat_ws(' ', outlet, {_SRCNAME})) AS t FROM candidates),
  hit AS (SELECT id, bool_or(contains(t, 'alert')) AS a, bool_or(contains(t, '3')) AS b FROM src GROUP BY id)
  SELECT cs.id FROM cs LEFT JOIN hit USING (id) WHERE hazard = 'wildfire' AND (contains(lower(place || ' ' || country), 'alert') OR coalesce(a, false)) AND (contains(lower(place || ' ' || country), '3') OR coalesce(b, false))""", "candidates")
def q_search_cases(spark, sf):
    cs = listed(spark, sf).withColumn("title", F.lit(""))
    src = candidates(spark, sf).select((F.floor(F.col("seq") / 2) * 2).alias("id"), "kind", "outlet")
    return C.search_cases(cs, src, "Alert 3", "wildfire").select("id")


# ------------------------------------------------------------------------------------------ jobs

_JOB = """jb AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS status, o_orderdate AS created, CASE o_orderkey % 3 WHEN 0 THEN 'flood' WHEN 1 THEN 'wildfire' ELSE 'vegetation' END AS task, o_totalprice / 400 AS aoi_km2 FROM orders)"""


def jobs(spark, sf) -> DataFrame:
    s = F.col("o_orderstatus")
    o = table(spark, sf, "orders")
    task = F.element_at(F.array(*[F.lit(t) for t in K.TASKS]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.when(s == "P", "running").when(s == "F", "failed").otherwise("succeeded").alias("status"), F.col("o_orderdate").alias("created"),
                    F.lit(None).cast("timestamp").alias("finished"), F.lit(None).cast("string").alias("summary"), task.alias("task"), (F.col("o_totalprice") / 400).alias("aoi_km2"))


@book.query("job_listing", f"WITH {_JOB} SELECT id, status, strftime(created, '%Y-%m-%d') AS created, task, {r6('aoi_km2')} FROM jb")
def q_jobs(spark, sf):
    return rounded(J.job_listing(jobs(spark, sf)).select("id", "status", F.date_format("created", "yyyy-MM-dd").alias("created"), "task", "aoi_km2"))


@book.query("job_status_counts", f"WITH {_JOB} SELECT s.status, count(jb.id) AS jobs FROM (VALUES ('queued'), ('running'), ('succeeded'), ('failed'), ('cancelled')) s(status) LEFT JOIN jb USING (status) GROUP BY ALL")
def q_job_counts(spark, sf):
    return J.job_status_counts(jobs(spark, sf))


@book.query("request_counters", f"SELECT method, route, code, count(*) AS requests, {r6('sum(seconds) AS seconds')} FROM access_log GROUP BY ALL", "access_log")
def q_counters(spark, sf):
    return rounded(J.request_counters(fixture(spark, sf, "access_log")))


@book.query("upgrade_job_summary", f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'burn' ELSE 'flood' END AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'burned' ELSE 'flooded' END AS affected_label, {r6('o_totalprice / 100 AS affected_km2')}, CASE WHEN o_orderkey % 2 = 0 THEN 0.7e0 ELSE 0.9e0 END AS mean_confidence_affected FROM orders""")
def q_upgrade(spark, sf):
    new = F.col("o_orderkey") % 2 == 0
    km2 = F.col("o_totalprice") / 100
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(new, "burn").alias("target"), F.when(new, "burned").alias("affected_label"), F.when(new, km2).alias("affected_km2"), F.when(new, 0.7).alias("mean_confidence_affected"),
                                            F.when(~new, km2).alias("flooded_km2"), F.when(~new, 0.9).alias("mean_confidence_flooded"))
    return rounded(J.upgrade_job_summary(old))
