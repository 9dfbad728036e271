"""Alert and news feeds: landed payloads (one JSON or XML text per row) -> candidate and article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import geometry, text
from terradelta.operators.ordinals import ordinals

CANDIDATE = ("hazard", "lon", "lat", "bbox", "start_date", "end_date", "place", "country", "kind", "source_id", "url", "title",
             "date", "detail")


def _code(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _day(s: Column) -> Column:
    return F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")


def _candidate(df: DataFrame, **cols: Column) -> DataFrame:
    cols["lon"], cols["lat"] = F.round(cols["lon"], 5), F.round(cols["lat"], 5)
    return df.select(*[cols[c].alias(c) for c in CANDIDATE])


GDACS = ("features ARRAY<STRUCT<properties: STRUCT<eventid: STRING, name: STRING, description: STRING, alertlevel: STRING, country: STRING, "
         "fromdate: STRING, todate: STRING, severitydata: STRUCT<severity: DOUBLE, severitytext: STRING>, url: STRUCT<report: STRING, geometry: STRING>>, "
         "geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>")


def gdacs_alerts(pages: DataFrame, extents: DataFrame) -> DataFrame:
    """Flood and fire alerts from pages ``(kind, payload)``, kind FL or WF; green fires under 10,000 ha are dropped.

    ``extents(url, bbox)`` comes from :func:`gdacs_extents`.
    """
    f = pages.select("kind", F.explode(F.from_json("payload", GDACS)["features"]).alias("f")).select(
        F.col("kind").alias("code"), "f.properties.*", F.col("f.geometry.coordinates").alias("xy"))
    size = F.coalesce("severitydata.severity", F.lit(0.0))
    minor = (F.col("code") == "WF") & F.coalesce(F.col("alertlevel") == "Green", F.lit(False)) & (size < K.MIN_FIRE_HA)
    f = f.where(~minor).withColumnRenamed("name", "event_name")
    f = f.join(extents.select(F.col("url").alias("extent_url"), "bbox"), F.col("url.geometry") == F.col("extent_url"), "left")
    c = F.col
    return _candidate(
        f, hazard=_code(K.HAZARD_CODES, c("code")), lon=F.get("xy", F.lit(0)), lat=F.get("xy", F.lit(1)), bbox=c("bbox"),
        start_date=_day(c("fromdate")), end_date=_day(c("todate")), place=F.lit(""), country=F.coalesce("country", F.lit("")),
        kind=F.lit("gdacs"), source_id=F.concat("code", "eventid"), url=F.coalesce("url.report", F.lit("")),
        title=F.concat(F.coalesce(F.nullif("event_name", F.lit("")), c("description")), F.lit(" ("), c("alertlevel"), F.lit(" alert)")),
        date=F.substring("fromdate", 1, 10), detail=F.trim(F.coalesce("severitydata.severitytext", F.lit(""))))


def gdacs_extents(payloads: DataFrame) -> DataFrame:
    """(url, bbox) of the affected areas (class Poly_A...) in extent payloads ``(url, payload)``; NULL without any."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<Class: STRING>, geometry: STRUCT<coordinates: STRING>>>"
    feats = F.from_json("payload", schema)["features"]
    hit = F.filter(feats, lambda f: F.coalesce(f["properties"]["Class"].startswith("Poly_A"), F.lit(False)))
    coords = F.concat_ws(" ", F.transform(hit, lambda f: f["geometry"]["coordinates"]))
    return payloads.select("url", coords.alias("coords")).select("url", geometry.bbox_json(F.col("coords")).alias("bbox"))


CEMS_LIST = ("results ARRAY<STRUCT<code: STRING, category: STRING, name: STRING, eventTime: STRING, centroid: STRING, countries: ARRAY<STRING>>>")
CEMS_DETAIL = "results ARRAY<STRUCT<code: STRING, reason: STRING, aois: ARRAY<STRUCT<name: STRING, extent: STRING>>>>"


def cems_activations(lists: DataFrame, details: DataFrame, since: Column) -> DataFrame:
    """Flood and wildfire activations since a date, with the area names and the union of area extents."""
    act = lists.select(F.explode(F.from_json("payload", CEMS_LIST)["results"]).alias("r")).select("r.*")
    act = act.withColumns({"hazard": _code(K.HAZARD_CODES, F.col("category")), "day": _day(F.col("eventTime"))})
    act = act.where(F.col("hazard").isNotNull() & (F.col("day") >= since))
    det = details.select("code", F.get(F.from_json("payload", CEMS_DETAIL)["results"], F.lit(0)).alias("d"))
    c = F.col
    both = act.join(det, "code", "left").withColumns(
        {"point": geometry.bbox_wkt(c("centroid")),
         "bbox": geometry.bbox_wkt(F.concat_ws(" ", F.transform("d.aois", lambda a: a["extent"])))})
    names = F.transform("d.aois", lambda a: a["name"])
    return _candidate(
        both, hazard=c("hazard"), lon=c("point.w"), lat=c("point.s"), bbox=c("bbox"), start_date=c("day"), end_date=c("day"),
        place=F.coalesce(F.array_join(names, ", "), F.lit("")), country=F.coalesce(F.array_join("countries", ", "), F.lit("")),
        kind=F.lit("cems"), source_id=c("code"), url=F.concat(F.lit("https://rapidmapping.emergency.copernicus.eu/"), c("code")),
        title=c("name"), date=F.substring("eventTime", 1, 10), detail=F.coalesce("d.reason", F.lit("")))


EONET = ("events ARRAY<STRUCT<id: STRING, title: STRING, categories: ARRAY<STRUCT<id: STRING>>, sources: ARRAY<STRUCT<url: STRING>>, "
         "geometry: ARRAY<STRUCT<magnitudeValue: STRING, magnitudeUnit: STRING, date: STRING, type: STRING, coordinates: ARRAY<DOUBLE>>>>>")


def eonet_events(payloads: DataFrame) -> DataFrame:
    """Wildfires (at least 1000 acres, no prescribed burns) and floods whose last position is a point."""
    e = payloads.select(F.explode(F.from_json("payload", EONET)["events"]).alias("e")).select("e.*")
    e = e.withColumns({"hazard": _code(K.EONET_CATEGORIES, F.get("categories", F.lit(0))["id"]),
                       "last": F.try_element_at("geometry", F.lit(-1)), "first": F.get("geometry", F.lit(0))})
    acres = F.coalesce(F.col("last.magnitudeValue").try_cast("double"), F.lit(0.0))
    e = e.where(F.col("hazard").isNotNull() & (F.col("last.type") == "Point") & ~F.lower("title").startswith("prescribed")
                & ((F.col("hazard") != "wildfire") | (acres >= K.MIN_FIRE_ACRES)))
    c = F.col
    link = F.concat(F.lit("https://eonet.gsfc.nasa.gov/api/v3/events/"), c("id"))
    size = F.when(acres != 0, c("last.magnitudeValue"))
    return _candidate(
        e, hazard=c("hazard"), lon=F.get("last.coordinates", F.lit(0)), lat=F.get("last.coordinates", F.lit(1)),
        bbox=F.lit(None).cast("struct<w:double,s:double,e:double,n:double>"), start_date=_day(c("first.date")), end_date=_day(c("last.date")),
        place=F.regexp_replace("title", r"^(Wildfire|Flood)s?\s+", ""), country=F.lit(""), kind=F.lit("eonet"), source_id=c("id"),
        url=F.coalesce(F.get("sources", F.lit(0))["url"], link), title=c("title"), date=F.substring("first.date", 1, 10),
        detail=F.trim(F.concat_ws(" ", size, c("last.magnitudeUnit"))))


def dedup_titles(articles: DataFrame, rank: str) -> DataFrame:
    """First article (by ``rank``) per normalised title; titles without a word are dropped. The ranked window keeps one
    row per title and partition before the shuffle, so a title copied everywhere does not fill one task."""
    keyed = articles.withColumn("title_key", text.title_key(F.col("title"))).where("title_key <> ''")
    w = Window.partitionBy("title_key").orderBy(rank)
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "title_key")


GDELT = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING>>"


def gdelt_articles(payloads: DataFrame, rank: str) -> DataFrame:
    """Articles of the news index: hazard from the title, one per normalised title, in fetch order."""
    a = payloads.select(rank, F.posexplode(F.from_json("payload", GDELT)["articles"]).alias("pos", "a")).select(rank, "pos", "a.*")
    seen = F.coalesce("seendate", F.lit(""))
    a = a.select(
        F.struct(rank, "pos").alias("rank"), text.hazard_of(F.coalesce("title", F.lit(""))).alias("hazard"), "url",
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.length(seen) >= 8, F.concat_ws("-", F.substring(seen, 1, 4), F.substring(seen, 5, 2), F.substring(seen, 7, 2))).otherwise("").alias("date"),
        F.coalesce("domain", F.lit("")).alias("outlet"))
    return dedup_titles(a.where("hazard IS NOT NULL"), "rank").drop("rank")


RSS_ITEM = "title STRING, link STRING, pubDate STRING, description STRING"


def rfc822(s: Column) -> Column:
    """Timestamp of an RSS publication date; without a zone it is UTC, NULL when it is no date."""
    bare = F.regexp_replace(F.trim(s), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s*(GMT|UTC|UT|Z)$", " +0000")
    zoned = F.when(zoned.rlike(r"[+-]\d{4}$"), zoned).otherwise(F.concat(zoned, F.lit(" +0000")))
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def rss_items(items: DataFrame, now: Column, hours: int, words: str | None = None) -> DataFrame:
    """Items ``(hazard, item)``, item = the XML of one <item>: recent, http links, optionally matching ``words``.

    Whole files are read with the XML source and rowTag=item; this takes the rows it yields, or item texts.
    """
    if "item" in items.columns:
        items = items.withColumn("x", F.from_xml(F.col("item"), RSS_ITEM)).select("hazard", "x.*")
    title, link = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("link", F.lit("")))
    items = items.withColumn("when", rfc822(F.col("pubDate")))
    keep = link.startswith("http") & (F.col("when") >= now - F.make_dt_interval(hours=F.lit(hours)))
    if words:
        keep = keep & F.concat_ws(" ", title, F.coalesce("description", F.lit(""))).rlike(f"(?i){words}")
    host = F.regexp_replace(F.regexp_extract(link, r"^https?://([^/?#]*)", 1), r"^www\.", "")
    return items.where(keep).select("hazard", link.alias("url"), title.alias("title"),
                                    F.date_format(F.to_utc_timestamp("when", "UTC"), "yyyy-MM-dd").alias("date"), host.alias("outlet"))


def dedup_urls(articles: DataFrame, channel_rank: str, order: str) -> DataFrame:
    """Every url once, from the channel that comes first."""
    w = Window.partitionBy("url").orderBy(channel_rank, order)
    return articles.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def interleave_hazards(articles: DataFrame, order, per_hazard: int | None = None) -> DataFrame:
    """Reading order: one flood, one wildfire, one vegetation story in turn; with ``per_hazard`` at most that many of each.

    There are three hazards, so stories are numbered by a range sort instead of a window over a hazard.
    """
    turn = F.array_position(F.array(*[F.lit(h) for h in K.HAZARD_TURNS]), F.col("hazard")).cast("int")
    ranked = ordinals(articles, order, ["hazard"], "round").withColumn("round", F.col("round").cast("int")).withColumn("turn", turn)
    return ranked if per_hazard is None else ranked.where(F.col("round") <= per_hazard)


def channel_status(fetches: DataFrame) -> DataFrame:
    """Per channel: ok, number of items, first error. The row of channel '(run)' is ok when any official channel is.

    ``fetches(channel, official, error, items)``: one row per fetch.
    """
    per = fetches.groupBy("channel", "official").agg(
        (F.count("error") == 0).alias("ok"), F.sum(F.when(F.col("error").isNull(), F.col("items"))).alias("items"),
        F.min("error").alias("error"))
    run = per.agg(F.lit("(run)").alias("channel"), F.lit(None).cast("boolean").alias("official"),
                  F.coalesce(F.bool_or(F.col("ok") & F.col("official")), F.lit(False)).alias("ok"),
                  F.sum("items").alias("items"), F.lit(None).cast("string").alias("error"))
    return per.unionByName(run)
