"""Checking what a reader extracted from an article, and placing it on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terradelta import constants as K
from terradelta.functions import text

EXTRACTION = ("evidence ARRAY<STRING>, locations ARRAY<STRUCT<place: STRING, admin_area: STRING, country: STRING>>, start_date STRING, "
              "end_date STRING, impact STRING, hazard STRING, has_happened BOOLEAN")


def parse_extraction(raw: Column) -> Column:
    """The reader's JSON answer; an inlined reasoning block in front of it is dropped."""
    return F.from_json(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), EXTRACTION)


def verify_quotes(evidence: Column, body: Column) -> Column:
    """Quotes longer than 20 characters that stand word for word in the normalised ``body`` (final dots ignored)."""
    quotes = F.coalesce(evidence, F.array().cast("array<string>"))
    real = lambda n, b: (F.length(n) > K.MIN_QUOTE_CHARS) & F.contains(b, F.regexp_replace(n, r"\.+$", ""))
    return text.once(body, lambda b: F.filter(quotes, lambda q: text.once(text.norm_text(q), lambda n: real(n, b))))


def drop_speculative(quotes: Column) -> Column:
    return F.filter(quotes, lambda q: ~text.is_speculative(q))


def verify_places(locations: Column, support: Column) -> Column:
    """Locations whose place occurs in the normalised title and factual quotes."""
    def named(loc, support):
        return F.coalesce((loc["place"] != "") & F.contains(support, text.norm_text(loc["place"])), F.lit(False))

    return text.once(support, lambda s: F.filter(locations, lambda loc: named(loc, s)))


def read_pages(pages: DataFrame, *keep: str, min_chars: int = K.MIN_ARTICLE_CHARS) -> DataFrame:
    """``keep`` and the story ``text`` of pages ``(html, ...)`` whose story has at least ``min_chars`` characters.

    The story leaves a generator, so that a filter on it is not moved below and the page read a second time.
    """
    story = F.filter(F.array(text.page_text(F.col("html"))), lambda t: F.length(t) >= min_chars)
    return pages.select(*keep, F.explode(story).alias("text"))


def verify(df: DataFrame) -> DataFrame:
    """Judge extractions ``(title, text, pub_date, x STRUCT)``: adds quotes, facts, places, verdict, reason, dates.

    The whole text is searched; an article and its support are normalised once, however many quotes and places there are.
    """
    df = df.withColumn("quotes", verify_quotes(F.col("x.evidence"), text.norm_text(F.concat_ws(" ", "title", "text"))))
    df = df.withColumn("facts", drop_speculative(F.col("quotes")))
    support = text.norm_text(F.concat_ws(" ", F.concat(F.array("title"), F.col("facts"))))
    df = df.withColumn("places", verify_places(F.col("x.locations"), support))
    reason = (
        F.when(~F.coalesce(F.col("x.hazard").isin(*K.HAZARD_TURNS), F.lit(False)), "not about a mapped hazard")
        .when(~F.coalesce("x.has_happened", F.lit(False)), "not happened (forecast, warning or general story)")
        .when(F.size("quotes") == 0, "quote not in article")
        .when(F.size("facts") == 0, "only forecasts or warnings quoted")
        .when(F.size("places") == 0, "place not in the evidence")
    )
    df = df.withColumn("reason", reason)
    start, end = clamp_event_dates(F.col("x.start_date"), F.col("x.end_date"), F.col("pub_date"))
    return df.withColumns({"verdict": F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"), "start_date": start, "end_date": end})


def clamp_event_dates(start: Column, end: Column, published: Column) -> tuple[Column, Column]:
    """Event dates within 60 days before and 1 day after publication, else the publication date; end is not before start."""
    lo, hi = F.date_sub(published, K.DATE_LOOKBACK_DAYS), F.date_add(published, K.DATE_LOOKAHEAD_DAYS)
    within = lambda d, a, b: F.coalesce(F.when(d.between(a, b), d), published)
    first = within(text.iso_date(start), lo, hi)
    return first, F.greatest(first, within(text.iso_date(end), first, hi))


def _whole_word(name: Column, asked: Column) -> Column:
    return F.regexp_like(asked, F.concat(F.lit(r"\b\Q"), name, F.lit(r"\E\b")))


def mappable(asked: Column) -> Column:
    """Whether a gazetteer hit (columns name, category, addresstype, place_rank, s, n, w, e) is a place called ``asked``."""
    c = F.col
    km = F.hypot((c("n") - c("s")) * 110.6, (c("e") - c("w")) * 111.3 * F.cos(F.radians((c("n") + c("s")) / 2)))
    name = text.plain(F.coalesce("name", F.lit("")))
    ok = (c("category").isin(*K.PLACE_KINDS) & ~F.coalesce(c("addresstype").isin(*K.TOO_VAGUE), F.lit(False))
          & (F.coalesce("place_rank", F.lit(30)) < K.MAX_PLACE_RANK) & (km <= K.MAX_PLACE_KM) & (name != "") & _whole_word(name, text.plain(asked)))
    return F.coalesce(ok, F.lit(False))


def geocode(locations: DataFrame, gazetteer: DataFrame, key: list[str]) -> DataFrame:
    """First mappable gazetteer hit of each location ``key + (place, admin_area, country)``.

    Three questions are tried in turn: place with area and country, place with country, area with country.
    ``gazetteer(query, hit_rank, name, lat, lon, s, n, w, e, category, addresstype, place_rank)`` holds the answers.
    Questions are made distinct and answered once; however often a place is asked for, it meets one answer row.
    """
    c = F.col
    full = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), ", ")
    ask = lambda rank, *parts: F.struct(F.lit(rank).alias("ask_rank"), full(*parts).alias("query"), parts[0].alias("asked"))
    asks = F.filter(F.array(ask(1, c("place"), c("admin_area"), c("country")), ask(2, c("place"), c("country")), ask(3, c("admin_area"), c("country"))),
                    lambda a: F.coalesce(a["asked"], F.lit("")) != "")
    asked = locations.select(*key, F.explode(asks).alias("a")).select(*key, "a.*")
    hits = asked.select("query", "asked").distinct().join(gazetteer, "query").where(mappable(c("asked")))
    w = Window.partitionBy("query", "asked").orderBy("hit_rank")
    answers = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("query", "asked", "lon", "lat", "s", "n", "w", "e", "name")
    found = asked.join(answers, ["query", "asked"])
    best = F.min_by(F.struct("lon", "lat", F.struct("w", "s", "e", "n").alias("bbox"), c("name").alias("label")), "ask_rank")
    return found.groupBy(*key).agg(best.alias("hit")).select(*key, "hit.*")


def place_candidates(verified: DataFrame, gazetteer: DataFrame, key: str) -> DataFrame:
    """Accepted extractions with their first geocodable location as candidates; unplaced ones have NULL coordinates."""
    ok = verified.where("verdict = 'accepted'")
    locs = ok.select(key, F.posexplode("places").alias("pos", "p")).select(key, "pos", "p.*")
    hits = geocode(locs, gazetteer, [key, "pos"])
    first = hits.groupBy(key).agg(F.min_by(F.struct("lon", "lat", "bbox", "label"), "pos").alias("hit"))
    top = F.get("places", F.lit(0))
    where = F.array_join(F.array_distinct(F.filter(F.array(top["place"], top["admin_area"]), lambda p: F.coalesce(p, F.lit("")) != "")), ", ")
    return ok.join(first, key, "left").select(
        key, F.col("x.hazard").alias("hazard"), "hit.lon", "hit.lat", "hit.bbox", "start_date", "end_date", where.alias("place"),
        top["country"].alias("country"), F.lit("news").alias("kind"), "outlet", "title", F.get("facts", F.lit(0)).alias("quote"),
        F.coalesce("x.impact", F.lit("")).alias("detail"),
        F.when(F.col("hit").isNull(), F.concat(F.lit("could not place '"), top["place"], F.lit("' precisely"))).alias("reason"))


def reader_log(verified: DataFrame, columns) -> DataFrame:
    """The log of read articles: links and verdicts, never the article text."""
    return verified.select(*[c for c in columns if c != "text"], "verdict", "reason")


def reader_log_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("hazard", "verdict").agg(F.count("*").alias("articles"))
