"""Weather, parking and published-text observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridewave.functions.clock import wall
from ridewave.operators.joins import require

c = F.col
# Hourly weather variables, and those that accumulate to the ending hour.
VARIABLES = ("temperature_2m", "relative_humidity_2m", "precipitation", "rain", "snowfall", "snow_depth",
             "weather_code", "cloud_cover", "wind_speed_10m", "wind_gusts_10m")
ACCUMULATIONS = ("precipitation", "rain", "snowfall")


def weather_problems(df: DataFrame, start, end, zone: Sequence[str] = ()) -> DataFrame:
    """Repeated hours, hours outside the range and missing hours of a complete hourly grid."""
    keys = [*zone, "date", "hour"]
    day = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    zones = df.select(*zone).distinct() if zone else df.sparkSession.range(1).select()
    grid = zones.select("*", day).select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    label = lambda d, p: d.select(F.lit(p).alias("problem"), *keys)
    return (label(df.groupBy(*keys).count().where("count > 1"), "duplicate_hour")
            .unionByName(label(df.where(~c("date").between(F.lit(start), F.lit(end)) | ~c("hour").between(0, 23)), "outside_range"))
            .unionByName(label(grid.join(df.select(*keys), keys, "left_anti"), "missing_hour")))


def read_weather(df: DataFrame, start, end, zone: Sequence[str] = ()) -> DataFrame:
    """The weather table when its grid is complete; otherwise the run stops."""
    found = weather_problems(df, start, end, zone).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(require(found, c("_n") > 0, "weather hourly grid is incomplete"), how="cross").drop("_n")


def broadcast_to_routes(df: DataFrame, routes: DataFrame) -> DataFrame:
    """A city-wide hourly series repeated for every route; routes are a dimension."""
    return df.join(routes.select("route").distinct(), how="cross")


def align_accumulations(df: DataFrame, columns: Sequence[str], zone: Sequence[str] = ()) -> DataFrame:
    """Accumulations reported at the ending hour move to the hour they fell in.

    The next hour comes by a shifted equi join; a missing next hour leaves NULL.
    """
    moment = c("date").cast("timestamp_ntz") + F.make_dt_interval(hours=c("hour") - 1)
    later = df.select(*zone, F.to_date(moment).alias("date"), F.hour(moment).alias("hour"), *[c(x).alias("_" + x) for x in columns])
    out = df.join(later, [*zone, "date", "hour"], "left")
    return out.select(*[c("_" + x).alias(x) if x in columns else c(x) for x in df.columns])


def read_parking(df: DataFrame, start, cutoff, zone: str) -> DataFrame:
    """Parking snapshots inside a half-open window: local time, quality flags, key checks."""
    inside = df.where((c("time") >= wall(start)) & (c("time") < wall(cutoff)))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), c("time"))
    keyed = require(inside, c("time").isNull() | c("parking_id").isNull(), "missing primary key")
    return keyed.withColumn("local_time", local).withColumn(
        "occupancy_rate_valid", F.coalesce(c("occupancy_rate").between(0, 100), F.lit(False))).withColumn(
        "counts_valid", F.coalesce((c("free_spaces") >= 0) & (c("free_handicapped_spaces") >= 0), F.lit(False)))


def parking_summary(df: DataFrame) -> DataFrame:
    """Lots, instants, hours, invalid rows and lots that never show a free space."""
    lots = df.groupBy("parking_id").agg(F.max("free_spaces").alias("m")).agg(F.count_if(c("m") == 0).alias("always_zero_lots"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("parking_id").alias("lots"), F.count_distinct("time").alias("instants"),
        F.count_distinct(F.to_date("local_time"), F.hour("local_time")).alias("hour_buckets"),
        F.count_if(~c("occupancy_rate_valid")).alias("invalid_rates"), F.count_if(~c("counts_valid")).alias("invalid_counts")).join(
        lots, how="cross")


def parking_months(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_format("local_time", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


# Texts that carry a score, a speed, a notice, a forecast, in the published language.
POST_MARK = '<div class="tgme_widget_message '
AGENCY = "ЦОДД"
SCORE_TEXT = r"(?<![\p{L}\p{N}_])(10|[0-9])\s+балл?[а-я]*"
CURRENT_TEXT = (r"(?iu)(оценивает|оценива[ею]тся|на дорогах сейчас|на дорогах\s*[—–:-]?\s*\d+\s+балл?"
                r"|загруженность.*балл?)")
FORECAST_TEXT = r"(?iu)(?:ожидаем|ожидается|прогноз).*\d+\s+балл"
CLOSURE_TEXT = r"(?iu)перекры|закрыт.*движени|огранич.*движени"
INCIDENT_TEXT = r"(?iu)(?<![\p{L}\p{N}_])ДТП(?![\p{L}\p{N}_])|авари|задержива[ею]тся"


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment: tags out, the common entities in, blanks folded."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _speeds() -> Column:
    """Distinct speeds whose preceding words speak of traffic movement (over ``_pieces``)."""
    before = F.expr("slice(_pieces, 1, greatest(size(_pieces) - 1, 0))")
    return F.array_distinct(F.transform(F.filter(before, lambda p: p.rlike(r"(?<!\d)\d{1,3}\s*$") & _moving(p)),
                                        lambda p: F.regexp_extract(p, r"(\d{1,3})\s*$", 1)))


def _moving(piece: Column) -> Column:
    words = F.lower(F.right(F.regexp_replace(piece, r"\d{1,3}\s*$", ""), F.lit(95)))
    return words.contains("скорость") & (words.contains("движени") | words.contains("поток")) & ~words.contains("ветер")


def extract_traffic_posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Score, speed and notices of each post of a channel page; conflicts and forecasts are NULL."""
    blocks = pages.withColumn("_b", F.explode(F.expr(
        f"slice(split({html}, '{POST_MARK}'), 2, greatest(size(split({html}, '{POST_MARK}')) - 1, 0))")))
    posts = blocks.select(
        *[x for x in pages.columns if x != html],
        F.regexp_extract("_b", r'data-post="([^"]+)"', 1).alias("post"),
        F.regexp_extract("_b", r'<time[^>]+datetime="([^"]+)"', 1).alias("published_at"),
        F.regexp_extract("_b", r'(?s)<div class="tgme_widget_message_text js-message_text"[^>]*>(.*?)</div>', 1).alias("_body"),
        c("_b").rlike(r"\bedited\b").alias("edited"))
    kept = posts.where("post <> '' AND published_at <> '' AND _body <> ''").withColumn("text", plain_text(c("_body")))
    kept = kept.withColumn("_pieces", F.split("text", "км/ч"))
    scores = F.array_distinct(F.regexp_extract_all("text", F.lit(SCORE_TEXT), F.lit(1)))
    rows = kept.withColumn("_scores", scores).withColumn("_speeds", _speeds())
    broken = (~c("text").contains(AGENCY) | (F.size("_scores") > 1) | (F.size("_speeds") > 1) | c("text").rlike(FORECAST_TEXT))
    score = F.when((F.size("_scores") == 1) & c("text").rlike(CURRENT_TEXT), F.get("_scores", F.lit(0)).cast("int"))
    speed = F.when(F.size("_speeds") == 1, F.get("_speeds", F.lit(0)).cast("int"))
    return rows.select(
        *[x for x in pages.columns if x != html], "post", "published_at", "edited",
        F.when(~broken, score).alias("congestion_score"), F.when(~broken, speed).alias("mean_speed_kmh"),
        c("text").rlike(CLOSURE_TEXT).alias("closure_notice"), c("text").rlike(INCIDENT_TEXT).alias("incident_notice"))


# Number words of article titles.
NUMBER_WORDS = {
    "ноль": 0, "ноля": 0, "один": 1, "одного": 1, "два": 2, "двух": 2, "три": 3, "трех": 3, "четыре": 4, "четырех": 4, "пять": 5, "пяти": 5,
    "шесть": 6, "шести": 6, "семь": 7, "семи": 7, "восемь": 8, "восьми": 8, "девять": 9, "девяти": 9, "десять": 10, "десяти": 10}
CITY_TEXT = r"москв|столич|столиц"
SUBURB_TEXT = r"подмосков|област"
TOPIC_TEXT = r"пробк|загруженность|скорость"
VERB_TEXT = (r"(?<![\p{L}])(?:достигли|достигла|достигло|оценивается|составляет|составляют|выросла|выросли|снизилась"
             r"|снизились|увеличилась)(?![\p{L}])")
NOT_CURRENT_TEXT = (r"ожида|прогноз|могут|могли|будут|будет|завтра|вчера|недел|месяц|с начала|в среднем|в центре|на мкад"
                    r"|на участке|подмосков|област|почти|более|менее|не достиг|не превыш|от .* до |утром|ранее")
ARTICLE_SPEED = (r"средняя скорость (?:транспортного потока|движения)(?:[^.!?]{0,100}?)составляет (\d+(?:[.,]\d+)?)\s*км/ч")
CHANGE_TEXT = r"увелич|сниз|выше|ниже"


def _article_scores(text: Column) -> Column:
    number = "(?:10|[0-9]|" + "|".join(NUMBER_WORDS) + ")"
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_-])(" + number + r")\s+балл"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.coalesce(m.try_cast("int"), F.element_at(words, m))))


def extract_traffic_articles(articles: DataFrame, start, end) -> DataFrame:
    """Current city-wide score and speed of news articles (title, body, published_at as local time).

    Articles about suburbs, parts of the city, averages or forecasts give no row.
    """
    fold = lambda x: F.replace(F.lower(x), F.lit("ё"), F.lit("е"))
    rows = articles.withColumn("_t", fold(plain_text(c("title")))).withColumn("_b", fold(plain_text(c("body"))))
    rows = rows.withColumn("_lead", F.get(F.split("_b", r"(?<=[.!?])\s+"), F.lit(0)))
    rows = rows.withColumn("_ts", _article_scores(c("_t"))).withColumn("_ls", _article_scores(c("_lead")))
    day = F.to_date("published_at")
    fit = (day.between(F.lit(start), F.lit(end)) & c("_t").rlike(CITY_TEXT) & ~c("_t").rlike(SUBURB_TEXT) & ~c("_t").rlike(NOT_CURRENT_TEXT)
           & c("_t").rlike(TOPIC_TEXT) & c("_t").rlike(VERB_TEXT) & (F.size("_ts") == 1) & ~c("_lead").rlike(NOT_CURRENT_TEXT)
           & (F.size("_ls") == 1) & (F.get("_ts", F.lit(0)) == F.get("_ls", F.lit(0))))
    sentences = F.filter(F.split("_b", r"(?<=[.!?])\s+"), lambda s: ~s.rlike(NOT_CURRENT_TEXT) & s.contains("в москве") & ~s.rlike(CHANGE_TEXT)
                         & s.rlike(ARTICLE_SPEED))
    speeds = F.filter(F.array_distinct(F.transform(sentences, lambda s: F.replace(
        F.regexp_extract(s, ARTICLE_SPEED, 1), F.lit(","), F.lit(".")).try_cast("double"))), lambda v: (v > 0) & (v <= 100))
    provider = F.when(c("_lead").contains("яндекс"), "yandex").when(c("_lead").contains("цодд"), "codd").otherwise("unspecified")
    return rows.where(fit).withColumn("_v", speeds).select(
        *[x for x in articles.columns if x not in ("title", "body")], F.get("_ts", F.lit(0)).alias("congestion_score"),
        provider.alias("score_provider"), F.when(F.size("_v") == 1, F.get("_v", F.lit(0))).alias("mean_speed_kmh"))
