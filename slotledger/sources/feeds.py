"""Parsers of landed JSON payloads: price chunks, the fallback feed, weather by location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.config import LedgerConfig
from slotledger.functions import timecols as t
from slotledger.functions.losses import wind_power

CHUNK_SCHEMA = "series array<array<double>>"
FALLBACK_SCHEMA = "unix_seconds array<bigint>, price array<double>"

# Weather variables, lead times in days, and the tagged locations
# (name, counts for wind, counts for solar); temperature uses every location.
WEATHER_VARIABLES = ("wind_speed_100m", "shortwave_radiation", "temperature_2m")
WEATHER_LEADS = (2, 3)
WEATHER_FEATURES = ("wind_power", "wind_speed", "solar", "temp")
WEATHER_POINTS = (
    ("German Bight (offshore)", True, False),
    ("Husum", True, False),
    ("Emden", True, False),
    ("Rostock", True, False),
    ("Uckermark", True, False),
    ("Magdeburger Boerde", True, True),
    ("Berlin", False, True),
    ("Cologne", False, True),
    ("Frankfurt", False, True),
    ("Leipzig", False, True),
    ("Stuttgart", False, True),
    ("Munich", False, True),
)


def weather_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEATHER_POINTS), "point string, is_wind boolean, is_solar boolean")


def finite(value: Column) -> Column:
    """NULL instead of NaN, so that averages and maxima skip it."""
    return F.when(~F.isnan(value), value)


def parse_price_chunks(chunks: DataFrame) -> DataFrame:
    """``payload`` ``{"series": [[ms, value or null], ...]}`` to known values by slot."""
    parsed = chunks.withColumn("p", F.from_json("payload", CHUNK_SCHEMA))
    rest = [c for c in chunks.columns if c != "payload"]
    pairs = parsed.select(*rest, F.explode("p.series").alias("pair"))
    return pairs.select(
        *rest,
        F.timestamp_millis(F.get("pair", F.lit(0)).cast("bigint")).alias("slot_utc"),
        finite(F.get("pair", F.lit(1))).alias("value"),
    ).filter(F.col("value").isNotNull())


def chunks_for_range(chunks: DataFrame, start_ms: Column, end_ms: Column) -> DataFrame:
    """Only the chunks that can hold values in ``[start, end)``, judged by their start times.

    A chunk reaches up to the start of the next one of its series; the last one is open.
    """
    starts = chunks.select("series_id", "chunk_start_ms").distinct()
    following = F.lead("chunk_start_ms").over(
        Window.partitionBy("series_id").orderBy("chunk_start_ms")
    )
    wanted = starts.withColumn("next_ms", following).filter(
        (F.col("chunk_start_ms") < end_ms)
        & (F.col("next_ms").isNull() | (F.col("next_ms") > start_ms))
    )
    return chunks.join(wanted.drop("next_ms"), ["series_id", "chunk_start_ms"], "left_semi")


def parse_fallback_feed(payloads: DataFrame, cfg: LedgerConfig, first: Column, last: Column) -> DataFrame:
    """Parallel arrays to known values in local days ``first`` to ``last`` inclusive."""
    parsed = payloads.withColumn("p", F.from_json("payload", FALLBACK_SCHEMA))
    rest = [c for c in payloads.columns if c != "payload"]
    zipped = F.arrays_zip(F.col("p.unix_seconds").alias("s"), F.col("p.price").alias("v"))
    rows = parsed.select(*rest, F.inline(zipped).alias("s", "v")).select(
        *rest, F.timestamp_seconds("s").alias("slot_utc"), finite(F.col("v")).alias("value")
    )
    lo, hi = t.day_start(first, cfg.tz), t.day_end(last, cfg.tz)
    return rows.filter(F.col("value").isNotNull() & (F.col("slot_utc") >= lo) & (F.col("slot_utc") < hi))


def weather_schema() -> str:
    fields = ["time: array<string>"] + [
        f"{v}_previous_day{n}: array<double>" for v in WEATHER_VARIABLES for n in WEATHER_LEADS
    ]
    return f"hourly struct<{', '.join(fields)}>"


def aggregate_weather(payloads: DataFrame, points: DataFrame, cfg: LedgerConfig) -> DataFrame:
    """Payloads per location to one row per series, valid hour and lead.

    Radiation is the mean of the preceding hour, so each hour takes the value stamped one hour
    later; that shift happens on the payload's own array, before anything is exchanged. A payload
    may be a chunk of a location's history that carries the one hour after its end; its column
    ``until_utc`` then says where the chunk ends, and hours from there on belong to the next one.
    """
    parsed = payloads.withColumn("h", F.from_json("payload", weather_schema())["hourly"])
    later = lambda arr: F.concat(F.slice(arr, F.lit(2), F.size(arr)), F.array(F.lit(None).cast("double")))

    def lead_cells(n: int) -> Column:
        # a variable the payload lacks counts as unknown at every hour
        nothing = F.array().cast("array<double>")
        wind, solar, temp = (F.coalesce(F.col(f"h.{v}_previous_day{n}"), nothing) for v in WEATHER_VARIABLES)
        cells = F.arrays_zip(
            F.col("h.time").alias("time"), wind.alias("wind"), later(solar).alias("solar"), temp.alias("temp")
        )
        return F.transform(cells, lambda z: F.struct(F.lit(n).alias("lead_days"), z.alias("z")))

    per_lead = [lead_cells(n) for n in WEATHER_LEADS]
    until = F.col("until_utc") if "until_utc" in payloads.columns else F.lit(None).cast("timestamp")
    rows = parsed.select("series_id", "point", until.alias("until"), F.explode(F.concat(*per_lead)).alias("r"))
    rows = rows.filter(F.col("until").isNull() | (F.to_timestamp("r.z.time") < F.col("until"))).join(F.broadcast(points), "point").select(
        "series_id",
        F.to_timestamp("r.z.time").alias("valid_utc"),
        F.col("r.lead_days").alias("lead_days"),
        F.when(F.col("is_wind"), finite(F.col("r.z.wind"))).alias("wind"),
        F.when(F.col("is_solar"), finite(F.col("r.z.solar"))).alias("solar"),
        finite(F.col("r.z.temp")).alias("temp"),
    )
    national = rows.groupBy("series_id", "valid_utc", "lead_days").agg(
        F.avg(wind_power(F.col("wind"))).alias("wind_power"),
        F.avg("wind").alias("wind_speed"),
        F.avg("solar").alias("solar"),
        F.avg("temp").alias("temp"),
    )
    known = F.coalesce(*[F.col(f) for f in WEATHER_FEATURES]).isNotNull()
    return national.filter(known).withColumn("available_at_utc", available_at(cfg))


def available_at(cfg: LedgerConfig) -> Column:
    """Publication time of a lead-time value: model run plus delay."""
    hours = F.col("lead_days") * 24 - cfg.publication_delay_hours
    return F.timestamp_seconds(F.unix_seconds("valid_utc") - hours * 3600)


def availability_log(obs: DataFrame, feeds: DataFrame, probed_at: Column, cfg: LedgerConfig) -> DataFrame:
    """How far each feed reaches at the probe time; a feed without values gets empty text."""
    last = (
        obs.filter(F.col("value").isNotNull() & (F.col("ingested_at") <= probed_at))
        .groupBy("series_id")
        .agg(F.max("slot_utc").alias("last"))
    )
    joined = feeds.join(last, "series_id", "left")
    return joined.select(
        t.utc_text(probed_at).alias("probed_at_utc"),
        "series_id",
        F.coalesce(t.utc_text(F.col("last")), F.lit("")).alias("last_value_start_utc"),
        F.coalesce(t.local_iso(F.col("last"), cfg.tz), F.lit("")).alias("last_value_start_local"),
    )
