"""Forecast windows of questions, and daily forecasts as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DAYS = 16
# Weather codes and their labels; other codes are named by number.
LABELS = {
    0: "맑음", 1: "대체로 맑음", 2: "부분적으로 흐림", 3: "흐림", 45: "안개", 48: "서리 안개", 51: "약한 이슬비", 53: "이슬비", 55: "강한 이슬비",
    61: "약한 비", 63: "비", 65: "강한 비", 71: "약한 눈", 73: "눈", 75: "강한 눈", 80: "약한 소나기", 81: "소나기", 82: "강한 소나기", 95: "뇌우",
    96: "우박을 동반한 뇌우", 99: "강한 우박을 동반한 뇌우",
}
# Words for seven days, the day after tomorrow and tomorrow.
WEEK, AFTER_TOMORROW, TOMORROW = ("이번 주", "주간", "일주일"), "모레", "내일"
# Places with a forecast point; the first one named in a question counts.
LOCATIONS = {
    "수원": (37.2636, 127.0286), "서울": (37.5665, 126.9780), "인천": (37.4563, 126.7052), "부산": (35.1796, 129.0756), "대전": (36.3504, 127.3845),
    "대구": (35.8714, 128.6014), "광주": (35.1595, 126.8526),
}
DAILY = (
    "time array<string>, weather_code array<int>, temperature_2m_max array<double>, temperature_2m_min array<double>,"
    " precipitation_probability_max array<int>, precipitation_sum array<double>, wind_speed_10m_max array<double>"
)


def window(question: Column, today: Column) -> Column:
    """struct<start, days>: an ISO date, a week, or one of the next days; today otherwise."""
    day = F.try_to_timestamp(F.regexp_extract(question, r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b", 1), F.lit("yyyy-MM-dd")).cast("date")
    week = F.lit(False)
    for w in WEEK:
        week = week | question.contains(w)
    make = lambda start, days: F.struct(start.alias("start"), F.lit(days).alias("days"))
    return (
        F.when(day.isNotNull(), make(day, 1)).when(week, make(today, 7)).when(question.contains(AFTER_TOMORROW), make(F.date_add(today, 2), 1))
        .when(question.contains(TOMORROW), make(F.date_add(today, 1), 1)).otherwise(make(today, 1))
    )


def guard(start: Column, days: Column, today: Column) -> Column:
    """struct<status, days>: past and too_far have no forecast; days are cut at the last one there is."""
    offset = F.date_diff(start, today)
    status = F.when(offset < 0, "past").when(offset >= MOST_DAYS, "too_far").otherwise("ok")
    cut = F.least(F.greatest(days, F.lit(1)), F.lit(MOST_DAYS) - offset)
    return F.struct(status.alias("status"), F.when(status == "ok", cut).otherwise(0).cast("int").alias("days"))


def location(question: Column, places: dict[str, tuple[float, float]] = LOCATIONS, default: str = "수원") -> Column:
    out = F.lit(default)
    for name in reversed(places):
        out = F.when(question.contains(name), name).otherwise(out)
    return out


def label(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for item in LABELS.items() for x in item])
    return F.when(code.isNull(), "정보 없음").otherwise(F.coalesce(F.try_element_at(names, code), F.concat(F.lit("날씨 코드 "), code.cast("string"))))


def daily_rows(payloads: DataFrame, json_col: str, start: Column, days: Column) -> DataFrame:
    """One row per day in [start, start + days) of a forecast document; short arrays give nulls."""
    parsed = payloads.withColumn("_d", F.from_json(json_col, f"daily struct<{DAILY.replace(' array', ':array')}>")["daily"])
    fields = [f.split()[0] for f in DAILY.split(", ")]
    rows = parsed.withColumn("_start", start).withColumn("_days", days).withColumn("_r", F.explode(F.arrays_zip(*[F.col(f"_d.{f}").alias(f) for f in fields])))
    day = F.try_to_date(F.col("_r.time"))
    return rows.where((day >= F.col("_start")) & (day < F.date_add("_start", F.col("_days")))).select(
        *[c for c in payloads.columns if c != json_col], F.col("_r.time").alias("date"), label(F.col("_r.weather_code")).alias("weather"),
        F.col("_r.temperature_2m_max").alias("temperature_max"), F.col("_r.temperature_2m_min").alias("temperature_min"),
        F.col("_r.precipitation_probability_max").alias("precipitation_probability"), F.col("_r.precipitation_sum").alias("precipitation_sum"),
        F.col("_r.wind_speed_10m_max").alias("wind_speed_max"),
    )
