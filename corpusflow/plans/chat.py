"""Answers to questions by route: directories, documents, weather, or a language model alone.

Each branch is a join of the questions it concerns; a question that a branch cannot answer gets that
branch's fixed reply. What a model writes comes from the caller's function, by batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import weather
from ..operators.lookup import CONTACT_STOPWORDS, PLACE_STOPWORDS, best_match
from ..operators.routing import Rules, context_blocks, db_intent, route_questions
from ..sources.services import complete
from ..sources.shared import pin

Model = Callable[[list[str]], list[str]]

# Replies without a model, and what an answer is called.
NO_INTENT = "정확한 DB 정보가 필요한 질문으로 판단되지만, 어떤 DB에서 찾을지 결정하지 못했습니다. 장소 위치나 전화번호처럼 더 구체적으로 질문해 주세요."
NO_SEARCH = "이 질문은 문서 기반 검색(RAG)으로 답해야 하지만, 현재 검색 파이프라인이 연결되어 있지 않습니다."
NO_RESULTS = "관련 문서를 찾지 못했습니다. 질문을 더 구체적으로 입력해 주세요."
NO_MATERIAL = "관련 자료를 찾지 못했습니다."
NO_PHONE = "📞 요청하신 부서의 전화번호를 찾지 못했습니다. 정확한 부서·시설 이름을 입력해주세요."
NO_PLACE = "📍 요청하신 위치를 찾지 못했습니다. 정확한 건물/장소 이름을 포함해서 질문해주세요."
PAST = "과거 날씨는 예보 API가 아니라 과거 관측/기록 API가 필요합니다. 오늘 이후 날짜로 질문해 주세요."
TOO_FAR = f"Open-Meteo 예보는 최대 {weather.MOST_DAYS}일 범위까지만 조회할 수 있습니다. 더 가까운 날짜로 질문해 주세요."
NO_FORECAST = "해당 날짜의 날씨 예보를 찾지 못했습니다. 날짜를 다시 확인해 주세요."
INTENT_NAMES = {"phone": "전화", "map": "지도", "unknown": "DB", "rag": "RAG", "weather": "날씨", "llm": "일반"}
FORECAST_URL = "https://api.open-meteo.com/v1/forecast"
WEATHER_HEAD = "Weather forecast data from Open-Meteo.\nLocation: {0}\nTimezone: Asia/Seoul\nUse only this forecast data. Do not add unsupported weather details."

SOURCE = "array<struct<type:string,title:string,source_url:string,score:double>>"


def _sources(kind: str, title: Column, url: Column | None = None) -> Column:
    none = F.lit(None)
    one = F.struct(F.lit(kind).alias("type"), title.alias("title"), (url if url is not None else none.cast("string")).alias("source_url"), none.cast("double").alias("score"))
    return F.array(one).cast(SOURCE)


def _answered(rows: DataFrame, route: str, intent: str, reply: Column, sources: Column | None = None) -> DataFrame:
    empty = F.array().cast(SOURCE)
    return rows.select(
        "query_id", F.lit(route).alias("route"), F.lit(INTENT_NAMES[intent]).alias("intent"), reply.alias("reply"), (sources if sources is not None else empty).alias("sources")
    )


def prompt(context: Column, question: Column) -> Column:
    return F.concat_ws("\n\n", context, F.concat(F.lit("Question:\n"), question))


def answer_from_directory(asked: DataFrame, contacts: DataFrame, places: DataFrame, titles: tuple[str, str] = ("contacts", "places")) -> DataFrame:
    """`asked` has db_intent; contacts id, name, description, phone; places id, name, description, latitude, longitude."""
    phone = best_match(asked.where("db_intent = 'phone'"), contacts, "text", CONTACT_STOPWORDS).select("query_id", "name", "phone")
    place = best_match(asked.where("db_intent = 'map'"), places, "text", PLACE_STOPWORDS).select("query_id", "name", "latitude", "longitude")
    called = F.concat(F.lit("📞 "), "name", F.lit(" 전화번호는 "), "phone", F.lit(" 입니다."))
    at = F.concat_ws(", ", F.col("latitude").cast("string"), F.col("longitude").cast("string"))
    link = F.concat(F.lit("\n지도: https://www.google.com/maps?q="), F.replace(at, F.lit(" "), F.lit("")))
    shown = F.concat(F.lit("📍 "), "name", F.lit(" 위치입니다. 위도/경도: ("), at, F.lit(")"), link)
    own = lambda i: F.lit(titles[i])
    return reduce(
        DataFrame.unionByName,
        [
            _answered(asked.where("db_intent = 'phone'").select("query_id").join(phone, "query_id", "left"), "relational_db", "phone", F.coalesce(called, F.lit(NO_PHONE)), _sources("relational_db", own(0))),
            _answered(asked.where("db_intent = 'map'").select("query_id").join(place, "query_id", "left"), "relational_db", "map", F.coalesce(shown, F.lit(NO_PLACE)), _sources("relational_db", own(1))),
            _answered(asked.where("db_intent = 'unknown'"), "relational_db", "unknown", F.lit(NO_INTENT), _sources("relational_db", F.lit("relational_db"))),
        ],
    )


def answer_from_documents(asked: DataFrame, results: DataFrame | None, model: Model | None = None, nothing: str = NO_RESULTS) -> DataFrame:
    """`results` are ranked search results of the questions (as of batch_search); None stands for a search that is not connected."""
    if results is None:
        return _answered(asked, "rag", "rag", F.lit(NO_SEARCH))
    own = results.join(asked.select("query_id"), "query_id", "left_semi")
    row = F.struct("rank", F.lit("document").alias("type"), "title", "source_url", F.col("score").cast("double").alias("score"))
    listed = own.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_r"))  # at most 20 of a question
    cited = listed.select("query_id", F.transform("_r", lambda x: F.struct(x["type"].alias("type"), x["title"].alias("title"), x["source_url"].alias("source_url"), x["score"].alias("score"))).cast(SOURCE).alias("_sources"))
    found = asked.join(context_blocks(own).select("query_id", "context"), "query_id").join(cited, "query_id")
    told = complete(found, prompt(F.col("context"), F.col("text")), model)
    missing = asked.join(results.select("query_id"), "query_id", "left_anti")
    return _answered(told, "rag", "rag", F.col("reply"), F.col("_sources")).unionByName(_answered(missing, "rag", "rag", F.lit(nothing)))


def rag_answer(questions: DataFrame, results: DataFrame, top_k: int = 3, model: Model | None = None) -> DataFrame:
    """query_id and reply from the top_k documents alone; without any a fixed reply."""
    told = answer_from_documents(questions.select("query_id", "text"), results.where(F.col("rank") <= top_k), model, NO_MATERIAL)
    return told.select("query_id", "reply")


def answer_from_weather(asked: DataFrame, forecasts: DataFrame, today: Column, model: Model | None = None) -> DataFrame:
    """`forecasts` has location and payload, a forecast document in JSON. Days that it does not have get no forecast."""
    rows = asked.select("query_id", "text", weather.location(F.col("text")).alias("_at"), weather.window(F.col("text"), today).alias("_w"))
    rows = rows.withColumn("_g", weather.guard(F.col("_w.start"), F.col("_w.days"), today))
    met = rows.where("_g.status = 'ok'").join(forecasts.select(F.col("location").alias("_at"), "payload"), "_at", "left")
    days = weather.daily_rows(met.select("query_id", "payload", F.col("_w.start").alias("_from"), F.col("_g.days").alias("_n")), "payload", F.col("_from"), F.col("_n"))
    said = F.concat(
        F.lit("- "), "date", F.lit(": "), "weather", F.lit(", min "), F.col("temperature_min").cast("string"), F.lit("°C, max "), F.col("temperature_max").cast("string"), F.lit("°C, precipitation probability "),
        F.col("precipitation_probability").cast("string"), F.lit("%, precipitation "), F.col("precipitation_sum").cast("string"), F.lit("mm, max wind "), F.col("wind_speed_max").cast("string"), F.lit("km/h"),
    )
    lines = days.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", said.alias("said")))), lambda x: x["said"]), "\n").alias("_days"))
    head = F.replace(F.lit(WEATHER_HEAD), F.lit("{0}"), F.col("_at"))
    joined = rows.join(lines, "query_id", "left").withColumn("context", F.concat_ws("\n", head, "_days"))
    told = complete(joined.where("_days is not null"), prompt(F.col("context"), F.col("text")), model)
    fixed = F.when(F.col("_g.status") == "past", PAST).when(F.col("_g.status") == "too_far", TOO_FAR).otherwise(NO_FORECAST)
    title = _sources("weather_api", F.concat(F.lit("Open-Meteo forecast: "), "_at"), F.lit(FORECAST_URL))
    return _answered(told, "weather", "weather", F.col("reply"), title).unionByName(_answered(joined.where("_days is null"), "weather", "weather", fixed, title))


def answer_chat(
    questions: DataFrame, contacts: DataFrame, places: DataFrame, results: DataFrame | None, forecasts: DataFrame, today: Column,
    rules: Rules | None = None, model: Model | None = None, decided: DataFrame | None = None,
) -> DataFrame:
    """One row per question (query_id, text): route, intent, reply and sources.

    The rules decide the route, unless `decided` (query_id, route, db_intent) has a model's decision. A question for a
    directory whose intent that leaves open is judged again by its words, and only then gets the fixed reply.
    """
    routed = route_questions(questions.select("query_id", "text"), "text", rules)
    if decided is not None:
        given = decided.select("query_id", F.col("route").alias("_route"), F.col("db_intent").alias("_intent"))
        routed = routed.join(given, "query_id", "left").select(
            "query_id", "text", F.coalesce("_route", "route").alias("route"), F.when(F.col("_route").isNotNull(), F.coalesce("_intent", F.lit("unknown"))).otherwise(F.col("db_intent")).alias("db_intent")
        )
    again = F.when((F.col("route") == "relational_db") & (F.col("db_intent") == "unknown"), db_intent(F.col("text"), rules)).otherwise(F.col("db_intent"))
    routed = pin(routed.select("query_id", "text", "route", again.alias("db_intent")))
    of = lambda route: routed.where(F.col("route") == route)
    plain = complete(of("llm"), F.col("text"), model)
    return reduce(
        DataFrame.unionByName,
        [
            answer_from_directory(of("relational_db"), contacts, places), answer_from_documents(of("rag"), results, model),
            answer_from_weather(of("weather"), forecasts, today, model), _answered(plain, "llm", "llm", F.col("reply")),
        ],
    )
