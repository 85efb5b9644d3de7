"""Chat answers branch by branch."""

import json

import pytest
from pyspark.sql import functions as F

from corpusflow.operators.routing import Rules
from corpusflow.plans import chat

RULES = Rules(weather=("날씨",), phone=("전화",), place=("어디",), topics={"t": ("장학",)}, priority={"t": 1}, forced={})
PLACE = "id long, name string, description string, phone string, latitude double, longitude double"


@pytest.fixture(scope="module")
def told(spark):
    daily = {"time": ["2025-06-01", "2025-06-02"], "weather_code": [0, 61], "temperature_2m_max": [20.5, 18.0], "temperature_2m_min": [10.0, 9.0], "precipitation_probability_max": [5, 80], "precipitation_sum": [0.0, 4.2], "wind_speed_10m_max": [3.5, 6.0]}
    asked = [
        (1, "도서관 전화번호 알려줘"), (2, "체육관 어디야"), (3, "없는곳 전화"), (4, "장학 안내"), (5, "장학 또"), (6, "수원 날씨"), (7, "2025-05-01 날씨"), (8, "2025-12-01 날씨"), (9, "부산 날씨"), (10, "hello"),
        (11, "도서관 전화"), (12, "아무거나"), (13, None), (14, "내일 날씨"),
    ]
    questions = spark.createDataFrame(asked, "query_id int, text string")
    people = spark.createDataFrame([(1, "중앙도서관", "책", "031-1", 37.5, 127.25), (2, "체육관", "운동", "031-2", 1.0, 2.0)], PLACE)
    results = spark.createDataFrame([(4, 2, "B", "u2", 0.5, "second"), (4, 1, "A", "u1", 0.75, "first")], "query_id int, rank int, title string, source_url string, score double, text string")
    forecasts = spark.createDataFrame([("수원", json.dumps({"daily": daily}))], "location string, payload string")
    decided = spark.createDataFrame([(11, "relational_db", "unknown"), (12, "relational_db", None)], "query_id int, route string, db_intent string")
    model = lambda prompts: [f"<{p}>" for p in prompts]
    rows = chat.answer_chat(questions, people, people, results, forecasts, F.lit("2025-06-01").cast("date"), RULES, model, decided).collect()
    assert len(rows) == len(asked)
    return {r["query_id"]: r for r in rows}


def test_directories(told):
    assert (told[1]["reply"], told[1]["intent"], told[1]["route"]) == ("📞 중앙도서관 전화번호는 031-1 입니다.", "전화", "relational_db")
    assert told[2]["reply"] == "📍 체육관 위치입니다. 위도/경도: (1.0, 2.0)\n지도: https://www.google.com/maps?q=1.0,2.0" and told[2]["sources"][0]["title"] == "places"
    assert told[3]["reply"] == chat.NO_PHONE
    assert told[11]["reply"] == told[1]["reply"]  # the model left the intent open, the words tell it
    assert (told[12]["reply"], told[12]["intent"]) == (chat.NO_INTENT, "DB")


def test_documents(spark, told):
    assert told[4]["reply"].startswith("<[1] A\nsource_url: u1") and told[4]["reply"].endswith("Question:\n장학 안내>")
    assert [(s["type"], s["title"], s["source_url"], s["score"]) for s in told[4]["sources"]] == [("document", "A", "u1", 0.75), ("document", "B", "u2", 0.5)]
    assert (told[5]["reply"], told[5]["sources"]) == (chat.NO_RESULTS, [])
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, text string")
    assert {r["reply"] for r in chat.answer_from_documents(asked, None).collect()} == {chat.NO_SEARCH}
    results = spark.createDataFrame([(1, k, f"T{k}", "u", 0.5, "x") for k in (1, 2, 3, 4)], "query_id int, rank int, title string, source_url string, score double, text string")
    got = {r["query_id"]: r["reply"] for r in chat.rag_answer(asked, results, 3, lambda ps: [str(p.count("source_url")) for p in ps]).collect()}
    assert got == {1: "3", 2: chat.NO_MATERIAL}


def test_weather(told):
    assert "Location: 수원" in told[6]["reply"] and "- 2025-06-01: 맑음, min 10.0°C, max 20.5°C, precipitation probability 5%, precipitation 0.0mm, max wind 3.5km/h" in told[6]["reply"]
    assert "2025-06-02" in told[14]["reply"] and "2025-06-01" not in told[14]["reply"]
    assert (told[7]["reply"], told[8]["reply"], told[9]["reply"]) == (chat.PAST, chat.TOO_FAR, chat.NO_FORECAST)
    assert (told[9]["sources"][0]["title"], told[9]["sources"][0]["source_url"]) == ("Open-Meteo forecast: 부산", chat.FORECAST_URL)


def test_model_alone(told):
    assert (told[10]["reply"], told[10]["intent"], told[10]["sources"]) == ("<hello>", "일반", [])
    assert told[13]["route"] == "llm"
