"""Rule-based routing of questions, and assembly of answers' context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, count_of, squash

# Words that route a question, tested in this order.
WEATHER = ("날씨", "기온", "강수", "비 와", "비가", "비올", "눈 와", "더워", "추워", "예보")
PHONE = ("전화", "전화번호", "연락처", "문의처", "사무실 번호", "행정실 번호")
MAP = (
    "어디", "위치", "찾아가", "가는 길", "어떻게 가", "길찾기", "캠퍼스맵", "강의실", "도서관", "학생회관", "공학관", "복지관", "박물관", "정문", "후문",
)
# Topics of questions that documents answer; among equal counts the higher priority, then the first, wins.
TOPICS = {
    "academic_schedule": (
        "학사일정", "학사 일정", "수강신청", "수강 정정", "수강취소", "등록 기간", "휴학", "복학", "개강", "종강", "시험 기간", "성적 확인", "성적 공시",
    ),
    "graduation_requirements": (
        "졸업", "졸업요건", "졸업 요건", "졸업학점", "졸업 학점", "전공 학점", "교양 학점", "이수 학점", "필수 이수", "졸업인증",
    ),
    "university_notices": (
        "공지", "공지사항", "학교 공지", "전체 공지", "안내", "모집", "선발", "신청", "접수", "제출", "대상자", "자격", "기간", "결과 발표",
    ),
    "scholarship_support": (
        "장학", "장학금", "국가장학금", "교내장학", "성적향상장학금", "학자금", "등록금", "수혜", "중복 수혜", "신청 불가",
    ),
    "materials": (
        "자료실", "자료", "첨부파일", "첨부 파일", "양식", "서식", "신청서", "제출서류", "제출 서류", "pdf", "hwp", "hwpx", "docx",
    ),
    "student_life": ("학생생활", "학생 생활", "학생증", "동아리", "상담", "통학", "셔틀", "기숙사", "복지"),
    "career_support": ("취업", "진로", "커리어", "현장실습", "인턴", "채용", "비교과", "취업지원"),
    "department_sources": (
        "학과", "전공", "단과대", "대학 공지", "학과 공지", "전공 공지",
    ),
}
PRIORITY = {
    "academic_schedule": 3, "graduation_requirements": 3, "scholarship_support": 3, "materials": 3, "student_life": 3, "career_support": 3,
    "department_sources": 2, "university_notices": 1,
}
# Words that force a topic, tested in this order before the counts.
FORCED = {
    "scholarship_support": ("장학", "장학금", "국가장학금", "성적향상장학금"),
    "graduation_requirements": ("졸업", "졸업요건", "졸업학점"),
    "materials": ("자료실", "첨부파일", "첨부 파일", "양식", "서식", "신청서"),
    "academic_schedule": ("학사일정", "수강신청", "휴학", "복학", "개강", "종강"),
    "career_support": ("취업", "진로", "현장실습", "인턴", "채용"),
    "student_life": ("학생생활", "학생증", "동아리", "기숙사", "셔틀"),
}
ROUTES, INTENTS = ("llm", "relational_db", "rag", "weather"), ("map", "phone", "unknown")
# Words of the three-way intent rule.
INTENT_PHONE = ("전화번호", "전화", "연락처", "문의", "번호")
INTENT_MAP = (
    "어디", "위치", "찾아", "가는 길", "어딨", "어딨어", "위치 알려", "도서관", "학생회관", "강의동", "공학관", "정문", "후문", "복지관", "박물관",
)


class Rules:
    """Word lists of a deployment; the defaults are those above, without names of departments, which sites add."""

    def __init__(
        self,
        weather: tuple[str, ...] = WEATHER,
        phone: tuple[str, ...] = PHONE,
        place: tuple[str, ...] = MAP,
        topics: dict[str, tuple[str, ...]] = TOPICS,
        priority: dict[str, int] = PRIORITY,
        forced: dict[str, tuple[str, ...]] = FORCED,
    ) -> None:
        self.weather, self.phone, self.place, self.topics, self.priority, self.forced = weather, phone, place, topics, priority, forced


def normalize_question(c: Column) -> Column:
    return squash(F.lower(c))


def topic(question: Column, rules: Rules) -> Column:
    """Topic of a normalised question: forced, else the most words; null without any."""
    found = F.lit(None).cast("string")
    for name, kws in reversed(rules.forced.items()):
        found = F.when(contains_any(question, kws), name).otherwise(found)
    scored = [
        F.struct(count_of(question, kws).alias("n"), F.lit(rules.priority.get(name, 0)).alias("p"), F.lit(-i).alias("i"), F.lit(name).alias("name"))
        for i, (name, kws) in enumerate(rules.topics.items())
    ]
    best = F.array_max(F.array(*scored))
    return F.coalesce(found, F.when(best["n"] > 0, best["name"]))


def decide(question: Column, rules: Rules | None = None) -> Column:
    """struct<route, db_intent, reason> of a question."""
    rules, q = rules or Rules(), normalize_question(question)
    make = lambda route, intent, reason: F.struct(F.lit(route).alias("route"), F.lit(intent).alias("db_intent"), reason.alias("reason"))
    about = topic(q, rules)
    return (
        F.when(contains_any(q, rules.weather), make("weather", "unknown", F.lit("weather keyword")))
        .when(contains_any(q, rules.phone), make("relational_db", "phone", F.lit("phone keyword")))
        .when(contains_any(q, rules.place), make("relational_db", "map", F.lit("map keyword")))
        .when(about.isNotNull(), make("rag", "unknown", F.concat(F.lit("rag keyword: "), about)))
        .otherwise(make("llm", "unknown", F.lit("default")))
    )


def parse_decision(raw: Column, question: Column, rules: Rules | None = None) -> Column:
    """A model's answer as a decision: the outermost {...} as JSON; anything unusable falls back to the rules."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    json = F.from_json(body, "route string, db_intent string, reason string")
    usable = F.coalesce(json["route"].isin(*ROUTES), F.lit(False))
    intent = F.when(json["db_intent"].isin(*INTENTS), json["db_intent"]).otherwise("unknown")
    own = F.struct(json["route"].alias("route"), intent.alias("db_intent"), F.coalesce(json["reason"], F.lit("")).alias("reason"))
    return F.when(usable, own).otherwise(decide(question, rules))


def db_intent(question: Column, rules: Rules | None = None) -> Column:
    rules, q = rules or Rules(), normalize_question(question)
    return F.when(contains_any(q, rules.phone), "phone").when(contains_any(q, rules.place), "map").otherwise("unknown")


def classify_intent(question: Column) -> Column:
    """phone, map or general (where a model would be asked)."""
    return F.when(contains_any(question, INTENT_PHONE), "phone").when(contains_any(question, INTENT_MAP), "map").otherwise("general")


def route_questions(questions: DataFrame, text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """Adds route, db_intent and reason."""
    return questions.withColumn("_d", decide(F.col(text_col), rules)).select(*questions.columns, "_d.route", "_d.db_intent", "_d.reason")


def context_blocks(results: DataFrame) -> DataFrame:
    """Per query: the numbered context of its ranked results, and its sources, each URL once in order.

    The first row of a URL is found by grouping, so lists of any length are gone through once.
    """
    row = F.struct("rank", "title", "source_url", "score", "text")
    by_url = results.groupBy("query_id", "source_url").agg(F.collect_list(row).alias("r"), F.min(row).alias("first"))
    listed = by_url.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"), F.array_sort(F.collect_list("first")).alias("first"))
    block = lambda x: F.concat_ws(
        "\n", F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["title"]), F.concat(F.lit("source_url: "), x["source_url"]),
        F.concat(F.lit("score: "), F.format_string("%.6f", x["score"])), x["text"],
    )
    return listed.select(
        "query_id",
        F.array_join(F.transform("r", block), "\n\n").alias("context"),
        F.array_join(F.transform("first", lambda x: F.concat(F.lit("- "), x["title"], F.lit(": "), x["source_url"])), "\n").alias("sources"),
    )


def answer_batch(
    questions: DataFrame, contacts: DataFrame, places: DataFrame, search_results: DataFrame, rules: Rules | None = None
) -> DataFrame:
    """query_id, route, reply or context for each question (query_id, text), by route.

    Replies that a language model or the weather service would write are left to the caller: the
    row then carries the context, null where there is none.
    """
    from .lookup import CONTACT_STOPWORDS, PLACE_STOPWORDS, best_match

    routed = route_questions(questions, "text", rules)
    branches = []
    for intent, table, value, stop in (("phone", contacts, "phone", CONTACT_STOPWORDS), ("map", places, "location", PLACE_STOPWORDS)):
        asked = routed.where((F.col("route") == "relational_db") & (F.col("db_intent") == intent))
        found = best_match(asked, table, "text", stop).select("query_id", "name", value)
        branches.append(asked.join(found, "query_id", "left").select("query_id", "route", F.concat_ws(": ", "name", value).alias("reply"), F.lit(None).cast("string").alias("context")))
    asked = routed.where(F.col("route") == "rag")
    context = context_blocks(search_results.join(asked.select("query_id"), "query_id", "left_semi"))
    branches.append(asked.join(context, "query_id", "left").select("query_id", "route", F.lit(None).cast("string").alias("reply"), "context"))
    rest = routed.where(F.col("route").isin("llm", "weather"))
    none = F.lit(None).cast("string")
    branches.append(rest.select("query_id", "route", none.alias("reply"), none.alias("context")))
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
