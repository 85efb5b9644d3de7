"""Fuzzy lookup of places and contacts named in a question, and directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.shared import pin

# What a question about a place, or a phone number, says besides the name.
PLACE_STOPWORDS = (
    "어디있어", "어디있니", "어딨어", "어딨니", "어디야", "어디에", "어디", "어딨", "물어봐", "알려줘", "알려", "찾아줘", "찾아", "위치", "가는길",
    "가는", "길", "좀", "주세요", "주세", "해줘", "해봐", "알아", "뭐야", "뭐지", "있어", "있니", "없어", "없니",
)
CONTACT_STOPWORDS = (
    "전화번호", "연락처", "전화", "번호", "알려줘", "알려", "찾아줘", "찾아", "좀", "주세요", "주세", "해줘", "뭐야", "뭐지", "있어", "있니", "문의",
    "가르쳐", "가르쳐줘", "알고싶", "알고싶어",
)
#: Letters of the sequences that texts are found by.
SEQUENCE = 3


def compact(c: Column) -> Column:
    """Lower case, letters, digits and underscores only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w가-힣]+", "")


def keyword(question: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """What is left of a question without stopwords, longest first."""
    out = compact(question)
    for w in sorted(stopwords, key=len, reverse=True):
        out = F.replace(out, F.lit(w), F.lit(""))
    return out


def match_texts(name: Column, description: Column) -> Column:
    """What match_score compares of a row, made once a row: full name, description and words of the name."""
    full = compact(name)
    parts = F.filter(F.transform(F.split(name, r"(?U)\s+"), compact), lambda t: F.length(t) >= 2)
    return F.struct(full.alias("full"), compact(description).alias("about"), F.filter(F.array_append(parts, full), lambda t: F.length(t) >= 2).alias("words"))


def score_texts(key: Column, texts: Column) -> Column:
    """The score of match_score for a row's match_texts."""
    inside = F.when((F.length(key) >= 2) & (texts["full"].contains(key) | texts["about"].contains(key)), 100 + F.length(key)).otherwise(0)
    words = F.filter(texts["words"], lambda t: t.contains(key) | key.contains(t))
    near = F.array_max(F.transform(words, lambda t: 80 + F.least(F.length(key), F.length(t))))
    return F.when(F.length(key) < 2, 0).otherwise(F.greatest(inside, F.coalesce(near, F.lit(0))))


def match_score(key: Column, name: Column, description: Column) -> Column:
    """100 + length if the key is in the name or description, 80 + the shorter length if it and a word of the name contain each other, else 0."""
    return score_texts(key, match_texts(name, description))


def best_match(questions: DataFrame, directory: DataFrame, text_col: str = "text", stopwords: tuple[str, ...] = ()) -> DataFrame:
    """Per question with any match the best row of the directory (id, name, description, ...), lowest id on ties.

    The score of match_score takes two looks at a directory, neither of which meets every row. A row whose
    name or description holds the key scores the same as any other such row, so the lowest id is
    wanted: texts are found by the rarest of the key's letter sequences, then compared. Where there is
    none, the longest word of a name inside the key wins: its pieces are looked up among the words.
    Both sides are reduced to distinct keys, texts and words first, and joined by value.
    """
    asked = questions.select("query_id", keyword(F.col(text_col), stopwords).alias("_key")).where(F.length("_key") >= 2)
    keys = pin(asked.select("_key").distinct())
    inside = _holders(keys, directory).select("_key", "_id", (F.length("_key") + 100).alias("score"))
    within = _longest_words(keys.join(inside, "_key", "left_anti"), directory)
    found = asked.join(inside.unionByName(within), "_key").select("query_id", "score", "_id")
    rows = directory.select("*", F.col("id").alias("_id"))
    return found.join(rows, "_id").select("query_id", "score", *directory.columns)


def _sequences(text: Column, n: Column | int) -> Column:
    """The distinct sequences of n letters of a text of at least n."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def holding(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """_key and _text of all pairs of a key and a text that holds it; both are distinct and not empty.

    A key meets the texts that have its rarest sequence of letters, of three, or of all if it is shorter.
    """
    sizes = F.array_distinct(F.array(F.lit(1), F.least(F.length("_text"), F.lit(2)), F.least(F.length("_text"), F.lit(SEQUENCE))))
    spread = pin(texts.withColumn("_n", F.explode(sizes)).select("_text", F.explode(_sequences(F.col("_text"), F.col("_n"))).alias("_part")))
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    parts = keys.select("_key", F.explode(_sequences(F.col("_key"), F.least(F.length("_key"), F.lit(SEQUENCE)))).alias("_part"))
    # A key with a sequence that no text has is in none.
    rarest = (
        parts.join(counts, "_part", "left").groupBy("_key")
        .agg(F.min_by("_part", F.struct("_rows", "_part")).alias("_part"), F.bool_and(F.col("_rows").isNotNull()).alias("_all")).where("_all")
    )
    return rarest.select("_key", "_part").join(spread, "_part").where(F.col("_text").contains(F.col("_key"))).select("_key", "_text")


def _holders(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """_key and the lowest id of the rows whose name or description holds it."""
    both = directory.select("id", F.explode(F.array(compact(F.col("name")), compact(F.col("description")))).alias("_text"))
    texts = both.where(F.length("_text") >= 2).groupBy("_text").agg(F.min("id").alias("_id"))
    return holding(keys, texts.select("_text")).join(texts, "_text").groupBy("_key").agg(F.min("_id").alias("_id"))


def _longest_words(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """_key with score and lowest id of the longest word of a name that the key holds."""
    name = F.col("name")
    named = directory.select("id", F.explode(F.array_append(F.transform(F.split(name, r"(?U)\s+"), compact), compact(name))).alias("_word"))
    words = pin(named.where(F.length("_word") >= 2).groupBy("_word").agg(F.min("id").alias("_id")))
    lengths = sorted(r[0] for r in words.select(F.length("_word")).distinct().collect())  # no more than the longest word has letters
    if not lengths:
        return keys.select("_key", F.lit(0).cast("long").alias("_id"), F.lit(0).alias("score")).limit(0)
    n = F.explode(F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("_key")))
    pieces = keys.select("_key", n.alias("_n")).select("_key", F.explode(_sequences(F.col("_key"), F.col("_n"))).alias("_word"))
    best = F.max(F.struct(F.length("_word").alias("n"), (-F.col("_id")).alias("down")))
    found = pieces.join(words, "_word").groupBy("_key").agg(best.alias("b"))
    return found.select("_key", (-F.col("b.down")).alias("_id"), (F.col("b.n") + 80).alias("score"))


def with_fallback(questions: DataFrame, best: DataFrame, directory: DataFrame, names: list[str]) -> DataFrame:
    """Each question with its best match, else the first of some directory entries whose name holds one of `names`, in that order."""
    rank = F.lit(None).cast("int")
    for i, n in reversed(list(enumerate(names))):
        rank = F.when(F.col("name").contains(n), i).otherwise(rank)
    columns = [c for c in best.columns if c not in ("query_id", "score")]
    default = directory.select(*columns, rank.alias("_rank")).where("_rank is not null").orderBy("_rank", "id").limit(1)
    missing = questions.select("query_id").join(best.select("query_id"), "query_id", "left_anti")
    filled = missing.join(F.broadcast(default.drop("_rank"))).withColumn("score", F.lit(0))
    return best.unionByName(filled.select(*best.columns))


def in_box(latitude: Column, longitude: Column, south: float, west: float, north: float, east: float) -> Column:
    return latitude.between(south, north) & longitude.between(west, east)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def coordinate(value: Column) -> Column:
    """Six decimals."""
    return F.format_string("%.6f", value)


def tel_uri(phone: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(phone, "[^0-9]", ""))


def by_id(table: DataFrame, value: str) -> DataFrame:
    """The row with this id; none if the value is no integer."""
    return table.where(F.col("id") == F.lit(value).try_cast("long"))


def filter_rows(table: DataFrame, query: str, columns: list[str], tag: str | None = None) -> DataFrame:
    """Rows of which some columns, joined and without white space, contain the query; and with a tag, if given."""
    low = F.regexp_replace(fold(F.concat_ws(" ", *columns)), r"(?U)\s+", "")
    want = F.regexp_replace(fold(F.lit(query)), r"(?U)\s+", "")
    rows = table.where((want == "") | low.contains(want))
    return rows if tag is None else rows.where(F.array_contains("tags", tag))


def bounding_box(points: DataFrame, padding: float) -> DataFrame:
    """South, west, north and east of all points, with a margin."""
    return points.agg(
        (F.min("latitude") - padding).alias("south"), (F.min("longitude") - padding).alias("west"),
        (F.max("latitude") + padding).alias("north"), (F.max("longitude") + padding).alias("east"),
    )


def translate_key(table: Column, path: Column) -> Column:
    """Value of a dotted path in a map of labels; the path itself where it has none."""
    return F.coalesce(F.try_element_at(table, path), path)
