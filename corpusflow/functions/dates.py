"""Dates in crawled text, as timestamps without a zone. Values with a zone become UTC wall time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squash

# How days are written, in order of preference; labels before a day; metadata keys that hold one.
FORMS = ("[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}", r"[0-9]{4}\s*년\s*[0-9]{1,2}\s*월\s*[0-9]{1,2}\s*일")
LABELS = ("작성일", "등록일")
METADATA_KEYS = ("article:published_time", "published_time", "published_at", "date", "created")

#: Clock times that may follow a day, and the whole of a value in seven parts: year, month, day, hour, minute, second, zone.
CLOCK = r"(?:\s+[0-9]{1,2}(?::|시\s*)[0-9]{1,2}(?:분(?:\s*[0-9]{1,2}초)?|(?::[0-9]{2})?))?"
VALUE = (
    r"^([0-9]{4})\s*[-./년]\s*([0-9]{1,2})\s*[-./월]\s*([0-9]{1,2})\s*일?"
    r"(?:[T ]\s*([0-9]{1,2})\s*[:시]\s*([0-9]{1,2})(?:\s*[:분])?(?:\s*([0-9]{1,2}(?:\.[0-9]{1,6})?)\s*초?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)


def parse_datetime(value: Column) -> Column:
    """A day and perhaps a clock time, in numbers or Korean units; null if it is neither, or impossible."""

    def read(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, VALUE, i)
        number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("int"), F.lit(0))
        second = F.coalesce(F.nullif(part(6), F.lit("")).cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
        wall = F.try_make_timestamp_ntz(number(1), number(2), number(3), number(4), number(5), second)
        sign = F.when(part(7).startswith("-"), 1).when(part(7).startswith("+"), -1).otherwise(0)
        offset = F.regexp_extract(part(7), "^[+-]([0-9]{2})", 1), F.regexp_extract(part(7), "([0-9]{2})$", 1)
        hours, minutes = (F.coalesce(F.nullif(o, F.lit("")).cast("int"), F.lit(0)) * sign for o in offset)
        return F.when(text.rlike(VALUE), wall + F.make_dt_interval(hours=hours, mins=minutes))

    return let(squash(value), read)


def published_at(content: Column, metadata: Column | None = None) -> Column:
    """Metadata, then labelled days, then any day of the text; the first that can be read."""
    found = [F.try_element_at(metadata, F.lit(k)) for k in METADATA_KEYS] if metadata is not None else []
    found += [F.regexp_extract(content, rf"_?{label}_?\s*[:：]?\s*({form}{CLOCK})", 1) for form in FORMS for label in LABELS]
    found += [F.regexp_extract(content, form + CLOCK, 0) for form in FORMS]
    read = F.transform(F.filter(F.array(*found), lambda x: F.coalesce(x, F.lit("")) != ""), parse_datetime)
    return F.get(F.filter(read, lambda t: t.isNotNull()), F.lit(0))


def all_dates(content: Column) -> Column:
    """Days of all dates of a text, form by form; impossible ones are left out."""
    written = F.concat(*[F.regexp_extract_all(content, F.lit(form), F.lit(0)) for form in FORMS])
    return F.filter(F.transform(written, lambda w: parse_datetime(w).cast("date")), lambda d: d.isNotNull())
