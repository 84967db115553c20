"""Session dates and relative-time answers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days and months, and the patterns of relative days and durations.
WEEKDAYS = {"mon": "Monday", "tue": "Tuesday", "wed": "Wednesday", "thu": "Thursday", "fri": "Friday", "sat": "Saturday", "sun": "Sunday"}
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
LAST_WEEKDAY = r"last\s+(mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\.?"
DURATION = r"\bfor\s+(a\s+few|a\s+couple|one|two|three|four|five|six|seven|eight|nine|ten|\d+)\s+years?\b"
CANDIDATE = "struct<raw:string,answer:string,style:string>"


def session_date(c: Column) -> Column:
    """The date of a session stamp like ``1:56 pm on 8 May, 2023``; null if there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"on\s+(\d{1,2}\s+[A-Za-z]+,\s+\d{4})", 1)
    return F.try_to_date(F.initcap(F.regexp_replace(found, r"\s+", " ")), "d MMMM, yyyy")


def format_day(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def format_month(d: Column) -> Column:
    return F.date_format(d, "MMMM yyyy")


def weekday_name(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda rest, k: F.when(low.startswith(k), WEEKDAYS[k]).otherwise(rest), reversed(WEEKDAYS), F.initcap(c))


def temporal_candidates(date: Column, fact: Column, question: Column) -> Column:
    """Answers that a fact of a dated session offers, in the order of the rules; none without a date."""
    text, asked = F.lower(F.coalesce(fact, F.lit(""))), F.lower(F.coalesce(question, F.lit("")))
    day, before, after = format_day(date), format_day(F.date_sub(date, 1)), format_day(F.date_add(date, 1))
    month = F.trunc(date, "MM")
    group = lambda p, n: F.regexp_extract(text, p, n)
    weekday = weekday_name(group(LAST_WEEKDAY, 1))
    explicit = rf"\b(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b"
    explicit_day = format_day(F.try_to_date(F.initcap(F.regexp_replace(group(explicit, 1), r"\s+", " ")), "d MMMM yyyy"))
    make = lambda raw, answer, style: F.struct(raw.alias("raw"), answer.alias("answer"), F.lit(style).alias("style"))
    rules = [
        F.when(text.contains("yesterday"), make(F.lit("yesterday"), before, "absolute_from_relative")),
        F.when(text.contains("today"), make(F.lit("today"), day, "absolute_from_relative")),
        F.when(text.contains("tomorrow"), make(F.lit("tomorrow"), after, "absolute_from_relative")),
        F.when(text.rlike("last weekend|the weekend before|previous weekend"), make(F.lit("last weekend"), F.concat(F.lit("The weekend before "), day), "anchored_relative")),
        F.when(text.rlike(r"\blast week\b|the week before"), make(F.lit("last week"), F.concat(F.lit("The week before "), day), "anchored_relative")),
        F.when(text.rlike(LAST_WEEKDAY), make(F.concat(F.lit("last "), weekday), F.concat(F.lit("The "), weekday, F.lit(" before "), day), "anchored_relative")),
        F.when(text.contains("last month"), make(F.lit("last month"), format_month(F.add_months(month, -1)), "month_year")),
        F.when(text.contains("next month"), make(F.lit("next month"), format_month(F.add_months(month, 1)), "month_year")),
        F.when(text.contains("this month"), make(F.lit("this month"), format_month(month), "month_year")),
        F.when(text.contains("last year"), make(F.lit("last year"), (F.year(date) - 1).cast("string"), "year")),
        F.when(text.rlike(r"\bsince\s+\d{4}\b"), make(group(r"\bsince\s+(\d{4})\b", 0), F.concat(F.lit("Since "), group(r"\bsince\s+(\d{4})\b", 1)), "duration_since")),
        F.when(text.rlike(DURATION), make(group(DURATION, 0), F.concat(group(DURATION, 1), F.lit(" years")), "duration")),
        F.when(text.rlike(explicit) & asked.contains("what date") & explicit_day.isNotNull(), make(group(explicit, 1), explicit_day, "explicit_absolute")),
    ]
    found = F.array_compact(F.array(*rules))
    year = r"\b(?:in|during)\s+(\d{4})\b"
    bare = F.when(text.rlike(year), F.array(make(group(year, 0), group(year, 1), "year"))).otherwise(F.array().cast(f"array<{CANDIDATE}>"))
    return F.when(date.isNull(), F.array().cast(f"array<{CANDIDATE}>")).when(F.size(found) > 0, found).otherwise(bare)


def mentions_date(response: Column, date: Column) -> Column:
    low = F.lower(response)
    return low.contains(F.year(date).cast("string")) & low.contains(F.lower(F.date_format(date, "MMMM"))) & low.contains(F.dayofmonth(date).cast("string"))


def is_uncertain(response: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(response, F.lit(""))))
    return (low == "") | low.contains("not mentioned") | low.contains("unknown") | low.isin("n/a", "none")


def normalize_answer(response: Column, date: Column, content: Column) -> Column:
    """A relative answer made absolute against one block's session date; else the answer as it is."""
    low, text = F.lower(response), F.lower(content)
    said = mentions_date(response, date)
    month = F.trunc(date, "MM")
    weekday = weekday_name(F.regexp_extract(text, LAST_WEEKDAY, 1))
    return (
        F.when(date.isNull(), response)
        .when(text.contains("yesterday") & (low.contains("yesterday") | said), format_day(F.date_sub(date, 1)))
        .when(text.contains("last week") & (low.contains("last week") | said), F.concat(F.lit("The week before "), format_day(date)))
        .when(text.contains("next month") & (low.contains("next month") | low.contains("summer")), format_month(F.add_months(month, 1)))
        .when(text.contains("this month") & (low.contains("this month") | said), format_month(date))
        .when(text.rlike(LAST_WEEKDAY) & (low.contains("last") | said), F.concat(F.lit("The "), weekday, F.lit(" before "), format_day(date)))
        .when(text.contains("last year") & low.contains("last year"), (F.year(date) - 1).cast("string"))
        .otherwise(response)
    )


def resolve_answer(response: Column, date: Column, content: Column, question: Column) -> Column:
    """The answer policy for dates: a rule's candidate replaces an uncertain answer or an unchanged relative one."""
    candidates = temporal_candidates(date, content, question)
    first = F.try_element_at(candidates, F.lit(1))
    normal = normalize_answer(response, date, content)
    final = F.when(is_uncertain(response), first["answer"]).otherwise(normal)
    anchored = first["style"].isin("anchored_relative", "duration_since", "duration", "year", "month_year")
    return F.when(first.isNull(), normal).when((final == response) & anchored, first["answer"]).otherwise(final)
