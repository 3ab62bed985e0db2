"""Dates found in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import WS

#: Labels, month names and forms that the results depend on.
LABELLED = rf"(?i)(?:发布时间|发布日期|成文日期|印发日期|发文日期|时间|日期|发布|更新日期|published|posted|date)[^0-9]{{0,12}}(20[0-9]{{2}}){WS}*[-年/.]{WS}*([0-9]{{1,2}}){WS}*[-月/.]{WS}*([0-9]{{1,2}})"
CHINESE = rf"(20[0-9]{{2}}){WS}*年{WS}*([0-9]{{1,2}}){WS}*月{WS}*([0-9]{{1,2}}){WS}*日"
DASHED = r"(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})"
SLASHED = r"(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
DAY_FIRST = rf"(?i)\b([0-9]{{1,2}}){WS}+({MONTHS})\.?{WS}*,?{WS}+(20[0-9]{{2}})\b"
MONTH_FIRST = rf"(?i)\b({MONTHS})\.?{WS}+([0-9]{{1,2}}){WS}*,?{WS}+(20[0-9]{{2}})\b"
PUBLISHED = rf"(?i)(?:发布时间|发布日期|发布于|published|posted)[^0-9]{{0,12}}(20[0-9]{{2}}){WS}*[-年/.]{WS}*([0-9]{{1,2}}){WS}*[-月/.]{WS}*([0-9]{{1,2}})"
ONLY_DATE = rf"^{WS}*20[0-9]{{2}}{WS}*[年/.-]{WS}*[0-9]{{1,2}}{WS}*[月/.-]{WS}*[0-9]{{1,2}}{WS}*日?{WS}*$"
EFFECTIVE = rf"(20[0-9]{{2}}){WS}*[年\-/.]{WS}*([0-9]{{1,2}}){WS}*[月\-/.]{WS}*([0-9]{{1,2}}){WS}*日?{WS}*(?:起)?{WS}*(?:施行|生效|执行|实施|适用)"
EFFECTIVE_EN = rf"(?i)(?:effective|enters? into force|applies from){WS}*(?:on{WS}*)?([0-9]{{1,2}}){WS}+({MONTHS})\.?{WS}*,?{WS}+(20[0-9]{{2}})"


def made(year: Column, month: Column, day: Column) -> Column:
    """A calendar date of the years 2000 to 2100, else NULL."""
    date = F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")
    return F.when(F.year(date).between(2000, 2100), date)


def month_number(name: Column) -> Column:
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.left(F.lower(name), F.lit(3)))
    return F.when(name != "", F.floor((at + 2) / 3).cast("int").cast("string"))


def _found(text: Column, pattern: str, order: tuple[int, int, int] = (0, 1, 2)) -> Column:
    """The date of the first match, read from the match's own numbers: one scan of the text, and small generated code."""
    match = F.regexp_extract(text, pattern, 0)
    numbers = F.regexp_extract_all(match, F.lit("[0-9]+"), 0)
    if len(set(order)) == 3 and max(order) == 2:
        y, m, d = (F.get(numbers, i) for i in order)
        return F.try_to_date(F.concat(y, F.lit("-"), m, F.lit("-"), d), "y-M-d")
    y, d = F.get(numbers, order[0]), F.get(numbers, order[2])
    month = month_number(F.regexp_extract(match, f"(?i)({MONTHS})", 1))
    return F.try_to_date(F.concat(y, F.lit("-"), month, F.lit("-"), d), "y-M-d")


def any_date(text: Column, window: int | None = 2000) -> Column:
    """The first date of the first form that has one: labelled, Chinese, dashed, slashed, English."""
    hay = text if window is None else F.left(text, F.lit(window))
    plain = F.translate(hay, "０１２３４５６７８９", "0123456789")
    return F.coalesce(
        _found(plain, LABELLED), _found(plain, CHINESE), _found(plain, DASHED), _found(plain, SLASHED),
        _found(hay, DAY_FIRST, (1, -1, 0)), _found(hay, MONTH_FIRST, (1, -1, 0)),
    )


def publication_date(text: Column) -> Column:
    """A labelled date, even if it isn't valid, else that of the last line that is only a date."""
    last = F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x.rlike(ONLY_DATE)), F.lit(-1))
    return F.when(text.rlike(PUBLISHED), _found(text, PUBLISHED)).otherwise(_found(last, f"{CHINESE}|{DASHED}|{SLASHED}"))


def effective_date(text: Column) -> Column:
    early = F.left(text, F.lit(4000))
    return F.when(text.rlike(EFFECTIVE), _found(text, EFFECTIVE)).otherwise(_found(early, EFFECTIVE_EN, (1, -1, 0)))


def listed_date(value: Column) -> Column:
    """A date from a listing: epoch seconds or milliseconds in digits, else any date of the whole string."""
    text = F.trim(value)
    number = F.when(text.rlike("^[0-9]{10,13}$"), text.cast("double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.when(seconds > 1e9, F.to_date(F.timestamp_seconds(seconds)))).otherwise(any_date(text, None))


def date_from_url(url: Column, pattern: str) -> Column:
    """A date from three groups, or from one of eight digits."""
    groups = pattern.replace("\\(", "").count("(") - pattern.count("(?")
    if groups >= 3:
        return made(*(F.regexp_extract(url, pattern, i) for i in (1, 2, 3)))
    raw = F.regexp_extract(url, pattern, 1)
    return F.when(raw.rlike("^[0-9]{8}$"), made(F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2)))
