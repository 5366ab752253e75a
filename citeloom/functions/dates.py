"""Date rules and paraphrases of dates, years, persons, countries and numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the accepted notations
FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd")
COUNTRY_PHRASES = {"France": "the country with the tricolour of blue, white and red", "Japan": "the country with a red disc on its flag", "Canada": "the country with a maple leaf on its flag", "Switzerland": "the country with a white cross on a red flag", "Brazil": "the country with a starry globe on its flag"}
SURNAMES = ("Avery", "Bellamy", "Carver", "Dunmore", "Ellison", "Farrow", "Garland", "Hollis")
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()


def admissible(published: Column, start: Column | None) -> Column:
    """FLT-7: true without a start; false without a readable date; else not before the start."""
    if start is None:
        return F.lit(True)
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.when(start.isNull() | (start == ""), True).otherwise(F.coalesce(day(published) >= day(start), F.lit(False)))


def any_date(text: Column) -> Column:
    return F.coalesce(*(F.try_to_date(text, f) for f in FORMATS))


def date_phrase(day: Column, today: Column, shift_days: Column | None = None) -> Column:
    """DATE-1: how long ago, roughly; shift_days (366 to 1824) makes the false-premise variant. Null dates stay null."""
    d = F.datediff(today, day) + (shift_days if shift_days is not None else F.lit(0))
    n, tail = F.abs(d), F.when(d >= 0, " ago").otherwise(" from now")
    months, years = F.floor(n / 30), F.floor(n / 365)
    plural = lambda k, word: F.concat(k.cast("string"), F.lit(" " + word), F.when(k == 1, "").otherwise("s"))
    return (
        F.when(d == 0, "today")
        .when(n < 7, F.concat(F.lit("a few days"), tail))
        .when(n < 30, F.concat(F.lit("a few weeks"), tail))
        .when(n < 365, F.concat(F.lit("roughly "), plural(months, "month"), tail))
        .otherwise(F.concat(F.lit("roughly "), plural(years, "year"), tail))
    )


def year_phrase(year: Column, now: Column, shift: Column | None = None) -> Column:
    """DATE-2"""
    d = now - (year if shift is None else year + shift)
    word = F.when(F.abs(d) == 1, " year").otherwise(" years")
    return F.when(d == 0, "this year").when(d > 0, F.concat(d.cast("string"), word, F.lit(" ago"))).when(d < 0, F.concat(F.abs(d).cast("string"), word, F.lit(" from now")))


def person_phrase(name: Column, false_premise: Column | None = None, seed: int = 0) -> Column:
    """TXT-1: initials and the last name of two or more capitalised words, else null; the false-premise variant takes another surname."""
    words = F.split(F.trim(name), r"\s+")
    fits = (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    initials = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.substring(w, 1, 1), F.lit(".")))
    last = F.element_at(words, -1)
    if false_premise is not None:
        pool = F.array(*map(F.lit, SURNAMES))
        last = F.when(false_premise, F.get(pool, F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(len(SURNAMES))).cast("int"))).otherwise(last)
    return F.when(fits, F.concat_ws(" ", F.concat_ws(" ", initials), last))


def country_phrase(name: Column) -> Column:
    """TXT-2: a phrase for the countries of the table (a parameter of any size would be joined), else null."""
    return F.create_map(*(F.lit(x) for kv in COUNTRY_PHRASES.items() for x in kv))[F.trim(name)]


def words_of(n: int) -> str:
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + ("-" + _ONES[n % 10] if n % 10 else "")
    return _ONES[n // 100] + " hundred" + (" and " + words_of(n % 100) if n % 100 else "")


@F.pandas_udf(T.StringType())
def number_phrase(text: pd.Series) -> pd.Series:
    """TXT-3: texts with exactly one number of up to three digits, that number in words; else null."""
    import re

    def one(s: str | None) -> str | None:
        found = re.findall(r"\d+", s or "")
        return re.sub(r"\d+", words_of(int(found[0])), s) if len(found) == 1 and len(found[0]) < 4 else None

    return text.map(one)


def paraphrase(node: Column, today: Column) -> Column:
    """TXT-4: the first kind that fits: date, year, person, country, number; null where none does."""
    day = any_date(node)
    year = F.when(node.rlike(r"^(1[89]|20)\d\d$"), node.try_cast("int"))
    return F.coalesce(date_phrase(day, today), year_phrase(year, F.year(today)), country_phrase(node), person_phrase(node), number_phrase(node))
