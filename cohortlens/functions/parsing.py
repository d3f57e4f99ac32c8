"""Ingestion expressions: name normalisation, NA tokens, numbers, times, timestamps.

All of them are plain Column expressions, so they stay inside whole-stage codegen and
apply to any number of rows; only column *names* are handled on the driver.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens pandas' CSV reader reads as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Two-digit years 69..99 belong to the 1900s (POSIX pivot).
TWO_DIGIT_PIVOT = 69

# Shapes of date texts: digit runs are 9, letter runs are a. A date may be followed by a time.
NUMBER_DATES = ("9/9/9", "9-9-9", "9.9.9")
NAMED_DATES = ("9 a 9", "9 a, 9", "9-a-9", "9/a/9", "9. a 9", "a 9 9", "a 9, 9", "a-9-9", "a/9/9")
TIMES = ("", " 9:9", " 9:9:9", " 9:9 a", " 9:9:9 a")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def name_key(name: object) -> str:
    """Spelling-independent form of a column name: its ASCII letters and digits, lower-cased."""
    return "".join(ch for ch in str(name).lower() if ch.isascii() and ch.isalnum())


def find_column(columns: Sequence[str], aliases: Iterable[str], required: bool = True) -> str | None:
    """The column that the earliest matching alias names; of columns that differ in spelling
    only, the last one counts."""
    wanted = list(aliases)
    for alias in wanted:
        same = [c for c in columns if name_key(c) == name_key(alias)]
        if same:
            return same[-1]
    if required:
        raise ValueError(f"none of the columns {list(columns)} is named like {' / '.join(wanted)}")
    return None


def na_to_null(c: Column) -> Column:
    """Missing-value tokens (exact text) become NULL."""
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """NaN and ±inf are not values: NULL (Spark orders NaN above every number)."""
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(c)


def to_number(c: Column, keep_infinite: bool = True) -> Column:
    """Text → double, bad text → NULL.

    Spark's cast accepts Java float suffixes (``12d``/``12f``); those are rejected here.
    NaN becomes NULL; ±inf is kept (the cleaning step counts and drops it) unless
    ``keep_infinite`` is false.
    """
    text = F.trim(c.cast("string"))
    value = (
        F.when(text.rlike("(?i)^[+]?inf(inity)?$"), F.lit(float("inf")))
        .when(text.rlike("(?i)^-inf(inity)?$"), F.lit(float("-inf")))
        .when(text.rlike("[dDfF]$"), F.lit(None).cast("double"))
        .otherwise(text.try_cast("double"))
    )
    value = F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)
    if not keep_infinite:
        value = nan_to_null(value)
    return value


def time_of_day_text(c: Column) -> Column:
    """Digits only, zero-filled to 6, rendered ``HH:MM:SS``; NULL stays NULL.

    A time column read as float renders ``93207.0``; the trailing ``.0`` is dropped first.
    """
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0+$", ""), "[^0-9]", "")
    padded = F.lpad(digits, 6, "0")
    return F.concat(F.substring(padded, 1, 2), F.lit(":"), F.substring(padded, 3, 2), F.lit(":"), F.substring(padded, 5, 2))


def parse_timestamp(c: Column) -> Column:
    """Timestamp of a date text in any of the usual layouts (session time zone; bad text → NULL).

    The text's shape (digit and letter runs, separators) says which layouts can fit, so each row is
    taken apart once: numbers by ``/``, ``-`` or ``.`` (a first number of four digits is the year;
    else day, month, year, or month first where day first is no date), English month names before
    or behind the day, ``yyyyMMdd``; a time with or without seconds or AM/PM. Years of two digits are
    1969 to 2068. All other shapes (ISO with T, fractions, offsets) are left to Spark's cast."""
    text = F.trim(c.cast("string"))
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), "[A-Za-z]+", "a")
    numbers, words = F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    # the parts are named in a one-element array, so each is computed once per row
    parts = F.array(F.struct(text.alias("text"), shape.alias("shape"), numbers.alias("numbers"), words.alias("words")))
    return F.get(F.transform(parts, lambda p: _by_shape(p["text"], p["shape"], p["numbers"], p["words"])), F.lit(0))


def _by_shape(text: Column, shape: Column, numbers: Column, words: Column) -> Column:
    """The timestamp of a text taken apart (see :func:`parse_timestamp`)."""
    def number(at: int, digits: int = 2) -> Column:
        part = F.get(numbers, F.lit(at))
        return F.when(F.length(part) <= digits, part.try_cast("int"))

    def year(at: int) -> Column:
        part = F.get(numbers, F.lit(at))
        two = part.try_cast("int")
        return F.when(F.length(part) == 4, two).when(F.length(part) == 2, two + F.when(two >= TWO_DIGIT_PIVOT, 1900).otherwise(2000))

    def moment(y: Column, m: Column, d: Column, first: int, half: Column) -> Column:
        """The date with the time whose numbers begin at ``first``; ``half`` is AM, PM or NULL."""
        hour = F.coalesce(number(first), F.lit(0))
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        minute, second = F.coalesce(number(first + 1), F.lit(0)), F.coalesce(number(first + 2), F.lit(0))
        timed = F.size(numbers) > first  # a time that does not fit must not fall back to midnight
        fits = ~timed | (number(first).isNotNull() & number(first + 1).isNotNull() & ((F.size(numbers) <= first + 2) | number(first + 2).isNotNull()))
        return F.when(fits, F.try_make_timestamp(y, m, d, hour, minute, second))

    def half_of(word: int) -> Column:
        found = F.get(words, F.lit(word))
        return F.when(found.isNull() | found.isin("am", "pm"), found)

    def known_half(word: int) -> Column:
        found = F.get(words, F.lit(word))
        return found.isNull() | found.isin("am", "pm")

    names = F.create_map(*[F.lit(v) for i, name in enumerate(MONTHS, 1) for key in {name, name[:3]} | ({"sept"} if i == 9 else set()) for v in (key, i)])
    month = F.try_element_at(names, F.get(words, F.lit(0)))
    year_first = F.length(F.get(numbers, F.lit(0))) == 4
    by_numbers = F.when(known_half(0), F.when(year_first, moment(year(0), number(1), number(2), 3, half_of(0))).otherwise(F.coalesce(
        moment(year(2), number(1), number(0), 3, half_of(0)), moment(year(2), number(0), number(1), 3, half_of(0)))))
    by_name = F.when(known_half(1), moment(year(1), month, number(0), 2, half_of(1)))
    compact = F.when(F.length(text) == 8, F.try_make_timestamp(
        *[F.substring(text, a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))], F.lit(0), F.lit(0), F.lit(0)))
    return (
        F.when(shape.isin(*[d + t for d in NUMBER_DATES for t in TIMES]), by_numbers)
        .when(shape.isin(*[d + t for d in NAMED_DATES for t in TIMES]), by_name)
        .when(shape == "9", compact)
        .otherwise(text.try_cast("timestamp"))
    )
