"""Scalar functions over prose, arguments and cells, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import MONEY, ascii_digits, latin_digits, search_form


def amount_argument(text: Column) -> Column:
    """An amount as a caller writes it: separators of thousands dropped, two decimals; null (no filter) if it is none."""
    return F.regexp_replace(ascii_digits(text), "[, ]", "").try_cast("decimal(30,6)").cast("decimal(30,2)").try_cast(MONEY)


def number_of_export(token: Column) -> Column:
    """The number that an exported cell stands for; null where the rest is no number.

    In a cell with digits of another alphabet, and nothing but digits and commas, a comma before the last two digits is
    the decimal one. All other commas are of thousands, also in Latin digits.
    """
    t = latin_digits(F.trim(token))
    other = token.rlike("[٠-٩۰-۹]") & t.rlike("^[0-9,]*,[0-9]{2}$")
    plain = F.replace(t, F.lit(","))
    decimal = F.concat(F.substring(plain, F.lit(1), F.length(plain) - 2), F.lit("."), F.right(plain, F.lit(2)))
    return F.replace(F.when(other, decimal).otherwise(plain), F.lit("٫"), F.lit(".")).try_cast(MONEY)


def number_of_evaluation(token: Column) -> Column:
    """The first number of a text. Of two kinds of separators the later is the decimal one.

    Commas alone are decimal if two digits follow the last, else of thousands; a single dot before three digits is of thousands.
    """
    t = F.replace(F.replace(latin_digits(token), F.lit("٬")), F.lit("٫"), F.lit("."))
    t = F.regexp_replace(F.regexp_extract(t, "-?[0-9.,]+", 0), "[.,]+$", "")
    dot, comma = (F.length(t) - F.instr(F.reverse(t), sign) for sign in ".,")
    tail = F.length(F.regexp_extract(t, "([^.,]*)$", 1))
    without = lambda sign: F.replace(t, F.lit(sign))
    both = F.when(dot > comma, without(",")).otherwise(F.replace(without("."), F.lit(","), F.lit(".")))
    commas = F.when(tail == 2, F.replace(t, F.lit(","), F.lit("."))).otherwise(without(","))
    dots = F.when((tail == 3) & (F.length(t) - F.length(without(".")) == 1), without(".")).otherwise(t)
    return F.when(t.contains(".") & t.contains(","), both).when(t.contains(","), commas).when(t.contains("."), dots).otherwise(t).try_cast(MONEY)


def number_of_witness(token: Column) -> Column:
    """Digits and dots alone, without sign; null for more than one dot."""
    t = F.regexp_replace(F.replace(latin_digits(token), F.lit("٫"), F.lit(".")), "[^0-9.]", "")
    return F.when(F.length(F.regexp_replace(t, "[^.]", "")) <= 1, t).try_cast(MONEY)


def date_of_cell(cell: Column) -> Column:
    """A day of the calendar from 1900 to 2100: eight digits, or year, month and day (one digit or two) with separators."""
    t = F.trim(latin_digits(cell))
    form = r"^([0-9]{4})(?:([0-9]{2})([0-9]{2})|[-/.]([0-9]{1,2})[-/.]([0-9]{1,2}))$"
    y, m, d = F.regexp_extract(t, form, 1), *(F.lpad(F.concat(F.regexp_extract(t, form, i), F.regexp_extract(t, form, i + 2)), 2, "0") for i in (2, 3))
    real = F.try_to_timestamp(F.concat(y, m, d), F.lit("yyyyMMdd")).isNotNull()
    return F.when(t.rlike(form) & y.between("1900", "2100") & real, F.concat_ws("-", y, m, d))


def dates_in_text(text: Column) -> Column:
    """struct(gregorian, hijri): of the runs of eight digits in a text the first that can be a day of either calendar.

    Gregorian: years 19xx and 20xx up to 2100; Hijri: 14xx. Months up to 12, days up to 31.
    """
    runs = F.regexp_extract_all(latin_digits(text), F.lit("[0-9]{8}"), F.lit(0))
    possible = F.filter(runs, lambda x: x.substr(5, 2).between("01", "12") & x.substr(7, 2).between("01", "31"))
    dashed = lambda x: F.concat_ws("-", x.substr(1, 4), x.substr(5, 2), x.substr(7, 2))
    first = lambda a, b: F.get(F.transform(F.filter(possible, lambda x: x.substr(1, 4).between(a, b)), dashed), F.lit(0))
    return F.struct(first("1900", "2100").alias("gregorian"), first("1400", "1499").alias("hijri"))


def date_shown(iso: Column, inherited: Column) -> Column:
    """Slash form; a star marks a date that was taken from the row above; a dash for none."""
    return F.when(iso.isNull(), "-").otherwise(F.concat(F.translate(iso, "-", "/"), F.when(inherited, "*").otherwise("")))


def count_form(n: Column) -> Column:
    """Which form of a noun a count takes in Arabic."""
    return F.when(n == 1, "one").when(n == 2, "two").when(n.between(3, 10), "few").otherwise("many")


def cents(amount: Column) -> Column:
    """Whole cents, half away from zero."""
    return (F.signum(amount.cast("double")).cast("long") * F.round(F.abs(amount) * 100, 0).cast("long")).cast("long")


def typed_cell(text: Column) -> Column:
    """struct(kind, flag, whole, number): a cell restored from its text as bool, int, decimal or text."""
    t = F.lower(F.trim(text))
    kind = F.when(text.isNull(), "null").when(t.isin("true", "false"), "bool").when(t.rlike("^-?[0-9]{1,18}$"), "int").when(t.rlike(r"^-?[0-9]{1,16}\.[0-9]{1,2}$"), "decimal").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind == "bool", t == "true").alias("flag"), F.when(kind == "int", t.try_cast("long")).alias("whole"), F.when(kind == "decimal", t.try_cast(MONEY)).alias("number"))


def query_terms(question: Column) -> Column:
    """The words of a question in search form, each once, in order; signs of the query language are gone."""
    return F.array_distinct(F.regexp_extract_all(search_form(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def years_in_text(text: Column) -> Column:
    """Distinct years from 1900 to 2100 that stand alone, in order."""
    return F.array_distinct(F.regexp_extract_all(ascii_digits(text), F.lit(r"(?<![0-9.,/-])((?:19|20)[0-9]{2}|2100)(?![0-9.,])"), F.lit(1)))


def amounts_in_text(text: Column) -> Column:
    """Numbers with two decimals, as decimals, in order."""
    return F.transform(F.regexp_extract_all(ascii_digits(text), F.lit(r"(?<![0-9.,])[0-9]+(?:,[0-9]{3})*\.[0-9]{2}(?![0-9])"), F.lit(0)), lambda x: F.replace(x, F.lit(",")).try_cast(MONEY))


def mentions(text: Column, token: str) -> Column:
    """Whether ``token`` stands as a whole word."""
    return F.coalesce(search_form(text).rlike(r"(?<![\p{L}\p{N}_])\Q" + token + r"\E(?![\p{L}\p{N}_])"), F.lit(False))


def money_shaped(text: Column) -> Column:
    return F.coalesce(ascii_digits(text).rlike(r"[0-9]+\.[0-9]{2}(?![0-9])|[0-9],[0-9]{3}(?![0-9])"), F.lit(False))


def needs_tool(question: Column) -> Column:
    """Whether a question asks for a number that only the rows can give."""
    return F.coalesce(search_form(question).rlike(r"\b(how much|how many|total|sum|balance|average|count|highest|lowest|largest|smallest)\b"), F.lit(False))


def citations(answer: Column) -> Column:
    """array of (page, first, last) from an answer's text; a reversed range is turned.

    "page 3, rows 4-7": up to fourteen other signs stand between the page and its rows. Rows without a page ("rows 7 to
    4", page null) are read only in an answer that cites no page.
    """
    t, rows = F.lower(latin_digits(answer)), r"rows?\s*([0-9]+)(?:\s*(?:[-–—]|to)\s*([0-9]+))?"
    paged, bare = rf"page\s*([0-9]+)[^0-9]{{0,14}}?{rows}", rf"(?<![0-9]){rows}"

    def read(pattern: str, page: int | None, at: int) -> Column:
        def one(c: Column) -> Column:
            part = lambda i: F.regexp_extract(c, pattern, i).try_cast("int")
            a, b = part(at), F.coalesce(part(at + 1), part(at))
            return F.struct((part(page) if page else F.lit(None).cast("int")).alias("page"), F.least(a, b).alias("first"), F.greatest(a, b).alias("last"))

        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one)

    return F.when(t.rlike(paged), read(paged, 1, 2)).otherwise(read(bare, None, 1))
