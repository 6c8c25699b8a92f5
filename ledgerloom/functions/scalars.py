"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Digits of the two other alphabets with their separators, and what they stand for.
OTHER_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬،", "01234567890123456789.,,"
DIACRITICS = "[ً-ْٰـ]"
#: Letters of the Arabic script that are searched as one, by code point (Unicode block Arabic): alef with
#: madda, hamza above, waw with hamza, alef with hamza below, yeh with hamza, teh marbuta, alef maksura, alef wasla.
FOLD_FROM = "آأؤإئةىٱ"
FOLD_TO = "ااوايهيا"


def ascii_digits(text: Column) -> Column:
    return F.translate(text, OTHER_DIGITS, ASCII_DIGITS)


def latin_digits(text: Column) -> Column:
    """Digits of the other alphabets as ASCII; their separators stay."""
    return F.translate(text, OTHER_DIGITS[:20], ASCII_DIGITS[:20])


def parse_amount(token: Column) -> Column:
    """A printed amount as decimal(18,2); null where it can't be told.

    Separators and blanks alone: zero for two or more. A minus at either end negates. Before the first dot a digit must
    stand, after it two digits (or none), whatever marks are between them. After the last comma two digits are decimals,
    three thousands, more a lost dot after the third, fewer nothing.
    """
    t = ascii_digits(token)
    s = F.regexp_replace(t, "[^0-9.,]", "")
    minus = t.rlike(r"^\s*-") | t.rlike(r"-\s*$")
    whole, fraction = F.replace(F.substring_index(s, ".", 1), F.lit(",")), F.regexp_replace(F.regexp_extract(s, r"^[^.]*\.(.*)$", 1), "[^0-9]", "")
    tail = F.substring_index(s, ",", -1)
    head = F.replace(F.regexp_extract(s, r"^(.*),[^,]*$", 1), F.lit(","))
    lost = F.concat(head, F.substring(tail, 1, 3), F.lit("."), F.lpad(F.substring(tail, 4, 2), 2, "0"))
    commas = F.when(F.length(tail) == 2, F.concat(head, F.lit("."), tail)).when(F.length(tail) == 3, F.concat(head, tail)).when(F.length(tail) > 3, lost).otherwise(head)
    dotted = F.when(whole == "", None).when(F.length(fraction) == 2, F.concat(whole, F.lit("."), fraction)).when(fraction == "", whole)
    number = F.when(s.contains("."), dotted).when(s.contains(","), commas).otherwise(s)
    value = F.when(t.rlike(r"^[\s.,]+$"), F.when(F.length(F.regexp_replace(t, r"^\s+|\s+$", "")) >= 2, F.lit("0"))).when(s.rlike("[0-9]"), number).try_cast(MONEY)
    return F.when(minus, -value).otherwise(value).cast(MONEY)


def parse_amount_ocr(token: Column) -> Column:
    """The lenient form for OCR: the last separator decides, three digits after it are thousands, failure is zero."""
    s = F.regexp_replace(ascii_digits(token), "[^0-9.,-]", "")
    tail = F.regexp_extract(s, "[.,]([0-9]*)$", 1)
    digits = F.regexp_replace(s, "[^0-9]", "")
    cut = F.length(digits) - F.length(tail)
    number = F.when(s.rlike("[.,]") & (F.length(tail) != 3), F.concat(digits.substr(F.lit(1), cut), F.lit("."), tail)).otherwise(digits)
    value = F.coalesce(number.try_cast(MONEY), F.lit(0).cast(MONEY))
    return F.when(s.startswith("-"), -value).otherwise(value).cast(MONEY)


def read_date(cell: Column) -> Column:
    """struct(iso, status, year) of a date cell: ok, missing, incomplete or implausible.

    Eight digits in all are year, month, day; else words of eight digits are tried from the last. The day must exist
    and its year lie between 1900 and 2100.
    """
    t = ascii_digits(cell)
    digits = F.regexp_replace(t, "[^0-9]", "")
    parts = F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, "[^0-9]", "")), lambda w: F.length(w) == 8)
    tried = F.when(F.length(digits) == 8, F.array(digits)).otherwise(F.reverse(parts))
    real = F.filter(tried, lambda d: d.substr(1, 4).between("1900", "2100") & F.try_to_timestamp(d, F.lit("yyyyMMdd")).isNotNull())
    d = F.get(real, F.lit(0))
    status = F.when(cell.isNull(), "missing").when(F.size(tried) == 0, "incomplete").when(d.isNull(), "implausible").otherwise("ok")
    return F.struct(F.concat_ws("-", d.substr(1, 4), d.substr(5, 2), d.substr(7, 2)).alias("iso"), status.alias("status"), d.substr(1, 4).cast("int").alias("year"))


def iso_date(cell: Column) -> Column:
    r = read_date(cell)
    return F.when(r.status == "ok", r.iso)


def token_style(token: Column) -> Column:
    """How an amount is printed: dot, comma2, comma3, comma_long, digits or none."""
    t = ascii_digits(token)
    tail = F.length(F.regexp_extract(t, r",([0-9]*)\D*$", 1))
    return F.when(~t.rlike("[0-9]") | t.isNull(), "none").when(t.contains("."), "dot").when(t.contains(","), F.when(tail == 2, "comma2").when(tail == 3, "comma3").otherwise("comma_long")).otherwise("digits")


def search_form(text: Column) -> Column:
    """Text for search: no diacritics, folded letters, ASCII digits, single blanks, lower case."""
    t = F.translate(ascii_digits(F.regexp_replace(text, DIACRITICS, "")), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


#: Kinds of transaction, first match wins; this library's own words.
KINDS = [("transfer_in", "transfer received"), ("transfer_out", "transfer sent"), ("cash", "cash withdrawal"), ("card", "card payment"), ("fee", "fee"), ("standing_order", "standing order"), ("deposit", "deposit"), ("brought_forward", "brought forward")]


def transaction_kind(description: Column, side: Column) -> Column:
    """First kind whose words the description holds; a bare transfer goes by its side; else other."""
    t = search_form(description)
    out = F.when(t.isNull(), "other")
    for kind, words in KINDS:
        out = out.when(t.contains(words), kind)
    return out.when(t.contains("transfer"), F.when(side == "credit", "transfer_in").otherwise("transfer_out")).otherwise("other")


def side_of_label(label: Column) -> Column:
    """debit, credit or '' for a column label."""
    t = F.lower(F.trim(label))
    return F.when(t.isin("debit", "dr", "withdrawal", "withdrawals", "out"), "debit").when(t.isin("credit", "cr", "deposit", "deposits", "in"), "credit").otherwise("")


def one_digit_apart(a: Column, b: Column) -> Column:
    """Same length and exactly one different character."""
    differ = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p.x != p.y))
    return F.coalesce((F.length(a) == F.length(b)) & (differ == 1), F.lit(False))


def money_text(amount: Column) -> Column:
    """Thousands and two decimals; a dash for null."""
    return F.coalesce(F.format_number(amount, 2), F.lit("-"))


def short_key(content: Column) -> Column:
    """Statement key: the first sixteen hex digits of the content's SHA-256; null content is refused."""
    return F.when(content.isNotNull(), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> Column:
    """struct(low, high): Wilson bounds of a share, to six digits; null for no trials."""
    p, d = hits / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.struct(F.when(n > 0, F.round(mid - half, 6)).alias("low"), F.when(n > 0, F.round(mid + half, 6)).alias("high"))


def page_mentions(text: Column, longest: int = 50) -> Column:
    """Pages that a question names ("page 3", "pages 4-6, 9"): distinct and sorted; longer ranges give their ends."""
    spans = F.regexp_extract_all(F.lower(text), F.lit(r"pages?\s+([0-9]+(?:\s*(?:-|to|,|and)\s*[0-9]+)*)"), F.lit(1))
    parts = F.flatten(F.transform(spans, lambda s: F.split(s, r"\s*(?:,|and)\s*")))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, r"\s*(?:-|to)\s*"), lambda n: n.try_cast("int")))

    def run(e: Column) -> Column:
        a, b = F.array_min(e), F.array_max(e)
        return F.when(b - a <= longest, F.sequence(a, b)).otherwise(F.array(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(ends, lambda e: F.array_min(e).isNotNull()), run))))


def bag_of_words(text: Column) -> Column:
    """Words of two letters or more, lower case, as they come."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))
