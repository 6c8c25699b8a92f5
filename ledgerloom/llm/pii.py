"""Format-preserving pseudonyms of personal data.

Card numbers, IBANs, phone numbers, social security numbers, IPv4 addresses, dates and the names in e-mail addresses are
found, validated and permuted within their format by a keyed Feistel network, so equal values get equal pseudonyms
in all documents and different values stay different. Everything is built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Length of an IBAN by country, as registered.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_GROUPS = lambda n: "(?: ?[A-Z0-9]{4}){%d}" % (n // 4 - 1) + (" ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else "")
_IBAN = "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}{_GROUPS(n)}" for n, c in IBAN_LENGTHS.items())
#: Country codes of phones that are written without a separator.
_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: One pattern for each kind; a match is validated before it is changed. An e-mail name begins where a run of its
#: characters does, or right after a match, and is never given back, so a long run is looked at once. A host has at most
#: 127 labels, as in DNS.
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{M}\p{N}._%+-])|\G)[._%+-]*+[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]{1,63}+){0,126}\.[A-Za-z]{2,}",
    "phone": _LEFT + r"(?:\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\.[0-9])|[0-9]{3} [0-9]{3} [0-9]{4}(?![ -][0-9])|\+[0-9]{7,15})" + _RIGHT,
    "date": _LEFT + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})" + _RIGHT,
    "ssn": _LEFT + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _RIGHT,
    "ip": _LEFT + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _RIGHT,
    "iban": _LEFT + r"(?=[A-Z]{2}[0-9]{2})(?:" + _IBAN + ")" + _RIGHT,
    "card": _LEFT + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _RIGHT,
}
#: Characters of the longest e-mail address (RFC 5321 allows 254 octets); what is longer is none and stays.
LONGEST_ADDRESS = 254
#: Matches of a text whose widths are summed anew for each place; sums of whole blocks are kept.
BLOCK = 128
#: Rounds of the Feistel network.
ROUNDS = 8
#: Dates are permuted among the days from FIRST_DAY on, DAYS of them (1900-01-01 to 2099-12-31).
FIRST_DAY, DAYS = "1900-01-01", 73049


def _feistel(left: str, right: str, left_size: str, right_size: str, tweak: str, key: str) -> str:
    """SQL: struct(l, r) after ROUNDS rounds that add a keyed hash of one half to the other, by turns."""
    digest = lambda half: f"cast(conv(substr(sha2(concat('{key}', '|', {tweak}, '|', i, '|', {half}), 256), 1, 13), 16, 10) AS bigint)"
    step = f"IF(i % 2 = 1, named_struct('l', (a.l + {digest('a.r')}) % {left_size}, 'r', a.r), named_struct('l', a.l, 'r', (a.r + {digest('a.l')}) % {right_size}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (a, i) -> {step})"


def _digits(d: str, kind: str, key: str) -> str:
    """SQL: the digit string ``d`` (2 to 30 digits) permuted among those of its length."""
    half = f"(length({d}) div 2)"
    state = _feistel(f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", f"cast(pow(10, {half}) AS bigint)", f"cast(pow(10, length({d}) - {half}) AS bigint)", f"concat('{kind}', length({d}))", key)
    return f"transform(array({state}), s -> concat(lpad(cast(s.l AS string), {half}, '0'), lpad(cast(s.r AS string), length({d}) - {half}, '0')))[0]"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _refill(m: str, fresh: str, cls: str) -> str:
    """SQL: ``m`` with its characters of class ``cls`` replaced by those of ``fresh``, in order."""
    place = f"length(regexp_replace(substr({m}, 1, j), '[^{cls}]', ''))"
    return f"array_join(transform(sequence(1, length({m})), j -> IF(substr({m}, j, 1) RLIKE '[{cls}]', substr({fresh}, {place}, 1), substr({m}, j, 1))), '')"


def _luhn(d: str) -> str:
    """SQL: sum of a digit string by the Luhn rule, with the last digit undoubled."""
    x = f"cast(substr({d}, length({d}) - k, 1) AS int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + IF(k % 2 = 0, {x}, IF({x} > 4, 2 * {x} - 9, 2 * {x})))"


def _only(m: str, cls: str = "0-9") -> str:
    return f"regexp_replace({m}, '[^{cls}]', '')"


def _card(key: str) -> str:
    body = _let(_digits("substr(d, 1, length(d) - 1)", "card", key), "b", f"concat(b, cast((10 - {_luhn('concat(b, 0)')} % 10) % 10 AS string))")
    return _let(_only("m"), "d", f"IF({_luhn('d')} % 10 = 0, {_let(body, 'f', _refill('m', 'f', '0-9'))}, m)")


def _phone(key: str) -> str:
    """The country code after a plus stays."""
    code = f"regexp_extract(m, '^\\\\+(?:[0-9]{{1,3}}(?![0-9])|{_CODES})', 0)"
    own = _let(_only("t"), "d", f"IF(length(d) BETWEEN 6 AND 14, concat(c, {_let(_digits('d', 'phone', key), 'f', _refill('t', 'f', '0-9'))}), m)")
    return _let(code, "c", _let("substr(m, length(c) + 1)", "t", own))


def _ssn(key: str) -> str:
    """Permuted among the numbers that can be issued: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (f"cast(substr(m, {at}, {n}) AS int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    state = _feistel(f"{area} - IF({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", "'ssn'", key)
    part = lambda x, n: f"lpad(cast({x} AS string), {n}, '0')"
    fresh = _let(state, "s", f"concat_ws('-', {part('s.l + IF(s.l >= 665, 2, 1)', 3)}, {part('s.r div 9999 + 1', 2)}, {part('s.r % 9999 + 1', 4)})")
    return f"IF(m RLIKE '^(000|666|9)' OR m RLIKE '-00-' OR m RLIKE '0000$', m, {fresh})"


def _ip(key: str) -> str:
    part = lambda i: f"cast(p[{i}] AS int)"
    valid = " AND ".join(f"{part(i)} < 256 AND cast({part(i)} AS string) = p[{i}]" for i in range(4))
    state = _feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", "'ip'", key)
    fresh = _let(state, "s", "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)")
    return _let("split(m, '\\\\.')", "p", f"IF({valid}, {fresh}, m)")


def _iban(key: str) -> str:
    """Digits after the check digits are permuted, letters stay, check digits are made anew; a card within stays no less covered."""
    rest = lambda d: f"aggregate(sequence(1, length({d})), 0, (t, k) -> {_let(f'substr({d}, k, 1)', 'x', 'IF(ascii(x) > 57, t * 100 + ascii(x) - 55, t * 10 + cast(x AS int)) % 97')})"
    body = _let("substr(v, 5)", "b", _let(_only("b"), "d", f"IF(length(d) < 2, b, {_let(_digits('d', 'iban', key), 'f', _refill('b', 'f', '0-9'))})"))
    check = f"lpad(cast(98 - {rest('y')} AS string), 2, '0')"
    fresh = _let(body, "o", _let("concat(o, substr(v, 1, 2), '00')", "y", _let(f"concat(substr(v, 1, 2), {check}, o)", "z", _refill("m", "z", "A-Z0-9"))))
    valid = f"substr(v, 3, 2) BETWEEN '02' AND '98' AND {_let('concat(substr(v, 5), substr(v, 1, 4))', 'y', rest('y'))} = 1"
    within = "regexp_extract(m, '(?<= )[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}(?![0-9A-Za-z])', 0)"
    other = _let("m", "whole", _let(within, "m", f"IF(m = '', whole, replace(whole, m, {_card(key)}))"))
    return _let("replace(m, ' ', '')", "v", f"IF({valid}, {fresh}, {other})")


def _date(key: str) -> str:
    """Steps of the network over 2^18 numbers are repeated until a day of the range comes out.

    Slashes are read as day, month, year, and as month, day, year only if that is no date. The days of the second
    reading (after the 12th) are permuted among themselves, so that pseudonyms of both don't meet.
    """
    short = "m RLIKE '^[0-9][/.]|[/.][0-9][/.]'"
    form = f"CASE WHEN m LIKE '____-%' THEN 'yyyy-MM-dd' WHEN m LIKE '%.%' THEN IF({short}, 'd.M.yyyy', 'dd.MM.yyyy') WHEN try_to_date(m, 'd/M/yyyy') IS NULL THEN IF({short}, 'M/d/yyyy', 'MM/dd/yyyy') ELSE IF({short}, 'd/M/yyyy', 'dd/MM/yyyy') END"
    held = f"s.l * 512 + s.r < {DAYS} AND (f NOT LIKE 'M%' OR day(date_add(date'{FIRST_DAY}', cast(s.l * 512 + s.r AS int))) > 12)"
    state = _feistel("w.n div 512", "w.n % 512", "512", "512", "'date'", key)
    walk = f"aggregate(sequence(1, 240), named_struct('n', cast(datediff(x, date'{FIRST_DAY}') AS bigint), 'ok', false), (w, u) -> IF(w.ok, w, {_let(state, 's', f'named_struct({chr(39)}n{chr(39)}, s.l * 512 + s.r, {chr(39)}ok{chr(39)}, {held})')}))"
    fresh = _let(walk, "w", f"IF(w.ok, date_format(date_add(date'{FIRST_DAY}', cast(w.n AS int)), f), m)")
    day = "CASE WHEN m LIKE '____-%' THEN try_to_date(m, 'yyyy-MM-dd') WHEN m LIKE '%.%' THEN try_to_date(m, 'd.M.yyyy') ELSE coalesce(try_to_date(m, 'd/M/yyyy'), try_to_date(m, 'M/d/yyyy')) END"
    return _let(form, "f", _let(day, "x", f"IF(x IS NULL OR NOT (x BETWEEN date'{FIRST_DAY}' AND date_add(date'{FIRST_DAY}', {DAYS - 1})), m, {fresh})"))


def _email(key: str) -> str:
    """Letters of the name are permuted among words of their length (by twelve), digits among numbers (by eighteen); the host stays."""
    letters, digits = _only("lower(n)", "a-z"), _only("n")
    number = lambda s: f"aggregate(sequence(1, length({s})), cast(0 AS bigint), (t, k) -> t * 26 + (ascii(substr({s}, k, 1)) - 97))"
    spell = lambda v, n: f"array_join(transform(sequence({n} - 1, 0), k -> chr(97 + cast(({v} div cast(pow(26, k) AS bigint)) % 26 AS int))), '')"
    size = lambda n: f"cast(pow(26, {n}) AS bigint)"
    half = "(length(q) div 2)"
    tweak = f"concat('mail', length(q), '|', {digits})"
    word = _let(_feistel(f"IF({half} = 0, 0, {number(f'substr(q, 1, greatest({half}, 1))')})", number(f"substr(q, {half} + 1)"), size(half), size(f"length(q) - {half}"), tweak, key), "s", f"concat(IF({half} = 0, '', {spell('s.l', f'greatest({half}, 1)')}), {spell('s.r', f'(length(q) - {half})')})")
    chunks = f"IF(length(w) = 0, '', array_join(transform(sequence(0, (length(w) - 1) div 12), c -> {_let('substr(w, c * 12 + 1, 12)', 'q', word)}), ''))"
    one = f"cast((cast(e AS int) + cast(conv(substr(sha2(concat('{key}', '|mail1|'), 256), 1, 6), 16, 10) AS int)) % 10 AS string)"
    part = _let("substr(d, c * 18 + 1, 18)", "e", f"IF(length(e) < 2, {one}, {_digits('e', 'mail', key)})")
    fresh_digits = f"IF(d = '', '', array_join(transform(sequence(0, (length(d) - 1) div 18), c -> {part}), ''))"
    lowered = _let(_let(letters, "w", chunks), "f", _refill("lower(n)", "f", "a-z"))
    both = _let(lowered, "o", _let(_let(digits, "d", _let(letters, "w", fresh_digits)), "g", _refill("o", "g", "0-9")))
    # letters beyond ASCII move among those of their 32 code points, by a hash of the name before them
    point = lambda v: f"decode(unhex(lpad(hex({v}), 8, '0')), 'UTF-32')"
    block = f"filter(transform(sequence(0, 31), h -> {point('ascii(x) div 32 * 32 + h')}), y -> y RLIKE r'^\\p{{L}}$' AND lower(y) = y)"
    shift = f"1 + cast(conv(substr(sha2(concat('{key}', '|letter|', substr(n, 1, j - 1)), 256), 1, 8), 16, 10) AS bigint) % greatest(size(a) - 1, 1)"
    moved = _let(block, "a", f"IF(array_position(a, x) = 0, x, element_at(a, cast((array_position(a, x) - 1 + {shift}) % size(a) + 1 AS int)))")
    wide = f"array_join(transform(sequence(1, length(o)), j -> {_let('substr(o, j, 1)', 'x', f'IF(ascii(x) < 128, x, {moved})')}), '')"
    both = f"IF(n RLIKE '[^ -~]', {_let(both, 'o', wide)}, {both})"
    fresh = _let("lower(substring_index(m, '@', 1))", "n", f"concat({both}, '@', substring_index(m, '@', -1))")
    return f"IF(length(m) > {LONGEST_ADDRESS}, m, {fresh})"


def _sum(widths: str, after: str, count: str) -> str:
    """SQL: sum of ``count`` elements of an array behind the first ``after``."""
    return f"aggregate(slice({widths}, {after} + 1, {count}), 0, (t, x) -> t + x)"


def _long_digits_guard(expression: str) -> str:
    return f"IF(length({_only('m')}) > 30, m, {expression})"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", out: str = "text", spans: str = "pii", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: the text with pseudonyms, and ``spans``: what was changed.

    ``spans``: array of (kind, start from 1, length) in characters of the given text, in order. Values that fail their
    check (Luhn sum, octets, calendar, ranges, an address of at most 254 characters) stay, as do those of more than 30
    digits (but for e-mail names). E-mail names come out in lower
    case. A null text stays null with no spans; columns of the names ``out`` and ``spans`` are replaced. Rows are
    handled one by one: repeated rows get equal results, an empty table gives no rows, texts of any length are read whole.
    The key stands in the query's plan, so plans and event logs are as secret as the key.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key may not hold quotes or backslashes")
    make = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}
    pattern = "|".join(f"({PATTERNS[k]})" for k in kinds)
    if "card" in kinds:  # the separator's group is numbered after the kinds before it
        pattern = pattern.replace(r"\1", rf"\{list(kinds).index('card') + 2}")
    docs = docs.drop(spans).withColumn("_t", F.col(text))
    found = docs.withColumn("_m", F.when(F.col("_t").rlike(r"[0-9]|@"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    kind = "CASE " + " ".join(f"WHEN m RLIKE r'^(?:{PATTERNS[k]})$' THEN '{k}'" for k in kinds) + " END"
    changed = "CASE " + " ".join(f"WHEN k = '{k}' THEN {_long_digits_guard(make[k](key)) if k not in ('email', 'iban') else make[k](key)}" for k in kinds) + " ELSE m END"
    found = found.withColumn("_n", F.expr(f"IF(size(_m) = 0, array(), transform(_m, m -> {_let(kind, 'k', f'named_struct({chr(39)}kind{chr(39)}, k, {chr(39)}old{chr(39)}, m, {chr(39)}new{chr(39)}, {changed})')}))"))
    found = found.withColumn("_g", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
    fresh = F.expr("IF(size(_m) = 0, _t, concat(array_join(transform(_n, (x, i) -> concat(_g[i], x.new)), ''), _g[size(_n)]))")
    found = found.withColumn("_w", F.expr("transform(_n, (x, i) -> length(_g[i]) + length(x.old))"))
    found = found.withColumn("_b", F.expr(f"aggregate(filter(sequence(0, size(_w) div {BLOCK}), b -> b > 0), array(0), (a, b) -> concat(a, array(element_at(a, -1) + {_sum('_w', f'(b - 1) * {BLOCK}', str(BLOCK))})), a -> a)"))
    start = f"1 + _b[i div {BLOCK}] + {_sum('_w', f'i div {BLOCK} * {BLOCK}', f'i % {BLOCK}')} + length(_g[i])"
    places = F.expr(f"IF(size(_m) = 0, array(), transform(filter(transform(_n, (x, i) -> named_struct('kind', x.kind, 'start', {start}, 'length', length(x.old), 'same', x.old = x.new)), x -> NOT x.same), x -> named_struct('kind', x.kind, 'start', x.start, 'length', x.length)))")
    found = found.withColumn("_p", places)
    found = found.withColumn(out, fresh).withColumn(spans, F.coalesce("_p", F.array().cast("array<struct<kind:string,start:int,length:int>>")))
    return found.drop("_t", "_m", "_n", "_g", "_w", "_b", "_p")
