"""Format-preserving pseudonyms for personal data (operator 5), in DataFrame functions only.

Found and validated: payment card numbers (13 to 19 digits with an optional single space or
hyphen between groups; Luhn), phone numbers (international, or 3-3-4 digits with separators),
IPv4 addresses (four octets of 0 to 255), US social security numbers, IBANs (mod 97), dates
(year first, also before a time; day or month first; with the month's name in English, German, French or Spanish; real days of 1600 to 2399), e-mail addresses, and keys
(32 or more hexadecimal digits in one word).  What looks alike but isn't valid stays.  Where digits or capitals
stand beside a number, every run of whole groups is tried.

Numbers and dates are permuted within their format by a balanced-as-can-be Feistel network of
``ROUNDS`` rounds, whose round function is SHA-256 of the key, the kind, the length, the round
and the other half.  A permutation: different values stay different, and a value has the
same pseudonym wherever it stands, with its separators kept.  A card keeps its length and a
right check digit; a phone its country code, which is told by its digits, so that a number has one pseudonym however it is grouped
(one without a plus and a code is permuted like the national part of one with); a date its order of parts, and 400-year cycle, and one with a name for the month
is linked with the same day year first; an IBAN
its country and right check digits.  Hexadecimal keys are permuted block by block.
E-mail addresses, which aren't numbers, become keyed ones under ``example.invalid``.

The text is cut at the matches and put together again: one regular-expression pass, no join and
no shuffle, and texts without a match are left as they are.  Null text stays null; all columns
of the input stay, in order; repeated rows give repeated rows, an empty table an empty one.  A key that is a string stands in the plan; a
secret is better handed over as a column, such as ``spark.read.text(path).scalar()``, of which the plan shows only where it is read.

Not taken for phones: ten digits without a separator or a plus, which may be any number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,62}[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
#: Of more than 128 digits some are decimal: a repeated syllable is no key.
HEX = r"[0-9a-fA-F]{32,128}|(?=[a-fA-F]*[0-9])[0-9a-fA-F]{129,}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
DATE = r"[0-9]{4}([\-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\2[0-9]{4}"
#: Names of the months, with as many short forms; and the countries' telephone codes of one or two digits (all others have three).
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "en short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
_NAMES = "|".join(sorted({m for ms in MONTHS.values() for m in ms}, key=lambda m: (-len(m), m)))
WORDED = rf"(?i:(?:{_NAMES})(?:\.? | )[0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}|[0-9]{{1,2}}(?:st|nd|rd|th|er|\.)?(?: of| de)? (?:{_NAMES})\.?,?(?: de)? [0-9]{{4}})"
#: Before a time.
TIMED = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?=T[0-9]{2}(?::?[0-9]{2}|(?![\p{L}\p{N}])))"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}(?:[ .\-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
CARD = r"[0-9](?:[ \-]?[0-9]){12,18}"
#: What neither precedes nor follows a match: a letter, a digit or what would go on with it.
BEFORE, AFTER = r"(?<![\p{L}\p{N}_]|[0-9][.\-])", r"(?![\p{L}\p{N}_@]|[.\-][0-9])"
#: All groups in a row that may belong to an account number or a card, without backtracking, for which a long run would need
#: as deep a stack.  A group that a letter, a fraction, a date or an address goes on with isn't one of them.
_ENDS = r"(?![\p{L}\p{N}_]|[./][0-9]|[A-Za-z0-9._%+\-]{0,64}@)"
IBANS = rf"(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2}})[A-Z0-9]++{_ENDS}(?: [A-Z0-9]++{_ENDS}(?!-[0-9]))*+"
CARDS = rf"(?=[0-9](?:[ \-]?[0-9]){{12}})[0-9]++{_ENDS}(?:[ \-][0-9]++{_ENDS})*+"
OTHERS = rf"{HEX}|{WORDED}|{DATE}|{IP}|{SSN}|{PHONE}"
#: In order of preference.
PII = rf"{BEFORE}(?:(?:{EMAIL}|{IBANS}|{OTHERS}|{CARDS}){AFTER}|{TIMED})"
#: Groups of a number at most.
MOST_GROUPS = 19
#: Length of an account number by country (ISO 13616).
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _random(key: Column, kind: str, n: Column | int, i: Column | int, half: Column) -> Column:
    """A keyed number below 2**52."""
    message = F.concat_ws("|", key, F.lit(kind), (n if isinstance(n, Column) else F.lit(n)).cast("string"), (i if isinstance(i, Column) else F.lit(i)).cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(message, 256), 1, 13), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: Column, kind: str, n: Column | int) -> Column:
    """Permutes the pairs (a, b), 0 <= a < size_a, 0 <= b < size_b (up to 10**15 each); a struct of a and b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def two_rounds(s: Column, i: Column) -> Column:
        left = F.pmod(s["a"] + _random(key, kind, n, 2 * i, s["b"]), size_a.cast("long"))
        return F.struct(left.alias("a"), F.pmod(s["b"] + _random(key, kind, n, 2 * i + 1, left), size_b.cast("long")).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, two_rounds)


def permuted_digits(d: Column, key: Column, kind: str) -> Column:
    """A string of up to 30 decimal digits, permuted among those of its length."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")
    b = n - a
    p = feistel(F.coalesce(F.substring(d, F.lit(1), a).cast("long"), F.lit(0)), F.substring(d, a + 1, b).cast("long"), F.pow(F.lit(10.0), a), F.pow(F.lit(10.0), b), key, kind, n)
    # let() evaluates the network once
    return _let(p, lambda s: F.concat(F.when(a > 0, F.lpad(s["a"].cast("string"), a, "0")).otherwise(""), F.lpad(s["b"].cast("string"), b, "0")))


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _refilled(x: Column, digits: Column, skip: Column | int = 0) -> Column:
    """x with its digits after the first ``skip`` ones replaced, in order, by ``digits``."""
    step = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    skip = skip if isinstance(skip, Column) else F.lit(skip)

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        new = F.when(is_digit & (s["n"] >= skip), F.substring(digits, s["n"] - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["n"] + is_digit.cast("int")).alias("n"))

    return F.aggregate(F.split(x, ""), step, put, lambda s: s["out"])


def _luhn_sum(d: Column, odd: Column) -> Column:
    """Sum of the digits, those at distance odd, odd + 2, ... from the right doubled."""
    def add(s: Column, c: Column) -> Column:
        v = c.cast("int") * (F.lit(1) + F.pmod(s["i"] + odd, F.lit(2)))
        return F.struct((s["sum"] + F.when(v > 9, v - 9).otherwise(v)).alias("sum"), (s["i"] + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), add, lambda s: s["sum"])


def is_card(x: Column) -> Column:
    d = _digits(x)
    return F.length(d).between(13, 19) & (F.pmod(_luhn_sum(d, F.lit(0)), F.lit(10)) == 0) & ~d.rlike(r"^0+$")


def card(x: Column, key: Column) -> Column:
    d = _digits(x)
    body = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return _let(body, lambda p: _refilled(x, F.concat(p, F.pmod(10 - F.pmod(_luhn_sum(p, F.lit(1)), F.lit(10)), F.lit(10)).cast("string"))))


def is_ip(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.cast("int") <= 255)


def ip(x: Column, key: Column) -> Column:
    p = F.split(x, r"\.")
    s = feistel(p[0].cast("long") * 256 + p[1].cast("long"), p[2].cast("long") * 256 + p[3].cast("long"), F.lit(65536), F.lit(65536), key, "ip", 4)
    return _let(s, lambda v: F.concat_ws(".", F.floor(v["a"] / 256).cast("string"), F.pmod(v["a"], F.lit(256)).cast("string"), F.floor(v["b"] / 256).cast("string"), F.pmod(v["b"], F.lit(256)).cast("string")))


def _date(x: Column) -> dict[str, Column]:
    """Of a date: its order of parts, the parts, and the range of days that its class of spelling covers.

    Year first, and with dots day first, the order is known.  Otherwise two parts up to 12 may be
    either, and a part over 12 is the day: days stay on their side of 12, so that a pseudonym
    is of the class of its original and the permutation is one of each class."""
    p = F.split(x, r"[\-/.]")
    year_first, dots = F.length(p[0]) == 4, x.contains(".")
    first, second = p[0].cast("int"), p[1].cast("int")
    day_first = ~year_first & (dots | (first > 12))
    day = F.when(year_first, p[2].cast("int")).when(day_first, first).otherwise(second)
    known = year_first | dots
    return {
        "year_first": year_first,
        "day_first": day_first,
        "year": F.when(year_first, first).otherwise(p[2].cast("int")),
        "month": F.when(year_first | day_first, second).otherwise(first),
        "day": day,
        "low": F.when(known | (day <= 12), 1).otherwise(13),
        "days": F.when(known, 31).when(day <= 12, 12).otherwise(19),
    }


def _real(year: Column, month: Column, day: Column) -> Column:
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 29).otherwise(28)
    return year.between(1600, 2399) & month.between(1, 12) & day.between(1, last)


def is_date(x: Column) -> Column:
    d = _date(x)
    return _real(d["year"], d["month"], d["day"])


def _moved(d: dict[str, Column], key: Column, use) -> Column:
    """use(year, month, day) of the pseudonym: years of 1600 to 2399, months and the class's days are permuted, again and again until the day is real."""
    low, days = d["low"].cast("long"), d["days"].cast("long")

    def value(s: Column) -> tuple[Column, Column, Column]:
        return s["a"] + 1600, F.floor(s["b"] / days) + 1, s["b"] % days + low

    def walk(s: Column, i: Column) -> Column:
        return F.when((i > 0) & _real(*value(s)), s).otherwise(feistel(s["a"], s["b"], F.lit(800), days * 12, key, "date", d["days"]))

    start = F.struct((d["year"] - 1600).cast("long").alias("a"), ((d["month"] - 1) * days + d["day"] - low).cast("long").alias("b"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(40)), start, walk), lambda s: use(*value(s)))


def date(x: Column, key: Column) -> Column:
    d = _date(x)
    mark = F.regexp_extract(x, r"[\-/.]", 0)

    def spelt(year: Column, month: Column, day: Column) -> Column:
        y, m, n = year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")
        return F.when(d["year_first"], F.concat(y, mark, m, mark, n)).when(d["day_first"], F.concat(n, mark, m, mark, y)).otherwise(F.concat(m, mark, n, mark, y))

    return _moved(d, key, spelt)


def _worded(x: Column) -> dict[str, Column]:
    """Of a date with a month's name: the name, its style and number, and what _date() tells; the order is known."""
    name = F.regexp_extract(x, rf"(?i)({_NAMES})", 1)
    styles = {}
    for i, ms in enumerate(MONTHS.values()):
        for k, m in enumerate(ms):
            styles.setdefault(m.lower(), i * 12 + k)
    code = F.create_map(*[F.lit(v) for pair in styles.items() for v in pair])[F.lower(name)]
    day, year = F.regexp_extract(x, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1).cast("int"), F.regexp_extract(x, r"([0-9]{4})", 1).cast("int")
    return {"name": name, "style": F.floor(code / 12).cast("int"), "month": F.pmod(code, F.lit(12)) + 1, "day": day, "year": year, "low": F.lit(1), "days": F.lit(31)}


def is_worded(x: Column) -> Column:
    d = _worded(x)
    return F.coalesce(_real(d["year"], d["month"], d["day"]), F.lit(False))


def worded_date(x: Column, key: Column) -> Column:
    """Day, month's name (of the same language and length, in capitals if it was) and year are put where they stood; an English ending of the day follows it."""
    d = _worded(x)
    names = F.array(*[F.array(*map(F.lit, ms)) for ms in MONTHS.values()])

    def spelt(year: Column, month: Column, day: Column) -> Column:
        new = names[d["style"]][(month - 1).cast("int")]
        new = F.when((F.length(d["name"]) > 1) & (F.upper(d["name"]) == d["name"]), F.upper(new)).when(F.lower(d["name"]) == d["name"], F.lower(new)).otherwise(F.initcap(new))
        ending = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
        out = F.regexp_replace(x, F.lit(r"[0-9]{4}"), F.lit("\u0001"))
        out = F.regexp_replace(out, F.lit(r"[0-9]{1,2}(?:st|nd|rd|th)"), F.concat(F.lit("\u0002"), ending))
        out = F.regexp_replace(out, F.lit(r"[0-9]{1,2}"), F.lit("\u0002"))
        out = F.regexp_replace(out, F.lit(rf"(?i){_NAMES}"), new)
        return F.replace(F.replace(out, F.lit("\u0001"), year.cast("string")), F.lit("\u0002"), day.cast("string"))

    return _moved(d, key, spelt)


def _mod97(x: Column) -> Column:
    """Of a string of digits and capital letters, a letter counting as a number of 10 to 35."""
    def add(s: Column, c: Column) -> Column:
        v = F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
        return F.pmod(s * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.split(x, ""), F.lit(0), add)


def is_iban(x: Column) -> Column:
    p = F.replace(x, F.lit(" "), F.lit(""))
    return F.length(p).between(15, 34) & (_mod97(F.concat(F.substring(p, F.lit(5), F.length(p) - 4), F.substring(p, 1, 4))) == 1)


def iban(x: Column, key: Column) -> Column:
    """Country and letters stay, the account's digits are permuted, the check digits follow."""
    p = F.replace(x, F.lit(" "), F.lit(""))
    new = permuted_digits(_digits(F.substring(p, F.lit(5), F.length(p) - 4)), key, "iban")

    def checked(d: Column) -> Column:
        moved = _refilled(F.substring(p, F.lit(5), F.length(p) - 4), d)
        check = F.lpad((98 - _mod97(F.concat(moved, F.substring(p, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return _refilled(x, F.concat(check, d))

    return _let(new, checked)


def is_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(7, 15)


def phone(x: Column, key: Column) -> Column:
    """The country code stays: after a plus as many digits as it has by the table."""
    d = _digits(x)
    short = [c for c in CODES if len(c) == 2]
    code = F.when(~x.startswith("+"), 0).when(F.substring(d, 1, 1).isin(*[c for c in CODES if len(c) == 1]), 1).when(F.substring(d, 1, 2).isin(*short), 2).otherwise(3)
    return _refilled(x, permuted_digits(F.substring(d, code + 1, F.length(d) - code), key, "phone"), code)


def hexadecimal(x: Column, key: Column) -> Column:
    """Blocks of 12 digits (and the rest), each permuted by its place; in capital letters only if x has no small ones."""
    n = F.length(x)

    def block(i: Column) -> Column:
        b = F.substring(x, i * 12 + 1, F.lit(12))
        h = F.floor(F.length(b) / 2).cast("int")
        r = F.length(b) - h
        left = F.coalesce(F.conv(F.substring(b, F.lit(1), h), 16, 10).cast("long"), F.lit(0))
        s = feistel(left, F.conv(F.substring(b, h + 1, r), 16, 10), F.pow(F.lit(16.0), h), F.pow(F.lit(16.0), r), key, "key", n * 100 + i)
        return _let(s, lambda v: F.concat(F.when(h > 0, F.lpad(F.hex(v["a"]), h, "0")).otherwise(""), F.lpad(F.hex(v["b"]), r, "0")))

    out = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 12).cast("int")), block), "")
    return F.when(x.rlike("[a-f]"), F.lower(out)).otherwise(out)


def email(x: Column, key: Column) -> Column:
    at = F.split(F.lower(x), "@")
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("local"), at[0], at[1]), 256), 1, 16), F.lit("@d"), F.substring(F.sha2(F.concat_ws("|", key, F.lit("domain"), at[1]), 256), 1, 8), F.lit(".example.invalid"))


def pseudonym(x: Column, key: Column) -> Column:
    """Of one match; the match itself where it isn't valid."""
    def whole(pattern: str) -> Column:
        return x.rlike(f"^(?:{pattern})$")

    return (
        F.when(x.contains("@"), email(x, key))
        .when(whole(IBAN) & is_iban(x), iban(x, key))
        .when(whole(HEX), hexadecimal(x, key))
        .when(whole(WORDED), F.when(is_worded(x), worded_date(x, key)).otherwise(x))
        .when(whole(DATE), F.when(is_date(x), date(x, key)).otherwise(x))
        .when(whole(IP), F.when(is_ip(x), ip(x, key)).otherwise(x))
        .when(whole(SSN), F.when(~x.rlike("^(000|666|9..)|-00-|-0000$"), _refilled(x, permuted_digits(_digits(x), key, "ssn"))).otherwise(x))
        .when(whole(CARD) & is_card(x), card(x, key))
        .when(whole(PHONE) & is_phone(x), phone(x, key))
        .otherwise(x)
    )


def _part(text: Column, n: Column | int) -> Column:
    """A text and the number of values replaced in it."""
    return F.struct(text.alias("text"), (n if isinstance(n, Column) else F.lit(n)).alias("n"))


def _joined(parts: Column) -> Column:
    return _let(parts, lambda p: _part(F.array_join(p["text"], ""), F.aggregate(p["n"], F.lit(0), lambda s, n: s + n)))


def _replaced(x: Column, pattern: str, use) -> Column:
    """x with its matches put through ``use``, all of them parts."""
    new = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), use)
    return _joined(F.flatten(F.zip_with(F.split(x, pattern, -1), new, lambda p, m: F.array(_part(p, 0), F.coalesce(m, _part(F.lit(""), 0))))))


def _single(x: Column, key: Column) -> Column:
    return _let(pseudonym(x, key), lambda y: _part(y, (x != y).cast("int")))


def _cut(x: Column, key: Column) -> Column:
    """Of a run of groups: the account numbers and cards that are whole groups in a row, and the other values between them.

    Of those that overlap account numbers go first, then the longest, then the first."""
    group = "[A-Z0-9]+"
    lengths = F.create_map(*[F.lit(v) for pair in IBAN_LENGTHS.items() for v in pair])

    def kind(t: Column) -> Column:
        is_account = t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (F.length(t) == F.coalesce(lengths[F.substring(t, 1, 2)], F.length(t)))
        return F.when(is_account, F.when(is_iban(t), 0)).when(t.rlike("^[0-9]{13,19}$"), F.when(is_card(t), 1))

    def candidate(g: Column, i: Column, j: Column) -> Column:
        return _let(F.array_join(F.slice(g, i + 1, j - i + 1), ""), lambda t: F.struct(kind(t).alias("kind"), (-F.length(t)).alias("longest"), i.alias("i"), j.alias("j")))

    def best(g: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.filter(F.transform(F.sequence(i, F.least(i + MOST_GROUPS - 1, F.size(g) - 1)), lambda j: candidate(g, i, j)), lambda c: c["kind"].isNotNull()))
        none = F.array().cast("array<struct<kind:int,longest:int,i:int,j:int>>")
        taken = F.aggregate(F.array_sort(F.flatten(ends)), none, lambda s, c: F.when(F.exists(s, lambda k: (k["i"] <= c["j"]) & (c["i"] <= k["j"])), s).otherwise(F.concat(s, F.array(c))))
        return F.array_sort(F.transform(taken, lambda k: F.struct(k["i"].alias("i"), k["j"].alias("j"), k["kind"].alias("kind"))))

    def pieces(g: Column, marks: Column) -> Column:
        """The numbers and what stands between them; marks: what follows each group."""
        def some(a: Column, b: Column) -> Column:
            return F.array_join(F.flatten(F.zip_with(F.slice(g, a + 1, b - a), F.slice(marks, a + 1, b - a), lambda c, m: F.array(c, m))), "")

        def piece(text: Column, of: Column) -> Column:
            return F.struct(text.alias("text"), of.alias("kind"))

        def add(s: Column, k: Column) -> Column:
            number = F.concat(some(k["i"], k["j"]), F.element_at(g, k["j"] + 1))
            return F.struct((k["j"] + 1).alias("at"), F.concat(s["out"], F.array(piece(some(s["at"], k["i"]), F.lit(2)), piece(number, k["kind"]), piece(F.element_at(marks, k["j"] + 1), F.lit(3)))).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,kind:int>>").alias("out"))
        return F.aggregate(best(g), start, add, lambda s: F.concat(s["out"], F.array(piece(some(s["at"], F.size(g)), F.lit(2)))))

    def new(p: Column) -> Column:
        others = _replaced(p["text"], f"{BEFORE}(?:{OTHERS}){AFTER}", lambda m: _single(m, key))
        return F.when(p["kind"] == 0, _part(iban(p["text"], key), 1)).when(p["kind"] == 1, _part(card(p["text"], key), 1)).when(p["kind"] == 2, others).otherwise(_part(p["text"], 0))

    both = F.struct(F.regexp_extract_all(x, F.lit(group), F.lit(0)).alias("groups"), F.split(x, group, -1).alias("marks"))
    return _joined(F.transform(_let(both, lambda b: _let(F.slice(b["marks"], F.lit(2), F.size(b["groups"])), lambda marks: pieces(b["groups"], marks))), new))


def replaced(x: Column, key: Column) -> Column:
    """Of one match; a run of groups that is no valid number as a whole is cut."""
    return _let(_single(x, key), lambda y: F.when((y["n"] == 0) & x.rlike(rf"^(?:{IBANS}|{CARDS})$"), _cut(x, key)).otherwise(y))


def pseudonymise(docs: DataFrame, key: str | Column, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The table with its texts' personal data replaced, and, if asked for, the number of values replaced."""
    names = docs.columns
    used, held = "__new", "__key"
    while used in names or held in names:
        used, held = used + "_", held + "_"
    secret = F.lit(key) if isinstance(key, str) else F.col(held)
    text = F.col(f"`{text_col}`")
    some = text.rlike("[0-9@]|[a-fA-F]{32}") & text.rlike(PII)  # every match has one of the first
    df = docs if isinstance(key, str) else docs.withColumn(held, key)
    df = df.withColumn(used, F.when(some, _replaced(text, PII, lambda x: replaced(x, secret))))
    df = df.withColumn(text_col, F.coalesce(F.col(used)["text"], text))
    if count_col:
        df = df.withColumn(count_col, F.coalesce(F.col(used)["n"], F.lit(0)).cast("long"))
    return df.select(*[f"`{c}`" for c in names], *([count_col] if count_col else []))
