"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Values are found by pattern, validated, and permuted by a keyed Feistel
network within their own format: a card number stays a card number with a
right check digit, an address keeps four octets, a date stays a real date.
The permutation depends on the key and the value alone, so equal values stay
linked across documents, and distinct values of a format stay distinct.

Kinds: ``email`` (the local part, of any length, with the letters, numbers and
marks of every script; the domain, also an international one of up to 127
labels, stays), ``card`` (13-19 digits, Luhn), ``ipv4``, ``phone`` (the last ten
digits, in groups of 3, 3 and 4), ``ssn``, ``iban`` (mod 97; in one piece, or in
groups of four where the country's length is known), ``date`` (yyyy-mm-dd,
yyyy/mm/dd, day first with ``/`` or ``.``, with ``.`` also without leading zeros,
month first with ``/`` where that is no date; years 1800-2199) and ``secret`` (a
quoted run of 32 or more hexadecimal digits).  What fails its validation (a
number with a wrong check digit, 2023-02-30) is left as it is.  A kind is
reported where a value changed, an e-mail only if no run of two or more letters
or numbers of its local part is as it was.

Not looked for: IPv6 addresses, telephone numbers in other groups, secrets
without quotes or in other alphabets.

Defined results: null text stays null with nothing found; a text without a
valid value is unchanged.  Rows are independent, null and repeated ids do not
matter; other columns are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 8

#: The alphabets within which a character is permuted.
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
HEX = "0123456789abcdef"


def _other_letters() -> tuple[tuple[str, ...], tuple[str, ...], list[tuple[int, int]]]:
    """The letters, numbers and marks outside the alphabets above: lower case
    with a capital of its own, by script; single ones, by class; and runs of code
    points of one class without case (first, length)."""
    known = set(DIGITS + LETTERS + ACCENTED)
    known |= {c.upper() for c in known}
    kind = lambda c: unicodedata.category(c)[0]
    rest = [c for c in map(chr, range(128, 0x110000)) if kind(c) in "LMN" and c not in known]
    lower = [c for c in rest if len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c and c.upper() not in known]
    scripts: dict[str, str] = {}
    for c in lower:
        script = unicodedata.name(c).split()[0]
        scripts[script] = scripts.get(script, "") + c
    cased = set(lower) | {c.upper() for c in lower}
    plain = [c for c in rest if c not in cased]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(plain), lambda x: (ord(x[1]) - x[0], kind(x[1])))]
    single = tuple("".join(r[0] for r in runs if len(r) == 1 and kind(r[0]) == k) for k in "LMN")
    return tuple(scripts.values()), tuple(s for s in single if s), [(ord(r[0]), len(r)) for r in runs if len(r) > 1]


CASED, SINGLES, RUNS = _other_letters()
#: Codes from here on are code points of ``RUNS``.
_POINT = 1 << 24

#: Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(
    rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, countries in IBAN_LENGTHS.items())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: How each kind is written (Java regular expressions).
PATTERNS = {
    "email": (r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{M}\p{N}_-]{1,63}\.){1,126}"
              r"(?:xn--[A-Za-z0-9-]{1,59}|[\p{L}\p{M}]{2,63})(?![\p{L}\p{M}\p{N}])"),
    "iban": r"(?<![\p{L}\p{N}])(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + _GROUPED + r")(?![\p{L}\p{N}])",
    "ipv4": rf"(?<![\p{{L}}\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\p{L}\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "card": r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "secret": r"(?<=[\"'])[0-9A-Fa-f]{32,}+(?=[\"'])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _draw(key: str, tweak: str, step: Column, other: Column) -> Column:
    """The round function: 64 hexadecimal digits from key, round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), step.cast("string"), other).cast("binary"), 256)


def _part(digest: Column, i: Column) -> Column:
    """16 bits of a digest; positions beyond the sixteenth start over."""
    return F.conv(F.substr(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, tweak: str) -> Column:
    """Permute the numbers 0 <= a < size_a, 0 <= b < size_b as one pair:
    ``struct<a, b>``.  The domain is exactly size_a x size_b."""
    start = F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"),
                     F.lit(size_a).alias("ma"), F.lit(size_b).alias("mb"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, step: F.struct(
        s["b"].alias("a"),
        F.pmod(s["a"] + _part(_draw(key, tweak, step, s["b"].cast("string")), F.lit(0)), s["ma"]).alias("b"),
        s["mb"].alias("ma"), s["ma"].alias("mb")))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel_text(value: Column, key: str, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LETTERS, ACCENTED),
                 every: bool = False) -> Column:
    """Permute the characters of a text within their alphabets.  Case is
    kept apart, so a value in capitals gets the same pseudonym in capitals.
    With ``every`` all other letters, numbers and marks are permuted too,
    within their script or run of code points; characters of no alphabet stay."""
    cased = alphabets + CASED if every else alphabets
    sets = cased + SINGLES if every else cased
    symbols, upto = "".join(sets), len("".join(cased))
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    firsts, sizes = (F.split(F.lit(",".join(str(r[i]) for r in RUNS)), ",").cast("array<int>") for i in (0, 1))
    run = lambda point: F.size(F.filter(firsts, lambda f: f <= point)) - 1

    def code(c):
        plain = F.instr(F.lit(symbols[:upto]), F.lower(c)) - 1
        if not every:
            return plain
        single = F.instr(F.lit("".join(SINGLES)), c) - 1
        point = F.ascii(c)
        return (F.when(plain >= 0, plain).when(single >= 0, single + upto)
                .when(_let(run(point), lambda r: (r >= 0) & (point < F.get(firsts, r) + F.get(sizes, r))), point + _POINT)
                .otherwise(F.lit(-1)))

    def per_alphabet(c, pick, beyond):
        """pick(start, size) of the alphabet that holds symbol number c."""
        out, begin = None, 0
        for a in sets:
            v = F.lit(pick(begin, len(a)))
            out = F.when(c < begin + len(a), v) if out is None else out.when(c < begin + len(a), v)
            begin += len(a)
        return out.otherwise(beyond(run(c - _POINT)) if every else F.lit(1))

    first = lambda x: per_alphabet(x, lambda b, n: b, lambda r: F.get(firsts, r) + _POINT)
    size = lambda x: per_alphabet(x, lambda b, n: n, lambda r: F.get(sizes, r))
    ints = "array<int>"

    def step(s, k):
        digest = _draw(key, tweak, k, F.array_join(s["b"].cast("array<string>"), "."))
        moved = _let(digest, lambda d: F.transform(s["a"], lambda x, i: F.pmod(x + _part(d, i), F.get(s["ra"], i))))
        return F.struct(s["b"].alias("a"), moved.cast(ints).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    def permuted(codes):
        """The new codes of the characters that have one."""
        within = F.transform(codes, lambda x: x - first(x)).cast(ints)
        radix = F.transform(codes, size).cast(ints)
        half = F.floor(F.size(codes) / 2).cast("int")
        rest = F.size(codes) - half
        start = F.struct(F.slice(within, F.lit(1), half).alias("a"), F.slice(within, half + 1, rest).alias("b"),
                         F.slice(radix, F.lit(1), half).alias("ra"), F.slice(radix, half + 1, rest).alias("rb"))
        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))
        return F.zip_with(done, codes, lambda x, c: x + first(c))

    def symbol(x):
        plain = F.substr(F.lit(symbols), x + 1, F.lit(1))
        point = F.decode(F.unhex(F.lpad(F.hex((x - _POINT).cast("long")), 8, "0")), "UTF-32")
        return F.when(x < len(symbols), plain).otherwise(point) if every else plain

    def put(chars, codes):
        places = F.sequence(F.lit(0), F.size(chars))        # one more, which get() finds null
        moved = F.zip_with(F.filter(places, lambda i: F.get(codes, i) >= 0), permuted(F.filter(codes, lambda x: x >= 0)),
                           lambda i, x: F.struct(i.alias("i"), F.when(
                               (x < upto) & (F.get(chars, i) != F.lower(F.get(chars, i))), F.upper(symbol(x)))
                               .otherwise(symbol(x)).alias("c")))
        others = F.transform(F.filter(places, lambda i: F.get(codes, i) < 0),
                             lambda i: F.struct(i.alias("i"), F.get(chars, i).alias("c")))
        return F.array_join(F.transform(F.sort_array(F.concat(moved, others)), lambda s: s["c"]), "")

    return _let(chars, lambda chars: _let(F.transform(chars, code), lambda codes: put(chars, codes)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _card(v: Column, key: str) -> Column:
    body = feistel_text(F.substr(v, F.lit(1), F.length(v) - 1), key, "card", (DIGITS,))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    check = F.filter(numbers, lambda d: F.call_function("luhn_check", F.concat(_digits(body), d)))
    return F.concat(body, F.get(check, F.lit(0)))


def _ipv4(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("int"))
    p = feistel_pair(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)),
                     F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), 65536, 65536, key, "ipv4")
    return F.get(F.transform(F.array(p), lambda q: F.concat_ws(
        ".", F.shiftright(q["a"], 8), q["a"] % 256, F.shiftright(q["b"], 8), q["b"] % 256)), F.lit(0))


def _phone(v: Column, key: str) -> Column:
    """Ten digits are permuted; a country code stays."""
    head = F.regexp_extract(v, r"^(\+\d{1,3}[ .-]?)?", 0)
    return F.concat(head, feistel_text(F.substr(v, F.length(head) + 1, F.length(v)), key, "phone", (DIGITS,)))


#: 400 Gregorian years are 146,097 days = 189 x 773.
_FIRST_DAY, _DAYS_A, _DAYS_B = "1800-01-01", 189, 773


def _written(v: Column, day_at: int, month_at: int) -> Column:
    """The date of dd/mm/yyyy or mm/dd/yyyy; null where there is none."""
    return F.concat_ws("-", F.substr(v, F.lit(7), F.lit(4)), F.substr(v, F.lit(month_at), F.lit(2)),
                       F.substr(v, F.lit(day_at), F.lit(2))).try_cast("date")


def _year_first(v: Column) -> Column:
    return v.rlike(r"^\d{4}")


def _month_first(v: Column) -> Column:
    return v.contains("/") & ~_year_first(v) & _written(v, 1, 4).isNull()


def _day(v: Column) -> Column:
    """Days since the first day of the domain; null where there is no such date."""
    parts = F.split(v, r"\.")
    dotted = F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    date = (F.when(_year_first(v), F.translate(v, "/", "-").try_cast("date")).when(v.contains("."), dotted.try_cast("date"))
            .when(_month_first(v), _written(v, 4, 1)).otherwise(_written(v, 1, 4)))
    return F.date_diff(date, F.lit(_FIRST_DAY).cast("date"))


def _date(v: Column, key: str) -> Column:
    p = feistel_pair(F.floor(_day(v) / _DAYS_B), F.pmod(_day(v), F.lit(_DAYS_B)), _DAYS_A, _DAYS_B, key, "date")
    iso = F.get(F.transform(F.array(p), lambda q: F.date_add(
        F.lit(_FIRST_DAY).cast("date"), q["a"] * _DAYS_B + q["b"]).cast("string")), F.lit(0))
    y, m, d = (F.substr(iso, F.lit(i), F.lit(n)) for i, n in ((1, 4), (6, 2), (9, 2)))
    bare = lambda x: F.regexp_replace(x, "^0", "")
    return (F.when(_year_first(v), F.when(v.contains("/"), F.concat_ws("/", y, m, d)).otherwise(iso))
            .when(_month_first(v), F.concat_ws("/", m, d, y)).when(v.contains("/"), F.concat_ws("/", d, m, y))
            .when(F.length(v) < 10, F.concat_ws(".", bare(d), bare(m), y))      # written without leading zeros
            .otherwise(F.concat_ws(".", d, m, y)))


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN whose first four characters went to the end."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(
        F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97).cast("int"))


def _iban(v: Column, key: str) -> Column:
    land, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5), F.length(v))
    new = feistel_text(account, key, "iban", (DIGITS, LETTERS))
    check = 98 - _mod97(F.concat(F.replace(new, F.lit(" "), F.lit("")), land, F.lit("00")))
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), new)


def kind_of(v: Column) -> Column:
    """The validated kind of a found value; null when it is none."""
    bare = F.replace(v, F.lit(" "), F.lit(""))
    is_ = lambda kind: v.rlike(f"^(?:{_standing(kind)})$")
    return (F.when(v.contains("@"), F.lit("email"))
            .when(is_("iban"), F.when(_mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare)),
                                                      F.substr(bare, F.lit(1), F.lit(4)))) == 1, F.lit("iban")))
            .when(is_("ipv4"), F.lit("ipv4"))
            .when(is_("date"), F.when(_day(v).between(0, _DAYS_A * _DAYS_B - 1), F.lit("date")))
            .when(is_("ssn"), F.when(~v.rlike(r"^(?:000|666|9)") & ~v.rlike(r"-00-|-0000$"), F.lit("ssn")))
            .when(is_("phone"), F.lit("phone"))
            .when(is_("card") & F.call_function("luhn_check", _digits(v)), F.lit("card"))
            .when(v.rlike("^[0-9A-Fa-f]{32,}$"), F.lit("secret")))


def _standing(kind: str) -> str:
    """A kind's pattern without its look-arounds, for a value that stands alone."""
    return re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\])*\)", "", PATTERNS[kind])


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    """The value permuted within its format."""
    local, domain = F.split_part(v, F.lit("@"), F.lit(1)), F.split_part(v, F.lit("@"), F.lit(2))
    usual = local.rlike(f"^[A-Za-z0-9._%+{ACCENTED}{ACCENTED.upper()}-]*$")
    name = F.when(usual, feistel_text(local, key, "email")).otherwise(feistel_text(local, key, "email", every=True))
    return (F.when(kind == "email", F.concat(name, F.lit("@"), domain))
            .when(kind == "iban", _iban(v, key))
            .when(kind == "ipv4", _ipv4(v, key))
            .when(kind == "date", _date(v, key))
            .when(kind == "ssn", feistel_text(v, key, "ssn", (DIGITS,)))
            .when(kind == "phone", _phone(v, key))
            .when(kind == "card", _card(v, key))
            .when(kind == "secret", feistel_text(v, key, "secret", (HEX,)))
            .otherwise(v))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """Replace the private values of a text column.  With ``found`` a column
    of that name lists the kinds replaced, in text order."""
    values, kinds, news = fresh("values"), fresh("kinds"), fresh("news")
    # one cheap test spares the texts without a digit or an @ the long pattern
    candidates = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    out = docs.withColumn(values, F.coalesce(candidates, F.array().cast("array<string>")))
    out = out.withColumn(kinds, F.transform(values, kind_of))
    out = out.withColumn(news, F.zip_with(values, kinds, lambda v, k: pseudonym(v, k, key)))
    between = F.split(F.col(text), ANY, -1)
    rebuilt = F.array_join(F.zip_with(between, news, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")
    changed = F.when(F.exists(kinds, lambda k: k.isNotNull()), rebuilt).otherwise(F.col(text))
    kept = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found:
        runs = lambda v: F.split(F.split_part(v, F.lit("@"), F.lit(1)), r"[^\p{L}\p{M}\p{N}]+")
        left = lambda old, new: F.exists(F.zip_with(runs(old), runs(new), lambda a, b: (a == b) & (F.length(a) > 1)), lambda x: x)
        replaced = F.filter(kinds, lambda k, i: k.isNotNull() & (F.get(values, i) != F.get(news, i))
                            & ((k != "email") | ~left(F.get(values, i), F.get(news, i))))
        kept.append(replaced.alias(found))
    return out.select(*kept)
