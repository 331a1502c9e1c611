"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

A value is found by pattern, validated (check digits, calendar, ranges), and replaced by a keyed permutation of the values of
its format: a Feistel network whose rounds add a digest of one half of the symbols to the other half, each symbol modulo the
size of its own alphabet. Equal values get equal pseudonyms in all documents, and different ones different pseudonyms. What
fails its validation stays as it is.

| kind | accepted | permuted | kept |
| card | 13-19 digits, plain or in groups, Luhn | all digits but the last | grouping; the check digit is made anew |
| iban | mod-97 check, in the length of its country | account letters and digits | country, grouping; the check digits are made anew |
| phone | +country and 7-14 digits, or NANP grouping | subscriber digits | country code, punctuation |
| ssn | US ranges | area, group, serial within their ranges | dashes |
| ipv4 | four octets | octets | |
| date | calendar days of 1900-2099 in four notations | day number, so one day stays one day in every notation | notation |
| email | local part and dotted domain | letters and digits of the local part, by class | domain, dots |
| secret | 16 or more symbols assigned to token, secret, password or key | letters and digits, by class | |
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import whole_row

ROUNDS = 8

# Alphabets within which a symbol stays.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_START, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}


def _iban_pattern() -> str:
    """A known country's own length, so that a following word is not taken; else any length."""
    known = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        known.append(f"(?:{countries.replace(' ', '|')})\\d\\d(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "") + _END)
    return (_START + r"(?=[A-Z]{2}\d\d)(?:" + "|".join(known) + "|" + r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END + ")")


# In the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?<=(?:token|secret|password|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{16,}+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": _iban_pattern(),
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}" + _END
             + "|" + _START + r"(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}" + _END,
    "date": _START + r"(?:\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4})" + _END,
    "ssn": _START + r"\d{3}-\d\d-\d{4}" + _END,
    "ipv4": r"(?<![\p{L}\p{N}.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
    "card": _START + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


# What follows is built of Columns, not of SQL text: the parser's tables for so long an expression would stay on the driver's heap.

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _feistel(symbols: Column, radices: Column, kind: str, key: str) -> Column:
    """Permute an array<bigint> of symbols, each within 0..radix-1; symbols at even and odd places are the halves."""
    def moved(half: Column, round_: Column) -> Column:
        def symbol(x: Column, i: Column) -> Column:
            others = F.transform(F.filter(half, lambda y, j: j % 2 != round_ % 2), lambda y: y.cast("string"))
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(half), round_, i, F.array_join(others, ",")), 256)
            drawn = F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")
            return F.when(i % 2 == round_ % 2, (x + drawn) % F.get(radices, i)).otherwise(x)

        return F.transform(half, symbol)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), symbols, moved)


def _alphabet(c: Column) -> Column:
    found = F
    for a in ALPHABETS:
        found = found.when(F.contains(F.lit(a), c), a)
    return found.otherwise("")


def _poured(form: Column, symbols: Column, movable: Callable[[Column], Column]) -> Column:
    """The text `form` with its movable characters replaced in order by the characters of `symbols`."""
    def state(t: Column, n: Column) -> Column:
        return F.struct(t.alias("t"), n.alias("n"))

    def step(s: Column, c: Column) -> Column:
        moved = state(F.concat(s["t"], F.substr(symbols, s["n"] + 1, F.lit(1))), s["n"] + 1)
        return F.when(movable(c), moved).otherwise(state(F.concat(s["t"], c), s["n"]))

    # Walks the characters once; the state is the text so far and the number of symbols used.
    return F.aggregate(_characters(form), state(F.lit(""), F.lit(0)), step, lambda s: s["t"])


def _permuted_text(value: Column, kind: str, key: str) -> Column:
    """Every letter and digit moved within its alphabet, everything else in place."""
    def symbols(ch: Column, radices: Column) -> Column:
        places = F.transform(ch, lambda c: (F.instr(_alphabet(c), c) - 1).cast("bigint"))
        return F.array_join(F.zip_with(ch, _feistel(places, radices, kind, key),
                                       lambda c, x: F.substr(_alphabet(c), x.cast("int") + 1, F.lit(1))), "")

    def poured(ch: Column) -> Column:
        made = _let(F.transform(ch, lambda c: F.length(_alphabet(c))), lambda radices: symbols(ch, radices))
        return _let(made, lambda sym: _poured(value, sym, lambda c: _alphabet(c) != ""))

    return _let(F.filter(F.split(value, ""), lambda c: (c != "") & (_alphabet(c) != "")), poured)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_digit(c: Column) -> Column:
    return F.contains(F.lit("0123456789"), c)


def _card(v: Column, key: str) -> Column:
    """Luhn numbers: all digits but the last, and the check digit that belongs to them."""
    def checked(b: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda x: F.call_function("luhn_check", F.concat(b, x.cast("string"))))
        return F.concat(b, F.get(fits, 0).cast("string"))

    def new(d: Column) -> Column:
        body = _permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
        return _let(body, lambda b: _let(checked(b), lambda sym: _poured(v, sym, _is_digit)))

    return _let(_digits(v), lambda d: F.when(F.call_function("luhn_check", d), new(d)).otherwise(v))


def _mod97(text: Column) -> Column:
    """The ISO 7064 remainder of letters and digits."""
    return F.aggregate(_characters(text), F.lit(0), lambda acc, c: F.when(_is_digit(c), (acc * 10 + c.cast("int")) % 97).otherwise(
        (acc * 100 + F.ascii(c) - 55) % 97))


def _iban(v: Column, key: str) -> Column:
    def without_blanks(x: Column) -> Column:
        return F.replace(x, F.lit(" "), F.lit(""))

    def made(p: Column, d: Column) -> Column:
        def whole(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(b, F.substring(d, 1, 2), F.lit("00")))).cast("string"), 2, "0")
            return F.concat(F.substring(d, 1, 2), check, b)

        body = _permuted_text(F.substr(d, F.lit(5)), "iban", key)
        new = _let(body, lambda b: _let(whole(b), lambda sym: _poured(p, sym, lambda c: c != " ")))
        return F.concat(new, F.substr(v, F.length(p) + 1))

    def valid(d: Column) -> Column:
        remainder = _mod97(F.concat(F.substr(d, F.lit(5)), F.substring(d, 1, 4)))
        return (F.length(d) >= 12) & (remainder == 1) & F.substring(d, 3, 2).between("02", "98")

    # Of a country with no known length, last groups that belong to the next words make the check fail; they are left off.
    known = " ".join(IBAN_LENGTHS.values()).split()

    def part(g: Column) -> Column:
        shorter = F.transform(F.sequence(F.size(g), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(g, 1, n), " "))
        tried = F.when(F.substring(v, 1, 2).isin(known), F.array(v)).otherwise(shorter)
        return F.get(F.filter(tried, lambda x: _let(without_blanks(x), valid)), 0)

    return _let(_let(F.split(v, " "), part),
                lambda p: F.when(p.isNull(), v).otherwise(_let(without_blanks(p), lambda d: made(p, d))))


def _phone(v: Column, key: str) -> Column:
    """The country code (up to the first other character, or one digit of an unbroken number) stays."""
    code = F.when(v.rlike("^[+][0-9]{1,3}[^0-9]"), F.regexp_extract(v, "^[+][0-9]{1,3}", 0)).when(
        v.rlike("^[+]"), F.substring(v, 1, 2)).otherwise("")

    def new(code: Column) -> Column:
        return F.concat(code, _permuted_text(F.substr(v, F.length(code) + 1), "phone", key))

    return _let(code, lambda code: F.when(F.length(_digits(v)).between(8, 15), new(code)).otherwise(v))


def _numbers(v: Column, separator: str) -> Column:
    return F.transform(F.split(v, separator), lambda p: p.cast("bigint"))


def _array(*numbers: int) -> Column:
    return F.array(*[F.lit(n) for n in numbers])


def _ssn(v: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
    def written(m: Column) -> Column:
        area = m[0] + F.when(m[0] >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((m[1] + 1).cast("string"), 2, "0"),
                           F.lpad((m[2] + 1).cast("string"), 4, "0"))

    def new(n: Column) -> Column:
        places = F.array(n[0] - F.when(n[0] > 666, 2).otherwise(1), n[1] - 1, n[2] - 1)
        return _let(_feistel(places, _array(898, 99, 9999), "ssn", key), written)

    def valid(n: Column) -> Column:
        return n[0].between(1, 899) & (n[0] != 666) & (n[1] > 0) & (n[2] > 0)

    return _let(_numbers(v, "-"), lambda n: F.when(valid(n), new(n)).otherwise(v))


def _ipv4(v: Column, key: str) -> Column:
    moved = _feistel(_numbers(v, "[.]"), _array(256, 256, 256, 256), "ipv4", key)
    return F.array_join(F.transform(moved, lambda x: x.cast("string")), ".")


def _date(v: Column, key: str) -> Column:
    """Day numbers from 1900-01-01; there are 73049 = 17 * 4297 of them."""
    first = F.lit(datetime.date(1900, 1, 1))

    def new_day(day: Column) -> Column:
        places = F.array((day % 17).cast("bigint"), ((day - day % 17) / 17).cast("bigint"))
        return _let(_feistel(places, _array(17, 4297), "date", key), lambda m: F.date_add(first, (m[1] * 17 + m[0]).cast("int")))

    def made(day: Column, form: str) -> Column:
        return F.when(day.between(0, 73048), F.date_format(new_day(day), form)).otherwise(v)

    out = v
    for pattern, form in (("^[0-9]+[/]", "d/M/yyyy"), ("^[0-9]+[.]", "d.M.yyyy"), ("^[0-9]{2}[/][0-9]{2}[/]", "dd/MM/yyyy"),
                          ("^[0-9]{2}[.][0-9]{2}[.]", "dd.MM.yyyy"), ("^[0-9]{4}-", "yyyy-MM-dd")):
        parsed = F.datediff(F.try_to_timestamp(v, F.lit(form)), first)
        out = F.when(v.rlike(pattern), _let(parsed, lambda day: made(day, form))).otherwise(out)
    return out


def _replacement(v: Column, key: str) -> Column:
    """struct(kind, new) for a match; new equals the match where validation fails."""
    made = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date}
    email = F.concat(_permuted_text(F.substring_index(v, "@", 1), "email", key), F.lit("@"), F.substring_index(v, "@", -1))

    def named(kind: str, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), new.alias("new"))

    # Which alternative matched; the look-behind of `secret` is gone, so it is what fits no other kind.
    out = F
    for k in ("email", "ipv4", "date", "ssn", "phone", "card", "iban"):
        out = out.when(v.rlike(f"^(?:{PATTERNS[k]})$"), named(k, email if k == "email" else made[k](v, key)))
    return out.otherwise(named("secret", _permuted_text(v, "secret", key)))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str = "pseudonyms") -> DataFrame:
    """Replace the text column and add `found`: array of (kind, new) for every replaced value, in text order.

    All other columns and all rows stay as they are; a null text stays null (found is empty), repeated rows give repeated
    results. The column named by `found` is replaced if it exists. key is secret: whoever has it can reverse the pseudonyms.
    """
    names = [c for c in docs.columns if c != found]
    of = F.col("_text")
    # Without a digit or an at sign nothing can match, so most texts are read once, by a search for one character class.
    hit = F.coalesce(of.rlike("[0-9@]|(?:token|secret|password|key)[\"' =:]") & of.rlike(ANY), F.lit(False))
    rows = docs.select(whole_row(docs).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.select("_row", "_text", F.when(hit, F.regexp_extract_all(of, F.lit(ANY), F.lit(0))).alias("_matches"))
    rows = rows.select("_row", "_text", "_matches", F.transform("_matches", lambda v: _replacement(v, key)).alias("_new"))
    between = F.split(of, ANY, -1)
    new_text = F.array_join(F.zip_with(between, F.concat(F.transform("_new", lambda n: n["new"]), F.array(F.lit(""))),
                                       lambda a, b: F.concat(a, b)), "")
    changed = F.filter(F.zip_with("_matches", "_new", lambda v, n: F.struct(
        n["kind"].alias("kind"), n["new"].alias("new"), (v != n["new"]).alias("changed"))), lambda x: x["changed"])
    listed = F.transform(changed, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("new")))
    return rows.select(
        *[F.coalesce(new_text, of).alias(text) if c == text else F.col("_row").getField(c).alias(c) for c in names],
        F.coalesce(listed, F.array().cast("array<struct<kind:string,new:string>>")).alias(found))


def kinds(found: str = "pseudonyms") -> Column:
    """The distinct kinds among the replaced values, sorted and comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.col(found)["kind"])), ",")
