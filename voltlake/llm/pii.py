"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

Found values are validated and then permuted within their format by a keyed Feistel network, so a value always has the
same pseudonym, in every document, and pseudonyms look like what they stand for:

* card numbers (13 to 19 digits, Luhn valid): all digits but the last are permuted, the last is the check digit again
* telephone numbers (optional country code, area code, 7 digits): digits are permuted, marks and country code stay, and the area code's first digit is 0 only where it was
* dates (ISO, or day and month with / or ., years 1800 to 2199, days that exist): another day that exists, in the same order and with the same marks; without leading zeros where a day or month had none. Different days have different pseudonyms, however they are spelled; a day has the same one in each order but that with the month first, which only days above the 12th can be seen to have (where both numbers could be months, the day comes first)
* social security numbers (three groups that are not all zero): others of that kind
* IPv4 addresses (octets up to 255): octets are permuted in two halves
* e-mail addresses (local part of up to 64 characters): letters and digits of the local part, each among their kind
* access keys (AKIA and 16 capitals or digits) and values of password=, token= or secret= (of six characters or more, however long; with
  blanks around the mark if they are quoted): letters and digits, each among their kind

What fails its validation stays as it is, and so does a secret after a colon, as in JSON. `pseudonymise` reads only the key and the text; columns of any other name are
ignored. Null text stays null (n_found 0), empty text empty; a null or repeated key is no matter; a long text is split at
its matches once. An empty table gives an empty result. The secret has no default: without it nobody can reverse a pseudonym.
The result holds no value as it was. One letter or digit alone of its kind has few pseudonyms to choose from, so it is hidden among ten or 26.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
_KEY = r"\bAKIA[A-Z0-9]{16}\b"
_ASSIGNED = r"(?i:\b(?:password|passwd|token|secret)(?:=| ?= ?[\"']))[A-Za-z0-9_+/-]{6,}+"
_DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d/-])"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
_CARD = r"(?<![\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"
KINDS = {"email": _EMAIL, "key": _KEY, "assigned": _ASSIGNED, "date": _DATE, "ip": _IP, "ssn": _SSN, "phone": _PHONE, "card": _CARD}
PATTERN = "|".join(KINDS.values())

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: str, secret: str) -> Column:
    """A permutation of pairs below the two sizes: each half in turn is moved by a keyed hash of the other one."""

    def move(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit(tweak), i.cast("string"), F.when(even, s["r"]).otherwise(s["l"]).cast("string")), 256), 1, 14), 16, 10).cast("long")
        return F.struct(
            F.when(even, (s["l"] + by % left_size) % left_size).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + by % right_size) % right_size).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), move)


def _power(base: int, n: Column) -> Column:
    """base ** n, exactly."""
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(1).cast("long"), lambda a, i: F.when(i > 0, a * base).otherwise(a))


def _digits(numeral: Column, base: int, tweak: str, secret: str) -> Column:
    """A numeral (digits 0-9a-z) of up to 36 (base 10) or 22 (base 26) digits among those of its length; longer ones in such pieces."""
    most = {10: 36, 26: 22}[base]

    def one(x: Column) -> Column:
        n = F.length(x)
        a, b = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
        number = lambda c: F.coalesce(F.conv(F.when(c == "", "0").otherwise(c), base, 10).cast("long"), F.lit(0))
        pair = _feistel(number(F.substring(x, F.lit(1), a)), number(F.substring(x, a + 1, b)), _power(base, a), _power(base, b), f"{tweak}{base}", secret)
        back = lambda v, width: F.when(width > 0, F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), width, "0")).otherwise("")
        return F.element_at(F.transform(F.array(pair), lambda p: F.concat(back(p["l"], a), back(p["r"], b))), 1)

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(numeral) - 1) / most).cast("int"))), lambda i: one(F.substring(numeral, i * most + 1, F.lit(most))))
    return F.when(F.length(numeral) > 0, F.array_join(pieces, "")).otherwise("")


def _refill(shape: Column, alphabet: str, chars: Column) -> Column:
    """`shape` with its characters of `alphabet`, in order, replaced by those of `chars`."""
    each = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when((c != "") & (F.instr(F.lit(alphabet), c) > 0), F.struct(F.concat(s["out"], F.substring(chars, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(each, start, step, lambda s: s["out"])


def _by_kind(text: Column, tweak: str, secret: str) -> Column:
    """Digits, small and capital letters of a text, each permuted among their kind; all else stays."""
    out = text
    for alphabet, pattern in ((_DIGITS, "[^0-9]"), (_LOWER, "[^a-z]"), (_UPPER, "[^A-Z]")):
        own = F.regexp_replace(text, pattern, "")
        if alphabet is _DIGITS:
            new = _digits(own, 10, tweak, secret)
        else:
            numerals = "0123456789abcdefghijklmnop"
            new = F.translate(_digits(F.translate(own, alphabet, numerals), 26, tweak + alphabet[0], secret), numerals, alphabet)
        out = _refill(out, alphabet, new)
    return out


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Of digits from the right; the last one doubled or not, then every other one."""
    value = lambda c, i: F.when(i % 2 == (0 if double_last else 1), F.when(2 * c > 9, 2 * c - 9).otherwise(2 * c)).otherwise(c)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(m: Column, secret: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    new = _digits(F.substring(digits, F.lit(1), F.length(digits) - 1), 10, "card", secret)
    whole = F.concat(new, ((10 - _luhn_sum(new, True) % 10) % 10).cast("string"))
    return F.when(_luhn_sum(digits, False) % 10 == 0, _refill(m, _DIGITS, whole)).otherwise(m)


def _phone(m: Column, secret: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    d = F.regexp_replace(rest, "[^0-9]", "")
    lead = F.substring(d, 1, 1).cast("int")
    number = lambda at, n: F.substring(d, at, n).cast("long")
    pair = F.when(lead == 0, _feistel(number(2, 4), number(6, 5), F.lit(10**4), F.lit(10**5), "phone0", secret)).otherwise(_feistel(number(1, 5) - 10**4, number(6, 5), F.lit(9 * 10**4), F.lit(10**5), "phone", secret))
    text = lambda p: F.concat(F.when(lead == 0, F.concat(F.lit("0"), F.lpad(p["l"].cast("string"), 4, "0"))).otherwise((p["l"] + 10**4).cast("string")), F.lpad(p["r"].cast("string"), 5, "0"))
    return F.concat(country, _refill(rest, _DIGITS, F.element_at(F.transform(F.array(pair), text), 1)))


def _date(m: Column, secret: str) -> Column:
    """Days of 400 years, 146,097 = 189 x 773 of them."""
    iso = m.rlike(r"^\d{4}-")
    parts = F.split(m, "[-/.]")
    # Where only one order gives a month, that is it; else the day comes first.
    a, b = F.element_at(parts, 1).cast("int"), F.element_at(parts, 2).cast("int")
    month_first = (~iso) & (b > 12)
    y, mo, d = F.when(iso, a).otherwise(F.element_at(parts, 3).cast("int")), F.when(iso, b).when(month_first, a).otherwise(b), F.when(iso, F.element_at(parts, 3).cast("int")).when(month_first, b).otherwise(a)
    day = F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    first = F.lit("1800-01-01").cast("date")
    n = F.datediff(day, first)
    moved = _feistel(F.floor(n / 773), n % 773, F.lit(189), F.lit(773), "date", secret)
    new = F.element_at(F.transform(F.array(moved), lambda p: F.date_add(first, (p["l"] * 773 + p["r"]).cast("int"))), 1)
    # Only days above the 12th can be told to have the month first, so these are permuted among themselves: there are 88,497 = 9 x 9,833.
    late = n - 12 * ((y - 1800) * 12 + mo)
    moved = _feistel(F.floor(late / 9833), late % 9833, F.lit(9), F.lit(9833), "month first", secret)
    begins = lambda k: F.datediff(F.add_months(first, (k - 1).cast("int")), first) + 12 - 12 * k  # noqa: E731  place of a month's 13th among them

    def day_at(p: Column) -> Column:
        place = p["l"] * 9833 + p["r"]
        guess = F.floor(place * 4800 / 88497)
        months = F.filter(F.transform(F.sequence(F.lit(-1), F.lit(3)), lambda i: guess + i), lambda k: (k >= 1) & (k <= 4800) & (begins(k) <= place))
        return F.element_at(F.transform(F.slice(months, -1, 1), lambda k: F.date_add(F.add_months(first, (k - 1).cast("int")), (place - begins(k) + 12).cast("int"))), 1)

    new = F.when(month_first, F.element_at(F.transform(F.array(moved), day_at), 1)).otherwise(new)
    mark = F.when(m.contains("/"), "/").otherwise(".")
    # A pseudonym's own day and month are written as the day comes first, or as the month does where it did.
    bare = m.rlike(r"^\d[/.]|[/.]\d[/.]")
    day_text, month_text = (F.when(bare, F.date_format(new, p[:1])).otherwise(F.date_format(new, p)) for p in ("dd", "MM"))
    slashed = F.concat(F.when(month_first, month_text).otherwise(day_text), mark, F.when(month_first, day_text).otherwise(month_text), mark, F.date_format(new, "yyyy"))
    return F.when((n >= 0) & (n < 146097), F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(slashed)).otherwise(m)


def _ip(m: Column, secret: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    at = lambda i: F.element_at(octets, i)
    pair = _feistel(at(1) * 256 + at(2), at(3) * 256 + at(4), F.lit(65536), F.lit(65536), "ip", secret)
    text = F.element_at(F.transform(F.array(pair), lambda p: F.concat_ws(".", F.floor(p["l"] / 256).cast("string"), (p["l"] % 256).cast("string"), F.floor(p["r"] / 256).cast("string"), (p["r"] % 256).cast("string"))), 1)
    return F.when(F.forall(octets, lambda x: x <= 255), text).otherwise(m)


def _ssn(m: Column, secret: str) -> Column:
    """999 areas; 99 groups of 9,999 numbers each."""
    part = lambda i: F.element_at(F.split(m, "-"), i).cast("long") - 1
    pair = _feistel(part(1), part(2) * 9999 + part(3), F.lit(999), F.lit(99 * 9999), "ssn", secret)
    padded = lambda x, n: F.lpad((x + 1).cast("int").cast("string"), n, "0")
    text = F.element_at(F.transform(F.array(pair), lambda p: F.concat_ws("-", padded(p["l"], 3), padded(F.floor(p["r"] / 9999), 2), padded(p["r"] % 9999, 4))), 1)
    return F.when(~m.rlike("^000|-00-|0000$"), text).otherwise(m)


def pseudonym(m: Column, secret: str) -> Column:
    """Of a match of PATTERN; itself where it isn't valid."""
    local = F.substring_index(m, "@", 1)
    value = F.regexp_extract(m, "[A-Za-z0-9_+/-]*$", 0)
    whole = lambda kind: m.rlike(f"^(?:{KINDS[kind]})$")
    cases = [
        (m.contains("@"), F.concat(_by_kind(local, "email", secret), F.substring(m, F.length(local) + 1, F.length(m)))),
        (m.contains("="), F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), _by_kind(value, "assigned", secret))),
        (m.startswith("AKIA"), F.concat(F.lit("AKIA"), _by_kind(F.substring(m, F.lit(5), F.length(m)), "key", secret))),
        (whole("date"), _date(m, secret)),
        (whole("ip"), _ip(m, secret)),
        (whole("ssn"), _ssn(m, secret)),
        (whole("phone"), _phone(m, secret)),
    ]
    return reduce(lambda other, case: F.when(case[0], case[1]).otherwise(other), reversed(cases), _card(m, secret))


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: the key, the text with pseudonyms, n_found (values that have another one now), and these pseudonyms in order."""
    if not secret:
        raise ValueError("pseudonyms need a secret")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Each kind has a digit, an @ or one of two words in it: other texts aren't searched.
    matches = F.when(F.col("text").rlike(r"[0-9@]|AKIA|="), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = rows.withColumn("found", F.coalesce(matches, F.array().cast("array<string>")))
    found = found.withColumn("new", F.transform("found", lambda m: pseudonym(m, secret)))
    parts = F.split("text", PATTERN, -1)
    woven = F.array_join(F.zip_with(parts, "new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    moved = F.filter(F.arrays_zip(F.col("found").alias("value"), F.col("new").alias("pseudonym")), lambda p: p["value"] != p["pseudonym"])
    return found.select(
        F.col("key").alias(key),
        F.when(F.size("found") > 0, woven).otherwise(F.col("text")).alias("text"),
        F.size(moved).cast("long").alias("n_found"),
        F.transform(moved, lambda p: p["pseudonym"]).alias("pseudonyms"),
    )
