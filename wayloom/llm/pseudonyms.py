"""Format-preserving pseudonyms for numbers and dates (operator 1), with DataFrame functions only.

Found values are validated, then permuted within their own format by a keyed
Feistel network over two mixed-radix halves: a value always gets the same
pseudonym, another value another one, and the pseudonym is again valid in the
same format (a card number keeps its length and has a right check digit, an
address has octets up to 255, a date is a day of the calendar). Equal values
therefore stay linked across documents without a table.

Kinds: card numbers (13 to 19 digits with a right check digit, with or without
groups of four), IPv4 addresses (octets without leading zeros), +1 telephone numbers, US social security
numbers, dates from 1900-01-01 to 2100-05-02 as YYYY-MM-DD, DD.MM.YYYY and
MM/DD/YYYY, and e-mail addresses (the digits and the letters of the local part
become a keyed word of 16 digits; the domain stays). What looks like one of
them and isn't valid stays, but for telephone numbers: an area or exchange that is never assigned
(first digit 0 or 1, or last two 11) still may be someone's mistyped number, so it becomes
another one that is never assigned, and an assignable one another assignable one.

Who has the key can turn pseudonyms back. It is the argument ``key``, else the session's
``spark.wayloom.pseudonym.key``; where neither is set a public key is used, which is for tests.

Texts are read whole. A null text stays null, with counts of 0; an empty one
stays empty. Repeated rows are rewritten alike; an empty table gives an empty one. Other columns stay as they are
unless they have the name of a count (n_found, n_changed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The formats that are looked for, the first that fits at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}"
PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d)"
ANY = "|".join((EMAIL, PHONE, IPV4, CARD, SSN, DATE))


def _draw(key: str, kind: str, round_: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), round_.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Struct(l, r): a permutation of the pairs with 0 <= left < a and 0 <= right < b."""

    def turn(acc, i):
        l2 = F.pmod(acc["l"] + _draw(key, kind + "l", i, acc["r"]), a)
        return F.struct(l2.alias("l"), acc["r"].alias("r"))

    def turn_back(acc, i):
        r2 = F.pmod(acc["r"] + _draw(key, kind + "r", i, acc["l"]), b)
        return F.struct(acc["l"].alias("l"), r2.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, i: turn_back(turn(acc, i), i))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def check_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, right to left, every second digit doubled."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _card(key: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")

    def swap(d):
        body = F.length(d) - 1
        low = F.floor(body / 2).cast("int")
        high = body - low
        f = feistel(key, "card", F.substring(d, F.lit(1), high).cast("long"), F.substring(d, high + 1, low).cast("long"), _power(high), _power(low))
        new = _let(f, lambda x: F.concat(F.lpad(x["l"].cast("string"), high, F.lit("0")), F.lpad(x["r"].cast("string"), low, F.lit("0"))))
        full = _let(new, lambda x: F.concat(x, F.pmod(F.lit(10) - F.pmod(check_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        sep = F.substring(m, 5, 1)
        grouped = lambda x: F.concat(*[F.concat(F.substring(x, k, 4), sep) for k in (1, 5, 9)], F.substring(x, 13, 4))
        return F.when(F.length(m) == F.length(d), full).otherwise(_let(full, grouped))

    return _let(digits, lambda d: F.when(check_sum(d) % 10 == 0, swap(d)).otherwise(m))


def _ipv4(key: str, m: Column) -> Column:
    def swap(p):
        n = lambda k: F.element_at(p, k).cast("long")
        f = feistel(key, "ipv4", n(1) * 256 + n(2), n(3) * 256 + n(4), F.lit(65536), F.lit(65536))
        out = _let(f, lambda x: F.concat_ws(".", F.floor(x["l"] / 256).cast("string"), (x["l"] % 256).cast("string"), F.floor(x["r"] / 256).cast("string"), (x["r"] % 256).cast("string")))
        return F.when(F.exists(p, lambda o: (o.cast("int") > 255) | o.rlike("^0.")), m).otherwise(out)

    return _let(F.split(m, r"\."), swap)


def _code(n: Column) -> tuple[Column, Column, Column]:
    """Of an area or exchange: whether it can be assigned, its index among those alike, and how many these are."""
    valid = (n >= 200) & (n % 100 != 11)
    first, last = F.floor(n / 100), n % 100
    index = F.when(valid, (first - 2) * 99 + last - F.when(last > 11, 1).otherwise(0)).when(n < 200, n).otherwise(198 + first)
    return valid, index, F.when(valid, 792).otherwise(208)


def _code_text(valid: Column, index: Column) -> Column:
    last = index % 99
    high = (F.floor(index / 99) + 2) * 100 + last + F.when(last >= 11, 1).otherwise(0)
    n = F.when(valid, high).when(index < 200, index).otherwise((index - 198) * 100 + 11)
    return F.lpad(n.cast("string"), 3, "0")


def _phone(key: str, m: Column) -> Column:
    area, exchange, line = (F.substring(m, *at).cast("long") for at in ((5, 3), (10, 3), (14, 4)))
    va, a, na = _code(area)
    ve, e, ne = _code(exchange)
    f = feistel(key, "phone", a * 100 + F.floor(line / 100), e * 100 + line % 100, na * 100, ne * 100)

    def text(x):
        number = F.lpad((x["l"] % 100 * 100 + x["r"] % 100).cast("string"), 4, "0")
        return F.concat(F.lit("+1 ("), _code_text(va, F.floor(x["l"] / 100)), F.lit(") "), _code_text(ve, F.floor(x["r"] / 100)), F.lit("-"), number)

    return _let(f, text)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    f = feistel(key, "ssn", index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(x):
        a = F.floor(x["l"] / 99)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(f, text)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """Days 0 to 270 * 271 - 1 from 1900-01-01 are the pairs of the network."""
    zero = F.to_date(F.lit("1900-01-01"))

    def in_format(form: str) -> Column:
        def new(n):
            f = feistel(key, "date", F.floor(n / 271), n % 271, F.lit(270), F.lit(271))
            return _let(f, lambda x: F.date_format(F.date_add(zero, (x["l"] * 271 + x["r"]).cast("int")), form))

        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), zero)
        return _let(day, lambda n: F.when((n >= 0) & (n < 270 * 271), new(n)).otherwise(m))

    return (F.when(F.contains(m, F.lit("/")), in_format("MM/dd/yyyy")).when(F.contains(m, F.lit(".")), in_format("dd.MM.yyyy"))
            .otherwise(in_format("yyyy-MM-dd")))


def _email(key: str, m: Column) -> Column:
    local = F.lower(F.regexp_extract(m, "^[^@]+", 0))
    word = lambda k: F.lpad(F.pmod(_draw(key, "email", F.lit(k), local), F.lit(100_000_000)).cast("string"), 8, "0")
    return F.concat(F.lit("id"), word(1), word(2), F.regexp_extract(m, "@.*$", 0))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one found value; values that aren't valid come back as they are."""
    return (F.when(F.contains(m, F.lit("@")), _email(key, m))
            .when(F.startswith(m, F.lit("+")), _phone(key, m))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(key, m))
            .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{2}[./]\d{2}[./]\d{4}$"), _date(key, m))
            .when(F.contains(m, F.lit(".")), _ipv4(key, m))
            .otherwise(_card(key, m)))


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with text rewritten, and n_found and n_changed (long)."""
    key = key or docs.sparkSession.conf.get("spark.wayloom.pseudonym.key", "wayloom-1")
    text = F.col("text")
    counts = ("n_found", "n_changed")
    cols = [c for c in docs.columns if c not in counts]
    taken = {c.lower() for c in docs.columns}
    mark = "_"
    while any(mark + n in taken for n in ("found", "new")):
        mark += "_"
    found, new = mark + "found", mark + "new"
    some = text.rlike(r"@[A-Za-z0-9-]+\.") | (text.rlike(r"[0-9]") & text.rlike(r"\d{3}-\d{4}|\d{1,3}\.\d{1,3}\.\d|\d{4}[ -]?\d{4}[ -]?\d{4}|\d-\d{2}-\d{2,4}|\d[./]\d{2}[./]\d{4}"))
    d = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn(new, F.transform(found, lambda m: pseudonym(key, m)))
    gaps = F.split(text, ANY, -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(gaps, F.col(new), lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))))
    new_text = F.when(F.size(found) > 0, joined).otherwise(text)
    changed = F.size(F.filter(F.zip_with(found, new, lambda x, y: x != y), lambda x: x))
    return d.select(*(new_text.alias("text") if c == "text" else F.col(f"`{c}`") for c in cols),
                    F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_found"), F.coalesce(changed, F.lit(0)).cast("long").alias("n_changed"))
