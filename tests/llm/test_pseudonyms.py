"""Pseudonyms against a plain Feistel network over the same halves."""

import datetime
import hashlib
import random

KEY = "k-7"


def draw(kind, i, v):
    return int(hashlib.sha256(f"{KEY}:{kind}:{i}:{v}".encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, a, b):
    assert 0 <= left < a and 0 <= right < b
    for i in range(1, 9):
        left = (left + draw(kind + "l", i, right)) % a
        right = (right + draw(kind + "r", i, left)) % b
    return left, right


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total


def card(m):
    d = m.replace(" ", "").replace("-", "")
    if luhn(d) % 10:
        return m
    body = len(d) - 1
    low = body // 2
    high = body - low
    x, y = feistel("card", int(d[:high]), int(d[high : high + low]), 10**high, 10**low)
    new = f"{x:0{high}d}{y:0{low}d}"
    new += str(-luhn(new + "0") % 10)
    return new if len(m) == len(d) else m[4].join(new[k : k + 4] for k in range(0, 16, 4))


def ipv4(m):
    o = m.split(".")
    if any(int(x) > 255 or (x[0] == "0" and x != "0") for x in o):
        return m
    o = [int(x) for x in o]
    x, y = feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


GOOD = [n for n in range(1000) if n >= 200 and n % 100 != 11]
POOR = [n for n in range(1000) if n < 200 or n % 100 == 11]


def phone(m):
    area, exchange, line = int(m[4:7]), int(m[9:12]), int(m[13:17])
    A, E = (GOOD if n in GOOD else POOR for n in (area, exchange))
    x, y = feistel("phone", A.index(area) * 100 + line // 100, E.index(exchange) * 100 + line % 100, len(A) * 100, len(E) * 100)
    return f"+1 ({A[x // 100]:03d}) {E[y // 100]:03d}-{x % 100 * 100 + y % 100:04d}"


AREAS = [n for n in range(1, 900) if n != 666]


def ssn(m):
    area, group, serial = (int(x) for x in m.split("-"))
    if area not in AREAS or not group or not serial:
        return m
    x, y = feistel("ssn", AREAS.index(area) * 99 + group - 1, serial - 1, 898 * 99, 9999)
    return f"{AREAS[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"


ZERO = datetime.date(1900, 1, 1)


def date(m, form):
    try:
        n = (datetime.datetime.strptime(m, form).date() - ZERO).days
    except ValueError:
        return m
    if not 0 <= n < 270 * 271:
        return m
    x, y = feistel("date", n // 271, n % 271, 270, 271)
    return (ZERO + datetime.timedelta(x * 271 + y)).strftime(form)


def email(m):
    local, domain = m.split("@")
    word = [draw("email", k, local.lower()) % 10**8 for k in (1, 2)]
    return f"id{word[0]:08d}{word[1]:08d}@{domain}"


def test_every_kind_by_a_plain_feistel(spark):
    from wayloom.llm.pseudonyms import pseudonymise

    r = random.Random(9)
    cases = []
    for _ in range(60):
        body = "".join(str(r.randrange(10)) for _ in range(r.randrange(12, 19)))
        cases.append((body + str(-luhn(body + "0") % 10), card))
        body = "".join(str(r.randrange(10)) for _ in range(15))
        d = body + str((-luhn(body + "0") + r.randrange(2)) % 10)
        cases.append((r.choice(" -").join(d[k : k + 4] for k in range(0, 16, 4)), card))
        cases.append((".".join(str(r.randrange(280)) for _ in range(4)), ipv4))
        cases.append((f"+1 ({r.randrange(1000):03d}) {r.randrange(1000):03d}-{r.randrange(10000):04d}", phone))
        cases.append((f"{r.randrange(1000):03d}-{r.randrange(100):02d}-{r.randrange(10000):04d}", ssn))
        form = r.choice(["%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"])
        cases.append(((datetime.date(1890, 1, 1) + datetime.timedelta(r.randrange(80_000))).strftime(form), lambda m, f=form: date(m, f)))
        cases.append((f"{r.choice('abcXY')}o.{r.randrange(99)}_x@mail.example.org", email))
    cases += [("010.001.002.003", ipv4), ("0.0.0.0", ipv4), ("+1 (211) 911-0000", phone), ("666-10-1000", ssn), ("2021-02-30", lambda m: m)]
    docs = spark.createDataFrame([(k, f"see {v} there") for k, (v, _) in enumerate(cases)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in pseudonymise(docs, key=KEY).collect()}
    for k, (v, plain) in enumerate(cases):
        assert got[k] == f"see {plain(v)} there", v
    spark.conf.set("spark.wayloom.pseudonym.key", KEY)
    try:
        assert {x.doc_id: x.text for x in pseudonymise(docs).collect()} == got
    finally:
        spark.conf.unset("spark.wayloom.pseudonym.key")


def test_phones_stay_assignable():
    pairs = {phone(f"+1 ({a:03d}) 555-{n:04d}") for a in (212, 911, 17, 999) for n in range(300)}
    assert len(pairs) == 1200 and all(int(p[9:12]) in GOOD for p in pairs)


def test_columns_repeated_rows_and_nulls(spark):
    from wayloom.llm.pseudonyms import pseudonymise

    rows = [(1, "on 2020-01-01", "a", "b", 1, 2), (1, "on 2020-01-01", "a", "b", 1, 2), (None, None, None, None, None, None), (2, "", "x", "y", 0, 0), (3, ("w 10.0.0.1 " * 40_000).strip(), "", "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, _new string, `a.b` int, n_found int")
    got = pseudonymise(docs)
    assert got.columns == ["doc_id", "text", "_found", "_new", "a.b", "n_found", "n_changed"]
    out = sorted(got.collect(), key=lambda r: (r.doc_id or 0, r.n_found))
    assert out[0].text is None and out[0].n_found == 0 and out[1] == out[2] and (out[1]["_found"], out[1]["_new"], out[1]["a.b"]) == ("a", "b", 1)
    assert out[3].text == "" and out[4].n_found == out[4].n_changed == 40_000 and pseudonymise(docs.limit(0)).count() == 0
