"""PII pseudonyms against a plain version in Python, and what a format promises."""

import datetime
import hashlib
import re

from foldwright.llm import pii

from llm_cases import EDGES, LONG, needs_data

KEY = "test key"
TEXTS = [
    "call +1 (017) 555-7713 now", "card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112.",
    "mail und.34@mail7.example.com, É.9@x.org", "ip 97.51.17.173 v4.0. 1.2.3.4.5 300.1.1.1",
    "on 2020-02-30 and 2020-02-29 or 29.02.2020 or 29/2/2020 x 1.1.1899", "ssn 123-45-6789 666-12-1234 000-11-1111 123-00-1234",
    "IBAN DE89370400440532013000 and DE89 3704 0044 0532 0130 00. DE88370400440532013000",
    'token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"!!', "plain text 12345 words v1.2.3", None, "",
    "+1 (017) 555-7713 again und.34@mail7.example.com", "+4930123456789 (030) 555-1234",
]


def feistel(symbols, radices, kind):
    half = list(symbols)
    for r in range(pii.ROUNDS):
        rest = ",".join(str(y) for j, y in enumerate(half) if j % 2 != r % 2)
        half = [(x + int(hashlib.sha256(f"{KEY}|{kind}|{len(half)}|{r}|{i}|{rest}".encode()).hexdigest()[:14], 16)) % radices[i]
                if i % 2 == r % 2 else x for i, x in enumerate(half)]
    return half


def moved(text, kind):
    places = [(i, next(a for a in pii.ALPHABETS if c in a)) for i, c in enumerate(text) if any(c in a for a in pii.ALPHABETS)]
    new = feistel([a.index(text[i]) for i, a in places], [len(a) for _, a in places], kind)
    out = list(text)
    for (i, a), x in zip(places, new):
        out[i] = a[x]
    return "".join(out)


def test_no_sql_text(spark, monkeypatch):
    """The replacements are built of Columns: the parser keeps its tables for a long SQL text on the driver's heap."""
    def parsed(text):
        raise AssertionError(f"SQL text of {len(text)} characters")

    for f in ("expr", "selectExpr"):
        monkeypatch.setattr(pii.F if f == "expr" else pii.DataFrame, f, parsed, raising=False)
    docs = spark.createDataFrame([(1, "ssn 123-45-6789")], "doc_id bigint, text string")
    assert [x["kind"] for x in pii.pseudonymize(docs, KEY).first()["pseudonyms"]] == ["ssn"]


def test_iban_before_other_words(spark):
    """A valid IBAN is found whatever word follows it, and what follows stays or is found itself."""
    ibans = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "AT611904300234573201", "DE89 3704 0044 0532 0130 00",
             "NO93 8601 1117 947", "GB29 NWBK 6016 1331 9268 19", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    after = [" IN cash", " 12 May", " EUR 500", " 2024-01-02", " CASH NOW", ".", ""]
    rows = [(k * 10 + j, f"pay {i}{a}") for k, i in enumerate(ibans) for j, a in enumerate(after)]
    docs = spark.createDataFrame([*rows, (999, "pay ZZ80 5390 0754 7034 IN cash, ZZ18 5390 0754 7034 IN cash")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymize(docs, KEY).collect()}
    for k, i in enumerate(ibans):
        new = moved(i.replace(" ", "")[4:], "iban")
        for j, a in enumerate(after):
            got = out[k * 10 + j]
            value = got["text"][4:4 + len(i)]
            assert value.replace(" ", "")[4:] == new and value[:2] == i[:2] and [c == " " for c in value] == [c == " " for c in i]
            assert (got["text"][4 + len(i):] == a) == (a != " 2024-01-02")
            assert [x["kind"] for x in got["pseudonyms"]] == ["iban"] + ["date"] * (a == " 2024-01-02")
    # No known country: the longest run of groups that passes the check; nothing where none does.
    assert [x["kind"] for x in out[999]["pseudonyms"]] == ["iban"] and out[999]["text"].endswith(" IN cash, ZZ18 5390 0754 7034 IN cash")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def run(spark, texts, key=KEY):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: (r["text"], [tuple(p) for p in r["pseudonyms"]]) for r in pii.pseudonymize(df, key).collect()}


def test_values(spark):
    out = run(spark, TEXTS)
    assert out[0][0] == "call +1" + moved(" (017) 555-7713", "phone") + " now"
    body = moved("411111111111111", "card")
    card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
    grouped = " ".join(card[i:i + 4] for i in range(0, 16, 4))
    assert out[1][0] == f"card {grouped} and {card}, bad 4111111111111112."
    assert out[2][0] == f"mail {moved('und.34', 'email')}@mail7.example.com, {moved('É.9', 'email')}@x.org"
    ip = ".".join(map(str, feistel([97, 51, 17, 173], [256] * 4, "ipv4")))
    assert out[3][0] == f"ip {ip} v4.0. 1.2.3.4.5 300.1.1.1"
    day = (datetime.date(2020, 2, 29) - datetime.date(1900, 1, 1)).days
    a, b = feistel([day % 17, day // 17], [17, 4297], "date")
    new = datetime.date(1900, 1, 1) + datetime.timedelta(b * 17 + a)
    assert out[4][0] == f"on 2020-02-30 and {new:%Y-%m-%d} or {new:%d.%m.%Y} or {new.day}/{new.month}/{new.year} x 1.1.1899"
    area, group, serial = feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    area = area + 1 if area < 665 else area + 2
    assert out[5][0] == f"ssn {area:03d}-{group + 1:02d}-{serial + 1:04d} 666-12-1234 000-11-1111 123-00-1234"
    account = moved("370400440532013000", "iban")
    rest = int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
    iban = f"DE{98 - rest:02d}{account}"
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    spaced = " ".join(iban[i:i + 4] for i in range(0, 22, 4))
    assert out[6][0] == f"IBAN {iban} and {spaced}. DE88370400440532013000"
    secret = "40d78a45c418324758e099eb7cb89bc0f5fa9f62"
    assert out[7][0] == f'token = "{moved(secret, "secret")}"!!'
    assert [out[k] for k in (8, 9, 10)] == [(TEXTS[8], []), (None, []), ("", [])]
    assert out[11][0].split(" again ")[0] == out[0][0][5:-4] and out[11][0].split(" again ")[1] == out[2][0][5:].split(",")[0]
    assert out[1][1] == [("card", grouped), ("card", card)]
    assert out[12][0].startswith("+4") and [k for k, _ in out[12][1]] == ["phone", "phone"]
    assert run(spark, TEXTS[:1], "another key")[0] != out[0]


def test_permutation(spark):
    """All values of a small format: different ones stay different, all stay valid."""
    texts = [f"10.0.{a}.{b}" for a in range(8) for b in range(0, 256, 5)] + [
        (datetime.date(1999, 1, 1) + datetime.timedelta(d)).isoformat() for d in range(400)]
    out = [t for t, _ in run(spark, texts).values()]
    assert len(set(out)) == len(set(texts))
    for t in out:
        if "-" in t:
            assert 1900 <= datetime.date.fromisoformat(t).year <= 2099
        else:
            assert all(0 <= int(x) <= 255 for x in t.split("."))


def test_edges(spark, edges, no_docs):
    out = pii.pseudonymize(edges.withColumnRenamed("score", "pseudonyms"), KEY)
    assert out.columns == [*[c for c in edges.columns if c != "score"], "pseudonyms"]
    rows = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted(EDGES, key=repr)
    assert all(r["pseudonyms"] == [] for r in rows)
    assert pii.pseudonymize(no_docs, KEY).collect() == []
    assert run(spark, [LONG + " 4111111111111111"])[0][0].startswith(LONG[:-1])


@needs_data
def test_documents(documents):
    """What is found is gone; texts without any of it are untouched."""
    finder = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d+\.\d+\.\d+\.\d+(?![\w.])")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in pii.pseudonymize(documents, KEY).collect():
        old = texts[r["doc_id"]]
        if not re.search(r"\d", old):
            assert r["text"] == old
        for value in finder.findall(old):
            assert value not in r["text"]
        for value in re.findall(r"(?<!\w)\d{16}(?!\w)", old):
            assert (value in r["text"]) == (not luhn(value))
