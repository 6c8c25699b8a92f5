import hashlib
import random
import re
import time
from datetime import date, timedelta

from ledgerloom.llm import pii


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def run(spark, texts, key="k", **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS k", "1 AS m")
    return [(r.new, r.pii) for r in sorted(pii.pseudonymise(docs, key, out="new", **more).collect())]


def test_known_values_change_within_their_format(spark):
    text = "a bosbt.42@mail8.example.com, 42.144.35.254; 4041894974608795 4111-1111-1111-1111 +1 (988) 555-2485 1980-02-29 31/12/1999 123-45-6789 end"
    new, spans = run(spark, [text])[0]
    assert [s.kind for s in spans] == ["email", "ip", "card", "card", "phone", "date", "date", "ssn"]
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))
    assert re.sub(r"9+\.9+\.9+\.9+", "ip", shape(new)) == re.sub(r"9+\.9+\.9+\.9+", "ip", shape(text))
    for s in spans:
        assert text[s.start - 1 : s.start - 1 + s.length] not in new
    assert "@mail8.example.com" in new and "+1 (" in new
    cards = re.findall(r"(?<!\d)(?:\d{16}|\d{4}-\d{4}-\d{4}-\d{4})(?!\d)", new)
    assert len(cards) == 2 and all(luhn(c.replace("-", "")) for c in cards)
    y, m, d = map(int, re.search(r"\d{4}-\d{2}-\d{2}(?!-)", new).group().split("-"))
    assert date(1900, 1, 1) <= date(y, m, d) <= date(2099, 12, 31)


def test_what_fails_its_check_stays(spark):
    text = "300.1.2.3 1.2.3.04 4111111111111112 30.02.2001 2023-13-01 000-12-3456 666-12-3456 12345 v1.2.3 x4111111111111111"
    assert run(spark, [text]) == [(text, [])]


def test_equal_values_stay_linked_and_different_ones_apart(spark):
    r = random.Random(8)
    ips = [f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(150)]
    days = [(date(2020, 1, 1) + timedelta(days=i)).isoformat() for i in range(300)]
    mails = [f"{a}{b}.{c}@x.org" for a in "abcdef" for b in "ghijk" for c in ("1", "22")]
    phones = [f"(212) 555-{i:04d}" for i in range(150)]
    for values in (ips, days, mails, phones):
        got = [n for n, _ in run(spark, values)]
        assert len(set(got)) == len(set(values))
        assert run(spark, ["so " + values[0] + " ok"])[0][0] == "so " + got[0] + " ok"
        assert [n for n, _ in run(spark, values, key="other")] != got


def test_edge_rows(spark):
    assert run(spark, [None, "", "none here", "x" * 100_000 + " 42.144.35.254"])[:3] == [(None, []), ("", []), ("none here", [])]
    assert run(spark, ["42.144.35.254 42.144.35.254"])[0][0].split(" ")[0] == run(spark, ["42.144.35.254"])[0][0]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0
    assert set(pii.pseudonymise(spark.createDataFrame([(1, "t", 5)], "doc_id long, text string, pii int"), "k").columns) == {"doc_id", "text", "pii"}


def test_long_digits_of_email_names(spark):
    names = [("1234567890" * 9)[:n] for n in (1, 2, 18, 19, 30, 36, 37, 54, 55, 80)] + ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "x" + "9" * 37, "x" + "9" * 36 + "8"]
    got = [n for n, _ in run(spark, [f"id {n}@host.org ok" for n in names])]
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))
    assert [shape(g) for g in got] == [shape(f"id {n}@host.org ok") for n in names]
    assert len(set(got)) == len(names) and all(n not in g for n, g in list(zip(names, got, strict=True))[1:])


def test_further_forms(spark):
    given = ["+15551234567", "+442079460958", "555.123.4567", "555 123 4567", "12/25/1990", "1/25/1990", "1/5/1990", "1.5.1990", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "josé.42@x.com", "иван@x.ru"]
    kinds = ["phone"] * 4 + ["date"] * 4 + ["iban"] * 2 + ["email"] * 2
    new, spans = run(spark, [" ; ".join(given)])[0]
    assert [s.kind for s in spans] == kinds
    got = new.split(" ; ")
    assert all(a != b for a, b in zip(got, given, strict=True))
    assert got[0].startswith("+1") and got[1].startswith("+44") and [len(g) for g in got[:4]] == [len(g) for g in given[:4]]
    m, d, y = map(int, got[4].split("/"))
    assert d > 12 and date(y, m, d) and len(got[4]) == 10
    for g, w in zip(got[8:10], given[8:10], strict=True):
        v = g.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 and [c == " " for c in g] == [c == " " for c in w]
    assert "NWBK" in got[9] and "é" not in got[10] and not set("иван") <= set(got[11]) and got[11].endswith("@x.ru") and got[11][:4].isalpha()


def test_what_isnt_of_a_further_form(spark):
    text = "DE88370400440532013000 XX89370400440532013000 555.123.4567.8 13/32/1990 +123456"
    assert run(spark, [text]) == [(text, [])]
    new, spans = run(spark, ["555 123 4111 1111 1111 1111 1 DE12 4111 1111 1111 1111 11"])[0]
    assert "DE12 " in new and "4111 1111 1111 1111" not in new and len(spans) == 2
    days = [f"{m:02}/{d:02}/1990" for m in range(1, 13) for d in range(1, 29)]
    assert len({n for n, _ in run(spark, days)}) == len(days)


def feistel(left, right, left_size, right_size, tweak, key):
    """The network of the module's docstring in plain Python."""
    for i in range(1, pii.ROUNDS + 1):
        digest = lambda half: int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:13], 16)  # noqa: B023, E731
        if i % 2:
            left = (left + digest(right)) % left_size
        else:
            right = (right + digest(left)) % right_size
    return left, right


def test_against_a_plain_network(spark):
    r = random.Random(12)
    ips = [[r.randrange(256) for _ in range(4)] for _ in range(20)]
    ssns = [f"{r.randrange(100, 600)}{r.randrange(1, 100):02}{r.randrange(1, 10000):04}" for _ in range(20)]
    days = [date(1900, 1, 1) + timedelta(days=r.randrange(pii.DAYS)) for _ in range(20)]
    want = []
    for a, b, c, d in ips:
        x, y = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip", "k")
        want.append(f"{x // 256}.{x % 256}.{y // 256}.{y % 256}")
    for s in ssns:
        areas = [a for a in range(1, 900) if a != 666]
        a, rest = feistel(areas.index(int(s[:3])), (int(s[3:5]) - 1) * 9999 + int(s[5:]) - 1, 898, 99 * 9999, "ssn", "k")
        want.append(f"{areas[a]:03}-{rest // 9999 + 1:02}-{rest % 9999 + 1:04}")
    for day in days:
        n = (day - date(1900, 1, 1)).days
        while True:
            a, b = feistel(n // 512, n % 512, 512, 512, "date", "k")
            n = a * 512 + b
            if n < pii.DAYS:
                break
        want.append((date(1900, 1, 1) + timedelta(days=n)).isoformat())
    given = [".".join(map(str, i)) for i in ips] + [f"{s[:3]}-{s[3:5]}-{s[5:]}" for s in ssns] + [d.isoformat() for d in days]
    assert [n for n, _ in run(spark, given)] == want


def test_long_runs_and_hosts_end_soon(spark):
    """None of these is an address; each is looked at once and stays."""
    texts = ["a@" + "b." * 20_000 + "com", "x" * 1_000_000, "a.b-c_" * 150_000, "a" * 300 + "@x.org", "@" * 100_000, "9" * 500_000, ". " * 200_000]
    began = time.time()
    assert run(spark, texts) == [(t, []) for t in texts]
    assert time.time() - began < 60


def test_addresses_after_other_characters(spark):
    for text in ("...john@x.org", "to:-john@x.org", "a@b.com,john@x.org;"):
        new, spans = run(spark, [text])[0]
        assert "john" not in new and new.endswith(("@x.org", "@x.org;")) and spans


def test_repeated_rows_get_equal_results(spark):
    docs = spark.createDataFrame([(1, "call 212-555-0123")] * 3, "doc_id long, text string")
    assert len({r.text for r in pii.pseudonymise(docs, "k").collect()}) == 1


def test_bulk_pseudonyms_are_valid_and_distinct(spark):
    r = random.Random(21)
    areas = [a for a in range(1, 900) if a != 666]
    ssns = list({f"{r.choice(areas):03}-{r.randint(1, 99):02}-{r.randint(1, 9999):04}" for _ in range(10_000)})
    ssns += ["001-01-0001", "899-99-9999", "665-01-0001", "667-01-0001"]
    got = [n for n, _ in run(spark, ssns)]
    assert len(set(got)) == len(set(ssns))
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", g) for g in got)
    bodies = list({f"4{r.randrange(10**14):014}" for _ in range(3000)})
    cards = [b + str(next(c for c in range(10) if luhn(b + str(c)))) for b in bodies]
    got = [n for n, _ in run(spark, cards)]
    assert len(set(got)) == len(cards) and all(luhn(g) and len(g) == 16 for g in got)

    def iban(body):
        return f"DE{98 - int(body + '131400') % 97:02}{body}"

    ibans = [iban(f"{r.randrange(10**18):018}") for _ in range(2000)]
    got = [n for n, _ in run(spark, ibans)]
    assert len(set(got)) == len(set(ibans)) and all(iban(g[4:]) == g for g in got)


def test_places_of_many_matches(spark):
    text = "".join(f"x{'y' * (i % 5)} 42.144.{i // 250}.{i % 250} 1.2.3.400;" for i in range(1000))
    (new, spans), began = run(spark, [text])[0], time.time()
    assert [text[s.start - 1 : s.start - 1 + s.length] for s in spans] == re.findall(r"42\.144\.\d+\.\d+", text)
    assert new.count(";") == 1000 and time.time() - began < 60
