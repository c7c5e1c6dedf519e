import hashlib
import re

from clipgrove.llm import pii


def feistel(digits, moduli, tag, key):
    d = list(digits)
    half = len(d) / 2
    for r in range(1, 9):
        odd = r % 2 == 1
        other = ",".join(str(x) for i, x in enumerate(d) if (i < half) != odd)
        h = hashlib.sha256(f"{key}|{tag}|{r}|{len(d)}|{other}".encode()).hexdigest()
        d = [(x + int(h[i % 16 * 4:i % 16 * 4 + 4], 16)) % moduli[i] if (i < half) == odd and moduli[i] > 1 else x for i, x in enumerate(d)]
    return d


def luhn_ok(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def with_check(body):
    return next(body + str(c) for c in range(10) if luhn_ok(body + str(c)))


def one(spark, text, key="k"):
    return pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()


def test_card_equals_plain_feistel(spark):
    card = with_check("492934838514630")
    want = with_check("".join(map(str, feistel(map(int, card[:-1]), [10] * 15, "card", "k"))))
    row = one(spark, f"a {card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]} b")
    assert row.text == f"a {want}, {want[:4]} {want[4:8]} {want[8:12]} {want[12:]} b"
    assert luhn_ok(want) and [r.kind for r in row.replaced] == ["card", "card"]


def test_all_addresses_of_one_part_stay_apart(spark):
    rows = [(i, f"10.0.{i // 40}.{i % 40}") for i in range(800)]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(got)) == 800 and all(all(int(p) < 256 for p in g.split(".")) for g in got)
    want = ".".join(map(str, feistel([10, 0, 0, 0], [256] * 4, "ip", "k")))
    assert want in got


def test_days_are_a_permutation(spark):
    df = spark.range(0, 3000).selectExpr("id as doc_id", "date_format(date_add(date'1999-01-01', cast(id as int)), 'yyyy-MM-dd') as text")
    got = [r.text for r in pii.pseudonymise(df, "k").collect()]
    assert len(set(got)) == 3000 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", g) for g in got)


def test_formats_link_and_invalid_values_stay(spark):
    row = one(spark, "29.2.2024 02/29/2024 2024-02-29 2024-02-30 300.1.1.1 4845168114407328 1899-12-31")
    a, b, c, *rest = row.text.split()
    day, month, year = a.split(".")
    assert b == f"{int(month):02}/{int(day):02}/{year}" and c == f"{year}-{int(month):02}-{int(day):02}"
    assert rest == ["2024-02-30", "300.1.1.1", "4845168114407328", "1899-12-31"]


def test_account_phone_mail(spark):
    row = one(spark, "GB82 WEST 1234 5698 7654 32|GB82WEST12345698765432|+1 (017) 555-7713|Ann.9@mail.example.com|123-45-6789|000-12-1234")
    iban, bare, phone, mail, ssn, bad = row.text.split("|")
    assert iban.replace(" ", "") == bare and bare[:2] == "GB" and bare[2:] != "82WEST12345698765432"
    n = int("".join(str(int(ch, 36)) for ch in bare[4:] + bare[:4]))
    assert n % 97 == 1
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and "555-7713" not in phone
    assert re.fullmatch(r"[A-Z][a-z]{2}\.\d@mail\.example\.com", mail)
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn) and ssn != "123-45-6789" and bad == "000-12-1234"


def test_other_key_other_pseudonym_and_odd_rows(spark, odd, empty):
    assert one(spark, "97.51.17.173", "a").text != one(spark, "97.51.17.173", "b").text
    got = {r.doc_id: r for r in pii.pseudonymise(odd, "k").collect()}
    want = {r.doc_id: r for r in odd.collect()}
    assert all(got[i].text == want[i].text and got[i]["_old"] == "x" for i in want)
    assert got[1].replaced is None and got[2].replaced == []
    assert pii.pseudonymise(empty, "k").count() == 0


def test_long_texts_are_searched_without_recursion(spark):
    many = 20_000
    rows = [(1, "a@b" + ".b" * many), (2, "12345" * many), (3, "1234 " * many), (4, "GB82 " + "WEST " * many), (5, "1.1" * many), (6, "a." * many + "x@y.z"), (7, "a" * many + "@" + "b-" * many)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert got[1][1:] == rows[0][1][1:] and got[6] == rows[5][1]
    assert all(len(got[i]) == len(t) for i, t in rows if i != 5)  # addresses change their length
    assert one(spark, "jo.do@mail.example.co.uk, x").text.endswith("@mail.example.co.uk, x")


def test_days_stay_apart_in_every_layout(spark):
    import datetime

    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(3000)]
    texts = {}
    for d in days:
        for layout in ("{m:02d}/{d:02d}/{y}", "{d:02d}/{m:02d}/{y}", "{m}/{d}/{y}", "{d}/{m}/{y}"):
            t = layout.format(y=d.year, m=d.month, d=d.day)
            a, b, y = map(int, t.split("/"))
            texts[t] = (y, a, b) if a <= 12 else (y, b, a)  # as it is read
    rows = list(enumerate(sorted(texts)))
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    read = lambda t: (lambda a, b, y: (datetime.date(y, a, b), "m") if a <= 12 else (datetime.date(y, b, a), "d"))(*map(int, t.split("/")))
    seen = {}
    for i, t in rows:
        assert read(got[i])[1] == read(t)[1] and (len(got[i]) == 10 or len(t) < 10)
        seen.setdefault(read(got[i]), set()).add(read(t))
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len({read(t) for _, t in rows})
