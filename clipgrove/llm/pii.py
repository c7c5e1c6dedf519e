"""Format-preserving pseudonyms: keyed Feistel permutations of the personal numbers and dates in whole texts.

A value becomes an array of digits with their moduli (10 for a digit, 26 for a letter, 256 for a part of an
address). Eight Feistel rounds shift the digits of one half by a keyed SHA-256 of the other half, so
the map is a permutation of all values of the format, and equal values get equal pseudonyms in every document, however
they are written. Separators, letter case, check digits and valid dates are kept valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clipgrove.llm.words import free_name

#: order of the alternatives is the order of preference
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}+"  # possessive: matched in a loop, not by recursion
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
KINDS = {"email": EMAIL, "iban": IBAN, "date": DATE, "ip": IP, "phone": PHONE, "ssn": SSN, "card": CARD}
ANY = rf"(?<![A-Za-z0-9._%+-])(?:{EMAIL})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:{'|'.join(v for k, v in KINDS.items() if k != 'email')})(?![A-Za-z0-9])(?!\.[0-9])"
FIRST_DAY, DAYS = "1900-01-01", 73_049
WALKS = 271 * 270 - DAYS + 1
LATE_DAYS = 19  # of a month, from the 13th on
ROUNDS = 8


def feistel(digits: Column, moduli: Column, tag: str, key: str) -> Column:
    """The permuted digits; a modulus of 1 keeps its digit. One keyed hash per round."""
    half = F.size(digits) / 2

    def turn(d: Column, r: Column) -> Column:
        odd = r % 2 == 1
        other = F.array_join(F.transform(F.filter(d, lambda x, i: (i < half) != odd), lambda x: x.cast("string")), ",")
        stream = F.sha2(F.concat(F.lit(f"{key}|{tag}|"), r.cast("string"), F.lit("|"), F.size(d).cast("string"), F.lit("|"), other), 256)
        shift = lambda h, i: F.conv(F.substr(h, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.transform(F.array(stream), lambda h: F.transform(
            d, lambda x, i: F.when(((i < half) == odd) & (moduli[i] > 1), (x + shift(h, i)) % moduli[i]).otherwise(x)))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), digits, turn)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def numbers(text: Column) -> Column:
    """The digits in a string as an array of int."""
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9])")), lambda x: x.cast("int"))


def placed(pattern: Column, values: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by ``values``."""
    at = lambda i: F.length(F.regexp_replace(F.substr(pattern, F.lit(1), i), "[^0-9]", "")) - 1
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda i: once(
        F.substr(pattern, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), values[at(i)].cast("string")).otherwise(c))), "")


def luhn(d: Column) -> Column:
    """Check digit for the digits before it."""
    last = F.size(d) - 1
    total = F.aggregate(F.transform(d, lambda x, i: F.when((last - i) % 2 == 0, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))


def _code(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 65).when(c.rlike("[a-z]"), F.ascii(c) - 97).otherwise(F.lit(0))


def _size(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[A-Za-z]"), F.lit(26)).otherwise(F.lit(1))


def mixed(text: Column, tag: str, key: str) -> Column:
    """Letters stay letters of their case, digits digits, other signs what they are. The case does not
    change the pseudonym."""
    return once(_letters(text), lambda cs: once(
        feistel(F.transform(cs, _code), F.transform(cs, _size), tag, key),
        lambda d: F.array_join(F.transform(cs, lambda c, i: F.when(c.rlike("[0-9]"), d[i].cast("string")).when(c.rlike("[A-Z]"), F.char(d[i] + 65))
                                           .when(c.rlike("[a-z]"), F.char(d[i] + 97)).otherwise(c)), "")))


def _tens(d: Column) -> Column:
    return F.transform(d, lambda x: F.lit(10))


def _mod97(text: Column) -> Column:
    """Remainder of an account number that starts with its country, check digits last in this string."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_letters(text), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(mixed(local, "email", key), F.substr(m, F.length(local) + 1))


def _iban(m: Column, key: str) -> Column:
    bare = F.regexp_replace(m, " ", "")
    body = lambda s: F.substr(s, F.lit(5))
    land = lambda s: F.substr(s, F.lit(1), F.lit(2))

    def fresh(s: Column) -> Column:
        new = mixed(body(s), "iban", key)
        return once(new, lambda b: F.concat(land(s), F.lpad((98 - _mod97(F.concat(b, land(s), F.lit("00")))).cast("string"), 2, "0"), b))

    at = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), " ", ""))
    spread = lambda new: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
        F.substr(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substr(new, at(i), F.lit(1)))), "")
    good = _mod97(F.concat(body(bare), F.substr(bare, F.lit(1), F.lit(4)))) == 1
    return F.when(good, once(fresh(bare), spread))


def _date(m: Column, key: str) -> Column:
    def moved(text: Column, layout: str, wide: str) -> Column:
        day = F.datediff(F.try_to_timestamp(text, F.lit(layout)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        walk = lambda a, i: F.when((i > 1) & (a < DAYS), a).otherwise(once(
            feistel(F.array((a / 270).cast("int"), a % 270), F.array(F.lit(271), F.lit(270)), "date", key), lambda d: d[0] * 270 + d[1]))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), day, walk)
        back = F.date_add(F.lit(FIRST_DAY).cast("date"), new)
        return F.when(day.between(0, DAYS - 1), F.when(F.length(text) == 10, F.date_format(back, wide)).otherwise(F.date_format(back, layout)))

    def day_first(text: Column) -> Column:
        """Texts that can only be day/month: permuted among days from the 13th on, so that they stay apart from month/day."""
        date = F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date")
        month = lambda a: F.add_months(F.lit(FIRST_DAY).cast("date"), (a / LATE_DAYS).cast("int"))
        there = lambda a: F.dayofmonth(F.last_day(month(a))) >= a % LATE_DAYS + 13
        cell = (F.year(date) * 12 + F.month(date) - 1900 * 12 - 1) * LATE_DAYS + F.dayofmonth(date) - 13
        # nine in ten cells are days, so a walk as long as the sequence does not occur (0.1 to the power of its length)
        walk = lambda a, i: F.when((i > 1) & there(a), a).otherwise(once(
            feistel(F.array((a / LATE_DAYS).cast("int"), a % LATE_DAYS), F.array(F.lit(2400), F.lit(LATE_DAYS)), "day first", key), lambda d: d[0] * LATE_DAYS + d[1]))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), cell, walk)
        back = once(new, lambda a: F.date_add(month(a), a % LATE_DAYS + 12))
        return F.when((F.dayofmonth(date) > 12) & F.year(date).between(1900, 2099), F.when(F.length(text) == 10, F.date_format(back, "dd/MM/yyyy")).otherwise(F.date_format(back, "d/M/yyyy")))

    return (F.when(m.contains("-"), moved(m, "yyyy-MM-dd", "yyyy-MM-dd")).when(m.contains("."), moved(m, "d.M.yyyy", "dd.MM.yyyy"))
            .otherwise(F.coalesce(moved(m, "M/d/yyyy", "MM/dd/yyyy"), day_first(m))))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = once(parts, lambda p: feistel(p, F.transform(p, lambda x: F.lit(256)), "ip", key))
    return F.when(F.forall(parts, lambda x: x < 256), F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _phone(m: Column, key: str) -> Column:
    own = F.regexp_replace(m, r"^\+1", "")
    return F.concat(F.when(m.startswith("+1"), F.lit("+1")).otherwise(F.lit("")), once(
        numbers(own), lambda d: once(feistel(d, _tens(d), "phone", key), lambda n: placed(own, n))))


def _ssn(m: Column, key: str) -> Column:
    good = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("-0000$")
    return F.when(good, once(numbers(m), lambda d: once(feistel(d, _tens(d), "ssn", key), lambda n: placed(m, n))))


def _card(m: Column, key: str) -> Column:
    def fresh(d: Column) -> Column:
        body = F.slice(d, F.lit(1), F.size(d) - 1)
        new = once(body, lambda b: feistel(b, _tens(b), "card", key))
        return F.when(luhn(body) == F.element_at(d, -1), once(new, lambda n: placed(m, F.concat(n, F.array(luhn(n))))))

    return once(numbers(m), fresh)


def _kind(m: Column) -> Column:
    out = F.when(m.contains("@"), F.lit("email"))
    for kind in ("date", "ip", "phone", "ssn", "card"):
        out = out.when(m.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind))
    return out.otherwise(F.lit("iban"))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, pseudonym or null if the value is not valid) of a match of ANY."""
    k = _kind(m)
    made = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "phone": _phone, "ssn": _ssn, "card": _card}

    def choose(kind: Column) -> Column:
        out = None
        for name, f in made.items():
            out = F.when(kind == name, f(m, key)) if out is None else out.when(kind == name, f(m, key))
        return F.struct(kind.alias("kind"), out.alias("value"))

    return once(k, choose)


def pseudonymise(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``documents`` with every valid e-mail name, account, date, IPv4 address, phone, social-security and card number in ``text``
    replaced, and ``replaced``: an array of (kind, value), the pseudonyms in order. Columns of these names are replaced, others kept.

    Numbers that fail their check (Luhn, mod 97, parts of an address over 255, no such day, a day outside 1900-2099) are left.
    A date with slashes is month/day if that is a day, else day/month; the two are formats of their own. Texts of any length, and domains
    of any number of labels (a match ends after 127), are searched without recursion; a name of more than 64 characters is no e-mail name. A null text stays null with a null array; empty texts and texts without a match stay as they are. No shuffle: each row
    is rewritten where it is read. Social-security pseudonyms keep the layout, not the rules on issued areas."""
    whole = F.col(f"`{text}`").cast("string")
    # texts without a digit or @ skip the search
    found = F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = [f"`{c}`" for c in documents.columns if c not in (text, "replaced")]
    old, hit = free_name(documents, "_old"), free_name(documents, "_hits")
    hits = documents.select(*rest, whole.alias(old), F.when(whole.isNotNull(), F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))).alias(hit))
    gaps = F.split(old, ANY, -1)
    news = F.transform(hit, lambda h: F.coalesce(h["new"]["value"], h["old"]))
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), news.alias("n")), lambda z: F.concat(z["g"], F.coalesce(z["n"], F.lit("")))), "")
    return hits.select(*rest, F.when(F.size(hit) > 0, joined).otherwise(F.col(old)).alias(text),
                       F.transform(F.filter(hit, lambda h: h["new"]["value"].isNotNull()), lambda h: h["new"]).alias("replaced"))
