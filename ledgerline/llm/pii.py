"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Found in texts and validated: payment card numbers (13 to 19 digits, or 16 and 15 in the usual groups) that
pass the Luhn check, international bank account numbers whose check digits are right, social security numbers
(three, two and four digits with hyphens) of a possible area, group and serial, North American phone numbers,
other phone numbers after a plus sign (8 to 15 digits), IPv4 addresses, dates, and e-mail addresses. A value is
permuted inside its own format: a card becomes a card of the same length that passes the check, an account
number keeps country, letters and what stands before its last 18 digits and gets new check digits, a phone
number keeps all but its last seven digits, an address becomes an address, a date a date. The permutation
depends on the key and the kind only, so equal values get equal pseudonyms in all documents and different ones
stay different. A date with slashes is read day first; where the middle number is no month, month first, and
it is permuted among such dates. Dates outside 1800 to 2199 stay. An e-mail address's name part has no fixed
format; it becomes a keyed digest. Its host is labels of letters, digits and hyphens with single dots between
them, up to the last that is two letters or more. Numbers that fail their check are no personal data and stay.

The network: a value is a pair (l, r) below sizes (a, b); ten rounds add a keyed hash of one half to
the other, modulo its size. Everything is built-in functions on one row; nothing is shuffled.

Each pattern can begin at the start of a run only, takes runs without giving them back, and repeats groups a
few times at most: the search takes time in proportion to the text, whatever it holds.

The key is a text, which then stands in query plans and event logs, or a column, such as one of a broadcast
table of one row.

Defined results: a null text stays null with counts of 0, an empty one empty; matches are leftmost and
don't overlap; repeated rows are treated alike; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
# The formats.
EMAIL = r"(?<![A-Za-z0-9._%+-])[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,}"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"
ACCOUNT = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"
    r"(?:[A-Z0-9]{11,30}|(?: (?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){2,7}(?: (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ABROAD = r"(?<![0-9+])\+[1-9][0-9]{1,2}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,12}){1,5}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
NUMBER = f"(?=[0-9+(A-Z])(?:{'|'.join((DATE, ACCOUNT, SOCIAL, ADDRESS, PHONE, ABROAD, CARD))})"
ANY = f"{EMAIL}|{NUMBER}"
KINDS = ("email", "date", "account", "social", "address", "phone", "card")
#: Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SOCIAL_SIZES = (898 * 99, 9999)
#: The days of a 400-year cycle from 1800-01-01: 146,097 = 189 * 773.
FIRST_DAY, DAY_SIZES = "1800-01-01", (189, 773)
#: Its 4,800 months without their first twelve days: 88,497 = 9 * 9833.
MONTHS, LATE_SIZES = 4800, (9, 9833)


def _hash(key: Column, kind: str, round_: Column, half: Column, size: Column) -> Column:
    text = F.concat(key, F.lit(f"|{kind}|"), round_.cast("string"), F.lit("|"), size.cast("string"), F.lit("|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("bigint")


def feistel(value: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """A keyed permutation of the whole numbers below a*b, which must be below 2**62."""
    start = F.struct(F.floor(value / b).cast("bigint").alias("l"), F.pmod(value, b).cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _hash(key, kind, i, s["r"], b), a)).otherwise(s["l"]).cast("bigint").alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _hash(key, kind, i, s["l"], a), b)).cast("bigint").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(digits: Column, key: Column, kind: str) -> Column:
    """Another text of as many digits (18 at most): the halves are 10**n // 2 and the rest."""
    n = F.length(digits)
    a, b = (F.pow(F.lit(10), half).cast("bigint") for half in (F.floor(n / 2), n - F.floor(n / 2)))
    return F.lpad(feistel(_whole(digits), a, b, key, kind).cast("string"), n, "0")


def _whole(digits: Column) -> Column:
    return digits.try_cast("bigint")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number, its check digit included."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def into_format(text: Column, digits: Column) -> Column:
    """text with its digits replaced, in order."""
    place = lambda i: F.length(_digits(F.substring(text, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def account_rest(account: Column) -> Column:
    """What an account number, its first four characters moved to the end, leaves modulo 97; 1 if it is valid."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97).cast("int")

    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def email_parts(match: Column) -> Column:
    """lead, address (empty if there is none), rest of a match of EMAIL."""
    name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    lead = F.regexp_extract(name, r"^[._%+-]*", 0)
    end = F.regexp_extract(F.substring_index(host, "..", 1), r"^[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}", 0)
    address = F.when(end == "", "").otherwise(F.concat(F.substring(name, F.length(lead) + 1, F.length(name)), F.lit("@"), end))
    return F.struct(lead.alias("lead"), address.alias("address"), F.substring(host, F.length(end) + 1, F.length(host)).alias("rest"))


def kind_of(match: Column) -> Column:
    """The kind of a match of ANY, or null where it fails its check."""
    digits = _digits(match)
    octets = F.transform(F.split(match, r"\."), lambda x: x.try_cast("int"))
    american = (F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1"))
    area = F.substring(digits, 1, 3)
    social = (area != "000") & (area != "666") & (area < "900") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    return (
        F.when(match.contains("@"), F.when(email_parts(match)["address"] != "", "email"))
        .when(match.rlike(f"^(?:{DATE})$"), F.when(_day(match).isNotNull(), "date"))
        .when(match.rlike("^[A-Z]"), F.when(account_rest(F.replace(match, F.lit(" "), F.lit(""))) == 1, "account"))
        .when(match.rlike(f"^(?:{SOCIAL})$"), F.when(social, "social"))
        .when(match.rlike(f"^(?:{ADDRESS})$"), F.when(F.forall(octets, lambda x: x <= 255), "address"))
        .when(match.rlike(f"^(?:{PHONE})$"), F.when(american, "phone"))
        .when(match.startswith("+"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(luhn_sum(digits) % 10 == 0, "card")
    )


def _month_first(match: Column) -> Column:
    return match.contains("/") & (F.substring(match, F.lit(4), F.lit(2)) > "12")


def late_rank(day: Column) -> Column:
    """The number of earlier days that are beyond the twelfth of their month, for such a day."""
    first = F.lit(FIRST_DAY).cast("date")
    month = (F.year(day) - F.year(first)) * 12 + F.month(day)
    return (F.datediff(day, first) - 12 * month).cast("bigint")


def late_day(rank: Column) -> Column:
    """The day of a late_rank. A month's estimate is off by one at most."""
    first = F.lit(FIRST_DAY).cast("date")

    def of(r: Column) -> Column:
        guess = F.floor(r * MONTHS / (LATE_SIZES[0] * LATE_SIZES[1])).cast("int")
        begun = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m <= r
        month = F.when(begun(guess + 1), guess + 1).when(begun(guess), guess).otherwise(guess - 1)
        return F.date_add(first, (r + 12 * (month + 1)).cast("int"))

    return F.element_at(F.transform(F.array(rank), of), 1)


def _day(match: Column) -> Column:
    day = (
        F.when(match.contains("-"), F.try_to_date(match, "yyyy-MM-dd"))
        .when(_month_first(match), F.try_to_date(match, "MM/dd/yyyy"))
        .when(match.contains("/"), F.try_to_date(match, "dd/MM/yyyy"))
        .otherwise(F.try_to_date(match, "dd.MM.yyyy"))
    )
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), day)


def _date(match: Column, key: Column) -> Column:
    a, b = (F.lit(x).cast("bigint") for x in DAY_SIZES)
    first = F.lit(FIRST_DAY).cast("date")
    day = F.date_add(first, feistel(F.datediff(_day(match), first).cast("bigint"), a, b, key, "date").cast("int"))
    late = late_day(feistel(late_rank(_day(match)), *(F.lit(x).cast("bigint") for x in LATE_SIZES), key, "month-first"))
    return (
        F.when(match.contains("-"), F.date_format(day, "yyyy-MM-dd"))
        .when(_month_first(match), F.date_format(late, "MM/dd/yyyy"))
        .when(match.contains("/"), F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "dd.MM.yyyy"))
    )


def _account(match: Column, key: Column) -> Column:
    """The last 18 digits behind the check digits are permuted, and the check digits follow from them."""
    digits = F.substring(_digits(match), F.lit(3), F.length(match))
    moved = F.least(F.length(digits), F.lit(18))
    kept = F.substring(digits, F.lit(1), F.length(digits) - moved)
    new = F.concat(kept, permuted_digits(F.substring(digits, F.length(digits) - moved + 1, moved), key, "account"))
    bare = into_format(F.replace(match, F.lit(" "), F.lit("")), F.concat(F.lit("00"), new))
    check = F.lpad((98 - account_rest(bare)).cast("string"), 2, "0")
    return into_format(match, F.concat(check, new))


def _social(digits: Column, key: Column) -> Column:
    part = lambda at, n: F.substring(digits, at, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    a, b = (F.lit(x).cast("bigint") for x in SOCIAL_SIZES)
    moved = feistel((area * 99 + part(4, 2) - 1) * b + part(6, 4) - 1, a, b, key, "social")
    high = F.floor(moved / b)
    new = F.floor(high / 99) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    texts = (new, 3), (F.pmod(high, F.lit(99)) + 1, 2), (F.pmod(moved, b) + 1, 4)
    return F.concat(*[F.lpad(v.cast("bigint").cast("string"), n, "0") for v, n in texts])


def _address(match: Column, key: Column) -> Column:
    octets = F.transform(F.split(match, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, x: s * 256 + x)
    half = F.lit(65536).cast("bigint")
    moved = feistel(number, half, half, key, "address")
    return F.concat_ws(".", *[F.pmod(F.floor(moved / (256**i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0)])


def _email(match: Column, key: Column) -> Column:
    parts = email_parts(match)
    digest = F.sha2(F.concat(key, F.lit("|email|"), F.lower(parts["address"])), 256)
    return F.concat(parts["lead"], F.lit("user-"), F.substring(digest, 1, 16), F.lit("@example.invalid"), parts["rest"])


def pseudonym(match: Column, kind: Column, key: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    card = permuted_digits(F.substring(digits, F.lit(1), n - 1), key, "card")
    check = F.pmod(10 - luhn_sum(F.concat(card, F.lit("0"))) % 10, F.lit(10))
    phone = F.concat(F.substring(digits, F.lit(1), n - 7), permuted_digits(F.substring(digits, n - 6, F.lit(7)), key, "phone"))
    return (
        F.when(kind == "email", _email(match, key))
        .when(kind == "date", _date(match, key))
        .when(kind == "account", _account(match, key))
        .when(kind == "social", into_format(match, _social(digits, key)))
        .when(kind == "address", _address(match, key))
        .when(kind == "phone", into_format(match, phone))
        .when(kind == "card", into_format(match, F.concat(card, check.cast("string"))))
        .otherwise(match)
    )


def pseudonymize(docs: DataFrame, key: str | Column) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind>: how many of each kind were replaced."""
    key = F.lit(key) if isinstance(key, str) else key
    mails, numbers = F.col("text").contains("@"), F.col("text").rlike("[0-9]")
    found = F.when(mails, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).when(numbers, F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)))
    rows = docs.select("doc_id", "text", key.alias("_key"), found.alias("_found"))
    judged = rows.withColumn("_found", F.transform("_found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    some = F.exists("_found", lambda x: x["kind"].isNotNull())
    replaced = F.transform("_found", lambda x: pseudonym(x["m"], x["kind"], F.col("_key")))
    parts = F.when(mails, F.split("text", ANY, -1)).otherwise(F.split("text", NUMBER, -1))
    joined = F.array_join(F.zip_with(parts, F.concat(replaced, F.array(F.lit(""))), lambda part, new: F.concat(part, new)), "")
    counts = [F.coalesce(F.size(F.expr(f"filter(_found, x -> x.kind = '{k}')")), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return judged.select("doc_id", F.when(some, joined).otherwise(F.col("text")).alias("text"), *counts)
