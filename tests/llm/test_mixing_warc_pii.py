"""Mixing, WARC and personal data, against brute force and exact round trips."""

import datetime
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing, pii, warc

DOC = "doc_id bigint, text string, source string, size int, target string"


def mix_rows(rng, n=400):
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) + rng.choice(["", "\t\x0b", " x"]), rng.choice(["a", "b", "é", "Z", "tiny", None]), 1, "x") for i in range(n)]
    rows = [r if r[2] != "tiny" else (r[0], "one two", "tiny", 1, "x") for r in rows]
    return rows + [(None, None, None, 1, "x"), (7, "x y", "a", 1, "x"), (7, "x y", "a", 1, "x"), (9000, "w " * 30_000, "b", 1, "x")]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= more


def test_mix_meets_its_targets(spark):
    rows = mix_rows(random.Random(1))
    out = [r.asDict() for r in mixing.plan(spark.createDataFrame(rows, DOC)).collect()]
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expect = brute_targets(sizes)
    for s in sizes:
        own = [r for r in out if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(r["target"] == pytest.approx(expect[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - expect[s]) <= 0.5
        cut = [r for r in own if r["taken"] not in (0, r["size"], 2 * r["size"])]
        assert len(cut) <= 1
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    used = [r["position"] for r in out if r["position"] is not None]
    assert used == sorted(used) and all(0 <= p <= 1 for p in used)
    assert all((r["position"] is None) == (r["taken"] == 0) and (r["repeat_position"] is None) == (r["taken"] <= r["size"]) for r in out)


def test_mix_repeats_itself_and_takes_empty_tables(spark):
    rows = mix_rows(random.Random(2), 120)
    key = lambda df: sorted(map(str, df.collect()))
    a, b = (mixing.plan(spark.createDataFrame(x, DOC).repartition(n)) for x, n in ((rows, 2), (rows[::-1], 5)))
    assert key(a) == key(b)
    uses = mixing.sequence(a)
    assert uses.agg(F.sum("words")).first()[0] == a.agg(F.sum("taken")).first()[0]
    assert mixing.plan(spark.createDataFrame([], DOC)).count() == 0
    nothing = mixing.plan(spark.createDataFrame([(1, None, None, 0, "")], DOC)).first()
    assert (nothing.size, nothing.target, nothing.taken, nothing.position) == (0, 0.0, 0, None)


def test_positions_follow_the_schedule(spark):
    """The demand at the position given for a fraction is that fraction."""
    rows = [(k, u / 50) for k in range(3) for u in range(51)]
    got = spark.createDataFrame(rows, "kind int, u double").withColumn("t", mixing.time_of(F.col("u"), F.col("kind"))).collect()
    for r in got:
        line, area, upto = mixing.SCHEDULES[r.kind], 0.0, 0.0
        for (t0, w0), (t1, w1) in zip(line, line[1:]):
            area += (t1 - t0) * (w0 + w1) / 2
            x = min(max(r.t - t0, 0), t1 - t0)
            upto += w0 * x + (w1 - w0) * x * x / (2 * (t1 - t0))
        assert upto / area == pytest.approx(r.u, abs=1e-9)


PAGE = "page_id bigint, url string, html string, payload string, record_type string"


@pytest.mark.parametrize("chunk", [97, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    rng = random.Random(4)
    big = "é<p>\r\n\r\n" * 300
    tricky = ("WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60) + "WARC/1." * 5
    htmls = [big, tricky, None, "", "short", big[:1000], "x" * 999, "x" * 1000] + ["".join(rng.choice("ab\r\nWÄ/1") for _ in range(rng.choice([10, 1500]))) for _ in range(20)]
    pages = [(i, rng.choice(["http://a/", None, "b\r\nX: y"]), h, "p", "q") for i, h in enumerate(htmls)]
    pages += [(100 + i, "u", htmls[i % 8], "p", "q") for i in range(24)] + [(None, "u", big, "p", "q"), (None, None, "solo" * 400, "p", "q"), (123, "u", htmls[7], "p", "q")]
    folder = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(pages, PAGE).repartition(3), folder, chunk)
    got = sorted(map(str, (tuple(r) for r in warc.read(spark, folder).collect())))
    top = {}
    for i, _, h, *_ in pages:
        if i is not None:
            top[h] = max(i, top.get(h, -1))
    expect = []
    for i, _, h, *_ in pages:
        payload = (h or "").encode()
        revisit = len(payload) >= 1000 and h in top and (i is None or i < top[h])
        expect.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    assert got == sorted(map(str, expect))
    assert any(e[3] == "revisit" for e in expect)


@pytest.mark.parametrize("chunk", [8, 97, 1 << 20])
def test_warc_payloads_that_end_in_the_version(spark, tmp_path, chunk):
    name = "WARC/1.1"
    htmls = [name, "a page about " + name, name + "\r", name + "\r\n", name * 3, "x" * (97 - 8) + name + " is a format", "x" * (97 - 4) + name + "\r\n" + name + "\r\n" + "y" * 60, "x" * (97 - 9) + name + "\r\n"]
    pages = [(i, f"http://a/{name}" if i % 2 else "u", h, "p", "q") for i, h in enumerate(htmls)]
    folder = str(tmp_path / "archive")
    warc.write(spark.createDataFrame(pages, PAGE), folder, chunk)
    got = sorted(tuple(r) for r in warc.read(spark, folder).collect())
    assert got == [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, h in enumerate(htmls)]


def test_warc_cuts_of_the_version_at_all_borders(spark, tmp_path):
    """Every part of the version line at the end of a payload and at a chunk's border."""
    line = "WARC/1.1\r\n\r\nWARC/1.1\r\n"
    htmls = ["x" * fill + line[:n] + tail for fill in (0, 3, 20) for n in range(len(line) + 1) for tail in ("", "y" * 30)]
    pages = [(f"id {i}/é", "u", h, "p", "q") for i, h in enumerate(htmls)] + [("", "u", "empty id", "p", "q"), (None, "u", "no id", "p", "q")]
    docs = spark.createDataFrame(pages, PAGE.replace("page_id bigint", "page_id string"))
    for chunk in (9, 23):
        folder = str(tmp_path / f"archive{chunk}")
        warc.write(docs, folder, chunk)
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(spark, folder, "string").collect()}
        assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h, *_ in pages}


def test_warc_of_no_pages_and_damaged_archives(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGE), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    rows = warc.chunk_rows(warc.decide(spark.createDataFrame([(1, "u", "abcdef", "", "")], PAGE)), 2)
    assert [r.running_sha1 for r in rows.orderBy("chunk_no").collect()] == [hashlib.sha1(x).hexdigest() for x in (b"ab", b"abcd", b"abcdef")]
    rows.where("chunk_no != 2").select(F.col("record").cast("string")).write.option("lineSep", warc.END).text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="segment 2 is missing"):
        warc.read(spark, str(tmp_path / "bad")).collect()


def luhn(digits):
    return sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


TEXTS = [
    (1, "pay 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; born 1984-02-29 and 31/12/1999, not 2023-02-30"),
    (2, "call +1 (888) 555-6841 or 888-555-6841 from 10.0.0.255, not 300.1.1.1 or 1.2.3.4.5 by a.b+c@Mail.example.com."),
    (3, None),
    (4, ""),
    (None, "4111111111111111 31.12.1999é"),
    (1, "pay 4111 1111 1111 1111"),
    (5, "x " * 60_000 + "10.0.0.255"),
    (6, "nothing here 12 3456"),
]


def test_pseudonyms_keep_format_and_links(spark):
    docs = spark.createDataFrame([(i, t, "s", 1, "clash") for i, t in TEXTS], "doc_id bigint, text string, source string, n_card int, kind string")
    out = {(r.doc_id, len(r.text or "")): r for r in pii.pseudonymize(docs, "k1").collect()}
    rows = sorted(out.values(), key=lambda r: (r.doc_id is None, r.doc_id or 0, len(r.text or "")))
    short, first, second, null, empty, long, plain, anonymous = rows
    card, card2 = re.match(r"pay (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), not 4111111111111112;", first.text).groups()
    assert card.replace(" ", "") == card2 != "4111111111111111" and luhn(card2)
    assert short.text == f"pay {card}" and anonymous.text.startswith(card2)
    day, day2 = re.search(r"born (\S+) and (\S+), not 2023-02-30$", first.text).groups()
    assert datetime.date.fromisoformat(day) != datetime.date(1984, 2, 29)
    parsed = datetime.datetime.strptime(day2, "%d/%m/%Y")
    assert anonymous.text == f"{card2} {parsed:%d.%m.%Y}é"
    found = re.fullmatch(r"call \+1 \(888\) (\d{3}-\d{4}) or 888-(\d{3}-\d{4}) from (\S+), not 300.1.1.1 or 1.2.3.4.5 by (\S+)\.", second.text)
    assert found[1] == found[2] != "555-6841"
    assert found[3] != "10.0.0.255" and long.text == "x " * 60_000 + found[3] and all(0 <= int(x) <= 255 for x in found[3].split("."))
    assert re.fullmatch(r"user-[0-9a-f]{16}@example.invalid", found[4])
    assert null.text is None and empty.text == "" and plain.text == TEXTS[-1][1]
    assert (first.n_card, first.n_date, second.n_phone, second.n_address, second.n_email, null.n_card) == (2, 2, 2, 1, 1, 0)
    other = pii.pseudonymize(docs, "k2").where("doc_id = 6 or doc_id = 2").collect()
    assert {r.text for r in other} != {second.text, plain.text} and plain.text in {r.text for r in other}
    assert pii.pseudonymize(docs.limit(0), "k").count() == 0


def test_network_is_a_permutation(spark):
    n = spark.range(7 * 11).select(pii.feistel(F.col("id"), F.lit(7).cast("bigint"), F.lit(11).cast("bigint"), F.lit("k"), "x").alias("v"))
    assert sorted(r.v for r in n.collect()) == list(range(77))
    digits = spark.range(10_000).select(pii.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("k"), "x").alias("v"))
    assert digits.distinct().count() == 10_000 and {len(r.v) for r in digits.collect()} == {4}


def hashed(kind, i, size, half):
    return int(hashlib.sha256(f"k|{kind}|{i}|{size}|{half}".encode()).hexdigest()[:14], 16)


def permute(value, a, b, kind):
    left, right = divmod(value, b)
    for i in range(10):
        if i % 2 == 0:
            left = (left + hashed(kind, i, b, right)) % a
        else:
            right = (right + hashed(kind, i, a, left)) % b
    return left * b + right


def permute_digits(digits, kind):
    n = len(digits)
    return str(permute(int(digits), 10 ** (n // 2), 10 ** (n - n // 2), kind)).zfill(n)


def filled(pattern, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in pattern)


def rest97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def expected(piece, kind):
    """The pseudonym of a piece, by plain arithmetic."""
    digits = re.sub("[^0-9]", "", piece)
    if kind == "card":
        new = permute_digits(digits[:-1], "card")
        return filled(piece, new + next(c for c in "0123456789" if luhn(new + c)))
    if kind == "phone":
        return filled(piece, digits[:-7] + permute_digits(digits[-7:], "phone"))
    if kind == "address":
        n = permute(int.from_bytes(bytes(map(int, piece.split(".")))), 65536, 65536, "address")
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "social":
        areas = [a for a in range(1, 900) if a != 666]
        n = (areas.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1
        n = permute(n, 898 * 99, 9999, "social")
        return f"{areas[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"
    if kind == "account":
        new = digits[2:-18] + permute_digits(digits[2:][-18:], "account")
        bare = filled(piece.replace(" ", ""), "00" + new)
        return filled(piece, f"{98 - rest97(bare):02}" + new)
    if kind == "email":
        return "user-" + hashlib.sha256(f"k|email|{piece.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if kind == "date":
        first = datetime.date(1800, 1, 1)
        style = "%Y-%m-%d" if "-" in piece else "%d.%m.%Y" if "." in piece else "%d/%m/%Y"
        day = datetime.datetime.strptime(piece, style).date()
        return (first + datetime.timedelta(permute((day - first).days, 189, 773, "date"))).strftime(style)
    return piece


PIECES = [
    ("4111 1111 1111 1111", "card"), ("5500-0055-5555-5559", "card"), ("378282246310005", "card"), ("4222222222222", "card"), ("4111111111111112", None),
    ("888-555-6841", "phone"), ("+1 (888) 555-6841", "phone"), ("+49 30 901820", "phone"), ("+442079460958", "phone"), ("+12 34", None), ("555-6841", None),
    ("10.0.0.255", "address"), ("300.1.1.1", None), ("1.2.3.4.5", None), ("078-05-1120", "social"), ("899-99-9999", "social"), ("667-01-0001", "social"),
    ("666-05-1120", None), ("000-05-1120", None), ("078-00-1120", None), ("1078-05-1120", None),
    ("DE89370400440532013000", "account"), ("DE89 3704 0044 0532 0130 00", "account"), ("GB29NWBK60161331926819", "account"), ("GB30NWBK60161331926819", None),
    ("MT84MALT011000012345MTLCAST001S", "account"), ("a.b+c@Mail.example.com", "email"), ("x@y.z", None), ("x@10.example", "email"), ("nobody@nowhere", None),
    ("2023-02-28", "date"), ("2023-02-30", None), ("31/12/1999", "date"), ("29.02.2000", "date"), ("1700-01-01", None), ("2199-12-31", "date"), ("word", None), ("é", None), ("77", None),
]


def test_pseudonyms_equal_plain_arithmetic(spark):
    rng = random.Random(12)
    texts, expect = [], []
    for i in range(150):
        some = [rng.choice(PIECES) for _ in range(rng.randrange(12))]
        gaps = [rng.choice(["; ", ", ", "\n", " and ", " é "]) for _ in some]
        texts.append((i, "".join(g + p for g, (p, _) in zip(gaps, some))))
        expect.append((i, "".join(g + expected(p, k) for g, (p, k) in zip(gaps, some)), *(sum(k == kind for _, k in some) for kind in pii.KINDS)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(r) for r in pii.pseudonymize(docs, "k").collect())
    assert got == expect
    keys = spark.createDataFrame([("k",)], "secret string")
    by_column = pii.pseudonymize(docs.crossJoin(F.broadcast(keys)), F.col("secret"))
    assert sorted(tuple(r) for r in by_column.collect()) == expect


@pytest.mark.parametrize(
    "text",
    ["a" * 1_000_000, "a@" + "b." * 100_000, "a@" + "b." * 100_000 + "com", "7" * 1_000_000, "a@" * 300_000, "._%+-" * 200_000, "1." * 300_000, "+1 " * 200_000, "AB12" * 200_000, "a@b." + "." * 300_000, "(123) " * 100_000],
    ids=lambda t: t[:8],
)
def test_search_takes_time_in_proportion(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    begun = time.time()
    row = pii.pseudonymize(docs, "k").first()
    assert time.time() - begun < 20
    if text.endswith("com"):
        assert row.n_email == 1 and row.text == expected(text, "email")
    else:
        assert row.text == text


def test_ends_of_email_addresses(spark):
    cases = {"..a@b.com..x.org": "..{a@b.com}..x.org", "a@.com": "a@.com", "<a@b.com>": "<{a@b.com}>", "a@b.com.": "{a@b.com}.", "a@b.com.1": "{a@b.com}.1", "a@10.0.0.255": "a@[10.0.0.255]", "a@@b.com": "a@@b.com", "a@b@c.com": "a@{b@c.com}"}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs, "k").collect()}
    fill = lambda t: re.sub(r"\[(.*)\]", lambda m: expected(m[1], "address"), re.sub(r"\{(.*)\}", lambda m: expected(m[1], "email"), t))
    assert got == {i: fill(t) for i, t in enumerate(cases.values())}


def test_month_first_dates_become_month_first_dates(spark):
    first = datetime.date(1800, 1, 1)
    days = [d for d in (first + datetime.timedelta(i) for i in range(146_097)) if d.day > 12]
    ranks = spark.createDataFrame(list(enumerate(days)), "i bigint, d date")
    assert len(days) == 88_497 and ranks.where((pii.late_rank(F.col("d")) != F.col("i")) | (pii.late_day(F.col("i")) != F.col("d"))).count() == 0
    old = [d.strftime("%m/%d/%Y") for d in days if d.year in (1800, 2000, 2019, 2199)]
    docs = spark.createDataFrame([(i, f"on {t}.") for i, t in enumerate(old)] + [(-1, "not 13/13/2020 or 02/30/2020")], "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(docs, "k1").collect()}
    assert out.pop(-1).text == "not 13/13/2020 or 02/30/2020"
    new = [out[i].text[3:-1] for i in range(len(old))]
    assert len(set(new)) == len(old) and all(r.n_date == 1 for r in out.values())
    assert all(1800 <= d.year <= 2199 and d.day > 12 for d in (datetime.datetime.strptime(t, "%m/%d/%Y") for t in new))
    assert sum(a == b for a, b in zip(old, new)) < 5
