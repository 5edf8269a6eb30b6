"""Private values beside other words."""

import random

import pytest

from tessera.llm import pii


@pytest.mark.parametrize("number", ["BE68 5390 0754 7034", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"])
@pytest.mark.parametrize("after", ["", " BIC", " EUR", " A1", " PAID", " PAID NOW", " PAID 12", ".", " and 2024"])
def test_iban_before_a_word(number, after):
    text = f"pay {number}{after}"
    assert [(text[a:b], k) for a, b, k, _ in pii.find(text) if k == "iban"] == [(number, "iban")]
    new = pii.replace(text, pii.find(text))
    assert number not in new and len(new) == len(text) and new.endswith(after)


@pytest.mark.parametrize("second", ["ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332"])
@pytest.mark.parametrize("before", ["", "AB12 CDEF "])
def test_two_ibans_in_a_row(second, before):
    text = f"{before}BE68 5390 0754 7034 {second} EUR"
    assert [text[a:b] for a, b, k, _ in pii.find(text) if k == "iban"] == ["BE68 5390 0754 7034", second]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def planted(rng):
    """(text, kind, value as it counts for links) of a value whose format is known by how it is made."""
    kind = rng.choice(["card", "ssn", "ip", "ip6", "date", "email", "phone", "iban"])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4)), "card", number
    if kind == "ssn":
        parts = [str(rng.randrange(1, 600)).zfill(3), str(rng.randrange(1, 100)).zfill(2), str(rng.randrange(1, 10_000)).zfill(4)]
        return rng.choice(["{}-{}-{}", "SSN: {}{}{}"]).format(*parts), "ssn", "".join(parts)
    if kind == "ip":
        text = ".".join(str(rng.randrange(256)) for _ in range(4))
        return text, "ip", text
    if kind == "ip6":
        text = "2001:db8:" + ":".join(f"{rng.randrange(1, 65536):x}" for _ in range(6))
        return text, "ip", text
    if kind == "date":
        y, m, d = rng.randrange(1000, 3000), rng.randrange(1, 13), rng.randrange(13, 29)
        return rng.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}"]), "date", (y, m, d)
    if kind == "email":
        local = "".join(rng.choice("abcxyz019") for _ in range(rng.choice([3, 12, 90])))
        return f"{local}@mail.example.org", "email", local
    if kind == "phone":
        code, rest = rng.choice(["1", "44", "351"]), digits(9)
        return rng.choice([f"+{code} {rest}", f"+{code}{rest}", f"+{code}-{rest[:3]}-{rest[3:6]}-{rest[6:]}"]), "phone", code + rest
    body = digits(18)
    check = 98 - int(body + "131400") % 97  # D is 13, E is 14
    return f"DE{check:02d}{body}", "iban", body


def test_planted_values_are_found_and_linked(spark):
    """Every planted value and nothing else is replaced, by another valid one of its format, equal values alike."""
    rng = random.Random(11)
    decoys = ["v1.2.3", "300.1.2.3", "4111111111111112", "12:30", "2023-02-30", "1/2", "n0t@nowhere", "500 000", "std::map", "3.14159", "000-12-3456"]
    rows, want, links = [], {}, {}
    for i in range(400):
        parts, spans, at = [], [], 0
        for _ in range(rng.randrange(1, 12)):
            what = rng.random()
            if what < 0.35:
                text, kind, value = planted(rng)
                start = at + len(text) - len(text.lstrip("SN: "))
                spans.append((start, at + len(text), kind, value))
            else:
                text = rng.choice(decoys) if what < 0.55 else rng.choice(["word", "né", "und.", "\n", "(so)"])
            parts.append(text)
            at += len(text) + len(" | ")
        rows.append((i, " | ".join(parts)))
        want[i] = spans
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (None, rows[1][1])]
    d = spark.createDataFrame([(*r, "s", 1, "k") for r in rows], "doc_id long, text string, spans string, n_card int, private string").repartition(3)
    got = pii.report(d, "some key").collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, spans in want.items():
        r, old = by_id[i], rows[i][1]
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for a, b, k, _ in spans)
        shift, at = 0, 0
        for a, b, kind, value in spans:
            assert r["text"][at + shift : a + shift] == old[at:a]
            follows = old[b : b + 3]
            end = r["text"].index(follows, a + shift) if follows else len(r["text"])
            new = r["text"][a + shift : end]
            assert new != old[a:b]
            if kind == "card":
                assert luhn("".join(c for c in new if c.isdigit()))
            bare = "".join(c for c in new if c.isalnum()) if kind != "date" else tuple(sorted(map(int, new.replace("/", "-").replace(".", "-").split("-"))))
            assert links.setdefault((kind, value), bare) == bare
            shift, at = end - b, b
    assert by_id[1002]["text"] == by_id[0]["text"] and by_id[1000]["text"] == by_id[1001]["text"] == ""
    other = {r["doc_id"]: r["text"] for r in pii.report(d, "other key").collect()}
    assert any(other[i] != by_id[i]["text"] for i in want)


@pytest.mark.parametrize("a,b", [("+1 0175557713", "+10175557713"), ("+44 20 7946 0958", "+442079460958"), ("+351-912-345-678", "+351912345678"), ("+7 (495) 123-4567", "+74951234567")])
def test_phones_link_without_separators(a, b):
    x, y = (pii.replace(t, pii.find(t, "k")) for t in (a, b))
    assert "".join(c for c in x if c.isdigit()) == "".join(c for c in y if c.isdigit()) and x != a


@pytest.mark.parametrize("text", ["born 1850-03-04", "in 2150-01-01", "on 31/12/99", "call 5551234567", "020 7946 0958", "555 123 4567", "ssn 123456789", "at 2001:db8::8a2e:370:7334"])
def test_less_common_formats(text):
    assert len(pii.find(text, "k")) == 1


def test_dates_keep_their_span_of_years():
    ends = (1900, 2000, 2100, 10_000)
    for year in (1, 1850, 1900, 1999, 2000, 2099, 2100, 9999):
        new = int(pii.replace(t := f"{year:04d}-06-15", pii.find(t, "k"))[:4])
        assert next(i for i, e in enumerate(ends) if year < e) == next(i for i, e in enumerate(ends) if new < e)


@pytest.mark.parametrize("day", ["05/01", "28/02", "31/12", "13/11"])
def test_years_of_two_and_of_four_digits_link(day):
    short, long = (pii.replace(t, pii.find(t, "k")) for t in (f"{day}/24", f"{day}/2024"))
    assert short[:6] == long[:6] and short[-2:] == long[-2:] and long[6:8] == "20" and short != f"{day}/24"


@pytest.mark.parametrize("n", [3, 9, 15, 30, 48, *range(50, 65), 90, 128, 200])
def test_every_character_of_a_local_part_is_replaced(n):
    """At each place the pseudonyms of 24 names agree with the names no more often than by chance."""
    rng = random.Random(n)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n)) for _ in range(24)]
    new = [pii.replace(t, pii.find(t, "k"))[:n] for t in (f"{x}@example.org" for x in names)]
    assert all(sum(x[i] == y[i] for x, y in zip(names, new, strict=True)) <= 7 for i in range(n))
    one = names[0][:-1] + ("a" if names[0][-1] != "a" else "b")  # and one character changes all of its piece
    other = pii.replace(f"{one}@example.org", pii.find(f"{one}@example.org", "k"))[:n]
    last = (n - 1) // pii.PIECE * pii.PIECE
    assert sum(x == y for x, y in zip(new[0][last:], other[last:], strict=True)) <= max(2, (n - last) // 4)


@pytest.mark.parametrize("digits", [7, 9, 12, 16, 19, 30, 60])
def test_every_digit_of_a_number_is_replaced(digits):
    rng = random.Random(digits)
    olds = ["".join(rng.choice("0123456789") for _ in range(digits)) for _ in range(40)]
    news = [pii._number(x, "k", "t") for x in olds]
    assert all(sum(x[i] == y[i] for x, y in zip(olds, news, strict=True)) <= 18 for i in range(digits))
    assert len(set(news)) == len(set(olds))


def test_key_comes_from_the_session(spark):
    d = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    own = pii.report(d).first()["text"]
    spark.conf.set(pii.KEY_SETTING, "named")
    try:
        assert pii.report(d).first()["text"] == pii.report(d, "named").first()["text"] != own
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_other_columns_stay_as_they_are(spark):
    rows = [(1, "mail jo@example.com", "p", "r", 5, "a.b"), (2, None, "q", "s", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _private string, row string, n_chars long, `a.b` string")
    d = d.withColumnRenamed("row", "old")
    out = {r["doc_id"]: r for r in pii.pseudonymize(d, "k").collect()}
    assert out[1]["_private"] == "p" and out[1]["old"] == "r" and out[1]["a.b"] == "a.b" and out[1]["text"] != rows[0][1]
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] is None and out[2]["n_chars"] is None and out[2]["_private"] == "q"
