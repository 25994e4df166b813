import datetime
import hashlib
import re

from ticketlens.llm.pii import PATTERNS, pseudonymise

KEY = "k"


def _run(spark, texts, key=KEY):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in pseudonymise(frame, key, found="kinds").orderBy("doc_id").collect()]


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _draw(tweak, step, other):
    return hashlib.sha256("|".join((KEY, tweak, str(step), other)).encode()).hexdigest()


def _pair(a, b, ma, mb, tweak):
    """The Feistel network on a pair of numbers, in plain Python."""
    for step in range(1, 9):
        a, b, ma, mb = b, (a + int(_draw(tweak, step, str(b))[:4], 16)) % ma, mb, ma
    return a, b


def _digits(text, tweak):
    """The Feistel network on the digits of a text, in plain Python."""
    ds = [int(c) for c in text if c.isdigit()]
    a, b = ds[:len(ds) // 2], ds[len(ds) // 2:]
    for step in range(1, 9):
        h = _draw(tweak, step, ".".join(map(str, b)))
        a, b = b, [(x + int(h[i % 16 * 4:i % 16 * 4 + 4], 16)) % 10 for i, x in enumerate(a)]
    new = iter(a + b)
    return "".join(str(next(new)) if c.isdigit() else c for c in text)


def test_equals_a_plain_implementation(spark):
    texts = ["4111111111111111", "4111 1111 1111 1111", "10.0.200.7", "+49 (030) 555-7713", "123-45-6789",
             "2024-02-29", "29/02/2024", "31.12.1999"]
    got = [r["text"] for r in _run(spark, texts)]
    for text, new in zip(texts[:2], got[:2]):
        assert new[:-1] == _digits(text[:-1], "card") and _luhn(re.sub(r"\D", "", new))
    a, b, c, d = map(int, texts[2].split("."))
    hi, lo = _pair(a * 256 + b, c * 256 + d, 65536, 65536, "ipv4")
    assert got[2] == f"{hi >> 8}.{hi % 256}.{lo >> 8}.{lo % 256}"
    assert got[3] == "+49 " + _digits("(030) 555-7713", "phone")
    assert got[4] == _digits(texts[4], "ssn")
    first = datetime.date(1800, 1, 1)
    for text, new, form in zip(texts[5:], got[5:], ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y")):
        n = (datetime.datetime.strptime(text, form).date() - first).days
        x, y = _pair(n // 773, n % 773, 189, 773, "date")
        assert new == (first + datetime.timedelta(days=x * 773 + y)).strftime(form)


def test_equal_values_stay_linked_and_distinct_ones_distinct(spark):
    values = [f"{i // 20}.{i % 20}.7.9" for i in range(200)]
    rows = _run(spark, [f"x {v}, y" for v in values] + [f"again {v}" for v in values])
    new = [re.search(PATTERNS["ipv4"].replace(r"\p{L}", "a-z"), r["text"])[0] for r in rows]
    assert new[:200] == new[200:] and len(set(new)) == 200 and not set(new) & set(values)
    mails = [r["text"] for r in _run(spark, ["Ann.Bo7@x.org", "ANN.BO7@x.org and ann.bo7@x.org"])]
    local = [m.split("@")[0] for m in re.findall(r"\S+@x.org", " ".join(mails))]
    assert len({x.lower() for x in local}) == 1 and local[1] == local[1].upper()
    assert _run(spark, ["1.2.3.4"])[0]["text"] != _run(spark, ["1.2.3.4"], key="other")[0]["text"]


def test_formats_and_checks(spark):
    texts = ["iban DE89370400440532013000.", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "çé.12@mail7.example.com###"]
    iban, token, mail = (r["text"] for r in _run(spark, texts))
    value = re.search(r"DE\d{20}", iban)[0]
    assert int(re.sub("[A-Z]", lambda m: str(ord(m[0]) - 55), value[4:] + value[:4])) % 97 == 1 and value not in texts[0]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', token) and token != texts[1]
    assert re.fullmatch(r"[^\W\d]{2}\.\d\d@mail7\.example\.com###", mail) and mail != texts[2]


def test_what_is_not_valid_stays(spark):
    texts = ["4111111111111112 256.1.1.1 1.2.3.4.5 2023-02-30 31/04/2020 000-12-3456 a@b DE00370400440532013000",
             "Clean text, version 2.0 of 1999: 12345", None, "", "no digits at all", "x" * 300_000 + " 12 "]
    rows = _run(spark, texts)
    assert [r["text"] for r in rows] == texts and all(r["kinds"] == [] for r in rows)


def test_columns_with_clashing_names_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "1.2.3.4", "v", "k")] * 2, "doc_id long, text string, values string, kinds string")
    out = pseudonymise(frame, KEY)
    assert out.columns == frame.columns and out.distinct().count() == 1 and out.count() == 2
    assert pseudonymise(frame.where("false"), KEY).count() == 0
    assert pseudonymise(frame, KEY).collect()[0]["text"] != "1.2.3.4"


def test_letters_of_every_script_change(spark):
    names = ["иван.петров", "ИВАН.ПЕТРОВ", "γιώργος", "李小龍", "김철수", "łukasz.żółć", "straße", "ÿß", "يوسف", "𠮷野", "Ивaн7"]
    rows = _run(spark, [f"to {n}@mail.example.org." for n in names])
    new = [re.fullmatch(r"to (.+)@mail\.example\.org\.", r["text"])[1] for r in rows]
    assert [r["kinds"] for r in rows] == [["email"]] * len(names) and len(set(new)) == len(names)
    for old, now in zip(names, new):
        assert len(now) == len(old) and [c.isalnum() for c in now] == [c.isalnum() for c in old]
        assert sum(a == b and a.isalnum() for a, b in zip(old, now)) <= 1, (old, now)
    assert new[1].lower() == new[0] and new[1] == new[0].upper()
    assert _run(spark, ["._%@mail.example.org"])[0]["kinds"] == []              # nothing to replace


def test_long_secrets_grouped_ibans_and_month_first_dates(spark):
    secret = "0f1e2d3c" * 32
    texts = [f'key "{secret}"', f"'{'ab12' * 5000}'", "iban DE89 3704 0044 0532 0130 00 OK", "BE68 5390 0754 7034 OK", "12/25/2020"]
    rows = _run(spark, texts + ["DE89370400440532013000"])
    assert [r["kinds"] for r in rows] == [["secret"], ["secret"], ["iban"], ["iban"], ["date"], ["iban"]]
    new = [r["text"] for r in rows]
    assert re.fullmatch('key "[0-9a-f]{256}"', new[0]) and secret not in new[0] and len(new[1]) == 20_002
    grouped = re.fullmatch(r"iban (DE\d\d(?: \d{4}){4} \d\d) OK", new[2])[1]
    assert grouped.replace(" ", "") == new[5] != "DE89370400440532013000"
    assert re.fullmatch(r"BE\d\d(?: \d{4}){3} OK", new[3]) and new[3] != texts[3]
    assert new[4] != texts[4] and datetime.datetime.strptime(new[4], "%m/%d/%Y")


#: The alphabets of the usual kinds.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"


def _plain(text, tweak, alphabets):
    """The Feistel network over several alphabets, in plain Python."""
    at = [(i, next((a, a.index(c.lower())) for a in alphabets if c.lower() in a)) for i, c in enumerate(text)
          if any(c.lower() in a for a in alphabets)]
    codes, sizes = [x for _, (_, x) in at], [len(a) for _, (a, _) in at]
    half = len(at) // 2
    a, b, ra, rb = codes[:half], codes[half:], sizes[:half], sizes[half:]
    for step in range(1, 9):
        h = _draw(tweak, step, ".".join(map(str, b)))
        moved = [(x + int(h[i % 16 * 4:i % 16 * 4 + 4], 16)) % ra[i] for i, x in enumerate(a)]
        a, b, ra, rb = b, moved, rb, ra
    out = list(text)
    for (i, (alphabet, _)), x in zip(at, a + b):
        out[i] = alphabet[x].upper() if out[i] != out[i].lower() else alphabet[x]
    return "".join(out)


def test_emails_ibans_and_secrets_equal_a_plain_implementation(spark):
    three = ("0123456789", LETTERS, ACCENTED)
    locals_ = ["a", "Bob.Smith+x", "çé.12", "x" * 200, "A1_b2%c3-d4", "José"]
    rows = _run(spark, [f"{x}@host.example" for x in locals_])
    assert [r["text"] for r in rows] == [_plain(x, "email", three) + "@host.example" for x in locals_]
    ibans = ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO9386011117947"]
    for old, row in zip(ibans, _run(spark, ibans)):
        account = _plain(old[4:], "iban", three[:2])
        digits = "".join(str(int(c, 36)) for c in account.replace(" ", "") + old[:2] + "00")
        assert row["text"] == f"{old[:2]}{98 - int(digits) % 97:02}{account}" and row["kinds"] == ["iban"]
    secrets = ["0123456789abcdef" * 2, "ABCDEF0123" * 10, "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"]
    rows = _run(spark, [f"'{x}'" for x in secrets])
    assert [r["text"] for r in rows] == [f"'{_plain(x, 'secret', ('0123456789abcdef',))}'" for x in secrets]


def test_marks_long_names_and_international_domains(spark):
    """No run of the local part is left as it was where a kind is reported."""
    names = ["jose\u0301.garcia", "राहुल", "สมชาย.ใจดี", "a\u0308o\u0308u\u0308", "Zoe\u0308.M", "x." * 80 + "name",
             "אֱלֹהִים", "தமிழ்", "ḷ\u0323mno"]
    domains = ["example.org", "münchen.de", "例え.テスト", "xn--bcher-kva.xn--p1ai", "मेल.भारत", "a.b.c.d.e.f.g.h.i.j.example.com"]
    addresses = [(n, d) for n in names for d in domains]
    rows = _run(spark, [f"to {n}@{d}, please" for n, d in addresses])
    for (name, domain), row in zip(addresses, rows):
        new = re.fullmatch(r"to (.+)@(.+), please", row["text"])
        assert new[2] == domain and len(new[1]) == len(name) and new[1] != name, row
        runs = lambda x: re.split(r"[._%+-]", x)
        assert [len(r) for r in runs(name)] == [len(r) for r in runs(new[1])]
        same = [a for a, b in zip(runs(name), runs(new[1])) if a == b and len(a) > 1]
        assert row["kinds"] == ([] if same else ["email"])
        assert not same or len(same[0]) <= 2
        if name == "राहुल":
            assert sum(a != b for a, b in zip(name, new[1])) >= 3
    long = "l" * 5000
    assert _run(spark, [f"{long}@example.org"])[0]["text"] != f"{long}@example.org"
    assert _run(spark, ["word " * 2 + "a." * 100_000 + "@x"])[0]["kinds"] == []
    assert _run(spark, ["a@" + "b." * 100_000 + " ok"])[0]["kinds"] == []


def test_more_ways_to_write_dates(spark):
    texts = ["2024/02/29", "29.2.2024", "1.3.2024", "2023/02/30", "31.4.2020", "29.02.2024", "1.2.3.2024"]
    rows = _run(spark, texts)
    assert [r["kinds"] for r in rows] == [["date"], ["date"], ["date"], [], [], ["date"], []]
    new = [r["text"] for r in rows]
    assert re.fullmatch(r"\d{4}/\d\d/\d\d", new[0]) and re.fullmatch(r"[1-9]\d?\.[1-9]\d?\.\d{4}", new[1])
    day = datetime.datetime.strptime(new[0], "%Y/%m/%d")
    assert day == datetime.datetime.strptime(new[1], "%d.%m.%Y") == datetime.datetime.strptime(new[5], "%d.%m.%Y")
    assert new[3:5] == texts[3:5] and new[6] == texts[6]
