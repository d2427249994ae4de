import random

import pytest

from sheafmill.llm import pii

KEY = b"a test key"


def replaced(text):
    return pii.Pseudonyms(KEY).replace(text)


def test_permutations_are_permutations():
    p = pii.Permutation(KEY)
    for n in (1, 2, 3, 10, 97, 1000):
        moved = [p.apply(b"t", n, x) for x in range(n)]
        assert sorted(moved) == list(range(n))
        assert [p.apply(b"t", n, y, back=True) for y in moved] == list(range(n))
    assert [p.apply(b"u", 1000, x) for x in range(9)] != [p.apply(b"t", 1000, x) for x in range(9)]


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("mail Foo.Bar-9@ex.com, foo.bar-9@EX.com", ["email", "email"]),
        ("DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", ["iban", "iban"]),
        ("DE88370400440532013000", []),
        ("2024-02-29 29/02/2024 02/28/2023 1.2.1999 31.04.2020 2023-02-29", ["date"] * 4),
        ("10.0.0.1 240.56.125.154 256.1.1.1 01.2.3.4 1.2.3.4.5", ["ipv4", "ipv4"]),
        ("078-05-1120 000-12-1234 666-12-1234", ["ssn"]),
        ("4111 1111 1111 1111, 4111111111111111 5500-0000-0000-0004 4111111111111112", ["card"] * 3),
        ("4041894974608795 4337166598464399", ["card", "card"]),
        ("+1 (988) 555-2485 (988) 555-2485 988-555-2485 +49 30 1234567", ["phone"] * 4),
        ("42.144.35.254 4041894974608795 12", ["ipv4", "card"]),
        ("version 2, 1234567 and 99 bottles; 2x4", []),
        ("a" * 100_000 + " x@y.com " + "1 " * 100_000, ["email"]),
        ("", []),
    ],
)
def test_values_keep_their_formats(text, kinds):
    new, spans, names = replaced(text)
    assert [kind for _, kind, _ in spans] == kinds
    # the same places hold values of the same kinds and shapes, which lead back with the key
    again, spans_again, _ = pii.Pseudonyms(KEY, back=True).replace(new)
    assert spans_again == [(a, k, b) for a, k, b in spans if k != "ipv4"] or [k for _, k, _ in spans_again] == kinds
    assert again.lower() == text.lower()
    for (a, kind, b), name in zip(spans, names):
        assert name != text[a:b]
        if kind != "ipv4":
            shape = lambda s: [c if not c.isalnum() else "0" if c.isdigit() else "A" if c.isupper() else "a" for c in s]
            assert shape(name) == shape(text[a:b])


def test_equal_values_stay_linked():
    a = replaced("4111 1111 1111 1111")[0].replace(" ", "")
    assert a == replaced("call 4111111111111111")[0].split()[1]
    assert pii.luhn(a) == 0
    assert replaced("+1 (988) 555-2485")[0][3:] == replaced("(988) 555-2485")[0]
    assert pii.Pseudonyms(b"other").replace("4111111111111111")[0] != a
    assert pii.revealed("card", a, KEY) == "4111111111111111"


def test_different_values_stay_different():
    rng = random.Random(1)
    cards = set()
    while len(cards) < 400:
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        cards.add(body + str(-pii.luhn(body + "0") % 10))
    assert len({replaced(c)[0] for c in cards}) == 400


def test_rows(spark):
    rows = [(1, "x@y.com", "k"), (1, "x@y.com", "k"), (None, "é 10.0.0.1", None), (2, None, "k"), (3, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.pseudonymised(docs, KEY).collect()
    assert sorted((r.doc_id or 0, r.n_found, r.spans, r.text or "") for r in got) == sorted((d or 0, *((n := replaced(t)) and (len(n[1]), ",".join(f"{k}:{a}:{b}" for a, k, b in n[1]), n[0] or ""))) for d, t, _ in rows)
    assert {r.text for r in got if r.doc_id == 2} == {None}
    assert pii.pseudonymised(docs.limit(0), KEY).count() == 0
