import random
import re

import pytest

from leafmill.llm import pii

KEY = b"secret"
IBAN = "DE89 3704 0044 0532 0130 00"


def kinds(text):
    return [(k, o) for _, _, k, o in pii.entities(text)]


@pytest.mark.parametrize("text,want", [
    ("call +49 30 12 34 56 now", [("phone", "+49 30 12 34 56")]), ("+33-61-23-45-67", [("phone", "+33-61-23-45-67")]), ("(212) 555-0199.", [("phone", "212) 555-0199")]),
    ("bob.1@mail.example.com", [("email", "bob.1@mail.example.com")]), ("x+y@a.org@b", [("email", "x+y@a.org")]), ("a@b", []), ("12@", []), ("@", []),
    ("4785380592391139 4785-3805-9239-1139", [("card", "4785380592391139"), ("card", "4785-3805-9239-1139")]), ("47853805923911390", []),
    ("10.2.3.4, 1.2.3.4.5 256.1.1.1", [("ip", "10.2.3.4")]), ("078-05-1120", [("ssn", "078-05-1120")]),
    ("token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]), ("04dbebab91ab85687d33eeaaf9ac699e1188f96Z", []),
    (f"{IBAN} DE88 3704", [("iban", IBAN)]), (f"{IBAN[:-3]} 0A", [("card", "3704 0044 0532 0130")]), ("GB29 NWBK 6016 1331 9268 19 PAID", [("iban", "GB29 NWBK 6016 1331 9268 19")]),
    ("Dr. Anna Keller met Keller and Frau Schmidt.", [("name", "Anna"), ("name", "Keller"), ("name", "Keller"), ("name", "Schmidt")]),
    ("Mr. Wolfgang Schmidt", [("name", "Wolfgang"), ("name", "Schmidt")]), ("господин Иван Петров", [("name", "Иван"), ("name", "Петров")]),
    ("Anna Smith came; Smith left", [("name", "Anna"), ("name", "Smith"), ("name", "Smith")]), ("Name: Li Wei", [("name", "Li"), ("name", "Wei")]), ("Dreams Herrlich", []),
    (None, []), ("", []), ("1" * 50_000 + "." * 50_000 + "a@" * 50_000, []),
])
def test_detection(text, want):
    assert kinds(text) == want


def originals(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(400):
        yield "email", f"{rng.choice(['a', 'ñé', 'Ab'])}{digits(2)}.{rng.choice('xyz')}@m{digits(1)}.example.com"
        yield "phone", f"+{rng.randint(1, 99)} {digits(3)} {digits(4)}"
        yield "card", digits(16)
        yield "ssn", f"{digits(3)}-{digits(2)}-{digits(4)}"
        yield "ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))
        yield "secret", "".join(rng.choice("0123456789abcdef") for _ in range(32))
        yield "name", rng.choice("KLMÉ") + "".join(rng.choice("aeiklmnrst") for _ in range(4))
    for k in pii.NAMES.values():
        yield from (("name", n) for n in k)


def test_surrogates_are_one_to_one_without_fixed_points_and_keep_form():
    seen, same = {}, 0
    for kind, o in set(originals(random.Random(1))):
        s = pii.surrogate(kind, o, KEY)
        assert s.lower() != o.lower() and (kind, s) not in seen
        seen[kind, s] = o
        assert s == pii.surrogate(kind, o, KEY)
        same += s == pii.surrogate(kind, o, b"another")
        if kind != "name" or o not in pii._NAME_LIST:
            assert len(s) == len(o) or kind == "ip"
            assert [c.isupper() for c in s] == [c.isupper() for c in o] or kind == "ip"
        if kind == "card":
            assert pii.luhn(s) == pii.luhn(o)
        if kind == "name" and o in pii._NAME_LIST:
            assert pii._NAME_LIST[s] == pii._NAME_LIST[o]
    assert same < 0.02 * len(seen)
    assert pii.luhn("4539578763621486") == 0
    assert pii._iban_rest(pii.surrogate("iban", IBAN, KEY)) == 1
    for block in ("10.", "127.", "192.168."):
        assert pii.surrogate("ip", block + "1.2" if block.count(".") == 2 else block + "1.2.3", KEY).startswith(block)
    assert pii.surrogate("email", "Bob@X.org", KEY).lower() == pii.surrogate("email", "bob@x.org", KEY)
    for size in (2, 3, 37):
        moved = [pii._moved(i, size, KEY, "t") for i in range(size)]
        assert sorted(moved) == list(range(size)) and all(a != i for i, a in enumerate(moved))


def test_query_keeps_no_original_and_redraws(spark):
    ssn = "078-05-1120"
    taken = pii.surrogate("ssn", ssn, KEY)  # also some document's original
    rows = [(1, f"x {ssn} y {ssn}", "e"), (2, f"{taken} and é 10.1.2.3", "e"), (2, f"{taken} and é 10.1.2.3", "e"), (3, None, "e"), (4, "", "e"), (None, "Frau Weber, a@b.org. Weber", "e"), (5, "w " * 200_000 + ssn, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = pii.replace_pii(docs, KEY).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[3].text is None and by[4].text == "" and by[3].n_entities == by[4].n_entities == 0
    new = pii.surrogate("ssn", ssn, KEY, 1)
    assert by[1].text == f"x {new} y {new}" and by[5].text.endswith(new) and by[1].kinds == "ssn" and by[1].n_entities == 2
    assert by[2].kinds == "ip,ssn" and " and é 10." in by[2].text
    everything = " ".join(r.text or "" for r in got)
    assert not re.search(rf"{ssn}|{taken}|10\.1\.2\.3|Weber|a@b\.org", everything)
    assert by[None].kinds == "email,name" and len(set(re.findall(r"\bW?[A-Z][a-z]+r?\b", by[None].text)) - {"Frau"}) == 1
    assert pii.replace_pii(docs.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.replace_pii(docs, b"")
