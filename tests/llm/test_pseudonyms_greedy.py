"""Values that a longer match that is not valid would hide."""

from driftline.llm import pii


def test_values_inside_matches_that_are_not_valid():
    p = pii.Permutation(b"k")
    for iban, after in [("BE68 5390 0754 7034", " BIC KREDBEBB"), ("BE68539007547034", " BIC"), ("ES91 2100 0418 4502 0005 1332", " EUR"),
                        ("AT61 1904 3002 3457 3201", " 2024")]:
        text, spans = pii.pseudonymise("to " + iban + after, p)
        assert [(s["kind"], s["first"], s["last"]) for s in spans] == [("iban", 3, 3 + len(iban))]
        assert iban not in text and text.endswith(after) and len(text) == 3 + len(iban + after)
        new = spans[0]["pseudonym"].replace(" ", "")
        assert pii.iban_check(new[:2], new[4:]) == new[2:4] and new == pii.iban(p, iban.replace(" ", ""))
    text, spans = pii.pseudonymise("AB12 CDEF 3456 BE68 5390 0754 7034 end", p)
    assert [(s["kind"], s["first"], s["last"]) for s in spans] == [("iban", 15, 34)]
    text, spans = pii.pseudonymise("1111 2222 4088 4956 9889 7153", p)
    assert [(s["kind"], s["first"]) for s in spans] == [("card", 10)]
    text, spans = pii.pseudonymise("+44 20 7946 0958 2024 1111", p)
    assert [s["kind"] for s in spans] == ["intl"] and not text.startswith("+44 20 7946 0958")
    assert pii.pseudonymise("BE68 5390 0754 7035 BIC, 2023-02-30, 300.1.1.1, 4088495698897154", p) == (
        "BE68 5390 0754 7035 BIC, 2023-02-30, 300.1.1.1, 4088495698897154", [])
