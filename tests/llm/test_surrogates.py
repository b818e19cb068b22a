from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from rows import as_documents, messy_rows

from edupulse.llm import surrogates
from edupulse.llm.surrogates import KEY, detect, luhn, permute, replace, surrogate

TEXTS = [
    "Write to jane.doe@mail7.example.com or JANE.DOE@mail7.example.com now",
    "Call +1 (017) 555-7713, or +1 017 555 7713; the office is (212) 555-0199.",
    "Host 97.51.17.173 and 192.168.4.5, not 999.1.1.1 nor 1.2.3",
    "Card 9807915762804490 and 4111 1111 1111 1111, id 12345",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" api_key: Zx81-ABCDEFGH99',
    "SSN 078-05-1120, IBAN DE89 3704 0044 0532 0130 00.",
    "Mr John Smith met Mrs Anna Keller and Señor Pedro Ñúñez; господин Иван Петров, Mr. john is no name",
]


def kinds(text):
    return [(k, text[a:b]) for a, b, k, _ in detect(text)]


def test_detection():
    assert [k for k, _ in kinds(TEXTS[0])] == ["email", "email"]
    assert kinds(TEXTS[1]) == [("phone", "+1 (017) 555-7713"), ("phone", "+1 017 555 7713"), ("phone", "(212) 555-0199")]
    assert kinds(TEXTS[2]) == [("ip", "97.51.17.173"), ("ip", "192.168.4.5")]
    assert kinds(TEXTS[3]) == [("card", "9807915762804490"), ("card", "4111 1111 1111 1111")]
    assert [k for k, _ in kinds(TEXTS[4])] == ["secret", "secret"]
    assert kinds(TEXTS[5]) == [("ssn", "078-05-1120"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert [t for _, t in kinds(TEXTS[6])] == ["John Smith", "Anna Keller", "Pedro Ñúñez", "Иван Петров"]
    assert detect("plain words, 12 of them, at 10:30 = fine") == []


@pytest.mark.parametrize("secret", ["a1" * 300, "9f" * 80, "sk-proj-" + "Ab3_" * 40, "9f" * 50_000])
def test_secrets_of_any_length(secret):
    for text in (f"token = {secret} end", f"see {secret} end"):
        if len(secret) == 600 and "token" not in text:
            continue  # no hexadecimal run and no prefix: unnamed, it is a word
        changed, kinds_ = replace(text, KEY)
        assert kinds_ == ["secret"] and len(changed) == len(text) and changed.endswith(" end")
        assert not any(secret[at: at + 12] in changed for at in range(0, min(len(secret), 2000) - 12))


@pytest.mark.parametrize("text", TEXTS)
def test_surrogates_keep_kind_and_form(text):
    out, _ = replace(text, KEY, {})
    assert out != text and kinds(text) != kinds(out)
    assert [k for k, _ in kinds(out)] == [k for k, _ in kinds(text)]
    for (kind, old), (_, new) in zip(kinds(text), kinds(out), strict=True):
        assert old.lower() != new.lower()
        if kind != "name":
            shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)))
            if kind == "secret":
                assert len(old) == len(new) and (not re.fullmatch("[0-9a-f]+", old) or re.fullmatch("[0-9a-f]+", new))
            elif kind != "ip":
                assert shape(old) == shape(new)


def test_coreference_is_kept():
    out, _ = replace(TEXTS[0], KEY, {})
    a, b = (x for _, x in kinds(out))
    assert a != b and a.lower() == b.lower()
    out, _ = replace(TEXTS[1], KEY, {})
    a, b, _ = (re.sub(r"\D", "", x) for _, x in kinds(out))
    assert a == b


def test_permutations_are_one_to_one():
    assert len({permute(f"{a}{b}{c}", "k") for a in "aeiou" for b in "bcdfgh" for c in range(10)}) == 300
    assert len({permute(f"{i:03d}", "k") for i in range(1000)}) == 1000
    ips = {surrogate("ip", f"10.0.{a}.{b}", "k") for a in range(10) for b in range(50)}
    assert len(ips) == 500 and all(x.startswith("10.") for x in ips)
    valid = [f"4{i:04d}{d}" for i in range(300) for d in range(10) if luhn(f"4{i:04d}{d}")]
    made = {surrogate("card", c, "k") for c in valid}
    assert len(made) == len(valid) and all(luhn(c) and c[0] == "4" for c in made)
    wrong = [f"4{i:04d}{d}" for i in range(60) for d in range(10) if not luhn(f"4{i:04d}{d}")]
    assert not any(luhn(surrogate("card", c, "k")) for c in wrong)
    women = surrogates.GIVEN_NAMES["f", "latin"]
    assert {surrogate("name", f"f:{n.lower()}", "k") for n in women} == {n.lower() for n in women}


def test_names_keep_gender_and_script():
    out, _ = replace("Mrs Anna Keller, господин Иван Петров", KEY, {})
    (_, woman), (_, man) = kinds(out)
    assert woman.split()[0] in surrogates.GIVEN_NAMES["f", "latin"] and man.split()[0] in surrogates.GIVEN_NAMES["m", "cyrillic"]
    assert re.fullmatch("[А-ЯЁа-яё]+", man.split()[1]) and woman.split()[1][0].isupper()


def test_clashes_are_resolved(spark, monkeypatch):
    """With surrogates of two digits only, clashes are many; the attempts part them."""
    found = spark.createDataFrame([("ssn", f"{i:09d}") for i in range(0, 3000, 100)], "kind string, entity string")
    monkeypatch.setattr(surrogates, "_surrogates", lambda key, attempt: F.substring(F.sha2(F.concat_ws("|", "entity", attempt.cast("string")), 256), 1, 2))
    key, attempts = surrogates.checked(found)
    made = [hashlib.sha256(f"{i:09d}|{attempts.get(('ssn', f'{i:09d}'), 0)}".encode()).hexdigest()[:2] for i in range(0, 3000, 100)]
    assert attempts and len(set(made)) == len(made)


FIXED = ["Call +15551234567 or +1 555 123 4567", "+4915112345678", "+35312345678", "Password: ________", "token = --------", "auth=........",
         "__@--.com", "x@--.com", "auth=_______a", "Mr ẞ"]


def test_entities_that_cannot_change(spark):
    found = {(k, e) for t in FIXED for _, _, k, e in detect(t)}
    assert found == {("phone", "+1:15551234567"), ("phone", "+2:4915112345678"), ("phone", "+3:35312345678"), ("email", "x@--.com"), ("secret", "_______a")}
    assert all(surrogate(k, e, f"{KEY}{n}") != e for k, e in found for n in range(20))
    key, attempts = surrogates.checked(spark.createDataFrame(sorted(found), "kind string, entity string"))
    for text in FIXED:
        out, hidden = replace(text, key, attempts)
        assert (out != text) == bool(hidden) == bool(detect(text))
    assert replace("+15551234567", key, attempts)[0].startswith("+1")


def test_no_exceptions_by_construction(spark):
    """Also where every string of a shape is taken, and whatever the title."""
    names = [*"aeiou", "smith", "anna smith", *(f"{a}{b}" for a in "bcdfg" for b in "aeiou"), *map(str.lower, surrogates.GIVEN_NAMES["m", "latin"])]
    rows = {("name", e) for t in ("Mr", "Dr", "Mrs") for n in names for _, _, _, e in detect(f"{t} {n.title()}")}
    assert len(rows) == len(names)
    rows |= {("ssn", f"{i:09d}") for i in range(500)} | {("secret", f"{x}{i}bcdabcd") for x in "abzZ" for i in range(10)}
    rows |= {("ip", f"{a}.{b}") for a in ("169.254", "172.31", "192.168", "0.0", "8.8", "255.255") for b in ("0.1", "255.255", "7.7")}
    rows |= {("phone", "4915112345"), ("phone", "+2:4915112345")}
    _, attempts = surrogates.checked(spark.createDataFrame(sorted(rows), "kind string, entity string"))
    assert attempts == {}
    assert surrogate("ip", "169.254.9.9", "k").startswith("169.254.") and surrogate("ip", "172.20.1.1", "k").startswith(("172.", "192.168."))


def test_person_has_one_surrogate_under_every_title(spark):
    docs = as_documents(spark, [(1, "Dr Anna Smith"), (2, "Ms Anna Smith"), (3, "Mr Smith"), (4, "Mrs Smith"), (5, "Dr Smith")])
    out = {r["doc_id"]: r["text"].split(" ", 1)[1] for r in surrogates.pseudonymize(docs).collect()}
    assert out[1] == out[2] and out[3] == out[4] == out[5] and len(set(out.values())) == 2


def test_attempts_end(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "MAX_ATTEMPTS", 2)
    with pytest.raises(ValueError, match="no surrogate"):
        surrogates.checked(spark.createDataFrame([("secret", "________")], "kind string, entity string"))


def test_whole_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + messy_rows()
    docs = as_documents(spark, rows)
    out = surrogates.pseudonymize(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    key, _ = surrogates.checked(surrogates.entities(docs))
    assert got == sorted(((i, replace(t, key, {})[0] if t else t) for i, t in rows), key=repr)
    clean = [t for _, t in messy_rows() if t]
    assert all(t in {t for _, t in got} for t in clean)


def test_nothing(nothing):
    assert surrogates.report(nothing).count() == 0
