"""Surrogates: formats, coreference, distinctness, collisions, odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from donorlens.llm import surrogates

TEXTS = [
    "Mail Bob.Smith+x@Foo.example.com or BOB.SMITH+X@FOO.EXAMPLE.COM, not bob.smith@foo.example.com.",
    "Call +1 (743) 555-3824 or (743) 555-3824; ip 10.2.3.4, not a version 1.2.3.4.5",
    "Mr. John Smith and Mrs Smith met Frau Müller, Г-н Иванов and MR JOHN SMITH",
    "DE89 3704 0044 0532 0130 00 and 4111 1111 1111 1111 and 4111111111111112 and 123-45-6789",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: hunter2secret; 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
    "clean text with the numbers 12, 345 and 2024-01-02",
]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r["row"]["doc_id"]: r for r in surrogates.pseudonymised(df).collect()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def test_email_case_and_coreference(made):
    a, b, c = re.findall(r"[^\s,]+@[\w.-]*\w", made[0]["text"])
    assert a.upper() == b and a.lower() != c.lower()
    assert a.split("@")[1].lower() == c.split("@")[1].lower() != "foo.example.com"
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{5}\+[a-z]@[a-z]{3}\.[a-z]{7}\.com", a.lower())


def test_phone_layouts_share_the_number(made):
    text = made[1]["text"]
    long_, short = re.findall(r"\(\d{3}\) \d{3}-\d{4}", text)
    assert long_ == short != "(743) 555-3824" and "+1 (" in text
    assert "10.2.3.4" not in text.split("version")[0] and "1.2.3.4.5" in text


def test_names_keep_gender_script_and_case(made):
    m = re.fullmatch(r"Mr\. (\w+) (\w+) and Mrs (\w+) met Frau (\w+), Г-н (\w+) and MR (\w+) (\w+)", made[2]["text"])
    first, last, wife, other, russian, first2, last2 = m.groups()
    assert last == wife and (first.upper(), last.upper()) == (first2, last2) and other != last
    assert any(first.endswith(e) for e in surrogates.LATIN_ENDS["M"])
    assert all(0x400 <= ord(c) < 0x500 for c in russian)
    assert not {"John", "Smith", "Müller", "Иванов"} & {first, last, other, russian}


def test_numbers_keep_their_format(made):
    iban, a, b, ssn = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) and (\d{4}(?: \d{4}){3}) and (\d{16}) and (\d{3}-\d\d-\d{4})",
                                   made[3]["text"]).groups()
    assert luhn(a.replace(" ", "")) == 0 and a != "4111 1111 1111 1111" and b != "4111111111111112"
    assert ssn != "123-45-6789" and iban != "DE89 3704 0044 0532 0130 00"
    assert made[3]["entity_types"] == "CARD,IBAN,SSN"


def test_secrets(made):
    m = re.fullmatch(r'token = "([0-9a-f]{40})" password: ([a-z]{6}\d[a-z]{6}); ([0-9a-f]{40})', made[4]["text"])
    assert m and m[1] == m[3] and not m[1].startswith("24be") and m[2] != "hunter2secret"


def test_clean_text_is_untouched(made):
    assert made[5]["text"] == TEXTS[5] and made[5]["n_entities"] == 0 and made[5]["entity_types"] == ""


def test_surrogates_are_distinct_and_new_on_a_crowded_domain(spark):
    """Two hundred one-letter names at one domain, and all of 250 addresses: draws collide and are redrawn."""
    values = [("EMAIL", f"{chr(97 + i % 26)}{i // 26}@x.org") for i in range(200)]
    values += [("SURNAME", f"name{i}") for i in range(1500)] + [("IPV4", f"10.0.0.{i}") for i in range(250)]
    df = spark.createDataFrame(values, "kind string, canon string")
    rows = surrogates._distinct_surrogates(df).collect()
    assert len(rows) == len(values)
    made = {(r["kind"], r["surrogate"]) for r in rows}
    assert len(made) == len(values)
    assert not {(k, s.lower()) for k, s in made} & set(values)


def test_hint_never_hides_a_match(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [("Dr Who",), ("api_key=abcdefgh",), ("a@b.c",)], "text string")
    text = F.col("text")
    assert df.filter(text.rlike(surrogates.ANY) & ~text.rlike(surrogates.HINT)).count() == 0


def test_odd_rows(odd_docs, no_docs):
    got = surrogates.pseudonymised_documents(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    same = got.filter("doc_id = 8").first()
    assert same == odd_docs.filter("doc_id = 8").first()
    changed = got.filter("doc_id = 9").first()
    assert "ann@mail" not in changed["text"] and changed["n_chars"] == len(changed["text"]) and changed["size"] == "own size"
    assert got.filter("text is null").count() == 2
    assert surrogates.pseudonymised_documents(no_docs).count() == 0


def test_long_secrets_are_taken_whole(spark):
    run = "ab1Z" * 5000
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4"
    texts = [f"token={run} end", f"token: {jwt}. End", "sum " + "0a1b" * 50 + " end", "key AKIA" + "ABCDEFGH" * 2 + " end",
             "sum " + "abcdefab" * 40 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in surrogates.pseudonymised(df).collect()}
    for i, t in enumerate(texts):
        new = got[i]["text"]
        assert got[i]["n_entities"] == 1 and got[i]["entity_types"] == "SECRET"
        assert len(new) == len(t) and new.split()[-1] == t.split()[-1] and new != t
    new = got[0]["text"]
    assert "ab1Z" * 3 not in new
    assert all(a != b for a, b in zip(jwt.split("."), got[1]["text"].split()[1].split(".")))
    assert got[3]["text"] != texts[3] and "0a1b" * 3 not in got[2]["text"]
