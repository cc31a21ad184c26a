import hashlib
import re

import pytest

from plumbline.llm import pii, queries
from tests.llm.conftest import DATA

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and checks(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def checks(number):
    total = 0
    for k, d in enumerate(reversed(number)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PATTERNS.items() for m in re.finditer(p, text or "") if ok(m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    "a@b.c@d.e f", "a@b.c%d@e.f", "@x.y", "a@b", "a@b.", "a@b..c", "x.y+z@mail5.example.com.", "ü@b.co", "a@@b.c", "a@b.c.d@e.f@g.h",
    "1.2.3.4.5.6.7.8", "999.1.2.3.4", "007.08.9.255", "1.2.3.256", "1..2.3.4", "12.34.56", "00000000001.2.3.4", "4111 1111 1111 1111",
    "4111-1111-1111-1111 4111111111111111", "4111  1111", "5", "4111111111111112", "+1 (499) 555-6503%%%", "+1", "+12", "+1 2", "+1--",
    "+49 30 1234567 +49 30 7654321", "+1 (271) 555-1655 188.54.39.104", "+" * 20, "+1" * 9, "", None, "a" * 500 + "@", "1" * 500, "1." * 300,
]


@pytest.mark.parametrize("text", ODD)
def test_base_spans_equal_the_patterns(text):
    assert [(s.kind, s.start, s.end) for s in pii.find(text) if s.base] == base(text)


def test_query_equals_the_patterns(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op12_pii(spark, DATA).collect()
    assert len(found) == len(texts)
    for r in found:
        wanted = base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in wanted) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(listed(wanted).encode()).hexdigest()
        assert set(listed(wanted).split(",")) <= set(r["spans"].split(",")) and r["n_added"] == len([x for x in r["spans"].split(",") if x]) - len(wanted)


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("paid 4465758382889437 4465758382889437 now", "card", "4465758382889437"),
    ("card 12-4111 1111 1111 1111-77", "card", "4111 1111 1111 1111"),
    ("+1 (271) 555-1655 4465758382889437", "phone", "+1 (271) 555-1655"),
    ("call (030) 123 45678 today", "phone", "(030) 123 45678"),
    ("write to jane.doe (at) example (dot) org", "email", "jane.doe (at) example (dot) org"),
    ("IBAN DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
    ("GB82WEST12345698765432", "iban", "GB82WEST12345698765432"),
    ("nir 1 85 05 78 006 084 91", "nir", "1 85 05 78 006 084 91"),
    ("DNI 12345678Z", "dni", "12345678Z"),
    ("her SSN is 123-45-6789", "ssn", "123-45-6789"),
])
def test_added_spans(text, kind, span):
    added = [s for s in pii.find(text) if not s.base and s.kind == kind]
    assert span in [text[s.start : s.end] for s in added] and all(s.score >= pii.MIN_SCORE for s in added)


@pytest.mark.parametrize("text", [
    "IBAN DE89 3704 0044 0532 0130 01", "123-45-6789", "invoice SSN 123-45-6789", "000-12-3456 ssn", "30 123 45678 pieces",
    "DNI 12345678A", "nir 1 85 05 78 006 084 92", "4465758382889438 4465758382889438", "sold 2021 2022 2023 2024 units",
])
def test_what_fails_its_check_or_context_is_left_alone(text):
    assert not pii.find(text)


def test_context_moves_the_score():
    plain, near, against = (pii.find(t)[0].score for t in ("4111111111111111", "visa 4111111111111111", "order 4111111111111111"))
    assert against < plain < near


def test_long_texts_take_linear_time(spark):
    import time

    start = time.perf_counter()
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 150_000, "+1" * 150_000, "1.2." * 75_000, "4111111111111111 " * 20_000):
        pii.find(text)
    assert time.perf_counter() - start < 20


def test_redaction_and_edge_cases(spark, edge, empty):
    docs = spark.createDataFrame([(1, "a@b.co or +1 (499) 555-6503, ip 1.2.3.4"), (2, None), (3, "")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["[EMAIL] or [PHONE], ip [IP]", None, ""]
    found, name = pii.with_spans(edge.withColumn("pii_spans", edge["id"]))
    assert name == "_pii_spans" and found.count() == edge.count() and found.where(f"{name} IS NULL").count() == 0
    assert pii.with_spans(empty)[0].count() == 0 and pii.redact(empty).columns == empty.columns
