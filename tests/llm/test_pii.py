"""Personal data on odd and planted texts, against the patterns as they stand and against the SQL."""

import random
import re

import duckdb
import pytest

from sigscreen.llm import corpus, pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _plain(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [c for c in m[0] if c in "0123456789"]
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits))
                    or kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


TEXTS = [
    None, "", " ", "iban: DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00", "my ssn is 123-45-6789", "order 123-45-6789",
    "4111 1111 1111 1111", "4111 1111 1111 1112", "4111111111111111 5555555555554444 and 0000000000000000 4012888888881881",
    "a@b.c@d.e.f. @x.y z@@q.r é@b.co mail é.a@b-c.de", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 version 1.2.3.4",
    "+1 (017) 555-7713 +1 +12 call +49 30 1234567890123 +1-2345678", "🙂🙂 +1 (017) 555-7713 x@y.zz 🙂 10.0.0.1", "ip 10.0.0.1\nip 10.0.0.1",
    "GB82WEST12345698765432", "1" * 50_000, "a" * 50_000 + "@", "1." * 50_000, "word " * 30_000 + "x@y.zz",
]


def test_random_strings_against_the_patterns_as_they_stand():
    r = random.Random(1)
    found = 0
    for _ in range(8000):
        text = "".join(r.choices("aZ.@0123459 -+()%_é🙂\n", weights=[2, 1, 6, 3] + [4] * 7 + [3, 3, 2, 1, 1, 1, 1, 1, 1, 1], k=r.randint(0, 60)))
        got = [s[:3] for s in pii.find_spans(text) if s[4]]
        assert got == _plain(text), text
        found += len(got)
    assert found > 500


@pytest.fixture(scope="module")
def docs(spark):
    corpus.reachable(spark)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "x@y.zz", "x"), (3, TEXTS[3], "x"), (3, TEXTS[3], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string")


def test_added_spans_are_checked_and_base_spans_stay(docs):
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for row in rows:
        text = "" if row.doc_id is None else TEXTS[row.doc_id] or ""
        if row.doc_id is not None:
            assert [(s.kind, s.start, s.end) for s in row.spans if s.base] == _plain(text)
            assert [s.start for s in row.spans] == sorted(s.start for s in row.spans)
    added = {r.doc_id: [(s.kind, TEXTS[r.doc_id][s.start:s.end]) for s in r.spans if not s.base] for r in rows if r.doc_id is not None}
    assert added[3] == [("iban", "DE89 3704 0044 0532 0130 00")] and added[14] == [("iban", "GB82WEST12345698765432")]
    assert added[4] == [("ssn", "123-45-6789")] and added[5] == []
    assert added[8] == [("card", "4111111111111111"), ("card", "5555555555554444"), ("card", "4012888888881881")]


def test_words_nearby_move_the_score():
    def score(text):
        return pii.find_spans(text)[0][3]
    assert score("server 10.0.0.1") > score("x 10.0.0.1") > score("version 10.0.0.1")
    assert score("server " + "x" * pii.NEARBY + " 10.0.0.1") == score("x 10.0.0.1")


def test_digests_against_sql(spark, docs):
    con = duckdb.connect()
    documents = docs.where("doc_id is null or doc_id not in (15, 16, 17)").toPandas()   # noqa: F841
    want = con.execute(queries.ORACLES["op12_personal_data"]).df()
    got = pii.digests(docs.where("doc_id is null or doc_id not in (15, 16, 17)")).toPandas()
    key = list(got.columns)
    def rows(frame):
        return sorted(map(str, frame[key].astype({"doc_id": "float"}).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_empty_table(docs):
    assert pii.digests(docs.limit(0)).count() == 0
