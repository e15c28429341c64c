"""Personal data against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spokenspark.llm import personal_data
from spokenspark.llm.common import matches, running_sums

SF = "/root/testdata/sf0.001"
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "", re.A) if holds(k, m[0])]


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    forms = [FORMS["email"], FORMS["phone"], FORMS["ip"], r"[0-9]([\x20-]?[0-9]){15,}", r"[^\W_]+"]
    out = []
    for m in re.finditer("|".join(f"(?:{f})" for f in forms), low):
        t = m[0]
        kind = next((k for k in ("email", "phone", "ip") if re.fullmatch(FORMS[k], t)), "card" if re.fullmatch(r"[0-9]([\x20-]?[0-9]){15,}", t) else None)
        value = None if kind is None or not holds(kind, t) else t if kind in ("email", "ip") else ("+" if kind == "phone" else "") + re.sub("[^0-9]", "", t)
        out.append((t, kind is None, value, m.start(), m.end()))
    return out


def expected(texts):
    every = [tokens(t) for t in texts]
    n_term, n_value, both = Counter(t[0] for x in every for t in x if t[1]), Counter(t[2] for x in every for t in x if t[2]), Counter()
    total = sum(n_term.values())
    for x in every:
        for i, t in enumerate(x):
            if t[2]:
                both.update({(t[2], u[0]) for u in x[max(0, i - 8) : i + 9] if u[1]})
    terms = {}
    for (v, t), n in both.items():
        if n >= 2 and math.log(total * min(n, n_term[t]) / (n_term[t] * n_value[v])) >= 0.95 * math.log(total / n_value[v]):
            terms[t] = max(terms.get(t, 4), 5 if n >= n_term[t] else 4)
    rank = {k: i for i, k in enumerate(FORMS)}
    return [[(rank[k], s, e) for k, s, e in base(text)] + sorted((terms[t], s, e) for t, own, _, s, e in x if own and t in terms) for text, x in zip(texts, every, strict=True)], terms


ODD = [
    None, "", "  ", "a@b", "a@b.c_d@e.f", "x.y+z@mail-1.example.co.uk, (a@b.c)", "é😀 jane@x.org é", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111111111",
    "+4111 1111 1111 1111", "call +1 (743) 555-3824 or +12 3 or +1-2-3-4-5-6-7-8)", "0" * 16 + " " + "0" * 20, "@@@ +++ ...", "+1 (((((", "a.b@c..d@e.f", "12345678901234567890@x.yz",
]
NAMED = [f"Filler {w} comes first. Ask Zebulon Quist at z.quist@example.org about {w}." for w in "apples pears plums".split()] + ["Zebulon met Quist once, z.QUIST@example.org.", "We ask about apples at noon and ask again."] + [f"common words ask about many things at place {i}" for i in range(60)]


def rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, [tuple(s) for s in r.found]) for r in df.collect())


def test_spans_against_plain_version(spark):
    texts = [*ODD, *NAMED, NAMED[0], " ".join(NAMED * 40)]
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, ODD[5], "clash", 1), (4, ODD[4], None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, found string, key int").repartition(3)
    want, terms = expected([t for _, t, _, _ in data])
    assert terms["zebulon"] in (4, 5) and "about" not in terms and "apples" not in terms
    found = personal_data.find_personal_data(docs)
    assert found.columns == ["doc_id", "text", "key", "found"]
    assert rows(found) == sorted((i is None, i or 0, w) for (i, *_), w in zip(data, want, strict=True))
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


def test_sanitized(spark):
    data = [(i, t, 0) for i, t in enumerate([*ODD, *NAMED])]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    out = personal_data.sanitized(docs)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(data) and got[0] is None and got[1] == ""
    assert got[6] == "é😀 [EMAIL] é" and got[9] == "+[CARD]" and got[5] == "[EMAIL], ([EMAIL])"
    named = [got[len(ODD) + i] for i in range(4)]
    assert not any(re.search("zebulon|quist", t, re.I) for t in named) and "[EMAIL]" in named[0] and "apples" in named[0]
    assert got[len(ODD) + 5] == NAMED[5]
    assert {r.doc_id: r.n_chars for r in out.collect()}[6] == len(got[6])


def test_documents_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = expected([r.text for r in docs])
    names = [*FORMS, *personal_data.ADDED]
    got = {r.doc_id: r for r in personal_data.op12_personal_data(spark, SF).collect()}
    assert len(got) == len(docs) and any(r.spans for r in got.values())
    for r, w in zip(docs, want, strict=True):
        g = got[r.doc_id]
        assert g.spans == ",".join(f"{names[k]}:{s}:{e}" for k, s, e in w) and [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for k, _, _ in w) for i in range(4)]


def test_running_sums_and_matches(spark):
    df = spark.range(1)
    for n in (1, 2, 63, 64, 65, 1000):
        numbers = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("int"))
        assert df.select(running_sums(numbers)).first()[0] == [sum(x % 7 for x in range(1, k + 1)) for k in range(1, n + 1)]
    text = "é1😀22" * 300
    assert [tuple(m) for m in df.select(matches(F.lit(text), "[0-9]+")).first()[0]] == [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", text)]


@pytest.mark.parametrize("text", ["a" * 2_000_000, "a@b" + ".c" * 300_000 + "_", "1 " * 500_000, "1" * 2_000_000 + ".", "+1 " + "(" * 300_000, "jane@x.org 1.2.3.4 " * 40_000])
def test_long_texts_take_time_in_proportion(spark, text):
    began = time.time()
    n = spark.createDataFrame([(text,)], "text string").select(F.size(personal_data.base_spans(F.col("text")))).first()[0]
    assert n == (80_000 if "jane" in text else 1 if "@" in text else 0) and time.time() - began < 30
