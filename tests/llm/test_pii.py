import hashlib
import random
import re

import numpy as np

from cmdprism.llm import pii
from cmdprism.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_sum(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled)


def base(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn_sum(digits) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def texts():
    rng = random.Random(3)
    parts = [
        "a@b.com", "x.y+z@mail-1.example.co.uk", "@home", "a@b", "a@b@c.de", "x@a.com.y@b.org", "..@-.-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
        "001.002.003.004", "12.5", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500 0000 0000 0004 99", "+1 (269) 555-3296",
        "+44((((", "+4 5", "+1234567890123456", "call 555-123-4567", "(555) 123-4567", "me (at) mail (dot) com", "card 4111.1111.1111.1111", "٣٤",
        "v1.2.3.4", "é", "\U0001f600", "9" * 40, "id 378282246310005 x",
    ]
    out = [None, "", "nothing here", "a" * 50_000 + "@", "1" * 50_000, "1 " * 20_000, "+" * 10_000 + "1", "a@" * 5000, "1." * 20_000]
    for _ in range(400):
        out.append(rng.choice(["", " ", ", ", "."]).join(rng.choice(parts) for _ in range(rng.randrange(1, 8))))
    return out


def test_base_spans_equal_the_plain_patterns():
    for text in texts():
        if text and len(text) <= 10_000:
            order = {k: i for i, k in enumerate(pii.KINDS)}
            assert sorted(pii.base_and_dropped(text)[0], key=lambda s: (order[s[0]], s[1])) == base(text), text


def test_added_spans_leave_base_spans_and_overlap_nothing(spark):
    rows = [(i, t, "q") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.fit(df)
    added = 0
    for _, text, _ in rows:
        own, spans = model.spans(text)
        assert set(own) <= set(spans)
        for kind, a, b in set(spans) - set(own):
            added += 1
            assert kind in pii.KINDS and 0 <= a < b <= len(text)
            assert not any(a < y and x < b for k, x, y in spans if (k, x, y) != (kind, a, b))
    assert added > 10
    masked = df.select("doc_id", pii.masked(model, df["text"]).alias("m")).collect()
    by_id = {r["doc_id"]: r["m"] for r in masked}
    for i, text, _ in rows:
        if not model.spans(text)[1]:
            assert by_id[i] == text
        else:
            covered = {x for _, a, b in model.spans(text)[1] for x in range(a, b)}
            kept = "".join(c for x, c in enumerate(text) if x not in covered)
            assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", by_id[i]) == kept and by_id[i] != text


def test_reliabilities_are_recovered():
    """Votes drawn from known labelers: the estimate tells both classes apart as well as those labelers allow."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.7, 0.6, 0.85])
    drawn = np.where(rng.random((4000, 5)) < right, truth[:, None] * 2 - 1, 1 - truth[:, None] * 2)
    drawn[rng.random((4000, 5)) < 0.2] = 0
    patterns, at, n = np.unique(drawn, axis=0, return_inverse=True, return_counts=True)
    p = pii.estimate(patterns, n.astype(float))[at.ravel()]
    assert ((p > 0.5) == truth).mean() > 0.95
    assert abs(p.mean() - truth.mean()) < 0.03


def test_query_over_the_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for row in rows:
        spans = base(docs[row["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(row["spans"].split(","))


def test_empty_table_and_no_candidates(spark):
    assert pii.op3(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = pii.op3(spark.createDataFrame([(None, "plain words")], "doc_id long, text string")).first()
    assert row["spans"] == "" and row["n_email"] == 0


def test_numbers_of_many_groups_are_candidates_inside_longer_runs():
    card = "4111111111111111"
    for size in (1, 2, 3, 4):
        spelt = " ".join(card[i : i + size] for i in range(0, len(card), size))
        for text in (f"pay {spelt} 20240102", f"pay 20240102 {spelt}"):
            at = text.index(spelt)
            assert ("card", at, at + len(spelt)) in pii.candidates(text)[1], text
    text = "call +49 30 12 34 56 78 20240102 1530"
    assert ("phone", 5, 5 + len("+49 30 12 34 56 78")) in pii.candidates(text)[1]
    assert len(pii.candidates("1 " * 20_000)[1]) <= 7 * 20_000


def test_added_spans_are_the_likeliest_that_overlap_nothing(spark):
    """By plain choice: of all candidates that are likely enough and free, the likeliest is taken, until none is left."""
    rng = np.random.default_rng(8)
    parts = [
        "mail ann (at) example (dot) org", "card 4111.1111.1111.1111", "call 030 1234 5678", "phone 0151-2345678", "pay 4111 1111 1111 1111 20240102 77",
        "ip 10.0.0.1", "bob@example.com", "+49 30 1234567", "4111 1111 1111 1111", "nothing here", "tel +49 30 12 34 56 78 20240102 1530",
    ]
    texts = [" ".join(rng.choice(parts, size=int(rng.integers(1, 7)))) for _ in range(150)]
    model = pii.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    added = 0
    for text in texts:
        own, more = pii.candidates(text)
        taken = list(own)
        open_ = [(pii.SpanClassifier.probability(model, pii.describe(text, *s, False)), s) for s in more]
        while True:
            free = [(p, s) for p, s in open_ if p >= pii.ACCEPT and not any(s[1] < b and a < s[2] for _, a, b in taken)]
            if not free:
                break
            taken.append(min(free, key=lambda x: (-x[0], x[1]))[1])
        assert sorted(taken) == sorted(model.spans(text)[1])
        added += len(taken) - len(own)
    assert added > 20
