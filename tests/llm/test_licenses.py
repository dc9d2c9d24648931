import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdprism.llm import licenses
from cmdprism.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, licenses string, n_words int, places int"
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def plain_notices(text):
    """Labels of all short templates, by comparing every place."""
    words = licenses.words_of(text)
    out = set()
    for t in licenses.templates():
        if not t.keys and any(tuple(words[i : i + len(t.words)]) == t.words for i in range(len(words))):
            out.add(t.label)
    return out


def scan(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], SCHEMA)
    return {r["doc_id"]: r for r in licenses.op13(df).collect()}


FULL = {label: text for label, text, _ in licenses.GRANTS}


def test_base_places_and_notices_equal_a_plain_search(spark):
    rng = np.random.default_rng(1)
    pool = ["mit", "license", "License", "apache", "general", "public", "GNU", "the", "cc", "by", "nc", "sa", "4", "bsd", "2", "clause", "Ünder", "x1"]
    rows = [(i, " ".join(rng.choice(pool, size=int(rng.integers(0, 60))))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "... !!"), (903, "MIT-License, mit\nlicense"), (904, "mitlicense")]
    found = scan(spark, rows)
    assert len(found) == len(rows)
    for i, text in rows:
        r = found[i]
        assert tuple(r[c] for c in COLUMNS[:5]) == plain_base(text), text
        assert set(filter(None, r["labels"].split(","))) == plain_notices(text), text
        assert r["score"] == (1.0 if r["labels"] else 0.0)


@pytest.mark.parametrize("label", sorted(FULL))
def test_a_grant_is_found_without_its_name(spark, label):
    filler = "lorem ipsum dolor sit amet " * 30
    text = FULL[label]
    words = text.split()
    edited = " ".join(w for i, w in enumerate(words) if i != len(words) - 3)  # a word is lost behind the key phrase
    rows = [(1, text), (2, filler + text.upper() + " " + filler), (3, filler + edited), (4, " ".join(sorted(words))), (5, filler)]
    found = scan(spark, rows)
    assert all(label in found[i]["labels"].split(",") for i in (1, 2, 3))
    assert found[4]["labels"] == "" or label not in found[4]["labels"].split(",")
    assert found[5]["labels"] == "" and found[5]["score"] == 0.0
    assert found[3]["score"] > 0.8


def test_a_key_phrase_alone_is_no_grant(spark):
    found = scan(spark, [(1, "unless required by applicable law"), (2, "the following disclaimer and conditions of any kind")])
    assert {r["labels"] for r in found.values()} == {""}


def test_long_texts_repeated_rows_and_empty_tables(spark):
    long = "wort " * 400_000 + "released under the mit license"
    df = spark.createDataFrame([(1, long, "", 1, 1)] * 2, SCHEMA)
    rows = licenses.op13(df).collect()
    assert len(rows) == 2 and {(r["n_words"], r["n_base"], r["first_word"]) for r in rows} == {(400_005, 1, 400_003)}
    assert licenses.op13(df.limit(0)).collect() == []
    empty = licenses.op13(spark.createDataFrame([(1, None, "", 1, 1)], SCHEMA)).first()
    assert [empty[c] for c in COLUMNS] == [0, 0, None, None, "", "", 0.0]


def test_frequencies_cover_the_corpus(spark):
    df = spark.createDataFrame([(i, "mit license mit" if i % 4 == 0 else "license text") for i in range(40)], "doc_id long, text string")
    rows, counts = licenses.document_frequencies(df.repartition(5), "text", licenses.templates())
    assert rows == 40 and counts["mit"] == 10 and counts["license"] == 40
    index = licenses.fit(df)
    assert index.idf["mit"] > index.idf["license"]
    assert index.by_template[0][0] == "mit"


def test_general_form_keeps_columns_and_gives_places(spark):
    df = spark.createDataFrame([(7, "this work is licensed under the mit license")], "doc_id long, text string")
    row = licenses.find_licenses(df, licenses.fit(df)).first()
    assert row["doc_id"] == 7
    assert [(p["start"], p["label"], p["base"]) for p in row["licenses"]["places"]] == [(6, "mit", True)]


def test_query_over_the_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_license_scan"](spark, sf_dir)
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS[:5]) for r in rows.collect()}
    assert found == {i: plain_base(t) for i, t in texts.items()}
    assert rows.where(F.col("score").between(0, 1)).count() == len(texts)
