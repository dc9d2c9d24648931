import random
import zlib
from itertools import product

import numpy as np

from cmdprism.llm import toxicity
from cmdprism.llm.queries import QUERIES

CLEAN = "the river runs past a quiet little town and people walk along its banks every morning before work begins".split()
BAD = ["idiot", "moron", "scum", "stupid"]


def corpus(n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def model_of(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, marks, toxicity.fit(docs, marks, marks["toxic"].isNotNull())


def test_letter_counts_are_those_of_three_letters_in_a_row():
    texts = ["Ab é", None, "", "b-b"]
    got = toxicity.trigram_counts(texts)
    plain = {}
    for word in ["ab", "é", "b", "b"]:
        classes = [0, *[toxicity.class_of(c) for c in word], 0]
        for pair in zip(classes, classes[1:], classes[2:], strict=False):
            plain[pair] = plain.get(pair, 0) + 1
    inside = {k: v for k, v in plain.items()}
    for (a, b, c), n in inside.items():
        assert got[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c] >= n
    assert toxicity.class_of("É") == 5 and toxicity.class_of("ж") == toxicity.OTHER and toxicity.class_of("7") == 0


def test_viterbi_equals_the_best_of_all_readings():
    rng = np.random.default_rng(2)
    restorer = toxicity.Restorer(rng.random((28, 28, 28)) * 6)

    def cost(pieces):
        total, a, b = 0.0, 0, 0
        for piece, channel in [*pieces, (" ", 0.0)]:
            total += channel
            for ch in piece:
                c = toxicity.class_of(ch)
                if b or c:
                    total += restorer.costs[a, b, c]
                    a, b = b, c
        return total

    for stretch in ["1d10t", "s c u m", "stuuupiiid", "m0r0n", "a.b.c.d", "$cum"]:
        best = min(product(*restorer.readings(stretch)), key=cost)
        got = restorer.decode(stretch)
        assert abs(cost(best) - min(cost(x) for x in product(*restorer.readings(stretch)) if "".join(p for p, _ in x) == got)) < 1e-9


def test_disguised_words_are_restored_and_scored(spark):
    rows, labels = corpus()
    _, _, model = model_of(spark, rows, labels)
    restore = model.restorer.restore
    assert restore("An 1D10T here") == "an idiot here"
    assert restore("you s c u m") == "you scum"
    assert restore("so stuuuupid") == "so stupid"
    assert restore("m0r0n!") == "moron!"
    assert restore("room 101 on the 3rd") in ("room 101 on the 3rd", "room 101 on the erd")
    assert restore(None) == ""
    model.words.prepare()
    for text in ["the quiet 1d10t walks", "the river s.c.u.m and town", "a stuuuupid town", "MORON"]:
        assert model.words.score(restore(text)) >= toxicity.THRESHOLD, text
    for text in ["the river runs past a quiet town", "", "a a a a a a"]:
        assert model.words.score(restore(text)) < toxicity.THRESHOLD, text


def test_disguises_are_decoded_together(spark):
    rows, labels = corpus()
    _, _, model = model_of(spark, [*rows, *[(1000 + i, "worthless shit hate") for i in range(20)]], labels)
    restore = model.restorer.restore
    plain = {
        "idio+": "idiot", "idio7": "idiot", "hat3": "hate", "worthle$$": "worthless", "m 0 r 0 n": "moron", "i d 1 0 t": "idiot",
        "s.t.u.p.1.d": "stupid", "s - c - u - m": "scum", "s  c  u  m": "scum", "1d107": "idiot", "5h17": "shit",
        "$ c u m": "scum", "ss c uuu mm": "scum", "s.7.uuu.p.!.d": "stupid",
    }
    for disguised, word in plain.items():
        assert restore(f"the {disguised}, here") == f"the {word}, here", disguised
    assert restore("101 10 1 0 1") == "101 10 1 0 1"
    model.words.prepare()
    for text in ["the quiet m 0 r 0 n walks", "a s.t.u.p.1.d town", "the river 1d107", "i d 1 0 t"]:
        assert model.words.score(restore(text)) >= toxicity.THRESHOLD, text


def test_patterns_are_run_wherever_they_match():
    rng = random.Random(8)
    alphabet = "aabé1$!. -_*0\u0416\u0663\u00b2\U0001f600\n"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        spaced, leet, stretched = toxicity.possible(text)
        assert spaced or not toxicity.SPACED.search(text), text
        assert leet or not toxicity.LEET.search(text), text
        assert stretched or not toxicity.STRETCHED.search(text), text


def test_very_long_and_odd_texts(spark):
    rows, labels = corpus(200)
    _, _, model = model_of(spark, rows, labels)
    for text in ["a" * 300_000, "a " * 50_000, "1a" * 20_000, "!" * 100_000, "\U0001f600é" * 100]:
        assert isinstance(model.restorer.restore(text), str)


def test_nulls_repeats_single_labels_and_empty_tables(spark):
    rows, labels = corpus(200)
    docs, marks, _ = model_of(spark, [*rows, (None, None), (3, None), (3, ""), (7, "moron " * 2000)], [*labels, (5, 0), (None, 1), (9, None)])
    got = toxicity.op5(docs, marks).collect()
    assert len(got) == 204 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["predicted"] for r in got if r["doc_id"] == 7][-1] == 1
    only_clean = toxicity.op5(docs, marks.where("toxic = 0")).collect()
    assert {r["score"] for r in only_clean} == {0.0}
    assert toxicity.op5(docs.where("false"), marks).collect() == []
    assert len(toxicity.op5(docs, marks.where("false")).collect()) == 204


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    pairs = [(a, b) for a, y in held if y for b, z in held if not z]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.8
