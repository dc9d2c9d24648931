import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from cmdprism.llm import language
from cmdprism.llm.queries import QUERIES


def plain_bits(train, body):
    """Code length by walking contexts from the longest to none, straight from the counts."""
    counts = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
    for text in train:
        padded = b"   " + text
        for i in range(3, len(padded)):
            for order in range(language.ORDER + 1):
                counts[order][padded[i - order : i]][padded[i]] += 1
    bits, padded = 0.0, b"   " + body
    for i in range(3, len(padded)):
        for order in range(language.ORDER, -1, -1):
            seen = counts[order].get(padded[i - order : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if padded[i] in seen:
                bits -= math.log2(seen[padded[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_plain_walk():
    corpora = {"x": ["the cat sat", "the hat é"], "y": ["der hund saß da", "das haus"]}
    bodies = [language.letter_bytes(t) for t in ["the house", "", "ßé zz q", "a", "Das 3 Haus!!"]]
    strings = {k: language.count_strings([language.letter_bytes(t) for t in v]) for k, v in corpora.items()}
    model = language.LanguageModel(strings)
    model.prepare()
    got = model.bits(bodies)
    for k, name in enumerate(model.names):
        want = [plain_bits([language.letter_bytes(t) for t in corpora[name]], b) for b in bodies]
        assert np.allclose(got[:, k], want)


def test_undefined_texts_and_untrained_models():
    model = language.LanguageModel({"x": language.count_strings([b"abc abc"])})
    assert model.predict([None, "", "12 ...!", "abc"]) == [("und", 0.0)] * 3 + [("x", 1.0)]
    assert language.LanguageModel({}).predict(["abc"]) == [("und", 0.0)]


def test_held_out_documents_get_their_language(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_null_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(1, "abc def", "x", "q"), (2, None, "x", None), (None, "abc", None, None), (2, "", "y", None), (2, "z" * 100_000, "y", None)]
    got = language.op1(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["lang_pred"] for r in got)
    assert language.op1(spark.createDataFrame([], schema)).collect() == []
