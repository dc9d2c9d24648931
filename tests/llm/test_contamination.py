import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdprism.llm import contamination as c

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    wanted = {}
    for item_id, text in items:
        words = plain_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            wanted.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    sizes = {len(k) for k in wanted}
    out = []
    for text in docs:
        words = plain_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                held = wanted.get(tuple(words[i : i + size]))
                if held:
                    hit |= set(range(i, i + size))
                    found |= held
        out.append((len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def made_up(seed, n_docs=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "é", "x1", "ß", "word", "zz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(12)]
    items += [(99, ""), (98, None), (97, items[5][1]), (None, "only here twelve")]
    docs = [None, "", "...", "the " * 5000, "Only HERE, twelve!"]
    for _ in range(n_docs):
        words = [rng.choice([*vocab, "other", "Q9"]) for _ in range(rng.randrange(80))]
        at = rng.randrange(len(words) + 1)
        docs.append(" ".join(words[:at] + (items[rng.randrange(12)][1].split() if rng.random() < 0.5 else []) + words[at:]))
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_hits_equal_a_plain_search(seed):
    docs, items = made_up(seed)
    phrases = c.Phrases([(None if i is None else str(i), t) for i, t in items])
    got = [(n, sum(b - a for a, b in spans), found) for n, spans, found in c.hits_of(docs, phrases)]
    assert got == brute(docs, items)


def test_cut_streams_lose_nothing():
    docs, items = made_up(3)
    phrases = c.Phrases([(str(i), t) for i, t in items])
    stream = np.array([phrases.vocabulary.get(w, 0) for w in c.words_of(" ".join(d or "" for d in docs))])
    whole = {tuple(x) for x in zip(*c.occurrences(stream, phrases), strict=True)}
    cut = {tuple(x) for x in zip(*c.occurrences(stream, phrases, 37), strict=True)}
    assert whole and whole == cut


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        s = rng.integers(0, 3, n)
        assert list(c.suffix_array(s)) == sorted(range(n), key=lambda i: list(s[i:]))


def test_query_equals_brute_force_in_one_and_in_many_blocks(spark, sf_dir):
    docs, items = made_up(8)
    docs_df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    items_df = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    want = brute(docs, items)
    for block in (c.BLOCK_BYTES, 100):
        rows = c.find_contamination(docs_df, items_df, block_bytes=block).orderBy("doc_id").collect()
        got = [(r["_hits"]["n_words"], sum(s["end"] - s["start"] for s in r["_hits"]["spans"]), r["_hits"]["items"]) for r in rows]
        assert got == want
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    real_items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    from cmdprism.llm.queries import QUERIES

    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    for row, (n, hit, found) in zip(real, brute([r["text"] for r in real], real_items), strict=True):
        assert got[row["doc_id"]] == (n, hit, len(found), hit > 0, hashlib.sha256(",".join(found).encode()).hexdigest())
    assert any(v[3] for v in got.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert c.digest(docs, items).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = c.digest(one, items).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)


def test_spans_of_blocks_are_merged(spark):
    rows = [([(0, 3), (5, 9), (2, 4), (9, 12), (20, 21)],), ([],), ([(1, 2)],)]
    df = spark.createDataFrame(rows, "s array<struct<start: int, end: int>>").select(c.merged_spans(F.col("s")).alias("m"))
    assert [[(x["start"], x["end"]) for x in r["m"]] for r in df.collect()] == [[(0, 4), (5, 12), (20, 21)], [], [(1, 2)]]
