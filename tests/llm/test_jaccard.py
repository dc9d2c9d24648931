import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cmdprism.llm import jaccard
from cmdprism.llm.queries import QUERIES


def shingle_set(text, width=5):
    words = (text or "").lower().encode().translate(jaccard.WORD_BYTES).split()
    n = min(width, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute(rows, threshold=0.8):
    """Per row: its number of links, and the rows of its class."""
    sets = [shingle_set(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    links = [set() for _ in rows]
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if both / (len(s) + len(sets[j]) - both) >= threshold - 1e-12:
                links[i].add(j)
                links[j].add(i)
    group = [None] * len(rows)
    for i in range(len(rows)):
        if group[i] is None:
            reached, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()] - reached:
                    reached.add(j)
                    todo.append(j)
            for j in reached:
                group[j] = frozenset(reached)
    return [len(x) for x in links], group


def made_up(seed):
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    rows, next_id = [], iter(range(10_000))
    for _ in range(40):  # small groups of copies and near copies
        text = words(rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 5)):
            changed = list(text)
            for _ in range(rng.randrange(0, 3)):
                changed[rng.randrange(len(changed))] = "new"
            rows.append((next(next_id), " ".join(changed)))
    base = words(150)  # a large group of near copies
    for i in range(90):
        changed = list(base)
        changed[rng.randrange(150)] = f"edit{i}"
        rows.append((next(next_id), " ".join(changed)))
    passage = words(40)  # unlike documents that share a passage
    rows += [(next(next_id), " ".join(words(60) + passage + words(40))) for _ in range(80)]
    rows += [(next(next_id), " ".join(passage))] * 3  # repeated rows
    rows += [(next(next_id), t) for t in (None, "", "...", "one", "One!", "a b c d", "x" * 100_000, "y " * 3000)]
    rows.append((None, "one two three four five six"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,chunk", [(32, 256), (4, 16)])
def test_links_and_classes_equal_brute_force(spark, small, chunk):
    rows = made_up(small)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, cluster string")
    # So many runs that no pair of this size is missed.
    got = jaccard.near_duplicates(df, recall=1 - 1e-9, small=small, chunk=chunk).collect()
    links, groups = brute(rows)
    want = Counter(
        (i, n, len(g), min((rows[j][0] for j in g if rows[j][0] is not None), default=None))
        for (i, _), n, g in zip(rows, links, groups, strict=True)
    )
    assert Counter((r["id"], r["n_links"], r["class_docs"], r["class_id"]) for r in got) == want


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, in buckets of all levels, are found at the stated rate."""
    rng = random.Random(4)
    rows = []
    for k in range(300):
        text = [f"p{k}x{i}" for i in range(100)]
        other = list(text)
        other[50], other[52] = "new", "other"  # 7 of 96 shingles differ: similarity 89 / 103
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    rng.shuffle(rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_links"] for r in got) / 600 >= jaccard.TARGET_RECALL


def test_query_finds_the_links_of_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    links, groups = brute(rows)
    got = {r["doc_id"]: r for r in QUERIES["op4_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got.values())
    assert 0.95 * sum(links) <= found <= sum(links)
    same = sum(got[i]["class_id"] == min(rows[j][0] for j in g) for (i, _), g in zip(rows, groups, strict=True))
    assert same >= 0.98 * len(rows)


def test_one_document_of_each_class_stays(spark):
    rows = made_up(9)
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, _class string").withColumnRenamed("_class", "_own")
    kept = jaccard.one_of_each(df.drop("_own"), recall=1 - 1e-9).collect()
    _, groups = brute(rows)
    want = Counter()
    for g in set(groups):
        ids = [rows[j][0] for j in g]
        want[min((x for x in ids if x is not None), default=None)] += 1
    assert Counter(r["doc_id"] for r in kept) == want


def test_equal_tokens_lead_to_equal_buckets():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    b = np.unique(np.r_[a[:180], rng.integers(0, 2**63, 20).astype(np.uint64)])
    runs = 200
    one, two = jaccard.first_buckets([a, b], runs, 0.8)
    assert abs(len(one) / runs - 1 / 0.8) < 0.3
    shared = np.intersect1d(one, two)
    assert abs(len(shared) / runs - 180 / 200 / 0.8) < 0.3
    below_a, below_b = jaccard.next_buckets(a, shared, 0.8), jaccard.next_buckets(b, shared, 0.8)
    assert abs(len(below_a) / len(shared) - jaccard.BRANCH / 0.8) < 0.4
    assert 0.6 < len(np.intersect1d(below_a, below_b)) / len(below_a) < 1
    assert jaccard.first_buckets([], 3, 0.8) == [] and len(jaccard.first_buckets([a[:0], a], 3, 0.8)[0]) == 0


def test_runs_reach_the_recall():
    rng = np.random.default_rng(1)

    def met(depth):
        picks = rng.poisson(1.0 if depth == jaccard.DEPTH else jaccard.BRANCH)
        return any(depth == 1 or met(depth - 1) for _ in range(picks))

    runs = jaccard.runs_for(jaccard.DEPTH, 0.99)
    missed = sum(not any(met(jaccard.DEPTH) for _ in range(runs)) for _ in range(4000))
    assert missed / 4000 < 0.015


def test_common_counts_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30_000, rng.integers(1, 9000)).astype(np.uint64)) for _ in range(12)]
    got = jaccard.common_counts(sets[:5], sets[5:])
    assert [[len(set(a) & set(b)) for b in sets[5:]] for a in sets[:5]] == got.astype(int).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.op4(df).collect() == []
    assert jaccard.one_of_each(df).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(200, 201), (202, 201)]
    names = {x: rng.randbytes(16) for e in edges for x in e}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a binary, b binary")
    got = {bytes(r["id"]): bytes(r["root"]) for r in jaccard.components(df, "test").collect()}
    groups = [range(0, 61), range(100, 140), range(200, 203)]
    assert got == {names[x]: min(names[y] for y in g) for g in groups for x in g}


def test_pipeline_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "mixing",
    ]


def test_clashing_columns_are_kept(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame(
        [(1, text, "a", "b", "c"), (2, text, "d", "e", "f"), (3, "other words", "g", "h", "i")], "doc_id long, text string, _set string, _own string, _stay string"
    )
    assert sorted(tuple(r) for r in jaccard.one_of_each(df).collect()) == [(1, text, "a", "b", "c"), (3, "other words", "g", "h", "i")]


@pytest.mark.parametrize("small", [4, 32])
def test_recall_just_above_the_threshold(spark, small):
    """Sets that share nearly all their words meet in large buckets of all levels: every pair has a similarity of 0.82."""
    rng = random.Random(9)
    shared = [f"w{i}" for i in range(75)]
    rows = []
    for i in range(120):
        own = [f"x{i}y{j}" for j in range(8)]
        # One-word shingles make the similarity exact: 75 shared of 91 words.
        words = shared + own
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.near_duplicates(df, width=1, small=small)
    got = [r["n_links"] for r in found.collect()]
    assert sum(got) >= 0.99 * 120 * 119
    assert {r["class_id"] for r in found.collect()} == {0}
