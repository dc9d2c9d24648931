import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cmdprism.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree_of(digests):
    """All levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def climb(levels, pos, digest):
    proof = ""
    for below in levels[:-1]:
        run = below[pos // 3 * 3 : pos // 3 * 3 + 3]
        proof += "".join(run[: pos % 3] + run[pos % 3 + 1 :])
        run[pos % 3] = digest
        digest, pos = h("".join(run)), pos // 3
    return digest, proof


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[source] = (own, tree_of([leaf_of(r, r[4]) for r in own]))
    top = tree_of([trees[s][1][-1][0] for s in order])
    out = []
    for at, source in enumerate(order):
        own, levels = trees[source]
        for pos, row in enumerate(own):
            even = zlib.crc32(b"" if row[0] is None else str(row[0]).encode()) % 2 == 0
            text = row[4].replace("\n", "") if even and row[4] is not None else row[4]
            subroot, low = climb(levels, pos, leaf_of(row, text))
            root, high = climb(top, at, subroot)
            out.append((row[0], levels[0][pos], levels[-1][0], top[-1][0], h(low + high), root, root == top[-1][0]))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def rows_of(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, "clash") for r in rows], SCHEMA)


def sample(n):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        source = [None, "a", "ä", "big", "big", "big", "Z"][int(rng.integers(7))]
        text = [None, "", "line\nbreak", "ende\n", "plain ü €"][int(rng.integers(5))]
        rows.append((i * 7 % 1000, source, [None, "en"][i % 2], [None, 5][i % 3 > 0], text))
    return [*rows, *rows[:1], *rows[:1], (None, "a", None, None, None), (None, None, "x", 1, "a\nb"), (5, "lonely", "en", 3, "x\n")]


@pytest.mark.parametrize("n, levels", [(0, 7), (10, 1), (300, 1), (300, 2), (300, 7)])
def test_equal_to_plain_hashing(spark, monkeypatch, n, levels):
    rows = sample(n)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, levels))
    assert rows_of(merkle.op12(frame(spark, rows))) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("rows", [[(1, "s", "en", 1, "a\nb")], [(i, "s", "en", 1, "a\n") for i in range(30)], [(i, f"s{i}", "en", 1, "a\n") for i in range(11)]])
def test_single_rows_and_sources(spark, rows):
    assert rows_of(merkle.op12(frame(spark, rows))) == sorted(plain(rows), key=key)


def test_empty_table(spark):
    assert merkle.op12(frame(spark, [])).collect() == []


def test_a_state_is_that_of_the_children_before_it(spark):
    digests = merkle.hex_rows([h(str(i)) for i in range(5)])
    parents, children, count, before = merkle.climb(digests)
    assert merkle.hex_texts(parents) == tree_of([h(str(i)) for i in range(5)])[1]
    assert count.tolist() == [3, 2] and (before[:, 0] == merkle.START).all()
    # Resuming at any slot with the child itself gives the parent again.
    for slot in range(2):
        right = np.zeros((2, 2, 64), np.uint8)
        right[:, : 2 - slot] = children[:, slot + 1 :]
        again = merkle.resume(before[:, slot], children[:, slot], right, count - slot - 1, count)
        assert merkle.hex_texts(again) == merkle.hex_texts(parents)


def test_written_parents_hold_one_state_a_child(spark):
    nodes = spark.createDataFrame([("t", i, 20, h(str(i))) for i in range(20)], "tree string, pos long, n long, digest string")
    _, parents, roots = merkle.build(nodes, 2)
    found = [r for part in parents for r in part.collect()]
    assert roots.first()["digest"] == tree_of([h(str(i)) for i in range(20)])[-1][0]
    assert sorted((r["level"], r["pos"]) for r in found) == [(1, i) for i in range(7)] + [(2, 0), (2, 1), (2, 2), (3, 0)]
    assert all(len(r["states"]) == len(r["children"]) and all(len(s) == 32 for s in r["states"]) for r in found)


def test_only_changed_texts_fail(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    joined = merkle.op12(docs).join(docs, "doc_id")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = even & F.coalesce(F.col("text").contains("\n"), F.lit(False))
    assert joined.where(F.col("verified") == changed).count() == 0
