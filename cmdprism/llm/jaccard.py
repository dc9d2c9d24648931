"""N-gram Jaccard join by chosen paths.

A document is the set of its shingles (five words in a row). Equal sets are one set with so many copies. In each of
several runs a set picks tokens by a hash of the run and the token, 1/threshold of them on average, and falls into one bucket
per picked token. Buckets of up to ``SMALL`` sets are compared pair by pair. The members of larger ones pick again, by a hash
of the path so far, ``BRANCH``/threshold tokens on average, and fall into the children's buckets, down to ``DEPTH`` levels. Two sets
of the wanted similarity share a pick per run, and ``BRANCH`` picks per further level, on average; ``runs_for`` gives the runs
after which they have met with the wanted chance.

What is still large at the last level is a group of sets that share nearly everything: its overlapping buckets are
joined into one cluster, and all pairs of the cluster are compared, dealt out as pairs of chunks of bounded size, from which
only sums per set and one edge per set come back. Every comparison counts common shingles exactly.

Classes are the connected components of the links; a document's links are all other documents of at least the wanted similarity,
copies included.

Defined results: null texts and texts without words have no shingles, no links and a class each (their set is null). A text of
fewer than ``width`` words has one shingle, all of it. The class id is the smallest non-null document id of the class (null
if it has none). Repeated rows are copies. Empty tables give no rows. Extra columns take no part
and are kept where documents are returned, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import Aside, in_steps
from cmdprism.plans.skew import attach_group_values
from cmdprism.sources.tables import materialize

WIDTH = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.99
DEPTH = 3
BRANCH = 1.5
#: Buckets of up to so many sets are compared at once; larger ones are split on.
SMALL = 32
#: Sets in one chunk of a cluster, and bytes of their texts, on average at most.
CHUNK, CHUNK_BYTES = 1024, 16 << 20
#: Shingles that are hashed at a time.
STEP_TOKENS = 4_000_000

#: ASCII letters in lower case, digits and bytes from 0x80 make words.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
ODD_1, ODD_2, ODD_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def runs_for(depth: int, recall: float) -> int:
    """Runs after which two sets of exactly the threshold have met with the wanted chance, were all buckets large.

    Shared picks are Poisson: one per run on average, ``BRANCH`` per further level. So they miss each other in a run
    with the chance exp(-chance to meet below a shared bucket).
    """
    meet = 1.0
    for _ in range(depth - 1):
        meet = 1 - math.exp(-BRANCH * meet)
    return math.ceil(-math.log(1 - recall) / meet)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD_1
    x = (x ^ (x >> np.uint64(29))) * ODD_2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words; the first ones met are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


class Shingler:
    """Sets of 64-bit shingles."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.hashes = WordHashes()

    def word_hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        return np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        words = self.word_hashes(text)
        width = min(self.width, len(words))
        if not width:
            return words
        total = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            total = total * ODD_3 + words[i : len(words) - width + 1 + i]
        return np.unique(mixed(total))


def digest(tokens: np.ndarray) -> bytes | None:
    """128 bits of a set; None for the empty set."""
    if not len(tokens):
        return None
    sums = [np.add.reduce(mixed(tokens ^ odd)) for odd in (ODD_2, ODD_3)]
    return b"".join(int(x).to_bytes(8, "big") for x in sums)


def picked(tokens: np.ndarray, path: np.uint64, below: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens that a path picks, and the buckets they lead to."""
    hashed = (tokens ^ path) * ODD_1
    hashed = (hashed ^ (hashed >> np.uint64(32))) * ODD_2
    at = np.flatnonzero(hashed < below)
    return at, mixed(hashed[at] ^ path)


def limits(sizes: np.ndarray | int, picks: float) -> np.ndarray:
    """Hashes below which a token of a set of so many is picked, ``picks`` of them on average."""
    return np.minimum(2.0**64 * picks / np.maximum(sizes, 1), 2.0**64 - 4096).astype(np.uint64)


def first_buckets(sets: list[np.ndarray], runs: int, threshold: float) -> list[np.ndarray]:
    """Buckets of every set in all runs."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    below = limits(sizes, 1 / threshold)[owner]
    found = [picked(tokens, path, below) for path in mixed(np.arange(1, runs + 1, dtype=np.uint64) * ODD_3)]
    owners, buckets = np.concatenate([owner[at] for at, _ in found]), np.concatenate([b for _, b in found])
    order = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[order], np.arange(1, len(sets)))
    return np.split(buckets[order].view(np.int64), cuts)


def next_buckets(tokens: np.ndarray, buckets: np.ndarray, threshold: float) -> np.ndarray:
    """The children's buckets of one set in some large buckets."""
    below = limits(len(tokens), BRANCH / threshold)
    return np.concatenate([picked(tokens, path, below)[1] for path in buckets.view(np.uint64)]).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def least_common(size_a: np.ndarray | int, size_b: np.ndarray | int, threshold: float) -> np.ndarray | float:
    """Common shingles that two sets need: common / (a + b - common) >= threshold."""
    return threshold / (1 + threshold) * (size_a + size_b) - 1e-9


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common shingles of every left with every right set, by products over slabs of shared tokens."""
    tokens = np.concatenate([*left, *right])
    shared, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    number = np.cumsum(counts > 1) - 1
    keep = (counts > 1)[at]
    owner, column = owner[keep], number[at[keep]]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for slab in range(0, int((counts > 1).sum()), 4096):
        a, b = np.searchsorted(column, [slab, slab + 4096])
        cells = np.zeros((len(left) + len(right), 4096), dtype=np.float32)
        cells[owner[a:b], column[a:b] - slab] = 1
        total += cells[: len(left)] @ cells[len(left) :].T
    return total


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) of all nodes of ``edges`` (a, b): root is the smallest node of the component.

    Alternating stars: each node hands its larger neighbours, then all its smaller ones, to the smallest; components
    shrink to stars in a number of rounds that grows with the logarithm of their size. Edges meet the value of their node by a
    join that a hot node (the middle of a star) doesn't skew. Nodes are hex texts meanwhile, in the same order.
    """
    named = edges.where("a <> b").select(F.hex(F.least("a", "b")).alias("lo"), F.hex(F.greatest("a", "b")).alias("hi"))
    edges, before = materialize(named.distinct(), name), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m"), F.count("*").alias("n")).select("lo", F.least("lo", "m").alias("m"), "n")
        handed = attach_group_values(edges, materialize(least, name), "lo", "n", ["m"], spread_by="hi")
        large = materialize(handed.select(F.col("m").alias("lo"), "hi").distinct(), name)
        down = materialize(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), name)
        # Every node but the smallest hangs on the smallest of its neighbours, which takes over the others.
        joined = attach_group_values(large, down, "hi", "n", ["m"], spread_by="lo")
        pairs = F.array(
            F.struct(F.least("lo", "m").alias("lo"), F.greatest("lo", "m").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi"))
        )
        edges = materialize(joined.select(F.inline(pairs)).where("lo <> hi").distinct(), name)
    return edges.select(F.unhex("hi").alias("id"), F.unhex("lo").alias("root")).unionByName(
        edges.select(F.unhex("lo").alias("id"), F.unhex("lo").alias("root")).distinct()
    )


class Join:
    """One join: parameters and the functions that run inside tasks."""

    def __init__(self, width: int, threshold: float, recall: float, small: int, chunk: int, depth: int) -> None:
        self.width, self.threshold, self.small, self.chunk, self.depth = width, threshold, small, chunk, depth
        self.runs = runs_for(depth, recall)
        self.shingler = Shingler(width)

    def with_set(self, docs: DataFrame, text_col: str) -> DataFrame:
        """``docs`` with ``_set``, the digest of each text's shingles."""
        shingler = self.shingler

        @F.pandas_udf("binary")
        def digests(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: digest(shingler.shingles(t if isinstance(t, str) else None)))

        return docs.withColumn("_set", digests.asNondeterministic()(F.col(text_col)))

    def sets_of(self, docs: DataFrame) -> DataFrame:
        """Per step of a task and distinct set: its documents and first buckets; documents without words have the set null."""
        shingler, runs, threshold = self.shingler, self.runs, self.threshold

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at = 0
                for step in in_steps(batch["text"], STEP_TOKENS):
                    ids = [None if pd.isna(x) else int(x) for x in batch["id"].iloc[at : at + len(step)]]
                    at += len(step)
                    held: dict[bytes | None, tuple[np.ndarray, list]] = {}
                    for doc, text in zip(ids, step, strict=True):
                        tokens = shingler.shingles(text)
                        held.setdefault(digest(tokens), (tokens, []))[1].append(doc)
                    yield pd.DataFrame(
                        {
                            "set": pd.Series(list(held), dtype=object),
                            "ids": pd.Series([x[1] for x in held.values()], dtype=object),
                            "buckets": pd.Series(first_buckets([x[0] for x in held.values()], runs, threshold), dtype=object),
                        }
                    )

        return docs.mapInPandas(run, "set binary, ids array<long>, buckets array<long>")

    def texts_of_sets(self, docs: DataFrame, text_col: str) -> DataFrame:
        """(set, words) of the distinct sets of each task: what a comparison needs, as text."""
        shingler = self.shingler

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[bytes] = set()
            for batch in batches:
                keys, texts = [], []
                for text in batch["text"]:
                    key = digest(shingler.shingles(text))
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        texts.append(text)
                yield pd.DataFrame({"set": pd.Series(keys, dtype=object), "text": pd.Series(texts, dtype=object)})

        return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "set binary, text string")

    def split_on(self, large: DataFrame, texts: DataFrame) -> DataFrame:
        """(set, bucket) one level down for the members of large buckets."""
        shingler, threshold = self.shingler, self.threshold

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                children = [
                    next_buckets(shingler.shingles(text), np.asarray(buckets, dtype=np.int64), threshold)
                    for text, buckets in zip(batch["text"], batch["buckets"], strict=True)
                ]
                sizes = [len(c) for c in children]
                yield pd.DataFrame(
                    {"set": batch["set"].to_numpy().repeat(sizes), "bucket": np.concatenate([*children, np.zeros(0, np.int64)])}
                )

        own = large.groupBy("set").agg(F.collect_list("bucket").alias("buckets"))
        return own.join(texts, "set").select("text", "set", "buckets").mapInPandas(run, "set binary, bucket long")

    def buckets(self, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Small buckets of all levels as lists of sets, (bucket, set) of what stays large, and the texts of their sets."""
        entries = sets.select("set", F.explode("buckets").alias("bucket"))
        lists, texts = [], None
        for level in range(1, self.depth + 1):
            sizes = materialize(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-sizes")
            shared = materialize(entries.join(sizes, "bucket"), "jaccard-shared")
            if texts is None:
                # Whatever shares a bucket is compared or split on: only those texts are shuffled on.
                texts = materialize(self.texts_of(docs, shared.select("set").distinct()), "jaccard-texts")
            small = shared.where(F.col("n") <= self.small)
            lists.append(small.groupBy("bucket").agg(F.sort_array(F.collect_list("set")).alias("sets")).select("sets"))
            large = shared.where(F.col("n") > self.small).select("bucket", "set")
            if level == self.depth or large.isEmpty():
                break
            entries = materialize(self.split_on(large, texts), "jaccard-entries")
        every = lists[0]
        for other in lists[1:]:
            every = every.unionByName(other)
        return every.distinct(), large, texts

    def texts_of(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        return self.texts_of_sets(docs, "text").join(wanted, "set").groupBy("set").agg(F.first("text").alias("text"))

    def compare_lists(self, rows: DataFrame) -> DataFrame:
        """Links (a, b and their copies) among the sets of each list; rows of a list stand together."""
        shingler, threshold = self.shingler, self.threshold

        def links(group: list[tuple]) -> Iterator[tuple]:
            held = [(key, shingler.shingles(text), copies, cluster) for key, text, copies, cluster in group]
            held.sort(key=lambda x: x[0])
            for i, (a, ta, ca, ka) in enumerate(held):
                for b, tb, cb, kb in held[i + 1 :]:
                    if ka is not None and ka == kb:
                        continue  # compared within their cluster
                    least = least_common(len(ta), len(tb), threshold)
                    if min(len(ta), len(tb)) >= least and common(ta, tb) >= least:
                        yield a, b, ca, cb

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            current, group, found = None, [], []
            for batch in batches:
                for number, key, text, copies, cluster in batch.itertuples(index=False):
                    if number != current:
                        found += links(group)
                        current, group = number, []
                    group.append((key, text, copies, cluster))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b", "copies_a", "copies_b"])
                    found = []
            found += links(group)
            yield pd.DataFrame(found, columns=["a", "b", "copies_a", "copies_b"])

        placed = rows.repartition("list").sortWithinPartitions("list")
        return placed.select("list", "set", "text", "copies", "cluster").mapInPandas(
            run, "a binary, b binary, copies_a long, copies_b long"
        )

    def compare_chunks(self, rows: DataFrame) -> DataFrame:
        """(set, links, root) from each pair of chunks of a cluster: links within it, and the smallest set reached."""
        shingler, threshold = self.shingler, self.threshold

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            low, high = int(frame["low"].iloc[0]), int(frame["high"].iloc[0])
            frame = frame.sort_values("set", ignore_index=True)
            tokens = [shingler.shingles(t) for t in frame["text"]]
            left = np.flatnonzero(frame["own"] == low)
            right = left if low == high else np.flatnonzero(frame["own"] == high)
            sizes = np.array([len(t) for t in tokens])
            counts = common_counts([tokens[i] for i in left], [tokens[i] for i in right])
            linked = counts >= least_common(sizes[left][:, None], sizes[right][None, :], threshold)
            linked &= left[:, None] != right[None, :]
            copies = frame["copies"].to_numpy(np.int64)
            n = np.zeros(len(frame), dtype=np.int64)
            n[left] += linked @ copies[right]
            if low != high:
                n[right] += linked.T @ copies[left]
            root = np.arange(len(frame))
            while True:
                before = root.copy()
                root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], len(root)).min(axis=1, initial=len(root)))
                root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], len(root)).min(axis=0, initial=len(root)))
                if (root == before).all():
                    break
            kept = np.flatnonzero(n)
            return pd.DataFrame(
                {"set": frame["set"].to_numpy()[kept], "links": n[kept], "root": frame["set"].to_numpy()[root[kept]]}
            )

        return rows.groupBy("cluster", "low", "high").applyInPandas(run, "set binary, links long, root binary")

    def run(self, docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
        """Sets (set, copies, root, class_id, class_docs, n_links, rep_set), and (set, ids) of all documents."""
        source = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
        found = materialize(self.sets_of(source), "jaccard-found")
        # Copies of a set pick the same tokens, so any row's buckets serve.
        sets = found.where("set IS NOT NULL").groupBy("set").agg(
            F.sum(F.size("ids")).alias("copies"), F.min(F.array_min("ids")).alias("first_id"), F.first("buckets").alias("buckets")
        )
        sets = materialize(sets, "jaccard-sets")
        lists, large, texts = self.buckets(sets, source)
        lists = materialize(lists.select("sets", F.xxhash64("sets").alias("list")), "jaccard-lists")
        texts = texts.join(sets.select("set", "copies"), "set")
        firsts = large.groupBy("bucket").agg(F.min("set").alias("first"))
        stars = large.join(firsts, "bucket").select(F.col("first").alias("a"), F.col("set").alias("b"))
        clusters = materialize(components(stars, "jaccard-clusters"), "jaccard-clusters").select(
            F.col("id").alias("set"), F.col("root").alias("cluster")
        )
        lengths = texts.select("set", F.octet_length("text").alias("bytes"))
        sizes = clusters.join(lengths, "set").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        # Every text goes out once for each chunk of its cluster, so chunks are as large as a task may hold two of.
        chunks = F.greatest(F.ceil(F.col("n") / self.chunk), F.ceil(F.col("bytes") / CHUNK_BYTES), F.lit(1))
        chunked = clusters.join(sizes, "cluster").select("set", "cluster", chunks.cast("int").alias("chunks"))
        chunked = chunked.withColumn("own", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
        members = lists.select("list", F.explode("sets").alias("set")).join(clusters, "set", "left")
        pairs = self.compare_lists(members.join(texts, "set").select("list", "set", "text", "copies", "cluster"))
        pairs = materialize(pairs.distinct(), "jaccard-pairs")
        others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        dealt = chunked.select("*", others.alias("other")).select(
            "set", "cluster", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
        )
        stars = materialize(self.compare_chunks(dealt.join(texts, "set")), "jaccard-stars")

        links = (
            pairs.select(F.col("a").alias("set"), F.col("copies_b").alias("links"))
            .unionByName(pairs.select(F.col("b").alias("set"), F.col("copies_a").alias("links")))
            .unionByName(stars.select("set", "links"))
            .groupBy("set")
            .agg(F.sum("links").alias("links"))
        )
        edges = pairs.select("a", "b").unionByName(stars.select(F.col("root").alias("a"), F.col("set").alias("b")))
        roots = components(edges, "jaccard-classes").withColumnRenamed("id", "set")
        joined = (
            sets.select("set", "copies", "first_id")
            .join(links, "set", "left")
            .join(roots, "set", "left")
            .withColumn("root", F.coalesce("root", "set"))
        )
        joined = materialize(joined, "jaccard-joined")
        first = F.min(F.struct(F.col("first_id").isNull(), "first_id", "set"))
        classes = joined.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_docs"))
        out = joined.join(classes, "root").select(
            "set", "copies", "root", F.col("first.first_id").alias("class_id"), F.col("first.set").alias("rep_set"), "class_docs",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
        return materialize(out, "jaccard-result"), found.select("set", "ids")


def near_duplicates(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
    small: int = SMALL,
    chunk: int = CHUNK,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: id, class_id, n_links, class_docs, and the hex digests ``set`` and ``root`` (null without words).

    Documents of a set stand together in few rows when the classes are joined, so many copies are no large key.
    """
    sets, found = Join(width, threshold, recall, small, chunk, depth).run(docs, text_col, id_col)
    named = found.select(F.col("set").alias("_own"), "ids")
    joined = named.join(sets, F.col("_own") == F.col("set"), "left")
    return joined.select(F.explode("ids").alias("id"), "set", "root", "class_id", "n_links", "class_docs").select(
        "id",
        F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("class_docs", F.lit(1)).alias("class_docs"),
        F.hex("set").alias("set"),
        F.hex("root").alias("root"),
    )


def one_of_each(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = WIDTH,
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
    small: int = SMALL,
    chunk: int = CHUNK,
    depth: int = DEPTH,
) -> DataFrame:
    """One document of each class, the one with the smallest id, and all documents without words.

    Documents meet the list of those that stay by set and id: many copies of a text spread by their ids.
    """
    join = Join(width, threshold, recall, small, chunk, depth)
    sets, _ = join.run(docs, text_col, id_col)
    stay = sets.where(F.col("set") == F.col("rep_set")).select(
        F.hex("set").alias("_stay"), F.coalesce(F.col("class_id").cast("string"), F.lit("null")).alias("_stay_id")
    )
    aside = Aside(docs)
    rows = join.with_set(aside.rows, aside[text_col])
    # A document without words has a key of its own, which nothing else has.
    own = F.concat(F.lit("row/"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_own", F.coalesce(F.hex("_set"), own)).withColumn(
        "_own_id", F.coalesce(F.col(aside[id_col]).cast("long").cast("string"), F.lit("null"))
    )
    same = (F.col("_own") == F.col("_stay")) & (F.col("_own_id") == F.col("_stay_id"))
    kept = rows.join(stay, same, "left").where(F.col("_set").isNull() | F.col("_stay").isNotNull())
    # Rows that repeat an id and a text are copies as well.
    return kept.dropDuplicates(["_own", "_own_id"]).select(*aside.back())


def op4(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "class_docs")
