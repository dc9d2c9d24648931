"""Merkle manifest of a table: a tree of SHA-256 nodes whose parents keep the hash state before each child slot.

A node's input is the hex text of its children, 64 bytes each, which is one SHA-256 block. So the state of a parent before
slot k is the state after k blocks: eight words that a table can hold. ``build`` writes the parents level by level with
their children and these states. Folding a changed child resumes its parent's state with the replacement and the siblings
to its right only; nothing left of it is hashed again.

Every tree is cut into blocks of at most ``FANOUT ** LEVELS`` nodes, which climb ``LEVELS`` levels in one group; the tops of
the blocks are the nodes of the next round. On the way down each block is met by its own parents and by the path above it,
so no group grows with the table, whatever the size of a source. Positions come from range-wise running counts.

Defined results: a null field is ``-``; rows of a null source are a tree of their own, which comes first. Null ids come first in a
source; rows with the same id go by their leaf, and equal rows stand side by side. An empty text is hashed as ``0:``. A source with
one row has its leaf as subroot; a single source's subroot is the root, and an empty proof is the hash of nothing. A null id
has the checksum 0, so its row counts as tampered. An empty table gives no rows; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdprism.llm.common import crc_bucket
from cmdprism.plans.prefix import rank_in_order
from cmdprism.sources.tables import materialize

FANOUT = 3
#: Levels that a block of nodes climbs in one group.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<slot: int, siblings: array<string>, state: binary>>"
PARENT = "tree string, block long, level int, pos long, n long, digest string, children array<string>, states array<binary>"

# ---- SHA-256 of many nodes at once ---------------------------------------------------------


def root_bits(number: int, power: int) -> int:
    """The first 32 bits behind the point of a root."""
    scaled = number << (32 * power)
    low, high = 0, 1 << 40
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, math.isqrt(p) + 1))]
START = np.array([root_bits(p, 2) for p in PRIMES[:8]], np.uint32)
ROUND = [np.uint32(root_bits(p, 3)) for p in PRIMES[:64]]
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint32(bits)) | (x << np.uint32(32 - bits))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one block (n, 16) of big-endian words each."""
    w = list(np.ascontiguousarray(block.T))
    for i in range(16, 64):
        near, far = w[i - 2], w[i - 15]
        s0 = turn(far, 7) ^ turn(far, 18) ^ (far >> np.uint32(3))
        s1 = turn(near, 17) ^ turn(near, 19) ^ (near >> np.uint32(10))
        w.append(w[i - 16] + s0 + w[i - 7] + s1)
    first = np.ascontiguousarray(state.T)
    a, b, c, d, e, f, g, h = first
    for i in range(64):
        one = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return (first + np.stack([a, b, c, d, e, f, g, h])).T


def words(hexes: np.ndarray) -> np.ndarray:
    """Digests as hex text (n, 64) in words (n, 16): one block."""
    return np.ascontiguousarray(hexes).view(">u4").astype(np.uint32)


def finish(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Hex digests (n, 64) of nodes whose children are all taken in: the last block holds the length only."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 15] = 0x80000000, children * 512
    octets = np.ascontiguousarray(compress(state, last)).astype(">u4").view(np.uint8).reshape(len(state), 32)
    return np.stack([HEX[octets >> 4], HEX[octets & 15]], axis=2).reshape(len(state), 64)


def hex_rows(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)


def hex_texts(rows: np.ndarray) -> list[str]:
    text = rows.tobytes().decode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def resume(state: np.ndarray, replacement: np.ndarray, right: np.ndarray, n_right: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Parents' digests from the state before a slot, its replacement and the siblings to the right (n, FANOUT - 1, 64)."""
    state = compress(state, words(replacement))
    for k in range(right.shape[1]):
        more = np.flatnonzero(n_right > k)
        if len(more):
            state[more] = compress(state[more], words(right[more, k]))
    return finish(state, children)


# ---- going up: parents with their states ------------------------------------------------------


def climb(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level: per parent its digest, its children (n, FANOUT, 64), their number, and the state before each slot."""
    n = -(-len(digests) // FANOUT)
    children = np.zeros((n * FANOUT, 64), np.uint8)
    children[: len(digests)] = digests
    children = children.reshape(n, FANOUT, 64)
    count = np.full(n, FANOUT)
    count[-1] = len(digests) - FANOUT * (n - 1)
    state = np.repeat(START[None, :], n, axis=0)
    before = []
    for slot in range(FANOUT):
        before.append(state.copy())
        filled = np.flatnonzero(count > slot)
        state[filled] = compress(state[filled], words(children[filled, slot]))
    return finish(state, count), children, count, np.stack(before, axis=1)


def block_parents(levels: int, base: int):
    """For the nodes of one block: all parents above them, up to ``levels`` levels or the tree's own top."""

    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        tree, block, n = nodes["tree"].iloc[0], int(nodes["block"].iloc[0]), int(nodes["n"].iloc[0])
        first, digests, out = int(nodes["pos"].iloc[0]), hex_rows(nodes["digest"].tolist()), []
        for level in range(1, levels + 1):
            if n == 1:
                break
            n, first = -(-n // FANOUT), first // FANOUT
            digests, children, count, before = climb(digests)
            texts, states = hex_texts(children.reshape(-1, 64)), before.astype(">u4")
            out.append(
                pd.DataFrame(
                    {
                        "tree": tree, "block": block, "level": base + level, "pos": first + np.arange(len(digests)), "n": n,
                        "digest": hex_texts(digests),
                        "children": [texts[FANOUT * i : FANOUT * i + c] for i, c in enumerate(count)],
                        "states": [[states[i, s].tobytes() for s in range(c)] for i, c in enumerate(count)],
                    }
                )
            )
        return pd.concat(out)

    return run


def build(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Trees over ``nodes`` (tree, pos from 0, n nodes of the tree, digest): per round its nodes and parents, and the roots (tree, digest).

    ``nodes`` should be a written table. A round holds the parents of ``levels`` levels, in blocks.
    """
    rounds, parents, roots = [], [], [nodes.where("n = 1").select("tree", "digest")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    base = 0
    while most > 1:
        placed = nodes.where("n > 1").withColumn("block", F.expr(f"pos div {FANOUT**levels}"))
        up = placed.select("tree", "block", "pos", "n", "digest").groupBy("tree", "block")
        made = materialize(up.applyInPandas(block_parents(levels, base), PARENT), "merkle-parents")
        rounds.append(placed)
        parents.append(made)
        roots.append(made.where("n = 1").select("tree", "digest"))
        base += levels
        nodes = made.where((F.col("level") == base) & (F.col("n") > 1)).select("tree", "pos", "n", "digest")
        most = -(-most // FANOUT**levels)
    return rounds, parents, reduce(DataFrame.unionByName, roots)


# ---- going down: paths, proofs and folding -----------------------------------------------------


class Block:
    """The parents above one block's nodes, level by level, and the path above the block's top."""

    def __init__(self, records: pd.DataFrame) -> None:
        top = records[records["children"].isna()]
        self.crown = [] if top.empty else list(top["path"].iloc[0])
        self.subroot = None if top.empty else top["subroot"].iloc[0]
        self.levels = []
        for _, level in records[records["children"].notna()].groupby("level"):
            level = level.sort_values("pos")
            self.levels.append((int(level["pos"].iloc[0]), [list(c) for c in level["children"]], [list(s) for s in level["states"]]))

    def steps(self, pos: np.ndarray):
        """Per level: slot, all siblings and state before the slot for the node at each position."""
        for first, children, states in self.levels:
            slots, pos = pos % FANOUT, pos // FANOUT
            at = (pos - first).tolist()
            yield (
                slots,
                [children[i][:s] + children[i][s + 1 :] for i, s in zip(at, slots.tolist(), strict=True)],
                [states[i][s] for i, s in zip(at, slots.tolist(), strict=True)],
            )
        for step in self.crown:
            n = len(pos)
            yield np.full(n, step["slot"]), [list(step["siblings"])] * n, [step["state"]] * n


def words_of(states: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(states), ">u4").reshape(-1, 8).astype(np.uint32)


def fold(replacement: np.ndarray, steps: list) -> np.ndarray:
    """Root digests that the replaced leaves lead to."""
    for slots, siblings, states in steps:
        n_right = np.array([len(s) for s in siblings]) - slots
        right = np.zeros((len(slots), FANOUT - 1, 64), np.uint8)
        for k in range(FANOUT - 1):
            has = np.flatnonzero(n_right > k)
            if len(has):
                right[has, k] = hex_rows([siblings[i][slots[i] + k] for i in has.tolist()])
        replacement = resume(words_of(states), replacement, right, n_right, slots + n_right + 1)
    return replacement


def node_paths(key: tuple, nodes: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Path of every node of a block to the root: per level its slot, its siblings and the parent's state before the slot."""
    block = Block(records)
    paths: list[list] = [[] for _ in range(len(nodes))]
    for slots, siblings, states in block.steps(nodes["pos"].to_numpy(np.int64)):
        for path, slot, others, state in zip(paths, slots.tolist(), siblings, states, strict=True):
            path.append({"slot": slot, "siblings": others, "state": state})
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": paths, "subroot": block.subroot})


def folded_leaves(key: tuple, nodes: pd.DataFrame, records: pd.DataFrame) -> pd.DataFrame:
    """Proof digest and folded root of every leaf of a block."""
    if nodes.empty:
        return pd.DataFrame({"doc_id": [], "leaf": [], "subroot": [], "proof_sha256": [], "folded_root": []})
    block = Block(records)
    steps = list(block.steps(nodes["pos"].to_numpy(np.int64)))
    proofs = [hashlib.sha256() for _ in range(len(nodes))]
    for _, siblings, _ in steps:
        for proof, others in zip(proofs, siblings, strict=True):
            proof.update("".join(others).encode())
    return pd.DataFrame(
        {
            "doc_id": nodes["doc_id"], "leaf": nodes["digest"], "subroot": block.subroot,
            "proof_sha256": [p.hexdigest() for p in proofs],
            "folded_root": hex_texts(fold(hex_rows(nodes["changed"].tolist()), steps)),
        }
    )


def met(nodes: DataFrame, parents: DataFrame, above: DataFrame, apply, schema: str) -> DataFrame:
    """Every block of nodes with its parents and the path above its top, ``above`` being (tree, block, path, subroot)."""
    records = parents.select(
        "tree", "block", "level", "pos", "children", "states", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")
    ).unionByName(above.select("tree", "block", "path", "subroot"), allowMissingColumns=True)
    return nodes.groupBy("tree", "block").cogroup(records.groupBy("tree", "block")).applyInPandas(apply, schema)


def paths_above(rounds: list[DataFrame], parents: list[DataFrame], crowns: DataFrame, levels: int) -> list[DataFrame]:
    """Per round the path above each of its blocks: (tree, block, path, subroot).

    ``crowns`` (tree, n, path, subroot) continues each tree beyond its root. A tree ends in the round where one block is left.
    """
    span, out = FANOUT**levels, []
    below = None
    for k in range(len(rounds) - 1, -1, -1):
        # Nodes of this round that the tree still has: its blocks number one where the tree ends.
        left = F.ceil(F.col("n") / float(span**k))
        ending = (left <= span) if k == 0 else (left > 1) & (left <= span)
        above = crowns.where(ending).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
        if below is not None:
            above = above.unionByName(below.withColumnRenamed("pos", "block"))
        out.insert(0, above)
        if k:
            below = materialize(
                met(rounds[k], parents[k], above, node_paths, f"tree string, pos long, path {PATH}, subroot string"), "merkle-paths"
            )
    return out


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    fields = [field(F.col(name)) for name in FIELDS[:-1]]
    return F.sha2(F.concat(*fields, field(text)).cast("binary"), 256)


def ranked(nodes: DataFrame, by: list[str], order: list) -> DataFrame:
    """``pos`` from 0 and ``n`` within ``by``; equal rows get places of their own."""
    numbered = nodes.withColumn("_copy", F.monotonically_increasing_id())
    return rank_in_order(numbered, by, [*order, "_copy"], "pos", "n").drop("_copy")


def manifest(docs: DataFrame, changed_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof digest and the root that each document with ``changed_text`` folds to."""
    original = F.col("text")
    leaves = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tree"), "doc_id", leaf_digest(original).alias("digest"),
        leaf_digest(original if changed_text is None else changed_text).alias("changed"),
    )
    nodes = materialize(ranked(leaves, ["tree"], [F.asc_nulls_first("doc_id"), "digest"]), "merkle-leaves")
    rounds, parents, subroots = build(nodes, levels)
    # The sources are the leaves of one more tree.
    sizes = nodes.where("pos = 0").select("tree", "n")
    tops = ranked(subroots.select(F.col("tree").alias("source_key"), "digest", F.lit("").alias("tree")), ["tree"], ["source_key"])
    tops = materialize(tops, "merkle-subroots")
    top_rounds, top_parents, top_roots = build(tops, levels)
    root = (top_roots.first() or ["", None])[1]
    empty = F.array().cast(PATH)
    one = F.lit(0).cast("long").alias("block")
    if top_rounds:
        last = tops.agg(F.max("n").alias("n")).select(F.lit("").alias("tree"), "n", empty.alias("path"), F.lit("").alias("subroot"))
        found = met(
            tops.withColumn("block", F.expr(f"pos div {FANOUT**levels}")), top_parents[0],
            paths_above(top_rounds, top_parents, last, levels)[0], node_paths, f"tree string, pos long, path {PATH}, subroot string",
        )
        crowns = tops.join(found.select("pos", "path"), "pos")
    else:
        crowns = tops.withColumn("path", empty)
    crowns = crowns.select(F.col("source_key").alias("tree"), "path", F.col("digest").alias("subroot"))
    crowns = materialize(crowns.join(sizes, "tree"), "merkle-crowns")
    if rounds:
        above = paths_above(rounds, parents, crowns, levels)[0]
        parents_of_leaves = parents[0]
    else:
        above = crowns.select("tree", one, "path", "subroot")
        parents_of_leaves = nodes.sparkSession.createDataFrame([], PARENT)
    placed = nodes.withColumn("block", F.expr(f"pos div {FANOUT**levels}"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, proof_sha256 string, folded_root string"
    folded = met(placed, parents_of_leaves, above, folded_leaves, schema)
    return folded.withColumn("root", F.lit(root).cast("string"))


def op12(docs: DataFrame) -> DataFrame:
    """Texts of rows with an even checksum lose their line breaks before their leaves are folded."""
    tampered = F.when(crc_bucket("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = manifest(docs, tampered)
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _sql_field(name: str) -> str:
    return f"coalesce(concat(strlen(CAST({name} AS VARCHAR)), ':', CAST({name} AS VARCHAR)), '-')"


_SQL_HEAD = " || ".join(_sql_field(name) for name in FIELDS[:-1])
# The last bit of the checksum: the running remainder starts with ones and is inverted at the end.
_SQL_EVEN = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) & 1 = 1"""
OP12_SQL = f"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_SQL_HEAD} AS head, text, {_SQL_EVEN} AS even FROM documents),
leaves AS (SELECT r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, sha256(head || {_sql_field('text')}) AS leaf,
  sha256(head || {_sql_field("(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)")}) AS changed FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM leaves),
nodes AS (
  SELECT src, 0 AS lvl, pos, leaf AS digest FROM placed
  UNION ALL
  SELECT src, lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM nodes) WHERE n > 1 GROUP BY src, lvl, pos // 3),
tops AS (SELECT src, max_by(digest, lvl) AS subroot FROM nodes GROUP BY src),
upper AS (
  SELECT 0 AS lvl, src AS pos, subroot AS digest FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM upper) WHERE n > 1 GROUP BY lvl, pos // 3),
top AS (SELECT max_by(digest, lvl) AS root, max(lvl) AS height FROM upper),
heights AS (SELECT src, max(lvl) AS height FROM nodes GROUP BY src),
climbing AS (
  SELECT r, src, 0 AS lvl, pos, changed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.r, f.src, f.lvl + 1, any_value(f.pos // 3),
    sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.h ELSE n.digest END, '' ORDER BY n.pos)),
    any_value(f.proof) || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '')
  FROM climbing f JOIN heights USING (src) JOIN nodes n ON n.src = f.src AND n.lvl = f.lvl AND n.pos // 3 = f.pos // 3
  WHERE f.lvl < height GROUP BY f.r, f.src, f.lvl),
crossing AS (
  SELECT r, 0 AS lvl, src AS pos, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM climbing GROUP BY r, src
  UNION ALL
  SELECT f.r, f.lvl + 1, any_value(f.pos // 3),
    sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.h ELSE n.digest END, '' ORDER BY n.pos)),
    any_value(f.proof) || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '')
  FROM crossing f JOIN top ON f.lvl < height JOIN upper n ON n.lvl = f.lvl AND n.pos // 3 = f.pos // 3 GROUP BY f.r, f.lvl),
folded AS (SELECT r, max_by(h, lvl) AS folded_root, sha256(max_by(proof, lvl)) AS proof_sha256 FROM crossing GROUP BY r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN tops USING (src) JOIN folded USING (r), top"""
