"""Leakage-safe splits: whole groups, stratified by their majority label."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdprism.functions.numbers import ratio
from cmdprism.functions.text import group_digest
from cmdprism.plans.prefix import digest_key, rank_in_order
from cmdprism.plans.skew import attach_group_values
from cmdprism.session import GROUP_KEY, LABEL, ROW_ID
from cmdprism.sources.tables import materialize

SPLITS = ("train", "val", "test")
# Default ratios of the three splits.
RATIOS = (0.62, 0.14, 0.24)


def group_label_stats(df: DataFrame, group: str = GROUP_KEY, label: str = LABEL) -> DataFrame:
    """Size, malicious ratio and majority label per group."""
    stats = df.groupBy(group).agg(F.count(label).alias("size"), F.sum(label).cast("bigint").alias("positives"))
    stats = stats.withColumn("malicious_ratio", ratio(F.col("positives").cast("double"), F.col("size")))
    return stats.withColumn("strat_label", (F.col("malicious_ratio") >= 0.5).cast("int"))


def digest_groups(
    df: DataFrame, ratios: tuple[float, float, float] = RATIOS, seed: int = 13,
    group: str = GROUP_KEY, label: str = LABEL,
) -> DataFrame:
    """Assign every group (by its digest; the key's text is not shuffled) to a split by its rank within its stratum.

    Two stages, each rounded per stratum: train against the rest, then validation against test.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    train, val, test = ratios
    stats = group_label_stats(df.select(group_digest(F.col(group), seed).alias("digest"), label), "digest", label)
    ranked = rank_in_order(stats, ["strat_label"], [F.col("digest")], key=digest_key(F.col("digest")))
    first = F.round(F.col("_n") * F.lit(train))
    second = first + F.round((F.col("_n") - first) * F.lit(val / (val + test)))
    split = F.when(F.col("_rank") < first, "train").when(F.col("_rank") < second, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank", "_n")


def split_groups(
    df: DataFrame, ratios: tuple[float, float, float] = RATIOS, seed: int = 13,
    group: str = GROUP_KEY, label: str = LABEL,
) -> DataFrame:
    """:func:`digest_groups` with the key of every group."""
    keys = df.select(group_digest(F.col(group), seed).alias("digest"), group).groupBy("digest").agg(F.min(group).alias(group))
    return digest_groups(df, ratios, seed, group, label).join(keys, "digest")


def with_split(df: DataFrame, groups: DataFrame, seed: int = 13, group: str = GROUP_KEY, row_id: str = ROW_ID) -> DataFrame:
    """``df`` with the split of each row's group, all columns kept. ``groups`` should be a written table."""
    rows = df.withColumn("_digest", group_digest(F.col(group), seed))
    sized = groups.select(F.col("digest").alias("_digest"), "size", "split")
    return attach_group_values(rows, sized, "_digest", "size", ["split"], spread_by=row_id).drop("_digest")


def assign_rows(
    df: DataFrame, groups: DataFrame, seed: int = 13, group: str = GROUP_KEY, row_id: str = ROW_ID
) -> DataFrame:
    """``(row_id, group_key, split)`` for every row, joined on the fixed-width digest."""
    return with_split(df.select(row_id, group), groups, seed, group, row_id)


def split_table(
    df: DataFrame, ratios: tuple[float, float, float] = RATIOS, seed: int = 13, targets: dict[str, int] | None = None
) -> DataFrame:
    """The written group table (digest, size, positives, split); with row ``targets`` the groups are rebalanced first."""
    groups = digest_groups(df, ratios, seed).select("digest", "size", "positives", "split")
    if targets is not None:
        groups = rebalance_groups(materialize(groups, "groups"), targets)
    return materialize(groups, "groups")


def stratified_group_split(
    df: DataFrame, ratios: tuple[float, float, float] = RATIOS, seed: int = 13,
    targets: dict[str, int] | None = None,
) -> DataFrame:
    """Row-level split table; with row ``targets`` the groups are rebalanced first."""
    return assign_rows(df, split_table(df, ratios, seed, targets), seed)


def select_split(df: DataFrame, splits: DataFrame, name: str, check: bool = True) -> DataFrame:
    """Rows of one split (left semi join by row id); unknown or empty splits are errors."""
    wanted = splits.where(F.col("split") == name).select(ROW_ID)
    if check and wanted.isEmpty():
        raise ValueError(f"split {name} unknown or empty")
    return df.join(wanted, ROW_ID, "left_semi")


def ids_for(df: DataFrame, groups: DataFrame, seed: int = 13, group: str = GROUP_KEY) -> DataFrame:
    """Row ids of the rows whose group is listed (a group table with digest and size)."""
    listed = materialize(groups.select("digest", "size", F.lit(True).alias("listed")), "listed-groups")
    rows = df.select(ROW_ID, group_digest(F.col(group), seed).alias("digest"))
    found = attach_group_values(rows, listed, "digest", "size", ["listed"], spread_by=ROW_ID)
    return found.where("listed").select(ROW_ID)


def plan_moves(
    histogram: dict[tuple[str, int], int], targets: dict[str, int], max_moves: int | None = None
) -> dict[tuple[str, int], dict[str, int]]:
    """How many groups of each (split, size) end up in which split.

    Repeats one step on the size histogram: the smallest group of the split most above its target goes to the
    split most below. Ends when no split is above, or none below, its target, or after ``max_moves`` groups; without that
    limit also when a state comes back. Runs of equal steps are taken in one go, exactly as if made one by one.
    """
    cells = {s: defaultdict(lambda: defaultdict(int)) for s in SPLITS}
    excess = {s: -targets.get(s, 0) for s in SPLITS}
    for (split, size), n in histogram.items():
        cells[split][size][split] += n
        excess[split] += size * n
    moved, seen = 0, set()

    def front(split: str) -> tuple[int, str, int]:
        """Size, origin and number of the groups that the split gives next."""
        size = min(cells[split])
        origins = cells[split][size]
        origin = split if origins.get(split) else next(iter(origins))
        return size, origin, origins[origin]

    def give(over: str, under: str, size: int, origin: str, n: int) -> None:
        cells[over][size][origin] -= n
        if not cells[over][size][origin]:
            del cells[over][size][origin]
        if not cells[over][size]:
            del cells[over][size]
        cells[under][size][origin] += n
        excess[over] -= size * n
        excess[under] += size * n

    while max_moves is None or moved < max_moves:
        over = max(SPLITS, key=lambda s: excess[s])
        under = max(SPLITS, key=lambda s: -excess[s])
        if excess[over] <= 0 or excess[under] >= 0 or not cells[over]:
            break
        state = tuple(excess[s] for s in SPLITS)
        if max_moves is None and state in seen:
            break
        seen.add(state)
        left = None if max_moves is None else max_moves - moved
        third = next(s for s in SPLITS if s not in (over, under))
        runs = []
        if excess[third] > 0 and cells[third]:
            runs = falling_run({s: (excess[s], *front(s)) for s in (over, third)}, -excess[under], left)
        elif excess[third] < 0:
            runs = rising_run({s: excess[s] for s in (under, third)}, front(over), excess[over], left)
        if runs:
            for giver, taker, n in runs:
                size, origin, _ = front(over if giver is None else giver)
                give(over if giver is None else giver, under if taker is None else taker, size, origin, n)
                moved += n
            continue
        size, origin, available = front(over)
        # Alone at the end of its side: the same pair stays furthest off until one of the gaps is smaller than a group.
        gaps = [excess[over], -excess[under]]
        gaps += [excess[over] - excess[third]] if excess[third] > 0 else []
        gaps += [excess[third] - excess[under]] if excess[third] < 0 else []
        n = max(1, min(min(gaps) // max(size, 1), available, *([left] if left is not None else [])))
        give(over, under, size, origin, n)
        moved += n
    result: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
    for now, sizes in cells.items():
        for size, origins in sizes.items():
            for origin, n in origins.items():
                result[(origin, size)][now] = n
    return {cell: ends for cell, ends in result.items() if set(ends) != {cell[0]}}


def lowest(low: int, high: int, fits) -> int | None:
    """The smallest number in [low, high] that fits, if all above it fit as well; None if not even ``high`` does."""
    if low > high or not fits(high):
        return None
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return high


def falling_run(
    givers: dict[str, tuple[int, int, str, int]], room: int, left: int | None
) -> list[tuple[str | None, str | None, int]]:
    """Moves of two splits above their targets to the one below, down to a common level.

    The larger one always gives, so the moves made from above a level are, whatever their order, those of each split until it
    reaches the level. The lowest level is taken that both can reach with the groups at hand and that leaves room below.
    """
    floor = max(size for _, size, _, _ in givers.values())
    counts = lambda level: {s: max(0, -(-(e - level) // size)) for s, (e, size, _, _) in givers.items()}

    def fits(level: int) -> bool:
        n = counts(level)
        total = sum(n[s] * givers[s][1] for s in n)
        return all(n[s] <= givers[s][3] for s in n) and total <= room and (left is None or sum(n.values()) <= left)

    level = lowest(floor, max(e for e, *_ in givers.values()), fits)
    if level is None:
        return []
    return [(s, None, n) for s, n in counts(level).items() if n]


def rising_run(
    takers: dict[str, int], front: tuple[int, str, int], supply: int, left: int | None
) -> list[tuple[str | None, str | None, int]]:
    """Moves of one split above its target to the two below, up to a common level: the mirror of :func:`falling_run`."""
    size, _, available = front
    counts = lambda level: {s: max(0, -(-(-level - e) // size)) for s, e in takers.items()}

    def fits(level: int) -> bool:
        n = sum(counts(level).values())
        return n <= available and n * size <= supply and (left is None or n <= left)

    level = lowest(size, max(-e for e in takers.values()), fits)
    if level is None:
        return []
    return [(None, s, n) for s, n in counts(level).items() if n]


def rebalance_groups(groups: DataFrame, targets: dict[str, int], max_moves: int | None = None) -> DataFrame:
    """Move small groups from splits above their row target to splits below it.

    Only the histogram (one row per split and group size) reaches the driver; which groups
    of a size move is decided on the cluster by digest rank.
    """
    histogram = {
        (r["split"], r["size"]): r["n"]
        for r in groups.groupBy("split", "size").agg(F.count("*").alias("n")).collect()
    }
    moves = plan_moves(histogram, targets, max_moves)
    if not moves:
        return groups
    cells = []
    for (split, size), ends in moves.items():
        begin = 0
        partial = sum(ends.values()) < histogram[(split, size)] or len(ends) > 1
        for end in SPLITS:
            if end != split and ends.get(end):
                cells.append((split, size, partial, begin, begin + ends[end], end))
                begin += ends[end]
    schema = "split STRING, size BIGINT, _partial BOOLEAN, _from BIGINT, _to BIGINT, _end STRING"
    plan = groups.sparkSession.createDataFrame(cells, schema)
    per_cell = plan.groupBy("split", "size", "_partial").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_to", "_end"))).alias("_ends")
    )
    joined = groups.join(per_cell, ["split", "size"], "left")
    # Each split gives up its sizes in ascending order, so only a handful of cells move in part.
    partial = F.coalesce("_partial", F.lit(False))
    ranked = rank_in_order(joined.where(partial), ["split", "size"], [F.col("digest")], key=digest_key(F.col("digest"))).drop("_n")
    every = ranked.unionByName(joined.where(~partial).withColumn("_rank", F.lit(0).cast("bigint")))
    end = F.filter("_ends", lambda e: (F.col("_rank") >= e["_from"]) & (F.col("_rank") < e["_to"]))
    moved = F.try_element_at(end, F.lit(1))["_end"]
    return every.withColumn("split", F.coalesce(moved, F.col("split"))).drop("_rank", "_ends", "_partial")


def split_report(groups: DataFrame) -> DataFrame:
    """Rows, labels and groups per split from the group table; splits without rows show zeros."""
    per_split = groups.groupBy("split").agg(
        F.sum("size").alias("_rows"), F.sum("positives").alias("_pos"), F.count("*").alias("_groups")
    )
    names = groups.sparkSession.createDataFrame([(s,) for s in SPLITS], "split STRING")
    joined = names.join(per_split, "split", "left").fillna(0)
    return joined.select(
        "split",
        F.col("_rows").alias("n_rows"),
        F.col("_pos").cast("bigint").alias("malicious"),
        (F.col("_rows") - F.col("_pos")).cast("bigint").alias("benign"),
        ratio(F.col("_pos"), F.col("_rows")).alias("malicious_ratio"),
        F.col("_groups").alias("n_groups"),
    )


def group_table(df: DataFrame, splits: DataFrame, group: str = GROUP_KEY, label: str = LABEL) -> DataFrame:
    """Size, positives and split of every group of a row-level split table."""
    rows = df.select(ROW_ID, label).join(splits.select(ROW_ID, group, "split"), ROW_ID)
    return rows.groupBy("split", group).agg(F.count("*").alias("size"), F.sum(label).alias("positives"))


def leaking_groups(splits: DataFrame, group: str = GROUP_KEY) -> DataFrame:
    """Groups found in more than one split; empty for a sound split table."""
    return splits.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")


def assert_disjoint(df: DataFrame, splits: DataFrame, label: str = LABEL) -> None:
    """Fail if a group is in two splits or a split with rows lacks one of the classes."""
    if not leaking_groups(splits).isEmpty():
        raise ValueError("a group occurs in more than one split")
    report = split_report(group_table(df, splits, label=label))
    names = [r["split"] for r in report.where("n_rows > 0 AND (malicious = 0 OR benign = 0)").collect()]
    if names:
        raise ValueError(f"only one class in {', '.join(sorted(names))}")


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 13, label: str = LABEL, row_id: str = ROW_ID) -> DataFrame:
    """Add ``fold``: digest rank within the label, modulo ``k``."""
    digest = group_digest(F.col(row_id).cast("string"), seed)
    ranked = rank_in_order(df.withColumn("_digest", digest), [label], [F.col("_digest"), F.col(row_id)], key=digest_key(F.col("_digest")))
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n", "_digest")
