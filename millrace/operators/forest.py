"""Isolation forest (Liu, Ting and Zhou, 2008): distributed sampling; a tree grows in one task, large ones by levels first."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.bymodel import apply_models, reused_state
from millrace.operators.vectors import CLASS
from millrace.session import settle

TREES = 300
SAMPLE = 256
# Rows of a range of the hash order, and rows of which a task grows a tree.
RANGE_ROWS = 50_000
TASK_ROWS = 20_000
# Entries of node bounds that a task holds before it passes them on.
HELD_ENTRIES = 4_000_000
# Rows and trees that are walked together; few enough for the processor's cache.
WALKED_ROWS = 512
WALKED_TREES = 8


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n items."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    deep = 2.0 * (np.log(np.maximum(safe - 1.0, 1e-300)) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, deep))


def sampling_plan(rows: DataFrame, key: str = CLASS, trees: int = TREES, sample: int | float | None = None) -> DataFrame:
    """One row per key: rows of a sample, samples in a round, rounds, and the front of the hash order that they need."""
    counted = rows.groupBy(key).agg(F.count("*").alias("_n"))
    if isinstance(sample, float):
        size = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(sample))).cast("long")
    else:
        size = F.least(F.lit(int(sample or SAMPLE)), F.col("_n")).cast("long")
    plan = (
        counted.withColumn("_size", size)
        .withColumn("_per_round", F.least(F.lit(trees), F.floor(F.col("_n") / F.col("_size"))).cast("int"))
        .withColumn("_rounds", F.ceil(F.lit(trees) / F.col("_per_round")).cast("int"))
        .withColumn("_wanted", F.col("_per_round") * F.col("_size"))
        .withColumn("_front", F.least(F.lit(1.0), (F.col("_wanted") + 12.0 * F.sqrt("_wanted") + 60.0) / F.col("_n")))
    )
    # One row per key, written so that its size is known and the rows need not be shuffled by a few keys.
    return settle(plan, "sampling")


def draw_samples(
    rows: DataFrame,
    identity: Sequence[str],
    key: str = CLASS,
    trees: int = TREES,
    sample: int | float | None = None,
    seed: int = 42,
    plan: DataFrame | None = None,
) -> DataFrame:
    """Rows for each (key, tree), without repeats inside a tree.

    A round is one hash order of a key's rows, cut into consecutive samples; as
    many rounds are used as the trees need. For large keys only the front of the
    order is ranked, so ranking touches a bounded number of rows. The front is
    wide enough but for a chance below 1e-12 (Chernoff's bound); its rows are
    counted, and the whole order is ranked if they should be too few. The order
    is cut into ranges of about ``RANGE_ROWS`` rows that are counted first, so
    rows are ranked inside ranges and no task sorts a whole key. A row's place
    depends on its identity alone. Rows without a key are in no sample.
    """
    plan = sampling_plan(rows, key, trees, sample) if plan is None else plan
    placing = F.xxhash64(F.lit(seed), F.col("_round"), *[F.col(c) for c in identity])

    def front_of(table: DataFrame, plan: DataFrame) -> DataFrame:
        spread = table.join(plan, key).withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_rounds") - 1)))
        ranges = F.greatest(F.lit(1.0), F.ceil(F.col("_n") * F.col("_front") / F.lit(RANGE_ROWS)))
        return (
            spread.withColumn("_place", placing)
            .withColumn("_share", F.shiftrightunsigned(F.col("_place"), 11) / F.lit(float(2**53)))
            .filter(F.col("_share") < F.col("_front"))
            .withColumn("_range", F.floor(F.col("_share") / F.col("_front") * ranges).cast("long"))
        )

    def counted(plan: DataFrame) -> DataFrame:
        narrow = front_of(rows.select(*dict.fromkeys([key, *identity])), plan)
        return settle(narrow.groupBy(key, "_round", "_range").agg(F.count("*").alias("_in")), "sample-ranges")

    found = counted(plan)
    full = (
        found.groupBy(key, "_round").agg(F.sum("_in").alias("_got")).join(plan, key)
        .filter(F.col("_got") >= F.col("_wanted")).groupBy(key).agg(F.count("*").alias("_full"))
    )
    short = plan.filter(F.col(key).isNotNull()).join(full, key, "left").filter(F.coalesce("_full", F.lit(0)) < F.col("_rounds"))
    if not short.isEmpty():
        plan = settle(plan.withColumn("_front", F.lit(1.0)), "sampling-whole")
        found = counted(plan)
    earlier = Window.partitionBy(key, "_round").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    order = Window.partitionBy(key, "_round", "_range").orderBy("_share", "_place", *identity)
    ranked = front_of(rows, plan).withColumn("_rank", F.row_number().over(order)).join(found, [key, "_round", "_range"])
    drawn = ranked.withColumn("_slot", F.floor((F.col("_before") + F.col("_rank") - 1) / F.col("_size")).cast("int"))
    return (
        drawn.filter(F.col("_slot") < F.col("_per_round"))
        .withColumn("tree", (F.col("_round") * F.col("_per_round") + F.col("_slot")).cast("int"))
        .filter(F.col("tree") < trees)
        .select(*[F.col(f"`{c}`") for c in rows.columns], "tree", F.col("_size").alias("sample"))
    )


def usable_features(rng: np.random.Generator, width: int, max_features: float) -> np.ndarray:
    return np.sort(rng.permutation(width)[: max(1, int(max_features * width))])


def draw_split(rng: np.random.Generator, low: np.ndarray, high: np.ndarray) -> tuple[int, float] | None:
    """Place and threshold of a random split between bounds; None if nothing varies."""
    varying = np.flatnonzero(high > low)
    if not len(varying):
        return None
    pick = int(varying[rng.integers(len(varying))])
    cut = float(rng.uniform(low[pick], high[pick]))
    return pick, cut if cut < high[pick] else float(low[pick])


def grow_tree(
    x: np.ndarray, rng: np.random.Generator, max_features: float = 1.0, depth: int = 0, limit: int | None = None, usable: np.ndarray | None = None
) -> dict[str, tuple]:
    """Random splits until single rows, constant rows, or the height limit.

    A subtree starts at its ``depth`` in the whole tree, with that tree's limit and features.
    """
    limit = height_limit(len(x)) if limit is None else limit
    usable = usable_features(rng, x.shape[1], max_features) if usable is None else usable
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), depth, -1, 0)]
    while waiting:
        members, depth, parent, side = waiting.pop()
        index = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(members)))])
        if parent >= 0:
            nodes[parent][2 + side] = index
        if depth >= limit or len(members) <= 1:
            continue
        part = x[members][:, usable]
        split = draw_split(rng, part.min(axis=0), part.max(axis=0))
        if split is None:
            continue
        pick, cut = split
        below = part[:, pick] <= cut
        nodes[index][0], nodes[index][1] = int(usable[pick]), cut
        waiting.append((members[~below], depth + 1, index, 1))
        waiting.append((members[below], depth + 1, index, 0))
    feature, threshold, left, right, path = zip(*nodes)
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "path": path}


def height_limit(n: int) -> int:
    return math.ceil(math.log2(max(n, 2)))


NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def fit_forest(
    rows: DataFrame,
    identity: Sequence[str],
    key: str = CLASS,
    trees: int = TREES,
    sample: int | float | None = None,
    max_features: float = 1.0,
    seed: int = 42,
    vector: str = "vector",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """One row per (key, tree) with the tree as parallel node arrays.

    Samples of up to ``task_rows`` rows make one tree in one task. Of larger
    samples, nodes are split level by level on counts and bounds gathered over
    all tasks until they hold no more than that; the subtrees below are then
    grown in one task each. A tree itself is one row of up to two nodes for each
    sampled row, whatever the width of the vectors.
    """
    plan = sampling_plan(rows, key, trees, sample)
    drawn = draw_samples(rows.select(key, *[c for c in identity if c != key], vector), identity, key, trees, sample, seed, plan)
    kind = rows.schema[key].dataType.simpleString()
    if (plan.agg(F.max("_size")).first()[0] or 0) > task_rows:
        return _fit_by_levels(drawn, identity, key, kind, max_features, seed, vector, task_rows)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(identity))
        tree = int(pdf["tree"].iloc[0])
        grown = grow_tree(np.vstack(pdf[vector].to_numpy()), np.random.default_rng([seed, tree]), max_features)
        return pd.DataFrame(
            {key: [pdf[key].iloc[0]], "tree": [tree], "sample": [len(pdf)], **{k: [list(v)] for k, v in grown.items()}}
        )

    return drawn.groupBy(key, "tree").applyInPandas(build, f"`{key}` {kind}, tree int, sample long, {NODES}")


def _route(model: tuple, x: np.ndarray) -> np.ndarray:
    """The node that each row reaches; the children of node p are 2p and 2p + 1, the root is 1."""
    nodes, feature, threshold = model
    at = np.ones(len(x), dtype=np.int64)
    while len(nodes):
        found = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
        inner = np.flatnonzero(nodes[found] == at)
        if not len(inner):
            return at
        split = found[inner]
        at[inner] = 2 * at[inner] + (x[inner, feature[split]] > threshold[split])
    return at


def _splits(pdf: pd.DataFrame) -> tuple:
    row = pdf.iloc[0]
    order = np.argsort(np.asarray(row["nodes"], dtype=np.int64))
    return tuple(np.asarray(row[c], dtype=t)[order] for c, t in (("nodes", np.int64), ("feature", np.int64), ("threshold", float)))


def _bounds(placed: DataFrame, vector: str) -> DataFrame:
    """Rows (unit, tree, sample, node, n, low, high): a node's rows, and the least and largest value of every entry."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        entries = 0

        def spill() -> pd.DataFrame:
            return pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["unit", "tree", "sample", "node", "n", "low", "high"])

        for pdf in batches:
            for k, group in pdf.groupby(["unit", "tree", "sample", "node"], sort=False):
                x = np.vstack(group[vector].to_numpy())
                low, high = x.min(axis=0), x.max(axis=0)
                if k in held:
                    state = held[k]
                    held[k] = [state[0] + len(x), np.minimum(state[1], low), np.maximum(state[2], high)]
                else:
                    held[k] = [len(x), low, high]
                    entries += 2 * len(low)
            if entries > HELD_ENTRIES:
                yield spill()
                held, entries = {}, 0
        yield spill()

    parts = placed.select("unit", "tree", "sample", "node", vector).mapInPandas(
        gather, "unit string, tree int, sample long, node long, n long, low array<double>, high array<double>"
    )
    node = ["unit", "tree", "sample", "node"]
    each = parts.select(*node, "n", F.posexplode(F.arrays_zip("low", "high")).alias("at", "bound"))
    merged = each.groupBy(*node, "at").agg(F.sum("n").alias("n"), F.min("bound.low").alias("low"), F.max("bound.high").alias("high"))
    # One item for each entry of a vector.
    ordered = merged.groupBy(*node).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("b"))
    return ordered.select(*node, "n", F.col("b.low").alias("low"), F.col("b.high").alias("high"))


def _fit_by_levels(drawn: DataFrame, identity: Sequence[str], key: str, kind: str, max_features: float, seed: int, vector: str, task_rows: int) -> DataFrame:
    unit = F.to_json(F.struct(F.col(key), F.col("tree")))
    drawn = settle(drawn.withColumn("unit", unit).withColumn(vector, F.col(vector).cast("array<double>")), "forest-samples")
    units = settle(drawn.groupBy("unit").agg(F.first(key).alias(key), F.first("tree").alias("tree"), F.count("*").alias("sample")), "forest-units")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                depth = int(r.node).bit_length() - 1
                found = None
                if depth < height_limit(int(r.sample)):
                    usable = usable_features(np.random.default_rng([seed, r.tree]), len(r.low), max_features)
                    found = draw_split(np.random.default_rng([seed, r.tree, r.node]), np.asarray(r.low)[usable], np.asarray(r.high)[usable])
                feature, cut = (int(usable[found[0]]), found[1]) if found else (-1, 0.0)
                out.append((r.unit, r.node, feature, cut, depth + float(average_path(r.n))))
            yield pd.DataFrame(out, columns=["unit", "node", "feature", "threshold", "path"])

    def routed(upper: DataFrame | None) -> DataFrame:
        if upper is None:
            return drawn.withColumn("node", F.lit(1).cast("long"))
        splits = upper.filter("feature >= 0").groupBy("unit").agg(*[F.collect_list(c).alias(a) for c, a in (("node", "nodes"), ("feature", "feature"), ("threshold", "threshold"))])
        # Trees that fit a task have no upper part: all their rows are at the root.
        models = units.select("unit").join(splits, "unit", "left")
        models = models.select("unit", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("nodes", "array<bigint>"), ("feature", "array<int>"), ("threshold", "array<double>"))])
        return apply_models(drawn, settle(models, "forest-upper"), "unit", _splits, _route, "node", "long", vector)

    upper, level = None, 0
    while True:
        with reused_state():
            # Rows at this depth are those of the last level's splits.
            placed = routed(upper).filter(F.col("node") >= F.lit(1 << level))
            large = _bounds(placed, vector).filter(F.col("n") > task_rows)
            grown = settle(large.mapInPandas(split, "unit string, node long, feature int, threshold double, path double"), f"forest-level-{level}")
        upper = grown if upper is None else upper.unionByName(grown)
        level += 1
        if grown.filter("feature >= 0").isEmpty():
            break
    upper = settle(upper, "forest-upper-nodes")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(identity))
        first = pdf.iloc[0]
        tree, node = int(first["tree"]), int(first["node"])
        x = np.vstack(pdf[vector].to_numpy())
        usable = usable_features(np.random.default_rng([seed, tree]), x.shape[1], max_features)
        grown = grow_tree(x, np.random.default_rng([seed, tree, node]), max_features, node.bit_length() - 1, height_limit(int(first["sample"])), usable)
        return pd.DataFrame({"unit": [first["unit"]], "node": [node], **{k: [list(v)] for k, v in grown.items()}})

    with reused_state():
        leaves = upper.filter("feature < 0").select("unit", "node")
        below = routed(upper).join(leaves, ["unit", "node"], "left_anti")
        subtrees = settle(below.groupBy("unit", "node").applyInPandas(build, f"unit string, node long, {NODES}"), "forest-subtrees")
    none = F.array(F.lit(-1))
    tops = upper.select("unit", "node", F.array("feature").alias("feature"), F.array("threshold").alias("threshold"), none.alias("left"), none.alias("right"), F.array("path").alias("path"))
    parts = tops.unionByName(subtrees).join(units, "unit")

    def join_up(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes one after another, the root first; upper splits are tied to the parts of their children."""
        pdf = pdf.sort_values("node")
        starts = dict(zip(pdf["node"], np.concatenate(([0], np.cumsum(pdf["feature"].map(len))))[:-1], strict=True))
        out: dict[str, list] = {c: [] for c in ("feature", "threshold", "left", "right", "path")}
        for r in pdf.itertuples(index=False):
            start = starts[r.node]
            for c in ("feature", "threshold", "path"):
                out[c].extend(getattr(r, c))
            if r.feature[0] >= 0 and r.left[0] < 0:
                out["left"].append(starts[2 * r.node])
                out["right"].append(starts[2 * r.node + 1])
            else:
                out["left"].extend(i + start if i >= 0 else -1 for i in r.left)
                out["right"].extend(i + start if i >= 0 else -1 for i in r.right)
        first = pdf.iloc[0]
        return pd.DataFrame({key: [first[key]], "tree": [first["tree"]], "sample": [first["sample"]], **{c: [v] for c, v in out.items()}})

    return parts.groupBy("unit").applyInPandas(join_up, f"`{key}` {kind}, tree int, sample long, {NODES}")


def _by_levels(tree: pd.Series) -> tuple:
    """Nodes of a tree level by level, as (depth, feature, threshold, first child, path).

    The children of a node are neighbours, so a step is the first child plus
    whether the value lies above the threshold. Nothing lies above that of a
    leaf, which is its own child.
    """
    feature, left, right = (np.asarray(tree[c], dtype=np.intp) for c in ("feature", "left", "right"))
    threshold, path = (np.asarray(tree[c], dtype=float) for c in ("threshold", "path"))
    levels = [np.zeros(1, dtype=np.intp)]
    while True:
        inner = levels[-1][feature[levels[-1]] >= 0]
        if not len(inner):
            break
        levels.append(np.stack([left[inner], right[inner]], axis=1).ravel())
    order = np.concatenate(levels)
    place = np.zeros(len(feature), dtype=np.intp)
    place[order] = np.arange(len(order))
    inner = feature[order] >= 0
    child = np.where(inner, place[left[order]], np.arange(len(order)))
    return len(levels) - 1, np.where(inner, feature[order], 0), np.where(inner, threshold[order], np.inf), child, path[order]


def pack_forest(pdf: pd.DataFrame) -> tuple:
    """All trees of one key in packs, how many they are, and the mean path that a score of a half stands for."""
    pdf = pdf.sort_values("tree")
    trees = [_by_levels(tree) for _, tree in pdf.iterrows()]
    packs = []
    for at in range(0, len(trees), WALKED_TREES):
        depths, features, thresholds, children, paths = zip(*trees[at : at + WALKED_TREES])
        roots = np.cumsum([0, *map(len, features)])[:-1]
        children = [child + root for child, root in zip(children, roots, strict=True)]
        packs.append((max(depths), roots, *map(np.concatenate, (features, thresholds, children, paths))))
    return packs, len(trees), float(average_path(float(pdf["sample"].max())))


def isolation(model: tuple, x: np.ndarray) -> np.ndarray:
    """Score in (0, 1]; higher is easier to isolate."""
    packs, trees, usual = model
    total = np.zeros(len(x))
    for start in range(0, len(x), WALKED_ROWS):
        part, paths = x[start : start + WALKED_ROWS], total[start : start + WALKED_ROWS]
        # A value that is no number goes right at every split, as the largest one does.
        values = np.where(np.isnan(part), np.inf, part).ravel()
        places = np.arange(len(part)) * part.shape[1]
        for depth, roots, feature, threshold, child, path in packs:
            first, node = np.tile(places, len(roots)), np.repeat(roots, len(part))
            # No place is out of bounds; with "clip" numpy need not check that first.
            for _ in range(depth):
                value = values.take(feature.take(node, mode="clip") + first, mode="clip")
                above = value > threshold.take(node, mode="clip")
                node = child.take(node, mode="clip") + above
            for reached in path.take(node).reshape(len(roots), len(part)):
                paths += reached
    mean = total / trees
    return np.power(2.0, -mean / usual) if usual > 0 else np.full(len(x), 0.5)


def isolation_scores(rows: DataFrame, forest: DataFrame, key: str = CLASS, vector: str = "vector", **options) -> DataFrame:
    """Add ``isolation``."""
    return apply_models(rows, forest, key, pack_forest, isolation, "isolation", "double", vector, **options)
