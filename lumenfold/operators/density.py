"""Clusters by density, of any number of vectors.

Equal vectors are one point with a count. Points are dealt into blocks around pivots, and what has to be compared is pairs of blocks
whose bounds don't rule it out; a task holds the blocks of one team and meets others one at a time. Three steps, all exact:

1. each point's nearest neighbours, and by them its core distance: that to its ``min_size``-th point, itself and its copies counted;
2. the minimum spanning tree over mutual reachabilities (the greatest of the distance and both core distances), by Boruvka rounds. A component's
   shortest known edge is its shortest if no point of it can have a shorter one that is not known: a point's unknown edges are at least as long
   as its last known neighbour is far. Where that doesn't decide, the component's points are searched for what is outside it;
3. the tree of merges from the shortest edge up. The shortest edges, as many as leave parts of at most MOST_NODES, are worked off part by part,
   a task each; a part then is one node, and what it has to tell is a few sums (below), until one part is left.

A branch is a part of ``min_size`` points or more until it meets another such part; its excess of mass is the sum over its points of the level
(one over the distance) at which they leave it, less the level at which it ends below. Of a branch and those inside it the ones with more excess stay, and
all points together are no cluster. For this a node needs its points, its sum, and the excess of what is inside.

Defined results: no more than ``min_size - 1`` vectors are noise; what is not finite counts as 0, zero vectors stay zero and are copies of each other;
distances count to nine decimals, and what meets at one distance meets at once, so no order of rows or edges matters; a cluster is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import vectors as V
from lumenfold.operators.components import connected_components
from lumenfold.session import batches_of, checkpointed, discard, release, stored

#: Points of a block; more where there would be more than MOST_BLOCKS blocks of one pivot.
BLOCK = 1024
#: Pivots: their vectors, and twice as many centres of blocks, are sent to every task.
MOST_BLOCKS = 4096
#: Blocks whose points search together, so that a block that they meet is sent once.
TEAM = 16
#: Up to so many times all blocks are sent in a search; beyond, each task reads them where they are stored.
MOST_COPIES = 4
#: Points of a task's own blocks when it reads all others.
MOST_POINTS = 65_536
#: Points that others are compared with at once, blocks together.
AT_ONCE = 1024
#: Blocks of a file.
PER_FILE = 64
NEIGHBOURS = 16
#: Nodes that a task takes into its part of the tree of merges.
MOST_NODES = 200_000
#: Level of points at distance 0.
TOP = 1e12
#: Large rows of an Arrow batch.
FEW = 8


def _level(d: float) -> float:
    return 1.0 / d if d > 0 else TOP


def points_of(vectors: DataFrame) -> DataFrame:
    """``p`` (the smallest id), ``copies`` and ``v`` (of unit length) of each different vector."""
    return vectors.select("id", V.unit(F.col("embedding")).alias("v")).groupBy("v").agg(F.min("id").alias("p"), F.count(F.lit(1)).alias("copies"))


def blocked(points: DataFrame, block: int = BLOCK, most: int = MOST_BLOCKS) -> DataFrame:
    """``block``, ``p`` and ``copies`` (arrays), ``data`` (the vectors' doubles), ``centre``, ``radius``: points near one pivot together."""
    spark = points.sparkSession
    n = points.count()
    block = max(block, -(-n // most))
    pivots = points.orderBy(F.xxhash64("p"), "p").limit(max(1, -(-n // block))).select("v").collect()  # MOST_BLOCKS vectors at most
    sent = spark.sparkContext.broadcast(np.array([r.v for r in pivots], np.float64))

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["cell"] = _distances(np.stack(pdf["v"]), sent.value).argmin(axis=1)
                yield pdf

    with batches_of(spark, 1024):
        dealt = stored(points.mapInPandas(cell, "v array<double>, p long, copies long, cell long"))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("in_cell"))  # a row a pivot
    parted = dealt.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("p"), F.ceil(F.col("in_cell") / block)))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        x = np.stack(pdf["v"])
        centre = x.mean(axis=0)
        radius = float(_distances(x, centre[None]).max())
        row = [(int(key[0]), int(key[1]), pdf["p"].tolist(), pdf["copies"].tolist(), x.tobytes(), centre.tolist(), radius * (1 + 1e-9) + 1e-9)]
        return pd.DataFrame(row, columns=["cell", "part", "p", "copies", "data", "centre", "radius"])

    packed = stored(parted.groupBy("cell", "part").applyInPandas(pack, "cell long, part long, p array<long>, copies array<long>, data binary, centre array<double>, radius double"))
    keys = packed.select("cell", "part").orderBy("cell", "part").collect()  # a row a block, twice MOST_BLOCKS and a little at most
    names = spark.createDataFrame([(r.cell, r.part, i) for i, r in enumerate(keys)], "cell long, part long, block long")
    named = _in_files(packed.join(F.broadcast(names), ["cell", "part"]).drop("cell", "part"), packed)
    discard(dealt)
    discard(packed)
    return named


def _in_files(blocks: DataFrame, counted: DataFrame) -> DataFrame:
    """Stored, a few blocks a file, as a reader takes many rows of a file at once."""
    return stored(blocks.repartition(max(1, -(-counted.count() // PER_FILE)), "block"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """To nine decimals, so that what is read from both ends is one distance, and equal ones are equal."""
    return np.round(np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T))), 9)


def _met(blocks: DataFrame, reach: DataFrame, run, schema: str, nearest: int | None = None) -> DataFrame:
    """``run`` for each team: its own blocks, and an iterator of those it meets, one in memory at a time.

    ``reach``: ``block`` and ``tau``, the distance up to which its points want to know. With ``nearest`` so many nearest blocks, whatever their bounds.
    What a team wants is sent to it, the nearest first, while that is MOST_COPIES times all blocks at most. Else as many teams as tasks
    each read all blocks where they are stored, and nothing is sent: the disk needed then doesn't grow with the square of the points.
    """
    spark = blocks.sparkSession
    rows = blocks.select("block", "centre", "radius", F.size("p").alias("n")).orderBy("block").collect()  # a row a block
    tau = {r.block: r.tau for r in reach.select("block", "tau").collect()}  # a row a block
    asking = np.array(sorted(tau), np.int64)
    if not len(asking):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((np.array([r.centre for r in rows]), np.array([r.radius for r in rows]), np.array([tau.get(r.block, -1.0) for r in rows])))

    def bounds(mine: np.ndarray) -> np.ndarray:
        """How near each block can be to these; infinite if they don't want it, and 0 for themselves."""
        centres, radii, taus = sent.value
        least = np.full(len(radii), np.inf)
        for i in mine:
            apart = _distances(centres[i : i + 1], centres)[0]
            bound = np.maximum(0.0, apart - radii - radii[i])
            bound[i] = 0.0
            others = np.flatnonzero(bound <= taus[i]) if nearest is None else np.unique(np.append(np.argsort(apart, kind="stable")[:nearest], i))
            least[others] = np.minimum(least[others], bound[others])
        return least

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    teams = -(-len(asking) // TEAM)

    def wants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealt = np.array_split(asking, teams)
        for pdf in batches:
            for t in pdf["id"]:
                bound = bounds(dealt[t])
                others = np.flatnonzero(np.isfinite(bound))
                yield pd.DataFrame({"team": t, "n_own": len(dealt[t]), "other": np.concatenate((dealt[t], others)), "bound": np.concatenate((np.full(len(dealt[t]), -1.0), bound[others]))})

    wanted = spark.range(0, teams, 1, min(teams, parts)).mapInPandas(wants, "team long, n_own long, other long, bound double")
    if wanted.count() <= MOST_COPIES * len(rows):
        given = wanted.join(blocks, F.col("other") == F.col("block")).select("team", (F.col("bound") < 0).alias("own"), "n_own", "bound", *blocks.columns)
        given = given.repartition(parts, "team").sortWithinPartitions("team", "bound", "block").drop("bound")
    else:
        points = sum(rows[i].n for i in asking)
        tasks = min(len(asking), max(parts, -(-points // MOST_POINTS)))
        given = _read_by_each(blocks, asking, tasks, bounds)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def single() -> Iterator[dict]:
            for pdf in batches:
                yield from pdf.to_dict("records")

        ahead = single()
        row = next(ahead, None)
        while row is not None:
            team, own, early = row["team"], [], []
            while row is not None and row["team"] == team and len(own) < row["n_own"]:
                (own if row["own"] else early).append(row)
                row = next(ahead, None)

            def others() -> Iterator[dict]:
                nonlocal row
                yield from early
                while row is not None and row["team"] == team:
                    yield row
                    row = next(ahead, None)

            met = others()
            yield from run(own, met)
            for _ in met:
                pass

    with batches_of(spark, FEW):
        return stored(given.mapInPandas(stream, schema))


def _read_by_each(blocks: DataFrame, asking: np.ndarray, tasks: int, bounds) -> DataFrame:
    """``team``, ``own`` and a block: each task's own blocks, then those it wants, read from what is stored without a shuffle."""
    spark = blocks.sparkSession

    def wants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealt = np.array_split(asking, tasks)
        for pdf in batches:
            for t in pdf["id"]:
                bound = bounds(dealt[t])
                mine = np.zeros(len(bound), bool)
                mine[dealt[t]] = True
                yield pd.DataFrame({"team": [t], "n_own": [len(dealt[t])], "mine": [mine.tolist()], "wanted": [np.isfinite(bound).tolist()]})

    team = spark.range(0, tasks, 1, tasks).mapInPandas(wants, "team long, n_own long, mine array<boolean>, wanted array<boolean>")
    twice = blocks.withColumn("own", F.lit(True)).unionByName(blocks.withColumn("own", F.lit(False))).coalesce(1)
    at = F.col("block").cast("int")
    asked = F.when(F.col("own"), F.get("mine", at)).otherwise(F.get("wanted", at))
    # The pairs of partitions of the two sides are the tasks: the one of all blocks with each team.
    return twice.join(team.hint("shuffle_replicate_nl"), asked).select("team", "own", "n_own", *blocks.columns)


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.float64).reshape(len(row["p"]), -1)


def _take_nearest(d: np.ndarray, ids: np.ndarray, counts: np.ndarray, dist: np.ndarray, who: np.ndarray, many: np.ndarray) -> None:
    """The nearest of what is known and of ``d``, by distance and id, in place. Only what is no farther than the last known one is sorted."""
    k = dist.shape[1]
    hit = d <= dist[:, -1:]
    hits = hit.sum(axis=1)
    rows = np.flatnonzero(hits)
    if not len(rows):
        return
    d, hit, hits = d[rows], hit[rows], hits[rows]
    at = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    if 4 * hits.max() < d.shape[1]:  # few: these alone, side by side
        r, c = np.nonzero(hit)
        place = np.arange(len(r)) - (np.cumsum(hits) - hits)[r]
        few, at = np.full((len(rows), hits.max()), np.inf), np.zeros((len(rows), hits.max()), np.int64)
        few[r, place], at[r, place] = d[r, c], c
        d = few
    upto = np.minimum(dist[rows, -1], np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] > k else dist[rows, -1]
    width = int((d <= upto[:, None]).sum(axis=1).max())  # ties beyond k too, which ids decide
    near = np.argpartition(d, width - 1, axis=1)[:, :width]
    at = np.take_along_axis(at, near, axis=1)
    all_d, all_i, all_c = np.concatenate((dist[rows], np.take_along_axis(d, near, axis=1)), axis=1), np.concatenate((who[rows], ids[at]), axis=1), np.concatenate((many[rows], counts[at]), axis=1)
    best = np.lexsort((all_i, all_d), axis=1)[:, :k]
    dist[rows], who[rows], many[rows] = (np.take_along_axis(a, best, axis=1) for a in (all_d, all_i, all_c))


def _apart(own: list[dict]):
    """How far a block is at least from each of these; not at all from itself."""
    names, centres, radii = np.array([r["block"] for r in own]), np.array([r["centre"] for r in own]), np.array([r["radius"] for r in own])
    return lambda other: np.where(names == other["block"], -np.inf, np.linalg.norm(centres - np.asarray(other["centre"]), axis=1) - radii - other["radius"])


def _at_once(met: Iterator[dict], apart, *columns: str) -> Iterator[tuple]:
    """Blocks together, as many as have AT_ONCE points: their vectors, these columns, and a function that says which points a block of one's own has to look at,
    by its number and how far it wants to know; nothing if none."""

    def joined(group: list[dict]) -> tuple:
        gaps = np.stack([apart(r) for r in group], axis=1)
        whose = np.repeat(np.arange(len(group)), [len(r["p"]) for r in group])

        def wanted(i: int, upto: float) -> slice | np.ndarray | None:
            near = gaps[i] <= upto
            return slice(None) if near.all() else near[whose] if near.any() else None

        return np.concatenate([_matrix(r) for r in group]), *(np.concatenate([np.asarray(r[c]) for r in group]) for c in columns), {r["block"] for r in group}, wanted

    group, n = [], 0
    for row in met:
        group.append(row)
        n += len(row["p"])
        if n >= AT_ONCE:
            yield joined(group)
            group, n = [], 0
    if group:
        yield joined(group)


def _search_neighbours(k: int, min_size: int):
    """Each point's ``k`` nearest others, its core distance, and how far unknown ones are at least."""

    def run(own: list[dict], met: Iterator[dict]) -> Iterator[pd.DataFrame]:
        apart, farthest = _apart(own), np.full(len(own), np.inf)
        state = [(_matrix(r), np.asarray(r["p"]), np.full((len(r["p"]), k), np.inf), np.full((len(r["p"]), k), -1), np.zeros((len(r["p"]), k), np.int64)) for r in own]
        for y, ids, counts, names, wanted in _at_once(met, apart, "p", "copies"):
            for i, (x, mine, dist, who, many) in enumerate(state):
                part = wanted(i, farthest[i])
                if part is None:
                    continue
                d = _distances(x, y[part])
                if own[i]["block"] in names:
                    d[mine[:, None] == ids[part][None]] = np.inf
                _take_nearest(d, ids[part], counts[part], dist, who, many)
                farthest[i] = dist[:, -1].max()
        for r, (_, mine, dist, who, many) in zip(own, state):
            found = []
            known = np.isfinite(dist)
            upto = np.cumsum(np.where(known, many, 0), axis=1) + np.asarray(r["copies"])[:, None]
            first = np.where(upto >= min_size, dist, np.inf).min(axis=1)
            core = np.where(np.asarray(r["copies"]) >= min_size, 0.0, first)
            for i, p in enumerate(mine):
                n = int(known[i].sum())
                found.append((r["block"], i, p, who[i, :n].tolist(), dist[i, :n].tolist(), core[i], max(core[i], dist[i, -1])))
            yield pd.DataFrame(found, columns=["block", "at", "p", "others", "d", "core", "least"])

    return run


def _search_outside(own: list[dict], met: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """The shortest edge of each active point to another component, if it is no longer than what is known; else how long it is at least."""
    apart, state = _apart(own), []
    for r in own:
        active = np.flatnonzero(np.asarray(r["active"], bool))
        state.append((active, _matrix(r)[active], np.asarray(r["core"])[active], np.asarray(r["comp"])[active], np.asarray(r["upto"])[active].copy(), np.full(len(active), -1)))
    farthest = np.array([upto.max(initial=-np.inf) for *_, upto, _ in state])
    for y, ids, core, comp, _, wanted in _at_once(met, apart, "p", "core", "comp"):
        one = (comp == comp[0]).all()
        for i, (_, x, mine, own_comp, upto, who) in enumerate(state):
            part = wanted(i, farthest[i])
            if part is None or one and (own_comp == comp[0]).all():
                continue
            w = np.maximum(np.maximum(_distances(x, y[part]), mine[:, None]), core[part][None])
            w[own_comp[:, None] == comp[part][None]] = np.inf
            least = w.min(axis=1)
            rows = np.flatnonzero((least <= upto) & np.isfinite(least))
            if not len(rows):
                continue
            w, least = w[rows], least[rows]
            best = np.where(w == least[:, None], ids[part][None], np.iinfo(np.int64).max).min(axis=1)
            better = (least < upto[rows]) | (who[rows] < 0) | (best < who[rows])
            upto[rows[better]], who[rows[better]] = least[better], best[better]
            farthest[i] = upto.max()
    for r, (active, _, _, _, upto, who) in zip(own, state):
        yield pd.DataFrame({"p": np.asarray(r["p"])[active], "other": who, "w": upto})


def _undirected(edges: DataFrame) -> DataFrame:
    """Each pair once; of two readings of one distance the least."""
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return ends.groupBy("a", "b").agg(F.min("w").alias("w"))


def neighbours(blocks: DataFrame, min_size: int) -> DataFrame:
    """``block``, ``at``, ``p``, ``others`` and ``d`` (the nearest), ``core``, ``least``. First a few near blocks are met, which says how far the others matter."""
    k = max(NEIGHBOURS, min_size)
    schema = "block long, at long, p long, others array<long>, d array<double>, core double, least double"
    reach = blocks.select("block", F.lit(float("inf")).alias("tau"))
    first = _met(blocks, reach, _search_neighbours(k, min_size), schema, 3)
    far = F.when(F.size("d") < k, float("inf")).otherwise(F.element_at("d", -1))
    found = _met(blocks, first.groupBy("block").agg(F.max(far).alias("tau")), _search_neighbours(k, min_size), schema)
    discard(first)
    return found


def cores(points: DataFrame, min_size: int, block: int = BLOCK) -> DataFrame:
    """``p`` and ``core``, the distance to a point's ``min_size``-th, itself counted."""
    return neighbours(blocked(points, block), min_size).select("p", "core")


def spanning_tree(points: DataFrame, min_size: int, block: int = BLOCK) -> DataFrame:
    """``a``, ``b``, ``w``: a minimum spanning tree over mutual reachabilities. Stored."""
    blocks = blocked(points, block)
    near = neighbours(blocks, min_size)
    cores = near.select("p", "core")
    pairs = near.select(F.col("p").alias("a"), "core", F.explode(F.arrays_zip("others", "d")).alias("n")).select("a", "core", F.col("n.others").alias("b"), F.col("n.d").alias("d"))
    other = cores.select(F.col("p").alias("b"), F.col("core").alias("core_b"))
    known = stored(_undirected(pairs.join(other, "b").select("a", "b", F.greatest("d", "core", "core_b").alias("w"))))
    labels = stored(near.select("p", "block", "at", "core", "least", F.col("p").alias("comp")))
    discard(near)
    chosen: list[DataFrame] = []
    while True:
        state = _components(_across(known, labels), labels)
        if state.limit(2).count() < 2:
            break
        picks = state.where("best is not null and best.w <= least").select("comp", "best.w", "best.a", "best.b", "best.to")
        if picks.isEmpty():
            # No component is sure of its shortest edge: its points are searched.
            found = _outside(blocks, labels, state.select("comp", "best"))
            seen = found.select(F.col("p").alias("f"), F.col("w").alias("found"))
            labels = _instead(labels, labels.join(seen, F.col("p") == F.col("f"), "left").withColumn("least", F.greatest("least", F.coalesce("found", "least"))).drop("f", "found"))
            more = found.where("other >= 0").select(F.col("p").alias("a"), F.col("other").alias("b"), "w")
            known = _instead(known, _undirected(known.unionByName(more)))
            discard(found)
            continue
        chosen.append(picks.select("a", "b", "w").distinct())
        ends = _ends(picks.select("comp", "to"))
        labels = _instead(labels, labels.join(ends, "comp", "left").withColumn("comp", F.coalesce("end", "comp")).drop("end"))
        known = _instead(known, _across(known, labels).select("a", "b", "w"))
    for used in (blocks, labels, known):
        discard(used)
    if not chosen:
        return points.sparkSession.createDataFrame([], "a long, b long, w double")
    tree = chosen[0]
    for c in chosen[1:]:
        tree = tree.unionByName(c)
    return stored(tree)


def _instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` stored, and neither what was stored as ``old`` nor what was shuffled for ``new`` kept."""
    new = stored(new)
    discard(old)
    release(new.sparkSession)
    return new


def small_tree(points: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """:func:`spanning_tree` of the points of one block: from one point on, the shortest edge outwards each time."""
    points = points.sort_values("p")
    x, ids, copies = np.stack(points["v"]), points["p"].to_numpy(), points["copies"].to_numpy()
    d = _distances(x, x)
    np.fill_diagonal(d, 0.0)
    order = np.argsort(d, axis=1, kind="stable")
    enough = (np.cumsum(copies[order], axis=1) >= min_size).argmax(axis=1)
    core = np.take_along_axis(d, order, axis=1)[np.arange(len(x)), enough]
    link, frm = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    inside, at, edges = np.zeros(len(x), bool), 0, []
    for _ in range(len(x) - 1):
        inside[at] = True
        w = np.maximum(np.maximum(d[at], core[at]), core)
        nearer = ~inside & (w < link)
        link[nearer], frm[nearer] = w[nearer], at
        at = int(np.where(inside, np.inf, link).argmin())
        edges.append((ids[frm[at]], ids[at], link[at]))
    return pd.DataFrame(edges, columns=["a", "b", "w"])


def _across(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components, with these: ``ca``, ``cb``."""
    a = labels.select(F.col("p").alias("a"), F.col("comp").alias("ca"))
    b = labels.select(F.col("p").alias("b"), F.col("comp").alias("cb"))
    return edges.select("a", "b", "w").join(a, "a").join(b, "b").where("ca <> cb")


def _components(outer: DataFrame, labels: DataFrame) -> DataFrame:
    """``comp``, ``least`` (how long unknown edges are at least), ``best`` (the shortest known one)."""
    both = outer.select(F.col("ca").alias("comp"), F.col("cb").alias("to"), "a", "b", "w").unionByName(outer.select(F.col("cb").alias("comp"), F.col("ca").alias("to"), "a", "b", "w"))
    best = both.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("best"))
    return checkpointed(labels.groupBy("comp").agg(F.min("least").alias("least")).join(best, "comp", "left"))


def _outside(blocks: DataFrame, labels: DataFrame, unsure: DataFrame) -> DataFrame:
    """``p``, ``other`` (-1 for none), ``w`` of the points that could have a shorter edge than is known."""
    upto = unsure.select("comp", F.coalesce("best.w", F.lit(float("inf"))).alias("upto"))
    rows = labels.join(upto, "comp", "left").withColumn("active", F.coalesce(F.col("least") < F.col("upto"), F.lit(False)))
    told = F.sort_array(F.collect_list(F.struct("at", "comp", "core", "active", F.coalesce("upto", F.lit(0.0)).alias("upto"))))  # a block's points
    packed = rows.groupBy("block").agg(told.alias("t"), F.max(F.when(F.col("active"), F.col("upto"))).alias("tau"))
    packed = checkpointed(packed.select("block", "tau", *[F.col(f"t.{c}").alias(c) for c in ("comp", "core", "active", "upto")]))
    told = _in_files(blocks.join(packed.drop("tau"), "block"), blocks)
    found = _met(told, packed.where("tau is not null"), _search_outside, "p long, other long, w double")
    discard(told)
    return found


def _ends(picks: DataFrame) -> DataFrame:
    """``comp``, ``end``: where picks lead. Of two components that pick each other the smaller stays; ways double each round."""
    back = picks.select(F.col("comp").alias("at"), F.col("to").alias("on"))
    # A component that picks itself is an end.
    now = checkpointed(
        picks.join(back, F.col("to") == F.col("at"), "left").select("comp", F.when((F.col("on") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("end"))
    )
    while True:
        ahead = now.select(F.col("comp").alias("at"), F.col("end").alias("on"))
        then = checkpointed(now.join(ahead, F.col("end") == F.col("at"), "left").select("comp", F.coalesce("on", "end").alias("end"), (F.col("on") != F.col("end")).alias("moved")))
        now = then.select("comp", "end")
        if then.where("moved").isEmpty():
            return now


def merged(nodes: pd.DataFrame, edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """One part of the tree of merges: each node's ``part`` (the smallest node) and ``label`` (of the outermost branch that stays), and the sums of the part.

    ``nodes``: node, points, mass, inner, branched. ``edges``: a, b, w, which join them all.
    """
    nodes, edges = nodes.sort_values("node"), edges.sort_values(["w", "a", "b"])
    ids = nodes["node"].tolist()
    at = {node: i for i, node in enumerate(ids)}
    points, mass, inner = nodes["points"].tolist(), nodes["mass"].tolist(), nodes["inner"].tolist()
    branched, least = nodes["branched"].tolist(), list(ids)
    n = len(ids)
    up, root = [-1] * (2 * n - 1), list(range(2 * n - 1))
    stays: dict[int, int] = {}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def closed(i: int, level: float) -> float:
        """The excess of a branch that ends here, or of what is inside if that is more."""
        excess = mass[i] - points[i] * level
        if branched[i] and inner[i] > excess:
            return inner[i]
        stays[i] = least[i]
        return excess

    a, b, w = (edges[c].tolist() for c in ("a", "b", "w"))
    low = 0
    while low < len(w):
        # All edges of one length at once: no order among them.
        high, met = low, {}
        while high < len(w) and w[high] == w[low]:
            x, y = top(at[a[high]]), top(at[b[high]])
            mine, other = met.pop(x, [x]), met.pop(y, [y])
            root[y] = x
            met[x] = mine + other
            high += 1
        level = _level(w[low])
        for parts in met.values():
            size, large = sum(points[c] for c in parts), [c for c in parts if points[c] >= min_size]
            if len(large) > 1:
                sums = (size * level, sum(closed(c, level) for c in large), True)
            elif large:
                (c,) = large
                sums = (mass[c] + (size - points[c]) * level, inner[c], branched[c])
            else:
                sums = (size * level if size >= min_size else 0.0, 0.0, False)
            new = len(points)
            points.append(size)
            least.append(min(least[c] for c in parts))
            for column, value in zip((mass, inner, branched), sums):
                column.append(value)
            for c in parts:
                up[c] = root[c] = new
        low = high
    labels: list[int | None] = [None] * len(points)
    for i in range(len(points) - 1, -1, -1):
        outer = labels[up[i]] if up[i] >= 0 else None
        labels[i] = outer if outer is not None else stays.get(i)
    last = len(points) - 1
    return pd.DataFrame({
        "node": ids, "part": least[last], "label": pd.array(labels[:n], "Int64"), "points": points[last], "mass": mass[last], "inner": inner[last], "branched": branched[last],
    })


def _shortest(edges: DataFrame, nodes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """As many of the shortest edges, equal ones together, as leave parts of ``most`` nodes at most: these, and ``node``, ``part`` of what they touch.

    If the edges of the least length alone are too many, these, and true.
    """
    n = edges.count()
    if n < most:
        return edges, nodes.select("node", F.lit(nodes.agg(F.min("node")).first()[0]).alias("part")), False
    share = 0.5
    while n * share >= most:
        low = edges.where(F.col("w") < edges.approxQuantile("w", [share], 0.01)[0])
        parts = checkpointed(connected_components(low, "a", "b").select("node", F.col("component").alias("part")))
        largest = parts.groupBy("part").count().agg(F.max("count")).first()[0]
        if largest is not None and largest <= most:
            return low, parts, False
        share /= 2
    last = edges.orderBy("w").limit(most).agg(F.max("w"), F.min("w")).first()
    tied = last[0] == last[1]
    low = edges.where(F.col("w") == last[1]) if tied else edges.where(F.col("w") < last[0])
    return low, checkpointed(connected_components(low, "a", "b").select("node", F.col("component").alias("part"))), tied


def tied_merge(nodes: DataFrame, level: float, min_size: int) -> DataFrame:
    """:func:`merged` for parts that edges of one length make: sums by part, of any size."""
    excess = F.col("mass") - F.col("points") * level
    inside = F.col("branched") & (F.col("inner") > excess)
    large = F.col("points") >= min_size
    rows = nodes.withColumn("value", F.when(inside, F.col("inner")).otherwise(excess)).withColumn("own", F.when(large & ~inside, F.col("node")))
    only = F.max(F.when(large, F.struct("points", "mass", "inner", "branched")))
    by = rows.groupBy("part").agg(
        F.sum("points").alias("all"), F.count(F.when(large, 1)).alias("n"), F.sum(F.when(large, F.col("value"))).alias("values"), only.alias("one")
    )
    size, n, one = F.col("all"), F.col("n"), F.col("one")
    mass = F.when(n == 1, one["mass"] + (size - one["points"]) * level).when((n > 1) | (size >= min_size), size * level).otherwise(0.0)
    sums = by.select(
        F.col("part").alias("of"), "n", size.alias("s_points"), mass.alias("s_mass"),
        F.when(n > 1, F.col("values")).when(n == 1, one["inner"]).otherwise(0.0).alias("s_inner"), F.when(n == 1, one["branched"]).otherwise(n > 1).alias("s_branched"),
    )
    return rows.join(sums, F.col("part") == F.col("of")).select(
        "node", "part", F.when(F.col("n") > 1, F.col("own")).alias("label"), F.col("s_points").alias("points"), F.col("s_mass").alias("mass"),
        F.col("s_inner").alias("inner"), F.col("s_branched").alias("branched"),
    )


def labelled(points: DataFrame, tree: DataFrame, min_size: int, most: int = MOST_NODES) -> DataFrame:
    """``p``, ``label`` of points in clusters; the label is the cluster's smallest id."""
    state = "node long, part long, label long, points long, mass double, inner double, branched boolean"
    first = F.when(F.col("copies") >= min_size, F.col("copies") * TOP).otherwise(0.0)
    nodes = stored(points.select(F.col("p").alias("node"), F.col("copies").alias("points"), first.alias("mass"), F.lit(0.0).alias("inner"), F.lit(False).alias("branched")))
    at = points.select("p", F.col("p").alias("node"), F.lit(None).cast("long").alias("label"))

    def work(key: tuple, mine: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return merged(mine, edges, min_size)

    while True:
        left = tree.count()
        if not left:
            break
        low, parts, tied = _shortest(tree, nodes, most)
        low = stored(low)
        parts = checkpointed(parts)
        edges = low.join(parts.select(F.col("node").alias("a"), F.col("part").alias("of")), "a")
        inside = nodes.join(parts, "node")
        done = stored(tied_merge(inside, _level(low.first()["w"]), min_size) if tied else inside.groupBy("part").cogroup(edges.groupBy("of")).applyInPandas(work, state))
        over = done.select(F.col("node").alias("n"), "part", F.col("label").alias("outer"))
        at = stored(at.join(over, F.col("node") == F.col("n"), "left").select("p", F.coalesce("part", "node").alias("node"), F.coalesce("outer", "label").alias("label")))
        touched = done.select("node")
        kept = nodes.join(touched, "node", "left_anti")
        nodes = stored(done.where("node = part").select("node", "points", "mass", "inner", "branched").unionByName(kept))
        rest = tree.join(low.select("a", "b"), ["a", "b"], "left_anti")
        new_a, new_b = over.select(F.col("n").alias("a"), F.col("part").alias("pa")), over.select(F.col("n").alias("b"), F.col("part").alias("pb"))
        tree = stored(rest.join(new_a, "a", "left").join(new_b, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"), "w"))
    return at.where("label is not null").select("p", "label")


def in_order(keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``place`` from 0 in order of ``key``: sorted by ranges, and each range's places begin where the one before ends."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(keys.repartitionByRange(parts, key).withColumn("range", F.spark_partition_id()))
    begun, offsets = 0, []
    for r in rows.groupBy("range").count().orderBy("range").collect():  # a row a partition
        offsets.append((r.range, begun))
        begun += r["count"]
    table = keys.sparkSession.createDataFrame(offsets, "range int, before long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return rows.join(F.broadcast(table), "range").withColumn("place", F.col("before") + within).drop("range", "before")


def clusters(vectors: DataFrame, min_size: int, block: int = BLOCK, most: int = MOST_NODES) -> DataFrame:
    """``id`` and ``label`` of vectors in clusters; labels count from 0 in order of the clusters' smallest ids. Noise is left out."""
    rows = vectors.select("id", "embedding")
    points = stored(points_of(rows))
    # What would be one block is one task's work.
    block = block if points.count() > block else 0
    if (points.agg(F.sum("copies")).first()[0] or 0) < max(2, min_size):
        return rows.where("false").select("id", F.lit(0).cast("long").alias("label"))
    tree = spanning_tree(points, min_size, block) if block else points.groupBy(F.lit("one block")).applyInPandas(lambda pdf: small_tree(pdf, min_size), "a long, b long, w double")
    found = stored(labelled(points, stored(tree), min_size, most))
    places = in_order(found.select("label").distinct(), "label").select(F.col("label").alias("l"), F.col("place").cast("long").alias("place"))
    mine = rows.select("id", V.unit(F.col("embedding")).alias("v")).join(points.select("v", "p"), "v")
    return mine.join(found, "p").join(places, F.col("label") == F.col("l")).select("id", F.col("place").alias("label"))
