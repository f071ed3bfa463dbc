"""Clusters by density: against a plain reading of the definition, one threshold after the other."""

from pathlib import Path

import numpy as np
import pytest

from lumenfold.operators import density
from lumenfold.operators.clustering import density_clusters


def unit(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def brute(x, m):
    """Parts at every distance, by flooding the whole matrix; a branch is a row of parts that hold each other."""
    x = unit(np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0))
    n = len(x)
    if n < max(2, m):
        return [-1] * n
    d = np.round(np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2))), 9)
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(w, np.inf)
    parts = [frozenset([i]) for i in range(n)]
    begun, leave, kids = {}, {}, {}
    for p in parts:
        leave[p], kids[p] = 0.0, None
    chosen = []

    def value(p, level):
        excess = leave[p] - len(p) * level
        inside = sum(v for v, _ in kids[p]) if kids[p] else None
        if inside is not None and inside > excess:
            return inside, [c for _, cs in kids[p] for c in cs]
        return excess, [p]

    for t in np.unique(w[np.isfinite(w)]):
        if len(parts) == 1:
            break
        level = 1 / t if t > 0 else 1e12
        left, now = list(parts), []
        while left:
            group, rest = [left.pop()], left
            grown = True
            while grown:
                grown = [p for p in rest if any(w[np.ix_(sorted(p), sorted(g))].min() <= t for g in group)]
                rest = [p for p in rest if p not in grown]
                group += grown
            left = rest
            if len(group) == 1:
                now.append(group[0])
                continue
            whole, large = frozenset().union(*group), [p for p in group if len(p) >= m]
            if len(large) > 1:
                leave[whole], kids[whole] = len(whole) * level, [value(p, level) for p in large]
            elif large:
                leave[whole], kids[whole] = leave[large[0]] + (len(whole) - len(large[0])) * level, kids[large[0]]
            else:
                leave[whole], kids[whole] = (len(whole) * level if len(whole) >= m else 0.0), None
            now.append(whole)
        parts = now
    (whole,) = parts
    chosen = [c for _, cs in kids[whole] or [] for c in cs]
    labels = [-1] * n
    for k, c in enumerate(sorted(chosen, key=min)):
        for i in c:
            labels[i] = k
    return labels


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")


def blobs(rng, n, dim, groups, spread):
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread


def told(rows, n):
    labels = [-1] * n
    for r in rows.collect():
        labels[r.id] = r.label
    return labels


@pytest.mark.parametrize("seed", range(8))
def test_one_task_as_defined(seed):
    rng = np.random.default_rng(seed)
    x = blobs(rng, 70, int(rng.integers(2, 6)), 4, rng.choice([0.1, 0.3, 1.0]))
    if seed % 2:
        x = np.round(x, 1)  # copies and many equal distances
    m = int(rng.integers(2, 6))
    assert density_clusters(unit(x), m).tolist() == brute(x, m)


def test_many_blocks_and_parts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((blobs(rng, 60, 3, 5, 0.1), [[np.nan, 0, 0], [0, 0, 0]], blobs(rng, 20, 3, 2, 0.1).round(1)))
    x = np.concatenate((x, x[:12], np.repeat(x[:1], 40, axis=0)))  # copies, and one vector with many
    got = told(density.clusters(frame(spark, x), 3, block=24, most=50), len(x))
    assert got == brute(x, 3) and len(set(got)) > 3


def test_equal_distances_beyond_a_task(spark):
    """Vectors at right angles are all equally far: no cluster, however many meet at once; pairs of blobs among them are two."""
    x = np.concatenate((np.eye(30), np.eye(30)[:1] + np.eye(30)[1:2] * [[0.1], [0.11], [0.12], [0.13]], np.eye(30)[5:6] + np.eye(30)[6:7] * [[0.1], [0.11], [0.12], [0.13]]))
    got = told(density.clusters(frame(spark, x), 3, block=16, most=12), len(x))
    assert got == brute(x, 3) and max(got) == 1


def test_few(spark):
    assert told(density.clusters(frame(spark, np.eye(2)), 3), 2) == [-1, -1]
    assert told(density.clusters(frame(spark, np.zeros((0, 2))), 3), 0) == []
    x = blobs(np.random.default_rng(0), 60, 3, 3, 0.05)
    assert told(density.clusters(frame(spark, x), 3), 60) == brute(x, 3)


def test_only_the_nearest_are_sorted(monkeypatch):
    """Merging a block's distances sorts few of them, and gives what sorting all gives, ties and gaps included."""
    rng = np.random.default_rng(1)
    widest, plain = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis: widest.append(keys[0].shape[1]) or plain(keys, axis=axis))
    for n, steps in ((3, 5), (40, 6), (400, 10**6)):
        state = np.full((30, 8), np.inf), np.full((30, 8), -1), np.zeros((30, 8), np.int64)
        seen_d, seen_i = np.zeros((30, 0)), np.zeros(0, np.int64)
        for block in range(4):
            d, ids = rng.integers(0, steps, (30, n)) / 4, rng.permutation(n) + 1000 * (3 - block)
            density._take_nearest(d.copy(), ids, ids % 7 + 1, *state)
            seen_d, seen_i = np.concatenate((seen_d, d), axis=1), np.concatenate((seen_i, ids))
            for row in range(30):
                best = plain((seen_i, seen_d[row]))[:8]
                assert state[0][row, : len(best)].tolist() == seen_d[row, best].tolist() and state[1][row, : len(best)].tolist() == seen_i[best].tolist()
                assert state[2][row, : len(best)].tolist() == (seen_i[best] % 7 + 1).tolist()
        assert n < 400 or max(widest[-4:]) <= 20


def test_a_search_sends_no_block_to_every_team(spark, monkeypatch):
    """In many dimensions every block wants all others: what is shuffled stays a few times the points, and the neighbours are the nearest, read by several tasks."""
    rng = np.random.default_rng(5)
    x = np.concatenate((unit(rng.normal(size=(900, 64))), unit(rng.normal(size=(1, 64))).repeat(3, axis=0)))
    monkeypatch.setattr(density, "TEAM", 4)
    points = density.points_of(frame(spark, x))
    blocks = density.blocked(points, 16)
    assert blocks.count() > 40
    seen = shuffled(spark)
    rows = density.neighbours(blocks, 3).collect()
    sent = shuffled(spark) - seen
    assert sent < 8 * x.nbytes, f"{sent} bytes shuffled for {x.nbytes} of vectors"
    d = np.round(np.sqrt(np.maximum(0, ((x[:, None] - x[None]) ** 2).sum(axis=2))), 9)
    assert sorted(r.p for r in rows) == list(range(901))
    for r in rows:
        apart = np.delete(d[r.p, :901], r.p)
        assert np.abs(np.sort(apart)[:16] - np.array(r.d)).max() < 2e-9 and abs(np.sort(d[r.p])[2] - r.core) < 2e-9


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_own_blocks_come_in_any_order(spark):
    """A store may hand out its files in another order: own blocks are awaited, and nothing that came before them is lost."""
    x = unit(np.random.default_rng(6).normal(size=(120, 20)))
    blocks = density.blocked(density.points_of(frame(spark, x)), 8)
    plain = density._read_by_each

    def backwards(*args):
        return plain(*args).repartition(3, "team").sortWithinPartitions("team", "own", "block")

    def found():
        return sorted((r.p, tuple(r.others), tuple(r.d)) for r in density.neighbours(blocks, 3).collect())

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(density, "MOST_COPIES", 0)
        direct = found()
        patch.setattr(density, "_read_by_each", backwards)
        assert found() == direct
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(density, "MOST_COPIES", 10**9)
        assert found() == direct


def test_rounds_leave_only_the_tree(spark):
    """What a round replaces goes from the shared folder at once."""
    from lumenfold.session import shared_dir

    kept = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("stored-*")}
    points = density.points_of(frame(spark, unit(np.random.default_rng(7).normal(size=(60, 5)))))
    before = kept()
    tree = density.spanning_tree(points, 3, 16)
    assert len(kept() - before) == 1 and tree.count() == 59


def test_small_blocks_are_compared_together(monkeypatch):
    """One comparison for many small blocks, and what comparing all points gives; far blocks are left out of it."""
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate((rng.normal(size=(160, 6)), rng.normal(size=(40, 6)) + 1000)), 1)  # with equal distances
    d = density._distances(x, x)
    np.fill_diagonal(d, np.inf)
    core, comp = np.sort(d, axis=1)[:, 1], np.arange(200) // 3
    blocks = []
    for b in range(25):
        at = slice(8 * b, 8 * b + 8)
        centre = x[at].mean(axis=0)
        told = {"core": core[at], "comp": comp[at], "active": np.arange(8) < b % 9, "upto": np.full(8, np.inf)}
        blocks.append({"block": b, "p": np.arange(200)[at], "copies": np.ones(8, int), "data": x[at].tobytes(), "centre": centre, "radius": density._distances(x[at], centre[None]).max() + 1e-8, **told})
    sizes, plain = [], density._distances
    monkeypatch.setattr(density, "_distances", lambda a, b: sizes.append(len(b)) or plain(a, b))
    for most, together in ((1024, 1), (60, 4)):
        monkeypatch.setattr(density, "AT_ONCE", most)
        sizes.clear()
        rows = np.concatenate([f[["p", "least"]].to_numpy() for f in density._search_neighbours(8, 3)(blocks, iter(blocks))])
        found = {r.p: r for f in density._search_neighbours(8, 3)(blocks, iter(blocks)) for r in f.itertuples()}
        assert len(rows) == 200 and len(sizes) <= 2 * 25 * together
        for p, r in found.items():
            best = np.lexsort((np.arange(200), d[p]))[:8]
            assert r.others == best.tolist() and r.d == d[p][best].tolist() and r.core == core[p]
        sizes.clear()
        w = np.maximum(np.maximum(d, core[:, None]), core[None])
        w[comp[:, None] == comp[None]] = np.inf
        for r in (r for f in density._search_outside(blocks, iter(blocks)) for r in f.itertuples()):
            assert (r.other, r.w) == (w[r.p].argmin(), w[r.p].min())
        assert len(sizes) <= 25 * together
    assert min(sizes) < 60  # the far ones alone, or the near ones
