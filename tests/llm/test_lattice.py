import numpy as np
import pytest

from lakeloom.llm import lattice
from tests.llm.util import components

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def rows(seed=0, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.25])
        out.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3), "x"))
    hot = out[0][1]
    out += [(1000 + i, hot, 0, "x") for i in range(50)]
    out += [(2000, None, 0, "x"), (2001, [0.0] * dim, 0, "x"), (2002, [float("nan")] + [1.0] * (dim - 1), 0, "x"), (2003, [None] + [1.0] * (dim - 1), 0, "x"), (2004, hot, None, "x"), (2005, [], 0, "x"), (2006, [float("inf")] * dim, 1, "x"), (2007, hot[:8], 0, "x")]
    return out


def brute(data, least):
    good = {}
    for i, v, y, _ in data:
        if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = (y, x / np.sqrt((x * x).sum()))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= least]
    n = {i: 0 for i, *_ in data}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components([i for i, *_ in data], links)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


WIDE = {"width": 2, "tables": 16, "probes": 3, "scale": 1.76}


@pytest.mark.parametrize("how", [{}, {"block": 40}, {"block": 40, "blocks": 1}, {"shapes": lambda n: WIDE}, {"shapes": lambda n: WIDE, "block": 50, "blocks": 0}])
def test_against_brute_force(spark, how):
    """All of a label in one task, two blocks of it in one, and by groups of cells."""
    data = rows()
    got = lattice.near_vectors(spark, spark.createDataFrame(data, SCHEMA), **how).collect()
    want = brute(data, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want
    assert sum(n for n, _, _ in want.values()) > 1000


def test_links_of_cells_of_any_size():
    """Pair by pair, in blocks, of one side and of two, and shared out over groups of cells."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 16))
    x = base[rng.integers(0, 5, 400)] + rng.normal(size=(400, 16)) * rng.choice([0.02, 0.15, 0.3], 400)[:, None]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    net, w, side = lattice.Lattice(16, 5, 3, 1.76), rng.integers(1, 4, 400), rng.integers(0, 2, 400)
    near = (x @ x.T >= 0.93) & ~np.eye(400, dtype=bool)
    for sides, want in ((np.zeros(400, int), near), (side, near & (side[:, None] != side[None, :]))):
        for few, block, groups in ((24, 1024, 1), (1, 7, 1), (10_000, 9, 1), (4, 30, 3)):
            got = [lattice.linked(x, sides, w, net, 0.93, g, groups, few, block) for g in range(groups)]
            assert (sum(g.count for g in got) == (want * w).sum(axis=1)).all()
            edges = [e for g in got for e in g.forest]
            assert all(want[a, b] for a, b in edges)
            assert components(range(400), edges) == components(range(400), [(int(a), int(b)) for a, b in zip(*np.nonzero(want)) if a < b])


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (200, 8))
    p = lattice.decode_e8(x)
    d = ((x - p) ** 2).sum(axis=1)
    for r in lattice.e8_roots():
        assert (((x - p - r) ** 2).sum(axis=1) >= d - 1e-9).all()
    assert d.max() <= 1 + 1e-9


@pytest.mark.parametrize("count", [1 << 16, 1 << 22, 1 << 30])
def test_recall_at_the_threshold(count):
    """Pairs at cosine 0.93 share a cell, unrelated vectors seldom, at each size of labels."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w = rng.normal(size=a.shape)
    w -= (w * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    cells = lattice.Lattice(64, **lattice.shape(count))
    x, z = cells.cells(a), cells.cells(b)
    hit = (x[:, :, :, None] == z[:, :, None, :]).any(axis=(2, 3))
    assert hit.any(axis=1).mean() >= 0.9999
    other = (x[:, :, :, None] == np.roll(z, 1, axis=0)[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    assert other < {1: 0.1, 2: 0.02, 3: 0.005}[cells.width]


def test_awkward_numbers(spark):
    """Vectors in double precision, of numbers whose squares are beyond it, and of repeated and long ones."""
    schema = SCHEMA.replace("float", "double")
    data = [(1, [1e200, 2e200, 0.0], 0, "x"), (2, [1e-200, 2e-200, 0.0], 0, "x"), (3, [1.0, 2.0, 0.001], 0, "x"), (4, [2.0, -1.0, 0.0], 0, "x"), (5, [5e-324, 0.0, 0.0], 0, "x"), (6, [1.0, 0.0, 0.0], 0, "x")]
    data += [(10 + i, [1.0] * 5000 + [float(i)], 7, "x") for i in range(3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark, spark.createDataFrame(data, schema)).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 10: (2, 10), 11: (2, 10), 12: (2, 10)}


def test_null_and_repeated_ids(spark):
    v = [1.0, 2.0, 3.0]
    data = [(None, v, 0, "x"), (1, v, 0, "x"), (1, v, 0, "x"), (2, [2.0, 4.0, 6.0], 0, "x")]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in lattice.near_vectors(spark, spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(-1, 0, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_empty_table(spark):
    assert lattice.near_vectors(spark, spark.createDataFrame([], SCHEMA)).count() == 0
