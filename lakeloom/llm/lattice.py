"""Embedding near-duplicates: lattice hashing on E8, links verified by cosine in double precision.

Each table projects vectors on eight random orthonormal directions, shifts them and decodes them to the nearest E8 lattice
point. A vector enters the cell of that point and those of the next nearest points, so vectors near a wall share a cell.
The vectors of one cell (and label) are compared; a pair counts in the first of the cells that it shares. Equal vectors are one class
before any hashing, and links are counted and joined where they are found: no pair leaves its task but those of a spanning forest.

A label's vectors go to tasks as they are (not cell by cell) and are hashed there: all of them to one task while they are few, each two
blocks of them to one while there are some blocks, and beyond that the cells are dealt over groups and a vector goes to the groups of
its cells. Cells get smaller as labels get larger (``shape``), so that the vectors in a cell stay few at every size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import textkit
from lakeloom.llm.common import Workspace, components, counted_join


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice: a point's nearest neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (integers of even sum, or all halves of even sum) to each row."""

    def d8(y):
        f = np.rint(y)
        e = y - f
        odd = f.sum(axis=1) % 2 != 0
        k = np.flatnonzero(odd)
        j = np.abs(e[k]).argmax(axis=1)
        f[k, j] += np.where(e[k, j] >= 0, 1, -1)
        return f

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(near[:, None], a, b)


class Lattice:
    """Cells of unit vectors: ``tables`` tables, each with the own cell and ``probes`` neighbouring ones.

    A cell is a point of ``width`` copies of E8 side by side; a probe moves one of them. More copies make smaller cells: for
    labels of very many vectors, with more tables to the same recall.
    """

    def __init__(self, dim: int, tables: int, probes: int, scale: float, width: int = 1, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = 8 * width
        self.frames = [np.linalg.qr(rng.normal(size=(max(dim, n), n)))[0][:dim] for _ in range(tables)]
        self.shifts = rng.uniform(0, 1, (tables, n))
        self.step, self.probes, self.width, self.roots = scale / np.sqrt(max(dim, 8)), probes, width, e8_roots()

    def _point(self, p: np.ndarray) -> np.ndarray:
        key = np.zeros(len(p), np.uint64)
        for c in range(8):
            key = textkit.mix(key + (2 * p[:, c]).astype(np.int64).view(np.uint64) * textkit._STEP[c] + textkit.U(1))
        return key

    def cells(self, x: np.ndarray) -> np.ndarray:
        """A 64-bit key for each (row, table, cell)."""
        out = []
        for t, (q, shift) in enumerate(zip(self.frames, self.shifts)):
            y = x @ q / self.step + shift
            choices = []  # for each copy: the own point's key, then its probes'
            for w in range(self.width):
                part = y[:, 8 * w : 8 * w + 8]
                own = decode_e8(part)
                near = [own]
                if self.probes:
                    order = np.argpartition(-((part - own) @ self.roots.T), self.probes, axis=1)[:, : self.probes]
                    near += [own + self.roots[order[:, j]] for j in range(self.probes)]
                choices.append([self._point(p) for p in near])
            base = textkit.mix(np.full(len(x), t + 1, np.uint64))
            picks = [[0] * self.width] + [[j if v == w else 0 for v in range(self.width)] for w in range(self.width) for j in range(1, self.probes + 1)]
            for pick in picks:
                key = base
                for w, j in enumerate(pick):
                    key = textkit.mix(key * textkit.U(3) + choices[w][j])
                out.append(key)
        return np.stack(out, axis=1).reshape(len(x), len(self.frames), -1).view(np.int64)


def shape(count: int) -> dict:
    """The lattice for a label of ``count`` vectors: E8 copies, tables and scale.

    Two vectors at cosine 0.93 share no cell with a chance of some 5 in a million at each of them (measured by a test); two unrelated
    ones share one with a chance of 0.05, 0.005 and 0.001, so that a vector meets a few thousand others at the end of each range.
    """
    if count <= 1 << 16:
        return {"width": 1, "tables": 5, "probes": 3, "scale": 1.76}
    return {"width": 2, "tables": 8, "probes": 3, "scale": 2.2} if count <= 1 << 22 else {"width": 3, "tables": 11, "probes": 3, "scale": 2.6}


def _unit(vectors: list) -> tuple[list[np.ndarray], list[int]]:
    """Unit vectors in double precision and the rows that have one."""
    rows, keep = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and (x != 0).any():
            rows.append(_scaled(x[None])[0])
            keep.append(i)
    return rows, keep


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of finite numbers, not all 0, to length 1."""
    x = x.astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        n = np.sqrt((x * x).sum(axis=1))
        odd = ~np.isfinite(n) | (n < 1e-150)
    if odd.any():
        x[odd] /= np.abs(x[odd]).max(axis=1)[:, None]
        n[odd] = np.sqrt((x[odd] * x[odd]).sum(axis=1))
    return x / n[:, None]


class _Links:
    """Counts of linked vectors, and a forest of the links, of the vectors in one task."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.parent, self.forest = weight, np.zeros(len(weight), np.int64), np.arange(len(weight)), []

    def roots(self) -> np.ndarray:
        root = self.parent
        while (root[root] != root).any():
            root[:] = root[root]
        return root

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.roots()
        up: dict[int, int] = {}  # where former roots have gone in this call

        def top(u):
            path = []
            while (v := up.get(u, u)) != u:
                path.append(u)
                u = v
            for w in path:
                up[w] = u
            return u

        for p, q, u, v in zip(x.tolist(), y.tolist(), root[x].tolist(), root[y].tolist()):
            u, v = top(u), top(v)
            if u != v:
                up[u] = v
                self.forest.append((p, q))
        if up:
            root[list(up)] = list(up.values())

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """The links of x and y, one by one."""
        np.add.at(self.count, x, self.weight[y])
        np.add.at(self.count, y, self.weight[x])
        root = self.roots()
        new = root[x] != root[y]
        self.join(x[new], y[new])

    def add_square(self, p: np.ndarray, q: np.ndarray, mask: np.ndarray) -> None:
        """The links of p and q where ``mask`` says so."""
        self.count[p] += mask @ self.weight[q]
        self.count[q] += mask.T @ self.weight[p]
        while True:  # each row and each column joins its first neighbour of another part, until there is none
            root = self.roots()
            new = mask & (root[p][:, None] != root[q][None, :])
            rows, cols = np.flatnonzero(new.any(axis=1)), np.flatnonzero(new.any(axis=0))
            if not len(rows):
                return
            self.join(np.append(p[rows], p[new[:, cols].argmax(axis=0)]), np.append(q[new[rows].argmax(axis=1)], q[cols]))


class _Cells:
    """The cells of a task's vectors, numbered in order of table and key: ``ids`` (vector, table, cell)."""

    def __init__(self, keys: np.ndarray):
        n, tables, cells = keys.shape
        flat, table = keys.ravel(), np.tile(np.repeat(np.arange(tables), cells), n)
        order = np.lexsort((flat, table))
        new = np.ones(len(order), bool)
        new[1:] = (flat[order[1:]] != flat[order[:-1]]) | (table[order[1:]] != table[order[:-1]])
        run = np.cumsum(new) - 1
        self.ids = np.empty(len(order), np.int64)
        self.ids[order] = run
        self.ids = self.ids.reshape(keys.shape)
        self.vec, self.run, self.start = order // (tables * cells), run, np.append(np.flatnonzero(new), len(order))
        self.key, self.size = flat[order[self.start[:-1]]], np.diff(self.start)

    def members(self, r: int) -> np.ndarray:
        return self.vec[self.start[r] : self.start[r + 1]]

    def first(self, x: np.ndarray, y: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Whether ``cell`` is the first that vectors x and y share."""
        out, table = np.ones(len(x), bool), self.table(x, cell)
        for t in range(int(table.max()) + 1 if len(x) else 0):
            at = np.flatnonzero(out & (table >= t))
            for lo in range(0, len(at), 65_536):
                some = at[lo : lo + 65_536]
                a, b = self.ids[x[some], t], self.ids[y[some], t]
                least = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)
                out[some] = least >= cell[some]
        return out

    def table(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (self.ids[x] == cell[:, None, None]).any(axis=2).argmax(axis=1)

    def shared_before(self, p: np.ndarray, q: np.ndarray, r: int) -> np.ndarray:
        """Which of p and q share a cell before r, as a matrix."""
        a, b = (self.ids[v].reshape(len(v), -1) for v in (p, q))
        cols = np.intersect1d(a[a < r], b[b < r])
        if not len(cols):
            return np.zeros((len(p), len(q)), bool)

        def marks(ids):
            out = np.zeros((len(ids), len(cols)), np.float32)
            at = np.minimum(np.searchsorted(cols, ids), len(cols) - 1)
            rows, places = np.nonzero(cols[at] == ids)
            out[rows, at[rows, places]] = 1
            return out

        return marks(a) @ marks(b).T > 0

    def settled(self, members: np.ndarray, r: int) -> np.ndarray:
        """Which members lie together in one cell before r, the one of most of them: their pairs are known."""
        ids = self.ids[members].reshape(len(members), -1)
        before, count = np.unique(ids[ids < r], return_counts=True)
        return (ids == before[count.argmax()]).any(axis=1) if len(before) else np.zeros(len(members), bool)


def linked(unit: np.ndarray, side: np.ndarray, weight: np.ndarray, lattice: Lattice, least: float, group: int = 0, groups: int = 1, few: int = 48, block: int = 1024) -> _Links:
    """Links of vectors that share a cell of ``group``, of those on different sides, or of all where there is one side.

    Cells of up to ``few`` vectors are compared all at once, pair by pair; those of more in square blocks, without the pairs that an
    earlier cell holds.
    """
    cells, out = _Cells(lattice.cells(unit)), _Links(weight)
    both = bool((side != side[0]).any())
    mine = cells.key.view(np.uint64) % textkit.U(groups) == textkit.U(group)
    vec, run = cells.vec, cells.run
    small = np.flatnonzero(((cells.size <= few) & (cells.size > 1) & mine)[run])
    for d in range(1, int(cells.size[cells.size <= few].max(initial=0))):
        small = small[(small + d < len(run))]
        small = small[run[small] == run[small + d]]
        for lo in range(0, len(small), 65_536):
            at = small[lo : lo + 65_536]
            x, y = vec[at], vec[at + d]
            if both:
                use = side[x] != side[y]
                at, x, y = at[use], x[use], y[use]
            hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            if hit.any():
                x, y = x[hit], y[hit]
                ok = cells.first(x, y, run[at[hit]])
                out.add(x[ok], y[ok])

    def square(p, q, r, same):
        mask = unit[p] @ unit[q].T >= least
        if same:
            mask = np.triu(mask, 1)
        n = int(mask.sum())
        if n > 8 * block:
            mask &= ~cells.shared_before(p, q, r)
            out.add_square(p, q, mask)
        elif n:
            x, y = np.nonzero(mask)
            x, y = p[x], q[y]
            ok = cells.first(x, y, np.full(len(x), r))
            out.add(x[ok], y[ok])

    def compare(left, right, r, same):
        for a in range(0, len(left), block):
            for b in range(a if same else 0, len(right), block):
                square(left[a : a + block], right[b : b + block], r, same and a == b)

    for r in np.flatnonzero((cells.size > few) & mine).tolist():
        members = cells.members(r)
        old = cells.settled(members, r)
        for known in (True, False):  # pairs of a new member with old ones, and with new ones
            if not known:
                left, right = members[~old], members[~old]
            else:
                left, right = members[~old], members[old]
            if not both:
                compare(left, right, r, not known)
                continue
            low, high = side.min(), side.max()
            compare(left[side[left] == low], right[side[right] == high], r, False)
            if known:
                compare(left[side[left] == high], right[side[right] == low], r, False)
    return out


def _compare(least: float, shapes):
    """Members sorted by (label, dim, g, i, j): (rep, links, other), counts of linked vectors and the edges of a forest."""
    made: dict[tuple, Lattice] = {}

    def rows(key, parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        _, dim, g, i, j = key
        whole = pa.Table.from_batches(parts)
        if whole.num_rows < 2:
            return None
        own, rep, w, count, groups = (whole.column(c).to_numpy() for c in ("own", "rep", "w", "count", "groups"))
        if i != j and (own == own[0]).all():
            return None
        how = shapes(int(count[0]))
        lattice = made.setdefault((dim, *how.values()), Lattice(dim, **how))
        unit = _scaled(whole.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        got = linked(unit, own if i != j else np.zeros(len(own), np.int32), w, lattice, least, g, int(groups[0]))
        some = np.flatnonzero(got.count)
        a, b = (np.array([x[c] for x in got.forest], np.int64) for c in (0, 1))
        reps, links = pa.array(np.concatenate((rep[some], rep[a]))), pa.array(np.concatenate((got.count[some], np.zeros(len(a), np.int64))))
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[b])])
        return pa.RecordBatch.from_arrays([reps, links, other], ["rep", "links", "other"])

    def run(it):
        held, key = [], None
        for b in it:
            at = np.stack([b.column(c).to_numpy() for c in ("label", "dim", "g", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                now = tuple(at[lo].tolist())
                if now != key:
                    if held and (out := rows(key, held)) is not None:
                        yield out
                    held, key = [], now
                held.append(b.slice(lo, hi - lo))
        if held and (out := rows(key, held)) is not None:
            yield out

    return run


def _dealt(shapes, most: int):
    """Members of large labels -> a row for each group of cells that the vector has a cell in."""
    made: dict[tuple, Lattice] = {}

    def run(it):
        for b in it:
            dims, counts = b.column("dim").to_numpy(), b.column("count").to_numpy()
            for dim, count in {*zip(dims.tolist(), counts.tolist())}:
                part = b.take(pa.array(np.flatnonzero((dims == dim) & (counts == count))))
                how = shapes(count)
                lattice = made.setdefault((dim, *how.values()), Lattice(dim, **how))
                keys = lattice.cells(_scaled(part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))).reshape(part.num_rows, -1)
                groups = -(-count * keys.shape[1] // most)
                g = np.sort((keys.view(np.uint64) % textkit.U(groups)).astype(np.int64), axis=1)
                new = np.ones(g.shape, bool)
                new[:, 1:] = g[:, 1:] != g[:, :-1]
                out = part.take(pa.array(np.nonzero(new)[0]))
                names = [c for c in out.schema.names if c not in ("g", "groups")]
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in names), pa.array(g[new]), pa.array(np.full(out.num_rows, groups))], [*names, "g", "groups"])

    return run


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = 0.93, shapes=shape, block: int = 32_768, blocks: int = 16) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Linked: labels equal and not null, cosine (double precision) of ``least`` or more. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. n_links counts the other
    vectors linked directly, component_id is the smallest vec_id reachable, kept says whether that is the vector itself.
    Two vectors at cosine 0.93 share no cell with a chance of some 5 in a million; nearer ones less (``shapes``).

    A null vec_id has no links, a null component and is kept. Repeated rows are vectors of their own; of one vec_id
    they have one component. An empty table gives no rows. A task holds two blocks of ``block`` vectors at most; labels of up to
    ``blocks`` blocks are compared block by block, larger ones by groups of cells.
    """
    ws = Workspace(spark, "lattice")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    element = element if element in ("float", "double") else "double"
    kind = f"vec_id long, label long, d1 long, d2 long, dim int, vec array<{element}>"

    def units(it):
        for b in it:
            rows, keep = _unit(b.column("embedding").to_pylist())
            part = b.take(pa.array(keep, pa.int64()))
            u = [np.frombuffer(r.tobytes(), np.uint64) for r in rows]
            d1, d2 = textkit.set_digest([textkit.mix(x + np.arange(len(x), dtype=np.uint64) * textkit._STEP[3])[None] for x in u])
            n = np.fromiter(map(len, rows), np.int32, len(rows))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(d1), pa.array(d2), pa.array(n), part.column("embedding")], [x.split()[0] for x in kind.split(", ")])

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"), F.col("label").cast("long").alias("label"))
    good = ws.save(typed.where("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(units, kind), "units")
    same = ["label", "dim", "d1", "d2"]
    reps = ws.save(good.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec")), "reps")
    sizes = ws.save(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("c")).withColumn("count", F.col("c")), "sizes")
    member = counted_join(reps.select("label", "dim", "rep", "w", "vec"), sizes, ["label", "dim"], reps.count())
    member = member.withColumn("g", F.lit(0).cast("long")).withColumn("groups", F.lit(1).cast("long")).withColumn("nb", F.ceil(F.col("count") / block).cast("int"))
    dealt = member.where(F.col("nb") <= blocks)
    if not sizes.where(F.col("c") > block * blocks).isEmpty():
        large = ws.save(member.where(F.col("nb") > blocks).drop("nb").mapInArrow(_dealt(shapes, block), member.drop("nb").schema), "large")
        held = ws.save(large.groupBy("label", "dim", "g").agg(F.count(F.lit(1)).alias("c")).withColumn("nb", F.ceil(F.col("c") / block).cast("int")), "held")
        dealt = dealt.unionByName(counted_join(large, held, ["label", "dim", "g"], large.count()).select(dealt.columns))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "x")).withColumn("j", F.greatest("own", "x")).drop("x", "nb")
    parts, task = int(spark.conf.get("spark.sql.shuffle.partitions")), ["label", "dim", "g", "i", "j"]
    dealt = dealt.repartition(parts, *task).sortWithinPartitions(*task)
    found = ws.save(dealt.mapInArrow(_compare(least, shapes), "rep long, links long, other long"), "found")
    ws.drop("large", "held")
    label = components(ws, found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    count = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.join(count, "rep", "left").join(label, reps.rep == label.node, "left")
    known = ws.save(known.select(*same, F.col("w").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    whole = counted_join(good.select("vec_id", *same), known, same, good.count()).select("vec_id", "n_links", "component_id")
    lone = typed.where("vec_id IS NULL OR label IS NULL").select("vec_id")
    bad = typed.where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", "embedding").where(_unusable()).select("vec_id")
    lone = lone.unionByName(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = whole.unionByName(lone)
    return ws.finish(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _unusable():
    odd = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return F.expr(f"embedding IS NULL OR size(embedding) = 0 OR {odd} OR NOT exists(embedding, x -> x <> 0)")
