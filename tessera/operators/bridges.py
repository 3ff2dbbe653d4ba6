"""The best k of what queries reach over two bridges, without a row for each query and node that is reached.

A query enters at a few units of its own object and walks, as in objects.bridge_walk, to units of other objects that share
an entity: node n is reached at depth two if some unit u of neither the query's object nor n's holds an entity of a seed and
one of n. So of the units that hold two given entities only the first of each of three objects matter: two objects can be
the query's and n's. That table, `links`, grows with the units. It and the units are stored once. A task has a block of
queries, reads the links of their seeds' entities and the units in batches from the shared folder, and keeps each query's
best k: similarities are matrix products, and whether a unit is reached is told by its entities, for units alone that are
similar enough to be among the best. Paths are looked up for the best alone. Time is the queries times the units; memory and
what is moved are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .objects import BONUS, BRIDGE_WEIGHT, CONFIDENCE, GRAPH, SIMILARITY
from .stored import stored

#: Queries of a task, units that are read at once, queries that are scored at once, a query's units and all pairs that are looked at first and at once.
QUERIES, UNITS, STRIP, PIECE, AT_ONCE = 1024, 32768, 64, 64, 1 << 18
NONE_LOW, NONE_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min
#: Of a query and an entity: a seed holds it; units of one object, or of more, hold it and an entity of a seed.
HELD, ONE, MORE = 1, 2, 4
_OUT = "q long, node long, path array<long>, g double, cos double"
_LINKS = [f"{c}{r}" for c in "ou" for r in range(3)]


def links(units: DataFrame) -> DataFrame:
    """(e, f, o0, o1, o2, u0, u1, u2): the first unit u. of each of the first three objects o. of which a unit holds e and f. units: (id, object, entity), all long."""
    held = units.select("id", "object", "entity").distinct()
    both = held.select("id", "object", F.col("entity").alias("e")).join(held.select("id", F.col("entity").alias("f")), "id")
    each = both.groupBy("e", "f", "object").agg(F.min("id").alias("id"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("e", "f").orderBy("id"))).where("r <= 3")
    return first.groupBy("e", "f").agg(*[F.max(F.when(F.col("r") == r + 1, F.col(c))).alias(f"{n}{r}") for c, n in (("object", "o"), ("id", "u")) for r in range(3)])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the row, value) of all entries of lists; null is empty."""
    column = column.combine_chunks()
    sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _runs(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in rows, place of the entry) of all entries of some rows, of which row i has those from first[i] to first[i + 1]."""
    size = first[rows + 1] - first[rows]
    return np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) + np.repeat(first[rows] - (np.cumsum(size) - size), size)


class _Links:
    """links of a block: by e, and within it by f."""

    def __init__(self, t: pa.Table):
        t = t.sort_by([("e", "ascending"), ("f", "ascending")])
        e = t.column("e").to_numpy()
        f = t.column("f").to_numpy()
        self.entities, self.f = np.unique(f, return_inverse=True)
        cells = lambda c: np.stack([pa.compute.fill_null(t.column(f"{c}{r}"), 0).to_numpy() for r in range(3)], axis=1)
        self.objects, self.firsts = cells("o"), cells("u")
        self.there = np.stack([pa.compute.is_valid(t.column(f"o{r}")).to_numpy() for r in range(3)], axis=1)
        self.low, self.high = np.where(self.there, self.objects, NONE_LOW).min(axis=1, initial=NONE_LOW), np.where(self.there, self.objects, NONE_HIGH).max(axis=1, initial=NONE_HIGH)
        row = np.nonzero(self.there)[0]
        by = np.argsort(self.objects[self.there], kind="stable")
        self.by_object, self.row_of = self.objects[self.there][by], row[by]
        names, start = np.unique(e, return_index=True)
        self.span = dict(zip(names.tolist(), zip(start.tolist(), np.append(start[1:], len(e)).tolist(), strict=True), strict=True))

    def codes(self, entities: np.ndarray) -> np.ndarray:
        """Places in self.entities, one past them where there are none."""
        if not len(self.entities):
            return np.zeros(len(entities), np.int64)
        at = np.minimum(np.searchsorted(self.entities, entities), len(self.entities) - 1)
        return np.where(self.entities[at] == entities, at, len(self.entities))

    def reach(self, seeds: list, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of self.entities: the least and the greatest object, but the query's own, of a unit that holds it and an entity of a seed."""
        low, high = np.full(len(self.entities), NONE_LOW), np.full(len(self.entities), NONE_HIGH)
        x, y = np.searchsorted(self.by_object, [own, own + 1]) if own < NONE_LOW else (0, 0)
        hers = np.unique(self.row_of[x:y])  # links of which the query's own object is one: the others are as they stand
        ok = self.there[hers] & (self.objects[hers] != own)
        rest = np.where(ok, self.objects[hers], NONE_LOW).min(axis=1, initial=NONE_LOW), np.where(ok, self.objects[hers], NONE_HIGH).max(axis=1, initial=NONE_HIGH)
        for e in {e for s in seeds for e in s["ents"] or []}:
            i, j = self.span.get(e, (0, 0))
            a, b = np.searchsorted(hers, [i, j])
            at = self.f[i:j]
            for found, held, other, better in ((low, self.low, rest[0], np.minimum), (high, self.high, rest[1], np.maximum)):
                mine = held[i:j]
                if a < b:
                    mine = mine.copy()
                    mine[hers[a:b] - i] = other[a:b]
                found[at] = better(found[at], mine)
        return low, high

    def between(self, seeds: list, own: int, node_object: int, codes: np.ndarray) -> list | None:
        """[seed, u]: the first way to a unit next to a node that holds the entities of these codes."""
        for s in seeds:
            best = None
            for e in s["ents"] or []:
                i, j = self.span.get(e, (0, 0))
                at = i + np.searchsorted(self.f[i:j], codes)
                at = at[(at < j)]
                at = at[np.isin(self.f[at], codes)]
                ok = self.there[at] & (self.objects[at] != own) & (self.objects[at] != node_object)
                if ok.any():
                    u = int(self.firsts[at][ok].min())
                    best = u if best is None else min(best, u)
            if best is not None:
                return [s["node"], best]
        return None


class _Units:
    """A batch of units, by id."""

    def __init__(self, t: pa.Table, links_of: _Links, dimensions: int):
        t = t.sort_by("id")
        self.ids, self.objects = t.column("id").to_numpy(), t.column("object").to_numpy()
        every = np.arange(t.num_rows + 1)
        row, entity = _flat(t.column("ents"))
        self.codes, self.first = links_of.codes(entity), np.searchsorted(row, every)
        row, self.idx = _flat(t.column("idx"))
        self.val, self.first_val = _flat(t.column("val"))[1], np.searchsorted(row, every)
        self.y = np.zeros((t.num_rows, dimensions), np.float32)
        self.y[row, self.idx] = self.val

    def codes_of(self, j: int) -> np.ndarray:
        return self.codes[self.first[j] : self.first[j + 1]]

    def cosines(self, x: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of rows m of x with units j, to nine digits."""
        pair, at = _runs(self.first_val, j)
        return np.round(np.bincount(pair, weights=x[m[pair], self.idx[at]] * self.val[at], minlength=len(j)), 9)


class _Reach:
    """What a block's queries reach, by entities."""

    def __init__(self, links_of: _Links, q: np.ndarray, own: np.ndarray, seeds: list):
        self.q, self.own, n = q, own, len(links_of.entities)
        self.width = n + 1
        self.state = np.zeros((len(q), n + 1), np.uint8)
        width = max([1, *map(len, seeds)])
        self.seeds = np.array([[s["node"] for s in of] + [i] * (width - len(of)) for i, of in zip(q.tolist(), seeds, strict=True)], np.int64).reshape(len(q), width)
        places, only = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, of in enumerate(seeds):
            low, high = links_of.reach(of, own[m])
            self.state[m, :n] = np.where(low < high, MORE, np.where(low == high, ONE, 0))
            one = np.flatnonzero(low == high)
            places.append(m * self.width + one)
            only.append(low[one])
            held = links_of.codes(np.array(sorted({e for s in of for e in s["ents"] or []}), np.int64))
            self.state[m, held[held < n]] |= HELD
        self.places, self.only = np.concatenate(places), np.concatenate(only)

    def depth(self, m: np.ndarray, u: _Units, j: np.ndarray) -> np.ndarray:
        """2 or 1 hops, or 0 where query m does not get to unit j, or it is the query or a seed."""
        pair, at = _runs(u.first, j)
        code = u.codes[at]
        state = self.state[m[pair], code]
        some = lambda which: np.bincount(pair[which], minlength=len(j)) > 0
        one = some((state & HELD) > 0) & (u.objects[j] != self.own[m])
        alone = np.flatnonzero(state & ONE)
        if len(alone):
            object_ = self.only[np.searchsorted(self.places, m[pair[alone]] * self.width + code[alone])]
            alone = alone[object_ != u.objects[j[pair[alone]]]]
        two = some((state & MORE) > 0) | some(alone)
        own = (u.ids[j] == self.q[m]) | (u.ids[j, None] == self.seeds[m]).any(axis=1)
        return np.where(own, 0, np.where(two, 2, one.astype(int)))


def search(queries: DataFrame, units: DataFrame, k: int, confidence: float, dimensions: int, rows: int = QUERIES, batch: int = UNITS) -> DataFrame:
    """(q, node, path, g, cos): of what bridge_walk reaches in two hops, each query's best k by walk_score, the smaller node of equals, and its seeds.

    queries: (q, object, idx, val, seeds array of (rank, node, ents), by rank), seeds being units of the query's own object;
    units: (id, object, idx, val, ents), no query's unless it is its own row. All ids, objects and entities are long, vectors
    are of length 1 and sparse.
    """
    parts = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    units = stored(units.repartition(parts, "id").select("id", "object", "idx", "val", "ents"))
    files = sorted(units.inputFiles())
    link_files = sorted(stored(links(units.select("id", "object", F.explode("ents").alias("entity"))).select("e", "f", *_LINKS)).inputFiles())
    near = 0.0 + BRIDGE_WEIGHT
    far = near + BRIDGE_WEIGHT / 2
    depth_g = np.array([0.0, near, far])
    above = GRAPH * far + BONUS + CONFIDENCE * confidence  # what a score has at most besides the similarity
    slack = 1e-7 * (dimensions + 16)  # of a product in single precision

    def read(names: list[str]) -> Iterator[pa.RecordBatch]:
        for name in names:
            store, path = fs.FileSystem.from_uri(name)
            with store.open_input_file(path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=batch)

    def batches() -> Iterator[pa.Table]:
        held, size = [], 0
        for b in read(files):
            held.append(b)
            size += b.num_rows
            if size >= batch:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def links_from(entities: set) -> _Links:
        wanted = pa.array(sorted(entities), pa.int64())
        held = [pa.table({c: pa.array([], pa.int64()) for c in ("e", "f", *_LINKS)})]
        for b in read(link_files):
            held.append(pa.Table.from_batches([b.filter(pa.compute.is_in(b.column("e"), value_set=wanted))]))
        return _Links(pa.concat_tables([t.select(held[0].column_names).cast(held[0].schema) for t in held]))

    def run(t: pa.Table) -> pa.Table:
        q, own, seeds = t.column("q").to_numpy(), t.column("object").to_numpy(), t.column("seeds").to_pylist()
        x = np.zeros((len(q), dimensions))
        row, at = _flat(t.column("idx"))
        x[row, at] = _flat(t.column("val"))[1]
        x_small = x.astype(np.float32)
        links_of = links_from({e for of in seeds for s in of for e in s["ents"] or []})
        reach = _Reach(links_of, q, own, seeds)
        n_codes = len(links_of.entities)
        best: list[list] = [[] for _ in q]  # (-score, node, cos, object, codes of its entities, depth)
        starts: list[list] = [[] for _ in q]
        need = np.where(reach.state.any(axis=1), -np.inf, np.inf)  # the similarity that a unit must have to count
        seed_of = np.array([m for m, of in enumerate(seeds) for _ in of], np.int64)
        seed_rank = np.array([r for of in seeds for r in range(len(of))], np.int64)
        seed_ids = np.array([s["node"] for of in seeds for s in of], np.int64)

        def keep(u: _Units, m: np.ndarray, j: np.ndarray) -> None:
            hops = reach.depth(m, u, j)
            m, j, hops = m[hops > 0], j[hops > 0], hops[hops > 0]
            cos = u.cosines(x, m, j)
            score = np.round(SIMILARITY * cos + GRAPH * depth_g[hops] + BONUS + CONFIDENCE * confidence, 9)
            by = np.lexsort((u.ids[j], -score, m))
            place = np.arange(len(by)) - np.searchsorted(m[by], m[by])
            for i in by[place < k].tolist():
                best[m[i]].append((-score[i], int(u.ids[j[i]]), float(cos[i]), int(u.objects[j[i]]), u.codes_of(j[i]), int(hops[i])))
            for i in np.unique(m).tolist():
                best[i] = sorted(best[i], key=lambda r: r[:2])[:k]
                if len(best[i]) == k:
                    need[i] = (-best[i][-1][0] - 1e-8 - above) / SIMILARITY - slack

        for b in batches():
            u = _Units(b, links_of, dimensions)
            n = len(u.ids)
            if not n:
                continue
            at = np.minimum(np.searchsorted(u.ids, seed_ids), n - 1)
            here = np.flatnonzero(u.ids[at] == seed_ids)
            for i, c in zip(here.tolist(), u.cosines(x, seed_of[here], at[here]).tolist(), strict=True):
                starts[seed_of[i]].append((int(seed_ids[i]), c, int(u.objects[at[i]]), u.codes_of(at[i]), int(seed_rank[i])))
            for i in range(0, len(q), STRIP):
                cos = x_small[i : i + STRIP] @ u.y.T
                todo, seen, piece = np.arange(len(cos)), np.full(len(cos), np.inf), PIECE
                while len(todo):  # the most similar first: they raise what others need
                    c, cut = cos[todo] if len(todo) < len(cos) else cos, need[i + todo]
                    if piece < n:
                        much = np.flatnonzero((c >= cut[:, None]).sum(axis=1) > piece)
                        if len(much):
                            cut[much] = np.maximum(cut[much], np.partition(c[much], n - piece, axis=1)[:, n - piece])
                    m, j = np.nonzero((c >= cut[:, None]) & (c < seen[todo, None]))
                    for s in range(0, len(m), AT_ONCE):
                        keep(u, i + todo[m[s : s + AT_ONCE]], j[s : s + AT_ONCE])
                    seen[todo] = cut
                    todo, piece = todo[cut > need[i + todo]], piece * 8
        out = []
        for m in range(len(q)):
            for _, node, c, obj, codes, depth in best[m]:
                if depth == 2:
                    path, g = links_of.between(seeds[m], own[m], obj, codes), far
                else:
                    with_ = set(links_of.entities[codes[codes < n_codes]].tolist())
                    path, g = [next(s["node"] for s in seeds[m] if with_ & set(s["ents"] or []))], near
                out.append((q[m], node, [*path, node], g, c))
            for node, c, obj, codes, r in starts[m]:
                path = links_of.between(seeds[m][:r], own[m], obj, codes)  # a way that begins at a later seed holds this one
                out.append((q[m], node, [node] if path is None else [*path, node], 0.0 if path is None else far, c))
        cells = list(zip(*out, strict=True)) if out else [[] for _ in range(5)]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64()]
        return pa.table([pa.array(list(c), kind) for c, kind in zip(cells, kinds, strict=True)], names=["q", "node", "path", "g", "cos"])

    queries = stored(queries)
    blocks = max(1, -(-queries.count() // rows))
    kind = "array<struct<rank:int,node:long,ents:array<long>>>"
    dealt = queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("blk"), "q", "object", "idx", "val", F.col("seeds").cast(kind).alias("seeds"))
    return dealt.repartition(max(2, blocks), "blk").groupBy("blk").applyInArrow(run, _OUT)
