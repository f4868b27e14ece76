"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one point with a multiplicity. Points are dealt to shards by a hash of their vec_id; a shard holds
at most some ``shard_size`` points, so its graph is built in one task. Every shard's points query every shard (each pair of
shards once, since links have no direction). A query descends the levels greedily and then follows a beam on the lowest
one; the beam of a query that it finds full of links is doubled, up to the whole shard. Before, an audit compares all points
whose id is divisible by 50 with all points exactly, and copies of them planted just above the threshold with their
shard; the beam of all queries is doubled until both, pooled over all pairs of shards, show a recall of ``recall`` or
more. What is found is verified with the cosine in double precision. Each pair of shards gives one row per linked point: its number
of links and its root in the pair's own forest, so that a large group never becomes a list of pairs. Components are those
of the forests together.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors without
vec_id and vectors of different lengths; each keeps its row. Repeated rows are vectors of their own that link with each
other. Columns other than vec_id and embedding play no part. Graphs are files in the shared folder with names of
the task's attempt, of which only those that a finished task reports are read.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shared_dir, written

LINKS, WIDE = 12, 24  # of a point on the upper levels and on the lowest
CANDIDATES = 64
BEAM = 24
AUDITED = 50  # points whose id it divides are audited


def chosen_links(x: np.ndarray, who: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each point of ``who`` up to ``most`` of its candidates ``near`` (nearest first, -1: none) that are nearer to it
    than to any candidate taken before; then, while there is room, the others."""
    n, c = near.shape
    there = near >= 0
    v = x[near]
    to_self = np.einsum("nd,ncd->nc", x[who], v)
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken, count = np.zeros((n, c), bool), np.zeros(n, np.int64)
    closest = np.full((n, c), -2.0, np.float32)  # to any taken one
    for k in range(c):
        ok = there[:, k] & (count < most) & (closest[:, k] < to_self[:, k])
        taken[:, k] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, between[:, k]), closest)
    order = np.argsort(~taken * 2 * c + ~there * 4 * c + np.arange(c), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(there, near, -1), order, 1)


def build_level(x: np.ndarray, points: np.ndarray, most: int, block: int = 256) -> np.ndarray:
    """Links among ``points`` (rows of ``x``) as an array (len(points), most) of rows of ``x``, -1 for none."""
    n = len(points)
    c = min(CANDIDATES, n - 1)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    half = most // 2
    for at in range(0, n, block):
        own = points[at : at + block]
        sim = x[own] @ x[points].T
        sim[np.arange(len(own)), np.arange(at, at + len(own))] = -3
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
        links = chosen_links(x, own, points[near], half)
        out[at : at + len(own), : links.shape[1]] = links
    # The way back, so that what few are near to can be reached as well.
    place = np.full(len(x), -1, np.int32)
    place[points] = np.arange(n)
    for source, targets in enumerate(out[:, :half].tolist()):
        for target in targets:
            if target >= 0:
                row = out[place[target]]
                free = np.flatnonzero(row < 0)
                if len(free) and not (row == points[source]).any():
                    row[free[0]] = points[source]
    # Groups without a link between them get one from each to the next.
    label = np.arange(n)
    src = np.repeat(np.arange(n), most)[out.ravel() >= 0]
    dst = place[out.ravel()[out.ravel() >= 0]]
    label = roots(label, src, dst)
    heads = np.unique(label)
    for a, b in zip(heads, heads[1:], strict=False):
        out[a, -1], out[b, -1] = points[b], points[a]
    return out


def roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label of each connected group of places, for edges ``a``-``b``."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


class Graph:
    """A shard: its points' ids, multiplicities and vectors, and the links of each level."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.ids, self.counts, self.vectors = ids, counts, vectors
        wide = vectors.astype(np.float64)
        self.exact = wide / np.linalg.norm(wide, axis=1, keepdims=True)
        self.x = self.exact.astype(np.float32)
        if levels is None:
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
            height = np.floor(-np.log((mixed.astype(np.float64) + 1) / 2**53) / math.log(LINKS)).astype(int)
            levels = [(np.arange(len(ids), dtype=np.int32), build_level(self.x, np.arange(len(ids)), WIDE))]
            while len(p := np.flatnonzero(height >= len(levels)).astype(np.int32)) >= 2:
                levels.append((p, build_level(self.x, p, LINKS)))
        self.levels = levels

    def save(self) -> bytes:
        out = io.BytesIO()
        more = {f"{k}{i}": v for i, (p, links) in enumerate(self.levels) for k, v in (("p", p), ("l", links))}
        np.savez(out, ids=self.ids, counts=self.counts, vectors=self.vectors, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        levels = [(z[f"p{i}"], z[f"l{i}"]) for i in range(sum(k.startswith("p") for k in z.files))]
        return cls(z["ids"], z["counts"], z["vectors"], levels)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best points found for each query and their cosines; -1 where there are fewer."""
        n = len(self.ids)
        if beam >= n:
            sim = q @ self.x.T
            return np.broadcast_to(np.arange(n, dtype=np.int32), sim.shape), sim
        points, _ = self.levels[-1]
        sim = q @ self.x[points].T
        k = min(8, len(points))
        start = points[np.argpartition(-sim, k - 1, axis=1)[:, :k]]
        for level in range(len(self.levels) - 2, 0, -1):
            start = self._walk(q, start, level, 8)[0]
        return self._walk(q, start, 0, beam)

    def _walk(self, q: np.ndarray, start: np.ndarray, level: int, beam: int, step: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step with each other, ``step`` points of each at a time."""
        points, links = self.levels[level]
        place = np.full(len(self.ids) + 1, -1, np.int32)
        place[points] = np.arange(len(points))
        m, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((m, len(self.ids) + 1), bool)  # the last column takes what isn't there
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -3.0, np.float32)
        done = np.ones((m, beam), bool)
        k = min(beam, start.shape[1])
        ids[:, :k], done[:, :k] = start[:, :k], start[:, :k] < 0
        seen[rows, start] = True
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qd,qkd->qk", q, self.x[ids[:, :k]]), -3)
        active = np.arange(m)
        while len(active):
            open_sims = np.where(done[active], -4, sims[active])
            pick = np.argpartition(-open_sims, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
            live = np.take_along_axis(open_sims, pick, 1) > -3
            some = live.any(1)
            if not some.all():
                active, pick, live = active[some], pick[some], live[some]
                if not len(active):
                    break
            at = active[:, None]
            done[at, pick] = True
            new = links[place[np.where(live, ids[at, pick], points[0])]]
            new = np.where(live[:, :, None], new, -1).reshape(len(active), -1)
            fresh = ~seen[at, new] & (new >= 0)
            seen[at, new] = True
            seen[:, -1] = False
            new = np.where(fresh, new, -1)
            # Repeats within the row: only the first stays.
            order = np.argsort(new, axis=1, kind="stable")
            ranked = np.take_along_axis(new, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
            new = np.where(again, -1, new)
            got = np.where(new >= 0, np.einsum("qd,qkd->qk", q[active], self.x[new]), -3)
            all_sims = np.concatenate([sims[active], got], 1)
            best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], new], 1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], new < 0], 1), best, 1)
        return ids, sims


NEAR = 1e-4  # single precision leaves less doubt than this


def audit(a: Graph, b: Graph, same: bool, threshold: float, beams: list[int], block: int = 512) -> Iterator[tuple[bool, int, int, int]]:
    """How many links of audited queries there are and how many of them each beam finds: (planted, beam, links, found).

    Queries are the points of ``a`` whose id is divisible by 50 and, within a shard, copies of them (of 32 evenly
    placed points where they are fewer) turned away from the original to just above the threshold, so that there is
    something to find in a shard without links as well.
    """
    picked = np.flatnonzero(a.ids % AUDITED == 0)
    kinds = [(False, a.x[picked], picked)]
    if same:
        origin = picked if len(picked) >= 32 else np.linspace(0, len(a.ids) - 1, min(32, len(a.ids))).astype(int)
        x = a.exact[origin]
        away = np.random.default_rng(len(a.ids)).normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(away, axis=1, keepdims=True)
        near = min(1.0, threshold + 0.002)
        kinds.append((True, np.where(norm > 1e-9, near * x + math.sqrt(1 - near * near) * away / np.maximum(norm, 1e-9), x).astype(np.float32), None))
    for planted, queries, own in kinds:
        for at in range(0, len(queries), block):
            q = queries[at : at + block]
            truth = q @ b.x.T >= threshold
            if same and own is not None:
                truth[np.arange(len(q)), own[at : at + block]] = False
            some = truth.any(1)
            q, truth = q[some], truth[some]
            links, hits = int(truth.sum()), 0
            for beam in beams if links else []:
                if hits < links:
                    places = found_of(q, b, threshold, beam)
                    hits = sum(int(row[found].sum()) for row, found in zip(truth, places, strict=True))
                yield planted, beam, links, hits


def pairs_of(a: Graph, b: Graph, threshold: float, beam: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in ``a``, in ``b``) of all verified links that queries of ``a`` find in ``b``, block by block."""
    for at in range(0, len(a.ids), block):
        found = found_of(a.x[at : at + block], b, threshold, beam)
        i = np.repeat(np.arange(at, at + len(found)), [len(f) for f in found])
        j = np.concatenate(found) if len(found) else np.empty(0, np.int32)
        sure = np.concatenate([np.einsum("nd,nd->n", a.exact[i[k : k + 100_000]], b.exact[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)] or [np.empty(0)]) >= threshold
        yield i[sure], j[sure]


def found_of(q: np.ndarray, b: Graph, threshold: float, beam: int) -> list[np.ndarray]:
    """Places in ``b`` of what may link with each query; beams that come back full are doubled."""
    out: list[np.ndarray | None] = [None] * len(q)
    left = np.arange(len(q))
    while len(left):
        ids, sims = b.search(q[left], beam)
        near = (sims >= threshold - NEAR) & (ids >= 0)
        full = (near.sum(1) >= 0.75 * beam) & (beam < len(b.ids))
        for k in np.flatnonzero(~full):
            out[left[k]] = ids[k][near[k]]
        left = left[full]
        beam = beam * 2 if beam * 8 < len(b.ids) else len(b.ids)
    return out


def _rows(a: Graph, b: Graph, same: bool, threshold: float, beam: int) -> pa.RecordBatch | None:
    """One row per linked point of a pair of shards: id, links, root."""
    shift = 0 if same else len(a.ids)
    total = len(a.ids) if same else shift + len(b.ids)
    links, label = np.zeros(total, np.int64), np.arange(total)
    both = np.zeros((len(a.ids), len(a.ids)), bool) if same else None
    for i, j in pairs_of(a, b, threshold, beam):
        if same:
            both[i, j] = True
        else:
            np.add.at(links, i, b.counts[j])
            np.add.at(links, shift + j, a.counts[i])
            label = roots(label, i, shift + j)
    if same:
        both |= both.T
        np.fill_diagonal(both, False)
        for at in range(0, len(both), 256):
            i, j = np.nonzero(both[at : at + 256])
            np.add.at(links, i + at, a.counts[j])
            label = roots(label, i + at, j)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    touched = np.flatnonzero(links)
    if not len(touched):
        return None
    return pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(links[touched]), pa.array(ids[label[touched]])], ["id", "links", "root"])


def near_duplicates(table: DataFrame, threshold: float = 0.95, shard_size: int = 8192, least_shards: int = 8, recall: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and the audit's audited_recall of the links (null: none met)
    and planted_recall, the same in every row."""
    spark = table.sparkSession
    base = shared_dir(spark, "hnsw")
    folder = f"{base}/graphs"
    rows = table.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding")
    sound = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, e -> e is not null and not isnan(e) and abs(e) < double('infinity')) and exists(embedding, e -> e <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    points = written(rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), f"{base}/points")
    shards = max(least_shards, math.ceil(points.count() / shard_size))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        group = group.sort_values("rep")
        graph = Graph(group["rep"].to_numpy(np.int64), group["copies"].to_numpy(np.int64), np.stack(group["embedding"].to_list()))
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(graph.save())
        return pd.DataFrame({"size": [group["size"].iloc[0]], "name": [name], "points": [len(group)]})

    dealt = points.select("rep", "copies", "embedding", F.size("embedding").alias("size"), F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"))
    files = written(dealt.groupBy("size", "shard").applyInPandas(build, "size int, name string, points int"), f"{base}/files")
    # A name for each shard, and shards are bounded in number by the vectors over the shard size.
    of: dict[int, list[str]] = {}
    for r in files.orderBy("size", "name").collect():
        of.setdefault(r["size"], []).append(r["name"])
    numbered = [(size, names) for size, names in of.items()]
    pairs = sum(len(names) * (len(names) + 1) // 2 for _, names in numbered)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Graph, Graph, bool]]:
        """The pairs of shards with the numbers in ``batches``."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        held: dict[str, Graph] = {}

        def get(name: str) -> Graph:
            if name not in held:
                if len(held) >= 2:
                    held.pop(next(iter(held)))
                with system.open_input_file(f"{root}/{name}") as f:
                    held[name] = Graph.load(f.read())
            return held[name]

        for batch in batches:
            for k in batch.column(0).to_pylist():
                for _, names in numbered:
                    own = len(names) * (len(names) + 1) // 2
                    if k < own:
                        break
                    k -= own
                i = (math.isqrt(8 * k + 1) - 1) // 2
                j = k - i * (i + 1) // 2
                yield get(names[j]), get(names[i]), i == j

    tasks = max(1, min(pairs, 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # The last beam is as wide as the largest shard, which is then compared whole.
    widest = files.agg(F.coalesce(F.max("points"), F.lit(0))).first()[0]
    beams = [BEAM]
    while beams[-1] < widest:
        beams.append(beams[-1] * 2)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, same in each(batches):
            if rows := list(audit(a, b, same, threshold, beams)):
                kinds = (pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["planted", "beam", "links", "found"])

    audits = spark.range(0, pairs, 1, tasks).mapInArrow(check, "planted boolean, beam int, links long, found long")
    shares = {(r["planted"], r["beam"]): r["found"] / r["links"] for r in audits.groupBy("planted", "beam").agg(F.sum("links").alias("links"), F.sum("found").alias("found")).collect()}
    beam = next((x for x in beams if min(shares.get((kind, x), 1.0) for kind in (False, True)) >= recall), beams[-1])

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, same in each(batches):
            made = _rows(a, b, same, threshold, beam)
            if made is not None:
                yield made

    found = written(spark.range(0, pairs, 1, tasks).mapInArrow(query, "id long, links long, root long"), f"{base}/found")
    known = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), "hnsw-components").select(F.col("id").alias("rep"), "component")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    state = points.join(counts, "rep", "left").join(known, "rep", "left")
    state = state.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("sound").join(state, "embedding").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    audited = {f"{name}_recall": F.lit(shares.get((kind, beam))).cast("double") for kind, name in ((False, "audited"), (True, "planted"))}
    return linked.unionByName(alone).withColumns(audited)
