"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Equal vectors of a label are one vertex with a multiplicity. A label's vertices are dealt into shards
of bounded size, each shard builds a layered graph, and every vertex queries every shard of its label: a
shard's members come first in its task, then the queries stream past the graph in blocks, so no graph leaves
its task. Before the first query a shard audits its beam: noisy copies of some vertices, and some vertices,
are compared with an exact scan, and the beam is doubled until the mean share of what each probe finds reaches
the target. A query whose hits fill half its beam, as in large groups of copies, is widened to the
whole shard, which is an exact scan; such probes don't count in an audit. Found pairs are verified by cosine in
double precision; a meeting sends one count for each query and the links of a spanning forest, so large groups
never become all their pairs. The lowest audited recall of a label's shards is returned beside its rows.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label or id, link with nothing and are kept as they are; vectors of different lengths
never link; repeated ids are rows of one vertex if their vectors are equal; an empty table gives an empty
result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import read, written
from gaugeline.llm.components import connected_components

MIN_COSINE = 0.93
#: Vertices in a shard on average, and queries that meet its graph at a time: the bounds of a task's memory.
SHARD = 16_384
QUERIES = 2_048
DEGREE = 24
BUILD_BEAM = 48
FIRST_BEAM = 48
MIN_RECALL = 0.98
AUDITS = 64
_STEP = 128


def _diverse(near: np.ndarray, cross: np.ndarray, valid: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (sorted by falling similarity) to link: those nearer to the vertex than to any
    candidate chosen before; the places left go to the nearest others."""
    rows, width = near.shape
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        blocked = (chosen & (cross[:, j, :] > near[:, j, None])).any(1)
        chosen[:, j] = valid[:, j] & ~blocked & (chosen.sum(1) < most)
    room = most - chosen.sum(1)
    rest = valid & ~chosen
    return chosen | (rest & (np.cumsum(rest, 1) <= room[:, None]))


class Hnsw:
    """Layers over prefixes of one random order: layer l holds the first n / DEGREE**l vertices."""

    def __init__(self, vectors: np.ndarray, seed: int = 5) -> None:
        self.order = np.random.default_rng(seed).permutation(len(vectors))
        self.x = np.ascontiguousarray(vectors[self.order], np.float32)
        sizes = [len(self.x)]
        while sizes[-1] > 4 * DEGREE:
            sizes.append(-(-sizes[-1] // DEGREE))
        self.sizes = sizes
        self.layers: list[np.ndarray] = [np.empty((0, 0), np.int32)] * len(sizes)
        for level in range(len(sizes) - 1, -1, -1):
            self._build(level)

    def _build(self, level: int) -> None:
        n, most = self.sizes[level], DEGREE if level else 2 * DEGREE
        links = np.full((n, most), -1, np.int32)
        self.layers[level] = links
        done = min(n, max(_STEP, self.sizes[level + 1] if level + 1 < len(self.sizes) else 0))
        for at in range(0, done, 512):
            sims = self.x[at : min(at + 512, done)] @ self.x[:done].T
            sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -9
            width = min(done - 1, BUILD_BEAM)
            if width > 0:
                cand = np.argsort(-sims, 1, kind="stable")[:, :width].astype(np.int32)
                self._link(links, np.arange(at, at + len(sims)), cand, np.take_along_axis(sims, cand, 1), most)
        while done < n:
            batch = np.arange(done, min(n, done + min(_STEP * 4, max(_STEP, done // 2))))
            q = self.x[batch]
            found, sims = self._beam(q, level, self._entries(q, level), BUILD_BEAM, done)
            own = q @ q.T
            np.fill_diagonal(own, -9)
            width = min(len(batch), 8)
            mates = np.argsort(-own, 1, kind="stable")[:, :width]
            cand = np.concatenate([found, batch[mates].astype(np.int32)], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, mates, 1)], 1)
            order = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
            self._link(links, batch, np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1), most)
            done += len(batch)

    def _choose(self, near: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        valid = (cand >= 0) & (near > -5)
        v = self.x[np.maximum(cand, 0)]
        keep = _diverse(near, v @ v.transpose(0, 2, 1), valid, most)
        order = np.argsort(~keep, 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(cand, order, 1), -1)
        return out.astype(np.int32)

    def _link(self, links: np.ndarray, nodes: np.ndarray, cand: np.ndarray, near: np.ndarray, most: int) -> None:
        mine = self._choose(near, cand, most // 2 if most > DEGREE else most)
        links[nodes, : mine.shape[1]] = mine
        u, j = np.nonzero(mine >= 0)
        to, frm = mine[u, j], nodes[u]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        heads, starts, counts = np.unique(to, return_index=True, return_counts=True)
        if not len(heads):
            return
        width = int(min(counts.max(), most))
        new = np.full((len(heads), width), -1, np.int32)
        for i in range(width):
            has = counts > i
            new[has, i] = frm[starts[has] + i]
        for at in range(0, len(heads), 256):
            h = heads[at : at + 256]
            both = np.concatenate([links[h], new[at : at + 256]], 1)
            sims = np.einsum("ijk,ik->ij", self.x[np.maximum(both, 0)], self.x[h])
            srt = np.sort(both, 1)
            sims[both < 0] = -9
            again = np.zeros(both.shape, bool)  # a link that is there already counts once
            for r in np.flatnonzero(((srt[:, 1:] == srt[:, :-1]) & (srt[:, 1:] >= 0)).any(1)):
                again[r] = True
                again[r, np.unique(both[r], return_index=True)[1]] = False
            sims[again] = -9
            order = np.argsort(-sims, 1, kind="stable")
            picked = self._choose(np.take_along_axis(sims, order, 1), np.take_along_axis(both, order, 1), most)
            links[h, : picked.shape[1]] = picked
            links[h, picked.shape[1] :] = -1

    def _entries(self, q: np.ndarray, level: int) -> np.ndarray:
        """The entry of each query to a layer: an exact scan of the top one, then greedy descents."""
        if level >= len(self.sizes) - 1:
            return np.zeros((len(q), 1), np.int32)
        at = np.argmax(q @ self.x[: self.sizes[-1]].T, 1).astype(np.int32)[:, None]
        for lower in range(len(self.sizes) - 2, level, -1):
            at = self._beam(q, lower, at, 4, self.sizes[lower])[0][:, :1]
        return at

    def _beam(self, q: np.ndarray, level: int, entries: np.ndarray, beam: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best vertices each query finds in a layer, all queries in step."""
        n, links = len(q), self.layers[level]
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, upto + 1), bool)
        seen[:, upto] = True
        ids = np.full((n, beam), -1, np.int32)
        sims = np.full((n, beam), -9, np.float32)
        open_ = np.zeros((n, beam), bool)
        e = entries.shape[1]
        ids[:, :e] = entries
        sims[:, :e] = np.einsum("ijk,ik->ij", self.x[entries], q)
        open_[:, :e] = True
        seen[rows, entries] = True
        active = np.arange(n)
        while len(active):
            score = np.where(open_[active], sims[active], -9)
            take = min(3, beam)
            pick = np.argpartition(-score, take - 1, 1)[:, :take] if beam > take else np.tile(np.arange(beam), (len(active), 1))
            good = np.take_along_axis(score, pick, 1) > -5
            has = good.any(1)
            if not has.all():
                active, pick, good = active[has], pick[has], good[has]
                if not len(active):
                    break
            open_[active[:, None], pick] = False
            frm = np.where(good, ids[active[:, None], pick], -1)
            nxt = np.where(frm[:, :, None] >= 0, links[np.maximum(frm, 0)], -1).reshape(len(active), -1)
            nxt = np.where((nxt >= 0) & (nxt < upto), nxt, upto)
            nxt = np.sort(nxt, 1)
            fresh = ~seen[active[:, None], nxt]
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            width = int(fresh.sum(1).max())
            if not width:
                continue
            order = np.argsort(~fresh, 1, kind="stable")[:, :width]
            nxt, fresh = np.take_along_axis(nxt, order, 1), np.take_along_axis(fresh, order, 1)
            seen[active[:, None], nxt] = True
            got = np.where(fresh, np.einsum("ijk,ik->ij", self.x[np.minimum(nxt, len(self.x) - 1)], q[active]), -9)
            all_ids = np.concatenate([ids[active], nxt.astype(np.int32)], 1)
            all_sims = np.concatenate([sims[active], got], 1)
            all_open = np.concatenate([open_[active], fresh], 1)
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-sims, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the given vectors, similarities) of the beam's best vertices; -1 where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        ids, sims = self._beam(q, 0, self._entries(q, 0), min(beam, self.sizes[0]), self.sizes[0])
        return np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1), sims


def audited_beam(graph: Hnsw, x: np.ndarray, least: float, seed: int = 9) -> tuple[int, float]:
    """The beam with which probes find what an exact scan finds, and the mean share that they found.

    The beam doubles until that share reaches ``MIN_RECALL``; at the shard's size it is an exact scan.
    """
    rng = np.random.default_rng(seed)
    some = x[rng.choice(len(x), min(AUDITS, len(x)), replace=False)]
    noise = rng.normal(size=some.shape)
    noise -= (noise * some).sum(1, keepdims=True) * some
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(least, 1, (len(some), 1))
    probes = np.where(norm > 1e-9, cos * some + np.sqrt(1 - cos**2) * noise / np.maximum(norm, 1e-9), some)
    probes = np.concatenate([probes, x[rng.choice(len(x), min(AUDITS, len(x)), replace=False)]])
    truth = probes @ x.T >= least
    beam = FIRST_BEAM
    while beam < len(x):
        hits, scanned = range_search(graph, x, probes, least, beam)
        shares = [truth[i, h].sum() / truth[i].sum() for i, h in enumerate(hits) if truth[i].any() and not scanned[i]]
        recall = float(np.mean(shares)) if shares else 1.0
        if recall >= MIN_RECALL:
            return beam, recall
        beam *= 2
    return len(x), 1.0


def range_search(graph: Hnsw, x: np.ndarray, q: np.ndarray, least: float, beam: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the places of the vectors with cosine >= ``least`` that it meets, and whether it was
    widened to the whole shard."""
    out: list[np.ndarray] = []
    scanned = np.zeros(len(q), bool)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        ids, sims = graph.search(part, beam)
        near = (sims >= least - 1e-4) & (ids >= 0)
        for i in range(len(part)):
            if beam >= len(x) or near[i].sum() > ids.shape[1] // 2:
                out.append(np.flatnonzero(x @ part[i] >= least))
                scanned[at + i] = True
            else:
                cand = ids[i][near[i]]
                out.append(cand[x[cand] @ part[i] >= least])
    return out, scanned


def _local_links(query_ids: np.ndarray, hits: list[np.ndarray], ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the meeting's links."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for q, h in zip(query_ids.tolist(), hits, strict=True):
        for v in ids[h].tolist():
            a, b = root(q), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((q, v))
    return out


def near_duplicates(vectors: DataFrame, least: float = MIN_COSINE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of a table (vec_id, embedding, label)."""
    x = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"), F.coalesce(usable, F.lit(False)).alias("usable"))
    key = F.when(F.col("usable"), F.sha2(F.concat_ws("|", "label", F.to_json(F.col("x"))).cast("binary"), 256))
    rows = written(rows.withColumn("key", key), "embeddings")
    vertices = written(
        rows.where("usable").groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min_by("label", "vec_id").alias("label"), F.min_by("x", "vec_id").alias("x")),
        "vertices",
    )
    vertices = vertices.withColumn("part", F.concat_ws(":", F.size("x"), "label"))
    sizes = vertices.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = vertices.join(sizes, "part")
    members = dealt.select("part", F.pmod(F.xxhash64("id"), "shards").cast("int").alias("shard"), F.lit(0).alias("asking"), "id", "copies", "x")
    asking = dealt.select("part", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("asking"), "id", "copies", "x")
    found = written(_meetings(members.unionByName(asking), least, queries), "near")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others"))
    audits = found.where("kind = 2").groupBy("part").agg((F.min("b") / 1e6).alias("audited_recall"))
    groups = connected_components(found.where("kind = 1").select("a", "b"))
    known = vertices.select("key", "id", "copies", "part").join(counts, "id", "left").join(groups, "id", "left").join(audits, "part", "left")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component", "id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("others") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        "audited_recall",
    )


def _meetings(roles: DataFrame, least: float, block: int) -> DataFrame:
    """(kind, part, a, b): kind 0, a query's links with the copies in a shard; kind 1, a link of the spanning
    forest; kind 2, a shard's audited recall in millionths (b) and beam (a)."""

    class Shard:
        def __init__(self, part: str) -> None:
            self.part, self.graph = part, None
            self.ids: list[int] = []
            self.copies: list[int] = []
            self.x: list[np.ndarray] = []
            self.asked: list[tuple[int, np.ndarray]] = []

        def answers(self) -> Iterator[tuple[int, str, int, int]]:
            if not self.ids or not self.asked:
                return
            if self.graph is None:
                self.at, self.n = np.array(self.ids, np.int64), np.array(self.copies, np.int64)
                self.v = _unit(np.array(self.x))
                self.x.clear()
                self.graph = Hnsw(self.v)
                self.beam, recall = audited_beam(self.graph, self.v, least)
                yield 2, self.part, self.beam, int(recall * 1e6)
            mine = np.array([i for i, _ in self.asked], np.int64)
            hits, _ = range_search(self.graph, self.v, _unit(np.array([x for _, x in self.asked])), least, self.beam)
            self.asked.clear()
            hits = [h[self.at[h] != i] for h, i in zip(hits, mine, strict=True)]
            yield from ((0, self.part, int(i), int(self.n[h].sum())) for h, i in zip(hits, mine, strict=True) if len(h))
            yield from ((1, self.part, a, b) for a, b in _local_links(mine, hits, self.at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Shard("")

        def batch() -> pa.RecordBatch:
            out = list(held.answers())
            kind, part, a, b = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.record_batch([pa.array(kind, pa.int32()), pa.array(part, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "part", "a", "b"])

        for rows in batches:
            part, shard, asking, ids, copies = (c.to_pylist() for c in rows.columns[:5])
            ends, flat = rows.column(5).offsets.to_numpy(), rows.column(5).values.to_numpy(zero_copy_only=False)
            for i in range(rows.num_rows):
                if (part[i], shard[i]) != now:
                    yield batch()
                    now, held = (part[i], shard[i]), Shard(part[i])
                x = flat[ends[i] : ends[i + 1]].astype(float)
                if asking[i]:
                    held.asked.append((ids[i], x))
                    if len(held.asked) >= block:
                        yield batch()
                else:
                    held.ids.append(ids[i])
                    held.copies.append(copies[i])
                    held.x.append(x)
        yield batch()

    dealt = roles.repartition("part", "shard").sortWithinPartitions("part", "shard", "asking", "id")
    return dealt.mapInArrow(run, "kind int, part string, a long, b long")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # first by the largest component, whose square may overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
