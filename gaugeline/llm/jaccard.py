"""N-gram Jaccard self-join with a token-group matrix: exact links of word-shingle sets.

1. Equal sets are one vertex with a multiplicity, kept under the smallest document id; its key is 128 bits of
   the sorted set.
2. Similar sets are partitioned into groups: a set joins the set that most of its sketch's buckets name first.
   A group of many tokens is cut into groups of bounded size, so a family of any size is a few groups.
3. The matrix holds, for each token of a prefix, the groups that have it, the tokens being ordered from rare
   to frequent by one order for all. Tokens of one group alone drop out. A set and a group that share too few
   entries for a link with any size of member never meet; of two groups the smaller one's sets ask.
4. A group that is asked, or has two members, is read once with its asking sets. The group's token union
   bounds each asking set's overlap with any member; only sets whose bound reaches the threshold open the
   group, and are compared with every member on the whole sets. A meeting sends, for each set, the number of
   its links and one edge to its component there, never the pairs.

The order needs the frequent tokens: each task counts its tokens, sends those met at least ``LOCAL`` times
in a block, and at most ``HOT_TOKENS`` of them, the most frequent, are broadcast. A token left out costs
time, never a link, and neither does a set that lands in an unfit group.

Defined cases: null, empty or blank text has no shingles and links with nothing; texts of fewer than k
words are one shingle; a row with a null id links with nothing and has no component; rows that repeat
an id share its component; an empty table gives an empty result; other columns are ignored; texts of any
length are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import bounded_batches, handing_back, read, small_side, written
from gaugeline.llm.components import connected_components

WORDS = 5
PERCENT = 80
#: Buckets that a set's sketch has at most, and the share of its own that must name one set first.
BINS = 10
ALIKE = 0.3
#: Tokens that a prefix holds beyond those that can all differ.
ROOM = 3
#: Tokens and members of a group, and of the sets that meet it at a time, on average.
GROUP_TOKENS = 200_000
GROUP_MEMBERS = 1_000
#: Cells of a meeting's matrix that are held at a time.
CELLS = 4_000_000
HOT_TOKENS = 500_000
LOCAL = 3
#: Partitions over which the rows of a frequent token are spread.
SALTS = 64
#: Tokens that are counted together in a task, and rows of a matrix partition on average.
BLOCK = 1_000_000
#: Documents that a task cuts up together.
TOGETHER = 500
PART_ROWS = 1_500_000
#: Keys whose first halves are equal, at most (none are expected below 10**9 documents).
MAX_CLASHES = 10_000
#: Rows of ``_roles`` that are shipped to every executor at most.
SHIPPED_ROLES = 300_000

_U = np.uint64
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted, distinct 64-bit hashes of the k-word shingles of the whole text, A-Z lowered."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], _U)
    n = len(h) - k + 1
    s = np.zeros(n, _U)
    for i in range(k):
        s = _mix(s + h[i : i + n] * _SEEDS[i % len(_SEEDS)])
    return np.unique(s)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, which bounds what a task holds as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, TOGETHER):
            yield b.slice(at, TOGETHER)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def set_id(s: np.ndarray, clash: frozenset[int] = frozenset()) -> int:
    """A set's number: half of its key, or the other half if two keys have that one."""
    hi, lo = set_key(s)
    return lo if hi in clash else hi


_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], _U)


def sketch(s: np.ndarray) -> list[int | None]:
    """The smallest mixed token of each of ``BINS`` equal ranges of a sorted set; None where it has no token."""
    starts = np.searchsorted(s, _EDGES)
    filled = np.flatnonzero(np.diff(np.append(starts, len(s))))
    out: list[int | None] = [None] * BINS
    for i, m in zip(filled.tolist(), np.minimum.reduceat(_mix(s ^ _SEEDS[0]), starts[filled]).view(np.int64).tolist(), strict=True):
        out[i] = m
    return out


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """The smallest intersection of a set of n with any set at the threshold."""
    return (percent * n + 99) // 100


def prefix_length(n: int, percent: int = PERCENT, room: int = ROOM) -> int:
    return min(n, n - least_overlap(n, percent) + room)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: (doc id, n, key, sketch); of kind 1: (token, count) of a block's frequent tokens."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        met: set = set()

        def frequent() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(held) if held else np.empty(0, _U), return_counts=True)
            t, c = t[c >= LOCAL].view(np.int64), c[c >= LOCAL]
            z = pa.nulls(len(t), pa.int64())
            return pa.record_batch([pa.array(np.ones(len(t), np.int32)), pa.array(t), pa.array(c.astype(np.int64)), z, z, pa.nulls(len(t), pa.list_(pa.int64()))], names=["kind", "id", "n", "hi", "lo", "mins"])

        for b in _slices(batches):
            ids, ns, his, los, mins = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, k)
                hi, lo = set_key(s) if len(s) else (None, None)
                ids.append(doc_id)
                ns.append(len(s))
                his.append(hi)
                los.append(lo)
                mins.append(sketch(s) if len(s) else None)
                if len(s) and (hi, lo) not in met:
                    met.add((hi, lo))
                    held.append(s)
                    size += len(s)
            yield pa.record_batch([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(mins, pa.list_(pa.int64()))], names=["kind", "id", "n", "hi", "lo", "mins"])
            if size >= BLOCK:
                yield frequent()
                held, size = [], 0
                met.clear()
        yield frequent()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "kind int, id long, n long, hi long, lo long, mins array<long>")


def _matrix_rows(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], clash: frozenset[int], k: int, percent: int) -> DataFrame:
    """(token, salt, sid, n): the prefix of each distinct set, its tokens from rare to frequent.

    A task sends a set once. Tokens known as frequent are salted by the set over ``SALTS`` partitions.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = sent.value
        met: set[int] = set()
        for b in _slices(batches):
            out_t, out_s, out_n, out_k = [], [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text, k)
                if not len(s):
                    continue
                sid = set_id(s, clash)
                if sid in met:
                    continue
                met.add(sid)
                p = prefix_length(len(s), percent)
                weight = np.zeros(len(s), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    weight = np.where(tokens[at] == s, counts[at], 0)
                    order = np.lexsort((s, weight))[:p]
                    s, weight, n = s[order], weight[order], len(s)
                else:
                    s, weight, n = s[:p], weight[:p], len(s)
                out_t.append(s)
                out_s.append(np.full(p, sid, np.int64))
                out_n.append(np.full(p, n, np.int64))
                out_k.append(np.where(weight > 0, sid % SALTS, -1).astype(np.int32))
            if out_t:
                yield pa.record_batch([pa.array(np.concatenate(out_t).view(np.int64)), pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_s)), pa.array(np.concatenate(out_n))], names=["token", "salt", "sid", "n"])

    return docs.select("text").mapInArrow(run, "token long, salt int, sid long, n long")


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    """The matrix rows whose token two different sets have, each once.

    Spark sorts a partition, on disk if need be, and a task holds a batch and one row whatever a token's
    count is. Salted tokens are known to be shared.
    """

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone: tuple | None = None  # the last row, if no other set has had its token yet
        seen: tuple[int, int] | None = None  # else the token and set of the last row
        for b in batches:
            t, k, s, n = (c.to_numpy() for c in b.columns)
            if alone is not None:
                t, k, s, n = (np.concatenate([[x], c]) for x, c in zip(alone, (t, k, s, n), strict=True))
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])  # a set that several tasks sent
            if seen is not None:
                keep &= (t != seen[0]) | (s != seen[1])
            t, k, s, n = t[keep], k[keep], s[keep], n[keep]
            if not len(t):
                continue
            shared = k >= 0
            same = t[1:] == t[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            if seen is not None:
                shared |= t == seen[0]
            alone = None if shared[-1] else (t[-1], k[-1], s[-1], n[-1])
            seen = (t[-1], s[-1]) if shared[-1] else None
            yield pa.record_batch([pa.array(t[shared]), pa.array(s[shared]), pa.array(n[shared])], names=["token", "sid", "n"])

    return rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "sid").mapInArrow(run, "token long, sid long, n long")


def _needed(n: str, m: str, percent: int) -> str:
    """SQL for the prefix tokens that sets of n and m share at least if they reach the threshold: the
    overlap that it takes, less what can lie behind the prefixes."""
    behind = [f"greatest(0, ({percent} * {x} + 99) div 100 - {ROOM})" for x in (n, m)]
    return f"greatest(1, ({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent} - greatest({', '.join(behind)}))"


def _needed_between(low: str, high: str, percent: int) -> str:
    """SQL for the least that a set of n shares with a set whose size lies in a range: the need is least
    at an end of it; one less makes up for rounding in between."""
    return f"greatest(1, least({_needed('n', low, percent)}, {_needed('n', high, percent)}) - 1)"


def _grouped(reps: DataFrame) -> DataFrame:
    """``reps`` without sketches, with ``g``: a set's group.

    Each bucket of a sketch names the smallest set in it; a set follows the one that most of its buckets
    name, twice over. Families are cut by a hash so that a group holds about ``GROUP_TOKENS``.
    """
    keyed = reps.select("sid", F.size(F.filter("mins", lambda x: x.isNotNull())).alias("filled"), F.posexplode("mins").alias("i", "m")).where("m IS NOT NULL")
    firsts = keyed.groupBy("i", "m").agg(F.min("sid").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "m", "first")
    votes = keyed.join(firsts, ["i", "m"]).where("sid <> first").groupBy("sid", "first").agg(F.count(F.lit(1)).alias("c"), F.first("filled").alias("filled"))
    follows = votes.where(F.col("c") >= F.greatest(F.lit(1), F.col("filled") * ALIKE)).groupBy("sid").agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("leader"))
    follows = written(follows, "leaders")
    twice = follows.join(follows.select(F.col("sid").alias("leader"), F.col("leader").alias("above")), "leader", "left")
    families = written(twice.select("sid", F.coalesce("above", "leader").alias("family")), "families")
    held = reps.drop("mins").join(families, "sid", "left").withColumn("family", F.coalesce("family", "sid"))
    sizes = held.groupBy("family").agg(F.greatest(F.ceil(F.sum("n") / GROUP_TOKENS), F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS)).alias("blocks")).where("blocks > 1")
    cut = F.when(F.col("blocks").isNull(), F.col("family")).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("sid"), "blocks")))
    return held.join(written(sizes, "large-families"), "family", "left").withColumn("g", cut).drop("family", "blocks")


def _asks(shared: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """(sid, n, h): sets with the other groups that their prefixes let them link with."""
    ranges = written(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most")), "group-sizes")
    rows = written(shared.join(grouped.select("sid", "g"), "sid").join(ranges.select("g", "members"), "g"), "matrix")
    across = rows.groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("token")
    rows = written(rows.join(across, "token"), "matrix-across")
    # a set with fewer tokens across than any link takes is no party to one
    least = F.expr(_needed_between(f"({percent} * n + 99) div 100", f"100 * n div {percent}", percent))
    alive = rows.groupBy("sid", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("sid")
    rows = written(rows.join(alive, "sid"), "matrix-alive")
    columns = rows.groupBy("token", F.col("g").alias("h"), F.col("members").alias("size")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low, high = f"greatest(least, ({percent} * n + 99) div 100)", f"least(most, 100 * n div {percent})"
    met = rows.join(columns, "token").where("members < size OR members = size AND g < h").where(f"{low} <= {high}")
    met = met.groupBy("sid", "n", "h").agg(F.count(F.lit(1)).alias("c"))
    met = met.join(ranges.select(F.col("g").alias("h"), "least", "most"), "h")
    return written(met.where(F.col("c") >= F.expr(_needed_between(low, high, percent))).select("sid", "n", "h"), "asks")


def _roles(grouped: DataFrame, asks: DataFrame) -> DataFrame:
    """(doc_id, sid, copies, h, block, asking): which sets meet in which block of which group's askers."""
    blocks = asks.groupBy("h").agg(F.greatest(F.ceil(F.sum("n") / GROUP_TOKENS), F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS)).alias("blocks"))
    several = grouped.groupBy(F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("h")
    opened = written(several.join(blocks, "h", "full").select("h", F.coalesce("blocks", F.lit(1)).cast("int").alias("blocks")), "opened")
    members = grouped.join(opened.withColumnRenamed("h", "g"), "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("rep", "sid", "copies", F.col("g").alias("h"), "block", F.lit(0).alias("asking"))
    asking = asks.select("sid", "h").join(opened, "h").join(grouped.select("sid", "rep", "copies"), "sid")
    asking = asking.select("rep", "sid", "copies", "h", F.pmod(F.xxhash64("sid"), "blocks").cast("int").alias("block"), F.lit(1).alias("asking"))
    return written(members.unionByName(asking).withColumnRenamed("rep", "doc_id"), "roles")


def _with_sets(docs: DataFrame, roles: DataFrame, clash: frozenset[int], k: int) -> DataFrame:
    """``roles`` with the whole sets, from the documents that take part."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_side(roles, roles.count(), SHIPPED_ROLES), "doc_id")

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s, own = None, np.empty(0, _U), 0
        for b in _slices(batches):
            places, sets = [], []
            for i, (text, sid) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if text != last:
                    last, s = text, shingles(text, k)
                    own = set_id(s, clash) if len(s) else 0
                if len(s) and own == sid:  # else another row with the same id
                    places.append(i)
                    sets.append(s.view(np.int64))
            if places:
                lengths = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                held = [c.take(pa.array(places)) for c in b.columns[1:]]
                yield pa.record_batch([*held, pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(sets)))], names=["sid", "copies", "h", "block", "asking", "s"])

    return found.select("text", "sid", "copies", "h", "block", "asking").mapInArrow(run, "sid long, copies long, h long, block int, asking int, s array<long>")


def links_in(members: list[np.ndarray], askers: list[np.ndarray], own: bool, percent: int = PERCENT) -> np.ndarray | None:
    """Which of the members and the opening askers (rows) link with which member (columns); ``own``: members with
    one another too. None if no set opens the group.

    Askers below the bound that the members' token union sets have no link; their rows stay empty.
    """
    k, many = len(members), len(members) + len(askers)
    sizes = np.array([len(x) for x in (*members, *askers)], np.int64)
    row = np.repeat(np.arange(many), sizes)
    tokens, at = np.unique(np.concatenate([*members, *askers]), return_inverse=True)
    union = np.zeros(len(tokens), bool)
    union[at[: int(sizes[:k].sum())]] = True
    bound = np.bincount(row, weights=union[at], minlength=many).astype(np.int64)
    opens = 100 * bound >= percent * np.maximum(sizes, sizes[:k].min())
    opens[:k] = True
    if not (own and k > 1) and not opens[k:].any():
        return None
    # columns of the matrix: tokens that two of the sets have
    keep = opens[row]
    row, at = row[keep], at[keep]
    keep = (np.bincount(at, minlength=len(tokens)) > 1)[at] & union[at]
    row, at = row[keep], at[keep]
    _, at = np.unique(at, return_inverse=True)
    width = int(at.max()) + 1 if len(at) else 0
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    first = 0 if own else k
    common = np.zeros((many - first, k), np.float32)
    step = max(1, CELLS // many)
    for start in range(0, width, step):
        part = slice(*np.searchsorted(at, [start, start + step]))
        cells = np.zeros((many, min(step, width - start)), np.float32)
        cells[row[part], at[part] - start] = 1
        common += cells[first:] @ cells[:k].T
    common = common.astype(np.int64)
    linked = np.zeros((many, k), bool)
    linked[first:] = 100 * common >= percent * (sizes[first:, None] + sizes[None, :k] - common)
    linked[~opens] = False
    linked[np.arange(k), np.arange(k)] = False
    return linked


def star_edges(linked: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(first, other) places for each component of a matrix of links with its first k rows."""
    out: list[tuple[int, int]] = []
    seen = ~linked.any(1)
    seen[:k] &= ~linked.any(0)
    for v in range(k):
        if seen[v]:
            continue
        seen[v] = True
        edge = np.array([v])
        while len(edge):
            new = linked[:, edge].any(1)
            new[:k] |= linked[edge].any(0)
            asking = np.flatnonzero(new[k:] & ~seen[k:]) + k
            if len(asking):
                new[:k] |= linked[asking].any(0)
            new &= ~seen
            seen |= new
            out += [(v, x) for x in np.flatnonzero(new).tolist()]
            edge = np.flatnonzero(new[:k])
    return out


def _met(roles: DataFrame, percent: int) -> DataFrame:
    """(kind, a, b): kind 0, a set's links with the copies in a meeting; kind 1, an edge of a component."""

    def verdict(members: dict, askers: dict, own: bool) -> Iterator[tuple[int, int, int]]:
        if not members or not (askers or own and len(members) > 1):
            return
        linked = links_in([s for _, s in members.values()], [s for _, s in askers.values()], own, percent)
        if linked is None or not linked.any():
            return
        k, sids = len(members), [*members, *askers]
        copies = np.array([c for c, _ in (*members.values(), *askers.values())], float)
        counts = linked @ copies[:k]
        counts[:k] += copies[k:] @ linked[k:]
        yield from ((0, sids[i], int(counts[i])) for i in np.flatnonzero(counts).tolist())
        yield from ((1, sids[a], sids[b]) for a, b in star_edges(linked, k))

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        sides: tuple[dict, dict] = ({}, {})
        out: list[tuple[int, int, int]] = []

        def batch() -> pa.RecordBatch:
            kinds, a, b = zip(*out, strict=True) if out else ((), (), ())
            out.clear()
            return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        for x in batches:
            sid, copies, h, block, asking = (c.to_pylist() for c in x.columns[:5])
            ends, flat = x.column(5).offsets.to_numpy(), x.column(5).values.to_numpy()
            for i in range(x.num_rows):
                if (h[i], block[i]) != now:
                    if now is not None:
                        out += verdict(*sides, now[1] == 0)
                    now, sides = (h[i], block[i]), ({}, {})
                    if len(out) >= 20_000:
                        yield batch()
                sides[asking[i]][sid[i]] = (copies[i], flat[ends[i] : ends[i + 1]].copy())
        if now is not None:
            out += verdict(*sides, now[1] == 0)
        yield batch()

    dealt = roles.repartition("h", "block").sortWithinPartitions("h", "block", "asking", "sid")
    return dealt.mapInArrow(run, "kind int, a long, b long")


def similar_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; ``n_links``: the other rows linked directly."""
    spark = bounded_batches(docs).sparkSession
    profile = written(_profile(docs, k), "profile")
    sets = profile.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "hi", "lo", "mins")
    distinct = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("mins").alias("mins"))
    distinct = written(distinct, "distinct-sets")
    twice = [r["hi"] for r in distinct.groupBy("hi").count().where("count > 1").select("hi").limit(MAX_CLASHES + 1).collect()]
    if len(twice) > MAX_CLASHES:
        raise RuntimeError("too many keys with equal first halves")
    clash = frozenset(twice)
    reps = distinct.withColumn("sid", F.when(F.col("hi").isin(twice), F.col("lo")).otherwise(F.col("hi")) if twice else F.col("hi"))
    if clash and reps.groupBy("sid").count().where("count > 1").count():
        raise RuntimeError("set numbers are not unique")
    grouped = written(_grouped(reps), "groups")

    total = distinct.agg(F.sum(F.col("n") * (100 - percent) / 100 + ROOM + 1)).first()[0] or 0
    top = profile.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "token").limit(HOT_TOKENS).toPandas()
    tokens, counts = top["token"].to_numpy(np.int64).view(_U), top["c"].to_numpy(np.int64)
    order = np.argsort(tokens)
    parts = max(spark.sparkContext.defaultParallelism, int(total // PART_ROWS) + 1)
    rows = _matrix_rows(docs.where("doc_id IS NOT NULL"), (tokens[order], counts[order]), clash, k, percent)
    shared = written(_shared(rows, parts), "shared")
    roles = _roles(grouped, _asks(shared, grouped, percent))
    found = written(_met(_with_sets(docs, roles, clash, k), percent), "links")

    linked = found.where("kind = 0").groupBy(F.col("a").alias("sid")).agg(F.sum("b").alias("links"))
    component = connected_components(found.where("kind = 1").select("a", "b")).withColumnRenamed("id", "sid")
    final = written(grouped.join(component, "sid", "left").withColumn("component", F.coalesce("component", "sid")).join(linked, "sid", "left"), "final")
    least = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = final.join(least, "component").select("hi", "lo", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("others"))
    out = sets.select("doc_id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(has_id, F.coalesce("others", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d
), n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.rid = c.a JOIN n y ON y.rid = c.b WHERE 100 * c.i >= 80 * (x.n + y.n - c.i)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
least_id AS (SELECT r.a AS rid, min(d.doc_id) AS doc_id FROM reach r JOIN d ON d.rid = r.b GROUP BY r.a),
links AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least_id.doc_id, d.doc_id)) AS component_id, coalesce(links.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (rid) LEFT JOIN least_id USING (rid) LEFT JOIN links USING (rid)
"""
