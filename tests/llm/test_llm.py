"""Every operator against brute force and on the awkward cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import bpe, components, hnsw, jaccard, line_dedup, packing, quality, sharding, toxicity, vafile, warc

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, n long, label string, batch int"


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "x", 3) for i, t in zip(ids, texts, strict=True)], EXTRA)


def prose(rng, n, words=400):
    pool = ["w%d" % i for i in range(words)]
    return " ".join(rng.choice(pool) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "one", "a b c d", "A B c D", "x " * 4000, "é" * 300, "same line of twenty characters\nother", "Same Line of twenty CHARACTERS  \nmore", "same line of twenty characters", "tail\n"]


# -- line dedup ------------------------------------------------------------------------------------------


def lines_by_hand(rows):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(blanks))
    held = {}
    for n, (i, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= 20:
                held.setdefault(x, []).append((i, n))
    keeper = {k: max(i for i, _ in v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def digest(df):
    return sorted((r["doc_id"], r["_n_lines"], r["_n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(3)
    pool = [prose(rng, 6) + " lineend" for _ in range(30)] + ["É " * 12, "é " * 12, "short"]
    texts = AWKWARD + ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)] + ["\n".join(pool * 40)]
    rows = list(enumerate(texts))
    out = line_dedup.dedup_lines(docs_of(spark, texts), batches=batches, fanout=fanout)
    assert set(out.columns) == set(docs_of(spark, []).columns) | {"_n_lines", "_n_dropped"}
    assert digest(out) == lines_by_hand(rows)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0
    line = "a line that is long enough to count"
    out = line_dedup.dedup_lines(docs_of(spark, [line] * 4, [1, 7, 7, 3]))
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, ""), (3, ""), (7, line), (7, line)]
    assert line_dedup.dedup_lines(docs_of(spark, [None])).first()["text"] is None


def test_line_key_is_one_to_one(spark):
    rng = random.Random(5)
    alphabet = "aAzZ09 éÉßÀàãÃÂâKkİıſsÿŸЖж漢😀\x0b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.line_key(F.col("t")).alias("k")).collect()
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    pairs = {(low(r["t"]), r["k"]) for r in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# -- jaccard -----------------------------------------------------------------------------------------------


def sets_by_hand(text, k=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def groups_by_hand(rows):
    sets = {n: sets_by_hand(t) for n, (_, t) in enumerate(rows)}
    root = {n: n for n in sets}
    links = dict.fromkeys(sets, 0)

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    best = {}
    for n, (i, _) in enumerate(rows):
        best[find(n)] = min(best.get(find(n), i), i)
    return sorted((i, len(sets[n]), best[find(n)], links[n]) for n, (i, _) in enumerate(rows))


def families(rng, many):
    texts = []
    for _ in range(many):
        base = prose(rng, rng.randint(5, 120), 5000).split()
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "edit%d" % rng.randrange(3)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts


def test_jaccard_join(spark, monkeypatch):
    rng = random.Random(8)
    texts = AWKWARD + families(rng, 40) + ["common passage of the corpus " * 3 + prose(rng, 10) for _ in range(20)]
    rows = list(enumerate(texts, 100))
    want = groups_by_hand(rows)
    docs = docs_of(spark, texts, range(100, 100 + len(texts)))
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect())) == want
    # no set follows another, and groups, meetings and matrices of a few sets
    monkeypatch.setattr(jaccard, "ALIKE", 2.0)
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect())) == want
    monkeypatch.setattr(jaccard, "ALIKE", 0.1)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 150)
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect())) == want


def test_links_of_a_meeting_by_hand(monkeypatch):
    rng = np.random.default_rng(2)
    for cells in (8, 1 << 20):
        monkeypatch.setattr(jaccard, "CELLS", cells)
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        some = [np.unique(np.concatenate([base[rng.random(60) < 0.92], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)])) for _ in range(30)]
        for k in (1, 12):
            got = jaccard.links_in(some[:k], some[k:], True)
            for i, a in enumerate(some):
                for j in range(k):
                    assert got[i, j] == (i != j and 100 * len(np.intersect1d(a, some[j])) >= 80 * len(np.union1d(a, some[j])))
            assert not jaccard.links_in(some[:k], some[k:], False)[:k].any()
    assert jaccard.links_in(some[:1], [some[1] + np.uint64(1)], False) is None


def test_jaccard_edges(spark):
    assert jaccard.similar_groups(docs_of(spark, [])).count() == 0
    got = sorted(map(tuple, jaccard.similar_groups(docs_of(spark, ["a b", "A  B", None, "a b", ""], [5, 3, 9, None, 1])).collect()), key=str)
    assert got == sorted([(5, 1, 3, 1), (3, 1, 3, 1), (9, 0, 9, 0), (None, 1, None, 0), (1, 0, 1, 0)], key=str)


def test_needed_overlap_never_exceeds_the_shared_prefix(spark):
    rng = np.random.default_rng(4)
    cases = []
    for _ in range(300):
        n = int(rng.integers(1, 60))
        common = int(rng.integers(0, n + 1))
        a = rng.permutation(1000)[:n]
        b = np.concatenate([a[:common], 1000 + rng.permutation(500)[: int(rng.integers(0, 20))]])
        i, u = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if len(b) and 100 * i >= 80 * u:
            pa_, pb = (np.sort(x)[: jaccard.prefix_length(len(x))] for x in (a, b))
            cases.append((len(a), len(b), len(np.intersect1d(pa_, pb))))
    need = spark.createDataFrame(cases, "n long, m long, c long").where(f"c < {jaccard._needed('n', 'm', 80)}")
    assert cases and need.count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- tokens --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tok():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


TEXTS = ["Hello, World! it's 're", "ΣΑΣ ΟΔΟΣ", "İ ẞ ﬁ", "a\x1cb c\x85d\xa0e", "<|endoftext|>x <|ENDOFTEXT|>", "é ́a", "１２ 3½ Ⅷ", "😀👍🏽 ​﻿", "a\x00b\x00", "x" * 3000 + " y", "!?" * 2000, "한국어 日本語 가"]


def test_bpe_equals_the_library(spark, tok):
    texts = TEXTS + [t for t in AWKWARD if t is not None] + [prose(random.Random(1), 300)]
    rows = {r["doc_id"]: r for r in bpe.encoded(docs_of(spark, [*texts, None]), bpe.vocabulary_path()).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids), t[:40]
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stream_and_bulk_agree(tok):
    b = bpe.Bpe(bpe.vocabulary_path())
    rng = random.Random(7)
    parts = [v.removesuffix("</w>") for v in b.ids if v.isascii() and v.removesuffix("</w>").isalpha()]
    words = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 3, 8, 300, 900]))).lower() for _ in range(60)]
    flat, n = b.encode_words(words)
    at = 0
    for w, k in zip(words, n.tolist(), strict=True):
        ids = flat[at : at + k].tolist()
        at += k
        assert ids == tok.encode(w, add_special_tokens=False).ids
        assert ids == [b.ids[t] for t in b.stream(b._symbols(w))]
    decoder = b.decoder()
    ids = list(b.encode("héllo wörld <|endoftext|>"))
    assert "".join(map(decoder.feed, ids)) + decoder.finish() == b.decoder().feed_all(ids) == tok.decode(ids, skip_special_tokens=False)
    assert b.decoder().feed_all([10**7]) == ""


def test_tokens_come_from_the_transducer_in_bounded_memory(tok):
    b = bpe.Bpe(bpe.vocabulary_path())
    rng = random.Random(9)
    texts = [prose(rng, 200), "a" * 20_000 + " tail", None, "", "ΣΑΣ " + "é" * 5_000, " <|endoftext|> ".join(prose(rng, 40) for _ in range(30))]
    lexicon = bpe.Lexicon(b, b.encode_words)
    got = list(bpe.digests(lexicon, texts, size=100, together=700))
    for t, (n, ids_hash, text_hash) in zip(texts, got, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert (n, ids_hash) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert text_hash == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert "".join(b.pieces(t, 100)) == (t or "")
        assert [w for p in b.pieces(t, 100) for w in b.text_words(p)] == b.text_words(t)
    words = {w for t in texts for w in b.text_words(t)} - set(b.special)
    assert b.emitted == sum(len(tok.encode(w, add_special_tokens=False).ids) for w in words)  # each word once, no other way in
    assert b.widest <= b.block + b.lookahead and b.windows > len(words)


def test_memory_of_words_turns_over(tok):
    b = bpe.Bpe(bpe.vocabulary_path())
    lexicon = bpe.Lexicon(b, b.encode_words, size=5)
    rng = random.Random(1)
    for _ in range(30):
        texts = [prose(rng, 6, 30) for _ in range(3)]
        for t, ids in zip(texts, lexicon.look_up([b.text_words(t) for t in texts]), strict=True):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing(spark, tok):
    rng = random.Random(4)
    texts = TEXTS + AWKWARD + [prose(rng, rng.randint(1, 3000)) for _ in range(60)]
    rows = packing.packed(docs_of(spark, texts), bpe.vocabulary_path(), group=20).toPandas()
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = rows[rows["doc_id"] == i].sort_values("start")
        assert mine["length"].sum() == len(ids) == mine["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(mine["start"], mine["length"], mine["ids_crc32"], strict=True))
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and (s["offset"].to_numpy() == np.concatenate([[0], s["length"].cumsum().to_numpy()[:-1]])).all()
    assert packing.packed(docs_of(spark, []), bpe.vocabulary_path()).count() == 0


def test_first_fit_decreasing_by_hand():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= lengths[i]


# -- vectors -----------------------------------------------------------------------------------------------------


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_vafile(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(700, 8)), 2)
    v[50:80] = v[100]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (1004, [1.0, 2.0], 0), (1005, [float("inf")] * 8, 0)]
    ints = vafile.integer_vectors(vectors_of(spark, rows), "vec_id", "embedding")
    assert ints.count() == 701
    got = sorted(map(tuple, vafile.top_k(ints, ints.where("id % 100 = 0"), candidates=150, per_query_block=3).collect()))
    x = np.floor(1024 * v.astype(np.float32).astype(float)).astype(np.int64)
    want = []
    for q in range(0, 700, 100):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(order)]
    assert got == sorted(want)
    assert vafile.top_k(ints.where("id < 0"), ints.where("id < 0")).count() == 0
    clash = vectors_of(spark, rows).withColumn("cells", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("id", F.lit(-1))
    again = vafile.integer_vectors(clash, "vec_id", "embedding")
    assert sorted(map(tuple, vafile.top_k(again, again.where("id % 100 = 0")).collect())) == got
    twice = ints.where("id IN (100, 101, 102)").unionByName(ints.where("id IN (101, 102)"))
    assert [r["vec_id"] for r in vafile.top_k(twice, twice.where("id = 100")).orderBy("rank").collect()] in ([101, 101, 102, 102], [102, 102, 101, 101])


def test_only_cells_meet_and_few_exact_vectors_are_read(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(rng.normal(size=(3000, 16)))]
    ints = vafile.integer_vectors(vectors_of(spark, rows), "vec_id", "embedding")
    read = []
    real = vafile._scores
    monkeypatch.setattr(vafile, "_scores", lambda c, v, q: (read.append(c.count()), real(c, v, q))[1])
    assert vafile.top_k(ints, ints.where("id % 100 = 0"), candidates=500).count() == 300
    assert sum(read) < 0.05 * 30 * 3000
    bounds = vafile.cell_bounds(ints)
    file = vafile.approximation_file(ints.withColumn("rid", F.col("id")), bounds)
    assert file.columns == ["rid", "id", "dim", "cells"] and {len(r["cells"]) for r in file.select("cells").collect()} == {16}
    few = ints.where("id IN (100, 101)")
    assert few.count() == 2 and vafile.top_k(few, few.where("id = 100")).count() == 1


def test_vafile_large_components(spark):
    rows = [(100, [1e9, -1e9], 0), (1, [1e9, 1e9], 0), (2, [-1e9, 1e9], 0)]
    ints = vafile.integer_vectors(vectors_of(spark, rows), "vec_id", "embedding")
    assert [r["vec_id"] for r in vafile.top_k(ints, ints.where("id = 100")).orderBy("rank").collect()] == [1, 2]


def test_hnsw(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(900, 24))
    near = np.repeat(base[:40], 6, 0) + rng.normal(size=(240, 24)) * 0.08
    v = np.concatenate([base, near, np.repeat(base[50:52], 30, 0)]).astype(np.float32)
    labels = [int(i) for i in rng.integers(0, 3, len(v))]
    rows = [(i, x.tolist(), y) for i, (x, y) in enumerate(zip(v, labels, strict=True))]
    odd = [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, v[0].tolist(), None), (5003, [float("nan")] * 24, 1), (5004, [], 1)]
    out = hnsw.near_duplicates(vectors_of(spark, rows + odd), shard=150, queries=100).toPandas().set_index("vec_id").sort_index()
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None])
    np.fill_diagonal(link, False)
    found = out.loc[: len(v) - 1, "n_links"].to_numpy()
    assert (found <= link.sum(1)).all() and found.sum() >= 0.98 * link.sum()
    lab = np.arange(len(v))
    for _ in range(len(v)):
        new = np.array([min(lab[i], lab[link[i]].min() if link[i].any() else lab[i]) for i in range(len(v))])
        if (new == lab).all():
            break
        lab = new
    assert (out.loc[: len(v) - 1, "component_id"].to_numpy() == lab).mean() > 0.99
    for i in range(5000, 5005):
        assert tuple(out.loc[i, ["n_links", "component_id", "kept"]]) == (0, i, True)
    assert (out["kept"] == (out.index == out["component_id"])).all()
    assert out.loc[: len(v) - 1, "audited_recall"].between(hnsw.MIN_RECALL, 1).all() and out.loc[5000:, "audited_recall"].isna().all()
    twice = hnsw.near_duplicates(vectors_of(spark, rows[:30] + rows[:30] + [(0, rows[1][1], labels[0])]).withColumn("a.b", F.lit(1)).withColumn("part", F.lit("x"))).toPandas()
    assert len(twice) == 61 and (twice["n_links"] >= 1).sum() >= 60


def test_hnsw_empty(spark):
    assert hnsw.near_duplicates(vectors_of(spark, [])).count() == 0


# -- classifiers ---------------------------------------------------------------------------------------------------


def labelled(spark, n=600):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        t = prose(rng, rng.randint(20, 80))
        if bad:
            t = t.upper().replace(" ", "!! ")
        if toxic:
            w = t.split(" ")
            w.insert(rng.randrange(len(w)), rng.choice(["vilefoo", "nastybar"]))
            t = " ".join(w)
        texts.append(t)
        labels.append((i, int(not bad), int(toxic)))
    return texts, labels, spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_hold_out(spark):
    texts, labels, table = labelled(spark)
    docs = docs_of(spark, [*texts, None, "", "z " * 20000], [*range(len(texts)), 9001, 9002, 9003])
    q = {r["doc_id"]: r["_quality"] for r in quality.score_documents(docs, table).collect()}
    t = {r["doc_id"]: r["_toxicity"]["score"] for r in toxicity.score_documents(docs, table).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60
    assert np.mean([(q[i] >= 0.3) == labels[i][1] for i in held]) > 0.95
    assert np.mean([(t[i] >= 0.5) == labels[i][2] for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in [*q.values(), *t.values()]) and {9001, 9002, 9003} <= q.keys() & t.keys()


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["_quality"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    assert {r["_toxicity"]["score"] for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs_of(spark, []), one).count() == 0


def test_block_max_search_is_exact():
    rng = random.Random(3)
    counts = [tuple(sorted((w, rng.randint(1, 3)) for w in rng.sample(range(30), rng.randint(0, 4)))) for _ in range(400)]
    idf = np.array([rng.uniform(1, 5) for _ in range(30)])
    index = toxicity.BlockMaxIndex(idf, counts, list(range(400)), np.array([i % 2 for i in range(400)]), np.ones(400), block=16)

    def dense(c):
        v = np.zeros(30)
        for w, x in index.unit(c):
            v[w] = x
        return v

    table = np.array([dense(c) for c in counts])
    for c in counts[:80]:
        s = np.round(table @ dense(c), 9)
        want = [(s[i], i) for i in sorted(range(400), key=lambda i: (-s[i], i)) if s[i] > 0][:15]
        got = [(x, int(index.ids[at])) for x, at in index.nearest(c, 15)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([x for x, _ in got], [x for x, _ in want])


def test_texts_without_a_telling_term_are_searched_too(spark):
    texts, labels, table = labelled(spark)
    kept = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5][0]
    rare = " ".join(f"seldom{i}" for i in range(40))
    texts[kept] = rare
    docs = docs_of(spark, [*texts, rare, "unheard of"], [*range(len(texts)), 9004, 9005])
    got = {r["doc_id"]: r["_toxicity"]["evidence"] for r in toxicity.score_documents(docs, table).collect()}
    assert got[9004][0]["doc_id"] == kept and got[9004][0]["cosine"] == pytest.approx(1)
    assert got[9005] == []
    no_insult = [i for i, (t, (_, _, toxic)) in enumerate(zip(texts, labels, strict=True)) if not toxic and i != kept]
    assert no_insult and all(len(got[i]) == 15 for i in no_insult)


def test_search_of_many_is_exact_over_all_terms():
    rng = np.random.default_rng(4)
    draw = lambda: tuple(sorted(Counter(np.minimum(rng.zipf(1.3, rng.integers(1, 80)), 900).tolist()).items()))
    counts = [draw() for _ in range(700)]
    counts += counts[:20]
    idf = rng.uniform(1, 5, 901)
    index = toxicity.BlockMaxIndex(idf, counts, list(range(720)), np.arange(720) % 2, np.ones(720), block=16)

    def dense(c):
        v = np.zeros(901)
        for w, n in c:
            v[w] = (1 + np.log(n)) * idf[w]
        return v / np.linalg.norm(v)

    table = np.array([dense(c) for c in counts])
    place = {int(i): at for at, i in enumerate(index.ids)}
    out = [None, place[3]]
    for leave in out:
        asked = [counts[3]] if leave is not None else [draw() for _ in range(150)]
        for c, near in zip(asked, index.nearest_of(asked, 15, None if leave is None else [leave]), strict=True):
            s = np.round(table @ dense(c), 9)
            want = [i for i in sorted(range(720), key=lambda i: (-s[i], i)) if s[i] > 0 and (leave is None or i != 3)][:15]
            assert [int(index.ids[at]) for _, at in near] == want
            assert np.allclose([x for x, _ in near], s[want])


def test_model_travels_without_what_can_be_made_again():
    """The driver and every task hold the sent bytes beside the model."""
    import pickle

    rng = np.random.default_rng(5)
    counts = [np.array(sorted(Counter(np.minimum(rng.zipf(1.4, 120), 5000).tolist()).items()), np.int32) for _ in range(2000)]
    y = np.arange(2000) % 2
    words = [f"word{i}".encode() for i in range(5001)]
    model = toxicity.ToxicityModel(toxicity.Vocabulary(words, 10), list(range(2000)), counts, y, 0.3, rng.integers(1, 900, 5001), 9000)
    sent = pickle.dumps(model, protocol=5)
    assert len(sent) < 0.6 * sum(v.nbytes for v in vars(model.index).values() if isinstance(v, np.ndarray))
    again = pickle.loads(sent)
    assert list(again.vocabulary.number.items()) == list(model.vocabulary.number.items())
    for name, v in vars(model.index).items():
        assert np.array_equal(getattr(again.index, name), v), name
    texts = [" ".join(f"word{i}" for i in rng.zipf(1.4, 50)) for _ in range(70)] + ["", None]
    assert again.judge(texts) == model.judge(texts)
    empty = toxicity.Vocabulary([])
    assert pickle.loads(pickle.dumps(empty)).number == {}


def test_search_spreads_one_text_at_a_time():
    """What a group of texts meets in the index is not held at once."""
    import tracemalloc

    rng = np.random.default_rng(6)
    counts = [np.stack([rng.permutation(400)[:19], rng.integers(1, 4, 19)], 1).astype(np.int32) for _ in range(4000)]
    index = toxicity.BlockMaxIndex(np.ones(400), counts, list(range(4000)), np.arange(4000) % 2, np.ones(4000))
    asked = [np.stack([np.arange(80 * (i % 5), 80 * (i % 5) + 80), np.ones(80)], 1).astype(np.int32) for i in range(toxicity.TOGETHER)]
    met = sum(int(index.many[c[:, 0]].sum()) for c in asked)
    assert 500_000 < met < toxicity.SPREAD
    tracemalloc.start()
    found = index.nearest_of(asked)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 * met
    assert found[7] == index.nearest(asked[7])


# -- sharding, archives ------------------------------------------------------------------------------------------------


def test_sharding(spark):
    texts = [f"text {i % 50}" for i in range(3000)] + AWKWARD
    out = sharding.shard_documents(docs_of(spark, texts)).toPandas()
    assert len(out) == len(texts) and set(out["law"]) == {"key"}
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g))) and 200 < len(g) < 550
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {8} and 200 < len(moved) < 500
    for i, t in enumerate(texts):
        r = out[out["doc_id"] == i].iloc[0]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sharding.shard_documents(docs_of(spark, [])).count() == 0
    again = sharding.shard_documents(docs_of(spark, ["same"] * 5 + ["other"], [7] * 5 + [None])).toPandas()
    assert again["shard"][again["doc_id"] == 7].nunique() == 1 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in again.groupby("shard"))


def test_sharding_by_hand(spark):
    """Each level's draws, worked out anew: the smallest of the shards' exponential draws wins."""
    tree = sharding.shard_tree([1.0, 2.0, 0.5, 1.0, 3.0])
    leaves = [(f"{i // 4}/{i // 2 % 2}/{i}", w) for i, w in enumerate([1.0, 2.0, 0.5, 1.0, 3.0])]
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    hashes = [F.xxhash64(F.lit(p), F.col("k")).alias(f"h{i}") for i, (p, _) in enumerate(leaves)]
    for r in keys.select("k", *hashes, sharding.descend(F.col("k"), tree).alias("s")).collect():
        draws = [-np.log((((r[f"h{i}"] % 2**64) >> 11) + 0.5) / 2**53) / w for i, (_, w) in enumerate(leaves)]
        assert r["s"] == int(np.argmin(draws))


def test_a_further_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(1500).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(*[sharding.descend(F.col("k"), sharding.shard_tree([1.0] * n)).alias(f"n{n}") for n in range(1, 41)]).collect()
    for r in rows:
        for n in range(1, 40):
            assert r[f"n{n + 1}"] in (r[f"n{n}"], n)


def test_sharding_confines_movement(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old, new = sharding.shard_tree([1.0] * 8), sharding.shard_tree([1.0] * 4 + [1.0, 1.0, 3.0, 1.0])
    rows = keys.select(sharding.descend(F.col("k"), old).alias("a"), sharding.descend(F.col("k"), new).alias("b")).where("a <> b").collect()
    assert rows and all(r["b"] >= 4 for r in rows)
    with pytest.raises(ValueError):
        sharding.shard_tree([1.0, 0.0])


def test_warc(spark, tmp_path):
    for compress in (False, True):
        raw = warc.packed_records([("http://a", b"one"), ("http://b", b"two\r\n\r\n"), ("http://c", b"")], compress)
        got = list(warc.parse(raw))
        assert [(g[2]["warc-target-uri"], g[3]) for g in got] == [("http://a", b"one"), ("http://b", b"two\r\n\r\n"), ("http://c", b"")]
        assert got[0][0] == 0 and got[-1][0] + got[-1][1] == len(raw)
    (tmp_path / "x.warc").write_bytes(raw)
    assert warc.read_warc(spark, str(tmp_path / "x.warc")).count() == 3
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))


def test_merkle_audit(spark):
    rows = [(i // 70, i, f"record {i}".encode()) for i in range(300)] + [(9, None, b"x")]
    other = [(f, k, b"rot" if k in (3, 150) else c) for f, k, c in rows if k != 299]
    a, b = (warc.leaves(spark.createDataFrame(r, "f int, k long, c binary"), "f", "k", "c") for r in (rows, other))
    bad = warc.audit(a, b).collect()
    assert sorted(r["key"] for r in bad) == [3, 150, 299]
    assert next(r for r in bad if r["key"] == 299)["replica_offset"] is None
    assert warc.audit(a, a).count() == 0
    empty = warc.leaves(spark.createDataFrame([], "f int, k long, c binary"), "f", "k", "c")
    assert warc.audit(empty, empty).count() == 0
    assert warc.audit(a, empty).count() == 301


def test_merkle_audit_of_lost_added_and_equal_records(spark):
    rows = [(i // 50, i, f"record {i}".encode()) for i in range(200)] + [(9, None, b"x"), (9, None, b"y"), (9, 7, b"p"), (9, 7, b"q"), (9, 7, b"q")]
    other = [r for r in rows if r[1] not in (10, 60)] + [(1, 1000, b"added"), (9, 7, b"q")]
    other = [r for r in other if r != (9, None, b"x")]
    other.remove((9, 7, b"p"))
    a, b = (warc.leaves(spark.createDataFrame(r, "f int, k long, c binary"), "f", "k", "c", fanout=4) for r in (rows, other))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = [(str(r["key"]), r["hash"], r["replica_hash"]) for r in warc.audit(a, b).collect()]
    want = [("10", sha(b"record 10"), None), ("60", sha(b"record 60"), None), ("1000", None, sha(b"added")), ("None", sha(b"x"), None), ("7", sha(b"p"), sha(b"q"))]
    assert sorted(got, key=str) == sorted(want, key=str)
    # a lost record leaves every node but its own path as it was
    low = warc.tree(a)[0].join(warc.tree(b)[0].select(F.col("file"), F.col("starts"), F.col("hash").alias("other")), ["file", "starts"]).where("file = 0 AND hash <> other")
    assert low.count() <= 1


# -- whole operators by hand --------------------------------------------------------------------------------------------


def test_toxicity_scores_by_hand(spark):
    """Counts, weights, neighbours, votes and calibration worked out plainly, on ties, repeats and clashing names."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(3, 40), 60) + (" vile grub" if i % 5 == 0 else "") for i in range(120)]
    texts[30:33] = [texts[31]] * 3
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(100)] + [(5, 0, 1), (6, 0, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*texts, None, "", "zzz"], [*range(120), 900, 901, 902]).withColumn("a.b", F.lit(1)).withColumn("_toxicity", F.lit("mine"))
    with pytest.raises(ValueError):
        toxicity.score_documents(docs, table)
    got = toxicity.score_documents(docs, table, name="_mine")
    assert got.columns == [*docs.columns, "_mine"]
    rows = {r["doc_id"]: r["_mine"] for r in got.collect()}

    by_id = {}
    for i, _, y in labels:
        by_id.setdefault(i, set()).add(y)
    train = [i for i in range(100) if len(by_id[i]) == 1 and by_id[i] <= {0, 1} and zlib.crc32(str(i).encode()) % 5]
    y = np.array([next(iter(by_id[i])) for i in train])
    telling = toxicity.select_terms([texts[i] for i in train], y)
    every = [*texts, "", "", "zzz"]
    vocabulary = set(telling) | {w for i in train for w in toxicity.words_of(texts[i])}

    def held(text):
        out = Counter()
        for w in toxicity.words_of(text):
            for t in dict.fromkeys([w, *[b for b in toxicity.terms_of(w)[1:] if b in set(telling)]]):
                if t in vocabulary:
                    out[t] += 1
        return out

    df = Counter(t for x in every for t in held(x))
    weigh = lambda t: (np.log((len(every) + 1) / (df[t] + 1)) + 1) * (toxicity.TELLING if t in telling else 1)

    def unit(text):
        v = {t: (1 + np.log(n)) * weigh(t) for t, n in held(text).items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = [unit(texts[i]) for i in train]
    base = np.mean([v for i, _, v in labels if v is not None and i is not None and zlib.crc32(str(i).encode()) % 5])
    share = y.mean()
    weight = np.where(y == 1, base / share, (1 - base) / (1 - share))

    def vote(text, leave=None):
        q = unit(text)
        cos = [(-round(sum(x * v.get(t, 0) for t, x in q.items()), 9), train[j], j) for j, v in enumerate(vectors) if j != leave]
        near = [c for c in sorted(cos)[:15] if c[0] < 0]
        if not near:
            return None, []
        w = np.array([weight[j] / (0.05 + 1 + c) for c, _, j in near])
        return float(w @ y[[j for *_, j in near]] / w.sum()), [i for _, i, _ in near]

    votes = np.array([vote(texts[i], j)[0] or 0.0 for j, i in enumerate(train)])
    # isotonic regression by its min-max formula
    places = np.unique(votes)
    mean = lambda a, b: np.average(y[(votes >= a) & (votes <= b)], weights=weight[(votes >= a) & (votes <= b)])
    fitted = [max(min(mean(a, b) for b in places[places >= p]) for a in places[places <= p]) for p in places]
    n = weight.sum()
    steps = (np.array(fitted) * n + base) / (n + 1)
    for i, text in zip([*range(120), 900, 901, 902], every, strict=True):
        v, ids = vote(text)
        assert [e["doc_id"] for e in rows[i]["evidence"]] == ids
        if v is not None:
            assert rows[i]["score"] == pytest.approx(np.interp(v, places, steps), abs=1e-6)
    assert rows[900]["score"] == rows[901]["score"] == rows[902]["score"] and rows[30] == rows[31] == rows[32]
    one = table.where("toxic = 1")
    assert {r["_mine"]["score"] for r in toxicity.score_documents(docs, one, name="_mine").collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), table, name="_mine").count() == 0


def test_quality_scores_by_hand(spark):
    """The weights make the stated loss stationary, the score is the stated line, every row gets the model's score."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(5, 60)) + "." if i % 3 else " ".join("$$ %% 99" for _ in range(rng.randint(3, 40))) for i in range(200)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(150)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [*texts, None, "", texts[1]], [*range(200), 900, 901, 902]).withColumn("a.b", F.lit(1)).withColumn("_quality", F.lit("mine"))
    with pytest.raises(ValueError):
        quality.score_documents(docs, table)
    rows = {r["doc_id"]: r["_q"] for r in quality.score_documents(docs, table, name="_q").collect()}
    model = quality.train(docs, table)
    want = model.score(np.array([quality.features(t) for t in [*texts, "", "", texts[1]]]))
    assert list(rows.values()) == pytest.approx(want.tolist(), abs=1e-12) and rows[900] == rows[901] and rows[902] == rows[1]
    train = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([quality.features(texts[i]) for i in train]), np.array([int(i % 3 > 0) for i in train])
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0)), -6, 6)
    draw = np.random.default_rng(quality.SEED)
    diff = z[draw.choice(np.flatnonzero(y == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(y == 0), quality.PAIRS)]
    p = 1 / (1 + np.exp(diff @ model.weights))
    assert np.abs(-(diff * p[:, None]).mean(0) + quality.L2 * model.weights).max() < 1e-5
    assert model.cut == pytest.approx(np.quantile(z @ model.weights, (y == 0).mean()))
    edge = model.slope * (z @ model.weights - model.cut) + np.log(0.3 / 0.7)
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-edge)))
    # the ranking survives, though the labels are told apart without a fault
    distinct = {tuple(v) for v in z[y == 1].round(9).tolist()}
    assert len({round(s, 12) for s in model.score(x[y == 1]).tolist()}) > 0.9 * len(distinct)


def test_empty_and_null_rows_of_the_rest(spark, tok):
    odd = docs_of(spark, [None, "", "a", "a", "x y " * 30_000], [None, 1, 1, 1, 2]).withColumn("a.b", F.lit(1))
    assert bpe.encoded(odd, bpe.vocabulary_path()).count() == 5
    assert packing.packed(odd, bpe.vocabulary_path()).agg(F.sum("length")).first()[0] == 5 + sum(len(tok.encode(t, add_special_tokens=False).ids) for t in ("", "a", "a", "x y " * 30_000))
    assert sorted(r["shard"] for r in sharding.shard_documents(odd).collect())[0] >= 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    leaves = warc.leaves(pages.select(F.lit(0).alias("file"), "page_id", warc.record(F.col("url"), F.col("html")).alias("raw")), "file", "page_id", "raw")
    assert warc.audit(leaves, leaves).count() == 0
    clash = docs_of(spark, ["one line that is long enough", None]).withColumn("_n_lines", F.lit("x")).withColumn("_n_dropped", F.lit("y")).withColumn("a.b", F.lit(1))
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "__n_lines", "__n_dropped"] and [r["_n_lines"] for r in out.collect()] == ["x", "x"]


def test_a_line_repeated_in_few_documents_is_hot(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 4)
    line = "the same line of more than twenty"
    docs = docs_of(spark, ["\n".join([line] * 50), "\n".join([line] * 60), line, *[f"some line of its own, number {i}" for i in range(40)]])
    lines = line_dedup.hashed_lines(docs)
    hot = line_dedup.counted(lines).where("hot").collect()
    assert [(r["n_docs"], r["max_did"]) for r in hot] == [(3, 2)]
    assert digest(line_dedup.dedup_lines(docs, batches=3)) == lines_by_hand(list(enumerate([r["text"] for r in docs.collect()])))
