import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pack_what_is_left(spark, tmp_path):
    from gaugeline.llm.common import read

    docs = read(spark, SF, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for i, (_name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] >= counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(3, text), (1, text), (2, text + " more"), (7, "other text of its own kind here"), (7, "other text of its own kind here"), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 8]


def _read(spark, sf):
    from gaugeline.llm.common import read

    return read(spark, sf, "documents"), read(spark, sf, "labels")


def test_each_stage_by_hand(spark, tmp_path):
    """Every stage on what its predecessor kept, against plain Python."""
    import hashlib

    import numpy as np

    from gaugeline.llm import bpe, quality, toxicity
    from tests.llm.test_llm import groups_by_hand, lines_by_hand

    tokenizers = pytest.importorskip("tokenizers")
    docs, labels = _read(spark, SF)
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in now.select("doc_id", "text").collect()]
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = after.count()
        if name == "quality":
            score = quality.train(now, labels).score(np.array([quality.features(t) for _, t in before]))
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for (i, _), s in zip(before, score, strict=True) if s >= quality.THRESHOLD)
        elif name == "toxicity":
            found = toxicity.train(now, labels).judge([t for _, t in before])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for (i, _), (s, _) in zip(before, found, strict=True) if s < toxicity.THRESHOLD)
        elif name == "line_dedup":
            want = sorted((i, h) for i, _, _, h in lines_by_hand(before))
            rows = after.collect()
            assert sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in rows) == want
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None and r["n_chars"] is not None)
        elif name == "near_duplicates":
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, _, c, _ in groups_by_hand(before)})
        else:
            tok = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
            n = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before}
            assert {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == n
        now = after


def test_stages_on_awkward_rows(spark):
    docs, _ = _read(spark, SF)
    long = "word of a very long text " * 20_000
    rows = [(None, None), (-1, None), (-2, ""), (-3, long), (-3, long), (-4, "a"), (-4, "b")]
    odd = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], docs.schema)
    clash = docs.limit(60).unionByName(odd)
    for name in ("a.b", "_quality", "_toxicity", "_n_lines", "_n_dropped", "component_id", "did", "n"):
        clash = clash.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns, name
        got = out.collect()
        assert all(r[c] == c for r in got for c in ("a.b", "_quality", "_toxicity", "_n_lines", "_n_dropped", "component_id", "did", "n"))
        if name == "line_dedup":
            assert len(got) == clash.count()
        assert stage(spark, clash.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, clash, SF).select("doc_id").distinct().count() == 60 + 5
    assert corpus_pipeline.STAGES[-1][1](spark, clash.limit(0), SF).count() == 0
