"""Line deduplication over levelled sorted runs of line hashes.

State is a list of runs on each level. A run is a Parquet table sorted by (h1, h2) that holds, for
each line key, the number of documents, the largest document id seen in its rows, and whether it is hot. A new batch is
counted, merge-anti-joined with the live runs (which drops the keys that a run settles already) and
the rest is added as a level-0 run; when a level holds ``fanout`` runs they are merged into one run of
the next level. Every step is a DataFrame expression, aggregate or join; no Python runs on rows.

Defined cases: null or empty text is one empty line; a line key is the line stripped of ASCII white
space with A-Z lowered; keys of fewer than ``min_chars`` code points never count; each row counts as
one document, and rows that share a document id hold a key together; a null id ranks below all ids;
an empty table gives an empty result; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import BLANKS, fresh, quoted, read, scratch_path, written

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
#: A key is hot in a batch when it holds more than one in this many of the batch's lines, so fewer keys than
#: this are, and fewer than ``batches`` times as many altogether: that bounds the broadcast whatever the
#: input's size. A key that is hot in no batch holds at most one in this many of all lines.
HOT_SHARE = 2_000
_NO_ID = -(2**63)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A one-to-one image of the line's key, for hashing.

    Reading the UTF-8 bytes as Latin-1 and lowering those characters lowers A-Z and turns lead bytes
    C3..DE of two-byte characters into E3..FE. Continuation bytes stay, so the count of them still
    tells which lead byte it was: different keys keep different images.
    """
    stripped = F.trim(line, F.lit(BLANKS))
    return F.lower(F.decode(stripped.cast("binary"), "ISO-8859-1"))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, th, lines: array of (pos, h1, h2)) of the lines whose key is long enough."""
    lines = F.transform(
        split_lines(F.col("text")),
        lambda x, i: F.struct(
            i.alias("pos"),
            F.when(F.char_length(F.trim(x, F.lit(BLANKS))) >= min_chars, line_key(x)).alias("key"),
        ),
    )
    keyed = F.filter(lines, lambda s: s["key"].isNotNull())
    hashes = F.transform(
        keyed,
        lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["key"]).alias("h1"), F.xxhash64(F.lit(1), s["key"]).alias("h2")),
    )
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"),
        hashes.alias("lines"),
    ).where(F.size("lines") > 0)


def counted(lines: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, max_did, hot) of a batch; map-side sums keep a hot key to a row a task.

    A key counts once for each document, and with each of its lines for the test of its heat; only documents
    that repeat a line send their lines a second time.
    """
    total = lines.select(F.sum(F.size("lines"))).first()[0] or 0
    keys = F.transform("lines", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2")))
    each = lines.select("did", keys.alias("all"), F.array_distinct(keys).alias("own"))
    repeats = F.size("all") > F.size("own")
    first = F.transform("own", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), F.lit(1).alias("doc"), F.when(repeats, 0).otherwise(1).alias("line")))
    again = F.transform("all", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), F.lit(0).alias("doc"), F.lit(1).alias("line")))
    rows = each.select("did", F.explode(F.when(repeats, F.concat(first, again)).otherwise(first)).alias("k"))
    sums = rows.groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.sum("k.doc").alias("n_docs"), F.max("did").alias("max_did"), F.sum("k.line").alias("n"))
    return sums.select("h1", "h2", "n_docs", "max_did", (F.col("n") > total / HOT_SHARE).alias("hot"))


def _merge(runs: list[DataFrame]) -> DataFrame:
    both = functools.reduce(DataFrame.unionByName, runs)
    return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_did").alias("max_did"), F.max("hot").alias("hot"))


@dataclass
class LineRuns:
    """The levelled runs in the shared folder; ``add`` takes a batch, ``merged`` gives the totals."""

    spark: SparkSession
    fanout: int = FANOUT
    min_docs: int = MIN_DOCS
    levels: list[list[DataFrame]] = field(default_factory=list)

    def _write(self, run: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "line-run")
        run.select("h1", "h2", "n_docs", "max_did", "hot").sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema("h1 long, h2 long, n_docs long, max_did long, hot boolean").parquet(path)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unsettled(self, batch: DataFrame) -> DataFrame:
        """The batch's counts without the keys that a live run settles already: at least ``min_docs``
        documents there and no smaller id. Keys that are hot in the batch stay, so that their heat is known.
        One merge anti-join with each run; runs are few (fanout a level)."""
        for i, run in enumerate(self.runs()):
            settled = run.where(F.col("n_docs") >= self.min_docs).select(*[F.col(c).alias(f"{c}_{i}") for c in ("h1", "h2", "max_did")])
            batch = batch.join(
                settled.hint("merge"),
                ~batch["hot"] & (batch["h1"] == settled[f"h1_{i}"]) & (batch["h2"] == settled[f"h2_{i}"]) & (settled[f"max_did_{i}"] >= batch["max_did"]),
                "left_anti",
            )
        return batch

    def add(self, batch: DataFrame) -> None:
        """Counts a batch of hashed lines, anti-joins it with the runs, and adds the rest as a run."""
        run = self._write(self.unsettled(counted(batch)))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self._write(_merge(level))
                self.levels[i] = []
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(merged)

    def merged(self) -> DataFrame:
        runs = self.runs()
        return runs[0] if len(runs) == 1 else _merge(runs)


def dropped_lines(lines: DataFrame, totals: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(did, th, drops: positions) of the lines to drop, from hashed lines and merged runs.

    Hot keys, whose number is bounded by the pigeonhole principle, are matched by broadcast; the
    others hold at most a ``HOT_SHARE``-th of the lines each and are matched by a shuffled join.
    """
    repeated = written(totals.where(F.col("n_docs") >= min_docs), "line-repeats")
    hot = F.broadcast(repeated.where("hot").select("h1", "h2", "max_did"))
    cold = repeated.where("NOT hot").select("h1", "h2", "max_did")
    each = lines.select("did", "th", F.explode("lines").alias("l")).select("did", "th", "l.pos", "l.h1", "l.h2")
    later = F.col("did") < F.col("max_did")
    by_hot = each.join(hot, ["h1", "h2"]).where(later)
    by_cold = each.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"]).where(later)
    both = by_hot.select("did", "th", "pos").unionByName(by_cold.select("did", "th", "pos"))
    return both.groupBy("did", "th").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` cut to its kept lines, and ``_n_lines`` and ``_n_dropped`` (``count_names``).

    The rows enter the runs in ``batches`` batches by a hash of the id. Whole texts are shuffled once,
    for the last join on the document.
    """
    spark = docs.sparkSession
    n_lines, n_dropped = count_names(docs)
    hashed = hashed_lines(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("did"), F.lit(batches)).cast("int"))
    lines = written(hashed, "lines", "batch")
    runs = LineRuns(spark, fanout, min_docs)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    drops = dropped_lines(lines, runs.merged(), min_docs)
    rest = [c for c in docs.columns if c != "text"]
    held = docs.select(
        *[F.col(quoted(c)).alias(f"c_{c}") for c in rest],
        F.col("text").isNull().alias("_null"),
        split_lines(F.col("text")).alias("_lines"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"),
    )
    held = held.join(drops, ["did", "th"], "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("_lines")).otherwise(F.transform(keep, lambda i: F.get("_lines", i)))
    text = F.when(~F.col("_null"), F.array_join(kept, "\n"))
    return held.select(
        *[(text if c == "text" else F.col(quoted(f"c_{c}"))).alias(c) for c in docs.columns],
        F.size("_lines").cast("long").alias(n_lines),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(n_dropped),
    )


def count_names(docs: DataFrame) -> tuple[str, str]:
    """The names of the two columns that ``dedup_lines`` adds: with more underscores where the documents have them."""
    return fresh(docs, "_n_lines"), fresh(docs, "_n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT rid) >= 3
), marked AS (
  SELECT keyed.*, (keeper IS NOT NULL AND doc_id <> keeper) AS dropped FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
