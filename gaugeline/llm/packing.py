"""First-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids, closed by an end id, are cut into full sequences and one remainder. Remainders are
dealt by hash into groups of about ``GROUP`` pieces; each group is packed on its own: longest piece
first, each into the first bin with room, found by walking down a tree whose nodes hold the largest
room below them.

Defined cases: null text is the empty text, so the document is its end id alone; equal rows are packed
as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.bpe import TOGETHER, Bpe, Lexicon, vocabulary_path
from gaugeline.llm.common import bounded_batches, handing_back, read, written

SEQUENCE = 2_048
END_ID = 1
#: Pieces in a group on average; bounds a packing task's memory.
GROUP = 20_000


class TournamentTree:
    """Bins from left to right; a node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> int:
        """Takes ``length`` from the first bin that has it, and gives its number; -1 if none has."""
        room, node = self.room, 1
        if room[1] < length:
            return -1
        while node < self.size:
            node *= 2
            if room[node] < length:
                node += 1
        at = node - self.size
        room[node] -= length
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
        return at


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each length; equal lengths in the order given."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tree = TournamentTree(max(1, n), capacity)
    filled = np.zeros(max(1, n), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        b = tree.place(int(lengths[i]))
        bins[i], offsets[i] = b, filled[b]
        filled[b] += lengths[i]
    return bins, offsets


@functools.lru_cache(maxsize=1)
def _lexicon(path: str) -> Lexicon:
    """A worker's memory of words, kept from task to task.

    New words go to the tokenizers library together, as one text: it drops the spaces between them, and
    the end-of-word mark of their last tokens tells them apart. Words come normalised and cut by the
    tokenizer file's own rules, so the library has only to split at spaces and to merge.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    bpe = Bpe(path)
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    tok.normalizer = None
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(max(bpe.token) + 1, bool)
    ends[[i for t, i in bpe.ids.items() if t.endswith(bpe.suffix)]] = True

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(words), 200):
            some = words[at : at + 200]
            if not bpe.special.keys().isdisjoint(some):
                flat, n = bpe.encode_words(some)
            else:
                flat = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
                n = np.diff(np.flatnonzero(ends[flat]), prepend=-1)
                if len(n) != len(some):
                    raise RuntimeError("the tokenizer does not keep words apart")
            ids.append(flat)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes)

    return Lexicon(bpe, encode)


def pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row): each document's ids cut at the sequence length."""
    end = np.array([end_id], "<u4").tobytes()

    @handing_back
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(path)
        row = 0
        for b in batches:
            for at in range(0, len(b), TOGETHER):
                part = b.iloc[at : at + TOGETHER]
                out: list[tuple] = []
                for doc_id, got in zip(part["doc_id"].tolist(), lexicon.look_up([lexicon.bpe.text_words(t) for t in part["text"]]), strict=True):
                    ids = got.astype("<u4").tobytes() + end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc_id, start, len(cut) // 4, zlib.crc32(cut), n, row))
                        row += 1
                frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long"
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, kinds)


def packed(docs: DataFrame, path: str, capacity: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """One row per piece with its sequence and offset."""
    cut = written(pieces(docs, path, capacity), "pieces")
    groups = max(1, -(-cut.count() // group))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(g["length"].to_numpy(np.int64), capacity)
        first = int(g["group"].iloc[0]) << 32
        return pd.DataFrame({c: g[c].astype("Int64") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": first + bins, "offset": offsets})

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)))
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(pack, kinds)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"), vocabulary_path())
