"""Byte-pair encoding as a streaming transducer with bounded lookahead, and an incremental decoder.

A merge list decides how far to the right a token can depend on its text. A rule (x, y) is pre-empted
only by an earlier rule whose left part is a right-hand part of y, which in turn only by a still
earlier one, and so on; the longest such chain, in symbols, is a sufficient lookahead. The encoder
keeps a window of at most that many symbols beyond a block, merges the window, emits the tokens
that end before the lookahead, and goes on behind them: a word of any length takes constant memory. The end
of a word stands for all the lookahead there is, so the last window of a word is emitted whole; most words
have one window only. ``encode_words`` takes a step of many words at a time: each round holds one window of
each word that is not yet through.

Texts are read in pieces of about ``PIECE`` characters, cut before white space; a piece's words, ids and
decoded text are let go before the next batch of pieces, and hashes, counts and the decoder's state are all
that a document keeps, however long it is. Only a run without white space is held whole.

Texts are prepared as the tokenizer file says: special tokens are found in the raw text, the rest is
NFC-normalised, lower-cased character by character, cut into words by the file's pattern, and each
word's bytes are written with the byte alphabet, the last one with the end-of-word mark.

The decoder takes ids one by one: it turns each into bytes, and a UTF-8 state machine gives out the
text that is complete. Files without a decoder have their token strings joined by spaces.

Defined cases: null text is the empty text and has no ids; lone surrogates can't occur in Spark
strings; repeated rows and null ids each get a row; an empty table gives an empty result; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import importlib.util
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import bounded_batches, read

#: Folder of the public tokenizer files; a parameter of everything that reads one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 150_000
#: Symbols of the widest window that is merged together with others, a step of every window at a time.
TABLE = 48
#: Characters of a piece of text on average, and of the pieces that are looked up together.
PIECE = 1 << 16
TOGETHER_CHARS = 1 << 20
#: Documents that packing looks up together.
TOGETHER = 400
_NO_RANK = 1 << 40
_CUT = re.compile("[ \t\n\r][0-9A-Za-z]")
_SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def vocabulary_path(name: str = VOCABULARY, folder: str = TOKENIZERS) -> str:
    """Where a tokenizer file lies: by the ``public_tokenizers`` package if installed, else in the folder."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"{folder}/{name}"


def byte_alphabet() -> list[str]:
    """The printable character of each byte, by the usual rule: printable Latin-1 as it is, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols to the right of a token's end that can change it: the longest chain of pre-empting rules."""
    parts = {a + b: (a, b) for a, b in reversed(merges)}

    @functools.cache
    def spine(token: str) -> tuple[str, ...]:
        """The token and the right-hand parts inside it, which a rule to its right may take."""
        return (token, *(spine(parts[token][1]) if token in parts else ()))

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 5_000))
    reach: dict[str, int] = {}
    longest = 0
    for left, right in merges:  # by rank, so only earlier rules have been entered
        chain = length(right) + max((reach.get(t, 0) for t in spine(right)), default=0)
        reach[left] = max(reach.get(left, 0), chain)
        longest = max(longest, chain)
    return longest


class Bpe:
    """A tokenizer file's ids, by own code."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern.replace("\\s", _SPACES))
        # the same pattern with its classes spelt out for lower-case ASCII
        self.plain = re.compile(pattern.replace("[\\p{L}]", "[a-z]").replace("[\\p{N}]", "[0-9]").replace("\\s", "\\t-\\r ").replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"))
        self.alphabet = byte_alphabet()
        self._raw: dict[int, bytes] = {}
        self.byte_of = {c: b for b, c in enumerate(self.alphabet)}
        self.decodes_bytes = bool(spec.get("decoder"))
        keys = np.array([(self.ids[a] << 20) + self.ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank_of = keys[order], order.astype(np.int64)
        self._result = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self._base = np.array([self.ids[c] for c in self.alphabet], np.int64)
        self._base_end = np.array([self.ids[c + self.suffix] for c in self.alphabet], np.int64)
        self._name = {i: s for s, i in self.ids.items()}
        self._length = np.zeros(max(self.token) + 1, np.int64)
        for s, i in self.ids.items():
            self._length[i] = len(s.removesuffix(self.suffix) if self.suffix else s)
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.suffix) if self.suffix else t))
        self.block = max(256, self.lookahead)
        #: What went through the transducer: windows, their widest, and tokens given out.
        self.windows = self.widest = self.emitted = 0

    def _merged(self, symbols: list[str]) -> list[str]:
        """The merges in rank order, leftmost first, on a linked list with a heap of pairs."""
        n = len(symbols)
        s: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or rank.get((s[i], s[j])) != r:
                continue
            s[i] += s[j]
            s[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank.get((s[i], s[after[i]]))) is not None:
                    heapq.heappush(heap, (q, i))
            if before[i] >= 0 and (q := rank.get((s[before[i]], s[i]))) is not None:
                heapq.heappush(heap, (q, before[i]))
        return [x for x in s if x is not None]

    def _symbols(self, word: str) -> Iterator[str]:
        raw = word.encode("utf-8")
        for b in raw[:-1]:
            yield self.alphabet[b]
        yield self.alphabet[raw[-1]] + self.suffix

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one word's symbols, each given out once no further symbol can change it."""
        window: list[str] = []
        for x in symbols:
            window.append(x)
            if len(window) >= self.block + self.lookahead:
                limit, used = len(window) - self.lookahead, 0
                for token in self._merged(window):
                    size = len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)
                    if used + size > limit:
                        break
                    yield token
                    used += size
                window = window[used:]
        yield from self._merged(window)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of many words, all through the transducer: in each round every
        word that is not through merges its next window and gives out its stable tokens."""
        raws = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raws], np.int64)
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # words, their ids before, numbers of ids, ids
        if self.special and not self.special.keys().isdisjoint(words):
            which = np.array([i for i, w in enumerate(words) if w in self.special], np.int64)
            counts[which] = 1
            parts.append((which, np.zeros(len(which), np.int64), np.ones(len(which), np.int64), np.array([self.special[words[i]] for i in which.tolist()], np.int64)))
        live = np.flatnonzero((counts == 0) & (sizes > 0))
        live = live[np.argsort(sizes[live], kind="stable")]
        at, span = np.zeros(len(words), np.int64), self.block + self.lookahead
        while len(live):
            for few in np.split(live, range(20_000, len(live), 20_000)):
                widths = np.minimum(sizes[few] - at[few], span)
                ended = at[few] + widths == sizes[few]
                self.windows += len(few)
                self.widest = max(self.widest, int(widths.max()))
                ids, n = self._merge_windows([raws[i][a : a + w] for i, a, w in zip(few.tolist(), at[few].tolist(), widths.tolist(), strict=True)], widths, ended)
                if not ended.all():
                    # a token is stable if all that it can depend on lies in the window
                    own = np.repeat(np.arange(len(few)), n)
                    ends = np.cumsum(self._length[ids])
                    ends -= np.repeat(np.concatenate([[0], ends])[np.cumsum(n) - n], n)
                    stable = ended[own] | (ends <= (widths - self.lookahead)[own])
                    ids, n = ids[stable], np.bincount(own[stable], minlength=len(few))
                    at[few] += np.bincount(own[stable], weights=self._length[ids], minlength=len(few)).astype(np.int64)
                parts.append((few, counts[few], n, ids))
                counts[few] += n
                at[few] = np.where(ended, sizes[few], at[few])
                self.emitted += len(ids)
            live = live[at[live] < sizes[live]]
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for which, before, n, ids in parts:
            flat[ranges(starts[which] + before, n)] = ids
        return flat, counts

    def _merge_windows(self, raws: list[bytes], lengths: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of windows in rising order of width; ``ended`` ones close their word."""
        narrow = int(np.searchsorted(lengths, TABLE, "right"))
        ids, counts = self._merged_all(raws[:narrow], lengths[:narrow], ended[:narrow]) if narrow else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest = [[self.ids[s] for s in self._merged([*map(self.alphabet.__getitem__, r[:-1]), self.alphabet[r[-1]] + self.suffix * bool(e)])] for r, e in zip(raws[narrow:], ended[narrow:], strict=True)]
        return np.concatenate([ids, *(np.array(x, np.int64) for x in rest)]), np.concatenate([counts, np.array([len(x) for x in rest], np.int64)])

    def _merged_all(self, raws: list[bytes], lengths: np.ndarray, ended: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's best-ranked, leftmost pair is merged in each step until no window has one."""
        width = int(lengths.max())
        cells = np.array(raws, dtype=f"S{width}").view(np.uint8).reshape(len(raws), width)
        m = self._base[cells].astype(np.int64)
        rows = np.arange(len(raws))
        m[rows[ended], lengths[ended] - 1] = self._base_end[cells[rows[ended], lengths[ended] - 1]]
        m[np.arange(width) >= lengths[:, None]] = -1
        done, left = m.copy(), lengths.copy()
        if width > 1:
            rank, live = self._ranks(m[:, :-1], m[:, 1:]), rows
            while True:
                at = rank.argmin(1)
                has = rank[np.arange(len(live)), at] < _NO_RANK
                done[live[~has], : m.shape[1]] = m[~has]
                live, at, m, rank = live[has], at[has], m[has], rank[has]
                if not len(live):
                    break
                k = np.arange(len(live))
                m[k, at] = self._result[rank[k, at]]
                left[live] -= 1
                # what stands right of the pair moves one place to the left
                move = np.arange(m.shape[1] - 1) > at[:, None]
                m[:, :-1] = np.where(move, m[:, 1:], m[:, :-1])
                m[:, -1] = -1
                rank[:, :-1] = np.where(move[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = _NO_RANK
                rank[k, at] = np.where(at + 1 < m.shape[1], self._ranks(m[k, at], m[k, np.minimum(at + 1, m.shape[1] - 1)]), _NO_RANK)
                before = np.maximum(at - 1, 0)
                rank[k, before] = np.where(at > 0, self._ranks(m[k, before], m[k, at]), rank[k, before])
                keep = int(left[live].max())
                if 1 < keep < m.shape[1]:
                    m, rank = m[:, :keep], rank[:, : keep - 1]
        return done[np.arange(width) < left[:, None]], left

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) + b
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._rank_of[at], _NO_RANK)

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens, in order."""
        if text.isascii():
            return self.plain.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def text_words(self, text: str | None) -> list[str]:
        """The normalised words and the special tokens of a text, in order."""
        if not text:
            return []
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.words(part))]
        return self.words(text)

    def pieces(self, text: str | None, size: int = PIECE) -> Iterator[str]:
        """A text in pieces that have its words between them: cut before white space that an ASCII letter or
        digit follows, which neither a word, a special token nor a normalisation reaches across."""
        text, at = text or "", 0
        while len(text) - at > size and (cut := _CUT.search(text, at + size)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> Iterator[int]:
        for piece in self.pieces(text):
            for w in self.text_words(piece):
                if w in self.special:
                    yield self.special[w]
                else:
                    yield from (self.ids[t] for t in self.stream(self._symbols(w)))

    def raw_of(self, token_id: int) -> bytes | None:
        """The bytes a token stands for: its text if the file has no decoder, else what its characters encode."""
        raw = self._raw.get(token_id)
        if raw is None and (token := self.token.get(token_id)) is not None:
            if not self.decodes_bytes or token in self.special:
                raw = token.encode("utf-8")
            else:
                end = bool(self.suffix) and token.endswith(self.suffix)
                raw = bytes(self.byte_of[c] for c in (token.removesuffix(self.suffix) if end else token)) + b" " * end
            self._raw[token_id] = raw
        return raw

    def raw_table(self) -> dict[int, bytes]:
        """The bytes of every token."""
        if len(self._raw) < len(self.token):
            for i in self.token:
                self.raw_of(i)
        return self._raw

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Ids in, text out; holds the bytes of an unfinished character and whether a token came before."""

    def __init__(self, bpe: Bpe) -> None:
        self._bpe = bpe
        self._state = codecs.getincrementaldecoder("utf-8")("replace")
        self._any = False

    def _bytes(self, token_id: int) -> bytes:
        """A token's bytes; unknown ids have none."""
        raw = self._bpe.raw_of(token_id)
        if raw is None:
            return b""
        if self._any and not self._bpe.decodes_bytes:
            return b" " + raw
        self._any = True
        return raw

    def feed(self, token_id: int) -> str:
        return self._state.decode(self._bytes(token_id))

    def feed_all(self, ids: list[int]) -> str:
        """What feeding the ids one by one gives, in one step of the state machine."""
        table = self._bpe.raw_table()
        try:
            raws = [table[i] for i in ids]
        except KeyError:  # unknown ids have no bytes
            raws = [table[i] for i in ids if i in table]
        if not raws:
            return ""
        gap = b"" if self._bpe.decodes_bytes else b" "
        out = (gap if self._any else b"") + gap.join(raws)
        self._any = True
        return self._state.decode(out)

    def finish(self) -> str:
        return self._state.decode(b"", True)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Slots(dict):
    """Numbers of words by their first use; ``new`` holds those not yet encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot


class Lexicon:
    """The ids of words, remembered in two generations of one array each: when the young one is full it
    becomes the old one, and a word asked for again is copied back. New words are encoded in bulk."""

    def __init__(self, bpe: Bpe, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], size: int = REMEMBERED) -> None:
        self.bpe, self.encode, self.size = bpe, encode, size
        self._start()
        self._rotate()

    def _start(self) -> None:
        self.young = _Slots()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _rotate(self) -> None:
        self.old = (self.young, self.flat, self.at, self.n)
        self._start()

    def _add(self, words: list[str]) -> None:
        """Ids of the new words, in the order of their slots."""
        slots, flat, at, n = self.old
        before = np.array([slots.get(w, -1) for w in words], np.int64)
        lengths = np.zeros(len(words), np.int64)
        lengths[before >= 0] = n[before[before >= 0]]
        fresh = np.flatnonzero(before < 0)
        ids, sizes = self.encode([words[i] for i in fresh.tolist()]) if len(fresh) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        lengths[fresh] = sizes
        starts = self.used + np.cumsum(lengths) - lengths
        total, first = self.used + int(lengths.sum()), len(self.young) - len(words)
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.young) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        self.flat[ranges(starts[fresh], sizes)] = ids
        kept = before[before >= 0]
        self.flat[ranges(starts[before >= 0], n[kept])] = flat[ranges(at[kept], n[kept])]
        self.at[first : first + len(words)], self.n[first : first + len(words)] = starts, lengths
        self.used = total

    def look_up(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The ids of every list of words."""
        if len(self.young) > self.size or self.used > 16 * self.size:
            self._rotate()
        counts = np.array([len(x) for x in lists], np.int64)
        slots = np.fromiter(map(self.young.__getitem__, itertools.chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if self.young.new:
            words, self.young.new = self.young.new, []
            self._add(words)
        lengths = self.n[slots]
        ids = self.flat[ranges(self.at[slots], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(ends)]


@functools.lru_cache(maxsize=1)
def _lexicon(path: str) -> Lexicon:
    """A worker's encoder, kept from task to task."""
    bpe = Bpe(path)
    return Lexicon(bpe, bpe.encode_words)


class Digest:
    """What a document keeps between its pieces: the number of ids, two running hashes and the decoder."""

    def __init__(self, bpe: Bpe, decimal: list[str]) -> None:
        self.n, self._decimal, self._decoder = 0, decimal, bpe.decoder()
        self._ids, self._text = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: list[int]) -> None:
        if ids:
            self._ids.update((" " * bool(self.n) + " ".join([self._decimal[i] for i in ids])).encode())
            self._text.update(self._decoder.feed_all(ids).encode("utf-8"))
            self.n += len(ids)

    def finish(self) -> tuple[int, str, str]:
        self._text.update(self._decoder.finish().encode("utf-8"))
        return self.n, self._ids.hexdigest(), self._text.hexdigest()


def digests(lexicon: Lexicon, texts: Iterable[str | None], size: int = PIECE, together: int = TOGETHER_CHARS) -> Iterator[tuple[int, str, str]]:
    """(number of ids, hash of the ids, hash of the decoded text) of each text, in order; never more than
    ``together`` characters and a piece are held as words and ids."""
    bpe = lexicon.bpe
    decimal = [str(i) for i in range(max(bpe.token) + 1)]
    held: list[tuple[Digest, list[str], bool]] = []
    chars = 0

    def through() -> Iterator[tuple[int, str, str]]:
        for (digest, _, last), ids in zip(held, lexicon.look_up([words for _, words, _ in held]), strict=True):
            digest.feed(ids.tolist())
            if last:
                yield digest.finish()
        held.clear()

    for text in texts:
        digest, before = Digest(bpe, decimal), None
        for piece in itertools.chain(bpe.pieces(text, size), [None]):
            if before is not None:
                held.append((digest, bpe.text_words(before), piece is None))
                chars += len(before) + 64
                if chars >= together:
                    yield from through()
                    chars = 0
            before = piece
    yield from through()


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text and decodes its ids.

    A worker remembers the ids of the words it met lately.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _lexicon(path)
        for b in batches:
            out = pd.DataFrame(digests(lexicon, b["text"]), columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"), vocabulary_path())
