"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8): speculate and verify.

A text is split into words by the vocabulary's pattern. For the distinct words of a batch, greedy longest match
proposes tokens; two neighbouring tokens are compatible if their joined bytes encode to just these two, and a
word whose neighbours are all compatible is encoded rightly. The checks run over all words of a batch at once on
the distinct pairs, whose verdicts are kept; only words with an incompatible pair are merged exactly.

Defined cases
  * An empty text has no ids, and so has a null text: an empty list. Strings of special tokens are ordinary text.
  * Texts of any length are encoded whole; exact merging takes n log n steps.
  * Rows come out as they came in, repeated rows too; a column of the result's name gives way to it.
"""

from __future__ import annotations

import base64
import functools
import itertools
import heapq
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: How the rank files part a text before merging (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Of a rank file; ``folder`` defaults to $TOKENIZERS or the installed package of public tokenizers."""
    folder = folder or os.environ.get("TOKENIZERS")
    if not folder:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.__file__)
    return os.path.join(folder, f"{name}.tiktoken")


class Vocabulary:
    """Ranks of byte strings, with what encoding needs; keeps the verdicts on pairs and the ids of words it has seen."""

    MEMO = 400_000  # entries kept at most; what falls out is computed again

    def __init__(self, rank_lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines()) if a}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        # prefixes of tokens: longest match stops at the first text that begins no token
        self.prefixes = {b[:k] for b in self.ranks for k in range(1, len(b) + 1)}

    def merge(self, word: bytes) -> list[int]:
        """Exact: join the neighbours of least rank, leftmost first, until none can be joined."""
        n = len(word)
        end = list(range(1, n + 1))  # of the part that starts here
        prev, alive = list(range(-1, n - 1)), [True] * n
        rank = self.ranks.get
        heap = []
        for i in range(n - 1):
            if (r := rank(word[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == stop):
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                if (r := rank(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := prev[i]) >= 0 and (r := rank(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n = [], 0, len(word)
        ranks, prefixes = self.ranks, self.prefixes
        while i < n:
            j, best, at = i + 1, ranks[word[i : i + 1]], i + 1
            while j < n and word[i : j + 1] in prefixes:
                j += 1
                if (r := ranks.get(word[i:j])) is not None:
                    best, at = r, j
            out.append(best)
            i = at
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Verdict on each pair (a << 32 | b); single tokens are asked as a pair with themselves absent (b = 2^32 - 1)."""
        distinct, back = np.unique(pairs, return_inverse=True)
        verdict = np.empty(len(distinct), bool)
        known = self.pairs
        for k, p in enumerate(distinct.tolist()):
            v = known.get(p)
            if v is None:
                a, b = p >> 32, p & 0xFFFFFFFF
                v = self.merge(self.bytes_of[a]) == [a] if b == 0xFFFFFFFF else self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
                if len(known) > 4 * self.MEMO:
                    known.clear()
                known[p] = v
            verdict[k] = v
        return verdict[back]

    def learn(self, words: list[str]) -> None:
        """Ids of distinct words into the memo."""
        raw = [w.encode("utf-8") for w in words]
        tokens = [self.propose(b) for b in raw]
        flat = np.fromiter((t for ts in tokens for t in ts), "i8")
        size = np.fromiter(map(len, tokens), "i8", len(tokens))
        last = np.cumsum(size) - 1
        right = np.append(flat[1:], 0)
        right[last] = 0xFFFFFFFF  # the last token of a word: asked alone where the word has no other
        single = size == 1
        ask = np.ones(len(flat), bool)
        ask[last[~single]] = False
        fine = np.ones(len(flat), bool)
        fine[ask] = self.compatible((flat[ask] << 32) | right[ask])
        good = np.logical_and.reduceat(fine, last - size + 1) if len(flat) else np.ones(0, bool)
        for w, b, t, ok in zip(words, raw, tokens, good.tolist()):
            self.words[w] = t if ok else self.merge(b)

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for start in range(0, len(texts), 256):
            parted = [self.split(t) if t else [] for t in texts[start : start + 256]]
            if len(self.words) > self.MEMO:
                self.words.clear()
            new = {w for ws in parted for w in ws}.difference(self.words)
            if new:
                self.learn(sorted(new))
            of = self.words
            for ws in parted:
                ids: list[int] = []
                for w in ws:
                    ids += of[w]
                out.append(ids)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(rank_lines: bytes) -> Vocabulary:
    return Vocabulary(rank_lines)


def bounded(batch: pa.RecordBatch, text: str, most: int = 1 << 22):
    """The batch in slices of at most ``most`` bytes of text, or one text; a text has no more tokens than bytes, so the ids of a slice stay small too."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    end, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(end, most + (end[start - 1] if start else 0), side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, text: str = "text", vocabulary_file: str | None = None, column: str = "ids", only_count: bool = False) -> DataFrame:
    """``docs`` without ``text``, with the list of token ids (or, with ``only_count``, their number as ``column``).

    The rank file (under 1 MB) is read by the driver and broadcast; its size doesn't depend on the data.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    with open(vocabulary_file or vocabulary_path(), "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in (text, column)]
    kind = LongType() if only_count else ArrayType(IntegerType())
    schema = StructType([docs.schema[c] for c in rest] + [StructField(column, kind)])

    def run(batches):
        v = vocabulary(shipped.value)
        for whole in batches:
            for b in bounded(whole, text):
                got = v.encode_all(b.column(b.schema.get_field_index(text)).to_pylist())
                size = np.fromiter(map(len, got), "i8", len(got))
                if only_count:
                    new = pa.array(size)
                else:
                    flat = np.fromiter(itertools.chain.from_iterable(got), "i4", int(size.sum()))
                    new = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype("i4")), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), new], names=[*rest, column])

    return docs.select(*[f"`{c}`" for c in rest], f"`{text}`").mapInArrow(run, schema)
