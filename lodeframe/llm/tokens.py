"""Encoding of a corpus with a byte-level BPE vocabulary: speculate, verify, repair.

For each distinct word a greedy longest match proposes tokens. A sequence of tokens is the BPE encoding of its bytes if and
only if each adjacent pair is the encoding of its own bytes, so all adjacent pairs of a batch are tested together
against a table of pairs (each distinct pair is merged once). Only words with an incompatible pair go through
the exact merges. Words repeat, so both results are kept.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary lies unless the caller says otherwise.
VOCABULARY = os.environ.get("LODEFRAME_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: What the vocabulary's pattern takes for white space, and the pattern (of the vocabulary's README).
SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words and pairs kept per Python worker.
KEPT = 1 << 17


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes words; counts in ``proposed``, ``repaired`` how many were speculated and how many had to be merged."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.any, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.proposed = self.repaired = 0

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)

    def greedy(self, w: bytes) -> list[int]:
        """The longest token at each place. Every single byte is a token, so it always comes to the end."""
        get, out, i, n = self.ranks.get, [], 0, len(w)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = get(w[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token for byte {w[i]}")
        return out

    def exact(self, w: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank until none is a token; for long words with a heap of pairs."""
        import heapq

        get, n = self.ranks.get, len(w)
        end = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                r = get(w[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
                continue
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[w[i : end[i]]])
            i = end[i]
        return out

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of new words into ``words``."""
        guesses = []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            guesses.append([whole] if whole is not None else self.greedy(b))
        self.proposed += len(words)
        size = np.array([len(g) for g in guesses])
        flat = np.array([t for g in guesses for t in g], dtype=np.int64)
        of = np.repeat(np.arange(len(words)), size)
        same = of[1:] == of[:-1] if len(of) else np.zeros(0, dtype=bool)
        pair = ((flat[:-1] << 20) | flat[1:])[same]
        owner = of[1:][same]
        distinct, inverse = np.unique(pair, return_inverse=True)
        fits = np.fromiter((self._fits(int(p)) for p in distinct), dtype=bool, count=len(distinct))
        bad = np.unique(owner[~fits[inverse]]) if len(pair) else np.zeros(0, dtype=np.int64)
        self.repaired += len(bad)
        for i in bad:
            guesses[i] = self.exact(words[i].encode("utf-8", "surrogatepass"))
        self.words.update((w, tuple(g)) for w, g in zip(words, guesses))

    def _fits(self, pair: int) -> bool:
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            a, b = pair >> 20, pair & 0xFFFFF
            known = self.pairs[pair] = self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none."""
        if len(self.words) > KEPT:
            self.words.clear()
        split = [self.split(t) if t else [] for t in texts]
        known = self.words
        new = {w for s in split for w in s if w not in known}
        if new:
            self.learn(sorted(new))
        out = []
        for s in split:
            ids: list[int] = []
            for w in s:
                ids += known[w]
            out.append(ids)
        return out


#: One encoder per vocabulary in each Python worker, as its words are worth keeping.
_ENCODERS: dict[str, Encoder] = {}


def token_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row of ``docs``, in no order; rows with a null or empty text have an empty list.

    Blanks are text; strings that look like special tokens are ordinary text; special tokens aren't added. The vocabulary
    (a fixed file of some 50,000 entries) is read by the driver and broadcast. No shuffle. Extra columns are ignored; an
    empty table gives no rows; rows with a null doc_id are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary)
        if encoder is None:
            encoder = _ENCODERS[vocabulary] = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = encoder.encode_batch(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")
