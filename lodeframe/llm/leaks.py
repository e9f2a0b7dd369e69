"""Passages of held-out items inside a corpus.

Items and documents are reduced to words. Each window of WINDOW words of an item has a 64-bit SimHash, and so has each
window of a document that could belong to a passage (nearly all its words occur in items: a necessary condition, so
nothing is lost by it). A multi-index of four 16-bit blocks finds all pairs of fingerprints within RADIUS bits: of two such
fingerprints one block differs in at most RADIUS // 4 bits, and every item window is listed under all block values
that near. The pairs are verified by the exact weighted similarity of their words, and what remains by the exact
definition: a run of 20 or more words of the item with at most one edit in ten words, by an alignment of words.

The corpus is read once and never shuffled; the items are a fixed set, and only they are broadcast.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The shortest passage, and the words for which one edit is allowed (the problem's statement).
PASSAGE, PER_EDIT = 20, 10
#: Words of a window; a passage of PASSAGE words has some five of them.
WINDOW = 16
#: A window of a passage has at most so many words that aren't the item's.
STRANGE = 2
BITS, BLOCKS, RADIUS = 64, 4, 15
#: Least weighted share of an item window's words that the document's window must have.
SIMILAR = 0.65
#: Words in a row that every passage has as they are in the item: PASSAGE words with two edits leave three runs of 18 words in all, and longer
#: ones with one edit in ten words longer runs.
RUN = 6
#: Item windows of one index, which takes some 6 KB for each; more items are looked for block by block.
INDEX_WINDOWS = 32_768

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
BLOCK_TAGS = frozenset("p br div li ul ol td tr th table hr h1 h2 h3 h4 h5 h6 blockquote pre section article".split())
LINK = re.compile(r"\]\([^)\s]*\)")
BROKEN = re.compile(r"[-‐‑]\s*\n[\s>|»]*")
UNSEEN = re.compile("[\u00ad\u180e\ufeff\u200b-\u200f\u202a-\u202e\u2060-\u2064]+")


def words_of(text: str) -> list[str]:
    """The words of a text, regardless of case, punctuation, width, markup, quotation signs and hyphenation."""
    if "<" in text:
        text = TAG.sub(lambda m: " " if m.group(1).lower() in BLOCK_TAGS else "", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = LINK.sub("]", text)
    if not text.isascii():
        text = UNSEEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "\n" in text:
        text = BROKEN.sub("", text)
    return WORD.findall(text.lower())


class Index:
    """The item windows: fingerprints, the multi-index, and what verifying needs."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, words_of(t)) for i, t in items if isinstance(t, str)]
        self.items = [(i, w) for i, w in texts if len(w) >= PASSAGE]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        v = len(self.vocabulary)
        bits = np.zeros((v + 1, BITS), dtype=np.int8)  # the last row stands for all other words: they weigh nothing
        for w, k in self.vocabulary.items():
            h = xxhash.xxh64_intdigest(w, seed=7)
            bits[k] = [1 if h >> b & 1 else -1 for b in range(BITS)]
        self.bits = bits
        count = Counter(w for _, ws in self.items for w in set(ws))
        self.weight = np.array([math.log(1 + len(self.items) / count[w]) for w in sorted(self.vocabulary)] + [0.0])
        self.codes = [np.array([self.vocabulary[w] for w in ws], dtype=np.int32) for _, ws in self.items]
        owner, offset, windows = [], [], []
        for k, c in enumerate(self.codes):
            for at in range(len(c) - WINDOW + 1):
                owner.append(k)
                offset.append(at)
                windows.append(c[at : at + WINDOW])
        self.owner, self.offset = np.array(owner, dtype=np.int32), np.array(offset, dtype=np.int32)
        self.windows = np.array(windows, dtype=np.int32).reshape(-1, WINDOW)
        self.prints = self.simhash(self.windows)
        masks = [0] + [sum(1 << b for b in c) for r in range(1, RADIUS // BLOCKS + 1) for c in itertools.combinations(range(BITS // BLOCKS), r)]
        masks = np.array(masks, dtype=np.uint16)
        self.lists, self.starts = [], []
        m = len(self.prints)
        for b in range(BLOCKS):
            near = (self.block(self.prints, b)[:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.lists.append((order // len(masks)).astype(np.uint16 if m < 1 << 16 else np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(near, minlength=1 << 16))]))

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def simhash(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(windows), dtype=np.uint64)
        for at in range(0, len(windows), 4096):
            s = self.bits[windows[at : at + 4096]].sum(axis=1, dtype=np.int16) > 0
            out[at : at + 4096] = np.packbits(s, axis=1, bitorder="little").view(np.uint64).ravel()
        return out

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item window) of all pairs within RADIUS bits."""
        found = []
        m = np.int64(len(self.prints))
        for b in range(BLOCKS):
            value = self.block(prints, b).astype(np.int64)
            first, size = self.starts[b][value], self.starts[b][value + 1] - self.starts[b][value]
            edge = np.cumsum(size)
            lo = 0
            while lo < len(prints):
                hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + 2_000_000, side="right")))
                s = size[lo:hi]
                q = np.repeat(np.arange(lo, hi), s)
                at = np.arange(len(q)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(first[lo:hi], s)
                w = self.lists[b][at].astype(np.int64)
                x = prints[q] ^ self.prints[w]
                ok = np.bitwise_count(x) <= RADIUS
                for earlier in range(b):  # a pair comes from the first block that is near
                    ok &= np.bitwise_count(self.block(x, earlier)) > RADIUS // BLOCKS
                found.append(q[ok] * m + w[ok])
                lo = hi
        pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pairs // max(m, 1), pairs % max(m, 1)

    def similarity(self, windows: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The weighted share of each item window w's words that occur in the document's window q; q ascends."""
        out = np.zeros(len(w))
        weight = self.weight[self.windows]
        weight /= weight.sum(axis=1, keepdims=True)
        for first in range(0, len(windows), 2048):  # so many windows as rows of a table of words
            lo, hi = np.searchsorted(q, [first, first + 2048])
            if lo == hi:
                continue
            own = windows[first : first + 2048]
            there = np.zeros((len(own), len(self.weight)), dtype=bool)
            there[np.arange(len(own))[:, None], own] = True
            for at in range(lo, hi, 50_000):
                part = slice(at, min(at + 50_000, hi))
                out[part] = (weight[w[part]] * there[(q[part] - first)[:, None], self.windows[w[part]]]).sum(axis=1)
        return out


def runs_of(item: np.ndarray, region: np.ndarray) -> int:
    """The longest run of words of the item that the region has as it is, PASSAGE at most."""
    same = item[:, None] == region[None, :]
    if not same.any():
        return 0
    n = 1
    while n < PASSAGE and min(same.shape) > 1:
        same = same[1:, 1:] & (item[: same.shape[0] - 1, None] == region[None, : same.shape[1] - 1])
        if not same.any():
            break
        n += 1
    return n


def may_hold(item: np.ndarray, region: np.ndarray, words: int) -> bool:
    """Whether some PASSAGE words in a row of the item occur in the region, all but three, in any order. words: how many there are.

    Necessary for a passage: one of 30 to 39 words may have three edits in its middle, in any other some PASSAGE words in a
    row have fewer.
    """
    known = np.zeros(words, dtype=bool)
    known[region] = True
    there = np.concatenate([[0], np.cumsum(known[item])])
    return bool((there[PASSAGE:] - there[:-PASSAGE] >= PASSAGE - 3).any())


def has_passage(item: np.ndarray, region: np.ndarray) -> bool:
    """Whether some run of PASSAGE or more words of the item occurs in the region with one edit in PER_EDIT words at most.

    The first and the last word of the run must be there, as a shorter quotation isn't a longer one with its ends left out.
    For all starts in the item at once: edit distance to the best place of the region, word by word.
    """
    m, n = len(item), len(region)
    starts = m - PASSAGE + 1
    if starts <= 0 or n == 0:
        return False
    far = m + n + 1
    ramp = np.arange(n + 1, dtype=np.int32)
    begin = np.arange(starts)
    d = np.full((starts, n + 1), far, dtype=np.int32)
    d[:, 1:][item[:starts, None] == region[None, :]] = 0
    d = np.minimum.accumulate(d - ramp, axis=1) + ramp
    for x in range(1, m):
        live = begin + x < m
        same = item[np.minimum(begin + x, m - 1)][:, None] == region[None, :]
        if x + 1 >= PASSAGE and (d[:, :-1][same & live[:, None]] <= (x + 1) // PER_EDIT).any():
            return True
        step = np.full_like(d, far)
        np.minimum(d[:, :-1] + ~same, d[:, 1:] + 1, out=step[:, 1:])
        d = np.minimum.accumulate(step - ramp, axis=1) + ramp
        if d.min() > m // PER_EDIT:
            return False
    return False


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int]]:
    """(number of the text, item_id) of all passages."""
    get, other = index.vocabulary.get, len(index.vocabulary)
    codes, lengths = [], []
    for t in texts:
        ws = words_of(t) if isinstance(t, str) else []
        lengths.append(len(ws))
        codes += [get(w, other) for w in ws]
    c = np.array(codes, dtype=np.int32)
    ends = np.cumsum(lengths)
    if len(c) < WINDOW or not len(index.prints):
        return []
    doc = np.repeat(np.arange(len(texts)), lengths)
    known = np.concatenate([[0], np.cumsum(c < other)])
    at = np.flatnonzero((known[WINDOW:] - known[:-WINDOW] >= WINDOW - STRANGE) & (doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]))
    if not len(at):
        return []
    windows = c[at[:, None] + np.arange(WINDOW)]
    q, w = index.near(index.simhash(windows))
    ok = index.similarity(windows, q, w) >= SIMILAR
    q, w = q[ok], w[ok]
    place, item = at[q], index.owner[w]
    diagonal = place - index.offset[w]
    order = np.lexsort((diagonal, item, doc[place]))
    out = []
    key = None
    group: list[int] = []
    todo = []
    for i in order:
        k = (int(doc[place[i]]), int(item[i]))
        if k != key or diagonal[i] - group[-1] > PASSAGE:
            if key is not None:
                todo.append((*key, group[0], group[-1]))
            key, group = k, []
        group.append(int(diagonal[i]))
    if key is not None:
        todo.append((*key, group[0], group[-1]))
    done = set()
    for d, k, lo, hi in todo:
        if (d, k) in done:
            continue
        words = index.codes[k]
        slack = len(words) // PER_EDIT + STRANGE
        first, last = int(ends[d] - lengths[d]), int(ends[d])
        region = c[max(first, lo - slack) : min(last, hi + len(words) + slack)]
        if not may_hold(words, region, other + 1):
            continue
        run = runs_of(words, region)
        if run >= PASSAGE or (run >= RUN and has_passage(words, region)):
            done.add((d, k))
            out.append((d, index.items[k][0]))
    return out


def pieces(texts: list[str | None], most: int = 1000, chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts with about ``chars`` characters in total; a longer text is one by itself."""
    a, size = 0, 0
    for b, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if b > a and (b - a >= most or size + n > chars):
            yield a, b
            a, size = b, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: each document with each item of which it contains a passage, once.

    Null and empty texts, and items of fewer than PASSAGE words, contain or are no passage. Repeated documents
    each have their rows. Extra columns are ignored. The items are a fixed set, whatever the corpus; as many of them as have some INDEX_WINDOWS
    windows are indexed on the driver and broadcast at a time.
    """
    words = F.size(F.split("text", r"\W+"))  # about
    blocks = -(-int(items.agg(F.sum(F.greatest(words, F.lit(0)))).first()[0] or 0) // INDEX_WINDOWS) or 1
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        parts.append(_leaks_of(docs, Index([(r.item_id, r.text) for r in own.select("item_id", "text").collect()])))
    return reduce(DataFrame.unionByName, parts)


def _leaks_of(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for a, b in pieces(texts):
                found = find(index, texts[a:b])
                yield pd.DataFrame([(ids[a + d], i) for d, i in found], columns=["doc_id", "item_id"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, item_id bigint")
