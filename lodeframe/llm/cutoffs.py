"""Texts that were cut off by a limit or in transfer.

A text that stops inside its last word or sentence is a strict prefix of something longer. First the whole values are joined by
prefix: fixed-length prefixes of all values are hashed, and those that share one with an unfinished value are hashed at
the lengths of the unfinished ones, so every value that goes on in a longer copy is found. Second, as whole longer copies
are rare, the same self-join is done on windows: the last 2 to 12 tokens of each text that has no proper end are
hashed, and so are all windows of that many tokens of all texts, with what follows them. A tail that elsewhere goes
on (with more words, or with more letters of its last word) was cut; one that elsewhere ends was not. The longest
window that occurs elsewhere decides; where none of two or more tokens does, nothing is known, and the text counts as
complete. Numbers are masked, and lines of lists, key-value pairs, headings, signatures and
titles are compared only with their like, as they end without a stop. Last, the lengths at which a source cuts
show as peaks among its cut texts: an unfinished text of just that length was cut as well.

Nothing is sampled: every prefix and window of every text counts, if its hash is in a Bloom filter of the hashes asked for (of
bounded size; false positives cost time only, as the join on the hash follows).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.leaks import pieces
from lodeframe.sources.tables import discard, materialise

#: Window lengths in tokens, and those at which the letters of a broken last word are compared.
ORDERS = (2, 3, 4, 5, 6, 8, 10, 12)
PREFIX_ORDERS = (2, 4)
#: Length in characters of the prefixes that whole values are joined by first; a shorter value says too little.
WHOLE = 48
#: What the number of a window says: at most 12 tokens; letters of the last word; the same as prose; the whole value.
LETTERS, AS_PROSE, VALUE, STEM = 100, 200, 300, 400
#: A window decides from so many occurrences on; the longest that a text has (a title apart) from one on, as a single longer copy is enough.
ENOUGH = 2
#: Bits of the Bloom filter: some 16 for each key, but at most 64 MB; with more keys it lets more windows pass.
BLOOM_PER_KEY, BLOOM_LEAST, BLOOM_MOST, BLOOM_HASHES = 16, 1 << 16, 1 << 29, 3
#: A length is a limit of a source if this share of the source's cut texts, and at least PEAK, were cut there, PEAK times as many as at
#: the two lengths before and after it, and most of the unfinished texts of that length. All but PEAK are ratios, so size plays no part.
LIMIT_SHARE, PEAK = 0.1, 3
#: Keys with more than this share of all tails are joined by broadcast.
HOT_SHARE = 0.001

CJK = "぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"[{CJK}]|[0-9]+|[^\W0-9{CJK}]+|\.\.\.|[^\s\w]")
ENDS = frozenset([".", "!", "?", "。", "！", "？", "…", "..."])
CLOSERS = "\"'”’»›)]}*_）】」』"
OPENERS = ",;:(-–—/[{、，；：（¿¡“„«‘‚‹"
MARK = re.compile(r"(?:\s*(?:\.\.\.|…|\[[^\]\n]{1,12}\]))+$")
INVISIBLE = re.compile("[​-‏⁠-⁤﻿­]+")
APART = re.compile(r"(?<=[.!?。！？…\"'`])[ \t]+(?=[—–] |- )")
# lists, signatures, key-value pairs, headings: the number of the group is the kind
KINDS = re.compile(r"\s*(?:((?:[-*+•]|[0-9]{1,3}[.)])\s)|((?:—|–|--)\s?)|([\w ]{1,30}:(?:\s+\S+){0,3}\s*$)|(#{1,6}\s))")
PROSE, TITLE, NEWLINE = 0, 5, "\n"
TITLE_TOKENS = 12

#: The multipliers of the hashes.
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LETTER = 0x2545F4914F6CDD1D
_UNLETTER = pow(_LETTER, -1, 1 << 64)
_WRAP = (1 << 64) - 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """At least the first n powers."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base]


def _prefix_sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the text up to and with each character, all texts in a row; where each begins; how long each is)."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size) - size
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    at = np.arange(len(code)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        total = np.cumsum(code * _powers(int(size.max(initial=1)), _LETTER)[at], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, dtype=np.uint64), total])[begin]
        return total - np.repeat(before, size), begin, size


SPACE, LINE, SIGN, LETTERED, DIGITS, IDEOGRAPHIC = range(6)


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character its class, whether it is a digit of any script, whether it ends a sentence."""
    chars = [chr(i) for i in range(0x110000)]
    out = np.array([LETTERED if c.isalnum() or c == "_" else SPACE if c.isspace() else SIGN for c in chars], dtype=np.uint8)
    out[ord("0") : ord("9") + 1] = DIGITS
    out[ord("\n")] = LINE
    out[0] = SPACE  # stands between texts
    for m in re.finditer("(.)-(.)", CJK):
        out[ord(m.group(1)) : ord(m.group(2)) + 1] = IDEOGRAPHIC
    digit = np.array([c.isdigit() for c in chars])
    ends = np.zeros(0x110000, dtype=bool)
    ends[[ord(c) for c in ENDS if len(c) == 1]] = True
    return out, digit, ends


@dataclass
class Tokens:
    """The tokens of texts, all in a row; each text begins with a line break, and lines without tokens are left out."""

    hash: np.ndarray
    text: np.ndarray  # the number of the text
    kind: np.ndarray  # of the token's line; PROSE for line breaks
    is_end: np.ndarray
    is_line: np.ndarray
    begin: np.ndarray  # of its characters
    size: np.ndarray  # in characters; 0 for what isn't a word of letters
    sums: np.ndarray  # of the hashed characters before each, one more than there are

    def stems(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of the first ``length`` characters of the tokens ``at``."""
        b = self.begin[at]
        letters = (self.sums[b + length] - self.sums[b]) * _powers(len(self.sums), _UNLETTER)[b]
        return _finish(letters, STEM, length.astype(np.uint64))


def _lines(text: str) -> list[str]:
    """The lines of a text in lower case, those without tokens left out; what is signed in its line is two lines."""
    out = []
    for raw in text.lower().splitlines():
        if "— " in raw or "– " in raw or "- " in raw:
            out += [x for x in APART.split(raw) if x.strip()]
        elif raw.strip():
            out.append(raw.replace("\0", " ") if "\0" in raw else raw)
    return out


def _kind(line: str) -> int:
    m = KINDS.match(line)
    return m.lastindex if m else PROSE


def scan(texts: list[list[str]], whole: list[bool] | None = None) -> Tokens:
    """The tokens of texts given as lines. whole: whether a text's first line is its first at all, and so may be a title."""
    classes, digits, ends = _classes()
    kinds = np.array([_kind(x) for t in texts for x in t] or [0], dtype=np.uint64)
    flat = "\0".join("\n" + "\n".join(t) for t in texts)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = classes[code]
    is_line = cls == LINE
    # a line break is a token, though a text without lines has but the one it begins with
    before = np.concatenate([np.zeros(1, dtype=np.uint8), cls[:-1]])
    start = (cls != SPACE) & ((cls != before) | (cls == SIGN) | (cls == IDEOGRAPHIC) | is_line)
    dots = np.zeros(len(code), dtype=bool)
    if "..." in flat:  # three dots are one token
        for m in re.finditer(r"\.\.\.", flat):
            start[m.start() + 1 : m.end()] = False
            dots[m.start()] = True
    with np.errstate(over="ignore"):
        total = np.cumsum((code + np.uint64(1)) * _powers(len(code), _LETTER)[: len(code)], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), total])
    begin = np.flatnonzero(start)
    # a token ends before the next, or where blanks begin
    stop = np.flatnonzero(np.append((cls[1:] != cls[:-1]) | start[1:], True)) + 1 if len(code) else begin
    end = stop[np.searchsorted(stop, begin, side="right")] if len(begin) else begin
    three = dots[begin]
    end = np.where(three, begin + 3, end)
    first = code[begin]
    c = cls[begin]
    size = np.where((c == LETTERED) & ~digits[first] & (first != ord("_")), end - begin, 0)
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[begin]) * _powers(len(sums), _UNLETTER)[begin]
        h = _finish(np.where(digits[first], np.uint64(0), h), 0, np.where(digits[first], 0, end - begin).astype(np.uint64))
    line = c == LINE
    text = np.cumsum(code == 0)[begin] if len(begin) else begin
    number = np.cumsum(line) - 1  # of the line, counted with the break before it
    is_end = three | (ends[first] & (end - begin == 1))
    # the first line of a text, if it is short prose without an end, is a title; a text without lines has one of its own here
    lines = np.array([max(1, len(t)) for t in texts], dtype=np.int64)
    own = np.zeros(int(lines.sum()), dtype=np.uint64)
    own[np.repeat([len(t) > 0 for t in texts], lines)] = kinds[: sum(map(len, texts))]
    count = np.bincount(number, minlength=len(own)) - 1
    last = np.cumsum(count + 1) - 1
    heads = np.cumsum(lines) - lines
    if whole is not None:
        heads = heads[np.array(whole, dtype=bool)]
    titles = heads[(own[heads] == PROSE) & (count[heads] > 0) & (count[heads] <= TITLE_TOKENS) & ~is_end[last[heads]]]
    own[titles] = TITLE
    return Tokens(h, text, np.where(line, np.uint64(PROSE), own[number]), is_end, line, begin, size, sums)


def _tail(lines: list[str]) -> tuple[list[str], bool]:
    """The last lines of a text, with at least 12 tokens if it has so many; and whether they are all."""
    n = len(lines)
    k, tokens = n, 0
    while k and tokens <= max(ORDERS):
        k -= 1
        tokens += 1 + len(TOKEN.findall(lines[k]))
    return lines[k:], k == 0


def split_end(text: str) -> tuple[str, bool, bool]:
    """The text without blanks, invisible characters and marks of omission at its end; whether it had a mark; broken."""
    s = text.rstrip() if text.isascii() else INVISIBLE.sub("", text).rstrip()
    broken = s.endswith("�")
    s = s.rstrip("�").rstrip()
    if not s or s[-1] not in ".…]":
        return s, False, broken
    n = 64
    while True:  # marks lie at the end, so only that is searched
        at = max(0, len(s) - n)
        m = MARK.search(s[at:])
        if m and m.start() == 0 and at:
            n *= 2
            continue
        return (s[: at + m.start()].rstrip() if m else s), m is not None, broken


def _finish(g: np.ndarray, n: int, kind) -> np.ndarray:
    k = (g + np.uint64(n) * _MIX + np.asarray(kind, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) * _P
    return k ^ (k >> np.uint64(29))


def tail_keys(t: Tokens, at: int, n: int, kind: int, stem: int) -> tuple[list[int], list[int]]:
    """Hashes of the windows that end with the token ``at``, ``n`` tokens being there, by ORDERS; and by PREFIX_ORDERS those whose last word, of hash
    ``stem``, may go on (0: no such window)."""
    h = [int(x) for x in t.hash[at - min(n, max(ORDERS)) + 1 : at + 1][::-1]]
    sums, total, p = [], 0, 1
    for x in h:
        total = (total + x * p) & _WRAP
        sums.append(total)
        p = (p * int(_P)) & _WRAP
    with np.errstate(over="ignore"):
        known = [m for m in ORDERS if m <= len(sums)]
        keys = _finish(np.array([sums[m - 1] for m in known], dtype=np.uint64), np.array(known, dtype=np.uint64), kind)
        follow = keys.astype(np.int64).tolist() + [0] * (len(ORDERS) - len(known))
        letters = [m for m in PREFIX_ORDERS if m <= len(sums) and stem]
        keys = _finish(np.array([(sums[m - 1] - h[0] + stem) & _WRAP for m in letters], dtype=np.uint64), np.array([LETTERS + m for m in letters], dtype=np.uint64), kind)
        part = keys.astype(np.int64).tolist() + [0] * (len(PREFIX_ORDERS) - len(letters))
    return follow, part


def _values(texts: list[str]) -> list[tuple[int, int]]:
    """Of each text of WHOLE or more characters the keys of its first WHOLE characters and of all; (0, 0) for others."""
    long = [t if len(t) >= WHOLE else "" for t in texts]
    sums, begin, size = _prefix_sums(long)
    with np.errstate(over="ignore"):
        at = begin[size > 0]
        first = _finish(sums[at + WHOLE - 1], VALUE, WHOLE).astype(np.int64)
        whole = _finish(sums[at + size[size > 0] - 1], VALUE + 1, size[size > 0].astype(np.uint64)).astype(np.int64)
    got = iter(zip(first.tolist(), whole.tolist()))
    return [next(got) if n else (0, 0) for n in size]


ENDING = (
    "doc_id bigint, source string, n_chars bigint, n_bytes bigint, mark boolean, rule int, kind int, twin bigint, "
    "body int, first bigint, value bigint, stem bigint, follow array<bigint>, part array<bigint>, prose array<bigint>"
)


def endings(docs: DataFrame) -> DataFrame:
    """A row (see ENDING) for every text without a proper end.

    rule: 1 cut for certain (broken character, open code block), 0 to be asked. Null, empty and blank texts, and texts with
    a proper end (a final stop, perhaps before closing signs or a mark; a closed code block; a sign such as an
    emoji) give no row. ``twin`` is a hash of the text's last part, the same for copies; ``body`` the length without marks of omission, ``first``
    and ``value`` the keys of its first characters and of all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, bodies, tails = [], [], []
            for doc_id, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                if not isinstance(text, str):
                    continue
                body, mark, broken = split_end(text)
                if not body:
                    continue
                rule = 1 if broken or body.count("```") % 2 else 0
                if not rule:
                    bare = body.rstrip(CLOSERS)
                    if body.endswith("```") or body[-1] in ENDS or (bare and bare[-1] in ENDS):
                        continue
                lines, all_of_it = _tail(_lines(body))
                last = TOKEN.findall(lines[-1])[-1] if lines else ""
                if not last or not (rule or last[0].isalnum() or "_" in last or last in OPENERS or last in CLOSERS):
                    continue
                bodies.append(body)
                tails.append((lines, all_of_it))
                twin = int(np.uint64(xxhash.xxh64_intdigest(body[-200:].encode("utf-8", "surrogatepass"))).astype(np.int64))
                out.append((doc_id, source, len(text), len(text.encode("utf-8", "surrogatepass")), mark, rule, twin, len(body)))
            rows = []
            if out:
                t = scan([x for x, _ in tails], [x for _, x in tails])
                size = np.bincount(t.text, minlength=len(out))
                at = np.cumsum(size) - 1
                with np.errstate(over="ignore"):
                    stems = np.where(t.size[at] > 0, t.stems(at, t.size[at]), np.uint64(0))
                for own, i, n, stem, (first, value) in zip(out, at, size, stems, _values(bodies)):
                    kind = int(t.kind[i])
                    follow, part = tail_keys(t, i, n, kind, int(stem))
                    # what looks like a title may be a first sentence that was cut, so it is held against prose as well
                    prose = tail_keys(t, i, n, PROSE, 0)[0] if kind == TITLE else []
                    rows.append((*own[:6], kind, *own[6:], first, value, int(stem.astype(np.int64)), follow, part, prose))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENDING.split(", ")])

    return docs.select("doc_id", "source", "text").mapInPandas(run, ENDING)


def bloom(keys: DataFrame, n: int) -> bytes:
    """A Bloom filter of a column key with about ``n`` values. Its size is bounded by BLOOM_MOST."""
    size = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_PER_KEY * max(1, n) - 1).bit_length()))
    bits = F.array(*[F.expr(f"shiftright(key, {21 * i}) & {size - 1}") for i in range(BLOOM_HASHES)])
    words = keys.select(F.explode(bits).alias("bit")).select(F.shiftright("bit", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BLOOM_MOST / 64 rows
    out = np.zeros(size // 64, dtype=np.uint64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).astype(np.uint64)
    return out.view(np.uint8).tobytes()


def _kept(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The positions of the keys that the filter lets pass."""
    at = np.arange(len(keys))
    signed, mask = keys.view(np.int64), np.int64(8 * len(bits) - 1)
    for i in range(BLOOM_HASHES):
        b = (signed[at] >> np.int64(21 * i)) & mask
        at = at[(bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1]
    return at


def window_counts(docs: DataFrame, filter_bits: bytes, lengths: np.ndarray) -> DataFrame:
    """key, n_on, n_end, n_all: how often a window or value goes on with more text, ends, or occurs, inside of texts.

    For the keys of ``part``: how often the word goes on with more letters (n_on). lengths: whether an unfinished value has that
    many characters. Counted per batch before any shuffle.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((filter_bits, lengths))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed, lengths = shared.value
        bits = np.frombuffer(packed, dtype=np.uint8)
        for pdf in batches:
            texts = [t for t in pdf["text"] if isinstance(t, str)]
            for a, b in pieces(texts, 300):
                yield _count(texts[a:b], bits, lengths)

    return docs.select("text").mapInPandas(run, "key bigint, n_on bigint, n_end bigint, n_all bigint")


def _longer_values(texts: list[str], bits: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, whether the value goes on in its line, whether it ends there) of the beginnings of texts that are asked for."""
    long = [t for t in texts if len(t) > WHOLE]
    if not long or not lengths.any():
        return
    with np.errstate(over="ignore"):
        sums, begin, size = _prefix_sums([t[:WHOLE] for t in long])
        own = _kept(_finish(sums[begin + size - 1], VALUE, WHOLE), bits)
        if not len(own):
            return
        long = [long[i] for i in own]
        sums, begin, size = _prefix_sums(long)
        n = np.arange(len(sums)) - np.repeat(begin, size) + 1
        ok = np.flatnonzero((n < np.repeat(size, size)) & lengths[np.minimum(n, len(lengths) - 1)] & (n < len(lengths)))
        keys = _finish(sums[ok], VALUE + 1, n[ok].astype(np.uint64))
        hit = _kept(keys, bits)
    which = np.searchsorted(begin, ok[hit], side="right") - 1
    rest = [long[t][k : k + 40].lstrip(" \t") for t, k in zip(which, n[ok[hit]])]
    ends = np.array([not r or r[0] in ENDS or r[0] in "\r\n" for r in rest], dtype=bool)
    yield keys[hit], ~ends, ends


def _count(texts: list[str], bits: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
    t = scan([_lines(split_end(x)[0]) for x in texts])
    n = len(t.hash)
    sizes = np.bincount(t.text, minlength=len(texts))
    pos = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.zeros(n, dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    hashes, kind = t.hash, t.kind
    nxt = np.append(np.arange(1, n), 0)
    ends = t.is_end[nxt] | (t.is_line[nxt] & (kind != PROSE))
    on = ~t.is_end[nxt] & ~t.is_line[nxt]
    inner = ~last & ~t.is_line  # the last token's follower is the end of the text; that is counted from the endings
    found = list(_longer_values(texts, bits, lengths))
    g = np.zeros(n, dtype=np.uint64)
    sums = {}
    with np.errstate(over="ignore"):
        p = np.uint64(1)
        for m in range(1, max(ORDERS) + 1):
            g[m - 1 :] += hashes[: n - m + 1] * p
            p = p * _P
            if m in PREFIX_ORDERS:
                sums[m] = g.copy()
            if m in ORDERS:
                ok = np.flatnonzero(inner & (pos >= m - 1))
                k = _finish(g[ok], m, kind[ok])
                hit = _kept(k, bits)
                found.append((k[hit], on[ok][hit], ends[ok][hit]))
        # beginnings of words: first those with which some text ends, then their windows
        _, one, codes = np.unique(hashes, return_index=True, return_inverse=True)
        size = np.maximum(t.size[one] - 1, 0)
        word = np.repeat(np.arange(len(one)), size)
        stem = t.stems(one[word], np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + 1)
        hit = _kept(stem, bits)
        stem, word = stem[hit], word[hit]
        many = np.bincount(word, minlength=len(one))
        begin = np.cumsum(many) - many
        for m in PREFIX_ORDERS:
            ok = np.flatnonzero((pos >= m - 1) & (many[codes] > 0))
            if not len(ok):
                continue
            c = many[codes[ok]]
            rep = np.repeat(ok, c)
            at = np.arange(len(rep)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[codes[ok]], c)
            k = _finish(sums[m][rep] - hashes[rep] + stem[at], LETTERS + m, kind[rep])
            hit = _kept(k, bits)
            found.append((k[hit], np.ones(len(hit), dtype=bool), np.zeros(len(hit), dtype=bool)))
    key, goes, stops = (np.concatenate(x) for x in zip(*found))
    u, inv, every = np.unique(key.view(np.int64), return_inverse=True, return_counts=True)
    sum_of = lambda x: np.bincount(inv, x, len(u)).astype(np.int64)
    return pd.DataFrame({"key": u, "n_on": sum_of(goes), "n_end": sum_of(stops), "n_all": every})


def _facts(docs: DataFrame, tails: DataFrame, filter_bits: bytes, lengths: np.ndarray) -> DataFrame:
    """key, n_on, n_end, n_all, n_tails, n_rows: of each key that was asked for; n_tails is how many texts end with it, copies once, n_rows with
    copies."""
    numbers = ("n_on", "n_end", "n_all", "n_tails", "n_rows")
    none = {c: F.lit(0).cast("long") for c in numbers}
    alike = tails.groupBy("key", "twin").agg(F.max((F.col("n") < LETTERS).cast("long")).alias("n_tails"), F.count(F.lit(1)).alias("n_rows"))
    alike = alike.withColumns({c: none[c] for c in numbers[:3]}).select("key", *numbers)
    inside = window_counts(docs, filter_bits, lengths).withColumns({c: none[c] for c in numbers[3:]})
    return inside.unionByName(alike).groupBy("key").agg(*[F.sum(c).alias(c) for c in numbers])


def _seen(tails: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """The ``n`` tails with the facts of their keys. Keys that very many texts end with are joined by broadcast, so they fill no task."""
    facts = materialise(facts.where("n_rows > 0 and (n_all > 0 or n_tails > 1)"), "facts")
    hot = F.broadcast(facts.where(F.col("n_rows") > HOT_SHARE * n))  # fewer than 1 / HOT_SHARE
    rest = tails.join(hot.select("key"), "key", "left_anti").join(facts.where(F.col("n_rows") <= HOT_SHARE * n), "key")
    return tails.join(hot, "key").unionByName(rest)


def _told(seen: DataFrame) -> DataFrame:
    """row, why (prefix, word or sentence): the texts whose tails go on elsewhere.

    Ties go to the text: as many occurrences that end as go on mean that it was complete.
    """
    on, end = F.col("n_on"), F.col("n_end") + F.greatest(F.col("n_tails") - 1, F.lit(0))
    longest = F.col("n") == F.col("longest")

    def told_by(low: int, single: Column) -> Column:
        least = F.when(single, 1).otherwise(ENOUGH)
        return F.max(F.when((F.col("n") > low) & (F.col("n") < low + LETTERS) & (on + end >= least), F.struct("n", on.alias("on"), end.alias("end"))))

    at = lambda n, c: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias
    per = seen.groupBy("row").agg(
        F.coalesce(told_by(0, longest & (F.col("kind") != TITLE)), told_by(AS_PROSE, F.lit(False))).alias("best"),
        (at(VALUE + 1, "n_on")("value_on")), (at(VALUE + 1, "n_end")("value_end")),
        *[at(n, "n_all")(f"i{n}") for n in PREFIX_ORDERS],
        *[at(LETTERS + n, "n_on")(f"p{n}") for n in PREFIX_ORDERS],
    )
    word = F.lit(None).cast("boolean")
    for n in sorted(PREFIX_ORDERS, reverse=True):
        i, p = F.col(f"i{n}"), F.col(f"p{n}")
        word = F.coalesce(word, F.when(i + p > 0, (i == 0) & (p > 0)))
    goes_on = F.col("best.on") > F.col("best.end")
    why = F.when(F.col("value_on") > F.col("value_end"), F.lit("prefix")).when(word, F.lit("word")).when(goes_on, F.lit("sentence"))
    return per.select("row", why.alias("why")).where("why is not null")


def cut_texts(docs: DataFrame) -> DataFrame:
    """doc_id, source, why of each text that was cut off.

    why: prefix (a longer copy of the whole value goes on), word or sentence (the longest known window does, inside the last word
    or after it), limit (it ends at the length at which its source cuts), rule (a broken character or an open code block at its end). Copies
    of the text itself count once. Extra columns are ignored; a null source is a source of its own.
    """
    ends = materialise(endings(docs).withColumn("row", F.monotonically_increasing_id()), "endings")
    asked = ends.where("rule = 0")
    numbers = F.array(*[F.lit(n) for n in (*ORDERS, *[LETTERS + n for n in PREFIX_ORDERS], VALUE + 1, *[AS_PROSE + n for n in ORDERS])])
    every = F.arrays_zip(numbers.alias("n"), F.concat("follow", "part", F.array("value"), "prose").alias("key"))
    longest = F.element_at(F.array(*[F.lit(n) for n in ORDERS]), F.greatest(F.size(F.filter("follow", lambda k: k != 0)), F.lit(1)))
    tails = asked.select("row", "kind", "twin", longest.alias("longest"), F.inline(every)).toDF("row", "kind", "twin", "longest", "n", "key")
    tails = materialise(tails.where("key is not null and key <> 0"), "tails")
    keys = tails.select("key").unionByName(asked.select(F.explode(F.array("stem", "first")).alias("key")).where("key <> 0"))
    body = asked.where("value <> 0").select("body").distinct().toPandas()["body"].to_numpy(dtype=np.int64)  # lengths, as many as a text may have
    lengths = np.zeros(int(body.max(initial=0)) + 1, dtype=bool)
    lengths[body] = True
    n = tails.count()
    told = _told(_seen(tails, _facts(docs, tails, bloom(keys, n), lengths), n))
    all_ends = materialise(ends.join(told, "row", "left").withColumn("why", F.when(F.col("rule") == 1, F.lit("rule")).otherwise(F.col("why"))).select("doc_id", "source", "n_chars", "n_bytes", "mark", "kind", "why"), "told")
    discard(ends, tails)
    return _limits(all_ends)


def _limits(ends: DataFrame) -> DataFrame:
    """Adds the texts that end in prose, without a mark of omission, and are exactly as long as a limit of their source."""
    ends = ends.withColumn("_s", F.coalesce("source", F.lit("\0")))
    long = ends.select("_s", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("b").alias("unit"), F.col("n_bytes").alias("length")))).alias("l"), F.col("why").isNotNull().alias("cut"))
    peaks = long.groupBy("_s", F.col("l.unit").alias("unit"), F.col("l.length").alias("length")).agg(F.sum(F.col("cut").cast("int")).alias("k"), F.count(F.lit(1)).alias("m"))
    around = F.sum("k").over(Window.partitionBy("_s", "unit").orderBy("length").rangeBetween(-2, 2))  # over the lengths that occur
    cuts = F.sum("k").over(Window.partitionBy("_s", "unit"))
    peaks = peaks.withColumn("others", around - F.col("k")).withColumn("cuts", cuts).where((F.col("k") >= PEAK) & (F.col("k") >= LIMIT_SHARE * F.col("cuts")) & (F.col("k") >= PEAK * F.col("others")) & (F.col("k") * 2 > F.col("m")))
    units = {u: peaks.where(F.col("unit") == u).select("_s", F.col("length").alias(f"n_{w}"), F.lit(True).alias(f"at_{u}")) for u, w in (("c", "chars"), ("b", "limit"))}
    # a limit in bytes may leave up to three bytes of a character unused
    cases = F.explode(F.sequence(F.col("n_bytes"), F.col("n_bytes") + 3))
    near = ends.select("_s", "n_bytes").distinct().select("_s", "n_bytes", cases.alias("n_limit")).join(units["b"], ["_s", "n_limit"]).select("_s", "n_bytes", "at_b").distinct()
    out = ends.join(units["c"], ["_s", "n_chars"], "left").join(near, ["_s", "n_bytes"], "left")
    here = F.coalesce("at_c", "at_b", F.lit(False))
    out = out.withColumn("why", F.coalesce("why", F.when(here & ~F.col("mark") & (F.col("kind") == PROSE), F.lit("limit"))))
    return out.where("why is not null").select("doc_id", "source", "why")


def cut_shares(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, share of cut texts, of every source."""
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    k = cut.groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    both = n.join(k, n["source"].eqNullSafe(k["source"]), "left").select(n["source"], "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))
    return both.withColumn("share", F.round(F.col("n_cut") / F.col("n_docs"), 6))

