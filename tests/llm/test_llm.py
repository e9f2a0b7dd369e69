"""The problems on texts, vectors and sketches against brute force."""

import base64
import math

import numpy as np
import pandas as pd
import pytest

from lodeframe.llm import clusters, cutoffs, leaks, percentiles, tokens

DOC = "doc_id long, text string, source string, n long, key long"


# 2


def blobs(seed=3, k=6, size=40, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(k):
        centre = rng.standard_normal(dim)
        for _ in range(size + 7 * c):
            out.append((centre + 0.15 * rng.standard_normal(dim)) * rng.uniform(0.01, 50))
    pair = rng.standard_normal(dim)
    out += [pair, pair * 3.0] + [rng.standard_normal(dim) for _ in range(25)]
    return out


def brute_clusters(rows):
    ids = sorted(rows)
    x = np.stack([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    comp = {}
    for i in range(len(ids)):
        if i in comp:
            continue
        comp[i], todo = i, [i]
        while todo:
            j = todo.pop()
            for n in np.flatnonzero(x @ x[j] >= 0.8):
                if int(n) not in comp:
                    comp[int(n)] = i
                    todo.append(int(n))
    groups = {}
    for i, c in comp.items():
        groups.setdefault(c, []).append(ids[i])
    return sorted((i, min(g)) for g in groups.values() if len(g) > 1 for i in g)


@pytest.mark.parametrize("parts", [1, 12])
def test_clusters(spark, parts):
    vs = {f"{i:036x}": [float(np.float32(a)) for a in v] for i, v in enumerate(blobs(), 1)}
    rows = [(k.upper(), v, 0, 1) for k, v in vs.items()] + [(k, v, 0, 1) for k, v in list(vs.items())[:30]]
    bad = [("f" * 36, None), ("e" * 36, [0.0] * 64), ("d" * 36, [1.0] * 63), ("c" * 36, [float("nan")] + [1.0] * 63), ("b" * 36, [float("inf")] + [1.0] * 63), ("a" * 36, [None] + [1.0] * 63), (None, [1.0] * 64), ("0" * 36, [1.0] * 64)]
    df = spark.createDataFrame(rows + [(i, v, 0, 1) for i, v in bad], "id string, vector array<float>, cluster int, n long").repartition(parts)
    got = sorted(map(tuple, clusters.found(df).collect()))
    assert got == brute_clusters({k: np.array(v) for k, v in vs.items()})
    described = clusters.described(df).collect()
    assert {r.cluster_id for r in described} == {c for _, c in got} and max(r["rank"] for r in described) == 5


def at_cosine(rng, c, size, dim=64):
    """``size`` vectors of which each two have cosine c."""
    q = np.linalg.qr(rng.standard_normal((dim, size + 1)))[0].T
    return [math.sqrt(c) * q[0] + math.sqrt(1 - c) * q[i] for i in range(1, size + 1)]


@pytest.mark.parametrize("parts", [1, 64])
def test_many_singles_and_small_clusters(spark, parts):
    rng = np.random.default_rng(18)
    small = np.concatenate([np.stack(at_cosine(rng, c, 3)) for c in (0.81, 0.85, 0.9) for _ in range(500)])
    vs = np.concatenate([small, rng.standard_normal((40_000, 64))]).astype(np.float32)
    at = rng.permutation(len(vs)) + 1
    df = spark.createDataFrame(pd.DataFrame({"id": [f"{i:036x}" for i in at], "vector": vs.tolist()}), "id string, vector array<float>").coalesce(1)
    got = {r.id: r.cluster_id for r in clusters.found(df if parts == 1 else df.repartition(parts)).collect()}
    assert got == {f"{i:036x}": f"{min(g):036x}" for g in at[: len(small)].reshape(-1, 3).tolist() for i in g}


@pytest.mark.parametrize("parts", [1, 6])
def test_loose_clusters(spark, parts):
    rng = np.random.default_rng(12)
    groups = [at_cosine(rng, c, size) for c in (0.81, 0.83, 0.85, 0.87, 0.89) for size in (2, 2, 2, 3, 5, 30)]
    vs = [v for g in groups for v in g] + list(rng.standard_normal((300, 64)))
    rows = {f"{i:036x}": v for i, v in zip(rng.permutation(len(vs)) + 1, vs)}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows.items()], "id string, vector array<float>").repartition(parts)
    got = sorted(map(tuple, clusters.found(df).collect()))
    assert got == brute_clusters(rows) and len(got) == sum(map(len, groups))


def test_more_clusters_than_a_tree_has_leaves(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MAX_LEAVES", 60)
    rng = np.random.default_rng(13)
    vs = [v for _ in range(400) for v in at_cosine(rng, 0.85, 3)] + list(rng.standard_normal((200, 64)))
    rows = {f"{i:036x}": v for i, v in zip(rng.permutation(len(vs)) + 1, vs)}
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows.items()], "id string, vector array<float>").repartition(10)
    once = clusters.usable_nodes(df)
    means = list(clusters._centres(clusters.partition_summaries(once.repartition(2))))
    assert max(map(len, means)) <= 60 and sum(map(len, means)) > 300
    own = np.concatenate(means)
    assert (np.linalg.norm(own, axis=1) >= math.sqrt(0.8)).all()  # none is mixed
    got = sorted(map(tuple, clusters.found(df).collect()))
    assert got == brute_clusters(rows) and len(got) == 1200


def test_pairs_in_a_large_rest(spark, monkeypatch):
    rng = np.random.default_rng(14)
    vs = np.concatenate([np.stack(at_cosine(rng, 0.81, 2)) for _ in range(150)] + [rng.standard_normal((66_000, 64))]).astype(np.float32)
    at = rng.permutation(len(vs)) + 1
    pdf = pd.DataFrame({"id": [f"{i:036x}" for i in at], "vector": vs.tolist()})
    df = spark.createDataFrame(pdf, "id string, vector array<float>").repartition(12)
    got = {r.id: r.cluster_id for r in clusters.found(df).collect()}
    want = {f"{i:036x}": f"{min(a, b):036x}" for a, b in at[:300].reshape(-1, 2) for i in (a, b)}
    assert got == want
    monkeypatch.setattr(clusters, "COMPARED", 100)  # in several steps
    few = clusters.usable_nodes(df.where(df.id.isin(list(want))))
    assert {r.id: r.cluster_id for r in clusters.least_similar(few, 300).collect()} == want
    monkeypatch.setattr(clusters, "SLICE", 1)
    near = clusters.described(df.where(df.id.isin(list(want)))).collect()
    assert {r.size for r in near} == {2} and {r["rank"] for r in near} == {1, 2} and all(abs(r.closeness - math.sqrt(0.905)) < 1e-4 for r in near) and len(near) == 300


def test_no_clusters(spark):
    df = spark.createDataFrame([], "id string, vector array<float>")
    assert clusters.found(df).count() == 0
    one = spark.createDataFrame([("a" * 36, [1.0] * 64)], "id string, vector array<float>")
    assert clusters.found(one).count() == 0 and clusters.clusters(one).first().size == 1


def test_tree_and_ward():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    x = clusters._units(np.concatenate([x, np.repeat(x[:3], 200, axis=0) + 0.01 * rng.standard_normal((600, 16))]))
    t = clusters.FeatureTree(16)
    t.add(np.ones(len(x)), x)
    assert t.n.sum() == len(x) and np.allclose(t.total.sum(axis=0), x.sum(axis=0))
    assert np.allclose(t.inner.sum(axis=0), x.sum(axis=0)) and np.bincount(t.parent).max() <= 10 * clusters.BRANCH
    n, total = clusters.ward(np.array([2.0, 3.0, 4.0]), np.array([[2.0, 0], [2.97, 0.3], [0, 4.0]]))
    assert sorted(n) == [4, 5] and np.allclose(total.sum(axis=0), [4.97, 4.3])
    assert len(clusters.ward(np.zeros(0), np.zeros((0, 2)))[0]) == 0


def test_chains_merge_what_the_cheapest_first_merges():
    rng = np.random.default_rng(17)
    groups = [np.stack(at_cosine(rng, 0.9, 8)) for _ in range(12)]
    x = np.concatenate(groups)[rng.permutation(96)]
    n = rng.integers(1, 9, 96).astype(float)
    # average cosines of 0.95 or more only within parts of the groups
    for limit in (0.8, 0.93):
        a, b = clusters._ward(n, x * n[:, None], limit)
        m, t, done = n.copy(), x * n[:, None], False
        while not done:
            mean = t / m[:, None]
            s = mean @ mean.T
            sq = np.diag(s)
            cost = np.where(s >= limit, m[:, None] * m[None, :] / (m[:, None] + m[None, :]) * (sq[:, None] + sq[None, :] - 2 * s), np.inf)
            np.fill_diagonal(cost, np.inf)
            i, j = divmod(int(cost.argmin()), len(m))
            done = not np.isfinite(cost[i, j])
            if not done:
                t[i] += t[j]
                m[i] += m[j]
                m, t = np.delete(m, j), np.delete(t, j, axis=0)
        assert sorted(a) == sorted(m) and np.allclose(np.sort(b.sum(axis=1)), np.sort(t.sum(axis=1)))
    a, _ = clusters._ward(np.ones(3000), clusters._units(np.ones((3000, 8)) + 0.01 * rng.standard_normal((3000, 8))), 0.8)
    assert a.tolist() == [3000]


def test_a_full_tree_gets_coarser(monkeypatch):
    monkeypatch.setattr(clusters, "MAX_LEAVES", 50)
    rng = np.random.default_rng(2)
    t = clusters.FeatureTree(4)
    t.add(np.ones(5000), clusters._units(rng.standard_normal((5000, 4))))
    assert t.n.sum() == 5000 and len(t.n) < 600 and t.similar < clusters.LEAF


# 7


def rank_error(values, got, p):
    x = np.sort(values)
    n = len(x)
    r = max(1, -(-p * n // 100))
    lo, hi = np.searchsorted(x, got, "left") + 1, np.searchsorted(x, got, "right")
    miss = 0 if lo <= r <= hi else min(abs(lo - r), abs(hi - r))
    return miss / (n - r + 1)


@pytest.mark.parametrize("kind", ["normal", "lognormal", "ties", "sorted", "reversed", "constant"])
def test_sketches_have_a_bounded_error_and_merge(kind):
    rng = np.random.default_rng(7)
    x = {
        "normal": rng.standard_normal(300_000), "lognormal": rng.lognormal(0, 3, 300_000), "ties": rng.integers(0, 20, 300_000).astype(float), "sorted": np.arange(300_000.0),
        "reversed": np.arange(300_000.0)[::-1], "constant": np.full(300_000, 4.0),
    }[kind]
    total = percentiles.Sketch()
    for part in np.array_split(x, 70):
        total.merge(percentiles.Sketch.from_bytes(percentiles.Sketch().add(part).to_bytes()))
    assert total.n == len(x) and len(total.to_bytes()) < 400_000
    for p, q in zip((50, 90, 99), total.quantiles()):
        assert rank_error(x, q, p) < 0.02
    assert total.quantiles((99.9,))[0] is not None


def test_small_sketches_are_exact():
    for n in (1, 2, 3, 99, 100, 1000):
        x = np.random.default_rng(n).standard_normal(n)
        got = percentiles.Sketch().add(x).quantiles()
        assert got == [float(np.sort(x)[math.ceil(p * n / 100) - 1]) for p in (50, 90, 99)]


def test_sketches_in_slices(spark, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(percentiles, "FAN_IN", 1)
    monkeypatch.setattr(percentiles, "OPEN", 2)
    rows = [(f"n{i % 7}", "X", dt.date(2025, 1, 1 + i % 3), float(i)) for i in range(3000)]
    days = percentiles.day_sketches(spark.createDataFrame(rows, "name string, def string, day date, value double").repartition(9))
    assert days.count() == 21 and days.agg({"n": "sum"}).first()[0] == 3000
    got = {r.name: (r.n, r.p50, r.p99) for r in percentiles.percentiles(days).collect()}
    for k in range(7):
        x = sorted(float(i) for i in range(3000) if i % 7 == k)
        assert got[f"n{k}"] == (len(x), x[math.ceil(len(x) / 2) - 1], x[math.ceil(0.99 * len(x)) - 1])


def test_percentiles_per_group(spark, tmp_path, monkeypatch):
    import datetime as dt

    nan = float("nan")
    chunks = [
        (1, "w", dt.date(2025, 1, 1), ["a", "A", "b", "zz", None, "a"], [1.0, 2.0, 3.0, 99.0, 98.0, nan], 0), (1, "w", dt.date(2025, 1, 1), ["a", "A", "b", "zz", None, "a"], [1.0, 2.0, 3.0, 99.0, 98.0, nan], 0),
        (2, "w", dt.date(2025, 1, 2), ["a", "b"], [None, 7.0], 0), (3, None, None, ["a"], [float("inf")], 0), (None, "w", dt.date(2025, 1, 2), ["b"], [7.0], 0), (None, "w", dt.date(2025, 1, 2), ["b"], [7.0], 0), (5, "w", None, None, None, 0), (6, "w", None, ["b", "b"], [1.0], 0),
    ]
    c = spark.createDataFrame(chunks, "chunk_no long, name string, day date, being_ids array<string>, values array<double>, n int")
    b = spark.createDataFrame([("a", "X", 1), ("a", "Y", 5), ("a", None, 9), (" B", "X", None), ("c", None, 1)], "id string, def string, updated_at long")
    days = percentiles.day_sketches(percentiles.values_of(c, b))
    got = {(r.name, r["def"]): (r.n, r.p50, r.p90, r.p99) for r in percentiles.percentiles(days).collect()}
    assert got == {("w", "Y"): (2, 1.0, 2.0, 2.0), ("w", "X"): (5, 7.0, 7.0, 7.0), (None, "Y"): (1, float("inf"), float("inf"), float("inf"))}
    assert percentiles.percentiles(percentiles.day_sketches(percentiles.values_of(c.limit(0), b))).count() == 0
    c.repartition(3).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    for most in (10, 0):  # by broadcast, and without
        monkeypatch.setattr(percentiles, "AGAIN", most)
        assert "_metadata" not in percentiles.values_of(stored, b).columns
        days = percentiles.day_sketches(percentiles.values_of(stored, b))
        assert {(r.name, r["def"]): (r.n, r.p50, r.p90, r.p99) for r in percentiles.percentiles(days).collect()} == got


# 8

TEXTS = [
    None, "", " ", "Hello  world\r\n\t it's <|endoftext|> I'LL don't", "naïve café 👩‍🔬 ½ ²³ १२३ 日本語テキスト。", "a" * 3000, "ab" * 2000 + " x", "\x1c\x1d\x85\xa0   .", "    indented\n\n\n  code {x: 12345678901234567890}",
    "ſ'S don'T", "﻿​ zero", "0" * 500, " \n" * 400, "supercalifragilistic antidisestablishmentarianism",
]


def test_ids_equal_those_of_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    ranks = tokens.load_ranks()
    ref = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    noise = ["".join(chr(int(c)) for c in rng.choice([*range(32, 127), 10, 9, 228, 233, 8364, 20013, 128512], 300)) for _ in range(60)]
    texts = TEXTS + noise
    df = spark.createDataFrame([(i, t, "s", 0, 0) for i, t in enumerate(texts)], DOC).repartition(3)
    got = {r.doc_id: r.ids for r in tokens.token_ids(df).collect()}
    assert got == {i: ref.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.token_ids(df.limit(0)).count() == 0


def test_speculation_is_verified():
    ranks = {bytes([i]): i for i in range(256)}
    for i, t in enumerate([b"cd", b"ab", b"bc", b"abc"]):
        ranks[t] = 256 + i
    e = tokens.Encoder(ranks)
    assert e.greedy(b"bcd") == [258, ord("d")] and e.exact(b"bcd") == [ord("b"), 256]
    for w in ("abcd", "bcd", "ababc", "aabbccdd", "abcabcabc"):
        assert e.encode_batch([w])[0] == (e.exact(w.encode()) if w.encode() not in ranks else [ranks[w.encode()]])
    assert e.repaired > 0


def test_the_vocabulary_is_a_rank_file(tmp_path):
    p = tmp_path / "v.tiktoken"
    p.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" " + str(i).encode() for i in range(256)))
    assert tokens.Encoder(tokens.load_ranks(str(p))).encode_batch(["é"]) == [[0xC3, 0xA9]]


# 9

ITEM = "Suppose that Orban and Weltun disagree about the lantern of a barge: the first claims 419, the second 1809. Explain why Orban survives if the culvert is replayed from position 443, given that the pulley was sealed before"
OTHER = "Given 77 paddock vectors and 12 orchard centres state the smallest quiver that lets Corvo skip the oxbow entirely and then show why Rion would reach the same cistern with only 45 comparisons"


def test_passages(spark, monkeypatch):
    w = ITEM.split()
    edited = w[:]
    edited[6], edited[15] = "around", "boat"  # with 20 words, two edits
    short = " ".join(w[:19])
    many = w[3:23]
    for i in (2, 9, 15):
        many[i] = "odd"
    cases = {
        1: ITEM, 2: "Before. " + ITEM.upper() + " After.", 3: " ".join(edited[:20]), 4: short, 5: " ".join(many), 6: "<p>" + " ".join(f"<b>{x}</b>" for x in w[:24]) + "</p>", 7: "> " + "\n> ".join([" ".join(w[:9]), " ".join(w[9:16]), " ".join(w[16:30])]),
        8: " ".join(w[:12])[:-3] + "-\n" + " ".join(w[:12])[-3:] + " " + " ".join(w[12:26]), 9: "​".join(ITEM), 10: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM), 11: "nothing of the kind", 12: None, 13: "", 14: OTHER + " and " + ITEM,
        15: " ".join(w[5:14] + w[15:26]), 16: " ".join(w[5:12] + ["really"] + w[12:26]), 17: "filler words here " * 3000 + ITEM + " more" * 5000, 18: " ".join(reversed(w)), 19: "**" + "** _".join(w[:22]), 20: " ".join(w[:6] + w[7:19]),
    }
    docs = spark.createDataFrame([(i, t, "s", 0, 0) for i, t in cases.items()] + [(1, ITEM, "s", 0, 0)], DOC)
    items = spark.createDataFrame([(7, "s", ITEM), (8, "s", OTHER), (9, "s", None), (10, "s", "too short")], "item_id long, subject string, text string")
    got = sorted(map(tuple, leaks.leaks(docs, items).collect()))
    assert got == sorted([(i, 7) for i in (1, 1, 2, 3, 6, 7, 8, 9, 10, 14, 15, 16, 17, 19)] + [(14, 8)])
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(leaks, "INDEX_WINDOWS", 20)  # several indexes
    assert sorted(map(tuple, leaks.leaks(docs, items).collect())) == got


def brute_passage(item, doc):
    """All runs of the item against all runs of the document that begin and end with the same words."""

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
            d = new
        return d[-1]

    for i in range(len(item) - 19):
        for j in range(i + 20, len(item) + 1):
            most = (j - i) // 10
            for a in range(len(doc)):
                for b in range(max(a + 1, a + (j - i) - most), min(len(doc), a + (j - i) + most) + 1):
                    if doc[a] == item[i] and doc[b - 1] == item[j - 1] and distance(item[i + 1 : j - 1], doc[a + 1 : b - 1]) <= most:
                        return True
    return False


def test_alignment_against_brute_force():
    rng = np.random.default_rng(9)
    outcomes = set()
    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(20, 34))
        doc = list(item[rng.integers(0, 4) :][:30])
        for _ in range(rng.integers(0, 5)):
            p = rng.integers(0, len(doc))
            doc[p : p + rng.integers(0, 2)] = [int(rng.integers(30, 40))] * int(rng.integers(0, 2))
        doc = list(rng.integers(0, 40, 5)) + doc + list(rng.integers(0, 40, 5))
        want = brute_passage(list(item), doc)
        outcomes.add(want)
        assert leaks.has_passage(item, np.array(doc)) == want
        run = leaks.runs_of(item, np.array(doc))
        assert run == max(k for k in range(21) if k == 0 or any(list(item[i : i + k]) == doc[j : j + k] for i in range(len(item) - k + 1) for j in range(len(doc) - k + 1)))
        assert not want or (run >= leaks.RUN and leaks.may_hold(item, np.array(doc), 40))
    assert outcomes == {True, False}


def test_the_multi_index_finds_all_within_the_radius():
    index = leaks.Index([(i, " ".join(f"w{(i * 31 + k * (i % 7 + 1)) % 97}" for k in range(40))) for i in range(1, 25)])
    rng = np.random.default_rng(10)
    q = index.prints[rng.integers(0, len(index.prints), 200)].copy()
    for i in range(len(q)):
        for b in rng.choice(64, rng.integers(0, 20), replace=False):
            q[i] ^= np.uint64(1) << np.uint64(b)
    got = set(zip(*map(np.ndarray.tolist, index.near(q))))
    want = {(int(a), int(b)) for a, b in np.argwhere(np.bitwise_count(q[:, None] ^ index.prints[None, :]) <= leaks.RADIUS)}
    assert got == want and want


# 10


def corpus():
    subjects = ["the night crew", "our tester", "the analyst", "a reviewer"]
    out = []
    for i in range(120):
        a, b = subjects[i % 4], ["vector index", "page cache", "lock table"][i % 3]
        out.append(f"After {i} rows had been copied, {a} reloaded the {b} in the archive room. The sum came out right because {a} repaired the {b} on Monday.")
        out.append(f"Notes on the {b}\n\n{a} checks the {b} every week.\n\n- reload the {b}\n- repair the {b}")
        out.append(f"It took {i} ms to merge the {b}. And so the search goes on…")
        out.append(f"It took {i} ms to merge the {b} again.\n\n— {a}")
    return out


def test_cut_texts(spark):
    full = "After 5 rows had been copied, our tester reloaded the page cache in the archive room. The sum came out right because our tester repaired the page cache on Monday."
    cases = {
        "word": full[:60], "sentence": "It took 3 ms to merge the page cache. After 7 rows had been", "mark": "It took 3 ms to merge the page cache. The sum came out...", "more": "It took 3 ms to merge the lock table. The sum came out right because [more]", "broken": "It took 3 ms to mer�",
        "fence": "It took 3 ms.\n```\nquery { a", "list": "It took 3 ms to merge the lock table again.\n\n- reload the vec",
    }
    fine = {
        "stop": full, "no stop": full[:-1], "title": "Notes on the page cache", "ellipsis": "It took 9 ms to merge the page cache. And so the search goes on…", "sign": "It took 3 ms to merge the lock table again.\n\n— our tester", "items": "It took 3 ms.\n\n- reload the page cache\n- repair the lock table",
        "code": "It took 3 ms.\n```\nquery { a }\n```", "code in a line": "It took 3 ms. ```\nquery { a }\n``` It took 3 ms.", "quote": 'He said "it took 3 ms."', "blank": " \n", "empty": "", "null": None, "emoji": "It took 3 ms to merge the page cache. 👍",
    }
    rows = [(i, t, "s", 0, 0) for i, t in enumerate(corpus())]
    rows += [(10_000 + i, t, None, 0, 0) for i, t in enumerate(cases.values())] + [(20_000 + i, t, "s", 0, 0) for i, t in enumerate(fine.values())]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    cut = cutoffs.cut_texts(df)
    got = {r.doc_id for r in cut.collect()}
    assert {k for i, k in enumerate(cases) if 10_000 + i not in got} == set()
    assert {k for i, k in enumerate(fine) if 20_000 + i in got} == set()
    assert not [i for i in got if i < 10_000]
    shares = {r.source: (r.n_docs, r.n_cut) for r in cutoffs.cut_shares(df, cut).collect()}
    assert shares[None] == (len(cases), len(cases)) and shares["s"] == (len(rows) - len(cases), 0)
    assert cutoffs.cut_texts(df.limit(0)).count() == 0


def test_one_longer_copy_is_enough(spark):
    item = "It took 3 ms.\n\n- inspect the copper valve beside the northern pump with our new lamp every night"
    texts = {1: item + " before the watch changes", 2: item, 3: item} | {10 + i: f"It took {i} ms.\n\n- close gate {w} every night" for i, w in enumerate(["one", "two", "three", "four", "five", "six"])}
    df = spark.createDataFrame([(i, t, "s", 0, 0) for i, t in texts.items()], DOC)
    assert {r.doc_id for r in cutoffs.cut_texts(df).collect()} & {2, 3, *range(10, 16)} == {2, 3}


def test_a_value_that_goes_on_elsewhere_was_cut(spark):
    whole = "Vor dem Umbau wurden die Messwerte der nordlichen Anlage mit denen des Archivs verglichen und neu geordnet"
    title = "A heading of some length that stands above the text of a report"
    texts = {1: whole + ", ehe sie gingen.", 2: whole, 3: whole[:-3] + "...", 4: whole[:40], 5: title, 6: title + "\n\nText below it.", 7: whole[:60] + "\n", 8: "x" + whole[:70], 9: whole + "."}
    df = spark.createDataFrame([(i, t, None, 0, 0) for i, t in texts.items()] + [(2, whole, None, 0, 0)], DOC).repartition(3)
    got = sorted((r.doc_id, r.why) for r in cutoffs.cut_texts(df).collect() if r.why == "prefix")
    # 2 goes on in 1 and ends in 9: a tie goes to the text; 4 is too short for a whole value, 8 no beginning of another
    assert got == [(3, "prefix"), (7, "prefix")]
    longer = df.where("doc_id <> 9")
    assert sorted(r.doc_id for r in cutoffs.cut_texts(longer).collect() if r.why == "prefix") == [2, 2, 3, 7]


def test_values_against_brute_force():
    rng = np.random.default_rng(15)
    base = ["".join(rng.choice(list("ab c\n"), 300)) for _ in range(4)]
    texts = [b[: rng.integers(1, 300)] for b in base for _ in range(40)]
    values = cutoffs._values(texts)
    lengths = np.zeros(301, dtype=bool)
    lengths[[len(t) for t in texts]] = True
    everything = np.full(1 << 10, 255, dtype=np.uint8)
    found = {}
    for keys, on, end in cutoffs._longer_values(texts, everything, lengths):
        for k, a, b in zip(keys.view(np.int64).tolist(), on, end):
            x = found.setdefault(k, [0, 0])
            x[0] += a
            x[1] += b
    for t, (_, k) in zip(texts, values):
        longer = [x[len(t) :].lstrip(" \t")[:1] for x in texts if len(x) > len(t) and x.startswith(t)]
        stops = sum(c in ("", "\n") for c in longer)
        assert (k == 0) == (len(t) < cutoffs.WHOLE) and (k == 0 or found.get(k, [0, 0]) == [len(longer) - stops, stops])


def test_limits_of_a_source(spark):
    ends = [(i, "a", 500, 500, False, 0, "word") for i in range(20)] + [(20 + i, "a", 300 + 7 * i, 300, False, 0, "word") for i in range(5)] + [(40, "a", 500, 500, False, 0, None), (41, "a", 500, 500, True, 0, None), (42, "b", 500, 500, False, 0, None), (43, "a", 307, 307, False, 0, None), (44, "a", 500, 500, False, 1, None)]
    ends += [(60 + i, None, 250 - i % 3, 255 - i % 4, False, 0, "word") for i in range(12)] + [(80, None, 249, 253, False, 0, None)]
    df = spark.createDataFrame(ends, "doc_id long, source string, n_chars long, n_bytes long, mark boolean, kind int, why string")
    assert sorted(r.doc_id for r in cutoffs._limits(df).collect() if r.why == "limit") == [40]
    assert cutoffs._limits(df.limit(0)).count() == 0


def keys_of_the_end(text):
    lines, first = cutoffs._tail(cutoffs._lines(text))
    t = cutoffs.scan([lines], [first])
    at = len(t.hash) - 1
    with np.errstate(over="ignore"):
        stem = int(t.stems(np.array([at]), t.size[[at]])[0])
    return cutoffs.tail_keys(t, at, len(t.hash), cutoffs.PROSE, stem)


def test_keys_of_tails_are_keys_of_windows():
    text = "One two three four five six seven eight nine ten eleven twelve"
    follow, part = keys_of_the_end("Above.\n\n" + text)
    everything, none = np.full(1 << 10, 255, dtype=np.uint8), np.zeros(1, dtype=bool)
    inside = cutoffs._count(["First line here.\n" + text + "s are there and more."], everything, none)
    assert set(part) <= set(inside["key"]) and not set(follow) & set(inside["key"])
    inside = cutoffs._count(["First line here.\n" + text + " and more."], everything, none)
    assert set(follow) <= set(inside["key"])
    assert inside.set_index("key").loc[follow[-1], "n_on"] == 1


ODD = ["a", "- x", "Title only", "\n\nword", "one\n\n\n\n\ntwo three", " \n \n- a b\n— c d", "x " * 40 + "\n" * 9 + "Key: value", "", "  ", "....... a... b....c", "中文字 abc中d 12ab_3 _x ²³ ١٢", "1) first\n2. second\n# Head\n## y", "wait… — no - name\nA. — Bob", "\x00a\x85b\u2028c", "naïve café!?", "...", "a...\n...b"]


def plain_tokens(text):
    """(token, kind) one by one, as the arrays should have them."""
    out, first = [("\n", 0)], True
    for line in cutoffs._lines(text):
        found = cutoffs.TOKEN.findall(line.replace("\0", " "))
        kind = cutoffs._kind(line)
        if kind == 0 and first and len(found) <= cutoffs.TITLE_TOKENS and found[-1] not in cutoffs.ENDS:
            kind = cutoffs.TITLE
        first = False
        out += [(w, kind) for w in found] + [("\n", 0)]
    return out[:-1] if len(out) > 1 else out


def test_arrays_of_tokens_against_plain_ones():
    texts = [t for t in corpus() if t] + ODD
    t = cutoffs.scan([cutoffs._lines(x) for x in texts])
    want = [(i, *w) for i, x in enumerate(texts) for w in plain_tokens(x)]
    assert t.text.tolist() == [i for i, *_ in want] and t.kind.tolist() == [k for *_, k in want]
    assert t.is_line.tolist() == [w == "\n" for _, w, _ in want] and t.is_end.tolist() == [w in cutoffs.ENDS for _, w, _ in want]
    assert t.size.tolist() == [len(w) if w[0].isalpha() and len(cutoffs.TOKEN.findall(w[0] + "a")) == 1 else 0 for _, w, _ in want]
    same = {}
    for h, (_, w, _) in zip(t.hash.tolist(), want):
        assert same.setdefault("0" if w[0].isdigit() else w, h) == h
    assert len(set(same.values())) == len(same)
    with np.errstate(over="ignore"):
        at = np.flatnonzero(t.size > 2)
        beginnings = dict(zip(t.stems(at, t.size[at] - 1).tolist(), [want[i][1][:-1] for i in at]))
        whole = {want[i][1]: int(h) for i, h in zip(np.flatnonzero(t.size), t.stems(np.flatnonzero(t.size), t.size[t.size > 0]))}
    assert all(whole.get(w, h) == h for h, w in beginnings.items())


def test_the_end_alone_gives_the_same_tail():
    for text in [t for t in corpus() if t] + ODD:
        lines = cutoffs._lines(cutoffs.split_end(text)[0])
        own, first = cutoffs._tail(lines)
        a, b = cutoffs.scan([lines]), cutoffs.scan([own], [first])
        assert a.kind[-1] == b.kind[-1] and a.hash[-12:].tolist() == b.hash[-12:].tolist() and (len(b.hash) > 12 or len(a.hash) == len(b.hash))


def test_marks_of_omission_are_found_at_the_end_alone():
    for text, want in {"a b...": ("a b", True), "a [more] …": ("a", True), "a. [x] b": ("a. [x] b", False), "...": ("", True), "a" + " ..." * 60: ("a", True), "x [not a mark, far too long] ": ("x [not a mark, far too long]", False), "end.": ("end.", False), "a. ...": ("a.", True)}.items():
        assert cutoffs.split_end(text)[:2] == want
        m = cutoffs.MARK.search(text.rstrip())
        assert (text.rstrip()[: m.start()].rstrip() if m else text.rstrip()) == want[0]


def test_the_filter_lets_pass_what_is_asked_for(spark):
    keys = np.random.default_rng(16).integers(-(2**63), 2**63, 5000)
    bits = np.frombuffer(cutoffs.bloom(spark.createDataFrame(pd.DataFrame({"key": keys[:2500]})), 2500), dtype=np.uint8)
    passed = cutoffs._kept(keys.view(np.uint64), bits)
    assert set(range(2500)) <= set(passed.tolist()) and len(passed) < 2600


def test_hot_tails_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(i, t + (" and then our tester reloaded the" if i % 5 == 0 else ""), "s", 0, 0) for i, t in enumerate(corpus())], DOC)
    want = sorted(map(tuple, cutoffs.cut_texts(df).collect()))
    monkeypatch.setattr(cutoffs, "HOT_SHARE", 0.9)
    assert sorted(map(tuple, cutoffs.cut_texts(df).collect())) == want and want


def test_the_subpackage_is_optional():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "lodeframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            for n in ast.walk(ast.parse(f.read_text())):
                if isinstance(n, ast.ImportFrom):
                    assert "llm" not in (n.module or "").split(".")
