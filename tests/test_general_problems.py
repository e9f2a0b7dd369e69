"""The general problems against brute force on small tables, with nulls, repeats, ties, empty tables and extra columns."""

import datetime as dt
import json
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.ids import NIL_ID, norm_id, ref_id, refers
from lodeframe.operators import changefeed, history, incremental, orphans, skew

A, B, C = "a" * 36, "b" * 36, "c" * 36
OPEN = 9223372036854775807

EDGE = "from_id string, to_id string, created_at long, weight double, ord long, n long, piece int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ids(spark):
    df = spark.createDataFrame([(" AB-c ",), ("",), (None,), (NIL_ID,), ("  ",), ("00000000-" + "0" * 28,)], "id string")
    assert [r[0] for r in df.select(norm_id("id")).collect()][:3] == ["abc", "", None]
    assert [r[0] for r in df.select(ref_id("id")).collect()] == ["abc", None, None, None, None, None]
    odd = spark.createDataFrame([("000",), ("0-0",), ("\u00a0",), ("x",)], "id string").unionByName(df)
    assert [r[0] for r in odd.select(refers("id")).collect()] == [r[0] is not None for r in odd.select(ref_id("id")).collect()]


# 1


def edges(spark):
    out = [(A.upper(), B, i, 1.5 if i % 3 else None, i, 0, 0) for i in range(60)]
    out += [(f"{i:036x}", B, 1, float("nan") if i == 7 else 2.0, 100 + i, 0, 0) for i in range(1, 140)]
    out += [(None, B, 5, 1.0, 300, 0, 0), (NIL_ID, B, 5, 1.0, 301, 0, 0), (" ", B, 5, 1.0, 302, 0, 0), (C, B, None, None, 303, 0, 0)]
    return spark.createDataFrame(out, EDGE)


def test_heavy_ids_are_exact(spark):
    e = edges(spark)
    assert rows(skew.heavy_from_ids(e, "t")) == [("t", A)]
    exactly = spark.createDataFrame([(A, B, 1, 1.0, 1, 0, 0)] * 2 + [(f"{i:036x}", B, 1, 1.0, i, 0, 0) for i in range(1, 99)], EDGE)
    assert rows(skew.heavy_from_ids(exactly, "t")) == [("t", A)]  # 2 of 100 is 2 %


def test_totals_of_hot_and_other_ids(spark):
    got = {r[0]: r[1:] for r in rows(skew.from_id_totals(edges(spark)))}
    assert got[A] == (60, 60.0, 59)
    assert got[f"{7:036x}"] == (1, None, 1)
    assert got[C] == (1, None, None)
    assert len(got) == 141


def test_empty_tables_of_edges(spark):
    e = spark.createDataFrame([], EDGE)
    assert rows(skew.heavy_from_ids(e, "t")) == [] and rows(skew.from_id_totals(e)) == []


# 3


def t(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


LOG = "log_no long, source_table string, run_no long, event string, read_upto timestamp_ntz, logged_at timestamp_ntz, extra string"


def test_runs_take_what_no_earlier_run_took(spark, tmp_path):
    log = spark.createDataFrame(
        [
            (1, "x", 1, "started", t(2), t(2), ""), (2, "x", 1, " Succeeded", t(2), t(2, 1), ""), (3, "x", 2, "succeeded", t(4), t(4), ""), (4, "x", 2, "ROLLED_BACK ", t(4), t(5), ""),
            (5, "x", 3, "succeeded", t(3), t(6), ""), (6, "x", 4, "succeeded", t(3), t(7), ""), (7, "x", 5, "started", t(9), t(9), ""), (8, "y", 9, "succeeded", t(9), t(9), ""), (9, "x", 6, "failed", t(8), t(8), ""),
        ],
        LOG,
    )
    windows, following = incremental.run_windows(log, "x")
    assert windows == [(1, t(2)), (3, t(3))] and following == 7
    recs = spark.createDataFrame([("a", 1, t(1)), ("a", 1, t(5)), ("b", 1, t(2)), ("c", 1, t(2, 1)), ("d", 1, t(3, 1)), ("e", None, None)], "rec_id string, rec_version long, arrived_at timestamp_ntz")
    runs = lambda lg, r, at: {x.rec_id: x.run_no for x in incremental.runs_of_records(lg, {"x": (r, r)}, str(tmp_path / at)).collect()}
    assert runs(log, recs, "1") == {"a": 1, "b": 1, "c": 3, "d": 7, "e": 7}
    assert incremental.run_windows(log.limit(0), "x") == ([], 1)
    assert set(runs(log.limit(0), recs, "2").values()) == {1}
    assert runs(log, recs.limit(0), "3") == {}


def test_a_run_that_dies_between_plan_and_commit(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame([(i, "x", i, "succeeded", t(i + 1), t(i + 1), "") for i in range(1, 9)], LOG)
    recs = spark.createDataFrame([(f"r{i % 40}", i % 3, t(1 + i % 12, i % 24)) for i in range(200)], "rec_id string, rec_version long, arrived_at timestamp_ntz")
    want = rows(incremental.runs_of_records(log, {"x": (recs, recs)}, str(tmp_path / "whole")))
    path = str(tmp_path / "dies")

    def dies(*_):
        raise RuntimeError("killed")

    for where in ("write", "commit"):
        with monkeypatch.context() as m:
            if where == "write":  # half of the rows reach the sink
                whole = incremental._batch
                m.setattr(incremental, "_batch", lambda *a: (whole(*a, F.pmod(F.xxhash64("rec_id"), F.lit(2)) == 0), dies()))
            else:
                m.setattr(incremental.BatchLedger, "commit", dies)
            with pytest.raises(RuntimeError):
                incremental.runs_of_records(log, {"x": (recs, recs)}, path)
    plan = incremental.BatchLedger(spark, f"{path}/x").plan({"x": 0})
    # later rows are not the replayed batch's: its plan was written before they came
    more = recs.unionByName(spark.createDataFrame([("late", 1, t(28))], recs.schema))
    assert rows(incremental.runs_of_records(log, {"x": (more, more)}, path)) == want
    assert plan["batch"] == 0 and incremental.BatchLedger(spark, f"{path}/x").plan({"x": 9})["batch"] == 1


def test_a_failed_batch_is_replayed_and_adds_nothing_twice(spark, tmp_path):
    ledger = incremental.BatchLedger(spark, str(tmp_path / "ledger"))
    src = spark.createDataFrame([("p", i, f"k{i}") for i in range(1, 6)] + [("q", 1, "z"), ("q", None, "n"), (None, 1, "m")], "part_of string, off long, k string")
    first = ledger.plan({"p": 3})
    sunk = ledger.sink(ledger.read(src, first, "part_of", "off"), "k", "off", None)
    assert sunk.count() == 3
    again = incremental.BatchLedger(spark, str(tmp_path / "ledger")).plan({"p": 5, "q": 1})
    assert again == first  # not committed, so the same offsets once more
    assert ledger.sink(ledger.read(src, again, "part_of", "off"), "k", "off", sunk).count() == 0
    ledger.commit(first)
    second = ledger.plan({"p": 5, "q": 1}, {"p": [(7, 4), (8, 5), (9, 99)]})
    assert sorted((r.k, r.part) for r in ledger.read(src, second, "part_of", "off").collect()) == [("k4", 7), ("k5", 8), ("z", None)]


def test_a_replay_adds_no_null_key_and_partitions_stay_apart(spark):
    rows_ = [("p", 1, None), ("p", 1, None), ("p", None, "k"), ("p", 2, "k"), ("q", 2, "k")]
    src = spark.createDataFrame(rows_, "part string, off long, k string")
    sink = incremental.BatchLedger.sink
    first = sink(src, "k", "off", None, "part")
    assert first.count() == 4
    assert sink(src, "k", "off", first, "part").count() == 0 and sink(src, "k", "off", first).count() == 0
    assert [tuple(r) for r in sink(src, ["k"], "off", first.where("part = 'p'"), "part").collect()] == [("q", 2, "k")]


def test_the_ledger_takes_each_record_of_both_tables_once(spark, small):
    from lodeframe.plans.core_queries import p3_found, p3_replayed

    found = p3_found(spark, small).collect()
    log = spark.read.parquet(f"{small}/run_log.parquet")
    following = {t: incremental.run_windows(log, t)[1] for t in ("beings", "wal_records")}
    want = sorted((r.source_table, int(r.run_no == following[r.source_table]), r.rec_id, str(r.rec_version)) for r in found)
    got = sorted((r.source_table, r.batch, r.rec_id, str(r.rec_version)) for r in p3_replayed(spark, small).collect())
    assert got == want and {b for _, b, *_ in got} == {0, 1}


# 4

CORE = "struct<def:string,status:int,name:string,code:string,weight:double,priority:int,category:string,created_at:long,updated_at:long>"
NODE = f"node_no long, being_id string, tx_begin long, tx_end long, created_at long, core {CORE}, piece int, n long"


def node(no, being, begin, end, created, status=0, name="x", code="", category=None):
    return (no, being, begin, end, created, ("D", status, name, code, 1.0, 1, category, 0, 0), 0, 0)


def brute_periods(nodes):
    best = {}
    for no, b, begin, end, created, core, *_ in nodes:
        if b is None or begin is None:
            continue
        end = OPEN if end is None else end
        if end <= begin:
            continue
        attrs = None if core is None else (core[1], core[2], core[3] or "", core[4], core[5], core[6] or "")
        key, rank = (b, begin), (created if created is not None else -(2**63), no)
        if key not in best or rank > best[key][0]:
            best[key] = (rank, end, attrs)
    by = defaultdict(list)
    for (b, begin), (_, end, attrs) in sorted(best.items()):
        by[b].append([begin, end, attrs])
    out = []
    for b, vs in by.items():
        for i, v in enumerate(vs[:-1]):
            v[1] = min(v[1], vs[i + 1][0])
        merged = []
        for begin, end, attrs in vs:
            if merged and merged[-1][1] == begin and merged[-1][2] == attrs:
                merged[-1][1] = end
            else:
                merged.append([begin, end, attrs])
        out += [(b, x, -1 if y == OPEN else y) for x, y, _ in merged]
    return sorted(out)


@pytest.mark.parametrize("pieces", [False, True])
def test_periods(spark, monkeypatch, pieces):
    if pieces:
        monkeypatch.setattr(history, "HOT_ROWS", 20)
        monkeypatch.setattr(history, "PIECES", 8)
    rng = random.Random(4)
    data = [node(i, rng.choice([A, A, A, B, C]), rng.randrange(1, 200), rng.choice([None, OPEN, rng.randrange(1, 260)]), rng.randrange(5), rng.randrange(2), "x", rng.choice([None, ""])) for i in range(400)]
    data += [node(900, None, 5, 9, 1), node(901, B, None, 9, 1), (902, C, 500, None, None, None, 0, 0)]
    df = spark.createDataFrame(data, NODE)
    assert sorted(map(tuple, history.periods(df).drop("attrs").collect())) == brute_periods(data)


def test_gaps_and_touching_periods(spark):
    data = [node(1, A, 1, 5, 1), node(2, A, 5, 9, 1), node(3, A, 12, None, 1), node(4, A, 12, 12, 9), node(5, A, 14, 20, 1, status=3), node(6, A, 14, 30, 2)]
    got = sorted(map(tuple, history.periods(spark.createDataFrame(data, NODE)).drop("attrs").collect()))
    assert got == [(A, 1, 9), (A, 12, 30)]
    empty = spark.createDataFrame([], NODE)
    assert rows(history.periods(empty)) == [] and rows(history.ledger(empty)) == []


def test_a_begin_with_most_captures_is_split(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT_ROWS", 20)
    monkeypatch.setattr(history, "PIECES", 8)
    rng = random.Random(40)
    data = [node(i, A, rng.choice([7, 7, 7, 30, 50]), rng.choice([None, 60]), rng.choice([None, *range(40)]), rng.randrange(3)) for i in range(300)]
    df = spark.createDataFrame(data, NODE)
    assert history._hot_bounds(history.captures(df))[1]
    assert sorted(map(tuple, history.periods(df).drop("attrs").collect())) == brute_periods(data)
    got = history.ledger(df).collect()
    assert len(got) == 300 and sum(r.believed for r in got) == 3
    for begin in (7, 30, 50):
        times = sorted((r[4] if r[4] is not None else -1, r[0]) for r in data if r[2] == begin)
        want = {no: after for (_, no), (after, _) in zip(times, times[1:])}
        assert {r.node_no: -1 if r.superseded_at is None else r.superseded_at for r in got if r.tx_begin == begin and not r.believed} == want


def test_the_ledger_keeps_what_was_superseded(spark):
    data = [node(1, A, 1, 5, 10), node(2, A, 1, 7, 20)]
    got = {r.node_no: r.superseded_at for r in history.ledger(spark.createDataFrame(data, NODE)).collect()}
    assert got == {1: 20, 2: None}


# 5

BEING = "id string, created_at long, updated_at long, tx_end long, month int, range int"


def brute_orphans(relations, beings, defs):
    norm = lambda x: None if x is None or x.strip().replace("-", "").lower() in ("", NIL_ID) else x.strip().replace("-", "").lower()
    born, last = {}, {}
    for i, created, updated, end, *_ in beings:
        k = norm(i)
        if k:
            born[k] = min([x for x in (born.get(k), created) if x is not None], default=None)
            rank = (updated if updated is not None else -(2**63), end is not None)
            last[k] = max(last.get(k, (-(2**63), False)), rank)
    for i, created in defs:
        born[norm(i)] = min([x for x in (born.get(norm(i)), created) if x is not None], default=None)
        last.setdefault(norm(i), (-(2**63), False))
    out = []
    for f, to, created, _, no, *_ in relations:
        for side, ref in (("from_id", norm(f)), ("to_id", norm(to))):
            if ref is None:
                continue
            if ref not in born:
                out.append((no, side, "missing"))
                continue
            if created is not None and born[ref] is not None and created < born[ref]:
                out.append((no, side, "late"))
            if created is not None and last[ref][1] and last[ref][0] > -(2**63) and created > last[ref][0]:
                out.append((no, side, "deleted"))
    return sorted(out)


def test_orphans(spark):
    rng = random.Random(5)
    month = 30 * 86400 * 10**9
    ids = [f"{i:036x}" for i in range(1, 150)]
    beings = []
    for i in ids[:100]:
        for _ in range(rng.choice([1, 1, 2, 3])):
            beings.append((rng.choice([i, i.upper(), f" {i}"]), rng.choice([None, rng.randrange(50) * month + rng.randrange(5)]), rng.choice([None, rng.randrange(20, 80) * month]), rng.choice([None, None, 7]), 0, 0))
    defs = [(i, rng.randrange(50) * month) for i in ids[95:110]]
    relations = [(rng.choice(ids[:3] + ids + [None, NIL_ID, "n/a"]), rng.choice(ids + ["", "  "]), rng.choice([None, rng.randrange(60) * month + rng.randrange(5)]), 1.0, n, 0, 0) for n in range(1500)]
    df = orphans.orphan_references(spark.createDataFrame(relations, EDGE), spark.createDataFrame(beings, BEING), spark.createDataFrame(defs, "id string, created_at long"))
    got = sorted(map(tuple, df.select("ord", "side", "reason").collect()))
    assert got == brute_orphans(relations, beings, defs)
    report = orphans.orphan_report(df).agg(F.sum("n")).first()[0]
    assert report == len(got)


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([(A, B, 1, 1.0, 1, 0, 0)], EDGE)
    none, nodefs = spark.createDataFrame([], BEING), spark.createDataFrame([], "id string, created_at long")
    assert rows(orphans.orphan_references(r, none, nodefs).select("ord", "side", "reason")) == [(1, "from_id", "missing"), (1, "to_id", "missing")]
    assert rows(orphans.orphan_references(r.limit(0), none, nodefs)) == []


# 6

WAL = "rec_no long, arrived_at timestamp_ntz, magic binary, payload_len int, seq long, payload string, crc32 long, id string, kind string"


def record(no, seq, tx, ops, damage=None):
    p = json.dumps({"tx_id": tx, "ops": ops}, ensure_ascii=False)
    b = p.encode()
    out = [no, t(1), b"WAL\x01", len(b), seq, p, zlib.crc32(b), "x", "y"]
    if damage == "magic":
        out[2] = b"LAW\x01"
    elif damage == "length":
        out[3] += 1
    elif damage == "crc":
        out[6] += 1
    elif damage == "null":
        out[5] = None
    return tuple(out)


def create(i, name="n"):
    return {"CreateBeing": {"being": {"core": {"id": i, "status": 1, "name": name, "weight": 1.5, "priority": 2, "category": "é"}, "ext": None}}}


def update(i, **fields):
    return {"UpdateBeing": {"id": i, "updates": [{"field_name": k, "new_value": v} for k, v in fields.items()]}}


def delete(i):
    return {"DeleteBeing": {"id": i}}


def brute_state(log):
    ok = {}
    for r in log:
        if r[2] == b"WAL\x01" and r[5] is not None and len(r[5].encode()) == r[3] and zlib.crc32(r[5].encode()) == r[6]:
            ok[r[4]] = json.loads(r[5])
    seen, state = set(), {}
    for seq in sorted(ok):
        p = ok[seq]
        if p["tx_id"] is not None and p["tx_id"] in seen:
            continue
        seen.add(p["tx_id"])
        for op in p["ops"]:
            (kind, o), = op.items()
            if kind == "CreateBeing":
                state[o["being"]["core"]["id"].lower()] = dict.fromkeys(changefeed.FIELDS, seq)
            elif kind == "DeleteBeing":
                state.pop(o["id"].lower(), None)
            elif kind == "UpdateBeing" and o["id"].lower() in state:
                for u in o["updates"]:
                    if u["field_name"] in changefeed.FIELDS:
                        state[o["id"].lower()][u["field_name"]] = seq
    return sorted((i, f, s) for i, fs in state.items() for f, s in fs.items())


def test_state_after_the_log(spark):
    rng = random.Random(6)
    log, ids = [], [A, B.upper(), C]
    for n in range(300):
        ops = [rng.choice([create(rng.choice(ids)), update(rng.choice(ids), weight=None, color="red"), update(rng.choice(ids), name="z", status=3), delete(rng.choice(ids)), {"CreateRelation": {"relation": {"from_id": A, "to_id": B}}}]) for _ in range(rng.randrange(4))]
        log.append(record(n, n + rng.choice([0, 1000]), rng.choice([n, n // 2, None]), ops, rng.choice([None] * 6 + ["magic", "length", "crc", "null"])))
    log += rng.sample(log, 60)
    rng.shuffle(log)
    df = spark.createDataFrame(log, WAL)
    assert sorted(map(tuple, changefeed.field_origins(df).collect())) == brute_state(log)


def test_fold_merges_in_any_order(spark):
    log = [record(1, 1, 1, [create(A)]), record(2, 2, 2, [update(A, name="q"), delete(B)]), record(3, 3, 3, [create(B)]), record(4, 4, 4, [delete(A)]), record(5, 5, 5, [create(A, "w")])]
    ev = changefeed.events(changefeed.transactions(spark.createDataFrame(log, WAL)))
    parts = [changefeed.fold(ev.where(c)) for c in ("seq >= 4", "seq in (1, 3)", "seq = 2")]
    merged = changefeed.merge(changefeed.merge(parts[0], parts[1]), parts[2])
    whole = changefeed.present(changefeed.fold(ev))
    assert rows(changefeed.present(merged)) == rows(whole)
    assert {r.id: (r.name.value, r.name.seq) for r in whole.collect()} == {A: ("w", 5), B: ("n", 3)}
    assert rows(changefeed.field_origins(spark.createDataFrame([], WAL))) == []
    assert {r.id: (r.weight, r.category) for r in changefeed.present_beings(spark.createDataFrame(log, WAL)).collect()} == {A: (1.5, "é"), B: (1.5, "é")}
