"""Data-preparation operators against brute force on small fixtures, with the awkward cases."""

import json
import math
import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftwell.kernels import outliers
from driftwell.operators import eager, grid, late, shred
from driftwell.operators.sequence import in_chunks, with_positions
from driftwell.operators.spikes import faulty_residuals, spikes

START = datetime(2021, 1, 4, tzinfo=UTC)
CLASH = ["_key", "_t", "_idx", "n", "value", "key", "_chunk", "_slot", "_bucket", "rec_id"]


def clashing(df):
    """The frame with extra columns named like the operators' own."""
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# -- positions ---------------------------------------------------------------------------------------


def test_positions_and_chunks_cover_each_reading_once(spark):
    rows = [("a", i, i // 2) for i in range(200)] + [("b", i, i) for i in range(7)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, id int, t int")
    placed = with_positions(df, "k", F.floor(F.col("t") / 10), ["t"])
    got = {r["id"]: (r["_idx"], r["_n"]) for r in placed.where("k = 'a'").collect()}
    assert all(got[i] == (i // 2, 100) for i in range(200)) and placed.count() == 207
    cut = in_chunks(placed, 16, 3)
    assert cut.where("_own").count() == 207
    spans = {r["_chunk"]: (r["lo"], r["hi"]) for r in cut.where("k = 'a'").groupBy("_chunk").agg(F.min("_idx").alias("lo"), F.max("_idx").alias("hi")).collect()}
    assert spans[1] == (13, 34) and spans[0] == (0, 18) and spans[6] == (93, 99)


# -- spikes ------------------------------------------------------------------------------------------

READING = "record_id long, state_key string, event_time timestamp, measurement array<double>"


def series(key, values, first=0, step=60):
    return [(first + i, key, START + timedelta(seconds=step * i), v) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([("temp", -60.0, 90.0)], "kind string, low_limit double, high_limit double")


def found(df):
    return {r["rec_id"]: r for r in df.collect()}


def test_spikes_stuck_runs_and_limits(spark, limits):
    rng = np.random.default_rng(1)
    base = 20 + 3 * np.sin(np.arange(300) / 40) + rng.normal(0, 0.2, 300)
    v = base.copy()
    v[50] += 4
    v[[120, 121, 122]] -= 5
    v[200:260] += 6  # a level that lasts
    v[280:292] = 21.5  # stuck
    v[20] = 95.0
    df = spark.createDataFrame(series("s/temp/1", [[float(x)] for x in v]), READING)
    got = found(spikes(clashing(df), limits))
    assert {i for i, r in got.items() if r["spike"]} == {50, 120, 121, 122}
    assert {i for i, r in got.items() if r["stuck"]} == set(range(280, 292)) and {i for i, r in got.items() if r["limit_violation"]} == {20}


def test_spikes_do_not_depend_on_chunks(spark, limits):
    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(0, 0.02, 1500)) + rng.normal(0, 0.3, 1500)
    at = rng.choice(1500, 25, replace=False)
    v[at] += rng.choice([-1, 1], 25) * rng.uniform(4, 9, 25)
    v[700:715] = 1.25
    df = spark.createDataFrame(series("s/temp/1", [[float(x)] for x in v]), READING)
    whole, cut = found(spikes(df, limits)), found(spikes(df, limits, chunk=200))
    assert set(whole) == set(cut) and set(at) - set(range(700, 715)) <= set(whole)


def test_chunks_share_the_noise_of_their_source(spark, limits):
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(0, 0.1, 600), rng.normal(0, 1.0, 600)] + 20
    df = spark.createDataFrame(series("s/temp/1", [[float(x)] for x in v]), READING)
    sets = [{i for i, r in found(spikes(df, limits, chunk=c)).items() if r["spike"]} for c in (5000, 400, 150)]
    assert sets[0] == sets[1] == sets[2] and min(sets[0]) >= 600


def test_more_models_than_are_broadcast(spark, limits, monkeypatch):
    from driftwell.operators import spikes as module

    rng = np.random.default_rng(14)
    rows = [r for k in range(5) for r in series(f"s/temp/{k}", [[float(x)] for x in rng.normal(0, 1, 60) + 30 * (np.arange(60) == 20 + k)], first=100 * k)]
    df = spark.createDataFrame(rows, READING)
    monkeypatch.setattr(module, "FEW", 0)
    assert set(found(spikes(df, limits))) == {100 * k + 20 + k for k in range(5)}


def test_statistics_of_parts_add_up_to_those_of_the_whole():
    y = np.cumsum(np.random.default_rng(6).normal(0, 1, 500).round(1))
    whole = outliers.statistics(y, np.ones(500, bool))
    parts = defaultdict(int)
    for lo in range(0, 500, 70):
        own = np.zeros(500, bool)
        own[lo : lo + 70] = True
        near = slice(max(0, lo - 20), lo + 90)
        for k, n in outliers.statistics(y[near], own[near]).items():
            parts[k] += n
    assert {k: n for k, n in parts.items() if n} == {k: n for k, n in whole.items() if n}


def judged(y):
    flags, _ = outliers.spikes(y, *outliers.model(outliers.statistics(y, np.ones(len(y), bool))))
    return set(np.flatnonzero(flags).tolist())


def test_the_autoregression_decides():
    rng = np.random.default_rng(8)
    walk, noise = np.cumsum(rng.normal(0, 1, 400)), rng.normal(0, 1, 400)
    weights = [outliers.model(outliers.statistics(x, np.ones(400, bool)))[1] for x in (walk, noise)]
    assert weights[0][0] > 0.8 and max(weights[1]) < 0.4 and all(math.isclose(w.sum(), 1.0) for w in weights)
    steps = noise.copy()
    steps[100:] += 12
    steps[200:203] += 12
    steps[300:312] -= 12
    assert judged(steps) == {200, 201, 202, *range(300, 312)}
    # Where a walk is judged closely, the verdicts depend on the model.
    close = [set(np.flatnonzero(outliers.spikes(walk, 1.0, w, limit=3.0)[0]).tolist()) for w in (weights[0], np.full(6, 1 / 6))]
    assert close[0] != close[1]


def test_constant_and_rounded_series():
    flat = np.zeros(300)
    flat[10::30] = 50.0
    assert judged(flat) == set(range(10, 300, 30))
    rounded = np.random.default_rng(9).normal(0, 0.04, 300).round(1)
    rounded[5] = 3.0
    assert judged(rounded) == {5}
    masked = np.random.default_rng(10).normal(0, 1, 600)
    at = set(range(50, 550, 8))
    masked[sorted(at)] += np.linspace(20, 400, len(at))
    assert at <= judged(masked)


def test_spikes_awkward_rows(spark, limits):
    inf = float("inf")
    rows = [(1, None, START, [1.0]), (2, "s/temp/1", None, [1.0]), (3, "s/temp/1", START, None), (4, "s/temp/1", START, []), (5, "s/temp/1", START, [None]), (6, "s/temp/1", START, [inf]), (7, "s/other/1", START, [1e9]), (8, "nokind", START, [1e9]), (9, "s/temp/2", START, [99.0]), (10, "s/temp/2", START, [99.0])]
    df = spark.createDataFrame(rows, READING)
    assert set(found(spikes(df, limits))) == {5, 6, 9, 10}
    assert spikes(df.limit(0), limits).count() == 0 and spikes(df, limits.limit(0)).count() == 2
    short = spark.createDataFrame(series("s/temp/3", [[0.0], [50.0], [0.1], [0.2]]), READING)
    assert spikes(short, limits).count() == 0
    two = spark.createDataFrame(series("s/temp/4", [[float(math.sin(i * 7)), float(math.cos(i * 5))] if i != 33 else [0.0, 60.0] for i in range(60)]), READING)
    assert set(found(spikes(two, limits))) == {33}


def test_repeats_share_the_verdict_and_do_not_make_runs(spark, limits):
    rows = series("s/temp/1", [[float(x)] for x in np.random.default_rng(3).normal(0, 1, 40)])
    again = [(1000 + i, *rows[5][1:]) for i in range(15)]
    df = spark.createDataFrame(rows + again, READING)
    assert spikes(df, limits).count() == 0
    rows[8] = (*rows[8][:3], [80.0])
    df = spark.createDataFrame(rows + [(2000, *rows[8][1:])], READING)
    assert set(found(spikes(df, limits))) == {8, 2000}


def test_faulty_residuals(spark):
    kind = "output_id long, state_key string, state_index long, step_index long, residual struct<mean:array<double>,covariance:struct<num_rows:int,num_cols:int,vals:array<double>>>"
    res = lambda m, v: (m, (len(m), len(m), v))
    rows = [(i, "a", i, 0, res([0.1 * i], [1.0])) for i in range(5)]
    rows += [(10, "a", 10, 0, res([6.0], [1.0])), (11, "a", 11, 0, res([5.9], [1.0])), (12, "a", 12, 0, res([0.0], [0.0])), (13, "a", 13, 0, res([float("nan")], [1.0])), (14, "a", 14, 0, None), (15, "a", 15, 0, ([], None)), (16, None, 1, 0, res([9.0], [1.0])), (17, "a", None, 0, res([0.2], [-1.0])), (18, "a", 18, 0, ([0.1], None)), (19, "a", 19, 0, res([0.0, 0.5], [1.0, 0.0, 0.0, 0.005]))]
    rows += [(100 + i, "b", 2 * i, 0, res([0.3], [1.0])) for i in range(10)] + [(200 + i, "b", 2 * i + 1, 0, None) for i in range(9)]
    rows += [(300 + i, "c", i, 0, res([0.3], [1.0])) for i in range(9)] + [(320 + i, "c", 8, 0, res([0.3], [1.0])) for i in range(5)]
    df = spark.createDataFrame(rows, kind)
    assert set(found(faulty_residuals(clashing(df)))) == {10, 12, 13, 16, 17, 18, 19, *range(100, 110)}
    assert faulty_residuals(df.limit(0)).count() == 0


# -- shredding ---------------------------------------------------------------------------------------


def test_levels_of_the_textbook_record():
    kind = pa.struct([("links", pa.struct([("back", pa.list_(pa.int64())), ("fwd", pa.list_(pa.int64()))])), ("names", pa.list_(pa.struct([("langs", pa.list_(pa.string())), ("url", pa.string())])))])
    records = pa.array([{"links": {"back": [], "fwd": [20, 40, 60]}, "names": [{"langs": ["en-us", "en"], "url": "A"}, {"langs": None, "url": "B"}, {"langs": ["en-gb"], "url": None}]}, {"links": None, "names": [None]}, None], kind)
    leaves = shred.levels(records)
    fwd = leaves[("links", "fwd", "[]")]
    assert fwd.rep.tolist() == [0, 1, 1, 0, 0] and fwd.defn.tolist() == [5, 5, 5, 1, 0]
    langs = leaves[("names", "[]", "langs", "[]")]
    assert langs.rep.tolist() == [0, 2, 1, 1, 0, 0] and langs.values.to_pylist() == ["en-us", "en", None, "en-gb", None, None]
    record, at, cols = shred.rebuild(leaves, ("names", "[]"), {"url": ("url",), "langs": ("langs", "[]")})
    assert record.tolist() == [0, 0, 0] and at[0].tolist() == [0, 1, 2] and cols["url"].to_pylist() == ["A", "B", None] and cols["langs"].to_pylist() == [["en-us", "en"], None, ["en-gb"]]


def test_shredding_round_trip_on_random_records():
    rng = random.Random(5)
    gau = lambda: rng.choice([None, {"mean": rng.choice([None, [], [1.0], [2.0, None]]), "covariance": rng.choice([None, {"num_rows": 1, "num_cols": 1, "vals": rng.choice([None, [], [3.0]])}])}])
    out = lambda: rng.choice([None, {"state": gau(), "residual": gau(), "mixture": rng.choice([None, {"weights": rng.choice([None, [], [0.5, None]]), "distributions": rng.choice([None, [], [gau() for _ in range(rng.randint(1, 3))]])}])}])
    records = [rng.choice([None, {"batches": rng.choice([None, [], [rng.choice([None, {"outputs": rng.choice([None, [], [out() for _ in range(rng.randint(1, 3))]])}]) for _ in range(rng.randint(1, 3))]])}]) for _ in range(400)]
    array = pa.array(records, shred.RECORD)
    for part in (array, array.slice(37, 200)):
        rows = part.to_pylist()
        want = []
        for i, r in enumerate(rows):
            for b, bb in enumerate((r or {}).get("batches") or []):
                for o, oo in enumerate((bb or {}).get("outputs") or []):
                    for k, g in enumerate(((oo or {}).get("mixture") or {}).get("distributions") or []):
                        if g is not None:
                            want.append((i, b, o, k, g["mean"], (g["covariance"] or {}).get("vals"), (g["covariance"] or {}).get("num_rows")))
        record, at, cols = shred.rebuild(shred.levels(part), ("batches", "[]", "outputs", "[]", "mixture", "distributions", "[]"), {"mean": ("mean", "[]"), "vals": ("covariance", "vals", "[]"), "n": ("covariance", "num_rows")})
        assert list(zip(record.tolist(), *(a.tolist() for a in at), cols["mean"].to_pylist(), cols["vals"].to_pylist(), cols["n"].to_pylist(), strict=True)) == want


def test_payload_layouts(spark):
    g, m = {"mean": [1.0]}, {"weights": [0.4, 0.6], "distributions": [{"mean": [1.0], "covariance": [[1.0, 3.0], [2.0, 4.0]]}, None, {"mean": []}]}
    payloads = [None, "", "{", "[1]", "{}", '"text"', json.dumps({"outputs": {"state": g}}), json.dumps({"outputs": [None, {"state": json.dumps(g), "residual": None}]}), json.dumps({"run": {"batches": [{"outputs": []}, {"outputs": [{"mixtureModel": json.dumps(m)}]}]}}), json.dumps({"batches": None}), json.dumps({"batches": [None, {"outputs": {"residual": g}}]})]
    df = spark.createDataFrame(list(enumerate(payloads)) + [(None, payloads[6])], "raw_id long, payload string")
    rows = shred.nested_objects(clashing(df), "raw", "raw_id", payload="payload").collect()
    got = {(r["rec_id"], r["batch_no"], r["output_no"], r["child"], r["child_no"]): r for r in rows}
    assert set(got) == {(6, 0, 0, "state", 0), (7, 0, 1, "state", 0), (8, 1, 0, "component", 0), (8, 1, 0, "component", 2), (8, 1, 0, "weight", 0), (8, 1, 0, "weight", 1), (10, 1, 0, "residual", 0)}
    assert got[(8, 1, 0, "component", 0)]["covariance"] == [1.0, 2.0, 3.0, 4.0]
    assert shred.nested_objects(df.limit(0), "raw", "raw_id", payload="payload").count() == 0


# -- skewed keys -------------------------------------------------------------------------------------


def test_eager_aggregation_equals_the_join(spark):
    rng = random.Random(7)
    left = [(rng.choice(["h"] * 20 + ["a", "b", None]), rng.choice([None, float("nan"), 1.0, 2.0, -3.0])) for _ in range(300)]
    right = [(rng.choice(["h"] * 5 + ["b", "c", None]), rng.choice([None, 4.0, 0.5])) for _ in range(60)]
    l, r = spark.createDataFrame(left, "k string, x double"), spark.createDataFrame(right, "k string, y double")
    got = {x["key"]: x for x in eager.join_aggregate(eager.Side(clashing(l), "k", {"x": F.col("x")}), eager.Side(r, "k", {"y": F.col("y")})).collect()}
    want = defaultdict(list)
    for k, x in left:
        for k2, y in right:
            if k is not None and k == k2:
                want[k].append((None if x is None or math.isnan(x) else x, y))
    assert set(got) == set(want)
    for k, pairs in want.items():
        assert got[k]["pairs"] == len(pairs) and got[k]["x_pair_n"] == sum(x is not None for x, _ in pairs)
        assert math.isclose(got[k]["x_x_y_sum"] or 0.0, sum(x * y for x, y in pairs if x is not None and y is not None), abs_tol=1e-9)
        assert math.isclose(got[k]["y_pair_sum"] or 0.0, sum(y for _, y in pairs if y is not None), abs_tol=1e-9)
    full = eager.join_aggregate(eager.Side(l, "k", {}), eager.Side(r, "k", {}), "full").collect()
    assert {x["key"] for x in full} == {"h", "a", "b", "c", None}


def test_hot_keys_count_null_keys_in_the_total(spark):
    l = spark.createDataFrame([("h",)] * 2 + [(None,)] * 97 + [("c",)], "k string")
    r = spark.createDataFrame([], "k string")
    full = lambda a, b: eager.join_aggregate(eager.Side(a, "k", {}), eager.Side(b, "k", {}), "full")
    got = eager.hot_keys(full(l, r), ("l", "r")).collect()
    assert [(x["src"], x["state_key"], x["n"]) for x in got] == [("l", "h", 2)]
    assert eager.hot_keys(full(r, r), ("l", "r")).count() == 0


def test_own_statistics_and_roll_up(spark):
    l = spark.createDataFrame([("a/x", 1.0), ("a/x", 3.0), ("b/x", None), ("c/y", -2.0), (None, 5.0)], "k string, x double")
    r = spark.createDataFrame([("a/x", 2.0), ("d/y", 7.0)], "k string, y double")
    full = eager.join_aggregate(eager.Side(l, "k", {"x": F.col("x")}), eager.Side(r, "k", {"y": F.col("y")}), "full")
    got = {x["key"]: x for x in full.collect()}
    assert got["a/x"]["x_sq"] == 10.0 and got["a/x"]["x_n"] == 2 and got["b/x"]["x_n"] == 0 and got["d/y"]["y_sum"] == 7.0 and got["c/y"]["y_n"] == 0
    rolled = {x["grp"]: x for x in eager.roll_up(full, F.try_element_at(F.split("key", "/"), F.lit(2)), ["x", "y"]).collect()}
    assert set(rolled) == {"x", "y", None} and (rolled["x"]["left_n"], rolled["x"]["pairs"], rolled["x"]["x_sum"], rolled["x"]["x_max"]) == (3, 2, 4.0, 3.0) and rolled["y"]["y_sum"] == 7.0


# -- grids -------------------------------------------------------------------------------------------


def test_regular_grid(spark):
    steps = spark.createDataFrame([("temp", 600), ("bad", 0)], "kind string, grid_seconds int")
    at = lambda minutes: START + timedelta(minutes=minutes)
    rows = [("s/temp/1", at(1), [1.0]), ("s/temp/1", at(2), [3.0]), ("s/temp/1", at(41), [5.0, 2.0]), ("s/temp/1", at(180), [None]), ("s/temp/1", at(1440 + 5), [7.0]), ("s/temp/1", at(1440 + 25), [8.0]), ("s/temp/1", at(50), None), ("s/temp/1", None, [1.0]), (None, at(1), [1.0]), ("s/bad/1", at(1), [1.0]), ("nokind", at(1), [1.0])]
    df = spark.createDataFrame(rows, "state_key string, event_time timestamp, measurement array<double>")
    base = int(START.timestamp())
    made = grid.regular_grid(clashing(df), steps).collect()
    got = {(r["slot_epoch"] - base) // 600: (r["n"], r["value"], r["status"]) for r in made}
    assert {(r["slot_epoch"] - base) // 600 for r in made if r["within_day"]} == {*range(19), 144, 145, 146}
    assert set(got) == {*range(19), 144, 145, 146} | {*range(19, 144)}
    assert got[0] == (2, [2.0], "observed") and got[1] == (0, [2.0], "carried") and got[4] == (1, [5.0, 2.0], "observed")
    assert got[10][2] == "carried" and got[11] == (0, None, "missing") and got[18] == (1, [None], "observed") and got[145] == (0, [7.0], "carried")
    # Empty days between two with readings, also where the step doesn't divide the day.
    odd = spark.createDataFrame([("temp", 7 * 3600)], "kind string, grid_seconds int")
    ends = spark.createDataFrame([("s/temp/1", at(1), [1.0]), ("s/temp/1", at(5 * 1440), [2.0])], df.schema)
    slots = sorted(r["slot_epoch"] for r in grid.regular_grid(ends, odd).collect())
    assert slots == list(range(int(at(1).timestamp()) // 25200 * 25200, int(at(5 * 1440).timestamp()) + 1, 25200))
    assert grid.regular_grid(df.limit(0), steps).count() == 0 and grid.regular_grid(df, steps.limit(0)).count() == 0


# -- late events -------------------------------------------------------------------------------------


def late_rows(n=400, seed=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        arrival = START + timedelta(minutes=rng.randint(0, 3000))
        event = arrival - timedelta(minutes=rng.choice([0, 1, 5, 30, 119, 120, 121, 200, 900])) if rng.random() < 0.9 else arrival + timedelta(minutes=rng.randint(1, 100))
        rows.append((i, rng.choice(["a", "b", None]), rng.choice([event] * 20 + [None]), rng.choice([arrival] * 20 + [None]), rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 7.5])))
    return rows


def test_frontier_statistics_and_versions(spark):
    rows = late_rows()
    df = spark.createDataFrame(rows, "record_id long, state_key string, event_time timestamp, arrival_time timestamp, v double")
    marked = late.with_frontier(clashing(df).withColumn("frontier", F.lit(1)))
    got = {r["record_id"]: r["is_late"] for r in marked.collect()}
    top, want, kept = {}, {}, []
    for r in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[3] or datetime.min.replace(tzinfo=UTC), r[0])):
        want[r[0]] = r[1] in top and r[2] < top[r[1]] - timedelta(hours=2)
        late_by = top.get(r[1], r[2]) > r[2]
        top[r[1]] = max(top.get(r[1], r[2]), r[2])
        if not want[r[0]] and r[4] is not None and not math.isnan(r[4]):
            kept.append((r[1], int(r[2].timestamp()) // 3600 * 3600, r[4], late_by))
    assert got == want and any(want.values())
    groups = defaultdict(list)
    for k, p, v, _ in kept:
        groups[k, p].append(v)
    state = late.multiset(marked, F.col("v"))
    stats = {(r["key"], r["period"]): r for r in late.period_stats(state).collect()}
    assert set(stats) == set(groups)
    for k, vs in groups.items():
        s = stats[k]
        assert (s["n"], s["n_distinct"], s["min_value"], s["max_value"], s["median_value"]) == (len(vs), len(set(vs)), min(vs), max(vs), float(np.median(vs)))
    assert sum(r["n_corrections"] for r in stats.values()) == sum(x[3] for x in kept)
    halves = [late.multiset(marked.where(F.col("record_id") % 2 == i), F.col("v")) for i in (0, 1)]
    assert sorted(map(str, late.combine(*halves).collect())) == sorted(map(str, state.collect()))
    assert {r["record_id"] for r in late.left_out(clashing(df), bucket_us=7 * 60_000_000).collect()} == {i for i, x in want.items() if x}
    versions = late.period_versions(marked, F.col("v"))
    other = late.period_versions(late.with_frontier(df, bucket_us=7 * 60_000_000), F.col("v"))
    assert sorted(map(str, versions.collect())) == sorted(map(str, other.collect()))
    day = lambda t: -46296297 if t is None else int(t.timestamp()) // 86400
    batches = defaultdict(list)
    for r in rows:
        if r[0] in want and not want[r[0]] and r[4] is not None and not math.isnan(r[4]):
            batches[r[1], int(r[2].timestamp()) // 3600 * 3600].append((day(r[3]), r[4]))
    for r in versions.collect():
        vs = [v for b, v in batches[r["key"], r["period"]] if b <= r["as_of_batch"]]
        assert (r["n"], r["n_distinct"], r["min_value"], r["max_value"], r["median_value"]) == (len(vs), len(set(vs)), min(vs), max(vs), float(np.median(vs)))
    last = versions.groupBy("key", "period").agg(F.max_by("n", "as_of_batch").alias("n")).collect()
    assert all(r["n"] == len(groups[r["key"], r["period"]]) for r in last) and versions.count() >= len(groups)
    assert late.period_stats(late.multiset(late.with_frontier(df.limit(0)), F.col("v"))).count() == 0


def test_queries_and_sql_names_agree():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {f"p{n}_found" for n in (1, 2, 3, 4, 5)} <= set(q)
