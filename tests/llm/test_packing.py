"""Packing: nothing lost, nothing too full, little unused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import packing
from driftwell.llm.packing import configuration_lp, pack, plan_bins, utilisation


def check(placed, items, capacities):
    rows = placed.collect()
    caps = dict(capacities)
    load, tokens, pieces = {}, {}, {}
    for r in rows:
        load[r.pack_id, r.bin] = load.get((r.pack_id, r.bin), 0) + r.n_tokens
        key = (r.pack_id, r.item_id)
        tokens.setdefault(key, []).append((r.piece_no, r.first_token, r.n_tokens))
        pieces[key] = r.n_pieces
    assert all(v <= caps[p] for (p, _), v in load.items())
    for p, c in caps.items():
        for i, n in items.items():
            got = sorted(tokens[p, i])
            assert len(got) == pieces[p, i] == max(1, -(-n // c)) and sum(x[2] for x in got) == n
            assert [x[1] for x in got] == [c * k for k in range(len(got))]
    return {p: 1 + max(b for q, b in load if q == p) for p in caps}


def test_all_items_are_placed_within_capacity(spark):
    rng = np.random.default_rng(1)
    items = {i: int(x) for i, x in enumerate(np.minimum(rng.lognormal(5.5, 0.9, 3000), 9000))} | {9001: 0, 9002: 1000, 9003: 2000, 9004: 2001}
    df = spark.createDataFrame(list(items.items()), "doc_id long, n long").withColumns({"bin": F.lit("x"), "rank": F.lit(1), "cls": F.lit(2)})
    caps = [(1, 1000), (2, 4096), (3, 50)]
    capacities = spark.createDataFrame(caps + [(4, None), (5, 0)], "pack_id int, capacity int")
    bins = check(pack(df, capacities, size="n"), items, caps)
    for p, c in caps:
        assert bins[p] <= 1.01 * sum(items.values()) / c + 3
    used = {r.pack_id: r for r in utilisation(pack(df, capacities, size="n"), capacities).collect()}
    assert used[2].n_items == len(items) and 0 <= used[2].unused_share < 0.01 and used[2].fullest <= 4096 and used[2].least_bins <= used[2].n_bins == min(used[2].lp_bins, used[2].fit_bins)


def test_texts_nulls_ties_and_empty_tables(spark):
    texts = [(1, "ä" * 10), (2, None), (3, ""), (4, "x" * 25), (None, "abc"), (5, "tie"), (6, "tie"), (7, "y" * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    caps = spark.createDataFrame([(1, 20)], "pack_id int, capacity int")
    rows = {(r.item_id, r.piece_no): r for r in pack(df, caps).collect()}
    assert rows[1, 0].n_tokens == 20 and rows[2, 0].n_tokens == rows[3, 0].n_tokens == 0 and rows[4, 1].n_tokens == 5 and rows[None, 0].n_tokens == 3
    assert sum(k[0] == 7 for k in rows) == 5000
    assert pack(df.limit(0), caps).count() == 0 and pack(df, caps.limit(0)).count() == 0


def test_one_length_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, 30)] * 500, "doc_id long, n int")
    caps = spark.createDataFrame([("a", 100)], "pack_id string, capacity long")
    rows = pack(df, caps, size="n").collect()
    bins = {}
    for r in rows:
        bins[r.bin] = bins.get(r.bin, 0) + 1
    assert len(rows) == 500 and max(bins.values()) <= 3 and len(bins) == 167


@pytest.mark.parametrize("seed", range(5))
def test_plans_place_each_rank_once_and_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    u = 1024
    counts = np.zeros(u + 1, np.int64)
    counts[1:] = rng.poisson(rng.gamma(0.3, (1, 20, 200, 5, 0.05)[seed], u))
    plan, lp_bins, fit_bins = plan_bins(counts)
    for p in (plan, packing._lp_plan(counts, 128, 500, 0.01)):
        placed, load = [[] for _ in counts], np.zeros(p.bins, np.int64)
        for cls, first, n, b in zip(p.cls, p.first, p.count, p.bin_first, strict=True):
            placed[cls] += range(first, first + n)
            load[b : b + n] += cls
        assert all(sorted(x) == list(range(n)) for x, n in zip(placed[1:], counts[1:], strict=True)) and load.max(initial=0) <= u
    assert plan.bins == min(lp_bins, fit_bins) and plan.bins >= (counts * np.arange(u + 1)).sum() / u


def test_the_lp_beats_best_fit_where_sizes_are_awkward():
    counts = np.zeros(1001, np.int64)
    counts[[510, 260, 270, 230]] = [600, 600, 600, 1200]  # 900 bins of (510, 260, 230) and (270, 270, 230, 230)
    plan, lp_bins, fit_bins = plan_bins(counts, classes=1000)
    assert plan.bins == lp_bins <= 930 and fit_bins == 1100


def test_value_and_bound_of_the_lp():
    size, demand = np.array([30, 40, 60]), np.array([100, 100, 100])
    s = configuration_lp(size, demand, 100, 4000, 0.01)
    assert ((s.configurations @ size) <= 100).all() and s.bound <= s.value <= 1.05 * s.bound
    assert s.bound <= 133.4 and s.value >= 133.3  # 100 of (60, 40) and a third of 100 of (30, 30, 30)
    assert np.allclose((s.times @ s.configurations * size).sum(), (demand * size).sum(), rtol=0.01)


def test_wide_units(spark, monkeypatch):
    monkeypatch.setattr(packing, "UNITS", 64)
    monkeypatch.setattr(packing, "width", lambda c: -(-c // 64))
    monkeypatch.setattr(packing, "TOGETHER", 1)
    items = {i: int(x) for i, x in enumerate(np.random.default_rng(2).integers(0, 1500, 400))} | {900: 1000, 901: 999}
    df = spark.createDataFrame(list(items.items()), "doc_id long, n long")
    caps = [(1, 1000), (2, 130), (3, 7)]
    bins = check(pack(df, spark.createDataFrame(caps, "pack_id int, capacity int"), size="n"), items, caps)
    assert bins[1] <= 1.1 * sum(items.values()) / 1000 + 5
