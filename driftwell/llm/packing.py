"""Items of varying length into containers of fixed capacity: a configuration LP over the length histogram.

The plan is made from the histogram alone (at most ``UNITS`` sizes a capacity, whatever the number of items): the
LP over coarse classes, solved by multiplicative weights with a knapsack program for prices, is rounded down to whole
containers, and what is left is placed by best fit on exact sizes. Best fit on exact sizes alone is planned, too, and the plan
with fewer containers is used. The items are then placed by their rank within their size, which is counted
in parts, so neither a task nor the driver ever holds the items of a size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.session import stage

UNITS = 32_768  #: most sizes that a capacity is told apart into; larger capacities are planned in wider units, sizes rounded up
CLASSES = 256  #: classes of sizes in the LP
ROUNDS, GAP, STEP, SLACK = 3000, 0.003, 0.2, 0.1  #: rounds at most, gap between the LP's value and its bound to stop at, share of the scarcest class per round, loss of price at which a known configuration is used again
PARTS = 64  #: parts in which the ranks within a size are counted
TOGETHER = 20  #: capacities whose plans are broadcast together (some MB each at most); more are placed in several passes


@dataclass
class Plan:
    """Placements of one container size: items of size ``cls`` ranked from ``first`` on go to bins from ``bin_first`` on, one each."""

    cls: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    bin_first: list[int] = field(default_factory=list)
    bins: int = 0

    def place(self, cls: int, first: int, count: int, bin_first: int) -> None:
        self.cls.append(cls)
        self.first.append(first)
        self.count.append(count)
        self.bin_first.append(bin_first)


def _knapsack(price: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """The configuration of greatest total price: counts per class (``size`` ascending) that add up to at most ``room``, and its price."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    fits = np.searchsorted(size, np.arange(room + 1), "right")
    for c in range(int(size[0]), room + 1):
        gain = best[c - size[: fits[c]]] + price[: fits[c]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], choice[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if choice[c] >= 0:
            counts[choice[c]] += 1
            c -= int(size[choice[c]])
        else:
            c -= 1
    return counts, float(best[room])


@dataclass
class Solution:
    """Configurations (counts per class), how often each is used, the LP's value where all classes are covered, and its lower bound."""

    configurations: np.ndarray
    times: np.ndarray
    value: float
    bound: float


def configuration_lp(size: np.ndarray, demand: np.ndarray, room: int, rounds: int = ROUNDS, gap: float = GAP) -> Solution:
    """Fractional containers that cover ``demand`` items of each class, as few as possible, by multiplicative weights.

    A class's weight falls exponentially in its coverage, its price is the weight per item wanted. The knapsack program finds the
    dearest configuration; it is used for a share of its scarcest class. As prices only fall, the program's last
    result bounds all prices, and a known configuration that comes near it is used again without running the program.
    The weights are a dual solution: their sum over the dearest price is a lower bound, and the rounds end when the value is within ``gap`` of it.
    """
    m = len(size)
    demand = demand.astype(float)
    covered, weight = np.zeros(m), np.ones(m)
    known, times = np.zeros((64, m)), np.zeros(64)
    n, top, base, bound, value = 0, 0.0, 0.0, float(demand @ size) / room, np.inf
    fall = 2 * np.log(max(m, 2))
    for r in range(rounds):
        price = weight / demand
        worth = known[:n] @ price
        k = int(worth.argmax()) if n else -1
        if k < 0 or worth[k] < (1 - SLACK) * top:
            made, top = _knapsack(price, size, room)
            bound = max(bound, float(weight.sum()) / top)
            same = np.flatnonzero((known[:n] == made).all(1))
            k = int(same[0]) if len(same) else n
            if k == n:
                if n == len(known):
                    known, times = np.vstack([known, np.zeros_like(known)]), np.r_[times, np.zeros(n)]
                known[n] = made
                n += 1
        take = known[k] > 0
        step = STEP * float((demand[take] / known[k, take]).min())
        times[k] += step
        covered[take] += step * known[k, take]
        share = covered / demand
        least = float(share.min())
        weight = np.exp(-fall * (share - least))  # relative to the scarcest class, so none vanishes
        top *= np.exp(fall * (least - base))
        base = least
        if r % 20 == 19 and least > 0:
            value = float(times[:n].sum() / least)
            if value <= (1 + gap) * bound:
                break
    even = float(np.average(covered / demand, weights=demand * size))
    return Solution(known[:n].astype(np.int64), times[:n] / max(even, 1e-300), value, bound)


class _Bins:
    """Bins with room, in runs of alike ones, and the items placed so far."""

    def __init__(self, counts: np.ndarray) -> None:
        self.plan, self.rest = Plan(), counts.astype(np.int64).copy()
        self.placed = np.zeros(len(counts), np.int64)
        self.free: dict[int, list[list[int]]] = {}
        self.rooms: list[int] = []

    def put(self, size: int, n: int, bin_first: int) -> None:
        self.plan.place(size, int(self.placed[size]), n, bin_first)
        self.placed[size] += n
        self.rest[size] -= n

    def leave(self, room: int, bin_first: int, n: int) -> None:
        if room > 0:
            if room not in self.free:
                self.free[room] = []
                insort(self.rooms, room)
            self.free[room].append([bin_first, n])

    def best_fit(self, capacity: int) -> Plan:
        """The rest, longest first, each item into the fullest bin that holds it."""
        for size in range(capacity, 0, -1):
            while self.rest[size] > 0:
                at = bisect_left(self.rooms, size)
                if at == len(self.rooms):
                    n = int(-(-self.rest[size] // (capacity // size)))
                    self.leave(capacity, self.plan.bins, n)
                    self.plan.bins += n
                    continue
                room = self.rooms[at]
                run = self.free[room][-1]
                n = int(min(run[1], self.rest[size]))
                self.put(size, n, run[0])
                self.leave(room - size, run[0], n)
                run[0] += n
                run[1] -= n
                if not run[1]:
                    self.free[room].pop()
                    if not self.free[room]:
                        del self.free[room]
                        self.rooms.pop(bisect_left(self.rooms, room))
        if self.rest[0]:
            # Items without length need no room: all of them in the first bin.
            self.plan.bins = max(self.plan.bins, 1)
        return self.plan


def _lp_plan(counts: np.ndarray, classes: int, rounds: int, gap: float) -> Plan:
    """The LP over classes of sizes (rounded up), its configurations used in whole bins, and best fit for the rest and the room left."""
    u = len(counts) - 1
    bins = _Bins(counts)
    width = -(-u // classes)
    sizes = np.flatnonzero(counts[1:]) + 1
    cls = -(-sizes // width)
    kept = cls <= u // width  # larger ones fill a bin alone, or the rest of it by best fit
    sizes, cls = sizes[kept], cls[kept]
    if len(sizes):
        present, at = np.unique(cls, return_inverse=True)
        demand = np.bincount(at, weights=counts[sizes])
        solution = configuration_lp(present, demand, u // width, rounds, gap)
        held = [sizes[at == k][::-1].tolist() for k in range(len(present))]  # exact sizes of each class, longest first
        left = demand.astype(np.int64)
        filled = solution.configurations @ present
        for c in np.lexsort((-solution.times, -filled)).tolist():
            need = solution.configurations[c]
            take = np.flatnonzero(need)
            n = int(min(np.floor(solution.times[c] + 0.5), np.min(left[take] // need[take])))
            left[take] -= max(n, 0) * need[take]
            slots = [k for k in take[::-1].tolist() for _ in range(int(need[k]))]
            while n > 0:  # runs of bins with the same exact sizes
                chosen: dict[int, int] = {}
                picked = []
                for k in slots:
                    size = next(s for s in held[k] if bins.rest[s] > chosen.get(s, 0))
                    chosen[size] = chosen.get(size, 0) + 1
                    picked.append(size)
                run = min(n, *(int(bins.rest[s]) // times for s, times in chosen.items()))
                for s in picked:
                    bins.put(s, run, bins.plan.bins)
                bins.leave(u - sum(picked), bins.plan.bins, run)
                bins.plan.bins += run
                n -= run
                for k in take.tolist():
                    while held[k] and not bins.rest[held[k][0]]:
                        held[k].pop(0)
    return bins.best_fit(u)


def plan_bins(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS, gap: float = GAP) -> tuple[Plan, int, int]:
    """The plan for ``counts`` items per size 0..U, and the bins of the LP's plan and of best fit alone; the LP's is used unless it needs more.

    Items of size 0 take no room and go to bin 0. Bins never exceed U.
    """
    fit = _Bins(counts).best_fit(len(counts) - 1)
    lp = _lp_plan(counts, classes, rounds, gap)
    return (lp if lp.bins <= fit.bins else fit), lp.bins, fit.bins


def width(capacity: int, units: int = UNITS) -> int:
    """Tokens of a unit of the plan."""
    return -(-capacity // units)


def _plan_task(classes: int, rounds: int, gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, units, sizes, counts in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                full = np.zeros(units + 1, np.int64)
                full[sizes] = counts
                p, lp_bins, fit_bins = plan_bins(full, classes, rounds, gap)
                p.place(-1, lp_bins, 0, fit_bins)
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(p.cls), pa.int32()), pa.array(p.cls, pa.int32()), pa.array(p.first, pa.int64()), pa.array(p.bin_first, pa.int64())], names=["no", "cls", "first", "bin_first"])

    return run


def pack(items: DataFrame, capacities: DataFrame, *, item_id: str = "doc_id", text: str | None = "text", size: str | None = None, pack_id: str = "pack_id", capacity: str = "capacity", classes: int = CLASSES, rounds: int = ROUNDS, gap: float = GAP, parts: int = PARTS) -> DataFrame:
    """``(pack_id, item_id, piece_no, n_pieces, first_token, n_tokens, bin, lp_bins, fit_bins)``: every item in bins of every capacity.

    An item's size is the UTF-8 length of ``text``, or the column ``size``. An item larger than the capacity is cut into
    pieces of the capacity and a rest; no other item is split. Items of size 0 (also null texts and negative sizes) have
    one piece of 0 tokens in bin 0. No bin holds more than its capacity. ``lp_bins`` and ``fit_bins`` are the bins that the LP's plan and
    best fit alone need; the plan with fewer is used. Rows with a null id are placed like any
    other; rows that repeat an id are items of their own. Capacities that are null or below 1 are left out; equal capacities
    under different ids are packed each. Empty tables give empty results.
    """
    spark = items.sparkSession
    wanted = capacities.where(F.col(capacity) >= 1).select(F.col(pack_id).alias("p"), F.col(capacity).cast("long").alias("c")).dropDuplicates(["p"]).orderBy("c").collect()
    id_type = items.schema[item_id].dataType.simpleString()
    pack_type = capacities.schema[pack_id].dataType.simpleString()
    out = f"pack_id {pack_type}, item_id {id_type}, piece_no int, n_pieces int, first_token bigint, n_tokens bigint, bin bigint, lp_bins bigint, fit_bins bigint"
    if not wanted:
        return spark.createDataFrame([], out)
    length = F.octet_length(text) if size is None else F.col(size).cast("long")
    base = stage(items.select(F.col(item_id).alias("item_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("_size"), F.pmod(F.xxhash64(item_id, text if size is None else size), F.lit(parts)).alias("_part")))
    made = [_pack_some(base, wanted[i : i + TOGETHER], out, pack_type, classes, rounds, gap) for i in range(0, len(wanted), TOGETHER)]
    placed = made[0]
    for m in made[1:]:
        placed = placed.unionByName(m)
    return placed


def _pack_some(base: DataFrame, wanted: list, out: str, pack_type: str, classes: int, rounds: int, gap: float) -> DataFrame:
    spark = base.sparkSession
    of = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(r.c).alias("c"), F.lit(width(r.c)).alias("per")) for i, r in enumerate(wanted)))).alias("_o")
    pieces = base.select("item_id", "_part", "_size", of).select("item_id", "_part", "_size", "_o.*")
    n_pieces = F.greatest(F.ceil(F.col("_size") / F.col("c")), F.lit(1))
    pieces = pieces.select("item_id", "_part", "_size", "no", "c", "per", n_pieces.cast("int").alias("n_pieces"), F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece_no"))
    pieces = pieces.withColumn("n_tokens", F.least("c", F.col("_size") - F.col("piece_no").cast("long") * F.col("c")))
    # A unit that the capacity isn't a multiple of is cut off; a piece of the full capacity has the last whole unit.
    pieces = pieces.withColumn("cls", F.least(F.ceil(F.col("n_tokens") / F.col("per")), F.floor(F.col("c") / F.col("per"))).cast("int"))
    counts = stage(pieces.groupBy("no", "cls", "_part").agg(F.count(F.lit(1)).alias("n")))

    histogram = counts.groupBy("no", "cls").agg(F.sum("n").alias("n")).groupBy("no").agg(F.collect_list("cls").alias("sizes"), F.collect_list("n").alias("counts"))
    units = F.element_at(F.array(*(F.lit(r.c // width(r.c)) for r in wanted)), F.col("no") + 1).cast("int")
    # One task per capacity plans its bins; a plan's size depends on the units, not on the items.
    todo = histogram.select("no", units.alias("units"), "sizes", "counts").repartition(len(wanted), "no")
    lookup: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    compared: dict[int, tuple[int, int]] = {}
    rows: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in todo.mapInArrow(_plan_task(classes, rounds, gap), "no int, cls int, first bigint, bin_first bigint").collect():
        if r.cls < 0:
            compared[r.no] = (r.first, r.bin_first)
        else:
            rows.setdefault((r.no, r.cls), []).append((r.first, r.bin_first))
    for k, found in rows.items():  # intervals of each size in order of rank
        a = np.array(sorted(found), np.int64)
        lookup[k] = (a[:, 0], a[:, 1])
    shared = spark.sparkContext.broadcast(lookup)

    before = F.sum("n").over(Window.partitionBy("no", "cls").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("no", "cls", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("no", "cls", "_part").orderBy("item_id", "_size", "piece_no"))
    ranked = pieces.withColumn("_r", rank).join(offsets, ["no", "cls", "_part"])
    ranked = ranked.select("no", "cls", (F.col("_before") + F.col("_r") - 1).alias("rank"), "item_id", "piece_no", "n_pieces", (F.col("piece_no").cast("long") * F.col("c")).alias("first_token"), "n_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            no, cls, r = (b.column(k).to_numpy() for k in range(3))
            bins = np.zeros(len(r), np.int64)
            code = (no.astype(np.int64) << 32) + cls
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order])) + 1
            for group in np.split(order, cuts):
                if len(group) and cls[group[0]]:
                    first, bin_first = known[int(no[group[0]]), int(cls[group[0]])]
                    k = np.searchsorted(first, r[group], "right") - 1
                    bins[group] = bin_first[k] + r[group] - first[k]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(3, 8)), pa.array(bins)], names=["no", "item_id", "piece_no", "n_pieces", "first_token", "n_tokens", "bin"])

    fields = out.replace(f"pack_id {pack_type}", "no int").split(", lp_bins")[0]
    placed = ranked.mapInArrow(place, fields)
    per_pack = F.element_at(F.array(*(F.struct(F.lit(r.p).cast(pack_type).alias("p"), F.lit(compared.get(i, (0, 0))[0]).cast("long").alias("lp"), F.lit(compared.get(i, (0, 0))[1]).cast("long").alias("fit")) for i, r in enumerate(wanted))), F.col("no") + 1)
    return placed.withColumn("_p", per_pack).select(F.col("_p.p").alias("pack_id"), "item_id", "piece_no", "n_pieces", "first_token", "n_tokens", "bin", F.col("_p.lp").alias("lp_bins"), F.col("_p.fit").alias("fit_bins"))


def utilisation(placed: DataFrame, capacities: DataFrame, *, pack_id: str = "pack_id", capacity: str = "capacity") -> DataFrame:
    """``(pack_id, capacity, n_items, n_pieces, n_tokens, n_bins, lp_bins, fit_bins, least_bins, fullest, unused_share)`` of an assignment.

    ``least_bins`` is a lower bound, the tokens over the capacity; ``fullest`` is the greatest number of tokens in a bin.
    """
    bins = placed.groupBy("pack_id", "bin").agg(F.count_if(F.col("piece_no") == 0).alias("i"), F.count(F.lit(1)).alias("p"), F.sum("n_tokens").alias("t"), F.max("lp_bins").alias("lp"), F.max("fit_bins").alias("fit"))
    per = bins.groupBy("pack_id").agg(F.sum("i").alias("n_items"), F.sum("p").alias("n_pieces"), F.sum("t").alias("n_tokens"), (F.max("bin") + 1).alias("n_bins"), F.max("lp").alias("lp_bins"), F.max("fit").alias("fit_bins"), F.max("t").alias("fullest"))
    caps = capacities.select(F.col(pack_id).alias("_p"), F.col(capacity).cast("long").alias("capacity")).dropDuplicates(["_p"])
    joined = per.join(caps, per.pack_id == caps._p)
    return joined.select("pack_id", "capacity", "n_items", "n_pieces", "n_tokens", "n_bins", "lp_bins", "fit_bins", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_bins"), "fullest", (1 - F.col("n_tokens") / (F.col("n_bins") * F.col("capacity"))).alias("unused_share"))
