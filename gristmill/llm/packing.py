"""Best-fit packing of token sequences by bin completion with branch and bound.

Only a piece's length matters for packing, and there are at most ``capacity`` lengths. So the corpus is
reduced to a histogram of lengths, which the driver solves whatever the number of documents, and the solution
is a list of patterns: lengths that share a sequence, and how many sequences do so. Pieces then find their
sequence from their length and their rank among the pieces of that length, without a sort of the corpus: ranks
are counted within each task and shifted by per-task totals.

Solving: best-fit decreasing, or one filling around the largest length left at a time, gives the incumbent.
Its most wasteful sequences are then searched again together for one fewer, by branch and bound: around the
largest length left, all fillings within the waste that is still allowed are tried, least waste first, but
those that another one dominates. A search meets a bounded number of fillings; rounds go on while they improve.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import stable

CAPACITY = 2048
Pattern = tuple[int, ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over all thresholds: no packing has fewer sequences."""
    size = np.arange(capacity + 1)
    number, load = np.cumsum(counts[::-1])[::-1], np.cumsum(counts * size)
    best = -(-int(load[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        big = int(number[capacity - k + 1]) if k else 0
        middle = int(number[capacity // 2 + 1]) - big
        held = int(load[capacity - k] - load[capacity // 2])
        small = int(load[capacity // 2] - (load[k - 1] if k else 0))
        best = max(best, big + middle + max(0, -(-(small - (middle * capacity - held)) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the histogram; equal open sequences are kept as one group."""
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r, g in groups.items() if r >= length and g), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    groups[capacity - each * length].append(((length,) * each, full))
                if rest:
                    groups[capacity - rest * length].append(((length,) * rest, 1))
                break
            pattern, n = groups[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if used < n:
                groups[room].append((pattern, n - used))
            groups[room - each * length].append((pattern + (length,) * each, used))
            left -= used * each
    return [x for g in groups.values() for x in g]


def quick_fillings(avail: np.ndarray, room: int, allowed: int, budget: int = 4000) -> list[Pattern]:
    """A few fillings of ``room`` that waste ``allowed`` at most, least waste first, then fewest pieces.

    Lengths are tried from the largest; each filling wastes less than the one found before it, and the first
    without waste ends the walk. Those left out are met by ``fillings``.
    """
    found: list[tuple[int, int, Pattern]] = []
    best, nodes = allowed + 1, 0
    left = avail.copy()

    def walk(room: int, most: int, taken: Pattern) -> None:
        nonlocal best, nodes
        nodes += 1
        if nodes > budget or best == 0:
            return
        if room <= most and left[room]:
            found.append((0, len(taken) + 1, (*taken, room)))
            best = 0
            return
        lengths = np.flatnonzero(left[: min(room, most) + 1])
        if not len(lengths):
            if room < best:
                found.append((room, len(taken), taken))
                best = room
            return
        if lengths[0] * 2 > room:  # one more piece at most, so the largest dominates the rest
            x = int(lengths[-1])
            if room - x < best:
                found.append((room - x, len(taken) + 1, (*taken, x)))
                best = room - x
            return
        # Two pieces that fill the room exactly, if any, largest first.
        pairs = lengths[(lengths * 2 > room)]
        pairs = pairs[left[room - pairs] > 0]
        if len(pairs):
            found.append((0, len(taken) + 2, (*taken, int(pairs[-1]), int(room - pairs[-1]))))
            best = 0
            return
        # A length is taken as often as it fits, then less often; below it come smaller lengths only, so the
        # depth is bounded by how many different lengths fit, not by how many pieces.
        for x in lengths[::-1].tolist():
            for times in range(min(int(left[x]), room // x), 0, -1):
                left[x] -= times
                walk(room - x * times, x - 1, (*taken, *(x,) * times))
                left[x] += times
                if nodes > budget or best == 0:
                    return

    walk(room, room, ())
    return [f for _, _, f in sorted(found)]


def _with(bits: int, length: int, n: int) -> int:
    """The sums ``bits`` with up to ``n`` pieces of ``length`` added."""
    k = 1
    while n > 0:
        bits |= bits << length * min(k, n)
        n, k = n - k, 2 * k
    return bits


def fillings(avail: np.ndarray, room: int, allowed: int, spend: Callable[[], bool] = lambda: True) -> Iterator[Pattern]:
    """Every undominated filling of ``room`` that wastes ``allowed`` at most, lazily, least waste first, then largest pieces.

    A filling is dominated if an unused piece still fits, alone or in the place of one or more smaller ones: their
    places can be exchanged in any packing. So all pieces no longer than the waste are in it. Sets of reachable sums
    are bits of an integer, so every branch that is entered leads to a filling. ``spend`` is asked once for each
    filling that is met, and ends the enumeration.
    """
    lengths = np.flatnonzero(avail[: room + 1]).tolist()
    number = [min(int(avail[x]), room // x + 1) for x in lengths]

    def dominated(fill: Pattern, waste: int) -> bool:
        used, sums = Counter(fill), 1
        for x, n in zip(lengths, number):
            low = max(x - waste, 0)
            if n > used[x] and sums >> low & ((1 << x - low + 1) - 1):
                return True
            sums = _with(sums, x, used[x])
        return False

    for waste in range(min(allowed, room) + 1):
        low = bisect_right(lengths, waste)
        forced = tuple(x for x, n in zip(lengths[:low][::-1], number[:low][::-1]) for _ in range(n))
        if sum(forced) > room - waste:
            return
        reach = {low: 1 << sum(forced)}
        for i in range(low, len(lengths)):
            reach[i + 1] = _with(reach[i], lengths[i], number[i]) & ((1 << room + 1) - 1)

        def exact(i: int, rest: int) -> Iterator[Pattern]:
            for j in range(min(i, bisect_right(lengths, rest)), low, -1):
                if not reach[j] >> rest & 1:
                    return
                x = lengths[j - 1]
                for times in range(min(number[j - 1], rest // x), 0, -1):
                    if reach[j - 1] >> rest - x * times & 1:
                        for tail in exact(j - 1, rest - x * times):
                            yield (*(x,) * times, *tail)
            if rest == sum(forced):
                yield forced

        for fill in exact(len(lengths), room - waste):
            if not spend():
                return
            if not dominated(fill, waste):
                yield fill


def completion(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Bin completion over the histogram: each pattern is used as often as its scarcest length allows."""
    left, out = counts.astype(np.int64).copy(), []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return out
        top = int(lengths[-1])
        left[top] -= 1
        fill = quick_fillings(left, capacity - top, capacity) if capacity > top else []
        left[top] += 1
        pattern = (top, *(fill[0] if fill else ()))
        need = Counter(pattern)
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        out.append((pattern, times))


def search(items: list[int], capacity: int, target: int, budget: int = 3000) -> list[Pattern] | None:
    """Packs ``items`` into ``target`` sequences by bin completion with backtracking over all undominated fillings.

    Passes with quick fillings only and with the first 2 and 8 at each step go before the one with all, so that
    early choices are revised too. None if there is no way, or no pass found one among the first ``budget`` fillings it met.
    """
    counts = np.bincount(items, minlength=capacity + 1).astype(np.int64)
    slack = target * capacity - sum(items)
    width, nodes, cut = None, 0, False
    failed: set[tuple[int, bytes]] = set()

    def spend() -> bool:
        nonlocal nodes
        nodes += 1
        return nodes <= budget

    def step(slack: int, out: list[Pattern]) -> list[Pattern] | None:
        nonlocal cut
        lengths = np.flatnonzero(counts)
        if not len(lengths):
            return out
        state = (slack, counts.tobytes())
        if len(out) == target or state in failed:
            return None
        top = int(lengths[-1])
        counts[top] -= 1
        if width == 0:
            found, cut = takewhile(lambda _: spend(), quick_fillings(counts, capacity - top, slack, 300) or [()] * (capacity - top <= slack)), True
        else:
            found = fillings(counts.copy(), capacity - top, slack, spend)
        for k, fill in enumerate(found):
            if width and k == width:
                cut = True
                break
            for x in fill:
                counts[x] -= 1
            done = step(slack - (capacity - top - sum(fill)), [*out, (top, *fill)])
            for x in fill:
                counts[x] += 1
            if done is not None:
                return done
            if nodes > budget:
                break
        counts[top] += 1
        failed.add(state)
        return None

    for width in (0, 2, 8, None) if slack >= 0 else ():
        nodes, cut = 0, False
        failed.clear()
        counts[:] = np.bincount(items, minlength=capacity + 1)
        done = step(slack, [])
        if done is not None or not cut and nodes <= budget:
            return done
    return None


def solve(counts: np.ndarray, capacity: int, pool: int = 48) -> list[tuple[Pattern, int]]:
    """Patterns and multiplicities that pack the histogram into few sequences."""
    total = lambda plan: sum(n for _, n in plan)
    bound = lower_bound(counts, capacity)
    plan = min(best_fit(counts, capacity), completion(counts, capacity), key=total)
    tries, t = [(pool, pool), (2 * pool, 2 * pool), (3 * pool, 3 * pool), (2 * pool, pool), (3 * pool, 2 * pool)], 0
    while total(plan) > bound and t < len(tries):
        # The most wasteful sequences, and some others from all over the list, are packed anew with one fewer.
        most, wasteful = tries[t]
        plan = sorted(plan, key=lambda x: (sum(x[0]), x[0]))
        singles, taken, size = [], Counter(), 0
        for goal, order in ((wasteful, range(len(plan))), (most, np.unique(np.linspace(0, len(plan) - 1, most).astype(int)).tolist()[::-1])):
            for i in order:
                pattern, n = plan[i]
                while taken[i] < n and size + len(pattern) <= goal:
                    size, taken[i] = size + len(pattern), taken[i] + 1
                    singles.append(pattern)
                    if goal > wasteful:
                        break
                if size >= goal:
                    break
        rest = [(pattern, n - taken[i]) for i, (pattern, n) in enumerate(plan) if n > taken[i]]
        items = [x for p in singles for x in p]
        better = search(items, capacity, len(singles) - 1) if items else None
        if better is None:
            t += 1
            continue
        plan, t = [*rest, *((p, 1) for p in better)], 0
    return plan


def _pieces(path: str, capacity: int, end_id: int):
    """Pieces of each document with their length, checksum, task and rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(path), Counter(), TaskContext.get().partitionId()
        stop = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or b"" for t in some.column(1).cast(pa.binary()).to_pylist()]
                rows: list[tuple] = []
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode_many(texts)):
                    ids += stop
                    for i, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[start * 4 : (start + capacity) * 4]
                        length = len(own) // 4
                        rows.append((doc, i, start, length, zlib.crc32(own), part, seen[length]))
                        seen[length] += 1
                columns = zip(*rows) if rows else [[]] * 7
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def places(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, first ranks of its runs of places, their first sequence and their offset."""
    runs, base = defaultdict(lambda: ([], [], [])), 0
    taken: Counter = Counter()
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            first, sequence, at = runs[length]
            first.append(taken[length])
            sequence.append(base)
            at.append(offset)
            taken[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in v) for k, v in runs.items()}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece of a document.

    Each document's ids end with ``end_id``; only longer ones are cut, into pieces of ``capacity``.

    Defined cases: a null or empty text is the end id alone; rows that repeat are packed each; pieces of equal length
    are exchangeable, and which of them gets which place is fixed by their order in the tasks; an empty table gives no
    rows; other columns are ignored; texts of any length are cut whole.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = stable(slim.mapInArrow(_pieces(path, capacity, end_id), "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"))
    sizes = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("shift"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # one row for each length: capacity at most
        histogram[length] = n
    where = places(solve(histogram, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        ranks = rank.to_numpy()
        for k, at in length.groupby(length).indices.items():
            first, begin, shift = where[int(k)]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            sequence[at], offset[at] = begin[run] + ranks[at] - first[run], shift[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = made.join(shifts, ["part", "length"]).withColumn("place", find("length", F.col("rank") + F.col("shift")))
    return ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "place.sequence_id", "place.offset")
