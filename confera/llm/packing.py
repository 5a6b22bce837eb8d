"""Best-fit packing by bin completion with branch and bound, over the histogram of piece lengths.

Pieces of one length are interchangeable, so what has to be packed is a histogram of at most `capacity` counts, however many
documents there are. The search takes the largest length left, lists the undominated fillings of the room beside it, of any
number of items and least waste first, applies one as often as the counts allow (later once), and goes on; the waste so far against what a better packing may still waste prunes a branch, and best-fit decreasing is the first incumbent.
The result is a list of (pattern, times); each piece then finds its place from its rank among the pieces of its length.
Ranks come from counts per input partition and length, so a length that a third of all pieces share is dealt out like any.

Defined results: a null text counts as empty and still has its end id. Repeated rows are packed once each; their order
among equals is arbitrary but fixed. A null id is carried along. A very long text is encoded whole, then cut into pieces.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, text_batches
from confera.llm.tokens import encoder

CAPACITY = 2048
#: Nodes of the search; past them the best packing so far is used. It bounds time, not what is packed.
NODES = 4000
_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
Pattern = tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, after Martello and Toth."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    n, s = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]
    n, s = np.append(n, 0), np.append(s, 0)
    half = capacity // 2 + 1
    for k in range(1, capacity // 2 + 1):
        over = capacity - k + 1
        n1, n2 = int(n[over]), int(n[half] - n[max(over, half)])
        room = n2 * capacity - int(s[half] - s[max(over, half)])
        best = max(best, n1 + n2 + max(0, -(-(int(s[k] - s[half]) - room) // capacity)))
    return best


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    open_bins: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in sorted(r for r in open_bins if r >= size) if left else ():
            each = room // size
            groups, open_bins[room] = open_bins[room], []
            for pattern, times in groups:
                for take, bins in ((each, min(times, left // each)), (left % each if left < times * each else 0, 1)):
                    if take and bins and times:
                        open_bins[room - take * size].append(((*pattern, (size, take)), bins))
                        left, times = left - take * bins, times - bins
                if times:
                    open_bins[room].append((pattern, times))
            if not left:
                break
        each = capacity // size
        for take, bins in ((each, left // each), (left % each, 1)):
            if take and bins:
                open_bins[capacity - take * size].append((((size, take),), bins))
    return [g for groups in open_bins.values() for g in groups]


def fillings(counts: np.ndarray, largest: int, room: int, slack: int) -> Iterator[tuple[int, ...] | None]:
    """Fillings of the room beside one item of the largest size that waste at most `slack`, of any number of items.

    Least waste first, among equals those of larger items. None stands for a filling that another one dominates: an item
    left out fits in the place of some of its items, or in the waste.
    """
    left = counts[: room + 1].copy()
    if largest <= room:
        left[largest] -= 1
    sizes = np.flatnonzero(left)[::-1].tolist()
    if sizes and sizes[0] == room:
        yield (room,)  # dominates every other
        return
    most = [min(int(left[s]), room // s) for s in sizes]
    # reach[i]: the sums, as bits, that items of sizes[i:] have.
    whole, reach = (1 << room + 1) - 1, [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums, n, step = reach[i + 1], most[i], 1
        while n:
            take = min(step, n)
            sums |= sums << take * sizes[i]
            n, step = n - take, 2 * step
        reach[i] = sums & whole

    def of_sum(i: int, rest: int) -> Iterator[list[tuple[int, int]]]:
        if not rest:
            yield []
        while rest and i < len(sizes) and reach[i] >> rest & 1:
            for n in range(min(most[i], rest // sizes[i]), 0, -1):
                if reach[i + 1] >> rest - n * sizes[i] & 1:
                    for more in of_sum(i + 1, rest - n * sizes[i]):
                        yield [(i, n), *more]
            i += 1

    free = sum(1 << s for s in sizes)
    for waste in range(min(room, slack) + 1):
        if reach[0] >> room - waste & 1:
            for chosen in of_sum(0, room - waste):
                yield None if _dominated(chosen, sizes, left, free, waste) else tuple(sizes[i] for i, n in chosen for _ in range(n))


def _dominated(chosen: list[tuple[int, int]], sizes: list[int], left: np.ndarray, free: int, waste: int) -> bool:
    ones, many = 0, 0  # sums of one chosen item, and of two or more
    for i, n in chosen:
        if int(left[sizes[i]]) == n:
            free ^= 1 << sizes[i]
        for _ in range(n):
            many |= (many | ones) << sizes[i]
            ones |= 1 << sizes[i]
    spread, width = (1 | ones) << 1 | many << 1, 1  # one more than the sum, up to the waste more
    fits, spread = many, spread if waste else 0
    while width < waste:
        step = min(width, waste - width)
        spread |= spread << step
        width += step
    return bool((fits | spread) & free)


def _steps(state: np.ndarray, largest: int, room: int, slack: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """Fillings and how often to use them: first as often as the counts allow, then once, which leaves no packing out."""

    def all_steps() -> Iterator[tuple[tuple[int, ...], int] | None]:
        for once in (False, True):
            for filling in fillings(state, largest, room, slack):
                if filling is None:
                    yield None
                    continue
                times = min(int(state[x]) // c for x, c in Counter((largest, *filling)).items())
                if not once:
                    yield filling, times
                elif times > 1:
                    yield filling, 1

    # Drawn in growing parts, each from the start: so the tables of sums don't wait in memory at every depth.
    at, part = 0, 4
    while found := list(islice(all_steps(), at, at + part)):
        yield from found
        at, part = at + part, 2 * part


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """counts[size]: items of the size. Patterns of (size, items of it) and how often each is used."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    bound, best = lower_bound(counts, capacity), best_fit_decreasing(counts, capacity)
    bins = sum(t for _, t in best)

    def level(state: np.ndarray, wasted: int, used: int):  # noqa: ANN202
        largest = int(np.flatnonzero(state)[-1])
        return state, wasted, used, largest, _steps(state, largest, capacity - largest, (bins - 1) * capacity - total - wasted)

    path: list[tuple[Pattern, int]] = []
    levels = [level(counts, 0, 0)]
    while levels and nodes and bins > bound:
        state, wasted, used, largest, steps = levels[-1]
        step = next(steps, ())
        if step == ():
            levels.pop()
            del path[-1:]
            continue
        nodes -= 1
        if step is None:
            continue
        filling, times = step
        wasted, used = wasted + times * (capacity - largest - sum(filling)), used + times
        if wasted > (bins - 1) * capacity - total:
            continue
        need = Counter((largest, *filling))
        state = state.copy()
        for x, c in need.items():
            state[x] -= c * times
        pattern = (tuple(sorted(need.items(), reverse=True)), times)
        if not state.any():
            if used < bins:
                best, bins = [*path, pattern], used
            continue
        path.append(pattern)
        levels.append(level(state, wasted, used))
    return best


def places(solution: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, items a bin, first bin, offset in the bin), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    first_bin = 0
    for pattern, times in solution:
        at = 0
        for size, each in pattern:
            out[size].append((ranks[size], each, first_bin, at))
            ranks[size] += each * times
            at += each * size
        first_bin += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            rows = []
            for k, ids in enumerate(encode(batch.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            if rows:
                of, piece, start, length, crc, part = zip(*rows)
                columns = [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(part, pa.binary())] * with_ids, names=_PIECE[: 5 + with_ids])

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return text_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    pieces = cut_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)
    pieces = checkpointed(pieces.withColumn("pid", F.spark_partition_id()))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    per_part = pieces.groupBy("pid", "length").count()
    for length, n in per_part.groupBy("length").agg(F.sum("count")).collect():  # `capacity` rows at most
        counts[length] = n
    placed = docs.sparkSession.sparkContext.broadcast(places(bin_completion(counts, capacity, nodes)))

    before = F.sum("count").over(Window.partitionBy("length").orderBy("pid")) - F.col("count")
    offsets = per_part.select("pid", "length", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("pid", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("rank", nth - 1).join(offsets, ["pid", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("pid", "before")

    kept = _PIECE[: 5 + with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in np.unique(length):
                own = length == size
                runs = placed.value[int(size)]
                run = runs[np.searchsorted(runs[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - run[:, 0]
                sequence[own], offset[own] = run[:, 2] + nth // run[:, 1], run[:, 3] + nth % run[:, 1] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in ranked.select(*kept).dtypes) + ", sequence_id bigint, offset bigint"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)
