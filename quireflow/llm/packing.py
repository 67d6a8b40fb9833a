"""Filling fixed-capacity containers with items of varying length.

Items are hashed into buckets of bounded size, each packed on its own. A bucket's items are dealt,
longest first and back and forth, to windows of a few dozen containers, so every window has about
the same lengths. In a window, Karmarkar-Karp multiway differencing keeps partial partitions, each a
vector of container sums; the two with the largest spread are merged with opposing imbalances, the
largest sums of one onto the smallest of the other, until one partition with nearly equal sums is
left. Where sums then exceed the capacity they are repaired: the smallest items are taken back and go where
they fit best, items are moved or swapped, or those of two containers divided anew. Where that fails, the
window gets another container and starts again.

An item longer than the capacity fills containers of its own; what remains of it is an item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_ITEMS = 16_384
WINDOW = 96
#: Share of the content, in the smallest items, that a repair takes back; most items of two containers that are divided anew.
TAKEN_BACK, RESPLIT = 0.2, 12
#: Container numbers of a bucket start at its number times this.
_STRIDE = 1 << 32


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The container (0 to k-1) of each item, by Karmarkar-Karp differencing into k nearly equal sums."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    sums = np.zeros((n, k), np.int64)
    sums[:, 0] = sizes
    nodes: list[tuple[int, int, np.ndarray]] = []
    vectors: dict[int, np.ndarray] = {i: sums[i] for i in range(n)}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = vectors.pop(a) + vectors.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        node = n + len(nodes)
        nodes.append((a, b, order))
        vectors[node] = both
        heapq.heappush(heap, (-int(both[0]), node))
    out = np.zeros(n, np.int64)
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for node in range(n + len(nodes) - 1, n - 1, -1):
        a, b, order = nodes[node - n]
        mine = places.pop(node)
        left = np.empty(k, np.int64)
        left[order] = mine
        for child, at in ((a, left), (b, left[::-1])):
            if child < n:
                out[child] = at[0]
            else:
                places[child] = at
    return out


_MASKS = {m: (np.arange(1 << m)[:, None] >> np.arange(m)) & 1 for m in range(1, RESPLIT + 1)}


def _resplit(sizes: np.ndarray, where: np.ndarray, load: np.ndarray, c: int, capacity: int) -> bool:
    """Divide the items of the overfull container c and of a roomier one anew, so that both fit."""
    mine = np.flatnonzero(where == c)
    for d in np.argsort(load, kind="stable"):
        if load[c] + load[d] > 2 * capacity:
            return False
        both = np.concatenate([mine, np.flatnonzero(where == d)])
        if len(both) > RESPLIT:
            continue
        sums = _MASKS[len(both)] @ sizes[both]
        fits = np.where((sums <= capacity) & (sums >= load[c] + load[d] - capacity), sums, -1)
        best = int(fits.argmax())
        if fits[best] >= 0:
            where[both] = np.where(_MASKS[len(both)][best] == 1, c, d)
            load[c], load[d] = sums[best], load[c] + load[d] - sums[best]
            return True
    return False


def _refill(sizes: np.ndarray, where: np.ndarray, k: int, capacity: int) -> None:
    """Take back the smallest items, a part of the content, and put each where the least room is left that holds it."""
    order = np.argsort(-sizes, kind="stable")
    small = order[np.cumsum(sizes[order][::-1])[::-1] <= TAKEN_BACK * sizes.sum()]
    load = np.bincount(where, weights=sizes, minlength=k).astype(np.int64)
    np.subtract.at(load, where[small], sizes[small])
    for i in small:
        room = capacity - load - sizes[i]
        c = int(np.where(room >= 0, room, capacity + 1).argmin())
        where[i] = c if room[c] >= 0 else int(room.argmax())
        load[where[i]] += sizes[i]


def _settle(sizes: np.ndarray, where: np.ndarray, k: int, capacity: int) -> bool:
    """Take what is over the capacity out of ``where``; False if that fails.

    The worst container gives an item to another or swaps one with it; failing that, its items and
    another's are divided anew.
    """
    load = np.bincount(where, weights=sizes, minlength=k).astype(np.int64)
    n = len(sizes)
    other = np.concatenate([sizes, np.zeros(k, np.int64)])  # a swap with an item of size 0 is a move
    while True:  # each step lowers what is over in all, so this ends
        c = int(load.argmax())
        over = int(load[c]) - capacity
        if over <= 0:
            return True
        if _resplit(sizes, where, load, c, capacity):
            continue
        home = np.concatenate([where, np.arange(k)])
        room = capacity - load[home]
        mine = np.flatnonzero(where == c)
        gain = sizes[mine][:, None] - other
        useful = np.where((gain > 0) & (gain <= room) & (home != c), np.minimum(gain, over) * (capacity + 1) - gain, -1)
        best = int(useful.argmax())
        if useful.flat[best] < 0:
            return False
        i, j = mine[best // len(other)], best % len(other)
        to, moved = int(home[j]), int(sizes[i] - other[j])
        where[i] = to
        if j < n:
            where[j] = c
        load[c] -= moved
        load[to] += moved


def pack_window(sizes: np.ndarray, capacity: int, repair: bool = True) -> np.ndarray:
    """Containers of items none of which exceeds the capacity; their number rises until all sums fit.

    Differencing lays out all items. Unless ``repair`` is off, sums that miss the capacity are settled
    before a container is added.
    """
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = differencing(sizes, k)
        fits = np.bincount(where, weights=sizes, minlength=k).max() <= capacity
        if not fits and repair:
            _refill(sizes, where, k, capacity)
            fits = _settle(sizes, where, k, capacity)
        if fits:
            return where
        k += max(1, k // 64)


def pack(sizes: np.ndarray, capacity: int, window: int = WINDOW, repair: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, container, first, end) of every piece: item is a row number, first and end its token range."""
    whole = sizes // capacity
    whole[sizes == capacity] = 0
    rest = sizes - whole * capacity
    item = np.repeat(np.arange(len(sizes)), whole)
    first = (np.arange(len(item)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    container = np.arange(len(item))
    left = np.flatnonzero(rest > 0)
    left = left[np.argsort(-rest[left], kind="stable")]
    # equal windows whose content comes closest below a whole number of containers
    least = max(1, -(-int(rest.sum()) // (capacity * window)))
    windows = min(range(least, 2 * least + 1), key=lambda w: w * np.ceil(rest.sum() / (w * capacity) + 0.1))
    turn = np.arange(len(left)) % (2 * windows)
    dealt = np.where(turn < windows, turn, 2 * windows - 1 - turn)
    at = len(item)
    parts = [(item, container, first, first + capacity)]
    for w in range(windows):
        own = left[dealt == w]
        if not len(own):
            continue
        where = pack_window(rest[own], capacity, repair)
        used, where = np.unique(where, return_inverse=True)
        start = whole[own] * capacity
        parts.append((own, at + where, start, start + rest[own]))
        at += len(used)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def fill_containers(items: DataFrame, key: str, size: str, specs: Sequence[tuple[int, int]], bucket_items: int = BUCKET_ITEMS, window: int = WINDOW) -> DataFrame:
    """(spec_id, container, key, first_token, end_token): where each item of each spec goes; end is exclusive.

    ``specs`` are (spec_id, capacity) pairs. Items with a null key or size, or a size under 1, are no
    items; of several rows of a key the largest size counts. Container numbers are unique within a
    spec, not dense. Only items longer than the capacity are split. No items give no rows. A spec with
    a null id or a capacity under 1 is refused.
    """
    pairs = [(int(s), int(c)) for s, c in specs if s is not None and c is not None and c > 0]
    if len(pairs) != len(specs):
        raise ValueError("every spec needs an id and a capacity of at least 1")
    known = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("bigint").alias("n")).dropna().where("n > 0").groupBy("key").agg(F.max("n").alias("n"))
    total = known.count()
    buckets = max(1, -(-total // bucket_items))
    placed = known.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    kind = dict(known.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            for bucket, rows in f.groupby("bucket", sort=False):
                if held and held[0]["bucket"].iloc[0] != bucket:
                    yield from done(held)
                    held = []
                held.append(rows)
        if held:
            yield from done(held)

    def done(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True)
        sizes, keys, base = rows["n"].to_numpy(), rows["key"].to_numpy(), int(rows["bucket"].iloc[0]) * _STRIDE
        for spec, capacity in pairs:
            item, container, first, end = pack(sizes, capacity, window)
            yield pd.DataFrame({"spec_id": np.int32(spec), "container": container + base, "key": keys[item], "first_token": first, "end_token": end})

    spread = placed.repartition(min(buckets, 100_000), "bucket").sortWithinPartitions("bucket", "key")
    out = spread.mapInPandas(run, f"spec_id int, container bigint, key {kind}, first_token bigint, end_token bigint")
    return out.withColumnRenamed("key", key)
