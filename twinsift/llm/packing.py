"""Problem 6: texts into containers of fixed capacity, by bin completion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .tokens import VOCABULARY, count_tokens, spread

#: Texts per shard. Shards are packed apart from each other, at the price of about half a container each.
SHARD_TEXTS = 8_192
#: Search steps for the completion of one container, and branches for the last containers of a shard.
FILL_STEPS, TAIL_NODES = 300, 2_000
#: So many of the last items of a shard are left to the branch-and-bound over all completions.
TAIL_ITEMS = 40


class Sizes:
    """A multiset of item sizes, ordered."""

    def __init__(self, sizes):
        self.count: dict[int, int] = defaultdict(int)
        for s in sizes:
            self.count[s] += 1
        self.order = sorted(self.count)
        self.total, self.items = sum(sizes), len(sizes)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        self.total -= s
        self.items -= 1
        if not self.count[s]:
            del self.count[s]
            del self.order[bisect_left(self.order, s)]

    def put(self, s: int) -> None:
        if s not in self.count:
            insort(self.order, s)
        self.count[s] += 1
        self.total += s
        self.items += 1

    def at_most(self, room: int) -> int:
        """Index of the largest size that fits, or -1."""
        return bisect_right(self.order, room) - 1


def best_filling(left: Sizes, room: int, steps: int = FILL_STEPS) -> list[int]:
    """Sizes that fill ``room`` with the least waste found, larger ones first; ``left`` is unchanged.

    Depth-first over sizes in falling order. An item that fills the rest exactly dominates every other filling of it, so
    it ends the search.
    """
    best, waste, path = [], room, []
    budget = [steps]

    def search(room: int, top: int) -> bool:
        nonlocal best, waste
        if left.count.get(room, 0) > 0:
            best, waste = [*path, room], 0
            return True
        if room < waste:
            best, waste = path.copy(), room
        k = min(top, left.at_most(room))
        while k >= 0 and budget[0] > 0:
            s = left.order[k]
            if left.count[s] > 0 and s <= room:
                budget[0] -= 1
                left.count[s] -= 1
                path.append(s)
                done = search(room - s, k)
                path.pop()
                left.count[s] += 1
                if done:
                    return True
            k -= 1
        return False

    search(room, len(left.order) - 1)
    return best


def completions(left: Sizes, room: int, allowed: int, most: int = 64) -> list[list[int]]:
    """Undominated fillings of ``room`` that waste at most ``allowed``, least waste first.

    A filling is dominated, and left out, if an item of what is left still fits beside it, if one item fills the room
    exactly, or if two of its items could be exchanged for one of what is left that is at least as large as both and fits.
    """
    if left.count.get(room, 0) > 0:
        return [[room]]
    found: list[tuple[int, list[int]]] = []
    path: list[int] = []

    def search(room: int, top: int) -> None:
        if len(found) >= most:
            return
        fits = left.at_most(room)
        while fits >= 0 and left.count[left.order[fits]] <= 0:
            fits -= 1
        if fits < 0:
            if room <= allowed and not _exchangeable(left, path, room):
                found.append((room, path.copy()))
            return
        for k in range(min(top, fits), -1, -1):
            s = left.order[k]
            if left.count[s] > 0:
                left.count[s] -= 1
                path.append(s)
                search(room - s, k)
                path.pop()
                left.count[s] += 1

    search(room, len(left.order) - 1)
    return [p for _, p in sorted(found, key=lambda x: x[0])]


def _exchangeable(left: Sizes, path: list[int], room: int) -> bool:
    for i, a in enumerate(path):
        for b in path[i + 1 :]:
            k = left.at_most(a + b + room)
            if k >= 0 and left.order[k] >= a + b and left.count[left.order[k]] > 0:
                return True
    return False


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers needed at least: by total size, and with the items above half the capacity, no two of which fit together."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the first incumbent."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        insort(rooms, (room - s, b))
    return bins


def branch_and_bound(sizes: list[int], capacity: int, nodes: int = TAIL_NODES) -> list[list[int]]:
    """The fewest containers found for ``sizes`` within ``nodes`` branches: the optimum if they suffice.

    Each branch fills a container around the largest item left, least waste first. A branch is cut when the waste so far
    leaves no way to need fewer containers than the incumbent.
    """
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    total, left, chosen, budget = sum(sizes), Sizes(sizes), [], [nodes]

    def search(wasted: int) -> None:
        nonlocal best
        if not left.items:
            if len(chosen) < len(best):
                best = [c.copy() for c in chosen]
            return
        budget[0] -= 1
        if budget[0] < 0 or len(best) <= bound:
            return
        largest = left.order[-1]
        left.take(largest)
        # a solution with fewer containers may waste this much in all; the last container's free room is waste too
        for c in completions(left, capacity - largest, (len(best) - 1) * capacity - total - wasted):
            allowed = (len(best) - 1) * capacity - total - wasted
            waste = capacity - largest - sum(c)
            if waste > allowed or budget[0] < 0:
                break
            for s in c:
                left.take(s)
            chosen.append([largest, *c])
            search(wasted + waste)
            chosen.pop()
            for s in c:
                left.put(s)
        left.put(largest)

    search(0)
    return best


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers for sizes from 1 to ``capacity``: bin completion around the largest item, the tail by branch-and-bound."""
    first = best_fit(sizes, capacity)
    left, out = Sizes(sizes), []
    while left.items > TAIL_ITEMS:
        largest = left.order[-1]
        left.take(largest)
        filling = best_filling(left, capacity - largest)
        for s in filling:
            left.take(s)
        out.append([largest, *filling])
    out += branch_and_bound([s for s, n in left.count.items() for _ in range(n)], capacity)
    return out if len(out) < len(first) else first


def _packer(capacities: dict[str, int]):
    def pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        spec, shard = key
        capacity = capacities[spec]
        b = b.sort_values(["n_tokens", "doc_id"], ascending=[False, True])
        ids, tokens = b["doc_id"].to_numpy(), b["n_tokens"].to_numpy()
        whole, rest = np.divmod(tokens, capacity)
        rows = [np.empty((0, 5), dtype=np.int64)]
        # pieces of texts above the capacity, each a full container of its own
        cut_up = np.flatnonzero(whole)
        if len(cut_up):
            times = whole[cut_up]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows.append(np.column_stack([np.arange(times.sum()), np.repeat(ids[cut_up], times), part, part * capacity, np.full(times.sum(), capacity)]))
        made = int(whole.sum())
        by_size = defaultdict(list)
        for i in np.flatnonzero(rest)[::-1]:
            by_size[int(rest[i])].append(i)
        packed = [(n, by_size[s].pop()) for n, c in enumerate(pack_sizes([int(s) for s in rest if s], capacity)) for s in c]
        if packed:
            n, i = np.array(packed, dtype=np.int64).T
            rows.append(np.column_stack([made + n, ids[i], whole[i], whole[i] * capacity, rest[i]]))
        all_rows = np.concatenate(rows)
        out = pd.DataFrame(all_rows, columns=["container", "doc_id", "part_no", "start_token", "n_tokens"])
        out["container"] += int(shard) << 32
        out.insert(0, "spec_name", spec)
        return out

    return pack


def text_sizes(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every text with at least one token."""
    return spread(docs.select("doc_id", "text")).select("doc_id", count_tokens(vocabulary)("text").alias("n_tokens")).where(F.col("n_tokens") > 0)


def containers(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(spec_name, container, doc_id, part_no, start_token, n_tokens)``: where every text goes, per capacity.

    A text of up to the capacity stays whole. A longer one is cut at multiples of the capacity; its full pieces are a
    container each and the remainder is an item like any other. Null and empty texts have no tokens and take no room.
    Rows that repeat a doc_id are items of their own. Specs without a capacity above 0 are ignored.

    Texts are spread over shards by a hash, evenly whatever their ids, so no container problem grows with the table; only
    (doc_id, size) travels to them. ``specs`` is a fixed table of a few rows.
    """
    capacities = {r.spec_name: r.capacity_tokens for r in specs.where((F.col("capacity_tokens") > 0) & F.col("spec_name").isNotNull()).collect()}
    sized = cut(text_sizes(docs, vocabulary))
    shards = max(1, round(sized.count() / SHARD_TEXTS))
    each = sized.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(shards)).alias("shard"), F.explode(F.array(*[F.lit(c) for c in sorted(capacities)]) if capacities else F.array().cast("array<string>")).alias("spec_name"))
    return each.groupBy("spec_name", "shard").applyInPandas(_packer(capacities), "spec_name string, container bigint, doc_id bigint, part_no bigint, start_token bigint, n_tokens bigint")


def filling(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the containers needed at least for so many tokens, and the share of room used."""
    per = placed.groupBy("spec_name").agg(F.countDistinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("texts"))
    return per.join(specs.select("spec_name", "capacity_tokens"), "spec_name").select("spec_name", "capacity_tokens", "containers", "texts", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))
