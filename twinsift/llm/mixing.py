"""Problem 7: a mixture of sources in target shares, by min-cost flow."""

from __future__ import annotations

import warnings
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import cut
from .tokens import VOCABULARY, count_tokens, source_name, spread

SEED = 7
#: Texts per slice of the seeded order: slices are summed apart, so that no window holds a whole pattern.
SLICE_TEXTS = 4_096
#: Texts of each pattern, drawn by a seeded hash, among which the last tokens of its quotas are settled, and changes a quota.
SETTLING_TEXTS, SETTLING_CHANGES = 512, 12
#: Bisection steps for the largest total.
STEPS = 60


class Flow:
    """Min-cost flow on a small network by successive shortest paths; capacities and costs are integers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, e: int) -> int:
        return self.room[e ^ 1]

    def run(self, s: int, t: int) -> int:
        """Send as much as possible from ``s`` to ``t`` at the least cost; returns the amount."""
        sent = 0
        while True:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and (b not in dist or dist[a] + self.cost[e] < dist[b]):
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if b not in queued:
                            queued.add(b)
                            queue.append(b)
            if t not in dist:
                return sent
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount
            sent += amount


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[int, dict]:
    """Tokens per (pattern, source) for a mixture of ``total`` tokens: (tokens placed, flows).

    Each pattern offers its tokens once at no cost, a second time at cost 1, a third time at cost 2 and so on, up to the
    smallest cap among its sources: convex costs, so a text is repeated only when nothing unused is left, and all texts
    of a pattern are repeated evenly. Each source takes its quota.
    """
    names = sorted(shares)
    net = Flow(2 + 2 * len(patterns) + len(names))
    at = {n: 2 + 2 * len(patterns) + i for i, n in enumerate(names)}
    uses = {}
    for k, (p, tokens) in enumerate(sorted(patterns.items())):
        offer, pool = 2 + 2 * k, 3 + 2 * k
        net.edge(0, offer, tokens * min(repeats[n] for n in p))
        for level in range(min(repeats[n] for n in p)):
            net.edge(offer, pool, tokens, level)
        for n in p:
            uses[p, n] = net.edge(pool, at[n], tokens * repeats[n])
    for n in names:
        net.edge(at[n], 1, int(shares[n] * total))
    sent = net.run(0, 1)
    return sent, {k: net.used(e) for k, e in uses.items()}


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The most tokens a mixture can have with every source at its share and no text above its cap."""
    low, high = 0, sum(t * min(repeats[n] for n in p) for p, t in patterns.items())
    for _ in range(STEPS):
        if low >= high:
            break
        mid = (low + high + 1) // 2
        if route(patterns, shares, repeats, mid)[0] == sum(int(s * mid) for s in shares.values()):
            low = mid
        else:
            high = mid - 1
    return low


def settled(gaps: dict[tuple[str, str], int], texts: dict[str, list[tuple[str, int, dict[str, int]]]], caps: dict[str, int]) -> dict[tuple[str, str], int]:
    """``(digest, source) -> change of uses`` that closes the gaps per (pattern, source) as well as a few changes can.

    ``texts`` has per pattern (digest, tokens, uses by source). Each change gives or takes one use of the text that brings
    the gap closest to 0; no text is used more than its pattern's cap in all.
    """
    changes: dict[tuple[str, str], int] = defaultdict(int)
    total = {d: sum(u.values()) for rows in texts.values() for d, _, u in rows}
    open_gaps = dict(sorted(gaps.items()))
    for (p, n), _ in [*open_gaps.items()] * 2:  # what one source gives back in the first turn another may take in the second
        for _ in range(SETTLING_CHANGES):
            gap = open_gaps[p, n]
            more = ((abs(gap - t), d, 1, t) for d, t, _ in texts.get(p, ()) if total[d] < caps[p])
            less = ((abs(gap + t), d, -1, t) for d, t, u in texts.get(p, ()) if u.get(n, 0) + changes[d, n] > 0)
            left, digest, sign, tokens = min((*more, *less), default=(abs(gap), "", 0, 0))
            if left >= abs(gap):
                break
            changes[digest, n] += sign
            total[digest] += sign
            open_gaps[p, n] -= sign * tokens
    return {k: v for k, v in changes.items() if v}


def distinct_texts(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(digest, n_tokens, pattern, doc_ids)`` of every text that a wanted source has.

    A text that several sources hold is one text with the pattern of all these sources; ``doc_ids`` gives the smallest
    doc_id that each of them has it under. Null and empty texts and other sources are left out. ``targets`` is a fixed
    table of a few rows.
    """
    wanted = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).select(source_name(F.col("source")).alias("source")).distinct()
    own = docs.select("doc_id", "text", source_name(F.col("source")).alias("source")).where(F.col("source").isNotNull()).join(wanted, "source", "left_semi")
    sized = spread(own).select("source", "doc_id", F.sha2("text", 256).alias("digest"), count_tokens(vocabulary)("text").alias("n_tokens")).where(F.col("n_tokens") > 0)
    per = sized.groupBy("digest", "source").agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
    return per.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("of")).select("digest", "n_tokens", F.concat_ws("\x1f", F.transform("of", lambda x: x.source)).alias("pattern"), F.map_from_entries("of").alias("doc_ids"))


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """``(source, doc_id, uses, n_tokens)``: which text is used how often on whose account.

    ``total`` is the size wanted in tokens; by default it is the largest at which every source can reach its share. A
    larger one can't be had with these shares and caps; it is lowered to that, with a warning that names both. A
    text is used at most ``max_repeats`` times in all; if several sources with different caps hold it, the smallest cap
    holds. A source without any text takes part in no mixture of any size: it is left out and the shares of the rest are
    taken relative to each other. Sources of ``targets`` without a share or cap above 0 are ignored, repeated rows count
    once (the largest share).

    Texts are aggregated by membership pattern, the only thing the driver sees: at most 2^sources - 1 rows, in practice a
    few dozen. Flows of a pattern are laid along its texts in a seeded order: a text is used where its middle falls. Its
    place in that order comes from sums per slice, not from a window over the pattern. What a quota then misses, half a
    text at most on either side, is settled by giving or taking single uses of a bounded number of the pattern's texts.
    """
    spark = docs.sparkSession
    rows = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).where(F.col("source").isNotNull()).collect()
    texts = cut(distinct_texts(docs, targets, vocabulary))
    stats = {tuple(r.pattern.split("\x1f")): (int(r.tokens), int(r.texts)) for r in texts.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).collect()}
    patterns = {p: t for p, (t, _) in stats.items()}
    there = {n for p in patterns for n in p}
    caps = {r.source: int(r.cap) for r in rows if r.source in there}
    whole = sum(r.share for r in rows if r.source in there)
    shares = {r.source: r.share / whole for r in rows if r.source in there}
    most = largest_total(patterns, shares, caps) if patterns else 0
    if total is not None and total > most:
        warnings.warn(f"a mixture of {total} tokens can't be had with these shares and caps; it gets {most}", stacklevel=2)
    _, flows = route(patterns, shares, caps, most if total is None else min(total, most)) if patterns else (0, {})
    # the segments of each pattern's line: first source from 0, the next where it ends, ...
    segments, lines = [], []
    for p in sorted(patterns):
        end = 0
        for n in p:
            if flows[p, n]:
                segments.append(("\x1f".join(p), n, end, end + flows[p, n]))
                end += flows[p, n]
        lines.append(("\x1f".join(p), patterns[p], -(-end // patterns[p]), max(1, stats[p][1] // SLICE_TEXTS)))
    line = spark.createDataFrame(lines, "pattern string, tokens bigint, passes bigint, slices bigint")
    segment = spark.createDataFrame(segments, "pattern string, source string, low bigint, high bigint")
    order = F.xxhash64(F.lit(seed), "digest")
    placed = texts.join(line, "pattern").where(F.col("passes") > 0).withColumn("slice", F.pmod(order, F.col("slices"))).withColumn("place", F.xxhash64(F.lit(seed + 1), "digest"))
    before = Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = placed.groupBy("pattern", "slice").agg(F.sum("n_tokens").alias("in_slice")).withColumn("offset", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).drop("in_slice")
    within = Window.partitionBy("pattern", "slice").orderBy("place", "digest").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(offset, ["pattern", "slice"])
    start = F.col("offset") + F.col("inside")
    runs = started.select("pattern", "digest", "doc_ids", "n_tokens", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1), lambda k: k * F.col("tokens") + start + F.col("n_tokens") / 2)).alias("at"))
    used = runs.join(segment, "pattern").where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    uses = cut(used.groupBy("pattern", "source", "digest").agg(F.first("doc_ids").alias("doc_ids"), F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("uses")))
    laid = {(r.pattern, r.source): int(r.tokens) for r in uses.groupBy("pattern", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens")).collect()}
    gaps = {(p, n): high - low - laid.get((p, n), 0) for p, n, low, high in segments}
    some = texts.join(line, "pattern").select("pattern", "digest", "n_tokens", "doc_ids", F.row_number().over(Window.partitionBy("pattern").orderBy(F.xxhash64(F.lit(seed + 2), "digest"), "digest")).alias("rank")).where(F.col("rank") <= SETTLING_TEXTS)
    by_text = uses.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("source", "uses"))).alias("by_source"))
    pool, of = defaultdict(list), {}
    for r in some.join(by_text, "digest", "left").orderBy("pattern", "rank").collect():  # patterns x SETTLING_TEXTS
        pool[r.pattern].append((r.digest, int(r.n_tokens), r.by_source or {}))
        of[r.digest] = r
    changes = settled(gaps, pool, {"\x1f".join(p): min(caps[n] for n in p) for p in patterns})
    rows = [(n, d, of[d].doc_ids[n], int(of[d].n_tokens), v) for (d, n), v in sorted(changes.items())]
    changed = spark.createDataFrame(rows, "source string, digest string, doc_id bigint, n_tokens bigint, uses bigint")
    whole_uses = uses.select("source", "digest", F.try_element_at("doc_ids", F.col("source")).alias("doc_id"), "n_tokens", "uses").unionByName(changed)
    return whole_uses.groupBy("source", "digest").agg(F.first("doc_id").alias("doc_id"), F.sum("uses").alias("uses"), F.first("n_tokens").alias("n_tokens")).where(F.col("uses") > 0).select("source", "doc_id", "uses", "n_tokens")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per wanted source the share it was to have, the share it has, and how its texts were used; sources without texts have 0."""
    per = mixed.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("uses").alias("most_uses"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    tokens = F.coalesce("tokens", F.lit(0))
    return want.join(per, "source", "left").select("source", "target_share", F.round(tokens / F.sum(tokens).over(Window.partitionBy()), 6).alias("actual_share"), tokens.alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
