"""Filling windows of several permitted sizes with whole texts (problem 8): variable-capacity best fit."""

from __future__ import annotations

from bisect import bisect_right
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkir.session import stage


def pack(sizes: list[int], capacities: list[int]) -> list[tuple[int, list[int]]]:
    """Bins (capacity, indexes of the items): every item in exactly one, no bin above its capacity.

    Bins are opened for the largest item left. Each permitted capacity that holds it is filled in turn with the best
    fitting items, the largest that still fit; the one that leaves the least of its room unused is opened (ties: the
    larger). At the end each bin takes the least capacity that holds its contents. No item may exceed every capacity.
    """
    caps = sorted(set(capacities))
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        stacks.setdefault(n, []).append(i)
    if stacks and max(stacks) > caps[-1]:
        raise ValueError("an item exceeds every capacity")
    lengths = sorted(stacks)
    bins = []
    while lengths:
        best = None
        for cap in caps:
            if cap < lengths[-1]:
                continue
            used = {lengths[-1]: 1}
            room, at = cap - lengths[-1], len(lengths)
            while room and (at := bisect_right(lengths, room, 0, at)):
                n = lengths[at - 1]
                free = len(stacks[n]) - used.get(n, 0)
                take = min(free, room // n)
                if take:
                    used[n] = used.get(n, 0) + take
                    room -= take * n
                at -= 1
            cost = (room / cap, -cap)
            if best is None or cost < best[0]:
                best = (cost, used)
        items = []
        for n, times in best[1].items():
            items += [stacks[n].pop() for _ in range(times)]
            if not stacks[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
        held = sum(sizes[i] for i in items)
        bins.append((next(c for c in caps if c >= held), items))
    return bins


def pack_texts(documents: DataFrame, windows: DataFrame, tokens: str = "tokens", doc: str = "doc_id", shard_items: int = 20_000) -> DataFrame:
    """(bin_id, window_name, capacity, doc_id, piece, start_token, tokens): which window holds which text.

    A text is whole (piece 0) unless it is larger than the largest window; then it is cut into pieces as large as that,
    and a rest. Texts without tokens (null, empty) and null ids are not packed; rows that repeat id and size are one text.
    Windows without a name or a positive capacity are ignored, of those of equal capacity the first name is used; with no
    window left a ValueError is raised.

    Texts are spread by hash over shards of about ``shard_items``, so a shard is bounded whatever the sources' shares; a
    shard is packed by itself and leaves at most its last bins partly empty.
    """
    spec = windows.filter("window_name IS NOT NULL AND capacity_tokens > 0").groupBy("capacity_tokens").agg(F.min("window_name").alias("window_name"))
    names = {r.capacity_tokens: r.window_name for r in spec.collect()}  # the permitted sizes, a short list by its meaning
    if not names:
        raise ValueError("no window has a positive capacity")
    top = max(names)
    items = documents.filter((F.col(tokens) > 0) & F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(tokens).cast("long").alias("n")).distinct()
    items = items.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / top))).alias("piece"))
    items = items.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * top).alias("start_token"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("tokens"))
    items = stage(items, "items")
    shards = max(1, ceil(items.count() / shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["tokens", "doc_id", "piece", "start_token"]).reset_index(drop=True)
        bins = pack(p["tokens"].tolist(), list(names))
        bin_of, cap_of = [0] * len(p), [0] * len(p)
        for b, (cap, held) in enumerate(bins):
            for i in held:
                bin_of[i], cap_of[i] = b, cap
        first = int(p["shard"].iloc[0]) << 32 if len(p) else 0
        return p.assign(bin_id=[first + b for b in bin_of], capacity=cap_of, window_name=[names[c] for c in cap_of])[["bin_id", "window_name", "capacity", "doc_id", "piece", "start_token", "tokens"]]

    return items.groupBy("shard").applyInPandas(run, "bin_id long, window_name string, capacity int, doc_id long, piece int, start_token long, tokens long")


def fill_report(packed: DataFrame) -> DataFrame:
    """(window_name, capacity, bins, texts, tokens, unused, fill) per window used."""
    bins = packed.groupBy("bin_id", "window_name", "capacity").agg(F.sum("tokens").alias("held"), F.count("*").alias("texts"))
    return bins.groupBy("window_name", "capacity").agg(
        F.count("*").alias("bins"), F.sum("texts").alias("texts"), F.sum("held").alias("tokens"),
        F.sum(F.col("capacity") - F.col("held")).alias("unused"), (F.sum("held") / F.sum("capacity")).alias("fill"))
