"""Links between the members of hash buckets, and connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import discard, materialise

#: Members of a bucket up to which all pairs of different components are compared: at most so many pairs a member.
SMALL = 32
SLOT_BITS = 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v). One star step; the minimum of a node's neighbours is an aggregate with map-side combine, never a collected group."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("k"), F.least("u", "m0").alias("m"))
    joined = both.join(low, both.u == low.k)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) of ids -> (node, comp): the smallest id reachable, for each node that has a pair. Stars repeat until they change nothing."""
    edges = materialise(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda d: d.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(v as decimal(38,0)))")).first()
    now = sign(edges)
    while now[0]:
        step = materialise(_star(_star(edges, True), False), "edges")
        discard(edges)
        edges, last, now = step, now, sign(step)
        if now == last:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """sets (id, comp, grams: distinct values) -> all pairs (a, b) in different comps that can reach ``percent`` by the prefix filter.

    Values get one order for all sets, rare ones first. Two sets of the wanted
    similarity share a value among the first ``n - ceil(percent * n / 100) + 1`` of
    each, so only these meet in a join: sets that have nothing but frequent values in
    common give no pair. Frequencies are counts in SLOTS slots by hash (one byte each
    is broadcast); collisions make the order worse, never the result.
    """
    context = sets.sparkSession.sparkContext
    slot = lambda g: (K.mix(g) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def count(batches):
        total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(slot(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "c"])

    counts = sets.select("grams").mapInArrow(count, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    rank = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    rank[counts["slot"].to_numpy()] = np.minimum(255, 5 * np.log2(counts["c"].to_numpy())).astype(np.uint8)
    ranks = context.broadcast(rank)

    def cut(batches):
        for batch in batches:
            n = np.diff(batch.column(2).offsets.to_numpy())
            flat = batch.column(2).flatten().to_numpy().view(np.uint64)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, ranks.value[slot(flat)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            order = order[place < np.repeat(n + 1 + (-percent * n) // 100, n)]
            own = row[order]
            yield pa.RecordBatch.from_arrays([pa.array(flat[order].view(np.int64)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(n[own].astype(np.int64))], names=["gram", "id", "comp", "n"])

    prefixes = materialise(sets.select("id", "comp", "grams").mapInArrow(cut, "gram long, id long, comp long, n long"), "prefixes")
    shared = prefixes.groupBy("gram").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("gram")
    return _in_one_group(prefixes.join(shared, "gram", "left_semi"), "gram", percent)


def _in_one_group(members: DataFrame, group: str, percent: int) -> DataFrame:
    """members (group, id, comp, n) -> pairs of one group that are in different comps and whose sizes allow the threshold."""
    left = members.select(group, F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))
    right = members.select(group, F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
    return left.join(right, group).where(f"ca < cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bucket_links(keys: DataFrame, percent: int, prepare: Callable[[DataFrame], DataFrame], grams: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keys (key, id) -> confirmed pairs (a, b) that connect all that pairs of one key can connect.

    In each bucket all members are first compared with the smallest id, so that a
    bucket of any size gives one pair a member and none is collected. Members that this
    leaves in different components are then compared with each other: directly in
    buckets of at most SMALL members, by the prefix filter, which misses nothing, in
    larger ones. ``prepare`` gets the members of shared buckets (key, id, lead) and
    returns their set sizes (id, n); ``grams`` gets ids (id) and returns (id, grams).
    """
    shared = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("high")).where("lead < high").select("key", "lead")
    members = materialise(keys.join(shared, "key").distinct(), "members")
    sizes = prepare(members)
    star = materialise(members.where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star")
    links = materialise(confirm(star), "links")

    comps = connected_components(links)
    placed = members.join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m")).where("c0 < c1").select("key", (F.col("m") > SMALL).alias("large"))
    apart = materialise(placed.join(open_keys, "key").join(sizes, "id").select("key", "id", "comp", "n", "large"), "apart")
    rest = _in_one_group(apart.where("not large"), "key", percent)
    large = materialise(apart.where("large").select("id", "comp").distinct(), "large")
    if not large.isEmpty():
        sets = materialise(grams(large.select("id")).join(large, "id").select("id", "comp", "grams"), "large-sets")
        rest = rest.union(prefix_pairs(sets, percent)).distinct()
    more = materialise(confirm(rest.join(star, ["a", "b"], "left_anti")), "links")
    for t in (members, star, apart, large):
        discard(t)
    return links.union(more)
