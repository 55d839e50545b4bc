"""Exact, preferred, greedy and transitive de-duplication. Every input has an explicit order column; ties are by order."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.joining import lookup
from sievework.session import discard, written

LOCAL = 8_000_000  # edges that one task decides, as arrays of some 50 bytes an edge
GROUP = 100_000  # edges of a component that one task decides beside others
SLICE = 2_000_000  # keys of sets above which they are joined in slices
SLICES = 4
KEY_TOKENS = 4  # most tokens of a key by which sets meet
MOST_KEYS = 512  # most keys of a set that has several tokens in each
KEY_COST = 20  # what a shuffled key costs, in compared candidates


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key; rank runs in the map tasks first, so a hot key sends one row a task."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prefer(df: DataFrame, keys: Sequence[str], preferred: Column, order: str, place: str = "place") -> DataFrame:
    """One row a key: the first preferred one, else the first; ``place`` is where the key's first row stood.

    Rows with an empty or null key are never merged.
    """
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
    whole = df.withColumn("_p", F.when(preferred, 0).otherwise(1))
    # reduced before the shuffle: the best row and the first place are both partial aggregates
    names = df.columns
    best = whole.where(~blank).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct(*names), F.struct("_p", order)).alias("_r"), F.min(order).alias(place)
    )
    return best.select("_r.*", place).unionByName(df.where(blank).withColumn(place, F.col(order)))


def greedy_keys(df: DataFrame, keys: Sequence[str], order: str, rounds: int = 1000) -> DataFrame:
    """Rows a scan in order keeps when a row is dropped as soon as any of its keys was kept before.

    Rounds on key minima instead of pairs: an undecided row that is the first undecided one of all its keys is kept; rows
    that share a key with a kept row are dropped. Each round decides at least the first undecided row, and shuffles at
    most the undecided rows, so groups of any size stay linear.
    """
    kept, todo = None, written(df.select(F.col(order).alias("_o"), *[F.nullif(F.col(k), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]), "greedy")
    for _ in range(rounds):
        marked = todo
        for i in range(len(keys)):
            low = todo.where(f"_k{i} is not null").groupBy(f"_k{i}").agg(F.min("_o").alias(f"_m{i}"))
            marked = marked.join(low, f"_k{i}", "left")
        firsts = reduce(lambda a, b: a & b, [F.col(f"_m{i}").isNull() | (F.col(f"_m{i}") == F.col("_o")) for i in range(len(keys))])
        marked = written(marked.withColumn("_keep", firsts), "greedy")
        fresh = marked.where("_keep")
        first = written(fresh.select("_o"), "greedy")
        kept = first if kept is None else kept.unionByName(first)
        rest = marked.where("not _keep").select("_o", *[f"_k{i}" for i in range(len(keys))])
        for i in range(len(keys)):
            rest = rest.join(fresh.where(f"_k{i} is not null").select(f"_k{i}").distinct(), f"_k{i}", "left_anti")
        rest = written(rest.select("_o", *[f"_k{i}" for i in range(len(keys))]), "greedy")
        discard(todo, marked)
        todo = rest
        if not todo.limit(1).count():
            break
    else:
        raise RuntimeError(f"rows undecided after {rounds} rounds")
    return df.join(kept, F.col(order) == F.col("_o"), "left_semi")


def leaders(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Greedy leader clustering over similarity edges (lo < hi): id and leader of every node.

    A row is a leader iff no earlier leader is adjacent; others belong to their first adjacent leader. Nodes without an
    edge lead. At most ``LOCAL`` edges are decided whole in one task, by one scan in order; of more edges each connected
    component of at most ``GROUP`` is. Larger ones go by rounds: a row without an undecided or leading earlier neighbour
    leads; a row with a leading earlier neighbour follows; what isn't decided after ``rounds`` raises.
    """
    edges = written(edges.select("lo", "hi"), "edges")
    many = edges.count()
    if not many:
        return nodes.select("id", F.col("id").alias("leader"))
    if many <= LOCAL:  # all in one task
        decided = written(edges.coalesce(1).mapInArrow(_scan_all, "id long, leader long"), "decided")
        discard(edges)
        return decided.unionByName(nodes.join(decided, "id", "left_anti").select("id", F.col("id").alias("leader")))
    ends = edges.select(F.col("lo").alias("id")).unionByName(edges.select(F.col("hi").alias("id"))).distinct()
    parts = components(ends, edges)
    placed = written(edges.join(parts.withColumnRenamed("id", "lo"), "lo"), "placed")
    discard(edges, parts)
    group = min(GROUP, LOCAL)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    small = placed.join(sizes.where(F.col("n") <= group), "component").select("component", "lo", "hi")
    out = small.groupBy("component").applyInPandas(_scan, "id long, leader long")
    large = written(placed.join(sizes.where(F.col("n") > group), "component").select("lo", "hi"), "large")
    if large.limit(1).count():
        out = out.unionByName(_leaders_by_rounds(large, rounds))
    decided = written(out, "decided")
    discard(placed, large)
    return decided.unionByName(nodes.join(decided, "id", "left_anti").select("id", F.col("id").alias("leader")))


def _first_leaders(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and their leaders by one scan in order."""
    ids = np.unique(np.concatenate([lo, hi]))
    pairs = (np.searchsorted(ids, hi) << 32) | np.searchsorted(ids, lo)
    pairs.sort()
    ends, first = np.unique(pairs >> 32, return_index=True)
    before, own, leads = pairs & 0xFFFFFFFF, np.arange(len(ids)), np.ones(len(ids), dtype=bool)
    for i, start, end in zip(ends.tolist(), first.tolist(), [*first[1:].tolist(), len(pairs)]):
        near = before[start:end]
        leading = leads[near]
        k = leading.argmax()
        if leading[k]:
            own[i], leads[i] = near[k], False
    return ids, ids[own]


def _scan(d: pd.DataFrame) -> pd.DataFrame:
    """Leaders of the nodes of a component's edges."""
    ids, own = _first_leaders(d.lo.to_numpy(), d.hi.to_numpy())
    return pd.DataFrame({"id": ids, "leader": own})


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders of the nodes of all edges that come."""
    parts = [(b.column("lo").to_numpy(), b.column("hi").to_numpy()) for b in batches]
    if not parts:
        return
    ids, own = _first_leaders(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    for i in range(0, len(ids), 100_000):
        yield pa.record_batch([pa.array(ids[i : i + 100_000], pa.int64()), pa.array(own[i : i + 100_000], pa.int64())], names=["id", "leader"])


def _leaders_by_rounds(edges: DataFrame, rounds: int) -> DataFrame:
    nodes = edges.select(F.col("lo").alias("id")).unionByName(edges.select(F.col("hi").alias("id"))).distinct()
    state = written(nodes.select("id", F.lit(None).cast("boolean").alias("leads")), "leaders")
    for _ in range(rounds):
        known = edges.join(state.select(F.col("id").alias("lo"), F.col("leads").alias("l")), "lo")
        seen = known.groupBy("hi").agg(F.max(F.coalesce(F.col("l"), F.lit(False))).alias("led"), F.max(F.col("l").isNull()).alias("open"))
        new = state.join(seen, F.col("id") == F.col("hi"), "left").select(
            "id",
            F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)).alias("leads"),
        )
        new = written(new, "leaders")
        discard(state)
        state = new
        if not state.where("leads is null").limit(1).count():
            break
    else:
        raise RuntimeError(f"leaders undecided after {rounds} rounds")
    own = edges.join(state.where("leads").select(F.col("id").alias("lo")), "lo").groupBy("hi").agg(F.min("lo").alias("first"))
    return state.join(own, F.col("id") == F.col("hi"), "left").select("id", F.when(F.col("leads"), F.col("id")).otherwise(F.col("first")).alias("leader"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Connected components: id and the smallest id it is linked to, by label propagation with pointer jumping."""
    both = edges.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    links = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(nodes.select("id", F.col("id").alias("low")), "labels")
    for _ in range(rounds):
        heard = links.join(labels.select(F.col("id").alias("b"), F.col("low").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        jump = labels.select(F.col("id").alias("low"), F.col("low").alias("j"))
        step = labels.join(heard, F.col("id") == F.col("a"), "left").join(jump, "low")
        new = written(step.select("id", F.least("low", F.coalesce("l", "low"), "j").alias("low"), F.col("low").alias("old")), "labels")
        discard(labels)
        labels = new
        if not new.where("low != old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components not found after {rounds} rounds")
    discard(links)
    out = labels.select("id", F.col("low").alias("component"))
    out._written = labels._written
    return out


def _rare_first(df: DataFrame, key: str, signature: str, keep: list[str]) -> DataFrame:
    """id, kept columns, tokens by rising frequency and their number, written."""
    each = df.select(F.col(key).alias("id"), *keep, F.explode(signature).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    sets = each.join(counts, "token").groupBy("id", *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    return written(sets.withColumn("size", F.size("tokens")), "sets")


def token_pairs(df: DataFrame, key: str, signature: str, block: str, least: int) -> DataFrame:
    """lo, hi and shared of rows of one block that share at least ``least`` tokens, exact.

    Prefix filter: two such sets share a token among the first ``size - least + 1`` of each by rising frequency, so only
    those are indexed. Rows with equal sets should be collapsed before (``representatives``).
    """
    sets = _rare_first(df.withColumn("_b", F.col(block)), key, signature, ["_b"]).where(F.col("size") >= least)
    index = sets.select("id", "_b", F.explode(F.slice("tokens", F.lit(1), F.col("size") - least + 1)).alias("token"))
    found = index.withColumnRenamed("id", "lo").join(index.withColumnRenamed("id", "hi"), ["token", "_b"]).where("lo < hi").select("lo", "hi").distinct()
    a, b = sets.select(F.col("id").alias("lo"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("hi"), F.col("tokens").alias("tb"))
    both = found.join(a, "lo").join(b, "hi").select("lo", "hi", F.size(F.array_intersect("ta", "tb")).cast("long").alias("shared"))
    return both.where(F.col("shared") >= least)


def _ranked(df: DataFrame, key: str, signature: str) -> DataFrame:
    """id, tokens as their ranks by rising frequency, the rows that have each, and their number, written."""
    own = written(df.select(F.col(key).alias("id"), F.array_distinct(signature).alias("all")), "signatures")
    each = own.select("id", F.explode("all").alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    ranks = written(counts.select("token", "n", F.col("n").alias("rows"), F.row_number().over(Window.orderBy("n", "token")).alias("rank")), "ranks")
    sets = lookup(each, ranks, "token", ["rank", "rows"], "n").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "rows"))).alias("t"))
    out = written(sets.select("id", F.transform("t", lambda x: x["rank"]).alias("tokens"), F.transform("t", lambda x: x["rows"]).alias("rows"), F.size("t").alias("size")), "sets")
    discard(own, ranks)
    return out


class _Keys:
    """What sets are indexed by: keys of several tokens, so that frequent tokens alone bring nothing together.

    Two sets of sizes s <= n that are near share at least ``least`` tokens; the first ``k`` of these in the common order
    lie among the first ``size - least + k`` of each. Every choice of k tokens of those is a key. ``levels`` holds the k
    and the least number of shared tokens of every pair of sizes that can be near, ``choices`` what a set of a size is
    indexed by, as the smaller one (side 0) or the larger (side 1). ``near`` says whether so many shared tokens are enough
    for sets of two sizes, and more are then too. Sizes are few; means of the tokens' shares by place weigh keys against
    candidates.
    """

    def __init__(self, counts: dict[int, int], shares: dict[int, list[float]], near: Callable[[int, int, int], bool]):
        self.counts, sizes = counts, sorted(counts)
        self.need = {(s, n): 1 + bisect.bisect_left(range(1, s + 1), True, key=lambda o: near(o, s, n)) for s in sizes for n in sizes if s <= n and near(s, s, n)}  # noqa: B023
        self.loose: dict[int, int] = {}
        for (_, n), o in self.need.items():
            self.loose[n] = min(o, self.loose.get(n, o))
        usual = set(sorted(counts, key=counts.get)[-24:])
        self.levels, self.choices, best = {}, {}, None
        for most in range(1, KEY_TOKENS + 1):
            levels = {(s, n): (min(self._most(n, most), o), o) for (s, n), o in self.need.items()}
            choices: dict[tuple[int, int, int], int] = {}
            for (s, n), (k, o) in levels.items():
                for z, side in ((s, 0), (n, 1)):
                    choices[z, side, k] = max(z - o + k, choices.get((z, side, k), 0))
            cost = KEY_COST * sum(counts[z] * comb(p, k) for (z, _, k), p in choices.items())
            cost += sum(counts[s] * counts[n] * _chosen(shares[s][: s - o + k], k) for (s, n), (k, o) in levels.items() if s in usual and n in usual)
            if best is None or cost < best:
                self.levels, self.choices, best = levels, choices, cost

    def _most(self, n: int, most: int) -> int:
        """Tokens of a key of a set of n tokens; the larger of two sets has the more keys."""
        return max(k for k in range(1, most + 1) if k == 1 or comb(n - self.loose[n] + k, k) <= MOST_KEYS)


def _chosen(shares: Sequence[float], k: int) -> float:
    """Sum over all choices of k of the shares of their product."""
    sums = [1.0] + [0.0] * k
    for x in shares:
        for i in range(k, 0, -1):
            sums[i] += x * sums[i - 1]
    return sums[k]


def _near(sets: DataFrame, near: Callable[[int, int, int], bool]) -> DataFrame:
    """lo, hi and shared of all pairs of sets (``_ranked``) for whose shared tokens and sizes, the smaller first, ``near`` holds, exact.

    Sets meet by the keys of ``_Keys`` and a pair comes out at the key of its first common tokens only, so candidates are
    compared where they meet and never written. Of many keys a slice is shuffled at a time.
    """
    spark = sets.sparkSession
    total = sets.count()
    seen = sets.select("size", F.posexplode("rows").alias("pos", "n")).where("pos < 64").groupBy("size", "pos").agg(F.count("*").alias("sets"), F.avg("n").alias("n")).orderBy("pos").collect()  # at most 64 rows a size
    shares: dict[int, list[float]] = {}
    for r in seen:
        shares.setdefault(r["size"], []).append(r["n"] / total)
    keys = _Keys({r["size"]: r["sets"] for r in seen if r["pos"] == 0}, shares, near)
    if not keys.levels:
        return sets.select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit(0).alias("shared")).limit(0)
    chosen = [(z, side, k, p, [list(c) for c in combinations(range(p), k)] if k > 1 else []) for (z, side, k), p in sorted(keys.choices.items())]
    table = F.broadcast(spark.createDataFrame(chosen, "size int, side int, k int, prefix int, places array<array<int>>"))
    levels = F.broadcast(spark.createDataFrame([(s, n, k, o) for (s, n), (k, o) in keys.levels.items()], "na int, nb int, level int, least int"))
    one = F.transform(F.slice("tokens", F.lit(1), F.col("prefix")), lambda t: F.xxhash64(F.array(t)))
    several = F.transform("places", lambda c: F.xxhash64(F.transform(c, lambda i: F.get("tokens", i))))
    keyed = sets.join(table, "size").select("id", "tokens", "side", "k", F.explode(F.array_distinct(F.when(F.col("k") == 1, one).otherwise(several))).alias("key"))
    if sum(keys.counts[z] * comb(p, k) for (z, _, k), p in keys.choices.items()) <= SLICE:
        return _met(keyed, levels)
    parts = [written(_met(keyed.where(F.pmod("key", F.lit(SLICES)) == i), levels), "met") for i in range(SLICES)]
    return reduce(DataFrame.unionByName, parts)


def _met(keyed: DataFrame, levels: DataFrame) -> DataFrame:
    """The pairs of ``_near`` whose first common tokens are one of the keys."""
    a = keyed.where("side = 0").select("key", F.col("k").alias("level"), F.col("id").alias("a"), F.col("tokens").alias("ta"))
    b = keyed.where("side = 1").select("key", F.col("id").alias("b"), F.col("tokens").alias("tb"))
    na, nb = F.size("ta"), F.size("tb")
    met = a.join(b, "key").where((na < nb) | ((na == nb) & (F.col("a") < F.col("b"))))
    met = met.select("key", "level", "a", "b", na.alias("na"), nb.alias("nb"), F.array_intersect("ta", "tb").alias("common"))
    met = met.join(levels, ["na", "nb", "level"]).where((F.size("common") >= F.col("least")) & (F.xxhash64(F.slice("common", F.lit(1), F.col("level"))) == F.col("key")))
    return met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.size("common").alias("shared"))


def overlap_pairs(df: DataFrame, key: str, signature: str, overlap: float, least: int) -> DataFrame:
    """lo, hi and shared of sets that share at least ``least`` tokens and ``overlap`` of the smaller set, exact."""
    return _near(_ranked(df, key, signature), lambda shared, small, large: shared >= least and shared >= overlap * small)


def same_issue_pairs(df: DataFrame, key: str, signature: str, jaccard: float, overlap: float, least: int) -> DataFrame:
    """lo, hi and shared of titles of one issue: near by Jaccard, or with most tokens of the shorter one and at least ``least``."""
    return _near(_ranked(df, key, signature), lambda shared, small, large: shared >= jaccard * (small + large - shared) or (shared >= least and shared >= overlap * small))


def representatives(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The smallest key of each combination of columns, as id: equal rows collapsed by partial aggregation."""
    return df.groupBy(*columns).agg(F.min(key).alias("id"))


def members(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every row's key with its representative's, as id."""
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(key), *own)
    reps = representatives(rows, key, [f"_c{i}" for i in range(len(columns))])
    return rows.join(reps, [f"_c{i}" for i in range(len(columns))]).select(key, "id")


def token_leaders(df: DataFrame, key: str, signature: str, jaccard: float, overlap: float | None = None, least: int = 4) -> DataFrame:
    """id and leader of greedy clustering in key order by Jaccard similarity, with ``overlap`` also by the share of the
    smaller set (``same_issue_pairs``); rows without tokens lead themselves.

    Rows with equal token sets are collapsed to their first, which changes no leader: a copy is near to whatever its
    first is near to.
    """
    marked = written(df.select(F.col(key).alias("_key"), F.array_sort(signature).alias("_sig")), "signed")
    full = marked.where(F.size("_sig") > 0)
    reps = written(representatives(full, "_key", ["_sig"]), "reps")
    near = prefix_pairs(reps, "id", "_sig", jaccard) if overlap is None else same_issue_pairs(reps, "id", "_sig", jaccard, overlap, least)
    led = leaders(reps.select("id"), near)
    members = full.join(reps, "_sig").join(led, "id").select(F.col("_key").alias("id"), "leader")
    return members.unionByName(marked.where(F.coalesce(F.size("_sig"), F.lit(0)) <= 0).select(F.col("_key").alias("id"), F.col("_key").alias("leader")))


def prefix_pairs(df: DataFrame, key: str, signature: str, jaccard: float) -> DataFrame:
    """lo, hi and shared of pairs with Jaccard at least ``jaccard``, exact, by keys of the rarest tokens."""
    return _near(_ranked(df, key, signature), lambda shared, small, large: shared >= jaccard * (small + large - shared))


def duplicate_rows(df: DataFrame, leader: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """leader, key and fields of every follower, one row each: the flat form, for clusters of any size."""
    rows = df.join(leader.select(F.col("id").alias("_i"), F.col("leader").alias("_lead")), F.col(key) == F.col("_i")).drop("_i")
    return rows.where(F.col(key) != F.col("_lead")).select(F.col("_lead").alias("leader"), key, *fields)


def merge_duplicates(df: DataFrame, leader: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of the leaders with ``dupes``: their followers as structs in order, null where there are none.

    A row holds its whole cluster; where clusters may outgrow a row take ``duplicate_rows``.
    """
    rows = df.join(leader.select(F.col("id").alias("_i"), F.col("leader").alias("_lead")), F.col(key) == F.col("_i")).drop("_i")
    follow = rows.where(F.col(key) != F.col("_lead")).groupBy(F.col("_lead").alias("_l")).agg(F.array_sort(F.collect_list(F.struct(key, *fields))).alias("dupes"))
    return rows.where(F.col(key) == F.col("_lead")).join(follow, F.col("_lead") == F.col("_l"), "left").drop("_l", "_lead")
