"""Graphs as edge lists: closure, degrees, components, neighbourhood similarity, ranking, communities, null models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideloom.session import materialise


def undirected(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Neighbour pairs (a, b) in both directions: duplicates collapse, a self-loop stays once."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def known_ends(edges: DataFrame, nodes: DataFrame, src: str, dst: str, key: str) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(key).alias("_k")).distinct()
    return edges.join(ids, F.col(src) == F.col("_k"), "left_semi").join(ids, F.col(dst) == F.col("_k"), "left_semi")


def degrees(pairs: DataFrame, nodes: DataFrame, key: str, group: str) -> DataFrame:
    """Degree of every node, isolated ones included, and its ratio to the mean of its group."""
    deg = pairs.groupBy(F.col("a").alias(key)).agg(F.count("*").alias("degree"))
    out = nodes.select(key, group).distinct().join(deg, key, "left").fillna(0, ["degree"])
    mean = out.groupBy(group).agg(F.avg("degree").alias("_mean"))  # a row a group: no task holds a group
    out = out.join(mean, group)
    return out.withColumn("relative", F.round(F.when(F.col("_mean") > 0, F.col("degree") / F.col("_mean")).otherwise(0.0), 4)).select(key, group, "degree", "relative")


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the least node id reachable. Labels move along edges and, by pointer jumping, along labels, so the
    number of rounds grows with the logarithm of the diameter; they end when no label moves. Each round is written to the shared folder."""
    pairs = materialise(pairs, "pairs")
    state = materialise(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("c")), "labels")
    moved, written = True, state
    while moved:
        seen = pairs.join(state, pairs.b == state.node).groupBy("a").agg(F.min("c").alias("m"))
        hop = state.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        nxt = state.join(seen, state.node == seen.a, "left").join(hop, "c", "left").select("node", F.least("c", F.coalesce("m", "c"), F.coalesce("cc", "c")).alias("n"), F.col("c").alias("old"))
        nxt = written = materialise(nxt, "labels", instead_of=written)
        moved = not nxt.where("n <> old").isEmpty()
        state = nxt.select("node", F.col("n").alias("c"))
    return state.withColumnRenamed("c", "component")


#: A feature of more nodes than LISTED is compared in blocks of at most SLICE sets a side; nodes of one set in a row; pairs in a batch.
LISTED, SLICE, HELD, BATCH = 64, 2048, 1024, 1 << 19


def _alike(t: pa.Table, threshold: float, apart: list[str]) -> Iterator[pa.RecordBatch]:
    """(a, b, jaccard) of the nodes in a block pair whose sets agree by the threshold, which differ in all columns `apart`, and have the block's feature
    as their first in common: what a set holds before it counts so low that no such pair passes. Sides: 0 and 1, or 0 alone for a block with itself."""
    side, at = t["side"].to_numpy(), t["at"].to_numpy()
    s, held = t["s"].combine_chunks(), t["held"].combine_chunks()
    lengths, size = pc.list_value_length(s).to_numpy(), pc.list_value_length(held).to_numpy().astype(np.int64)
    code = s.flatten().dictionary_encode().indices.to_numpy()
    nodes, first = held.flatten(), np.cumsum(size) - size
    key, kinds = nodes.field("key"), [nodes.field(c).dictionary_encode().indices.to_numpy() for c in apart]
    row = np.repeat(np.arange(len(t)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    worth = np.where(place < at[row], -(2.0**20), 1.0).astype(np.float32)
    l = np.flatnonzero(side == 0)  # noqa: E741
    r = np.flatnonzero(side == 1) if side.any() else l
    slot = np.full(len(t), -1)
    slot[r] = np.arange(len(r))
    for start in range(0, len(l), 256):
        part = l[start : start + 256]
        line = np.full(len(t), -1)
        line[part] = np.arange(len(part))
        both = np.zeros((len(part), len(r)), np.float32)
        for c in range(0, int(code.max()) + 1, 2048):
            near = (code >= c) & (code < c + 2048)
            width = min(2048, int(code.max()) + 1 - c)
            p, q = np.zeros((len(part), width), np.float32), np.zeros((len(r), width), np.float32)
            mine, theirs = near & (line[row] >= 0), near & (slot[row] >= 0)
            p[line[row[mine]], code[mine] - c] = worth[mine]
            q[slot[row[theirs]], code[theirs] - c] = 1
            both += p @ q.T
        i, j = np.nonzero(both >= threshold / (1 + threshold) * (lengths[part][:, None] + lengths[r][None, :]) * (1 - 1e-6))
        shared = both[i, j].astype(np.float64)
        i, j = part[i], r[j]
        jaccard = shared / (lengths[i] + lengths[j] - shared)
        ok = jaccard >= threshold
        if not side.any():
            ok &= i <= j
        i, j, jaccard = i[ok], j[ok], jaccard[ok]
        many = size[i] * size[j]
        ends = np.cumsum(many)
        at_ = 0
        while at_ < len(i):  # all nodes of the one set with all of the other
            before = ends[at_] - many[at_]
            to = max(at_ + 1, int(np.searchsorted(ends, before + BATCH, "right")))
            k = np.repeat(np.arange(at_, to), many[at_:to])
            o = np.arange(len(k)) + before - (ends - many)[k]
            x, y = first[i[k]] + o // size[j[k]], first[j[k]] + o % size[j[k]]
            ok = (i[k] != j[k]) | (x < y)
            for kind in kinds:
                ok &= kind[x] != kind[y]
            a, b = key.take(pa.array(x[ok])), key.take(pa.array(y[ok]))
            found = pa.RecordBatch.from_arrays([pc.if_else(pc.less(a, b), a, b), pc.if_else(pc.less(a, b), b, a), pa.array(jaccard[k[ok]])], ["a", "b", "jaccard"])
            yield found.filter(pc.not_equal(a, b))
            at_ = to


def shared_neighbours(members: DataFrame, key: str, feature: str, group: str, least: int, threshold: float, apart: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of nodes of different groups whose feature sets (of at least `least` elements) have a Jaccard of `threshold` or more.
    Other columns of the nodes named in `apart` must differ as well.

    Prefix filtering: sets are ordered by rarity, and pairs with Jaccard t share an element among the first n - ceil(t n) + 1
    of both, so common features create no candidates. The first element two sets share lies in both prefixes, and only there the
    pair counts, so no pair comes twice. Features of few nodes are joined; those of many are compared in blocks, all pairs of a
    block at once, and only pairs that pass leave it. Nodes of equal sets share a row, so a set is moved and compared once, however many have it.
    """
    kinds = [group, *apart]
    m = members.select(F.col(key).alias("key"), F.col(feature).alias("f"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kinds)]).dropna().distinct()
    names = [f"k{i}" for i in range(len(kinds))]
    df = m.groupBy("f").agg(F.count("*").alias("df"))
    sets = m.join(df, "f").groupBy("key", *names).agg(F.sort_array(F.collect_list(F.struct("df", "f"))).alias("s")).where(F.size("s") >= least)
    sets = materialise(sets.select("key", *names, F.transform("s", lambda x: x["f"]).alias("s")), "sets", tidy=True)
    large = sets.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("s", F.ceil(F.col("n") / HELD).alias("parts"))
    part = F.pmod(F.xxhash64("key", *names), F.coalesce("parts", F.lit(1))).alias("part")
    rows = sets.join(large, "s", "left").groupBy("s", part).agg(F.sort_array(F.collect_list(F.struct(*names, "key"))).alias("held"))
    prefix = materialise(rows.select("*", F.posexplode(F.slice("s", F.lit(1), (F.size("s") - F.ceil(F.size("s") * threshold) + 1).cast("int"))).alias("at", "f")), "prefixes", instead_of=sets, tidy=True)
    sizes = prefix.groupBy("f").agg(F.sum(F.size("held")).alias("n"), F.count("*").alias("rows")).where("n > 1")
    few = prefix.join(sizes.where(F.col("n") <= LISTED).select("f"), "f", "left_semi").select("f", "s", F.inline("held"))
    a, b = few.select("f", *[F.col(c).alias(f"a_{c}") for c in ("key", *names, "s")]), few.select("f", *[F.col(c).alias(f"b_{c}") for c in ("key", *names, "s")])
    pairs = a.join(b, "f").where(" AND ".join(["a_key < b_key", *[f"a_{c} <> b_{c}" for c in names]]))
    shared = F.array_intersect("a_s", "b_s")
    n = F.size(shared)
    pairs = pairs.where(F.get(shared, F.lit(0)) == F.col("f")).select(F.col("a_key").alias("a"), F.col("b_key").alias("b"), (n / (F.size("a_s") + F.size("b_s") - n)).alias("jaccard"))
    many = prefix.join(sizes.where(F.col("n") > LISTED).select("f", F.ceil(F.col("rows") / SLICE).alias("blocks")), "f")
    many = many.withColumn("own", F.pmod(F.xxhash64("s", "part"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select("f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "s", "at", "held")
    kind = members.schema[key].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _alike(pa.Table.from_batches(list(batches)), threshold, names)

    met = many.groupBy("f", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}, jaccard double")
    return pairs.where(F.col("jaccard") >= threshold).unionByName(met)


def pagerank(pairs: DataFrame, seeds: DataFrame | None = None, group: Column | None = None, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(node[, anchor], rank) by power iteration until a round moves the ranks of a graph by less than tolerance times its nodes.

    group, an expression of node, tells independent graphs apart, each of which has the sum 1. seeds(node, anchor) give one personalised
    rank per anchor; an anchor without a seed in a graph has no rows there. Mass of nodes without links goes to the restart
    vector. Ranks that don't settle within `rounds` are an error.
    """
    group = F.lit(0).cast("long") if group is None else group
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().withColumn("g", group)
    anchors = seeds.select("node", "anchor").distinct().withColumn("p", F.lit(1.0)) if seeds is not None else nodes.select("node", F.lit("").alias("anchor"), F.lit(1.0).alias("p"))
    placed = nodes.join(anchors, "node")
    total = placed.groupBy("g", "anchor").agg(F.sum("p").alias("s"))
    n = nodes.groupBy("g").agg(F.count("*").alias("size"))
    own = placed.join(total, ["g", "anchor"]).select("node", "anchor", (F.col("p") / F.col("s")).alias("p"))
    base = nodes.join(total.select("g", "anchor"), "g").join(n, "g").join(own, ["node", "anchor"], "left").fillna(0.0, ["p"])
    base = materialise(base.select("node", "g", "anchor", "size", "p"), "restart")
    links = materialise(pairs.join(pairs.groupBy("a").agg(F.count("*").alias("out")), "a"), "links")
    state, written = base.withColumn("r", F.lit(1.0) / F.col("size")), None
    for _ in range(rounds):
        flow = links.join(state.select(F.col("node").alias("a"), "anchor", "r"), "a").groupBy(F.col("b").alias("node"), "anchor").agg((alpha * F.sum(F.col("r") / F.col("out"))).alias("f"))
        new = state.join(flow, ["node", "anchor"], "left").fillna(0.0, ["f"])
        kept = new.groupBy("g", "anchor").agg(F.sum("f").alias("kept"))  # a row a graph and anchor
        moved = new.join(kept, ["g", "anchor"]).withColumn("n", F.col("f") + (1 - F.col("kept")) * F.col("p"))
        state = written = materialise(moved.select("node", "g", "anchor", "size", "p", F.col("n").alias("r"), F.abs(F.col("n") - F.col("r")).alias("moved")), "rank", instead_of=written)
        off = state.groupBy("g", "anchor").agg((F.sum("moved") / F.first("size")).alias("off")).agg(F.max("off")).first()[0]
        state = state.drop("moved")
        if off is None or off < tolerance:
            return state.select("node", *(["anchor"] if seeds is not None else []), F.col("r").alias("rank"))
    raise RuntimeError(f"ranks still move by {off} a node after {rounds} rounds")


def strongest_anchor(nodes: DataFrame, ranks: DataFrame, order: list[str], other: str = "Other") -> DataFrame:
    """(node, anchor): the anchor with the greatest rank, the earlier in `order` on ties; `other` for nodes that none reaches."""
    place = F.create_map(*[F.lit(x) for i, name in enumerate(order) for x in (name, i)])
    best = ranks.where("rank > 0").groupBy("node").agg(F.max_by("anchor", F.struct("rank", -F.try_element_at(place, F.col("anchor")))).alias("anchor"))
    return nodes.select("node").distinct().join(best, "node", "left").fillna(other, ["anchor"])


def label_communities(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, community) by label propagation: a node takes the most frequent label around it, keeps its own if that is among them,
    else the smallest. The halves of the nodes, by a new hash each round, take turns, so that labels don't swing; they end when
    neither half moves. Labels that don't settle within `rounds` are an error."""
    pairs = materialise(pairs.where("a <> b"), "pairs")
    state = written = materialise(pairs.select(F.col("a").alias("node"), F.col("a").alias("l")).distinct(), "labels")
    for k in range(rounds):
        votes = pairs.join(state, pairs.b == state.node).groupBy("a", "l").agg(F.count("*").alias("n"))
        voted = votes.withColumnRenamed("a", "node").join(state.withColumnRenamed("l", "own"), "node")
        best = voted.groupBy("node").agg(F.max_by("l", F.struct("n", (F.col("l") == F.col("own")).cast("int").alias("same"), (-F.col("l")).alias("least"))).alias("best"), F.first("own").alias("own"))
        turn = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        nxt = written = materialise(best.select("node", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("l"), (F.col("best") != F.col("own")).alias("moves")), "labels", instead_of=written)
        still = nxt.where("moves").isEmpty()
        state = nxt.select("node", "l")
        if still:
            return state.withColumnRenamed("l", "community")
    raise RuntimeError(f"labels still move after {rounds} rounds")


def reach(pairs: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of nodes within `depth` steps: the frontier is joined with the edges and thinned by an anti-join."""
    seen = materialise(start.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    for k in range(1, depth + 1):
        front = seen.where(F.col("depth") == k - 1).select(F.col("node").alias("a"))
        new = pairs.join(front, "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = materialise(seen.unionByName(new.withColumn("depth", F.lit(k))), "seen", instead_of=seen)
    return seen


def support_density(members: DataFrame, core: DataFrame, key: str, feature: str, s_min: int, d_min: float) -> DataFrame:
    """Per feature: members, members in the core, their share, and whether both reach their least values."""
    flag = core.select(key).distinct().withColumn("core", F.lit(1))
    g = members.select(key, feature).distinct().join(flag, key, "left").groupBy(feature).agg(F.count("*").alias("n_members"), F.sum(F.coalesce("core", F.lit(0))).alias("support"))
    density = F.when(F.col("n_members") > 0, F.col("support") / F.col("n_members")).otherwise(0.0)
    return g.withColumn("density", F.round(density, 4)).withColumn("is_indicator", (F.col("support") >= s_min) & (density >= d_min))


def lift(members: DataFrame, core: DataFrame, key: str, feature: str, group: str, least: int) -> DataFrame:
    """Per group and feature: share of core members among its holders over the share among all members of the group."""
    flag = core.select(key).distinct().withColumn("core", F.lit(1))
    rows = members.select(group, key, feature).distinct().join(flag, key, "left").withColumn("core", F.coalesce("core", F.lit(0)))
    base = rows.select(group, key, "core").distinct().groupBy(group).agg(F.avg("core").alias("base"))
    g = rows.groupBy(group, feature).agg(F.count("*").alias("has"), F.sum("core").alias("has_core")).where(F.col("has") >= least)
    p = F.col("has_core") / F.col("has")
    return g.join(base, group).select(group, feature, "has", "has_core", F.round(F.when(F.col("base") > 0, p / F.col("base")).otherwise(0.0), 4).alias("lift"))


def best_features(lifts: DataFrame, group: str, feature: str, k: int) -> DataFrame:
    """The k features of each group with the greatest lift, then support, then the smaller name."""
    w = Window.partitionBy(group).orderBy(F.desc("lift"), F.desc("has"), feature)
    return lifts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def likely_misses(members: DataFrame, core: DataFrame, top: DataFrame, key: str, feature: str, group: str, least: int = 2) -> DataFrame:
    """(group, key, n): members outside the core that hold at least `least` of the best features of their group."""
    held = members.select(group, key, feature).distinct().join(top.select(group, feature), [group, feature], "left_semi")
    return held.join(core.select(key).distinct(), key, "left_anti").groupBy(group, key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def style_shares(nodes: DataFrame, clusters: DataFrame, style: Column, site: str, main: str) -> DataFrame:
    """Per site: pages and those in a cluster that holds a style page of the main site; for the main site also its style pages and
    how many of them are in no cluster of another site. nodes(node, site, ...), clusters(node, component)."""
    n = nodes.join(clusters, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = n.groupBy("component").agg(F.max((style & (F.col(site) == main)).cast("int")).alias("styled"), F.count_distinct(site).alias("n_sites"))
    n = n.join(per, "component")
    own = style & (F.col(site) == main)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return n.groupBy(site).agg(F.count("*").alias("n_pages"), count(F.col("styled") == 1).alias("n_styled"), count(own).alias("n_style"), count(own & (F.col("n_sites") == 1)).alias("n_only_here"))


def cluster_fingerprints(pairs: DataFrame, clusters: DataFrame, nodes: DataFrame, site: str) -> DataFrame:
    """(node, site, component, f): the clusters of at least two sites in which the neighbours of a node lie."""
    c = nodes.join(clusters, "node", "left").select("node", site, F.coalesce("component", "node").alias("component"))
    wide = c.groupBy("component").agg(F.count_distinct(site).alias("n")).where("n >= 2").select(F.col("component").alias("f"))
    near = pairs.join(c.select(F.col("node").alias("b"), F.col("component").alias("f")), "b").join(wide, "f", "left_semi").select(F.col("a").alias("node"), "f").distinct()
    return near.join(c, "node")


def hidden_equivalents(prints: DataFrame, site: str, least: int = 6, threshold: float = 0.45) -> DataFrame:
    """(a, b, jaccard) of nodes of different sites and clusters whose fingerprints agree by the threshold."""
    return shared_neighbours(prints, "node", "f", site, least, threshold, ("component",))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers well mixed (a published finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Chances of at most 0, 1, ... events of a Poisson law of mean 1.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), initial=1.0) for k in range(20)])


def bootstrap_mean(df: DataFrame, value: str, key: str, reps: int, seed: int = 12345) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: each row draws its weight in each replicate from its key, so the
    result doesn't depend on the layout and no replicate is ever assembled; partial sums per replicate are all that is shuffled.
    Rows without a value are left out; keys should be unique."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(F.lit(seed), key).alias("k"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w = np.zeros(reps), np.zeros(reps)
        with np.errstate(over="ignore"):
            steps = np.arange(1, reps + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for b in batches:
                v, k = b["v"].to_numpy(), b["k"].to_numpy().astype(np.uint64)
                for at in range(0, len(v), 2048):
                    draw = _mixed(k[at : at + 2048, None] + steps[None, :]) / 2.0**64
                    n = np.searchsorted(_POISSON, draw, "right")
                    s += v[at : at + 2048] @ n
                    w += n.sum(0)
        yield pd.DataFrame({"rep": np.arange(reps), "s": s, "w": w})

    reps_ = rows.mapInPandas(each, "rep int, s double, w double").groupBy("rep").agg((F.sum("s") / F.sum("w")).alias("m"))
    return reps_.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg("m").alias("mean"))


def permutation_test(df: DataFrame, group: str, value: str, flag: str, key: str, reps: int, seed: int = 12345) -> DataFrame:
    """p = (1 + replicates with at least the observed flagged mean) / (reps + 1): in each replicate as many values of a group are drawn
    without return as are flagged in it.

    The draw is the smallest hashes of key and replicate. A group's bound of the hash is found among those near it: by the law of
    order statistics the bound of k of n lies within 12 deviations of k / n, so only that band is ranked, and what lies below is summed.
    """
    rows = df.select(group, F.col(value).cast("double").alias("v"), F.col(flag).alias("f"), F.xxhash64(F.lit(seed), key).alias("h")).dropna()
    rows = materialise(rows, "rows")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("f").cast("long")).alias("k"))
    share = F.col("k") / F.col("n")
    wide = 12 * F.sqrt(share * (1 - share) / F.col("n")) + 24 / F.col("n")
    per = per.where("k > 0").select(group, "k", F.greatest(share - wide, F.lit(0.0)).alias("lo"), F.least(share + wide, F.lit(1.0)).alias("hi"))
    drawn = rows.join(per, group).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("u", F.pmod(F.xxhash64("h", "rep"), F.lit(1 << 52)) / float(1 << 52)).where("u < hi")
    below = drawn.where("u < lo").groupBy(group, "rep").agg(F.count("*").alias("c"), F.sum("v").alias("s"))
    band = drawn.where("u >= lo").join(below.select(group, "rep", "c"), [group, "rep"], "left").withColumn("rank", F.row_number().over(Window.partitionBy(group, "rep").orderBy("u", "h")))
    rest = band.where("rank <= k - coalesce(c, 0)").groupBy("rep").agg(F.sum("v").alias("s"))
    sums = below.select("rep", "s").unionByName(rest).groupBy("rep").agg(F.sum("s").alias("s"))
    seen = rows.where("f").agg(F.sum("v").alias("observed_sum"), F.count("*").alias("k"))
    m = sums.crossJoin(F.broadcast(seen)).select((F.col("s") / F.col("k")).alias("m"), (F.col("observed_sum") / F.col("k")).alias("observed"))  # one row
    return m.groupBy("observed").agg(((F.lit(1) + F.sum((F.col("m") >= F.col("observed")).cast("int"))) / (reps + 1)).alias("p"), F.avg("m").alias("null_mean"))


def rewire(edges: DataFrame, group: str, src: str, dst: str, reps: int, seed: int = 12345, hubs: int | None = None) -> DataFrame:
    """Configuration-model replicas of each group's simple graph by double-edge swaps, 10 attempts an edge: (group, rep, a, b), a < b.
    With `hubs`, (group, rep, v) instead, v being how many nodes are the lesser end of at least so many edges: no replica leaves its task.

    Swapping is sequential inside a replica, so a task holds one group's edges; groups and replicas run in parallel.
    """
    e = edges.select(F.col(group).alias("g"), F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).dropna().where("a <> b").distinct()
    e = e.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(pdf["rep"].iloc[0]), len(pdf)])
        pdf = pdf.sort_values(["a", "b"])
        ends = list(zip(pdf["a"].tolist(), pdf["b"].tolist()))
        have = set(ends)
        for i, j, flip in zip(rng.integers(0, len(ends), 10 * len(ends)), rng.integers(0, len(ends), 10 * len(ends)), rng.random(10 * len(ends)) < 0.5):
            (a, b), (c, d) = ends[i], ends[j]
            if flip:
                c, d = d, c
            x, y = (min(a, d), max(a, d)), (min(c, b), max(c, b))
            if len({a, b, c, d}) < 4 or x in have or y in have:
                continue
            have -= {ends[i], ends[j]}
            have |= {x, y}
            ends[i], ends[j] = x, y
        if hubs is not None:
            return pd.DataFrame({"g": pdf["g"].iloc[:1], "rep": pdf["rep"].iloc[:1], "v": sum(k >= hubs for k in Counter(x for x, _ in ends).values())})
        return pd.DataFrame({"g": pdf["g"].iloc[0], "rep": pdf["rep"].iloc[0], "a": [x for x, _ in ends], "b": [y for _, y in ends]})

    return e.groupBy("g", "rep").applyInPandas(swap, f"g {e.schema['g'].dataType.simpleString()}, rep int, " + ("a bigint, b bigint" if hubs is None else "v bigint")).withColumnRenamed("g", group)
