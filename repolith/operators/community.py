"""Communities, betweenness and call flows: the graph operators that walk in rounds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.operators.lineage import count, cut, drop_cut, numbered


#: Edges of a graph that one task moves nodes in (some 100 bytes each); larger ones are made smaller first.
KERNEL_EDGES = 200_000


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, distinct, without loops."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """path, component (its least path). Each round takes the neighbours' least label, then that label's label."""
    u = undirected(edges)
    two = cut(u.union(u.select("b", "a")), "edges")
    labels = cut(two.groupBy(F.col("a").alias("path")).agg(F.least(F.col("path"), F.min("b")).alias("component")), "labels")
    while True:
        near = two.join(labels.select(F.col("path").alias("b"), "component"), "b").groupBy(F.col("a").alias("path")).agg(F.min("component").alias("near"))
        step = labels.join(near, "path").select("path", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("path").alias("component"), F.col("component").alias("further"))
        labels = cut(step.join(jump, "component", "left").select("path", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels", labels)
        if labels.where("component != old").isEmpty():
            return labels.select("path", "component")


def louvain_kernel(pairs: list[tuple[int, int, float]], total: float) -> dict[int, int]:
    """Greedy modularity by node moves and merging, nodes (numbers) in sorted order. pairs: a, b, weight; a pair of a node with itself is weight
    inside of it. total: the whole graph's edge weight."""
    names = sorted({x for p in pairs for x in p[:2]})
    member = {n: n for n in names}
    weight: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in pairs:
        weight[a][b] += w
        weight[b][a] += w
    while True:
        nodes = sorted(weight)
        group = {n: n for n in nodes}
        strength = {n: sum(weight[n].values()) for n in nodes}
        held = dict(strength)
        moved = changed = True
        any_move = False
        while changed:
            changed = False
            for n in nodes:
                own = group[n]
                held[own] -= strength[n]
                to: dict[str, float] = defaultdict(float)
                for m, w in weight[n].items():
                    if m != n:
                        to[group[m]] += w
                best, gain = own, to.get(own, 0.0) - held[own] * strength[n] / (2 * total)
                for g in sorted(to):
                    x = to[g] - held[g] * strength[n] / (2 * total)
                    if x > gain + 1e-12:
                        best, gain = g, x
                held[best] += strength[n]
                if best != own:
                    group[n] = best
                    changed = any_move = True
        moved = any_move
        if not moved:
            return member
        member = {n: group[g] for n, g in member.items()}
        merged: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for n in nodes:
            for m, w in weight[n].items():
                merged[group[n]][group[m]] += w
        weight = merged


#: Nodes of a range: a row of what moved() and betweenness() shuffle has what is known of a range's nodes, in arrays.
_NODES = 1 << 14
#: Ranges that the edges of one row lead to.
_TARGETS = 16
#: Bits of a node, one for each two rounds: which half of the nodes it is in.
_BITS = 31
_STATE = "part int, node binary, grp binary, k binary, bits binary, went long"
_TOLD = "part int, grp binary, held binary"
_MOVES = "part int, node binary, grp binary, k binary, held binary, bits binary"


def _joined(values: pd.Series, dtype: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, dtype) for v in values] or [np.zeros(0, dtype)])


def _by_range(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted numbers, and where they lie."""
    found, first = np.unique(numbers // _NODES, return_index=True)
    for r, i, j in zip(found, first, [*first[1:], len(numbers)], strict=True):
        yield int(r), slice(i, j)


def _asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a range's nodes add to the strength of their groups, a row for each range of these."""
    for pdf in frames:
        rows = []
        for part, grp, k in zip(pdf["part"], pdf["grp"], pdf["k"], strict=True):
            grps, at = np.unique(np.frombuffer(grp, np.int32), return_inverse=True)
            sums = np.bincount(at, np.frombuffer(k, np.int64), len(grps)).astype(np.int64)
            rows.extend((r, part, grps[x].tobytes(), sums[x].tobytes()) for r, x in _by_range(grps))
        yield pd.DataFrame(rows, columns=["gpart", "part", "grp", "k"])


def _told(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """The strength of the groups of a range, to each range of nodes that has some in them."""
    sums, low = np.zeros(_NODES, np.int64), int(key[0]) * _NODES
    for grp, k in zip(asked["grp"], asked["k"], strict=True):
        sums[np.frombuffer(grp, np.int32) - low] += np.frombuffer(k, np.int64)
    return pd.DataFrame({"part": asked["part"], "grp": asked["grp"], "held": [sums[np.frombuffer(g, np.int32) - low].tobytes() for g in asked["grp"]]})


def _summed_by(node: np.ndarray, grp: np.ndarray, weight: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weights of equal nodes and groups summed, in their order; held is that of the group."""
    keys, first, at = np.unique(node.astype(np.int64) << 32 | grp, return_index=True, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, at, weight)
    return node[first], grp[first], sums, held[first]


def _best(node: np.ndarray, grp: np.ndarray, to: np.ndarray, held: np.ndarray, k: np.ndarray, own: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the group of the most gain; of equal ones its own group, then the least. In whole numbers: 2 * total times the gain."""
    gain = to * (2 * total) - (held - np.where(grp == own, k, 0)) * k
    at = np.lexsort((grp, grp != own, -gain, node))
    first = at[np.flatnonzero(np.diff(node[at], prepend=-1))]
    return node[first], grp[first]


def _round(r: int, total: int) -> tuple[Callable, Callable]:
    """What a range hands to its neighbours in a round, and what it makes of what it gets."""

    def turn(bits: np.ndarray) -> np.ndarray:
        return (bits >> (r // 2 % _BITS)) & 1 == r % 2

    def sent(key: tuple, known: pd.DataFrame, to: pd.DataFrame) -> pd.DataFrame:
        mine, told, low = known[known["node"].notna()], known[known["node"].isna()], int(key[0]) * _NODES
        node, grp = _joined(mine["node"], np.int32), _joined(mine["grp"], np.int32)
        grps, held = _joined(told["grp"], np.int32), _joined(told["held"], np.int64)
        order = np.argsort(grps)
        held = held[order][np.searchsorted(grps[order], grp)]
        group_at, held_at = np.zeros(_NODES, np.int32), np.zeros(_NODES, np.int64)
        group_at[node - low], held_at[node - low] = grp, held
        rows = [(int(key[0]), node.tobytes(), grp.tobytes(), b"".join(mine["k"]), held.tobytes(), b"".join(mine["bits"]))]
        for place, dst, bits, w in zip(to["place"], to["dst"], to["bits"], to["w"], strict=True):
            now = turn(np.frombuffer(bits, np.int32))
            place, dst, w = np.frombuffer(place, np.int32)[now], np.frombuffer(dst, np.int32)[now], np.frombuffer(w, np.int64)[now]
            found = _summed_by(dst, group_at[place], w, held_at[place])
            rows.extend((part, *(c[x].tobytes() for c in found), None) for part, x in _by_range(found[0]))
        return pd.DataFrame(rows, columns=["part", "node", "grp", "k", "held", "bits"])

    def gone(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, got, low = pdf[pdf["bits"].notna()], pdf[pdf["bits"].isna()], int(key[0]) * _NODES
        node, grp, bits = (_joined(own[c], np.int32) for c in ("node", "grp", "bits"))
        k, held = _joined(own["k"], np.int64), _joined(own["held"], np.int64)
        now, new = turn(bits), np.zeros(_NODES, np.int32)
        group_at, k_at = np.zeros(_NODES, np.int32), np.zeros(_NODES, np.int64)
        group_at[node - low], k_at[node - low], new[node - low] = grp, k, grp
        # A node may stay where it is, also without a neighbour there.
        offers = [(node[now], grp[now], np.zeros(now.sum(), np.int64), held[now]), (_joined(got["node"], np.int32), _joined(got["grp"], np.int32), _joined(got["k"], np.int64), _joined(got["held"], np.int64))]
        to, group, weight, strong = _summed_by(*(np.concatenate(c) for c in zip(*offers, strict=True)))
        to, group = _best(to, group, weight, strong, k_at[to - low], group_at[to - low], total)
        new[to - low] = group
        new = new[node - low]
        return pd.DataFrame({"part": [int(key[0])], "node": [node.tobytes()], "grp": [new.tobytes()], "k": [k.tobytes()], "bits": [bits.tobytes()], "went": [int((new != grp).sum())]})

    return sent, gone


def moved(graph: DataFrame, total: int, rounds: int) -> DataFrame:
    """node, grp: nodes of a weighted graph (a, b, w; a and b structs of a number n and its bits, a.n <= b.n, a = b with the weight inside)
    after rounds in which half of them go to the neighbouring group that adds most to modularity. Which half changes from round to round,
    so that two nodes don't swap for ever; of equal groups the least counts.

    Nodes and groups lie in ranges. In a round each range asks those of its groups for their strength, hands group and strength to the
    neighbours whose turn it is, and gets theirs. All this moves in arrays, a row for each two ranges, so that Spark shuffles blocks and not edges.
    """
    both = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))
    ends = graph.select("w", F.explode(both).alias("e")).select("e.x", "e.y", "w")
    two = ends.where("x.n != y.n").select(F.floor(F.col("x.n") / _NODES).cast("int").alias("part"), F.floor(F.col("y.n") / (_NODES * _TARGETS)).cast("int").alias("target"), (F.col("x.n") % _NODES).alias("place"), F.col("y.n").alias("dst"), F.col("y.bits").alias("bits"), "w")

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dst", "place"])
        columns = {c: [pdf[c].to_numpy(t).tobytes()] for c, t in (("place", np.int32), ("dst", np.int32), ("bits", np.int32), ("w", np.int64))}
        return pd.DataFrame({"part": [int(key[0])], **columns})

    def begun(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy(np.int32).tobytes()
        return pd.DataFrame({"part": [int(key[0])], "node": [node], "grp": [node], "k": [pdf["k"].to_numpy(np.int64).tobytes()], "bits": [pdf["bits"].to_numpy(np.int32).tobytes()], "went": [0]})

    links = cut(two.groupBy("part", "target").applyInPandas(linked, "part int, place binary, dst binary, bits binary, w binary"), "links")
    strength = ends.groupBy(F.col("x.n").alias("node"), F.col("x.bits").alias("bits")).agg(F.sum("w").alias("k"))
    state, still = cut(strength.withColumn("part", F.floor(F.col("node") / _NODES).cast("int")).groupBy("part").applyInPandas(begun, _STATE), "labels"), 0
    for r in range(rounds):
        sent, gone = _round(r, total)
        told = state.mapInPandas(_asked, "gpart int, part int, grp binary, k binary").groupBy("gpart").applyInPandas(_told, _TOLD)
        known = state.select("part", "node", "grp", "k", "bits").unionByName(told, allowMissingColumns=True)
        moves = known.groupBy("part").cogroup(links.groupBy("part")).applyInPandas(sent, _MOVES)
        state = cut(moves.groupBy("part").applyInPandas(gone, _STATE), "labels", state)
        still = 0 if state.agg(F.sum("went")).first()[0] else still + 1
        if still == 2:
            break

    def plain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for node, grp in zip(pdf["node"], pdf["grp"], strict=True):
                yield pd.DataFrame({"node": np.frombuffer(node, np.int32), "grp": np.frombuffer(grp, np.int32)})

    groups = cut(state.mapInPandas(plain, "node int, grp int"), "groups", state)
    drop_cut(links)
    return groups


def communities(edges: DataFrame, kernel_edges: int = KERNEL_EDGES, rounds: int = 12, levels: int = 8) -> DataFrame:
    """path, community (its least path): each file in exactly one, by greedy modularity.

    A graph of more than kernel_edges edges is made smaller first: its nodes move in rounds, and groups become nodes with
    the edges' weights summed. What is left of at most that many edges, which are counted, goes to one task, whose kernel moves nodes one by one.
    Numbers in the order of paths stand for them until the end: a group's least number is its least path's.
    """
    u = cut(undirected(edges), "undirected")
    total = u.count()
    bits = reduce(Column.__add__, [F.pmod(F.xxhash64("path", F.lit(i)), F.lit(2)).cast("int") * (1 << i) for i in range(min((rounds + 1) // 2, _BITS))], F.lit(0))
    nodes = cut(numbered(u.select(F.explode(F.array("a", "b")).alias("path")).distinct(), [F.col("path")], "n").select("path", F.col("n").cast("int").alias("n"), bits.alias("bits")), "nodes")
    end = F.struct("n", "bits")
    a, b = nodes.select(F.col("path").alias("a"), end.alias("x")), nodes.select(F.col("path").alias("b"), end.alias("y"))
    graph = cut(u.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1).cast("long").alias("w")), "graph", u)
    member = nodes.select(F.col("n").alias("id"), F.col("n").alias("node"))
    # Both ways of an edge count, and a node's own weight once.
    size = lambda: graph.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)), F.lit(0))).first()[0]
    n_nodes = nodes.count()
    for _ in range(levels):
        if size() <= 2 * kernel_edges:
            break
        groups = moved(graph, total, rounds)
        before, n_nodes = n_nodes, groups.select("grp").distinct().count()
        member = cut(member.join(groups, "node").select("id", F.col("grp").alias("node")), "member", member)
        if n_nodes == before:
            drop_cut(groups)
            break
        to = groups.join(nodes.select("n", "bits").withColumnRenamed("n", "grp"), "grp").select("node", F.struct(F.col("grp").alias("n"), "bits").alias("to"))
        x = graph.select(F.col("a.n").alias("a"), F.col("b.n").alias("b"), "w").join(to.toDF("a", "ga"), "a").join(to.toDF("b", "gb"), "b")
        x = x.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("w").alias("w"))
        graph = cut(x, "graph", graph)
        drop_cut(groups)
    if size() <= 2 * kernel_edges:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            found = louvain_kernel(list(zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].astype(float).tolist(), strict=True)), float(total))
            return pd.DataFrame({"node": list(found), "grp": list(found.values())})

        last = graph.select(F.col("a.n").alias("a"), F.col("b.n").alias("b"), "w").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(kernel, "node int, grp int")
        member = cut(member.join(cut(last, "last"), "node").select("id", F.col("grp").alias("node")), "member", member)
    least = member.groupBy("node").agg(F.min("id").alias("least"))
    found = member.join(least, "node").select(F.col("id").alias("n"), "least").join(nodes.select("n", "path"), "n")
    return found.join(nodes.select(F.col("n").alias("least"), F.col("path").alias("community")), "least").select("path", "community")


def community_names(found: DataFrame) -> DataFrame:
    """community, name, size: the longest directory that all files share, or the least file's base name."""
    dirs = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    # The common prefix of all is that of the least and the greatest.
    x = found.groupBy("community").agg(F.min("path").alias("low"), F.min(F.array_join(dirs, "/")).alias("lo"), F.max(F.array_join(dirs, "/")).alias("hi"), count().alias("size"))
    lo, hi = F.split("lo", "/"), F.split("hi", "/")
    same = F.aggregate(F.zip_with(lo, hi, lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    name = F.array_join(F.slice(lo, 1, same), "/")
    return x.select("community", F.when(name != "", name).otherwise(F.element_at(F.split("low", "/"), -1)).alias("name"), "size")


def community_page(named: DataFrame, least: int = 2, offset: int = 0, limit: int = 50) -> DataFrame:
    return named.where(F.col("size") >= least).orderBy(F.desc("size"), "community").offset(offset).limit(min(limit, 200))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """q: one row. groups: path, community."""
    u = undirected(edges)
    x = u.join(groups.toDF("a", "ga"), "a").join(groups.toDF("b", "gb"), "b")
    m = u.agg(count().alias("m"))
    inner = x.where("ga = gb").agg(count().alias("inner"))
    deg = x.select(F.explode(F.array("ga", "gb")).alias("g")).groupBy("g").agg(count().alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inner.crossJoin(m).crossJoin(deg).select((F.col("inner") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("q"))


#: Sources of a group: what betweenness() holds as one row, in arrays, is what a group's searches know of a range.
_SOURCES = 1 << 6
_HELD = "part int, grp int, keys binary, sigma binary"
_SENT = "part int, grp int, keys binary, share binary"


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below _NODES * _SOURCES), in order, and the sums of their values, which are above 0."""
    if 8 * len(keys) > _NODES * _SOURCES:
        sums = np.bincount(keys, values, _NODES * _SOURCES)
        found = np.flatnonzero(sums)
        return found.astype(np.int32), sums[found]
    found, at = np.unique(keys, return_inverse=True)
    return found.astype(np.int32), np.bincount(at, values, len(found))


def _sent(key: tuple, held: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """What the nodes of a range hand to their neighbours, a row for each range of these: keys (a node's place and a source's), shares."""
    rows = []
    for keys, shares in zip(held["keys"], held["share"], strict=True):
        keys, shares = np.frombuffer(keys, np.int32), np.frombuffer(shares)
        first = np.searchsorted(keys, np.arange(_NODES + 1, dtype=np.int32) * np.int32(_SOURCES))
        for place, to in zip(links["place"], links["dst"], strict=True):
            place, to = np.frombuffer(place, np.int32), np.frombuffer(to, np.int32)
            busy = first[place + 1] > first[place]
            place, to = place[busy], to[busy]
            ranges = to // _NODES
            for dest in np.unique(ranges):
                mine = ranges == dest
                begin, n = first[place[mine]], first[place[mine] + 1] - first[place[mine]]
                at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
                k, v = _summed(np.repeat(to[mine] % _NODES, n) * _SOURCES + keys[at] % _SOURCES, shares[at])
                rows.append((int(dest), int(key[1]), k.tobytes(), v.tobytes()))
    return pd.DataFrame(rows, columns=["part", "grp", "keys", "share"])


def _total(sent: pd.DataFrame) -> np.ndarray:
    sums = np.zeros(_NODES * _SOURCES)
    for keys, shares in zip(sent["keys"], sent["share"], strict=True):
        sums[np.frombuffer(keys, np.int32)] += np.frombuffer(shares)
    return sums


def _next_level(key: tuple, sent: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
    """The nodes that a hop reaches for the first time, and the number of shortest ways to them."""
    sums = _total(sent)
    for keys in seen["keys"]:
        sums[np.frombuffer(keys, np.int32)] = 0
    keys = np.flatnonzero(sums)
    rows = [(*map(int, key), keys.astype(np.int32).tobytes(), sums[keys].tobytes())] if len(keys) else []
    return pd.DataFrame(rows, columns=["part", "grp", "keys", "sigma"])


def _level_before(key: tuple, sent: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """The level before with its dependencies: what its nodes got, times their numbers of ways."""
    sums, rows = _total(sent), []
    for keys, sigma in zip(before["keys"], before["sigma"], strict=True):
        rows.append((*map(int, key), keys, sigma, (sums[np.frombuffer(keys, np.int32)] * np.frombuffer(sigma)).tobytes()))
    return pd.DataFrame(rows, columns=["part", "grp", "keys", "sigma", "delta"])


def _shares(held: DataFrame) -> DataFrame:
    """part, grp, keys, share: what each node of a level hands to those before it, for each way."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        share = [((1 + np.frombuffer(d)) / np.frombuffer(s)).tobytes() for d, s in zip(pdf["delta"], pdf["sigma"], strict=True)]
        return pdf[["part", "grp", "keys"]].assign(share=share)

    return held.groupBy("part", "grp").applyInPandas(run, _SENT)


def _scores(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    sums = np.zeros(_NODES)
    for keys, delta in zip(pdf["keys"], pdf["delta"], strict=True):
        sums += np.bincount(np.frombuffer(keys, np.int32) // _SOURCES, np.frombuffer(delta), _NODES)
    at = np.flatnonzero(sums)
    return pd.DataFrame({"node": at + int(key[0]) * _NODES, "score": sums[at]})


def betweenness(edges: DataFrame, sources: int = 200, limit: int | None = 20) -> DataFrame:
    """path, score: Brandes' dependencies over the undirected graph, summed over the sources with the least hash of their path.

    All searches go on a hop at a time: a level holds each source's nodes at that distance and the number of shortest ways to
    them. A neighbour of a level is on it, on the one before or on the next, so that two levels tell which nodes are new. Back from the
    last level each node hands its dependency to those before it. Nodes lie in ranges and sources in groups: a row has what a group knows
    of a range, in arrays, and what nodes hand on moves in a row for each two ranges, so that Spark shuffles blocks and not single numbers.
    """
    by = ["part", "grp"]
    u = cut(undirected(edges), "undirected")
    # Numbers in place of paths: what the searches join and shuffle is small.
    nodes = cut(numbered(u.select(F.explode(F.array("a", "b")).alias("path")).distinct(), [F.col("path")], "node").withColumn("node", F.col("node").cast("int")), "nodes")
    a, b = nodes.toDF("a", "x"), nodes.toDF("b", "y")
    two = u.join(a, "a").join(b, "b").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
    two = two.select(F.floor(F.col("e.x") / _NODES).cast("int").alias("part"), F.floor(F.col("e.y") / (_NODES * _TARGETS)).cast("int").alias("target"), (F.col("e.x") % _NODES).alias("place"), F.col("e.y").alias("dst"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [int(key[0])], "place": [pdf["place"].to_numpy(np.int32).tobytes()], "dst": [pdf["dst"].to_numpy(np.int32).tobytes()]})

    groups = F.explode(F.sequence(F.lit(0), F.lit(max(sources - 1, 0) // _SOURCES)))
    links = cut(two.groupBy("part", "target").applyInPandas(packed, "part int, place binary, dst binary").select("part", groups.alias("grp"), "place", "dst"), "links", u)
    starts = nodes.orderBy(F.xxhash64("path"), "path").limit(sources)
    starts = starts.withColumn("source", F.row_number().over(Window.orderBy(F.xxhash64("path"), "path")) - 1)  # a row for each source
    starts = starts.select(F.floor(F.col("node") / _NODES).cast("int").alias("part"), F.floor(F.col("source") / _SOURCES).cast("int").alias("grp"), ((F.col("node") % _NODES) * _SOURCES + F.col("source") % _SOURCES).alias("key"))

    def begun(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(pdf["key"].to_numpy(np.int32))
        return pd.DataFrame({"part": [int(key[0])], "grp": [int(key[1])], "keys": [keys.tobytes()], "sigma": [np.ones(len(keys)).tobytes()]})

    def across(held: DataFrame):
        return held.groupBy(*by).cogroup(links.groupBy(*by)).applyInPandas(_sent, _SENT).groupBy(*by)

    levels = [cut(starts.groupBy(*by).applyInPandas(begun, _HELD), "level")]
    while True:
        seen = reduce(DataFrame.union, [x.select(*by, "keys") for x in levels[-2:]])
        near = cut(across(levels[-1].withColumnRenamed("sigma", "share")).cogroup(seen.groupBy(*by)).applyInPandas(_next_level, _HELD), "level")
        if near.isEmpty():
            break
        levels.append(near)
    back = f"{_HELD}, delta binary"
    delta, parts = levels[-1].groupBy(*by).applyInPandas(lambda pdf: pdf.assign(delta=[bytes(len(s)) for s in pdf["sigma"]]), back), []
    for before in reversed(levels[:-1]):
        parts.append(delta.select("part", "keys", "delta").groupBy("part").applyInPandas(_scores, "node long, score double"))
        delta = cut(across(_shares(delta)).cogroup(before.groupBy(*by)).applyInPandas(_level_before, back), "delta")
    if not parts:
        return nodes.limit(0).select("path", F.lit(0.0).alias("score"))
    out = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("score").alias("score")).join(nodes, "node").select("path", "score")
    return out.orderBy(F.desc("score"), "path").limit(limit) if limit else out


def _walk(start: tuple, known: dict[tuple, list[str]], depth: int, steps: int) -> tuple[list[tuple], list[tuple]]:
    """The steps of a flow as far as callees are known, and the places that were expanded without knowing theirs."""
    rows, missing = [], []
    seen: set[tuple] = set()
    stack = [(start, 0, ())]
    while stack and len(rows) < steps:
        at, d, path = stack.pop()
        again = at in seen
        rows.append((len(rows), d, *at, again, at in path))
        if not again and d < depth:
            seen.add(at)
            if at not in known:
                missing.append(at)
            # As many callees as there may be further steps; the first is on top.
            callees, way = known.get(at, []), (*path, at)
            stack.extend(((callees[i], callees[i + 1]), d + 1, way) for i in reversed(range(0, min(len(callees), 2 * (steps - len(rows))), 2)))
    return rows, missing


_STEP = pa.struct([("step", pa.int64()), ("depth", pa.int64()), ("file", pa.string()), ("symbol", pa.string()), ("revisit", pa.bool_()), ("is_cycle", pa.bool_())])
_STEPS = "array<struct<step:long,depth:long,file:string,symbol:string,revisit:boolean,is_cycle:boolean>>"
#: Flows that are walked at once: what they know is held in Python.
_FLOWS = 1000


def _strings(a: pa.Array) -> list[str | None]:
    """Few of many strings differ: each of them is decoded once."""
    coded = a.dictionary_encode()
    words = np.array([*coded.dictionary.to_pylist(), None], object)
    return words[coded.indices.fill_null(len(words) - 1).to_numpy(zero_copy_only=False)].tolist()


def flows(calls: DataFrame, entries: DataFrame, depth: int = 10, steps: int = 50) -> DataFrame:
    """entry_file, entry_symbol, step, depth, file, symbol, revisit, is_cycle: pre-order walks. calls: caller_file, caller_symbol, callee_symbol, callee_file.

    Callees of a caller go by symbol, then file. A place seen before in the flow
    is emitted as a revisit and not expanded; is_cycle tells whether it is on the
    path to itself. Flows walk in rounds: each goes as far as the callees that it
    knows lead, and asks for those of the places where it didn't know them, which a
    join with the call table brings. A flow has few steps, so that it needs few
    places, and of a place no more callees than steps. What a flow knows of a place is one list of strings, its file and symbol
    and those of its callees, and steps go out as columns: neither is made of a Row or dictionary each.
    """
    callee = Window.partitionBy("caller_file", "caller_symbol").orderBy("callee_symbol", "callee_file")
    table = calls.select("caller_file", "caller_symbol", "callee_symbol", "callee_file").distinct().withColumn("rk", F.row_number().over(callee)).where(F.col("rk") <= steps)
    one = F.struct("rk", F.array("callee_file", "callee_symbol").alias("at"))
    table = cut(table.groupBy("caller_file", "caller_symbol").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["at"])).alias("callees")), "callees")
    schema = f"entry_file string, entry_symbol string, known array<array<string>>, missing array<array<string>>, steps {_STEPS}"
    names, lists = [x.split()[0] for x in schema.split(", ")[:2]], pa.list_(pa.list_(pa.string()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, _FLOWS):
                batch = whole.slice(i, _FLOWS)
                known = batch.column(2).flatten()
                per_flow, per_place = batch.column(2).value_lengths().to_numpy(), known.value_lengths().to_numpy()
                words, ends_of = _strings(known.flatten()), np.cumsum(per_place).tolist()
                asked, flat, ends, at = [], [], [0], 0
                for file, symbol, n in zip(_strings(batch.column(0)), _strings(batch.column(1)), per_flow.tolist(), strict=True):
                    places = [words[(ends_of[k - 1] if k else 0) : ends_of[k]] for k in range(at, at + n)]
                    at += n
                    rows, missing = _walk((file, symbol), {(p[0], p[1]): p[2:] for p in places}, depth, steps)
                    asked.append(missing)
                    flat.extend([] if missing else rows)
                    ends.append(len(flat))
                open_ = np.array([bool(m) for m in asked])
                kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_flow * open_)]), pa.int32()), known.filter(pa.array(np.repeat(open_, per_flow))))
                columns = list(zip(*flat, strict=True)) or [()] * len(_STEP)
                taken = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STEP, strict=True)], fields=list(_STEP))
                arrays = [batch.column(0), batch.column(1), kept.cast(lists), pa.array(asked, lists), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "known", "missing", "steps"])

    now = entries.select(F.col("file").alias("entry_file"), F.col("symbol").alias("entry_symbol")).distinct().withColumn("known", F.array().cast("array<array<string>>"))
    done = []
    while True:
        walked = cut(now.mapInArrow(walk, schema), "flows")
        done.append(walked.where(F.size("missing") == 0).select(*names, "steps"))
        todo = walked.where(F.size("missing") > 0)
        if todo.isEmpty():
            break
        asked = todo.select(*names, F.explode("missing").alias("at"))
        on = (F.col("at")[0] == F.col("caller_file")) & (F.col("at")[1] == F.col("caller_symbol"))
        told = asked.join(table, on, "left").groupBy(*names).agg(F.collect_list(F.concat("at", F.coalesce("callees", F.array().cast("array<string>")))).alias("more"))
        now = todo.join(told, names).select(*names, F.concat("known", "more").alias("known"))
    return reduce(DataFrame.unionByName, done).select(*names, F.explode("steps").alias("x")).select(*names, "x.*")


def affected_flows(calls: DataFrame, symbols: DataFrame, changed: DataFrame, most: int | None = None, depth: int = 8, steps: int = 30) -> DataFrame:
    """Flows of the direct callers of symbols that the changed files define; of the symbol itself where it has none. most: how many flows, the first by file and symbol; all without it."""
    mine = symbols.join(changed.select("path"), "path", "left_semi").select(F.col("name").alias("callee_symbol"), "path").distinct()
    # Callers need no symbol's files, and a symbol's files no callers: the two aren't paired.
    callers = calls.join(mine.select("callee_symbol").distinct(), "callee_symbol", "left_semi").select(F.col("caller_file").alias("file"), F.col("caller_symbol").alias("symbol"))
    own = mine.join(calls.select("callee_symbol").distinct(), "callee_symbol", "left_anti").select(F.col("path").alias("file"), F.col("callee_symbol").alias("symbol"))
    entries = callers.union(own).distinct()
    return flows(calls, entries if most is None else entries.orderBy("file", "symbol").limit(most), depth, steps)
