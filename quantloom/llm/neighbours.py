"""Approximate nearest neighbours: an NN-descent graph by iterative joins, and greedy graph search.

Equal vectors form one node with a key of its own that knows its smallest ids, so a group of copies costs one
node, and an id that comes with several vectors is in several nodes. The graph is fitted on a documented sample
of the nodes, the leaders: all up to LEAST_LEADERS, then one of LEADER_ROWS, and about MOST_LEADERS at most. A few
small random-projection cells give first, mostly wrong neighbours. Each descent round then joins leaders
to their neighbours' neighbours: at every leader meet a draw of its neighbours and of those that
have it as one, and pairs of which one is new there (not yet compared in an earlier round) are scored;
better ones go back to their leaders, which keep the GRAPH_K best. A hub meets another draw of those
that point to it in each round. Rounds go on until one changes at most DELTA of the graph. Then the
neighbours of a sample are compared with those of a full scan; while fewer than RECALL of
them are right, the graph gets more neighbours a leader, newly drawn cells and further rounds.

Every node, leader or not, is then put into the graph by a greedy search, on the lists of the HOMES best leaders that
it finds. A query is searched in the graph likewise and goes through the lists of its best leaders; how many it
opens is chosen by a full scan for PROBES queries, such that they meet AIM of their neighbours, and grows
with the table where it must, to all leaders if need be. Queries and lists meet in one shuffle by leader, packed. The lists of
the first leaders tell which similarity the others must reach. Vectors travel as 16-bit residues from their leader, so
near copies are told apart. The best nodes found are scored in double precision on the original vectors and expanded
to ids. The results of a sample of queries are compared with those of a full scan as well; while fewer than
RECALL are right, all queries are searched again with half as many leaders more. Queries that still have fewer
results than there are candidates for are answered by a full scan, in blocks of SCANNED.

Defined results: vectors that are null, empty, zero, of a length other than the commonest, or that
hold null or non-finite components take no part, nor do rows with a null id; a query's own id is no
candidate; with fewer candidates than wanted, all found are returned; ties go to the smaller id; repeated
rows count once; an id with several vectors is one query and one candidate, whose score is the largest of
any pair of vectors; an empty table gives no rows; other columns are ignored. Every row is indexed.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm import words as W
from quantloom.llm.streams import as_binary, binaries, run_bounds, whole_runs
from quantloom.session import dropped, saved, ship

WANTED, QUERY_STEP = 5, 50
GRAPH_K, RETURNED = 48, 5
#: A round that changes a larger share of the neighbours is followed by another; PROBES nodes measure the graph's recall, and as many queries that of the search.
DELTA, RECALL, PROBES = 0.02, 0.92, 256
#: How far the similarity of two codes may lie from that of their vectors.
ROUNDING = 2e-4
#: Rows aimed at for each random-projection cell, the most compared at once, and how many times cells are drawn.
CELL_ROWS, CELL_MOST, CELL_TREES = 128, 1024, 2
BEAM, OPEN = 96, 32
#: Nodes a leader, the least and the most leaders that are drawn (as expected), and how many of them list a node.
LEADER_ROWS, LEAST_LEADERS, MOST_LEADERS, HOMES = 256, 1024, 2048, 3
#: Links of a leader that a search follows, leaders that every search begins with, and the beam by which nodes are listed.
LINKS, ENTRIES, INSERT_BEAM, INSERT_OPEN = 16, 512, 8, 4
#: Share of the probes' neighbours for which the beam is chosen, leaders whose lists are gone through first, nodes kept for the exact scores, queries a task of walks, and parts in which the other lists are gone through.
AIM, FIRST, KEPT, WALKED, PARTS = 0.94, 8, 16, 512, 3
SAMPLE_ROWS, SCANNED = 2000, 256
#: Rows of neighbours or members that a Python task works on at once, and of a list that queries are compared with.
AT_ONCE, TILE = 1 << 18, 4096
GRAPH = "node long, code binary, neighbours binary, sims binary, flags binary"
MERGED = f"{GRAPH}, fresh int"


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (floats or doubles), h1, h2 of the rows that take part; both zeros have one hash."""
    v = F.col(vector).cast("array<float>" if table.schema[vector].dataType.simpleString() == "array<float>" else "array<double>")
    # The largest is NaN where one is, and nulls are passed over.
    most, least = F.array_max(v), F.array_min(v)
    fine = ~F.isnan(most) & (most < float("inf")) & (least > float("-inf")) & ((most != 0) | (least != 0)) & ~F.exists(v, lambda x: x.isNull())
    rows = table.where(F.col(id_column).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_column).cast("long").alias("id"), v.alias("vector"))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("vector") == (size["size"] if size else 0)).withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square over- or underflows; cosines stay the same to the bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) else binaries(column, kind)[0]
    return values.reshape(len(column), -1)


def units(column: pa.Array) -> np.ndarray:
    v = _matrix(column, None).astype(np.float64)
    return unit(v / np.abs(v).max(axis=1, keepdims=True))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            code = units(b.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*b.columns, as_binary(code.ravel(), np.arange(len(b) + 1) * code.shape[1])], [*b.schema.names, "code"])


def nodes_of(rows: DataFrame, wanted: int) -> DataFrame:
    """node (a key of its own), h1, h2, vector, ids (the wanted + 1 smallest), code of each distinct vector; to be written before use, as keys come from the order of rows.

    The rank limit is applied before the shuffle too, so copies don't travel.
    """
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= wanted + 1)
    grouped = top.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_set("id")).alias("ids"))
    kind = dict(rows.dtypes)["vector"]
    return grouped.select(F.monotonically_increasing_id().alias("node"), "vector", "ids", "h1", "h2").mapInArrow(_encode, f"node long, vector {kind}, ids array<long>, h1 long, h2 long, code binary")


def _cells(planes: np.ndarray, middle: np.ndarray):
    """(cell, node, code) of every node in every tree; planes: tree, bit, dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1), np.float16).astype(np.float32)
            for t in range(len(planes)):
                cell = ((x @ planes[t].T > middle[t]) @ (1 << np.arange(planes.shape[1], dtype=np.int64))).astype(np.int64) + (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0), b.column(1)], ["cell", "node", "code"])

    return run


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def _cell_pairs(k: int, most: int):
    """Rows sorted by cell -> for each row its k best neighbours among at most `most` of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches, most):
            edge = run_bounds(b.column(0).to_numpy())
            node, x = b.column(1).to_numpy(), _matrix(b.column(2), np.float16).astype(np.float32)
            for i, j in zip(edge, edge[1:], strict=False):
                for a in range(i, j, most):
                    m = slice(a, min(j, a + most))
                    n = m.stop - a
                    if n < 2:
                        continue
                    s = x[m] @ x[m].T
                    np.fill_diagonal(s, -2)
                    at = _best(s, min(k, n - 1))
                    keep = np.take_along_axis(s, at, 1)
                    width = np.arange(n + 1) * at.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(node[m]), pa.nulls(n, pa.binary()), as_binary(node[m][at].ravel(), width), as_binary(keep.ravel(), width)], ["node", "code", "neighbours", "sims"]).append_column("flags", pa.nulls(n, pa.binary()))

    return run


def drawn(at: int, center: np.ndarray, member: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which (center, member) pairs the at-th round draws, each with the chance `share`."""
    h = W.mix(W.mix(center.view(np.uint64) + np.uint64((at + 1) * W.BASE % (1 << 64))) ^ member.view(np.uint64))
    return (h >> np.uint64(40)).astype(np.float64) < share * (1 << 24)


def _shares(flags: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """For each neighbour of rows with n ones: the share of its row's new, or old, neighbours that a draw of `most` takes."""
    owner = np.repeat(np.arange(len(n)), n)
    new = np.bincount(owner, flags, len(n))
    return most / np.maximum(np.where(flags > 0, new[owner], (n - new)[owner]), most)


def _merge(k: int, at: int):
    """Rows sorted by node -> one row a node with its code, its k best neighbours, which of them are still new after the at-th round, and how many its coded row lacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            key = b.column(0).to_numpy()
            counts = binaries(b.column(3), np.float32)[1]
            # In pieces of whole runs with a bounded number of neighbours.
            edge = run_bounds(key)
            total = np.concatenate(([0], np.cumsum(counts)))[edge]
            i = 0
            while i < len(edge) - 1:
                j = max(i + 1, int(np.searchsorted(total, total[i] + AT_ONCE, "right")) - 1)
                yield merged(b.slice(edge[i], edge[j] - edge[i]))
                i = j

    def merged(b: pa.RecordBatch) -> pa.RecordBatch:
        key = b.column(0).to_numpy()
        edge = run_bounds(key)
        nodes = len(edge) - 1
        which = np.repeat(np.arange(nodes), np.diff(edge))
        other, n = binaries(b.column(2), np.int64)
        sims, _ = binaries(b.column(3), np.float32)
        flags = np.ones(len(other), np.uint8)
        known = np.repeat(np.asarray(b.column(4).is_valid()), n)
        old, m = binaries(b.column(4), np.uint8)
        flags[known] = old & ~drawn(at, np.repeat(key, m), other[known], _shares(old, m, k // 2)) if at >= 0 else old
        owner = np.repeat(which, n)
        fine = (other != key[edge[owner]]) & (sims > -2) if len(owner) else np.zeros(0, bool)
        owner, other, sims, flags, known = (x[fine] for x in (owner, other, sims, flags, known))
        # Of a neighbour that comes twice, what is known of it counts.
        order = np.lexsort((-sims, ~known, other, owner))
        owner, other, sims, flags, known = (x[order] for x in (owner, other, sims, flags, known))
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
        owner, other, sims, flags, known = (x[first] for x in (owner, other, sims, flags, known))
        order = np.lexsort((other, -sims, owner))
        order = order[np.arange(len(order)) - np.searchsorted(owner, owner) < k]
        owner, other, sims, flags, known = (x[order] for x in (owner, other, sims, flags, known))
        fresh = np.bincount(owner[~known], minlength=nodes).astype(np.int32)
        bound = np.searchsorted(owner, np.arange(nodes + 1))
        return pa.RecordBatch.from_arrays([pa.array(key[edge[:-1]]), _codes(b, which, nodes), as_binary(other, bound), as_binary(sims, bound), as_binary(flags, bound), pa.array(fresh)], ["node", "code", "neighbours", "sims", "flags", "fresh"])

    return run


def _codes(b: pa.RecordBatch, which: np.ndarray, n: int) -> pa.Array:
    at = np.full(n, -1)
    valid = np.flatnonzero(np.asarray(b.column(1).is_valid()))
    at[which[valid]] = valid
    return b.column(1).take(pa.array(at, mask=at < 0))


def _edges(k: int, at: int):
    """(center, member, new, back) for the neighbours that the at-th round draws, in both directions; back: the member points to the center."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            other, n = binaries(b.column(1), np.int64)
            flags, _ = binaries(b.column(2), np.uint8)
            own = np.repeat(b.column(0).to_numpy(), n)
            chosen = drawn(at, own, other, _shares(flags, n, k // 2))
            own, other, new = own[chosen], other[chosen], flags[chosen] > 0
            for c, m, back in ((own, other, False), (other, own, True)):
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(m), pa.array(new), pa.array(np.full(len(c), back))], ["center", "member", "new", "back"])

    return run


def _with_least(k: int):
    """(member, code, least): the similarity that a new neighbour must exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims, n = binaries(b.column(2), np.float32)
            least = np.where(n >= k, sims[np.maximum(np.cumsum(n) - 1, 0)] if len(sims) else -2.0, -2.0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least)], ["member", "code", "least"])

    return run


def _local_join(k: int):
    """Rows (center, member, new, code, least) sorted by center -> better pairs for the members, of which one is new at the center."""

    def found(b: pa.RecordBatch, edge: np.ndarray) -> pa.RecordBatch | None:
        member, new, least = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
        x = _matrix(b.column(3), np.float16).astype(np.float32)
        owners, others, sims = [], [], []
        for i, j in zip(edge, edge[1:], strict=False):
            # New ones first; of a member that comes twice, the new row counts.
            order = i + np.lexsort((member[i:j], ~new[i:j]))
            _, once = np.unique(member[order], return_index=True)
            order = order[np.sort(once)]
            m, at_least, n_new = member[order], least[order], int(new[order].sum())
            if len(m) < 2 or not n_new:
                continue
            s = x[order[:n_new]] @ x[order].T
            s[np.arange(n_new), np.arange(n_new)] = -2
            for value, own, rest, low in ((s, m[:n_new], m, at_least[:n_new]), (s[:, n_new:].T, m[n_new:], m[:n_new], at_least[n_new:])):
                if value.size:
                    best = _best(value, min(k, value.shape[1]))
                    top = np.take_along_axis(value, best, 1)
                    row, col = np.nonzero(top > low[:, None])
                    owners.append(own[row])
                    others.append(rest[best[row, col]])
                    sims.append(top[row, col])
        if not owners:
            return None
        owner, other, sim = np.concatenate(owners), np.concatenate(others), np.concatenate(sims)
        order = np.lexsort((other, owner))
        owner, other, sim = owner[order], other[order], sim[order]
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
        owner, other, sim = owner[first], other[first], sim[first]
        edge = run_bounds(owner)
        none = pa.nulls(len(edge) - 1, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(owner[edge[:-1]]), none, as_binary(other, edge), as_binary(sim, edge), none], ["node", "code", "neighbours", "sims", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            out = found(b, run_bounds(b.column(0).to_numpy()))
            if out is not None:
                yield out

    return run


def _sorted_by(df: DataFrame, key: str, *more) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *more)


def _truth(ids: np.ndarray, codes: np.ndarray, wanted: int):
    """(node, code, weight) -> (node, sim): the wanted best similarities of each probe among the rows of a partition, each as often as it weighs, the probe's own once less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(ids), 0), np.float32)
        for b in batches:
            if not len(b):
                continue
            weight = np.minimum(b.column(2).to_numpy(), wanted + 1)
            s = codes @ _matrix(b.column(1), np.float16).astype(np.float32).T
            # Only what may be among the best goes on, with the probes' own.
            own, at = np.nonzero(ids[:, None] == b.column(0).to_numpy())
            may = (s > best.min(axis=1)[:, None]).any(axis=0) if best.shape[1] == wanted else np.ones(len(b), bool)
            may[at] = True
            place = np.cumsum(may) - 1
            weight = weight[may]
            s = np.repeat(s[:, may], weight, axis=1)
            first = np.cumsum(weight) - weight
            s[own, first[place[at]]] = -2
            if not s.shape[1]:
                continue
            best = np.concatenate([best, s], axis=1)
            best = np.take_along_axis(best, _best(best, wanted), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(best.ravel())], ["node", "sim"])

    return run


def _least(rows: DataFrame, probes: list, wanted: int) -> dict[int, float]:
    """By node of the probes (node, code): the similarity of the wanted-th best of rows (node, code, weight)."""
    probes = list({r["node"]: r for r in probes}.values())
    ids = np.array([r["node"] for r in probes])
    codes = np.stack([np.frombuffer(r["code"], np.float16) for r in probes]).astype(np.float32)
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim")))
    best = rows.mapInArrow(_truth(ids, codes, wanted), "node long, sim float").withColumn("rank", rank)
    return {r["node"]: r["sim"] for r in best.where(F.col("rank") == wanted).collect()}


def _drawn_few(rows: DataFrame, key: str, n: int, columns: list[str]) -> list:
    """About PROBES of the n rows, drawn by their key."""
    draw = F.pmod(F.xxhash64(F.lit("probe"), key), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < min(1.0, 2 * PROBES / max(n, 1))).select(*columns).orderBy(F.xxhash64(F.lit("probe"), key)).limit(PROBES).collect()


def recall_of(graph: DataFrame, n: int, wanted: int = WANTED) -> float:
    """The share of the wanted best neighbours that PROBES of the n nodes have in the graph; equally near ones count as right."""
    wanted = min(wanted, n - 1)
    probes = _drawn_few(graph, "node", n, ["node", "code", "sims"]) if wanted > 0 else []
    if not probes:
        return 1.0
    least = _least(graph.select("node", "code", F.lit(1).cast("long").alias("weight")), probes, wanted)
    return sum((np.frombuffer(r["sims"], np.float32)[:wanted] >= least[r["node"]] - 1e-5).sum() for r in probes) / (wanted * len(probes))


def recall_of_search(found: DataFrame, nodes: DataFrame, queries: DataFrame, wanted: int = WANTED) -> float:
    """The share of the wanted best candidates that found has for PROBES of the queries; equally near ones count as right."""
    probes = _drawn_few(queries.join(nodes.select("node", "code"), "node"), "id", queries.count(), ["id", "node", "code"])
    wanted = min(wanted, (nodes.agg(F.sum(F.size("ids"))).first()[0] or 0) - 1)
    if not probes or wanted < 1:
        return 1.0
    least = _least(nodes.select("node", "code", F.size("ids").cast("long").alias("weight")), probes, wanted)
    node_of = {r["id"]: r["node"] for r in probes}
    ids = found.sparkSession.createDataFrame([(i,) for i in node_of], "query_id long")
    scores: dict[int, list[float]] = {}
    for r in found.join(F.broadcast(ids), "query_id").select("query_id", "score").collect():
        scores.setdefault(r["query_id"], []).append(r["score"])
    return sum(min(wanted, sum(x >= least[node] - ROUNDING for x in scores.get(i, []))) for i, node in node_of.items()) / (wanted * len(node_of))


def _descended(graph: DataFrame, k: int, at: int) -> DataFrame:
    """The graph after a round of descent, the at-th; the given one is deleted."""
    edges = graph.select("node", "neighbours", "flags").mapInArrow(_edges(k, at), "center long, member long, new boolean, back boolean")
    rank = F.row_number().over(Window.partitionBy("center", "new").orderBy(F.xxhash64(F.lit(at), "center", "member")))
    back = edges.where("back").withColumn("rank", rank).where(F.col("rank") <= k // 2).select("center", "member", "new")
    edges = edges.where("NOT back").select("center", "member", "new").unionByName(back)
    codes = graph.select("node", "code", "sims").mapInArrow(_with_least(k), "member long, code binary, least float")
    met = edges.join(codes, "member").select("center", "member", "new", "code", "least")
    found = _sorted_by(met, "center").mapInArrow(_local_join(RETURNED), GRAPH)
    new = saved(_sorted_by(graph.drop("fresh").unionByName(found), "node").mapInArrow(_merge(k, at), MERGED), "graph")
    dropped(graph)
    return new


def graph_of(nodes: DataFrame, k: int = GRAPH_K, trees: int = CELL_TREES, wanted: int = WANTED) -> DataFrame:
    """The neighbour graph: node, code, neighbours, sims (packed, best first), fresh."""
    n = nodes.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "node"), F.lit(1 << 30)) / float(1 << 30)
    sample = [np.frombuffer(r["code"], np.float16) for r in nodes.where(draw < share).select("code").collect()]
    dims = len(sample[0]) if sample else 1
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / CELL_ROWS))))
    x = np.stack(sample).astype(np.float32) if sample else np.zeros((1, dims), np.float32)
    rng = np.random.default_rng(20)

    def met_in_cells() -> DataFrame:
        planes = rng.standard_normal((trees, bits, dims)).astype(np.float32)
        middle = np.stack([np.median(x @ planes[t].T, axis=0) for t in range(trees)])
        cells = nodes.select("node", "code").mapInArrow(_cells(planes, middle), "cell long, node long, code binary")
        return _sorted_by(cells, "cell", F.xxhash64("node")).mapInArrow(_cell_pairs(k, CELL_MOST), GRAPH)

    bare = nodes.select("node", "code", *(F.lit(None).cast("binary").alias(c) for c in ("neighbours", "sims", "flags")))
    graph = saved(_sorted_by(bare.unionByName(met_in_cells()), "node").mapInArrow(_merge(k, -1), MERGED), "graph")
    at = 0
    while True:
        changed = True
        while changed:
            graph = _descended(graph, k, at)
            changed = (graph.agg(F.sum("fresh")).first()[0] or 0) > DELTA * n * k
            at += 1
        if k >= n - 1 or recall_of(graph, n, wanted) >= RECALL:
            return graph
        k = min(n - 1, k * 3 // 2)
        more = saved(_sorted_by(graph.drop("fresh").unionByName(met_in_cells()), "node").mapInArrow(_merge(k, -1), MERGED), "graph")
        dropped(graph)
        graph = more


class Leaders:
    """The graph of the leaders as arrays, in which vectors are searched: a bounded number of rows, sent to the tasks."""

    def __init__(self, graph: DataFrame, links: int = LINKS):
        rows = sorted(graph.select("node", "code", "neighbours").collect(), key=lambda r: r["node"])
        self.key = np.array([r["node"] for r in rows], np.int64)
        self.code = np.stack([np.frombuffer(r["code"], np.float16) for r in rows]) if rows else np.zeros((0, 1), np.float16)
        near = [np.searchsorted(self.key, np.frombuffer(r["neighbours"], np.int64)[:links]) for r in rows]
        width = max([1, *map(len, near)])
        # A row with fewer neighbours is filled up with the leader itself.
        self.links = np.array([np.concatenate([v, np.full(width - len(v), k)]) for k, v in enumerate(near)], np.int32).reshape(len(rows), width)
        # The keys come from the order of rows, so the first ones are spread by a draw.
        self.entries = np.sort(np.random.default_rng(21).permutation(len(rows))[:ENTRIES])

    def residues(self, place: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What is left of unit vectors without their leaders: small, and so exact, among near copies."""
        return (x - self.code[place]).astype(np.float16)

    def vectors(self, place, residues: np.ndarray) -> np.ndarray:
        return self.code[place].astype(np.float32) + residues.astype(np.float32)

    def walk(self, x: np.ndarray, beam: int, width: int) -> np.ndarray:
        """For each row of x the places of its `beam` best leaders, best first, as a greedy search finds them; fewer are filled up with -1."""
        beam, code = min(beam, len(self.key)), self.code.astype(np.float32)
        step = max(1, AT_ONCE // max(1, min(width, beam) * self.links.shape[1]) // 4)
        return np.concatenate([self._walk(x[i : i + step], code, beam, width) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, beam), np.int32)

    def _walk(self, x: np.ndarray, code: np.ndarray, beam: int, width: int) -> np.ndarray:
        s = x @ code[self.entries].T
        best = _best(s, min(beam, s.shape[1]))
        found = np.full((len(x), beam), -1, np.int32)
        sims = np.full((len(x), beam), -4, np.float32)
        found[:, : best.shape[1]], sims[:, : best.shape[1]] = self.entries[best], np.take_along_axis(s, best, 1)
        closed, live = found < 0, np.arange(len(x))
        while len(live):
            f, v, c = found[live], sims[live], closed[live]
            ahead = _best(np.where(c, -4, v), min(width, beam))
            u = np.take_along_axis(f, ahead, 1)
            fresh = ~np.take_along_axis(c, ahead, 1)
            np.put_along_axis(c, ahead, True, 1)
            near = np.where(fresh[:, :, None], self.links[u], -1).reshape(len(live), -1)
            s = np.where(near < 0, -4, (code[near] @ x[live][:, :, None])[:, :, 0]).astype(np.float32)
            f, v, c = np.concatenate([f, near], 1), np.concatenate([v, s], 1), np.concatenate([c, near < 0], 1)
            # Of a leader that comes again, the one in the beam stays.
            order = np.argsort(f, axis=1, kind="stable")
            again = np.zeros(f.shape, bool)
            by_id = np.take_along_axis(f, order, 1)
            np.put_along_axis(again, order[:, 1:], by_id[:, 1:] == by_id[:, :-1], 1)
            v[again], c[again] = -4, True
            best = _best(v, beam)
            f, v, c = (np.take_along_axis(a, best, 1) for a in (f, v, c))
            f[v <= -4] = -1
            found[live], sims[live], closed[live] = f, v, c
            live = live[~c.all(axis=1)]
        return np.take_along_axis(found, np.argsort(-sims, axis=1, kind="stable"), 1)


def leaders_of(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes that lead: of n nodes, all up to LEAST_LEADERS, then one of LEADER_ROWS, and about MOST_LEADERS at most."""
    share = min(MOST_LEADERS, max(LEAST_LEADERS, n // LEADER_ROWS)) / max(n, 1)
    return nodes.where(F.pmod(F.xxhash64(F.lit("leader"), "node"), F.lit(1 << 30)) / float(1 << 30) < share)


def _packed(leader: np.ndarray, kind: int, *values: np.ndarray) -> pa.RecordBatch:
    """A row (leader, kind, packed values) for each leader."""
    order = np.argsort(leader, kind="stable")
    edge = run_bounds(leader[order])
    heads = leader[order][edge[:-1]].astype(np.int64)
    columns = [as_binary(v[order].ravel(), edge * (v.shape[1] if v.ndim > 1 else 1)) for v in values]
    columns += [pa.nulls(len(heads), pa.binary())] * (3 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(heads), pa.array(np.full(len(heads), kind, np.int32)), *columns], ["leader", "kind", "keys", "codes", "least"])


LISTS = "leader long, kind int, keys binary, codes binary, least binary"


def _bundles(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _insert(leaders: Leaders):
    """(node, vector) -> the lists of the leaders, packed: every node is on those of its HOMES nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bundles(batches, AT_ONCE // 4):
            x = units(b.column(1)).astype(np.float32)
            home = leaders.walk(x, INSERT_BEAM, INSERT_OPEN)[:, :HOMES]
            row, at = np.nonzero(home >= 0)
            yield _packed(home[row, at], 1, b.column(0).to_numpy()[row], leaders.residues(home[row, at], x[row]))

    return run


def lists_of(nodes: DataFrame, leaders: Leaders) -> DataFrame:
    """Every node on the lists of its nearest leaders, as the search in their graph finds them: leader (its place), kind, keys and codes (residues, packed)."""
    return saved(nodes.select("node", "vector").mapInArrow(_insert(leaders), LISTS), "lists")


def _walks(leaders: Leaders, beam: int, width: int):
    """(q, vector) -> (q, unit vector, beam): the leaders to be opened, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = units(b.column(1)).astype(np.float32)
                found = leaders.walk(x, beam, width)
                yield pa.RecordBatch.from_arrays([b.column(0), as_binary(x.ravel(), np.arange(len(b) + 1) * x.shape[1]), as_binary(found.ravel(), np.arange(len(b) + 1) * found.shape[1])], ["q", "code", "beam"])

    return run


def _asks(leaders: Leaders, first: int, last: int | None, parts: int, part: int):
    """(q, unit vector, beam, least) -> the queries packed by each of their leaders from the first to before the last, of a part of the leaders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bundles(batches, SCANNED * 4):
            leader = _matrix(b.column(2), np.int32)[:, first:last]
            row, at = np.nonzero((leader >= 0) & (leader % parts == part))
            if len(row):
                yield _packed(leader[row, at], 0, b.column(0).to_numpy()[row], leaders.residues(leader[row, at], _matrix(b.column(1), np.float32)[row]), b.column(3).to_numpy()[row].astype(np.float32))

    return run


FOUND = "q long, nodes binary, sims binary"


def _kept(q: np.ndarray, node: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each q its `most` best nodes, each once, best first."""
    order = np.lexsort((node, q))
    q, node, sim = q[order], node[order], sim[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (node[1:] != node[:-1])
    q, node, sim = q[once], node[once], sim[once]
    order = np.lexsort((node, -sim, q))
    q, node, sim = q[order], node[order], sim[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[near], node[near], sim[near]


def _found(q: np.ndarray, node: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    edge = run_bounds(q)
    return pa.RecordBatch.from_arrays([pa.array(q[edge[:-1]]), as_binary(node, edge), as_binary(sim, edge)], ["q", "nodes", "sims"])


def _meet(leaders: Leaders, most: int):
    """Rows sorted by leader, the queries of each before its list -> for the queries their `most` best nodes of the lists, of those that reach `least`."""

    def compared(asked: list, rows: list, out: list) -> int:
        if len(asked) > 1:
            asked[:] = [tuple(np.concatenate(v) for v in zip(*asked, strict=True))]
        keys, x = (np.concatenate(v) for v in zip(*rows, strict=True))
        n = 0
        for (q, y, low), i, j in itertools.product(asked, range(0, len(asked[0][0]) if asked else 0, TILE // 4), range(0, len(keys), TILE)):
            some = slice(i, i + TILE // 4)
            s = y[some] @ x[j : j + TILE].T
            row, col = np.nonzero(s >= low[some, None])
            if len(row) > most * len(s):
                best = _best(s, most)
                row, col = np.repeat(np.arange(len(s)), best.shape[1]), best.ravel()
            out.append((q[i + row], keys[j + col], s[row, col]))
            n += len(row)
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, rows, out, listed, held = None, [], [], [], 0, 0
        for leader, kind, keys, codes, least in itertools.chain((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), [(None,) * 5]):
            # A list is gone through when it has ended, and in parts if it is long.
            if rows and (leader != at or listed >= TILE):
                held += compared(asked, rows, out)
                rows, listed = [], 0
                if held > AT_ONCE * 4:
                    out = [_kept(*(np.concatenate(v) for v in zip(*out, strict=True)), most)]
                    held = len(out[0][0])
                    if held > AT_ONCE:
                        yield _found(*out[0])
                        out, held = [], 0
            if leader != at:
                at, asked = leader, []
            if leader is not None:
                keys = np.frombuffer(keys, np.int64)
                x = leaders.vectors(leader, np.frombuffer(codes, np.float16).reshape(len(keys), -1))
                if kind:
                    rows.append((keys, x))
                    listed += len(keys)
                else:
                    asked.append((keys, x, np.frombuffer(least, np.float32)))
        if held:
            yield _found(*_kept(*(np.concatenate(v) for v in zip(*out, strict=True)), most))

    return run


def _best_found(most: int):
    """Rows sorted by q -> one for each with its `most` best nodes, and the similarity that further ones must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            node, n = binaries(b.column(1), np.int64)
            found = _found(*_kept(np.repeat(b.column(0).to_numpy(), n), node, binaries(b.column(2), np.float32)[0], most))
            sims, n = binaries(found.column(2), np.float32)
            least = np.where(n < most, -4, sims[np.cumsum(n) - 1] - 2 * ROUNDING).astype(np.float32)
            yield found.append_column("least", pa.array(least))

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was found -> (q, u) with the query's own node."""
    for b in batches:
        u, n = binaries(b.column(1), np.int64)
        q = b.column(0).to_numpy()
        pair = np.unique(np.stack([np.concatenate([np.repeat(q, n), q]), np.concatenate([u, q])], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["q", "u"])


def _true_depths(leaders: Leaders, asked: np.ndarray, own: np.ndarray, place: np.ndarray, wanted: int):
    """The lists -> (q, node, sim, depth): the best nodes of a partition for each probe, and at which of its leaders they are met."""
    most = (wanted + 1) * HOMES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(own))[:, None]
        sim, node, depth = np.zeros((len(own), 0), np.float32), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int32)
        for b in batches:
            if not len(b):
                continue
            keys, n = binaries(b.column(2), np.int64)
            leader = np.repeat(b.column(0).to_numpy(), n)
            s = asked @ leaders.vectors(leader, binaries(b.column(3), np.float16)[0].reshape(len(keys), -1)).T
            row, at = np.nonzero(own[:, None] == keys)
            s[row, at] = -4
            if sim.shape[1] == most:
                may = (s > sim.min(axis=1)[:, None]).any(axis=0)
                s, keys, leader = s[:, may], keys[may], leader[may]
                if not len(keys):
                    continue
            best = _best(s, most)
            sim = np.concatenate([sim, s[every, best]], 1)
            node = np.concatenate([node, keys[best]], 1)
            depth = np.concatenate([depth, place[every, leader[best]]], 1)
            best = _best(sim, most)
            sim, node, depth = sim[every, best], node[every, best], depth[every, best]
        q = np.repeat(own, sim.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q, node.ravel(), sim.ravel(), depth.ravel())], ["q", "node", "sim", "depth"])

    return run


def beam_for(lists: DataFrame, leaders: Leaders, nodes: DataFrame, queries: DataFrame, wanted: int = WANTED) -> int:
    """How many leaders PROBES of the queries must open until they meet AIM of their wanted nearest nodes, by a full scan; BEAM at least."""
    probes = _drawn_few(queries.select("node").distinct().join(nodes.select("node", "vector"), "node"), "node", queries.count(), ["node", "vector"])
    if not probes:
        return BEAM
    own = np.array([r["node"] for r in probes])
    asked = unit(scaled(np.array([r["vector"] for r in probes]))).astype(np.float32)
    order = leaders.walk(asked, len(leaders.key), OPEN)
    place = np.full((len(own), len(leaders.key)), len(leaders.key), np.int32)
    row, at = np.nonzero(order >= 0)
    place[row, order[row, at]] = at
    met = lists.mapInArrow(_true_depths(leaders, asked, own, place, wanted), "q long, node long, sim float, depth int").where("sim > -3").groupBy("q", "node").agg(F.max("sim").alias("sim"), F.min("depth").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "node"))
    depths = np.sort([r["depth"] for r in met.withColumn("rank", rank).where(F.col("rank") <= wanted).select("depth").collect()])
    return max(BEAM, int(depths[min(len(depths) - 1, int(AIM * len(depths)))]) + 1) if len(depths) else BEAM


def _first_of_each(vec: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The places by falling score and rising id, of each id the first."""
    order = np.lexsort((vec, -score))
    return order[np.sort(np.unique(vec[order], return_index=True)[1])]


def _exact(wanted: int):
    """Rows (q, u, vector, ids) sorted by q -> the wanted + 1 best (vec_id, score) of each q, each vec_id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_runs(batches):
            q, u = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = run_bounds(q)
            x = scaled(_matrix(b.column(2), None).astype(np.float64))
            norm = np.sqrt((x * x).sum(axis=1))
            ids = b.column(3)
            out = ([], [], [])
            for i, j in zip(edge, edge[1:], strict=False):
                own = i + int(np.flatnonzero(u[i:j] == q[i])[0])
                score = (x[i:j] * x[own]).sum(axis=1) / (norm[i:j] * norm[own])
                vec = [v.values.to_numpy(zero_copy_only=False) for v in ids.slice(i, j - i)]
                score = np.repeat(score, [len(v) for v in vec])
                vec = np.concatenate(vec)
                order = _first_of_each(vec, score)[: wanted + 1]
                for k, v in enumerate((np.full(len(order), q[i]), vec[order], score[order])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["node", "vec_id", "score"])

    return run


def search(nodes: DataFrame, graph: DataFrame | Leaders, queries: DataFrame, wanted: int = WANTED, beam: int = BEAM, width: int = OPEN, lists: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries (id, node); the graph is that of some or all of the nodes, and the lists are made where none are given."""
    leaders = graph if isinstance(graph, Leaders) else Leaders(graph)
    lists = lists_of(nodes, leaders) if lists is None else lists
    starts = queries.select("node").distinct().join(nodes.select("node", "vector"), "node").select(F.col("node").alias("q"), "vector")
    walks = saved(starts.repartition(1 + queries.count() // WALKED, "q").mapInArrow(_walks(leaders, beam, width), "q long, code binary, beam binary"), "walks")
    most = max(KEPT, wanted + 1)

    def met(asked: DataFrame, first: int, last: int | None, parts: int = 1, part: int = 0) -> DataFrame:
        asks = asked.select("q", "code", "beam", "least").mapInArrow(_asks(leaders, first, last, parts, part), LISTS)
        return _sorted_by(asks.unionByName(lists.where(F.col("leader") % parts == part)), "leader", "kind").mapInArrow(_meet(leaders, most), FOUND)

    def best(found: DataFrame) -> DataFrame:
        return saved(_sorted_by(found, "q").mapInArrow(_best_found(most), FOUND + ", least float"), "best")

    # The lists of the first leaders tell what similarity the nodes on the others must reach.
    near = best(met(walks.withColumn("least", F.lit(-4.0).cast("float")), 0, FIRST))
    asked = walks.join(near.select("q", "least"), "q", "left").withColumn("least", F.coalesce("least", F.lit(-4.0).cast("float")))
    # In parts, so that not all that is asked is on disk at once.
    rest = [saved(met(asked, FIRST, None, PARTS, k), "rest") for k in range(PARTS)]
    found = best(functools.reduce(DataFrame.unionByName, rest, near.drop("least")))
    # A query that met nothing still has its own node, whose copies may be asked for.
    none = F.lit(None).cast("binary")
    alone = walks.join(found, "q", "left_anti").select("q", none.alias("nodes"), none.alias("sims"))
    pairs = found.drop("least").unionByName(alone).mapInArrow(_pairs, "q long, u long").join(nodes.select(F.col("node").alias("u"), "vector", "ids"), "u")
    exact = saved(_sorted_by(pairs.select("q", "u", "vector", "ids"), "q").mapInArrow(_exact(wanted), "node long, vec_id long, score double"), "exact")
    for table in (walks, near, *rest, found):
        dropped(table)
    return _ranked(queries.select(F.col("id").alias("query_id"), "node").join(exact, "node"), wanted)


def _ranked(found: DataFrame, wanted: int) -> DataFrame:
    """query_id, rank, vec_id, score of the wanted best of found, each vec_id once."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")


def _scan(ids: np.ndarray, vectors: np.ndarray, wanted: int):
    """(vector, ids) of nodes -> the wanted + 1 best (query_id, vec_id, score) of each query among the rows of a batch."""
    asked = scaled(vectors)
    asked_norm = np.sqrt((asked * asked).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = scaled(_matrix(b.column(0), None).astype(np.float64))
            norm = np.sqrt((x * x).sum(axis=1))
            vec = [v.values.to_numpy(zero_copy_only=False) for v in b.column(1)]
            of, vec = np.repeat(np.arange(len(b)), [len(v) for v in vec]), np.concatenate(vec)
            for q, a, n in zip(ids, asked, asked_norm, strict=True):
                score = ((x * a).sum(axis=1) / (norm * n))[of]
                top = _first_of_each(vec, score)[: wanted + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), q)), pa.array(vec[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def completed(found: DataFrame, nodes: DataFrame, queries: DataFrame, wanted: int) -> DataFrame:
    """found, where queries with fewer results than they could have get those of a full scan instead."""
    some = nodes.agg(F.sum(F.size("ids"))).first()[0] or 0
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(wanted, some - 1)).select(F.col("query_id").alias("id"))
    lacking = saved(queries.join(enough, "id", "left_anti").join(nodes.select("node", "vector"), "node").select("id", "vector"), "lacking")
    n = lacking.count()
    if not n:
        dropped(lacking)
        return found
    blocks = -(-n // SCANNED)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    out = found.join(lacking.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    for k in range(blocks):
        rows = lacking.where(block == k).collect()
        if rows:
            best = nodes.select("vector", "ids").mapInArrow(_scan(np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows]), wanted), "query_id long, vec_id long, score double")
            out = out.unionByName(saved(_ranked(best, wanted), "scanned").select(found.columns))
    return out


def nearest(table: DataFrame, id_column: str, vector: str, is_query, wanted: int = WANTED) -> DataFrame:
    """The wanted nearest rows of every row for which the Column is_query (of `id`) holds."""
    ship(table.sparkSession)
    rows = usable(table, id_column, vector)
    nodes = saved(nodes_of(rows, wanted), "nodes")
    asked = rows.where(is_query).select("id", "h1", "h2").distinct()
    queries = saved(asked.join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("id", "node"), "queries")
    first = saved(leaders_of(nodes, nodes.count()), "leaders")
    graph = graph_of(first, wanted=wanted)
    leaders = Leaders(graph)
    lists = lists_of(nodes, leaders)
    beam = beam_for(lists, leaders, nodes, queries, wanted)
    found = saved(search(nodes, leaders, queries, wanted, beam, lists=lists), "found")
    while beam < len(leaders.key) and recall_of_search(found, nodes, queries, wanted) < RECALL:
        beam = beam * 3 // 2
        dropped(found)
        found = saved(search(nodes, leaders, queries, wanted, beam, lists=lists), "found")
    for table in (first, graph, lists):
        dropped(table)
    return completed(found, nodes, queries, wanted)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.pmod(F.col("id"), F.lit(QUERY_STEP)) == 0)
