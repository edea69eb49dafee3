"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. Nodes start with neighbours from random hyperplane buckets, a few tables of them, and
then compare the neighbours of their neighbours, keeping the nearest, until the lists hardly change. An audit compares a
sample of each label's nodes, with links and without, with all others of the label by brute force. Labels where links were
missed get more tables and rounds, and in the end are compared as a whole, so no label is left with a link known to be missed.
A node whose
list is full of links may have more, in its component and in others: such nodes are compared block by block with those of all
other components, which joins components, and then all nodes of a component with one another, which counts the links.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .arrow import grouped, in_arrow, map_rows
from .graph import components

#: Neighbours kept for a node, and rows of a block in which all pairs are compared.
NEIGHBOURS, BLOCK = 8, 128
#: Nodes of a block when components are compared with one another.
SIDE = 1024
#: Expected rows of a hyperplane bucket, tables of buckets at first, bits of a code at most.
BUCKET, TABLES, BITS = 32, 6, 48
#: Share of the lists' entries that a last round of descent may still change.
CHANGED = 0.001
#: Nodes of a label, with links and without, that an audit compares at least, and rounds of tables before the exact comparison.
AUDITED, AUDITS = 64, 3

log = logging.getLogger(__name__)


def unit(rows: pa.Array, dtype: str) -> np.ndarray:
    """Vectors, stored as bytes, as rows of length one in double precision."""
    v = np.frombuffer(b"".join(rows.to_pylist()), dtype).reshape(len(rows), -1).astype(float)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, dtype: str) -> DataFrame:
    """(id, space, vec): space is null for vectors that link with nothing, else their label and width."""

    def make():
        def one(label, v):
            if label is None or v is None or not len(v) or any(x is None for x in v):
                return None, None
            a = np.array(v, dtype)
            if not np.isfinite(a).all() or not a.any():
                return None, None
            return f"{label}:{len(a)}", (a + 0.0).tobytes()  # -0.0 becomes 0.0

        def run(part: pa.RecordBatch) -> list:
            found = [one(a, b) for a, b in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            return [part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary())]

        return run

    return map_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")), make, "id long, space string, vec binary")


def bucket_neighbours(nodes: DataFrame, dtype: str, tables: range) -> DataFrame:
    """(a, b, sim): the nearest rows of each node within its bucket of each table. Large buckets are dealt into blocks."""
    sizes = nodes.groupBy("space").agg(F.count("*").alias("n"))
    sized = nodes.select("id", "space", "vec").join(sizes, "space").select("id", "space", "vec", "n")

    def code(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            spaces, n = batch.column(1).to_pylist(), batch.column(3).to_numpy()
            by: dict[int, list[int]] = {}
            for i, s in enumerate(spaces):
                by.setdefault(int(s.rpartition(":")[2]), []).append(i)
            for width, rows in by.items():
                part = batch.take(pa.array(rows))
                u, bits = unit(part.column(2), dtype), np.clip(np.ceil(np.log2(np.maximum(n[rows], 1) / BUCKET)), 0, BITS).astype(int)
                for t in tables:
                    if (t, width) not in planes:
                        planes[t, width] = np.random.default_rng([t, width]).standard_normal((width, BITS + 1))
                    side = u @ planes[t, width]
                    ones = (side[:, :BITS] > 0).astype(np.int64)
                    codes = (ones * (1 << np.arange(BITS))).cumsum(1)
                    own = np.where(bits > 0, codes[np.arange(len(rows)), np.maximum(bits, 1) - 1], 0)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(rows), pa.int32()), part.column(1), pa.array(own), pa.array(side[:, BITS]), part.column(0), part.column(2)], names=["t", "space", "code", "side", "id", "vec"])

    coded = sized.transform(in_arrow, code, "t int, space string, code long, side double, id long, vec binary")
    dealt = coded.repartitionByRange("t", "space", "code", "side", "id").sortWithinPartitions("t", "space", "code", "side", "id")

    def near(batches):
        for _, rows in grouped(batches, 3):
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(max(0, min(at, rows.num_rows - BLOCK)), BLOCK)
                if part.num_rows > 1:
                    yield nearest(part.column(4).to_numpy(), unit(part.column(5), dtype))

    return dealt.transform(in_arrow, near, "a long, b long, sim double")


def nearest(ids: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
    """The nearest others of each row."""
    sims = u @ u.T
    np.fill_diagonal(sims, -2)
    k = min(NEIGHBOURS, len(ids) - 1)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel())], names=["a", "b", "sim"])


def kept(edges: DataFrame) -> DataFrame:
    """The nearest of each node's candidates."""
    lists = edges.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", "b")), asc=False), 1, NEIGHBOURS).alias("l"))
    return lists.select("a", F.explode("l").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))


def descend(graph: DataFrame, nodes: DataFrame, dtype: str) -> DataFrame:
    """Candidates among the neighbours of a common neighbour that are nearer than what a node has."""
    worst = graph.groupBy("a").agg(F.min("sim").alias("worst"))
    back = kept(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    around = graph.union(back).select(F.col("a").alias("mid"), F.col("b").alias("id")).union(graph.select("a", "a").distinct()).distinct()
    members = around.join(nodes.select("id", "vec"), "id").join(worst.withColumnRenamed("a", "id"), "id", "left").select("mid", "id", "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))

    def run(batches):
        for _, rows in grouped(batches, 1):
            if rows.num_rows < 2:
                continue
            ids, worst = rows.column(1).to_numpy(), rows.column(3).to_numpy()
            u = unit(rows.column(2), dtype)
            sims = u @ u.T
            np.fill_diagonal(sims, -3)
            a, b = np.nonzero(sims > worst[:, None])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims[a, b])], names=["a", "b", "sim"])

    return members.repartition("mid").sortWithinPartitions("mid").transform(in_arrow, run, "a long, b long, sim double")


def audited(own: DataFrame, audit: int) -> DataFrame:
    """A sample of the rows (id, space, label, vec, linked) by space, another one for each audit.

    Of nodes with links it takes as many as grow with the root of the space. Of those without, it takes enough to meet, 19
    times in 20, one of a ninth as many nodes as have links (or as the root, if that is more): fewer leave a recall of 0.9.
    A space that fits in one block is taken whole.
    """
    sizes = own.groupBy("space").agg(F.count_if("linked").alias("k"), F.count_if(~F.col("linked")).alias("u")).withColumn("root", F.ceil(F.sqrt(F.col("k") + F.col("u"))))
    share = F.when(F.col("k") + F.col("u") <= SIDE, 1.0).when(F.col("linked"), (AUDITED + F.col("root")) / F.col("k")).otherwise(AUDITED / F.col("u") + 27 / F.greatest("k", "root"))
    return own.join(sizes, "space").where(F.pmod(F.xxhash64("id", F.lit(audit)), F.lit(1 << 30)) < share * (1 << 30)).select(*own.columns)


def across(some: DataFrame, others: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(space, a, b, links, out): links between rows (id, space, label, vec) of both tables, one at least for any two labels that a pair of blocks links.

    All rows of a space are compared, block against block, whatever is known of them. A row without a and b for every pair of
    blocks counts its links and those between different labels.
    """
    sizes = [t.groupBy("space").agg(F.expr(f"cast(ceil(count(*) / {SIDE}) as int)").alias(x)) for t, x in ((some, "n_i"), (others, "n_j"))]
    blocks = sizes[0].join(sizes[1], "space")

    def placed(t: DataFrame, own: str, other: str, left: bool) -> DataFrame:
        dealt = t.join(blocks, "space").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int"))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).select("space", "i", "j", F.lit(left).alias("left"), "id", "label", "vec")

    rows = placed(some, "i", "j", True).union(placed(others, "j", "i", False))
    if some is others:
        rows = rows.where("i <= j")

    def run(batches):
        for (space, i, j), part in grouped(batches, 3):
            left = part.column(3).to_numpy(zero_copy_only=False)
            ids, labels, u = part.column(4).to_numpy(), part.column(5).to_numpy(), unit(part.column(6), dtype)
            a, b = np.nonzero(u[left] @ u[~left].T >= threshold)
            n, out = int((ids[left][a] != ids[~left][b]).sum()), labels[left][a] != labels[~left][b]
            a, b = np.flatnonzero(left)[a[out]], np.flatnonzero(~left)[b[out]]
            _, first = np.unique(np.stack([labels[a], labels[b]]), axis=1, return_index=True)
            found = [[None, *ids[a[first]].tolist()], [None, *ids[b[first]].tolist()], [n] + [0] * len(first), [int(out.sum())] + [0] * len(first)]
            yield pa.RecordBatch.from_arrays([pa.array([space] * (len(first) + 1), pa.string()), *(pa.array(x, pa.int64()) for x in found)], names=["space", "a", "b", "links", "out"])

    return rows.repartition("space", "i", "j").sortWithinPartitions("space", "i", "j").transform(in_arrow, run, "space string, a long, b long, links long, out long")


def joined(nodes: DataFrame, links: DataFrame, known: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Components of the links and of the pairs known besides, joined where nodes link whose lists are full of links: a node with room in its list has all of its links there."""
    labels = components(links.union(known))
    full = links.groupBy("a").agg(F.count("*").alias("held")).where(F.col("held") >= NEIGHBOURS)
    full = stored(nodes.select("id", "space", "vec").join(full.select(F.col("a").alias("id")), "id").join(labels.withColumnRenamed("node", "id"), "id"), "full", "none")
    several = full.groupBy("space").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_ = full.join(several, "space", "left_semi")
    more = stored(across(open_, open_, dtype, threshold).where("a is not null").select("a", "b"), "links")
    if more.limit(1).count():
        discard(labels)
        labels = components(links.union(known).union(more))
    discard(more)
    discard(full)
    return labels


def link_counts(nodes: DataFrame, labels: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """(id, links): copies, by their number, of other nodes of the component that are near enough, compared block by block."""
    own = nodes.join(labels.withColumnRenamed("node", "id"), "id").select("id", "label", "vec", "n")
    blocks = own.groupBy("label").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    placed = own.join(blocks, "label").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("label", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), "i", "id", "vec", "n").repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")

    def run(batches):
        for (_, low, high), rows in grouped(batches, 3):
            at, ids, n, u = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(6).to_numpy(), unit(rows.column(5), dtype)
            a = np.flatnonzero(at == low)
            b = np.flatnonzero(at == high)
            near = u[a] @ u[b].T >= threshold
            if low == high:
                np.fill_diagonal(near, False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(near @ n[b])], names=["id", "links"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a], ids[b]])), pa.array(np.concatenate([near @ n[b], n[a] @ near]))], names=["id", "links"])

    return pairs.transform(in_arrow, run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def searched(nodes: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """Components of all links. Spaces leave the search when an audit of theirs misses no link or they were compared as a whole."""
    work, known, graph = nodes, nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false"), None
    for audit in range(AUDITS + 1):
        more = bucket_neighbours(work, dtype, range(audit * TABLES, (audit + 1) * TABLES))
        graph = stored(kept(more if graph is None else graph.union(more)), "graph")
        while True:
            new = stored(kept(graph.union(descend(graph, work, dtype))), "graph")
            changed, total = new.join(graph, ["a", "b"], "left_anti").count(), new.count()
            discard(graph)
            graph = new
            if changed <= CHANGED * total:
                break
        labels = joined(work, graph.where(F.col("sim") >= threshold).select("a", "b"), known, dtype, threshold)
        own = work.select("id", "space", "vec").join(labels.withColumnRenamed("node", "id"), "id", "left")
        own = stored(own.select("id", "space", F.coalesce("label", "id").alias("label"), "vec", F.col("label").isNotNull().alias("linked")), "own", "none")
        found = stored(across(audited(own, audit), own, dtype, threshold), "audit")
        sums = found.groupBy("space").agg(F.sum("links").alias("links"), F.sum("out").alias("out"))
        failed = stored(sums.where("out > 0").select("space"), "failed")
        links, out, spaces = sums.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("out"), F.lit(0)), F.count_if(F.col("out") > 0)).first()
        log.info("audit %d: %d links of sampled nodes, recall %.4f, %d labels with missed links", audit + 1, links, 1 - out / max(links, 1), spaces)
        if not spaces:
            return labels
        rest = own.join(failed, "space", "left_semi")
        missed = (across(rest, rest, dtype, threshold) if audit == AUDITS else found).where("a is not null").select("a", "b")
        known = stored(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(missed), "known")
        if audit == AUDITS:
            log.info("%d labels were compared as a whole", spaces)
            break
        work = stored(work.join(failed, "space", "left_semi").select(*nodes.columns), "nodes", "none")
        graph = stored(graph.join(work.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b", "sim"), "graph")
        for t in (labels, own, found, failed):
            discard(t)
    return components(known)


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of equal label whose cosine is at least ``threshold``.

    Returns per row: the id, n_links (other rows linked directly), component_id (smallest id reachable, its own included), kept
    (whether that is its own). Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null
    label, link with nothing; vectors of different widths do not link. A null id has a null component and is not kept unless a
    copy has an id. No rows give no rows, and other columns are not read.
    """
    dtype = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = stored(vectors(df, id_col, vector_col, label_col, dtype), "vectors", "none")
    classes = rows.where("space is not null").groupBy("space", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes = stored(classes.where("id is not null"), "nodes", "none")
    labels = searched(nodes, dtype, threshold)
    counts = link_counts(nodes, labels, dtype, threshold)
    found = nodes.join(labels.withColumnRenamed("node", "id"), "id", "left").join(counts, "id", "left")
    found = found.select("space", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "id").alias("component"))
    out = rows.join(found.where("n_links > 0"), ["space", "vec"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
