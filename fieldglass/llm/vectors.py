"""Near-duplicate vectors: an HNSW graph per shard, every shard queried, links verified, components united.

Vectors are compared within a label and dimension. Each such group is cut into shards of bounded
size; a graph is built per shard and stored, and every shard's vectors are searched in every graph of
the group. In one task two shards at most are in memory. A search is audited against brute force on a
fixed number of queries and repeated with twice the beam until the audit passes.
"""

from __future__ import annotations

import io
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.components import connected_components
from fieldglass.llm.hnsw import Graph
from fieldglass.llm.tables import keep_once

SIMILARITY = 0.98
SHARD = 16_384
BEAM = 32
AUDIT = 128  # queries of an audit, of stored vectors and of disturbed copies each
RECALL = 0.98  # of audited links, in one direction; a link is looked for in both
_SLACK = 1e-5  # single precision of the graph
_BLOCK = 256


def pack_shard(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """A shard's ids, unit vectors in double precision, and graph."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    graph = Graph.build(unit.astype(np.float32))
    out = io.BytesIO()
    layers = {f"{name}{k}": part for k, pair in enumerate(graph.layers) for name, part in zip(("rows", "links"), pair, strict=True)}
    # Upper layers hold few rows: only their links are stored.
    layers = {k: (v if k.startswith("rows") else v[graph.layers[int(k[5:])][0]]) for k, v in layers.items()}
    np.savez(out, ids=ids, unit=unit, **layers)
    return out.getvalue()


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, Graph]:
    stored = np.load(io.BytesIO(data))
    unit = stored["unit"]
    layers = []
    for k in range(sum(name.startswith("rows") for name in stored.files)):
        rows, part = stored[f"rows{k}"], stored[f"links{k}"]
        links = np.full((len(unit), part.shape[1]), -1, np.int32)
        links[rows] = part
        layers.append((rows, links))
    return stored["ids"], unit, Graph(unit.astype(np.float32), layers)


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links (a, b), the smallest node reachable."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def searched(graph: Graph, unit: np.ndarray, queries: np.ndarray, similarity: float, same: bool, seed: int = 1) -> np.ndarray:
    """Groups over rows and then queries such that links between a query and a row lie within a group, as far as the audit can tell."""
    n, q = len(unit), len(queries)
    rng = np.random.default_rng(seed)
    picked = rng.choice(q, min(q, AUDIT), replace=False)
    truth = queries[picked] @ unit.T >= similarity
    if same:
        truth[np.arange(len(picked)), picked] = False
    origin = rng.choice(n, min(n, AUDIT), replace=False)
    noise = rng.normal(size=(len(origin), unit.shape[1]))
    noise -= (noise * unit[origin]).sum(axis=1, keepdims=True) * unit[origin]
    length = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    noise = np.divide(noise, length, out=np.zeros_like(noise), where=length > 0)
    near = similarity + (1 - similarity) * 0.05
    copies = near * unit[origin] + np.sqrt(1 - near * near) * noise
    beam = BEAM
    while True:
        rows, sims = graph.search(queries.astype(np.float32), beam, np.arange(n) if same else None)
        i, j = np.nonzero((rows >= 0) & (sims >= similarity - _SLACK))
        group = smallest_reachable(n + q, i + n, rows[i, j])
        at, of = np.nonzero(truth)
        good, total = int((group[picked[at] + n] == group[of]).sum()), len(at)
        found, near_found = graph.search(copies.astype(np.float32), beam)
        hit = (found >= 0) & (near_found >= similarity - _SLACK) & (group[np.maximum(found, 0)] == group[origin][:, None])
        passed = good >= RECALL * total and hit.any(axis=1).sum() >= RECALL * len(origin)
        if passed or beam >= n:
            return group
        beam *= 2


def links_of_pair(index: bytes, asked: bytes, same: bool, similarity: float) -> pd.DataFrame:
    """(id, root, n_links): a row per vector that has a link between the two shards.

    n_links counts the rows of the index that a query links with; root is one vector of its component
    here. Within each group that the search found, every pair is verified in double precision.
    """
    ids, unit, graph = unpack_shard(index)
    other, queries = (ids, unit) if same else unpack_shard(asked)[:2]
    n, q = len(ids), len(other)
    group = searched(graph, unit, queries, similarity, same)
    counts = np.zeros(q, np.int64)
    a_parts, b_parts = [], []
    order_r = np.argsort(group[:n], kind="stable")
    order_q = np.argsort(group[n:], kind="stable")
    sorted_r, sorted_q = group[:n][order_r], group[n:][order_q]
    for g in np.intersect1d(sorted_r, sorted_q):
        rows = order_r[np.searchsorted(sorted_r, g): np.searchsorted(sorted_r, g, "right")]
        asks = order_q[np.searchsorted(sorted_q, g): np.searchsorted(sorted_q, g, "right")]
        if same and len(rows) == 1:
            continue
        for lo in range(0, len(asks), _BLOCK):
            part = asks[lo: lo + _BLOCK]
            linked = queries[part] @ unit[rows].T >= similarity
            if same:
                linked &= part[:, None] != rows[None, :]
            counts[part] += linked.sum(axis=1)
            i, j = np.nonzero(linked)
            nodes = np.concatenate([rows, part + n])
            label = smallest_reachable(len(nodes), i + len(rows), j)
            moved = label != np.arange(len(nodes))
            a_parts.append(nodes[moved])
            b_parts.append(nodes[label[moved]])
    a = np.concatenate(a_parts) if a_parts else np.zeros(0, np.int64)
    b = np.concatenate(b_parts) if b_parts else np.zeros(0, np.int64)
    if same:
        a, b = np.concatenate([a, np.arange(n)]), np.concatenate([b, np.arange(n) + n])  # a vector is one node as row and as query
    label = smallest_reachable(n + q, a, b)
    names = np.concatenate([ids, other])
    size = np.bincount(label, minlength=n + q)[label]
    total = np.concatenate([np.zeros(n, np.int64), counts])
    show = size > (2 if same else 1)
    if same:
        show[:n] = False
    return pd.DataFrame({"id": names[show], "root": names[label[show]], "n_links": total[show]})


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    similarity: float = SIMILARITY, shard: int = SHARD,
) -> DataFrame:
    """One row per row of `vectors`: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have the same dimension, and their
    cosine in double precision is at least `similarity`. Vectors that are null, empty, zero or hold a
    null or non-finite component link with nothing. Ids may have any type that can be ordered, and may
    be null or repeated: rows are told apart by a number given when they are written, and repeated rows
    are vectors of their own that link with each other. component_id is the smallest id reachable, null
    if there is none but null ids; kept is whether the row's id is that id.
    """
    values = F.col("vector")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    every = keep_once(vectors.select(
        F.monotonically_increasing_id().alias("node"), F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector")), "vectors")
    fit = F.col("label").isNotNull() & F.coalesce(
        (F.size("vector") > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0) & (size < float("inf")), F.lit(False))
    usable = every.drop("id").where(fit).withColumn("dim", F.size("vector"))
    shards = usable.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    placed = usable.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        data = pack_shard(rows["node"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "graph": [data]})

    graphs = keep_once(placed.groupBy("label", "dim", "shard").applyInPandas(build, "label string, dim int, shard int, graph binary"), "graphs")
    # Names of shards only: every shard of a group with every other.
    of_group = graphs.groupBy("label", "dim").agg(F.sort_array(F.collect_list("shard")).alias("all"))
    pairs = of_group.select("label", "dim", F.explode("all").alias("shard"), "all").select("label", "dim", "shard", F.explode("all").alias("other"))
    names = ["label", "dim", "shard"]
    met = pairs.join(graphs, names).join(
        graphs.select("label", "dim", F.col("shard").alias("other"), F.col("graph").alias("asked")), ["label", "dim", "other"])

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # One row: the two shards of the pair.
        return links_of_pair(rows["graph"].iloc[0], rows["asked"].iloc[0], key[2] == key[3], similarity)

    dealt = met.withColumn("asked", F.when(F.col("shard") != F.col("other"), F.col("asked")))
    found = keep_once(dealt.groupBy("label", "dim", "shard", "other").applyInPandas(search, "id bigint, root bigint, n_links bigint"), "vector-links")
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n_links").alias("n_links"))
    rows = every.select("node", "id")
    linked = rows.join(connected_components(found, "id", "root"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    smallest = linked.join(least, "component").select("node", "least")
    out = rows.join(counts, "node", "left").join(smallest, "node", "left")
    component = F.coalesce("least", "id")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
