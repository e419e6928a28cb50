"""Near-duplicate vectors within a label by hierarchical navigable small-world graphs, one per shard.

Equal vectors of a label are one class, counted before the shuffle. The classes of a label are dealt to shards of about
`shard_size` by hash; each shard's graph is built by one task, which also audits it: the neighbours of a sample are searched and
compared with brute force, by vector and by class of partner counts, and the beam is widened until each class meets the recall target. Every class is then
searched in every shard of its label, in bounded blocks. What a search finds is verified in double precision, so no pair below the
threshold is a link. Tasks return how many vectors each class links with and a spanning forest of its links, never all pairs;
the forests' components are united over all shards.

Vectors that are null, empty, zero or hold null or non-finite components, and rows whose label is null, link with nothing and are kept.
Vectors of different lengths never link. Repeated ids are vectors of their own. A row with a null id has no
component and is kept. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .components import components
from .storage import folder_uri, read_file, stored, write_file

SLACK = 1e-4  # of single precision, before the double check


def _unit(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).astype(np.float64)
    x = flat.reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def audited(g: hnsw.Graph, least: float, target: float, sample: int, width: int) -> tuple[int, float]:
    """The beam width at which the sampled recall reaches the target, and that recall: the least of the share of vectors that
    find themselves and, for every class of vectors with about as many partners (by powers of two), the mean over its vectors of the
    share of partners found, self left out. Rows are drawn until `sample` of them have partners and lie outside the class with most
    rows, or the shard is through; a class keeps `sample` of them, fewer where they have thousands of partners."""
    order = np.random.default_rng(3).permutation(len(g.x))
    alone: list[int] = []
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    drawn: dict[int, int] = {}
    for lo in range(0, len(order), sample):
        some = order[lo : lo + sample]
        if not lo:
            alone = some.tolist()
        for i, s in zip(some.tolist(), g.x[some] @ g.x.T, strict=True):
            near = np.flatnonzero(s >= least)
            near = near[near != i]
            if not len(near):
                continue
            c = len(near).bit_length()
            drawn[c] = drawn.get(c, 0) + 1
            if drawn[c] <= max(64, min(sample, (1 << 19) >> c)):
                classes.setdefault(c, []).append((i, near))
        if sum(drawn.values()) - max(drawn.values(), default=0) >= sample:
            break
    asked = [alone, *([i for i, _ in rows] for rows in classes.values())]
    wanted = [[np.array([i]) for i in alone], *([near for _, near in rows] for rows in classes.values())]
    while True:
        reached = 1.0
        for rows, want in zip(asked, wanted, strict=True):
            found = hnsw.search(g, g.x[rows], width, least)
            reached = min(reached, float(np.mean([np.isin(w, f).mean() for w, f in zip(want, found, strict=True)])))
        if reached >= target or width >= len(g.x):
            return width, reached
        width *= 2


def links(vectors: DataFrame, *, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard_size: int = 16_384, block_size: int = 4_096, width: int = 64, recall: float = 0.998, audit: int = 512) -> DataFrame:
    """Per row: key, n_links (other vectors linked directly), component_id, kept (the component's smallest id), and
    audited, the recall of its shard's audit (null for vectors that can't link)."""
    spark = vectors.sparkSession
    folder = folder_uri(spark, "graphs")
    v = F.transform(vectors[vector], lambda x: x.cast("double"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].cast("string").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size("v") == 0) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    rows = rows.withColumn("size", F.when(F.col("ok"), F.size("v")))
    same = [F.when(F.col("ok"), F.xxhash64("label", "size", "v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "size", "v")).alias("h2")]
    rows = rows.select("id", "label", "size", "ok", *same, "v")
    # a class is named by its first hash; a null id takes part without giving its name
    classes = rows.where("ok").groupBy("label", "size", "h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least_id"), F.any_value("v").alias("v"))
    classes = stored(classes, "classes")
    per_label = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / shard_size).alias("shards"), F.ceil(F.count("*") / block_size).alias("blocks"))
    placed = classes.join(per_label, ["label", "size"])
    group = ["label", "size", "shard"]

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = table.column("size")[0].as_py()
        exact = _unit(table.column("v"), size)
        g = hnsw.build(exact.astype(np.float32))
        beam, reached = audited(g, least - SLACK, recall, audit, width)
        ids = table.column("h1").to_numpy()
        uri = write_file(folder, "graph", g.pack(ids=ids, exact=exact, counts=table.column("n").to_numpy()))
        return pa.table({"label": table.column("label")[:1], "size": table.column("size")[:1], "shard": table.column("shard")[:1], "uri": pa.array([uri]), "width": pa.array([beam], pa.int64()), "audited": pa.array([reached])})

    sharded = placed.select("label", "size", F.pmod(F.xxhash64("h1", "h2"), "shards").alias("shard"), "h1", "n", "v")
    graphs = stored(sharded.groupBy(*group).applyInArrow(make, "label string, size int, shard long, uri string, width long, audited double"), "graphs")

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, more = hnsw.Graph.unpack(read_file(table.column("uri")[0].as_py()))
        exact = _unit(table.column("v"), table.column("size")[0].as_py())
        ids, known, counts = table.column("h1").to_numpy(), more["ids"], more["counts"]
        # one link per query and group of the shard's vectors that earlier links have not yet brought together
        together = np.arange(len(known))
        linked, ends = np.zeros(len(ids), np.int64), []
        for i, near in enumerate(hnsw.search(g, exact.astype(np.float32), table.column("width")[0].as_py(), least - SLACK)):
            near = near[(more["exact"][near] @ exact[i] >= least) & (known[near] != ids[i])]
            if not len(near):
                continue
            linked[i] = counts[near].sum()
            groups, first = np.unique(together[near], return_index=True)
            ends += [(int(ids[i]), other) for other in known[near[first]].tolist()]
            if len(groups) > 1:
                together[np.isin(together, groups)] = groups[0]
        n = len(ends)
        out = {"h1": [*ids.tolist(), *(a for a, _ in ends)], "other": [None] * len(ids) + [b for _, b in ends], "n": [*linked.tolist(), *[0] * n], "audited": [table.column("audited")[0].as_py()] * (len(ids) + n)}
        return pa.table({k: pa.array(x, pa.float64() if k == "audited" else pa.int64()) for k, x in out.items()})

    asked = placed.select("label", "size", "h1", "v", F.pmod(F.xxhash64("h2", "h1"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    found = asked.join(graphs, group).groupBy(*group, "block").applyInArrow(find, "h1 long, other long, n long, audited double")
    found = stored(found, "found")
    counted = found.where("other is null").groupBy("h1").agg(F.sum("n").alias("links"), F.min("audited").alias("audited"))
    joined = components(found.where("other is not null").select(F.col("h1").alias("a"), F.col("other").alias("b")))
    named = classes.select("h1", F.col("n").alias("same"), "least_id").join(joined.withColumnRenamed("id", "h1"), "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    least_ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_class = stored(named.join(least_ids, "component").join(counted, "h1").select("h1", (F.col("same") - 1 + F.col("links")).alias("n_links"), "component_id", "audited"), "per-class")
    out = rows.select("id", "h1").join(per_class, "h1", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "audited")
