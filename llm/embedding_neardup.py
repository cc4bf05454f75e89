"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors of a label are one node with a count. Within a label, nodes are dealt into shards
around centroids drawn by least hash, a node between centroids into each of them; shards that are
still large are dealt again, and the whole is done ``REPEATS`` times with other centroids. A shard
that centroids do not part is worked on as pairs of blocks.

Build: in each shard a node gets the neighbours that robust pruning leaves (a candidate goes if a
kept neighbour is ``ALPHA`` times nearer to it than the node is), links go both ways, and the lists
are pruned again. A node's lists are united over all its shards.

Search: nodes that a united list names within range of a shard's member, but that are not of the
shard, join it as visitors, so that a search follows the united lists over shard borders. Then every
node of a shard is a query: a beam from the medoid leads to its surroundings, and from all that is
in range the search expands until it finds nothing more. Cosines are computed for the pairs that the
search meets, in double precision. A pair counts in the first shard that both share; a shard
returns, for each node, its links and the least node reached, never pairs.

Recall is audited vector by vector against brute force over all rows for a bounded sample, and
repeats are added while it is under ``RECALL``. If it stays there, the labels are searched as whole
shards in pairs of blocks without a graph, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.shared import ship, stored

THRESHOLD = 0.93
SHARD = 1000  # nodes that are searched together; larger shards fall into blocks of half as many
FAN = 64  # most centroids into which a large shard is dealt
LEVELS = 6
CHUNK = 1 << 13  # rows of a large shard that one task deals
MARGIN = 0.03  # of cosine, within which further centroids get the node too
DEGREE = 12
WIDEST = 24  # of a list within a shard, with the links back
ALPHA = 1.2
BEAM = 8
VISITS = 2  # rounds in which shards take in visitors
REPEATS = 2
MOST_REPEATS = 6
RECALL = 0.97
AUDIT = 300  # nodes whose links are also found by brute force
PAIRS = 1 << 15  # cosines computed at a time
HOT = 1000  # a node is hot if it stands for more than one in HOT rows, so there are fewer than HOT


def keyed_vectors(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, k, x)``: a digest of vectors that can link, and their bytes; else null.

    Components are taken as they are stored, in 8 bytes if the column holds doubles, else in 4.
    """
    wide = "double" in rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = column.flatten().to_numpy(zero_copy_only=False).astype("<f8" if wide else "<f4") + 0.0
            start = np.cumsum(size) - size
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
            some = np.concatenate(([0], np.cumsum(value != 0)))
            known = pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1))).to_numpy(zero_copy_only=False)
            fine = known & (bad[start + size] == bad[start]) & (some[start + size] > some[start])
            raw = [value[a : a + n].tobytes() if ok else None for a, n, ok in zip(start, size, fine)]
            keys = [None if r is None else xxhash.xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "k", "x"],
            )

    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return plain.mapInArrow(run, "vec_id long, label string, k binary, x binary")


def unit(raw: list[bytes], wide: bool) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8" if wide else "<f4").reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _deal(nodes: DataFrame, seeds: list[int], wide: bool) -> DataFrame:
    """``(shard, node)``: overlapping shards; some may still be large."""
    width = F.octet_length("x").cast("string")
    roots = nodes.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    now = roots.select(F.concat_ws("/", "label", width, F.col("seed").cast("string")).alias("shard"), "node")
    vectors = nodes.select("node", "x")
    done = None
    for level in range(LEVELS):
        sizes = now.groupBy("shard").agg(F.count("*").alias("n"))
        sized = stored(now.join(sizes, "shard"))
        small = sized.where(F.col("n") <= SHARD).select("shard", "node")
        done = small if done is None else done.unionAll(small)
        large = sized.where(F.col("n") > SHARD)
        if large.isEmpty():
            return done
        h = F.xxhash64("node", F.lit(seeds[0] * 100 + level))
        large = large.join(vectors, "node").withColumn("h", h).withColumn("fan", F.least(F.lit(FAN), F.ceil(F.col("n") * 4 / SHARD)))
        large = large.withColumn("chunks", F.ceil(F.col("n") / CHUNK))
        drawn = large.groupBy("shard", F.pmod("h", "fan").alias("c")).agg(
            F.min(F.struct("h", "x")).alias("m"), F.first("chunks").alias("chunks")
        )
        centres = drawn.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("salt"), F.col("m.x").alias("x"))
        members = large.select("shard", F.pmod(F.xxhash64("node"), "chunks").alias("salt"), "node", "n", "x")

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            if len(left) == 0 or len(right) == 0:
                return pa.table({"parent": pa.array([], pa.string()), "shard": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            centre = unit(sorted(right.column("x").to_pylist()), wide)
            near = unit(left.column("x").to_pylist(), wide) @ centre.T
            who, pick = np.nonzero(near >= near.max(axis=1, keepdims=True) - MARGIN)
            parent = left.column("shard")[0].as_py()
            return pa.table({
                "parent": [parent] * len(who), "shard": [f"{parent}/{c}" for c in pick.tolist()],
                "node": left.column("node").to_numpy()[who], "n": left.column("n").to_numpy()[who],
            })

        dealt = stored(
            members.groupBy("shard", "salt").cogroup(centres.toDF(*centres.columns).groupBy("shard", "salt"))
            .applyInArrow(nearest, "parent string, shard string, node long, n long")
        )
        # a shard that one centroid takes nearly whole is too dense for centroids, and stays as it was
        taken = dealt.groupBy("parent", "shard").agg(F.count("*").alias("most"), F.first("n").alias("n"))
        dense = stored(taken.where("most > 0.8 * n").select("parent").distinct())
        held = sized.select("shard", "node").join(dense.withColumnRenamed("parent", "shard"), "shard", "left_semi")
        done = done.unionAll(held)
        now = dealt.join(dense, "parent", "left_anti").select("shard", "node")
    return done.unionAll(now)


def _blocks(members: DataFrame, ring: bool) -> DataFrame:
    """Members with their group (shard, b, o): the shard itself, or each pair of a large one's blocks.

    With ``ring`` only pairs of neighbouring blocks, which is enough to build lists.
    """
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"))
    count = F.when(F.col("n") > SHARD, F.ceil(F.col("n") / (SHARD // 2))).otherwise(F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sized = members.join(sizes.select("shard", count.alias("blocks")), "shard").withColumn("own", own)
    if ring:
        others = F.array_distinct(F.array((F.col("own") + 1) % F.col("blocks"), (F.col("own") - 1 + F.col("blocks")) % F.col("blocks")))
    else:
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.filter(others, lambda o: (F.col("blocks") == 1) | (o != F.col("own")))
    return (
        sized.withColumn("other", F.explode(others))
        .withColumn("b", F.least("own", "other")).withColumn("o", F.greatest("own", "other")).drop("other")
    )


def prune(near: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (padded with -1) the ``degree`` that robust pruning keeps, padded likewise.

    The nearest candidate stays, and those go that are nearer to it, by ``ALPHA``, than to the row.
    """
    n, rows = len(near), np.arange(len(near))
    far = np.maximum(2 - 2 * near, 0)  # squared distances
    own = np.where(cand >= 0, far[rows[:, None], np.maximum(cand, 0)], np.inf)
    order = np.argsort(own, axis=1, kind="stable")
    cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
    kept = np.full((n, degree), -1, np.int64)
    alive = own.copy()
    for k in range(degree):
        at = alive.argmin(axis=1)
        live = alive[rows, at] < np.inf
        if not live.any():
            break
        pick = np.where(live, cand[rows, at], -1)
        kept[:, k] = pick
        alive[rows, at] = np.inf
        between = far[np.maximum(pick, 0)[:, None], np.maximum(cand, 0)]
        alive = np.where(live[:, None] & (ALPHA**2 * between <= own), np.inf, alive)
    return kept


def adjacency(x: np.ndarray) -> np.ndarray:
    """Lists of every row of ``x`` within a shard, padded with -1: pruned, linked both ways, pruned again."""
    n = len(x)
    near = x @ x.T
    np.fill_diagonal(near, -2.0)
    k = min(n - 1, 3 * DEGREE)
    if k < 1:
        return np.full((n, 1), -1, np.int64)
    cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
    forth = prune(near, cand, DEGREE)
    a, b = np.nonzero(forth >= 0)
    linked = np.zeros((n, n), bool)
    linked[a, forth[a, b]] = True
    linked |= linked.T
    degree = linked.sum(axis=1)
    both = np.full((n, int(degree.max())), -1, np.int64)
    a, b = np.nonzero(linked)
    both[a, np.arange(len(a)) - np.repeat(np.cumsum(degree) - degree, degree)] = b
    return both if both.shape[1] <= WIDEST else prune(near, both, WIDEST)


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of rows, a bounded number at a time."""
    out = np.empty(len(a))
    for i in range(0, len(a), PAIRS):
        part = slice(i, i + PAIRS)
        out[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]])
    return out


def range_search(x: np.ndarray, table: np.ndarray, starts: list[int], threshold: float) -> np.ndarray:
    """Which rows every row reaches within ``threshold``, by its lists (rows of ``table``, padded with -1)."""
    n, width = table.shape
    every = np.arange(n)
    seen, inside = np.zeros((n, n), bool), np.zeros((n, n), bool)
    beam, value = np.full((n, BEAM), -1, np.int64), np.full((n, BEAM), -np.inf)
    opened = np.ones((n, BEAM), bool)

    def meet(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        cosine = _cosines(x, q, v)
        seen[q, v] = True
        hit = cosine >= threshold
        inside[q[hit], v[hit]] = True
        return cosine

    def join(rows: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> None:
        """New vertices (one line each row) into the beams of ``rows``."""
        ids = np.concatenate((beam[rows], ids), axis=1)
        both = np.concatenate((value[rows], cosine), axis=1)
        known = np.concatenate((opened[rows], ids[:, BEAM:] < 0), axis=1)
        top = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM]
        for into, new in ((beam, ids), (value, both), (opened, known)):
            into[rows] = np.take_along_axis(new, top, axis=1)

    for m in starts:
        fresh = ~seen[:, m]
        cosine = np.where(fresh, meet(every, np.full(n, m)), -np.inf)
        join(every, np.where(fresh, m, -1)[:, None], cosine[:, None])
    while True:
        at = np.where(opened, -np.inf, value).argmax(axis=1)
        going = np.flatnonzero(~opened[every, at])
        if len(going) == 0:
            break
        opened[going, at[going]] = True
        reach = table[beam[going, at[going]]]
        fresh = (reach >= 0) & ~seen[going[:, None], np.maximum(reach, 0)]
        line, place = np.nonzero(fresh)
        cosine = np.full(reach.shape, -np.inf)
        cosine[line, place] = meet(going[line], reach[line, place])
        join(going, np.where(fresh, reach, -1), cosine)
    # expansion: whoever is in range hands on its neighbours
    a, b = np.nonzero(table >= 0)
    linked = np.zeros((n, n), np.float32)
    linked[a, table[a, b]] = 1
    front = inside.copy()
    while front.any():
        queries = np.flatnonzero(front.any(axis=1))
        before = inside[queries]
        reached = (front[queries].astype(np.float32) @ linked > 0) & ~seen[queries]
        q, v = np.nonzero(reached)
        meet(queries[q], v)
        front = np.zeros((n, n), bool)
        front[queries] = inside[queries] & ~before
    inside |= inside.T
    np.fill_diagonal(inside, False)
    return inside


def _padded(at: list[np.ndarray]) -> np.ndarray:
    table = np.full((len(at), max(1, max(map(len, at)))), -1, np.int64)
    for i, row in enumerate(at):
        table[i, : len(row)] = row
    return table


def _lists(groups: DataFrame, threshold: float, wide: bool) -> DataFrame:
    """``(node, near, close)`` of each shard: its list there, and those of it that are about in range."""

    def build(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node = node[order]
        raw = group.column("x").to_pylist()
        x = unit([raw[i] for i in order], wide)
        table = adjacency(x)
        close = (np.einsum("ij,ikj->ik", x, x[np.maximum(table, 0)]) >= threshold - MARGIN) & (table >= 0)
        near = [node[row[row >= 0]] for row in table]
        in_range = [node[row[ok]] for row, ok in zip(table, close)]
        return pa.table({
            "node": node, "near": pa.array(near, pa.list_(pa.int64())), "close": pa.array(in_range, pa.list_(pa.int64())),
        })

    return groups.select("shard", "b", "o", "node", "x").groupBy("shard", "b", "o").applyInArrow(
        build, "node long, near array<long>, close array<long>"
    )


def _least_reached(inside: np.ndarray) -> np.ndarray:
    """The least row that each row reaches by links."""
    n = len(inside)
    low = np.arange(n)
    rows = np.flatnonzero(inside.any(axis=1))
    while len(rows):
        new = np.minimum(low[rows], np.where(inside[rows], low, n).min(axis=1))
        new = np.minimum(new, low[new])
        if (new == low[rows]).all():
            break
        low[rows] = new
    return low


def search_group(group: pa.Table, threshold: float, wide: bool, exact: bool) -> pa.Table:
    """``(node, links, low)`` of a group: links counted here, and the least node reached."""
    node = group.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    node = node[order]
    raw = group.column("x").to_pylist()
    x = unit([raw[i] for i in order], wide)
    own, copies = group.column("own").to_numpy()[order], group.column("copies").to_numpy()[order]
    shard, b, o, blocks = (group.column(c)[0].as_py() for c in ("shard", "b", "o", "blocks"))
    n = len(node)
    if exact:
        inside = x @ x.T >= threshold
        np.fill_diagonal(inside, False)
    else:
        lists = group.column("near").to_pylist()
        at = []
        for i in order:
            row = np.array(lists[i] or [], np.int64)
            place = np.minimum(np.searchsorted(node, row), n - 1)
            at.append(place[node[place] == row])
        starts = []
        for block in np.unique(own):  # the medoid of each block
            here = np.flatnonzero(own == block)
            starts.append(int(here[(x[here] @ x[here].mean(axis=0)).argmax()]))
        inside = range_search(x, _padded(at), starts, threshold)
    low = node[_least_reached(inside)]
    # a pair counts in the first shard that both its ends share, and there in one pair of blocks
    a, c = np.nonzero(np.triu(inside))
    shards = group.column("shards").to_pylist()
    first = [frozenset(s for s in shards[i] if s < shard) for i in order]
    counts = np.array([first[i].isdisjoint(first[j]) for i, j in zip(a, c)], bool)
    if blocks > 1:
        counted = {b: (b + 1) % blocks == o, o: (o + 1) % blocks == b}
        counts &= (own[a] != own[c]) | np.array([counted[k] for k in own[a].tolist()], bool)
    a, c = a[counts], c[counts]
    links = np.bincount(a, copies[c], n).astype(np.int64) + np.bincount(c, copies[a], n).astype(np.int64)
    told = np.flatnonzero((links > 0) | (low != node))
    return pa.table({"node": node[told], "links": links[told], "low": low[told]})


def _linked(nodes: DataFrame, members: DataFrame, near: DataFrame | None, threshold: float, wide: bool) -> DataFrame:
    """``(node, links, low)`` of all shards."""
    every = members.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    carried = nodes.select("node", "x", "copies").join(every, "node")
    if near is not None:
        carried = carried.join(near, "node", "left")
    groups = _blocks(members, ring=False).join(carried, "node")
    columns = ["shard", "b", "o", "blocks", "own", "node", "x", "copies", "shards"] + ["near"] * (near is not None)
    exact = near is None
    return groups.select(*columns).groupBy("shard", "b", "o").applyInArrow(
        lambda group: search_group(group, threshold, wide, exact), "node long, links long, low long"
    )


def _searched(nodes: DataFrame, seeds: list[int], threshold: float, wide: bool) -> DataFrame:
    """Build, unite, take in visitors, search."""
    members = stored(_deal(nodes, seeds, wide))
    built = stored(_lists(_blocks(members, ring=True).join(nodes.select("node", "x"), "node"), threshold, wide))
    near = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    close = built.select("node", F.explode("close").alias("other")).distinct()
    fresh = members
    for _ in range(VISITS):
        named = fresh.join(close, "node").select("shard", F.col("other").alias("node")).distinct()
        fresh = stored(named.join(members, ["shard", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        members = stored(members.unionAll(fresh))
    return stored(_linked(nodes, members, near, threshold, wide))


def _audit(nodes: DataFrame, found: DataFrame, threshold: float, wide: bool) -> float:
    """Mean share of its links that a node of a bounded sample was given, against brute force over all rows."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(AUDIT).select("label", "node", "x").collect()
    held: dict[tuple, list] = {}
    for r in sample:
        held.setdefault((r["label"], len(r["x"])), []).append((r["node"], bytes(r["x"])))
    known = {k: (np.array([i for i, _ in v]), unit([x for _, x in v], wide)) for k, v in held.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            label, node, raw, copies = (b.column(i).to_pylist() for i in range(4))
            place: dict[tuple, list[int]] = {}
            for i, (one, x) in enumerate(zip(label, raw)):
                place.setdefault((one, len(x)), []).append(i)
            for key in place.keys() & known.keys():
                ids, x = known[key]
                here = place[key]
                near = x @ unit([raw[i] for i in here], wide).T >= threshold
                near &= ids[:, None] != np.array([node[i] for i in here])
                for i, n in zip(ids.tolist(), (near @ np.array([copies[i] for i in here])).tolist()):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["node", "true"])

    counted = nodes.select("label", "node", "x", "copies").mapInArrow(brute, "node long, true long")
    true = counted.groupBy("node").agg(F.sum("true").alias("true")).where(F.col("true") > 0)
    given = found.groupBy("node").agg(F.sum("links").alias("links"))
    share = F.least(F.coalesce("links", F.lit(0)) / F.col("true"), F.lit(1.0))
    return true.join(given, "node", "left").agg(F.coalesce(F.avg(share), F.lit(1.0))).head()[0]


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept, recall)`` of every row of (vec_id, embedding, label).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
    label, link with nothing; vectors of other lengths are not compared. Rows that repeat count
    one by one. A null vec_id keeps its row, without links or component. ``recall`` is the audit's.
    """
    spark = rows.sparkSession
    ship(spark)
    wide = "double" in rows.schema["embedding"].dataType.simpleString()
    keyed = keyed_vectors(rows)
    nodes = stored(
        keyed.where("k IS NOT NULL").groupBy("label", "k")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("x").alias("x"))
    )
    # two rows may share an id: a node is its label, digest and least id, so give it a number of its own
    nodes = stored(nodes.withColumnRenamed("node", "least").withColumn("node", F.monotonically_increasing_id()))
    recall, found = 0.0, None
    for repeats in range(REPEATS, MOST_REPEATS + 1):
        found = _searched(nodes, list(range(repeats)), threshold, wide)
        recall = _audit(nodes, found, threshold, wide)
        if recall >= RECALL:
            break
    else:
        label = F.concat_ws("/", "label", F.octet_length("x").cast("string"))
        found = stored(_linked(nodes, nodes.select(label.alias("shard"), "node"), None, threshold, wide))
        recall = 1.0
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    linked = components(found.select("node", "low"), "node", "low")
    of_node = nodes.select("label", "k", "least", "copies", "node").join(links, "node", "left").join(linked, "node", "left")
    of_node = stored(of_node.withColumn("component", F.coalesce("component", "node")))
    first = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stored(of_node.join(first, "component").select(
        F.col("label").alias("of"), F.col("k").alias("key"), "copies", "component_id",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    ))
    plain = keyed.select("vec_id", "label", "k")
    total = known.agg(F.sum("copies")).head()[0] or 0
    same = (F.col("label") == F.col("of")) & (F.col("k") == F.col("key"))
    hot = F.broadcast(known.where(F.col("copies") * HOT > total))  # fewer than HOT
    of_hot = plain.join(hot, same)
    others = plain.join(hot, same, "left_anti").join(known.where(F.col("copies") * HOT <= total), same, "left")
    return (
        of_hot.unionByName(others)
        .select(
            "vec_id",
            F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
        .withColumn("recall", F.lit(recall))
    )
