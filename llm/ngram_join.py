"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A text is its set of distinct word 5-grams. Two texts link when
``den * |A & B| >= num * |A | B|``. The search is exact and works on classes of equal sets:

1. Every task turns its texts into sets and packs their postings by hash range, so the
   inverted index moves in few bytes, each class once per task. Where the lists meet their
   lengths are known; lists of one class cannot add to an overlap and end there.
2. A class of size n needs ``T = ceil(num * n / den)`` common shingles with any partner.
   Its ``T - 1`` longest lists are set aside; a partner must occur in one of the rest, the
   short lists. (Length is taken in powers of two, then the hash decides: any order that all
   classes share is exact.) Classes whose lists of one class already exhaust the rest, and
   all those without T shared shingles, are done.
3. Candidates come from merging the short lists: what a pair has in common there, and at most
   T - 1 more, must reach the overlap it needs. Each is checked by binary search in the
   partner's set.

For components not every pair is needed. Each class is first checked against the most
central class (fewest unshared shingles) of the lists they meet in, and only pairs whose
ends are then still apart, and which their unshared shingles leave possible, are listed and
checked. So a group of near copies costs its size, not its square; no pair that could join
two components is left out, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.shared import cut, ship
from llm.words import shingle_sets

TASK_POSTINGS = 1 << 20  # packed at a time in a task
LIST_POSTINGS = 1 << 20  # postings that meet in a task
BLOCK = 256  # members of a list that are sent on together
KEPT_BITS = 48  # of a shingle hash, once it has been counted


def class_key(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a set; equal digests are taken as equal sets."""
    return int(xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))) - (1 << 63)


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, class)`` of every row; class is null for a set without shingles."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, keys = [], []
            for s in shingle_sets(b.column(1), n):
                sizes.append(len(s))
                keys.append(class_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
                ["doc_id", "n_shingles", "class"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, class long")


def _packed(docs: DataFrame, text: str, n: int, bits: int) -> DataFrame:
    """Postings by hash range: sorted 48-bit hashes in two parts, and the classes they belong to."""
    low_bits = KEPT_BITS - bits

    def pack(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.fromiter(sets, np.int64, len(sets))
        sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        hashes = np.concatenate(list(sets.values())) >> np.uint64(64 - KEPT_BITS)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], np.repeat(np.arange(len(keys)), sizes)[order]
        bucket = (hashes >> np.uint64(low_bits)).astype(np.int64)
        rows = {"bucket": [], "low": [], "high": [], "owner": [], "keys": [], "sizes": []}
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
            used = np.zeros(len(keys), bool)
            used[owner[a:b]] = True
            place = np.cumsum(used) - 1
            small = np.uint16 if used.sum() <= 1 << 16 else np.uint32
            rows["bucket"].append(int(bucket[a]))
            rows["low"].append(hashes[a:b].astype(np.uint32).tobytes())
            rows["high"].append((hashes[a:b] >> np.uint64(32)).astype(np.uint16).tobytes())
            rows["owner"].append(place[owner[a:b]].astype(small).tobytes())
            rows["keys"].append(keys[used].tobytes())
            rows["sizes"].append(sizes[used].tobytes())
        return pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema(
        [("bucket", pa.int64()), *((c, pa.binary()) for c in ("low", "high", "owner", "keys", "sizes"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for b in batches:
            for s in shingle_sets(b.column(0), n):
                if len(s) and (key := class_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                    if held >= TASK_POSTINGS:
                        yield pack(sets)
                        sets, held = {}, 0
        if sets:
            yield pack(sets)

    return docs.select(text).mapInArrow(
        run, "bucket long, low binary, high binary, owner binary, keys binary, sizes binary"
    )


def _meet(group: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Inverted lists of a hash range; the shingles in lists of two classes or more, by class range."""
    hashes, owner, keys, sizes, seen = [], [], [], [], 0
    for low, high, own, key, size in zip(
        group["low"], group["high"], group["owner"], group["keys"], group["sizes"], strict=True
    ):
        h = np.frombuffer(low, np.uint32).astype(np.uint64)
        hashes.append(h | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)))
        k = np.frombuffer(key, np.int64)
        o = np.frombuffer(own, np.uint16 if len(own) == 2 * len(h) else np.uint32)
        owner.append(o.astype(np.int64) + seen)
        keys.append(k)
        sizes.append(np.frombuffer(size, np.int64))
        seen += len(k)
    hashes, owner, keys, sizes = map(np.concatenate, (hashes, owner, keys, sizes))
    unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
    sizes = sizes[first]
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], place[owner[order]]
    shared = np.zeros(len(hashes), bool)
    same = hashes[1:] == hashes[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    hashes, owner = hashes[shared], owner[shared]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    starts = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
    lengths = np.repeat(np.diff(np.append(starts, len(hashes))), np.diff(np.append(starts, len(hashes))))
    keep = lengths > 1
    # the order of shingles: length of the list in powers of two, then hash
    ranked = (np.log2(lengths[keep]).astype(np.uint64) << np.uint64(KEPT_BITS)) | hashes[keep]
    owner = owner[keep]
    order = np.argsort(owner, kind="stable")
    ranked, owner = ranked[order].astype(np.int64), owner[order]
    # classes ascend, so a range of them is a slice
    target = unique[owner] >> (64 - bits) if bits else np.zeros(len(owner), np.int64)
    edges = np.flatnonzero(np.diff(target, prepend=target[:1] - 1))
    ends = np.append(edges[1:], len(owner))[: len(edges)]
    return pd.DataFrame(
        {
            "target": target[edges],
            "class": [unique[owner[a:b]].tobytes() for a, b in zip(edges, ends, strict=True)],
            "n": [sizes[owner[a:b]].tobytes() for a, b in zip(edges, ends, strict=True)],
            "ranked": [ranked[a:b].tobytes() for a, b in zip(edges, ends, strict=True)],
        }
    )


def _searched(parts: DataFrame, num: int, den: int) -> DataFrame:
    """Classes that can have a partner: shared shingles in order, and how many lists are short."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        owner, size, ranked = (
            np.concatenate([np.frombuffer(x, np.int64) for x in group[c]]) for c in ("class", "n", "ranked")
        )
        order = np.lexsort((ranked, owner))
        owner, size, ranked = owner[order], size[order], ranked[order]
        edges = np.flatnonzero(np.diff(owner, prepend=~owner[:1]))
        rows = []
        for a, b in zip(edges, np.append(edges[1:], len(owner))[: len(edges)], strict=True):
            n = int(size[a])
            need = -(-num * n // den)
            if b - a >= need:
                rows.append((owner[a], n, n - (b - a), ranked[a:b].tobytes(), ranked[a : b - need + 1]))
        return pd.DataFrame(rows, columns=["class", "n", "unshared", "ranked", "short"])

    return parts.groupBy("target").applyInPandas(
        run, "class long, n long, unshared long, ranked binary, short array<long>"
    )


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that link: the rest of a's shingles are sought in b's by binary search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, ra, rb in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                x, y = np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (na + nb - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keep, pa.bool_())], ["a", "b", "links"]
            )

    one = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("ranked").alias("ra"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("ranked").alias("rb"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ra", "rb")
    found = joined.mapInArrow(run, "a long, b long, links boolean")
    return found.where("links").select("a", "b")


def _possible(num: int, den: int, a: str, b: str) -> str:
    """Whether two classes may link, given their sizes and unshared shingles."""
    most = f"least({a}.n - {a}.unshared, {b}.n - {b}.unshared)"
    return f"{den} * {most} >= {num} * ({a}.n + {b}.n - {most})"


def _merged(left: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share enough short lists, merged list by list.

    The class of the lesser component seeks in its lists, whose members come in blocks of a
    bounded number, the same classes in the same block of every list.
    """
    longest = left.agg(F.max("len")).head()[0] or 0
    blocks = 1 << (longest // BLOCK).bit_length()
    columns = ["class", "n", "unshared", "last", "comp", "size"]
    held = (
        left.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks))).groupBy("h", "block")
        .agg(*[F.collect_list(c).alias(f"y_{c}") for c in columns])
    )
    seekers = left.where(F.struct("size", "comp") < F.col("top")).select("h", *columns)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        x = group.iloc[0]
        y = {c: np.concatenate(group[f"y_{c}"].to_list()) for c in columns}
        most = np.minimum(x["n"] - x["unshared"], y["n"] - y["unshared"])
        ok = (y["size"] > x["size"]) | ((y["size"] == x["size"]) & (y["comp"] > x["comp"]))
        ok &= den * most >= num * (x["n"] + y["n"] - most)
        other, first, count = np.unique(y["class"][ok], return_index=True, return_counts=True)
        n, last = y["n"][ok][first], y["last"][ok][first]
        # both have all their shingles up to the lesser ``last`` in short lists
        rest = -(-num * np.where(x["last"] <= last, x["n"], n) // den) - 1
        enough = count + rest >= -(-num * (x["n"] + n) // (num + den))
        return pd.DataFrame({"a": x["class"], "b": other[enough]})

    return seekers.join(held, "h").groupBy("class", "block").applyInPandas(merge, "a long, b long")


def class_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(node, component)`` of the classes that link with another one."""
    entries = sets.select(
        "class", "n", "unshared", F.element_at("short", -1).alias("last"), F.explode("short").alias("h")
    )
    central = F.struct((F.col("unshared") / F.col("n")).alias("u"), "class", "n", "unshared")
    lists = entries.groupBy("h").agg(F.count("*").alias("len"), F.min(central).alias("c")).where("len > 1")
    entries = cut(
        entries.alias("e").join(lists.alias("l"), "h").select("e.*", "len", "c")
    )
    stars = (
        entries.alias("e").where("class <> c.class").where(_possible(num, den, "e", "c"))
        .groupBy("class").agg(F.min("c").alias("c")).select(F.col("class").alias("a"), F.col("c.class").alias("b"))
    )
    links = cut(_verified(stars, sets, num, den))
    found = components(links, "a", "b")
    sized = found.join(found.groupBy("component").count(), "component").withColumnRenamed("node", "class")
    marked = cut(
        entries.join(sized, "class", "left").select(
            "h", "class", "n", "unshared", "last",
            F.coalesce("component", "class").alias("comp"), F.coalesce("count", F.lit(1)).alias("size"),
        )
    )
    rank = F.struct("size", "comp")
    apart = (
        marked.groupBy("h").agg(F.max(rank).alias("top"), F.min(rank).alias("low"), F.count("*").alias("len"))
        .where("top <> low").select("h", "top", "len")
    )
    pairs = _merged(cut(marked.join(apart, "h")), num, den)
    more = _verified(pairs, sets, num, den)
    return components(links.unionAll(more), "a", "b")


def ngram_jaccard_join(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs``.

    component_id is the least doc_id of the component. Null text counts as empty; a text
    without words has no shingles and is its own component. A text shorter than n words is
    one shingle. Rows that repeat a doc_id are texts of their own. A null doc_id keeps its row,
    with the component of its text, null if no linked text has an id. No rows give no rows.
    """
    rows = cut(text_classes(docs, doc_id, text, n))
    total = rows.agg(F.sum("n_shingles")).head()[0] or 0
    bits = min(KEPT_BITS - 8, max(0, (total // LIST_POSTINGS).bit_length()))
    lists = _packed(docs, text, n, bits).repartition(
        max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << bits), "bucket"
    )
    parts = lists.groupBy("bucket").applyInPandas(
        lambda group: _meet(group, bits), "target long, class binary, n binary, ranked binary"
    )
    sets = cut(_searched(parts, num, den))
    found = class_links(sets, num, den)
    ids = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    of_class = ids.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "first", F.coalesce("component", "class").alias("component")
    )
    least = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    return (
        rows.join(of_class.join(least, "component").select("class", "component_id"), "class", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
