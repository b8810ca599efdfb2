"""Exact join of documents by the Jaccard similarity of their word n-grams.

Sets are put into size bands. Two sets that link differ in at most ``H`` elements, a number known
for a band; so when each set is dealt into more than ``H`` parts by a hash, some part is the same in
both. Documents of a band with an equal part form a tile. Inside tiles bitmaps of the sets bound the
overlap from above, and only pairs that pass are intersected as sorted arrays.

A tile of near copies is not expanded into pairs. First each member is compared with the member
that shares the most parts with others. Then only members in different components so far are
compared, in blocks, which finds every link that could still join two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import texts
from rasterloom.llm.components import components
from rasterloom.llm.tables import scope, stored

RATIO = 1.5
BITS_MOST = 1 << 13
BLOCK = 4096
PAIRS = 1 << 16


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word windows of each document of a block.

    Fewer words than ``n`` are one window; no word, no window. A-Z count as a-z.
    """
    found = texts.words(data, offsets, lower=True)
    first, grams = texts.windows(found, n)
    cut = np.searchsorted(first, found.bounds)
    out = []
    for i, count in enumerate(found.counts.tolist()):
        if count >= n:
            out.append(np.unique(grams[cut[i] : cut[i + 1]]))
        elif count:
            own = found.hashes[found.bounds[i] : found.bounds[i + 1]]
            whole = (own * texts.powers(count + 1)[1:]).sum(dtype=np.uint64) + np.uint64(count)
            out.append(texts.splitmix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    one = texts.splitmix(grams ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = texts.splitmix(grams ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    mixed = texts.splitmix(np.array([one, two], np.uint64)).view(np.int64)
    return int(mixed[0]), int(mixed[1])


def band_edges(most: int) -> np.ndarray:
    """First sizes of the bands up to ``most``."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, math.floor(edges[-1] * RATIO) + 1))
    return np.array(edges)


def part_signatures(grams: np.ndarray, edges: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of the parts of a set, for its own band and, if it can link into it, the one below.

    In a band up to size ``h``, links are between sets of which one has at most ``h`` elements, and
    differ in at most ``H = h (100 - percent) / percent`` elements. With ``m`` parts, at least
    ``m - H`` are the same in both. Empty parts say little and are left out unless a set has
    ``m - H`` or more of them: then they alone might be the same, so they get signatures too.
    """
    size, found = len(grams), []
    band = int(np.searchsorted(edges, size, "right")) - 1
    for own in (band, band - 1):
        if own < 0 or not size:
            continue
        top = int(edges[own + 1]) - 1
        if own < band and size * percent > top * 100:
            continue
        differ = top * (100 - percent) // percent
        if not differ:  # only equal sets link
            continue
        spare = 1 + math.ceil(2 * (differ + 1) * math.exp(-float(edges[own]) / (differ + 1)))
        parts = differ + 1 + spare
        hashed = texts.splitmix(grams + np.uint64(0x9E3779B97F4A7C15 * (own + 1) & texts.MASK))
        part = (hashed >> np.uint64(20)) % np.uint64(parts)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part.astype(np.int64), texts.splitmix(hashed))
        full = np.bincount(part.astype(np.int64), minlength=parts) > 0
        if parts - int(full.sum()) > spare:
            full[:] = True
        at = np.flatnonzero(full)
        place = texts.splitmix((np.uint64(own) << np.uint64(40)) + at.astype(np.uint64))
        found.append(texts.splitmix(sums[at] ^ place).view(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def bitmap(grams: np.ndarray) -> bytes:
    """Bits of the hashed elements; four to eight times as many bits as elements, 64 at least."""
    width = min(BITS_MOST, max(64, 4 << (max(1, len(grams)) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(texts.splitmix(grams) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps folded to ``width`` bytes, as rows of words."""
    out = np.zeros((len(maps), width), np.uint8)
    for i, held in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(held, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bound on the overlap lets a pair link: a bit in one bitmap only is at least one
    element in one set only."""
    common = a & b
    only_a = np.bitwise_count(a ^ common).sum(1, dtype=np.int64)
    only_b = np.bitwise_count(b ^ common).sum(1, dtype=np.int64)
    return linked(np.minimum(na - only_a, nb - only_b), na, nb, percent)


def linked(overlap, na, nb, percent: int):
    """``100 * intersection >= percent * union``."""
    return 100 * overlap >= percent * (na + nb - overlap)


def digests(df: DataFrame, n: int) -> DataFrame:
    """``uid, doc_id, size, set, twin`` of each row: the size of its set and 128 bits of digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in texts.text_blocks(batch.column("text")):
                sets = shingles(data, offsets, n)
                one, two = zip(*[set_digest(s) for s in sets], strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "uid": batch.column("uid").slice(first, last - first),
                        "doc_id": batch.column("doc_id").slice(first, last - first),
                        "size": pa.array([len(s) for s in sets], pa.int64()),
                        "set": pa.array(one, pa.int64()),
                        "twin": pa.array(two, pa.int64()),
                    }
                )

    return df.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, size long, set long, twin long")


def postings(df: DataFrame, n: int, percent: int) -> DataFrame:
    """``tile, set``: every signature of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = band_edges(1 << 31)
        for batch in batches:
            for _, _, data, offsets in texts.text_blocks(batch.column("text")):
                sets = shingles(data, offsets, n)
                parts = [part_signatures(s, edges, percent) for s in sets]
                digest = np.array([set_digest(s)[0] for s in sets], np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "tile": pa.array(np.concatenate(parts)),
                        "set": pa.array(np.repeat(digest, [len(p) for p in parts])),
                    }
                )

    return df.select("text").mapInArrow(run, "tile long, set long")


def tiles(df: DataFrame, n: int, percent: int) -> DataFrame:
    """``tile, set``: the sets that share a part with another set, once each.

    Signatures are made twice, for the list of shared ones and for their members, and stored never.
    """
    sides = postings(df, n, percent).groupBy("tile").agg(F.min("set").alias("lo"), F.max("set").alias("hi"))
    shared = stored(sides.where("lo <> hi").select("tile"), "shared-tiles")
    return stored(postings(df, n, percent).join(shared, "tile").distinct(), "tiles")


def _sets(df: DataFrame, n: int) -> DataFrame:
    """``node, size, grams, bits`` of rows (node, set, text): elements and bitmap of the text's set,
    where it is the one with that digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("set").to_pylist()
            for first, last, data, offsets in texts.text_blocks(batch.column("text")):
                sets = shingles(data, offsets, n)
                own = [i for i, s in enumerate(sets) if set_digest(s)[0] == wanted[first + i]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": batch.column("node").slice(first, last - first).take(pa.array(own, pa.int64())),
                        "size": pa.array([len(sets[i]) for i in own], pa.int64()),
                        "grams": pa.array([sets[i].tobytes() for i in own], pa.binary()),
                        "bits": pa.array([bitmap(sets[i]) for i in own], pa.binary()),
                    }
                )

    return df.select("node", "set", "text").mapInArrow(run, "node long, size long, grams binary, bits binary")


def _bounded(percent: int):
    """Keeps the pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            maps_a, maps_b = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b"))
            width = np.minimum([len(m) for m in maps_a], [len(m) for m in maps_b])
            keep = np.zeros(batch.num_rows, bool)
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                for i in range(0, len(rows), PAIRS):
                    own = rows[i : i + PAIRS]
                    a, b = (folded([m[k] for k in own], int(w)) for m in (maps_a, maps_b))
                    keep[own] = may_link(a, b, na[own], nb[own], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _intersected(percent: int):
    """Keeps the pairs (a, b) that link, by their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                one, two = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                at = np.searchsorted(two, one)
                overlap = int((two[np.minimum(at, len(two) - 1)] == one).sum())
                keep.append(bool(linked(overlap, len(one), len(two), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with columns of the sets of both sides; a repeated row's set counts once."""
    for side in ("a", "b"):
        one = sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(one.dropDuplicates([side]), side)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersections; only the sets of pairs are moved twice."""
    pairs = stored(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    used = stored(sets.select("node", "grams").join(ends, "node", "left_semi").dropDuplicates(["node"]), "used-sets")
    return _beside(pairs, used, ["grams"]).select("a", "b", "grams_a", "grams_b").mapInArrow(
        _intersected(percent), "a long, b long"
    )


def _across(percent: int):
    """Pairs in different components of each run of (tile, block) that their bitmaps allow."""

    def pairs_of(node, component, size, maps, block, split) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = min(len(m) for m in maps)
        words, n = folded(maps, width), len(node)
        step = max(1, PAIRS // n)
        for i in range(0, n, step):
            row = np.repeat(np.arange(i, min(n, i + step)), n)
            column = np.tile(np.arange(n), min(n, i + step) - i)
            fits = (column > row) & (component[row] != component[column])
            fits &= linked(np.minimum(size[row], size[column]), size[row], size[column], percent)
            if split:  # pairs inside one block are compared where it meets itself
                fits &= block[row] != block[column]
            row, column = row[fits], column[fits]
            if len(row):
                fits = may_link(words[row], words[column], size[row], size[column], percent)
                yield node[row[fits]], node[column[fits]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows).combine_chunks()
            held = {c: table.column(c).to_numpy() for c in ("tile", "one", "two", "node", "component", "size", "block")}
            maps = table.column("bits").to_pylist()
            new = np.ones(len(maps), bool)
            new[1:] = np.any([held[c][1:] != held[c][:-1] for c in ("tile", "one", "two")], axis=0)
            edges = np.append(np.flatnonzero(new), len(maps)).tolist()
            seen: set[tuple[int, int]] = set()
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                own = slice(first, last)
                split = held["one"][first] != held["two"][first]
                for a, b in pairs_of(
                    held["node"][own], held["component"][own], held["size"][own], maps[own], held["block"][own], split
                ):
                    lo, hi = np.minimum(a, b), np.maximum(a, b)
                    seen.update(zip(lo.tolist(), hi.tolist(), strict=True))
            if seen:
                a, b = zip(*seen, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        waiting: list[pa.RecordBatch] = []
        for batch in batches:  # a run may go on in the next batch
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("tile", "one", "two")]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if waiting and any(w.as_py() != k[0] for w, k in zip((waiting[-1].column(c)[-1] for c in ("tile", "one", "two")), keys, strict=True)):
                yield from finished(waiting)
                waiting = []
            if cut:
                yield from finished([*waiting, batch.slice(0, cut)])
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield from finished(waiting)

    return run


def across_components(members: DataFrame, sets: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a tile, lie in different components and may link.

    ``members`` has ``tile, node``, ``joined`` the components so far. Tiles inside one component go.
    A tile of over ``BLOCK`` members is cut into blocks, and each two blocks meet in a task.
    """
    placed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("tile").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")
    )
    mixed = mixed.where("lo <> hi").select("tile", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = (
        placed.join(mixed, "tile")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(sets.select("node", "size", "bits").dropDuplicates(["node"]), "node")
        .select("tile", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component", "size", "bits")
    )
    keys = ["tile", "one", "two"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_across(percent), "a long, b long").distinct()


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, numbered: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``df``.

    Two rows link when their sets of ``n``-word shingles (A-Z as a-z, words ``[^\\x20\\x09-\\x0D]+``;
    fewer words are one shingle) have a Jaccard similarity of ``percent`` or more, and a component's
    id is the smallest ``doc_id`` that links lead to. Null or empty texts and texts without words
    have no shingles and stand alone, as do rows without near duplicates. Rows are told by a stored
    number, so repeated ids and rows without one lose no links; a component's id is null only where all its
    rows are without one. ``numbered`` says that ``doc_id`` is such a number already (of a stored
    table, unique, never null). Rows with equal sets are one set with a list of rows, whatever their
    number; repeated rows stay. No link is lost but by a collision of 64-bit hashes.
    """
    with scope(df.sparkSession):
        docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if numbered:
            docs = docs.withColumn("uid", F.col("doc_id"))
        else:
            docs = stored(docs.withColumn("uid", F.monotonically_increasing_id()), "numbered")
        sketch = stored(digests(docs, n), "digests", outlives=True)
        members = tiles(docs, n, percent)
        sizes = members.groupBy("tile").agg(F.count("*").alias("n"))
        hubs = members.join(sizes, "tile").groupBy("set").agg(F.sum("n").alias("hub"))
        nodes = stored(
            hubs.orderBy("hub", "set").select("set", F.monotonically_increasing_id().alias("node")), "nodes"
        )  # the larger the node, the more it shares
        members = stored(members.join(nodes, "set").select("tile", "node"), "members")
        owners = sketch.where("size > 0").groupBy("set", "twin", "size")
        owners = owners.agg(F.min("uid").alias("uid"), F.min("doc_id").alias("doc_id"))
        wanted = owners.join(nodes, "set").select("uid", "node", "set")
        sets = stored(_sets(docs.join(wanted, "uid"), n), "sets")

        centres = members.groupBy("tile").agg(F.max("node").alias("a"))
        stars = members.join(centres, "tile").where("node <> a").select("a", F.col("node").alias("b")).distinct()
        allowed = _beside(stars, sets, ["size", "bits"]).select("a", "b", "size_a", "size_b", "bits_a", "bits_b")
        links = stored(verified(allowed.mapInArrow(_bounded(percent), "a long, b long"), sets, percent), "links")
        joined = components(links)
        more = stored(verified(across_components(members, sets, joined, percent), sets, percent), "links")
        joined = components(
            joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        )

        grouped = owners.join(nodes, "set").join(joined, "node")
        least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = grouped.join(least, "component").select("set", "twin", "size", "component_id")
        owners = owners.join(named, ["set", "twin", "size"], "left").select(
            "set", "twin", "size", F.coalesce("component_id", "doc_id").alias("component_id")
        )
        owners = stored(owners, "owners", outlives=True)
    return sketch.join(owners, ["set", "twin", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


#: The same by joining all shingles; components by walking the links.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) END) AS g FROM t),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= {percent} * (cx.n + cy.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.x, r.m FROM e JOIN r ON r.doc_id = e.y)
SELECT r.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM r LEFT JOIN c ON c.doc_id = r.doc_id GROUP BY r.doc_id
"""


def sql(n: int, percent: int) -> str:
    """SQL for ``near_duplicates`` over ``documents`` with distinct ids."""
    return SQL.replace("{n}", str(n)).replace("{percent}", str(percent))
