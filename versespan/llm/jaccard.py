"""N-gram Jaccard join: texts whose sets of word shingles are at least 80 % alike.

Equal sets are one class. Two sets as alike as that share one of the first fifth of their
shingles in any common order; the order used puts frequent shingles last, so that a line or
passage that many texts hold does not bring them together. Classes that share such a shingle
meet in tiles of one shingle and one band of sizes (a band's classes and those of the band
below); in a tile, bitmap signatures bound the overlap of two sets from above, and the pairs
that remain are decided by intersecting the sorted sets themselves.

Only components are wanted, so not every pair of a large group is looked at: first each component
(at the start: class) tries one class, the hub of a shingle and tile of its own, and what that links
becomes a component, for ``STAR_ROUNDS`` rounds. So a round has one link per class at most,
however large a group is. Tiles then hold shingles with more than one component, and only
pairs of different components are tried there: first one of each two components, then those
whose components are still apart. No link between components is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versespan.llm.common import as_bytes, spare_name, text_blocks
from versespan.llm.shingles import mixed, shingle_sets
from versespan.session import materialize

PERCENT = 80
MAX_FREQUENT = 500_000       # frequent shingles at most, 8 bytes each, sent to all tasks
LEAST_FREQUENT = 64
COUNTED_AT_ONCE = 2_000_000  # shingles counted together in a task
LEAST_SEEN = 3               # of those, shingles seen less often are not reported
STAR_ROUNDS = 1          # more rounds cost more shuffle than the pairs that they save
TILE_ROWS = 1024
BROADCAST_IDS = 1_000_000
MARKS = 1 << 20              # places of the filter for texts that are needed
BANDS = 1.26                 # sizes of linked sets differ by less than this factor
WIDTHS = ((128, 128), (512, 512), (2048, 2048), (8192, 8192), (1 << 62, 16384))
NEIGHBOURS = 32              # classes of a shingle tried with each other before it is sent on
LINKS_AT_ONCE = 1 << 18      # links that one task brings together, 4 MB
FIRST = 4                    # shingles of a prefix by which a pair met twice is recognised


def prefix_length(n: int) -> int:
    """Two sets as alike as asked share one of this many first shingles."""
    return n - (PERCENT * n + 99) // 100 + 1 if n > 3 else 0


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity of how many shingles fall on each bit, as 64-bit words; wider for larger sets."""
    width = next(bits for most, bits in WIDTHS if len(shingles) <= most)
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of more words brought to ``words``; parities fold by exclusive or."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _class_of(shingles: np.ndarray) -> int:
    total = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def report() -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(held), return_counts=True)
        often = seen >= LEAST_SEEN
        return pa.RecordBatch.from_arrays(
            [pa.array([None, *tokens[often].view(np.int64)], pa.int64()),
             pa.array([size, *seen[often]], pa.int64())], ["token", "seen"])

    for batch in batches:
        for block in text_blocks(batch.column(0)):
            for own in shingle_sets(*as_bytes(block)):
                held.append(own)
                size += len(own)
            if size >= COUNTED_AT_ONCE:
                yield report()
                held, size = [], 0
    if held:
        yield report()


def frequent_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of many documents, sorted; which ones only steers the work, not the result.

    Counted over all documents in stretches of two million shingles. A shingle is frequent if
    its counts come to 1/500,000 of all shingles (64 at least), so there are at most 500,000.
    """
    counted = materialize(docs.select(F.col(text)).mapInArrow(
        _count_frequent, "token bigint, seen bigint"), "frequent")
    total = counted.filter(F.col("token").isNull()).agg(F.sum("seen")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // MAX_FREQUENT))
    rows = counted.filter(F.col("token").isNotNull()).groupBy("token").agg(
        F.sum("seen").alias("seen")).filter(F.col("seen") >= least).select("token")
    tokens = rows.toArrow().column("token").to_numpy().astype(np.int64).view(np.uint64)
    return np.sort(tokens)


def profiles(docs: DataFrame, text: str, frequent) -> DataFrame:
    """Per row ``doc_id, class, n, bitmap, prefix, lights``: the size and class of its set, and
    its prefix, of which the first ``lights`` shingles are infrequent. ``frequent`` is a
    broadcast sorted array."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            place = 0
            for block in text_blocks(batch.column(1)):
                classes, sizes, maps, prefixes, lights = [], [], [], [], []
                for own in shingle_sets(*as_bytes(block)):
                    classes.append(_class_of(own) if len(own) else None)
                    sizes.append(len(own))
                    maps.append(bitmap(own).tobytes())
                    most = prefix_length(len(own))
                    if len(often) and len(own):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        is_heavy = often[at] == own
                    else:
                        is_heavy = np.zeros(len(own), bool)
                    rare = own[~is_heavy][:most]
                    prefixes.append(np.concatenate(
                        [rare, own[is_heavy][:most - len(rare)]]).view(np.int64))
                    lights.append(len(rare))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(place, len(block)), pa.array(classes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()),
                     pa.array(prefixes, pa.list_(pa.int64())), pa.array(lights, pa.int32())],
                    ["doc_id", "class", "n", "bitmap", "prefix", "lights"])
                place += len(block)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, class bigint, n bigint, bitmap binary, prefix array<bigint>, "
             "lights int")


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Batches of sorted rows cut so that rows equal in the first ``columns`` stay together."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(i).to_numpy() for i in range(columns)]
        change = np.zeros(max(len(table) - 1, 0), bool)
        for key in keys:
            change |= key[1:] != key[:-1]
        cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def _may_meet(n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of one shingle: whether sizes and the shingle's places in both prefixes
    leave room for the overlap asked for."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    least = -(-PERCENT * (n[a] + n[b]) // (100 + PERCENT))
    return (100 * small >= PERCENT * large) & (n[a] - pos[a] >= least) & (n[b] - pos[b] >= least)


def _with_partner(key: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key and size, have another row of their key that they may meet.

    Rows up to ``NEIGHBOURS`` apart are tried; rows of a key with more than that are kept if the
    row next in size is near enough, as then one further away may be, too.
    """
    fine, at = np.zeros(len(key), bool), np.arange(len(key))
    for step in range(1, NEIGHBOURS + 1):
        a = at[:-step][key[step:] == key[:-step]]
        a = a[100 * n[a] >= PERCENT * n[a + step]]
        if not len(a):
            return fine
        a = a if step == NEIGHBOURS else a[_may_meet(n, pos, a, a + step)]
        fine[a] = fine[a + step] = True
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    counts = np.diff(np.append(first, len(key)))
    near = np.zeros(len(key), bool)
    next_to = (key[1:] == key[:-1]) & (100 * n[:-1] >= PERCENT * n[1:])
    near[:-1] |= next_to
    near[1:] |= next_to
    return fine | (near & np.repeat(counts > NEIGHBOURS, counts))


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class: each class of a key once, if another class of the key
    may be linked to it by their sizes and the key's places in their prefixes."""
    for table in _runs(batches, 1):
        key, own, n, pos = (table.column(i).to_numpy() for i in range(4))
        new_key = np.append(True, key[1:] != key[:-1])
        rows = np.flatnonzero(new_key | np.append(True, own[1:] != own[:-1]))
        rows = rows[np.lexsort((n[rows], key[rows]))]
        rows = rows[_with_partner(key[rows], n[rows], pos[rows].astype(np.int64))]
        if len(rows):
            yield from table.take(pa.array(rows)).to_batches()


def shared_shingles(profile: DataFrame) -> DataFrame:
    """``key, class, n, pos, band``: prefix shingles that several classes have, and their place in
    the prefix. Infrequent ones are found by sorting; frequent ones are kept as they are, as
    one of them may be very common."""
    known = profile.filter(F.col("n") > 3)
    each = known.select("class", "n", "lights", F.posexplode("prefix").alias("pos", "key"))
    columns = ["key", "class", "n", "pos"]
    light = each.filter(F.col("pos") < F.col("lights")).select(*columns) \
        .repartition("key").sortWithinPartitions("key", "class") \
        .mapInArrow(_shared_rows, "key bigint, class bigint, n bigint, pos int")
    heavy = each.filter(F.col("pos") >= F.col("lights")).select(*columns).distinct()
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(BANDS)))
    return materialize(light.unionByName(heavy).withColumn("band", band), "shared")


def _bound_holds(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether so many differing bits leave room for the overlap asked for.

    The sets differ in at least ``differ`` shingles, so they share at most half the rest.
    """
    most = (n_a + n_b - differ) // 2
    return 100 * most >= PERCENT * (n_a + n_b - most)


def _may_link(sizes: np.ndarray, maps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows: whether sizes and bitmaps allow the link."""
    words = np.array([len(m) // 8 for m in maps])
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    fine = 100 * small >= PERCENT * large
    least = np.minimum(words[a], words[b])
    for width in np.unique(least[fine]):
        picked = np.flatnonzero(fine & (least == width))
        used, place = np.unique(np.concatenate([a[picked], b[picked]]), return_inverse=True)
        table = np.empty((len(used), width), np.uint64)
        for own in np.unique(words[used]):
            rows = np.flatnonzero(words[used] == own)
            table[rows] = folded(np.frombuffer(
                b"".join([maps[r] for r in used[rows]]), np.uint64).reshape(-1, own), width)
        left, right = place[:len(picked)], place[len(picked):]
        for first in range(0, len(picked), 1 << 17):
            part = slice(first, first + (1 << 17))
            differ = np.bitwise_count(table[left[part]] ^ table[right[part]]).sum(
                axis=1, dtype=np.int64)
            chosen = picked[part]
            fine[chosen] = _bound_holds(sizes[a[chosen]], sizes[b[chosen]], differ)
    return fine


def _filter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, n_a, n_b, map_a, map_b`` and others, which are returned with the pairs ``a, b``
    whose sizes and bitmaps allow a link."""
    for batch in batches:
        n = batch.num_rows
        if n:
            sizes = np.concatenate([batch.column(i).to_numpy() for i in (2, 3)])
            maps = batch.column(4).to_pylist() + batch.column(5).to_pylist()
            fine = _may_link(sizes, maps, np.arange(n), np.arange(n) + n)
            names = ["a", "b", *batch.schema.names[6:]]
            yield batch.select(names).filter(pa.array(fine))


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components inside the tiles of sorted rows.

    Rows: ``key, tile, i, j, class, n, pos, root, band, chunk, first, bitmap``. Two classes meet
    in the tile of the larger band (or their own), and in the tile pair of their chunks. They
    share a shingle so early in both prefixes that the rest leaves room for the overlap, and
    they are tried only where they first meet, as far as their first shingles tell.
    """
    for table in _runs(batches, 4):
        key, tile, i, j, own, n, pos, root, band, chunk = (
            table.column(c).to_numpy() for c in range(10))
        head = np.frombuffer(b"".join(table.column(10).to_pylist()), np.int64).reshape(-1, FIRST)
        maps = table.column(11).to_pylist()
        change = np.zeros(len(key) - 1, bool)
        for c in (key, tile, i, j):
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(key)]])
        found_a, found_b, held = [], [], 0

        def decided(left: list, right: list) -> Iterator[pa.RecordBatch]:
            a, b = np.concatenate(left), np.concatenate(right)
            early = _may_meet(n, pos, a, b)
            a, b = a[early], b[early]
            met = np.zeros(len(a), bool)
            for x in range(FIRST):
                for y in range(FIRST):
                    met |= ((head[a, x] == head[b, y]) & (head[a, x] != 0)
                            & (x < pos[a]) & (y < pos[b]))
            a, b = a[~met], b[~met]
            fine = _may_link(n, maps, a, b)
            a, b = own[a[fine]], own[b[fine]]
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if last - first < 2:
                continue
            a, b = np.triu_indices(last - first, 1)
            a, b = a + first, b + first
            meet = (root[a] != root[b]) & ((band[a] == tile[a]) | (band[b] == tile[a]))
            meet &= ((chunk[a] == i[a]) & (chunk[b] == j[a])) | (
                (chunk[a] == j[a]) & (chunk[b] == i[a]))
            if meet.any():
                found_a.append(a[meet])
                found_b.append(b[meet])
                held += len(found_a[-1])
            if held > 1 << 20:
                yield from decided(found_a, found_b)
                found_a, found_b, held = [], [], 0
        if found_a:
            yield from decided(found_a, found_b)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``a, b, text_a, text_b``: the pairs whose sorted sets are alike enough."""
    for batch in batches:
        links = []
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            sides = [[own for block in text_blocks(part.column(c))
                      for own in shingle_sets(*as_bytes(block))] for c in (2, 3)]
            for x, y in zip(*sides, strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        if links:
            yield batch.select(["a", "b"]).filter(pa.array(links))


class Texts:
    """One text per class, fetched for the classes that pairs name."""

    def __init__(self, docs: DataFrame, text: str):
        self.docs, self.text = docs.select(F.col(text).alias("text")), text

    def of(self, classes: DataFrame) -> DataFrame:
        """``class, text`` of the classes asked for, and of some others.

        Texts that can not be needed are left out where they are read, by a filter of a million
        places, which is all that comes to the driver; a full filter only lets more through.
        """
        marks = classes.select(F.pmod("class", F.lit(MARKS)).cast("int").alias("m")) \
            .distinct().toArrow().column("m").to_numpy()
        wanted = np.zeros(MARKS, bool)
        wanted[marks] = True
        wanted = np.packbits(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.unpackbits(wanted).astype(bool)
            for batch in batches:
                for block in text_blocks(batch.column(0)):
                    own = [_class_of(s) if len(s) else None
                           for s in shingle_sets(*as_bytes(block))]
                    keep = np.array([c is not None and flags[c % MARKS] for c in own], bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64()).filter(pa.array(keep)),
                         block.filter(pa.array(keep)).cast(pa.string())], ["class", "text"])

        return self.docs.mapInArrow(run, "class bigint, text string").groupBy("class").agg(
            F.first("text").alias("text"))


def _decided(pairs: DataFrame, named: DataFrame) -> DataFrame:
    both = pairs.join(named.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(named.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(
        _exact, "a bigint, b bigint"), "links")


def _texts_of(pairs: DataFrame, texts: Texts) -> DataFrame:
    return materialize(texts.of(pairs.select(F.explode(F.array("a", "b")).alias("class"))), "texts")


def links_among(pairs: DataFrame, texts: Texts) -> DataFrame:
    """The pairs ``a, b`` of classes that are linked, decided by their texts."""
    pairs = materialize(pairs, "pairs")
    return _decided(pairs, _texts_of(pairs, texts))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes have different roots, with these as ``low`` and ``high``."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(
            f"root_{side}")), side, "left").withColumn(
                f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.filter(F.col("root_a") != F.col("root_b")).select(
        "a", "b", F.least("root_a", "root_b").alias("low"),
        F.greatest("root_a", "root_b").alias("high"))


def links_between(pairs: DataFrame, roots: DataFrame, texts: Texts) -> list[DataFrame]:
    """Links among the pairs ``a, b`` that bring the components of ``roots`` together: one pair of
    each two components is decided first, then those that are still of different components."""
    pairs = materialize(pairs, "pairs")
    named = _texts_of(pairs, texts)
    once = materialize(_apart(pairs, roots).groupBy("low", "high").agg(
        F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b"), "once")
    links = _decided(once, named)
    known = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    left = _apart(pairs, components(known)).select("a", "b").join(once, ["a", "b"], "left_anti")
    return [links, _decided(left, named)]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of all links ``a, b`` of a task: each root hands the least root it meets to
    those it meets, until none is left to meet."""
    rows = [np.stack([batch.column(i).to_numpy() for i in (0, 1)]) for batch in batches]
    if not rows:
        return
    nodes, place = np.unique(np.concatenate(rows, axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``a, b``: root is the component's least node.

    Up to ``LINKS_AT_ONCE`` links are brought together by one task, which saves the driver the
    plans of all rounds. For more, large stars and small stars in turn: each node hands its larger
    neighbours, then its smaller ones, to the least it knows. Minima are taken with map-side
    combining and every round is written out; the rounds grow with the logarithm of the longest
    chain.
    """
    links = links.filter(F.col("a") != F.col("b")).select("a", "b")
    if links.limit(LINKS_AT_ONCE + 1).count() <= LINKS_AT_ONCE:
        return materialize(links.coalesce(1).mapInArrow(_roots, "node bigint, root bigint"), "roots")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.unionByName(
            edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        large = large.filter(F.col("u") != F.col("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).filter(
            F.col("u") != F.col("v")).distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_maps(pairs: DataFrame, maps: DataFrame, *others: str) -> DataFrame:
    left = maps.select(F.col("class").alias("a"), F.col("n").alias("n_a"),
                       F.col("bitmap").alias("map_a"))
    right = maps.select(F.col("class").alias("b"), F.col("n").alias("n_b"),
                        F.col("bitmap").alias("map_b"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "n_a", "n_b", "map_a", "map_b", *others)


def _class_maps(profile: DataFrame) -> DataFrame:
    """``class, n, bitmap, first``: per class the first shingles of its prefix as bytes, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for prefix in batch.column(3):
                own = np.zeros(FIRST, np.int64)
                values = prefix.values.to_numpy()[:FIRST]
                own[:len(values)] = values
                heads.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(heads, pa.binary())],
                ["class", "n", "bitmap", "first"])

    known = profile.filter(F.col("n") > 3).select("class", "n", "bitmap", "prefix")
    return known.mapInArrow(run, "class bigint, n bigint, bitmap binary, first binary") \
        .groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "bitmap", "first")])


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of shared shingles with the root of their class, so far as links are known."""
    rooted = shared.join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
    return materialize(rooted.withColumn("root", F.coalesce("root", "class")), "rooted")


def _in_tiles(rooted: DataFrame) -> DataFrame:
    """Each row in the tile of its band and in that of the band above."""
    return rooted.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))


def star_pairs(rooted: DataFrame, maps: DataFrame) -> DataFrame:
    """For each root one pair to try, with the hub of a shingle and tile of one of its classes: of
    the hubs of another root that may be linked by the bitmaps, the one whose shingle comes first.

    A hub is the class in whose prefix the shingle comes first. It has the fewest rare shingles
    before it, so in a group of copies it is close to what they were copied from.
    """
    tiles = _in_tiles(rooted)
    hubs = tiles.groupBy("key", "tile").agg(
        F.min(F.struct("pos", "class", "root", "n")).alias("hub"),
        F.min("root").alias("low"), F.max("root").alias("high"))
    hubs = hubs.filter(F.col("low") != F.col("high")).select(
        "key", "tile", F.col("hub.pos").alias("at"), F.col("hub.class").alias("a"),
        F.col("hub.root").alias("to"), F.col("hub.n").alias("n_a"))
    near = PERCENT * F.greatest("n", "n_a") <= 100 * F.least("n", "n_a")
    pairs = tiles.join(hubs, ["key", "tile"]).filter((F.col("root") != F.col("to")) & near).groupBy(
        "a", F.col("class").alias("b"), "root").agg(F.min("at").alias("at"))
    fine = _with_maps(pairs, maps, "at", "root").mapInArrow(
        _filter_pairs, "a bigint, b bigint, at int, root bigint")
    return fine.groupBy("root").agg(F.min(F.struct("at", "a", "b")).alias("p")).select("p.a", "p.b")


def tile_pairs(rooted: DataFrame, maps: DataFrame) -> DataFrame:
    """Pairs of different components that share a shingle, where sizes and bitmaps allow a link.

    Tiles of one component are left out before any row is sent to them, and tiles of two classes
    are pairs as they are. A tile of more than ``TILE_ROWS`` classes is split into chunks whose
    pairs are tiles of their own, so none grows with the table. A shingle has no more tiles
    than there are bands.
    """
    one = F.struct("class", "n")
    kinds = _in_tiles(rooted).groupBy("key", "tile").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"),
        F.min(one).alias("x"), F.max(one).alias("y"), F.max("band").alias("top"))
    kinds = materialize(kinds.filter((F.col("low") != F.col("high")) & (
        F.col("top") == F.col("tile"))), "kinds")
    near = 100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")
    twos = kinds.filter((F.col("rows") == 2) & near).select(
        F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    twos = _with_maps(twos, maps).mapInArrow(_filter_pairs, "a bigint, b bigint")

    tiles = kinds.filter(F.col("rows") > 2).groupBy("key").agg(F.collect_list(F.struct(
        "tile", F.ceil(F.col("rows") / TILE_ROWS).alias("chunks"))).alias("tiles"))
    rows = rooted.join(tiles, "key").withColumn("t", F.explode(F.filter(
        "tiles", lambda t: t["tile"].isin(F.col("band"), F.col("band") + 1)))).drop("tiles")
    rows = rows.join(maps.select("class", "first", "bitmap"), "class").select(
        "*", "t.tile", F.pmod(F.xxhash64("class"), F.col("t.chunks")).alias("chunk"))
    rows = rows.withColumn("other", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("t.chunks") - 1)))
    rows = rows.select("key", "tile", F.least("chunk", "other").alias("i"),
                       F.greatest("chunk", "other").alias("j"), "class", "n", "pos", "root",
                       "band", "chunk", "first", "bitmap")
    tiles = rows.repartition("key", "tile", "i", "j").sortWithinPartitions("key", "tile", "i", "j")
    return tiles.mapInArrow(_tile_pairs, "a bigint, b bigint").unionByName(twos).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    NULL and empty texts and texts without words have no shingles and are a component of their
    own. Rows that repeat an id each link for themselves, by their own text, and may be in
    different components; each is returned once, with its own size. A row with a NULL id has a NULL component
    (but links others). Other columns are ignored; an empty table gives no rows. Sets are
    compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, "text"))
    profile = materialize(profiles(rows, "text", frequent), "profiles")
    shared = shared_shingles(profile)
    maps = materialize(_class_maps(profile), "maps")
    texts = Texts(rows, "text")
    rooted, links = shared.withColumn("root", F.col("class")), []
    for _ in range(STAR_ROUNDS):
        links.append(links_among(star_pairs(rooted, maps), texts))
        roots = components(reduce(DataFrame.unionByName, links))
        rooted = with_roots(shared, roots)
    links += links_between(tile_pairs(rooted, maps), roots, texts)
    roots = components(reduce(DataFrame.unionByName, links))
    return _labelled(profile, roots).withColumnRenamed("doc_id", doc_id)


def _labelled(profile: DataFrame, roots: DataFrame) -> DataFrame:
    """Every row with the least id of its component: classes that share a root. An id
    does not link its rows."""
    root = F.coalesce(F.col("root"), F.col("class")).alias("root")
    owned = profile.select("doc_id", "class", "n").join(
        roots.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", root)
    least = owned.filter(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("doc_id").alias("least"))
    return owned.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document is the first of its component, all columns as they are. Rows
    with a NULL id stay, and so do all rows of a repeated id that stays; an id goes with all
    its rows if one of them is a copy.

    The ids that go are sent to all tasks up to a million of them, so that texts need not move;
    beyond that both sides are shuffled.
    """
    labels, copy = near_duplicates(docs, doc_id, text), spare_name(docs, "_copy")
    copies = materialize(labels.filter(F.col("component_id") < F.col("doc_id")).select(
        F.col("doc_id").alias(copy)).distinct(), "copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    return docs.join(copies, F.col(doc_id) == F.col(copy), "left_anti")
