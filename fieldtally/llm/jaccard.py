"""Near-duplicate join on word n-gram Jaccard similarity, with a count-vector R-tree.

1. Every text's set of hashed shingles is made in numpy. Texts of equal sets are one class from there on.
2. A class's rarest shingles (by a fixed-size table of hashed counts over the corpus) are its prefix; two sets that are
   similar enough share a prefix shingle. Classes that share one form a block. Blocks deal the work out; in them:
3. First each member is compared with its block's first one; the links found join most copies into components.
4. In blocks that still hold several components, members are points: shingles hashed into GROUPS groups, counted. An
   R-tree over the points bounds the overlap of two nodes, and of two points, by the summed minima of their
   coordinates; only pairs of different components that pass the bound are left. The upper nodes of a large block's tree
   hold CELL points or so, cut along the sets' sizes and their leading coordinates; pairs of such nodes are dealt to tasks.
5. Every pair left is verified on the whole sets. Links between classes give the components.

A tree over the whole corpus would compare nearly all its leaves: the vectors of unrelated texts of like length lie
close together. So the prefix decides which points share a tree, and no pair is lost, as it has no false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import SPACE, beside_counted, documents, materialize, mix, only_ids, slices, text_bytes, unsigned_to_long, word_hashes
from fieldtally.llm.components import components
from fieldtally.llm.repeats import known_twice

WORDS = 5
#: Similarity from which two sets link, in hundredths.
PERCENT = 80
#: Cells of the table of shingle counts that orders shingles from rare to frequent.
CELLS = 1 << 16
#: Coordinates of a point.
GROUPS = 256
#: Coordinates of the coarse points that are looked at first: sums of neighbouring ones.
COARSE = 64
#: The greatest coordinate. Beyond sets so large that two may exceed it, the bound is left out.
TOP = (1 << 15) - 1
#: Points of an R-tree leaf, and children of a node.
LEAF = 64
#: Points of a node that a task takes whole: larger blocks are dealt out by pairs of nodes.
CELL = 512
#: Rows of prefixes that are looked through together for shingles that repeat.
TOGETHER = 150_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of every row; a row of fewer words has one shingle, of all of them."""
    hashes, _, _, rows = word_hashes(raw, offsets, SPACE == 0)
    n_rows = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    long = max(0, len(hashes) - words + 1)
    rolled = np.zeros(long, np.uint64)
    for i in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + long]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            x = np.array([b - a], np.uint64)
            for i in range(a, b):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(shingles: np.ndarray) -> int:
    """64 bits of a set; classes also differ in their sizes."""
    if not len(shingles):
        return 0
    return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) ^ (mix(shingles + np.uint64(0x51ED2701)).sum(dtype=np.uint64) << np.uint64(1))]) + np.uint64(len(shingles))).view(np.int64)[0])


def _each_set(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        raw, offsets = text_bytes(batch.column("text"))
        for a, b in slices(np.diff(offsets)):
            yield ids[a:b], shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def survey(docs: DataFrame, words: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, digest of each document; and a cell of the count table with its count (n) for each
    task, where doc_id is null and digest is the cell."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names, seen = ["doc_id", "n", "digest"], set()
        for ids, sets in _each_set(batches, words):
            digests, fresh = [set_digest(x) for x in sets], []
            for d, x in zip(digests, sets, strict=True):
                if d not in seen:
                    seen.add(d)
                    fresh.append(x)
            if fresh:
                cells += np.bincount((np.concatenate(fresh) >> np.uint64(48)).astype(np.int64), minlength=CELLS)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.int64())], names)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(cells[at]), pa.array(at)], names)

    return documents(docs).where("doc_id IS NOT NULL").mapInArrow(look, "doc_id long, n long, digest long")


def prefix_length(n: int, percent: int) -> int:
    """So many smallest elements of a set of n: sets that are similar enough share one of them."""
    return n - -(-percent * n // 100) + 1


def reorder(shingles: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles renamed, one to one, so that those of rarer cells are smaller."""
    return np.sort((rank[(shingles >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | (shingles & np.uint64((1 << 48) - 1)))


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of a and b elements that links them."""
    return -(-percent * (a + b) // (100 + percent))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, parts: np.ndarray, percent: int, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of different parts (and of different sides, where there are two) that may link: descends a
    bulk-loaded R-tree from pairs of nodes to pairs of points, and leaves out what the summed minima of coordinates
    exclude."""
    two = sides is not None
    sides = sides if two else np.arange(len(sizes))
    order = np.lexsort((points.argmax(1), sizes, sides) if two else (points.argmax(1), sizes))
    fine, sizes, parts, sides = points[order], sizes[order], parts[order], sides[order]
    points = fine.reshape(len(fine), COARSE, -1).sum(2, dtype=np.int32)
    n = len(sizes)
    only = lambda xs, a, b: xs[a] if (xs[a:b] == xs[a]).all() else -1
    # levels[0] are the leaves; of each node the largest coordinates, the range of sizes, and the one part and side if it is one
    levels, at = [], [(i, min(i + LEAF, n)) for i in range(0, n, LEAF)]
    tops = np.array([points[a:b].max(0) for a, b in at])
    lows, highs = np.array([sizes[a:b].min() for a, b in at]), np.array([sizes[a:b].max() for a, b in at])
    levels.append((tops, lows, highs, np.array([only(parts, a, b) for a, b in at]), np.array([only(sides, a, b) for a, b in at])))
    while len(levels[-1][0]) > LEAF:
        tops, lows, highs, part, side = levels[-1]
        cuts = range(0, len(tops), LEAF)
        levels.append((np.maximum.reduceat(tops, cuts), np.minimum.reduceat(lows, cuts), np.maximum.reduceat(highs, cuts), *(np.array([only(xs, c, c + LEAF) for c in cuts]) for xs in (part, side))))

    def may_link(level: tuple, i: int, js: np.ndarray) -> np.ndarray:
        tops, lows, highs, part, side = level
        js = js[(percent * lows[js] <= 100 * highs[i]) & (percent * lows[i] <= 100 * highs[js]) & ~((part[i] >= 0) & (part[i] == part[js])) & ~((side[i] >= 0) & (side[i] == side[js]))]
        return js[(np.minimum(tops[i], tops[js]).sum(1, dtype=np.int64) >= needed(lows[i], lows[js], percent)) | (highs[js] > TOP)]

    top = levels[-1]
    count = len(top[0])
    stack = [(len(levels) - 1, i, js) for i in range(count) if len(js := may_link(top, i, np.arange(i, count)))]
    while stack:
        depth, i, js = stack.pop()
        if depth:
            below = levels[depth - 1]
            mine = range(i * LEAF, min((i + 1) * LEAF, len(below[0])))
            theirs = np.concatenate([np.arange(j * LEAF, min((j + 1) * LEAF, len(below[0]))) for j in js])
            for k in mine:
                if len(found := may_link(below, k, theirs[theirs >= k])):
                    stack.append((depth - 1, k, found))
            continue
        (a, b), theirs = at[i], np.concatenate([np.arange(*at[j]) for j in js])
        for k in range(a, b):
            js_ = theirs[theirs > k]
            js_ = js_[(parts[js_] != parts[k]) & (sides[js_] != sides[k]) & (percent * sizes[js_] <= 100 * sizes[k]) & (percent * sizes[k] <= 100 * sizes[js_])]
            for x in (points, fine):
                js_ = js_[(np.minimum(x[k], x[js_]).sum(1, dtype=np.int64) >= needed(sizes[k], sizes[js_], percent)) | (sizes[js_] > TOP)]
            if len(js_):
                yield np.full(len(js_), order[k]), order[js_]


def node_pairs(members: DataFrame, percent: int, cell: int) -> DataFrame:
    """The members of blocks (h, id, n, part, and lead, their leading coordinate), each as often as its node has a partner:
    with the pair of nodes (i, j) and the side of the member in it. Blocks of up to `cell` points are one node. The nodes of a larger one are cut along
    size and leading coordinate: points of equal ones are spread by a hash of their id, so no rank is needed and no block
    is gathered. A node that can't link by its sizes, or is of the partner's one part, has no pair."""
    keys = ["h", "n", "lead"]
    block = Window.partitionBy("h")
    groups = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    groups = groups.select(*keys, "c", F.sum("c").over(block).alias("m"), (F.sum("c").over(block.orderBy("n", "lead")) - F.col("c")).alias("before"))
    groups = materialize(groups.where(F.col("m") > cell).drop("m"))
    placed = members.join(groups, keys, "left")
    at = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("c"))) / cell).cast("int")
    columns = ["h", "id", "n", "part"]
    zero = F.lit(0)
    alone = placed.where("c IS NULL").select(*columns, zero.alias("i"), zero.alias("j"), zero.alias("side"))
    dealt = placed.where("c IS NOT NULL").select(*columns, at.alias("node"))
    nodes = materialize(dealt.groupBy("h", "node").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("part").alias("p0"), F.max("part").alias("p1")))
    a, b = (nodes.select("h", *[F.col(c).alias(x + c) for c in ("node", "low", "high", "p0", "p1")]) for x in ("a", "b"))
    may = (F.col("anode") <= F.col("bnode")) & (percent * F.col("alow") <= 100 * F.col("bhigh")) & (percent * F.col("blow") <= 100 * F.col("ahigh"))
    several = (F.col("ap0") != F.col("ap1")) | (F.col("bp0") != F.col("bp1")) | (F.col("ap0") != F.col("bp0"))
    pairs = materialize(a.join(b, "h").where(may & several).select("h", F.col("anode").alias("i"), F.col("bnode").alias("j")))
    ends = pairs.select("h", F.col("i").alias("node"), "i", "j", zero.alias("side")).unionByName(pairs.where("i <> j").select("h", F.col("j").alias("node"), "i", "j", F.lit(1).alias("side")))
    return alone.unionByName(dealt.join(ends, ["h", "node"]).select(*columns, "i", "j", "side"))


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and points leave a link possible, with both sizes."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("n").alias("n" + x), F.col("point").alias("point" + x))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = (percent * F.col("na") <= 100 * F.col("nb")) & (percent * F.col("nb") <= 100 * F.col("na"))
    bound = F.aggregate(F.zip_with("pointa", "pointb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return near.where(alike & ((F.greatest("na", "nb") > TOP) | ((100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))))).select("a", "b", "na", "nb")


def _verify(pairs: DataFrame, points: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: those that pass the bound on their points meet their whole sets."""
    near = materialize(_bounded(pairs, points, percent))
    ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_set(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), _lists([unsigned_to_long(x) for x in sets], pa.int64())], ["id", "shingles"])

    sets = only_ids(docs, ids).mapInArrow(gather, "id long, shingles array<long>")
    # Each set goes to its pairs as a, then as b.
    near = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return near.where((100 + percent) * F.size(F.array_intersect("sa", "sb")) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _lists(xs: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs), kind))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """For every document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Null texts and texts without words have no shingles and link with nothing. Equal texts, equal sets and repeated rows
    link with each other. Rows whose doc_id is null are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    seen = materialize(survey(docs, words))
    cells = np.zeros(CELLS, np.int64)
    for row in seen.where("doc_id IS NULL").groupBy("digest").agg(F.sum("n").alias("n")).collect():  # CELLS rows at most
        cells[row["digest"]] = row["n"]
    rank = np.empty(CELLS, np.uint64)
    rank[np.argsort(cells, kind="stable")] = np.arange(CELLS, dtype=np.uint64)
    held = spark.sparkContext.broadcast(rank)
    each = seen.where("doc_id IS NOT NULL")
    classes = each.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        out: list[list[np.ndarray]] = [[], [], []]

        def rows_of() -> pa.RecordBatch:
            """A shingle that stands here twice is known to be shared: one of its rows goes where all tasks' rows of it
            meet, the others need no witness and are dealt at random."""
            h, digest, n = (np.concatenate(c) for c in out)
            sure, salt = known_twice(h, digest ^ unsigned_to_long(mix(h)))
            return pa.RecordBatch.from_arrays([pa.array(unsigned_to_long(h)), pa.array(salt), pa.array(sure), pa.array(digest), pa.array(n)], ["h", "salt", "sure", "digest", "n"])

        for _, sets in _each_set(batches, words):
            for x in sets:
                digest = set_digest(x)
                if not len(x) or digest in done:
                    continue
                done.add(digest)
                head = reorder(x, held.value)[: prefix_length(len(x), percent)]
                out[0].append(head)
                out[1].append(np.full(len(head), digest))
                out[2].append(np.full(len(head), len(x), np.int32))
            if sum(map(len, out[0])) > TOGETHER:
                yield rows_of()
                out = [[], [], []]
        if out[0]:
            yield rows_of()

    heads = documents(docs).where("doc_id IS NOT NULL").mapInArrow(prefixes, "h long, salt int, sure boolean, digest long, n int")
    block = Window.partitionBy("h", "salt")
    met = heads.select("h", "sure", "digest", "n", F.min("digest").over(block).alias("lo"), F.max("digest").over(block).alias("hi")).where("sure OR lo <> hi").select("h", "digest", "n").distinct()
    blocks = materialize(met.join(classes, ["digest", "n"]).select("h", "id", "n"))
    wanted = blocks.select(F.col("id").alias("doc_id")).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _each_set(batches, words):
            points = [np.minimum(np.bincount((x & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), TOP).astype(np.int16) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([len(x) for x in sets], pa.int64()), _lists(points, pa.int16())], ["id", "n", "point"])

    texts = documents(docs).where("doc_id IS NOT NULL")
    points = materialize(only_ids(texts, wanted).mapInArrow(count, "id long, n long, point array<short>"))
    first = blocks.groupBy("h").agg(F.min("id").alias("a"))
    stars = blocks.join(first, "h").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = materialize(_verify(stars, points, texts, words, percent))
    parts = materialize(components(links))
    named = blocks.join(parts, "id", "left").select("h", "id", "n", F.coalesce("component", "id").alias("part"))
    # Blocks of one component are done; of blocks with the same members, one is enough.
    mixed = named.groupBy("h").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(F.xxhash64("id"), 20)).alias("s0"), F.bit_xor(F.xxhash64("id")).alias("s1")).where("p0 <> p1")
    once = mixed.groupBy("m", "s0", "s1").agg(F.min("h").alias("h")).select("h")
    lead = points.select("id", F.array_position("point", F.array_max("point")).cast("int").alias("lead"))
    members = materialize(named.join(once, "h", "left_semi").join(lead, "id"))  # without their points, which are long

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair of nodes; a pair that goes on in the next batch waits for it."""
        rest: pa.Table | None = None

        def bounds(table: pa.Table) -> np.ndarray:
            h, i, j = (table.column(c).to_numpy() for c in ("h", "i", "j"))
            new = (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            return np.flatnonzero(np.concatenate([[True], new, [True]]))

        def solve(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, n, parts, sides = (table.column(c).to_numpy() for c in ("id", "n", "part", "side"))
            vectors = table.column("point").combine_chunks().flatten().to_numpy().reshape(-1, GROUPS)
            found: list = [[], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                two = sides[a:b] if sides[a:b].any() else None
                for x, y in tree_pairs(vectors[a:b], n[a:b].astype(np.int64), parts[a:b], percent, two):
                    found[0].append(ids[a:b][x])
                    found[1].append(ids[a:b][y])
            if found[0]:
                x, y = np.concatenate(found[0]), np.concatenate(found[1])
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cuts = bounds(table)
            if len(cuts) > 2:
                yield from solve(table.slice(0, int(cuts[-2])), cuts[:-1])
            rest = table.slice(int(cuts[-2]))
        if rest is not None:
            yield from solve(rest, np.array([0, len(rest)]))

    dealt = node_pairs(members, percent, cell).join(points.select("id", "point"), "id").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    pairs = dealt.mapInArrow(search, "a long, b long").distinct()
    more = materialize(_verify(pairs, points, texts, words, percent))
    merged = materialize(components(links.unionByName(more)))
    of_class = materialize(classes.join(merged, "id", "left").select("digest", "n", "copies", F.coalesce("component", "id").alias("component")))
    named = beside_counted(each, of_class, ["digest", "n"], "copies", F.col("doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that of its smallest doc_id, with its own columns. Documents of null doc_id stay."""
    kept = near_duplicates(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    first = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return first.unionByName(docs.where("doc_id IS NULL"))
