"""SimHash near-duplicates by segment bit counts.

A fingerprint of 64 bits is embedded as 32 numbers: the bit counts of its two-bit segments.
The Manhattan distance of two embeddings is never above the Hamming distance of the
fingerprints, so fingerprints within `distance` bits are within that range in the embedding.
The 32 coordinates are dealt to `distance + 4` groups. Two points within range differ in at
most `distance` groups and so share the grid cell of some four groups: every point is
entered in the cell of each choice of four groups, cells are joined by an equi-key, and a
pair in a cell has to pass the Manhattan bound and then the exact distance.

`near_copies` decides by exact shingle similarity. The grid finds its candidates up to `BITS`
bits. Texts at similarity 0.8 are some 10 bits apart and up to `WIDE`, too far for a grid over 64
bits, so cells of pairs of min-hashes of the same shingles find those; both kinds pass the
Manhattan bound and the exact distance first.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import PAIR, Scratch, batch_of, components, keeper, mix, runs, table, union_rows, words_of
from hustings.llm.registry import query
from hustings.llm.shingles import STEP, shingle_hashes, slices, word_hashes
from hustings.session import SIZED

SEED = 42
LOW = np.uint64(0x5555555555555555)
TOGETHER = 4  # groups that make up a cell
POINTS = 10_000  # fingerprints that a task enters in cells
SMALL = 24  # cells up to this size are compared as shifted columns
BITS = 4  # distance up to which the grid finds candidates
WIDE = 20  # bits between texts at similarity 0.8: 10 expected, deviation 3
BANDS = 6  # cells of a text; two texts at similarity 0.8 share none of them in 2 of 1,000 cases
BLOCK = 8192  # fingerprints of a cell that one task compares
HELD = 1 << 22  # shingles of a cell that one task holds


# --- fingerprints ----------------------------------------------------------------------


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of the `width`-word shingles, repeats included; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = ends - sizes + 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keeper("fingerprints")  # frees what operators before this one left
        for part in texts:
            found = []
            for i in range(0, len(part), 128):
                found += [fingerprint(t, width) for t in part.slice(i, 128).to_pylist()]
            yield pa.array(np.array(found, np.uint64).astype(np.int64), pa.int64())

    return docs.select("doc_id", F.arrow_udf(mark, "long")("text").alias("fp"))


# --- cells -----------------------------------------------------------------------------


def cell_keys(fps: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """For every choice of groups, the key of each fingerprint's cell."""
    counts = (fps & LOW) + ((fps >> np.uint64(1)) & LOW)  # 32 numbers of two bits each
    groups = distance + TOGETHER
    masks = []
    for g in range(groups):
        lo, hi = 32 * g // groups, 32 * (g + 1) // groups
        masks.append(((1 << (2 * hi)) - 1) ^ ((1 << (2 * lo)) - 1))
    for k, chosen in enumerate(combinations(masks, TOGETHER)):
        mask = 0
        for m in chosen:
            mask |= m
        # mix is one to one, so different cells of one choice keep different keys; keys of
        # different choices may meet by chance, which only adds a comparison.
        yield mix((counts & np.uint64(mask)) + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64))


def close(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs are linked: the Manhattan bound first, the exact distance for the rest."""
    a = (x & LOW) + ((x >> np.uint64(1)) & LOW)
    b = (y & LOW) + ((y >> np.uint64(1)) & LOW)
    # Each coordinate is 0, 1 or 2: bits that only one of them has sum up to a lower bound
    # of the difference after 0 -> 00, 1 -> 01, 2 -> 11 (unary).
    a |= (a >> np.uint64(1)) & LOW
    b |= (b >> np.uint64(1)) & LOW
    found = np.bitwise_count(a ^ b) <= distance
    found[found] = np.bitwise_count(x[found] ^ y[found]) <= distance
    return found


def spanning(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within `fps` connect: at most len(fps) - 1."""
    left, right = [], []
    rest = fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = close(np.broadcast_to(x, rest.shape), rest, distance)
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), x))
                right.append(found)
                frontier.extend(found)
                rest = rest[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links_in_cells(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of rows sorted by cell: all of small cells, a spanning set of large ones."""
    starts, ends = runs(keys)
    size = ends - starts
    own = np.repeat(size, size)
    small = (own > 1) & (own <= SMALL)
    k, f = keys[small], fps[small]
    for step in range(1, min(SMALL, int(size[size <= SMALL].max(initial=1)))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        x, y = f[same], f[same + step]
        hit = close(x, y, distance)
        yield x[hit], y[hit]
    for a, b in zip(starts[size > SMALL].tolist(), ends[size > SMALL].tolist()):
        yield spanning(np.unique(fps[a:b]), distance)


CELL = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def links(fps: DataFrame, scratch: Scratch, distance: int = 4, block: int = 8192) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that are `distance` apart or less.

    A cell that holds more than `block` fingerprints is cut into blocks, and each pair of
    blocks is a group of its own, so that no task gets a whole large cell.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("fp").to_numpy().astype(np.uint64)
            signed = found.astype(np.int64)
            for keys in cell_keys(found, distance):
                yield batch_of(CELL, keys.astype(np.int64), signed)

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held_k = np.concatenate([held_k, batch.column("key").to_numpy()])
            held_f = np.concatenate([held_f, batch.column("fp").to_numpy()])
            if len(held_k) < 200_000:
                continue
            cut = int(np.searchsorted(held_k, held_k[-1]))  # the last cell may go on
            yield from forest(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
        yield from forest(held_k, held_f)

    def forest(keys: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = links_in_cells(keys, found.astype(np.uint64), distance)
        ids, roots = union_rows((x.astype(np.int64), y.astype(np.int64)) for x, y in pairs)
        if ids:
            yield batch_of(PAIR, ids, roots)

    # A small table becomes many rows: it is dealt to as many tasks as those rows need.
    tasks = max(1, -(-fps.count() // POINTS))
    cells = fps.select("fp").repartition(tasks).mapInArrow(enter, "key long, fp long")
    hot = scratch.save(
        cells.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot"
    )
    if not hot.isEmpty():
        # Every member of a hot cell goes to the pairs of blocks that its block is part of.
        pieces = F.ceil(F.col("n") * 2 / block).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("pieces")).cast("int")
        split = (
            cells.join(hot, "key").withColumn("pieces", pieces).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
            .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        )
        cells = cells.join(hot.select("key"), "key", "left_anti").unionByName(split)
    sorted_cells = cells.repartition("key").sortWithinPartitions("key")
    return sorted_cells.mapInArrow(connect, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of `docs` (doc_id, text).

    component_id is the smallest doc_id among all documents that links reach, itself
    included. Equal fingerprints are one point of the grid, however many documents have
    them. A null text is empty; documents without words share fingerprint zero. A null
    doc_id takes part but is never the smallest. An empty table gives no rows.
    """
    marked = scratch.save(fingerprints(docs, width), "fingerprints")
    points = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    pairs = scratch.save(links(points, scratch, distance), "links")
    label = components(pairs, scratch)
    placed = points.join(label, F.col("fp") == F.col("id"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_point = scratch.save(placed.join(roots, "root").select("fp", "component_id"), "by-point")
    return marked.join(by_point, "fp")


# --- near copies -----------------------------------------------------------------------

SALTS = mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
MARKED = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("content", pa.int64()), ("fp", pa.int64()),
     ("size", pa.int64()), ("cells", pa.list_(pa.int64()))]
)
NEAR = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("size", pa.int64())])


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words are one shingle, none are an empty set."""
    words, offsets = word_hashes(texts)
    hashes, bounds = shingle_hashes(words, offsets, width)
    sets = []
    for a, b, c, d in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        if 0 < b - a < width:
            sets.append(shingle_hashes(words[a:b], np.array([0, b - a]), b - a)[0])
        else:
            sets.append(np.unique(hashes[c:d]))
    return sets


def shared_cells(shingles: np.ndarray) -> list[int]:
    """A key for each pair of min-hashes."""
    if not len(shingles):
        return []
    least = np.array([mix(shingles ^ salt).min() for salt in SALTS], np.uint64)
    return mix(least[::2] * STEP + least[1::2] + np.arange(BANDS, dtype=np.uint64)).astype(np.int64).tolist()


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this share of their union in common."""
    if len(x) > len(y):
        x, y = y, x
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[place] == x).sum())
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def feasible(fps: np.ndarray, sizes: np.ndarray, i: int, similarity: float, distance: int) -> np.ndarray:
    """Which rows the i-th one may be similar to, by fingerprint and by number of shingles."""
    near = close(fps, np.broadcast_to(fps[i], fps.shape), distance)
    return near & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)


def similar_links(
    ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, distance: int
) -> Iterator[tuple[int, int]]:
    """Links that connect what all similar pairs connect: at most len(ids) - 1."""
    sizes = np.array([len(s) for s in sets])
    rest = np.ones(len(ids), bool)
    for first in range(len(ids)):
        if not rest[first]:
            continue
        rest[first] = False
        frontier = [first]
        while frontier:
            i = frontier.pop()
            for j in np.flatnonzero(rest & feasible(fps, sizes, i, similarity, distance)).tolist():
                if alike(sets[i], sets[j], similarity):
                    rest[j] = False
                    frontier.append(j)
                    yield int(ids[i]), int(ids[j])


def dealt(rows: DataFrame, weight, most: int, scratch: Scratch, name: str) -> DataFrame:
    """`rows` (key, content, …) with keys of at most about `most` in sum of `weight`.

    A larger key is cut into blocks of contents, and each pair of blocks becomes a key.
    """
    hot = scratch.save(rows.groupBy("key").agg(F.sum(weight).alias("held")).where(F.col("held") > most), name)
    if hot.isEmpty():
        return rows
    split = (
        rows.join(hot, "key").withColumn("pieces", F.ceil(F.col("held") * 2 / most).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("content", F.lit(name)), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    )
    return rows.join(hot.select("key"), "key", "left_anti").unionByName(split.select(*rows.columns))


def grid_cells(points: DataFrame, scratch: Scratch, distance: int = BITS) -> DataFrame:
    """(key, content, size, fp): the points of each group that links of the grid join, groups of one left out.

    All points `distance` bits apart or less have a group in common, those of one fingerprint too.
    """
    label = components(scratch.save(links(points.select("fp").distinct(), scratch, distance), "grid-links"), scratch)
    root = F.coalesce("component", "fp")
    placed = points.join(label, F.col("fp") == F.col("id"), "left").select(
        F.xxhash64(F.lit("grid"), root).alias("key"), "content", "size", "fp"
    )
    several = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return placed.join(several, "key", "left_semi")


def near_copies(
    docs: DataFrame, scratch: Scratch, similarity: float = 0.8, width: int = 5, distance: int = WIDE
) -> DataFrame:
    """(doc_id, mark, component_id, first), one row per row of `docs` (doc_id, text).

    Texts are linked if their sets of `width`-word shingles are at least `similarity` alike
    (common shingles by all shingles of both). component_id is the smallest doc_id that links
    reach; `first` marks the smallest (doc_id, mark) of them, `mark` being the XXH64 of the text:
    different texts of one doc_id are rows of their own, repeated rows are alike in all columns.

    A pair is found if its fingerprints are `BITS` bits apart or less, by the grid, or up to
    `distance` bits and it shares one of the min-hash cells; a pair that is found is decided by its shingles. Texts of equal sets are
    one point, however many documents have them. Cells are cut by the number of fingerprints
    and, for the shingles, by their sum; in a cut cell the work grows with the square of the
    blocks. A null text is empty; documents without words are alike. A null doc_id takes
    part but is never the smallest. An empty table gives no rows.
    """

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper("near-copies")
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                sets = shingle_sets(texts, width)
                contents = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
                fps = [fingerprint(t, width) for t in texts]
                yield batch_of(
                    MARKED, batch.column("doc_id").slice(at, len(texts)), batch.column("mark").slice(at, len(texts)),
                    np.array(contents, np.uint64).astype(np.int64), np.array(fps, np.uint64).astype(np.int64),
                    [len(s) for s in sets], [shared_cells(s) for s in sets],
                )

    def with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((4, 0), np.int64)
        for batch in batches:
            rows = np.hstack([rows, np.vstack([batch.column(c).to_numpy() for c in ("key", "content", "size", "fp")])])
            if rows.shape[1] >= 200_000:
                cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on
                yield partners(rows[:, :cut])
                rows = rows[:, cut:]
        yield partners(rows)

    def partners(rows: np.ndarray) -> pa.RecordBatch:
        keep = np.zeros(rows.shape[1], bool)
        fps = rows[3].astype(np.uint64)
        starts, ends = runs(rows[0])
        several = ends - starts > 1
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            for i in range(b - a):
                hit = feasible(fps[a:b], rows[2, a:b], i, similarity, distance)
                hit[i] = False
                if hit.any():
                    keep[a + i] = True
        return batch_of(NEAR, *rows[:3, keep])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper("near-copies")
        key, ids, fps, sets, found = None, [], [], [], []
        for batch in batches:
            keys, contents, marks = (batch.column(c).to_numpy() for c in ("key", "content", "fp"))
            for at, texts in slices(batch.column("text")):
                for i, s in enumerate(shingle_sets(texts, width), at):
                    if keys[i] != key:
                        found += similar_links(np.array(ids), np.array(fps, np.int64).astype(np.uint64), sets, similarity, distance)
                        key, ids, fps, sets = keys[i], [], [], []
                    ids.append(contents[i])
                    fps.append(marks[i])
                    sets.append(s)
            if found:
                yield batch_of(PAIR, *map(list, zip(*found)))
                found = []
        found += similar_links(np.array(ids), np.array(fps, np.int64).astype(np.uint64), sets, similarity, distance)
        if found:
            yield batch_of(PAIR, *map(list, zip(*found)))

    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    marked = scratch.save(
        texts.mapInArrow(enter, "doc_id long, mark long, content long, fp long, size long, cells array<long>"), "marked"
    )
    points = scratch.save(
        marked.groupBy("content").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least"),
            F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("cells").alias("cells"),
        ),
        "points",
    )
    cells = points.select(F.explode("cells").alias("key"), "content", "size", "fp")
    cells = cells.unionByName(grid_cells(points, scratch))
    cells = dealt(cells, F.lit(1), BLOCK, scratch, "hot-cells").repartition("key").sortWithinPartitions("key")
    near = scratch.save(cells.mapInArrow(with_partners, "key long, content long, size long"), "near")
    chosen = scratch.save(
        points.join(near.select("content").distinct(), "content", "left_semi")
        .select("content", "fp", F.col("least.doc_id").alias("of"), F.col("least.mark").alias("as")),
        "chosen",
    )
    some = F.broadcast(chosen) if chosen.count() <= SIZED else chosen
    one_each = (
        texts.join(some, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("as") == F.col("mark")))
        .groupBy("content").agg(F.first("fp").alias("fp"), F.min("text").alias("text"))
    )
    groups = dealt(near, F.col("size"), HELD, scratch, "hot-texts").select("key", "content")
    together = groups.join(one_each, "content").repartition("key").sortWithinPartitions("key")
    pairs = scratch.save(together.select("key", "content", "fp", "text").mapInArrow(verify, "a long, b long"), "similar")
    label = components(pairs, scratch)
    placed = points.join(label, F.col("content") == F.col("id"), "left").select(
        "content", "least", F.coalesce("component", "content").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("least").alias("first"))
    by_content = scratch.save(placed.join(roots, "root").select("content", "first"), "by-content")
    return marked.join(by_content, "content").select(
        "doc_id", "mark", F.col("first.doc_id").alias("component_id"),
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))).alias("first"),
    )


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")
