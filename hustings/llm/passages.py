"""Near-duplicate passages by compact windows.

The tokens of a text are its five-word shingles. Under one hash function the Cartesian tree of
the token hashes gives every token c the widest window in which it is the minimum: all
passages between the window's ends that hold c have c as their min-hash, so a window stands for
all of them at once. Only windows that can hold a passage of the least length matter, about two
for as many tokens. Windows of different texts with an equal minimum share signatures; where
enough hash functions agree on an alignment (an interval join over both texts) the passage is
a candidate, and the shingles of both sides decide.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, batch_of, components, keeper, mix, runs, table
from hustings.llm.language_model import map_arrays, write_arrays
from hustings.llm.registry import query
from hustings.llm.shingles import shingle_hashes, slices, word_hashes

WIDTH = 5
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 6
ENOUGH = 3  # a pair at the threshold shares a hash with 0.8: three of six in 98 of 100 alignments, more if longer
FLUSH = 600_000  # windows a task holds before it links and sends them
PARTS = 256
BUCKETS = 6  # buckets of windows for each shuffle partition
OPEN = HASHES - ENOUGH + 1  # of any three of six functions one is among these first
BLOCK = 8192  # windows of a key that are compared in one task; larger keys are cut into pairs of blocks
PLACE = np.uint64((1 << 24) - 1)


# --- windows ---------------------------------------------------------------------------


def permuted(x: np.ndarray, f: int) -> np.ndarray:
    return mix(x ^ np.uint64((f + 1) * 0x9E3779B97F4A7C15 % 2**64))


def compact_windows(tokens: np.ndarray, bounds: np.ndarray, least: int, f: int) -> tuple[np.ndarray, ...]:
    """(hash, place, left, right) of the windows that hold `least` tokens or more.

    `place` counts from the beginning of all tokens; left and right are the tokens that the
    window has before and behind its minimum, up to `least` of them. A token is the minimum of
    such a window exactly if it is that of some `least` tokens in a row, and the tokens that end
    its window are such tokens themselves; so the tree is built from those alone.
    """
    hashes = permuted(tokens, f)
    n = len(hashes)
    if n < least:
        return hashes[:0], *(np.zeros(0, np.int64) for _ in range(3))
    # The place inside the number makes the first of equal tokens the smaller one.
    mask = max(PLACE, np.uint64((1 << n.bit_length()) - 1))  # a longer text takes more bits
    low = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    size = 1
    best = low
    while size * 2 <= least:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < least:
        best = np.minimum(best[: n - least + 1], best[least - size :][: n - least + 1])
    starts, ends = bounds[:-1], np.maximum(bounds[1:] - least + 1, bounds[:-1])
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    place = (best[np.cumsum(inside)[: len(best)] > 0] & mask).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    left, right = _extents(low[place].tolist(), place.tolist(), bounds, least)
    return hashes[place], place, left, right


def _extents(values: list[int], places: list[int], bounds: np.ndarray, least: int):
    """Tokens before and behind each minimum up to the next smaller one in its text."""
    text = np.searchsorted(bounds, places, "right") - 1
    first, last = bounds[text].tolist(), bounds[text + 1].tolist()
    before, behind = [0] * len(places), [0] * len(places)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and (first[stack[-1]] != first[i] or values[stack[-1]] > v):
            j = stack.pop()
            behind[j] = min(places[i], last[j])
        before[i] = places[stack[-1]] + 1 if stack else first[i]
        stack.append(i)
    for j in stack:
        behind[j] = last[j]
    at = np.array(places, np.int64)
    return np.minimum(at - np.array(before, np.int64), least), np.minimum(np.array(behind, np.int64) - at - 1, least)


STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def surroundings(tokens: np.ndarray, bounds: np.ndarray, least: int, places: list[np.ndarray]):
    """(content, tail) for each array of places: a hash of up to `least` tokens on both sides, and how many are behind."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), STEP)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[:-1])])
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), BACK)]))
    found = []
    for place in places:
        text = np.searchsorted(bounds, place, "right") - 1
        lo, hi = np.maximum(place - least, bounds[text]), np.minimum(place + least + 1, bounds[text + 1])
        # The same tokens around another middle are another content.
        shape = mix(((place - lo) * (2 * least + 2) + hi - lo).astype(np.uint64))
        found.append((mix((sums[hi] - sums[lo]) * inverse[lo]) ^ shape, hi - place - 1))
    return found


# --- joining windows -------------------------------------------------------------------

WINDOW = np.dtype(
    [("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("at", "<u4")] + [(n, "u1") for n in ("left", "right", "tail", "f")]
)
MATCH = np.dtype(
    [("a", "<i8"), ("b", "<i8"), ("at", "<u4"), ("other", "<u4"), ("f", "u1"), ("how", "u1"), ("tail", "u1")]
    + [(n, "<u8") for n in ("key", "content", "lead")]
)
COMPARED, EQUAL, NO_ROOM, SAME = 0, 1, 2, 3  # how a window stands to an earlier one of its key; SAME: in the same document


def equal(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches of windows with equal surroundings, each with the first of them, and those first ones.

    Whatever shares a passage through the one shares it through the other, so the first stands for all.
    """
    windows = windows[np.lexsort([windows[n] for n in ("at", "doc", "content", "f", "key")])]
    new = np.ones(len(windows), bool)
    new[1:] = np.any([windows[n][1:] != windows[n][:-1] for n in ("key", "f", "content")], axis=0)
    first = windows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    own = windows["doc"] != first["doc"]
    found = np.zeros(int(own.sum()), MATCH)
    for name, values in (("a", windows["doc"]), ("at", windows["at"]), ("f", windows["f"]), ("tail", windows["tail"])):
        found[name] = values[own]
    found["b"], found["other"], found["how"] = first["doc"][own], first["at"][own], EQUAL
    return found, windows[new]


def star(windows: np.ndarray, least: int, first_open: int = OPEN) -> np.ndarray:
    """Matches of every window, each of another content, with the first one of its key.

    What cannot be compared with it is a match too, marked by `how`: it is compared with the others
    when the key is opened. Only keys of the first `first_open` functions are.
    """
    windows = windows[np.lexsort([windows[n] for n in ("at", "doc", "f", "key")])]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["key"][1:] != windows["key"][:-1]) | (windows["f"][1:] != windows["f"][:-1])
    lead = windows[np.flatnonzero(new)[np.cumsum(new) - 1]]
    room = np.minimum(windows["left"], lead["left"]).astype(int) + np.minimum(windows["right"], lead["right"]) + 1
    how = np.where(windows["doc"] == lead["doc"], SAME, np.where(room >= SIMILARITY * least, COMPARED, NO_ROOM))
    own = ~new & ((how == COMPARED) | (windows["f"] < first_open))
    found = np.empty(int(own.sum()), MATCH)
    for name in ("at", "f", "tail", "key", "content"):
        found[name] = windows[name][own]
    found["a"], found["how"] = windows["doc"][own], how[own]
    found["b"], found["other"], found["lead"] = lead["doc"][own], lead["at"][own], lead["content"][own]
    return found


BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
BLOB_SQL = "bucket int, kind int, data binary"


def blobs(rows: np.ndarray, key: np.ndarray, buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows dealt to buckets by a hash, one block each, columns apart so that they compress."""
    bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    held, weight = [], 0
    for a, b in zip(*runs(bucket)):
        part = rows[a:b]
        held.append((int(bucket[a]), kind, b"".join(part[n].tobytes() for n in rows.dtype.names)))
        weight += part.nbytes
        if weight > 4 << 20:
            yield batch_of(BLOB, *zip(*held))
            held, weight = [], 0
    if held:
        yield batch_of(BLOB, *zip(*held))


def unblob(data: bytes, kind: np.dtype) -> np.ndarray:
    n = len(data) // kind.itemsize
    rows, at = np.empty(n, kind), 0
    for name in kind.names:
        size = kind[name].itemsize * n
        rows[name] = np.frombuffer(data[at : at + size], kind[name])
        at += size
    return rows


def dealt(sent: DataFrame, buckets: int) -> DataFrame:
    """Blocks by bucket; several buckets a task, so that tasks get about as much each."""
    return sent.repartition(max(1, buckets // BUCKETS), "bucket").sortWithinPartitions("bucket")


def pair_key(found: np.ndarray) -> np.ndarray:
    return mix(found["a"].astype(np.uint64)) + found["b"].astype(np.uint64)


def find_windows(docs: DataFrame, least: int, buckets: int) -> DataFrame:
    """Blocks of windows (kind 0, by key) and of matches (kind 1, by pair) of `docs` (doc_id, text).

    A window's key is the token in its middle. A task links the windows of its own documents that have equal
    surroundings and sends one of them, so a passage that a third of all documents have is one window per task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            rows = np.concatenate(held)
            held.clear()
            found, first = equal(rows)
            yield from blobs(first, first["key"] + first["f"], buckets, 0)
            if len(found):
                yield from blobs(found, pair_key(found), buckets, 1)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for begin, texts in slices(batch.column("text")):
                tokens, bounds = shingle_hashes(*word_hashes(texts), WIDTH)
                windows = [compact_windows(tokens, bounds, least, f)[1:] for f in range(HASHES)]
                around = surroundings(tokens, bounds, least, [place for place, _, _ in windows])
                for f, ((place, left, right), (content, tail)) in enumerate(zip(windows, around)):
                    text = np.searchsorted(bounds, place, "right") - 1
                    rows = np.empty(len(place), WINDOW)
                    rows["key"], rows["doc"], rows["at"] = tokens[place], ids[begin + text], place - bounds[text]
                    rows["left"], rows["right"], rows["f"] = left, right, f
                    rows["content"], rows["tail"] = content, tail
                    held.append(rows)
                    size += len(rows)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(read, BLOB_SQL)


def gather(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> Iterator[dict[int, np.ndarray]]:
    """All rows of each bucket by kind, from blocks sorted by bucket."""
    at, held = None, {}

    def whole():
        return {k: np.concatenate(held[k]) if k in held else np.empty(0, t) for k, t in kinds.items()}

    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(c) for c in ("bucket", "kind", "data"))):
            if bucket.as_py() != at:
                if held:
                    yield whole()
                at, held = bucket.as_py(), {}
            held.setdefault(kind.as_py(), []).append(unblob(data.as_py(), kinds[kind.as_py()]))
    if held:
        yield whole()


def join_windows(sent: DataFrame, least: int, buckets: int, first_open: int = OPEN) -> DataFrame:
    """Blocks of matches by pair, from the windows of all tasks."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gather(batches, {0: WINDOW, 1: MATCH}):
            copies, windows = equal(rows[0])
            found = np.concatenate([star(windows, least, first_open), copies, rows[1]])
            if len(found):
                yield from blobs(found, pair_key(found), buckets, 1)

    return dealt(sent, buckets).mapInArrow(link, BLOB_SQL)


# --- candidates ------------------------------------------------------------------------

PLACES = ("a", "b", "lo", "hi", "other_lo", "other_hi")
ALIGNED = pa.schema([(n, pa.int64()) for n in ("kind", *PLACES, "key", "f", "at", "other", "content", "lead")])
ALIGNED_SQL = ", ".join(f"{n} long" for n in ALIGNED.names)
PAIR, WITH_LEAD, COPY = 0, 1, 4  # kinds beside NO_ROOM (here also: not aligned) and SAME


def align(found: np.ndarray, least: int, enough: int, first_open: int = OPEN) -> Iterator[tuple[np.ndarray, ...]]:
    """Places where enough hash functions match the same two texts at about the same shift.

    Columns of ALIGNED: candidates are of kind PAIR, equal places of kind COPY; the matches follow that
    open keys may need, those of a candidate with its places.
    """
    rest = found[found["how"] > EQUAL]
    found = found[found["how"] <= EQUAL]
    shift = found["at"].astype(np.int64) - found["other"]
    found = found[np.lexsort((found["at"], shift, found["b"], found["a"]))]
    shift = found["at"].astype(np.int64) - found["other"]
    at, other = found["at"].astype(np.int64), found["other"].astype(np.int64)

    def rows(kind, chosen, places):
        where = (chosen[n].astype("<u8").view(np.int64) for n in ("key", "f", "at", "other", "content", "lead"))
        return np.broadcast_to(kind, len(chosen)), chosen["a"], chosen["b"], *places, *where

    if len(found):
        new = np.ones(len(found), bool)
        # A passage goes on while the shift moves by little (words come or go) and no gap is too long.
        new[1:] = (
            (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
            | (np.abs(np.diff(shift)) > least // 4) | (np.abs(np.diff(at)) > 2 * least)
        )
        starts = np.flatnonzero(new)
        seen = np.bitwise_or.reduceat(1 << found["f"].astype(np.int64), starts)
        grow = 2 * least
        places = [
            np.maximum(np.minimum.reduceat(at, starts) - grow, 0), np.maximum.reduceat(at, starts) + grow + 1,
            np.maximum(np.minimum.reduceat(other, starts) - grow, 0), np.maximum.reduceat(other, starts) + grow + 1,
        ]
        kept = np.bitwise_count(seen) >= enough
        none = [np.zeros(int(kept.sum()), np.int64)] * 6
        yield none[0] + PAIR, found["a"][starts][kept], found["b"][starts][kept], *(p[kept] for p in places), *none
        run = np.cumsum(new) - 1
        own = (found["how"] == COMPARED) & (found["f"] < first_open)
        yield rows(np.where(kept[run], WITH_LEAD, NO_ROOM)[own], found[own], [p[run][own] for p in places])
        yield copied(found[found["how"] == EQUAL], least)
    if len(rest):
        yield rows(rest["how"].astype(np.int64), rest, [np.zeros(len(rest), np.int64)] * 4)


def copied(found: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Rows of kind COPY from sorted matches of equal surroundings; those that touch are one."""
    at, shift = found["at"].astype(np.int64), found["at"].astype(np.int64) - found["other"]
    lo, hi = at - np.minimum(at, least), at + found["tail"] + 1
    new = np.ones(len(found), bool)
    new[1:] = (
        (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
        | (np.diff(shift) != 0) | (lo[1:] > hi[:-1])
    )
    starts = np.flatnonzero(new)
    if len(starts):
        lo, hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
    shift, none = shift[starts], [np.zeros(len(starts), np.int64)] * 6
    return none[0] + COPY, found["a"][starts], found["b"][starts], lo, hi, lo - shift, hi - shift, *none


def find_candidates(matches: DataFrame, least: int, enough: int, buckets: int, first_open: int = OPEN) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gather(batches, {1: MATCH}):
            for found in align(rows[1], least, enough, first_open):
                if len(found[0]):
                    yield batch_of(ALIGNED, *found)

    return dealt(matches, buckets).mapInArrow(read, ALIGNED_SQL)


# --- verification ----------------------------------------------------------------------

REQUEST = pa.schema([("part", pa.int32()), ("n", pa.int64())])
PIECE = pa.schema(
    [("pair", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("lo", pa.int64()), ("data", pa.binary())]
)
VERIFIED = pa.schema(
    [(n, pa.int64()) for n in ("pair", "a", "b", "start", "end", "other_start", "other_end")]
    + [("similarity", pa.float64())]
)


def pieces_of(candidates: DataFrame) -> DataFrame:
    """(doc, pair, side, lo, hi): the two pieces of every candidate."""
    sides = F.array(
        F.struct(F.col("a").alias("doc"), F.lit(0).alias("side"), F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.col("b").alias("doc"), F.lit(1).alias("side"), F.col("other_lo").alias("lo"), F.col("other_hi").alias("hi")),
    )
    wanted = candidates.select(F.xxhash64("a", "b", "lo", "other_lo").alias("pair"), F.explode(sides).alias("s"))
    return wanted.select("s.doc", "pair", "s.side", "s.lo", "s.hi")


def write_requests(pieces: DataFrame, folder: str) -> DataFrame:
    """Write which pieces (doc, pair, side, lo, hi) are wanted, by document, for all tasks to map."""
    wanted = pieces.select(
        F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int").alias("part"), "doc", "pair",
        F.col("side").cast("long").alias("side"), "lo", "hi",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle():
            rows = pa.Table.from_batches(held)
            names = ("doc", "pair", "side", "lo", "hi")
            write_arrays(f"{folder}/requests-{at}.bin", {}, {n: rows[n].to_numpy().astype("<i8") for n in names})
            return batch_of(REQUEST, [at], [len(rows)])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            for a, b in zip(*runs(parts)):
                if parts[a] != at:
                    if held:
                        yield settle()
                    at, held = int(parts[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield settle()

    dealt = wanted.repartition(PARTS, "part").sortWithinPartitions("part", "doc", "pair", "side")
    return dealt.mapInArrow(write, "part int, n long")


def read_pieces(docs: DataFrame, folder: str, need: int = 0, least: int = 0) -> DataFrame:
    """The wanted pieces of all documents, as shingle hashes; texts are not shuffled.

    Those are left out that have fewer than `need` different ones but for `least` at both ends.
    """
    rows = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = keeper("passages")
        if held.get("folder") != folder:
            held.clear()
            held.update(folder=folder, parts={})
        mapped = held["parts"]
        for batch in batches:
            ids, parts = batch.column("doc_id").to_pylist(), batch.column("part").to_pylist()
            found = {}
            for i, (doc, part) in enumerate(zip(ids, parts)):
                if part not in mapped:
                    mapped[part] = map_arrays(f"{folder}/requests-{part}.bin")
                if mapped[part]:
                    own = mapped[part][1]
                    a, b = np.searchsorted(own["doc"], doc), np.searchsorted(own["doc"], doc, "right")
                    if a < b:
                        found[i] = {n: v[a:b].tolist() for n, v in own.items()}
            if not found:
                continue
            chosen = batch.column("text").take(pa.array(list(found)))
            order = list(found)
            for begin, texts in slices(chosen):
                tokens, bounds = shingle_hashes(*word_hashes(texts), WIDTH)
                out, weight = [], 0
                for k in range(len(texts)):
                    own = found[order[begin + k]]
                    text = tokens[bounds[k] : bounds[k + 1]].astype("<u4")
                    for pair, side, lo, hi in zip(own["pair"], own["side"], own["lo"], own["hi"]):
                        piece = text[max(0, lo) : hi]
                        if need and len(set(text[max(0, lo + least) : hi - least].tolist())) < need:
                            continue
                        out.append((pair, side, ids[order[begin + k]], lo, piece.tobytes()))
                        weight += len(out[-1][-1])
                        if weight > 4 << 20:
                            yield batch_of(PIECE, *zip(*out))
                            out, weight = [], 0
                if out:
                    yield batch_of(PIECE, *zip(*out))

    return rows.select("doc_id", "part", "text").mapInArrow(read, "pair long, side int, doc_id long, lo long, data binary")


def verify(x: np.ndarray, y: np.ndarray, least: int, similarity: float) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages (start, end, other start, other end, similarity) that two pieces share."""
    # Of two passages of n shingles that share m the similarity is m / (2n - m); runs of hits join
    # while they keep it, and a run that would spoil it begins a passage of its own.
    need = 2 * similarity / (1 + similarity)
    if min(len(x), len(y)) < least * similarity:
        return
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    place = np.minimum(np.searchsorted(ranked, x), len(y) - 1)
    hits = np.flatnonzero(ranked[place] == x)
    if len(hits) < need * least or not _dense(hits, least, need):
        return
    place = order[place[hits]]
    cuts, first, held = [], 0, 0
    for begin, end in zip(*runs(hits - np.arange(len(hits)))):
        size = int(end - begin)
        if held and held + size < need * (hits[end - 1] + 1 - hits[first]):
            cuts.append(int(begin))
            first, held = begin, 0
        held += size
    for own, other in zip(np.split(hits, cuts), np.split(place, cuts)):
        a, b = int(own[0]), int(own[-1]) + 1
        if b - a < least:  # the other side is not longer
            continue
        mine, single = np.unique(x[own], return_index=True)
        # The other side begins where most of the hits say it does; of repeated shingles the first ones may say better.
        for chosen in (slice(None), single):
            middle = int(np.median((other - own)[chosen]))
            c, d = max(0, a + middle), min(len(y), b + middle)
            value = _similarity(x[a:b], y[c:d])
            if value < similarity and len(mine) < len(own) and c < d:
                inside = np.flatnonzero(np.isin(y[c:d], mine))
                if len(inside) and inside[-1] + 1 - inside[0] >= least * similarity:
                    c, d = c + int(inside[0]), c + int(inside[-1]) + 1
                    value = _similarity(x[a:b], y[c:d])
            if value >= similarity:
                yield a, b, c, d, value
                break
            if len(mine) == len(own):
                break


def _dense(hits: np.ndarray, least: int, need: float) -> bool:
    """Whether `least` or more places in a row hold a share of `need` hits: there is no passage without."""
    spare = np.arange(len(hits)) - need * hits
    before = np.searchsorted(hits, hits - least + 1, "right")
    far = before > 0
    return bool((spare[far] - np.minimum.accumulate(spare)[before[far] - 1] >= need - 1 - 1e-9).any())


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    mine, theirs = np.unique(x), np.unique(y)
    shared = len(np.intersect1d(mine, theirs, assume_unique=True))
    return shared / max(1, len(mine) + len(theirs) - shared)


def verify_pieces(pieces: DataFrame, least: int, similarity: float) -> DataFrame:
    """Verified passages; both pieces of a pair meet in one task, one pair at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, out = None, {0: [], 1: []}, []

        def settle():
            for a, lo, x in sides[0]:
                for b, other_lo, y in sides[1]:
                    for s, e, c, d, value in verify(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), least, similarity):
                        out.append((at, a, b, lo + s, lo + e + WIDTH - 1, other_lo + c, other_lo + d + WIDTH - 1, value))

        for batch in batches:
            for row in batch.to_pylist():
                if row["pair"] != at:
                    settle()
                    at, sides = row["pair"], {0: [], 1: []}
                sides[row["side"]].append((row["doc_id"], row["lo"], row["data"]))
            if out:
                yield batch_of(VERIFIED, *zip(*out))
                out.clear()
        settle()
        if out:
            yield batch_of(VERIFIED, *zip(*out))

    return pieces.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(
        read, "pair long, a long, b long, start long, end long, other_start long, other_end long, similarity double"
    )


# --- open keys -------------------------------------------------------------------------


def open_windows(aligned: DataFrame, passages: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, content, doc, at, label): the windows, one of each content, of keys with one that is not linked to the first.

    A match is linked if a verified passage of its candidate covers it. What has the same label (not 0)
    under a key is linked to the same first window: label - 1 is the hash function. Keys of one token
    are one here, as their windows are mostly the same.
    """
    rows = aligned.where(f"kind IN ({NO_ROOM}, {WITH_LEAD}, {SAME})").withColumn("pair", F.xxhash64("a", "b", "lo", "other_lo"))
    linked = passages.select(F.col("pair").alias("p"), "start", "end")
    met = rows.where(f"kind = {WITH_LEAD}").join(
        linked, (F.col("pair") == F.col("p")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left"
    )
    columns = ("kind", "key", "f", "a", "at", "content", "b", "other", "lead")
    marked = met.select(*columns, F.col("p").isNotNull().alias("linked")).unionByName(
        rows.where(f"kind <> {WITH_LEAD}").select(*columns, F.lit(False).alias("linked"))
    )
    marked = scratch.save(marked, "marked")
    keys = marked.where(f"NOT linked AND kind <> {SAME}").select("key").distinct()
    label = F.col("f") + 1
    sides = F.array(
        F.struct(F.col("content").alias("c"), F.col("a").alias("doc"), F.col("at"), F.when(F.col("linked"), label).alias("label")),
        F.struct(F.col("lead").alias("c"), F.col("b").alias("doc"), F.col("other").alias("at"), label.alias("label")),
    )
    found = marked.join(keys, "key", "left_semi").select("key", F.explode(sides).alias("s"))
    found = found.groupBy("key", F.col("s.c").alias("content")).agg(
        F.min(F.struct("s.doc", "s.at")).alias("w"), F.coalesce(F.min("s.label"), F.lit(0)).alias("label")
    )
    return found.select("key", "content", "w.doc", "w.at", "label")


def open_requests(windows: DataFrame, least: int) -> DataFrame:
    """(doc, pair, side, lo, hi): the surroundings of open windows; `pair` is the key and `side` the label.

    Two least lengths on both sides of the window's middle, `lo` may lie before the text.
    """
    sizes = windows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("d"), F.max("doc").alias("e"))
    chosen = windows.join(sizes.where("n > 2 AND d < e").select("key"), "key", "left_semi")
    return chosen.select(
        "doc", F.col("key").alias("pair"), F.col("label").alias("side"),
        (F.col("at") - 2 * least).alias("lo"), (F.col("at") + 2 * least + 1).alias("hi"),
    )


def open_pieces(pieces: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces by what is compared in one task: a key (`pair`), or a pair of its blocks."""
    sizes = pieces.groupBy("pair").agg(F.count("*").alias("n"), F.min("doc_id").alias("d"), F.max("doc_id").alias("e"))
    sizes = sizes.where("d < e").select("pair", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id", "lo"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("own")))
    placed = pieces.join(sizes, "pair").withColumn("own", own).select("*", F.explode(others).alias("o"))
    return placed.withColumn("pair", F.xxhash64("pair", F.least("own", "o"), F.greatest("own", "o"))).drop("blocks", "own", "o")


def connect(
    docs: list[int], texts: list[np.ndarray], least: int, similarity: float,
    labels: list[int] | None = None, middles: list[int] | None = None,
) -> Iterator[tuple[int, int]]:
    """Pairs of pieces that share a passage, such that whatever shares one is connected by them.

    With `middles`, places in the pieces, the passage has to hold the middle of a piece. No more pairs than pieces come out.
    Equal pieces are one, and pieces with the same label (not 0) are connected already. A pair needs
    `similarity` * `least` common shingles, so a piece is out that has fewer which any other has, and a
    pair shares one of the rarer shingles that both have beyond that number. The rest is searched
    through: a piece is compared with all that nothing connects it with yet.
    """
    same: dict[bytes, int] = {}
    kept = []
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    named: dict[int, int] = {}
    for i, x in enumerate(texts):
        j = same.setdefault(x.tobytes(), i)
        if j == i:
            kept.append(i)
        elif docs[i] != docs[j]:
            yield i, j
        parent[root(i)] = root(j)
        if labels and labels[i]:
            parent[root(i)] = root(named.setdefault(labels[i], i))
    if len({root(i) for i in kept}) < 2:
        return
    need = int(np.ceil(similarity * least))
    # All pieces as rows of shingle numbers, rarest first; 0 is an end or a shingle that no other piece has.
    sizes = np.array([len(texts[i]) for i in kept])
    ids = np.unique(np.concatenate([texts[i] for i in kept]), return_inverse=True)[1] + 1
    item = np.repeat(np.arange(len(kept)), sizes)
    places = np.cumsum(sizes) - sizes
    at = np.arange(len(ids)) - places[item]
    if middles:
        at -= np.array([middles[i] for i in kept])[item]
    near = np.abs(at) <= least if middles else slice(None)
    words, own = np.divmod(np.unique(ids[near] * len(kept) + item[near]), len(kept))
    while True:
        left = np.bincount(own, np.bincount(words)[words] > 1, len(kept))
        chosen = (left >= need)[own] & (np.bincount(words)[words] > 1)
        if chosen.all():
            break
        words, own = words[chosen], own[chosen]
    rows = np.flatnonzero(left >= need)
    classes = [root(kept[r]) for r in rows.tolist()]
    if len(set(classes)) < 2:
        return
    count = np.bincount(words, minlength=ids.max() + 1)
    order = np.lexsort((words, count[words], own))
    words, own = words[order], own[order]
    starts, ends = np.searchsorted(own, rows), np.searchsorted(own, rows, "right")
    item = np.searchsorted(rows, own)
    rare = np.arange(len(words)) <= ends[item] - need
    order = np.lexsort((item[rare], words[rare]))
    posted, bounds = item[rare][order], np.searchsorted(words[rare][order], np.arange(len(count) + 1))
    # All pieces in lines with their middles below each other. A passage is a row of `least` places or more around
    # the middle of which `share` or more are common shingles.
    share = 2 * similarity / (1 + similarity)
    before = max(0, -int(at.min()))
    width = max(before + int(at.max()) + 1, least)
    lines = np.zeros((len(rows), width), np.int32)
    for k, r in enumerate(rows.tolist()):
        first = before + int(at[places[r]])
        lines[k, first : first + sizes[r]] = ids[places[r] : places[r] + sizes[r]]
    begin = np.arange(min(width - least, before if middles else width) + 1)
    end = np.maximum(begin + least, before if middles else 0)
    held = np.zeros(len(count), bool)
    # The pieces of the largest class need no search of their own.
    largest = max(set(classes), key=classes.count)
    searched = np.array([c != largest for c in classes])
    for k in np.flatnonzero(searched).tolist():
        mine = words[starts[k] : ends[k]]
        lists = [posted[bounds[w] : bounds[w + 1]] for w in mine[: len(mine) - need + 1].tolist()]
        others = np.unique(np.concatenate(lists))
        others = others[~searched[others] | (others > k)]
        i = kept[rows[k]]
        others = others[np.array([root(kept[r]) != root(i) for r in rows[others].tolist()], bool)]
        if not len(others):
            continue
        line = lines[k][lines[k] > 0]
        held[line] = True
        spare = np.zeros((len(others), width + 1), np.float32)
        np.cumsum(held[lines[others]] - np.float32(share), axis=1, out=spare[:, 1:])
        held[line] = False
        best = np.maximum.accumulate(spare[:, ::-1], axis=1)[:, ::-1]
        others = others[(best[:, end] - spare[:, begin]).max(axis=1) >= -1e-3]
        for r in rows[others].tolist():
            j = kept[r]
            if root(j) == root(i):
                continue
            if any(not middles or a <= middles[j] <= b for a, b, *_ in verify(texts[j], texts[i], least, similarity)):
                parent[root(j)] = root(i)
                if docs[i] != docs[j]:
                    yield j, i


def connect_pieces(pieces: DataFrame, least: int, similarity: float) -> DataFrame:
    """Passages that connect the pieces of each key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle():
            texts = [np.frombuffer(data, "<u4") for _, _, data, _ in held]
            middles = [2 * least + min(0, lo) for _, lo, *_ in held]
            out = []
            for i, j in connect([d for d, *_ in held], texts, least, similarity, [label for *_, label in held], middles):
                (a, lo, *_), (b, other, *_) = held[i], held[j]
                lo, other = max(0, lo), max(0, other)
                for s, e, c, d, value in verify(texts[i], texts[j], least, similarity):
                    out.append((None, a, b, lo + s, lo + e + WIDTH - 1, other + c, other + d + WIDTH - 1, value))
            if out:
                yield batch_of(VERIFIED, *zip(*out))

        for batch in batches:
            for row in batch.to_pylist():
                if row["pair"] != at:
                    yield from settle()
                    at, held = row["pair"], []
                held.append((row["doc_id"], row["lo"], row["data"], row["side"]))
        yield from settle()

    return pieces.repartition("pair").sortWithinPartitions("pair", "doc_id", "lo").mapInArrow(
        read, "pair long, a long, b long, start long, end long, other_start long, other_end long, similarity double"
    )


def repeated_passages(
    docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, enough: int = ENOUGH
) -> DataFrame:
    """(a, b, start, end, other_start, other_end, similarity): passages that two documents share.

    Places count words, ends exclusive. A document is paired with the first one of each key, so
    copies are not expanded. Where one does not match the first, all windows of the key
    are searched through for pairs that connect whatever matches.
    """
    least = max(1, min_words - WIDTH + 1)
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    first_open = HASHES - enough + 1
    matches = join_windows(find_windows(known, least, buckets), least, buckets, first_open)
    aligned = scratch.save(find_candidates(matches, least, enough, buckets, first_open), "aligned")

    def read(pieces: DataFrame, name: str, need: int = 0) -> DataFrame:
        scratch.save(write_requests(pieces, scratch.path(name)), f"{name}-files")
        return read_pieces(known, scratch.path(name), need, least)

    pieces = read(pieces_of(aligned.where(f"kind = {PAIR}").select(*PLACES).distinct()), "requests")
    found = scratch.save(verify_pieces(pieces, least, similarity), "passages")
    scratch.drop("requests", "requests-files")
    copies = aligned.where(f"kind = {COPY}").select(
        F.lit(None).cast("long").alias("pair"), "a", "b", F.col("lo").alias("start"), (F.col("hi") + WIDTH - 1).alias("end"),
        F.col("other_lo").alias("other_start"), (F.col("other_hi") + WIDTH - 1).alias("other_end"), F.lit(1.0).alias("similarity"),
    )
    copies = scratch.save(copies, "copies")
    windows = scratch.save(open_windows(aligned, found, scratch), "open-windows")
    scratch.drop("aligned", "marked")
    # Pieces with fewer different shingles than a passage shares are compared as equal ones already.
    pieces = scratch.save(read(open_requests(windows, least), "open-requests", int(np.ceil(similarity * least))), "open-pieces")
    scratch.drop("open-requests", "open-requests-files", "open-windows")
    more = scratch.save(connect_pieces(open_pieces(pieces), least, similarity), "more-passages")
    scratch.drop("open-pieces")
    return found.unionByName(copies).unionByName(more).drop("pair")


def near_duplicates(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """One row per row of `docs` (doc_id, text): (doc_id, class_id, n_links, spans).

    class_id is the smallest doc_id that shared passages reach, the own one without any;
    n_links counts the documents it was compared with and shares a passage with, and
    spans lists its repeated passages as start:end in words, joined by commas. Null texts and
    texts below the least length share nothing; a null doc_id has a null class. Rows
    of one doc_id are one document. Passages repeated inside one document only do not count.
    """
    found = repeated_passages(docs, scratch, **options)
    both = found.select("a", "b", "start", "end").unionByName(
        found.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("other_start").alias("start"), F.col("other_end").alias("end"))
    )
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
        ).otherwise(F.concat(acc, F.array(s))),
    )
    text = F.array_join(F.transform(merged, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    by_doc = both.groupBy("a").agg(F.count_distinct("b").alias("n_links"), text.alias("spans"))
    label = components(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), scratch)
    joined = docs.select("doc_id").join(by_doc, F.col("doc_id") == F.col("a"), "left").join(
        label, F.col("doc_id") == F.col("id"), "left"
    )
    return joined.select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


@query("op3_passages")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "passages"))
