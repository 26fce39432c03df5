"""An n-gram language model in memory-mapped Elias-Fano tries, built and queried by Spark.

Level one is the vocabulary: the sorted word hashes of 256 parts of the hash space with running
counts; a word's rank over all parts is its id. Level two holds the successors of every
word: pair (u, w) is the number (u - first u) · V + w, an Elias-Fano sequence that is searched
relative to its context u, with the monotone pointers of the contexts as a second sequence
and one byte per pair for the quantised discounted probability.

The trie is cut into files of about `shard_tokens` tokens. The place of (u, w) among the files
follows from the running counts: a frequent word's successors spread over as many files as its
count asks for, so neither a file nor a task grows with a frequent word. Scoring maps the files
it meets; memory holds one batch of texts.

P(w | u) = max(c(uw) - D, 0) / c(u) + D · t(u) / c(u) · P(w), where t(u) is the number of
different successors; P(w) = (c(w) + 0.1) / (N + 0.1 · (V + 1)). A text starts after an end.
"""

import json
import mmap
import tempfile
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, batch_of, filesystem, keeper, table
from hustings.llm.eliasfano import Sequence
from hustings.llm.registry import query
from hustings.llm.shingles import slices, word_hashes

END = np.uint64(0)  # stands for the end of a text, as a word and as the first context
PARTS = 256
ADD = 0.1
DISCOUNT = 0.75
SHARD_TOKENS = 4_000_000
FLUSH_TOKENS = 3_000_000
OPEN_FILES = 256


# --- files -----------------------------------------------------------------------------


def write_arrays(uri: str, meta: dict, arrays: dict[str, np.ndarray]) -> None:
    """A file of named arrays; written aside and moved, so a file is whole or absent.

    The content depends on the input alone, so a second attempt of a task replaces the file
    by the same bytes.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    at, places = 0, {}
    for name, a in arrays.items():
        places[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"meta": meta, "places": places}).encode()
    head += b" " * (-len(head) % 8)
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside, compression=None) as sink:
        sink.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            sink.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    fs.move(aside, path)


def map_arrays(uri: str) -> tuple[dict, dict[str, np.ndarray]] | None:
    """The arrays of a file as views of the mapped file; None if there is no such file."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    if not isinstance(fs, pafs.LocalFileSystem):  # only a local file can be mapped: copy it, until the worker ends
        folder = keeper("copies", small=True).setdefault("folder", tempfile.TemporaryDirectory())
        copy = f"{folder.name}/{zlib.crc32(uri.encode()):08x}-{path.rsplit('/', 1)[-1]}"
        pafs.copy_files(path, copy, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        path = copy
    with open(path, "rb") as file:
        data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    size = int.from_bytes(data[:8], "little")
    head = json.loads(data[8 : 8 + size])
    found = {n: np.frombuffer(data, t, k, 8 + size + at) for n, (t, at, k) in head["places"].items()}
    return head["meta"], found


# --- vocabulary ------------------------------------------------------------------------


class Vocabulary:
    """Ids, counts and running counts of words, from the mapped parts."""

    def __init__(self, folder: str, sizes: list[tuple[int, int]]):
        """`sizes`: words and tokens of each of the PARTS parts."""
        self.folder = folder
        self.first = np.concatenate([[0], np.cumsum([n for n, _ in sizes])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum([t for _, t in sizes])]).astype(np.int64)
        self.words, self.tokens = int(self.first[-1]), int(self.before[-1])
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.parts:
            _, found = map_arrays(f"{self.folder}/words-{k}.bin")
            self.parts[k] = found["hash"], found["upto"]
        return self.parts[k]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, running count before) of sorted distinct hashes."""
        ids = np.full(len(hashes), -1, np.int64)
        count, upto = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, np.arange(PARTS, dtype=np.uint64) << np.uint64(56))
        cuts = np.append(cuts, len(hashes))
        for k in np.flatnonzero((cuts[1:] > cuts[:-1]) & (self.first[1:] > self.first[:-1])).tolist():
            own = slice(cuts[k], cuts[k + 1])
            keys, sums = self.part(k)
            at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
            hit = keys[at] == hashes[own]
            ids[own] = np.where(hit, self.first[k] + at, -1)
            before = sums[at].astype(np.int64)
            count[own] = np.where(hit, sums[at + 1].astype(np.int64) - before, 0)
            upto[own] = self.before[k] + before
        return ids, count, upto


def texts_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end behind every text, and the offsets of the texts."""
    words, offsets = word_hashes(texts)
    n = np.diff(offsets)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    found = np.full(bounds[-1], END)
    inner = np.ones(len(found), bool)
    inner[bounds[1:] - 1] = False
    found[inner] = words[offsets[0] : offsets[-1]]
    return found, bounds


COUNT = pa.schema([("part", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())])
SIZES = pa.schema([("part", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())])


def build_vocabulary(texts: DataFrame, folder: str, scratch: Scratch) -> Vocabulary:
    """Count all words of `texts` (text) and write the parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield batch_of(COUNT, (k >> np.uint64(56)).astype(np.int32), k.astype(np.int64), n[i : i + 100_000])

        for batch in batches:
            for _, part in slices(batch.column("text")):
                held.append(texts_of(part)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle():
            keys = np.concatenate([k for k, _ in held]).astype(np.uint64)
            order = np.argsort(keys)
            upto = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in held])[order])])
            write_arrays(f"{folder}/words-{at}.bin", {}, {"hash": keys[order], "upto": upto.astype("<u8")})
            return batch_of(SIZES, [at], [len(keys)], [int(upto[-1])])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            hashes, n = batch.column("hash").to_numpy(), batch.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if parts[a] != at:
                    if held:
                        yield settle()
                    at, held = int(parts[a]), []
                held.append((hashes[a:b], n[a:b]))
        if held:
            yield settle()

    counts = texts.mapInArrow(count, "part int, hash long, n long").groupBy("part", "hash").agg(F.sum("n").alias("n"))
    dealt = counts.repartition(PARTS, "part").sortWithinPartitions("part")
    sizes = scratch.save(dealt.mapInArrow(write, "part int, words long, tokens long"), "word-parts")
    found = {r["part"]: (r["words"], r["tokens"]) for r in sizes.collect()}
    return Vocabulary(folder, [found.get(k, (0, 0)) for k in range(PARTS)])


# --- pairs -----------------------------------------------------------------------------


def shard_of(upto: np.ndarray, count: np.ndarray, w: np.ndarray, words: int, shard_tokens: int) -> np.ndarray:
    """The file of pair (u, w), from u's running count and count: never lower for a later pair."""
    return ((upto + count * (w / max(words, 1))) // shard_tokens).astype(np.int64)


class Shard:
    """Successors of a range of contexts."""

    def __init__(self, meta: dict, arrays: dict[str, np.ndarray]):
        self.first, self.last, self.words = meta["first"], meta["last"], meta["words"]
        self.low, self.step = meta["low"], meta["step"]
        names = ("low", "high", "ones", "zeros")
        self.pairs = Sequence(meta["pairs"], meta["pair_bits"], [arrays[f"pair_{n}"] for n in names])
        self.pointers = Sequence(meta["pointers"], meta["pointer_bits"], [arrays[f"pointer_{n}"] for n in names])
        self.codes = arrays["codes"]

    @staticmethod
    def build(uri: str, u: np.ndarray, w: np.ndarray, n: np.ndarray, count: np.ndarray, words: int) -> int:
        """Write the file of sorted distinct pairs with their counts and their contexts' counts."""
        first, last = int(u[0]), int(u[-1])
        values = (u - first).astype(np.uint64) * np.uint64(words) + w.astype(np.uint64)
        pairs, pair_parts = Sequence.build(values, (last - first + 1) * words)
        ends = np.searchsorted(u, np.arange(first, last + 2))
        pointers, pointer_parts = Sequence.build(ends, len(u) + 1)
        logs = np.log10((n - DISCOUNT) / count)
        low, step = float(logs.min()), float((logs.max() - logs.min()) / 255 or 1.0)
        names = ("low", "high", "ones", "zeros")
        arrays = {f"pair_{k}": a for k, a in zip(names, pair_parts)}
        arrays |= {f"pointer_{k}": a for k, a in zip(names, pointer_parts)}
        arrays["codes"] = np.rint((logs - low) / step).astype(np.uint8)
        meta = {
            "first": first, "last": last, "words": words, "low": low, "step": step, "pairs": pairs.n,
            "pair_bits": pairs.low_bits, "pointers": pointers.n, "pointer_bits": pointers.low_bits,
        }
        write_arrays(uri, meta, arrays)
        return len(u)

    def successors(self, u: np.ndarray) -> np.ndarray:
        """How many different successors each context has here."""
        found = np.zeros(len(u), np.int64)
        own = (u >= self.first) & (u <= self.last)
        at = u[own] - self.first
        found[own] = self.pointers.get(at + 1).astype(np.int64) - self.pointers.get(at).astype(np.int64)
        return found

    def discounted(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The stored probability of each pair, 0 for pairs that were not seen."""
        found = np.zeros(len(u))
        own = np.flatnonzero((u >= self.first) & (u <= self.last))
        values = (u[own] - self.first).astype(np.uint64) * np.uint64(self.words) + w[own].astype(np.uint64)
        at = self.pairs.find(values)
        hit = at >= 0
        found[own[hit]] = 10.0 ** (self.low + self.step * self.codes[at[hit]])
        return found


class Model:
    """The whole model as a task sees it: mapped files, opened when they are met."""

    def __init__(self, folder: str, vocabulary: Vocabulary, shard_tokens: int):
        self.folder, self.vocabulary, self.shard_tokens = folder, vocabulary, shard_tokens
        self.open: OrderedDict[int, Shard | None] = OrderedDict()
        self.spread: dict[int, int] = {}

    def shard(self, k: int) -> Shard | None:
        if k not in self.open:
            found = map_arrays(f"{self.folder}/pairs-{k}.bin")
            self.open[k] = Shard(*found) if found else None
            if len(self.open) > OPEN_FILES:
                self.open.popitem(last=False)
        self.open.move_to_end(k)
        return self.open[k]

    def successors(self, u: np.ndarray, count: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """t(u) of sorted contexts: from one file, or from all that a frequent word spreads over."""
        total = self.vocabulary.words
        lo = shard_of(upto, count, np.zeros(len(u)), total, self.shard_tokens)
        hi = shard_of(upto, count, np.full(len(u), total - 1), total, self.shard_tokens)
        found = np.zeros(len(u), np.int64)
        one = lo == hi
        for k in np.unique(lo[one]).tolist():
            own = one & (lo == k)
            if shard := self.shard(k):
                found[own] = shard.successors(u[own])
        for i in np.flatnonzero(~one).tolist():
            if int(u[i]) not in self.spread:
                opened = (self.shard(k) for k in range(int(lo[i]), int(hi[i]) + 1))
                self.spread[int(u[i])] = sum(int(s.successors(u[i : i + 1])[0]) for s in opened if s)
            found[i] = self.spread[int(u[i])]
        return found

    def score(self, texts: list[str | None]) -> list[np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        tokens, bounds = texts_of(texts)
        distinct, at = np.unique(tokens, return_inverse=True)
        ids, count, upto = self.vocabulary.look_up(distinct)
        size = self.vocabulary.tokens + ADD * (self.vocabulary.words + 1)
        single = (count + ADD) / size
        starts = bounds[:-1]
        # The context of a token is the one before it, of a text's first token an end.
        previous = np.empty(len(at), np.int64)
        previous[1:] = at[:-1]
        previous[starts] = 0 if len(distinct) and distinct[0] == END else -1
        keys, where = np.unique(previous * len(distinct) + at, return_inverse=True)
        u, w = keys // len(distinct), keys % len(distinct)
        t = np.zeros(len(distinct), np.int64)
        known = ids >= 0
        t[known] = self.successors(ids[known], count[known], upto[known])
        seen = np.zeros(len(keys))
        pairs = np.flatnonzero(known[u] & known[w])
        shards = shard_of(upto[u[pairs]], count[u[pairs]], ids[w[pairs]], self.vocabulary.words, self.shard_tokens)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)]):
            if shard := self.shard(int(shards[a])):
                own = pairs[a:b]
                seen[own] = shard.discounted(ids[u[own]], ids[w[own]])
        rest = np.where(count[u] > 0, DISCOUNT * t[u] / np.maximum(count[u], 1), 1.0)
        logs = np.log10(seen + rest * single[w])[where]
        return [
            np.diff(bounds),
            np.add.reduceat((count > 0)[at].astype(np.int64), starts),
            np.add.reduceat(np.log10(single)[at], starts),
            np.add.reduceat(logs, starts),
        ]


BLOB = pa.schema([("shard", pa.int64()), ("data", pa.binary())])
BUILT = pa.schema([("shard", pa.int64()), ("pairs", pa.int64())])


def train(texts: DataFrame, folder: str, scratch: Scratch, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count words and pairs of all `texts` (text) and write the model's files into `folder`.

    Two passes over the texts. Pairs are counted in each task before the shuffle, which then
    carries one sorted block per task and file.
    """
    vocabulary = build_vocabulary(texts, folder, scratch)
    words = vocabulary.words

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            tokens = np.concatenate([np.array([END]), *held])
            held.clear()
            distinct, at = np.unique(tokens, return_inverse=True)
            ids, count, upto = vocabulary.look_up(distinct)
            keys, n = np.unique(at[:-1] * len(distinct) + at[1:], return_counts=True)
            u, w = keys // len(distinct), keys % len(distinct)
            shards = shard_of(upto[u], count[u], ids[w], words, shard_tokens)
            # Hash order is id order, so pairs are sorted, and so are their files.
            cuts = np.flatnonzero(np.diff(shards, prepend=-1))
            rows, weight = [], 0
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shards)]):
                own = ids[u[a:b]]
                parts = [
                    np.array([b - a, own[0]], "<i8"), np.diff(own, prepend=own[0]).astype("<u4" if words < 1 << 32 else "<u8"),
                    ids[w[a:b]].astype("<u4" if words < 1 << 32 else "<u8"), n[a:b].astype("<u4"),
                ]
                rows.append((int(shards[a]), b"".join(p.tobytes() for p in parts)))
                weight += len(rows[-1][1])
                if weight > 4 << 20:
                    yield batch_of(BLOB, *zip(*rows))
                    rows, weight = [], 0
            if rows:
                yield batch_of(BLOB, *zip(*rows))

        for batch in batches:
            for _, part in slices(batch.column("text")):
                held.append(texts_of(part)[0])  # each ends with an end, so the next begins after one
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle():
            u, w, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((w, u))
            u, w, n = u[order], w[order], n[order]
            starts = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
            u, w, n = u[starts], w[starts], np.add.reduceat(n, starts)
            return batch_of(BUILT, [at], [Shard.build(f"{folder}/pairs-{at}.bin", u, w, n, counts_of(u), words)])

        def counts_of(u: np.ndarray) -> np.ndarray:
            distinct, back = np.unique(u, return_inverse=True)
            part = np.searchsorted(vocabulary.first, distinct, "right") - 1
            found = np.zeros(len(distinct), np.int64)
            for k in np.unique(part).tolist():
                own = part == k
                place = distinct[own] - vocabulary.first[k]
                sums = vocabulary.part(k)[1].astype(np.int64)
                found[own] = sums[place + 1] - sums[place]
            return found[back]

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                if shard != at:
                    if held:
                        yield settle()
                    at, held = shard, []
                held.append(unblob(data.as_py(), words))
        if held:
            yield settle()

    blobs = texts.mapInArrow(pairs, "shard long, data binary")
    files = max(1, -(-vocabulary.tokens // shard_tokens))
    dealt = blobs.repartition(files, "shard").sortWithinPartitions("shard")
    scratch.save(dealt.mapInArrow(build, "shard long, pairs long"), "pair-files")
    return Model(folder, vocabulary, shard_tokens)


def unblob(data: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = "<u4" if words < 1 << 32 else "<u8"
    size, first = np.frombuffer(data, "<i8", 2).tolist()
    wide = np.dtype(kind).itemsize
    u = first + np.cumsum(np.frombuffer(data, kind, size, 16).astype(np.int64))
    w = np.frombuffer(data, kind, size, 16 + wide * size).astype(np.int64)
    return u, w, np.frombuffer(data, "<u4", size, 16 + 2 * wide * size).astype(np.int64)


SCORED = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of `docs` (doc_id, held_out, text)."""
    folder, vocabulary, shard_tokens = model.folder, model.vocabulary, model.shard_tokens

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = keeper("language-model")
        if held.get("folder") != folder:  # the worker's maps outlive a task, but not a model
            held.clear()
            held.update(folder=folder, model=Model(folder, vocabulary, shard_tokens))
        own = held["model"]
        for batch in batches:
            for first, texts in slices(batch.column("text"), 8 << 20):
                rows = batch.slice(first, len(texts))
                n, known, base, found = own.score(texts)
                total = np.full(len(texts), own.vocabulary.tokens)
                yield batch_of(SCORED, rows.column("doc_id"), rows.column("held_out"), n, known, total, base, found)

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return docs.select("doc_id", "held_out", "text").mapInArrow(scored, schema)


def score_corpus(docs: DataFrame, held_out, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Train on the rows of `docs` (doc_id, text) that are not `held_out` and score all of them.

    Null and empty texts are an end alone; a null doc_id is neither learned from nor held out.
    Repeated rows count as often as they come. Without a row to learn from every word is
    unknown: N and V are 0.
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    marked = docs.select("doc_id", "text", held_out.alias("held_out"))
    model = train(marked.where("NOT held_out").select("text"), folder or scratch.path("files"), scratch, shard_tokens)
    return score(marked.withColumn("held_out", F.coalesce("held_out", F.lit(False))), model)


@query("op8_language_model")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_corpus(table(spark, sf_dir, "documents"), held_out)
