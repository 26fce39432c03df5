"""Which tokens of two tokenizers end together, with corpus-wide counts of the pairs.

The byte offsets where both a token of A and one of B end cut a text into groups; the two tokens
that end there are linked. The first pass over the documents finds the links and each task's own
counts. The distinct pairs are dealt to shards by hash, and a shard gets a minimal perfect hash:
levels of bits, a key's place being the rank of the first bit that it has for itself. Counts are
dense vectors in the order of that hash, one of each shard and branch of tasks, and are added up
a tree of branches. The second pass aligns the documents again and looks counts up; beside each
count lies its key, so that a pair that was never counted is seen as such.

Both tokenizers leave what stands on the two sides of a space apart, if another character stands
before it and no white space behind it (checked from the tokenizers' own descriptions; others are
given whole texts). So a text is cut there, and each distinct word is aligned once.
"""

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from hustings.llm.common import Scratch, attempt_file, batch_of, filesystem, keeper, mix, table
from hustings.llm.pieces import SPACE, PieceModel
from hustings.llm.registry import query
from hustings.llm.shingles import slices

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORDS = 300_000  # distinct words that a Python worker counts, or remembers, at once
SHARD = 1 << 16  # pairs of a shard, about
ARITY = 32  # vectors that one step of the tree adds up
ROOM = 1 << 25  # characters of the texts (or new words) after which it starts anew as well
KEPT = 128  # shards that a worker keeps while it looks counts up, about a MB each
# How byte-level tokenizers cut a text before they merge: a fixed value.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BREAK = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = re.compile(r" (?:\s|\Z)")


# --- two tokenizers --------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokenizers A (byte level) and B (pieces) with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            if all(c in letters for c in token):
                self.a_bytes[i] = bytes(letters[c] for c in token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(len(self.b))))
        ]
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.a_names = [str(i) for i in range(len(self.a_bytes))]
        self.b_names = [str(i) for i in range(len(self.b_bytes))]
        self.by_words = self._splits(a_path, b_path)
        self.fast = self._ranked(a_path) if self.by_words else None

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _ranked(self, a_path: str) -> tiktoken.Encoding | None:
        """A by the ranks of its tokens, which is the faster library; None where the ranks say less than the merges.

        Where ids rise with the merges, and every token alone is merged to itself, the best
        pair of neighbours that makes up a token is always the pair that its merge names.
        """
        with open(a_path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        single = [i for t, i in model["vocab"].items() if len(t) == 1]
        if len(single) != 256 or merged != sorted(set(merged)) or not merged or merged[0] <= max(single):
            return None
        ranks = {self.a_bytes[i]: i for i in [*single, *merged]}
        fast = tiktoken.Encoding("own", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        if any(fast._core_bpe.encode_single_piece(t) != [i] for t, i in ranks.items()):
            return None
        return fast

    def _splits(self, a_path: str, b_path: str) -> bool:
        """Whether both tokenizers are known to keep words apart."""
        with open(a_path, encoding="utf-8") as source:
            says = json.load(source)
        cut = says.get("pre_tokenizer") or {}
        level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        if not level or says.get("normalizer") or says.get("truncation") or says["model"].get("type") != "BPE":
            return False
        try:
            return PieceModel(b_path).prefix
        except ValueError:
            return False

    def words(self, text: str | None) -> list[str]:
        """The text cut into words, without the space before each; none if there is nothing to align."""
        if not text or (self.by_words and SPACE in text):
            return []
        if not self.by_words:
            return [text]
        if text[0] != " " and not ODD.search(text):
            return text.split(" ")
        first, *others = BREAK.split(" " + text)
        return [first[1:], *others]

    def _batches(self, words: list[str]) -> list[list[int]]:
        """Words that may be encoded together, as one text, by their places."""
        joined = [
            i for i, w in enumerate(words) if self.by_words and not w[:1].isspace() and w[-1:] not in ("", " ") and SPACE not in w
        ]
        held = set(joined)
        return [joined[i : i + 4096] for i in range(0, len(joined), 4096)] + [[i] for i in range(len(words)) if i not in held]

    def _cut(self, words: list[str]):
        """(a, b, ends of both in bytes, their common ends and where those are, the words' ends); None if bytes are lost."""
        text = " ".join(words)
        data = (" " + text).encode("utf-8", "replace")
        a, b = self.encode_a(" " + text), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_at = np.searchsorted(a_ends, b_ends)  # both end with the text
        b_at = np.flatnonzero(a_ends[a_at] == b_ends)
        a_at, ends = a_at[b_at], b_ends[b_at]
        word_ends = np.cumsum([len(w) + 1 if w.isascii() else len(w.encode("utf-8", "replace")) + 1 for w in words])
        return a, b, a_ends, b_ends, ends, a_at, b_at, word_ends

    def links(self, words: list[str], times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, counts) of the links of words that come so many times."""
        for batch in self._batches(words):
            found = self._cut([words[i] for i in batch])
            if found is not None:
                a, b, _, _, ends, a_at, b_at, word_ends = found
                yield a[a_at] << 32 | b[b_at], times[batch][np.searchsorted(word_ends, ends)]

    def align(self, words: list[str]) -> list[tuple[int, int, np.ndarray, str]]:
        """(tokens of A, tokens of B, keys of the links, groups) of each word, for itself.

        A word whose tokens don't give its bytes back has no tokens.
        """
        out: list = [None] * len(words)
        for batch in self._batches(words):
            for i, found in zip(batch, self._batch([words[i] for i in batch])):
                out[i] = found
        return out

    def _batch(self, words: list[str]) -> list[tuple[int, int, np.ndarray, str]]:
        found = self._cut(words)
        if found is None:
            return [(0, 0, np.zeros(0, np.int64), "")] * len(words)
        a, b, a_ends, b_ends, ends, a_at, b_at, word_ends = found
        keys = a[a_at] << 32 | b[b_at]
        a_text, b_text = [self.a_names[i] for i in a.tolist()], [self.b_names[i] for i in b.tolist()]
        groups, i, j = [], 0, 0
        for x, y in zip((a_at + 1).tolist(), (b_at + 1).tolist()):
            left = a_text[i] if x - i == 1 else ",".join(a_text[i:x])
            groups.append(f"{left}|{b_text[j] if y - j == 1 else ','.join(b_text[j:y])}")
            i, j = x, y
        to = np.searchsorted(ends, word_ends, "right")
        a_to, b_to = np.searchsorted(a_ends, word_ends, "right").tolist(), np.searchsorted(b_ends, word_ends, "right").tolist()
        out, g, i, j = [], 0, 0, 0
        for h, x, y in zip(to.tolist(), a_to, b_to):
            out.append((x - i, y - j, keys[g:h], ";".join(groups[g:h])))
            g, i, j = h, x, y
        return out


def aligner(a_path: str, b_path: str) -> Aligner:
    held = keeper("aligners")
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Aligner(a_path, b_path)
    return held[a_path, b_path]


def scrambled(keys: np.ndarray, level: int = 0) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


# --- a minimal perfect hash --------------------------------------------------------------


class PerfectHash:
    """Places 0 … n - 1 of n distinct keys, in about four bits a key.

    A level has two bits for each key that came so far; keys that meet no other one there
    have the bit's rank as their place, the others go on. Keys left after the last level are
    kept in order.
    """

    LEVELS = 40

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.cumsum(bits, dtype=np.int64) - bits for bits in levels]
        self.bases = np.cumsum([0, *(int(bits.sum()) for bits in levels)])

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left) and len(levels) < cls.LEVELS:
            size = max(64, 2 * len(left))
            at = (scrambled(left, 1 + len(levels)) % np.uint64(size)).astype(np.int64)
            times = np.bincount(at, minlength=size)
            levels.append(times == 1)
            left = left[times[at] > 1]
        return cls(levels, np.sort(left))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; of a key that is none of them, any place (or -1)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (scrambled(keys[open_], 1 + k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.bases[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[at] == keys[open_], self.bases[-1] + at, -1)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<i8")
        return b"".join([head.tobytes(), self.rest.astype("<i8").tobytes(), *(np.packbits(b).tobytes() for b in self.levels)])

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n, rest = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", n, 16).tolist()
        at = 16 + 8 * n
        left = np.frombuffer(data, "<i8", rest, at).astype(np.int64)
        at += 8 * rest
        levels = []
        for size in sizes:
            packed = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels, left)


# --- first pass and counts ---------------------------------------------------------------

LOCAL = "branch long, pair long, spot long, n long"
LOCAL_ARROW = pa.schema([(n, pa.int64()) for n in ("branch", "pair", "spot", "n")])
HASH_ARROW = pa.schema([("shard", pa.int64()), ("hash", pa.binary()), ("pairs", pa.binary())])
VECTOR_ARROW = pa.schema([("shard", pa.int64()), ("branch", pa.int64()), ("counts", pa.binary())])


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The links of each task's documents: (branch = the task, pair, spot = its scrambled key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        branch, room = TaskContext.get().partitionId(), 0
        seen: Counter = Counter()

        def counted() -> Iterator[pa.RecordBatch]:
            if not seen:
                return
            found = list(align.links(list(seen), np.fromiter(seen.values(), np.int64, len(seen))))
            keys, at = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in found] or [sums[:0]]))
            yield batch_of(LOCAL_ARROW, np.full(len(keys), branch), keys, scrambled(keys).view(np.int64), sums)

        for batch in batches:
            for _, texts in slices(batch.column("text")):
                for text in texts:
                    seen.update(align.words(text))
                    room += len(text or "")
                if len(seen) > WORDS or room > ROOM:
                    yield from counted()
                    seen.clear()
                    room = 0
        yield from counted()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, LOCAL)


def _bytes(column: pa.ChunkedArray) -> bytes:
    return column[0].as_py()


def build_shard(rows: pa.Table) -> pa.Table:
    """The hash of a shard's pairs, and the pairs in its order."""
    keys = rows["pair"].to_numpy()
    made = PerfectHash.of(keys)
    placed = np.empty_like(keys)
    placed[made.places(keys)] = keys
    return pa.Table.from_batches([batch_of(HASH_ARROW, [rows["shard"][0].as_py()], [made.to_bytes()], [placed.tobytes()])])


def dense(counts: pa.Table, hashes: pa.Table) -> pa.Table:
    """One branch's counts of a shard as a dense vector."""
    if not counts.num_rows:
        return VECTOR_ARROW.empty_table()
    made = PerfectHash.from_bytes(_bytes(hashes["hash"]))
    vector = np.zeros(int(made.bases[-1]) + len(made.rest), np.int64)
    np.add.at(vector, made.places(counts["pair"].to_numpy()), counts["n"].to_numpy())
    key = [counts["shard"][0].as_py()], [counts["branch"][0].as_py()]
    return pa.Table.from_batches([batch_of(VECTOR_ARROW, *key, [vector.tobytes()])])


def added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.int64) for c in rows["counts"])
    key = [rows["shard"][0].as_py()], [rows["branch"][0].as_py()]
    return pa.Table.from_batches([batch_of(VECTOR_ARROW, *key, [total.tobytes()])])


def pair_counts(
    docs: DataFrame, a_path: str, b_path: str, scratch: Scratch, shard: int = SHARD, arity: int = ARITY
) -> tuple[DataFrame, int]:
    """The distinct pairs, (shard, hash, pairs, counts) with the latter two in the hash's order, and the number of shards."""
    local = scratch.save(link_counts(docs, a_path, b_path), "local")
    distinct = scratch.save(local.select("pair", "spot").distinct(), "distinct")
    shards = max(1, -(-distinct.count() // shard))
    at = F.pmod("spot", F.lit(shards)).alias("shard")
    schema = "shard long, hash binary, pairs binary"
    hashes = scratch.save(distinct.select(at, "pair").groupBy("shard").applyInArrow(build_shard, schema), "hashes")
    branches = (local.agg(F.max("branch")).first()[0] or 0) // arity
    counts = local.select(at, F.expr(f"branch div {arity}").alias("branch"), "pair", "n")
    copies = hashes.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches).cast("long"))).alias("branch"), "hash")
    schema = "shard long, branch long, counts binary"
    level = scratch.save(
        counts.groupBy("shard", "branch").cogroup(copies.groupBy("shard", "branch")).applyInArrow(dense, schema), "vectors-0"
    )
    scratch.drop("local", "distinct")
    k = 0
    while branches:
        branches, k = branches // arity, k + 1
        up = level.withColumn("branch", F.expr(f"branch div {arity}")).groupBy("shard", "branch").applyInArrow(added, schema)
        level = scratch.save(up, f"vectors-{k}")
        scratch.drop(f"vectors-{k - 1}")
    return scratch.save(hashes.join(level.select("shard", "counts"), "shard"), "counts"), shards


def best_counts(counts: DataFrame, size: int) -> np.ndarray:
    """The highest count of each token of B: a vector as long as its vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(size, np.int64)
        for batch in batches:
            for pairs, found in zip(batch.column("pairs"), batch.column("counts")):
                np.maximum.at(best, np.frombuffer(pairs.as_py(), np.int64) & 0xFFFFFFFF, np.frombuffer(found.as_py(), np.int64))
        some = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(best[some])], names=["b", "n"])

    rows = counts.select("pairs", "counts").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(size, np.int64)
    best[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return best


def write_shards(counts: DataFrame, folder: str) -> dict[int, str]:
    """A file of each shard; there are at most |A| × |B| / 65,536 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, *parts in zip(*(batch.column(n).to_pylist() for n in ("shard", "hash", "pairs", "counts"))):
                fs, path, uri = attempt_file(folder, f"shard-{shard}", ".pairs")
                with fs.open_output_stream(path, compression=None) as sink:
                    sink.write(np.array([len(p) for p in parts], "<i8").tobytes())
                    for part in parts:
                        sink.write(part)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([uri])], names=["shard", "uri"])

    return {r["shard"]: r["uri"] for r in counts.mapInArrow(run, "shard long, uri string").collect()}


class PairCounts:
    """Looks up counts; a worker reads a shard when it first needs it and keeps the last ones."""

    def __init__(self, files: dict[int, str], shards: int, kept: int = KEPT):
        self.files, self.shards, self.kept = files, shards, kept
        self.open: dict[int, tuple] = {}

    def _shard(self, k: int) -> tuple:
        found = self.open.pop(k, None)
        if found is None:
            fs, path = filesystem(self.files[k])
            with fs.open_input_file(path) as source:
                data = source.read()
            a, b, _ = np.frombuffer(data, "<i8", 3).tolist()
            found = PerfectHash.from_bytes(data[24 : 24 + a]), np.frombuffer(data[24 + a :], "<i8").reshape(2, b // 8)
            if len(self.open) >= self.kept:
                del self.open[next(iter(self.open))]
        self.open[k] = found
        return found

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for pairs that were not counted."""
        out = np.zeros(len(keys), np.int64)
        if not len(keys):
            return out
        spots = scrambled(keys).view(np.int64) % self.shards
        order = np.argsort(spots, kind="stable")
        cuts = np.flatnonzero(np.diff(spots[order])) + 1
        for part in np.split(order, cuts):
            if int(spots[part[0]]) not in self.files:
                continue
            made, (pairs, counts) = self._shard(int(spots[part[0]]))
            place = made.places(keys[part])
            known = (place >= 0) & (pairs[place] == keys[part])
            out[part[known]] = counts[place[known]]
        return out


# --- second pass -------------------------------------------------------------------------

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(
    docs: DataFrame, a_path: str, b_path: str, scratch: Scratch | None = None, words: int = WORDS, shard: int = SHARD, arity: int = ARITY
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): a row per row of `docs`.

    A is given a space and the text, B the text. `groups` is `a1,a2|b1;a3|b2,b3` in the order of
    the text. Null and empty texts, and texts that the tokens don't give back, have no tokens:
    zeros and an empty string; they count nowhere. Repeated rows count as often as they come.
    Columns other than doc_id and text are not looked at. Both files must lie at their paths on
    every executor.
    """
    scratch = scratch or Scratch(docs.sparkSession, "alignment")
    counts, shards = pair_counts(docs, a_path, b_path, scratch, shard, arity)
    best = best_counts(counts, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    files = write_shards(counts, scratch.path("files"))
    state = scratch.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        held = keeper("aligners").setdefault("memo", {})
        if held.get("state") != state:  # words of another run have other counts
            numbers = np.zeros((1 << 12, 5), np.int64)
            held.update(state=state, places={}, groups=[], room=0, numbers=numbers, look=PairCounts(files, shards))
        places, groups, look = held["places"], held["groups"], held["look"]

        def learn(new: list[str]) -> None:
            found = align.align(new)
            keys = np.concatenate([f[2] for f in found])
            n = look.look_up(keys)
            top = np.cumsum(np.concatenate([[0], n == best[keys & 0xFFFFFFFF]]))
            sums = np.cumsum(np.concatenate([[0], n]))
            ends = np.cumsum([0, *(len(f[2]) for f in found)])
            first = len(groups)
            while first + len(new) > len(held["numbers"]):
                held["numbers"] = np.concatenate([held["numbers"], np.zeros_like(held["numbers"])])
            part = held["numbers"][first : first + len(new)]
            part[:, 0], part[:, 1] = [f[0] for f in found], [f[1] for f in found]
            part[:, 2], part[:, 3], part[:, 4] = np.diff(ends), np.diff(top[ends]), np.diff(sums[ends])
            held["room"] += sum(map(len, new))
            groups.extend(f[3] for f in found)
            places.update(zip(new, range(first, first + len(new))))

        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in slices(batch.column("text")):
                if len(groups) > words or held["room"] > ROOM:
                    places.clear()
                    groups.clear()
                    held["room"] = 0
                cut = [align.words(t) for t in texts]
                new = set().union(*cut).difference(places)
                if new:
                    learn(list(new))
                totals, texts_out = np.zeros((len(cut), 5), np.int64), []
                for i, own in enumerate(cut):
                    at = list(map(places.__getitem__, own))
                    totals[i] = held["numbers"][at].sum(axis=0) if at else 0
                    texts_out.append(";".join(map(groups.__getitem__, at)))
                a, b, links, top, sums = map(pa.array, totals.T)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(cut)), a, b, links, links, top, sums, pa.array(texts_out, pa.string())],
                    names=["doc_id", *COUNTS, "groups"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


@query("op12_aligned_tokens")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"), public_tokenizers.path(A), public_tokenizers.path(B))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", *COUNTS, digest.alias("groups_sha256"))
