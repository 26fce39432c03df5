"""Token ids in bit-packed files.

A shard is one file of a sorted range of documents:

    magic "TIDS" | u32 version | u32 bits | u32 block
    blocks: `block` ids each (the last may hold fewer), every id in `bits` bits, least
            significant bit first, each block padded to whole bytes
    footer: u64 offset of each block | u64 first id position and i64 doc_id of each document
            (u8 null flag beside it)
    trailer: u64 footer offset | u64 blocks | u64 documents | u64 ids | "TIDS"

Fixed width makes every id addressable: id p lies in block p // block at bit
(p % block) * bits. A reader unpacks any range of ids with a few numpy operations, and
without touching the rest of the file.
"""

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from hustings.llm.common import Scratch, attempt_file, batch_of, filesystem, keeper, table
from hustings.llm.registry import query

MAGIC = b"TIDS"
HEAD = "<4sIII"
TAIL = "<QQQQ4s"
END_ID = 2
MEMO = 1_500_000  # distinct words whose ids a Python worker remembers

SHARDS = "path string, docs long, ids long, first long, last long"
SHARDS_ARROW = pa.schema(
    [("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]
)


# --- packing -------------------------------------------------------------------------


def width(vocabulary: int) -> int:
    """Bits that hold the ids 0 … vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.unpackbits(wide, axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """`count` ids from id `start` of a packed block."""
    at = (np.arange(start, start + count, dtype=np.int64)) * bits
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    byte = at >> 3
    word = np.zeros(count, np.uint64)
    for k in range((bits + 7 + 7) // 8):
        word |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class ShardWriter:
    """Appends documents; memory holds one block and the footer."""

    def __init__(self, sink, bits: int, block: int):
        self.sink, self.bits, self.block = sink, bits, block
        self.sink.write(struct.pack(HEAD, MAGIC, 1, bits, block))
        self.at = struct.calcsize(HEAD)
        self.offsets: list[int] = []
        self.starts: list[int] = []
        self.doc_ids: list[int | None] = []
        self.total = 0
        self.open: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.starts.append(self.total)
        self.doc_ids.append(doc_id)
        self.total += len(ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            data = pack(ids[i : min(i + self.block, whole)], self.bits)
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.open, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.sink.write(nulls.tobytes())
        self.sink.write(struct.pack(TAIL, self.at, len(self.offsets), len(self.starts), self.total, MAGIC))


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, source, size: int):
        self.source = source
        magic, version, self.bits, self.block = struct.unpack(HEAD, source.read_at(struct.calcsize(HEAD), 0))
        foot, blocks, docs, self.total, tail = struct.unpack(TAIL, source.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or tail != MAGIC or version != 1:
            raise ValueError("not a token file")
        data = source.read_at(size - struct.calcsize(TAIL) - foot, foot)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(foot)).astype(np.int64)
        self.starts = np.append(np.frombuffer(data, "<u8", docs, 8 * blocks), np.uint64(self.total)).astype(np.int64)
        self.doc_ids = np.frombuffer(data, "<i8", docs, 8 * (blocks + docs))
        self.nulls = np.frombuffer(data, np.uint8, docs, 8 * (blocks + 2 * docs)).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of positions start … stop - 1."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        lo, hi = int(self.offsets[first]), int(self.offsets[last + 1])
        data = self.source.read_at(hi - lo, lo)
        if (self.block * self.bits) % 8 == 0:  # no padding between blocks
            return unpack(data, self.bits, start - first * self.block, stop - start)
        parts = []
        for b in range(first, last + 1):
            at = max(start, b * self.block) - b * self.block
            to = min(stop, (b + 1) * self.block) - b * self.block
            parts.append(unpack(data[self.offsets[b] - lo : self.offsets[b + 1] - lo], self.bits, at, to - at))
        return np.concatenate(parts)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# --- encoding ------------------------------------------------------------------------

PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:-@[-`{-~]*)")


#: Texts whose ids must be those of their words, or the tokenizer gets whole texts: case, digits,
#: runs of white space of each kind at the beginning, inside and at the end, marks apart from words.
SPACED = (
    "Two Words", " leading and  double  spaces ", "line\nbreaks\r\nand\ttabs\x0band\x0cfeeds\n\n", "MIXED Case CamelCase Ünïcode ÀÉ",
    "12 345 6,789 a1 1a", "it's 'quoted' ( apart ) . . . -- !", "x y  z   x", "naïve café 東京 и т.д. 🙂 ok", "a\n b \n\n  c",
)


class Encoder:
    """The tokenizer's ids of whole texts, word by word where the tokenizer allows it.

    A tokenizer that drops white space and joins nothing across it gives a text the ids of its
    words in order, and a repeated word needs no second look. Words of Latin letters with
    ASCII marks behind them fall into two pieces, which go straight to the tokenizer's
    model if it is one that lower-cases; all other words go through the whole tokenizer. A
    tokenizer is asked for both; one that differs on any probe gets whole texts.
    """

    def __init__(self, path: str, memo: int = MEMO):
        self.memo = memo
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters = self._byte_letters()
        self.by_word = self._drops_spaces()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _drops_spaces(self) -> bool:
        """Whether texts have the ids of their words, as this class would look them up."""
        if any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        for text, whole in zip(SPACED, self._whole(list(SPACED))):
            words = text.encode("utf-8").split()
            self._learn(set(words))
            if b"".join(self.words[w] for w in words) != np.array(whole, self.kind).tobytes():
                self.words.clear()
                self.pieces.clear()
                return False
        return True

    def _byte_letters(self) -> dict[int, str] | None:
        """How the pre-tokenizer writes each plain character; None if it does more than that, or keeps case."""
        plain = [chr(c) for c in range(0x21, 0x100) if PLAIN.fullmatch(chr(c))]
        found = {}
        for c in plain:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(c) if self.tokenizer.pre_tokenizer else []
            if len(pieces) != 1:
                return None
            found[ord(c)] = pieces[0][0]
        probe = ["naïvetés", "über,", "abc.)]", "x", "Words", "UPPER!", "iPhone", "ÀÉÎ"]
        for word in probe:
            first, second = PLAIN.fullmatch(word.lower()).groups()
            parts = [p.translate(found) for p in (first, second) if p]
            ids = [t.id for p in parts for t in self.tokenizer.model.tokenize(p)]
            if ids != self.tokenizer.encode(word, add_special_tokens=False).ids:
                return None
        return found

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            tokens = self.tokenizer.model.tokenize(piece.translate(self.letters))
            ids = self.pieces[piece] = np.array([t.id for t in tokens], self.kind).tobytes()
        return ids

    def _learn(self, words: set[bytes]) -> None:
        rest = []
        for word in words:
            text = word.decode("utf-8", "replace")
            plain = PLAIN.fullmatch(text.lower()) if self.letters else None
            if plain:
                first, second = plain.groups()
                self.words[word] = (self._piece(first) if first else b"") + (self._piece(second) if second else b"")
            else:
                rest.append((word, text))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            encoded = self.tokenizer.encode_batch([t for _, t in part], add_special_tokens=False)
            for (word, _), found in zip(part, encoded):
                self.words[word] = np.array(found.ids, self.kind).tobytes()

    def encode(self, texts: list[str | None], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and `end_id`."""
        if len(self.words) > self.memo:
            self.words.clear()
            self.pieces.clear()
        end = np.array([end_id], self.kind).tobytes()
        if not self.by_word:
            whole = self._whole([t.encode("utf-8", "replace").decode("utf-8") if t else "" for t in texts])
            for found in whole:
                yield np.frombuffer(np.array(found, self.kind).tobytes() + end, self.kind)
            return
        get = self.words.get
        # Bytes are split at ASCII white space alone: other spaces are left to the tokenizer.
        split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
        ids = [list(map(get, words)) for words in split]
        new: set[bytes] = set()
        for words, own in zip(split, ids):
            if None in own:
                new.update(w for w, i in zip(words, own) if i is None)
        self._learn(new)
        for words, own in zip(split, ids):
            if None in own:
                own = map(get, words)
            yield np.frombuffer(b"".join(own) + end, self.kind)


def encoder(path: str, memo: int = MEMO) -> Encoder:
    held = keeper("encoders")
    if (path, memo) not in held:
        held[path, memo] = Encoder(path, memo)
    return held[path, memo]


# --- writing and reading -------------------------------------------------------------


def write_shards(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = 4096, memo: int = MEMO
) -> DataFrame:
    """Encode `docs` (doc_id, text) into files of `folder`, in ascending doc_id order.

    Returns one row per file: (path, docs, ids, first, last). One range shuffle of the texts;
    a task then encodes and writes its range in one pass. Null texts are empty, rows with
    a null doc_id come first, and rows of one doc_id are ordered by text. Save the result once;
    files of attempts that it does not name are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, memo)
        writer = sink = uri = None
        first = last = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 256):
                if ids and writer is None:
                    fs, path, uri = attempt_file(folder, "tokens", ".tids")
                    sink = fs.open_output_stream(path, compression=None)
                    writer, first = ShardWriter(sink, width(encode.vocabulary), block), ids[0]
                part = texts.slice(i, 256).to_pylist()
                for doc_id, found in zip(ids[i : i + 256], encode.encode(part, end_id)):
                    writer.add(doc_id, found)
                    last = doc_id
        if writer is not None:
            writer.close()
            sink.close()
            yield batch_of(SHARDS_ARROW, [uri], [len(writer.starts)], [writer.total], [first], [last])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, SHARDS)


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
ROWS_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    `start` counts the ids of all documents before; it needs one running sum over the files
    (a row each), not over documents.
    """
    from pyspark.sql import Window

    before = Window.orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "path").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as source:
                    shard = ShardReader(source, source.size())
                    n = len(shard.doc_ids)
                    k = 0
                    while k < n:
                        # As many documents as a few blocks hold, one at least.
                        to = int(np.searchsorted(shard.starts, shard.starts[k] + 64 * shard.block, "right")) - 1
                        to = min(max(to, k + 1), n)
                        at = shard.starts[k : to + 1]
                        ids = shard.ids(int(at[0]), int(at[-1])).astype("<u4")
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                        yield batch_of(
                            ROWS_ARROW,
                            pa.array(shard.doc_ids[k:to], mask=shard.nulls[k:to]),
                            at[:-1] + base,
                            np.diff(at),
                            crc,
                        )
                        k = to

    # About a file a task (a stated number of partitions is not merged again); a task holds one
    # file's footer and a few blocks.
    spread = placed.select("path", "base").repartition(max(1, shards.count()), "path")
    return spread.mapInArrow(read, ROWS)


def token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = END_ID,
    block: int = 4096,
    memo: int = MEMO,
) -> DataFrame:
    """Write `docs` as token files and read them back: one row per document.

    Columns of `docs` other than doc_id and text are not looked at. `memo` is the number of words
    whose ids a Python worker remembers, about 300 bytes each. An empty table gives no
    files and no rows; an empty text is its end id alone.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    shards = scratch.save(write_shards(docs, folder or scratch.path("files"), tokenizer, end_id, block, memo), "shards")
    return read_shards(shards)


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
