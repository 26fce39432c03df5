"""SentencePiece models of merge type: exact encoding by backtracking, and decoding.

A merge-type model joins, again and again, the two neighbours whose joint text has the best
score, the leftmost of equals. A row of pieces is the model's answer if and only if merging the
text of each two neighbours alone gives these two again: the first merge across a border of the
row would be made in the two pieces beside it as well. So the encoder needs no queue over the
text. An Aho-Corasick automaton over the reversed pieces gives the longest piece that begins at
each place; from the left the longest piece that agrees with the one before it is taken, a
shorter one if it doesn't, and where none agrees the last piece is given back. The answer for the
text before a place is unique, so a place that was given back can't be of use again: one bit a
place remembers it, and every place is left at most once.

No piece holds a space behind another character, and none a character that is no piece itself
(both are checked when the model is read): nothing is merged across such places. What lies
between them is encoded once and remembered.
"""

import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import keeper, table
from hustings.llm.registry import query

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO = 500_000  # words of a generation that a Python worker remembers, some 200 bytes each
LONG = 256  # longer ones are not remembered
NEVER = float("-inf")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values of the model format


# --- the model -----------------------------------------------------------------------


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protobuf message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 2, 5):
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"field of kind {kind} in a model file")


class PieceModel:
    """A model file: its pieces, the encoder and the decoder.

    Raises ValueError for models that it would not reproduce: other types than merges, a
    normaliser that changes characters, user-defined or unused pieces, no byte fallback.
    """

    def __init__(self, path: str, memo: int = MEMO):
        self.memo = memo
        self.texts: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        trainer: dict = {}
        normaliser: dict = {}
        with open(path, "rb") as source:
            data = source.read()
        for number, value in wire_fields(data):
            if number == 1:
                piece = dict(wire_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.ids[text] = len(self.texts)
                    self.scores[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.texts.append(text)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(wire_fields(value))
            elif number == 3:
                normaliser = dict(wire_fields(value))
        self.prefix = bool(normaliser.get(3, 1))
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode()
        self._check(trainer, normaliser)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        for text in self.scores:
            self.automaton.add_word(text[::-1], len(text))
        self.automaton.make_automaton()
        #: Length of the next shorter piece that a piece begins with, 0 for single characters.
        self.shorter = {t: next((k for k in range(len(t) - 1, 0, -1) if t[:k] in self.scores), 0) for t in self.scores}
        known = "".join(re.escape(c) for c in sorted(t for t in self.scores if len(t) == 1))
        self.parts = re.compile(f"[{known}]+|[^{known}]+", re.DOTALL)
        self.known = {t for t in self.scores if len(t) == 1}
        self.agree: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.silent = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.plain = [self._plain(t, k) for t, k in zip(self.texts, self.kinds)]

    def _check(self, trainer: dict, normaliser: dict) -> None:
        wrong = []
        if trainer.get(3, 1) != 2:
            wrong.append("not of merge type")
        if not trainer.get(35, 0):
            wrong.append("no byte fallback")
        if trainer.get(24, 0):
            wrong.append("spaces as suffixes")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            wrong.append("a normaliser that changes texts")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            wrong.append("user-defined or unused pieces")
        if any(c not in self.scores for t in self.scores for c in t):
            wrong.append("characters that are no pieces")
        if any(SPACE in t.lstrip(SPACE) for t in self.scores):
            wrong.append("spaces inside pieces")
        if wrong:
            raise ValueError("model can't be used: " + ", ".join(wrong))

    # --- encoding ---

    def merged(self, text: str) -> list[str]:
        """The model's own procedure: join the best pair until none is left. For short texts."""
        score, parts = self.scores.get, list(text)
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def fits(self, before: str, piece: str) -> bool:
        """Whether merging the two pieces' text gives these two again; remembered."""
        if len(self.agree) >= 2 * self.memo:
            self.agree.clear()
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.agree[before, piece] = found
        return found

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text of known characters."""
        n = len(text)
        longest = [0] * (n + 1)
        for end, size in self.automaton.iter(text[::-1]):
            if size > longest[n - 1 - end]:
                longest[n - 1 - end] = size
        agreed, shorter = self.agree.get, self.shorter
        failed = None  # a bit for each place, once one has failed
        path: list[str] = []
        at, before, size = 0, "", longest[0]
        while at < n:
            piece = text[at : at + size]
            fits = agreed((before, piece))
            if fits is None:
                fits = self.fits(before, piece)
            if fits and (failed is None or not failed[(at + size) >> 3] >> ((at + size) & 7) & 1):
                path.append(piece)
                at, before = at + size, piece
                size = longest[at]
                continue
            size = shorter[piece]
            if not size and failed is None:
                failed = bytearray(n // 8 + 1)
            while not size:
                failed[at >> 3] |= 1 << (at & 7)
                last = path.pop()
                at, before = at - len(last), path[-1] if path else ""
                size = shorter[last]
        return path

    def _word(self, text: str) -> bytes:
        """Ids of a text (spaces escaped) as 32-bit integers."""
        ids: list[int] = []
        for part in self.parts.findall(text):
            if part[0] in self.known:
                ids.extend(map(self.ids.__getitem__, self.backtrack(part)))
            else:
                ids.extend(map(self.bytes.__getitem__, part.encode("utf-8", "replace")))
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null and empty texts have none."""
        if not text:
            return np.zeros(0, np.int32)
        if self.prefix:
            text = " " + text
        text = text.replace(SPACE, " ")
        # Where single spaces part the words, a word stands for itself and the space before it.
        if text[0] == " " and text[-1] != " " and "  " not in text:
            words = text.split(" ")
            del words[0]
        else:
            words = re.findall(" *[^ ]+| +", text)
            if text[0] != " ":
                return np.frombuffer(self._word(words[0]) + b"".join(map(self._spaced, words[1:])), np.int32)
            return np.frombuffer(b"".join(map(self._spaced, words)), np.int32)
        found = list(map(self.words.get, words))
        if None in found:
            get = self.words.get
            found = [f or get(w) or self._remember(w) for w, f in zip(words, found)]
        return np.frombuffer(b"".join(found), np.int32)

    def _spaced(self, text: str) -> bytes:
        """A chunk with its leading spaces written out."""
        if text[0] == " " and text[1:2] not in ("", " "):
            return self.words.get(text[1:]) or self._remember(text[1:])
        return self._word(text.replace(" ", SPACE))

    def _remember(self, word: str) -> bytes:
        """Ids of a word; words are kept in two generations, of which the older one goes."""
        found = self.older.get(word)
        if found is None:
            found = self._word(SPACE + word)
        if len(word) <= LONG:
            if len(self.words) >= self.memo:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    # --- decoding ---

    def _plain(self, text: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unknown_text.encode()
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return text.replace(SPACE, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space set before a text goes, control pieces are silent, and
        every byte that is no part of a character becomes U+FFFD. Ids must be the model's."""
        if ids and min(ids) < 0:
            raise IndexError("negative id")
        data = b"".join(map(self.plain.__getitem__, ids))
        silent = not self.silent.isdisjoint(ids)
        first = next((i for i in ids if i not in self.silent), None)
        spaced = self.prefix and first is not None and self.kinds[first] == NORMAL and self.texts[first][0] == SPACE
        try:
            if not silent:
                return data[spaced:].decode()
        except UnicodeDecodeError:
            pass
        # Bytes make up a character only if nothing stands between them, not even a silent piece.
        out, run = [], b""
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.plain[i]
            else:
                out += [_readable(run), self.plain[i].decode()]
                run = b""
        return "".join([*out, _readable(run)])[spaced:]


def _readable(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            size = 1
            out.append("�")
        at += size
    return "".join(out)


def piece_model(path: str, memo: int = MEMO) -> PieceModel:
    """The model of a worker, read once."""
    held = keeper("piece_models")
    if (path, memo) not in held:
        held[path, memo] = PieceModel(path, memo)
    return held[path, memo]


# --- on tables -----------------------------------------------------------------------

ROOM = 1 << 20  # characters, or ids, that a batch given back may hold, but for one row


def _lists(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
    return pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, memo: int = MEMO) -> DataFrame:
    """(doc_id, ids): a row per row of `docs`, by its doc_id and whole text alone.

    Null and empty texts have an empty list; ids may be null or repeat. `path` names the model
    file, which every executor must have there. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, memo)
        for batch in batches:
            ids, held, room, first = batch.column("doc_id"), [], 0, 0
            for i, text in enumerate(batch.column("text")):
                found = model.encode(text.as_py())
                held.append(found)
                room += len(found) + 1
                if room > ROOM:
                    yield _lists(ids.slice(first, len(held)), held)
                    held, room, first = [], 0, i + 1
            if held:
                yield _lists(ids.slice(first, len(held)), held)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, memo: int = MEMO) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids); null lists decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path, memo)
        for batch in batches:
            batch, first, held, room = batch.select(["doc_id", "ids"]), 0, [], 0
            lists = batch.column("ids")
            for i, found in enumerate(lists):
                held.append(model.decode(found.values.to_numpy(zero_copy_only=False).tolist()) if found.is_valid else "")
                room += len(held[-1]) + 1
                if room > ROOM or i == len(lists) - 1:
                    part = batch.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.string())], names=["doc_id", "ids", "text"])
                    held, room, first = [], 0, i + 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


@query("op11_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(MODEL)
    found = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
