"""Benchmark items inside documents: size-partitioned MinHash containment search.

A short item has next to no Jaccard similarity with a long document that quotes it, so
items are partitioned by size, and a document is cut, for each size class of up to u
shingles, into windows of 2u shingles that overlap by u: an item's passage always lies whole
in one of them, and there its similarity has a lower bound. Windows and items meet where one
of many min-hashes is equal; each meeting is verified by exact shingle containment in
the whole document. Items of few shingles are looked up by every one of them, which misses none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import WORDS, ascii_lower, batch_of, keeper, table
from hustings.llm.registry import query
from hustings.llm.shingles import shingle_hashes, slices, word_hashes

WIDTH = 5
THRESHOLD = 0.8
SMALLEST = 16  # shingles in the smallest size class; items up to half of it are looked up exactly
# A passage that holds 0.8 of an item of half its class has a similarity of 0.19 or more with its
# window; 64 single hashes then miss it once in 10^6 times, and a whole passage once in 10^8.
HASHES = 64


class Items:
    """A block of items: shingle sets, size classes and min-hashes.

    Every text is searched for by itself; what counts are the united shingles of all texts of its
    id: `ids`, `sizes` and `parts` (shingles by their words) are by item, the rest by text.
    """

    def __init__(self, ids: list, texts: list[str], width: int = WIDTH):
        self.width = width
        place: dict[int, int] = {}
        united: list[dict[int, list]] = []
        self.item: list[int] = []  # of each text
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []  # words in a shingle: `width`, or all words of a shorter item
        words, offsets = word_hashes(texts)
        for i, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist()):
            n = min(width, b - a)
            if n:
                own, _ = shingle_hashes(words[a:b], np.array([0, b - a]), n)
                k = place.setdefault(i, len(place))
                if k == len(united):
                    united.append({})
                self.item.append(k)
                self.sets.append(np.unique(own))
                self.lengths.append(n)
                united[k].setdefault(n, []).append(self.sets[-1])
        self.ids: list[int] = list(place)
        self.parts = [{n: np.unique(np.concatenate(sets)) for n, sets in u.items()} for u in united]
        self.sizes = [sum(map(len, p.values())) for p in self.parts]
        few = [len(s) <= SMALLEST // 2 for s in self.sets]
        self.short = {
            n: self._index([k for k, m in enumerate(self.lengths) if m == n and few[k]]) for n in range(1, width + 1)
        }
        whole = [k for k, m in enumerate(self.lengths) if m == width and not few[k]]
        self.classes: dict[int, list] = {}
        for k in whole:
            u = SMALLEST
            while u < len(self.sets[k]):
                u *= 2
            self.classes.setdefault(u, []).append(k)
        self.tables = {
            u: [
                lookup(np.array([permuted(self.sets[k], f).min() for k in members], np.uint64), np.array(members))
                for f in range(HASHES)
            ]
            for u, members in self.classes.items()
        }

    def _index(self, members: list[int]):
        if not members:
            return None
        sets = [self.sets[k] for k in members]
        return lookup(np.concatenate(sets), np.repeat(members, [len(s) for s in sets]))

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of all pairs of texts and items with a candidate."""
        words, offsets = word_hashes(texts)
        pairs = []
        for n, index in self.short.items():
            if index:
                own, bounds = shingle_hashes(words, offsets, n)
                at, item = matches(own, index)
                pairs.append((np.searchsorted(bounds, at, "right") - 1, item))
        own, bounds = shingle_hashes(words, offsets, self.width)
        if len(own) and self.tables:
            cuts = {u: _cuts(bounds, u) for u in self.tables}
            for f in range(HASHES):
                hashed = permuted(own, f)
                for u, (starts, last, text) in cuts.items():
                    least = np.minimum.reduceat(hashed, starts)
                    window = np.minimum(least[:-1], least[1:])
                    window = np.append(np.where(last[:-1], least[:-1], window), least[-1])
                    at, item = matches(window, self.tables[u][f])
                    pairs.append((text[at], item))
        if not pairs:
            return
        text, own = (np.concatenate(c) for c in zip(*pairs))
        found = np.unique(np.stack([text, np.array(self.item, np.int64)[own]], 1), axis=0)
        sets: dict[tuple[int, int], np.ndarray] = {}
        for text, item in found.tolist():
            shared = 0
            for n, own in self.parts[item].items():
                if (text, n) not in sets:
                    sets = {k: v for k, v in sets.items() if k[0] == text}
                    sets[text, n] = np.unique(_one(words, offsets, text, n))
                shared += int(np.isin(own, sets[text, n]).sum())
            yield text, item, shared


def _one(words, offsets, text, n):
    own = words[offsets[text] : offsets[text + 1]]
    return shingle_hashes(own, np.array([0, len(own)]), n)[0]


def _cuts(bounds: np.ndarray, u: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the blocks of u shingles of each text, whether each is its text's last, and its text."""
    sizes = np.diff(bounds)
    blocks = -(-sizes // u)
    text = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return bounds[text] + nth * u, nth == blocks[text] - 1, text


def permuted(x: np.ndarray, f: int) -> np.ndarray:
    return (x ^ np.uint64((f + 1) * 0xBF58476D1CE4E5B9 % 2**64)) * np.uint64((2 * f + 1) * 0x94D049BB133111EB % 2**64 | 1)


def lookup(values: np.ndarray, members: np.ndarray):
    order = np.argsort(values, kind="stable")
    some = np.zeros(1 << 16, bool)
    some[values & np.uint64(0xFFFF)] = True
    return values[order], members[order], some


def matches(found: np.ndarray, index) -> tuple[np.ndarray, np.ndarray]:
    """Positions in `found` and the members with the same value, all pairs."""
    values, members, some = index
    at = np.flatnonzero(some[found & np.uint64(0xFFFF)])
    lo = np.searchsorted(values, found[at])
    n = np.searchsorted(values, found[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), members[np.repeat(lo, n) + nth]


ROWS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64())]
)


def item_classes(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, class_id): items with the same words belong to that with the smallest id."""
    form = F.array_join(F.regexp_extract_all(ascii_lower("text"), F.lit(f"({WORDS})")), " ")
    keyed = items.where("item_id IS NOT NULL").select("item_id", F.coalesce(form, F.lit("")).alias("form"))
    least = keyed.groupBy("form").agg(F.min("item_id").alias("class_id"))
    return keyed.join(least, "form").select("item_id", "class_id").distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    block_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) at or above the threshold.

    Containment is the share of the item's distinct shingles of `width` words (A-Z
    lower-cased) that the document has anywhere. An item of fewer words is one shingle of all
    its words; an item without words is in no document. Items of equal words appear once, as
    their smallest item_id; `item_classes` has the others. An item_id with different texts has
    the shingles of all those it is the smallest id of. Rows with null texts or a null
    item_id match nothing. A repeated doc_id gives rows for each of its texts.

    The items are the query set. They go to the tasks in blocks of about `block_words` words;
    the documents are read once a block and never shuffled.
    """
    found = None
    for part in _blocks(items, width, block_words):
        one = _search(docs, part, threshold)
        found = one if found is None else found.unionByName(one)
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_words: int = 1_000_000
) -> DataFrame:
    """The rows of `docs` that hold no item, by the search of `contamination`; nothing is shuffled.

    Null and empty texts hold nothing and stay.
    """
    for part in _blocks(items, width, block_words):
        docs = docs.where(~_holds(part, threshold)("text"))
    return docs


def _holds(items: Items, threshold: float):
    def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keeper("decontaminate")  # frees what operators before this one left
        for column in columns:
            found = np.zeros(len(column), bool)
            for first, texts in slices(column):
                for text, item, shared in items.find(texts):
                    found[first + text] |= shared >= threshold * items.sizes[item]
            yield pa.array(found)

    return F.arrow_udf(holds, "boolean")


def _blocks(items: DataFrame, width: int, block_words: int) -> Iterator[Items]:
    """The distinct texts, each for its smallest id, in blocks that fit a task; an id is in one block."""
    form = F.array_join(F.regexp_extract_all(ascii_lower("text"), F.lit(f"({WORDS})")), " ")
    own = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy(form.alias("form")).agg(
        F.min("item_id").alias("item_id"), F.min("text").alias("text")
    )
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // (6 * block_words)))
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], width)


def _search(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch.column("text")):
                rows = []
                for text, item, shared in items.find(texts):
                    size = items.sizes[item]
                    if shared >= threshold * size:
                        rows.append((ids[first + text], items.ids[item], shared, size))
                if rows:
                    yield batch_of(ROWS, *zip(*rows))

    schema = "doc_id long, item_id long, shared long, item_shingles long"
    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(search, schema)


ORACLE = rf"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents WHERE text IS NOT NULL
), item_words AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
    FROM benchmark WHERE text IS NOT NULL) GROUP BY w
), items AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS item_shingles FROM items GROUP BY item_id
), docs AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM items) WHERE len(w) >= n)
), shared AS (
  SELECT doc_id, item_id, count(*) AS shared FROM docs JOIN items USING (n, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE shared >= {THRESHOLD} * item_shingles
"""


@query("op2_decontaminate", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
