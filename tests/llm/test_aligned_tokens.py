"""Alignment of two tokenizers against a plain one, and the hash it counts with."""

import json
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as contract
from hustings.llm import aligned_tokens as at
from hustings.llm.common import Scratch

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=B)
PARTS = [
    "a", " ", "  ", "\n", "\t", " \n", "\x1c", "　", " ", "the", "ing", "é", "中", "😀", "\0", "12", "...", "'s", "<s>", "<|endoftext|>", "don't",
    "international", "-", "'", "\x85",
]


def plain(text):
    """(ids of A, ids of B, ends of both in bytes) by the libraries on the whole text; None if there is nothing."""
    if not text:
        return None
    letters = at.byte_letters()
    a = TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    b = PIECES.encode(text)
    a_bytes = [bytes(letters[c] for c in TOKENIZER.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in b]
    data = (" " + text).encode()
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return None
    return a, b, np.cumsum([len(t) for t in a_bytes]).tolist(), np.cumsum([len(t) for t in b_bytes]).tolist()


def brute(texts):
    """The rows of all texts, in order."""
    found = [plain(t) for t in texts]
    links = []
    for f in found:
        own = []
        if f:
            a, b, a_ends, b_ends = f
            places = {e: i for i, e in enumerate(b_ends)}
            own = [(i, places[e]) for i, e in enumerate(a_ends) if e in places]
        links.append(own)
    counts = Counter((f[0][i], f[1][j]) for f, own in zip(found, links) for i, j in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = []
    for f, own in zip(found, links):
        if not f:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = f[:2]
        groups, x, y = [], 0, 0
        for i, j in own:
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        ns = [counts[a[i], b[j]] for i, j in own]
        rows.append((len(a), len(b), len(own), len(own), sum(n == best[b[j]] for n, (_, j) in zip(ns, own)), sum(ns), ";".join(groups)))
    return rows


def test_ranks_give_the_librarys_ids(tmp_path):
    align = at.Aligner(A, B)
    assert align.fast is not None
    pick = random.Random(11)
    letters = "abcdefghinorst" * 3 + "ABQZ0129'-.,éüß中文 \n"
    for _ in range(6000):
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 40)))
        assert align.encode_a(text) == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)
    with open(A, encoding="utf-8") as source:
        says = json.load(source)
    says["model"]["merges"][300], says["model"]["merges"][900] = says["model"]["merges"][900], says["model"]["merges"][300]
    (tmp_path / "other.json").write_text(json.dumps(says), encoding="utf-8")
    assert at.Aligner(str(tmp_path / "other.json"), B).fast is None


def odd_texts():
    pick = random.Random(3)
    fixed = [
        None, "", " ", "  ", "a", " a", "a ", "a  b", "x▁y", "▁", "\n", "a \n b", "a\n b", "a\x1c b", "<|endoftext|> a<|endoftext|>", "word " * 8000,
        "y" * 20000, " " * 500 + "z", "中文 中文",
    ]
    return fixed + ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 20))) for _ in range(1500)] + ["a b c"] * 40


def test_words_stand_for_the_text():
    align = at.Aligner(A, B)
    assert align.by_words
    for text in odd_texts():
        words = align.words(text)
        if text and "▁" not in text:
            assert " ".join(words) == text
            a, b, *_ = plain(text)
            found = align.align(words)
            assert (sum(f[0] for f in found), sum(f[1] for f in found)) == (len(a), len(b)), repr(text)


@pytest.mark.parametrize("shard,arity,words", [(64, 2, 100), (1 << 16, 32, 300_000)])
def test_counts_and_groups_of_odd_rows(spark, shard, arity, words):
    texts = odd_texts()
    docs = spark.createDataFrame(
        [(i if i != 4 else None, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int"
    ).repartition(7)
    found = at.align(docs, A, B, Scratch(spark, "test"), words=words, shard=shard, arity=arity).collect()
    assert sorted((tuple(r) for r in found), key=str) == sorted(
        (((i if i != 4 else None), *row) for i, row in enumerate(brute(texts))), key=str
    )


def test_empty_tables_and_texts_without_links(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in at.align(docs, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert at.align(docs.limit(0), A, B).collect() == []


def test_tokenizers_that_join_words_get_whole_texts(tmp_path):
    with open(A, encoding="utf-8") as source:
        says = json.load(source)
    says["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "other.json").write_text(json.dumps(says), encoding="utf-8")
    align = at.Aligner(str(tmp_path / "other.json"), B)
    assert not align.by_words
    assert align.words("a b") == ["a b"]
    assert align.align(["x▁y"])[0][:2] == (0, 0)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 70_000])
def test_the_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n))
    made = at.PerfectHash.from_bytes(at.PerfectHash.of(keys).to_bytes())
    assert sorted(made.places(keys).tolist()) == list(range(len(keys)))
    assert len(made.to_bytes()) * 8 < 5 * n + 4096
    few = at.PerfectHash(*(lambda m: (m.levels[:2], np.sort(keys[at.PerfectHash(m.levels[:2], keys[:0]).places(keys) < 0])))(made))
    assert sorted(few.places(keys).tolist()) == list(range(len(keys)))  # the rest is kept in order


def test_keys_are_verified(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    counts, shards = at.pair_counts(docs, A, B, scratch, shard=2)
    assert shards > 1
    look = at.PairCounts(at.write_shards(counts, scratch.path("files")), shards, kept=1)
    a, b, *_ = plain("a b c a b")
    keys = np.array([x << 32 | y for x, y in zip(a, b)], np.int64)
    assert look.look_up(keys).tolist() == [2, 2, 1, 2, 2]
    assert look.look_up(keys + 1).tolist() == [0] * 5 and look.look_up(keys[:0]).tolist() == []


def test_the_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in contract.queries()["op12_aligned_tokens"](spark, sf_dir).collect()}
    for r, want in zip(rows, brute([r["text"] for r in rows])):
        assert found[r["doc_id"]] == (*want[:6], sha256(want[6].encode()).hexdigest() if want[6] else "")
