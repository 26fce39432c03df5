"""Pieces and alignment of two tokenizers."""

import random
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as contract
from hustings.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = [
    "a", "b", " ", "  ", "▁", "\n", "\t", "e", "th", "ing", "the", "é", "ü", "中", "文", "日本", "😀", "\0", "12", "...", "''", "<s>", "<unk>",
    "<0x41>", "　", "ß", "İ", "क्", "ा", " ", "\U0010ffff", "\x7f", "international", "ization",
]
ODD = [
    None, "", " ", "▁", "  ", "a", " a", "a ", " a  b ", "\n", "a\nb", "\n a", "<s> </s>", "a" * 5000, " " * 3000, "ab" * 4000, "x▁y", "▁x",
    "word " * 20000, "中" * 3000,
]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH, memo=50)


def expected(text):
    return LIBRARY.encode(text or "")


@pytest.mark.parametrize("seed", range(4))
def test_pieces_are_the_librarys(model, seed):
    pick = random.Random(seed)
    for _ in range(4000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 25)))
        assert model.encode(text).tolist() == expected(text), repr(text)
        letters = "".join(pick.choice("abcdeinorstu中αβ") for _ in range(pick.randint(0, 40)))
        assert model.encode(letters).tolist() == expected(letters), repr(letters)


def test_every_ordinary_piece_is_encoded_as_merging_says(model):
    pick = random.Random(5)
    for text in pick.sample(sorted(model.scores), 3000):
        assert model.backtrack(text) == model.merged(text)


def test_pieces_given_back_are_remembered_by_place(model, monkeypatch):
    asked = []
    fits = model.fits
    monkeypatch.setattr(model, "agree", {})
    monkeypatch.setattr(model, "fits", lambda a, b: asked.append((a, b)) or fits(a, b))
    text = "▁" + "abab" * 500
    assert "".join(model.backtrack(text)) == text
    assert len(asked) < 100  # each pair of pieces is merged once


def test_any_ids_are_decoded_as_the_library_does(model):
    pick = random.Random(6)
    for _ in range(6000):
        ids = [
            pick.choice([pick.randrange(32000), pick.randrange(3, 259), pick.randrange(3), 259, 29871]) for _ in range(pick.randint(0, 12))
        ]
        assert model.decode(ids) == LIBRARY.decode(ids), ids
    for wrong in ([-1], [32000]):
        with pytest.raises(IndexError):
            model.decode(wrong)


def test_other_models_are_refused(tmp_path):
    with open(PATH, "rb") as source:
        data = source.read()
    for name, extra in {
        "unigram": b"\x12\x04\x18\x01\x98\x02"[:4], "charsmap": b"\x1a\x05\x12\x01x\x18\x01", "user": b"\x0a\x05\x0a\x01q\x18\x04",
    }.items():
        (tmp_path / name).write_bytes(data + extra)
        with pytest.raises(ValueError):
            pieces.PieceModel(str(tmp_path / name))


def test_odd_rows_of_a_table(spark):
    rows = [(i, t, "own", [1]) for i, t in enumerate(ODD)] + [(None, "x", None, None), (3, "▁", "own", [1]), (3, "▁", "own", [1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, ids array<int>").repartition(3)
    found = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted(((r["doc_id"], tuple(r["ids"]), r["text"]) for r in found), key=str) == sorted(
        ((i, tuple(expected(t)), LIBRARY.decode(expected(t))) for i, t, *_ in rows), key=str
    )
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).collect() == []
    none = spark.createDataFrame([("a", None)], "doc_id string, ids array<int>")
    assert [tuple(r) for r in pieces.decode(none, PATH).collect()] == [("a", None, "")]


def test_the_query_against_the_library(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = contract.queries()["op11_pieces"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = expected(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == sha256(LIBRARY.decode(ids).encode()).hexdigest()
