"""Archives, embeddings and the pipeline."""

import gzip
import io
import zlib
from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from hustings.llm import archives, decontaminate, quantise, simhash, toxicity
from hustings.llm.common import Scratch, filesystem

# --- 6: archives -----------------------------------------------------------------------

PAGE = "<html>" + "x" * 200
PAGES = [
    (5, "http://a.example/ b\n", PAGE), (3, "http://b.example/", PAGE), (9, None, PAGE), (9, "http://c.example/", PAGE),
    (4, "http://d.example/é", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", PAGE), (None, "u", "é" * 70),
    (-1, "u", "é" * 70), (10, "u", "y" * 300_000 + "\r\n\r\nWARC/1.1\r\n\n1 2 3"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "own") for p in PAGES], "page_id long, url string, html string, payload_digest string")


def test_pages_come_back_from_their_archives(spark, pages):
    rows = [
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
        for r in archives.archive(pages.repartition(3)).collect()
    ]
    firsts, expected = {}, []
    for page_id, _, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        data = (html or "").encode()
        digest = sha256(data).hexdigest()
        first = len(data) >= 100 and digest in firsts
        expected.append((page_id, len(data), digest, "revisit" if first else "response", firsts.get(digest) if first else None))
        firsts.setdefault(digest, page_id)
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert archives.archive(pages.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_are_read_by_version(version):
    head = archives.arc_head(version, "name.arc")
    one = archives.arc_record(version, "http://a/ with blanks", "2001", "text/plain", b"no head\n\n\n", 0, "n")
    two = archives.arc_record(version, "dns:a", "20010203040506", "text/dns", b"", 0, "n")
    found = list(archives.arc_records(io.BytesIO(gzip.decompress(head + one + two))))
    assert [(f["URL"], f["Archive-date"], f["Content-type"], f["content"]) for f in found] == [
        ("http://a/ with blanks", "2001", "text/plain", b"no head\n\n\n"), ("dns:a", "20010203040506", "text/dns", b""),
    ]
    with pytest.raises(ValueError):
        list(archives.arc_records(io.BytesIO(gzip.decompress(head + one)[:-5])))


def test_dates_and_identifiers():
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert archives.warc_date("2001") == "2001-01-01T00:00:00Z" and archives.warc_date("odd") == "2000-01-01T00:00:00Z"
    for key in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012):
        identifier = archives.record_id(key, True, b"salt")
        assert identifier.version == 8 and archives.key_of(f"<urn:uuid:{identifier}>") == key
    assert archives.key_of(str(archives.record_id(5, False, b"salt"))) is None


def test_converted_records_are_whole_warc_records(spark, pages):
    scratch = Scratch(spark, "test-arc")
    legacy = scratch.save(archives.write_arc(pages.coalesce(1), scratch.path("arc"), shard_bytes=400), "files")
    assert legacy.count() > 1
    warc = scratch.save(archives.convert(legacy, scratch.path("warc"), scratch), "warc-files")
    kinds = {}
    for row in warc.collect():
        fs, path = filesystem(row["path"])
        data = gzip.decompress(fs.open_input_file(path).read())
        for headers, block in archives.warc_records(io.BytesIO(data)):
            kinds[headers["warc-type"]] = kinds.get(headers["warc-type"], 0) + 1
            if headers["warc-type"] != "warcinfo":
                assert headers["warc-block-digest"] == f"sha256:{sha256(block).hexdigest()}"
    assert kinds == {"warcinfo": legacy.count(), "response": 7, "revisit": 5}


# --- 5: embeddings ---------------------------------------------------------------------


def test_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1):
        spots = rng.normal(size=(40, 24))
        for spot in spots:
            for _ in range(int(rng.integers(1, 16))):
                # Near the threshold on both sides, where the search is hardest.
                rows.append((len(rows), (spot + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.27])).tolist(), label))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(30)] + [(2_000, (np.array(rows[0][1]) * 1e30).tolist(), 0)]
    odd = [
        (3_000, None, 0), (3_001, [0.0] * 24, 0), (3_002, [None, *rows[0][1][1:]], 0), (3_003, [float("nan"), *rows[0][1][1:]], 0),
        (3_004, rows[0][1], None), (3_005, rows[0][1][:12], 0), (3_006, [], 0), (None, [1.0, 2.0], 3), (3_007, [float("inf")] * 24, 1),
        (3_008, [1.0, 2.0], 3), (3_008, [1.0, 2.0], 3),
    ]
    table = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<double>, label int, n long")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    np.fill_diagonal(near, False)
    for list_size, block in ((1_024, 4_096), (60, 7)):  # one list, and many that are cut into blocks
        found = quantise.near_duplicates(table.repartition(4), list_size=list_size, block=block, reach=0.12)
        every = found.collect()
        assert len(every) == len(rows) + len(odd)
        got = {r["vec_id"]: r for r in every}
        links = np.array([got[r[0]]["n_links"] for r in rows])
        assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
        if list_size == 1_024:
            assert (links == near.sum(1)).all()
        for r in odd[:7]:
            assert (got[r[0]]["n_links"], got[r[0]]["component_id"], got[r[0]]["kept"]) == (0, r[0], True)
        assert got[3_008]["n_links"] == 2 and got[3_008]["component_id"] == 3_008
        assert got[None]["component_id"] is None and not got[None]["kept"]
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in every if r["vec_id"] is not None)
    assert quantise.near_duplicates(table.limit(0)).collect() == []
    nothing = quantise.near_duplicates(table.where("label IS NULL")).collect()
    assert [tuple(r) for r in nothing] == [(3_004, 0, 3_004, True)]


def test_table_distances_bound_the_true_ones():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = quantise.fit(x[:300], 4)
    home = index.home(x)
    codes, missed = index.code(x, home)
    own = np.flatnonzero(home == 2)
    table = np.sqrt(index.distances(x, 2, codes[own]))
    true = np.sqrt(quantise.squared(x, x[own]))
    assert (np.abs(table - true) <= missed[own][None, :] + 1e-6).all()


# --- queries and pipeline ----------------------------------------------------------------


def test_every_operator_is_registered():
    names = contract.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_the_stages_do_their_work(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "doc_id AS score", "text AS epoch", "1 AS place", "'x' AS row")
    odd = extra.limit(1).selectExpr(
        "CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", "score", "epoch", "place", "row"
    )
    now = extra.unionByName(odd).unionByName(extra.limit(3))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "decontamination", "mixing", "tokens"]
    scratch = Scratch(spark, "test-pipeline")
    kept = scratch.save(stages["toxicity"](spark, now, sf_dir), "toxicity")
    model = toxicity.learn(spark, sf_dir, now)
    expected = toxicity.score(now.select("doc_id", "text"), model).where("predicted = 0").count()
    assert kept.columns == now.columns and kept.count() == expected
    one = scratch.save(stages["simhash"](spark, kept, sf_dir), "simhash")
    prints = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in one.where("doc_id IS NOT NULL").collect()]
    assert all((x[1] ^ y[1]).bit_count() > 4 for i, x in enumerate(prints) for y in prints[:i])
    assert one.where("doc_id IS NULL").count() == 1 and one.columns == now.columns
    clean = scratch.save(stages["decontamination"](spark, one, sf_dir), "clean")
    bad = decontaminate.contamination(one, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = {r["doc_id"] for r in bad.collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - gone
    mixed = scratch.save(stages["mixing"](spark, clean, sf_dir), "mixed")
    assert mixed.columns == now.columns and mixed.count() > 0
    tokens = stages["tokens"](spark, mixed, sf_dir)
    assert tokens.count() == mixed.count()
    assert [f.name for f in tokens.schema][:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        assert found.count() == 0
        assert name == "tokens" or found.columns == docs.columns


def test_the_pipeline_runs_whole(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    total = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == total
        total += r["n_tokens"]
    assert rows and zlib.crc32(b"") == 0
