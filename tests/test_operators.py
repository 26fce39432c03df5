"""Table jobs on small frames: traps, properties and brute-force comparisons."""

import glob
import itertools
import os
import random
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hustings import session, vocab
from hustings.operators import (
    alignment,
    annotate,
    blocks,
    exports,
    ingest,
    linkage,
    merge,
    pages,
    reports,
    scoring,
    spectrum,
)
from hustings.operators.ids import dense_ids
from hustings.session import new_path
from hustings.sources import files
from hustings.streaming import incremental

COLUMNS = ingest.RAW_COLUMNS


def raw(spark, rows):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        ", ".join(f"{c} string" for c in COLUMNS) + ", row_no long",
    )


GOOD, BAD = "01/02/2025 10:00:00", "not a date"


def row(div, name, vote, date=GOOD, pos="Deputy", ref="P.1/2025", title="Principles", prop="Draft"):
    return (str(div), name, pos, date, ref, title, prop, vote)


def test_ingest_traps(spark):
    rows = [
        row(1, "Ann  Lee", "Pour", BAD),  # before the division is seen: dropped
        row(1, "Bob Ray", "En défaut", pos="Mr."),
        row(1, "Ann Lee", "Contre", prop="Other title"),
        row(1, " Bob   Ray ", "Pour"),  # active replaces absent
        row(1, "Bob Ray", "Contre"),  # a second active vote does not
        row(1, "Ann Lee", "Pour", BAD),  # counts, but an active vote is there
        row(1, "Cat Fox", "Ill", BAD),  # never dated: no member
        row(2, "Ann Lee", "Ill", "02/02/2024 10:00:00", pos="Senators", ref="{x}|P.2/2024(Amd)(3)", title="Amd"),
        row(2, "Bob Ray", "Abstained", BAD),  # the division is seen: counts
        row(3, "Bob Ray", "Pour", BAD),  # a division never dated does not exist
    ]
    t = ingest.build_all(raw(spark, rows))
    members = {r["canonical_name"]: r for r in t["members"].collect()}
    assert list(sorted(members)) == ["Ann Lee", "Bob Ray"]
    assert [m["member_id"] for _, m in sorted(members.items())] == [1, 2]
    assert [(p["position"], p["count"]) for p in members["Ann Lee"]["position_history"]] == [
        ("Deputy", 1), ("Senator", 1),
    ]
    assert members["Ann Lee"]["is_currently_active"]
    names = {r["member_id"]: r["canonical_name"] for r in members.values()}
    got = {(r["division_id"], names[r["member_id"]]): r["vote"] for r in t["votes"].collect()}
    assert got == {
        (1, "Ann Lee"): "Contre", (1, "Bob Ray"): "Pour", (2, "Ann Lee"): "Ill", (2, "Bob Ray"): "Abstained",
    }
    divisions = {r["division_id"]: r for r in t["divisions"].collect()}
    assert sorted(divisions) == [1, 2]
    assert divisions[1]["proposition_title"] == "Draft" and divisions[1]["division_stage"] == "principles"
    assert (divisions[2]["amendment_number"], divisions[2]["absent_count"]) == (3, 1)
    props = {r["proposition_id"]: r["base_reference"] for r in t["propositions"].collect()}
    assert props == {1: "P.2/2024", 2: "P.1/2025"}
    root = new_path(spark, "tables")
    files.write_tables(t, root)
    assert files.read_tables(spark, root)["votes"].where("year = 2024").count() == 2


def test_csv_keeps_order_and_text(spark):
    rows = [row(1, 'A "q" B', " Pour", title="line\nbreak, comma"), row(1, "A", "Contre ")]
    path = new_path(spark, "csv")
    files.write_csv(raw(spark, rows).orderBy("row_no").coalesce(1).drop("row_no"), path)
    back = files.scan_votes(spark, path).orderBy("row_no").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in back] == rows


def test_overrides_skip_blank_sides(spark, tmp_path):
    f = tmp_path / "o.csv"
    f.write_text("candidate_slug,member_canonical_name,note\n a , Ann Lee ,x\n,Bob,\nb,,\n")
    assert [tuple(r)[:2] for r in files.read_overrides(spark, str(f)).collect()] == [("a", "Ann Lee")]


def test_unknown_topic_is_an_error(spark):
    q = spark.createDataFrame([("a", "Housing"), ("b", "Weather")], "question_id string, topic string")
    topics = spark.createDataFrame([(x,) for x in vocab.TOPICS], "topic string")
    with pytest.raises(ValueError, match="Weather"):
        files.require_known_topics(q, topics)


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"k{i % 97:03d}", i) for i in range(1000)], "k string, i int")
    found = dense_ids(df.repartition(7), ["k", "i"], "n").orderBy("n").collect()
    assert [r["n"] for r in found] == list(range(1, 1001))
    assert [(r["k"], r["i"]) for r in found] == sorted((r["k"], r["i"]) for r in found)


def matrix(spark, members=23, divisions=40, seed=3, hot=True):
    """A random matrix; one division holds a vote of everybody."""
    rng = random.Random(seed)
    cells = [
        (m, d, rng.choice([1, 1, -1, 0]))
        for m in range(members)
        for d in range(divisions)
        if rng.random() < 0.4 or (hot and d == 0)
    ]
    dense = np.zeros((members, divisions))
    for m, d, v in cells:
        dense[m, d] = v
    return spark.createDataFrame(cells, "member_id long, division_id long, v int"), dense


@pytest.mark.parametrize("block,chunk", [(512, 2048), (5, 7)])
def test_products_do_not_depend_on_blocks(spark, block, chunk):
    values, x = matrix(spark)
    ids = spark.range(len(x)).select("id")
    found = blocks.self_products(
        values.select(F.col("member_id").alias("id"), F.col("division_id").alias("key"), "v"),
        ids,
        F.lit(40),
        block,
        chunk,
    ).collect()
    assert len(found) == len(x) * (len(x) + 1) // 2
    for r in found:
        assert r["a"] <= r["b"]
        assert r["dot"] == x[r["a"]] @ x[r["b"]]
        assert r["shared"] == np.sum((x[r["a"]] != 0) & (x[r["b"]] != 0))


def test_rows_go_only_to_blocks_that_hold_their_key(spark):
    # Eight bodies of 40 members and 6 divisions each, without a common division; one has a member more often.
    cells = [(100 * body + m, 1000 * body + d, 1 if (m + d) % 3 else -1) for body in range(8) for m in range(40) for d in range(6)]
    values = spark.createDataFrame(cells, "id long, key long, v int").repartition(5)
    ids = values.select("id").distinct()
    rows = blocks.routed_pairs(values, ids, F.lit(48), 10, 7, False).collect()
    held = {}
    for r in rows:
        held.setdefault(r["b"], set()).add(r["id"] // 100)
    assert len(held) > 8
    # A row is copied to the blocks of its own body (and of what is dealt with it), not to all.
    per_body = {body: sum(body in bodies for bodies in held.values()) for body in range(8)}
    assert len(rows) == sum(per_body[i // 100] for i, *_ in cells) < len(cells) * len(held) / 3
    found = {(r["a"], r["b"]): (r["shared"], r["dot"]) for r in blocks.self_products(values, ids, F.lit(48), 10, 7, False).collect()}
    vector = {}
    for i, k, v in cells:
        vector.setdefault(i, {})[k] = v
    want = {}
    for a, x in vector.items():
        for b, y in vector.items():
            if a <= b and x.keys() & y.keys():
                want[a, b] = (len(x.keys() & y.keys()), sum(x[k] * y[k] for k in x.keys() & y.keys()))
    assert found == want


def test_routes_beyond_the_broadcast_size(spark, monkeypatch):
    values, x = matrix(spark)
    rows = values.select(F.col("member_id").alias("id"), F.col("division_id").alias("key"), "v")
    ids = spark.range(len(x)).select("id")
    few = {tuple(r) for r in blocks.self_products(rows, ids, F.lit(40), 5, 7, False).collect()}
    monkeypatch.setattr(blocks, "sized", lambda df, name: session.stage(df, name))
    assert {tuple(r) for r in blocks.self_products(rows, ids, F.lit(40), 5, 7, False).collect()} == few


def test_only_pairs_of_one_cell_meet(spark):
    left = spark.createDataFrame([(u, k, f"c{u % 3}") for u in range(30) for k in (1, 2)], "id long, key long, cell string")
    right = spark.createDataFrame([(100 + m, 2, f"c{m % 4}") for m in range(12)], "id long, key long, cell string")
    met = []
    for named in (False, True):
        rows = blocks.routed_sides(
            left, right, left.select("id", "cell").distinct(), right.select("id", "cell").distinct(), F.lit(2), 4, 2, 8, named
        ).collect()
        assert {r["cell"] for r in rows} == {"c0", "c1", "c2"} and {r["key"] for r in rows} == {2}
        met.append({(a["id"], b["id"]) for a in rows for b in rows if (a["side"], b["side"]) == (0, 1) and a["cell"] == b["cell"]
                    and (a["lb"], a["rb"]) == (b["lb"], b["rb"])})
    assert met[0] == met[1] == {(u, 100 + m) for u in range(30) for m in range(12) if u % 3 == m % 4}


@pytest.mark.parametrize("density", [0.01, 0.9])
def test_sums_of_sparse_and_filled_blocks(density):
    rng = np.random.default_rng(1)
    x, y = (rng.choice([-1, 1], (n, 300)) * (rng.random((n, 300)) < density) for n in (31, 17))
    x[:, 7], y[:, 7] = 1, -1  # a key everybody has

    def rows(m, names):
        i, k = np.nonzero(m)
        return pd.DataFrame({"id": names[i], "key": k * 10, "v": m[i, k]}).sample(frac=1, random_state=3)

    names = np.array([f"r{i:02d}" for i in range(17)])
    li, ri, shared, dot = blocks.pair_sums(rows(x, np.arange(31) * 2), rows(y, names))
    assert li.tolist() == list(range(0, 62, 2)) and ri.tolist() == names.tolist()
    assert (dot == x @ y.T).all() and (shared == np.abs(x) @ np.abs(y).T).all()


def people(spark, n):
    return spark.range(n).select(
        F.col("id").alias("member_id"),
        F.format_string("m%03d", "id").alias("canonical_name"),
        F.lit(True).alias("is_currently_active"),
        F.array(F.struct(F.lit("Deputy").alias("position"), F.lit(1).alias("count"))).alias("position_history"),
    )


def test_alignment_of_strangers(spark):
    values = spark.createDataFrame([(0, 0, 1), (1, 1, -1), (2, 0, 0)], "member_id long, division_id long, v int")
    members, divisions = people(spark, 3), spark.range(2).select(F.col("id").alias("division_id"))
    null = {(r["m1"], r["m2"]): r["pct"] for r in alignment.alignment(values, members, divisions, strangers=True).collect()}
    zero = {
        (r["m1"], r["m2"]): r["pct"] for r in alignment.alignment(values, members, divisions, "zero", True).collect()
    }
    assert null == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): None, (0, 1): None, (0, 2): None, (1, 2): None}
    assert all(zero[k] == (v or 0.0) for k, v in null.items())
    similar = {(r["m1"], r["m2"]): r["similarity"] for r in alignment.cosine(values, members, divisions, True).collect()}
    assert {(r["m1"], r["m2"]) for r in alignment.alignment(values, members, divisions).collect()} == {(0, 0), (1, 1)}
    assert similar[(0, 0)] == 1.0 and similar[(2, 2)] == 0.0 and similar[(0, 1)] == 0.0


def test_sparse_and_filled_products_are_equal(monkeypatch):
    rng = np.random.default_rng(8)

    def side(n):
        cells = rng.choice(60 * 500, n, replace=False)
        return pd.DataFrame({"id": cells // 500, "key": cells % 500, "v": rng.choice([-1, 1], n)})

    for n in (0, 1, 40, 900):  # on both sides of the border between the two ways
        left, right = side(n), side(max(n, 5))
        found = blocks.pair_sums(left, right)
        for work in (-1, 1 << 60):
            monkeypatch.setattr(blocks, "SPARSE_WORK", work)
            assert all((x == y).all() for x, y in zip(blocks.pair_sums(left, right), found))


def test_positions_agree_and_reproduce_the_products(spark, monkeypatch):
    values, x = matrix(spark, 12, 60)
    members = people(spark, 12)
    centred = x - x.mean(axis=0)
    gram = centred @ centred.T
    expected = np.sort(np.linalg.eigvalsh(gram))[::-1][:3]
    # All directions in one block, and a long chain of small ones.
    for width, guard in ((spectrum.WIDTH, spectrum.GUARD), (3, 0)):
        monkeypatch.setattr(spectrum, "GUARD", guard)
        placed, shares, residual = spectrum.positions(values, members, 3, width=width)
        assert residual <= 1e-9
        c = np.array([[r.pc1, r.pc2, r.pc3] for r in placed.orderBy("member_id").collect()])
        assert np.allclose(c.sum(axis=0), 0, atol=1e-8)
        assert np.allclose(c.T @ c, np.diag(expected), atol=1e-6)
        assert np.allclose(gram @ c, c * expected, atol=1e-6)
        assert np.allclose(shares, expected / np.trace(gram))
        assert all(c[np.argmax(np.abs(c[:, i])), i] > 0 for i in range(3))


def test_blocs_follow_the_plain_loop(spark):
    rng = random.Random(5)
    points = [(i, f"m{i:03d}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(60)]
    df = spark.createDataFrame(points, "member_id long, canonical_name string, x double, y double")
    found = {r["member_id"]: r["bloc"] for r in spectrum.blocs(df, 5, 50).collect()}
    xy = np.array([(p[2], p[3]) for p in points])
    order = sorted(range(60), key=lambda i: points[i][2])
    centres = np.array([xy[order[int((i / 4) * 59)]] for i in range(5)])
    for _ in range(50):
        near = ((xy[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([xy[near == c].mean(0) if (near == c).any() else (0.0, 0.0) for c in range(5)])
    assert [found[i] for i in range(60)] == near.tolist()
    roster = spectrum.bloc_roster(df.withColumn("bloc", F.lit(1))).collect()
    assert {r["size"] for r in roster} == {60}


def ward_by_hand(x, k):
    norms = np.linalg.norm(x, axis=1)
    norms[norms == 0] = 1
    cos = (x / norms[:, None]) @ (x / norms[:, None]).T
    d2 = {frozenset(p): max(1 - cos[p], 0) ** 2 for p in itertools.combinations(range(len(x)), 2)}
    size = {i: 1 for i in range(len(x))}
    group = {i: {i} for i in range(len(x))}
    while len(size) > k:
        pair = min(d2, key=lambda p: (d2[p], sorted(p)))
        s, t = sorted(pair)
        h = d2.pop(pair)
        for v in size:
            if v in (s, t):
                continue
            total = size[s] + size[t] + size[v]
            a, b = d2.pop(frozenset((s, v))), d2.pop(frozenset((t, v)))
            d2[frozenset((s, v))] = ((size[v] + size[s]) * a + (size[v] + size[t]) * b - size[v] * h) / total
        size[s] += size.pop(t)
        group[s] |= group.pop(t)
    return {frozenset(g) for g in group.values()}


def test_ward_blocs(spark):
    values, x = matrix(spark, 21, 50, seed=11)
    divisions = spark.range(50).select(F.col("id").alias("division_id"))
    found = spectrum.hier_blocs(values, people(spark, 21), divisions, 5).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["bloc"], set()).add(r["member_id"])
    assert {frozenset(g) for g in groups.values()} == ward_by_hand(x, 5)


def test_ward_blocs_store_no_pair_of_strangers(spark, monkeypatch):
    values, x = matrix(spark, 15, 150, seed=9)
    # Three bodies without a common division: 105 pairs, of which 30 may share one.
    values = values.where("member_id % 3 = division_id % 3")
    x = x * (np.arange(15)[:, None] % 3 == np.arange(150) % 3)
    written, keep = [], session.Stages.keep
    before = glob.glob(f"{session.shared_folder(spark)}/ward-*")

    def kept(self, df, name):
        staged = keep(self, df, name)
        written.append((name, staged.count()))
        return staged

    monkeypatch.setattr(session.Stages, "keep", kept)
    divisions = spark.range(150).select(F.col("id").alias("division_id"))
    found = spectrum.hier_blocs(values, people(spark, 15), divisions, 4).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["bloc"], set()).add(r["member_id"])
    assert {frozenset(g) for g in groups.values()} == ward_by_hand(x, 4)
    pairs = [n for name, n in written if name == "ward"]
    assert 0 < pairs[0] <= 30 and pairs == sorted(pairs, reverse=True)
    assert sorted(glob.glob(f"{session.shared_folder(spark)}/ward-*")) == sorted(before)


def test_ward_blocs_without_votes(spark):
    values, _ = matrix(spark, 3, 5, seed=1)
    divisions = spark.range(5).select(F.col("id").alias("division_id"))
    found = spectrum.hier_blocs(values.where("false"), people(spark, 3), divisions, 2).collect()
    assert sorted(r["member_id"] for r in found) == [0, 1, 2] and {r["bloc"] for r in found} == {1}


def test_candidate_scores_by_hand_and_by_blocks(spark, monkeypatch):
    topics = vocab.TOPICS[:6]
    rng = random.Random(2)
    questions = [(f"q{i}", topics[i % 5]) for i in range(17)]
    cands = [(c, f"c{c}", "Deputy", "St John") for c in range(7)]
    stances = [
        (c, q, rng.choice(vocab.STANCES), rng.choice([None, None, "neutral"]))
        for c, *_ in cands
        for q, _ in questions
        if rng.random() < 0.8
    ]
    salience = [(c, t, rng.randrange(100) / 100) for c, *_ in cands for t in topics if rng.random() < 0.7]
    wishes = {u: [rng.choice(topics + ["Unknown"]) for _ in range(rng.randrange(1, 8))] for u in range(5)}
    wishes[9] = ["Unknown"]
    replies = {(u, q): rng.choice([*vocab.ANSWERS, "skip"]) for u in wishes for q, _ in questions if rng.random() < 0.6}
    tables = (
        spark.createDataFrame(
            [(u, i, t) for u, ts in wishes.items() for i, t in enumerate(ts)],
            "respondent_id long, position int, topic string",
        ),
        spark.createDataFrame(
            [(u, q, a) for (u, q), a in replies.items()], "respondent_id long, question_id string, answer string"
        ),
        spark.createDataFrame(cands, "candidate_id long, full_name string, role string, constituency string"),
        spark.createDataFrame(salience, "candidate_id long, topic string, salience double"),
        spark.createDataFrame(
            stances, "candidate_id long, question_id string, stance string, corrected_stance string"
        ),
        spark.createDataFrame(questions, "question_id string, topic string"),
    )

    def half_up(x):
        return np.floor(x * 100 + 0.5) / 100

    def by_hand(u, c):
        p = [t for t in wishes[u] if t in vocab.TOPICS][:5]
        w = lambda t: 5 - p.index(t) if t in p else 0
        sal = {t: s for cc, t, s in salience if cc == c}
        held = {q: (corr or s) for cc, q, s, corr in stances if cc == c}
        t_score = sum(w(t) * sal.get(t, 0) for t in p) / sum(w(t) for t in p)
        num = den = n = hits = seen = 0
        for q, topic in questions:
            a = replies.get((u, q), "skip")
            if a == "skip" or q not in held:
                continue
            seen += 1
            if held[q] == "not_addressed":
                continue
            m = 1 if a == held[q] else 0.5 if "neutral" in (a, held[q]) else 0
            num, den, n, hits = num + (w(topic) or 1) * m, den + (w(topic) or 1), n + 1, hits + (m == 1)
        raw_s = num / den if den else 0
        s_score = raw_s * min(1, n / 8)
        mine = {q for q, t in questions if t in p}
        cover = sum(held.get(q, "not_addressed") != "not_addressed" for q in mine) / len(mine) if mine else 0
        total = 0.4 * t_score + 0.6 * s_score
        return tuple(map(half_up, (t_score, s_score, raw_s, cover, total))) + (hits, seen, n, cover < 0.4)

    fields = "T S S_raw C match matched_questions answered_questions overlap_count low_coverage".split()
    small = partial(blocks.cross_products, left_block=2, right_block=3, chunk=4)
    for products in (blocks.cross_products, small):
        monkeypatch.setattr(scoring, "cross_products", products)
        found = scoring.candidate_match(*tables).collect()
        users = {u for u in wishes if any(t in vocab.TOPICS for t in wishes[u])}
        assert {(r["respondent_id"], r["candidate_id"]) for r in found} == {(u, c[0]) for u in users for c in cands}
        for r in found:
            assert tuple(r[f] for f in fields) == by_hand(r["respondent_id"], r["candidate_id"])
            assert 0 <= r["S"] <= r["S_raw"] <= 1 and 0 <= r["C"] <= 1
        for u in users:
            ranked = sorted((r for r in found if r["respondent_id"] == u), key=lambda r: r["rank"])
            keys = [(r["low_coverage"], -np.floor(r["match"] * 100 + 0.5), -r["S"], r["name"]) for r in ranked]
            assert keys == sorted(keys)
    assert [r["respondent_id"] for r in scoring.priority_rejects(tables[0]).collect()] == [
        u for u in wishes if u not in users
    ]


def test_area_cells_are_the_area_filter(spark):
    cands = spark.createDataFrame(
        [(1, "Connétable", "St John"), (2, "Deputy", "St John, St Lawrence and Trinity"), (3, "Senator", None), (4, "Deputy", "St Clement"),
         (5, None, "Elsewhere"), (6, "Deputy", None), (7, "Senator", "St John")],
        "candidate_id long, role string, constituency string",
    )
    for areas in (None, {}, {"Elsewhere": ["St John"], "X": []}):
        cells = cands.select("candidate_id", F.explode(scoring._cells(areas)).alias("cell")).collect()
        assert len(cells) == len(set(cells))
        for area in (*(vocab.AREA_CONSTITUENCIES if areas is None else areas), "Elsewhere", "St John", "Nowhere"):
            want = {r["candidate_id"] for r in scoring.area_filter(cands, area, areas).collect()}
            assert {r["candidate_id"] for r in cells if r["cell"] == f"={area}"} == want
        assert {r["candidate_id"] for r in cells if r["cell"] == ""} == set(range(1, 8))


def test_area_expansion(spark):
    cands = spark.createDataFrame(
        [(1, "Connétable", "St John"), (2, "Deputy", "St John, St Lawrence and Trinity"), (3, "Senator", None), (4, "Deputy", "St Clement")],
        "candidate_id int, role string, constituency string",
    )

    def ids(area):
        return sorted(r["candidate_id"] for r in scoring.area_filter(cands, area).collect())

    assert ids("St John") == [1, 2, 3]
    assert ids("St John, St Lawrence and Trinity") == [2]
    assert ids(None) == ids("") == [1, 2, 3, 4]


def test_quiz_selection_by_hand(spark):
    rng = random.Random(4)
    divisions = [
        (d, d % 31, f"{'abc'[d % 3] * 35} {d % 11}", rng.randrange(0, 30), rng.randrange(0, 30)) for d in range(300)
    ]
    df = spark.createDataFrame(
        divisions, "division_id long, proposition_id long, proposition_title string, pour_count long, contre_count long"
    ).withColumn("division_stage", F.lit("amendment")).withColumn("date", F.lit("2024-01-01").cast("timestamp"))
    df = df.withColumn(
        "proposition_title", F.concat(F.col("division_id").cast("string"), F.lit(" "), "proposition_title")
    )
    props = spark.createDataFrame(
        [(p, f"P.{p}/2024", "u", None if p == 0 else f"t{p % 6}", None, "**H** x\n first ") for p in range(31)],
        "proposition_id long, base_reference string, source_url string, topic_primary string, "
        "plain_language_summary string, extended_summary string",
    )
    pool = sorted(
        (abs(p / (p + c) - 0.5), d, f"{d} {t}", f"P.{pid}/2024", f"t{pid % 6}")
        for d, pid, t, p, c in divisions
        if p + c >= 20 and min(p, c) / (p + c) >= 0.25 and pid
    )[:200]
    picked, seen, topics = [], set(), {}
    for _, d, title, ref, topic in pool:
        if title[:30] in seen or ref in seen or topics.get(topic, 0) >= 4 or len(picked) >= 12:
            continue
        picked.append(d)
        topics[topic] = topics.get(topic, 0) + 1
        seen |= {title[:30], ref}
    found = scoring.quiz_questions(df, props, n=12).orderBy("position").collect()
    assert [r["division_id"] for r in found] == picked
    assert {r["summary"] for r in found} == {"first"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_a_frequent_piece_is_split(spark, monkeypatch):
    rows = [(1 if i % 3 else i, i) for i in range(900)]
    left = spark.createDataFrame(rows, "k long, x long")
    right = spark.createDataFrame([(k, 10_000 + x) for k, x in rows if x % 2], "k long, y long")
    met = []
    monkeypatch.setattr(linkage, "sized", lambda df, name: met.append(df.collect()) or session.sized(df, name))
    joined = linkage.split_join(left, right, ["k"], 50)
    assert {r["k"] for r in met[0]} == {1}
    assert {tuple(r) for r in joined.collect()} == {(k, x, 10_000 + y) for k, x in rows for j, y in rows if y % 2 and j == k}
    assert joined.count() == sum(1 for k, x in rows for j, y in rows if y % 2 and j == k)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Nested" not in plan and "Cartesian" not in plan
    # A third of all names share their longest piece.
    names = [f"{'constantinople' if i % 3 == 0 else chr(97 + i % 26) * 7} {i:04d}" for i in range(240)]
    monkeypatch.setattr(linkage, "CELL", 10)
    monkeypatch.setattr(linkage.split_join, "__defaults__", (10,))
    a = spark.createDataFrame([(n,) for n in names[:120]], "a string")
    b = spark.createDataFrame([(n,) for n in names[60:]], "b string")
    found = {tuple(r) for r in linkage.near_pairs(a, b, 0.85).collect()}
    assert found == {
        (x, y) for x in names[:120] for y in names[60:]
        if edits(x, y) <= 0.15 * (len(x) + len(y)) + 1e-9 and sum(min(x.count(c), y.count(c)) for c in set(x)) >= 0.425 * (len(x) + len(y)) - 1e-9
    }


def test_near_misses_by_brute_force(spark):
    rng = random.Random(8)
    first, last = ["rob", "robert", "ann", "anne", "zoe", "li"], ["ward", "warde", "wardle", "lee", "le feuvre", "o"]
    names = [f"{a} {b}" for a in first for b in last]
    names += ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    rng.shuffle(names)
    cands, members = names[:60] + ["robert ward"] * 5, names[40:]
    c = spark.createDataFrame([(i, f"s{i}", n) for i, n in enumerate(cands)], "candidate_id long, slug string, name string")
    m = spark.createDataFrame(list(enumerate(members)), "member_id long, name string")
    none = spark.createDataFrame([], "candidate_id long")

    def canon(n):
        return " ".join(n.split())

    def letters(x, y):
        return sum(min(x.count(c), y.count(c)) for c in set(x))

    for threshold in (0.93, 0.85, 0.6, 0.45, 0.2):
        bound = (1 - threshold) + 1e-9
        pairs = {
            (a, b) for a in map(canon, cands) for b in map(canon, members)
            if a and b and edits(a, b) <= bound * (len(a) + len(b)) and letters(a, b) >= threshold * (len(a) + len(b)) / 2 - 1e-9
        }
        found = linkage.near_pairs(
            c.select(F.trim(F.regexp_replace("name", " +", " ")).alias("a")), m.select(F.trim(F.regexp_replace("name", " +", " ")).alias("b")),
            threshold,
        ).collect()
        assert len(found) == len(pairs) and {tuple(r) for r in found} == pairs
    for threshold in (0.85, 0.75, 0.6):
        expected = {}
        for i, n in enumerate(cands):
            ratios = [
                (-SequenceMatcher(None, canon(n), canon(x)).ratio(), canon(x)) for x in members if canon(x) and canon(n)
            ]
            best = min(ratios, default=(0, ""))
            if -best[0] >= threshold:
                expected[i] = (-best[0], best[1])
        found = linkage.near_misses(c, m, none, threshold).collect()
        assert {r["candidate_id"]: (r["ratio"], canon(r["member_name"])) for r in found} == expected


def test_short_names_meet_by_their_letters(spark):
    # All share the piece "ab"; only those with the same letters may meet.
    names = ["ab" + 4 * (chr(99 + i) + chr(100 + i)) for i in range(20)]
    a = spark.createDataFrame([(n,) for n in names], "a string").repartition(1).distinct()
    b = spark.createDataFrame([(n[:2] + n[3] + n[2] + n[4:],) for n in names], "b string")
    assert linkage._by_pieces(a, b, 0.85).count() == 0
    assert linkage._by_shared(a, b, 0.85).distinct().count() == 20
    assert linkage.near_pairs(a, b, 0.85).count() == 20
    assert linkage._dealt(a).select(F.spark_partition_id()).distinct().count() > 1


def test_letters_are_counted_for_near_names_only(spark):
    names = spark.createDataFrame([("ann ward",), ("anne ward",), ("robert le feuvre",)], "a string")
    found = linkage.near_pairs(names, names.withColumnRenamed("a", "b"), 0.85)
    # In the condition of the join they would be counted for all candidates.
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(a, b) for a, in names.collect() for b, in names.collect() if a[0] == b[0]}


def test_linking_tiers(spark):
    members = spark.createDataFrame(
        [(1, "Robert Ward"), (2, "Élise Le-Feuvre"), (3, "Tom Binet"), (4, "Tim Binet"), (5, "Kirsten Morel")],
        "member_id long, name string",
    )
    cands = spark.createDataFrame(
        [
            (1, "rob-ward", "Rob Ward"),
            (2, "elise", "elise le feuvre"),
            (3, "t-binet", "T Binet"),  # two members share the key
            (4, "k1", "Kris Morel"),
            (5, "k2", "Kim Morel"),  # two candidates share the key
            (6, "forced", "Someone Else"),
            (7, "gone", "Tom Binet"),  # override to an unknown member falls through
            (8, "solo", "Ward"),
        ],
        "candidate_id long, slug string, name string",
    )
    overrides = spark.createDataFrame(
        [("forced", "KIRSTEN  Morel", 0), ("gone", "No Body", 1)], "slug string, member_name string, row_no long"
    )
    found = {r["candidate_id"]: (r["member_id"], r["reason"]) for r in linkage.link_people(cands, members, overrides).collect()}
    assert found == {1: (1, "initial-unique"), 2: (2, "exact"), 6: (5, "override"), 7: (3, "exact")}
    keys = {r["key"] for r in linkage.link_collisions(cands, members).collect()}
    assert keys == {"t binet", "k morel"}


def test_replies(spark):
    texts = {
        1: '[{"topic": "Housing", "salience": 1.7, "summary": " s ", "source_quote": "build homes"}]',
        2: '```json\n[{"topic": "Housing", "salience": "0.305", "summary": "a "b c", "source_quote": ""}]\n```',
        7: '[{"topic": "Housing", "summary": "two "bare" marks"}]',
        3: '[{"topic": "Housing"',
        4: '[{"topic": "Weather", "salience": 0.1}, {"topic": "Housing", "salience": -1, "source_quote": "never said"}, {"topic": "Housing", "salience": 1}]',
        5: '[{"topic": "Housing", "salience": "high"}]',
        6: "[]",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, response_text string")
    docs = df.select("doc_id", F.lit("We will BUILD\n homes.").alias("text"))
    good, rejects = annotate.parse_annotations(df, annotate.TOPIC_REPLY, numbers=["salience"])
    assert {r["doc_id"]: r["reason"] for r in rejects.collect()} == {
        3: "not JSON", 5: "bad number", 7: "not JSON",
    }
    found = {r["doc_id"]: (r["topic"], r["salience"], r["summary"], r["source_quote"]) for r in annotate.clean_topics(good, docs).collect()}
    assert found == {
        1: ("Housing", 1.0, "s", "build homes"),
        2: ("Housing", round(0.305, 2), 'a "b c', ""),
        4: ("Housing", 0.0, "", ""),
    }


def test_reply_shapes(spark):
    given = 'Sure:\n```json\n{"primary": "housing"}\n``` done'
    for shape in ("block", "outermost"):
        df = spark.createDataFrame([(given,)], "t string").select(annotate.clean_reply(F.col("t"), shape).alias("x"))
        assert df.first()["x"] == '{"primary": "housing"}'


def test_label_coercion(spark):
    df = spark.createDataFrame(
        [("Housing",), ("housing & land",), ("tax",), ("zzz",), (None,)], "primary string"
    ).withColumn("secondary", F.lit("null")).withColumn("tags", F.split(F.lit("a b c d e f"), " "))
    found = annotate.coerce_labels(df).collect()
    assert [r["primary"] for r in found] == [
        "Housing", "Housing", "Finance & Taxation", vocab.FALLBACK_TOPIC, vocab.FALLBACK_TOPIC,
    ]
    assert {r["secondary"] for r in found} == {None} and len(found[0]["tags"]) == 5


def test_index_cards(spark):
    def card(slug, name, items):
        return (
            f'<figure class="a" data-testid="profile-card"><a href="https://x.org/candidates/2026/{slug}/?from=1">'
            f'<img src="/{slug}.jpg"></a><h5 data-testid="profile-card-heading">{name}</h5>'
            + "".join(f"<li>{i}</li>" for i in items)
            + "</figure>"
        )

    page = (
        card("ann-o-lee-3", "<a>Ann O&#39;Lee</a>", ["Reform", "", "Standing for connétable of St John.", "St. John"])
        + card("bob", "", ["n/a", "standing for  SENATOR", "St.  Mary, St. Ouen"])
        + card("ann-o-lee-3", "<a>Again</a>", [])
        + '<figure data-testid="profile-card"><a href="/local">x</a></figure>'
    )
    found = pages.card_explode(spark.createDataFrame([(1, page)], "page_id long, html string"), "https://s.org")
    got = [tuple(r)[2:] for r in found.orderBy("pos").collect()]
    assert got == [
        ("ann-o-lee-3", "https://s.org/candidates/2026/ann-o-lee-3/", "Ann O'Lee", "/ann-o-lee-3.jpg", "Connétable", "St John", "Reform"),
        ("bob", "https://s.org/candidates/2026/bob/", "Bob", "/bob.jpg", "Senator", "St Mary, St Ouen", None),
    ]


def test_links_are_capped_in_page_order(spark):
    anchors = "".join(f'<A class=x HREF = "/p{i % 50}#f{i}"> <b>n{i}</b>&amp; </a>' for i in range(70))
    html = '<a href="/p0"> </a><a href="mailto:a@b">m</a><a href="http://o.org/">o</a><a href="?q">q</a>' + anchors
    df = spark.createDataFrame([(1, "https://www.s.org/", html)], "page_id long, url string, html string")
    found = pages.internal_links(df).orderBy("position").collect()
    assert len(found) == 40
    assert (found[0]["text"], found[0]["url"]) == ("q", "https://www.s.org/?q")
    assert (found[1]["text"], found[1]["url"]) == ("n0 &", "https://www.s.org/p0")


def test_stored_pages_behind_links(spark):
    rows = [
        (1, "https://s.org/", '<a href="/b#x">b</a><a href="/a">a</a><a href="/none">n</a><a href="/b">again</a>'),
        (2, "https://s.org/a", "A"), (3, "https://s.org/b#top", "B"), (4, "https://s.org/b", "later"), (5, "https://o.org/a", "other"),
    ]
    stored = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = pages.linked_pages(stored, pages.internal_links(stored)).orderBy("page").collect()
    assert [tuple(r) for r in found] == [(1, 1, 3, "https://s.org/b#top", "B"), (1, 2, 2, "https://s.org/a", "A")]
    document, _ = pages.aggregate_pages(
        pages.linked_pages(stored, pages.internal_links(stored)).withColumnRenamed("html", "text"),
        spark.createDataFrame([], "page_id long, page int, position int, url string, text string"), "page_id",
    )
    assert document.collect()[0]["document"] == "## b\n\nB\n\n## a\n\nA"


@pytest.mark.parametrize("span", [4096, 3])
def test_long_documents_are_cut(spark, span):
    parts = spark.range(200).select(
        (F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.repeat(F.lit("x"), (F.col("id") % 17).cast("int")).alias("part")
    )
    rows = parts.orderBy("o").collect()
    found = {r["k"]: r["document"] for r in pages.assemble_document(parts, "k", "o", limit=250, span=span).collect()}
    for k in (0, 1):
        assert found[k] == "\n\n".join(r["part"] for r in rows if r["k"] == k)[:250]


def test_upsert_policies(spark):
    old = spark.createDataFrame(
        [("a", "A", "Deputy", "2026-01-01", "t1"), ("b", "B", None, None, "t2")],
        "slug string, full_name string, role string, opted_out_at string, correction_token string",
    )
    new = spark.createDataFrame(
        [("a", "A2", None, None, "zz"), ("c", "C", "Senator", None, "t3")], old.schema
    )
    once = merge.upsert(old, new, ["slug"], merge.PROFILE_POLICY)
    assert sorted(tuple(r) for r in once.collect()) == [
        ("a", "A2", "Deputy", "2026-01-01", "t1"), ("b", "B", None, None, "t2"), ("c", "C", "Senator", None, "t3"),
    ]
    twice = merge.upsert(once, new, ["slug"], merge.PROFILE_POLICY)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_repeated_keys_are_applied_one_after_the_other(spark):
    schema = "slug string, full_name string, role string, correction_token string"
    old = spark.createDataFrame([("a", "A", None, "t0"), ("z", "Z", "Senator", "t9")], schema)
    batch = [("a", "A1", "Deputy", "x", 1), ("a", "A2", None, "y", 2), ("b", "B1", None, "t1", 4), ("b", None, "Deputy", "t2", 5), ("b", "B0", "Senator", "t3", 3)]
    new = spark.createDataFrame(batch, f"{schema}, at int").repartition(4)
    policy = {"role": "fill", "correction_token": "keep"}
    expected = [("a", "A2", "Deputy", "t0"), ("b", None, "Deputy", "t3"), ("z", "Z", "Senator", "t9")]
    assert sorted(tuple(r) for r in merge.upsert(old, new, ["slug"], policy, order="at").collect()) == expected
    assert merge.upsert(old, new, ["slug"], policy).count() == 3
    assert merge.upsert(old, new.limit(0), ["slug"]).count() == 2


def test_candidate_sources_and_stamps(spark):
    fields = "status string, text string, word_count int, source_url string, source_label string, notes string"
    table = spark.createDataFrame(
        [(1, "pending", None, None, None, None, None, "2026-01-01"), (2, "found", "t", 1, "u", "l", "n", "2026-01-02")],
        "id long, " + ", ".join(f"enhanced_manifesto_{f}" for f in fields.split(", ")) + ", enhanced_manifesto_fetched_at string",
    )
    updates = spark.createDataFrame(
        [(1, "found", "x", 3, "u", None, None, 1), (1, "not_found", None, None, None, None, "gone", 2)], f"id long, {fields}, at int"
    )
    found = merge.update_source(table, updates, "id", F.lit("now"), merge.CANDIDATE_SOURCE, "at").orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "not_found", None, None, None, None, "gone", "now"), (2, "found", "t", 1, "u", "l", "n", "2026-01-02")]
    stamped = merge.mark_classified(table, updates, "id", F.lit("done"), "enhanced_manifesto_fetched_at").orderBy("id").collect()
    assert [r["enhanced_manifesto_fetched_at"] for r in stamped] == ["done", "2026-01-02"]


def test_empty_cells_are_text(spark, tmp_path):
    lines = ["ID,MemberName,MemberPosition,Date,Reference,Title,PropositionTitle,Vote"]
    lines += [f"1,{n},Mr.,01/02/2003 00:00:00,,,,{vote}" for n, vote in (("Ann", "Pour"), ("Ann", ""), ("Bob", ""))]
    path = tmp_path / "votes.csv"
    path.write_text("\n".join(lines) + "\n")
    raw = files.scan_votes(spark, str(path))
    assert raw.where("Vote IS NULL OR Reference IS NULL OR Title IS NULL").count() == 0
    for rows in (raw, raw.withColumn("Vote", F.nullif("Vote", F.lit("")))):
        tables = ingest.build_all(rows)
        votes = tables["votes"].join(tables["members"], "member_id").select("canonical_name", F.coalesce("vote", F.lit("")).alias("v"))
        assert sorted(tuple(r) for r in votes.collect()) == [("Ann", "Pour"), ("Bob", "")]
        division = tables["divisions"].first()
        assert (division["pour_count"], division["absent_count"], division["total_eligible"]) == (1, 1, 2)
        assert division["proposition_id"] == 1 and division["reference"] == ""


def test_headings_of_sub_pages(spark):
    urls = ["https://a.b/x/y/", "https://a.b/x/y?q=1#z", "https://a.b", "https://a.b/", "https://a.b//p;v=1/", "nonsense"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(pages.page_heading(F.col("u")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["y", "y", "https://a.b", "https://a.b/", "p", "nonsense"]


def test_question_sets_and_areas(spark, tmp_path):
    path = tmp_path / "set.json"
    path.write_text('{"questions": [\n {"id": "q2", "topic": "T", "statement": "s", "explainer": "e"}, {"id": "q1", "topic": "U", "statement": "t"}]}')
    rows = files.read_questions(spark, str(path))
    assert [tuple(r) for r in rows.collect()] == [("q2", "T", "s", "e", 2026, 0), ("q1", "U", "t", None, 2026, 1)]
    topics = spark.createDataFrame([("T",)], "topic string")
    with pytest.raises(ValueError):
        files.require_known_topics(rows, topics)
    people = spark.createDataFrame([(1, "St John", "Deputy"), (2, "Else", "Senator")], "candidate_id long, constituency string, role string")
    assert scoring.area_filter(people, "  ").count() == 2
    assert [r["candidate_id"] for r in scoring.area_filter(people, " St John ", {}).collect()] == [1]


def test_integrity_compares_columns(spark):
    table = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("d", "e"), ("d", "e")], "x string, y string")
    found = ingest.integrity({"t": table}, {"t": [["x", "y"]]}, {"t": ["x"]}, []).collect()
    assert [tuple(r) for r in found] == [("unique t(x, y)", "d|e", 2)]


def test_staged_tables_are_safe_and_removed(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, name, default=None):
            return self.values.get(name, default)

    class Session:
        conf = Conf(**{"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Session.conf = Conf(**{"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y/"})
    assert session.shared_folder(Session()) == "hdfs://x/y"
    table = session.stage(spark.range(3), "test")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 3 and os.path.isdir(folder)
    assert session.release(spark) >= 1 and not os.path.exists(folder)


def test_stream_of_updates(spark, tmp_path):
    schema = "slug string, full_name string, role string"
    source, root = tmp_path / "in", str(tmp_path / "table")
    spark.createDataFrame([("a", "A", "Deputy"), ("a", "A1", None)], schema).coalesce(1).write.parquet(str(source / "0"))
    incremental.seed(spark.createDataFrame([("a", "old", "Senator"), ("z", "Z", None)], schema), root)
    for n, rows in enumerate([[("b", "B", None)], [("a", "A3", None), ("a", "A2", None)], [("z", "Z2", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / str(n + 1)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        query = incremental.merge_stream(
            stream, root, lambda t, b: merge.upsert(t, b, ["slug"], {"role": "fill"}, order="full_name"), str(tmp_path / "ck"), keep=2
        )
        query.awaitTermination()
    found = sorted(tuple(r) for r in incremental.current(spark, root).collect())
    assert found == [("a", "A3", "Deputy"), ("b", "B", None), ("z", "Z2", None)]
    assert incremental.versions(spark, root) == [1, 2]
    (tmp_path / "table" / "version-9").mkdir()  # a version that was never finished
    assert incremental.versions(spark, root) == [1, 2]


def test_templates_do_not_read_fields_in_values(spark):
    review = spark.createDataFrame(
        [("Ann {enhanced_url} Lee", "r", "c", " a@b.org ", "u", 5, "no", "", 0), ("B", "", "", "", "", 0, "no", "", 0)],
        "full_name string, role string, constituency string, email string, preview_url string, manifesto_word_count int, "
        "enhanced_manifesto_found string, enhanced_manifesto_url string, enhanced_manifesto_word_count int",
    )
    found = exports.message_table(review, {"enhanced": "x", "plain": "{first_name} {{}} {manifesto_wc}"}, "S").collect()
    assert [(r["email"], r["body"]) for r in found] == [("a@b.org", "Ann {} 5")]


def test_missing_salience_comes_first(spark):
    topics = spark.createDataFrame(
        [(1, "a", 0.1), (1, "b", None), (1, "c", 0.5), (1, "d", 0.4), (1, "e", 0.3)],
        "candidate_id long, topic string, salience double",
    )
    assert reports.top_topics(topics).first()["topics"] == ["b", "c", "d", "e"]


def test_batches_and_alignment(spark):
    df = spark.range(45).select("id")
    made = annotate.batches(df, 20, ["id"], ["id"])
    sizes = [len(r["items"]) for r in made.orderBy("batch_id").collect()]
    assert sizes == [20, 20, 5]
    replies = spark.createDataFrame(
        [(0, '[{"index": 1, "primary": "Housing"}, {"index": 0}, {"index": 21}, {"index": 1, "primary": "x"}]'), (1, "no")],
        "batch_id long, response_text string",
    )
    good, _ = annotate.parse_annotations(replies, annotate.BATCH_REPLY)
    found = {r["id"]: r["primary"] for r in annotate.align_batches(made, good, "id").collect()}
    assert found == {i: vocab.FALLBACK_TOPIC for i in [0, *range(20, 45)]}


def test_no_pair_is_shuffled(spark):
    values, x = matrix(spark)
    rows = values.select(F.col("member_id").alias("id"), F.col("division_id").alias("key"), "v")
    for every_pair in (True, False):
        products = blocks.self_products(rows, spark.range(len(x)).select("id"), F.lit(40), 5, 7, every_pair)
        text = products._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text[: text.index("MapInArrow")]
    found = blocks.agreements(rows.where("v <> 0"), rows.where("v <> 0"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text[: text.index("MapInArrow")]


def test_norms_of_cosines_are_broadcast(spark):
    values, x = matrix(spark)
    divisions = spark.range(x.shape[1]).select(F.col("id").alias("division_id"))
    text = alignment.cosine(values, people(spark, len(x)), divisions, True)._jdf.queryExecution().executedPlan().toString()
    assert text[: text.index("MapInArrow")].count("BroadcastHashJoin") == 2


@pytest.mark.parametrize("held,work,read", [(500_000, 1 << 22, 1 << 17), (9, 5, 3), (40, 1, 1)])
def test_agreements_by_brute_force(spark, monkeypatch, held, work, read):
    for name, value in (("WORK", work), ("READ", read), ("LIGHT", 10), ("FILLED", 3)):
        monkeypatch.setattr(blocks, name, value)
    rng = random.Random(work)
    left = [(rng.choice([None, *range(60)]), k, rng.choice([1, -1])) for k in range(25) for _ in range(9)] + [(u, 99, 1) for u in range(60)]
    right = [(m, k, rng.choice([1, -1])) for m in range(40) for k in range(30) if rng.random() < 0.3] + [(m, 99, -1) for m in range(3)]
    left, right = ({(i, k): v for i, k, v in rows} for rows in (left, right))
    want = {}
    for (a, k), v in left.items():
        for (b, l), w in right.items():
            if k == l:
                agreed, total = want.get((a, b), (0, 0))
                want[a, b] = agreed + (v == w), total + 1
    x, y = (spark.createDataFrame([(i, k, v) for (i, k), v in rows.items()], "id long, key long, v int") for rows in (left, right))
    for least in (1, 3):
        found = blocks.agreements(x, y, least, held).collect()
        assert len(found) == len({(r["a"], r["b"]) for r in found})
        assert {(r["a"], r["b"]): (r["agreed"], r["total"]) for r in found} == {k: v for k, v in want.items() if v[1] >= least}


@pytest.mark.parametrize("long", [2, 512])
def test_right_rows_of_a_key_travel_as_lists(spark, monkeypatch, long):
    monkeypatch.setattr(blocks, "LONG", long)
    rows = spark.range(40).select(F.col("id"), F.lit("k").alias("key"), (F.col("id") % 2).alias("v"))
    lists = blocks.listed(rows).collect()
    assert len(lists) < 40 and sorted((i, v) for r in lists for i, v in zip(r["ids"], r["vs"])) == [(i, i % 2) for i in range(40)]
    # No order by the right ids is needed, and nothing is exploded again.
    text = blocks.agreements(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in text and "side#" in text.split("Sort ")[1].split("]")[0] and "id#" not in text.split("Sort ")[1].split("]")[0]


@pytest.mark.parametrize("areas", [False, True])
def test_candidate_match_shuffles_no_pairs(spark, areas):
    priorities = spark.createDataFrame([(u, 0, vocab.TOPICS[0]) for u in range(4)], "respondent_id long, position int, topic string")
    answers = spark.createDataFrame([(u, "q", "agree") for u in range(3)], "respondent_id long, question_id string, answer string")
    cands = spark.createDataFrame(
        [(1, "b", "Deputy", "X"), (2, "a", "Deputy", "X"), (3, "a", "Deputy", "Y"), (4, None, "Deputy", "X")],
        "candidate_id long, full_name string, role string, constituency string",
    )
    saliences = spark.createDataFrame([(1, vocab.TOPICS[0], None)], "candidate_id long, topic string, salience double")
    stances = spark.createDataFrame([(1, "q", "neutral"), (2, "q", "agree")], "candidate_id long, question_id string, stance string")
    questions = spark.createDataFrame([("q", vocab.TOPICS[0])], "question_id string, topic string")
    places = spark.createDataFrame([(u, "X") for u in range(4)], "respondent_id long, area string") if areas else None
    found = scoring.candidate_match(priorities, answers, cands, saliences, stances, questions, areas=places, area_map={})
    top, *below = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert below and "Exchange" not in top and "Window" not in top
    ranked = {}
    for r in found.collect():
        ranked.setdefault(r["respondent_id"], {})[r["rank"]] = r["candidate_id"]
    # A null name comes first, equal names go by id.
    rest = [4] if areas else [4, 3]
    assert ranked[0] == dict(enumerate([2, 1, *rest], 1))
    assert ranked[3] == dict(enumerate([2, 1, *rest], 1))
