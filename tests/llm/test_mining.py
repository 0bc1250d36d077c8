"""Whitening, collocations and MinHash near-duplicates against numpy and plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import collocations, minhash, whitening
from tablewright.llm.common import documents
from tablewright.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

from .helpers import DOCS, WORDS, doc_frame, edge_rows, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("name", ["op12_collocations", "op13_minhash"])
def test_queries_match_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


# ---- whitening -----------------------------------------------------------------------------------


def test_rank_one_updates_equal_a_full_solve():
    """Repeated, close, tiny and huge eigenvalues; terms along one eigenvector; nothing to update."""
    rng = np.random.default_rng(0)
    for trial in range(400):
        d = int(rng.integers(1, 40))
        values = np.sort(rng.choice([0, 0, 1, 1, 2, 1e-8, 1e6, 3.5], d) * (1 + rng.choice([0, 1e-15, 1e-9, 0.1], d) * rng.random(d)))
        vectors = np.linalg.qr(rng.normal(size=(d, d)))[0]
        term = vectors[:, rng.integers(0, d)] * 3 if trial % 3 == 0 else rng.normal(size=d) * 10.0 ** rng.integers(-6, 6)
        found, basis = whitening.rank_one(values, vectors, term)
        want = vectors @ np.diag(values) @ vectors.T + np.outer(term, term)
        assert np.abs(basis @ np.diag(found) @ basis.T - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(basis.T @ basis - np.eye(d)).max() < 1e-12
    values, basis = whitening.rank_one(np.zeros(3), np.eye(3), np.zeros(3))
    assert not values.any() and (basis == np.eye(3)).all()


def test_spectra_of_parts_combine():
    rows = np.random.default_rng(1).integers(-500, 500, (700, 12)) + 1_000_000
    rows[:, 5] = rows[:, 4]
    found = whitening.Spectrum.empty(12)
    for at in (0, 1, 5, 300):
        upto = {0: 1, 1: 5, 5: 300, 300: 700}[at]
        found = found.with_spectrum(whitening.Spectrum.empty(12).with_rows(rows[at:upto]))
    want = np.linalg.eigvalsh(np.cov(rows.T.astype(float), bias=True) * 700)
    assert found.n == 700 and list(found.sums) == list(rows.sum(axis=0))
    assert np.abs(found.values - want).max() < 1e-12 * want.max()


def test_spectra_combine_in_spark(spark):
    """Many partitions, some empty, over several rounds of combining."""
    rows = np.random.default_rng(3).integers(-500, 500, (90, 6)) + 1_000_000
    frame = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<long>").repartition(40)
    found = whitening.combined(whitening.spectra(frame, 6), fan_in=3)
    want = np.linalg.eigvalsh(np.cov(rows.T.astype(float), bias=True) * 90)
    assert found.n == 90 and np.abs(found.values - want).max() < 1e-12 * want.max()


def plain_whitening(vectors, components=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    middle = (n * distinct - sums) / n
    cov = middle.T @ middle / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ basis / np.sqrt(values), values / np.trace(cov)


def test_whitening_equals_numpy(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(5)
    got = whitening.whitened_rows(frame).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r.vec_id, r.embedding) for r in frame.collect())
    n, deviation, white, explained = plain_whitening([v for _, v in rows])
    assert (got["vec_id"].to_numpy().reshape(-1, 16)[:, 0] == [i for i, _ in rows]).all() and (got["n"] == n).all()
    assert (got["deviation"].to_numpy().reshape(-1, 16) == deviation[:, None]).all()
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(-1, 16)) - np.abs(white)).max() < 1e-9
    assert np.abs(got["explained"].to_numpy()[:16] - explained).max() < 1e-12 and got["identity_error"].max() < 1e-10


def test_whitening_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, x string, n int, component string"
    extra = ("t", 1, "c")
    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1), rng.gauss(0, 3), rng.gauss(1, 2)] for _ in range(40)]
    rows = [(i, v, *extra) for i, v in enumerate(vectors)] + [(3, vectors[3], *extra), (None, vectors[4], *extra), (50, vectors[5], *extra)]
    unusable = [(90, None, *extra), (91, [1.0, None, 2.0], *extra), (92, [float("nan"), 1.0, 2.0], *extra), (93, [float("inf"), 1.0, 2.0], *extra)]
    got = whitening.whitened_rows(spark.createDataFrame(rows + unusable, schema)).collect()
    assert len(got) == 3 * len(rows) and {r.n for r in got} == {40}
    _, _, white, _ = plain_whitening([np.float32(v) for v in vectors])
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.vec_id == 7), sorted(abs(white[7])))
    assert whitening.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened_rows(spark.createDataFrame(unusable[:1] + [(1, [], *extra)], schema)).count() == 0
    same = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 2.0], *extra), (2, [1.0, 2.0], *extra)], schema)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in same)
    flat = whitening.whitened_rows(spark.createDataFrame([(1, [1.0, 0.0], *extra), (2, [3.0], *extra), (3, [-2.0], *extra)], schema)).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    huge = whitening.whitened_rows(spark.createDataFrame([(1, [3e38, 1.0], *extra), (2, [-3e38, 5.0], *extra), (3, [0.0, 2.0], *extra)], schema)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id < 3)


# ---- collocations --------------------------------------------------------------------------------


def plain_collocations(rows, least=10, top=2000):
    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts[lang or "und"].update((k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    result = []
    for lang, seen in counts.items():
        n = sum(v for (k, _), v in seen.items() if k == 1)
        good = {p: (k, v) for (k, p), v in seen.items() if k > 1 and v >= least}
        longer, rated = Counter(), []
        for p, (k, a) in good.items():
            if k == 3:
                w = p.split(" ")
                for q in (" ".join(w[:2]), " ".join(w[1:])):
                    longer[q] = max(longer[q], a)
        for p, (k, a) in good.items():
            w = p.split(" ")
            cuts = [(seen[(i, " ".join(w[:i]))], seen[(k - i, " ".join(w[i:]))], i) for i in range(1, k)]
            score, _, left, right = min((1_000_000 * a * a // (x * y), i, x, y) for x, y, i in cuts)
            if k == 3 or not longer[p] or 100 * longer[p] < 50 * a:
                rated.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(rated)[:top], 1):
            result.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(result)


def phrase_rows():
    rng = random.Random(4)
    words = [*"abcdefgh", "é", "\U0001d504x", "\xa0", "中"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", " .", "\t", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), "s") for i in range(300)]
    return [*rows, *edge_rows(), *[(900, "The Same The Same the same", "fr", "s")] * 12]


@pytest.mark.parametrize("settings", [{}, {"sample_bytes": 0}, {"sample_bytes": 2000}, {"sample_bytes": 9000, "block_words": 50, "most_bits": 64}])
def test_collocations_equal_plain_counts(spark, settings):
    """Whatever the sample proposes, however small the blocks and bit tables, the result is the same."""
    rows = phrase_rows()
    got = collocations.collocations(doc_frame(spark, rows), top=60, **settings).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, top=60)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "PART_BYTES", 7)
    text = "alpha beta gamma, delta" + "x" * 50 + " beta gamma. alpha beta gamma"
    block = collocations._Block()
    block.add(text)
    counts = {}
    for batch in block.counts("en", [collocations._everything()]):
        counts |= {(r["size"], r["phrase"]): r["total"] for r in batch.to_pylist()}
    assert counts[(3, "alpha beta gamma")] == 2 and counts[(2, "beta gamma")] == 3 and counts[(0, "")] == 9
    assert (2, "gamma delta") not in counts


def test_scores_are_exact_beyond_64_bits(spark):
    a = 10**13 + 7
    known = spark.createDataFrame([("en", 0, "", 10**15), ("en", 1, "x", 10**14 + 3), ("en", 1, "y", a + 1), ("en", 2, "x y", a)], collocations.COUNTS)
    (row,) = collocations.scored(known).collect()
    assert row.score == 1_000_000 * a * a // ((10**14 + 3) * (a + 1)) and (row.l, row.r) == (10**14 + 3, a + 1)


# ---- MinHash -------------------------------------------------------------------------------------


def plain_sets(rows):
    found = []
    for _, text, *_ in rows:
        words = re.findall(WORDS, lower(text))
        k = min(4, len(words))
        found.append(frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    return found


def plain_classes(rows):
    sets = plain_sets(rows)
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, *_), x, s in zip(rows, label, sets):
        if i is not None and s:
            least[x] = min(least.get(x, i), i)
    return [(i, len(s), least.get(x) if s else i) for (i, *_), x, s in zip(rows, label, sets)]


def near_rows():
    """Bases with copies that swap more and more words, so that similarities lie on both sides of the limit."""
    rng = random.Random(8)
    rows, at = [], 1000
    for base in range(12):
        words = prose(100 + base, 150).split(" ")
        shared = prose(99, 60)
        for step in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 7, 9])):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((at, " ".join(copy) + (shared if step % 5 == 0 else ""), "en", "s"))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("members", "block", "rounds"), [(minhash.REGION_MEMBERS, minhash.BLOCK_MEMBERS, minhash.BEST_ROUNDS), (2, 1, 1), (4, 6, 0)])
def test_minhash_classes_equal_plain(spark, members, block, rounds):
    """Small regions force the forest to grow deeper, small blocks force clumps into grids and back into regions; few
    rounds leave these something to find."""
    rows = [*near_rows(), *edge_rows()]
    got = minhash.near_duplicates(doc_frame(spark, rows), region_members=members, block_members=block, best_rounds=rounds).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(plain_classes(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dense_regions_stay_whole(spark):
    """A region that no further value splits is returned after the last level, and its grid joins all its members."""
    rows = [(7, 0, i, i, bytearray(range(160))) for i in range(23)]
    frame = spark.createDataFrame(rows, "key long, tree long, node long, class long, sketch binary")
    sketches = frame.select("node", "sketch")
    regions = minhash.small_regions(frame.drop("sketch"), sketches, region_members=5, grid_side=1, most_levels=2)
    cells = minhash._in_cells(regions.join(sketches, "node"), minhash.F.ceil(minhash.F.col("members") / 5), ["node", "class", "sketch"])
    pairs = cells.mapInPandas(minhash._signature_links, "a long, b long").collect()
    label = np.arange(23)
    minhash._joined(label, np.array([r.a for r in pairs]), np.array([r.b for r in pairs]))
    assert (label == 0).all()


def test_forest_misses_few_pairs():
    """Share of pairs at similarity 0.8 that meet in no region, if all regions were dense for three levels; the
    signature values of a pair agree independently. The stated bound is checked within what 200,000 draws can tell."""
    rng = np.random.default_rng(6)
    agree = rng.random((200_000, minhash.VALUES)) < 0.8
    met = np.zeros(len(agree), bool)
    for order in range(minhash.ORDERS):
        at = order * minhash.PREFIX
        base = agree[:, at : at + minhash.PREFIX].all(axis=1)

        def inside(level):
            if level == 0:
                return np.ones(len(agree), bool)
            found = np.zeros(len(agree), bool)
            for _ in range(minhash.BRANCHES):
                picked = rng.integers(0, minhash.VALUES, minhash.BRANCH_VALUES)
                found |= agree[:, picked].all(axis=1) & inside(level - 1)
            return found

        met |= base & inside(2)
    assert (~met).sum() == 0


def test_minhash_edge_tables(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    nothing = doc_frame(spark, [(1, None, None, None), (2, "", "en", "a"), (None, " ", "en", "a")])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(nothing).collect()), key=str) == [
        (1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)]
    assert collocations.collocations(nothing).count() == 0
    assert minhash.near_duplicates(documents(spark, "/root/testdata/sf0.001")).count() == documents(spark, "/root/testdata/sf0.001").count()
