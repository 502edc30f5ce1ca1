"""Line dedup, whitening and hard negatives against plain versions."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, corpus, rows
from wardline.llm import hard_negatives as hn
from wardline.llm import line_dedup as ld
from wardline.llm import whitening as wt

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lined():
    """Texts of a few dozen lines, drawn from common and rare ones, with blanks and letter case varied."""
    rng = np.random.default_rng(5)
    common = [f"A line Number {i} that is shared" for i in range(60)] + ["short", "Ünïçödé ßß", "ßßßßßßßßßß", "            ", "tenletters"]
    found = list(corpus())
    for i in range(120):
        lines = []
        for k in range(int(rng.integers(1, 30))):
            line = common[int(rng.integers(len(common)))] if rng.random() < 0.5 else f"own line {i} {k}"
            line = line.upper() if rng.random() < 0.2 else line
            lines.append(rng.choice(["", " ", "\t\x0b", "\r"]) + line + rng.choice(["", "  ", "\r", "\x0c"]))
        found.append((1000 + i, "\n".join(lines), None, "s", 1, "r", "l", "g", 1, "h"))
    return [*found, (None, "A line Number 3 that is shared\nkept", None, "s", 1, "r", "l", "g", 1, "h"), found[-1], found[-7]]


def plain_lines(docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)
    holders = defaultdict(set)
    for doc, text, *_ in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                holders[key(line)].add(doc)
    found = []
    for doc, text, *_ in docs:
        lines = (text or "").split("\n")
        gone = lambda line: doc is not None and len(holders[key(line)]) > 1 and doc != min(holders[key(line)])  # noqa: E731,B023
        kept = "\n".join(x for x in lines if not gone(x))
        found.append((doc, kept, len(lines), len(lines) - len([x for x in lines if not gone(x)]), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("probes", [ld.PROBES, 8])
def test_line_dedup(spark, monkeypatch, probes):
    monkeypatch.setattr(ld, "PROBES", probes)  # with few, a common line's shard has copies
    docs = spark.createDataFrame(lined(), SCHEMA).withColumn("gone", F.lit(1)).withColumn("n_lines", F.lit("x")).withColumn("hash", F.lit(2))
    found = sorted((tuple(r) for r in ld.line_dedup(docs.repartition(7)).collect()), key=str)
    assert found == plain_lines(lined())
    assert ld.line_dedup(docs, with_text=False).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_line_dedup_of_nothing_and_of_long_texts(spark):
    assert ld.line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "x" * 3_000_000 + "\n" + "\n".join(f"line number {i}" for i in range(50_000))
    docs = spark.createDataFrame([(2, long), (1, long[-200_000:]), (3, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in ld.line_dedup(docs).collect()), key=str) == plain_lines([(2, long), (1, long[-200_000:]), (3, None)])


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        sizes, bits = ld.perfect_hash(keys)
        assert sorted(ld.numbers(sizes, bits, keys)) == list(range(len(keys)))
        assert bits.sum() == len(keys)
    strangers = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    number = ld.numbers(sizes, bits, strangers)
    assert number.max() < len(keys) and number.min() >= -1


VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, rank string, dim string, v int"


def vectors(n=300, dim=6):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(n, dim)) * np.array([3, 3, 1, 0.5, 0.5, 0.1])[:dim] + rng.normal(size=dim)
    data[50:80] = data[50]
    more = lambda i, v, label: (i, v, label, "x", 1, "r", "d", 2)
    found = [more(i, [float(np.float32(c)) for c in data[i]], int(rng.integers(4)) if i % 41 else None) for i in range(n)]
    return [*found, more(900, None, 1), more(901, [1.0, None], 1), more(902, [math.nan] * dim, 1), more(903, [math.inf] * dim, 1), more(904, [], 1),
            more(905, [1.0, 2.0], 1), more(906, [-1.0, 2.0], 2), more(907, [0.0] * dim, 3)]


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def test_whitening(spark):
    given = vectors()
    table = spark.createDataFrame(given, VECTORS).repartition(5)
    found = wt.whiten(table, 4).collect()
    for dim in (6, 2):
        own = [(r[0], [math.floor(64 * c) + 1_000_000 for c in r[1]]) for r in given if usable(r[1]) and len(r[1]) == dim]
        fit = np.array(sorted({tuple(x) for _, x in own}), np.int64)
        n, total = len(fit), fit.sum(axis=0)
        centred = fit - total / n
        values, turned = np.linalg.eigh(centred.T @ centred / n)
        values, turned = values[::-1], turned[:, ::-1]
        got = defaultdict(dict)
        for r in found:
            if r.vec_id in dict(own):
                got[r.vec_id][r.component] = r
        assert len(got) == len(own)
        signs = None
        for vec_id, x in own:
            of = [got[vec_id][k] for k in range(1, min(4, dim) + 1)]
            assert len(got[vec_id]) == len(of)
            assert {int(r.deviation) for r in of} == {sum((n * a - int(s)) ** 2 for a, s in zip(x, total, strict=True))}
            assert {r.n for r in of} == {n} and all(0 <= r.identity_error < 1e-9 for r in of)
            k = len(of) if dim > 2 else 1  # two vectors have one direction
            want = (np.array(x) - total / n) @ turned[:, :k] / np.sqrt(values[:k])
            is_ = np.array([r.whitened for r in of])[:k]
            signs = np.sign(is_ * want) if signs is None else signs
            assert np.allclose(is_, want * signs, atol=1e-8)
            assert np.allclose([r.explained for r in of][:k], values[:k] / values.sum(), rtol=1e-9)
            assert all(r.whitened == 0 and r.explained == 0 for r in of[k:])


def test_whitening_of_equal_huge_and_no_vectors(spark):
    assert wt.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = wt.whiten(same).collect()
    assert len(found) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, 0.0, 0.0, 0.0)}
    huge = [(i, [1e300 * (i % 2), float(i), 3.0]) for i in range(9)]
    found = wt.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    x = [[int(min(64 * c, 10**12)) for c in v] for _, v in huge]
    want = {i: sum((9 * a - sum(col)) ** 2 for a, col in zip(v, zip(*x, strict=True), strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in found} == {i: int(v) for i, v in want.items()}
    assert all(r.identity_error < 1e-6 for r in found)


def test_whitening_does_not_depend_on_partitions(spark):
    table = spark.createDataFrame(vectors(), VECTORS)
    one, many = (
        sorted((r.vec_id, r.component, r.deviation, r.whitened, r.explained) for r in wt.whiten(table.repartition(n)).collect()) for n in (1, 9)
    )
    assert one == many


@pytest.mark.parametrize("gap", [0, 1e-13, 1e-9, 1e-6, 1e-3])
def test_refined_eigenvectors_of_clusters(gap):
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    exact = np.concatenate([5 + gap * np.arange(10), 3 + gap * np.arange(5), rng.random(25)])
    matrix = turn * exact @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, x = wt.refined_eigenvectors(matrix)
    assert np.abs(matrix @ x - x * values).max() < 2e-14
    assert np.abs(x.T @ x - np.eye(40)).max() < 2e-15
    assert np.abs(values - np.sort(exact)[::-1]).max() < 2e-14
    rough = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    assert np.abs(matrix @ rough - rough * np.einsum("ij,ij->j", rough, matrix @ rough)).max() > 1e-8


def plain_negatives(given, anchors, positives=5, negatives=10, low=30, high=90):
    whole = {r[0]: (r[2], [math.floor(256 * c) for c in r[1]]) for r in given if r[0] is not None and r[2] is not None and usable(r[1])}
    found = []
    for a in whole:
        if a not in anchors:
            continue
        label, v = whole[a]
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, other == label) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for s, i, same in [x for x in scored if x[2]][:positives]:
            inside = [(t, j) for t, j, its in scored if not its and low * -s <= 100 * -t <= high * -s]
            found += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(inside[:negatives], 1)]
        del same
    return sorted(found)


@pytest.mark.parametrize("block", [hn.CANDIDATES, 60])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hn, "CANDIDATES", block)
    monkeypatch.setattr(hn, "ANCHORS", block)
    given = vectors()
    table = spark.createDataFrame([*given, given[3], given[10]], VECTORS).repartition(3)  # repeated rows
    found = rows(hn.hard_negatives(hn.labelled_vectors(table), F.col("vec_id") % 10 == 0))
    assert found == plain_negatives(given, {i for i in range(0, 910, 10)})
    assert any(r[2] == 10 for r in found)


def test_hard_negatives_of_nothing_and_of_huge_vectors(spark):
    assert hn.hard_negatives(hn.labelled_vectors(spark.createDataFrame([], VECTORS)), F.lit(True)).collect() == []
    rng = np.random.default_rng(1)
    data = [(i, [float(c) for c in rng.choice([1e30, -1e30, 70000.5, 3.0], 5)], i % 2) for i in range(40)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    held = [(i, [max(-(2**16), min(2**16, c)) for c in v], label) for i, v, label in data]
    assert rows(hn.hard_negatives(hn.labelled_vectors(table), F.col("vec_id") < 9)) == plain_negatives(held, set(range(9)))


def test_angular_bounds_hold_and_filter():
    import pandas as pd

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 900
    x = np.rint(centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)) * 60).astype(np.int64)
    x[:3] = 0
    norms = np.linalg.norm(x, axis=1)
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    angles = np.arccos(np.clip(unit @ hn._apart(x[:256].astype(float), hn.DIRECTIONS).T, -1, 1)).astype(np.float32)
    block = hn._Block(pd.DataFrame({"vec_id": np.arange(1500), "norm": norms, "angles": list(angles), "v": list(x)}), norms.max())
    scored = []
    for a in range(0, 1500, 30):
        lower, upper = block.bounds(norms[a], angles[a])
        exact = x @ x[a]
        assert (lower <= exact).all() and (exact <= upper).all()
        best = np.sort(np.delete(exact, a))[::-1][:5]
        found, few = hn.windowed_negatives(block, norms[a], angles[a], x[a], best, 10, 30, 90)
        for p, (_, scores) in zip(best, found, strict=True):
            assert scores.tolist() == np.sort(exact[(100 * exact >= 30 * p) & (100 * exact <= 90 * p)])[::-1][:10].tolist()
        scored.append(few / 1500)
    assert np.mean(scored) < 0.6  # clustered vectors
