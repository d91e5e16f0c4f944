"""Merkle manifest, whitening and near-duplicate vectors against plain versions, and their edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glycospark.llm import cross_polytope, merkle, whitening


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# -- Merkle manifest ---------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves):
    """Root, and for each leaf its steps (sibling or None, sibling is left)."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            other = nodes[p ^ 1] if p ^ 1 < len(nodes) else None
            steps[k].append((other, p & 1 == 1))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], steps


def plain_manifest(rows):
    order = sorted(range(len(rows)), key=lambda k: ((rows[k][2] is not None, (rows[k][2] or "").encode()), (rows[k][0] is not None, rows[k][0] or 0), plain_leaf(rows[k])))
    groups = {}
    for k in order:
        groups.setdefault(rows[k][2], []).append(k)
    trees = [plain_tree([plain_leaf(rows[k]) for k in ks]) for ks in groups.values()]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for ks, (subroot, steps), above in zip(groups.values(), trees, upper):
        for k, own in zip(ks, steps):
            path, row = own + above, rows[k]
            digest = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                digest = plain_leaf((*row[:3], row[3] + 1, row[4]))
            for other, left in path:
                digest = H(other or "", digest) if left else H(digest, other or "")
            out.append((row[0], plain_leaf(row), subroot, root, H(*[o for o, _ in path if o]), digest, digest == root))
    return sorted(out, key=repr)


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("grp", "idx", "size", "digest", "id", "path", "_part", "leaf")])
    got = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 21])
def test_manifest_of_n_rows(spark, n):
    rows = [(k, "s", "en", k, "é" * k) for k in range(n)]
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_with_nulls_ties_and_long_texts(spark):
    rows = [(k * 37 % 101, None if k % 5 == 0 else f"s{k % 3}", (None, "", "de", "en", "日本")[min(k % 7, 4)], None if k % 4 == 0 else k, None if k % 6 == 0 else f"text {k}") for k in range(101)]
    rows += [(None, "s", "en", 3, "no id"), (None, None, None, None, None), (5, "s", "xx", 1, "x" * 300_000), (200, "s", "en", 4, ""), (200, "s", "en", 5, "tie")]
    rows += [(203, "s", "en", None, "twin")] * 2  # repeated rows keep a leaf each
    got, want = manifest(spark, rows), plain_manifest(rows)
    assert got == want
    assert {r[0] for r in got if not r[6]} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}


def test_manifest_of_nothing(spark):
    assert manifest(spark, []) == []


def test_numbering_is_exact_over_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("grp"), F.hash("id").alias("v"))
    got = merkle.numbered(rows, ["v"]).collect()
    for grp in "ab":
        mine = sorted((r for r in got if r.grp == grp), key=lambda r: r.v)
        assert [r.idx for r in mine] == list(range(len(mine))) and {r.size for r in mine} == {len(mine)}


# -- whitening ---------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "x", "k", "w", "n", "v", "vector", "node", "fp", "base", "bucket", "size", "component", "root")])


def plain_whitening(rows, kept):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(r, sums)] for r in x]
    y = np.array(d, dtype=float) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return n, [sum(c * c for c in r) for r in d], y @ u[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(7)
    rows = [(k, 0, (rng.standard_normal(20) * np.linspace(3, 0.2, 20) + 5).astype(np.float32).tolist()) for k in range(400)]
    bad = [(900, 0, None), (901, 0, rows[0][2][:-1] + [None]), (902, 0, [float("nan")] * 20), (903, 0, [float("inf")] + [0.0] * 19), (904, 0, []), (905, 0, [1.0, 2.0]), (906, 0, [3e38] * 20)]
    kept = [*rows, (None, 0, rows[3][2]), rows[4]]  # a null id and a repeated row
    got = whitening.whiten(vectors(spark, kept + bad)).toPandas()
    n, deviation, whitened, explained = plain_whitening(rows, kept)
    assert len(got) == 8 * len(kept) and set(got["n"]) == {n}
    assert sorted(got["component"].unique()) == list(range(1, 9))
    by_id = {i: k for k, (i, _, _) in enumerate(kept)}
    for c, part in got.groupby("component"):
        at = [by_id[None if np.isnan(i) else int(i)] for i in part["vec_id"]]
        assert part["deviation"].tolist() == [deviation[k] for k in at]
        sign = np.sign(part["whitened"].to_numpy() @ whitened[at, c - 1])
        assert np.abs(sign * part["whitened"].to_numpy() - whitened[at, c - 1]).max() < 1e-9
        assert abs(part["explained"].iloc[0] / explained[c - 1] - 1) < 1e-10
    assert got["identity_error"].max() < 1e-10


def test_whitening_of_few_or_flat_vectors(spark):
    out = lambda rows: sorted(tuple(r) for r in whitening.whiten(vectors(spark, rows)).collect())
    assert out([]) == [] and out([(1, 0, None)]) == []
    assert out([(1, 0, [1.0, 2.0])]) == [(1, k, 1, 0, None, 0.0, None) for k in (1, 2)]
    assert out([(k, 0, [float(k)]) for k in (1, 2)]) == [(1, 1, 2, 1024**2, pytest.approx(out([(k, 0, [float(k)]) for k in (1, 2)])[0][4]), 1.0, pytest.approx(0, abs=1e-12)), (2, 1, 2, 1024**2, pytest.approx(out([(k, 0, [float(k)]) for k in (1, 2)])[1][4]), 1.0, pytest.approx(0, abs=1e-12))]
    flat = out([(k, 0, [float(k), 7.0]) for k in range(4)])
    assert [r[4] is None for r in flat] == [False, True] * 4


def test_deviation_beyond_64_bits(spark):
    big = float(1 << 42)  # the whole numbers fit, the squares do not
    rows = [(1, 0, [big, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [0.0, 0.5])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows, "double")).collect()}
    assert got == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("case", ["wide", "low rank", "equal values", "close values", "beyond the subspace"])
def test_eigenpairs(case):
    rng = np.random.default_rng(3)
    size = 200 if case == "beyond the subspace" else 64
    spread = {"low rank": [9.0, 4.0, 1.0] + [0.0] * (size - 3), "equal values": [5.0] * 10 + [1.0] * (size - 10), "close values": (1 + 1e-9 * np.arange(size)[::-1]).tolist()}
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = turn @ np.diag(spread.get(case, rng.exponential(size=size))) @ turn.T
    matrix = (matrix + matrix.T) / 2
    values, axes = whitening.leading_pairs(lambda b: matrix @ b, size, 8)
    top = np.linalg.eigvalsh(matrix)[::-1][:8]
    assert np.abs(values - top).max() <= 1e-12 * top[0]
    assert np.abs(matrix @ axes - axes * values).max() <= 1e-12 * top[0]
    assert np.abs(axes.T @ axes - np.eye(8)).max() < 1e-12


# -- near-duplicate vectors --------------------------------------------------------------


def plain_classes(rows):
    """(id, n_links, component, kept) by comparing all pairs."""
    good = [k for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(rows[k][2], dtype=np.float32).astype(float) for k in good}
    linked = {k: [] for k in good}
    for a in good:
        for b in good:
            if a != b and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.93:
                linked[a].append(b)
    root = {rows[k][0]: rows[k][0] for k in good}
    for _ in rows:
        for a in good:
            for b in linked[a]:
                root[rows[a][0]] = min(root[rows[a][0]], root[rows[b][0]])
    return sorted(((i, len(linked.get(k, [])), root.get(i, i), i is None or root.get(i, i) == i) for k, (i, _, _) in enumerate(rows)), key=repr)


def close_vectors(n, size, seed):
    """Groups of copies around centres, so that cosines lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    rows = []
    for k in range(n):
        c = centres[min(int(rng.exponential(3)), 11)]
        v = c + rng.standard_normal(size) * np.linalg.norm(c) / math.sqrt(size) * rng.choice([0.05, 0.15, 0.22, 0.35])
        rows.append((1000 - k, int(rng.integers(0, 2)), v.astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("size, block", [(64, 256), (64, 8), (20, 16), (2, 256)])
def test_near_vectors(spark, monkeypatch, size, block):
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    rows = close_vectors(150, size, size + block)
    got = sorted((tuple(r) for r in cross_polytope.near_vectors(vectors(spark, rows)).collect()), key=repr)
    want = plain_classes(rows)
    assert got == want and sum(r[1] for r in want) > 200


def test_near_vectors_edge_cases(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(k, 1, base) for k in (9, 4, 7)] + [(4, 1, base), (4, 1, [-1.0, 5.0, 0.0, 0.0]), (20, 1, [-1.0, 5.0, 0.0, 0.1])]
    rows += [(1, 2, base), (2, None, base), (3, 1, None), (5, 1, []), (6, 1, [0.0, -0.0, 0.0, 0.0]), (8, 1, [1.0, None, 1.0, 1.0]), (10, 1, [float("nan")] * 4), (11, 1, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(None, 1, base), (12, 1, [1.0, 2.0, -3.0]), (13, 1, [3e38, 6e38 / 2, -3e38, 1e38]), (14, 1, [3e-40, 3e-40, -3e-40, 1e-40]), (15, 3, [0.0, 1.0]), (16, 3, [-0.0, 1.0])]
    got = sorted((tuple(r) for r in cross_polytope.near_vectors(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_classes(rows)
    assert cross_polytope.near_vectors(vectors(spark, [])).collect() == []


def test_recall_at_the_threshold():
    """Pairs just at the threshold meet in some bucket; the share that does is the recall of the links."""
    rng = np.random.default_rng(5)
    for size, hashes in ((64, 3), (64, 4), (256, 3)):
        a = rng.standard_normal((3000, size))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((3000, size))
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.93 * a + math.sqrt(1 - 0.93**2) * b
        base = np.zeros(len(a), dtype=np.uint64)
        x, y = cross_polytope.buckets(a, base, hashes), cross_polytope.buckets(b, base, hashes)
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
        assert met.mean() >= 0.998


def test_hashes_grow_with_the_label():
    assert cross_polytope.hashes_for(1000, 64) == 3
    assert cross_polytope.hashes_for(10**9, 64) == 5
    assert cross_polytope.tables(3) == 8 and cross_polytope.tables(5) > 20
