"""Whitening, Merkle manifest and passage classifier against brute force: nulls, odd rows, ties, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest

from panelwright.llm import merkle, mil, whiten

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, pos int, tree string, x string, score double"
MORE = ("odd", 7, "odd", "odd", 9.0)


# --- whitening -------------------------------------------------------------------------------------------------------


def clouds(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)) @ (rng.standard_normal((dim, dim)) * np.linspace(0.02, 0.2, dim))


@pytest.mark.parametrize("n,dim", [(400, 40), (300, 5), (60, 64)])
def test_whitening_equals_eigenvectors(spark, n, dim):
    v = clouds(n, dim)
    bad = [(n, None), (n + 1, []), (n + 2, [float("nan")] * dim), (n + 3, [None] + [0.0] * (dim - 1)), (n + 4, [float("inf")] * dim), (n + 5, [1.0] * (dim + 1)), (n + 6, [1e300] * dim)]
    rows = [(i, x.tolist(), 0, 1) for i, x in enumerate(v)] + [(*b, 0, 1) for b in bad]
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int, n int").repartition(5)).toPandas()
    x = np.floor(1024 * v).astype(np.int64) + 100000
    c = (n * x - x.sum(0)) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    k = min(8, dim)
    assert len(got) == n * k and set(got.n) == {n}
    z = (c @ q[:, ::-1][:, :k]) / np.sqrt(e[::-1][:k])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(mine - z * np.sign((mine * z).sum(0))).max() < 1e-8
    assert np.abs(got.groupby("component").explained.first().to_numpy() - e[::-1][:k] / e.sum()).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    assert got[got.component == 1].set_index("vec_id").deviation.sort_index().tolist() == ((n * x - x.sum(0)) ** 2).sum(1).tolist()


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whitened(spark.createDataFrame([(1, [0.5, 0.25])] * 3, schema)).count() == 0  # no variance
    got = whiten.whitened(spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 1.0]), (None, [0.5, 1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component, round(abs(r.whitened), 6)) for r in got) == [(0, 1, 0.0), (1, 1, 1.224745), (1, 1, 1.224745)]
    assert whiten._deviation(np.array([[3 * 10**9], [4]])) == [9 * 10**18, 16] and whiten._deviation(np.array([[4 * 10**9]])) == [None]


def test_components_of_a_close_spectrum():
    class Known:
        def __init__(self, v):
            self.v, self.passes = v, 0

        def __matmul__(self, q):
            self.passes += 1
            return self.v @ q

    rng = np.random.default_rng(1)
    base = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    for values in (np.linspace(1, 0.5, 200), 0.9 ** np.arange(200), np.append(np.ones(3), np.zeros(197)), np.append(1e9, np.linspace(1, 0.1, 199))):
        v = Known(base @ np.diag(values) @ base.T)
        e, q = whiten.components(v, 200, 8)
        assert len(e) == min(8, (values > 0).sum()) and np.abs(e - values[: len(e)]).max() < 1e-12 * values[0]
        assert np.linalg.norm(v.v @ q - q * e, axis=0).max() < 1e-11 * values[0]
        assert np.abs(q.T @ q - np.eye(len(e))).max() < 1e-12


# --- Merkle manifest -------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    fields = [str(r[0]) if r[0] is not None else None, r[3], r[2], str(r[4]) if r[4] is not None else None, text]
    return sha("".join("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def brute_tree(nodes):
    """Root, and for each node its steps as (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(steps)):
            lo = at[i] // 16 * 16
            run = nodes[lo : lo + 16]
            steps[i].append((run[: at[i] - lo], run[at[i] - lo + 1 :]))
            at[i] //= 16
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], steps


def brute_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    sub = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub[s] = brute_tree([leaf(r, r[1]) for r in trees[s]])
    root, upper = brute_tree([sub[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for r, own in zip(trees[s], sub[s][1], strict=True):
            low = None if r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
            node = leaf(r, low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r, r[1])
            for left, right in own + above:
                node = sha("".join([*left, node, *right]))
            proof = sha("".join("".join(left + right) for left, right in own + above))
            out.append((r[0], leaf(r, r[1]), sub[s][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def merkle_rows(n, sources=("a", "b", None)):
    rows = [(i, f"Text {i} ÄB *|" if i % 7 else None, "en" if i % 3 else None, sources[0] if i % 2 else sources[i % len(sources)], i if i % 5 else None, *MORE) for i in range(n)]
    rows += [(3, "other", None, "a", 1, *MORE), (3, "other", None, "a", 1, *MORE), (None, "UPPER", "x", "a", 2, *MORE), (n, "", "", "", 0, *MORE), (n + 1, "Long " * 20000, "é", "ünï", -1, *MORE)]
    return rows


@pytest.mark.parametrize("n,sources", [(700, ("a", "b", None)), (40, tuple(f"s{k}" for k in range(40)))])
def test_manifest_equals_brute_force(spark, n, sources):
    rows = merkle_rows(n, sources)
    got = sorted((tuple(r) for r in merkle.merkle_manifest(spark.createDataFrame(rows, DOCS).repartition(6)).collect()), key=repr)
    assert got == brute_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_little(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0
    for rows in ([(1, "one", None, None, 3, *MORE)], [(k, "t", None, "s", 1, *MORE) for k in range(17)]):
        assert sorted((tuple(r) for r in merkle.merkle_manifest(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == brute_manifest(rows)


# --- passage classifier ----------------------------------------------------------------------------------------------


def test_passages_cover_a_text():
    for text in (b"", b"x", b"word " * 1000, b"x" * 5000, "é".encode() * 3000, b"a" * 700 + b" " + b"b" * 700):
        parts = mil.passages(text)
        assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(hi - lo <= 2 * mil.PASSAGE for lo, hi in parts)


def test_features_depend_on_the_passage_alone():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.integers(0, 256, rng.integers(0, 600), dtype=np.uint8)) for _ in range(30)] + [b"", b" ", b"a a a a"]
    together = mil.features(parts)
    assert all((mil.features([p])[0] == together[i]).all() for i, p in enumerate(parts))
    assert together.shape == (33, mil.WIDTH) and together[-1, -3] == round(255 * 0.75)


def test_gradients():
    rng = np.random.default_rng(7)
    m = mil.start(0.3)
    m.weights = {k: np.asarray(v + 0.3 * rng.standard_normal(np.shape(v)), float) for k, v in m.weights.items()}
    x, first, y = rng.standard_normal((11, mil.WIDTH)) / 20, np.array([0, 3, 4]), np.array([1.0, 0.0, 0.5])
    _, grad = mil.loss_and_gradients(m, x, first, y)
    for k, w in list(m.weights.items()):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            found = []
            for step in (1e-5, -1e-5):
                moved = w.copy()
                moved[at] += step
                m.weights[k] = moved
                found.append(mil.loss_and_gradients(m, x, first, y)[0])
            m.weights[k] = w
            assert abs((found[0] - found[1]) / 2e-5 - grad[k][at]) < 1e-6, k


LABELED = "doc_id long, text string, lang string, source string, extra int, y double, bag binary, score int"


def quality_rows(n):
    rng = np.random.default_rng(2)
    words = ["the", "of", "river", "stone", "makes", "light"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.integers(30, 400)))
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = good()
        if bad:  # junk in the middle of one passage
            text = text + " " + "#&% !! " * 60 + " " + good()
        rows.append((i, text, "en", "s", 1, 0.0, b"", 1))
        if i % 4:
            labels.append((i, 0 if bad else 1, 0, 5))
    return rows, labels


def test_classifier_learns_from_documents(spark):
    rows, labels = quality_rows(400)
    labels += [(1, None, 0, 5), (None, 1, 0, 5), (2, 1, 0, 5), (9999, 0, 0, 5)]
    hard = [(1000, None), (1001, ""), (1002, "x" * 3_000_000), (None, "a null id"), (5, "a repeated id"), (1003, "日本語" * 4000)]
    docs = spark.createDataFrame(rows + [(*h, None, None, 0, 0.0, b"", 0) for h in hard], LABELED).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    got = mil.quality_scores(docs, known).collect()
    assert len(got) == len(rows) + len(hard)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id not in (5,)}
    held = [r for i, r in by_id.items() if i < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in by_id.values()) and len(held) > 80
    assert np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and 0 <= r.top_passage < r.n_passages for r in got)
    # attention finds the junk
    text = {r[0]: r[1].encode() for r in rows}
    junk = [r for r in by_id.values() if r.doc_id < 400 and r.doc_id % 3 == 0]
    assert np.mean([b"#&%" in text[r.doc_id][r.top_start : dict(mil.passages(text[r.doc_id]))[r.top_start]] for r in junk]) > 0.7
    # scores by brute force, one document at a time
    m = mil.learned(docs, known)
    for i in (3, 4, 1000, 1001, 1003):
        t = text.get(i, {1003: ("日本語" * 4000).encode()}.get(i, b""))
        h = m.encode(mil.features([t[lo:hi] for lo, hi in mil.passages(t)]))
        e = np.exp(m.attention(h) - m.attention(h).max())
        assert abs(m.score((e / e.sum()) @ h) - by_id[i].score) < 1e-9
    # neither labels of held-out rows nor lang, source or id change a score
    other = mil.quality_scores(docs.withColumn("lang", docs.source), known.filter("crc32(cast(doc_id AS string)) % 3 <> 1")).collect()
    assert sorted((r.doc_id or -1, r.score) for r in other) == sorted((r.doc_id or -1, r.score) for r in got)


def test_classifier_of_little(spark):
    docs, labels = spark.createDataFrame([], LABELED), spark.createDataFrame([], "doc_id long, quality int")
    assert mil.quality_scores(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "text", None, None, 0, 0.0, b"", 0)], LABELED)
    assert mil.quality_scores(one, labels).first().score == 0.5
