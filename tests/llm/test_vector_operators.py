"""Centroid clustering, fill-in-middle and embedding near-dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from ebbtide.llm import centroid_clustering, embedding_dedup, fill_in_middle
from ebbtide.llm.centroid_clustering import candidates, centroid_clusters, hilbert_keys, nearest
from ebbtide.llm.embedding_dedup import encoded, estimated_pairs, least_estimates, near_vectors, rotation, units
from ebbtide.llm.fill_in_middle import class_matrix, restored

VECTORS = "vec_id long, embedding array<double>, cluster string, number int, v string, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1, "y", 2) for i, v in rows], VECTORS)


# centroid clustering


def clustered(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in first]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, n) in zip(kept, assigned()):
            groups.setdefault(n, []).append(v)
        for n, group in groups.items():
            centroids[n] = [sum(column) // len(group) for column in zip(*group)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assigned())), key=str), centroids


def mixed_vectors(seed=5, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(64) / 8).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # a hot vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # repeated ids, unlike vectors, no id
    bad = [2000, None], [2001, []], [2002, [None, *rows[0][1][1:]]], [2003, [float("nan"), *rows[0][1][1:]]], [2004, [float("inf")] * 64], [2005, [0.5] * 63]
    return rows + [tuple(b) for b in bad] + [(2006, [0.0] * 64), (2007, [-0.0] * 64)]


def test_centroid_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroid_clustering, "BLOCK", 16)
    rows = mixed_vectors()
    found, centroids = centroid_clusters(vectors(spark, rows))
    expected, centres = clustered(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected and centroids.tolist() == centres


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    rows = [(i, [i / 10] * 64) for i in range(n)]
    found, centroids = centroid_clusters(vectors(spark, rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == clustered(rows)[0] and len(centroids) == n


def test_empty_clusters_stay_and_large_components_raise(spark):
    rows = [(i, [1.0] * 64) for i in range(40)]  # ties: all go to centroid 0, the others stay
    found, centroids = centroid_clusters(vectors(spark, rows))
    assert {r.cluster for r in found.collect()} == {0} and len(centroids) == 16
    with pytest.raises(ValueError, match="beyond"):
        centroid_clusters(vectors(spark, [(1, [1e9] * 64)]))
    large = [(i, [float((i * j) % 7 * 100_000) for j in range(64)]) for i in range(30)]  # products beyond exact doubles
    found, _ = centroid_clusters(vectors(spark, large))
    assert sorted((tuple(r) for r in found.collect()), key=str) == clustered(large)[0]


def test_box_candidates_hold_the_nearest():
    rng = np.random.default_rng(1)
    left_out = 0
    for _ in range(200):
        dim = int(rng.integers(1, 6))
        centroids = rng.integers(-20, 20, (8, dim))
        values = rng.integers(-20, 20, dim) + rng.integers(0, 6, (30, dim))
        distance = ((values[:, None] - centroids) ** 2).sum(2)
        some = candidates(values.min(0), values.max(0), centroids)
        left_out += 8 - len(some)
        assert set(distance.argmin(1)) <= set(some.tolist())
        cluster, least = nearest(values, values.min(0), values.max(0), centroids)
        assert (cluster == distance.argmin(1)).all() and (least == distance.min(1)).all()
    assert left_out > 400


@pytest.mark.parametrize("dim,bits", [(2, 3), (3, 2), (2, 1)])
def test_hilbert_neighbours(dim, bits):
    """Along the curve each cell is visited once and is next to the one before."""
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dim), -1).reshape(-1, dim)
    keys = [k.tobytes() for k in hilbert_keys(cells, bits)]
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# fill-in-middle


TEXTS = ["", "a", "ab cd", "  two  blanks\n", "été naïve ﬁ ß 中文 a", "x<P>y", "<S>", "a <M", "M><P", "😀a😀bc", "a\x00b", "1234", "Mixed Case words, and. marks!", "z" * 5000, "q w" * 9000]


def in_middle(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or i is None or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(300)] + [(5, None), (5, "a b"), (5, "a b"), (None, "some text"), (-3, "minus three")]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, form string, output string, n int")
    found = fill_in_middle.fill_in_middle(frame)
    told = found.withColumn("again", restored(found.output, found.form)).collect()
    assert sorted((tuple(r)[:6] for r in told), key=str) == sorted((in_middle(*r) for r in rows), key=str)
    assert sorted((r.doc_id, r.again) for r in told if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert {r.form for r in told} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(frame.limit(0)).count() == 0


def test_class_matrix_ranks():
    text = "".join(TEXTS) * 3
    matrix = class_matrix(text)
    classes = [3 if c.isascii() and c.isalpha() and i and text[i - 1].isascii() and text[i - 1].isalpha() else 2 if c.isascii() and c.isalpha() else 0 if c in " \t\n\v\f\r" else 1 for i, c in enumerate(text)]
    counts = [0] * 4
    for i in [*range(500), *range(500, len(text), 997), len(text)]:
        counts = [classes[:i].count(k) for k in range(4)]
        assert [matrix.rank(k, i) for k in range(4)] == counts and matrix.begun(i) == i - counts[3]
    starts = [i for i, k in enumerate(classes) if k != 3] + [len(text)]
    assert [matrix.start(u) for u in range(0, len(starts), 501)] == starts[::501] and matrix.start(len(starts) - 1) == len(text)


# embedding near-dedup


def linked(rows, threshold=0.9):
    """(vec_id, n_links, component, kept) of rows, sorted."""
    ok = [r for r, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {r: set() for r in range(len(rows))}
    for r in ok:
        for s in ok:
            if r < s and len(rows[r][1]) == len(rows[s][1]):
                x, y = np.array(rows[r][1]), np.array(rows[s][1])
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    near[r].add(s)
                    near[s].add(r)
    component = {}
    for r in near:
        stack, seen = [r], {r}
        while r not in component and stack:
            new = near[stack.pop()] - seen
            seen |= new
            stack += new
        if r not in component:
            least = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
            component.update(dict.fromkeys(seen, least))
    return sorted(((rows[r][0], len(near[r]), component[r], rows[r][0] == component[r]) for r in near), key=str)


def near_copies(seed=3, dim=64, groups=12, loose=250):
    rng = np.random.default_rng(seed)

    def moved(v, cosine):
        z = rng.standard_normal(len(v))
        z -= z @ v * v
        return cosine * v + np.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)

    base = rng.standard_normal((groups + loose, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [v for v in base]
    for g in range(groups):
        rows += [moved(base[g], c) * rng.uniform(0.1, 9) for c in rng.uniform(0.86, 0.999, 12)]
    for g in range(groups, groups + 100):  # pairs about the threshold
        rows.append(moved(base[g], 0.9 + 0.02 * rng.random()))
    rows += [rows[0]] * 40 + [rows[0] * 2] * 3  # copies, and a multiple
    order = rng.permutation(len(rows))
    return [(int(i), rows[k].tolist()) for i, k in enumerate(order)]


EDGES = [(5000, None), (5001, []), (5002, [0.0] * 64), (5003, [float("nan")] * 64), (5004, [None] * 64), (None, [1.0] * 64), (5005, [1.0] * 64), (5006, [1.0] * 63),
         (5007, [2.0] * 63), (5008, [3.0]), (5009, [-3.0]), (5010, [7.0]), (5011, [1e-200] * 64), (5012, [1e200] * 64), (5013, [-0.0] * 63 + [1.0]), (5014, [0.0] * 63 + [1.0])]


@pytest.mark.parametrize("homes,visitors,fewest", [(2048, 32_768, 16), (32, 64, 48)])
def test_near_vectors(spark, monkeypatch, homes, visitors, fewest):
    for name, value in (("HOMES", homes), ("VISITORS", visitors), ("FEWEST_CELLS", fewest)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rows = near_copies() + [e for e in EDGES if e[0] not in (5011, 5012)]
    found = near_vectors(vectors(spark, rows)).collect()
    expected = linked(rows)
    told = {r.vec_id: r for r in found if r.vec_id is not None}
    assert len(found) == len(rows) and all(told[i].n_links <= n for i, n, *_ in expected if i is not None)
    caught, all_links = sum(r.n_links for r in found), sum(n for _, n, *_ in expected)
    assert caught >= 0.99 * all_links
    assert sum((r.vec_id, r.n_links, r.component_id) == e[:3] for r, e in zip(sorted(found, key=lambda r: str(r.vec_id)), sorted(expected, key=lambda e: str(e[0])))) >= 0.98 * len(rows)
    assert [tuple(r) for r in found if r.vec_id is None] == [(None, 0, None, True)]


def test_extreme_vectors_and_repeated_ids(spark):
    found = {r.vec_id: tuple(r)[1:] for r in near_vectors(vectors(spark, EDGES)).collect()}
    assert found[5005] == (2, 5005, True) and found[5011] == (2, 5005, False) and found[5012] == (2, 5005, False)
    assert found[5006] == (1, 5006, True) and found[5008] == (1, 5008, True) and found[5009] == (0, 5009, True) and found[5010] == (1, 5008, False)
    assert found[5013] == (1, 5013, True) and found[5002] == (0, 5002, True)
    # rows of one id with unlike vectors are not joined by it; equal rows link
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one), (1, one), (2, other), (1, other), (9, one)]
    assert sorted(tuple(r) for r in near_vectors(vectors(spark, rows)).collect()) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (9, 2, 1, False)]
    assert near_vectors(vectors(spark, [])).count() == 0


def test_recall_between_cells(spark):
    """4,000 loose vectors, each with one partner at a cosine of 0.9 to 0.92, in 64 cells."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    z = rng.standard_normal(base.shape)
    z -= (z * base).sum(1)[:, None] * base
    z /= np.linalg.norm(z, axis=1)[:, None]
    cosine = rng.uniform(0.9, 0.92, (4000, 1))
    partner = cosine * base + np.sqrt(1 - cosine**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, partner]))]
    truth = ((base @ partner.T) >= 0.9).sum()
    import ebbtide.llm.embedding_dedup as module

    before, module.FEWEST_CELLS = module.FEWEST_CELLS, 64
    try:
        found = near_vectors(vectors(spark, rows)).agg({"n_links": "sum"}).first()[0]
    finally:
        module.FEWEST_CELLS = before
    assert found >= 0.98 * 2 * truth


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    x = units(rng.standard_normal((400, 64)))
    y = units(0.92 * x + np.sqrt(1 - 0.92**2) * units(rng.standard_normal(x.shape)))
    cosine = (x * y).sum(1)
    codes, factors = encoded(y)
    assert codes.shape == (400, 8) and np.allclose(rotation(64) @ rotation(64).T, np.eye(64))
    estimate = ((x @ rotation(64)) * embedding_dedup.signs(codes)).sum(1) / factors
    assert abs((estimate - cosine).mean()) < 0.01 and (estimate >= least_estimates(factors, 64, 0.9))[cosine >= 0.9].mean() > 0.995
    given_up = 400 * 400 - sum(len(i) for i, _ in estimated_pairs(x, codes, factors, 0.9))
    assert given_up > 0.99 * (400 * 400 - 400)
