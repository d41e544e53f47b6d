"""Manifest, exact deduplication and whitening: plain loops beside them, and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from tests.conftest import SF  # noqa: E402
from tests.llm.test_operators import AWKWARD, SCHEMA  # noqa: E402
from tidemark.llm import op11_manifest, op12_exact_dedup, op13_whitening  # noqa: E402


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)])


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _siblings(levels, i):
    for level in levels[:-1]:
        run = i // 3 * 3
        yield level[run:i], level[i + 1 : run + 3]
        i //= 3


def _proofs(docs):
    """All rows of the manifest by plain loops."""
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, _leaf(d, d["text"])))
    trees = {s: _tree([_leaf(d, d["text"]) for d in by[s]]) for s in sources}
    top = _tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, d in enumerate(by[s]):
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and d["text"] is not None
            acc, proof = _leaf(d, d["text"].replace("\n", "") if hit else d["text"]), ""
            for left, right in [*_siblings(trees[s], i), *_siblings(top, k)]:
                acc, proof = _h(*left, acc, *right), proof + "".join(left + right)
            out.append((d["doc_id"] or -1, _leaf(d, d["text"]), trees[s][-1][0], top[-1][0], _h(proof), acc, acc == top[-1][0]))
    return sorted(out)


def _manifest(df):
    return sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op11_manifest.with_proofs(df).collect())


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [81], [82, 1], [243, 81, 80, 9], [1, 250, 3], [730]])
def test_manifest_of_trees_of_all_sizes(spark, sizes):
    """Trees that end within a page, with it, and one node behind it."""
    rows = [(100 * k + i * 7, f"t{i}\n{k}", "en", None if k == 0 else f"s{k}é", i) for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert _manifest(df) == _proofs([r.asDict() for r in df.collect()])


def test_manifest_of_many_sources(spark):
    rows = [(i, f"a\nb{i}", None, f"{i % 90:02}", None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    assert _manifest(df) == _proofs([r.asDict() for r in df.collect()])


def test_manifest_of_awkward_rows(spark):
    df = spark.createDataFrame([*AWKWARD, *[AWKWARD[0]] * 200], SCHEMA).repartition(3)
    assert _manifest(df) == _proofs([r.asDict() for r in df.collect()])
    assert op11_manifest.with_proofs(df.limit(0)).collect() == []


def test_a_changed_row_is_found(spark):
    """Rows whose line ends went are exactly those that don't verify."""
    found = op11_manifest.op11_manifest(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in found if not r.verified} == {i for i, t in texts.items() if "\n" in (t or "") and zlib.crc32(str(i).encode()) % 2 == 0}
    assert any(r.verified for r in found) and not all(r.verified for r in found)


# ---- exact deduplication ----


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("most", [0, 20, 400, 10**6])
def test_trie_against_a_dict(seed, most):
    """Whatever is spilled in between, the terminals together give each string's smallest owner and rows."""
    rng, trie, want, got = random.Random(seed), op12_exact_dedup.Trie(), {}, {}

    def take(found):
        for text, node in found:
            owner, n, ties = got.get(text, (None, 0, 0))
            here = node.owner
            if owner is None or here < owner:
                owner, ties = here, 0
            got[text] = (owner, n + node.rows, ties + (node.ties if here == owner else 0))

    for _ in range(3000):
        key, owner = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))), (rng.randrange(50), rng.randrange(2))
        trie.insert(key, owner)
        rows = want.setdefault(key, [])
        rows.append(owner)
        if trie.held > most:
            take(trie.spill(most // 2))
            assert trie.held <= most // 2
    take(trie.all())
    assert got == {k: (min(v), len(v), v.count(min(v))) for k, v in want.items()}


def _plain_dedup(docs):
    groups = {}
    for d in docs:
        groups.setdefault(re.sub("[\x20\t-\r]+", " ", d["text"] or ""), []).append(d["doc_id"])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha = min(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        out += [(-1 if i is None else i, -1 if keep is None else keep, len(ids), sha) for i in ids]
    return sorted(out)


@pytest.mark.parametrize("most", [100, op12_exact_dedup.MOST_BYTES])
def test_dedup_of_awkward_rows(spark, most, monkeypatch):
    monkeypatch.setattr(op12_exact_dedup, "MOST_BYTES", most)
    more = [(8, "one\x0btwo  three\r\nfour five six", "en", "a", 1, "x", "x", "x"), (9, "another\xa0text", "en", "a", 1, "x", "x", "x"), (None, None, "a", "b", 2, "y", "y", "y")]
    df = spark.createDataFrame([*AWKWARD, *more, *[AWKWARD[0]] * 3000], SCHEMA).repartition(3)
    rows, found = [r.asDict() for r in df.collect()], op12_exact_dedup.with_owners(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in found) == _plain_dedup(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    stay = op12_exact_dedup.one_of_each(df)
    assert stay.columns == df.columns and sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(r.doc_id) for r in kept)
    assert op12_exact_dedup.with_owners(df.limit(0)).collect() == [] and op12_exact_dedup.one_of_each(df.limit(0)).collect() == []


def test_dedup_doesnt_hang_on_files(spark):
    """However rows are dealt, the same rows stay, also where ids repeat and other columns differ."""
    rows = [(i % 5, "same  text" if i % 2 else "same text", f"l{i}", "s", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stay = {tuple(op12_exact_dedup.one_of_each(df.repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(stay) == 1


# ---- whitening ----


def _plain_whitening(vectors):
    """(n, exact deviations, whitened, explained, eigenvalues) by numpy on all rows at once."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:8]
    return deviation, centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum(), e[order]


def test_whitening_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, z, explained, _ = _plain_whitening([r.embedding for r in rows])
    found = {(r.vec_id, r.component): r for r in op13_whitening.op13_whitening(spark, SF).collect()}
    assert len(found) == 8 * len(rows) and {r.n for r in found.values()} == {len(rows)} and len({r.identity_error for r in found.values()}) == 1
    got = np.array([[found[r.vec_id, k].whitened for k in range(1, 9)] for r in rows])
    assert [found[r.vec_id, 1].deviation for r in rows] == deviation
    assert np.allclose(np.abs(got), np.abs(z), atol=1e-8) and np.allclose(np.sign(got[0] * z[0]), np.sign(got[1] * z[1]))
    assert np.allclose([found[rows[0].vec_id, k].explained for k in range(1, 9)], explained, rtol=1e-10)
    assert np.abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-9 and found[rows[0].vec_id, 1].identity_error < 1e-9


def test_states_merge_to_the_whole():
    """In any grouping the merged state is that of all rows; an empty one changes nothing."""
    rng = np.random.default_rng(3)
    x = op13_whitening.whole(rng.normal(5, 3, (997, 6)))
    total = op13_whitening.of_rows(x)
    for cuts in ([1, 2, 3], [500], [10, 600, 601, 990]):
        states = [op13_whitening.of_rows(p) for p in np.split(x, cuts)]
        out = None
        for s in [*states[1:], None, states[0]]:
            out = op13_whitening.merged(out, s)
        assert out.n == total.n and out.sums == total.sums and np.allclose(out.scatter, total.scatter, rtol=1e-12)
    huge = op13_whitening.of_rows(np.array([[2**61, 1], [2**61, 3]]))
    assert huge.sums == [2**62, 4] and op13_whitening.deviations(np.array([[2**61, 1]]), huge)[0] == 4


def test_whitening_of_awkward_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int, n string, component string, whitened string"
    rest = (1, "x", "x", "x")
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    good = [(10, [0.5, -1.0]), (10, [0.5, -1.0]), (None, [0.25, 3.0]), (12, [-8.0, 0.001])]
    df = spark.createDataFrame([(i, v, *rest) for i, v in bad + good], kind).repartition(4)
    found = op13_whitening.whitened(df).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((str(i), k) for i, _ in good for k in (1, 2))
    deviation, z, _, _ = _plain_whitening([v for _, v in good])
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in found), sorted(np.abs(z).ravel())) and found[0].identity_error < 1e-9
    assert op13_whitening.whitened(df.limit(0)).collect() == [] and op13_whitening.whitened(df.filter("vec_id < 5")).filter("component > 2").collect() == []


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(i, [0.5, 0.25, 0.5]) for i in range(5)], "vec_id bigint, embedding array<double>")
    found = op13_whitening.whitened(df).collect()
    assert len(found) == 15 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in found} == {(0.0, 0.0, 0, 0.0)}
    # two vectors in three dimensions: one component has all variance
    two = op13_whitening.whitened(df.limit(1).union(spark.createDataFrame([(9, [1.5, 0.0, 0.5])], df.schema))).collect()
    assert sorted(round(abs(r.whitened), 6) for r in two) == [0, 0, 0, 0, 1, 1] and max(r.identity_error for r in two) < 1e-9
