"""Whitening, license scans and the Merkle manifest against plain loops, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import licenses, merkle, merkle_sql, whitening
from tests.llm.conftest import ODD

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- Whitening ------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [1, 2, 7, 48])
def test_components_are_eigenvectors(dims):
    rng = np.random.default_rng(dims)
    a = rng.standard_normal((2 * dims + 1, dims))
    cov = a.T @ a
    values, vectors = whitening.leading_components(cov, dims)
    assert np.allclose(values, np.linalg.eigvalsh(cov)[::-1], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(dims)).max() < 1e-13
    assert np.abs(cov @ vectors - vectors * values).max() < 1e-13 * values[0]


def test_components_of_equal_zero_and_steep_eigenvalues():
    values, vectors = whitening.leading_components(np.diag([1.0, 3, 3, 1, 3]), 4)
    assert np.allclose(values, [3, 3, 3, 1]) and np.allclose(vectors.T @ vectors, np.eye(4))
    values, _ = whitening.leading_components(np.zeros((3, 3)), 2)
    assert values.tolist() == [0, 0]
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((20, 20)))
    steep = q @ np.diag(10.0 ** -np.arange(20)) @ q.T
    values, vectors = whitening.leading_components((steep + steep.T) / 2, 4)
    assert np.allclose(values, [1, 0.1, 0.01, 0.001])
    assert np.allclose(np.abs((vectors * q[:, :4]).sum(axis=0)), 1)


def test_polar_factor_is_the_sign():
    a = np.diag([5.0, -1e-9, 2, -3])
    assert np.allclose(whitening.polar_factor(a), np.diag([1, -1, 1, -1]), atol=1e-6)


def test_packing_keeps_every_width():
    x = np.array([[1, -128], [127, 128], [-(2**31), 5], [2**40, -(2**63)]], np.int64)
    import pyarrow as pa

    rows = whitening.packed(x)
    assert [len(r) for r in rows] == [3, 5, 9, 17]
    assert (whitening.unpacked(pa.array(rows, pa.binary()), 2) == x).all()


def test_whitening_is_that_of_numpy(shipped):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 5).astype(np.float32)
    # A hot vector counts once in the fit.
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(data)] + [(1000 + i, [float(c) for c in data[0]], 0) for i in range(200)]
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 10, 0), (2002, [math.nan] + [0.0] * 11, 0), (2003, [math.inf] + [0.0] * 11, 0), (2004, [1.0], 0), (None, [0.0] * 12, 0)]
    out = whitening.whitening_rows(shipped.createDataFrame(rows, VECTORS)).collect()
    x = np.floor(np.vstack([data, np.zeros((1, 12))]).astype(float) * 256).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    cov = (distinct - total / n).T @ (distinct - total / n) / n
    values, vectors = (a[..., ::-1] for a in np.linalg.eigh(cov))
    assert len(out) == 501 * 4 and {r.n for r in out} == {n}
    got = {(r.vec_id, r.component): r for r in out}
    for c in range(4):
        want = (x - total / n) @ vectors[:, c] / np.sqrt(values[c])
        have = np.array([got[i if i < 300 else None, c + 1].whitened for i in range(301)])
        assert np.allclose(have * np.sign((have * want).sum()), want, atol=1e-9)
        assert got[5, c + 1].explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
    assert got[7, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[7], total))
    assert {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9
    assert got[1007, 2].whitened == got[0, 2].whitened


def test_whitening_of_odd_tables(shipped):
    empty = whitening.whitening_rows(shipped.createDataFrame([], VECTORS))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"
    assert whitening.whitening_rows(shipped.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).collect() == []
    same = whitening.whitening_rows(shipped.createDataFrame([(1, [0.5, 2.0], 0)] * 3, VECTORS)).collect()
    assert len(same) == 6 and all(r.n == 1 and r.whitened == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    flat = whitening.whitening_rows(shipped.createDataFrame([(i, [float(i), 1.0], 0) for i in range(4)], VECTORS).withColumn("component", F.lit("x"))).collect()
    assert [r.whitened for r in flat if r.component == 2] == [0.0] * 4
    huge = whitening.whitening_rows(shipped.createDataFrame([(1, [3e38, 1.0], 0), (2, [-3e38, 0.0], 0), (3, [0.0, 0.5], 0)], VECTORS)).collect()
    assert len(huge) == 6 and {r.deviation for r in huge if r.vec_id == 1} == {None}


# ---- License scans --------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_scan(text):
    """Labels by comparing every stretch of the text with every template, without hashes."""
    words, labels, best = plain_words(text), set(), 0.0
    for label, template in licenses.TEMPLATES:
        own = plain_words(template)
        k = licenses.K
        hits = [(p - t, p) for p in range(len(words) - k + 1) for t in range(len(own) - k + 1) if words[p : p + k] == own[t : t + k]]
        groups: list[list] = []
        for diagonal, p in sorted(hits):
            if groups and diagonal - groups[-1][-1][0] <= licenses.SLACK:
                groups[-1].append((diagonal, p))
            else:
                groups.append([(diagonal, p)])
        for g in groups:
            if len(g) < max(1, math.ceil(licenses.VOTES * (len(own) - k + 1))):
                continue
            span = words[min(p for _, p in g) : max(p for _, p in g) + k]
            row = [0] * (len(own) + 1)
            for w in span:
                for j in range(len(own), 0, -1):
                    if own[j - 1] == w:
                        row[j] = max(row[j], row[j - 1] + 1)
                for j in range(1, len(own) + 1):
                    row[j] = max(row[j], row[j - 1])
            if row[-1] / len(own) >= licenses.SHARE:
                labels.add(label)
                best = max(best, row[-1] / len(own))
    return labels, best


def plain_phrases(text):
    words, places, labels = plain_words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def _mit() -> str:
    return dict(reversed([(a, t) for a, t in licenses.TEMPLATES if len(t) > 200]))["mit"]


def test_license_labels_equal_a_plain_scan(documents):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon ".split()
    rng = np.random.default_rng(2)

    def prose(n):
        return " ".join(rng.choice(filler, n))

    mit = _mit()
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i not in (11, 30))
    inserted = " ".join(words[:20] + ["indeed", "so"] + words[20:])
    texts = [
        prose(300),
        prose(50) + " " + mit + " " + prose(40),
        prose(7) + " " + edited,
        inserted + prose(60),
        " ".join(words[:25]),
        "Released under the MIT-License.",
        "Licensed under CC BY-NC 4.0. " + prose(20) + " mit\nLICENSE mit license",
        (mit + " " + prose(30) + " ") * 3,
        "released under the mit license " * 500,
        "The GNU General  Public License; é mit licenseé apache license2",
        licenses.TEMPLATES[5][1] + licenses.TEMPLATES[10][1],
    ]
    texts += [t for _, t in licenses.TEMPLATES]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + i, texts[1], "s") for i in range(40)]
    got = {r.doc_id: r for r in licenses.license_labels(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n_words, n_base, first, last, base = plain_phrases(t)
        more, score = plain_scan(t)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n_base, first, last, ",".join(sorted(base))), t
        assert r.labels == ",".join(sorted(base | more)), t
        assert r.score == pytest.approx(max(score, 0.5 if n_base else 0.0)), t
    assert got[2].labels == got[3].labels == "mit" and got[4].labels == "" and got[100].labels == "mit"


def test_license_spans_name_words(documents):
    text = "one two three " + _mit() + " four five"
    (row,) = licenses.license_spans(documents([(1, text, None)])).collect()
    (span,) = row.spans
    assert (span.first, span.last, span.share) == (3, 2 + len(plain_words(_mit())), 1.0)


def test_license_scan_of_odd_rows(documents, shipped):
    odd = ODD + [(8, "mit license " * 30000, "b"), (9, "x" * 300000, "b")]
    docs = documents(odd).withColumn("labels", F.lit(1)).withColumn("key", F.lit(2)).withColumn("place", F.lit(3))
    got = licenses.license_labels(docs).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in odd)
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == by[2].n_words == 0 and by[1].labels == "" and by[1].first_word is None and by[1].score == 0
    assert (by[8].n_base, by[8].first_word, by[8].last_word, by[8].labels) == (30000, 0, 59998, "mit")
    assert licenses.license_labels(documents([])).collect() == []


# ---- Merkle manifest ------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """The last node and each node's (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, range(len(at))):
            run, slot = divmod(at[i], 16)
            own = nodes[16 * run : 16 * run + 16]
            path.append(("".join(own[:slot]), "".join(own[slot + 1 :])))
            at[i] = run
        nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    """Digests of (doc_id, source, lang, n_chars, text) rows, sorted."""

    def leaf(values):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups: dict = {}
    for r in rows:
        changed = leaf(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            changed = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
        groups.setdefault(r[1], []).append((r[0], leaf(r), changed))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([x[1] for x in groups[k]]))
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for k, (subroot, paths), top in zip(keys, trees, above):
        for (i, h, node), path in zip(groups[k], paths):
            path = path + top
            for left, right in path:
                node = digest(left + node + right)
            out.append((i, h, subroot, root, digest("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def test_manifest_equals_a_plain_tree(documents):
    rng = np.random.default_rng(5)
    sizes = {None: 3, "a": 1, "ab": 16, "b": 17, "é": 257, "z": 600} | {f"s{i}": 1 + i % 2 for i in range(40)}
    ids = iter(rng.permutation(5000).tolist())
    rows = [(next(ids), f"Text {i} of {s}" if i % 7 else None, s) for s, n in sizes.items() for i in range(n)]
    rows += [(9001, "Same Row", "z")] * 30 + [(None, "No Id", "z"), (9002, "One", "b"), (9002, "Two", "b")]
    docs = documents(rows)
    want = plain_manifest([tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()])
    got = sorted(map(tuple, merkle.manifest_rows(docs.repartition(7)).collect()), key=str)
    assert got == want
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    table = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", table)
    con.execute("CREATE TABLE d AS SELECT doc_id::BIGINT AS doc_id, text, lang::VARCHAR AS lang, source, n_chars::BIGINT AS n_chars FROM documents")
    sql = sorted(con.execute(merkle_sql.manifest_sql().replace("FROM documents", "FROM d")).fetchall(), key=str)
    assert sql == want


def test_manifest_of_odd_rows(documents):
    docs = documents(ODD).withColumn("g", F.lit(1)).withColumn("h", F.lit("x")).withColumn("n", F.lit(2)).withColumn("path", F.lit(3))
    got = sorted(map(tuple, merkle.manifest_rows(docs).collect()), key=str)
    assert got == plain_manifest([tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()])
    assert merkle.manifest_rows(documents([])).collect() == []
    (one,) = merkle.manifest_rows(documents([(1, "a", "s")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == digest("") and one.verified


def test_manifest_does_not_depend_on_partitions(documents):
    docs = documents([(i % 90, f"T{i % 50}", f"s{i % 3}") for i in range(400)])
    a = sorted(map(tuple, merkle.manifest_rows(docs.repartition(3)).collect()), key=str)
    assert a == sorted(map(tuple, merkle.manifest_rows(docs.repartition(11, "text")).collect()), key=str)
