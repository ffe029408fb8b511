"""Merkle manifest, source divergence and embedding near-duplicates against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import TEXTS, bag, empty, frame
from palaver.llm import covertree, divergence, merkle
from palaver.llm.queries import QUERIES, table

# --- Merkle manifest ------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    number = None if row.n_chars is None else row.n_chars + more
    values = (row.doc_id, row.source, row.lang, number, row.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def path_of(levels, i, arity):
    out = []
    for level in levels[:-1]:
        start = i // arity * arity
        out.append((level[start:i], level[i + 1 : start + arity]))
        i //= arity
    return out


def manifest_by_hand(rows, arity):
    """(doc_id, leaf, subroot, root, proof, root folded from the changed leaf) of every row."""
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {
        x: sorted((r for r in rows if r.lang == x), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r))) for x in langs
    }
    trees = {x: levels_of([leaf_of(r) for r in ordered[x]], arity) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs], arity)
    for number, lang in enumerate(langs):
        for i, r in enumerate(ordered[lang]):
            path = path_of(trees[lang], i, arity) + path_of(top, number, arity)
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf_of(r, int(changed))
            for before, after in path:
                folded = sha("".join(before) + folded + "".join(after))
            told = sha("".join("".join(a + b) for a, b in path))
            yield r.doc_id, leaf_of(r), trees[lang][-1][0], top[-1][0], told, folded


def manifest_rows(docs, arity=2):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(
        F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")
    ))
    rows = merkle.manifest(docs, arity=arity, changed=changed)
    return bag(rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256), merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    ))


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_of_odd_rows(spark, arity):
    docs = frame(spark)
    assert manifest_rows(docs, arity) == sorted(manifest_by_hand(docs.collect(), arity), key=repr)


def test_manifest_of_one_row_and_none(spark):
    one = frame(spark, TEXTS[:1])
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root and row.path == []
    assert merkle.manifest(empty(spark)).count() == 0


def test_manifest_query(spark, sf_dir):
    rows = QUERIES["op11_merkle_manifest"](spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").collect()
    assert sorted(tuple(r)[:6] for r in rows) == sorted(manifest_by_hand(docs, 2))
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    assert {r.doc_id for r in rows if not r.verified} == {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 == 0}


# --- source divergence ------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence_by_hand(rows, least, top):
    rows = [(r.lang or "", r.source or "", TERM.findall((r.text or "").translate(LOWER))) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        documents = Counter(t for x, _, terms in rows if x == lang for t in set(terms))
        kept = {t for t, n in documents.items() if n >= least}
        counts = {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, terms in rows:
            if x == lang:
                counts[s].update(t for t in terms if t in kept)

        def shares(count):
            return {t: 1 + 10**9 * (count[t] + 5) // (sum(count.values()) + 5 * len(kept)) for t in kept}

        whole, each = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        for s, p in each.items():
            pairs = [(other, sum(abs(p[t] - q[t]) for t in kept)) for other, q in each.items() if other != s]
            terms = [(t, p[t] - whole[t]) for t in kept if counts[s][t] and p[t] > whole[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                values.sort(key=lambda v: (-v[1], v[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(values[:most], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, tile", [(divergence.BLOCK, divergence.TILE_SUMS), (40, 2)])
def test_divergence_of_odd_rows(spark, block, tile):
    docs = frame(spark)
    got = bag(divergence.divergence(docs, least=2, top=3, block=block, tile=tile))
    assert got == divergence_by_hand(docs.collect(), 2, 3)


def test_divergence_of_few_words_and_none(spark):
    docs = frame(spark)
    got = divergence.divergence(docs, least=1000).collect()  # no language keeps a word
    assert {r.part for r in got} == {"pair"} and {r.value for r in got} == {0}
    assert sorted(tuple(r) for r in got) == sorted(divergence_by_hand(docs.collect(), 1000, 50))
    assert divergence.divergence(empty(spark)).count() == 0


def test_divergence_cuts_long_texts_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = b"ab cd efghijklmnop q r  stu vwx " * 3
    assert [w for piece in divergence._pieces(text) for w in piece] == text.split()
    assert divergence._pieces(b"a" * 50).__next__() == [b"a" * 50]


# --- embedding near-duplicates --------------------------------------------------------------------------


def linked_by_hand(rows, cosine=0.93):
    """{position: (key, links, component, kept)} of (key, label, vector) rows, by all pairs."""

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v) / np.abs(v).max() if good(v) and label is not None else None for _, label, v in rows]
    units = [None if u is None else u / np.sqrt(u @ u) for u in units]
    near = [set() for _ in rows]
    for i, u in enumerate(units):
        for j, v in enumerate(units):
            if i != j and u is not None and v is not None and rows[i][1] == rows[j][1] and len(u) == len(v) and u @ v >= cosine:
                near[i].add(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(near[i]), least, row[0] == least))
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, point string, n double"
    ).repartition(3)


def clustered(rng, n, dims, groups, spread):
    centres = rng.normal(size=(groups, dims))
    picks = centres[rng.integers(groups, size=n)]
    return picks + spread * rng.normal(size=(n, dims)) * rng.random((n, 1))


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), v.tolist()) for i, v in enumerate(clustered(rng, 400, 8, 12, 0.5))]
    same = rows[0][2]
    rows += [
        (1000, 0, None), (1001, 0, []), (1002, 0, [0.0] * 8), (1003, 0, [None, *same[1:]]), (1004, 0, [float("nan"), *same[1:]]),
        (1005, 0, [float("inf"), *same[1:]]), (1006, None, same), (1007, None, same), (None, 0, same), (None, 1, [-x for x in same]),
        (1008, 0, same[:4]), (1009, 0, [x * 1e200 for x in same]), (1010, 0, [x * 1e-200 for x in same]),
        *[(1011, 1, same)] * 3, *[(2000 + k, 2, same) for k in range(40)], *[(3000 + k, 2, [x + 1e-9 * k for x in same]) for k in range(40)],
    ]
    return rows


@pytest.mark.parametrize("cell", [covertree.CELL, 8])
def test_embeddings_of_odd_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(covertree, "PIVOTS", min(8, cell))
    rows = odd_vectors()
    assert bag(covertree.near_duplicates(vectors(spark, rows), cell=cell)) == linked_by_hand(rows)


def test_embeddings_of_none(spark):
    assert covertree.near_duplicates(vectors(spark, odd_vectors()).limit(0)).count() == 0


def test_embedding_query(spark, sf_dir):
    rows = [(r.vec_id, r.label, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert bag(QUERIES["op13_embedding_dedup"](spark, sf_dir)) == linked_by_hand(rows)


@pytest.mark.parametrize("spread", [0.02, 0.3, 2.0])
def test_cover_tree_levels_and_walk(spread):
    """Every node covers its points within its radius, centres lie apart, and a walk finds what all pairs give."""
    rng = np.random.default_rng(int(100 * spread))
    points = clustered(rng, 700, 16, 9, spread)
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    tree = covertree.CoverTree.build(points)
    inside = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for k in range(len(tree.lo)):
        away = np.sqrt(np.maximum(2 - 2 * inside[tree.lo[k] : tree.hi[k]] @ inside[tree.lo[k]], 0))
        assert away.max() <= tree.radius[k] + covertree.SLACK
        children = range(tree.first[k], tree.last[k])
        if children:
            assert [tree.lo[children[0]], tree.hi[children[-1]]] == [tree.lo[k], tree.hi[k]]
            assert max(tree.radius[c] for c in children) < tree.radius[k]
    weights = rng.integers(1, 5, len(points))
    found = covertree.traverse(tree, inside, weights, tree, inside, weights, 0.93, True)
    near = inside @ inside.T >= 0.93
    np.fill_diagonal(near, False)
    assert (found.total() == near @ weights).all()
    half = len(points) // 2
    one, two = covertree.CoverTree.build(points[:half]), covertree.CoverTree.build(points[half:])
    a, b = points[:half][one.order], points[half:][two.order]
    found = covertree.traverse(one, a, weights[:half], two, b, weights[half:], 0.93, False)
    near = a @ b.T >= 0.93
    assert (found.total() == np.concatenate([near @ weights[half:], near.T @ weights[:half]])).all()
    i, j = found.forest()
    assert len(i) == len(set(i.tolist())) and (i > j).all()
