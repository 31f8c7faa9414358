"""Near duplicates, repeated passages and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import ngram_join, suffix_dedup
from pricelake.llm.components import components
from pricelake.llm.ngram_join import Bands, bit_sketch, signatures, signed_parts


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def least_reachable(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    best = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return sorted([(i, len(s), best.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)], key=str)


def test_join_equals_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()]
    assert sorted(got, key=str) == least_reachable(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_join_of_edited_copies(spark, seed):
    """Copies at all distances around the bound, of short and long texts, some of them all in one group."""
    rnd = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice([4, 6, 9, 15, 30, 80, 200]))]
        for _ in range(12):
            own = list(words)
            for _ in range(rnd.randint(0, max(1, len(own) // 12))):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(5)}"
            rows.append((len(rows), " ".join(own)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == least_reachable(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(40):
        own = list(words)
        for _ in range(rnd.randint(0, 5)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(3)}"
        rows.append((i, " ".join(own)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == least_reachable(rows)


def test_signatures_meet():
    """Sets at the bound share a signature, whatever each of them leaves out; sketches never overstate a difference."""
    rng, bands = np.random.default_rng(4), Bands()
    for _ in range(200):
        n = int(rng.integers(5, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = len(a) - -(-8 * len(a) // 10)
        b = np.delete(a, rng.choice(len(a), gone, replace=False)) if gone else a
        drop = lambda found, spare: set(found.tolist()) - set(found[:spare].tolist())
        other = lambda found, spare: set(found.tolist()) - set(found[len(found) - spare :].tolist())
        x = set().union(*(drop(*s) for s in signatures(a, bands)))
        y = set().union(*(other(*s) for s in signatures(b, bands)))
        assert x & y
        sa, sb = bit_sketch(a), bit_sketch(b)
        while len(sa) > len(sb):
            sa = ngram_join._halved(sa)
        assert np.bitwise_count(sa ^ sb).sum() <= gone


def test_whole_parts_may_be_left_out():
    """Also where each of two sets at the bound leaves out as many whole parts as it may, those that it shares first; the
    subsets of a second level are there from some hundred n-grams on."""
    rng, bands, levels = np.random.default_rng(14), Bands(), set()
    for _ in range(150):
        n = int(rng.choice([6, 20, 90, 160, 300, 700]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone = len(a) - -(-8 * len(a) // 10)
        b = np.delete(a, rng.choice(len(a), gone, replace=False)) if gone else a
        levels.add(bands.parts(bands.of(len(a)))[1].shape[1])
        kept = []
        for x, y in ((a, b), (b, a)):
            others = set().union(*(set(found.tolist()) for found, _, _ in signed_parts(y, bands)))
            own = set()
            for found, part, spare in signed_parts(x, bands):
                shared = sorted(set(part.tolist()), key=lambda p: -sum(s in others for s in found[part == p].tolist()))
                own |= set(found[~np.isin(part, shared[:spare])].tolist())
            kept.append(own)
        assert kept[0] & kept[1]
    assert levels == {1, 3}


def test_low_bits_and_bucket_are_the_signature():
    sigs = (np.uint64(7) << np.uint64(40)) | np.random.default_rng(0).integers(0, 1 << 40, 50).astype(np.uint64)
    assert (ngram_join._whole(ngram_join._short(sigs), 7) == sigs).all() and len(ngram_join._short(sigs)) == 250


def test_rows_grow_with_the_sets(spark, monkeypatch):
    """Copies of one text that mostly don't link: no stage writes more than some rows for each of them."""
    made = {}
    old = ngram_join.materialise

    def counted(df, name, *more):
        out = old(df, name, *more)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    rnd = random.Random(3)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        own = list(words)
        for _ in range(rnd.randint(3, 9)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(50)}"
        rows.append((i, " ".join(own)))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == least_reachable(rows)
    assert all(made[name] <= 12 * len(rows) for name in ("ngram-near", "ngram-edges", "ngram-regions", "ngram-more"))


def test_one_id_with_several_texts(spark):
    text, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, text), (5, text), (5, other), (7, text + " more"), (None, text), (None, "alone and without any copy"), (3, text)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, text), (3, text), (5, other), (None, "alone and without any copy")], key=str)


def test_one_of_each_keeps_the_rest(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    expected = {i for i, n, least in least_reachable([(r["doc_id"], r["text"]) for r in docs.collect()]) if not n or i is None or least == i}
    assert ids == expected and {90, 91, 92, None} <= ids and 83 not in ids


def windows(rows, size):
    words = [((i if i is not None else ("t", t)), i, (t or "").encode().split()) for i, t in rows]
    owners = {}
    for own, _, w in words:
        for k in range(len(w) - size + 1):
            owners.setdefault(tuple(w[k : k + size]), set()).add(own)
    out = set()
    for own, i, w in words:
        for copy in (False, True):
            at = [k for k in range(len(w) - size + 1) if len(o := owners[tuple(w[k : k + size])]) > 1 and (not copy or min(o) != own)]
            spans = []
            for k in at:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + size
                else:
                    spans.append([k, k + size])
            out |= {(i, a, b, copy) for a, b in spans}
    return out


@pytest.mark.parametrize("size", [20, 50])
def test_repeats_equal_brute_force(docs, size, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_ENTRIES", 150)
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["copy"]) for r in suffix_dedup.repeats(docs, size).collect()}
    assert got == windows(rows, size)


def test_copies_are_cut(docs):
    out = {r["doc_id"]: r for r in suffix_dedup.without_copies(docs.withColumn("n_chars", F.length("text"))).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert out[80]["text"] == texts[80] and 82 not in out and 83 not in out and out[84]["text"] == texts[84]
    assert len(out[81]["text"].split()) == 45 and out[81]["n_chars"] == len(out[81]["text"])
    assert out[90]["text"] is None and out[91]["text"] == ""


@pytest.mark.parametrize("small", [2, 200_000])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr("pricelake.llm.components.SMALL_EDGES", small)
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if any(x in e and e[0] != e[1] for e in edges)}


def test_empty(none):
    assert ngram_join.join(none).count() == 0 and suffix_dedup.repeats(none).count() == 0
    assert ngram_join.one_of_each(none).count() == 0 and suffix_dedup.without_copies(none).count() == 0
