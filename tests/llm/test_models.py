"""Quality, language model, search and HTML: held-out accuracy and plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelake.llm import hmm, html_tree, mtree, quality_model, quality_rules
from pricelake.llm.statistics import repeated_words, surface


def plain_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    return len({j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)})


def test_surface():
    rnd = random.Random(1)
    for _ in range(200):
        words = [rnd.choice("ab") .encode() for _ in range(rnd.randint(0, 14))]
        assert repeated_words(words) == plain_repeats(words)
    s = surface("A é# b\nx\n\nA é# b\n x\r\n".encode())
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines) == (8, 10, 2, 1)
    assert surface(None) == surface(b"") and surface(b" \n\t").n_words == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose and two kinds of junk, in two strata; the second stratum has too few labels."""
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(1600):
        words = ["".join(rnd.choice("aeioubcdlmn") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 120))]
        bad = i % 8 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 16 else [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "few" if i % 20 == 1 else "many"))
        if i % 5:
            labels.append((i, 0 if bad else 1))
    rows += [(5000, None, "many"), (5001, "", None), (5002, "too short", "many"), (5003, "same words " * 60, "many")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (9999, 1), (3, None)], "doc_id long, quality int")


def test_rules(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (5000, 5001, 5002, 5003))
    many = [i for i in range(1600) if i % 20 != 1]
    assert [i for i in many if i % 8 == 0 and got[i]["kept"]] == []
    assert all(got[i]["kept"] for i in many if i % 8)
    assert all(got[i]["kept"] for i in range(1, 1600, 20) if i % 8)
    kept = quality_rules.keep(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]} and kept.columns == docs.columns


def test_binomial_bounds():
    for n, k, p in ((20, 3, 0.3), (400, 2, 0.01), (50, 50, 0.4)):
        plain = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(plain)
    assert quality_rules.certified(0, 1000, 0.01, 0.001) and not quality_rules.certified(0, 100, 0.01, 0.001) and not quality_rules.certified(0, 0, 0.5, 0.5)


def plain_choice(rows, lengths, risk, level):
    """``rows``: (passed, quality, proposes) of single documents; the rule set in force, document by document."""
    out = lambda passed, depths: any(p + d > n for p, d, n in zip(passed, depths, lengths, strict=True))
    depths, sequence = [0] * len(lengths), []
    while True:
        left = [(p, q) for p, q, proposes in rows if proposes and not out(p, depths)]
        best = (0.0, 0, None)
        for r, n in enumerate(lengths):
            for d in range(depths[r] + 1, n + 1):
                hit = [q for p, q in left if p[r] + d > n]
                value = (hit.count(0) / (hit.count(1) + 1), hit.count(0))
                if value > best[:2]:
                    best = (*value, (r, d))
        if best[2] is None:
            break
        depths = list(depths)
        depths[best[2][0]] = best[2][1]
        sequence.append(depths)
    holdout, tried = ([x for x in rows if bool(x[2]) is side] for side in (False, True))
    good, chosen, gain = sum(q for _, q, _ in holdout), None, 0.0
    for own in sequence:
        lost = sum(out(p, own) for p, q, _ in holdout if q)
        if not good or lost >= risk * good or sum(math.comb(good, i) * risk**i * (1 - risk) ** (good - i) for i in range(lost + 1)) > level:
            break
        share = lambda k, own=own: sum(out(p, own) for p, q, _ in tried if q == k) / max(1, sum(q == k for _, q, _ in tried))
        if share(0) - quality_rules.GOOD_WEIGHS * share(1) > gain:
            gain, chosen = share(0) - quality_rules.GOOD_WEIGHS * share(1), own
    return chosen


def test_rule_sets_equal_a_plain_version():
    rnd, lengths, found = random.Random(6), [3, 2, 4], set()
    for k in range(40):
        rows = []
        for _ in range(rnd.choice([5, 60, 300])):
            quality = int(rnd.random() < 0.7)
            rows.append(([0 if quality and rnd.random() < 0.97 else rnd.randint(0, n) for n in lengths], quality, rnd.random() < 0.4))
        grouped = Counter((tuple(p), q, side) for p, q, side in rows)
        keys = sorted({(p, side) for p, _, side in grouped})
        columns = [np.array([p for p, _ in keys]), *(np.array([grouped[p, q, side] for p, side in keys]) for q in (1, 0)), np.array([side for _, side in keys])]
        got = quality_rules.choose(*columns, np.array(lengths), 0.08, 0.05 / (1 + k % 3))
        assert (None if got is None else got.tolist()) == plain_choice(rows, lengths, 0.08, 0.05 / (1 + k % 3))
        found.add(got is None)
    assert found == {True, False}


def test_rules_on_odd_rows(spark):
    """Repeated rows, a very long text, clashing columns, no labels."""
    rows = [(1, "word " * 200_000, "en", 1, 2), (2, "a b c d e f " * 3, "en", 1, 2), (3, " ".join(f"w{i}" for i in range(80)), None, None, 2)]
    docs = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, __cutoffs0 int, __stratum int")
    labels = spark.createDataFrame([(3, 1), (None, 0), (1, 0)], "doc_id long, quality int")
    assert sorted((r["doc_id"], r["kept"]) for r in quality_rules.judge(docs, labels).collect()) == [(1, False), (2, False), (3, True), (3, True)]
    kept = quality_rules.keep(docs, labels.where("false"))
    assert [r["doc_id"] for r in kept.collect()] == [3, 3] and kept.columns == docs.columns
    assert sorted((r["doc_id"], r["predicted"] in (0, 1)) for r in quality_model.score(docs, labels).collect()) == [(1, True), (2, True), (3, True), (3, True)]


def test_classifier(labelled, spark):
    docs, labels = labelled
    got = quality_model.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    prose = [r for r in got if r["doc_id"] < 1600 and r["held_out"]]
    assert sum(r["predicted"] != (r["doc_id"] % 8 != 0) for r in prose) <= 0.01 * len(prose)
    one_class = quality_model.score(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert [r["score"] for r in one_class] == [1.0]
    assert [r["score"] for r in quality_model.score(docs, labels.where("false")).select("score").distinct().collect()] == [0.5]
    assert quality_model.keep(docs, labels).columns == docs.columns
    assert quality_model.score(docs.where("false"), labels).count() == 0 and quality_rules.judge(docs.where("false"), labels).count() == 0


def test_discriminant_densities():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (300, 3))
    moments = {q: (float(len(x)), x.sum(axis=0), x.T @ x) for q, x in ((0, x0), (1, x1))}
    model = quality_model.Discriminant.fit(moments, shrink=0.0, floor=0.0)
    covs = [np.cov(x.T, bias=True) for x in (x0, x1)]
    at = rng.normal(0, 2, (20, 3))
    logs = [-0.5 * (np.einsum("ij,jk,ik->i", at - x.mean(0), np.linalg.inv(c), at - x.mean(0)) + np.linalg.slogdet(c)[1]) for x, c in zip((x0, x1), covs, strict=True)]
    assert model.scores(at) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1] - math.log(300 / 400))), abs=1e-6)


def test_forward_equals_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    model = hmm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))))
    sequences = [np.array(s, dtype=np.uint16) for s in ([0], [1, 2, 3], [3, 3, 0, 1, 2], [2, 1])]
    for s, got in zip(sequences, model.log_likelihoods(sequences), strict=True):
        total = 0.0
        for path in np.ndindex(*(2,) * len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= model.step[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            total += p
        assert got == pytest.approx(math.log(total))


def test_expected_counts_equal_all_paths_and_raise_the_likelihood():
    rng = np.random.default_rng(2)
    norm = lambda a: a / a.sum(axis=-1, keepdims=True)
    model = hmm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    sequences = [np.array(s, dtype=np.uint16) for s in ([0, 1, 1], [2, 0], [1])]
    runs, lengths = hmm._pad(sequences)
    start, step, emit, loss = model.expected_counts(runs, lengths)
    s2, x2, e2, l2 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3)), 0.0
    for s in sequences:
        paths = {}
        for path in np.ndindex(*(2,) * len(s)):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= model.step[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            paths[path] = p
        whole = sum(paths.values())
        l2 += math.log(whole)
        for path, p in paths.items():
            s2[path[0]] += p / whole
            for t, k in enumerate(path):
                e2[k, s[t]] += p / whole
                if t:
                    x2[path[t - 1], k] += p / whole
    assert start == pytest.approx(s2) and step == pytest.approx(x2) and emit == pytest.approx(e2) and loss == pytest.approx(l2)
    better = hmm.Hmm(norm(start), norm(step), norm(emit))
    assert better.log_likelihoods(sequences).sum() >= loss - 1e-9


def test_language_model(docs, none, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT_WORDS", 60)
    monkeypatch.setattr(hmm, "CHUNK", 700)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in rows), key=str)
    got = hmm.score(docs, states=2, passes=2).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=str) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hmm.score(none).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    for name, value in (("PAGE", 8), ("FAN", 3), ("TREE_VECTORS", 50), ("BLOCK_QUERIES", 7)):
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(200)] + [(200 + i, [0.5] * 6) for i in range(40)]
    vectors += [(400, None), (401, [float("nan")] * 6), (402, [None] + [1.0] * 5), (403, []), (404, [9.0]), (405, [float("inf")] * 6), (None, [1.0] * 6), (60, [1.0] * 6)]
    got = {}
    for r in mtree.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(64 * x) for x in v] + [0] * (6 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in whole:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v, key=lambda x: np.array(x, dtype=np.int64).tobytes())
    for i, q in asked.items():
        best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i))[:7]
        assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got.keys() == asked.keys()


def test_pages_are_skipped_where_vectors_cluster():
    """Of narrow clusters few are multiplied out, of directions without structure nearly all; the result is exact."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 60, (40, 8))
    for clustered in (True, False):
        whole = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 2, (4000, 8)) if clustered else rng.normal(0, 60, (4000, 8))).astype(np.int64)
        tree = mtree.MTree(np.arange(4000), whole)
        for q in range(0, 4000, 400):
            best = sorted(((-s, i) for i, s in enumerate((whole @ whole[q]).tolist()) if i != q))[:5]
            assert tree.top(whole[q], q, 5) == [(-s, i) for s, i in best]
        share = tree.computed / (10 * 4000)
        assert share < 0.25 if clustered else share <= 1


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=x>menu</a></ul></nav><div class="cookie-notice">cookies</div>
<div class=body><h1>Title {n} &amp; &eacute;</h1><p>First   para {n}<br>goes on<p>Second <b>bold {n}</b>.<ul><li>one {n}<li>two {n}</ul>
<div class="teaser">Read also our paper</div><form><input>x</form></div><div style="display: none">hidden</div>
<aside>side</aside><section id="comments"><p>nice</p></section><footer>foot</footer></body></html>"""


def test_extraction(spark):
    rows = [(n, f"http://a.b/{n}", PAGE.format(n=n)) for n in range(12)] + [(100, "http://one.x/1", PAGE.format(n=1)), (101, None, PAGE.format(n=2)), (102, "http://a.b/z", None), (103, "http://a.b/y", ""), (104, "bad", "<p>a<article><header><h1>T</h1></header><p>in</article>out"), (105, "http://q/", "just & text &lt;b&gt; <!-- c --> <b")]
    got = {r["page_id"]: r for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = lambda n: f"Title {n} & é\nFirst para {n} goes on\nSecond bold {n}.\none {n}\ntwo {n}"
    assert got[3]["text"] == body(3)  # the teaser is the same on all pages of the host
    assert got[100]["text"] == body(1) + "\nRead also our paper" and got[101]["text"] == body(2) + "\nRead also our paper"
    assert got[102]["text"] == got[103]["text"] == "" and got[104]["text"] == "T\nin" and got[105]["text"] == "just & text <b> <b"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)
    assert html_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_are_no_evidence(spark):
    page = lambda words: f"<article><h1>{words} title</h1><p>{words} first<p>{words} next<ul><li>{words} point</ul></article>"
    text = lambda words: "\n".join(f"{words} {x}" for x in ("title", "first", "next", "point"))
    words = {n: "copied" if n < 30 else f"own {n}" for n in range(34)} | {n: f"group {n % 2}" for n in range(100, 140)}
    got = extracted(spark, [(n, f"http://{'copies' if n < 100 else 'groups'}.x/{n}", page(w)) for n, w in words.items()])
    assert got == {n: text(w) for n, w in words.items()}
    same = "the same long words in the middle of every page of this host"
    got = extracted(spark, [(n, f"http://near.x/{n}", f"<p>{same}</p><div>{n}</div><h6>small print</h6>") for n in range(9)])
    assert got == {n: f"{same}\n{n}" for n in range(9)}


def test_unclosed_elements_keep_the_rest():
    text = lambda html: "|".join(t for *_, t in html_tree.parse(html).blocks)
    assert text("<article><p>one <svg class='i'/> two</p><p>three</p></article>") == "one two|three"
    assert text("<p>one <math/> two</p><p>three") == "one two|three"
    assert text("<div><p>one <object data=x> two</p><p>three</p>four</div>") == "one two|three|four"
    assert text("<div><p>one <object data=x><p>no</p></object></p><p>three</p></div>") == "one|three"
    assert text("<p>one</p><svg-icon name=a></svg-icon><p>two</p><title-bar>three</title-bar><template-x>four") == "one|two|threefour"
    assert text("<p>one <svg><title/><style/><path d=x/><text>no</text></svg> two</p><p>three") == "one two|three"
    assert text("<div>one<svg><g><p>two</p></div><p>three") == "one|two|three"
    assert text("<div>one<svg><foreignObject><p>no</p></foreignObject></svg>two</div>") == "one|two"
    assert text("<p>one<noscript><p>no</p></noscript><template><div>no</div></template><p>two") == "one|two"
    assert text("<p>one<script>'<p>no</p>'</SCRIPT ><p>two<style>no<p>no") == "one|two"


def test_article_marks_are_a_prior(spark):
    page = "<article><p>lead of page {n}</p></article><div><p>body {n}</p></div><section>same on all pages</section>"
    cards = "<article><p>card</p></article><div><p>a long text beside the cards</p><p>that goes on</p></div>"
    got = extracted(spark, [(n, f"http://parts.x/{n}", page.format(n=n)) for n in range(9)] + [(50, "http://cards.x/", cards), (51, "http://few.x/", page.format(n=1))])
    assert got == {n: f"lead of page {n}\nbody {n}" for n in range(9)} | {50: "card\na long text beside the cards\nthat goes on", 51: "lead of page 1"}


def test_names_are_a_prior(spark):
    named = '<article><h2 id="search">T</h2><section id="how-to-search"><p>one</p></section><div class="elementor-widget-text">two</div><p class="notice-of-rights">three <span class="share">four</span></p><div class="social-links">no</div></article>'
    page = '<div><p>text {n} of the page</p></div><div class="widget">own {n}</div><div class="share-buttons">same</div><p>by <span class="related">{n} me</span></p>'
    alone = '<div id="widget"><p>all text</p><p>of the page</p></div>'
    got = extracted(spark, [(n, f"http://many.x/{n}", page.format(n=n)) for n in range(9)] + [(50, "http://named.x/", named), (51, "http://few.x/", page.format(n=1)), (52, None, alone), (53, None, '<article></article><div class="ad">no</div>'), (54, None, '<article>a</article><div class="ad">a long advert</div>')])
    assert {n: got[n] for n in range(9)} == {n: f"text {n} of the page\nown {n}\n{n} me" for n in range(9)}  # "by" is the same on all pages
    assert got[50] == "T\none\ntwo\nthree four" and got[51] == "text 1 of the page\nby" and got[52] == "all text\nof the page"
    assert got[53] == "" and got[54] == "a"


def test_parsing_is_linear():
    import time

    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<p><div>" + "<b>" * 100_000 + "<h1>x</h1>" * 10_000, "<div>" * 50_000 + "x" + "</div>" * 50_000, "<svg>" + "<g>" * 50_000 + "<path/>" * 50_000):
        began = time.process_time()
        html_tree.parse(page)
        assert time.process_time() - began < 6  # seconds on a slow machine; by the square it would be many minutes


def test_the_tree_alone_finds_boilerplate(spark):
    """No element, role or name says that anything is noise here."""
    page = '<div class="x1"><div>Welcome to our site</div><div>Read our terms</div></div><div class="x2"><h1>Title {n}</h1><p>text {n} of this page</p></div><div class="x3"><p>All rights reserved</p></div>'
    rows = [(n, f"http://plain.x/{n}", page.format(n=n)) for n in range(12)]
    assert extracted(spark, rows) == {n: f"Title {n}\ntext {n} of this page" for n in range(12)}


def test_importance_equals_plain_entropies(spark):
    rnd = random.Random(4)
    rows = [(n, f"http://h{n % 2}.x/{n}", "".join(f"<div class=c{k}><p>{rnd.choice('abc')} {k}</p>{'<h2>x</h2>' * rnd.randint(0, 1)}</div>" for k in range(3)) + f"<p>{n}</p>") for n in range(30)]
    trees = html_tree.parsed(spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")).cache()
    pages = {(r["host"], r["whole"], f["node"], f["content"], f["style"]) for r in trees.collect() for f in r["features"]}
    expected = {}
    for host, node in {(h, n) for h, _, n, _, _ in pages}:
        own = [(c, s) for h, _, n, c, s in pages if (h, n) == (host, node)]
        entropy = lambda values: 1.0 if len(values) == 1 else -sum(k / len(values) * math.log(k / len(values)) for k in Counter(values).values()) / math.log(len(values))
        expected[host, node] = (len(own), pytest.approx(html_tree.CONTENT_WEIGHT * entropy([c for c, _ in own]) + (1 - html_tree.CONTENT_WEIGHT) * entropy([s for _, s in own])))
    assert {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in html_tree.importance(trees).collect()} == expected


def test_odd_pages(spark):
    long = "<p>word</p>" * 30_000
    rows = [(1, "http://a.x/", long, 1), (1, "http://a.x/", long, 1), (None, None, "<p>x", 2), (2, "http://a.x/", None, 3)]
    got = html_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, blocks int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 1), (1, 30_000 * 5 - 1), (1, 30_000 * 5 - 1), (2, 0)]
