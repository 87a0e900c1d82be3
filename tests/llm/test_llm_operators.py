"""The training-data operators against brute force, held-out labels and defined edge cases."""

import math
import os
import random
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import hand_labelled
from packlake import llm
from packlake.llm import (
    components,
    embedding_dedup,
    html_extract,
    jaccard_join,
    labelled_pages,
    language_id,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    source_mixing,
    url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} and{k % 31}" for k in range(30_000))


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], DOCS)


def _odd_docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows, a column with a clashing name."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "tie tie tie", "b"), (5, "tie tie tie", "b"), (6, "12 34", None)]
    return _docs(spark, rows).selectExpr("*", "'x' as kept", "1 as n", "2 as rep", "3 as score", "4 as slot")


def _documents(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def _shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _components(nodes, links):
    comp = {}
    for d in sorted(nodes):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = d
                todo.extend(links.get(x, ()))
    return comp


def _near_links(texts):
    sets = {d: _shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    both = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    links = defaultdict(set)
    for (a, b), c in both.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            links[a].add(b)
            links[b].add(a)
    return links


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    df = llm.QUERIES[name](spark, sf)
    rel = con.sql(llm.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)


# 1


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no-scheme.net/x", "", "", None, "allow"),
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://myexample.net/en/", "myexample.net", "/en/", "net/", "block"),
        ("http://w.example.com/de/1", "w.example.com", "/de/1", "example.com/de/", "block"),
        ("http://w.example.com/en/1", "w.example.com", "/en/1", None, "allow"),
        ("http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
        ("http://x.net", "x.net", "", None, "allow"),
        ("http://x.com/free-casino", "x.com", "/free-casino", None, "block"),
        ("http://x.com/casinos", "x.com", "/casinos", None, "allow"),
        ("http://x.com/poker/poker", "x.com", "/poker/poker", None, "allow"),
        ("http://x.com/poker?bet=1", "x.com", "/poker", None, "block"),
    ],
)
def test_url(spark, url, host, path, rule, verdict):
    got = url_filter.host_and_path(url)
    assert got == (host, path)
    found = url_filter.Ruleset(url_filter.RULES).find(*got)
    assert (found and found.text) == rule
    hard, soft = url_filter.term_hits(url)
    own = "block" if hard or len(soft) >= 2 else "allow"
    assert (found.verdict if found else own) == verdict


def test_url_vocabulary(spark):
    forms = [f for w in url_filter.SOFT for f in (w, url_filter.plural(w))]
    assert len(set(forms)) == len(forms) and not set(forms) & set(url_filter.STRICT)
    assert [url_filter.plural(w) for w in ("bet", "lottery", "day", "box", "rx", "crash")] == ["bets", "lotteries", "days", "boxes", "rxes", "crashes"]
    assert url_filter.term_hits("http://x.com/pill-pills-bets") == (set(), {"pill", "bet"})
    terms = spark.createDataFrame([("Alpha", 1), ("beta", 0), ("gamma", 0), (None, 1), ("", 0)], "term string, strict int")
    strict, soft = url_filter.read_vocabulary(terms)
    assert (strict, soft) == (("alpha",), ("beta", "gamma"))
    pages = spark.createDataFrame([(1, "http://a.com/alpha"), (2, "http://a.com/beta"), (3, "http://a.com/betas/gammas?" + "x" * 100_000), (None, "http://a.com/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages, strict=strict, soft=soft).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", None: "allow"}


def test_url_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "http://x.net/a", "x"), (2, "http://x.net/a", "x")], "page_id long, url string, verdict string")
    assert sorted(r["verdict"] for r in url_filter.url_filter(df).collect()) == ["allow", "block", "block"]
    assert url_filter.url_filter(df.limit(0)).count() == 0


# 2


def test_line_dedup_keeps_one_of_each_recurring_line(spark, sf):
    texts = _documents(sf)
    out = {r["doc_id"]: r for r in line_dedup.query(spark, sf).collect()}
    assert set(out) == set(texts)
    holders = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            holders[x].add(d)
    for line, ds in holders.items():
        if len(ds) >= 3 and len(line.split()) >= 3:
            assert [d for d in ds if line in (out[d]["text"] or "").split("\n")] == [min(ds)]
    for d, t in texts.items():
        lines = (t or "").split("\n")
        assert len(lines) - out[d]["n_dropped"] == len((out[d]["text"] or "").split("\n")) or not out[d]["text"]


def test_line_templates_generalise(spark):
    rows = [(k, f"{chr(97 + k) * 3} unique text that starts in its own way\nPosted by user{k} on the board at {k}:00 today\nshared name {chr(97 + k)} in a line of ten tokens or so", "s") for k in range(6)]
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(_docs(spark, rows)).collect()}
    assert out[0]["n_dropped"] == 0
    assert all("Posted" not in out[k]["text"] and "unique" in out[k]["text"] for k in range(1, 6))
    assert line_dedup.templates_of_leaf(["a b c d e", "a b c d f", "x y z u v", "a b c d g"], 0.8) == [0, 0, 2, 0]


def test_line_templates_do_not_depend_on_leaf_lines(spark):
    name = [chr(97 + k) * 4 for k in range(12)]
    rows = [(k, f"Posted by user {x} on the board today\n{x} has its own\nThe old line of {x} and then ten tokens or so more", "s") for k, x in enumerate(name)]
    rows += [(50 + k, f"Posted by user {x} {x} wrote some thing", "s") for k, x in enumerate(name)]
    whole, parted = ({r["doc_id"]: r["text"] for r in line_dedup.line_dedup(_docs(spark, rows), leaf_lines=m).collect()} for m in (20_000, 2))
    assert whole == parted and all(whole[k] == f"{name[k]} has its own" for k in range(1, 12))
    assert all(whole[50 + k] for k in range(12))


def test_line_dedup_stage_leaves_near_copies_whole(spark):
    words = lambda tag, n: " ".join(f"{tag}{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(n))
    passage, others = words("p", 60), [words(t, 100) + "\n" + words(t + "z", 90) for t in "uvw"]
    rows = [
        (1, f"{passage}\n{others[0]}"),  # 2 shares a passage with it
        (2, f"{others[1]}\n{passage}"),
        (4, f"{others[2]}\nthe end"),  # 5 is a near copy of it
        (5, f"{others[2]}\nend of it"),
        (6, words("s", 55)),  # a short document that 7 holds
        (7, f"{words('s', 55)}\n{words('m', 99)}\n{words('n', 99)}\n{words('o', 99)}"),
    ]
    docs = _docs(spark, [(*row, "a") for row in rows])
    out = {r["doc_id"]: r["text"] for r in line_dedup.stage(spark, docs, "").collect()}
    assert out[1] == rows[0][1] and out[2] == others[1]
    assert out[4] == rows[2][1] and out[5] == rows[3][1]
    assert out[6] == rows[4][1] and out[7] == rows[5][1].split("\n", 1)[1]
    alone = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert alone[5] == "end of it" and alone[2] == others[1]


def test_line_dedup_odd_rows(spark):
    docs = _odd_docs(spark)
    out = line_dedup.line_dedup(docs).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in out) == Counter({(1, False): 1, (2, False): 1, (3, False): 1, (4, True): 1, (5, True): 2, (6, True): 1})
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    assert line_dedup.stage(spark, docs, "").columns == docs.columns


# 3


def test_html_marginals_equal_enumeration():
    page = html_extract.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div>")
    forest = html_extract.Forest([page])
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=(len(page.tag), 2)), rng.normal(size=(html_extract.KINDS, 2, 2))
    total, mass = 0.0, np.zeros((len(page.tag), 2))
    for bits in range(1 << len(page.tag)):
        y = [(bits >> v) & 1 for v in range(len(page.tag))]
        s = sum(unary[v, y[v]] for v in range(len(y))) + sum(pair[forest.kind[v], y[page.parent[v]], y[v]] for v in range(1, len(y)))
        total += math.exp(s)
        for v in range(len(y)):
            mass[v, y[v]] += math.exp(s)
    marginal, _, log_z = html_extract.sum_product(forest, unary, pair)
    assert np.allclose(marginal, mass / total) and math.isclose(log_z, math.log(total))


def test_html_accuracy_on_unseen_pages():
    pages = [html_extract.parse(x, True) for x in labelled_pages.labelled_pages(150, seed=11)]
    right = n = 0
    for page, p in zip(pages, html_extract.default_model().content(pages), strict=True):
        y = []
        for v, label in enumerate(page.label):
            y.append(label if label is not None else y[page.parent[v]] if v else 1)
        for node, _ in page.runs:
            n += 1
            right += (p[node] >= 0.5) == bool(y[node])
    assert right / n > 0.98


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<article><h1>Head &amp; tail</h1><p><b>First&nbsp;  one<br><p>Second
 one, with <a href=x>a link</a>.<p>To.</p><div class="ad"><p>Buy now.</p></div><ul><li>An item of the list.</li></ul></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thank you.</p></div></section>
<aside class="sidebar"><p>Most read</p></aside><form class="newsletter"><p>Sign up</p><input></form><footer>&copy; x &middot; All rights</footer>"""


def test_html_page():
    got = html_extract.extract([PAGE, None, "", "<p", "<div><p>Only this text is here, no more.</p>", "<!-- x"], html_extract.default_model())
    assert got[0] == "Head & tail\nFirst one\nSecond one, with a link.\nTo.\nAn item of the list."
    assert got[1:4] == ["", "", ""] and got[4] == "Only this text is here, no more." and got[5] == ""


def test_html_pages_labelled_by_hand():
    got = html_extract.extract([html for html, _ in hand_labelled.PAGES], html_extract.default_model())
    for text, (_, want) in zip(got, hand_labelled.PAGES, strict=True):
        got_lines, want_lines = Counter(text.split("\n")), Counter(want.split("\n"))
        assert sum((got_lines & want_lines).values()) >= 0.9 * max(sum(got_lines.values()), sum(want_lines.values())), text


def test_html_marginals_of_pages_equal_enumeration():
    """The text of small pages against the sum over all labellings of their nodes."""
    model = html_extract.default_model()
    htmls = [PAGE[-400:], "<div><p>One line.</p><ul><li><a href=x>A</a></li></ul></div>", "<article><h1>T</h1><p>Some text here.</p></article><footer>F</footer>"]
    for html in htmls:
        page = html_extract.parse(html)
        n = len(page.tag)
        assert n <= 16
        unary = model.unary([page])
        on, total = np.zeros(n), 0.0
        for code in range(1 << n):
            y = [(code >> v) & 1 for v in range(n)]
            e = sum(unary[v, y[v]] for v in range(n)) + sum(model.pair[html_extract.KIND.get(page.tag[v], 0), y[page.parent[v]], y[v]] for v in range(1, n))
            on += np.exp(e) * np.array(y)
            total += np.exp(e)
        want = "\n".join(text for node, text in page.runs if on[node] / total >= 0.5)
        assert html_extract.extract([html], model) == [want]


def test_html_deep_markup_takes_linear_time():
    for x in ("<div>x", "<div></section>", "<ul><li><div>", "<p><table><td><div>", "<i><div><b></i>"):
        began = time.process_time()
        html_extract.parse(x * 20_000)
        assert time.process_time() - began < 5


def test_html_table(spark, sf):
    rows = html_extract.query(spark, sf).collect()
    source = dict(duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    assert {r["page_id"] for r in rows} == set(source)
    for r in rows:
        assert r["n_chars"] == len(r["text"]) and "track(" not in r["text"] and "©" not in r["text"]
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<p>" * 3000 + "x", "x")], "page_id long, url string, html string, text string")
    assert html_extract.html_extract(odd).count() == 2


# 4


def _cosine_links(ids, x, threshold=0.9):
    n = np.linalg.norm(x, axis=1)
    link = (x @ x.T) / (n[:, None] * n[None, :]) >= threshold
    return {i: {ids[k] for k in np.flatnonzero(link[j]) if ids[k] != i} for j, i in enumerate(ids)}


def test_embeddings_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.12 * rng.normal(size=(rng.integers(1, 40), 16)) for c in centers] + [rng.normal(size=(300, 16))])
    x = np.concatenate([x, x[:20]])
    order = rng.permutation(len(x))
    x = x[order].astype(np.float32).astype(float)
    ids = list(range(5, 5 + len(x)))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    links = _cosine_links(ids, x)
    want = sum(map(len, links.values()))
    got = sum(r["n_links"] for r in out.values())
    assert 0.97 * want <= got <= want
    comp = _components(ids, links)
    assert sum(out[i]["component_id"] == comp[i] for i in ids) >= 0.97 * len(ids)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in out.items())


def test_embeddings_of_a_hot_group_all_meet(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=64) + 0.22 * rng.normal(size=(3000, 64))  # cosines about 0.954 among them
    x = np.concatenate([hot, rng.normal(size=(6000, 64))])
    x = x[rng.permutation(len(x))].astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    n = np.linalg.norm(x, axis=1)
    want = ((x @ x.T) / (n[:, None] * n[None, :]) >= 0.9).sum(axis=1) - 1
    assert [out[i]["n_links"] for i in range(len(x))] == want.tolist()


def test_embeddings_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (7, [2.0, 2.0]), (7, [2.0, 2.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 0.0]), (10, [1e38, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, kept int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 2, 6): 1, (7, 2, 6): 2, (8, 0, 8): 1, (9, 1, 9): 1, (10, 1, 9): 1})
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


# 5


def test_quality_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    ratio = quality_classifier.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    scored = quality_classifier.with_weights(docs.select("doc_id", "text"), ratio, ["doc_id"])
    held = scored.join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").collect()
    good = [r["__log_weight"] for r in held if r["quality"] == 1]
    bad = [r["__log_weight"] for r in held if r["quality"] == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97
    out = {r["doc_id"]: r["kept"] for r in quality_classifier.query(spark, big).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum(out[d] for d, q in known.items() if q == 1) >= 0.98 * sum(known.values())
    assert sum(not out[d] for d, q in known.items() if q == 0) >= 0.6 * sum(q == 0 for q in known.values())


def test_kth_largest(spark):
    r = random.Random(5)
    values = [r.choice((r.gauss(0, 1e6), 3.0, 3.0000000000000004, r.random())) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 250, 499, 500):
        assert quality_classifier.kth_largest(df, "v", k, bins=7) == sorted(values, reverse=True)[k - 1]
    assert quality_classifier.kth_largest(df, "v", 501) is None


def test_quality_odd_rows(spark):
    docs = _odd_docs(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (99, 1), (5, 0)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).collect()
    assert len(out) == 7 and all(not r["kept"] for r in out if r["doc_id"] in (1, 2, 3))
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert sorted({r["doc_id"] for r in none if r["kept"]}) == [4, 5, 6]
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


# 6


def test_language_held_out(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    lang = dict(duckdb.sql(f"select doc_id, lang from '{big}/documents.parquet'").fetchall())
    out = language_id.query(spark, big).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_mixture_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(docs)
    by = {k: " ".join(r["text"] for r in docs.where(docs.lang == k).limit(6).collect()).split()[:150] for k in ("en", "de")}
    predictor = language_id.Predictor(model)
    (top, score), (und, zero) = predictor.predict([" ".join(by["en"] + by["de"][:75]), "12 ! ² ½ Ⅷ"])
    assert top == "en" and 0.55 < score < 0.8 and (und, zero) == ("und", 0.0)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(_odd_docs(spark), model).collect()}
    assert out[1] == out[2] == out[3] == out[6] == "und" and out[4] != "und"
    empty = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predicted(_odd_docs(spark), empty).collect()} == {"und"}
    assert language_id.predicted(docs.limit(0), model).count() == 0


# 7


def test_schedule_deviates_by_less_than_a_block():
    blocks, weights = {"a": 40, "b": 13, "c": 100, "d": 1}, {"a": 3, "b": 1, "c": 5, "d": 1}
    slots = list(source_mixing.schedule(blocks, weights))
    assert Counter(k for k, _ in slots) == Counter(blocks)
    count, start, base, live = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0), 0, set(blocks)
    for t, (k, block) in enumerate(slots, 1):
        assert block == count[k]
        count[k] += 1
        total = sum(weights[x] for x in live)
        assert all(abs(count[x] - start[x] - Fraction(weights[x] * (t - base), total)) < 1 for x in live)
        if count[k] == blocks[k]:
            live.discard(k)
            base, start = t, dict(count)


def test_mixing_plan_equals_the_schedule():
    r = random.Random(7)
    for _ in range(60):
        blocks = {k: r.randrange(0, 90) for k in "abcdefg"[: r.randrange(1, 8)]}
        weights = {k: r.choice([1, 2, 3, 5, 6, 30, 97]) for k in blocks}
        plan = source_mixing.Plan(blocks, weights)
        got = {(k, b): int(s) for k, n in blocks.items() for b, s in enumerate(plan.slots(k, np.arange(n)))}
        assert got == {x: slot for slot, x in enumerate(source_mixing.schedule(blocks, weights))}


def test_mixing_matches_brute_force(spark, sf):
    rows = source_mixing.query(spark, sf.replace("0.001", "0.01")).collect()
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["position"]):
        own[r["source"]].append(r)
    weights = source_mixing.whole_weights({k: len(v) for k, v in own.items()}, None)
    slots = source_mixing.schedule({k: -(-len(v) // 64) for k, v in own.items()}, weights)
    want = {x: slot for slot, x in enumerate(slots)}
    for k, v in own.items():
        for rank, r in enumerate(v):
            assert (r["block"], r["slot"], r["position"] % 64) == (rank // 64, want[k, rank // 64], rank % 64)
    order = spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long").selectExpr("doc_id", "xxhash64(7, doc_id) as h")
    h = {r["doc_id"]: r["h"] for r in order.collect()}
    assert all([h[r["doc_id"]] for r in v] == sorted(h[r["doc_id"]] for r in v) for v in own.values())


def test_mixing_keeps_all_rows(spark, sf):
    rows = source_mixing.query(spark, sf).collect()
    n = len(_documents(sf))
    assert len({r["doc_id"] for r in rows}) == len({r["position"] for r in rows}) == len(rows) == n
    blocks = defaultdict(set)
    for r in rows:
        blocks[r["source"], r["block"]].add(r["slot"])
    assert all(len(s) == 1 for s in blocks.values())


def test_mixing_odd_rows(spark):
    docs = _odd_docs(spark)
    out = source_mixing.mixed(docs.select("doc_id", "source"), {"a": 1.0, "b": float("nan")}, block_docs=1)
    assert out.count() == 7
    staged = source_mixing.stage(spark, docs, "")
    assert staged.columns == docs.columns and staged.count() == 7
    assert source_mixing.mixed(docs.select("doc_id", "source").limit(0)).count() == 0


# 8


def test_quality_rules_odd_rows(spark):
    same = "alpha beta gamma delta epsilon "
    rows = [(k, f"Shared notice {k} of the host, nothing more to read here at all\n" + " ".join(f"own{k}x{j}" for j in range(4)), "h") for k in range(20, 34)]
    docs = _docs(spark, [(1, None, "h"), (2, "", None), (3, same * 4, "h"), (4, LONG, "h"), (5, "a b", "h"), (5, "a b", "h"), *rows])
    out = defaultdict(list)
    for r in quality_rules.quality_rules(docs).collect():
        out[r["doc_id"]].append(r)
    assert len(out[5]) == 2 and out[1][0]["base_failed"] and out[2][0]["n_words"] == 0
    assert out[3][0]["n_repeat_words"] == 20 and out[4][0]["n_words"] == 60_000
    assert out[20][0]["removed_words"] == 0 and out[21][0]["removed_words"] == 17
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_are_native(spark, sf):
    plan = quality_rules.query(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 9


def _check_pieces(pieces, texts, seq_len=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    at, by_doc = None, defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        if at is None or r["sequence_id"] != at[0]:
            assert r["offset"] == 0 and (at is None or at == (r["sequence_id"] - 1, seq_len))
        else:
            assert r["offset"] == at[1]
        at = (r["sequence_id"], r["offset"] + r["length"])
        assert at[1] <= seq_len and r["length"] > 0
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
    for d, x in ids.items():
        end = 0
        for s, n in sorted(by_doc[d]):
            assert s == end
            end += n
        assert end == len(x)


def test_packing_round_trip(spark, sf):
    texts = _documents(sf)
    _check_pieces(packing.query(spark, sf).collect(), texts)
    small = packing.packed(spark.read.parquet(f"{sf}/documents.parquet"), range_tokens=3000).collect()
    _check_pieces(small, texts)


def test_packing_odd_rows(spark):
    docs = _odd_docs(spark).where("doc_id <> 5")
    _check_pieces(packing.packed(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})
    assert packing.packed(docs.limit(0)).count() == 0
    assert sum(r["length"] for r in packing.packed(_odd_docs(spark).where("doc_id = 5")).collect()) == 8


def test_encoder_equals_tokenizer():
    coder = packing.Encoder(packing.default_tokenizer())
    texts = [
        "İstanbul ΣΑΣ Ａｂｃ été naïve CAFÉ's don't I'LL 3.14½ x\xa0y a\x1cb <|endoftext|>z q<|startoftext|> ﬁn ǅ t 你好 😀 ª²\xad ÀÉ..!! '' 's'S can'tT",
        "", " \n\t ", "\x00a b\x7f", "a​b é", "a|b | c.| ...", "ſ K Å",
    ]
    want = [coder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for _ in range(3):  # again from memory
        ids, counts = coder.ids(pa.array([*texts, None]))
        assert counts.tolist() == [*map(len, want), 0]
        assert ids.tolist() == [k for x in want for k in x]
    coder.pieces, coder.words = packing.Memory(8), packing.Memory(4)  # memories that overflow
    ids, _ = coder.ids(pa.array(texts))
    assert ids.tolist() == [k for x in want for k in x]


def test_packing_keeps_to_windows_of_the_order(spark, tmp_path):
    rows = [(k, f"text number {k * 7919 % 300} of many", "en", "s", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4).orderBy(F.desc("doc_id"))
    docs.write.parquet(str(tmp_path / "docs"))
    back = spark.read.parquet(str(tmp_path / "docs"))
    assert [r["__at"] for r in packing.in_files(back).orderBy(F.desc("doc_id")).collect()] == list(range(300))
    out = packing.packed(packing.in_files(back), seq_len=16, window_docs=50, range_tokens=100).collect()
    begin = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in out if not r["start"]}
    order = sorted(begin, key=begin.get)
    assert [sorted(order[k : k + 50]) for k in range(0, 300, 50)] == [list(range(250 - k, 300 - k)) for k in range(0, 300, 50)]
    assert order != sorted(order, reverse=True)


def test_hilbert_key_walks_to_neighbours():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = grid[np.argsort(packing.hilbert_key(grid, 3))]
    assert len(set(packing.hilbert_key(grid, 3).tolist())) == side**3
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# 10


def test_jaccard_join_matches_brute_force(spark, sf, monkeypatch):
    big = sf.replace("sf0.001", "sf0.01")
    texts = _documents(big)
    r = random.Random(10)
    base = [f"w{r.randrange(3000)}" for _ in range(200)]
    rows = [(k, t, "s") for k, t in texts.items()]
    for k in range(80):  # a group of distinct near copies, from close to beyond the threshold
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(200)] = f"v{r.randrange(9999)}"
        rows.append((10_000_000 + k, " ".join(w), "s"))
    for k in range(150):  # pairs that are just at the threshold: 80 of 100 shingles
        w = [f"p{k}x{j}" for j in range(94)]
        for m, y in enumerate((w, [*w[:84], *(f"q{k}x{j}" for j in range(10))])):
            rows.append((20_000_000 + 2 * k + m, " ".join(y), "s"))
    texts = {k: t for k, t, _ in rows}
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    depths = []
    compare = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda *a: depths.append(a[4]) or compare(*a))
    links = _near_links(texts)
    comp = _components(texts, links)
    out = {x["doc_id"]: x for x in jaccard_join.jaccard_join(_docs(spark, rows)).collect()}
    assert set(out) == set(texts)
    assert depths == [7, 6]  # classes near the threshold have their prefixes shortened
    wrong = [d for d in texts if out[d]["n_links"] != len(links[d]) or out[d]["class_id"] != comp[d]]
    assert not wrong
    assert all(x["kept"] == (d == x["class_id"]) for d, x in out.items())


def test_jaccard_forest_finds_all_common_prefixes(spark):
    r = np.random.default_rng(3)
    sig = r.integers(0, 3, (120, jaccard_join.TREES * jaccard_join.DEPTH)).astype(">u2")
    sig[60:90] = sig[60]  # a hot label
    classes = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sig)], "node long, sig binary").repartition(5)
    near = jaccard_join.forest(classes, 4).collect()
    for depth in (4, 5, 7):
        got = defaultdict(set)
        for x in near:
            if x["depth"] >= depth:
                got[x["tree"]].add((x["u"], x["v"]))
        value = sig.reshape(120, jaccard_join.TREES, -1)[:, :, :depth]
        for t in range(jaccard_join.TREES):
            links = defaultdict(set)
            for u, v in got[t]:
                links[u].add(v)
                links[v].add(u)
            first = {}
            want = {k: first.setdefault(value[k, t].tobytes(), k) for k in range(120)}
            assert _components(range(120), links) == want


def test_jaccard_odd_rows(spark):
    text = "one two three four five six seven eight nine ten "
    more = [(1, text * 3 + "A", "x"), (1, text * 3 + "B c d e f g h", "x"), (None, text[::-1] * 5, "x"), (None, text[::-1] * 5, "x"), (None, "another text of a nameless row", "y")]
    docs = _odd_docs(spark).unionByName(_docs(spark, more).selectExpr("*", "'x' as kept", "1 as n", "2 as rep", "3 as score", "4 as slot"))
    got = Counter((r["doc_id"], r["class_id"], r["copy_id"], r["n_links"], r["kept"]) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == Counter({
        (1, 1, 1, 0, True): 3, (2, 2, 2, 0, True): 1, (3, 3, 3, 0, True): 1, (4, 4, 4, 0, True): 1, (5, 5, 5, 1, True): 2, (6, 6, 6, 0, True): 1,
        (None, None, None, 1, True): 2, (None, None, None, 0, True): 1,
    })
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0
    staged = jaccard_join.stage(spark, docs, "")
    assert staged.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in staged.collect())
    assert left == Counter(set((r["doc_id"], r["text"]) for r in docs.collect()))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(300, 380)] + [(7, 7), (300, 7)]
    r = random.Random(1)
    edges = [e if r.random() < 0.5 else e[::-1] for e in chain + star]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 7 for k in [7, *range(300, 380)]}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    assert [k for k, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, kept = docs, []
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        docs = cp.written(stage(spark, docs, sf), f"test-{k}")
        assert docs.schema.names == first.schema.names
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    verdict = {r["doc_id"] for r in llm.QUERIES["op5_quality_classifier"](spark, sf).where("kept").collect()}
    assert set(kept[0]) == verdict
    assert set(kept[1]) <= set(kept[0])
    left = _near_links(kept[1])
    comp = _components(kept[1], left)
    assert {comp[d] for d in kept[2]} == set(comp.values()) and len(kept[2]) == len(set(comp.values()))
    assert kept[3] == kept[2]
    _check_pieces(cp.STAGES[-1][1](spark, docs, sf).collect(), kept[3])


def test_pipeline_mixing_reaches_the_sequences(spark, sf, monkeypatch):
    """Every stretch of sequences has the sources that the schedule gives it, and without the
    stage it has others."""
    import corpus_pipeline as cp

    monkeypatch.setattr(packing, "WINDOW_DOCS", 64)
    monkeypatch.setattr(packing.packed, "__defaults__", (None, 4096, packing.EOS, 1_000_000, 64))
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    mixed = cp.written(cp.mixing(spark, docs, big), "mixed")
    plain = cp.written(docs, "plain")
    at = {r["doc_id"]: r["position"] for r in source_mixing.mixed(docs.select("doc_id", "source")).collect()}
    want = [source[d] for d in sorted(at, key=at.get)]

    def windows(stage_docs):
        out = cp.packed(spark, stage_docs, big).where("start = 0").orderBy("sequence_id", "offset").collect()
        found = [source[r["doc_id"]] for r in out]
        return [Counter(found[k : k + 64]) for k in range(0, len(found), 64)]

    expected = [Counter(want[k : k + 64]) for k in range(0, len(want), 64)]
    assert windows(mixed) == expected
    assert windows(plain) != expected
    assert cp.run(spark, sf).count() > 0


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    text = "a line of the text that is long enough to be kept by all of the stages, number "
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, "tie tie tie", "b"), (5, "tie tie tie", "b"), (None, text + "nil", "a")]
    rows += [(k, text + " ".join(f"w{k}x{j}" for j in range(k % 40)), "ab"[k % 2]) for k in range(10, 60)]
    docs = _docs(spark, rows).selectExpr("*", "'x' as kept", "1 as n", "2 as rep", "3 as score", "4 as slot", "5 as position")
    labels = spark.createDataFrame([(11, 1, 0), (12, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    for name, some in (("full", docs), ("empty", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    d = str(tmp_path / "full")
    out = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        out = cp.written(stage(spark, out, d), f"odd-{k}")
        assert out.columns == docs.columns
    left = out.collect()
    assert not {1, 2, 3} & {r["doc_id"] for r in left}
    assert sum(r["text"] == text + "nil" for r in left) <= 1
    assert cp.run(spark, d).where("doc_id = 4").count() >= any(r["doc_id"] == 4 for r in left)
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0
