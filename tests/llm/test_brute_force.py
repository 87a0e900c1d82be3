"""Whole query results of operators that SQL can't express, against plain loops written anew."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import regex
import xxhash

from packlake.llm import language_id, line_dedup, quality_classifier

MASK = (1 << 64) - 1


def _documents(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def _templates(texts, depth=3, similarity=0.8, min_docs=3, min_tokens=3, long_tokens=50, long_docs=2):
    """Line numbers that each text loses, by comparing every line with every template of its leaf."""
    where = defaultdict(list)
    for d, text in texts.items():
        for k, raw in enumerate((text or "").split("\n")):
            tokens = tuple("<*>" if re.search("[0-9]", w) else w for w in re.split("[\x20\x09-\x0d]+", raw) if w)
            if len(tokens) >= min_tokens and any(w != "<*>" for w in tokens):
                where[tokens].append((d, k))
    leaves = defaultdict(list)
    for tokens in where:
        leaves[len(tokens), tokens[:depth]].append(tokens)
    lost = defaultdict(set)
    for lines in leaves.values():
        found = []  # (tokens with None for variable ones, members)
        for line in sorted(lines, key=lambda x: (-len(where[x]), " ".join(x))):
            votes = [sum(a == b for a, b in zip(t, line, strict=True)) for t, _ in found]
            if votes and max(votes) >= similarity * len(line):
                t, members = found[votes.index(max(votes))]
                t[:] = [a if a == b else None for a, b in zip(t, line, strict=True)]
                members.append(line)
            else:
                found.append((list(line), [line]))
        for _, members in found:
            spots = [x for line in members for x in where[line]]
            docs = {d for d, _ in spots}
            if len(docs) >= (long_docs if len(members[0]) >= long_tokens else min_docs):
                for d, k in spots:
                    if d != min(docs):
                        lost[d].add(k)
    return lost


def test_line_dedup_matches_brute_force(spark, sf):
    big = sf.replace("0.001", "0.01")
    texts = _documents(big)
    base = 10_000_000
    for k in range(60):  # a template with fields that have no digits
        texts[base + k] = f"Posted by user {'abcdefgh'[k % 8]}{'xyz'[k % 3]} on the board of the town today at noon\nown line {'q' * (k + 1)} here"
    passage = " ".join(f"word{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(50))
    for k, line in enumerate((passage, passage, passage[:-7], "", passage[:-7])):  # 50 words twice, 49 words twice
        texts[base + 100 + k] = f"{'short own line ' + 'abcde'[k]}\n{line}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lost = _templates(texts)
    assert lost[base + 101] == {1} and not any(lost.get(base + 100 + k) for k in (0, 2, 3, 4))
    assert any(d >= base for d in lost)
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert set(out) == set(texts)
    for d, text in texts.items():
        left = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in lost[d])
        assert (out[d]["text"], out[d]["n_dropped"]) == (left, len(lost[d]))
        assert out[d]["kept"] == bool(left and left.strip(" \t\n\x0b\x0c\r"))


def _grams(text, buckets):
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text or "")
    h = [xxhash.xxh3_64_intdigest("\x00again" if k and tokens[k - 1] == x else x) for k, x in enumerate(tokens)]
    pairs = [((a * 0x9E3779B97F4A7C15) ^ (b + 0x7F4A7C15)) & MASK for a, b in zip(h, h[1:], strict=False)]
    pairs = [((p ^ (p >> 29)) * 0xBF58476D1CE4E5B9) & MASK for p in pairs]
    return [(x >> 40) % buckets for x in h + pairs]


def test_quality_matches_brute_force(spark, sf):
    buckets, smooth = quality_classifier.BUCKETS, 10.0
    texts = _documents(sf)
    labels = defaultdict(set)
    for d, q in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet' where doc_id is not null and quality is not null").fetchall():
        labels[d].add(q)
    label = {d: min(q) for d, q in labels.items() if len(q) == 1}
    grams = {d: _grams(t, buckets) for d, t in texts.items()}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if label.get(d) == 1:
            target.update(g)
    n_raw, n_target = (sum(c.values()) + smooth * buckets for c in (raw, target))
    ratio = [math.log((target[b] + smooth) / n_target) - math.log((raw[b] + smooth) / n_raw) for b in range(buckets)]
    hashes = spark.createDataFrame([(d,) for d in texts], "doc_id long").selectExpr("doc_id", "xxhash64(5, doc_id) as h").collect()
    u = {r["doc_id"]: (((r["h"] & MASK) >> 12) + 0.5) / 2.0**52 for r in hashes}
    score = {d: sum(ratio[b] for b in g) - math.log(-math.log(u[d])) for d, g in grams.items()}
    full = [d for d, g in grams.items() if g]
    known = [label[d] for d in full if d in label]
    share, unknown = sum(known) / len(known), 1 - len(known) / len(full)
    share = min(1.0, share + 2 * math.sqrt(unknown * (share * (1 - share) + 1 / len(known)) / len(known)))
    kept = set(sorted(full, key=lambda d: -score[d])[: round(len(full) * share)])
    out = {r["doc_id"]: r for r in quality_classifier.query(spark, sf).collect()}
    assert set(out) == set(texts)
    assert all(abs(out[d]["score"] - score[d]) < 1e-6 * (1 + abs(score[d])) for d in texts)
    assert {d for d, r in out.items() if r["kept"]} == kept


def _word_buckets(word, buckets):
    code = [ord(c) for c in f" {word.lower()} "]
    out = []
    for at in range(len(code)):
        h = 0
        for n in (1, 2, 3):
            if at + n > len(code):
                break
            h = ((h ^ code[at + n - 1]) * 0x9E3779B97F4A7C15) & MASK
            h ^= h >> 29
            out.append(((((h + n) & MASK) * 0x9E3779B97F4A7C15 & MASK) >> 40) % buckets)
    return out


def _em(like, counts, langs):
    total, share, score = sum(counts), dict.fromkeys(langs, 1 / len(langs)), None
    top = [max(x[k] for k in langs) for x in like]
    p = [{k: math.exp(max(x[k] - t, -60.0)) for k in langs} for x, t in zip(like, top, strict=True)]
    for _ in range(12):
        now = dict.fromkeys(langs, 0.0)
        for x, c in zip(p, counts, strict=True):
            z = sum(x[k] * share[k] for k in langs)
            for k in langs:
                now[k] += c * x[k] * share[k] / z / total
        done = max(abs(now[k] - share[k]) for k in langs) < 1e-4
        share = now
        if done:
            break
    score = sum(c * (math.log(max(sum(x[k] * share[k] for k in langs), 1e-300)) + t) for x, c, t in zip(p, counts, top, strict=True))
    return share, score


def test_language_matches_brute_force(spark, sf):
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet'").fetchall()
    word, buckets = regex.compile(r"\p{L}[\p{L}\p{M}]*"), language_id.BUCKETS
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    counts = defaultdict(Counter)
    known = {}
    for d, text, lang in rows:
        if lang is not None and not held[d]:
            for w, c in Counter(word.findall(text or "")).items():
                for b in known.setdefault(w, _word_buckets(w, buckets)):
                    counts[lang][b] += c
    langs = sorted(counts)
    size = {k: sum(counts[k].values()) + 0.5 * buckets for k in langs}
    out = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    assert len(out) == len(rows)
    for d, text, _ in rows[:120]:
        assert out[d]["held_out"] == held[d]
        found = Counter(word.findall(text or ""))
        if not found:
            assert (out[d]["lang_pred"], out[d]["score"]) == ("und", 0.0)
            continue
        like = []
        for w in found:
            grams = known.setdefault(w, _word_buckets(w, buckets))
            like.append({k: sum(math.log((counts[k][b] + 0.5) / size[k]) for b in grams) / 3 for k in langs})
        n, live = sum(found.values()), langs
        share, score = _em(like, list(found.values()), live)
        while len(live) > 1:
            weakest = min(live, key=lambda k: share[k])
            rest = [k for k in live if k != weakest]
            next_share, next_score = _em(like, list(found.values()), rest)
            if score - next_score > 0.5 * math.log(max(2, n)):
                break
            live, share, score = rest, next_share, next_score
        best = max(live, key=lambda k: share[k])
        assert out[d]["lang_pred"] == best
        assert abs(out[d]["score"] - share[best]) < 1e-3
