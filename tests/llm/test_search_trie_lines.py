"""Lexical search, prefix trie and line deduplication against plain versions, on odd, hot and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallysift.llm import lexical_search, line_dedup, prefix_trie

LOWER = {c: c + 32 for c in range(65, 91)}


# -- lexical search

def plain_ranking(docs, items, k=20):
    """(item number, rank, doc_id, score) by scoring every document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bags = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = collections.Counter(t for _, w in bags for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    bags = [(i, len(w), collections.Counter(w)) for i, w in bags]
    out = []
    for q, (_, text) in enumerate(items):
        scored = []
        for i, n, tf in bags:
            m = 75 + 25 * n * n_docs // total if total else 0
            s = sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf)
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def ranked(spark, docs, items, kind="long", **options):
    d = spark.createDataFrame(docs, f"doc_id {kind}, text string").repartition(3)
    rows = lexical_search.rank(d, spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(400)] + ["ÉTÉ", "été", "A1"]
    docs = [(k, " ".join(rng.choices(words, k=int(rng.paretovariate(0.7)) % 300))) for k in range(3000)]
    docs += [(10_000 + k, docs[7][1]) for k in range(300)] + [(None, docs[7][1]), (None, "w1 w2"), (-5, None), (-6, ""), (7, docs[7][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(30)]
    return docs, items + [(30, None), (31, "?!"), (32, docs[7][1]), (33, "nowhere")]


def test_search_equals_plain_scores(spark, corpus):
    docs, items = corpus
    want = plain_ranking(docs, items)
    assert {w[0] for w in want} >= {*range(30), 32} - {k for k, _ in items if k > 32}
    assert ranked(spark, docs, items, heads=50) == want
    # a block of queries at a time, no thresholds to begin with
    assert ranked(spark, docs, items, heads=0, block_bytes=2000) == want


def test_search_prunes(corpus):
    docs, items = corpus
    queries = lexical_search.Queries([t for _, t in items])
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 500)
    at = np.concatenate([np.sort(rng.choice(len(queries.vocabulary), n, replace=False)) for n in sizes])
    impact = (rng.pareto(1, len(at)) * 1e6).astype(np.int64)
    row = np.repeat(np.arange(500), sizes)
    length = np.sqrt(np.bincount(row, impact.astype(float) ** 2))
    bucket, left = lexical_search.Bucket(length, sizes, at, impact), 0
    for terms, counts, norm in zip(queries.terms, queries.counts, queries.lengths):
        dense = np.zeros(len(queries.vocabulary), np.int64)
        dense[terms] = counts
        score = np.bincount(row, (dense[at] * impact).astype(float), minlength=500).astype(np.int64)
        assert bucket.scores(np.arange(500), dense).tolist() == score.tolist()
        bar = max(1, int(np.sort(score)[-20]))
        rows = bucket.survivors(terms, counts, norm, bar)
        assert set(np.flatnonzero(score >= bar)) <= set(rows.tolist())
        left += len(rows)
    assert left < 0.3 * 500 * len(items)


def test_search_odd_tables(spark, corpus):
    docs, items = corpus
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []
    assert ranked(spark, [(1, None), (2, "!")], items) == []
    names = [(f"é{k}" if k % 2 else f"z{k}", "same words") for k in range(40)] + [(None, "same words")]
    got = ranked(spark, [*names, ("a", "other")], [(0, "words")], kind="string")
    assert [r[2] for r in got] == sorted((n for n, _ in names if n), key=str.encode)[:20]
    twice = ranked(spark, [(1, "x"), (2, "y")], [(9, "x"), (9, "x")])
    assert [r[:3] for r in twice] == [(9, 1, 1)] * 2
    # a term of every document has no weight left, so it finds nothing
    assert ranked(spark, [(k, "x") for k in range(3000)], [(0, "x")]) == []


# -- prefix trie

def plain_trie(rows, heads=9, every=5):
    """Node rows from (conv_id, turn, role, text)."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, md5(md5(role or "") + md5(text or "")), role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % heads, c - int(math.fmod(c, every))
        built[c] = tuple(own if base == c else convs.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    return sorted((own[0], len(p), members[p[:-1]][0] if p else -1, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in own if len(built[c]) == len(p)).encode()).hexdigest()) for p, own in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def grown(spark, rows, **options):
    conv = spark.createDataFrame(rows, CONVERSATIONS).withColumn("c", F.lit("x")).withColumn("pos", F.lit(1)).repartition(5)
    turns, members = prefix_trie.shared_beginnings(prefix_trie.conversation_turns(conv))
    nodes, ends = prefix_trie.trie(turns, members, **options)
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                  r.saved_tokens, r.ends_sha256) for r in nodes.collect())
    assert ends.count() == ends.select("conv_id").distinct().count() == members.count()
    assert ends.join(nodes, ["depth", "node_1", "node_2"]).count() == members.count()
    return got


@pytest.mark.parametrize("block", [1, 3, 4])
def test_trie_equals_plain_version(spark, block):
    rng = random.Random(block)
    say = lambda: rng.choice(["", "a", "é", "long text " * 5, None])
    rows = [(c, t, rng.choice(["user", None, "assistant"]), say()) for c in range(-12, 60) for t in range(rng.randrange(0, 14))]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(11)]  # copies, some cut off by their beginnings
    rows += [(200, None, "user", "n"), (200, None, "user", "m"), (200, 1, "user", "n"), (None, 1, "user", "gone"), (None, None, None, None)]
    rows += [(207, 1, "user", "again")] * 50 + [(213, None, None, None)]
    assert grown(spark, rows, block=block) == plain_trie(rows)


def test_trie_of_a_hot_conversation(spark):
    rows = [(5, t, "user", f"turn {t}") for t in range(5000)] + [(6, t, "user", f"own {t}") for t in range(4000)]
    rows += [(k, 0, "user", "hi") for k in range(1000, 6000)]
    got = grown(spark, rows)
    assert len(got) == len(set(got)) and max(r[1] for r in got) >= 5000
    deep = [r for r in got if r[0] == 5]
    assert sum(r[3] for r in got if r[1] == 0) == 5002 and deep[-1][4:6] == (0, 1)
    brief = [r for r in rows if r[0] != 5 or r[1] < 20][:40] + rows[9000:]
    assert grown(spark, brief) == plain_trie(brief)


def test_trie_of_nothing(spark):
    assert grown(spark, []) == [] and grown(spark, [(None, 1, "user", "x")]) == []
    # crc32 of "3" leaves nothing of one turn, and conversation 0 is absent
    rows = [(3, 0, "user", "x")]
    assert grown(spark, rows) == plain_trie(rows)


# -- lines

def plain_lines(docs, least=10):
    """(n_lines, n_dropped, kept) of each row."""
    lines = [((t or "").split("\n")) for _, t in docs]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for (i, _), own in zip(docs, lines):
        for x in own:
            if len(key(x)) >= least:
                at = math.inf if i is None else i
                first[key(x)] = min(first.get(key(x), math.inf), at)
    out = []
    for (i, _), own in zip(docs, lines):
        keep = [x for x in own if len(key(x)) < least or first[key(x)] == (math.inf if i is None else i)]
        out.append((i, len(own), len(own) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def deduplicated(df, **options):
    rows = line_dedup.deduplicate(df, keep=["doc_id"], name="o", **options).select("doc_id", "o.*").collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.dropped) == r.n_dropped for r in rows)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in rows), key=repr)


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(2)
    pool = [f"{'Line' if k % 3 else ' LINE'} number {k % 200}{' ' * (k % 2)}" for k in range(600)] + ["ééééééééé", "éééééééééé", "short", "", "\r"]
    docs = [(k, "\n".join(rng.choices(pool, k=rng.randrange(0, 12)))) for k in range(400)]
    return docs + [(None, "Line number 1\nonly here without id"), (None, "only here without id"), (3, "Line number 1\nown line of three")]


def test_lines_equal_plain_version(spark, docs_of, lined, odd_texts):
    for docs in (lined, odd_texts, odd_texts * 3):
        df = docs_of(docs).repartition(7)
        assert deduplicated(df) == plain_lines(docs)
    out = line_dedup.deduplicate(docs_of(lined))
    assert out.columns == [*(c for c in docs_of(lined).columns if c != "text"), "lines"]


def test_lines_with_a_full_filter(docs_of, lined):
    """All bits of the least filter set: everything is a suspect, nothing changes."""
    docs = lined + [(1000 + k, "\n".join(f"unique line {k} {j}" for j in range(400))) for k in range(300)]
    assert deduplicated(docs_of(docs), max_bits=1 << 16) == plain_lines(docs)


def test_lines_of_repeated_rows_and_of_nothing(docs_of):
    docs = [(9, "a line of nine\nand another of nine\n" * 20)] * 2000 + [(k, "a line of nine") for k in range(2000)]
    assert deduplicated(docs_of(docs)) == plain_lines(docs)
    assert deduplicated(docs_of([])) == []


def test_filters_of_tasks_merge():
    rng = np.random.default_rng(1)
    seen = [rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(3)]
    seen[1][:300] = seen[0][:300]
    once, twice = line_dedup.Bits(1 << 16), line_dedup.Bits(1 << 16)
    for hashes in seen[:2]:
        twice.add(hashes[once.holds(hashes)])
        once.add(hashes)
    parts = [line_dedup.Bits(1 << 16) for _ in range(2)]
    for p, hashes in zip(parts, seen):
        p.add(hashes)
    both = parts[0].data & parts[1].data
    assert (both & twice.data == twice.data).all() and (parts[0].data | parts[1].data == once.data).all()
    assert twice.holds(seen[0][:300]).all() and twice.holds(seen[2]).mean() < 0.05
    for p in parts:
        block = p.blocks()[0]
        assert (line_dedup._decoded(line_dedup._encoded(block)) == block).all()
    few = np.zeros(line_dedup.BLOCK // 8, np.uint8)
    few[[0, 77, 8191]] = 3, 128, 255
    assert len(line_dedup._encoded(few)) == 22 and (line_dedup._decoded(line_dedup._encoded(few)) == few).all()
