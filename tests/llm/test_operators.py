"""Operators by themselves: odd rows, empty tables, hot groups, and the parts of each method."""

import collections
import gzip
import math
import os
import random
import re
import tempfile
import time
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_queries import brute_classes, brute_cut, brute_fingerprint

from tallysift.llm import (backoff_lm, block_labeller, decontaminate, packing, page_blocks, perspectives, quality_classifier,
                           quality_rules, simhash, substrings, warc)
from tallysift.llm.common import noted, stored
from tallysift.llm.components import roots
from tallysift.session import scratch_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = 13


@pytest.fixture(scope="module")
def odd(docs_of, odd_texts):
    return docs_of(odd_texts).persist()


@pytest.fixture(scope="module")
def none(docs_of):
    return docs_of([])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 1, 0), (7, 0, None), (None, 1, 0), (9, None, 0), (5, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def test_rules_on_odd_rows(odd, none, labels):
    got = quality_rules.apply_rules(odd, labels, keep=["doc_id"]).collect()
    assert len(got) == ODD
    by = collections.Counter((r.doc_id, r.n_words, r.base_failed, r.kept) for r in got)
    assert by[(1, 0, True, False)] == 1 and by[(4, 1, True, False)] == 2 and by[(6, 60_000, False, True)] == 1
    assert [r.n_repeat_words for r in got if r.doc_id == 9 and r.n_words == 300] == [300]
    kept = quality_rules.kept_documents(odd, labels)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {6, 7}
    assert quality_rules.kept_documents(none, labels).count() == 0
    assert quality_rules.kept_documents(odd, labels.limit(0)).count() == 2


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 40, 700, 3000) for k in (0, 1, 2, 7, 30, 31) if k <= n]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        exact = sum(math.comb(r.n, j) * 0.01 ** j * 0.99 ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * 0.01 else 1
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_rules_certify_with_enough_labels(spark):
    """2,000 clean and 200 shouting documents in one stratum, too few labels in the other."""
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(k, say(60) if k % 11 else say(60).upper(), "a" if k < 2200 else "b") for k in range(2220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 11 > 0)) for k in range(2220)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels).collect()}
    assert all(got[k] == (k % 11 > 0) for k in range(2200)) and all(got[k] for k in range(2200, 2220))


def test_classifier_on_odd_rows(odd, none, labels):
    everything = F.lit(True)
    model = quality_classifier.fit(odd, labels, everything)
    got = quality_classifier.score(odd, model, name="quality_score").collect()
    assert len(got) == ODD and all(0 <= r.quality_score <= 1 for r in got)
    for few in (labels.limit(0), labels.where("quality = 1")):
        flat = quality_classifier.fit(odd, few, everything)
        assert len({r.s for r in quality_classifier.score(odd, flat, name="s", keep=[]).collect()}) == 1
    assert quality_classifier.score(none, model, name="s").count() == 0
    assert quality_classifier.fit(none, labels, everything).bias == 0


def test_long_rows_leave_room_for_others(docs_of, spark):
    """A long text first in line neither ends the sample nor crowds a class out."""
    within = quality_classifier.within
    assert within([(1, 1, 90), (2, 1, 20), (3, 0, 30), (4, 1, 10), (5, 0, 25)], 100) == [2, 3, 4, 5]
    assert within([(1, 1, 90), (2, 0, 5)], 200) == [1, 2] and within([(k, k % 2, 1) for k in range(9)], 100) == list(range(9))
    assert within([], 10) == [] and within([(7, 1, 3), (7, 1, 3), (8, 0, 1)], 12) == [7, 8]
    with pytest.raises(ValueError):
        within([(1, 1, 60), (2, 0, 5)], 100)
    texts = [(k, f"{'good words here' if k % 2 else 'BAD! stuff! $$'} {k} " * (3 if k % 10 else 400)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_classifier.fit(docs_of(texts), labels, F.lit(True), fit_nonzeros=600)
    got = {r.doc_id: r.s for r in quality_classifier.score(docs_of(texts), model, name="s", keep=["doc_id"]).collect()}
    assert sum((got[k] > 0.5) == (k % 2 == 1) for k in got) >= 58
    with pytest.raises(ValueError):
        quality_classifier.fit(docs_of(texts), labels, F.lit(True), fit_nonzeros=10)


def test_indicators_are_per_document():
    texts = [b"Some words here", None, b"", b"A!! B!!\nA!! B!!\nA!! B!!", b"some words here"]
    together = quality_classifier.indicators(texts)
    for k, t in enumerate(texts):
        assert together[1][together[0] == k].tolist() == quality_classifier.indicators([t])[1].tolist()


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 6, replace=False)) for _ in range(80)]
    y = np.where(np.array([r.min() for r in rows]) < 5, 1.0, -1.0)
    scale = np.concatenate([rng.normal(size=50), np.zeros(quality_classifier.SIZE - 50)])
    w = quality_classifier.descend(rows, y, scale, epochs=2000, tolerance=1e-8)
    x = np.zeros((80, 51))
    for k, r in enumerate(rows):
        x[k, r] = scale[r] / np.linalg.norm(scale[r])
    x[:, 50] = 1
    v = np.append(w[:50], w[-1])
    loss = lambda u: u @ u / 2 + np.maximum(0, 1 - y * (x @ u)).sum()
    assert all(loss(v) <= loss(v + 0.01 * rng.normal(size=51)) + 1e-9 for _ in range(200))


def test_packing_odd_rows(odd, none):
    got = packing.pack(odd, TOKENIZER).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert packing.pack(none, TOKENIZER).count() == 0
    seqs = packing.sequences(packing.pack(odd, TOKENIZER)).collect()
    assert all(len(s.ids) == 4 * s.length for s in seqs) and sum(s.length < 1024 for s in seqs) == 1


def test_packing_encoder_equals_the_library():
    encode, rng = packing.encoder(TOKENIZER), random.Random(3)
    alphabet = "ab 1\n\t'sÉß½٣　!?.-_<|>\x0b\x85\xa0 " + "the "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in [*texts, "a <|endoftext|> b", "don't   we'll\n\n x²"]:
        assert np.frombuffer(encode(t), encode.type).tolist() == encode.whole.encode(t, add_special_tokens=False).ids


def test_round_robin_keeps_the_shares():
    plan = packing.Plan({"a": 500_000, "b": 90_000, "c": 7_000, None: 130}, {"a": 1, "b": 1, "c": 0.1, None: 0.01}, 1024, 128)
    at = {q: plan.place(k, np.arange(plan.grains[k])) for q, k in plan.index.items()}
    assert np.array_equal(np.sort(np.concatenate(list(at.values()))), np.arange(sum(plan.grains)) * 128)
    assert all((np.diff(p) > 0).all() for p in at.values())
    for q, share in (("a", 1 / 2.11), ("b", 1 / 2.11), ("c", 0.1 / 2.11)):
        for window in (3, 50, 140):
            assert abs((at[q] < window * 1024).sum() * 128 - share * window * 1024) <= 4 * 128
    # a stretch is placed alike from any partition
    whole = plan.pieces(1, 500, 3000)
    halves = [plan.pieces(1, 500, 1300), plan.pieces(1, 1800, 1700)]
    assert sum(whole[1]) == sum(halves[0][1]) + sum(halves[1][1]) and whole[2][0] == halves[0][2][0]


def pages_of(spark, texts):
    return spark.createDataFrame([(k, f"http://x/{k}", t, 1) for k, t in enumerate(texts)],
                                 "page_id long, url string, html string, _src int")


def test_main_text_of_odd_pages(spark):
    weights = block_labeller.train(page_blocks.invented(200, 5))
    article = "<article><h1>Head</h1><p>First&nbsp;<b>bold</b>ly &lt;x&gt;.<br>Next<p>Last <a href=x>link</a> words.</article>"
    texts = [None, "", "plain words only", "<p>" * 3000 + "deep", f"<body><nav><ul><li><a>Menu</a></ul></nav>{article}"
             "<aside>side</aside><div id='comments'><p>I think.</p></div><script>if (a<b) x('</p>')</script><footer>foot</footer>",
             "<a href='unclosed>", "<!-- never ends <p>x</p>"]
    pages = pages_of(spark, texts)
    got = {r.page_id: r.t for r in block_labeller.extract(pages, weights, name="t").collect()}
    assert got[0] == got[1] == got[6] == "" and len(got) == 7
    assert got[4] == "Head First boldly <x>. Next Last link words."
    assert block_labeller.extract(pages.limit(0), weights).count() == 0


@pytest.mark.parametrize("before", [
    "<datalist><option value=a><option value=b></datalist>", "<option>", "<div><select><option>x</select></div>", "<noscript>", "<svg>",
    "<object>", "<template>", "<div><script>if (a<b) f()</div>", "<option>x<p>y</p></option>"])
def test_silent_elements_without_end_tag_cut_nothing(before):
    article = "<article><p>First words.</p><p>Last words.</p></article>"
    page = f"<html><body>{before}{article}</body></html>"
    found = page_blocks.blocks_of(page)
    assert [t for t, path, _ in found if "article" in path and "option" not in path] == ["First words.", "Last words."]
    assert not any("f()" in t for t, _, _ in found)


def test_deep_blocks_and_containers_inside_the_article():
    deep = "".join(f"<div class='row-{k} col wide box'>" for k in range(12))
    close = "</div>" * 12
    parts = [(f"<nav>{deep}<p>Menu</p>{close}</nav>", 0), (f"{deep}<p>Long words of the article.</p>{close}", 1),
             ("<div class='comments'><p>I think.</p></div>", 0), (f"<div id='ad-1'>{deep}<p>Buy.</p>{close}</div>", 0),
             ("<div class='cookie-notice'>We use.</div>", 0), ("<p>More words of it.</p>", 1)]
    page = page_blocks.blocks_of("<body class='with-sidebar'><main class='no-ads'>" + "".join(p for p, _ in parts) + "</main></body>")
    assert block_labeller.by_elements(page).tolist() == [y for _, y in parts]
    made = [b for page, _ in page_blocks.invented(200, 5) for b in page]
    assert any({"article", "main"} & set(path) and {".comments", ".comment"} & set(path) for _, path, _ in made)
    assert max(len(path) for _, path, _ in made) > 24


def test_labeller_gradients_and_held_out_pages():
    rng = np.random.default_rng(2)
    w = {k: v * 3 for k, v in block_labeller.new_weights(rng).items()}
    pages = page_blocks.invented(4, 8)
    f, y = page_blocks.Features([b for b, _ in pages]), np.concatenate([y for _, y in pages])
    loss = lambda: -np.mean(np.log(np.where(y > 0, (p := block_labeller.Pass(w, f).p), 1 - p)))
    grad = block_labeller.Pass(w, f, keep=True).back(y)
    for name in w:
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[name][at], rel=1e-3)
    trained, unseen = block_labeller.train(page_blocks.invented(300, 5)), page_blocks.invented(100, 77)
    p = block_labeller.Pass(trained, page_blocks.Features([b for b, _ in unseen])).p
    assert np.mean((p >= 0.5) == (np.concatenate([y for _, y in unseen]) > 0)) > 0.98


def planted(seed=4):
    """Texts with shared passages, near copies, copies and repetition inside one text."""
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, base, short = say(450), say(1500), say(205)
    texts = [say(300) + passage + say(rng.randrange(300)) for _ in range(40)]
    texts += [base[:k * 30] + say(3) + base[k * 30:] for k in range(30)] + [base] * 5
    texts += [short, short + "x", "y" + short[:-1], "z" * 900, say(150) * 4, say(199), "", None, passage[:200], passage[1:200]]
    return texts


@pytest.mark.parametrize("bucket_rows", [1, 5, 4096])
def test_substrings_with_small_and_split_buckets(spark, docs_of, bucket_rows):
    texts = planted()
    docs = docs_of([(k, t) for k, t in enumerate(texts)])
    got = {r.doc_id: (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256) for r in substrings.deduplicate(
        docs, bucket_rows=bucket_rows).collect()}
    assert got == dict(enumerate(brute_cut([(t or "").encode() for t in texts])))


def test_substrings_on_odd_rows(odd, none, odd_texts):
    want = collections.Counter((i, *x[:3]) for (i, _), x in zip(odd_texts, brute_cut([(t or "").encode() for _, t in odd_texts])))
    got = substrings.deduplicate(odd).collect()
    assert collections.Counter((r.doc_id, r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans) for r in got) == want
    rest = substrings.without_repeats(odd)
    assert rest.columns == odd.columns and sum(r.text is None for r in rest.collect()) == 2
    assert substrings.without_repeats(none).count() == 0


def test_long_texts_are_cut_into_stretches(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 5000)
    rng = random.Random(9)
    text = bytes(rng.randrange(256) for _ in range(23_000))
    starts = []
    for data, begins, number, offset in substrings._groups([b"x", text, b"y" * 300], 200):
        h, o, anchor, first, last = substrings.anchors(data, begins[:-1], begins[1:], 200)
        part = np.searchsorted(begins, first, "right") - 1
        for a, z, p in zip(first, last, part):
            starts += [(number[p], k - begins[p] + offset[p]) for k in range(a, z + 1)]
    assert sorted(starts) == [(1, k) for k in range(22_801)] + [(2, k) for k in range(101)]


def test_language_model_on_odd_rows(odd, none):
    got = backoff_lm.score(odd, ~backoff_lm.held_out()).collect()
    assert len(got) == ODD and all(r.lm.score <= 0 and r.lm.n_tokens >= 1 for r in got)
    assert backoff_lm.score(none, F.lit(True)).count() == 0
    untrained = backoff_lm.score(odd, F.lit(False)).collect()
    assert all(r.lm.score == r.lm.base_score == 0 and r.lm.n_known == 0 for r in untrained)


def test_automaton_sums_to_one_and_equals_recursion():
    rng = random.Random(5)
    head = backoff_lm.Head([b"a", b"b", b"c"])
    texts = [[rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(rng.randrange(9))] for _ in range(60)]
    size, pairs, triples, words = head.size, collections.Counter(), collections.Counter(), collections.Counter()
    for t in texts:
        s = head.sequence(t).tolist()
        words.update(s)
        pairs.update(a * size + b for a, b in zip(s, s[1:]) if a >= 0 and b >= 0)
        triples.update((a * size + b) * size + c for a, b, c in zip(s, s[1:], s[2:]) if min(a, b, c) >= 0)
    pairs = {g: n for g, n in pairs.items() if n >= 4}
    triples = {g: n for g, n in triples.items() if n >= 3 and g // size in pairs and g % (size * size) in pairs}
    total = sum(n for w, n in words.items() if w != head.start)
    history = np.array([words[k] for k in range(5)])
    unigrams = np.log10((history + 1.0) / (total + 6))
    unigrams[head.start] = -99
    auto = backoff_lm.Automaton(head, unigrams, history, pairs, triples)
    for text in ([], [b"a"], [b"b", b"c"], [b"a", b"z"], [b"c", b"a", b"b"]):
        s = head.sequence(text).tolist()[1:-1]
        before = auto.score(s, [unigrams[w] if w >= 0 else -3.0 for w in s])
        grown = [10 ** (auto.score(s + [w], [unigrams[x] if x >= 0 else -3.0 for x in s] + [unigrams[w]]) - before)
                 for w in (0, 1, 2, head.end)]
        rest = 10 ** (auto.score(s + [-1], [unigrams[x] if x >= 0 else -3.0 for x in s] + [
            math.log10(1 - sum(10 ** unigrams[w] for w in (0, 1, 2, head.end)))]) - before)
        assert sum(grown) + rest == pytest.approx(1, rel=1e-9)


def test_substrings_of_rows_repeated_in_bulk(docs_of):
    """2,000 rows alike, with and without an id, beside others that share a part: the cost is that of their bytes."""
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(7, text)] * 1500 + [(None, text)] * 500 + [(8, text[500:1500] + "x" * 150), (9, "y" * 150 + text[:300]), (10, text[:150])]
    got = collections.Counter((r.doc_id, *r.cut[:4]) for r in substrings.deduplicate(docs_of(rows), keep=["doc_id"], rest_as=None).collect())
    want = brute_cut([text.encode(), text.encode(), *(t.encode() for _, t in rows[2000:])])
    assert got == collections.Counter({(7, *want[0]): 1500, (None, *want[0]): 500, **{(i, *w): 1 for (i, _), w in zip(rows[2000:], want[2:])}})


def test_substrings_of_texts_without_id_that_share_31_bits(docs_of):
    """Texts under one id, or none, are told apart by all of their hash; these two share its upper 31 bits."""
    passage = " ".join(f"w{k * k % 89}" for k in range(90))
    texts = [f"122748:{passage}", f"{passage}:201567", "x" * 40]
    docs = docs_of([(None, t) for t in texts])
    bits = docs.select(F.shiftrightunsigned(F.xxhash64("text", F.lit(True)), 33).alias("bits"))
    assert bits.distinct().count() == 2
    got = substrings.deduplicate(docs, keep=["doc_id"], rest_as=None).collect()
    assert collections.Counter(tuple(r.cut[:4]) for r in got) == collections.Counter(brute_cut([t.encode() for t in texts]))


def test_language_model_keeps_every_gram_seen_twice(docs_of):
    """Against an automaton of all counts, over several chunks; the grams have shares far below 1e-5 of the tokens."""
    rng = random.Random(8)
    rare = [f"rare{k} pair{k} goes{k} on" for k in range(40)] * 2
    filler = [" ".join(rng.choice(("aa", "bb", "cc", "dd")) for _ in range(30_000)) for _ in range(12)]
    texts = rare + filler + ["", "rare3 pair3 goes3 off", "pair5 goes5 on on", "aa new bb"]
    got = {r.doc_id: r.lm for r in backoff_lm.score(docs_of(list(enumerate(texts))), F.col("doc_id") < len(texts) - 3).collect()}
    train = [backoff_lm.words_in(t.encode()) for t in texts[:-3]]
    counts = collections.Counter(w for t in train for w in t)
    head, end = backoff_lm.Head(sorted(w for w, n in counts.items() if n > 1)), len(train)
    size, pairs, triples = head.size, collections.Counter(), collections.Counter()
    for t in train:
        s = head.sequence(t).tolist()
        pairs.update(a * size + b for a, b in zip(s, s[1:]) if a >= 0 and b >= 0)
        triples.update((a * size + b) * size + c for a, b, c in zip(s, s[1:], s[2:]) if min(a, b, c) >= 0)
    pairs, triples = ({g: n for g, n in x.items() if n > 1} for x in (pairs, triples))
    norm = math.log10(sum(counts.values()) + end + len(counts) + 2)
    history = np.array([counts[w] for w in head.ids] + [end, end])
    auto = backoff_lm.Automaton(head, np.log10(history + 1.0) - norm, history, pairs, triples)
    for k, t in enumerate(texts):
        words = backoff_lm.words_in(t.encode())
        single = [math.log10(counts[w] + 1) - norm for w in words] + [math.log10(end + 1) - norm]
        assert got[k].base_score == pytest.approx(sum(single), rel=1e-9)
        assert got[k].score == pytest.approx(auto.score(head.sequence(words).tolist()[1:], single), rel=1e-9)


def test_language_model_answers_take_a_part_of_the_texts(docs_of):
    """Scratch tables hold answers alone, packed: a small part of the texts."""
    rng = random.Random(5)
    texts = [" ".join(f"w{int(1000 * rng.random() ** 2)}" for _ in range(400)) for _ in range(1000)]
    paths: list[str] = []
    with noted(paths):
        scored = backoff_lm.score(docs_of(list(enumerate(texts))), F.col("doc_id") % 7 != 2, keep=["doc_id"])
    size = sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet"))
    assert paths and 0 < size < 0.15 * sum(map(len, texts))
    assert scored.count() == len(texts)


def test_pigeonring_keeps_every_close_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for bits in (0, 1, 2):
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
        assert simhash.viable(a ^ b).all() and simhash.linked(a, b).all()
        assert all(any((int(x) ^ int(y)) & m == 0 for m in simhash.KEYS) for x, y in zip(a[:300], b[:300]))
    assert not simhash.linked(a, ~a).any() and len(simhash.KEYS) == 15


def test_large_bucket_equals_all_pairs():
    rng, mask = np.random.default_rng(2), simhash.KEYS[3]
    free = np.uint64(~mask & (1 << 64) - 1)
    fps = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) & free & np.uint64(0xFF00FF00FF0F0F0F) | np.uint64(mask & 1))
    fps = np.unique(np.concatenate([fps, fps ^ np.uint64(int(free) & -int(free))]))
    u, v = simhash.large_bucket(fps, mask)
    classes = lambda pairs: len(set(brute_classes(pairs)))
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(u, v):
        parent[find(int(x))] = find(int(y))
    assert len({find(int(f)) for f in fps}) == classes([(k, int(f)) for k, f in enumerate(fps)])


def test_simhash_classes_and_one_of_each(spark, docs_of, odd, none, odd_texts):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    near = [(100 + k, " ".join(words[:k] + ["zzz"] + words[k:])) for k in range(0, 300, 4)]
    rows = [*odd_texts, *near, *((500 + k, "the same words again") for k in range(40)), *(
        (700 + k, " ".join(rng.choice(words) for _ in range(30))) for k in range(60))]
    pairs = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    want = collections.Counter(zip((i for i, _ in pairs), brute_classes(pairs)))
    docs = docs_of(rows)
    got = [r for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows) and collections.Counter((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == want
    one = simhash.keep_one(docs)
    kept = one.collect()
    assert one.columns == docs.columns and {r.doc_id for r in kept if r.doc_id is not None} == {c for _, c in want}
    # id 9 stands for two classes, and one class has null ids only
    assert len(kept) == len({c for _, c in want}) + 2 and [r.text for r in kept if r.doc_id is None] == ["one two"]
    assert simhash.keep_one(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (2001, 2000)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 50)}, 2001: 2000}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_in_one_and_several_blocks(spark, docs_of, odd, none, block_bytes):
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "Été", "x1", "delta"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 2, 5, 13, 14, 30])))) for k in range(40)] + [(None, "beta, beta; beta"), (7, None), (8, "!!")]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    texts = [(k, " ".join(say(400))) for k in range(20)] + [(50, ", ".join(items[1][1].upper().split())), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    got = {r.doc_id: r.found for r in decontaminate.find(docs_of(texts), bench, block_bytes=block_bytes).collect()}
    for i, t in texts:
        w, hit, names = split(t), set(), set()
        for item, it in items:
            p = split(it)
            for s in range(max(1, len(p) - 12) if p else 0):
                win = p[s:s + 13]
                for k in range(len(w) - len(win) + 1):
                    if w[k:k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        names |= {str(item)} if item is not None else set()
        f = got[i]
        assert (f.n_words, f.n_hit, f.items) == (len(w), len(hit), sorted(names))
        assert sum(b - a for a, b in f.runs) == len(hit)
        assert f.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == ODD
    assert decontaminate.clean(none, bench).count() == 0 and decontaminate.clean(odd, bench.limit(0)).count() == ODD


def test_archives_round_trip(spark):
    big = "<p>" + "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (3, None, big), (4, "u", None), (5, "u", ""),
            (6, "u", "small"), (7, "u", "small"), (None, "n", big), (None, "n", "x" * 3000), (8, "http://b/", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.archive(pages)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows)
    full = {(r.headers["X-Page-Id"], bytes(r.payload).decode()) for r in got if r.record_type == "response" and "X-Page-Id" in r.headers}
    assert full == {("3", big), ("4", ""), ("5", ""), ("6", "small"), ("7", "small"), ("8", "y" * 300_000)}
    again = [(r.headers.get("X-Page-Id"), r.headers["X-Refers-To-Page"], r.refers_to) for r in got if r.record_type == "revisit"]
    assert sorted(again, key=str) == [("1", "3", "<urn:page:3>"), ("2", "3", "<urn:page:3>"), (None, "3", "<urn:page:3>")]
    assert {r.target_uri for r in got if r.target_uri and "a/2" in r.target_uri} == {"http://a/2%0D%0AX:%20y"}
    read = warc.read(spark, path, payload=False)
    for condition, n in (("record_type = 'revisit'", 3), ("target_uri LIKE 'http://a%'", 2), ("record_id IN ('<urn:page:6>')", 1),
                         ("record_type = 'response' AND payload_length > 1000", 4)):
        found = read.where(condition).collect()
        assert len(found) == n and all(r.payload is None for r in found)
    empty = warc.archive(pages.limit(0))
    assert warc.read(spark, empty).count() == 0


def test_archives_of_other_writers(spark, tmp_path):
    def one(kind, body, extra=""):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\n{extra}Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    all_ = [one("warcinfo", b"software: x"), one("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 20_000, "Content-Type: application/http\r\n"),
            one("resource", b"plain", "WARC-Target-URI: http://q/\r\nX-Folded: a\r\n b\r\n")]
    (tmp_path / "plain.warc").write_bytes(b"".join(all_))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, all_)))
    got = warc.read(spark, str(tmp_path)).collect()
    sizes = collections.Counter((r.record_type, len(r.payload)) for r in got)
    assert sizes == {("warcinfo", 11): 2, ("response", 20_000): 2, ("resource", 5): 2}
    assert warc.read(spark, str(tmp_path)).where("record_type = 'resource'").first().headers["X-Folded"] == "a b"


@pytest.mark.parametrize("level", [0, 6])
def test_archives_of_payloads_that_do_not_compress(tmp_path, level):
    from pyarrow import fs

    payload = random.Random(3).randbytes(100_000)
    row = {"record_type": "response", "record_id": "<urn:x>", "target_uri": "http://x/", "payload_digest": None,
           "payload_length": None, "headers": [("X-Long", "h" * 3000)], "payload": payload}
    (tmp_path / "own.warc.gz").write_bytes(warc.member(warc.record(row), level) * 2)
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(warc.record(row), level) * 2)
    for name in ("own", "other"):
        with fs.LocalFileSystem().open_input_file(str(tmp_path / f"{name}.warc.gz")) as f:
            assert [p for _, p in warc.records(f, lambda _: True, True)] == [payload] * 2
            assert len([p for _, p in warc.records(f, lambda _: True, False) if p is None]) == 2


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "<|end|> yo"), (1, 1, "bob", "<|end|> yo"), (1, 2, "system", "be nice"),
            (1, 70, None, None), (2, 0, "system", "alone"), (None, None, "x|>", "")] + [(3, 5, "hot", f"t{k}") for k in range(50)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = perspectives.rotate(turns, chunk_rows=20).collect()
    by = {(r.conv_id, r.participant, r.chunk): r for r in got if r.conv_id != 3}
    assert set(by) == {(1, p, c) for p in ("ann", "bob", "unknown") for c in (0, 1)} | {(None, "x|>", None)}
    bob = by[(1, "bob", 0)]
    assert bob.rendered.startswith("<|user:ann|>\nhi<|end|>\n<|assistant|>\n<\\|end|> yo<|end|>\n")
    assert [bob.rendered[a:a + n] for a, n in bob.mask] == ["<\\|end|> yo<|end|>\n"] * 2 and bob.n_own == 2 and bob.n_turns == 4
    hot = [r for r in got if r.conv_id == 3]
    assert len(hot) == 3 and sum(r.n_turns for r in hot) == 50 and max(r.n_turns for r in hot) < 40
    assert perspectives.rotate(turns.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 7])
def test_parts_of_large_chunks_follow_each_other(spark, tasks):
    rows = [(c, n, "ab"[k % 2], f"t{k % 90:03d}") for c, n in ((1, 5), (None, 5), (2, None)) for k in range(500)]
    turns = spark.createDataFrame(rows + [(3, 1, "a", "x")], "conv_id long, turn long, role string, text string").repartition(tasks)
    whole = {(r.conv_id, r.participant, r.chunk): r for r in perspectives.rotate(turns, chunk_rows=None).collect()}
    parts = collections.defaultdict(list)
    for r in sorted(perspectives.rotate(turns, chunk_rows=120).collect(), key=lambda r: r.part):
        parts[(r.conv_id, r.participant, r.chunk)].append(r)
    assert len(whole) == 7 and set(parts) == set(whole)
    for key, found in parts.items():
        assert "".join(r.rendered for r in found) == whole[key].rendered
        assert [r.n_turns for r in found] == ([1] if key[0] == 3 else [120] * 4 + [20])
        assert [r.part for r in found] == list(range(len(found)))


def test_large_chunks_come_in_parts(spark, tmp_path):
    """Turns without a number and turns that share one: parts of 4,096, as the SQL says, and whole chunks on wish."""
    from compare import same
    from tallysift.llm.queries import ORACLES, op10_perspectives

    rows = [(1, None, "ab"[k % 2], f"t{k:05}") for k in range(5000)] + [(None, 70, "a", f"s{k % 3000:05}") for k in range(4500)]
    df = spark.createDataFrame(rows + [(2, 3, "a", "x")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = op10_perspectives(spark, str(tmp_path))
    assert same(got, con.execute(ORACLES["op10_perspectives"]).df()) is None
    assert sorted((r.participant, r.part, r.n_turns) for r in got.where("conv_id = 1").collect()) == [
        ("a", 0, 4096), ("a", 1, 904), ("b", 0, 4096), ("b", 1, 904)]
    odd = perspectives.rotate(df.withColumnRenamed("conv_id", "part"), conv="part")
    assert odd.columns[:4] == ["part", "participant", "chunk", "part_"] and odd.count() == got.count()
    whole = perspectives.rotate(df, chunk_rows=None).where("conv_id = 1").collect()
    assert [(r.n_turns, r.n_own) for r in whole] == [(5000, 2500)] * 2


def test_scratch_folder_is_new_each_time(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_language_model_asks_for_grams_in_few_bytes():
    """Frequent words have the small numbers of their part, and 2-grams are laid without losing that."""
    words, counts = [b"a", b"b", b"c", b"d"], np.array([2, 1, 9, 5])
    block = (backoff_lm.WORDS, 0, 0, 4, pa.compress(b" ".join(words), codec="zstd", asbytes=True), backoff_lm.laid_bytes(counts, np.full(4, 7)))
    reply, = backoff_lm.tally(backoff_lm.blocks_table([block]), 2).column("reply").to_pylist()
    counted, rank = backoff_lm.read_reply(backoff_lm.WORDS, reply, 4).tolist()
    assert counted == [2, 1, 9, 5] and (rank[0], *rank[2:]) == (2, 0, 1)

    rng = np.random.default_rng(3)
    first, last = rng.integers(0, 2_000, 5_000) ** 2, (60_000 * rng.random(5_000) ** 4).astype(np.int64)
    for grams in (np.unique((first << backoff_lm.BITS) + last), np.zeros(0, np.int64), np.array([0, 1, backoff_lm.LAST])):
        laid = backoff_lm.laid_grams(grams)
        assert backoff_lm.read_grams(laid, len(grams)).tolist() == grams.tolist()
        assert len(grams) < 100 or len(laid) < 0.8 * len(backoff_lm.laid_bytes(np.diff(grams, prepend=0)))


def test_language_model_leaves_no_shuffles_of_what_it_stored(spark):
    """Shuffle files of the questions go as soon as the answers are stored, and the session's setting is as before."""
    def files():
        local = Path(spark.sparkContext.getConf().get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir())
        return {*local.glob("**/blockmgr-*/*/shuffle_*.data")}

    setting, before = spark.conf.get(backoff_lm.FREED, None), files()
    with backoff_lm.shuffles_freed(spark):
        rows = stored(spark.range(5_000).repartition(7, "id"), "freed")
    end = time.monotonic() + 30
    while (left := files() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left and rows.count() == 5_000 and spark.conf.get(backoff_lm.FREED, None) == setting
