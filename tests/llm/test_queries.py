"""Registered queries: against their SQL, and the others against brute force."""

import collections
import hashlib
import html
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import oracle, same
from tokenizers import Tokenizer

import corpus_pipeline
from tallysift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def rows(sql):
    return duckdb.connect().execute(sql).fetchall()


@pytest.fixture(scope="module")
def documents():
    return rows(f"SELECT doc_id, text FROM '{SF}/documents.parquet'")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert same(QUERIES[name](spark, SF), oracle(SF, ORACLES[name])) is None


def test_rules_equal_sql_where_cutoffs_are_certified(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality_rules"](spark, sf)
    assert same(got, oracle(sf, ORACLES["op1_quality_rules"])) is None
    assert got.where("NOT kept AND NOT base_failed").count() > 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_quality_classifier"](spark, sf).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, q) for i, q in rows(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'") if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_packing_is_a_round_trip(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in documents}
    pieces = QUERIES["op3_packing"](spark, SF).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and zlib.crc32(own[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, p.length))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(own)
    sizes = []
    for s in range(len(by_seq)):
        at = 0
        for offset, length in sorted(by_seq[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 1024 for n in sizes[:-1]) and sizes[-1] <= 1024


def test_main_text(spark):
    want = {}
    for i, h in rows(f"SELECT page_id, html FROM '{SF}/pages.parquet'"):
        inner = re.sub(r"</?(p|h1|br)[^>]*>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        want[i] = " ".join(html.unescape(re.sub(r"<[^>]+>", "", inner)).split())
    got = {r.page_id: r for r in QUERIES["op4_main_text"](spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def brute_cut(texts, length=200):
    seen = collections.Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - length + 1):
            if seen[t[k:k + length]] > 1:
                covered[k] += 1
                covered[k + length] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark, documents):
    want = dict(zip((i for i, _ in documents), brute_cut([(t or "").encode() for _, t in documents])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op5_substrings"](spark, SF).collect()}
    assert got == want


def test_language_model_base(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in documents}
    words = {i: (t or "").encode().translate(LOWER).split() for i, t in documents}
    counts = collections.Counter(w for i in words if not held[i] for w in words[i])
    ends = sum(not h for h in held.values())
    total, types = sum(counts.values()) + ends, len(counts) + 1
    got = QUERIES["op6_backoff_lm"](spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        c = [counts[w] for w in words[r.doc_id]] + [ends]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(c), sum(x > 0 for x in c), total)
        assert r.base_score == pytest.approx(sum(math.log10((x + 1) / (total + types + 1)) for x in c), rel=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(pairs):
    """(id, fingerprint) to the least id reachable."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(pairs))]


def test_simhash(spark, documents):
    pairs = [(i, brute_fingerprint(t)) for i, t in documents]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(pairs, brute_classes(pairs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()} == want


def test_pipeline(spark, documents):
    """Each stage against what it must do to its own input."""
    docs, names = spark.read.parquet(f"{SF}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    kept = {r[0] for r in oracle(SF, ORACLES["op1_quality_rules"]).query("kept")[["doc_id"]].itertuples(index=False)}
    quality, near, passages, bench, packed = (f for _, f in corpus_pipeline.STAGES)
    first = quality(spark, docs, SF)
    a = sorted(first.collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in a} == kept and first.columns == docs.columns
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in a]
    second = near(spark, first, SF)
    b = sorted(second.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in b] == sorted(set(brute_classes(pairs))) and second.columns == docs.columns
    third = passages(spark, second, SF)
    c = sorted(third.collect(), key=lambda r: r.doc_id)
    cut = brute_cut([r.text.encode() for r in b])
    assert [r.doc_id for r in c] == [r.doc_id for r in b] and third.columns == docs.columns
    for before, after, (n, gone, _, digest) in zip(b, c, cut):
        assert after.n_chars == len(after.text)
        if not gone:
            assert after == before
        elif len(after.text.encode()) == n - gone:
            assert hashlib.sha256(after.text.encode()).hexdigest() == digest
    fourth = bench(spark, third, SF)
    third.write.mode("overwrite").parquet(path := f"{_scratch(spark)}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    clean = {r[0] for r in con.execute(
        f"SELECT doc_id FROM ({ORACLES['op8_decontaminate']}) WHERE NOT contaminated").fetchall()}
    assert {r.doc_id for r in fourth.collect()} == clean and fourth.columns == docs.columns
    last = packed(spark, fourth, SF).collect()
    assert {r.doc_id for r in last} == clean and len(names) == 5
    assert corpus_pipeline.run(spark, SF).count() == len(last)


def _scratch(spark):
    from tallysift.session import scratch_dir
    return scratch_dir(spark, "test")
