import math
import re
import zlib

import numpy as np
import pytest

from spinmill.llm import ngram_lm as lm
from spinmill.llm.queries import op2_lm_score


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
@pytest.mark.parametrize("top", [1, 100, 2**20, 2**63 - 1])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n + 1)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e = lm.EliasFano(*(lm.EliasFano.build(v)[k] for k in ("n", "l", "low", "high", "zeros", "ones")))
    if n:
        assert (e.get(np.arange(n)) == v).all()
    q = np.concatenate((v, rng.integers(0, top, 300, dtype=np.uint64), np.array([0, top], np.uint64)))
    have = set(v.tolist())
    at = e.find(q)
    for x, i in zip(q.tolist(), at.tolist()):
        assert (i >= 0) == (x in have) and (i < 0 or v[i] == x)


def test_pointers_and_words():
    """Ranges of successors, some empty and some longer than a word of bits, and searches within them."""
    rng = np.random.default_rng(5)
    sizes = rng.choice([0, 1, 2, 5, 63, 64, 65, 700], 400)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    e = lm.EliasFano(*(lm.EliasFano.build(edges, 0)[k] for k in ("n", "l", "low", "high", "zeros", "ones")))
    lo, hi = e.span(np.arange(len(sizes)))
    assert (lo == edges[:-1]).all() and (hi == edges[1:]).all()
    for top in (3000, 2**33, 2**40):
        own = [np.sort(rng.choice(top if top == 3000 else 10**6, k, replace=False).astype(np.uint64) * np.uint64(max(1, top // 10**6))) for k in sizes]
        w = lm.Words(**lm.Words.build(np.concatenate(own)))
        for i, v in enumerate(own):
            q = np.concatenate((v, v + np.uint64(1), [np.uint64(0)]))
            at = w.find(np.full(len(q), lo[i]), np.full(len(q), hi[i]), q)
            for x, k in zip(q.tolist(), at.tolist()):
                assert (k >= 0) == (x in set(v.tolist())) and (k < 0 or v[k - lo[i]] == x)


def test_selects():
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.integers(1, 2**63, 500, dtype=np.uint64), [np.uint64(2**64 - 1), np.uint64(1 << 63), np.uint64(1)]))
    for w in x.tolist():
        ones = [k for k in range(64) if w >> k & 1]
        assert lm.select_in_word(np.full(len(ones), w, np.uint64), np.arange(len(ones))).tolist() == ones


def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + [b""]


def plain_model(texts):
    """The estimates by dictionaries, without quantising."""
    uni, pair, three, docs = {}, {}, {}, 0
    for t in texts:
        docs += 1
        own = tokens(t)
        for k, w in enumerate(own):
            a, b = ([None, None] + own)[k : k + 2]
            uni[w] = uni.get(w, 0) + 1
            three.setdefault((a, b), {}).setdefault(w, 0)
            three[a, b][w] += 1
        three.setdefault((([None] + own)[-2], b""), {}).setdefault(None, 0)
        three[([None] + own)[-2], b""][None] += 1
    for (a, b), after in three.items():
        # A pair's count is that of its trigrams as a context.
        if b is not None:
            pair.setdefault(a, {})[b] = sum(after.values())
    off = lambda c: lm.DISCOUNTS[min(c, 3) - 1]
    n, v = sum(uni.values()), len(uni)

    def score(text):
        base = own_score = 0.0
        own, known = tokens(text), 0
        for k, w in enumerate(own):
            a, b = ([None, None] + own)[k : k + 2]
            c = uni.get(w, 0)
            known += c > 0
            p1 = (c + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p1)
            total = docs if b is None else uni.get(b, 0)
            after = pair.get(b, {})
            p = p1
            if total and after:
                p = (after[w] - off(after[w])) / total if w in after else 0.0
                p += sum(map(off, after.values())) / total * p1
            if (a, b) in three:
                own_three = three[a, b]
                t = sum(own_three.values())
                p = ((own_three[w] - off(own_three[w])) / t if w in own_three else 0.0) + sum(map(off, own_three.values())) / t * p
            own_score += math.log10(p)
        return len(own), known, base, own_score

    return n, score


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_dictionaries(spark, frame, rows, odd_rows, kind):
    data = odd_rows if kind == "odd" else rows
    got = lm.fit_and_score(spark, frame(data, extra=("score", "id") if kind == "odd" else ())).collect()
    held = lambda r: zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 1
    n, score = plain_model([r["text"] for r in data if not held(r)])
    want = sorted(((r["doc_id"], held(r), *score(r["text"])) for r in data), key=lambda x: (str(x[0]), x[4]))
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=lambda x: (str(x[0]), x[4]))
    assert len(have) == len(want) and {r["train_tokens"] for r in got} == {n}
    for h, w in zip(have, want):
        assert h[:4] == w[:4]
        assert h[4] == pytest.approx(w[4], rel=1e-9)
        # Quantised down, by up to a few thousandths of a decade a token.
        assert w[5] - 0.002 * w[2] <= h[5] <= w[5] + 1e-6


def test_distributions_sum_to_one_at_most(spark, frame):
    """Over all known words and the unknown one, in every context that a text offers."""
    texts = ["a b a c", "a b c", "b a", "c", ""]
    rows = [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": 0} for i, t in enumerate(texts)]
    model = lm.train(frame(rows))
    vocabulary = [b"a", b"b", b"c", b"", b"unknown"]
    import xxhash

    trie = lm.Trie(model)
    for context in ([], [b"a"], [b"a", b"b"], [b"c", b"c"], [b"zz"], [b"zz", b"a"]):
        total = 0.0
        for w in vocabulary:
            own = [*context, w]
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in own], np.uint64)
            total += 10 ** trie.probabilities(hashes, np.arange(len(own)), np.array([len(own)]))[2][-1]
        assert 0.98 < total <= 1 + 1e-9, (context, total)


def test_few_shards_kept_open(spark, frame, rows, monkeypatch):
    df = frame(rows[:30])
    model = lm.train(df, shard_tokens=500)
    want = sorted(map(tuple, lm.score(df, model).collect()))
    monkeypatch.setattr(lm, "MOST_OPEN", 2)
    trie = lm.Trie(model)
    for _, first, hashes, number, counts in lm.chunks(df.select("text").toArrow().to_batches()):
        trie.probabilities(hashes, number, counts)
        assert len(trie.open) <= 2
    assert sorted(map(tuple, lm.score(df, model).collect())) == want


def test_several_shards_agree(spark, frame, rows):
    df = frame(rows[:40])
    one = {r["doc_id"]: r["score"] for r in lm.score(df, lm.train(df)).collect()}
    many = {r["doc_id"]: r["score"] for r in lm.score(df, lm.train(df, shard_tokens=1000)).collect()}
    assert one.keys() == many.keys()
    assert all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)


def test_empty(spark, frame, odd_rows):
    assert lm.fit_and_score(spark, frame([])).count() == 0
    df = frame(odd_rows)
    got = lm.score(df, lm.train(df.limit(0))).collect()
    assert len(got) == len(odd_rows) and all(r["n_known"] == 0 and r["score"] == r["base_score"] == 0 for r in got)


def test_held_out_texts_gain(spark, sf):
    got = op2_lm_score(spark, sf).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]
