import random

import corpus_pipeline as cp
import numpy as np
import pytest
from spinmill.llm import similar as sh


def sets_of(texts, n=5):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in words]


def classes(texts, threshold=0.8):
    """Groups by all pairs' Jaccard similarity."""
    own, root = sets_of(texts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(own)):
        for j in range(i):
            if own[i] == own[j] or len(own[i] & own[j]) >= threshold * len(own[i] | own[j]) - 1e-9 and own[i] and own[j]:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(own))]


@pytest.fixture(scope="module")
def texts():
    """Copies of documents with 0 to 12 of 150 words replaced, around the threshold and beyond; a chain; short ones."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = [None, "", " ", "one two", "One  two", "one two three four five", "one two three four five six"]
    for _ in range(12):
        base = [word() for _ in range(150)]
        for k in range(9):
            copy = list(base)
            for at in rng.sample(range(150), k // 2 * 2):
                copy[at] = word()
            out.append(" ".join(copy[: 150 - k]))
    chain = [word() for _ in range(200)]
    out += [" ".join(chain[k * 15 :] + [f"w{k}x{j}" for j in range(k * 15)]) for k in range(6)]
    shared = [word() for _ in range(60)]  # one passage in many documents
    out += [" ".join(shared + [word() for _ in range(40)]) for _ in range(30)]
    rng.shuffle(out)
    return out


def test_stage_against_brute_force(spark, frame, sf, texts):
    data = [{"doc_id": i, "text": t, "lang": None, "source": "a", "n_chars": None} for i, t in enumerate(texts)]
    got = sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, frame(data), sf).collect())
    assert got == sorted(set(classes(texts))) and len(got) < len(texts)


def test_tiles_and_large_groups(spark, texts, monkeypatch):
    """Small tiles, and groups compared by rows of queries, give the same groups."""
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string").repartition(3)
    want = classes(texts)
    for tile, small in ((3, 192), (2048, 2)):
        monkeypatch.setattr(sh, "TILE", tile)
        monkeypatch.setattr(sh, "SMALL", small)
        group = {r["k"]: r["group"] for r in sh.similar_groups(df, "k").collect()}
        assert len(set(zip(want, (group[i] for i in range(len(want)))))) == len(set(want)) == len(set(group.values()))


def test_close_pairs_of_any_group():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 700, dtype=np.uint64)
    fp[350:] = fp[:350] ^ (np.uint64(1) << rng.integers(0, 63, 350).astype(np.uint64))
    group = np.sort(np.where(np.arange(700) % 2, 5, rng.integers(0, 12, 700) ** 2))  # one of over 350
    n = rng.integers(80, 130, 700)
    got = {(max(i, j), min(i, j)) for part in sh.close_pairs(group, fp, n, 0.8, 26) for i, j in zip(part[0].tolist(), part[1].tolist())}
    want = {(i, j) for i in range(700) for j in range(i) if group[i] == group[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 26 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
    assert got == want


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_groups_of_a_table(spark, rows, texts, threshold):
    all_texts = [r["text"] for r in rows] + texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate(all_texts)], "k bigint, text string")
    group = {r["k"]: r["group"] for r in sh.similar_groups(df, "k", similarity=threshold).collect()}
    want = classes(all_texts, threshold)
    assert len(group) == len(all_texts)
    assert len(set(zip(want, (group[i] for i in range(len(want)))))) == len(set(want)) == len(set(group.values()))
