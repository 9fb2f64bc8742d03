import hashlib
import random

import numpy as np
import pytest

from spinmill.llm import suffix_dedup as sd


def brute(texts, length):
    count = {}
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for b in raws:
        spans = sd.merged([(s, s + length) for s in range(len(b) - length + 1) if count[b[s : s + length]] > 1])
        edges = [0, *(x for s in spans for x in s), len(b)]
        kept = b"".join(b[a:z] for a, z in zip(edges[::2], edges[1::2]))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("kind", "length"), [("odd", 400), ("odd", 40), ("table", 400)])
def test_against_brute_force(spark, frame, rows, odd_rows, kind, length):
    data = odd_rows if kind == "odd" else rows
    got = sd.suffix_dedup(frame(data, extra=("t", "id", "spans") if kind == "odd" else ()), length=length).collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(data, brute([r["text"] for r in data], length))), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_passages_in_other_surroundings(spark, frame):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (399, 400, 401, 520, 1000)]
    texts = [noise(rng.randint(0, 300)) + rng.choice(passages) + noise(rng.randint(0, 300)) + rng.choice(passages) for _ in range(60)]
    data = [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": 0} for i, t in enumerate(texts)]
    got = sorted(sd.suffix_dedup(frame(data)).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute(texts, 400)


def test_empty_table(spark, frame):
    assert sd.suffix_dedup(frame([])).count() == 0


@pytest.mark.parametrize("bound", [4, 10**6])
def test_suffix_order_and_prefixes(bound, tmp_path):
    rng = random.Random(bound)
    for _ in range(150):
        t = [rng.randint(0, rng.choice([0, 1, 2, 6])) for _ in range(rng.randint(1, 50))]
        parts = list(sd.suffix_order(np.array(t), 1000, str(tmp_path / "q"), bound))
        order = np.concatenate([p for p, _ in parts]).tolist()
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = np.concatenate([x for _, x in parts]).tolist()
        for a, b, k in zip(order, order[1:], lcp[1:]):
            assert t[a : a + k] == t[b : b + k] and t[a + k : a + k + 1] != t[b + k : b + k + 1]
    assert not list(tmp_path.iterdir())


def test_equal_windows_fall_to_equal_keys():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    texts = [text, b"zz" + text[500:1500] + b"q" * 900, text[100:499], b"a" * 2000]
    key = {}
    for d, a, z, k, _ in sd.anchored(texts, 60):
        for s in range(a, z + 1):
            assert key.setdefault(texts[d][s : s + 60], (k, d, s))[0] == k
    assert sum(len(t) - 59 for t in texts) == sum(z - a + 1 for _, a, z, _, _ in sd.anchored(texts, 60))
