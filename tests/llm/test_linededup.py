import re

import numpy as np
import pytest

from spinmill.llm import linededup as ld


def words_of(line):
    return re.findall(rb"[^\x20\x09-\x0D]+", line)


def distance(a, b):
    """Words to insert, delete or replace between a and b, by the usual table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    """Texts left: a line goes if an earlier line has its words or, from five words on, is a word apart."""
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, ld_hash(r), r["text"]) for r in rows if r["text"] is not None})
    earlier, fate = [], {}
    for *key, text in order:
        for no, line in enumerate(text.encode().split(b"\n")):
            own = words_of(line)
            if not own:
                continue
            near = lambda b, own=own: b == own or (len(own) >= 5 and len(b) >= 5 and abs(len(own) - len(b)) < 2 and len(set(own) ^ set(b)) < 3 and distance(own, b) < 2)
            fate[(*key, text, no)] = any(near(b) for b in earlier)
            earlier.append(own)
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        key = (r["doc_id"] is not None, r["doc_id"] or 0, ld_hash(r), r["text"])
        out.append((r["doc_id"], "\n".join(x for k, x in enumerate(r["text"].split("\n")) if not fate.get((*key, k), False))))
    return sorted(out, key=str)


_HASHES = {}


def ld_hash(r):
    return _HASHES.get(r["text"], 0)


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_brute_force(spark, frame, rows, odd_rows, kind):
    data = odd_rows if kind == "odd" else rows[:60]
    names = ("n_lines", "ord", "k1", "id", "t", "gone", "g_id", "g_t", "__t", "row", "parts", "r_t", "r_id", "want", "near")
    df = frame(data, extra=names if kind == "odd" else ())
    from pyspark.sql import functions as F

    _HASHES.update({r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()})
    got = ld.line_dedup(df)
    assert {*names} <= set(got.columns) or kind == "table"
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute(data)


def test_shuffled_as_broadcast(frame, odd_rows, monkeypatch):
    want = sorted(((r["doc_id"], r["text"]) for r in ld.line_dedup(frame(odd_rows)).collect()), key=str)
    monkeypatch.setattr(ld, "MOST_BROADCAST", -1)
    assert sorted(((r["doc_id"], r["text"]) for r in ld.line_dedup(frame(odd_rows)).collect()), key=str) == want


def test_empty_table(spark, frame):
    assert ld.line_dedup(frame([])).count() == 0


def test_variants_meet_where_lines_are_a_word_apart():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 40, dtype=np.uint64)
    lines = [a, np.delete(a, 7), np.insert(a, 3, 99), a[:1]]
    k, p, line = ld.variants(np.concatenate(lines), np.array([len(x) for x in lines]))
    keys = {(int(x), int(q)): int(y) for q, y, x in zip(p, k, line)}
    assert keys[0, 7] == keys[1, -1] and keys[0, -1] == keys[2, 3]
    assert len({keys[i, -1] for i in range(4)}) == 4


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 15, 16, 17, 32, 33, 63, 64, 65, 127, 128])
def test_halves_are_shared_by_lines_a_word_apart(n):
    a = [b"%d" % i for i in range(n)]
    for k in range(n):
        for b in (a[:k] + [b"x"] + a[k + 1 :], a[:k] + [b"x"] + a[k:]):  # a line of five words against one of six as well
            assert set(ld.halves(a)) & set(ld.halves(b))


def test_one_word_apart():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        a, b = ([b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 6))] for _ in range(2))
        assert ld.one_word_apart(a, b) == (distance(a, b) < 2)
    assert ld.one_word_apart([b"a", b"b"], [b"a", b"c"]) and ld.one_word_apart([b"a"], [b"a", b"c"])
    assert not ld.one_word_apart([b"a", b"b", b"c"], [b"b", b"c", b"d"]) and not ld.one_word_apart([b"a"], [b"b", b"c"])
