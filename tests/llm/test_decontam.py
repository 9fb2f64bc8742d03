import hashlib
import random
import re
from collections import Counter

import pytest

from spinmill.llm import decontam as dc
from spinmill.llm.queries import op6_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def brute(texts, items, window=10):
    out = []
    for t in texts:
        own, hit, names = words_of(t), set(), set()
        for name, text in items:
            w = words_of(text)
            if name is None or not w:
                continue
            n = min(window, len(w))
            wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
    return out


def items_of(data):
    long = [r["text"] for r in data if r["text"] and len(r["text"].split()) > 12]
    cut = lambda t, a, z: " ".join(t.split()[a:z])
    return [
        (1, cut(long[0], 5, 30)), (2, cut(long[0], 20, 31).upper()), (10, "One, two"), (11, None), (12, ""), (None, long[0]), (3, cut(long[1], 0, 9)),
        (3, cut(long[2], 0, 12)), (4, "x" * 900), (5, "not there at all"), (6, long[-1]), (7, cut(long[0], 5, 30)),
    ]


@pytest.mark.parametrize("block", [2, 20_000])
@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_brute_force(spark, frame, rows, odd_rows, kind, block, monkeypatch):
    if block == 2:
        monkeypatch.setattr(dc, "MOST_TERMS", 3)  # then all words are in the index
    data = odd_rows if kind == "odd" else rows[:80]
    items = items_of(data)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = dc.contamination(frame(data, extra=("items", "id", "n_hit") if kind == "odd" else ()), bench, block=block).collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(data, brute([r["text"] for r in data], items))), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == want
    assert all(sum(s["past"] - s["first"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_empty_tables(spark, frame, odd_rows):
    none = spark.createDataFrame([], "item_id int, text string")
    got = dc.contamination(frame(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and all(r["n_hit"] == 0 for r in got)
    assert dc.contamination(frame([]), spark.createDataFrame([(1, "a b")], "item_id int, text string")).count() == 0


def test_query_finds_planted_passages(spark, sf):
    assert op6_decontaminate(spark, sf).where("contaminated").count() > 0


def shortest(own, window, reach):
    """Stretches [a, z) that hold the window's words as often as it does, with none within."""
    want, out = Counter(window), []
    for a in range(len(own)):
        z = next((z for z in range(a + len(window), min(a + reach, len(own)) + 1) if not want - Counter(own[a:z])), None)
        if z is not None and want - Counter(own[a + 1 : z]):
            out.append((a, z))
    return out


def brute_near(texts, items, window=10, slop=3):
    out = []
    for t in texts:
        own, hit, names = words_of(t), set(), set()
        for name, text in items:
            w = words_of(text)
            n = min(window, len(w))
            for win in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if name is not None and w else ():
                for a, z in shortest(own, win, n + n * slop // 10):
                    hit.update(range(a, z))
                    names.add(str(name))
        out.append((sorted(names), sorted(hit)))
    return out


def shaken(text, rng):
    """Words swapped with their neighbours and others put in."""
    w = text.split()
    for _ in range(len(w) // 4):
        i = rng.randrange(len(w) - 1)
        w[i], w[i + 1] = w[i + 1], w[i]
        w.insert(rng.randrange(len(w)), rng.choice(["between", w[0]]))
    return " ".join(w)


@pytest.mark.parametrize("slop", [0, 3])
def test_proximity_against_brute_force(spark, rows, odd_rows, slop):
    items = items_of(rows[:80]) + [(20, "the the a"), (21, "a b a b c a")]
    rng = random.Random(5)
    texts = [shaken(t, rng) for _, t in items if t and len(t.split()) > 3 for _ in range(6)] + [r["text"] for r in [*odd_rows, *rows[:20]]]
    texts += ["b a x a b c a a", "a b b a a c", "c a a b x x a b", "the a the", "the a x the", "One x two", "two One"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    got = {r["doc_id"]: r for r in dc.contamination(docs, spark.createDataFrame(items, "item_id int, text string"), slop=slop).collect()}
    want = brute_near(texts, items, slop=slop)
    for k, (names, hit) in enumerate(want):
        assert (got[k]["near_items"], [i for s in got[k]["near_spans"] for i in range(s["first"], s["past"])]) == (names, hit), k
    more = sum(set(r["near_items"]) > set(r["items"]) for r in got.values())
    assert more > (5 if slop else 0)
    assert all(set(r["near_items"]) >= set(r["items"]) for r in got.values())


def test_phrases_alone(spark, frame, rows):
    items = items_of(rows[:80])
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = dc.contamination(frame(rows[:80]), bench, slop=None).collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows[:80], brute([r["text"] for r in rows[:80]], items))), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == want
    assert all(not r["near_items"] and not r["near_spans"] for r in got)


def test_reach_is_bounded(spark, frame, odd_rows):
    with pytest.raises(ValueError):
        dc.contamination(frame(odd_rows), spark.createDataFrame([(1, "a b")], "item_id int, text string"), window=60)
