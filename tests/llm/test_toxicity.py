import random
import zlib

import pytest

from spinmill.llm import toxicity as tx
from spinmill.llm.queries import op3_toxicity


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled():
    """Texts whose toxic ones have words of two stems, and in training a neutral group's name more often."""
    rng = random.Random(6)
    filler = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    out = []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 40))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]) + rng.choice(["", "xa", "xbo", "xcur"]))
        if rng.random() < (0.6 if toxic else 0.1):
            words.append("muslims")
        out.append((i, " ".join(words), toxic))
    return out


def run(spark, data, **kw):
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in data], "doc_id bigint, text string, y int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id bigint, quality int, toxic int")
    return {r["doc_id"]: r for r in tx.fit_and_score(docs, labels, **kw).collect()}


def test_held_out_accuracy(spark, labelled):
    got = run(spark, labelled)
    out = [(got[i]["predicted"], y) for i, _, y in labelled if held(i)]
    assert all(got[i]["held_out"] == held(i) for i, *_ in labelled)
    assert sum(p == y for p, y in out) / len(out) > 0.97 and len(out) > 100


def test_neutral_mentions_after_training(spark, labelled):
    """Clean held-out texts that name a group, by training with and without the penalty."""
    neutral = [(i, t) for i, t, y in labelled if held(i) and not y]
    extra = [(10_000 + k, f"{t} muslims", 0) for k, (_, t) in enumerate(neutral)]
    rate = {}
    for weight in (0.0, tx.SWAP_WEIGHT):
        got = run(spark, labelled + extra, swap_weight=weight)
        own = [i for i, *_ in extra if held(i)]
        rate[weight] = sum(got[i]["score"] for i in own) / len(own)
    print("mean score of neutral mentions", rate)
    assert rate[tx.SWAP_WEIGHT] < 0.8 * rate[0.0]


def test_labels_of_held_out_rows_are_not_learnt_from(spark, labelled):
    other = [(i, t, 1 - y if held(i) else y) for i, t, y in labelled]
    assert run(spark, labelled) == run(spark, other)


def test_swaps_calm_identity_terms():
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        y = int(rng.random() < 0.4)
        words = [b"muslims"] if rng.random() < (0.8 if y else 0.2) else [b"people"]
        words += [b"awful"] if y and rng.random() < 0.7 else [b"fine"]
        own = tx.feature_set(words, {})
        other = tx.feature_set(tx.swapped(words, rng.randrange(9)), {}) if b"muslims" in words else None
        rows.append((own, other, y))
    term = tx.features(b"muslims")[0]
    plain, calm = (tx.fit(rows, swap_weight=w) for w in (0.0, 50.0))
    assert abs(calm.get(term, 0.0)) < 0.3 * abs(plain[term])


def test_swapped_terms_are_others_of_their_kind():
    words = [b"the", b"women", b"and", b"Jews", b"jews", b"women"]
    got = tx.swapped(words, 3)
    assert got[0] == b"the" and got[1] == got[5] != b"women" and got[1] in tx.KIND[b"women"] and got[3] == b"Jews" and got[4] in tx.KIND[b"jews"]


def test_odd_rows(spark, frame, odd_rows):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = tx.fit_and_score(frame(odd_rows, extra=("score", "id", "y")), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = labels.limit(0)
    assert {round(r["score"], 9) for r in tx.fit_and_score(frame(odd_rows), none).collect()} == {0.1}
    assert tx.fit_and_score(frame([]), labels).count() == 0


def test_a_smaller_sample_is_deterministic(spark, labelled):
    assert run(spark, labelled, most=100) == run(spark, labelled[::-1], most=100)


def test_query(spark, sf, rows):
    got = op3_toxicity(spark, sf).collect()
    assert len(got) == len(rows) and {"doc_id", "held_out", "score", "predicted"} <= set(got[0].asDict())
