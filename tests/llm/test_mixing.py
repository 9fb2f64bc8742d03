from collections import defaultdict

import pytest

from spinmill.llm import mixing
from spinmill.llm.queries import op7_mix_sources


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again; sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] >= most * sizes[s]}
        if not over:
            return target | {s: share * w[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_water_filling(spark, frame, rows, odd_rows, kind):
    data = odd_rows if kind == "odd" else rows
    df = mixing.mix(frame(data, extra=("size", "q", "left", "prefix") if kind == "odd" else ()))
    got = df.collect()
    assert len(got) == len(data)
    n_words = lambda t: len((t or "").encode().split())
    sizes, biggest = defaultdict(int), defaultdict(int)
    for r in data:
        sizes[r["source"]] += n_words(r["text"])
        biggest[r["source"]] = max(biggest[r["source"]], n_words(r["text"]))
    want, taken = filled(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["repeats"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    # Rows alike go together, so that the edge may be two rows wide.
    assert all(abs(taken[s] - want[s]) <= biggest[s] * 2 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, df.collect()))
    again = mixing.mix(frame(data).repartition(7)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


def test_budgets_nest(spark, frame, rows):
    """What a small weight takes of a source, a larger one takes too."""
    take = lambda w: {r["doc_id"]: r["repeats"] for r in mixing.mix(frame(rows), weights=w).collect() if r["source"] == "src0"}
    small, large = take((1, 3, 3)), take((2, 3, 3))
    assert all(small[d] <= large[d] for d in small)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 0}, {"a": 0}, {"a": 1, "b": 1, "c": 1}, {"a": 1000, "b": 1, None: 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "__source string, size bigint")
    got = {r["__source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_empty_table(spark, frame):
    assert mixing.mix(frame([])).count() == 0


def test_query(spark, sf):
    assert op7_mix_sources(spark, sf).columns == ["doc_id", "size", "source_size", "target", "taken"]
