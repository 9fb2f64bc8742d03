import corpus_pipeline as cp
import pyarrow.parquet as pq
import pytest


@pytest.fixture
def data(sf, odd_rows):
    """Repeated rows, several null ids and reused ids, some with a passage of the benchmark."""
    passage = " ".join(pq.read_table(f"{sf}/benchmark.parquet").to_pylist()[0]["text"].split()[:40])
    other = [t for t in (r["text"] for r in odd_rows) if t and len(t.split()) == 70][:4]
    pairs = [(None, other[0]), (None, other[0]), (None, "x " + passage), (None, "a text of its own kind"), (7, passage + " y"), (7, "one more text here"), (8, "said twice in the same words"), (8, "said twice in the same words"), (9, "said twice in the same words")]
    return [{"doc_id": i, "text": t, "lang": "en", "source": "a", "n_chars": 1} for i, t in pairs], passage


def seen(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_row_of_each_group_stays(spark, sf, frame, data):
    rows, passage = data
    same = "said twice in the same words"
    want = [(None, rows[0]["text"]), (None, "a text of its own kind"), (7, passage + " y"), (7, "one more text here"), (8, same)]
    assert seen(cp.drop_near_duplicates(spark, frame(rows), sf)) == sorted(want, key=str)


def test_only_rows_that_are_hit_go(spark, sf, frame, data):
    rows, passage = data
    assert seen(cp.decontaminate(spark, frame(rows), sf)) == sorted(((r["doc_id"], r["text"]) for r in rows if passage not in r["text"]), key=str)
