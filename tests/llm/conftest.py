import random

import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows(sf):
    """The documents of the smallest table, as dicts."""
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, a very long one, ties, repeated rows, near copies, and characters of several lengths."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(70) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "One two", base[0], base[0], base[0].replace(" ", "\n", 3), base[1] + "\n" + base[2], base[2] + "\n" + base[1]]
    for b in base:
        parts = b.split()
        for k in (3, 40, 69):
            texts.append(" ".join([*parts[:k], "changed", *parts[k + 1 :]]))
            texts.append(" ".join([*parts[:k], "more", *parts[k:]]))
    texts += ["\n".join(line(9) for _ in range(400)), "x" * 900, "ab" * 700, line(8) + "\n" + line(6), "日本語 テキスト 🙂 é\u0000 a"]
    out = [{"doc_id": i, "text": t, "lang": None if i % 4 == 0 else "en", "source": [None, "a", "b", "ß"][i % 4], "n_chars": None} for i, t in enumerate(texts)]
    out.append(dict(out[5]))  # a repeated row
    out.append({"doc_id": None, "text": base[3], "lang": None, "source": None, "n_chars": 1})
    return out


@pytest.fixture
def frame(spark):
    def make(rows, extra=()):
        data = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) + tuple(0 for _ in extra) for r in rows]
        return spark.createDataFrame(data, SCHEMA + "".join(f", `{c}` int" for c in extra))

    return make
