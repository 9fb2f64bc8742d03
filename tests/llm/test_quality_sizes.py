import re

import pytest
from spinmill.llm import quality
from spinmill.llm.queries import trusted_ids


def looks_clean(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return len(words) >= 50 and len(re.findall(r"[#*$%&|<>]", text)) <= 0.02 * len(words) and len(set(lines)) >= 0.9 * len(lines) and len(set(words)) >= 0.2 * len(words)


@pytest.mark.parametrize(("size", "german"), [("sf0.001", None), ("sf0.01", None), ("sf0.01", 5)])
def test_clean_documents_of_each_language_stay(spark, sf, size, german):
    """Unlabelled and clean ones by their looks, also where a language has but a few trusted documents; junk goes."""
    folder = f"{sf}/../{size}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trusted = trusted_ids(spark, folder)
    if german is not None:
        of_german = trusted.join(docs.where("lang = 'de'").select("doc_id").distinct(), "doc_id", "left_semi")
        trusted = trusted.join(of_german, "doc_id", "left_anti").union(of_german.orderBy("doc_id").limit(german))
    got = quality.quality_rules(docs, trusted).join(labels.select("doc_id", "quality"), "doc_id", "left").where("not base_failed").collect()
    clean = [r for r in got if r["quality"] is None and looks_clean(r["text"])]
    assert {r["lang"] for r in clean} >= {"de", "en", "es", "fr"}
    assert [r["doc_id"] for r in clean if not r["kept"]] == []
    junk = [r["kept"] for r in got if r["quality"] == 0]
    assert junk and sum(junk) <= 0.6 * len(junk)
