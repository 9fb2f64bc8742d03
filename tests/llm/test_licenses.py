import re

import pytest

from spinmill.llm import licenses as lic
from spinmill.llm.queries import op1_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def base(text):
    words, found = words_of(text), []
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def detections(text):
    """Every rule on every text, without keywords; a detection goes if another of its strength or better holds it."""
    words = words_of(text)
    norm = f" {' '.join(words)} "
    found = []
    for k, (label, _, rx, priority, weight, is_base) in enumerate(lic.rules()):
        for m in re.finditer(rx, norm):
            first = norm[: m.start()].count(" ") - 1
            found.append((first, first + len(m[0].split()), label, priority, weight, is_base, k))
    kept = []
    for x in found:
        inside = [y for y in found if y is not x and not y[5] and y[0] <= x[0] and y[1] >= x[1] and y[3] <= x[3]]
        inside = [y for y in inside if (y[0], -y[1], y[3], y[6]) < (x[0], -x[1], x[3], x[6])]
        if x[5] or not inside:
            kept.append((*x[:4], x[5]))
    return sorted(kept)


TEXTS = [
    None, "", "Licensed under the Apache License, Version 2.0.", "MIT License mit license MIT-LICENSE", "CC BY-NC-SA 4.0 and CC\nBY 4.0 or cc by",
    "GNU General Public License version 3, GNU Lesser General Public License, GNU Affero General Public License v3", "SPDX-License-Identifier: GPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 3.", "Creative Commons Attribution-NonCommercial 4.0; CC0 1.0; public domain",
    "Mozilla Public License 2.0. Released under the BSD 3-Clause License. See the ISC license.", "LİCENSE apache lıcense é apache license 日本 mit license",
    "word " * 3000 + "apache license " * 300, "the same terms as Perl itself; WTFPL; Unlicense", "no licence here", "accent cc", "a\u0000b mit\u0001license",
]


def test_against_plain_matching(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id int, text string, n_words int, x int")
    got = {r["doc_id"]: r for r in lic.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_words"], got[i]["n_base"]) == base(t)[:2], t
        have = sorted((d["first"], d["past"], d["label"], d["priority"], d["base"]) for d in got[i]["detections"])
        assert have == detections(t), t


def test_gate_and_keywords_lose_no_rule():
    """Texts made from each rule pass the gate and have the rule's keyword."""
    samples = ["apache license", "mit license", "gnu general public license", "cc by", "same terms as perl", "wtfpl", "public domain", "cc0", "bsd 2 clause"]
    for s in samples:
        assert any(g in s for g in lic.GATE)


def test_keywords_lose_no_rule(spark):
    """A text for each rule, in all the ways that its names are written, is found by the rule."""
    import itertools

    def ways(rx):
        """Some texts that a rule's name matches: every choice of its groups, optional parts with and without."""
        rx = re.sub(r"\(\?![^()]*(?:\([^()]*\)[^()]*)*\)", "", rx).replace(r"\d", "2")
        rx = re.sub(r"\[(\w)\w*\]", r"\1", rx)
        while m := re.search(r"\(\?:([^()]*)\)(\?)?", rx):
            picks = m[1].split("|") + ([""] if m[2] else [])
            return list(itertools.chain.from_iterable(ways(rx[: m.start()] + p + rx[m.end() :]) for p in picks))
        return [re.sub(r"(\w| )\?", r"\1", rx)]

    data = [(label, " ".join(t.split())) for label, _, name, _ in lic.FAMILIES for t in ways(name)]
    got = lic.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(data)], "i int, text string")).collect()
    for r in got:
        label, text = data[r["i"]]
        assert re.search(r"[a-z]", text) and any(g in text for g in lic.GATE), text
        assert label in {d["label"] for d in r["detections"]}, (label, text)
        assert sorted((d["first"], d["past"], d["label"]) for d in r["detections"]) == sorted(d[:3] for d in detections(text)), text


def test_hundreds_of_rules():
    assert len(lic.rules()) > 200


def test_query(spark, sf, rows):
    got = {r["doc_id"]: r for r in op1_license_scan(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == base(r["text"])
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "doc_id int, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 400])
def test_many_matches(spark, n):
    df = spark.createDataFrame([("mit license " * n,)], "text string")
    assert lic.scan(df).first()["n_base"] == n
