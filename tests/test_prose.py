"""Prose audit: the source's own examples, forms, borders and rhythm."""

import re

import pytest

from tallyrook.operators import prose

#: text -> counts that aren't 0
CASES = [
    ("Alex — a frontend engineer -- builds", {"dashes": 2}),
    ("not just an applicant, and not only storing code", {"contrasts": 2}),
    ("A bug is not cosmetic; it is a trust defect", {"contrasts": 1}),
    ("The headline isn't the speed. The real story is latency.", {"contrasts": 1}),
    ("I treat testing as part of shipping, not a separate phase.", {"contrasts": 1}),
    ("It's not the price. It's not the features. It's the trust.", {"contrasts": 1, "copulas": 1}),
    ("I delve; she delves. They delved while delving. A delver of delvings.", {"vocabulary": 4}),
    ("harness harnesses harnessed harnessing navigates utilized showcasing underscores embarked", {"vocabulary": 9}),
    ("ROBUST, seamlessly; pivotal: 'holistic' (tapestries)", {"vocabulary": 5}),
    ("robustness unseamless landscaped relearnings", {}),
    ("a cutting-edge game-changer, testament to it; a testament in cutting edge", {"vocabulary": 3}),
    ("I hope this helps! Great question. CERTAINLY. Let’s dive in", {"chat": 4}),
    ("Let me know if you need anything else. Let me know if you need anything", {"chat": 1}),
    ("Truly, it's worth noting; it’s worth noting. Quite, frankly", {"intensifiers": 4}),
    ("It serves as a tool, features a lot, boasts and presents", {"copulas": 4, "triads": 1}),
    ("Moreover, in today's world. When it comes to it, additionally", {"transitions": 4}),
    ("a pivotal moment", {"vocabulary": 1, "inflation": 1}),
    ("I am excited to apply. The future looks bright", {"closers": 2}),
    ("It could potentially work and may eventually end", {"hedges": 2}),
    ("We have red, green, and blue.\n\nShips, boats and rafts", {"triads": 2}),
    ("One two three. Four five six. One two three. Four five six. One two three.", {"uniform_runs": 1}),
    ("One two three. Four five six. One two three. Four five six seven eight nine. One two three.", {}),
    ("A b. A b. A b. A b. A b. A b. A b.", {"uniform_runs": 3}),
    ("Élan délve café-robust ünd", {}),
    ("", {}), (None, {}), ("—" * 3000, {"dashes": 3000}), ("robust " * 20_000, {"vocabulary": 20_000}),
]


@pytest.fixture(scope="module")
def audited(spark):
    df = spark.createDataFrame([(k, t, "w", 1) for k, (t, _) in enumerate(CASES)], "doc_id long, text string, w string, hits int")
    return {r.doc_id: r.asDict() for r in prose.audit(df).collect()}


def test_counts(audited):
    kept = ("dashes", "contrasts", *prose.rules(), "triads", "uniform_runs")
    got = {k: {c: r[c] for c in kept if r[c]} for k, r in audited.items()}
    assert {CASES[k][0]: got[k] for k in got if got[k] != CASES[k][1]} == {}


def test_verdicts(audited):
    by_text = {CASES[k][0]: r for k, r in audited.items()}
    for text, failed in (("Alex — a frontend engineer -- builds", "no_dashes"), ("a pivotal moment", "vocabulary_clean"), ("not just an applicant, and not only storing code", "no_contrasts"), ("A b. A b. A b. A b. A b. A b. A b.", "rhythm_varied")):
        r = by_text[text]
        assert {c for c in ("no_dashes", "no_contrasts", "vocabulary_clean", "rhythm_varied") if not r[c]} == {failed} and not r["pass"]
    # what is only trimmed passes
    assert by_text["I am excited to apply. The future looks bright"]["pass"] and not by_text["I am excited to apply. The future looks bright"]["polished"]
    assert not by_text["I hope this helps! Great question. CERTAINLY. Let’s dive in"]["pass"]
    assert by_text["We have red, green, and blue.\n\nShips, boats and rafts"]["pass"] and not by_text["We have red, green, and blue.\n\nShips, boats and rafts"]["polished"]
    assert by_text[None]["pass"] and by_text[None]["polished"] and by_text[""]["polished"]


def test_phrases_equal_plain_search(spark):
    """Every phrase once, in one text, against a plain search of word sequences."""
    text = " . ".join(p for phrases in prose.rules().values() for p in phrases)
    w = [x.replace("’", "'") for x in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", text.lower())]
    want = {c: sum(w[i : i + len(p.split())] == p.split() for p in phrases for i in range(len(w))) for c, phrases in prose.rules().items()}
    got = prose.audit(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().asDict()
    assert {c: got[c] for c in want} == want and min(want.values()) > 2


def test_rules_replace(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"])], "id long, w array<string>")
    got = df.select(prose.found("w", {"x": ("a b", "b"), "y": ("a b c",)}).alias("h")).first().h
    assert sorted(got) == ["x", "x", "x", "x", "y"]
