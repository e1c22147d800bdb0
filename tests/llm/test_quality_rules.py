"""The ledger against a brute-force version."""

import re
from collections import Counter

import pytest

from streamloom.llm import quality_rules as q

CASES = {
    1: None,
    2: "",
    3: "a b c d e a b c d e",
    4: "x " * 40,
    5: "line one\nline one\n\n\nline two\n line one\nline one",
    6: "É#%&|<> ß 漢字\tab\x0bcd\x0cef\rgh*$",
    7: " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"w{i}" for i in range(50, 58)),
    8: "only  four  words here",
    9: "ha ha ha ha ha ha",
    10: "long " * 30000,
}


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def frame(spark, cases):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in cases.items()], "doc_id long, text string, words string, n_words int")


def test_measurements(spark):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.ledger(frame(spark, CASES)).collect()}
    assert got == {i: brute(t) for i, t in CASES.items()}


def test_policies_and_ablations(spark):
    led = q.ledger(frame(spark, CASES))
    base = {r.doc_id: r.kept for r in q.apply_policy(led, "base.1").collect()}
    for i, t in CASES.items():
        n, *_, repeated = brute(t)
        assert base[i] == (n >= 10 and 100 * repeated <= 20 * n)
    bits = [r.fail_bits & q.mask_of(q.POLICIES["web.1"]) for r in led.collect()]
    for r in q.ablations(led, "web.1").collect():
        bit = q.mask_of((r.rule,))
        assert (r.n_failed, r.n_only) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))


def test_empty_and_repeated(spark):
    assert q.ledger(frame(spark, {})).count() == 0
    twice = frame(spark, {3: CASES[3]}).union(frame(spark, {3: CASES[3]}))
    assert q.ledger(twice).count() == 2


@pytest.mark.parametrize("policy", sorted(q.POLICIES))
def test_masks_name_known_rules(policy):
    assert set(q.POLICIES[policy]) <= {r.name for r in q.RULES}
