import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checkup.llm.quality_rules import SHARES, Threshold, fit_rules, learn, quality_rows, rules_column, text_stats, with_quality
from tests.llm.helpers import ascii_words, docs_of

SYMBOLS = set("#*$%&|<>")


def plain(text):
    text = text or ""
    words = ascii_words(text)
    lines = [x for x in text.split("\n") if ascii_words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), dup, len(covered))


def corpus(n=240, seed=3):
    rnd, texts, labels = random.Random(seed), [], []
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(900)]
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 300))]
        bad = i % 4 == 0
        if bad:
            words = [w + rnd.choice(["###", "$$$"]) for w in words]
        texts.append("\n".join(" ".join(words[k:k + 15]) for k in range(0, len(words), 15)))
        labels.append((i, 0 if bad else 1, 0))
    return texts, labels


@pytest.mark.parametrize("text", [None, "", " \n", "a b a b a b", "x#y $\n$ é\né\n", "the cat sat the cat sat on", "A\x1cB c\x85d"])
def test_statistics_equal_brute_force(text):
    assert text_stats(text)[:5] == plain(text)


def test_held_out_accuracy_and_learned_rules(spark):
    texts, labels = corpus()
    lab = spark.createDataFrame(labels[:160], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rows(docs_of(spark, texts), lab).collect()}
    held = [(got[i].kept, q == 1) for i, q, _ in labels[160:]]
    assert np.mean([a == b for a, b in held]) > 0.95
    for i, t in enumerate(texts[:20]):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_list_is_ordered_and_equals_python(spark):
    rules = [[Threshold("symbol_share", True, 0.5)], [Threshold("mean_word", True, 5.0), Threshold("upper_share", False, 0.2)]]
    texts = ["# # a b", "abcdefg hijklmnop", "ABCDEFG HIJ", "ab cd", None]
    got = [r[0] for r in with_quality(docs_of(spark, texts), rules).orderBy("doc_id").select("stats.rule").collect()]
    assert got == [1, 2, 0, 0, 0]
    assert spark.range(1).select(rules_column([])).first()[0] == 0


def test_learning_needs_two_classes():
    x = np.random.default_rng(1).random((200, len(SHARES)))
    assert learn(x, np.zeros(200, bool), SHARES) == []
    y = x[:, 2] > 0.7
    rules = learn(x, y, SHARES)
    assert rules and rules[0][0].stat == SHARES[2]


def test_edges(spark):
    texts, labels = corpus(40)
    none = spark.createDataFrame([(0, None, 0), (1, 1, 0), (1, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert fit_rules(docs_of(spark, texts), none) == []
    assert quality_rows(docs_of(spark, []), none).collect() == []
    clash = docs_of(spark, texts[:3] + [None]).withColumn("n_words", F.lit("mine")).withColumn("quality", F.lit(9))
    out = with_quality(clash, [], out="__q")
    assert out.columns == [*clash.columns, "__q"] and out.count() == 4
    assert quality_rows(clash.union(clash), none).count() == 8
