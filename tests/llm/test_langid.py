import random

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import langid
from tests.llm.fixtures import documents, empty, sentence


def labelled(spark, n=240):
    draw = random.Random(9)
    rows = [(k, sentence(draw, lang := ("en", "de", "fr")[k % 3], draw.randint(5, 60)) + ". X!", lang, "s") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_code_switching(spark):
    docs = labelled(spark)
    field = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    made = langid.with_language(docs.withColumn("out", langid.held_out(F.col("doc_id"))), field).filter("out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in made]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in made)
    draw = random.Random(1)
    mixed = spark.createDataFrame([(1, sentence(draw, "de", 30) + " " + sentence(draw, "fr", 12))], "doc_id long, text string")
    row = langid.with_language(mixed, field, with_runs=True).first()
    assert row["lang_pred"] == "de"
    assert [r["lang"] for r in row["lang_runs"]][0] == "de" and row["lang_runs"][-1]["lang"] == "fr"
    assert abs(row["lang_runs"][-1]["start"] - 30) <= 2


def test_blocked_scan_equals_plain_forward_backward():
    draw = np.random.default_rng(2)
    step = draw.normal(size=(3, 3))
    lens = np.array([1, 64, 65, 200, 3])
    score = draw.normal(size=(lens.sum(), 3))
    got = langid.posteriors(score, lens, step)
    at = 0
    for n in lens:
        own = np.exp(score[at : at + n])
        move = np.exp(step)
        ahead = [np.full(3, 1 / 3) @ move * own[0]]
        for t in range(1, n):
            ahead.append(ahead[-1] @ move * own[t])
            ahead[-1] /= ahead[-1].sum()
        back = [np.ones(3)]
        for t in range(n - 1, 0, -1):
            back.append(move @ (own[t] * back[-1]))
            back[-1] /= back[-1].sum()
        want = np.array(ahead) * np.array(back[::-1])
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_gradient_is_the_derivative():
    draw = np.random.default_rng(5)
    score, step, gold = draw.normal(size=(2, 4, 3)), draw.normal(size=(3, 3)), draw.integers(0, 3, (2, 4))

    def likelihood(score, step):
        total = 0.0
        for b in range(2):
            held = np.full(3, 1 / 3) @ np.exp(step) * np.exp(score[b, 0])
            path = np.log((np.full(3, 1 / 3) @ np.exp(step))[gold[b, 0]]) + score[b, 0, gold[b, 0]]
            for t in range(1, 4):
                held = held @ np.exp(step) * np.exp(score[b, t])
                path += step[gold[b, t - 1], gold[b, t]] + score[b, t, gold[b, t]]
            total += path - np.log(held.sum())
        return total

    wrong, _ = langid._gradient(score, gold, step)
    for place in ((0, 0, 1), (1, 3, 2), (0, 2, 0)):
        moved = score.copy()
        moved[place] += 1e-6
        assert abs((likelihood(moved, step) - likelihood(score, step)) / 1e-6 - wrong[place]) < 1e-4


def test_awkward_rows(spark):
    field = langid.fit(labelled(spark))
    made = langid.with_language(documents(spark).drop("lang"), field).collect()
    assert len(made) == documents(spark).count()
    by_id = {r["doc_id"]: r for r in made}
    for k in (100, 101, 102, 107):
        assert (by_id[k]["lang_pred"], by_id[k]["score"]) == ("und", 0.0)
    assert by_id[105]["lang_pred"] == "fr"
    assert langid.fit(empty(spark)) is None
    assert langid.with_language(empty(spark), field).collect() == []
    assert {r["lang_pred"] for r in langid.with_language(documents(spark), None).collect()} == {"und"}
    one = langid.fit(labelled(spark).filter("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.with_language(labelled(spark), one).collect()} == {"en"}
