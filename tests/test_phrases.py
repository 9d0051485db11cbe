"""Many phrases at once against a pattern per phrase."""

import random
import re

import pytest

from curatorium.operators import text as X


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrases_equal_a_pattern_each(spark, seed):
    rng = random.Random(seed)
    tokens = ["the", "The", "and", "a", "b_1", "-", " ", "  ", ".", "é", "É", "\n", "x", "ſ", "K"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "the and " * 2000]
    phrases = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))) for _ in range(150)] + ["", None, "the and", "the and", "THE AND THE"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "i int, t string")
    found = X.phrases_found(rows, "i", "t", spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(i if i else None, p) for i, t in enumerate(texts) for p in set(phrases) if p and t and re.search(rf"(?<![A-Za-z0-9_])(?:{re.escape(p)})(?![A-Za-z0-9_])", t, re.I | re.A)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_long_lists_of_phrases(spark):
    """A hundred thousand phrases, a third of them with the same first word."""
    phrases = spark.range(100_000).selectExpr("concat(if(id % 3 = 0, 'the', concat('w', id % 1000)), ' ', id) as phrase")
    texts = spark.createDataFrame([(1, "the 3 w1 1 the 300 the 299997 the 99999."), (2, "the the the 4 w5 6")], "i int, t string")
    got = {tuple(r) for r in X.phrases_found(texts, "i", "t", phrases).collect()}
    assert got == {(1, "the 3"), (1, "w1 1"), (1, "the 300"), (1, "the 99999")}


def _exchanged(df):
    """The columns that each exchange of a plan moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) \w*Exchange\w*\s*\n(?:Output|Input) \[\d+\]: \[(.*)\]", plan)


def test_texts_and_tokens_are_not_shuffled(spark):
    """a text's tokens are many times as large as the text; only keys and found sequences leave a task."""
    rows = spark.createDataFrame([(1, "the cat and the dog")], "i int, t string")
    moved = _exchanged(X.phrases_found(rows, "i", "t", spark.createDataFrame([("the cat",), ("dog",)], "phrase string")))
    assert any("__gram" in columns for columns in moved)
    assert not any(re.search(r"(?:^|, )(?:__t|t|__places|__first|__i)#", columns) for columns in moved if re.search(r"(?:^|, )i#", columns))


@pytest.mark.parametrize("size", [1, 2])
def test_full_lookups_let_more_through_but_change_nothing(spark, monkeypatch, size):
    """with hardly any slots and marks every token may begin a phrase and most sequences may be one."""
    rows = spark.createDataFrame([(1, "The cat, the dog"), (1, "the  cat the cat"), (None, "dog"), (None, "dog"), (2, "thecat dogs")], "i int, t string")
    phrases = spark.createDataFrame([(p,) for p in ["the cat", "The Cat", "dog", ", the", "a b c d e f g", "cat the", "DOG"]], "phrase string")
    monkeypatch.setattr(X, "SLOTS", size)
    monkeypatch.setattr(X, "MARKS", size)
    got = sorted(tuple(r) for r in X.phrases_found(rows, "i", "t", phrases).collect() if r[0] is not None)
    assert got == sorted((1, p) for p in ["the cat", "The Cat", "dog", "cat the", "DOG"])  # the comma follows a word
    assert sorted(r.phrase for r in X.phrases_found(rows, "i", "t", phrases).where("i is null").collect()) == ["DOG", "dog"]
