"""The second scorer: checked answers, failures as nulls, nothing asked twice."""

import json
import os
import tempfile

import pytest

from millrace.sources.scorer import MEMO, Remembered, answers, checked, client

GOOD = '{"inScope": true, "confidence": 0.5, "skills": ["RAG"], "city": null, "more": 1}'


@pytest.mark.parametrize("bad", [None, "", "no", "[]", "{}", '{"inScope": 1}', '{"inScope": true, "confidence": 2}', '{"inScope": true, "confidence": true}', '{"inScope": true, "skills": "RAG"}', '{"inScope": true, "salaryMin": NaN}', 7, {"inScope": True}])
def test_answers_that_are_not_what_they_must_be(bad):
    assert checked(bad) is None and checked(GOOD) == GOOD


def test_a_batch_is_tried_again_and_fails_as_a_whole():
    calls = []

    def at_third(rows):
        calls.append(len(rows))
        if len(calls) == 1:
            raise OSError
        return [GOOD] * (len(rows) - (len(calls) == 2))

    assert answers(at_third, [{}, {}], 3) == [GOOD, GOOD] and calls == [2, 2, 2]
    calls.clear()
    assert answers(at_third, [{}, {}], 2) == [None, None]


ROWS = [("1", "a", "t", "x"), ("2", "a", "t", "x"), ("3", "b", None, None), ("4", None, None, None), ("5", "bad", "t", "x"), ("6", "wrong", "t", "x")]


def _logged(folder):
    """A model that notes every row it is asked for."""

    def model(rows):
        for r in rows:
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                f.write(json.dumps(r["title"]))
        if any(r["title"] == "bad" for r in rows):
            raise ValueError
        return ["?" if r["title"] == "wrong" else GOOD for r in rows]

    return model


def _asked(folder):
    got = sorted(json.load(open(os.path.join(folder, f))) or "" for f in os.listdir(folder))
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    return got


def test_texts_are_asked_once_and_failures_again(spark, tmp_path):
    rows, model = spark.createDataFrame(ROWS, "id string, title string, text string, location_raw string"), _logged(str(tmp_path))
    one = Remembered(client(model, 1, 2), spark.createDataFrame([], MEMO))
    want = {"1": GOOD, "2": GOOD, "3": GOOD, "4": GOOD, "5": None, "6": None}
    assert {r.id: r.record for r in one(rows).collect()} == want
    assert _asked(tmp_path) == ["", "a", "b", "bad", "bad", "wrong"]
    two = Remembered(client(model, 1, 1), one.after)
    assert {r.id: r.record for r in two(rows).collect()} == want
    assert _asked(tmp_path) == ["bad", "wrong"]
    assert two(rows.limit(0)).count() == 0 and _asked(tmp_path) == []
