"""The second scorer's client: rows are asked in batches, answers are checked, failures are nulls, and what was answered once isn't asked again."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import keep_first
from ..operators.tables import settled

#: A model: rows (dicts of id, title, text, location_raw) in, one answer a row out, in their order: a JSON object as text, or None. It travels to the tasks by pickle.
Model = Callable[[list[dict]], list]
MEMO = "key string, record string"


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


#: Fields of an answer and what their values must be; ``inScope`` must be there, others may be absent or null, further fields are left alone.
FIELDS = {
    "inScope": lambda x: isinstance(x, bool), "confidence": lambda x: _number(x) and 0 <= x <= 1, "skills": lambda x: isinstance(x, list) and all(isinstance(s, str) for s in x),
    **dict.fromkeys(("seniority", "country", "city", "remoteType", "salaryCurrency", "salaryPeriod"), lambda x: isinstance(x, str)), **dict.fromkeys(("salaryMin", "salaryMax"), _number),
}


def checked(answer: object) -> str | None:
    """The answer, if it is a JSON object whose fields are what they must be; else None."""
    try:
        got = json.loads(answer)
    except (TypeError, ValueError):
        return None
    if not isinstance(got, dict) or not isinstance(got.get("inScope"), bool):
        return None
    return answer if all(got.get(k) is None or ok(got[k]) for k, ok in FIELDS.items()) else None


def answers(model: Model, rows: list[dict], attempts: int) -> list[str | None]:
    """Checked answers of one batch. A call that raises, or returns another number of answers, is made again, ``attempts`` times in all; then every row of it is None."""
    for _ in range(attempts):
        try:
            got = list(model(rows))
        except Exception:  # whatever a model raises is a failure of this batch, not of the run
            continue
        if len(got) == len(rows):
            return [checked(a) for a in got]
    return [None] * len(rows)


def _ask(model: Model, size: int, attempts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            rows = batch.slice(at, size).to_pylist()
            yield pa.RecordBatch.from_pydict({"id": pa.array([r["id"] for r in rows], pa.string()), "record": pa.array(answers(model, rows, attempts), pa.string())})


def client(model: Model, size: int = 16, attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A scorer (see plans.ingest.Scorer) that asks ``model`` for at most ``size`` rows at once; a task holds one Arrow batch. (id, record) for every row, record null where it failed."""

    def score(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("string").alias("id"), "title", "text", "location_raw").mapInArrow(partial(_ask, model, size, attempts), "id string, record string")

    return score


class Remembered:
    """A scorer that asks another one only for texts it has no answer to, and once for equal texts.

    ``memo`` (key, record) holds the answers of earlier runs, by a digest of title, text and place; after a call ``after`` is the memo of the next run. Failures aren't remembered, so
    the next run asks again. New answers are written once, so no plan that reads them asks twice."""

    def __init__(self, scorer: Callable[[DataFrame], DataFrame], memo: DataFrame) -> None:
        self.scorer, self.memo, self.after = scorer, memo, memo

    def __call__(self, rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct("title", "text", "location_raw")), 256))
        unknown = keep_first(keyed.join(self.memo, "key", "left_anti").select("key", "title", "text", "location_raw"), ["key"], [F.col("title")])
        fresh = settled(self.scorer(unknown.withColumnRenamed("key", "id")).select(F.col("id").alias("key"), "record").where("record IS NOT NULL"), "answers")
        self.after = self.memo.select("key", "record").unionByName(fresh)
        return keyed.select("id", "key").join(self.after, "key", "left").select("id", "record")
