"""Table functions for SQL, partitioned by key: runs of equal states, and one-to-one matches of candidate pairs.

SELECT * FROM state_runs(TABLE(SELECT user_id, t_ms, event_id, state, prob FROM steps) PARTITION BY user_id ORDER BY (t_ms, event_id))
SELECT * FROM one_to_one(TABLE(SELECT user_id, pred_id, gold_id, iou FROM pairs) PARTITION BY user_id ORDER BY (iou DESC, pred_id, gold_id))

A partition is read row by row; ``state_runs`` holds one run, ``one_to_one`` the ids that are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidelane import shipping


class StateRuns:
    """Rows (key, time, ..., state, prob) in order to runs: the first column is the key, the second the time, the last two
    are state and probability."""

    def __init__(self) -> None:
        self.run: list | None = None
        self.at = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        key, time, state, prob = row[0], row[1], row[-2], row[-1]
        if self.run is not None and self.run[1] == state:
            self.run[3], self.run[5], self.run[6] = time, self.at, self.run[6] + prob
        else:
            if self.run is not None:
                yield self._closed()
            self.run = [key, state, time, time, self.at, self.at, prob]
        self.at += 1

    def _closed(self) -> tuple:
        key, state, first, last, start, end, total = self.run
        return key, state, first, last, start, end, total / (end - start + 1)

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self._closed()


class OneToOne:
    """Pairs (key, pred_id, gold_id, ...) in order of preference: those whose two sides are both still free."""

    def __init__(self) -> None:
        self.preds: set = set()
        self.golds: set = set()

    def eval(self, row: Row) -> Iterator[tuple]:
        if row[1] not in self.preds and row[2] not in self.golds:
            self.preds.add(row[1])
            self.golds.add(row[2])
            yield row[0], row[1], row[2]


def register(spark: SparkSession) -> None:
    """Makes state_runs and one_to_one callable from SQL."""
    shipping.ship(spark)
    spark.udtf.register("state_runs", udtf(StateRuns, returnType="key long, state int, first_ms long, last_ms long, start_idx long, end_idx long, prob double"))
    spark.udtf.register("one_to_one", udtf(OneToOne, returnType="key long, pred_id long, gold_id long"))
