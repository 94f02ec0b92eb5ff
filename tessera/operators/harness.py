"""Running a system over reference questions: a log line for each item, written through, and scores of a log."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions import matching


@dataclass(frozen=True)
class Item:
    id: str
    question: str
    gold_sql: str
    stratum: str = ""


@dataclass
class Record:
    id: str
    stratum: str
    sql: str = ""
    error: str = ""
    strict: bool = False
    loose: bool = False
    soft: float = 0.0
    numeric: bool | None = None
    latency_ms: float = 0.0
    gold_ms: float = 0.0
    cand_ms: float = 0.0
    tokens: int = 0
    join_precision: float = 0.0
    join_recall: float = 0.0


def _timed(action: Callable[[], object]) -> tuple[object, float]:
    began = time.perf_counter()
    return action(), (time.perf_counter() - began) * 1000


def run_system(spark: SparkSession, items: Iterable[Item], system: Callable[[str], tuple[str, int]], log: str | Path, header: dict | None = None) -> list[Record]:
    """``system`` answers a question with SQL and the tokens it took.

    An item's error is recorded, not raised. The log is never overwritten:
    each line reaches the disk before the next item starts. Matches and
    partial credit compare all rows. Where the reference is ordered, its order
    counts in the loose match and in the pairing of rows.
    """
    path = Path(log)
    path.with_suffix(".header.json").write_text(json.dumps(header or {}))
    out = []
    with path.open("x") as f:
        for item in items:
            r = Record(item.id, item.stratum)
            try:
                gold = spark.sql(item.gold_sql)
                _, r.gold_ms = _timed(lambda gold=gold: gold.write.format("noop").mode("overwrite").save())
                (r.sql, r.tokens), r.latency_ms = _timed(lambda item=item: system(item.question))
                found = spark.sql(r.sql)
                _, r.cand_ms = _timed(lambda found=found: found.write.format("noop").mode("overwrite").save())
                r.strict, r.loose = matching.match_strict(gold, found), matching.match_sets(gold, found)
                ordered = matching.top_level_order(item.gold_sql)
                if ordered and r.loose:
                    r.loose = matching.match_in_place(gold, found)
                r.soft = matching.soft_scores(gold, found, ordered).collect()[0]["f1"]
                a, b = gold.limit(2).collect(), found.limit(2).collect()
                if len(a) == len(b) == 1 and len(gold.columns) == len(found.columns) == 1 and matching.number(a[0][0]) is not None:
                    r.numeric = matching.cells_equal(a[0][0], b[0][0])
                r.join_precision, r.join_recall, _ = matching.join_scores(matching.join_pairs(r.sql), matching.join_pairs(item.gold_sql))
            except Exception as e:  # noqa: BLE001
                r.error = f"{type(e).__name__}: {e}"[:500]
            out.append(r)
            f.write(json.dumps(asdict(r)) + "\n")
            f.flush()
            os.fsync(f.fileno())
    return out


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log as rows."""
    return spark.read.schema("id string, stratum string, sql string, error string, strict boolean, loose boolean, soft double, numeric boolean, latency_ms double, gold_ms double, cand_ms double, tokens long, join_precision double, join_recall double").json(path)
