"""Writers of predictions, reports and vocabularies."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_lines(rows: DataFrame) -> DataFrame:
    """(value): each prediction ``(text, label, probs, ...)`` as one JSON object, nulls kept."""
    kept = [c for c in ("text", "label", "probs", "error") if c in rows.columns]
    return rows.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value"))


def write_predictions(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, written by the executors."""
    prediction_lines(rows).write.mode("overwrite").text(path)


def write_prediction_file(rows: DataFrame, path: str) -> None:
    """One local file for people: empty without rows, one indented ASCII object for one row, else JSON lines.

    Rows come through the driver one partition at a time; large results belong in :func:`write_predictions`.
    """
    lines = (r.value for r in prediction_lines(rows).toLocalIterator())
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        first, second = next(lines, None), next(lines, None)
        if first is not None and second is None:
            f.write(json.dumps(json.loads(first), indent=2))
        elif first is not None:
            f.write(first + "\n" + second + "\n")
            f.writelines(line + "\n" for line in lines)


def write_report(report: dict, path: str) -> None:
    """A report as indented JSON; folders are made."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False)


def write_vocabulary_json(vocab: DataFrame, path: str) -> None:
    """A vocabulary as one JSON object {term: index}, for small ones; larger ones are saved as Parquet."""
    with open(path, "w", encoding="utf-8") as f:
        rows = vocab.orderBy("idx").toLocalIterator()
        json.dump({r.term: r.idx for r in rows}, f, ensure_ascii=False, indent=2)


def read_vocabulary_json(spark, path: str) -> DataFrame:
    """(term, idx) of such a file, in index order."""
    with open(path, encoding="utf-8") as f:
        pairs = sorted(((t, int(i)) for t, i in json.load(f).items()), key=lambda p: p[1])
    return spark.createDataFrame(pairs, "term string, idx int")
