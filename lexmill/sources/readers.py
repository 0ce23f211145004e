"""Readers of labelled texts, feature rows, prediction input and settings."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_number, prediction_text
from ..functions.vectors import parsed
from ..session import cut

#: Names under which the text or label may go, in order of preference, for training and for evaluation.
TRAIN_TEXT = ("message", "body", "Text", "content", "email_content", "emailContent")
TRAIN_LABEL = ("spam", "labelled", "Label")
EVAL_TEXT = ("message", "body", "Text", "content", "email_content")
EVAL_LABEL = ("spam", "labelled", "Label", "target")
#: Cells that CSV files of the usual data frame tools mean as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _resolve(rows: DataFrame, name: str, aliases: tuple[str, ...]) -> str:
    for candidate in (name, *aliases):
        if candidate in rows.columns:
            return candidate
    raise ValueError(f"the data must have a column {name!r} or one of {', '.join(aliases)}")


def labelled(rows: DataFrame, text: tuple[str, ...] = TRAIN_TEXT, label: tuple[str, ...] = TRAIN_LABEL, key: str | None = None) -> DataFrame:
    """(doc_id, text, label): columns found by name or alias, as texts; a null text is empty, a null label ``nan``.

    An alias is used only where the plain name is missing.  ``doc_id`` is ``key`` if given, otherwise made up.  Other
    columns are dropped, whatever their names.
    """
    texts, labels = _resolve(rows, "text", text), _resolve(rows, "label", label)
    ids = F.col(f"`{key}`") if key else F.monotonically_increasing_id()
    out = rows.select(ids.alias("doc_id"), F.coalesce(F.col(f"`{texts}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{labels}`").cast("string"), F.lit("nan")).alias("label"))
    return out if key else cut(out, "labelled")  # ids that are made up must not be made up again


def read_csv(spark: SparkSession, path: str, missing: bool = True) -> DataFrame:
    """A CSV file with a header, quoted line breaks and doubled quotes; all columns are texts.

    With ``missing``, cells that read like one of MISSING are null.  FileNotFoundError if a local path doesn't exist.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(path)
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if missing:
        rows = rows.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in rows.columns))
    return rows


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Training texts of a CSV file, see :func:`labelled`."""
    return labelled(read_csv(spark, path))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation texts of a CSV file: as :func:`read_labelled`, with other aliases."""
    return labelled(read_csv(spark, path), EVAL_TEXT, EVAL_LABEL)


def read_features(spark: SparkSession, path: str, n_features: int | None = None, has_header: bool = True, strict: bool = False) -> DataFrame:
    """(id, label, v) of a CSV file of a label and feature cells; blank lines are skipped.

    Cells that aren't numbers are 0.0 and odd labels are told by alias; ``strict`` makes them an error instead.  With
    ``n_features`` rows are cut or padded.  Lines are read as texts, so that no row becomes thousands of columns.
    """
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    if has_header:
        first = lines.agg(F.min("id")).scalar()
        lines = lines.where(F.col("id") > first)
    cells = F.transform(F.split(F.col("value"), ","), lambda c: F.regexp_replace(c, r'^\s*"?|"?\s*$', ""))
    rows = lines.where(F.trim("value") != "").select("id", cells.alias("c"))
    label, rest = F.element_at("c", 1), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))
    if strict:
        return rows.select("id", label.cast("int").alias("label"), F.transform(rest, lambda x: x.cast("double")).alias("v"))
    return rows.select("id", label_number(label).alias("label"), parsed(rest, n_features).alias("v"))


def feature_rows(rows: DataFrame, key: str = "row_id", label: str = "label", features: str = "features", width: int | None = None) -> DataFrame:
    """(id, label INT, v ARRAY<DOUBLE>) of a table of feature rows, each id once; null features stay null."""
    from ..functions.vectors import filled

    return rows.select(F.col(key).alias("id"), label_number(F.col(label)).alias("label"), filled(F.col(features), width).alias("v")).dropDuplicates(["id"])


def read_stop_words(path: str) -> tuple[str, ...]:
    """The words of a file, one a line, lower-cased; blank lines and lines that begin with ``#`` are skipped."""
    with open(path, encoding="utf-8") as f:
        lines = [line.strip().lower() for line in f]
    return tuple(dict.fromkeys(x for x in lines if x and not x.startswith("#")))


def read_prediction_input(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a file of texts or JSON objects with a ``text``, one a line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), prediction_text(F.col("value")).alias("text"))


@dataclass(frozen=True)
class Config:
    """Settings of training, with their defaults."""

    alpha: float = 1.0
    min_freq: int = 1
    ngram_range: tuple[int, int] = (1, 1)
    max_features: int | None = None
    test_size: float = 0.2
    random_seed: int = 42
    lowercase: bool = True
    pos_label: str = "spam"

    def as_dict(self) -> dict:
        return asdict(self)


def load_config(path: str | None) -> Config:
    """Defaults overlaid with the ``name: value`` lines of a file; the defaults if there is none or it can't be read."""
    base = Config()
    if not path:
        return base
    try:
        with open(path, encoding="utf-8") as f:
            found = _settings(f.read())
        found = {k: tuple(v) if k == "ngram_range" else v for k, v in found.items() if k in base.as_dict()}
        return replace(base, **found)
    except Exception:
        return base


def _settings(text: str) -> dict:
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        import json

        out = {}
        for line in text.splitlines():
            name, colon, value = line.split(" #")[0].partition(":")
            if colon and value.strip():
                word = value.strip()
                word = {"true": "true", "false": "false", "null": "null", "~": "null"}.get(word.lower(), word)
                try:
                    out[name.strip()] = json.loads(word)
                except ValueError:
                    out[name.strip()] = word.strip("'\"")
        return out
