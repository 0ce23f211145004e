"""Command lines: ``python -m lexmill.cli train|evaluate|predict|train-tfidf|knn``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import functions as F

from .operators import knn, linear, metrics, tfidf
from .plans import pipeline
from .session import cut, get_session
from .sources import readers, writers


#: Where training writes its models, and where they are looked for, if no folder is named.
DEFAULT_MODEL, DEFAULT_TFIDF = "models", "models/tfidf"


def _report(rows, pos_label: str | None) -> dict:
    """A summary, the confusion matrix and the report of ``(true, pred)`` rows; all of them are a few rows."""
    out = metrics.summary(rows, pos_label).first().asDict()
    cells = metrics.confusion_matrix(rows).collect()
    labels = sorted({c.true for c in cells})
    count = {(c.true, c.pred): c.n for c in cells}
    out |= {"labels": labels, "confusion_matrix": [[count[a, b] for b in labels] for a in labels]}
    return out | {"classification_report": {r.row: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in metrics.report(rows).collect()}}


def train(args: argparse.Namespace) -> None:
    spark = get_session()
    config = readers.load_config(args.config)
    done = pipeline.train(readers.read_labelled(spark, args.data), config)
    done.model.save(args.save_dir)
    report = _report(done.predictions, config.pos_label) | {k: v for k, v in done.report.first().asDict().items() if k in ("n_classes", "vocab_size")}
    writers.write_report(report, os.path.join(args.save_dir, "metrics.json"))
    writers.write_report(config.as_dict(), os.path.join(args.save_dir, "train_config.json"))
    print(json.dumps(report, indent=2, ensure_ascii=False))


def train_tfidf(args: argparse.Namespace) -> None:
    spark = get_session()
    corpus = readers.read_labelled(spark, args.data)
    corpus = corpus.withColumn("label", F.col("label").cast("int").cast("string"))
    words = readers.read_stop_words(args.stop_words) if args.stop_words else tfidf.STOP_WORDS
    model, held_out = pipeline.train_linear(corpus, stop_words=words)
    model.save(args.save_dir)
    print(json.dumps(_report(held_out, "1"), indent=2))


def _models(spark, args):
    """(TF-IDF model or None, naive Bayes model or None): the former is preferred where it can be read.

    Without any path the folders that training writes by default are taken, where they are there.
    """
    if not args.model and not args.tfidf_model:
        args.model = DEFAULT_MODEL if os.path.exists(DEFAULT_MODEL) else None
        args.tfidf_model = DEFAULT_TFIDF if os.path.exists(DEFAULT_TFIDF) else None
    if args.tfidf_model:
        try:
            return linear.load(spark, args.tfidf_model, args.tfidf_vect), None
        except Exception as e:
            print(f"TF-IDF model not used: {e}", file=sys.stderr)
    if not args.model:
        raise SystemExit("a naive Bayes model (--model) or a TF-IDF model (--tfidf-model) is needed")
    return None, pipeline.load_text_model(spark, args.model, tuple(args.ngram_range), args.lowercase, args.vocab)


def evaluate(args: argparse.Namespace) -> None:
    spark = get_session()
    corpus = readers.read_evaluation(spark, args.data)
    weighted, bayes = _models(spark, args)
    if weighted:
        found = weighted.predict(corpus.select("doc_id", tfidf.terms(F.col("text")).alias("terms")))
        rows = corpus.select("doc_id", "text", F.col("label").alias("true")).join(found.withColumnRenamed("label", "pred"), "doc_id")
        report = _report(rows, args.pos_label or "1")
    else:
        rows = pipeline.evaluate(bayes, corpus)
        report = _report(rows, args.pos_label or "spam")
    if args.output:
        writers.write_report({"metrics": report}, args.output)
        writers.write_predictions(rows.select("text", F.col("pred").alias("label"), "probs"), args.output + ".predictions")
    else:
        print(json.dumps(report, indent=2, ensure_ascii=False))


def predict(args: argparse.Namespace) -> None:
    spark = get_session()
    began = time.perf_counter()
    docs = spark.createDataFrame([(0, args.text)], "doc_id long, text string") if args.text is not None else readers.read_prediction_input(spark, args.input_file)
    weighted, bayes = _models(spark, args)
    if weighted:
        found = docs.join(weighted.predict(docs.select("doc_id", tfidf.terms(F.col("text")).alias("terms"))), "doc_id")
    else:
        found = bayes.predict(docs)
    if args.output_file:
        writers.write_prediction_file(found.orderBy("doc_id"), args.output_file)
    else:
        for row in writers.prediction_lines(found.orderBy("doc_id")).toLocalIterator():
            print(row.value)
    print(f"{time.perf_counter() - began:.3f} s", file=sys.stderr)


def neighbours(args: argparse.Namespace) -> None:
    """Labels the rows of one feature file by their nearest rows in another, and prints sizes, time and accuracy."""
    spark = get_session()
    began = time.perf_counter()
    train, error = pipeline.load_knn(spark, args.train, args.n_features, not args.no_header)
    if error:
        raise SystemExit(error)
    asked = cut(readers.read_features(spark, args.test, args.n_features, not args.no_header), "asked")
    found = knn.predict(train, asked.select("id", "v"), args.k, args.tie).select(F.col("qid").alias("id"), F.col("label").alias("pred"))
    both = cut(asked.select("id", "label").join(found, "id"), "predicted")
    share = knn.accuracy(both, F.col("label"), F.col("pred")).first().accuracy
    print(json.dumps({"train": train.count(), "test": both.count(), "k": args.k, "seconds": round(time.perf_counter() - began, 3), "accuracy": share}))
    if args.output_file:
        writers.write_prediction_file(both.orderBy("id").select(F.col("id").cast("string").alias("text"), F.col("pred").cast("string").alias("label")), args.output_file)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexmill")
    commands = parser.add_subparsers(required=True)

    def command(name, run, *options):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for flags, settings in options:
            sub.add_argument(flags, **settings)
        return sub

    models = [("--model", {}), ("--vocab", {}), ("--tfidf-model", {}), ("--tfidf-vect", {}), ("--ngram-range", {"nargs": 2, "type": int, "default": [1, 1]}), ("--lowercase", {"action": "store_true"})]
    command("train", train, ("--data", {"required": True}), ("--config", {}), ("--save_dir", {"default": DEFAULT_MODEL}))
    command("train-tfidf", train_tfidf, ("--data", {"required": True}), ("--save_dir", {"default": DEFAULT_TFIDF}), ("--stop-words", {}))
    command("evaluate", evaluate, ("--data", {"required": True}), ("--output", {}), ("--pos-label", {}), *models)
    which = command("predict", predict, ("--output-file", {}), *models).add_mutually_exclusive_group(required=True)
    which.add_argument("--text")
    which.add_argument("--input-file")
    number = {"type": int}
    command("knn", neighbours, ("--train", {"required": True}), ("--test", {"required": True}), ("--k", number | {"default": 9}), ("--n-features", number), ("--tie", {"choices": ("nearest", "one"), "default": "nearest"}), ("--no-header", {"action": "store_true"}), ("--output-file", {}))
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
