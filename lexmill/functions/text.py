"""Column expressions over texts, tokens, labels and class probabilities; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a longest run of these characters.
TOKEN = "[a-z0-9]+"
#: Fixed value: a TF-IDF token is a run of two or more word characters.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Labels that mean the positive class.
POSITIVE = ("1", "spam", "true", "t")


def tokens(text: Column, lowercase: bool = True) -> Column:
    """All tokens of a text in order; null gives an empty array.

    Without ``lowercase`` capital letters separate tokens, as they aren't token characters.
    """
    text = F.lower(text) if lowercase else text
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text: Column) -> Column:
    """TF-IDF tokens: lower-cased runs of two or more letters, digits or underscores; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(items: Column, lowercase: bool = True) -> Column:
    """Ready-made tokens, lower-cased if asked; they are not cut again."""
    return F.transform(items, F.lower) if lowercase else items


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks, repeats kept; the tokens themselves for ``n`` up to 1, none if too few."""
    if n <= 1:
        return items
    count = F.greatest(F.size(items) - (n - 1), F.lit(0))
    some = F.slice(items, 1, count)
    for j in range(1, n):
        some = F.zip_with(some, F.slice(items, j + 1, count), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(items) >= n, some).otherwise(F.array().cast("array<string>"))


def ngram_range(items: Column, low: int, high: int) -> Column:
    """n-grams for every n from ``low`` to ``high``, by rising n; empty if ``high < low``."""
    if high < low:
        return F.array().cast("array<string>")
    return F.flatten(F.array(*(ngrams(items, n) for n in range(low, high + 1))))


def joined(items: Column) -> Column:
    """Tokens as one text, parted by single blanks."""
    return F.array_join(items, " ")


def label_number(label: Column) -> Column:
    """0 or 1, or another whole number, of a label: a number is truncated, else 1 iff it is a positive alias; null gives 0."""
    number = label.try_cast("double").try_cast("int")
    return F.coalesce(number, F.when(F.lower(F.trim(label)).isin(*POSITIVE), 1).otherwise(0))


def class_label(label: Column) -> Column:
    """Predicted labels as 0 or 1: 1 for ``spam`` and ``1`` in any case, whole numbers as they are, else by alias."""
    text = F.lower(F.trim(label))
    return F.coalesce(F.when(text.isin("spam", "1"), 1), label.try_cast("int"), F.when(text.isin("1", "spam", "true"), 1).otherwise(0))


def probabilities(values: Column, classes: list[str] | None = None) -> Column:
    """An array of probabilities as a map by class name, or by position if no names are given; null gives an empty map."""
    if classes is None:
        keys = F.transform(F.sequence(F.lit(0), F.size(values) - 1), lambda i: i.cast("string"))
        keys = F.when(F.size(values) > 0, keys).otherwise(F.array().cast("array<string>"))
    else:
        keys = F.slice(F.array(*map(F.lit, classes)), 1, F.greatest(F.size(values), F.lit(0)))
        values = F.slice(values, 1, len(classes))
    return F.coalesce(F.map_from_arrays(keys, values), F.create_map().cast("map<string,double>"))


def with_both_classes(probs: Column) -> Column:
    """A probability map in which ``0`` and ``1`` are present, 0.0 where they were missing; null is an empty map."""
    missing = lambda key: F.coalesce(F.try_element_at(probs, F.lit(key)), F.lit(0.0))
    rest = F.map_filter(F.coalesce(probs, F.create_map().cast("map<string,double>")), lambda k, _: ~k.isin("0", "1"))
    return F.map_concat(F.create_map(F.lit("0"), missing("0"), F.lit("1"), missing("1")), rest)


def confidence(probs: Column, label: Column) -> Column:
    """The label's probability in per cent, to one decimal; 0 if label or probability is unknown."""
    return F.round(100 * F.coalesce(F.try_element_at(probs, label.cast("string")), F.lit(0.0)), 1)


def prediction_text(line: Column) -> Column:
    """The text of an input line: the ``text`` field of a JSON object, otherwise the line itself, trimmed.

    Strings come as they are; other values come in Python notation: None, True, False, or the
    JSON text of numbers, lists and objects.  A line that is no JSON object with that field is a text itself.
    """
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    fields = F.from_json(line, "map<string,string>")
    shape = F.try_parse_json(line)
    kind = F.schema_of_variant(F.try_variant_get(shape, "$.text", "variant"))
    value = fields["text"]
    shown = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(value)).otherwise(value)
    has = line.startswith("{") & shape.isNotNull() & F.array_contains(F.map_keys(fields), "text")
    return F.when(has, F.coalesce(shown, F.lit("None"))).otherwise(line)
