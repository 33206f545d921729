"""Extraction of (value, unit) answers: running an extractor, reading its answers, merging attempts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.schemas import RESULTS

# number followed by a unit word or sign
ANY_QUANTITY = r"\d[\d.,]*\s*(?:[%€$£]|[^\W\d_])"  # where ``FIRST_QUANTITY`` finds one, found faster
FIRST_QUANTITY = r"(-?\d[\d.,]*)\s*([%€$£]|[^\W\d_][\w²³₂/]*)"


def first_quantity(context: Column) -> Column:
    """Built-in extractor: the first number with a unit, as a JSON answer."""
    part = lambda found, i, name: F.nullif(F.regexp_extract(found, FIRST_QUANTITY, i), F.lit("")).alias(name)
    answer = lambda found: F.struct(part(found, 1, "value"), part(found, 2, "unit"))
    # a long text is not searched for each part; the one-element ``transform`` binds what was found
    first = F.transform(F.array(F.when(context.rlike(ANY_QUANTITY), F.regexp_extract(context, FIRST_QUANTITY, 0))), answer)
    return F.to_json(F.get(first, F.lit(0)), {"ignoreNullFields": "false"})


NO_QUANTITY = '{"value":null,"unit":null}'  # what ``first_quantity`` says without one
HEAD_AS_UNIT = '"unit":"Chunk"}'  # how its answer ends if a block's number stands before the next block's head


def block_answers(inner: Column, last: Column) -> Column:
    """The built-in extractor's answers to one block of a context: with the head of a next block after it, and as the last one.

    Null if there is none. The two differ only where that head is taken for a unit, so only there is the second one looked for.
    """
    named = lambda a: F.when(a != NO_QUANTITY, a)
    other = lambda a: F.when(F.endswith(a, F.lit(HEAD_AS_UNIT)), named(first_quantity(last))).otherwise(named(a))
    return F.get(F.transform(F.array(first_quantity(inner)), lambda a: F.struct(named(a).alias("inner"), other(a).alias("last"))), F.lit(0))


def first_answer(answers: Column) -> Column:
    """``first_quantity`` of a context from the ``block_answers`` of its blocks; a block's head holds no quantity."""
    inner = F.filter(F.slice(answers["inner"], 1, F.greatest(F.size(answers) - 1, F.lit(0))), lambda a: a.isNotNull())
    return F.coalesce(F.get(inner, F.lit(0)), F.try_element_at(answers["last"], F.lit(-1)), F.lit(NO_QUANTITY))


def run_extractor(df: DataFrame, prompt: str, model: Callable[[list[str]], list[str]] | None = None, out: str = "raw_output", answers: Column | None = None) -> DataFrame:
    """Answer text per prompt, from a batch model or the built-in extractor.

    A batch the model fails on yields null answers, which a later attempt can redo. ``answers`` are the built-in
    extractor's ``block_answers`` to the prompt's blocks, for a caller whose blocks stand in many prompts.
    """
    if model is None:
        return df.withColumn(out, first_quantity(F.col(prompt)) if answers is None else first_answer(answers))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                texts = model(batch[prompt].tolist())
            except Exception:
                texts = [None] * len(batch)
            yield batch.assign(**{out: texts})

    return df.mapInPandas(answer, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def without_thousands(text: Column) -> Column:
    """Remove commas between digits."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", "")


def _json_object(text: Column, read) -> Column:
    """``read`` applied to the one JSON object that is the whole text, null otherwise.

    Parsed once, inside brackets, so that trailing text or a second value counts
    as an error; the one-element ``transform`` binds the result.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", {"allowSingleQuotes": "false"})
    one = lambda values: F.when(F.size(values) == 1, read(F.get(values, F.lit(0))))
    return F.get(F.transform(F.array(listed), one), F.lit(0))


def _answer(fields: Column) -> Column:
    return F.struct(F.try_element_at(fields, F.lit("value")).alias("value"), F.try_element_at(fields, F.lit("unit")).alias("unit"))


def strict_answer(text: Column) -> Column:
    """(value, unit) of a JSON object with exactly these two keys, null otherwise."""
    exact = lambda m: F.array_sort(F.array_distinct(F.map_keys(m))) == F.array(F.lit("unit"), F.lit("value"))
    return _json_object(text, lambda m: F.when(exact(m), _answer(m)))


def python_to_json(text: Column) -> Column:
    """The bare words of a Python literal as JSON ones; single quotes are left to the reader."""
    out = text
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"(?<=[:,\[])(\s*){word}\b", f"$1{json_word}")
    return out


def stored_answer(text: Column) -> Column:
    """(value, unit) of a stored answer: a JSON object, else a Python dict literal, else null."""
    body = F.trim(text)
    schema = "value string, unit string, _corrupt string"
    lenient = F.from_json(python_to_json(body), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    literal = F.when(body.rlike(r"(?s)^\{.*\}$") & lenient["_corrupt"].isNull(), lenient)
    strict = _json_object(body, lambda m: F.when(m.isNotNull(), _answer(m)))
    return F.coalesce(strict, F.when(literal.isNotNull(), F.struct(literal["value"].alias("value"), literal["unit"].alias("unit"))))


def has_value(answer: Column) -> Column:
    """A value that is neither null nor blank."""
    return F.coalesce(F.trim(answer["value"]) != "", F.lit(False))


def result_records(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The full result record in its declared types, after the columns to ``keep``; a missing or failed part is null."""
    schema = T.StructType.fromDDL(RESULTS)
    answer = strict_answer(without_thousands(F.col("raw_output")))
    ready = df.withColumn("model_output", answer).withColumns(
        {
            "model_output_valid": F.col("model_output").isNotNull(),
            "value": F.col("model_output.value"),
            "unit": F.col("model_output.unit"),
        }
    )
    have = set(ready.columns)
    return ready.select(*keep, *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def still_to_do(work: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work items without a valid previous result."""
    valid = previous.where(F.col("model_output_valid")).select(*keys)
    return work.join(valid.distinct(), list(keys), "left_anti")


def merged_attempts(attempts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: a valid one first, then the earliest by ``order``.

    A minimum over structs combines before the shuffle, however many attempts a key has.
    """
    rest = [c for c in attempts.columns if c not in keys]
    first = F.struct((~F.col("model_output_valid")).alias("__invalid"), *[F.col(c).alias(f"__{c}") for c in order])
    best = F.min_by(F.struct(*rest), first)
    return attempts.groupBy(*keys).agg(best.alias("__b")).select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])
