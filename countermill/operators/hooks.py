"""Points where a user replaces a step of the reading pipeline.

A transformer and a validator are plain functions from a row's columns to a column, so a
replacement stays inside the generated code; a pandas_udf fits the same shape. A processor
replaces the whole pipeline and is a function from polls and channels to readings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countermill.functions.quality import grade_quality
from countermill.functions.scaling import transform_value
from countermill.functions.tags import enrich_tags

ColumnRule = Callable[[Callable[[str], Column]], Column]
Processor = Callable[[DataFrame, DataFrame], DataFrame]


def default_transformer(c: Callable[[str], Column]) -> Column:
    return transform_value(c("raw_value"), c("scale_factor"), c("offset"), c("decimal_places"))


def default_validator(c: Callable[[str], Column]) -> Column:
    return grade_quality(
        c("raw_value"),
        c("rate"),
        c("min_value"),
        c("max_value"),
        c("max_rate_of_change"),
        c("overflow_threshold"),
        c("overflow_check"),
    )


def default_tagger(c: Callable[[str], Column]) -> Column:
    return enrich_tags(
        c("tags"),
        c("name"),
        c("description"),
        c("start_register"),
        c("register_count"),
        c("scale_factor"),
        c("offset"),
    )


@dataclass(frozen=True)
class Rules:
    """The replaceable steps, each with the channel columns it reads."""

    transformer: ColumnRule = default_transformer
    transformer_columns: tuple[str, ...] = ("scale_factor", "offset", "decimal_places")
    validator: ColumnRule = default_validator
    validator_columns: tuple[str, ...] = (
        "min_value",
        "max_value",
        "max_rate_of_change",
        "overflow_threshold",
        "overflow_check",
    )
    tagger: ColumnRule = default_tagger
    tagger_columns: tuple[str, ...] = (
        "name",
        "description",
        "start_register",
        "register_count",
        "scale_factor",
        "offset",
        "tags",
    )


def custom_validator(rule: ColumnRule, columns: tuple[str, ...] = (), base: Rules = Rules()) -> Rules:
    """Rules with another grade."""
    return Rules(
        base.transformer, base.transformer_columns, rule, columns, base.tagger, base.tagger_columns
    )


def custom_transformer(
    rule: ColumnRule,
    columns: tuple[str, ...] = (),
    tagger: ColumnRule | None = None,
    tagger_columns: tuple[str, ...] = (),
    base: Rules = Rules(),
) -> Rules:
    """Rules with another value transform and, when given, another tagger."""
    return Rules(
        rule,
        columns,
        base.validator,
        base.validator_columns,
        tagger or base.tagger,
        tagger_columns if tagger else base.tagger_columns,
    )


def custom_processor(polls: DataFrame, channels: DataFrame, processor: Processor) -> DataFrame:
    """Run a processor that replaces decode, transform, rate, grade and tags."""
    return polls.transform(lambda df: processor(df, channels))
