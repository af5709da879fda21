"""Chat-format training rows, and the prompts of generation and extraction."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.recover import kind

#: Fixed value of the training format.
PREFIX = "Extract structured invoice data from the following document:"
#: Default instruction; any text may be given instead.
SYSTEM = (
    "You extract invoices and receipts from plain text. Answer with one JSON object and nothing else. Use null for what the "
    "document doesn't say, YYYY-MM-DD for dates, a fraction for tax_rate (0.08 is 8 %), a three-letter currency code, "
    "and at least one entry in line_items."
)


def compact(record: Column) -> Column:
    """JSON without blanks, fields in the order of the record, nulls kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def _dumps(value) -> str:
    """Compact JSON; a lone surrogate, which no UTF-8 text can hold, is a ValueError."""
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    out.encode("utf-8")
    return out


@F.pandas_udf(T.StringType())
def _compact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return _dumps(json.loads(text))
        except (ValueError, RecursionError):
            return None

    for t in texts:
        yield t.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def _compact_payload(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(line: str | None) -> str | None:
        try:
            return _dumps(json.loads(line or "")["ground_truth_json"])
        except (ValueError, KeyError, TypeError, RecursionError):
            return None

    for t in lines:
        yield t.map(one)


def compact_text(text: Column) -> Column:
    """JSON text without blanks, keys in their order and numbers as they are; null if it isn't JSON or holds a lone surrogate.

    Python on executors, as a VARIANT sorts its keys and drops the zeros of 150.0, and nothing built in re-spaces a text.
    """
    return _compact(text)


def payload_text(line: Column) -> Column:
    """``compact_text`` of the payload of an example's source line."""
    return _compact_payload(line)


def turns(system: Column, user: Column, answer: Column) -> Column:
    pair = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.array(pair("system", system), pair("human", user), pair("gpt", answer))


def render(df: DataFrame, text: str = "document_text", payload: str = "ground_truth_json", system: str = SYSTEM, source: str = "ground_truth_text") -> DataFrame:
    """Rows (id, conversations, difficulty, scenario_id); rows without text or payload are left out.

    The answer is the payload's JSON, compact, in the order of its keys: of a column ``source`` (text) if df has one, else of
    the payload as JSON text or struct. A VARIANT alone has lost order and number format and gives them as it can. An
    empty object counts as none.
    """
    doc = X.strip(F.coalesce(F.col(text), F.lit("")))
    kinds = dict(df.dtypes)
    if source in kinds:
        answer = compact_text(F.col(source))
    elif kinds[payload] == "string":
        answer = compact_text(F.col(payload))
    elif kinds[payload] == "variant":
        answer = F.when(kind(F.col(payload)) == "OBJECT", F.to_json(F.col(payload)))
    else:
        answer = compact(F.col(payload))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = df.select(empty("id"), doc.alias("doc"), answer.alias("answer"), empty("difficulty"), empty("scenario_id"))
    rows = rows.where((F.col("doc") != "") & F.col("answer").isNotNull() & ~F.col("answer").isin("{}", "null", "[]", '""', "0", "false"))
    return rows.select("id", turns(F.lit(system), F.concat(F.lit(PREFIX + "\n\n"), "doc"), F.col("answer")).alias("conversations"), "difficulty", "scenario_id")


def stats(examples: DataFrame, rendered: DataFrame) -> DataFrame:
    """One row: input, output, skipped."""
    both = examples.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(rendered.select(F.lit(0), F.lit(1)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(total("i").alias("input"), total("o").alias("output")).withColumn("skipped", F.col("input") - F.col("output"))


def extraction_prompt(document: Column, instruction: str) -> Column:
    return F.concat(F.lit(instruction), document)


def generation_prompt(scenario: dict[str, Column], contract: str) -> Column:
    """The user prompt for a scenario: name, difficulty, currency, style, and its edge cases as bullets if it has any."""
    bullets = F.array_join(F.transform(scenario["edge_cases"], lambda c: F.concat(F.lit("  • "), c)), "\n")
    block = F.when(F.size(scenario["edge_cases"]) > 0, F.concat(F.lit("\n\nEdge cases that the document must show:\n"), bullets)).otherwise("")
    return F.concat(
        F.lit("Write one synthetic document: "), scenario["name"], F.lit(".\n\nDifficulty: "), F.upper(scenario["difficulty"]), F.lit("\nCurrency: "), scenario["currency"],
        F.lit("\n\nStyle:\n"), scenario["style_notes"], block, F.lit("\n\nThe record must conform to:\n" + contract + "\n\nAnswer with a JSON object with the keys document_text and ground_truth_json only."),
    )


def from_turns(df: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, conversations) from a table of single turns, in order, with roles renamed for training."""
    who = F.when(F.col(role) == "assistant", "gpt").when(F.col(role) == "user", "human").otherwise(F.col(role))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), who.alias("from"), F.col(text).alias("value"))))
    return df.groupBy(F.col(by).alias("conv_id")).agg(F.transform(listed, lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))
