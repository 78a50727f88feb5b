"""Prompts for judge models and parsers of their answers, without a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLARITY_PROMPT = "Rate how clear the sentiment of this text is: 0 clear, 1 partly clear, 2 unclear. Answer with one digit.\nText: "
ASPECTS = ("quality", "diversity", "importance")
SCHEMA = ", ".join(f"{a} struct<score:int, explanation:string>" for a in ASPECTS)


def prompt(text: Column, instruction: str = CLARITY_PROMPT, suffix: str = "\nAnswer: ") -> Column:
    """Instruction, stripped text, suffix; braces in any of them are plain text."""
    return F.concat(F.lit(instruction), F.trim(F.coalesce(text, F.lit(""))), F.lit(suffix))


def parse_digit(answer: Column, digits: str = "012", default: int = 1) -> Column:
    """The first of the digits in an answer; ``default`` without one."""
    found = F.regexp_extract(F.coalesce(answer, F.lit("")), f"[{digits}]", 0)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), F.lit(default))


def parse_json(answer: Column) -> Column:
    """Struct of the three aspects' scores and explanations from the first ``{`` to the last ``}``; null unless all scores are there."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, SCHEMA)
    whole = F.lit(True)
    for a in ASPECTS:
        whole = whole & parsed[a]["score"].isNotNull()
    return F.when(whole, parsed)
