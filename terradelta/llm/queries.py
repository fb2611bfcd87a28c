"""The training-data queries, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from terradelta.llm.common import ship

#: query: (module of this subpackage, function)
FOUND = {
    "op7_tool_chat": "tool_chat",
    "op2_html_text": "html_text",
    "op8_class_lm": "class_lm",
    "op3_mixing": "mixing",
    "op6_line_dedup": "line_dedup",
    "op9_tiff_media": "tiff_media",
    "op1_sentencepiece": "sentencepiece_codec",
    "op5_token_output": "token_output",
    "op4_quality_rules": "quality_rules",
    "op10_ngram_join": "ngram_join",
    "op11_spelling": "spelling",
    "op12_toxicity": "toxicity",
    "op13_fill_middle": "fill_middle",
}


def _shipping(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipping(getattr(import_module(f"terradelta.llm.{module}"), name)) for name, module in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from terradelta.llm import fill_middle, ngram_join, quality_rules, tool_chat

    return {"op4_quality_rules": quality_rules.ORACLE, "op7_tool_chat": tool_chat.ORACLE, "op10_ngram_join": ngram_join.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
