"""Contract templates: ordered runs of text with ``{{ Field }}`` placeholders."""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
TEMPLATE_SCHEMA = (
    "template_id STRING, part STRING, section INT, run_seq INT, text STRING, "
    "underline STRING, color STRING"
)


@dataclass(frozen=True)
class Run:
    """A run of a template that is known when the job is written; one without text adds nothing."""

    part: str
    section: int
    run_seq: int
    text: str | None
    underline: str | None = None
    color: str | None = None

    def pieces(self) -> list[tuple[str, str | None]]:
        """Literal text and the field that follows it; None after the last literal."""
        if self.text is None:
            return []
        tokens = re.split(PLACEHOLDER, self.text)
        return list(zip(tokens[0::2], [*tokens[1::2], None]))


def scan_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATE_SCHEMA).parquet(path)


def tokenize_templates(templates: DataFrame) -> DataFrame:
    """Adds ``literals`` and ``fields``: the text around the placeholders and their names."""
    text = F.col("text")
    return templates.withColumns(
        {
            "literals": F.split(text, PLACEHOLDER, -1),
            "fields": F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)),
        }
    )
