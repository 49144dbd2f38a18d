"""Run logs: text lines to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field order of a processed line (fixed format).
LINE = (r"\[(\w+)\] Processed: (.+?) \| Duration: ([\d.]+)s \| Model: (\S+) \| Prompt chars: (\d+) \| Output chars: (\d+) \| "
        r"Tokens used: (\d+) \| Prompt tokens: (\d+) \| Completion tokens: (\d+) \| Total tokens: (\d+) \| "
        r"Estimated prompt tokens: (\d+) \| Estimated output tokens: (\d+) \| Expected max output tokens: (\d+) \| Token source: (\S+)")
FIELDS = (("stage", "string"), ("account", "string"), ("duration_s", "decimal(12,2)"), ("model", "string"),
          ("prompt_chars", "bigint"), ("output_chars", "bigint"), ("tokens_used", "bigint"), ("prompt_tokens", "bigint"),
          ("completion_tokens", "bigint"), ("total_tokens", "bigint"), ("est_prompt_tokens", "bigint"),
          ("est_output_tokens", "bigint"), ("expected_max", "bigint"), ("token_source", "string"))


def read_logs(spark: SparkSession, path: str, name: str = "processing.log") -> DataFrame:
    """Every log of that name below ``path``, one row per line, with the file it came from."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def arriving_logs(spark: SparkSession, path: str, name: str = "processing.log", files: int = 64) -> DataFrame:
    """``read_logs`` as a stream: logs that land below ``path``, ``files`` of them in a micro-batch."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("maxFilesPerTrigger", files).text(path)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def parse_logs(lines: DataFrame) -> DataFrame:
    """Typed columns for processed lines; other lines are dropped."""
    hit = lines.where(F.rlike("line", F.lit(LINE)))
    keep = [c for c in lines.columns if c != "line"]
    return hit.select(*keep, *[F.regexp_extract("line", LINE, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(FIELDS)])
