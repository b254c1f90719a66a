"""Landed provider responses."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rolloom.constants import DEFAULT_PROVIDER

RESPONSE_SCHEMA = StructType(
    [
        StructField("batch_no", LongType()),
        StructField("provider", StringType()),
        StructField("status", IntegerType()),
        StructField("raw", StringType()),
    ]
)

# --- fixed values: where a provider's envelope holds the text -----------------------------------
TEXT_PATHS = {
    "anthropic": "$.content[0].text",
    "huggingface": "$.choices[0].message.content",
    DEFAULT_PROVIDER: "$.text",
}


def provider_name(provider: Column, known: Iterable[str] = TEXT_PATHS) -> Column:
    """Lower-cased; a missing or unknown provider is handled as the default one."""
    name = F.lower(provider)
    return F.when(name.isin(*known), name).otherwise(F.lit(DEFAULT_PROVIDER))


def unwrap_response(
    responses: DataFrame,
    raw: str = "raw",
    out: str = "text",
    paths: Mapping[str, str] = TEXT_PATHS,
) -> DataFrame:
    """Take the model's text out of the provider's envelope.

    ``paths`` names the providers told apart; it holds the default one.
    """
    name = provider_name(F.col("provider"), paths)
    text = F.lit(None).cast("string")
    for provider, path in paths.items():
        text = F.when(name == provider, F.get_json_object(raw, path)).otherwise(text)
    return responses.withColumns({"provider": name, out: text})


def is_accepted() -> Column:
    """No HTTP error; a missing status is one."""
    return F.coalesce(F.col("status") < 400, F.lit(False))


def split_by_status(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses without an HTTP error, and the quarantine of all others."""
    accepted = is_accepted()
    return responses.filter(accepted), responses.filter(~accepted)
