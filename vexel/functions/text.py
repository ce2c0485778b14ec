"""String functions of the catalogue and of the text entry point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeds(text: Column) -> Column:
    """array<string>: addresses split at commas and white space; what is empty or has no colon is dropped. Null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: (x != "") & F.contains(x, F.lit(":")))


def host(address: Column) -> Column:
    """What stands before the first colon; localhost for null or no colon."""
    return F.when(F.contains(address, F.lit(":")), F.substring_index(address, ":", 1)).otherwise("localhost")


def port(advertised: Column, fallback: Column | str | None) -> Column:
    """The advertised port if positive, else the fallback parsed as an integer; null if that fails."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(advertised > 0, advertised).otherwise(F.trim(other).try_cast("int"))


def collection(name: Column) -> Column:
    """Trimmed; null and blank give an empty string."""
    return F.coalesce(F.trim(name), F.lit(""))


def flag(text: Column) -> Column:
    """True for everything but "false" in any case; null is true."""
    return F.coalesce(F.lower(text) != "false", F.lit(True))


def prefixed(text: Column, prefix: str = "query: ") -> Column:
    """The prefix and the text; a null text gives null."""
    return F.concat(F.lit(prefix), text)


def embeddings(json: Column) -> Column:
    """array<array<float>> of a JSON list of lists; an error for malformed JSON."""
    return F.from_json(json, "array<array<float>>", {"mode": "FAILFAST"})


def has_embedding(vectors: Column) -> Column:
    """Whether an array<array<float>> has a first element that is not empty; only that one counts."""
    return F.coalesce((F.size(vectors) > 0) & (F.size(F.get(vectors, 0)) > 0), F.lit(False))


def first_embedding(vectors: Column) -> Column:
    """array<float>: the first of an array<array<float>>; an error where there is none."""
    return F.when(has_embedding(vectors), F.get(vectors, 0)).otherwise(F.raise_error(F.lit("no embedding")))
