"""Expressions that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a longest run of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: Column, remainder: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo 5; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 5 == remainder


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose id is among ``ids``; null matches null."""
    wanted = ids.select(F.col(id_col).alias("_wanted_id")).distinct()
    return docs.join(wanted, F.col(id_col).eqNullSafe(F.col("_wanted_id")), "left_semi")
