"""Label normalisation: 0, 1 or NULL for anything invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words and their codes.
LABEL_CODES = {"benign": 0, "malicious": 1}
LABEL_WORDS = {code: word for word, code in LABEL_CODES.items()}


def label_from_text(c: Column) -> Column:
    """Words in any case, or digits that amount to 0 or 1. Blanks are not trimmed."""
    word = F.lower(c)
    out = F.when(word.rlike(r"^0+\z"), 0).when(word.rlike(r"^0*1\z"), 1)
    for name, code in LABEL_CODES.items():
        out = out.when(word == name, code)
    return out.cast("int")


def label_from_number(c: Column) -> Column:
    return F.when(c == 0, 0).when(c == 1, 1).cast("int")


def label_from_variant(v: str) -> Column:
    """Label held in the VARIANT column ``v``; JSON booleans and numbers count as themselves."""
    kind = F.expr(f"schema_of_variant({v})")
    as_text = F.expr(f"try_variant_get({v}, '$', 'string')")
    as_number = F.expr(f"try_variant_get({v}, '$', 'double')")
    as_bool = F.expr(f"try_variant_get({v}, '$', 'boolean')")
    numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return (
        F.when(kind == "STRING", label_from_text(as_text))
        .when(kind == "BOOLEAN", as_bool.cast("int"))
        .when(numeric, label_from_number(as_number))
    )


def label_word(c: Column) -> Column:
    """0/1 to words; anything else is ``unknown``."""
    return F.when(c == 0, LABEL_WORDS[0]).when(c == 1, LABEL_WORDS[1]).otherwise("unknown")


def verdict_code(c: Column) -> Column:
    """Verdict word to 1.0 or 0.0; a missing or unknown word counts as benign."""
    return F.when(F.lower(c.cast("string")) == "malicious", 1.0).otherwise(0.0)
