"""Arrow functions for what Spark has no built-in for: Unicode normal forms, sort keys, title case, Mac Roman."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .titles import title_case_text


def normalised(c: Column, form: str = "NFKC") -> Column:
    @F.pandas_udf(StringType())
    def to_form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return to_form(c)


@F.pandas_udf(StringType())
def sort_key(name: pd.Series) -> pd.Series:
    """Trimmed, lower-cased, without combining marks."""

    def key(t: str) -> str:
        return "".join(x for x in unicodedata.normalize("NFKD", t.strip().lower()) if not unicodedata.combining(x))

    return name.map(key, na_action="ignore")


@F.pandas_udf(StringType())
def mac_roman(text: pd.Series) -> pd.Series:
    """Characters that Mac Roman lacks as <0xXXXX>."""

    def encode(t: str) -> str:
        return "".join(x if x.encode("mac_roman", "ignore") else f"<0x{ord(x):04X}>" for x in t)

    return text.map(encode, na_action="ignore")


@F.pandas_udf(StringType())
def title_case(text: pd.Series) -> pd.Series:
    return text.map(title_case_text, na_action="ignore")
