"""Unicode work that Spark has no function for, as Arrow functions. ASCII values skip Python."""

from __future__ import annotations

import difflib
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII = r"^[\x00-\x7F]*$"


@cache
def _normaliser(form: str, fold: bool):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize(form, v).casefold() if fold else unicodedata.normalize(form, v))

    return run


def nfc(c: Column) -> Column:
    return F.when(c.rlike(_ASCII), c).otherwise(_normaliser("NFC", False)(c))


def nfkc(c: Column) -> Column:
    return F.when(c.rlike(_ASCII), c).otherwise(_normaliser("NFKC", False)(c))


def nfkc_casefold(c: Column) -> Column:
    return F.when(c.rlike(_ASCII), F.lower(c)).otherwise(_normaliser("NFKC", True)(c))


@cache
def _ratio():
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity (difflib's)."""
    return _ratio()(a, b)
