"""Privacy masks, each a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EMAIL, text


def mask_email(c: Column) -> Column:
    """First letter of the local part and of the domain stay: a***@b***.com."""
    return F.regexp_replace(text(c), r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9])[A-Za-z0-9.-]*(\.[A-Za-z]{2,})", "$1***@$2***$3")


def mask_phone(c: Column) -> Column:
    """All digits but the last two become *."""
    c = text(c)
    return F.concat(F.regexp_replace(F.left(c, F.greatest(F.length(c) - 2, F.lit(0))), r"\d", "*"), F.right(c, F.least(F.length(c), F.lit(2))))


def mask_name(c: Column) -> Column:
    """First letter of each word and ***."""
    return F.regexp_replace(text(c), r"(\p{L})\p{L}*", "$1***")


def mask_last_name(c: Column) -> Column:
    """The first word stays; of the last one its first letter."""
    return F.regexp_replace(text(c), r"^(\S+)\s+(?:.*\s)?(\S)\S*$", "$1 $2.")


def mask_address(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\d", "#")


def mask_url(c: Column) -> Column:
    """Host stays, the path becomes /***."""
    return F.regexp_replace(text(c), r"^([a-zA-Z]+://[^/?#]+)[/?#].*$", "$1/***")


def mask_field(field: Column, c: Column) -> Column:
    """The mask that a field path asks for; others stay."""
    low = F.lower(field)
    return (
        F.when(low.startswith("emailaddresses"), mask_email(c))
        .when(low.startswith("phonenumbers"), mask_phone(c))
        .when(low.startswith("names") & low.endswith("familyname"), mask_name(c))
        .when(low.startswith("names"), mask_last_name(c))
        .when(low.startswith("addresses"), mask_address(c))
        .when(low.startswith("urls"), mask_url(c))
        .otherwise(c)
    )


def mask_text(c: Column) -> Column:
    """Addresses within running text."""
    return F.regexp_replace(text(c), EMAIL, "***@***")
