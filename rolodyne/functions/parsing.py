"""Parsing of durations, structured replies and binary message bodies."""

from __future__ import annotations

import json
import re
from datetime import timedelta
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text


def duration(literal: str) -> timedelta:
    """24h, 7d or 30m."""
    m = re.fullmatch(r"\s*(\d+)\s*([hdm])\s*", literal.lower())
    if not m:
        raise ValueError(f"not a duration: {literal!r} (expected a number and h, d or m)")
    return timedelta(**{{"h": "hours", "d": "days", "m": "minutes"}[m[2]]: int(m[1])})


def reply(answer: str | None, many: bool = False):
    """The JSON of a model's answer: fences are taken off, and where the rest
    doesn't parse, what stands between the outermost brackets is tried. With
    many, a list is wanted, or an object's results."""
    if not answer or not answer.strip():
        return None
    body = answer.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[1] if "\n" in body else ""
        body = re.split(r"(?m)^\s*```\s*$", body)[0]
    opening, closing = ("[", "]") if many else ("{", "}")
    candidates = [body, body[body.find(opening) : body.rfind(closing) + 1] if opening in body else ""]
    for c in candidates:
        try:
            found = json.loads(c)
        except ValueError:
            continue
        if many and isinstance(found, dict):
            found = found.get("results")
        return found if not many or isinstance(found, list) else None
    return None


def numbered(answer: str | None, count: int) -> list[str | None]:
    """Lines such as "3. text" as a list of that many; missing numbers are null."""
    found = {int(n): t.strip() for n, t in re.findall(r"(?m)^\s*(\d+)[.):]\s*(.+)$", answer or "")}
    return [found.get(k) for k in range(1, count + 1)]


def body_text(blob: bytes | None) -> str | None:
    """The text of a typed-stream message body: after the string class and five
    bytes of its reference stand the length (one byte, or 0x81 and two, or 0x82
    and four, little-endian) and the UTF-8 text."""
    if not blob or not blob.startswith(b"\x04\x0bstreamtyped"):
        return None
    _, mark, rest = blob.partition(b"NSString")
    rest = rest[5:]
    if not mark or not rest:
        return None
    wide = {0x81: 2, 0x82: 4}.get(rest[0], 0)
    size = int.from_bytes(rest[1 : 1 + wide], "little") if wide else rest[0]
    data = rest[1 + wide :][:size]
    if not size or len(data) < size:
        return None
    return data.decode("utf-8", "ignore").strip() or None


def decoded_body(c: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(blobs: pd.Series) -> pd.Series:
        return pd.Series([body_text(b) for b in blobs], dtype="object")

    return run(c)


def people_search_url(name: Column, company: Column) -> Column:
    """Address of a people search for a name and a company."""
    words = F.trim(F.concat_ws(" ", text(name), text(company)))
    return F.concat(F.lit("https://www.linkedin.com/search/results/people/?keywords="), F.url_encode(words))


def search_url(name: str, company: str = "") -> str:
    return "https://www.linkedin.com/search/results/people/?keywords=" + quote_plus(f"{name} {company}".strip())


def same_person(a: Column, b: Column, threshold: float = 70.0) -> Column:
    """Whether two names are one person's: the better of both ratios of their folded forms."""
    from .similarity import ratio, token_sort_ratio
    from .text import compare_key

    x, y = compare_key(a), compare_key(b)
    return F.greatest(ratio(x, y), token_sort_ratio(x, y)) >= threshold
