"""Fill-in-the-middle: texts cut in three at unit borders and put in another order.

A unit is a run of ASCII letters or any other single code point. One Aho-Corasick
automaton passes over the text and reports where the class of a character changes
(a pair of a letter and another character, either way round) and where a sentinel
stands; nothing is kept of the characters between. What lies between two changes
is a run of one class, so that its number of units is known without looking: one
for letters, its length for others. The running sums of those numbers give the
place after any number of units. Code points beyond ASCII are of the second class
and take one place each, so the automaton only knows 128 characters.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 documents so many are transformed, and of those so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in string.ascii_letters:
        for y in map(chr, range(128)):
            if y not in string.ascii_letters:
                a.add_word(x + y, 0)
                a.add_word(y + x, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


class Units:
    """The units of a text by the places where the class changes.

    n: how many there are; sentinel: whether the text holds one."""

    def __init__(self, text: str):
        plain = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter((2 * at + kind for at, kind in _automaton().iter(plain)), np.int64)
        self.sentinel = bool((events & 1).any())
        self.cuts = np.concatenate(([0], events[events & 1 == 0] >> 1, [len(plain)]))
        letters = np.arange(len(self.cuts) - 1) % 2 == (plain[:1] not in string.ascii_letters)
        self.single = letters if plain else letters[:0]
        sizes = np.diff(self.cuts) if plain else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(np.where(self.single, 1, sizes))))
        self.n = int(self.before[-1])

    def place(self, units: int) -> int:
        """Code points that the first so many units take."""
        if not units:
            return 0
        run = int(np.searchsorted(self.before, units)) - 1
        return int(self.cuts[run + 1]) if self.single[run] else int(self.cuts[run]) + units - int(self.before[run])


def transform(text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """-> (units, form, characters of prefix and of middle, output)."""
    u = Units(text)
    if not text or u.sentinel or h[2] % 100 >= CHANGED:
        return u.n, "plain", None, None, text
    one, two = sorted((h[0] % (u.n + 1), h[1] % (u.n + 1)))
    a, b = u.place(one), u.place(two)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SUFFIX_FIRST:
        return u.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return u.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws(doc_id: Column, seed: str = SEED) -> Column:
    """Four numbers of 32 bits from the seed and an id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda at: F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """-> (id_col, n, form, prefix_chars, middle_chars, output), one row per row.

    A null text is empty; empty texts, those that hold a sentinel and one in ten
    stay as they are (form plain, no sizes). Repeated ids are cut at the same
    numbers. Texts of any length are read whole, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["i", "n", "form", "prefix_chars", "middle_chars", "output"], (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for b in slices(batches, "t"):
            rows = [transform(t or "", h) for t, h in zip(b.column("t").to_pylist(), b.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("i"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), draws(F.col(id_col), seed).alias("h"))
    return rows.mapInArrow(run, "i long, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("i", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: sentinels cut it, for no part holds one."""
    first, second = (F.when(form == "psm", F.lit(a)).otherwise(F.lit(b)) for a, b in ((SUFFIX, PREFIX), (MIDDLE, MIDDLE)))
    at = F.instr(output, first)
    end = F.instr(output, second)
    one = F.substring(output, F.lit(4), at - 4)
    two = F.substring(output, at + 3, end - at - 3)
    three = F.substring(output, end + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op11_fill_middle(spark, sf_dir):
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_FILL_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256(concat('1:', doc_id)) AS x FROM documents),
h AS (SELECT *, len(u) AS n, [concat('0x', x[k:k + 7])::BIGINT for k in [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 AS plain FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
 sha256(CASE WHEN plain THEN text WHEN h[4] % 100 < 20 THEN concat('<S>', suf, '<P>', pre, '<M>', mid) ELSE concat('<P>', pre, '<S>', suf, '<M>', mid) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
