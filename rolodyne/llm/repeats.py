"""Substring dedup by hashing units of lines.

A text is cut into units: lines, and within a line sentences; a sentence of more
than LONG words is cut again after words whose hash says so, which puts the same
cuts into the same passage wherever it stands. A passage copied into the middle
of another text thus shares all units but the two at its ends. Units are
normalised (lower case, single spaces, no punctuation at the ends) and hashed;
digests are grouped over the whole table, and the earliest occurrence of each, by
document id and offset, stays. Later ones are taken out, all of them with run=1;
with a larger `run` only where repeated units follow each other without a gap and
have so many words together, so that common short sentences and license lines
survive (RUN is what the query and the pipeline take). There, units of fewer than
UNIT words are too common to be told by their own words: they are hashed with what
follows them, and end a run like any other unit unless they are repeats
themselves; with a run of fewer than UNIT words they are told by their own. Characters of scripts without blanks count as half a word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, rekey, slices

UNIT, RUN, AHEAD, LONG, EVERY = 4, 24, 16, 32, 8
#: Of scripts without blanks so many characters count as a word, and of anything this many.
DENSE_CHARS, WORD_CHARS = 2, 24
NO_ID = (1 << 63) - 1
_scripts = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_dense = re.compile(f"[{_scripts}]")
_end = re.compile(r"[.!?;:]+(?=\s)|[。！？；：｡]+|\n")
_word = re.compile(r"\S+")
_token = re.compile(rf"[{_scripts}]|[^\s{_scripts}]+")
_trim = " \t.,;:!?\"'()[]|*#$%&-–—。，、；：！？「」『』（）"


def _count(piece: str, words: int, dense: bool) -> int:
    if dense and (n := len(_dense.findall(piece))):
        words = len(_token.findall(piece)) - n + -(-n // DENSE_CHARS)
    return max(words, len(piece) // WORD_CHARS) if words else 0


def units(text: str, alone: bool = False) -> list[tuple[int, int, int, int]]:
    """(start, end, words, digest) of all units with a word; offsets are code
    points of the text, and blanks around a unit belong to it. The digest of a
    unit of fewer than UNIT words also covers what follows it, up to AHEAD words,
    unless all units stand alone."""
    found, at = [], 0
    dense = _dense.search(text) is not None
    ends = [m.end() for m in _end.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        piece = text[at:end]
        words = piece.split()
        n = _count(piece, len(words), dense)
        if n > LONG:
            cut = at
            for m in (_token if dense else _word).finditer(piece):
                if zlib.crc32(m.group().lower().encode("utf-8", "surrogatepass")) % EVERY == 0:
                    _unit(found, text, cut, at + m.end(), dense)
                    cut = at + m.end()
            _unit(found, text, cut, end, dense)
        elif n:
            found.append((at, end, n, " ".join(words).lower().strip(_trim)))
        at = end
    out = []
    for k, (start, end, n, norm) in enumerate(found):
        if n < UNIT and not alone:
            have, parts = n, [norm]
            for _, _, more, then in found[k + 1 : k + 1 + AHEAD]:
                if have >= AHEAD:
                    break
                have += more
                parts.append(then)
            norm = "\n".join(parts) + ("\n." if have < AHEAD else "\n,")  # ends no part has
        out.append((start, end, n, xxhash.xxh3_128_intdigest(norm.encode("utf-8", "surrogatepass"))))
    return out


def _unit(found: list, text: str, start: int, end: int, dense: bool) -> None:
    words = text[start:end].split()
    if words:
        found.append((start, end, _count(text[start:end], len(words), dense), " ".join(words).lower().strip(_trim)))


def _unit_rows(rows: DataFrame, alone: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 2 << 20):
            found = [units(t, alone) for t in b.column("t").to_pylist()]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            take = pa.array(np.repeat(np.arange(len(found)), counts))
            flat = [u for us in found for u in us]
            digest = np.frombuffer(b"".join(u[3].to_bytes(16, "little") for u in flat), "<i8").reshape(-1, 2)
            number = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
            cols = [b.column("o").take(take), b.column("th").take(take), pa.array(number.astype(np.int32)), *(pa.array([u[k] for u in flat], pa.int32()) for k in range(3)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, ["o", "th", "k", "start", "end", "words", "h", "g"])

    return rows.mapInArrow(run, "o long, th long, k int, start int, end int, words int, h long, g long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 1) -> DataFrame:
    """-> (o, th, start, end, words, units, kept_id, kept_start, links): the spans
    to take out, each with the place where its first unit stays, and in links
    (start, kept_id, kept_start) of every unit of it, in order. Spans of a
    document don't overlap. A document's own repetitions count too. Rows with
    equal id and text are one document; null texts have no spans; null ids rank
    last. Units are cut twice rather than kept: they take more room than texts."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    found = _unit_rows(rows, run < UNIT)
    place = F.struct("o", "th", "start")
    first = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(rekey("h").alias("fh"), F.col("g").alias("fg"), "first")
    # two ints to a long: they travel twice
    pack = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    packed = found.select("h", "g", "o", "th", pack("start", "end").alias("at"), pack("k", "words").alias("kw"))
    later = packed.join(first, (packed.h == F.col("fh")) & (packed.g == F.col("fg"))).where(F.struct("o", "th", high("at").alias("start")) != F.col("first"))
    later = later.select("o", "th", "kw", "at", F.col("first.o").alias("fo"), F.col("first.start").alias("fs"))
    by_doc = Window.partitionBy("o", "th").orderBy("kw")
    once = later.dropDuplicates(["o", "th", "kw"])
    island = once.withColumn("island", high("kw") - F.row_number().over(by_doc))
    link = F.struct(high("at").alias("start"), F.when(F.col("fo") != NO_ID, F.col("fo")).alias("kept_id"), F.col("fs").alias("kept_start"))
    spans = island.groupBy("o", "th", "island").agg(F.min(high("at")).alias("start"), F.max(low("at")).alias("end"), F.sum(low("kw")).alias("words"), F.count(F.lit(1)).alias("units"), F.array_sort(F.collect_list(link)).alias("links"))
    spans = spans.where(F.col("words") >= run)
    return spans.select("o", "th", "start", "end", "words", "units", F.col("links")[0].kept_id.alias("kept_id"), F.col("links")[0].kept_start.alias("kept_start"), "links")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 1) -> DataFrame:
    """The input with repeated spans cut out of the text, and a column
    spans_removed (array of start, end in the original text). Rows are never
    dropped; a text may end up empty. An input column spans_removed is replaced."""
    spans = materialize(repeated_spans(docs, id_col, text_col, run).select("o", "th", "start", "end"))
    cut = spans.groupBy("o", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    cut = cut.select(rekey("o").alias("co"), F.col("th").alias("cth"), "cut")
    names = [c for c in docs.columns if c.lower() != "spans_removed"]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    joined = packed.join(cut, (packed.o == F.col("co")) & (packed.th == F.col("cth")), "left")
    old = F.col(f"row.`{text_col}`").cast("string")
    # what stands between the spans, in order
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda c: c.end))
    ends = F.concat(F.transform("cut", lambda c: c.start), F.array(F.length(old)))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda p: F.substring(old, p.s + 1, p.e - p.s)), "")
    text = F.when(F.col("cut").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*out, F.coalesce("cut", F.array().cast("array<struct<start:int,end:int>>")).alias("spans_removed"))


def op1_substrings(spark, sf_dir):
    spans = repeated_spans(read_table(spark, sf_dir, "documents"), run=RUN)
    return spans.select(F.when(F.col("o") != NO_ID, F.col("o")).alias("doc_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "words", "units", F.col("kept_id").alias("kept_doc_id"), "kept_start", "links")
