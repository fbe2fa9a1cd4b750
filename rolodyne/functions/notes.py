"""Marker blocks in notes: building, taking out, putting in.

A block begins with a line of its marker, such as "── Activity (auto · 2024-01-31) ──",
and ends with its end line, before the next block, or at a blank line. One whose
end isn't found within WINDOW lines is left alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, WINDOW, LONGEST = "──", 20, 500
#: Short names of channels.
SHORT = {"whatsapp": "WA", "imessage": "iM", "telegram": "TG", "signal": "SG", "linkedin": "LI", "instagram": "IG", "messenger": "MSG", "email": "EM", "sms": "SMS"}


def short_channel(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv))
    return F.coalesce(F.element_at(names, F.lower(c)), F.upper(F.left(c, F.lit(3))), F.lit("-"))


def activity_block(title: str, as_of: str) -> Column:
    """The block of a contact's figures: channel_primary, messages, n_channels,
    last_inbound_ever, last_outbound_ever, awaiting_side, stale_sent."""
    at = F.lit(as_of).cast("timestamp")
    days = lambda c: F.greatest(F.lit(0), F.floor((F.unix_micros(at) - F.unix_micros(c)) / F.lit(86_400_000_000))).cast("string")
    n = F.coalesce("messages", F.lit(0))
    first = F.concat_ws(" · ", F.concat(F.lit("Primary: "), short_channel(F.col("channel_primary"))), F.when(n > 0, F.concat(F.lit("30d: "), n.cast("string"), F.lit(" msgs"))), F.when(F.col("n_channels") >= 1, F.concat(F.col("n_channels").cast("string"), F.when(F.col("n_channels") > 1, F.lit(" channels")).otherwise(F.lit(" channel")))))
    wait = F.when(F.col("awaiting_side") == "mine", F.concat(F.lit("Awaiting: my reply"), F.coalesce(F.concat(F.lit(" ("), days(F.col("last_inbound_ever")), F.lit("d)")), F.lit("")))).when(F.col("awaiting_side") == "theirs", F.concat(F.lit("Awaiting: their reply"), F.coalesce(F.concat(F.lit(" ("), days(F.col("last_outbound_ever")), F.lit("d)")), F.lit(""))))
    second = F.concat_ws(" · ", F.concat(F.lit("Last heard: "), F.date_format("last_inbound_ever", "yyyy-MM-dd"), F.lit(" "), short_channel(F.col("channel_primary"))), wait, F.when(F.col("stale_sent") >= 3, F.concat(F.lit("Stale sent: "), F.col("stale_sent").cast("string"))))
    quiet = (n == 0) & F.col("last_inbound_ever").isNull() & F.col("last_outbound_ever").isNull()
    body = F.when(quiet, F.lit("No recent activity across messaging channels.")).otherwise(F.concat_ws("\n", first, F.nullif(second, F.lit(""))))
    return block(title, as_of, body)


def block(title: str, as_of: str, body: Column) -> Column:
    """A block of any title around a body, LONGEST characters at most."""
    head, end = f"{MARK} {title} (auto · {as_of[:10]}) {MARK}", f"{MARK} End {title} {MARK}"
    room = LONGEST - len(head) - len(end) - 20
    cut = F.when(F.length(body) > room + 18, F.concat(F.left(body, F.lit(room)), F.lit("…"))).otherwise(body)
    return F.concat_ws("\n", F.lit(head), cut, F.lit(end))


def interaction_body(mail_date: Column, subject: Column, meeting_date: Column, title: Column) -> Column:
    """What was last said and when: a line for mail and one for meetings."""
    line = lambda what, at, said: F.when(at.isNotNull(), F.concat(F.lit(f"{what}: "), at.cast("string"), F.coalesce(F.concat(F.lit(" – "), F.nullif(said, F.lit(""))), F.lit(""))))
    return F.concat_ws("\n", line("Email", mail_date, subject), line("Meeting", meeting_date, title))


def state_body(stage: Column, tags: Column, notes: Column) -> Column:
    """Stage, tags and notes of a card, a line each, without empty ones."""
    line = lambda what, c: F.concat(F.lit(f"{what}: "), F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")))
    return F.concat_ws("\n", line("Stage", stage), line("Tags", F.array_join(tags, ", ")), line("Notes", notes))


def strip(note: str, title: str) -> str:
    """The note without its block of that title; unchanged where the block has no end."""
    lines = (note or "").split("\n")
    begin = next((i for i, line in enumerate(lines) if f"{MARK} {title}" in line), None)
    if begin is None:
        return note or ""
    for i in range(begin + 1, min(len(lines), begin + WINDOW + 1)):
        line = lines[i].strip()
        if f"{MARK} End {title}" in line:
            end = i + 1
        elif line.startswith(MARK) or not line:
            end = i
        else:
            continue
        rest = "\n".join(lines[:begin] + lines[end:]).rstrip()
        return rest + "\n" * note.endswith("\n")
    return note


def merge(note: str, block: str, title: str) -> str:
    """The note with the block in place of the old one: after the last block
    there is, before free text otherwise."""
    base = strip(note, title)
    if not base.strip():
        return block
    lines, last, inside = base.split("\n"), -1, False
    for i, line in enumerate(lines):
        s = line.strip()
        if s.startswith(MARK):
            last, inside = i, "End" not in s
        elif inside and s:
            last = i
        else:
            inside = False
    head, tail = "\n".join(lines[: last + 1]), "\n".join(lines[last + 1 :]).strip()
    return "\n\n".join(x for x in (head, block, tail) if x)


def merged(note: Column | str, block: Column | str, title: str) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([merge(x or "", y or "", title) for x, y in zip(a, b)])

    return run(note, block)


def stripped(note: Column | str, title: str) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: strip(x or "", title))

    return run(note)


def needs_update(note: Column | str, block: Column | str, title: str) -> Column:
    """Whether merging would change the note."""
    old = F.coalesce(F.col(note) if isinstance(note, str) else note, F.lit(""))
    return F.trim(merged(note, block, title)) != F.trim(old)
