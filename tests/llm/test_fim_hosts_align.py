"""Fill-in-the-middle, rules by host and aligned tokenizers against plain forms."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, difference
from pyspark.sql import functions as F
from test_ops import EDGE, docs

from rolodyne.llm import align, fim, hosts, registry

MIXED = st.lists(st.sampled_from(["a", "Z", "bc", "1", " ", "<", "P", ">", "é", "漢", "\U0001f642", "\n", "\x00", "<M>", "<S>", "<P>"]), max_size=14).map("".join)


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


# --- 11 fill in the middle ------------------------------------------------------


def plain_fim(doc_id, text):
    text, units = text or "", re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = ("".join(units[s:e]) for s, e in ((0, a), (a, b), (b, None)))
    if h[3] % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(MIXED)
def test_units_and_places(text):
    found, u = re.findall("[A-Za-z]+|[^A-Za-z]", text), fim.Units(text)
    assert u.n == len(found) and u.sentinel == any(s in text for s in ("<P>", "<S>", "<M>"))
    assert [u.place(k) for k in range(len(found) + 1)] == [len("".join(found[:k])) for k in range(len(found) + 1)]


def test_events_are_sparse():
    text = "word " * 10 + "x" * 100_000 + "漢" * 100_000
    assert len(fim.Units(text).cuts) < 30


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_host_rules"])
def test_queries_equal_sql(spark, sf, duck, name):
    rows = registry.queries()[name](spark, sf).toPandas()
    assert difference(rows, duck.execute(registry.oracle_sql()[name]).df()) is None and len(rows) == 1000


def test_fim_of_odd_rows(spark):
    texts = [*EDGE, "a <P> b", "<M>", "x<", "<S", "漢字", "a" * 200_000 + " b", " ".join(["w1", "é"] * 50_000)] * 3
    ids = [None, None, *range(len(texts) - 2)]
    table = docs(spark, texts, ids, i="clash", output="clash", n="clash", h="clash")
    got = fim.fill_in_middle(table).withColumn("back", fim.restored(F.col("output"), F.col("form"))).toPandas()
    want = [(i, t, *plain_fim(i, t)) for i, t in zip(ids, texts)]
    key = lambda r: tuple(str(x) for x in r)
    rows = [(None if pd.isna(r[0]) else int(r[0]), *(None if x is not None and not isinstance(x, str) and pd.isna(x) else x for x in r[1:])) for r in got.drop(columns="back").itertuples(index=False)]
    assert sorted(map(key, [(r[0], int(r[1]), r[2], *(None if x is None else int(x) for x in r[3:5]), r[5]) for r in rows])) == sorted(key((r[0], *r[2:])) for r in want)
    assert sorted(got.back) == sorted(t or "" for t in texts)
    assert fim.fill_in_middle(table.limit(0)).count() == 0


# --- 12 rules by host --------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_of_odd_texts(spark):
    words = "alpha beta gamma delta"
    texts = [*EDGE, "a b c a b c", "a a a a a", "a b c x a b c y a b", f"{words} {words}\n{words}\n\n{words}\n", "a\x1cb \x85 \xa0c \x0b\x0c\r z", "# $ <tag> 100% \U0001f642", " ".join(str(i) for i in range(50_000)), " ".join(str(i % 700) for i in range(30_000)), "\n".join(["one line of it"] * 2000)]
    rows = hosts.text_counts(docs(spark, texts)).select("doc_id", *COUNTS).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {k: plain_counts(t) for k, t in enumerate(texts)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é", max_size=60), min_size=1, max_size=40))
def test_counts_of_any_text(spark, texts):
    rows = hosts.text_counts(docs(spark, texts)).select("doc_id", *COUNTS).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {k: plain_counts(t) for k, t in enumerate(texts)}


def test_hosts_of_sources(spark):
    rows = [("src0", "src0"), ("HTTPS://user:pw@Www.Example.com:8080/a?b#c", "www.example.com"), ("example.org/path", "example.org"), ("http://a.b?q", "a.b"), ("", None), (None, None), ("  ", None)]
    got = spark.createDataFrame([(s,) for s, _ in rows], "s string").select(hosts.host_of(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [h for _, h in rows]


def plain_verdicts(frame):
    """frame: host and a column of 0/1 for each rule -> rejected hosts."""
    rejected = set()
    for rule in hosts.RULES:
        g = frame[frame.host.notna()].groupby("host")[rule].agg(["size", "sum"]).astype(float)
        n, f = g["size"].to_numpy(), g["sum"].to_numpy()
        mean = f.sum() / n.sum()
        spread, k1, room = (n * (f / n - mean) ** 2).sum(), len(n) - 1, n.sum() - (n * n).sum() / n.sum() - (len(n) - 1)
        rho = (spread / (mean * (1 - mean)) - k1) / room if 0 < mean < 1 and room > 0 else 0
        strength = min(max(1 / rho - 1, hosts.WEAKEST), hosts.STRONGEST) if rho > 0 else hosts.STRONGEST
        rejected |= set(g.index[(f + mean * strength) / (n + strength) > hosts.LIMIT])
    return rejected


def test_bad_hosts_take_their_documents_along(spark):
    r = np.random.default_rng(3)
    clean = lambda: " ".join(f"w{x}" for x in r.integers(0, 10**6, 80))
    rows = []
    for host in range(40):  # every eighth host is a spammer: nine in ten documents are full of signs
        for k in range(60 if host else 900):
            bad = r.random() < (0.9 if host % 8 == 7 else 0.05)
            rows.append((len(rows), " ".join(f"{w}$" for w in clean().split()) if bad else clean(), f"https://h{host}.example/{k}"))
    rows += [(len(rows), clean(), "tiny.example"), (len(rows) + 1, "a$ " * 80, "small.example"), (len(rows) + 2, clean(), None), (len(rows) + 3, None, None), (None, clean(), ""), (None, clean(), "h7.example")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host": F.lit("clash"), "n": F.lit("clash"), "_h": F.lit("clash"), "rejected": F.lit("clash")})
    got = hosts.judge(table).toPandas()
    frame = got.assign(short=got.n_words < 50, repetitive=100 * got.n_repeat_words > 50 * got.n_words, symbols=10 * got.n_symbols > got.n_words, same_lines=10 * got.n_dup_lines > 3 * got.n_lines, odd_words=(got.word_chars < 2 * got.n_words) | (got.word_chars > 15 * got.n_words))
    rejected = plain_verdicts(frame)
    # where hosts are good or bad altogether, one failing document says much of its host
    assert rejected - {"small.example"} == {f"h{k}.example" for k in range(7, 40, 8)}
    assert len(got) == len(rows)
    assert (got.kept == (~got.base_failed & ~got.host.isin(rejected))).all()
    alone = got[got.host.isna()]
    assert (alone.kept == ~alone.base_failed).all() and len(alone) == 3
    assert got[got.host == "tiny.example"].kept.all()  # too little is known of it
    assert hosts.judge(table.limit(0)).count() == 0


def test_counts_use_built_in_functions_only(spark, sf):
    plan = hosts.text_counts(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- 13 alignment -------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_letters():
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


def plain_alignment(libraries, rows):
    t, sp = libraries
    of, counts, per = byte_letters(), Counter(), []
    for i, text in rows:
        whole = f" {text}".encode() if text else b""
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        a_bytes = [bytes(of[c] for c in t.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(sp.id_to_piece(x)[1:-1], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            per.append((i, 0, 0, 0, [], ""))
            continue
        at = lambda xs: np.concatenate(([0], np.cumsum(list(map(len, xs))))).tolist()
        a_at, b_at, links, k = at(a_bytes), at(b_bytes), [], 0
        for j in range(len(b)):  # every pair of ranges that overlap, found from the left
            while k < len(a) and a_at[k + 1] <= b_at[j]:
                k += 1
            m = k
            while m < len(a) and a_at[m] < b_at[j + 1]:
                links.append((a[m], b[j]))
                m += 1
        x, y = iter(zip(a, a_at[1:])), iter(zip(b, b_at[1:]))
        groups = [(list(_until(x, end)), list(_until(y, end))) for end in sorted(set(a_at) & set(b_at))[1:]]
        counts.update(links)
        per.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest()))
    most = {}
    for (_, second), c in counts.items():
        most[second] = max(most.get(second, 0), c)
    return sorted(((i, na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), h) for i, na, nb, ng, links, h in per), key=str)


def _until(tokens, end):
    """The tokens up to the one that ends there."""
    for i, e in tokens:
        yield i
        if e == end:
            return


SUMMARY = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def summed(df):
    return sorted((tuple(r) for r in df.select(*SUMMARY).collect()), key=str)


def test_alignment_query(spark, sf, libraries):
    table = pd.read_parquet(f"{sf}/documents.parquet")
    assert summed(registry.queries()["op13_alignment"](spark, sf)) == plain_alignment(libraries, list(zip(table.doc_id, table.text)))


def test_alignment_of_odd_rows(spark, libraries, monkeypatch):
    texts = [*EDGE, "▁b", "a▁", "<|endoftext|> x <s></s>", "  two  spaces  ", "\n\n\n", " lead", "é", "漢" * 2000, "word " * 20_000, "\U0001f469‍\U0001f680" * 30] * 2
    ids = [None, None, 5, 5, *range(len(texts) - 4)]
    table = docs(spark, texts, ids, block="clash", pair="clash", n="clash", of="clash")
    want = plain_alignment(libraries, list(zip(ids, texts)))
    assert summed(align.summary(table)) == want
    # blocks of few entries and slices of few bytes give the same
    monkeypatch.setattr(align, "ENTRIES", 5)
    monkeypatch.setattr(align, "SLICE", 50)
    found = align.blocks(table.repartition(1))
    assert found.count() > 10
    assert align.summary(table.limit(0)).count() == 0
    assert {r[-1] for r in summed(align.summary(docs(spark, [None, "", "▁"])))} == {""}


def test_alignments_keep_spans_and_products(spark):
    texts = ["Ünï \U0001f642 漢字 tokenizers", None, "plain words", "▁no"]
    both = {p: {r.doc_id: r for r in align.alignments(docs(spark, texts), products=p).collect()} for p in (False, True)}
    for p, rows in both.items():
        assert not rows[1].a and not rows[1].links and not rows[3].b and not rows[3].group_ends
        for k in (0, 2):
            x = align.Alignment([texts[k]])
            assert rows[k].a == x.a.tolist() and rows[k].b == x.b.tolist() and rows[k].group_ends == x.end[x.closes].tolist()
            links = {(y.a, y.b) for y in rows[k].links}
            group = [(i, j) for i in range(len(x.a)) for j in range(len(x.b)) if x.a_group[i] == x.b_group[j]]
            overlap = {(i, j) for i, j in group if max(np.append(0, x.a_end)[i], np.append(0, x.b_end)[j]) < min(x.a_end[i], x.b_end[j])}
            assert links == (set(group) if p else overlap) and len(rows[k].links) == len(links)


def test_alignment_rows_do_not_grow_with_their_block(spark, sf):
    """A row is a document, or a bounded list of pairs, however many a block holds."""
    few = spark.read.parquet(f"{sf}/documents.parquet").limit(200).coalesce(1)
    found = align.blocks(few).collect()
    each, listed = [r for r in found if r.pairs is None], [r for r in found if r.pairs is not None]
    assert len(each) == 200 and {len(r.entry_pair) for r in each} != {0} and all(sum(r.entry_n) == r.n_links for r in each)
    assert len({r.block for r in found}) == 1 < len(listed) and max(len(r.pairs) for r in listed) <= align.LISTED
    assert sum(sum(r.totals) for r in listed) == sum(r.n_links for r in each)
