"""Fuzzy joins, duplicate classes, one-to-one assignment and global ranks against plain forms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolodyne.functions.similarity import py_ratio
from rolodyne.operators import audit, near
from rolodyne.operators import resolve as R
from rolodyne.shared import connected_components, global_rank


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=24), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["", "a", "c", "x"])), max_size=7), st.sampled_from([55.0, 70.0, 80.0, 85.0, 92.0, 97.0, 100.0]))
def test_texts_that_reach_the_threshold_meet(a, edits, threshold):
    b = list(a)
    for at, put in edits:  # insert, or take out
        if put:
            b.insert(min(at, len(b)), put)
        elif b:
            b.pop(min(at, len(b) - 1))
    b = "".join(b)
    if b and py_ratio(a, b) >= threshold:
        assert near.index_keys(a, threshold) & near.probe_keys(b, threshold)
        assert near.index_keys(b, threshold) & near.probe_keys(a, threshold)
        d = len(a) + len(b) - 2 * near.least_common(len(a), len(b), threshold)
        assert (near.signature(a) ^ near.signature(b)).bit_count() <= d or (near.signature(a) ^ near.signature(b)) < 0


def made_names(n, seed=1):
    """Two-word names from a few frequent first names and many family names."""
    r = random.Random(seed)
    syllables = lambda k: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiouy") for _ in range(k))
    first, last = [syllables(r.choice([2, 2, 3])) for _ in range(300)], [syllables(r.choice([2, 3, 3, 4])) + r.choice(["", "k", "va", "ova", "ic"]) for _ in range(6000)]
    return sorted({f"{first[int(300 * r.random() ** 2)]} {r.choice(last)}" for _ in range(n)})


def test_candidates_are_few(spark):
    names = made_names(20_000)
    a = spark.createDataFrame([(n,) for n in names], "na string").repartition(4)
    pairs = R.near_names(a, a.withColumnRenamed("na", "nb"), 85.0)
    assert pairs.count() < 0.01 * len(names) ** 2


def test_fuzzy_pairs_equal_all_pairs(spark):
    names = made_names(250, 2) + ["ab", "abc", "abcd", "Ábc d"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names * 2)], "id long, name string")
    fold = sorted({"abc d" if n == "Ábc d" else n for n in names})
    for threshold, block in ((80.0, 3), (60.0, 2), (50.0, 1)):
        got = {(r.name_a, r.name_b): r.score for r in R.fuzzy_pairs(df, "id", "name", threshold, block).collect()}
        want = {(x, y): py_ratio(x, y) for x in fold for y in fold if x < y and len(x) >= block and x[:block] == y[:block] and py_ratio(x, y) >= threshold}
        assert got == pytest.approx(want)


def plain_classes(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {x: top(x) for x in up}


CONTACTS = "resource_name string, display_name string, phones array<string>, emails array<string>"


def test_classes_equal_pairs(spark):
    r = random.Random(4)
    names = made_names(60, 3)
    rows = [(f"people/{k:03}", r.choice([*names, None, "", "x"]), [f"+42190{r.randrange(10**6, 10**6 + 150)}" for _ in range(r.randrange(3))], [f"M{r.randrange(200)}@x.y" for _ in range(r.randrange(2))]) for k in range(220)]
    df = spark.createDataFrame(rows, CONTACTS)
    pairs = [(x.a, x.b, x.match_type) for x in R.duplicates(df).collect()]
    want = plain_classes([(a, b) for a, b, _ in pairs])
    got = {x.resource_name: x for x in R.duplicate_classes(df).collect()}
    assert {k: v.class_id for k, v in got.items()} == want
    for k, x in got.items():
        kinds = [m for a, b, m in pairs if k in (a, b)]
        assert x.members == list(want.values()).count(want[k])
        assert x.match_type == min(kinds, key=["phone", "email", "name"].index) and x.links >= len(kinds)
    alone = R.duplicate_classes(df, None).collect()
    assert {x.resource_name for x in alone} <= set(want) and len({x.class_id for x in alone}) >= len(set(want.values())) - 40
    assert R.duplicate_classes(df.limit(0)).count() == 0


def test_one_phone_of_very_many_contacts(spark):
    n = 100_000
    df = spark.range(n).select(F.concat(F.lit("people/"), F.col("id").cast("string")).alias("resource_name"), F.lit(None).cast("string").alias("display_name"), F.array(F.lit("+421 903 123 456")).alias("phones"), F.array().cast("array<string>").alias("emails"))
    row = R.duplicate_classes(df).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_id").alias("classes"), F.min("links").alias("least"), F.max("members").alias("members")).first()
    assert tuple(row) == (n, 1, n - 1, n)


def in_order(pairs, first_come):
    used, want = set(), set()
    for (i, k), v in sorted(pairs.items(), key=lambda x: (x[0][0], -x[1], x[0][1]) if first_come else (-x[1], *x[0])):
        if ("i", i) not in used and ("k", k) not in used:
            used |= {("i", i), ("k", k)}
            want.add((i, k, v))
    return want


@pytest.mark.parametrize("first_come", [False, True])
def test_assignment_of_chains(spark, first_come):
    """Many short chains, a long one, and a tangle; with few pairs a task they take every way there is."""
    r = random.Random(6)
    pairs = {(f"s{c}-{k}", f"t{c}-{k + j}"): 100.0 - (2 * k + j) / 10 for c in range(15) for k in range(8) for j in (0, 1)}
    pairs |= {(f"x{k:04}", f"y{k + j:04}"): 100.0 - (2 * k + j) / 100 for k in range(200) for j in (0, 1)}
    pairs |= {(f"a{r.randrange(30)}", f"b{r.randrange(30)}"): float(r.randrange(80, 83)) for _ in range(200)}
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "id string, key string, score double")
    want = in_order(pairs, first_come)
    for few in (10_000, 90):
        assert {tuple(x) for x in R.assign_one_to_one(df, first_come, few).collect()} == want


def test_plans_of_an_assignment_do_not_grow_with_its_lots(spark):
    df = spark.range(800).select(F.floor(F.col("id") / 2).alias("id"), (F.floor(F.col("id") / 2) + F.col("id") % 2).alias("key"), (-F.col("id")).cast("double").alias("score"))
    out = R.assign_one_to_one(df, few=90)
    assert out.count() == 400 and out.where("id = key").count() == 400
    assert out._jdf.queryExecution().analyzed().toString().count("Relation") <= 4


def test_a_long_chain_takes_few_jobs(spark):
    n = 130_000
    df = spark.range(2 * n).select(F.floor(F.col("id") / 2).alias("id"), (F.floor(F.col("id") / 2) + F.col("id") % 2).alias("key"), (-F.col("id")).cast("double").alias("score"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    out = R.assign_one_to_one(df)
    assert out.count() == n and out.where("id = key").count() == n
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) - before < 600


def test_ranks_of_equal_figures_use_all_tasks(spark):
    rows = spark.range(5000).select(F.format_string("people/%012d", F.hash("id").bitwiseAND(0xFFFFF).cast("long") * 5000 + F.col("id")).alias("resource_name"), F.lit(3).alias("high"), F.lit(7).alias("total"))
    out = audit.batches(rows, 50)
    names = [r.resource_name for r in rows.collect()]
    assert {r.resource_name: (r["rank"], r.batch) for r in out.collect()} == {n: (k + 1, k // 50 + 1) for k, n in enumerate(sorted(names))}
    laid = global_rank(rows, [F.col("high"), F.col("resource_name")], partitions=4)
    sizes = [r["count"] for r in laid.groupBy(F.floor((F.col("rank") - 1) / 1250)).count().collect()]
    assert sizes == [1250] * 4
    assert laid.rdd.getNumPartitions() >= 4
    assert audit.batches(rows.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_classes([e for e in edges if e[0] != e[1]])


def test_participants_equal_all_pairs(spark):
    from rolodyne.functions.similarity import weighted

    r = random.Random(8)
    words = ["bartholomew", "zoosmith", "azoosmith", "jan", "j", "novak", "maria", "de", "la", "cruz", "vysokohorska", "ann", "li"]
    names = sorted({" ".join(r.sample(words, r.randrange(1, 5))) for _ in range(120)} | {" ".join(words), " ".join(reversed(words))})
    records = spark.createDataFrame([(n, [n]) for n in names], "record string, names array<string>")
    have = names[::2]
    contacts = spark.createDataFrame([(n, n) for n in have], "contact string, name string")
    for cutoff in (91.0, 94.0, 98.0):
        got = {x.record: round(x.score, 6) for x in R.fuzzy_participants(records, contacts, cutoff).collect()}
        best = {n: max(round(weighted(n, m), 6) for m in have) for n in names}
        assert got == {n: s for n, s in best.items() if s >= cutoff}


def frequent_names(n, seed):
    """Names of which most characters are one of two frequent words, some very long, some of other scripts."""
    r = random.Random(seed)
    some = ["".join(r.choice("aeiobd") for _ in range(r.randrange(1, 6))) + r.choice([" automobile", " household"]) for _ in range(n)]
    return sorted({*some, *(" ".join(reversed(x.split())) for x in some[: n // 3]), "žofia household", "北京 automobile", "x" * 64, "x" * 63 + "y", "xy" * 40, "xy" * 39 + "yx", "a", "ab"})


@pytest.mark.parametrize("direct", [10**12, 0])
def test_near_rows_equal_all_pairs(spark, monkeypatch, direct):
    """Every pair once, nothing else, whatever way it is found; equal names are rows of their own."""
    monkeypatch.setattr(near, "DIRECT", direct)
    monkeypatch.setattr(near, "ROWS", 40)
    monkeypatch.setattr(near, "COPIES", 3)
    x, y = frequent_names(60, 1), frequent_names(50, 2)
    left, right = [(k, n) for k, n in enumerate(x + x[:5] * 7 + [""])], [(k, n) for k, n in enumerate(y + y[-3:])]
    a, b = spark.createDataFrame(left, "i long, na string"), spark.createDataFrame([*right, (99, None)], "j long, nb string")
    for forms, prefix in (((str, near.token_sorted), 0), ((str,), 2)):
        want = {(i, j): max(py_ratio(f(p), f(q)) for f in forms) for i, p in left for j, q in right if p and p[:prefix] == q[:prefix]}
        got = near.near_rows(a, b, 80.0, forms, prefix).collect()
        assert len(got) == len({(r.i, r.j) for r in got}) and all(r.na == left[r.i][1] and r.nb == right[r.j][1] for r in got)
        assert {(r.i, r.j): r.score for r in got} == pytest.approx({k: s for k, s in want.items() if s >= 80.0})


def test_only_near_pairs_leave_a_cell(spark):
    """Names alike in a frequent word don't meet as candidates by the million: each pair comes once, if it is near."""
    names = [f"{k:05d}".translate(str.maketrans("0123456789", "aeioubdgkm")) + " automobile" for k in range(0, 100_000, 50)]
    a = spark.createDataFrame([(n,) for n in names], "na string")
    pairs = near.near_pairs(a, a.withColumnRenamed("na", "nb"), 92.0, (str,)).collect()
    assert len(pairs) == len(set(pairs)) and all(py_ratio(r.na, r.nb) >= 92.0 for r in pairs)
    few = names[:60]
    assert {(r.na, r.nb) for r in pairs if r.na in few} == {(p, q) for p in few for q in names if py_ratio(p, q) >= 92.0}


@pytest.mark.parametrize("direct", [10**12, 0])
def test_participants_with_repeated_and_edited_words(spark, monkeypatch, direct):
    """Words that come twice in a name and first letters that differ: no index loses them."""
    from rolodyne.functions.similarity import weighted

    monkeypatch.setattr(near, "DIRECT", direct)
    monkeypatch.setattr(near, "ROWS", 40)
    r = random.Random(3)
    words = ["bartholomew", "vysokohorska", "jan", "novak", "maria", "de", "la", "cruz", "ann", "li", "zuzana", "karol", "von"]
    asked = sorted({" ".join(r.choices(words, k=r.randrange(3, 7))) for _ in range(60)} | {"cruz li maria vysokohorska", "de de karol jan bartholomew"})
    have = {"li cruz aaria vysokohorska", "zartholomew karol jan de"}
    for n in asked:
        w = r.sample(list(dict.fromkeys(n.split())), len(set(n.split())))
        w[0] = r.choice("qzxa") + w[0][1:]
        have.add(" ".join(r.sample(w, len(w))))
    records = spark.createDataFrame([(n, [n]) for n in asked], "record string, names array<string>")
    contacts = spark.createDataFrame([(n, n) for n in have], "contact string, name string")
    got = {x.record: round(x.score, 6) for x in R.fuzzy_participants(records, contacts, 91.0).collect()}
    best = {n: max(round(weighted(n, m), 6) for m in have) for n in asked}
    assert got == {n: s for n, s in best.items() if s >= 91.0} and len(got) > 10


def test_names_of_the_same_letters_are_no_candidates(spark):
    """Names with a frequent word and the letters of another name: only those that reach the cutoff leave a cell."""
    from rolodyne.functions.similarity import weighted

    words = [f"{k:05d}".translate(str.maketrans("0123456789", "aeioubdgkm")) for k in range(0, 100_000, 50)]
    a = spark.createDataFrame([(f"{w} automobile",) for w in words], "na string")
    b = spark.createDataFrame([(f"automobile {w}",) for w in words[::2]], "nb string")
    pairs = near.weighted_pairs(a, b, 92.0).collect()
    assert len(pairs) == len(set(pairs)) == 1000 and all(weighted(r.na, r.nb) >= 92.0 for r in pairs)


def test_equal_signatures_meet_once(monkeypatch):
    """All pairs of near signatures, each once, whatever the parts that they are worked on in."""
    monkeypatch.setattr(near, "RUN", 3)
    r = np.random.default_rng(5)
    x, y = (r.choice(r.integers(0, 32, 6, np.uint64), n) for n in (40, 25))
    for edits in (0, 1, 2):
        got = [p for i, j in near._near_signs(x, y, edits) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(40) for j in range(25) if int(x[i] ^ y[j]).bit_count() <= edits}


def alike_people(spark):
    """600 people and 120 others who are all alike, a part of them of the same company."""
    left = [(f"c{k}", f"bartholomew vysokohorska {k * 37 % 100}", "abc"[k % 3] * 4) for k in range(600)]
    right = [(f"s{k}", f"vysokohorska bartholomew {k * 53 % 100}", "abxyz"[k % 5] * 4) for k in range(120)]
    return spark.createDataFrame(left, "id string, name string, org string"), spark.createDataFrame(right, "key string, name string, org string")


def in_lots(monkeypatch, found):
    for name, value in (("BEGIN", 6000), ("FOUND", found), ("COMPARED", 6000), ("GROWTH", 4)):
        monkeypatch.setattr(R, name, value, raising=False)


def test_name_assignment_does_not_write_all_pairs(spark, monkeypatch):
    """Nearly all pairs of people are alike, but only a few for each are ever needed."""
    from rolodyne.plans import resolve_queries

    in_lots(monkeypatch, 6000)
    monkeypatch.setattr(resolve_queries, "_customer_names", lambda spark, sf: alike_people(spark))
    write, written = R.materialize, []

    def counted(df, *more):
        out = write(df, *more)
        written.append(out.agg(F.sum("n")).first()[0] or 0 if "pairs" in out.columns else out.count())
        return out

    monkeypatch.setattr(R, "materialize", counted)
    out = resolve_queries.name_assignment(spark, "")
    assert out.groupBy("rule").count().collect() and max(written) < 600 * 120 / 3


@pytest.mark.parametrize("found, threshold", [(6000, 85.0), (1000, 85.0), (6000, 70.0), (10**7, 85.0)])
def test_assignment_in_lots_equals_that_of_all_pairs(spark, monkeypatch, found, threshold):
    left, right = alike_people(spark)
    if threshold < 85:  # other first names, so that a company makes less than 100 of some
        left, right = (rows.withColumn("name", F.when(F.length(c) % 2 == 0, F.regexp_replace("name", "bartholomew", "bartosz")).otherwise(F.col("name"))) for rows, c in ((left, "id"), (right, "key")))
    pairs = {(r.id, r.key): r.score for r in R.scored_matches(left, right, threshold).collect()}
    assert len(pairs) > 6000
    in_lots(monkeypatch, found)
    if found > 10**6:
        monkeypatch.setattr(R, "BEGIN", 10**6)
    for first_come, got in zip((False, True), R.assigned_matches(left, right, threshold, rules=(False, True))):
        assert {(r.id, r.key, r.score) for r in got.collect()} == in_order(pairs, first_come)


def test_assignment_of_no_names(spark):
    left, right = alike_people(spark)
    assert all(got.count() == 0 for got in R.assigned_matches(left, right.limit(0), rules=(False, True)))
    assert all(got.count() == 0 for got in R.assigned_matches(left.withColumn("name", F.lit(" ")), right, rules=(False, True)))


def test_a_pass_of_numbers_is_the_pass_in_order():
    r = np.random.default_rng(4)
    i, k, score = r.integers(1, 60, 900), r.integers(1, 50, 900), r.choice(np.array([100.0, 99.5, 97.0, 85.0]), 900)
    for wide in (0, 1 << 40):  # three numbers that fit into a word, or don't
        lists = [[i[at : at + 200], k[at : at + 200], score[at : at + 200]] for at in range(0, 900, 200)]
        if wide:
            lists = [[x * wide, y * (1 << 20), s] for x, y, s in lists]
        for first_come in (False, True):
            x, y, s = R._in_order(lists, first_come)
            x, y = (x // wide, y >> 20) if wide else (x, y)
            keep = R._first_free(x, y, 64)
            want = R._in_turn(list(zip(i.tolist(), k.tolist(), score.tolist())), first_come)
            assert [(x[p], y[p], s[p]) for p in keep] == [(i[p], k[p], score[p]) for p in want]
