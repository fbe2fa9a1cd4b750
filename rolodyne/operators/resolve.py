"""Entity resolution: exact and fuzzy duplicates, external lists, message records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.similarity import fast_ratio, weighted_ratio
from ..functions.text import compare_key, digits, text, title_case
from ..shared import connected_components, global_rank, materialize, parts, rekey, remove
from .near import near_pairs, near_rows, weighted_pairs


def phone_key(c: Column, size: int = 9) -> Column:
    """Last nine digits, null for shorter numbers."""
    d = digits(c)
    return F.when(F.length(d) >= size, F.right(d, F.lit(size)))


def equal_pairs(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Pairs a < b of different ids that share a key, each once with its smallest
    key. Meant for keys that few ids share; groups() below is the form that
    stays linear."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("a"), F.col(key).alias("key")).distinct()
    other = keyed.select(F.col("a").alias("b"), "key")
    return keyed.join(other, "key").where("a < b").groupBy("a", "b").agg(F.min("key").alias("key"))


def groups(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Members of each shared key with the key's smallest id: linear in rows."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(id_col).alias("id"), F.col(key).alias("key")).distinct()
    lead = keyed.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return keyed.join(lead, "key").select("id", "key", "lead", "members")


def fuzzy_pairs(rows: DataFrame, id_col: str, name: str, threshold: float = 80.0, block: int = 3) -> DataFrame:
    """Pairs a < b whose names share the first folded characters and are at least
    `threshold` alike. Distinct names are compared, not rows, so equal names cost
    nothing.
    -> (name_a, name_b, score) over distinct folded names."""
    keys = rows.select(compare_key(F.col(name)).alias("na")).where(F.length("na") >= block).distinct()
    near = near_rows(keys, keys.withColumnRenamed("na", "nb"), threshold, (str,), block).where("na < nb")
    return near.select(F.col("na").alias("name_a"), F.col("nb").alias("name_b"), "score")


def duplicates(contacts: DataFrame, threshold: float = 80.0) -> DataFrame:
    """contacts: resource_name, display_name, phones array, emails array ->
    (a, b, match_type, confidence, detail). A pair counts once: by phone, else by
    mail address, else by name."""
    phone = contacts.select("resource_name", F.explode("phones").alias("p")).select("resource_name", phone_key(F.col("p")).alias("key"))
    mail = contacts.select("resource_name", F.explode("emails").alias("e")).select("resource_name", F.nullif(F.lower(F.trim("e")), F.lit("")).alias("key"))
    names = contacts.select("resource_name", compare_key(F.col("display_name")).alias("folded"))
    alike = fuzzy_pairs(contacts, "resource_name", "display_name", threshold)
    left, right = names.select(F.col("resource_name").alias("a"), F.col("folded").alias("name_a")), names.select(F.col("resource_name").alias("b"), F.col("folded").alias("name_b"))
    different = alike.join(left, "name_a").join(right, "name_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("score") / 100).alias("confidence"), F.concat_ws(" / ", "name_a", "name_b").alias("key"))
    same = equal_pairs(names.where(F.length("folded") >= 3), "resource_name", "folded").withColumn("confidence", F.lit(1.0))
    found = [(1, "phone", equal_pairs(phone, "resource_name", "key").withColumn("confidence", F.lit(0.90))), (2, "email", equal_pairs(mail, "resource_name", "key").withColumn("confidence", F.lit(0.90))), (3, "name", same.unionByName(different))]
    every = None
    for order, kind, df in found:
        one = df.select("a", "b", F.lit(order).alias("order"), F.lit(kind).alias("match_type"), F.round("confidence", 2).alias("confidence"), F.col("key").alias("detail"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("a", "b").agg(F.min(F.struct("order", "match_type", "confidence", "detail")).alias("m"))
    return best.select("a", "b", "m.match_type", "m.confidence", "m.detail")


def duplicate_keys(contacts: DataFrame) -> DataFrame:
    """contacts: resource_name, display_name, phones array, emails array -> distinct
    (resource_name, kind, key): phone, email and folded name."""
    phone = contacts.select("resource_name", F.explode("phones").alias("p")).select("resource_name", F.lit("phone").alias("kind"), phone_key(F.col("p")).alias("key"))
    mail = contacts.select("resource_name", F.explode("emails").alias("e")).select("resource_name", F.lit("email").alias("kind"), F.nullif(F.lower(F.trim("e")), F.lit("")).alias("key"))
    names = contacts.select("resource_name", F.lit("name").alias("kind"), compare_key(F.col("display_name")).alias("key")).where(F.length("key") >= 3)
    return phone.unionByName(mail).unionByName(names).where("key is not null").distinct()


def duplicate_classes(contacts: DataFrame, threshold: float | None = 80.0) -> DataFrame:
    """contacts: resource_name, display_name, phones array, emails array ->
    (resource_name, class_id, members, match_type, phone_links, email_links,
    name_links, links): a row for each contact that shares a phone, an address or
    a name with another, or has a name as similar as `threshold` (None: equal names
    only). class_id is the smallest name of a contact it reaches over such links;
    links counts other contacts by key, once for each key shared; match_type is the
    first of phone, email, name that the contact shares itself.

    Linear in rows: a shared key links its holders to its smallest one, never to
    each other, so n contacts of one phone give n rows. The pair to report for a
    contact is (class_id, resource_name)."""
    ids = materialize(contacts.select("resource_name").where("resource_name is not null").distinct().withColumn("n", F.monotonically_increasing_id()))
    keyed = materialize(duplicate_keys(contacts).join(ids, "resource_name").select("n", "kind", "key"))
    shared = keyed.groupBy("kind", "key").agg(F.min("n").alias("lead"), F.count(F.lit(1)).alias("holders"))
    own = keyed.join(shared.where("holders > 1").select(F.col("kind").alias("k"), F.concat("key", F.lit("")).alias("v"), "lead", "holders"), (F.col("kind") == F.col("k")) & (F.col("key") == F.col("v")))
    edges = own.select(F.col("n").alias("src"), F.col("lead").alias("dst"))
    counts = own.select("n", "kind", (F.col("holders") - 1).alias("links"))
    if threshold is not None:
        names = shared.where("kind = 'name'").select("key", "lead", "holders")
        alike = materialize(fuzzy_pairs(names, "lead", "key", threshold).select("name_a", "name_b"))
        other = lambda s: names.select(F.col("key").alias(f"name_{s}"), F.col("lead").alias(f"lead_{s}"), F.col("holders").alias(f"holders_{s}"))
        both = materialize(alike.join(other("a"), "name_a").join(other("b"), "name_b"))
        edges = edges.unionByName(both.select(F.col("lead_a").alias("src"), F.col("lead_b").alias("dst")))
        side = lambda s, o: both.select(F.col(f"name_{s}").alias("key"), F.col(f"holders_{o}").alias("links"))
        near = side("a", "b").unionByName(side("b", "a")).groupBy("key").agg(F.sum("links").alias("links"))
        members = keyed.where("kind = 'name'").select("n", F.col("key").alias("v")).join(near, F.col("v") == F.col("key")).select("n", F.lit("name").alias("kind"), "links")
        counts = counts.unionByName(members)
    classes = connected_components(edges)
    each = counts.groupBy("n").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("links"))), F.lit(0)).alias(f"{k}_links") for k in ("phone", "email", "name")))
    linked = materialize(each.join(classes.select(rekey("node").alias("node"), "component"), F.col("n") == F.col("node")).join(ids.select(rekey("n").alias("i"), "resource_name"), F.col("n") == F.col("i")).drop("node", "i"))
    size = linked.groupBy("component").agg(F.min("resource_name").alias("class_id"), F.count(F.lit(1)).alias("members")).select(rekey("component").alias("c"), "class_id", "members")
    kind = F.when(F.col("phone_links") > 0, "phone").when(F.col("email_links") > 0, "email").otherwise("name")
    return linked.join(size, F.col("component") == F.col("c")).select("resource_name", "class_id", "members", kind.alias("match_type"), "phone_links", "email_links", "name_links", (F.col("phone_links") + F.col("email_links") + F.col("name_links")).alias("links"))


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of duplicates() with their place: the surest first, then phone, email
    and name, then by their ids."""
    order = F.array_position(F.array(*map(F.lit, ("phone", "email", "name"))), F.col("match_type"))
    return global_rank(pairs.withColumn("_order", order), [F.desc("confidence"), F.col("_order"), F.col("a"), F.col("b")], "place").drop("_order")


def near_names(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Distinct names a (na), b (nb) -> every pair whose plain or token-sorted
    ratio reaches the threshold, and few others."""
    return near_pairs(a, b, threshold)


#: So much more has the score of a name with a similar company, 100 at most.
BONUS = 15.0


def _with_bonus(score: str, bonus: str) -> Column:
    return F.least(F.lit(100.0), F.col(score) + F.coalesce(bonus, F.lit(0.0)))


def _alike_companies(a: DataFrame, b: DataFrame, company: float) -> DataFrame:
    """Folded companies of a (oa), b (ob) -> (oa, ob, bonus) of those that are similar;
    they are compared once each, not once for every pair of people."""
    orgs = near_pairs(a.select(F.col("oa").alias("na")).distinct(), b.select(F.col("ob").alias("nb")).distinct(), company, (str,))
    return materialize(orgs.select(F.col("na").alias("oa"), F.col("nb").alias("ob"), F.lit(BONUS).alias("bonus")))


def scored_matches(left: DataFrame, right: DataFrame, threshold: float = 85.0, company: float = 75.0, block: int | None = None) -> DataFrame:
    """left (id, name, org), right (key, name, org) -> (id, key, score): the better
    of plain and token-sorted ratio, 15 more for a similar company, 100 at most.
    Empty names match nothing. Without a block every pair that can reach the
    threshold is compared, whatever its word order; `block` limits pairs to equal
    first letters and loses the others."""
    a = left.select("id", compare_key(F.col("name")).alias("na"), compare_key(text("org")).alias("oa"))
    b = right.select("key", compare_key(F.col("name")).alias("nb"), compare_key(text("org")).alias("ob"))
    full = near_rows(a, b, threshold, prefix=block or 0)
    alike = _alike_companies(a, b, company).toDF("ca", "cb", "bonus")
    known = full.join(alike, (F.col("oa") == F.col("ca")) & (F.col("ob") == F.col("cb")), "left")
    return known.select("id", "key", _with_bonus("score", "bonus").alias("score"))


def best_matches(left: DataFrame, right: DataFrame, threshold: float = 85.0, company: float = 75.0, block: int | None = None) -> DataFrame:
    """For each left row the right row of the highest score; ties to the smaller key."""
    scored = scored_matches(left, right, threshold, company, block)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "key")
    return scored.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("id", "key", F.round("score", 2).alias("score"))


#: So many pairs at most are assigned in one task; they are a few numbers or words each.
FEW = 100_000
#: Rounds that fix pairs all over the table go on while each leaves this share of the pairs at most.
ROUND_LEAVES = 0.7


def _in_turn(pairs: list[tuple], first_come: bool) -> list[int]:
    """Of (id, key, score) the places of those that a pass in order fixes."""
    ids, keys, keep = set(), set(), []
    for k in sorted(range(len(pairs)), key=lambda k: (pairs[k][0], -pairs[k][2], pairs[k][1]) if first_come else (-pairs[k][2], pairs[k][0], pairs[k][1])):
        if pairs[k][0] not in ids and pairs[k][1] not in keys:
            ids.add(pairs[k][0])
            keys.add(pairs[k][1])
            keep.append(k)
    return keep


def _one_task(pairs: DataFrame, first_come: bool) -> DataFrame:
    """A pass in order over a table of FEW pairs at most."""

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in rows if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            keep = _in_turn(list(zip(*(table.column(c).to_pylist() for c in ("id", "key", "score")))), first_come)
            yield from table.take(pa.array(keep, pa.int64())).combine_chunks().to_batches()

    return pairs.coalesce(1).mapInArrow(finish, pairs.schema)


def _without(pairs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Pairs whose id and key are both still free."""
    return pairs.join(fixed.select("id"), "id", "left_anti").join(fixed.select("key"), "key", "left_anti")


def _by_component(pairs: DataFrame) -> DataFrame:
    """pairs with the component of the graph of ids and keys they are in, and its size."""
    nodes = materialize(pairs.select(F.struct(F.lit(0).alias("side"), F.col("id").cast("string").alias("v")).alias("x")).unionByName(pairs.select(F.struct(F.lit(1).alias("side"), F.col("key").cast("string").alias("v")).alias("x"))).distinct().select("x.*", F.monotonically_increasing_id().alias("n")))
    side = lambda s, c: nodes.where(f"side = {s}").select(F.col("v").alias(f"v{c}"), F.col("n").alias(f"n{c}"))
    numbered = materialize(pairs.join(side(0, "i"), F.col("id").cast("string") == F.col("vi")).join(side(1, "k"), F.col("key").cast("string") == F.col("vk")).select("id", "key", "score", "ni", "nk"))
    comp = connected_components(numbered.select(F.col("ni").alias("src"), F.col("nk").alias("dst"))).select(rekey("node").alias("node"), "component")
    named = materialize(numbered.join(comp, F.col("ni") == F.col("node")).select("id", "key", "score", "component"))
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select(rekey("component").alias("c"), "size")
    return materialize(named.join(sizes, F.col("component") == F.col("c")).drop("c"))


def assign_one_to_one(scored: DataFrame, first_come: bool = False, few: int = FEW) -> DataFrame:
    """(id, key, score) candidates -> each id and each key at most once, of any
    type that sorts. The best pair is fixed first, then the best of what is left
    (ties to smaller id, then key); with first_come ids choose in their order,
    each the best key that is left.

    Rounds fix every pair that comes first for both its id and its key, which is
    what a pass over all pairs in order would do, as long as a round settles a
    good part of the pairs. What is left are chains, where each pair waits for the
    one before: they fall apart into components of ids and keys, and components of
    up to `few` pairs are passed through in order, all at once. Larger ones are
    taken together in their order, `few` pairs at a time, each lot without the ids
    and keys that the earlier ones took; so many jobs at most as there are such
    lots. All steps are written to the shared folder."""
    left, done = materialize(scored.groupBy("id", "key").agg(F.max("score").alias("score"))), []
    worse = -F.col("score")
    for_key = F.struct("id", worse) if first_come else F.struct(worse, F.col("id"))
    order = [F.col("id"), F.desc("score"), F.col("key")] if first_come else [F.desc("score"), F.col("id"), F.col("key")]
    n = left.count()
    while n > few:
        by_id = left.groupBy("id").agg(F.min_by("key", F.struct(worse, F.col("key"))).alias("key"))
        by_key = left.groupBy("key").agg(F.min_by("id", for_key).alias("id"))
        pairs = materialize(by_id.join(by_key, ["id", "key"]).join(left, ["id", "key"]).select("id", "key", "score"))
        done.append(pairs)
        rest = materialize(_without(left, pairs).select("id", "key", "score"))
        remove(left)
        left, before, n = rest, n, rest.count()
        if n > ROUND_LEAVES * before:
            break
    if n > few:
        parted = _by_component(left)
        small = parted.where(F.col("size") <= few)

        def settle(group: pa.Table) -> pa.Table:
            group = group.drop_columns(["component", "size"])
            return group.take(pa.array(_in_turn(list(zip(*(group.column(c).to_pylist() for c in ("id", "key", "score")))), first_come), pa.int64()))

        done.append(materialize(small.groupBy("component").applyInArrow(settle, left.schema)))
        large = parted.where(F.col("size") > few).select("id", "key", "score")
        if not large.isEmpty():
            ranked = materialize(global_rank(large, order, "_rank"))
            for begin in range(0, ranked.count(), few):
                lot = ranked.where((F.col("_rank") > begin) & (F.col("_rank") <= begin + few)).drop("_rank")
                if begin:  # one table of all that is taken, so that plans don't grow with the lots
                    lot = _without(lot, taken)
                fixed = _one_task(lot.select("id", "key", "score"), first_come)
                more = materialize(taken.unionByName(fixed) if begin else fixed)
                if begin:
                    remove(taken)
                taken = more
            done.append(taken)
    else:
        done.append(materialize(_one_task(left, first_come)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


#: assigned_matches() begins with so many pairs of names, then takes what makes FOUND pairs to
#: pass through in one task, but no more than COMPARED at once unless few of them are matches.
BEGIN, FOUND, COMPARED = 40_000_000, 10_000_000, 2_000_000_000
#: A lot compares so many times what the last one did at most.
GROWTH = 16


def _in_order(lists: list[list[np.ndarray]], first_come: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (i, k, score) of some lists in the order of a pass: numbers of one word are
    sorted, if three fit into one."""
    scores = np.unique(np.concatenate([np.unique(s) for _, _, s in lists]))[::-1]
    bits_i, bits_k, bits_s = (int(x).bit_length() for x in (max(i.max() for i, _, _ in lists), max(k.max() for _, k, _ in lists), len(scores)))
    if bits_i + bits_k + bits_s > 63:
        i, k, score = (np.concatenate(c) for c in zip(*lists))
        order = np.lexsort((k, -score, i) if first_come else (k, i, -score))
        return i[order], k[order], score[order]
    at_i, at_s = (bits_k + bits_s, bits_k) if first_come else (bits_k, bits_k + bits_i)
    words = np.concatenate([i << at_i | np.searchsorted(-scores, -s) << at_s | k for i, k, s in lists])
    words.sort()
    return words >> at_i & (1 << bits_i) - 1, words & (1 << bits_k) - 1, scores[words >> at_s & (1 << bits_s) - 1]


def _first_free(i: np.ndarray, k: np.ndarray, size: int = 1 << 14) -> list[int]:
    """Places of the pairs that a pass over them as they come fixes."""
    used_i, used_k, keep = bytearray(int(i.max()) + 1), bytearray(int(k.max()) + 1), []
    seen_i, seen_k = np.frombuffer(used_i, np.uint8), np.frombuffer(used_k, np.uint8)
    for at in range(0, len(i), size):
        free = np.flatnonzero(seen_i[i[at : at + size]] + seen_k[k[at : at + size]] == 0) + at
        x, y = i[free], k[free]
        ends = np.append(np.flatnonzero(np.diff(x)) + 1, len(x))
        for begin, end, one in zip([0, *ends[:-1].tolist()], ends.tolist(), x[ends - 1].tolist() if len(x) else []):
            if used_i[one]:
                continue
            for p in range(begin, end):  # those of one i that follow each other
                other = y[p]
                if not used_k[other]:
                    used_i[one] = used_k[other] = 1
                    keep.append(int(free[p]))
                    break
    return keep


def _packed(pairs: DataFrame) -> DataFrame:
    """(i, k, score) written as some thousands of pairs a row, how many they are and how
    many have a score of 100: what one task reads then are few rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, k, score = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64()), pa.array([int((score >= 100).sum())], pa.int64()), pa.array([i.tobytes() + k.tobytes() + score.tobytes()])], ["n", "top", "pairs"])

    return materialize(pairs.select("i", "k", "score").mapInArrow(pack, "n long, top long, pairs binary"))


def _unpacked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for n, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            i, k, score = np.frombuffer(data, np.int64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.float64, n, 16 * n)
            keep = score >= least
            yield [i[keep], k[keep], score[keep]]


def _passed(packed: DataFrame, n: int, first_come: bool, least: float = 0.0) -> DataFrame:
    """n packed pairs -> the (i, k, score), of a score of `least`, that a pass in order
    fixes, in one task, some bytes a pair; very many are left to assign_one_to_one()."""
    columns = ["i", "k", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [some for some in _unpacked(batches, least) if len(some[0])]
        if lists:
            i, k, score = _in_order(lists, first_come)
            keep = _first_free(i, k)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (i, k, score)], columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _unpacked(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in some], ["id", "key", "score"])

    if n > 4 * FOUND:
        return assign_one_to_one(packed.mapInArrow(rows, "id long, key long, score double"), first_come).toDF(*columns)
    return packed.coalesce(1).mapInArrow(run, "i long, k long, score double")


def _side_by_side(spark: SparkSession, *work: Callable[[], object]) -> list:
    with ThreadPoolExecutor(len(work)) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(one)) for one in work]]


def assigned_matches(left: DataFrame, right: DataFrame, threshold: float = 85.0, company: float = 75.0, block: int | None = None, rules: tuple[bool, ...] = (False,)) -> list[DataFrame]:
    """left (id, name, org), right (key, name, org) -> for each rule (its first_come)
    what assign_one_to_one() makes of scored_matches(): (id, key, score).

    Most pairs are never made: ids come in lots, in their order, and each lot is only
    compared with the keys that the earlier ones left. That is the order in which ids
    choose; of the best pairs it is that of those with the highest score there is, 100,
    which are fixed first. Pairs of less are then made of the ids and keys left, the
    better ones first where they are many. Lots grow as far as few pairs are found."""
    numbers = lambda rows, c, n: materialize(global_rank(rows.select(c).where(f"{c} is not null").distinct(), [F.col(c)], n))
    # few bytes, but not little work: all tasks share the names
    folded = lambda rows, c, name, org: materialize(rows.select(c, "name", "org").repartition(parts(rows.sparkSession)).select(c, compare_key(F.col("name")).alias(name), compare_key(text("org")).alias(org)))
    spark = left.sparkSession
    ids, keys, a, b = _side_by_side(spark, lambda: numbers(left, "id", "i"), lambda: numbers(right, "key", "k"), lambda: folded(left, "id", "na", "oa"), lambda: folded(right, "key", "nb", "ob"))
    alike = _alike_companies(a, b, company)
    orgs = [materialize(alike.select(o).distinct().withColumn(c, F.monotonically_increasing_id())) for o, c in (("oa", "ca"), ("ob", "cb"))]
    alike = materialize(alike.join(orgs[0], "oa").join(orgs[1], "ob").select(F.col("ca").alias("one"), F.col("cb").alias("other"), "bonus"))
    a, b = _side_by_side(spark, lambda: materialize(a.join(ids, "id").join(orgs[0], "oa", "left").select("i", "na", "ca")), lambda: materialize(b.join(keys, "key").join(orgs[1], "ob", "left").select("k", "nb", "cb")))
    n, m = ids.count(), keys.count()

    def scored(x: DataFrame, y: DataFrame, least: float) -> tuple[DataFrame, int, int]:
        """Packed pairs that reach `least`, how many they are, and of a score of 100."""
        # a similar company makes 100 of 85 and more
        base = max(threshold, least - BONUS - 1e-9 if threshold < 100 - BONUS or least >= 100 else least)
        near = near_rows(x, y, base, prefix=block or 0, names=False)
        known = near.join(alike, (F.col("ca") == F.col("one")) & (F.col("cb") == F.col("other")), "left")
        packed = _packed(known.select("i", "k", _with_bonus("score", "bonus").alias("score")).where(F.col("score") >= least))
        return packed, *(x or 0 for x in packed.agg(F.sum("n"), F.sum("top")).first())

    size = max(1, BEGIN // max(1, m))
    begun, every, top = scored(a.where(F.col("i") <= size), b, threshold)

    def assign(first_come: bool) -> DataFrame:
        least = threshold if first_come or size >= n else 100.0
        packed, found, begin, lot, left_keys, taken = begun, every, 0, size, m, None
        while True:
            fixed = _passed(packed, found, first_come, least)
            taken, before = materialize(fixed if taken is None else taken.unionByName(fixed)), taken
            for old in (before, packed):
                if old is not None and old is not begun:
                    remove(old)
            compared, found = lot * left_keys, top if packed is begun and least > threshold else found
            begin, left_keys = begin + lot, m - taken.count()
            if begin >= n or not left_keys:
                break
            share = max(found, 1) / compared
            lot = min(n - begin, max(1, int(min(GROWTH * compared, FOUND / share, max(COMPARED, 4 * left_keys / share)) / left_keys)))
            packed, found, _ = scored(a.where((F.col("i") > begin) & (F.col("i") <= begin + lot)), b.join(taken.select("k"), "k", "left_anti"), least)
        if least <= threshold or not left_keys:
            return taken
        # no pair of 100 is left of free ids and keys
        many = every / (min(size, n) * m) * (n - m + left_keys) * left_keys > FOUND
        for bound in [threshold + (100 - threshold) * k / 4 for k in (3, 2, 1, 0)] if many else [threshold]:
            packed, found, _ = scored(a.join(taken.select("i"), "i", "left_anti"), b.join(taken.select("k"), "k", "left_anti"), bound)
            taken, before = materialize(taken.unionByName(_passed(packed, found, first_come))), taken
            remove(before)
            remove(packed)
        return taken

    done = _side_by_side(spark, *(lambda rule=rule: assign(rule) for rule in rules))
    remove(begun)
    return [pairs.join(ids, "i").join(keys, "k").select("id", "key", "score") for pairs in done]


def ranked_lookup(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """candidates (record, rule, pos, key), index (rule, key, contact, seq): the
    contact of the first rule and position that hits; of several contacts with a
    key the first."""
    first = index.groupBy("rule", "key").agg(F.min_by("contact", "seq").alias("contact"))
    hits = candidates.where(F.col("key").isNotNull()).join(first, ["rule", "key"])
    return hits.groupBy("record").agg(F.min_by(F.struct("contact", "rule"), F.struct("rule", "pos", "key")).alias("m")).select("record", "m.contact", "m.rule")


def record_candidates(records: DataFrame) -> DataFrame:
    """records (record, emails, phones, handles, names arrays) -> candidates by
    rule: 1 mail, 2 phone, 3 handle, 5 profile name in a handle."""
    out = None
    for rule, source, key in (
        (1, "emails", lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))),
        (2, "phones", lambda c: phone_key(c)),
        (3, "handles", lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))),
        (5, "handles", lambda c: F.nullif(F.lower(F.regexp_extract(c, r"(?i)/in/([^/?#]+)", 1)), F.lit(""))),
    ):
        one = records.select("record", F.posexplode(source).alias("pos", "v")).select("record", F.lit(rule).alias("rule"), "pos", key(F.col("v")).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


def resolve_tags(tags: DataFrame, names: DataFrame, aliases: DataFrame, cutoff: float = 90.0) -> DataFrame:
    """tags (tag), names (name), aliases (alias, name) -> (tag, group_name, route):
    alias, folded equality, token-sorted similarity, else a new group."""
    t = tags.select("tag", compare_key(F.col("tag")).alias("k")).distinct()
    by_alias = t.join(aliases.select(compare_key(F.col("alias")).alias("k"), F.col("name").alias("g")), "k").select("tag", F.lit(1).alias("o"), F.lit(100.0).alias("s"), "g")
    folded = names.select("name", compare_key(F.col("name")).alias("nk"))
    equal = t.join(folded, F.col("k") == F.col("nk")).select("tag", F.lit(2).alias("o"), F.lit(100.0).alias("s"), F.col("name").alias("g"))
    close = best_matches(t.select(F.col("tag").alias("id"), F.col("tag").alias("name"), F.lit("").alias("org")), names.select(F.col("name").alias("key"), "name", F.lit("").alias("org")), cutoff)
    near = close.select(F.col("id").alias("tag"), F.lit(3).alias("o"), F.col("score").alias("s"), F.col("key").alias("g"))
    new = t.select("tag", F.lit(4).alias("o"), F.lit(0.0).alias("s"), title_case(F.col("tag")).alias("g"))
    every = by_alias.unionByName(equal).unionByName(near).unionByName(new)
    best = every.groupBy("tag").agg(F.min(F.struct("o", (-F.col("s")).alias("s"), "g")).alias("m"))
    return best.select("tag", F.col("m.g").alias("group_name"), F.element_at(F.array(*map(F.lit, ("alias", "equal", "similar", "create"))), F.col("m.o")).alias("route"))


def shared_keys(rows: DataFrame, id_col: str, key: str, least: int = 3) -> DataFrame:
    """Keys that at least so many different ids have."""
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.countDistinct(id_col).alias("holders")).where(F.col("holders") >= least)


def suggest_members(members: DataFrame, orgs: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """members (label, contact), orgs (contact, org): where one organisation makes
    up at least `share` of a label's members, other contacts of it are proposed."""
    size = members.groupBy("label").agg(F.countDistinct("contact").alias("size"))
    n = members.join(orgs, "contact").groupBy("label", "org").agg(F.countDistinct("contact").alias("n"))
    main = n.join(size, "label").where((F.col("n") >= least) & (F.col("n") >= share * F.col("size")))
    return main.join(orgs, "org").join(members, ["label", "contact"], "left_anti").select("label", "org", "contact").distinct()


def match_report(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("score") >= 95).alias("sure"), F.count_if((F.col("score") >= 85) & (F.col("score") < 95)).alias("likely"), F.count_if(F.col("score") < 85).alias("weak"))


def match_connections(connections: DataFrame, contacts: DataFrame, threshold: float = 85.0, block: int | None = None) -> DataFrame:
    """connections (id, name, email, org), contacts (key, seq, names array, emails
    array, org) -> (id, key, score, route): by mail address first (98, the last
    contact that has it), else by the best of a contact's names; each contact
    once, connections choosing in the order of their ids. A block size limits
    names to equal first letters and loses pairs of another word order."""
    mails = contacts.select("key", "seq", F.explode("emails").alias("e")).select("key", "seq", F.lower(F.trim("e")).alias("m")).where("m <> ''")
    owner = mails.groupBy("m").agg(F.max_by("key", "seq").alias("key"))
    by_mail = connections.join(owner, F.lower(F.trim("email")) == F.col("m")).groupBy("key").agg(F.min("id").alias("id")).select("id", "key", F.lit(98.0).alias("score"), F.lit("email").alias("route"))
    open_ = connections.join(by_mail.select("id"), "id", "left_anti").select("id", "name", "org")
    free = contacts.join(by_mail.select("key"), "key", "left_anti").select("key", F.explode("names").alias("name"), "org")
    near = scored_matches(open_, free, threshold, block=block).groupBy("id", "key").agg(F.max("score").alias("score"))
    fixed = assign_one_to_one(near, first_come=True)
    with_org = fixed.join(connections.select("id", compare_key(text("org")).alias("oa")), "id").join(contacts.select("key", compare_key(text("org")).alias("ob")), "key")
    alike = (F.col("oa") != "") & (F.col("ob") != "") & (fast_ratio("oa", "ob") >= 75.0)
    return by_mail.unionByName(with_org.select("id", "key", "score", F.when(alike, "company").otherwise("name").alias("route")))


#: Names of more words than this meet by any word they share instead of by sets of words.
MANY_WORDS = 12


def _common_words(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs (na, nb), lengths within 1.5 times, whose common words alone reach
    `threshold` with one of the names: sets of a name's words are looked up, of one
    name those that leave out little of it, of the other all that are long enough."""
    share = threshold / (200.0 - threshold)  # of the name's length that the common words have at least

    def sets(name: str, least: float) -> list[str]:
        words = sorted(set(name.split()))
        if len(words) > MANY_WORDS:
            return []
        whole = len(" ".join(words))
        every = (" ".join(w for k, w in enumerate(words) if bits >> k & 1) for bits in range(1, 1 << len(words)))
        return [s for s in every if len(s) >= least * whole - 1e-9]

    def of(names: DataFrame, col: str, least: float) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(s, n) for n in batch.column(0).to_pylist() for s in sets(n, least)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["s", col])

        # few bytes, but not little work: all tasks share the names
        return names.select(col).repartition(parts(names.sparkSession)).mapInArrow(run, f"s string, {col} string")

    near = F.greatest(F.length("na"), F.length("nb")) < 1.5 * F.least(F.length("na"), F.length("nb"))
    out = None
    for left, right in ((share, 0.0), (0.0, share)):
        met = of(a, "na", left).join(of(b, "nb", right), "s").where(near).select("na", "nb")
        out = met if out is None else out.unionByName(met)
    many = F.size(F.array_distinct(F.split("na", " "))) > MANY_WORDS
    words = lambda names, c: names.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("s"))
    other = F.size(F.array_distinct(F.split("nb", " "))) > MANY_WORDS
    wordy = words(a.where(many), "na").join(words(b, "nb"), "s").where(near).select("na", "nb").unionByName(words(a, "na").join(words(b.where(other), "nb"), "s").where(near).select("na", "nb"))
    return out.unionByName(wordy).distinct()


def fuzzy_participants(records: DataFrame, names: DataFrame, cutoff: float = 92.0, block: int | None = None) -> DataFrame:
    """records (record, names array), names (contact, name) -> (record, contact,
    score): the contact whose name is most alike (weighted ratio) to any of a
    record's participants; ties to the smaller contact.

    Above a cutoff of 90 partial ratios don't count. What then reaches the cutoff
    has a plain ratio of it, or at 0.95 one of the sorted words or of the sets of words,
    or common words that are nearly all of one name: only such pairs leave the cells
    or indexes where names meet. Below, no index finds all pairs; a block size is
    needed, which limits them to equal first letters."""
    asked = records.select("record", F.explode("names").alias("n")).select("record", compare_key(F.col("n")).alias("q")).where("q <> ''").distinct()
    asked = materialize(asked)  # read again and again below, as are the names
    have = materialize(names.select("contact", compare_key(F.col("name")).alias("h")).where("h <> ''"))
    q, h = asked.select("q").distinct(), have.select("h").distinct()
    if block:
        pairs = q.join(h, F.left("q", F.lit(block)) == F.left("h", F.lit(block)))
    elif cutoff <= 90:
        raise ValueError("a cutoff of 90 or less needs a block size")
    else:
        plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\W+", " "))
        x, y = (materialize(side) for side in (q.select("q", plain(F.col("q")).alias("na")), h.select("h", plain(F.col("h")).alias("nb"))))
        na, nb = (materialize(side.where(f"{c} <> ''").select(c).distinct()) for side, c in ((x, "na"), (y, "nb")))
        alike = weighted_pairs(na, nb, cutoff)
        if cutoff <= 95:  # token sets count 0.95: their common words may make up one name but for a letter or two
            alike = alike.unionByName(_common_words(na, nb, cutoff / 0.95)).distinct()
        pairs = x.join(alike, "na").join(y, "nb").select("q", "h")
    near = pairs.withColumn("score", weighted_ratio("q", "h")).where(F.col("score") >= cutoff).select("q", "h", "score")
    hits = asked.join(near, "q").join(have, "h")
    w = Window.partitionBy("record").orderBy(F.desc("score"), "contact")
    return hits.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("record", "contact", "score")
