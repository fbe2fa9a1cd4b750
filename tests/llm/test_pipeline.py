from __future__ import annotations

import pandas as pd
import pytest
from test_ops import brute_lines, brute_spans, check_packing, similar_groups

import corpus_pipeline as C


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The result of each stage, as run() chains them."""
    docs, out = C.read_table(spark, sf, "documents"), []
    for _, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, sf))
        out.append(docs.toPandas())
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
    for rows in stages[:-1]:
        assert rows.columns.tolist() == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (rows.n_chars == rows.text.str.len()).all()


def test_stages_equal_brute_force(stages, sf):
    first, second, third, fourth, packed = (s.sort_values("doc_id").reset_index(drop=True) for s in stages)
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    kept = set(first.doc_id)
    assert all((i in kept) == (q == 1) for i, q in labels.items())
    gone = brute_lines(first.text, first.doc_id)
    want = ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in zip(first.doc_id, first.text)]
    assert second.text.tolist() == want
    near, lead = similar_groups(second.text.tolist())
    one_each = {second.doc_id[k] for k, c in enumerate(lead) if c == k}
    assert len(one_each ^ set(third.doc_id)) <= 2  # long texts of a similarity close to 0.8 are estimated
    assert all(second.doc_id[k] in set(third.doc_id) or near[k] >= 0.78 for k in range(len(second)))
    assert third.text.tolist() == second.set_index("doc_id").text.loc[third.doc_id].tolist()
    texts = dict(zip(third.doc_id, third.text))
    cuts = {}
    for i, s, e, *_ in brute_spans(third.text, third.doc_id.tolist()):
        cuts.setdefault(i, []).append((s, e))
    for i, t in texts.items():
        for s, e in sorted(cuts.get(i, []), reverse=True):
            t = t[:s] + t[e:]
        texts[i] = t
    assert dict(zip(fourth.doc_id, fourth.text)) == texts
    used, least = check_packing(packed, texts)
    assert used <= least * 1.02


def test_run(spark, sf, stages):
    assert C.run(spark, sf).count() == len(stages[-1])


def test_stages_of_odd_rows(spark, sf):
    """Nulls everywhere, repeated and missing ids, and columns called like the operators' own."""
    line = "this line is repeated in several of the documents, word by word"
    rows = [(None, "one text without an id", None, None, None), (None, "quite another one without an id", "en", "s", 1), (None, None, None, None, None), (-7, None, "en", None, 3), (-7, "", "en", "s", 0), (-5, f"{line}\nfirst tail of it", "en", "s", 9), (-5, f"{line}\nthe second tail has more", "en", "s", 9), (-4, "word " * 30000, "xx", "s", 150000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["score", "text_score", "lines_removed", "spans_removed", "_row", "o", "fp", "k", "cut"]
    docs = docs.select("*", *(C.F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in C.STAGES[:4]:
        got = C.materialize(stage(spark, docs, sf))
        assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
        out = got.toPandas()
        assert all((out[n] == f"own {n}").all() for n in names), name
        if name == "line dedup":
            assert len(out) == len(rows) and sorted(out.text.dropna())[0] == "" and "the second tail has more" in set(out.text)
        if name == "simhash near-dedup":
            assert len(out) == 6 and out.text.notna().sum() >= 5
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert C.STAGES[4][1](spark, docs, sf).where("doc_id = -4").count() > 20
