import os
import random

import pytest

import corpus_pipeline
from quern.llm import decontaminate, ngram_join, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, SF)
        assert docs.columns == before.columns
        docs = docs.cache()
        kept[name] = docs.count()
        assert 0 < kept[name] <= before.count()
    groups = [x.component_id for x in ngram_join.jaccard_components(docs).collect()]
    assert len(groups) == kept["PII"]
    assert decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert pii.find(docs).filter("n_email > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept["PII"]


def test_rows_without_an_id_of_their_own(spark):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item, copied, alone, other, hot = prose(30), prose(60), prose(60), prose(60), prose(60)
    near = copied.rsplit(" ", 1)[0] + " changed"
    leak = f"{prose(40)} {item} {prose(40)}"
    rows = [(None, copied), (None, near), (None, alone), (5, near), (6, other), (6, leak), (None, leak + " end"), (None, None), (None, ""), (None, None), *[(3, hot)] * 40, *[(None, prose(50))] * 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(g for g, s in zip(group, sets, strict=True) if s is sets[i] or linked(s, sets[i])) for i in range(len(rows))]
    key = lambda x: (x[0] is None, x[0] or 0)
    got = [tuple(x) for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    want = [min((rows[i] for i in range(len(rows)) if group[i] == g), key=key) for g in set(group)]
    ids = lambda x: sorted(map(str, (y[0] for y in x)))
    assert len(got) == len(want) == len(set(group)) and ids(got) == ids(want)
    assert {g[1] for g in got} >= {near, alone, other, hot} and copied not in {g[1] for g in got}
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = sorted((tuple(x) for x in decontaminate.clean(docs, bench).collect()), key=str)
    assert clean == sorted((x for x in rows if not shingles(item) <= shingles(x[1])), key=str) and len(clean) == len(rows) - 2


CLASH = "doc_id long, text string, n_chars long, rid long, terms string, h long, size string, node string, key int, c0 string, places string, row int, none string, first string, cell long, bucket int"


def _tables(spark, folder, item):
    spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)] + [(None, 1, 1, None)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item, 5), (2, None, 5), (None, "", 5)], "item_id long, text string, n int").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_keep_columns_with_any_names(spark, tmp_path):
    r = random.Random(15)
    prose = lambda n, a="abcdefgh": " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(n))
    item = prose(30)
    texts = [prose(40) if i % 2 else "buy now " * 30 + prose(3, "xyz") for i in range(60)]
    texts += [texts[1], f"{prose(30)} {item} {prose(20)}", "write to joe@mail.example.com now", "é" * 200_000, "one " * 60_000, "", None, None]
    ids = [*range(60), 60, 61, 62, 63, 64, 65, None, 66]
    rows = [(d, t, None if t is None else len(t), 7, "t", 8, "s", "n", 9, "c", "p", 1, "o", "f", 2, 3) for d, t in zip(ids, texts, strict=True)]
    _tables(spark, tmp_path, item)
    docs = spark.createDataFrame(rows, CLASH).repartition(3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        got = {tuple(x)[3:] for x in out.collect()}
        assert got == {rows[0][3:]}
    near = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()]
    assert len(near) == len(rows) - 1 and (60, texts[60]) not in near and (None, None) in near
    clean = {x.doc_id for x in corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()}
    assert clean == set(ids) - {61}
    told = {x.doc_id: x.text for x in corpus_pipeline.pii_stage(spark, docs, str(tmp_path)).collect()}
    assert told == dict(zip(ids, texts, strict=True)) | {62: "write to [EMAIL] now"}
    packed = corpus_pipeline.packing_stage(spark, docs, str(tmp_path))
    assert packed.filter("start = 0").count() == len(rows)


def test_stages_with_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, "an item of five words and more")
    docs = spark.createDataFrame([], CLASH)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_more_terms_than_are_sent(spark, monkeypatch):
    r = random.Random(16)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    texts = [f"{prose(9)} zorblax wrote joe@mail.example.com {prose(5)}" for _ in range(10)] + [f"{prose(5)} wrote" for _ in range(12)] + [prose(9) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, h string, size string, places string").repartition(3)
    want = [sorted(map(str, f(docs).collect())) for f in (pii.find, pii.clean)]
    assert "zorblax" not in str(want[1]) and "term:" in str(want[0]) and "wrote" in str(want[1])
    monkeypatch.setattr(pii, "SENT", 0)
    assert [sorted(map(str, f(docs).collect())) for f in (pii.find, pii.clean)] == want


def test_near_duplicate_stage_makes_no_row_of_each_pair_that_just_misses(spark, monkeypatch):
    # any two share 119 of 149 shingles; the last six share 122 of 152 and are linked, so of them and their six sources one stays
    texts = [" ".join(f"x{k}y{i}" if i in (20, 70, 120) else f"w{i}" for i in range(138)) for k in range(150)]
    rows = list(enumerate(texts + [t + " and one more" for t in texts[-6:]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, apart = [], ngram_join._apart

    def counted(members, comp, nodes, forest):
        found = apart(members, comp, nodes, forest)
        made.append((found.count(), members.count()))
        return found

    monkeypatch.setattr(ngram_join, "_apart", counted)
    out = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(145))
    assert made and all(found <= cells for found, cells in made)
