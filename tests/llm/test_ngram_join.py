import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import ngram_join as nj
from quern.llm import textual
from quern.llm.graphs import components


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.choice([1, 3, 5, 8, 20, 60, 150, 400]))]
            if r.random() < 0.5:
                w[len(w) // 2 : len(w) // 2] = passage
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = list(enumerate([*corpus(seed, 240), "", None, " \n ", "One TWO", "one\ttwo", "A b c d E f", "a B c d e f"]))
    rows += rows[:3] + [(None, rows[5][1]), (None, "nobody else says this at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in nj.jaccard_components(df).collect()), key=str)
    assert got == brute(rows)


def test_ids_that_are_null_or_stand_by_several_texts(spark):
    r = random.Random(9)
    texts = [" ".join(f"{k}w{r.randrange(900)}" for _ in range(80)) for k in range(6)]
    near = [t + " and one more" for t in texts]
    rows = [(4, texts[0]), (4, texts[1]), (9, near[0]), (8, near[1]), (None, texts[2]), (None, near[2]), (None, texts[3]), (2, near[3]), (None, texts[4]), (None, texts[4])]
    got = sorted((tuple(x) for x in nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert nj.jaccard_components(spark.createDataFrame([], "doc_id long, text string, node long")).count() == 0


def test_chain_and_large_group(spark):
    r = random.Random(5)
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each differs a little from the one before; the ends are far apart
        rows.append((i, " ".join(w)))
        w[(7 * i) % 120] = f"x{r.random()}"
    got = {x.doc_id: x.component_id for x in nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, _, c in brute(rows)}


def test_words_in_segments(monkeypatch):
    texts = corpus(3, 60) + ["", "y" * 500, "é  ü", None]
    want = textual.batch_shingles(pa.array(texts))
    monkeypatch.setattr(textual, "SEGMENT", 64)
    got = textual.batch_shingles(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert [len(x) for x in want] == [len(sets(t)) for t in texts]


@pytest.mark.parametrize("n", [100, 255, 300, 511, 700, 1020, 2040, 6000])
def test_linked_sets_that_differ_in_as_many_parts_as_they_can_meet(n):
    for seed in range(5):
        s = np.unique(np.random.default_rng(seed).integers(0, 2**64, n, dtype="u8"))
        band = len(s).bit_length() - 1
        part = ((s >> np.uint64(32)) * np.uint64(nj.parts(band))) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: n // 5]  # a shingle of each part, as long as the link holds
        other = np.delete(s, first)
        assert nj.linked(len(s), len(other), len(other))
        a, b = nj.signatures(s), nj.signatures(other)
        assert len(np.intersect1d(a[0], b[0])) or not b[1]


def almost_copies(n):
    """Texts that differ in words of their own: any two are far from each other by a little, but the last ones, which are linked by pairs."""
    words = [f"w{i}" for i in range(138)]
    texts = [" ".join(f"x{k}y{i}" if i in (20, 70, 120) else w for i, w in enumerate(words)) for k in range(n)]
    return texts + [t + " and one more" for t in texts[-6:]]


def test_pairs_of_a_large_group_that_just_miss_are_no_rows(spark, monkeypatch):
    rows = list(enumerate(almost_copies(150)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made, apart, lists = [], nj._apart, nj._linked_lists

    def counted(members, comp, nodes, forest):
        found = apart(members, comp, nodes, forest)
        made.append(found.count())
        return found

    monkeypatch.setattr(nj, "_apart", counted)
    monkeypatch.setattr(nj, "_linked_lists", lambda near, nodes: lists(near, nodes, 20_000))  # several groups
    monkeypatch.setattr(nj, "ROUNDS", (False,))
    want = brute(rows)
    cells = nj._members(df.select("doc_id", "text"), nj.parts).count()
    got = sorted((tuple(r) for r in nj.jaccard_components(df).collect()), key=str)
    assert got == want
    assert 0 < made[0] <= cells


def test_disk_holds_no_texts_but_those_of_pairs_that_may_be_linked(spark, monkeypatch):
    # 200 texts share a line and no more, so their cells have nothing for the last round; of the others, five are linked
    r = random.Random(9)
    own = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows = list(enumerate([f"the same line in front of all {own(40)}" for _ in range(200)] + almost_copies(20)))
    rows += [(900 + k, rows[3][1] + " and more" * k) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables, fetched, cells, stored, texts, apart = [], [], [], nj.stored, nj._texts, nj._apart

    def kept(table, what, outlive=False):
        tables.append(table.columns)
        return stored(table, what, outlive)

    def read(docs, classes, wanted):
        fetched.append(texts(docs, classes, wanted).count())
        return texts(docs, classes, wanted)

    def counted(members, comp, nodes, forest):
        cells.append(members.select("cell").distinct().count())
        return apart(members, comp, nodes, forest)

    for name, f in (("stored", kept), ("_texts", read), ("_apart", counted)):
        monkeypatch.setattr(nj, name, f)
    assert sorted((tuple(x) for x in nj.jaccard_components(df).collect()), key=str) == brute(rows)
    assert not any({"text", "bitmap"} & set(columns) for columns in tables)
    assert fetched and max(fetched) < 100
    assert len(cells) == 2 and cells[1] < cells[0]


def test_shuffle_files_go_with_their_query(spark):
    top = [Path(d.getAbsolutePath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in top for f in d.rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = list(enumerate(corpus(4, 60)))
    result = nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert sorted((tuple(x) for x in result.collect()), key=str) == brute(rows)


def test_lists_in_groups_of_any_size():
    r = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in r.integers(0, 40, (300, 2)) if a < b}
    near = [(int(k), a, 10, np.array([b, b], "i8").tobytes()) for a, b in sorted(pairs) for k in {a % 3, b % 2}]
    table = pa.table([pa.array(c, t.type) for c, t in zip(zip(*near), nj.NEAR)], schema=nj.NEAR)
    for limit in (1, 100, 10_000):
        rows = nj._gather(table, limit).to_pylist()
        assert len({(x["g"], x["node"]) for x in rows}) == len(rows)
        held = {g: {x["node"] for x in rows if x["g"] == g} for g in {x["g"] for x in rows}}
        lists = [(x["g"], x["node"], b) for x in rows if x["others"] for b in np.frombuffer(x["others"], "i8").tolist()]
        assert {(a, b) for _, a, b in lists} == pairs and all(b in held[g] for g, _, b in lists)


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_the_driver_and_of_joins(spark, few):
    r = random.Random(4)
    links = sorted({(r.randrange(120), 200 + r.randrange(120)) for _ in range(90)})
    order = spark.createDataFrame([(v, -v) for v in range(320)], "node long, rank long")
    got = {x.node: x.comp for x in components(spark.createDataFrame(links, "a long, b long"), order, few).collect()}
    for a, b in links:
        assert got[a] == got[b]
    groups = {v: v for pair in links for v in pair}
    for _ in groups:
        for a, b in links:
            groups[a] = groups[b] = max(groups[a], groups[b])
    assert {v: c.node for v, c in got.items()} == groups


def test_few_parts_lose_no_link(spark):
    rows = list(enumerate(corpus(4, 160)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in nj.jaccard_components(df, lambda band: 3).collect()), key=str)
    assert got == brute(rows)


def test_bitmap_bound():
    r = np.random.default_rng(1)
    for n in (5, 70, 900):
        a = np.unique(r.integers(0, 2**63, n, dtype="u8"))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**63, n // 3 + 1, dtype="u8")]))
        x, y = (np.frombuffer(nj.bitmap(s), "u8") for s in (a, b))
        w = min(len(x), len(y))
        assert nj.bound(len(a), nj._fold(x, w), np.array([len(b)]), nj._fold(y, w)[None])[0] >= len(np.intersect1d(a, b))


def test_parity_bound():
    r = np.random.default_rng(2)
    for n in (1, 5, 70, 900):
        a = np.unique(r.integers(0, 2**63, n, dtype="u8"))
        for part in (0, n // 2, n - n // 10, n):
            b = np.unique(np.concatenate([a[:part], r.integers(0, 2**63, n // 3 + 1, dtype="u8")]))
            x, y = (np.frombuffer(nj.parity(s), "u8") for s in (a, b))
            w = min(len(x), len(y))
            assert nj.parity_bound(len(a), nj._fold_parity(x, w), np.array([len(b)]), nj._fold_parity(y, w)[None])[0] >= len(np.intersect1d(a, b))
