"""The pipeline's stages on a small table, and the queries' SQL on the smallest scale."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from panelworks.llm.common import stored

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        new = stored(f(spark, docs, SF))
        out.append((name, docs, new))
        docs = new
    return out


def test_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}, name
    assert stages[-1][2].count() > 0


def test_language_keeps_clean(stages):
    _, before, after = stages[0]
    assert after.count() >= 0.98 * before.filter("text rlike '\\\\p{L}'").count()


def test_near_copies_leave_one(stages):
    from test_llm_edges import brute_components

    _, before, after = stages[2]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    want = {i for i, (c, _) in brute_components(texts, 5, 80).items() if c == i}
    assert {r[0] for r in after.select("doc_id").collect()} == want


def test_whole_result_of_the_middle_stages(spark, stages):
    """Stages 2 to 4, one after another, against the plain versions of all three on what the first stage kept."""
    import re

    from test_llm_edges import brute_components

    import corpus_pipeline as c

    rows = sorted((r["doc_id"], r["text"]) for r in stages[1][1].select("doc_id", "text").collect())
    key = lambda line: "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in line.strip(" \t\n\x0b\f\r"))
    holders, first = {}, {}
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if key(line):
                holders.setdefault(key(line), set()).add(i)
                first.setdefault(key(line), (i, p))
    long = lambda k: len(re.findall(r"[^\x20\x09-\x0d]+", k)) >= 10 or len(k) >= 50
    texts = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [bool(k := key(x)) and len(holders[k]) >= (c.LONG_LINE_DOCS if long(k) else c.LINE_DOCS) and first[k] != (i, p) for p, x in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else t
        if not any(gone) or kept.strip(" \t\n\x0b\f\r"):
            texts[i] = kept
    texts = {i: texts[i] for i, (group, _) in brute_components(texts, 5, 80).items() if group == i}
    words = lambda t: re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
    grams = {tuple(w[k : k + c.WINDOW]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r["text"])] if w for k in range(max(1, len(w) - c.WINDOW + 1))}
    sizes = {len(g) for g in grams}
    texts = {i: t for i, t in texts.items() if not any(tuple(w[k : k + n]) in grams for w in [words(t)] for n in sizes for k in range(len(w) - n + 1))}
    assert {r["doc_id"]: r["text"] for r in stages[3][2].select("doc_id", "text").collect()} == texts and 50 < len(texts) < len(rows)


def test_what_stages_send_and_store_is_taken_back(spark):
    import corpus_pipeline as c
    from panelworks.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    mine = stored(docs)
    first = stored(c.language(spark, docs, SF))
    held = [x for x in c._held if isinstance(x, str)]
    second = stored(c.line_dedup(spark, first, SF))
    place = lambda x: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert held and not any(place(x).getFileSystem(conf).exists(place(x)) for x in held)
    assert mine.count() == 40 and first.count() and second.count()  # what was stored outside stays


def test_repeated_passages_leave_one(spark):
    import corpus_pipeline

    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    passage, ten, nine, glyphs = words(60, "p"), words(10, "t"), words(9, "s"), "\u5b57" * 50
    assert len(nine) < 50
    shared = [passage, f" {ten.upper()} ", ten, nine, glyphs]
    rows = [(i, "\n".join([f"own {i}", *shared])) for i in (1, 2, 3)] + [(10 + i, f"own {10 + i}\nshort line") for i in range(10)] + [(30, passage), (None, passage)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {r["doc_id"]: r["text"].split("\n") for r in out.collect()}
    assert got[1] == ["own 1", passage, f" {ten.upper()} ", nine, glyphs]
    assert got[2] == ["own 2", nine] and got[3] == ["own 3", nine]  # a short line needs 10 documents
    assert 30 not in got and got[None] == [passage]
    assert [got[10 + i] for i in range(10)] == [["own 10", "short line"]] + [[f"own {10 + i}"] for i in range(1, 10)]


def test_decontamination_acts_on_what_it_finds(spark, tmp_path):
    import corpus_pipeline

    item = [f"item{i}" for i in range(15)]
    spark.createDataFrame([("long", " ".join(item)), ("short", "three word item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = " ".join(f"own{i}" for i in range(100))
    rows = [
        (1, f"{own} {' '.join(item)} {own}"),  # an item of 10-19 words, whole
        (2, f"{own} {' '.join(item[2:12])}"),  # ten words of it
        (3, f"{own} {' '.join(item[2:11])}"),  # nine
        (4, f"{own} Three word, item. {own}"),  # an item of fewer words than a window
        (5, f"{own} three word"),
        (None, f"{own} {' '.join(item)}"),
        (None, own),
        (6, f"{own} {' '.join(item)}"),
        (6, own),
        (7, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[i] for i in (2, 4, 6, 8, 9)], key=str)


@pytest.mark.parametrize("name", ["op5_decontamination", "op8_line_dedup", "op9_chat", "op11_manifest", "op12_collocations"])
def test_sql(spark, name):
    import duckdb

    from panelworks.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a = QUERIES[name](spark, SF).toPandas()
    b = con.sql(SQL[name]).df()[list(a.columns)]
    rows = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert rows(a) == rows(b)
