"""The registered queries: against SQL in another engine where they have it, and the pipeline against brute force."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from ripple.llm import queries
from ripple.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLES:
        assert len(mine) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
        return
    theirs = con.execute(queries.ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(repr, mine[columns].values.tolist())) == sorted(map(repr, theirs[columns].values.tolist()))


def test_pipeline(spark):
    from tests.llm.test_operators import brute_components, brute_hits, brute_lines

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, steps = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == names
        steps.append(docs.orderBy("doc_id").toPandas())
    toxic, lines, near, clean = steps
    want = brute_lines(toxic.doc_id.tolist(), toxic.text.tolist())
    assert sorted(zip(lines.doc_id.tolist(), lines.text.tolist(), strict=True)) == sorted((r[0], r[3]) for r in want)
    ids = lines.doc_id.tolist()
    groups = brute_components(lines.text.tolist(), 5, 80, 100)
    assert near.doc_id.tolist() == [ids[i] for i, (n, c) in groups.items() if n == 0 or c == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute_hits(near.text.tolist(), items)
    assert clean.doc_id.tolist() == [i for i, h in zip(near.doc_id.tolist(), hits, strict=True) if h[2] == 0]
    done = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in done.where("decodes and samples_decode").collect()) == clean.doc_id.tolist()


EDGES = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, row string, lines string, `a.b` string"


def test_stages_on_rows_of_any_kind(spark):
    """Null keys and texts, empty and repeated rows, columns named as the operators' own, and no rows at all."""
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " ", "short", words, words, words + " more", "\n".join(["a line that is long enough to be counted, many times"] * 3), *["a line that is long enough to be counted, many times\nx"] * 6]
    rows = [(None if i % 4 == 0 else i % 7, t, None, "s", None, "i", "h", "r", "l", "ab") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, EDGES)
    for name, stage in corpus_pipeline.STAGES:
        for some in (df, df.limit(0)):
            got = written(stage(spark, some, SF), "edges")
            n = got.count()
            assert n <= some.count() and (name == "sentencepiece" or got.columns == df.columns)
            if name in ("toxicity", "line_dedup", "sentencepiece"):
                assert n == some.count()
        if name == "ngram_jaccard_join":
            left = [r["text"] for r in stage(spark, df, SF).collect()]
            assert left.count(words) + left.count(words + " more") == 1 and left.count(None) == left.count("") == left.count(" ") == 1
        if name == "benchmark_decontamination":
            assert stage(spark, df, SF).count() == len(texts)
