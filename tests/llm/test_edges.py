"""Every registered query, and the pipeline, on tables with nulls, repeated rows, clashing columns, and on empty tables."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxtable.llm import catalog

CLASH = ["a", "b", "rep", "m", "group", "length", "part", "rank", "block", "held", "term", "spans", "like", "best", "page", "cap", "x", "y", "k1", "first", "digest", "__spans2"]
LONG = "Some words repeat and repeat, 10.0.0.1 too. " * 4000
DOCS = [(1, "One two three four five six.", "en", "a.com", 28), (1, "One two three four five six.", "en", "a.com", 28), (2, None, None, None, None), (3, "", "en", "", 0), (4, LONG, "de", "a.com", len(LONG)), (5, LONG, None, "b.com", 1),
        (None, "No id, mail x@y.zz", "fr", "a.com", 1), (6, "\n\n \t", "", "c", 4), (7, "x@y.zz +1 (555) 123-4567", "en", "a.com", 9)]
PAGES = [(1, "http://a/1", "<p>Body</p>"), (1, "http://a/1", "<p>Body</p>"), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", "<p>" + LONG + "</p>"), (5, "u", "<p>" + LONG + "</p>")]
VECS = [(1, [1.0, 0.0, 0.5, 0.1], 0), (1, [1.0, 0.0, 0.5, 0.1], 0), (2, None, None), (3, [], 1), (4, [None, 1.0, 1.0, 1.0], 1), (5, [0.0] * 4, 1), (None, [1.0, 0.0, 0.5, 0.1], 1), (6, [1.0, 0.01, 0.5, 0.1], 1)]
TALKS = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, "user", None), (2, 0, None, "No end"), (None, 0, "user", "A."), (None, None, None, None), (3, 0, "", ""), (4, 0, "user", LONG + "."), (4, 1, "assistant", LONG)]
BENCH = [(1, "One two three four five six."), (2, None), (3, ""), (None, "a b c d e f g h")]


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, tmp_path_factory):
    where = tmp_path_factory.mktemp(request.param)
    for name, rows, schema in (("documents", DOCS, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("pages", PAGES, "page_id bigint, url string, html string"),
                               ("embeddings", VECS, "vec_id bigint, embedding array<float>, label int"), ("benchmark", BENCH, "item_id bigint, text string"),
                               ("conversations", TALKS, "conv_id bigint, turn bigint, role string, text string")):
        df = spark.createDataFrame(rows if request.param == "odd" else [], schema)
        df.select("*", *[F.lit(7).alias(c) for c in CLASH]).coalesce(2).write.parquet(f"{where}/{name}.parquet")
    return request.param, str(where)


EXPECTED = {"op1_tag_ratio": len(PAGES), "op2_backoff_automaton": len(DOCS), "op3_warc": len(PAGES) - 1, "op4_cap_filters": len(VECS) - 1, "op6_language": len(DOCS), "op7_disclosure": len(DOCS), "op10_licences": len(DOCS),
            "op11_square_catching": len(DOCS), "op12_branch_and_bound": 5, "op13_syncmers": len(DOCS)}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, folder, name):
    kind, where = folder
    rows = catalog.QUERIES[name](spark, where).collect()
    if kind == "empty":
        assert rows == []
    elif name in EXPECTED:
        assert len(rows) == EXPECTED[name]
    elif name == "op5_minhash_forest":
        assert {x.doc_id: x.component_id for x in rows} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    elif name == "op8_spaced_seeds":
        assert [(x.doc_id, x.item_id) for x in rows] == [(1, 1), (1, 1)]
    else:
        assert len({x.doc_id for x in rows}) == 8 and sum(x.doc_id == 1 for x in rows) == 2


def test_pipeline(spark, folder):
    kind, where = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = []
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs.columns, corpus_pipeline.stage(function(spark, docs, where), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before
            seen.append(sorted(x.doc_id for x in docs.select("doc_id").collect() if x.doc_id is not None))
            last = docs
    rows = corpus_pipeline.run(spark, where).collect()
    if kind == "empty":
        assert rows == [] and seen == [[]] * 4
        return
    # Documents without letters go; copies of 1 are one document, and it is a benchmark item; 5 is a copy of 4.
    assert seen == [[1, 1, 4, 5, 7], [1, 1, 4, 7], [4, 7], [4, 7]]
    text = {x.doc_id: x.text for x in last.collect()}
    assert "10.0.0.1" not in text[4] and text[7] == "[EMAIL] [PHONE]"
    assert text[None] == "No id, mail [EMAIL]" and {x.doc_id for x in rows} == {4, 7, None}
