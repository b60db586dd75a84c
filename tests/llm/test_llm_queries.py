"""The registered queries on the smallest tables: SQL where there is some, and what the stages leave."""

import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from assetlake.llm import decontamination, jaccard_join, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    wanted, got = c.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(wanted)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    now, counts = docs, [docs.count()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, corpus_pipeline.common.materialize(stage(spark, now, SF), "test-stage")
        counts.append(now.count())
        if n < 4:
            assert now.columns == docs.columns
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        if n == 0:
            assert ids(before) - ids(now) == {r.doc_id for r in toxicity.toxicity(before, labels).where("predicted = 1").collect()}
        if n == 1:
            assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in jaccard_join.similar_documents(before).where("doc_id = class_id").collect())
        if n == 2:
            assert ids(before) - ids(now) == {r.doc_id for r in decontamination.contaminated(before, items).collect()}
        if n == 3:
            assert ids(now) == ids(before)
        if n == 4:
            assert ids(now) == ids(before)
    assert counts[0] > counts[1] > counts[2] and counts[3] <= counts[2]


ROWS = [
    (1, None, "a"), (2, "", "b"), (2, "   ", "c"), (3, "few words", "d"), (4, "long " * 60_000, "e"), (5, "a token=abcdef stands in this text", "f"), (5, "a token=abcdef stands in this text", "g"),
    (5, "another text stands under the same id", "h"), (None, "no id at all stands beside this text", "i"), (None, None, "j"), (7, "you idiot, you worthless idiot and moron", "k"), (7, "nothing bad is in here at all", "l"), (8, None, "m"),
]
CLASHES = "doc_id long, text string, n_chars long, mark string, _key string, _digest string, _spans string, _score string, row long, node long, grp long, piece long, label int"


@pytest.fixture(scope="module")
def odd_rows(spark):
    return spark.createDataFrame([(i, t, len(t or ""), m, "k", "d", "s", "x", 1, 2, 3, 4, 0) for i, t, m in ROWS], CLASHES)


def test_stages_on_odd_rows_and_clashing_columns(spark, odd_rows):
    """Nulls, empty and long texts, shared ids and columns with the operators' own names: against what the docstring says."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    schema = odd_rows.schema
    docs = odd_rows.unionByName(spark.createDataFrame([(7, f"so {item} it goes", 9, "n", "k", "d", "s", "x", 1, 2, 3, 4, 0)], schema))
    marks = lambda df: sorted(r.mark for r in df.collect())
    everything = marks(docs)
    stages = dict(corpus_pipeline.STAGES)
    after = {name: stages[name](spark, docs, SF) for name in ("toxicity", "near_copies", "decontamination", "secrets")}
    assert all(df.columns == docs.columns for df in after.values())
    assert marks(after["toxicity"]) == [m for m in everything if m != "k"]
    assert marks(after["near_copies"]) == [m for m in everything if m != "g"]
    assert marks(after["decontamination"]) == [m for m in everything if m != "n"]
    texts = {m: t for _, t, m in ROWS}
    for r in after["secrets"].where("mark != 'n'").collect():
        wanted = texts[r.mark] and texts[r.mark].replace("token=abcdef", "[SECRET]")
        assert r.text == wanted and r["_digest"] == "d" and r.n_chars == (None if wanted is None else len(wanted))
    assert marks(after["secrets"]) == everything
    packed = stages["packing"](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(everything)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, odd_rows, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd_rows.where("false"), SF).count() == 0


def test_model_beats_word_counts_on_held_out_documents(spark):
    rows = [r for r in queries.op3_lm_scoring(spark, SF).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packing_needs_about_the_least_number_of_sequences(spark):
    rows = queries.op2_best_fit_packing(spark, SF).collect()
    assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
