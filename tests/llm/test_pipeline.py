"""The pipeline: every stage against what its operator says, the columns between them, edge rows."""

import corpus_pipeline as pipeline
from foldwright.llm import decontaminate, language, neardup, pii
from foldwright.llm.common import store

from llm_cases import SF, needs_data

import __spark_entry__ as entry


def test_registration():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and len(pipeline.STAGES) == 5


@needs_data
def test_stages(spark, documents):
    docs, states = documents, [documents]
    for _, stage in pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, SF), "test")
        assert sorted(docs.columns) == sorted(documents.columns)
        states.append(docs)
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in states]
    rejected = {r["doc_id"] for r in language.identify(states[0], language.fit(states[0])).collect()
                if r["lang_pred"] == "und" or (r["bits"] > pipeline.MOST_BITS)}
    assert ids[0] - ids[1] <= rejected
    assert ids[2] == {r["class_id"] for r in neardup.near_duplicates(states[1]).collect()}
    found = {r["doc_id"] for r in decontaminate.contaminated(states[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - found
    want = {r["doc_id"]: r["text"] for r in pii.pseudonymize(states[3], pipeline.PII_KEY).collect()}
    got = {r["doc_id"]: r for r in states[4].collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    pieces = pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.collect()} == ids[4]


def test_edges(spark, no_docs, edges):
    """Nulls, empty and long texts, copies, and columns with names that operators use themselves; an empty table."""
    docs = edges.selectExpr("*", "'s' AS source", "length(text) AS n_chars")
    kept = [
        {1, 2, 5, 8, 9, 10, None},  # without any learned language: those with letters
        {1, 5, 8, 9, 10},  # 1 stands for its copies, the null id among them
        {1, 5, 8, 9, 10}, {1, 5, 8, 9, 10}, {1, 5, 8, 9, 10}]
    state = docs
    for (_, stage), ids in zip(pipeline.STAGES, kept):
        state = store(stage(spark, state, SF), "test")
        assert {r["doc_id"] for r in state.select("doc_id").collect()} == ids
        if stage is not pipeline.STAGES[-1][1]:
            assert sorted(state.columns) == sorted(docs.columns)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id in (1, 5, 8, 9)").collect()} | {10: "another text with id ten"}
    pieces = sorted(map(tuple, state.select("doc_id", "piece", "start", "length").collect()))
    tokens = {k: sum(length for d, _, _, length in pieces if d == k) for k in texts}
    assert tokens[5] > 1024 > tokens[1] > tokens[8] > 1 and all(length <= 1024 for *_, length in pieces)
    for k in texts:
        mine = [p for p in pieces if p[0] == k]
        assert [p[1] for p in mine] == list(range(len(mine))) and all(p[2] == sum(q[3] for q in mine[:p[1]]) for p in mine)
    state = no_docs
    for _, stage in pipeline.STAGES:
        state = store(stage(spark, state, SF), "test")
        assert state.count() == 0
