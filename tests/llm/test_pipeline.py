"""The pipeline against its stages by hand."""

import duckdb
import pytest

import corpus_pipeline
from quillmend.llm import exact_dedup, quality, queries, simhash, toxicity


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").collect()}


def test_stages(spark, sf_dir, kept):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert all(k.columns == kept[0].columns for k in kept)
    toxic = {r["doc_id"] for r in toxicity.scores(kept[0], toxicity.fit(kept[0], labels)).filter("predicted = 1").collect()}
    assert ids(kept[1]) == ids(kept[0]) - toxic
    good = {r["doc_id"] for r in quality.scores(kept[1], quality.fit(kept[1], labels)).filter("predicted = 1").collect()}
    assert ids(kept[2]) == good
    texts = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    best = {}
    for i, t in texts.items():
        best[t] = max(i, best.get(t, -1))
    assert ids(kept[3]) == set(best.values())


def test_near_stage_decides_at_the_similarity(kept):
    """Brute force at 0.8 on both sides: who goes has such a neighbour, and of who stays no two are so similar."""
    sets = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in kept[3].collect()}
    left = ids(kept[4])
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0} for i in sets}
    assert all(near[i] for i in sets.keys() - left) and not any(near[i] & left for i in left)


def test_run_packs_what_is_left(spark, sf_dir, kept):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == ids(kept[4])
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert sum(r["length"] for r in rows) == sum(tokens.values())


def test_exact_dedup_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op2_exact_dedup"]).fetchall())
    got = exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want
