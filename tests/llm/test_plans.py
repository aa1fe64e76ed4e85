"""Plans of the native operators and of scans."""

import pytest

from quillstone.llm import audio, langid, pareto, pii, queries, simhash, url_tree

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_pareto_mix", "op5_boosted_pii", "op8_url_tree"])
def test_native_queries_run_no_python(spark, name, monkeypatch):
    seen = []
    for module in (pareto, pii, url_tree):
        write = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, n, write=write: (seen.append(plan(df)), write(df, n))[1])
    seen.append(plan(getattr(queries, name)(spark, SF)))
    assert len(seen) > 1
    assert not any(word in p for p in seen for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_scans_read_only_what_they_need(spark, monkeypatch):
    seen = []
    write = url_tree.materialize
    monkeypatch.setattr(url_tree, "materialize", lambda df, n: (seen.append(plan(df)), write(df, n))[1])
    queries.op8_url_tree(spark, SF)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in seen[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (audio.text_media(docs), simhash.fingerprints(docs)):
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(df)


def test_probes_are_merged(spark):
    """The exploded side looks small to the planner and must not be broadcast."""
    prints = spark.createDataFrame([(i * 7919, 1) for i in range(50)], "fp long, n long")
    text = simhash.links(prints)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in text


def test_model_size_is_fixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, table = langid.fit(docs)
    assert langs == sorted(langs) and table.shape == (len(langs), langid.BINS)
