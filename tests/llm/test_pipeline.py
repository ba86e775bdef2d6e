import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as p
    from wayloom.llm.fertility import fertility_rules
    from wayloom.llm.leaks import leaked_passages
    from wayloom.llm.mixing import pareto_mix
    from wayloom.llm.oddsketch import near_duplicates

    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == p.COLUMNS
        out.write.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    assert ids(kept[1]) == ids(fertility_rules(kept[0]).where("kept"))
    assert ids(kept[2]) == ids(near_duplicates(kept[1]).where("kept"))
    leaks = {r.doc_id for r in leaked_passages(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(kept[3]) == [i for i in ids(kept[2]) if i not in leaks]
    assert ids(kept[4]) == ids(kept[3])
    want = sorted(r.doc_id for r in pareto_mix(kept[4]).collect() for _ in range(r.copies))
    assert ids(docs) == want and len(p.run(spark, SF).columns) == len(p.COLUMNS) + 1
