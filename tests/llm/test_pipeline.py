"""The pipeline's stages, each against plain loops over its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tablehealth.llm import packing
from tests.llm.test_lines import brute_counts
from tests.llm.test_packing import check
from tests.llm.test_pii import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_one_after_another(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "near dedup", "personal data", "packing"
    ]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs.collect())
        function(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
    first, good, lined, single, masked = inputs
    ids = {r.doc_id for r in good}
    assert all(r.doc_id not in ids for r in first if brute_counts(r.text)[5])
    assert {r.doc_id for r in lined} == ids
    text = {r.doc_id: r.text for r in good}
    for r in lined:
        gone = text[r.doc_id].split("\n")
        assert all(line in gone for line in r.text.split("\n") if line) and r.n_chars == len(r.text)
    groups = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in lined])
    assert {r.doc_id for r in single} == {c for _, c in groups}
    assert {r.doc_id for r in masked} == {r.doc_id for r in single}
    for r in masked:
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
    placed = docs.collect()
    used = check([(r.length, r.sequence_id, r.offset) for r in placed], 2048)
    assert {r.doc_id for r in placed} == {r.doc_id for r in masked}
    assert used <= -(-sum(r.length for r in placed) // 2048) + 2
    assert sum(r.length for r in placed) == sum(
        len(b) // 4 + 1 for b in packing.encoder(packing.public_tokenizers.path(packing.VOCABULARY)).many([r.text for r in masked])
    )


def test_odd_rows_go_through_all_stages(spark, sf_dir):
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (None, " ".join(f"w{i}" for i in range(80)), None, "s", None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for one in (docs, docs.where(F.lit(False))):
        for _, function in corpus_pipeline.STAGES:
            one = function(spark, one, sf_dir)
        one.collect()


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    df = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert df.count() > 0 and df.columns[0] == "doc_id"
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
