import re

import corpus_pipeline
from millrace.llm import decontaminate, langid, ngram_join, secrets
from millrace.llm.pieces import decode


def test_stages(spark, docs, sf_dir, tmp_path):
    """Each stage against a plain account of what it should keep of its own input."""
    columns = docs.columns
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [r.asDict() for r in at.collect()]
        out = stage(spark, at, sf_dir)
        got = [r.asDict() for r in out.collect()]
        ids = [r["doc_id"] for r in got]
        if name == "language_id":
            ok = {r["doc_id"] for r in langid.identify(at).collect() if r["lang_pred"] != "und" and r["score"] >= langid.REJECT_BELOW}
            assert sorted(ids) == sorted(ok) and len(ids) >= 0.95 * len(rows)
        elif name == "near_duplicates":
            first = {r["component_id"] for r in ngram_join.ngram_jaccard_join(at).collect()}
            assert sorted(ids) == sorted(first)
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contaminated(at, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert sorted(ids) == sorted({r["doc_id"] for r in rows} - bad)
        elif name == "secret_scan":
            before = {r["doc_id"]: r["text"] for r in rows}
            assert all(r["text"] == secrets.redact(before[r["doc_id"]]) and not re.search(r"[0-9a-f]{32}", r["text"]) and r["n_chars"] == len(r["text"]) for r in got)
        else:
            before = {r["doc_id"]: r["text"] for r in rows}
            assert all(decode(r["ids"]) == before[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in got)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            at = spark.read.parquet(str(tmp_path / name))


def test_odd_rows(spark, odd, empty, sf_dir):
    for df in (odd, empty):
        df = df.select("doc_id", "text", "lang", "source", "n_chars", "label")
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf_dir).count() <= df.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 50
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "encoding"]
