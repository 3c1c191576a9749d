import struct

import corpus_pipeline
from rosterlink.llm import quality
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_suffix_dedup import brute as repeat_brute


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in at.collect()}
        at = stage(spark, at, sf_dir)
        rows = at.collect()
        if name != "packing":
            assert at.columns == columns
            after = {r.doc_id: r.asDict() for r in rows}
            assert len(after) == len(rows)
        if name == "quality":
            assert all(after[k] == before[k] for k in after) and {k for k, v in labels.items() if v} <= set(after)
            bad = {k for k, v in labels.items() if not v}
            assert len(bad & set(after)) <= len(bad) / 5
        elif name == "near_duplicates":
            roots = near_brute([(k, v["text"]) for k, v in before.items()], 5, 80)
            assert after == {k: v for k, v in before.items() if roots[k][1] == k}
        elif name == "repeats":
            cut = repeat_brute([(k, v["text"]) for k, v in before.items()], 100)
            for k, v in after.items():
                assert v == before[k] | {"text": v["text"], "n_chars": len(v["text"])}
                assert v["text"].encode() == cut[k][1] or len(v["text"].encode()) - len(cut[k][1]) <= 3 * 2 * len(cut[k][0])
        else:
            assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
            assert {r.doc_id for r in rows} == set(before)
            assert all(len(struct.unpack(f"<{r.length}I", r.ids)) == r.length for r in rows)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y", 1, 2), (2, "a b c d e f", "x", "y", 1, 2), (None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, rid int")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"] and kept.columns == docs.columns
    assert corpus_pipeline.without_repeats(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.without_repeats(spark, docs.limit(0), "").count() == 0
    assert quality.THRESHOLD == 0.3


def test_quality_stage_with_odd_rows(spark, tmp_path):
    """Clashing columns, repeated rows, null ids and texts, a long text, an empty table."""
    good, bad = "This is a plain sentence of some words, and another one follows it.", "$$$ | #### || 99 %% !! ~~~ | 0 0 0"
    rows = [(i, good if i % 2 else bad) for i in range(40)] + [(41, good), (41, good), (None, good), (None, None), (42, ""), (43, (good + "\n") * 3000)]
    docs = spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1.5 as score", "'r' as row", "0 as quality", "7 as rid")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} >= {41, 43, *range(1, 40, 2)} and not {r.doc_id for r in rows} & set(range(0, 40, 2))
    assert sum(r.doc_id == 41 for r in rows) == 2 and all(r.score == 1.5 and r.row == "r" and r.rid == 7 for r in rows)
    assert corpus_pipeline.good_quality(spark, docs.limit(0), str(tmp_path)).count() == 0
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in pieces if r.doc_id == 41) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 41)
    assert corpus_pipeline.packed(spark, docs.limit(0), str(tmp_path)).count() == 0
