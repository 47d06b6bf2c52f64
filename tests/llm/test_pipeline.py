"""Each stage of the pipeline against brute force on its own input."""

import hashlib

import corpus_pipeline
from pixelquarry.llm.tables import new_folder
from test_operators import SF, brute_groups, brute_leaks, brute_windows, words_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = new_folder(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept.append((name, before, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    _, before, after = kept[1]
    groups = brute_groups(texts(before).items(), 5)
    assert set(texts(after)) == {i for i, (_, root) in groups.items() if i == root}

    _, before, after = kept[2]
    new = texts(after)
    want = {i: digest for i, _, _, _, digest in brute_windows(texts(before).items(), words_of, 13, b" ".join)}
    assert {i: hashlib.sha256(b" ".join(words_of(t))).hexdigest() for i, t in new.items()} == want

    _, before, after = kept[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts(after)) == set(texts(before)) - {i for i, _ in brute_leaks(texts(before).items(), items)}

    _, before, after = kept[4]
    want = texts(before)
    for r in after.collect():
        assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
    assert after.count() == before.count()


def test_the_classifier_stage_keeps_good_and_drops_bad_documents(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest table has too few bad labelled rows to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stays = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = ([i for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum(i in stays for i in good) >= 0.97 * len(good)
    assert sum(i not in stays for i in bad) >= 0.6 * len(bad)


def test_run_is_the_stages_one_after_the_other(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


def test_stages_take_odd_rows_and_any_column_names(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 1.0, "x", 1, 2), (2, text, 2.0, None, 1, 2), (3, None, None, "y", 1, 2), (4, "", None, "y", 1, 2), (None, text, 0.5, "z", 1, 2), (6, "a b " * 4000, 0.1, "q", 1, 2), (1, text, 1.0, "w", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, `a.b` string, _goes int, _hit int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["a.b"]) for r in kept) == [(0, "z"), (1, "w"), (3, "y"), (4, "y"), (6, "q")]
    cut = {(r["doc_id"], r["a.b"]): r["text"] for r in corpus_pipeline.substrings(spark, docs, SF).collect()}
    assert cut[2, None] == "" and cut[1, "x"] == text and cut[None, "z"] == text and cut[3, "y"] is None
    assert corpus_pipeline.tokens(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.tokens(spark, docs.limit(0), SF).count() == 0
