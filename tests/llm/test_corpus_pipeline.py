"""Every stage of the pipeline against a brute-force version on what the stage before kept."""

import public_tokenizers

import corpus_pipeline
from causeway.llm import toxicity
from test_decontaminate import brute as brute_hits
from test_dedup import bare, brute_links, check_packing, classes


def keys(rows):
    return sorted(r.doc_id for r in rows)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs.collect()
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        if name == "toxicity":
            want = [r for r, s in zip(kept, model.scores([r.text for r in kept])) if s < 0.5]
        elif name == "exact_dedup":
            best = {}
            for r in kept:
                best.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id))
            chosen = {min(g)[1] for g in best.values()}
            want = [r for r in kept if r.doc_id in chosen]
        elif name == "ngram_join":
            groups = classes([r.doc_id for r in kept], brute_links([r.text for r in kept]))
            of = dict(zip((r.doc_id for r in kept), groups))
            assert sorted(of[r.doc_id] for r in rows) == sorted(set(groups))  # one of each class
            want = rows
        elif name == "decontamination":
            want = [r for r in kept if not brute_hits(r.text, items)[-1]]
        else:
            check_packing(rows, [(r.doc_id, r.text) for r in kept], public_tokenizers.path("word_bpe_49k.json"))
            break
        assert docs.columns == columns and keys(rows) == keys(want)
        assert {tuple(r) for r in rows} <= {tuple(r) for r in kept}
        kept = rows
    result = corpus_pipeline.run(spark, sf)
    assert sum(r.length for r in result.select("length").collect()) == sum(r.length for r in rows)
