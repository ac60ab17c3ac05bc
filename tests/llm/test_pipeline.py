"""The pipeline against a brute-force version of its filters, and its stages' columns."""

from collections import Counter

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quadrille.llm import bpe, langid, mixing, quality, simhash
from test_operators import brute_components, brute_print


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    clean = []
    for r in rows:
        measures, text = quality.clean(r["text"])
        if measures[6]:
            clean.append(r | {"text": text, "n_chars": len(text)})
    model = langid.fit(spark.createDataFrame(clean, docs.schema))
    known = [r for r in clean if (p := model.predict(r["text"]))[0] != "und" and p[1] >= langid.MIN_SCORE]
    prints = [(r["doc_id"], brute_print(r["text"])) for r in known]
    unique = [r for r, c in zip(known, brute_components(prints), strict=True) if r["doc_id"] == c]
    mixed = mixing.stage(spark, spark.createDataFrame(unique, docs.schema), sf_dir)
    library = Tokenizer.from_file(bpe.local_path(bpe.TOKENIZER))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in mixed.collect())
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "mixing", "BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.dtypes == docs.dtypes
    assert simhash.stage(spark, docs, sf_dir).count() <= docs.count()


def test_rows_without_or_with_shared_ids_stay(spark):
    """One row of each class is kept and mixed, whatever the ids."""
    texts = ["the old mill by the river grinds corn for seven villages", "a quick survey of harbour cranes and their many drivers", "seventeen violins played slowly while rain fell outside"]
    rows = [(None, texts[0]), (None, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[2]), (6, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.stage(spark, docs, "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(None, texts[0]): 1, (5, texts[1]): 1, (5, texts[2]): 1})
    # the only source takes all its words once: each row once, equal rows too
    assert Counter(mixing.stage(spark, docs, "").collect()) == Counter(docs.collect())


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null texts, copies, a long text and clashing column names go through every stage."""
    body = "the harbour keeps seven cranes and nine drivers who know them well. a quick survey of the old mill found no fault at all.\n"
    other = "seventeen violins played slowly while rain fell outside the hall. nobody left before the last note was gone.\n"
    rows = [
        (None, body + "one more line ends it here.", "en", "a", 1), (5, other, "en", None, 2), (5, body, "en", "a", 3), (5, body, "en", "a", 3),
        (6, None, None, "a", 4), (7, "", "en", "b", 5), (8, (body + other) * 1, "en", "b", 6), (9, "x" * 5000, "en", "b", 7), (10, " ".join(f"w{i}" for i in range(9000)) + ".", "en", "b", 8),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    table = spark.createDataFrame(rows, names)
    for extra in ("fp", "shard", "taken", "__copy", "start", "size", "first"):
        table = table.withColumn(extra, F.lit(1))
    folder = str(tmp_path)
    table.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    at = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [at.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, folder)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == at.columns
        out.write.parquet(f"{folder}/{name.replace(' ', '-')}")
        at = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
        counts.append(at.count())
    assert counts[0] == 9 and counts[1] >= counts[2] >= counts[3] >= 1
    assert at.where("doc_id is null or doc_id = 5").count() >= 1
    table.where("false").write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
