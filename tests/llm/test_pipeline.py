"""The corpus pipeline against a brute-force version of each stage, on what the stage before kept."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paragraf.llm import decontam, packing, quality, secretscan
from test_operators import brute_jaccard, weighted, window_similarity, words

SMALL = "/root/testdata/sf0.001"


COLUMNS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), schema=docs.schema if k < 4 else None)
        assert k == 4 or docs.columns == columns
        out.append((before, docs.toPandas()))
    return out


def test_run_is_its_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    want = stages[4][1]
    assert sorted(rows.columns) == sorted(want.columns)
    # which of two pieces of a length comes first follows the order of the table
    key = ["doc_id", "piece", "first_token", "n_tokens"]
    assert sorted(map(tuple, rows[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))
    assert sorted(rows.groupby("bin_id").n_tokens.sum()) == sorted(want.groupby("bin_id").n_tokens.sum())


def test_odd_rows_go_through(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, an empty table."""
    prose = "Das ist ein ganz gewöhnlicher Satz, der von nichts Besonderem handelt. Er steht hier nur so da.\n"
    rows = [(None, prose * 2, "de", "x", 1), (1, None, "de", None, None), (2, "", None, "x", 0), (3, prose * 3000, "de", "x", None), (4, prose, "de", "x", 5), (4, prose, "de", "x", 5), (5, "token = \"9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\" steht da. Ein anderer Satz, der sonst nirgends vorkommt.", "de", "x", 5), (-(2**63), "Noch ein Satz für sich, kurz.", None, None, 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("_gone", F.lit(1)).withColumn("_d1", F.lit("x"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (docs, docs.where("false")):
            columns = table.columns
            found = stage(spark, table, SMALL)
            assert k == 4 or found.columns == columns
            count = found.count()
        assert count == 0
        docs = stage(spark, docs, SMALL)
    assert {r.doc_id for r in docs.collect()} <= {3, 4, 5, -(2**63)}


def test_quality_stage(spark, stages):
    before, after = stages[0]
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = before[[bool(words(t)) for t in before.text]]
    good = model.score(quality.text_features(list(rows.text))) >= model.threshold
    assert set(after.doc_id) == set(rows.doc_id[good])
    clean = labels.where("quality = 1").toPandas().doc_id
    assert clean.isin(after.doc_id).mean() > 0.97


def test_near_duplicate_stage(stages):
    before, after = stages[1]
    want = brute_jaccard(list(zip(before.doc_id, before.text)))
    assert set(after.doc_id) == {d for d, (c, _) in want.items() if c == d}


def test_benchmark_stage(spark, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    heads = {i: set(words(t)) for i, t in items}
    # a window that matches holds at least half of an item's distinct words: that spares most of the brute force
    suspects = [(d, t) for d, t in zip(before.doc_id, before.text) if any(len(h & set(words(t))) >= 0.4 * len(h) for h in heads.values())]
    want, lost = {d for d, _ in near_windows(suspects, items)}, set(before.doc_id) - set(after.doc_id)
    assert want == lost


def near_windows(texts, items):
    """brute_contamination(), but for windows that hold too few of an item's trigrams: it looks at the others alone."""
    found = set()
    for d, t in texts:
        ws = words(t)
        for i, item in items:
            iw = words(item)
            n, grams = min(len(iw), len(ws)), weighted(iw)
            hits = np.cumsum([0] + [tuple(ws[k : k + 3]) in grams for k in range(len(ws) - 2)])
            starts = [s for s in range(len(ws) - n + 1) if hits[s + n - 2] - hits[s] >= 0.3 * len(iw)] if n >= 3 else []
            if any(window_similarity(weighted(ws[s : s + n]), grams) >= decontam.THRESHOLD for s in starts):
                found.add((d, i))
    return found


def test_secret_stage(stages):
    before, after = stages[3]
    found = secretscan._found(secretscan.fit(), list(before.text))
    want = {}
    for d, t, spans in zip(before.doc_id, before.text, found):
        for a, b, _, _ in reversed(spans):
            t = t[:a] + "[SECRET]" + t[b:]
        want[d] = t
    assert dict(zip(after.doc_id, after.text)) == want and (after.n_chars == after.text.str.len()).all()


def test_packing_stage(stages):
    before, after = stages[4]
    want = {d: len(re.findall(r"[^ \t\n\r\f]+", t)) + 1 for d, t in zip(before.doc_id, before.text) if t.strip(" \t\n\r\f")}
    assert after.groupby("doc_id").n_tokens.sum().to_dict() == want
    assert after.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY
    assert isinstance(after, pd.DataFrame)
