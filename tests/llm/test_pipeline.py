"""The pipeline's stages on odd, empty and clashing tables, and the whole run against a brute-force version."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_training_data import DOCS, ODD, _brute_hits, _components, _fingerprint, _targets, words

import corpus_pipeline
from tracewell.llm import quality_classifier, sharding

CLASH = [
    "size", "quality", "source_size", "target", "times", "hit_spans", "hit_items", "score", "words", "text_crc32", "k", "d", "k1", "k2", "fp", "node", "root", "key", "h", "m", "y", "item", "component_id",
    "row_key", "label", "part", "budget", "code", "a.b",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (9, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "eta THETA, iota"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(ODD, DOCS).write.parquet(f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_empty_and_clashing_tables(spark, folder, stage):
    docs = spark.createDataFrame(ODD, DOCS)
    last = stage is corpus_pipeline.sharding
    plain = stage(spark, docs, folder)
    assert plain.columns == docs.columns + (["row_number", "shard", "slot"] if last else [])
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    got = stage(spark, wide, folder)
    assert got.columns[: len(wide.columns)] == wide.columns
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    ids = lambda rows: sorted((str(r.doc_id), str(r.text)[:60], str(r.source)) for r in rows)
    if stage is not corpus_pipeline.near_duplicates:  # which of two equal documents stays may depend on all columns
        assert ids(rows) == ids(plain.collect())
    assert len(rows) == plain.count()
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == plain.columns and empty.count() == 0


def test_run_on_odd_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name, kind in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("documents", DOCS)):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _brute_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.learn_quality(docs, labels.filter(F.col("doc_id").isin([r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5])))
    rows = docs.collect()
    x = np.array([quality_classifier.statistics(None if r.text is None else r.text.encode()) for r in rows])
    rows = [r for r, s in zip(rows, model.score(x), strict=True) if s >= 0.3]
    by = collections.defaultdict(list)
    fps = [_fingerprint(r.text) for r in rows]
    classes = _components([(r.doc_id, f) for r, f in zip(rows, fps, strict=True)])
    for r, f in zip(rows, fps, strict=True):
        by[classes[f]].append(r)
    rows = [min(v, key=lambda r: r.doc_id) for v in by.values()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {t for t, n, _ in _brute_hits([r.text for r in rows], items) if n}
    rows = [r for r in rows if r.text not in dirty]
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    targets, mixed = _targets(sizes), []
    for source, size in sizes.items():
        drawn = []
        for r in rows:
            if r.source != source:
                continue
            ws, text = words(r.text), r.text or ""
            plain = len(re.sub(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", "", text)) / len(text) if text else 0
            q = max(0.02, plain**6 * min(1, 1.25 * len(set(ws)) / len(ws)) ** 2) if ws else 0.02
            digest = hashlib.md5(f"0|{r.doc_id}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()
            drawn.append((-math.log((int(digest[:13], 16) + 0.5) / 2**52) / q, digest, r))
        epochs, upto = int(targets[source] // max(1, size)), 0
        for _, _, r in sorted(drawn, key=lambda x: x[:2]):
            n = len(words(r.text))
            upto += n
            mixed += [r] * (epochs + (2 * upto - n <= 2 * (targets[source] - epochs * size)))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    mixed.sort(key=lambda r: md5("".join("-" if v is None else md5(str(v)) for v in r)))
    return [(*r, i, *sharding.locate(i, len(mixed), corpus_pipeline.SHARDS)) for i, r in enumerate(mixed)]


def test_run_matches_brute_force(spark, sf):
    got = sorted(((*r,) for r in corpus_pipeline.run(spark, sf).collect()), key=lambda r: r[-3])
    assert got == _brute_run(spark, sf) and len(got) > 50
