import numpy as np
import public_tokenizers
from brute import near as brute_near
from brute import quality as brute_quality
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, quality, secrets


def test_stages_against_plain_python(spark, folder, tmp_path, texts):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    rules = quality.learn_from(docs, labels)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        assert k == 4 or docs.columns == columns
    good, single, clean, mixed, packed = kept

    base = {i for i, t in texts.items() if (s := brute_quality(t))[0] < 50 or 100 * s[4] > 50 * s[0]}
    rows = quality.stats(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    x = quality.features({c: rows[c].to_numpy() for c in quality.STATS})
    rejected = np.zeros(len(rows), bool)
    for r in rules:
        rejected |= quality.covers(r, x)
    assert {r.doc_id for r in good} == set(texts) - base - set(rows["doc_id"][rejected].tolist())

    label = brute_near({r.doc_id: r.text for r in good})
    assert sorted(r.doc_id for r in single) == sorted(i for i, (_, c) in label.items() if c == i)
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: secrets.masked(r.text) for r in single} and any(a.text != b.text for a, b in zip(sorted(single), sorted(clean), strict=True))

    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(clean, docs.sparkSession.read.parquet(str(tmp_path / "secret_scan")).schema)).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in copies.items() for _ in range(n))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text, add_special_tokens=False).ids + [2] for r in mixed}
    once = {}
    for r in packed:
        once.setdefault((r.doc_id, r.piece), []).append(r)
    assert all(len(v) == copies[i] for (i, _), v in once.items())
    seq = {}
    for r in packed:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seq.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 1024
    assert sum(r.length for r in packed) == sum(len(ids[r.doc_id]) for r in mixed)


def test_run_and_empty_input(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
