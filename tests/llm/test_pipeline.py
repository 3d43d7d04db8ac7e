import hashlib
import random
import re

import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_fingerprint


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["ta", "ri", "mo", "nel", "ush"], k=rng.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(40, 120))) + "."
    rows = [(i, prose(), "en", f"s{i % 4}", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(10)]
    rows += [(200, None, "en", "s1", 0), (201, "too short", "en", "s1", 0), (202, "spam " * 60, "en", "s1", 0), (203, "a# b# c$ d% " * 20, "en", None, 0), (None, prose(), None, None, None), (5, rows[5][1], "en", "s1", 0)]
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    clean = corpus_pipeline.quality_stage(spark, spark.read.parquet(path), "")
    texts = [r.text for r in clean.collect()]
    assert sorted(texts) == sorted(r[1] for r in corpus() if r[0] not in (200, 201, 202, 203))
    clean.write.parquet(str(tmp_path / "clean"))
    kept = corpus_pipeline.dedup_stage(spark, spark.read.parquet(str(tmp_path / "clean")), "")
    groups = brute_components([(i, brute_fingerprint(t)) for i, t in enumerate(texts)])
    assert kept.count() == len(set(groups.values()))
    assert {r.doc_id for r in kept.collect()} == {None, *range(80)}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and set(out[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    mixed = corpus_pipeline.mixing_stage(spark, kept, "").collect()
    assert sorted(r.decoded_sha256 for r in out) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed)
    size = lambda rows: sum(len(re.findall(r"\S+", r.text)) for r in rows)
    assert abs(size(mixed) - size(kept.collect())) < 0.05 * size(mixed)
    extra = docs.selectExpr("*", "1 as size", "2 as _row", "'x' as component_id", "0L as _uid", "3 as n_words")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (len(texts), None, None), strict=True):
        got = stage(spark, extra, "")
        assert got.columns == corpus_pipeline.COLUMNS and got.count() > 0 and want in (None, got.count())
    assert corpus_pipeline.bpe_stage(spark, extra, "").count() == docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        empty = stage(spark, empty, "")
        assert empty.columns == corpus_pipeline.COLUMNS and empty.count() == 0
    assert corpus_pipeline.bpe_stage(spark, empty, "").count() == 0
