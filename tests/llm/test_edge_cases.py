"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe, langid, lattice, mixing, ngram_join, perplexity, quality_nbsvm, secret_scan, sharding, toxicity_fm

LONG = "the quick brown fox jumps over lazy dogs and " * 40_000
SECRET = 'token = "0123456789abcdef0123456789abcdef01234567"'
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard_id int, lang_pred string, tokens int, class long"


def rows() -> list[tuple]:
    texts = ["a plain sentence about markets and prices in the city", None, "", "   \n\t", LONG, "12345 67890 !!!", SECRET, "été à la plage, où l'on dort", "漢字 🙂 mixed text"]
    out = [(i, t, None if i == 3 else ("fr" if i == 7 else "en"), None if i == 2 else f"src{i}", None if t is None else len(t), 0.5, 7, "x", 1, 2) for i, t in enumerate(texts)]
    out += [out[0], (0, "another text under the same id with other words", "en", "src0", 10, 0.5, 7, "x", 1, 2), (None, texts[0], "en", "src1", 1, None, None, None, None, None)]
    out += [(20 + i, texts[0], "en", "src1", 53, 0.0, 0, "y", 0, 0) for i in range(3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    data = [(0, 1, 0), (4, 0, 1), (5, 0, 0), (6, None, None), (None, 1, 1), (20, 1, 0), (21, 0, 1), (21, 1, 1), (7, 1, 1)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def test_quality(docs, labels):
    out = quality_nbsvm.classify(docs, labels).collect()
    assert len(out) == len(rows()) and all(r["keep"] is not None for r in out)
    one_class = quality_nbsvm.classify(docs, labels.where("quality = 1")).collect()
    assert all(r["keep"] for r in one_class)
    assert quality_nbsvm.classify(docs.limit(0), labels).count() == 0


def test_toxicity(docs, labels):
    out = toxicity_fm.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows())
    nothing = toxicity_fm.score_toxicity(docs, labels.limit(0)).collect()
    assert not any(r["toxic"] for r in nothing)
    assert toxicity_fm.score_toxicity(docs.limit(0), labels).count() == 0


def test_ngram_join(docs, spark):
    rows = sorted(tuple(r) for r in ngram_join.ngram_jaccard_join(docs).collect())
    linked = {(i, 0, 3, 3) for i in (0, 20, 21, 22)}
    assert set(rows) == linked | {(i, i if i else 0, 0, 0) for i in range(9)} and len(rows) == 13
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in ids] == [-1, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert ngram_join.keep_one_of_each_group(docs.limit(0)).count() == 0


def test_mixing(docs):
    drawn = mixing.mix(docs).collect()
    assert drawn and all(r["tokens"] > 0 and 0 <= r["epoch"] < mixing.MAX_EPOCHS for r in drawn)
    assert {r["doc_id"] for r in drawn} <= {r[0] for r in rows()} - {1, 2}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(drawn)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_lattice(spark):
    v = [1.0] + [0.0] * 63
    near = [1.0, 0.01] + [0.0] * 62
    data = [(1, v), (2, near), (3, None), (4, []), (5, [0.0] * 64), (6, [float("nan")] * 64), (7, [1.0] * 3), (None, v), (8, v), (8, v), (9, [None] + v[1:]), (10, [-x for x in v])]
    frame = spark.createDataFrame([(i, e, 0, 1, 2) for i, e in data], "vec_id long, embedding array<float>, cell int, kind int, class int")
    found = sorted(tuple(r) for r in lattice.near_duplicates(frame).collect())
    assert found == sorted([(1, 1, 1, 2), (2, 1, 0, 2), (8, 1, 1, 2), *((i, i, 0, 0) for i in (3, 4, 5, 6, 7, 9, 10))])
    named = frame.selectExpr("concat('v', lpad(vec_id, 2, '0')) as vec_id", "embedding")
    assert sorted(r[:2] for r in map(tuple, lattice.near_duplicates(named).collect()))[:2] == [("v01", "v01"), ("v02", "v01")]
    assert lattice.near_duplicates(frame.limit(0)).count() == 0


def test_bpe(docs):
    out = bpe.bpe_encode(docs)
    back = {(r["doc_id"], r["text"]) for r in bpe.bpe_decode(out).collect()}
    assert back == {(r[0], r[1]) for r in rows()}
    assert {(r["doc_id"], r["n_tokens"]) for r in out.where("doc_id in (1, 2)").collect()} == {(1, None), (2, 0)}
    assert bpe.bpe_encode(docs.limit(0)).count() == 0


def test_secrets(docs):
    hits = {(r["doc_id"], r["rule"], r["nth"]) for r in secret_scan.secret_scan(docs).collect()}
    assert hits == {(6, "assigned_secret", 1), (6, "bare_hex_key", 1)}
    clean = secret_scan.redact_secrets(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    changed = {r["doc_id"]: r for r in clean.collect() if (r["doc_id"], r["text"]) not in {(x[0], x[1]) for x in rows()}}
    assert list(changed) == [6] and changed[6]["text"] == "<assigned_secret>" and changed[6]["n_chars"] == 17
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0


def test_language(docs):
    got = langid.identify(docs).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows())
    assert not any(out[i]["accepted"] or out[i]["lang"] for i in (1, 2, 3, 5)) and out[7]["lang"] == "fr" and out[4]["accepted"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in got)
    assert not any(r["accepted"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(docs.limit(0)).count() == 0


def test_sharding(docs):
    out = sharding.shard_records(docs, target_bytes=60)
    got = out.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows())
    assert sharding.shard_records(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_records(docs, column="shard_id")
    with pytest.raises(ValueError):
        sharding.shard_records(docs, column="Shard_ID")


def test_perplexity(docs):
    out = perplexity.perplexity_rules(docs).collect()
    assert len(out) == len(rows())
    assert not any(r["keep"] for r in out if r["doc_id"] in (1, 2))
    assert perplexity.perplexity_rules(docs.limit(0)).count() == 0


def test_stages(docs, spark):
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), "").count() == 0
        now = stage(spark, now, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
    assert now.count() > 0 and set(now.columns) == {"doc_id", "tokens", "n_tokens", "decoded_md5"}


CLASHES = ["_id", "_h", "_own_id", "_nth", "own_id", "Own_Digest", "key_id", "fate", "_leaf_n", "leaf_n", "leaf_lang", "Leaf_Whole", "mix_domain", "MIX_tokens", "identified", "Clean", "Shard2", "class", "h", "u", "v", "n", "m"]


def test_clashing_names_and_string_ids(docs, spark):
    """Helper columns never meet those of the table, in whatever case; ids may be strings."""
    own = [c for c in docs.columns if c.lower() not in {x.lower() for x in CLASHES}]
    wide = docs.select(F.concat(F.lit("id"), F.lpad("doc_id", 3, "0")).alias("doc_id"), *[c for c in own if c != "doc_id"], *[F.lit(f"KEEP{i}").alias(c) for i, c in enumerate(CLASHES)])
    now = wide
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, wide, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == wide.columns
            assert out.count() > 0 and all(r[c] == f"KEEP{k}" for r in out.collect() for k, c in enumerate(CLASHES))
            now = stage(spark, now, "")
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in wide.collect()}
    assert now.count() > 0
    sharded = sharding.shard_records(wide, target_bytes=60)
    assert sharded.columns == [*wide.columns, "shard"] and sharded.count() == len(rows())
    assert {r["doc_id"] for r in secret_scan.secret_scan(wide).collect()} == {"id006"}
    assert ("id020", "id000", 3, 3) in {tuple(r) for r in ngram_join.ngram_jaccard_join(wide).collect()}
    for out in (langid.identify(wide), perplexity.perplexity_rules(wide)):
        assert out.count() == len(rows())


def test_classifiers_take_string_ids(docs, labels):
    key = F.concat(F.lit("id"), F.lpad("doc_id", 3, "0"))
    docs, labels = docs.withColumn("doc_id", key), labels.withColumn("doc_id", key)
    assert quality_nbsvm.classify(docs, labels).count() == toxicity_fm.score_toxicity(docs, labels).count() == len(rows())
