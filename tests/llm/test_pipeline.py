"""The pipeline on a small table, stage by stage, against what each operator says."""

import corpus_pipeline as pipeline
import pytest

from .conftest import BASE, WORDS


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import random

    rand = random.Random(9)
    words = [f"{a}{b}" for a in ("ab", "cor", "de", "fi", "lu", "mo") for b in ("na", "ter", "so", "ving", "le", "ra", "tis")]
    text = lambda n: " ".join(rand.choice(words) + ("." if rand.random() < 0.1 else "") for _ in range(n))
    good = [(i, text(90)) for i in range(60)]
    junk = [(100 + i, " ".join(w + rand.choice(["###", "$$$", "%%%"]) for w in text(90).split())) for i in range(40)]
    item = " ".join(f"item{j}" for j in range(25))
    more = [(200, good[0][1]), (201, good[1][1] + " tail"), (202, text(40) + " " + item + " " + text(40)), (203, text(60) + " write to jo@example.com now " + text(9)), (204, None), (205, ""), (206, BASE), (207, " ".join(WORDS * 9))]
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in [*good, *junk, *more]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = pipeline.written(out, "t-" + name)
        kept.append({r.doc_id: r for r in docs.collect()})
    good = set(range(60))
    assert set(kept[0]) == good | {200, 201, 202, 203}
    assert set(kept[1]) == good | {202, 203}
    assert set(kept[2]) == set(kept[3]) == good | {203}
    assert "<EMAIL>" in kept[3][203].text and kept[3][203].n_chars == len(kept[3][203].text)
    assert kept[3][5].text == kept[0][5].text
    packed = pipeline.run(spark, sf).toPandas()
    assert set(packed["doc_id"]) == set(kept[3])
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_columns_that_clash_and_rows_that_repeat(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 100 or doc_id in (202, 204, 205)")
    extra = docs.selectExpr("*", "'mine' as kept", "7 as n_words", "1 as quality_score", "2 as leaks", "3 as _leaks", "4 as component_id", "5 as _m", "6 as _id")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns, name
        assert {(r.kept, r.n_words, r.leaks, r.component_id, r._id) for r in out.collect()} == {("mine", 7, 2, 4, 6)}, name
    good = docs.where("doc_id < 3")
    twice = good.union(good).union(good.selectExpr("null as doc_id", "text", "lang", "source", "n_chars")).union(good.selectExpr("1 as doc_id", "concat(text, ' x', text) as text", "lang", "source", "n_chars"))
    out = sorted((r.doc_id, len(r.text)) for r in pipeline.near_dedup(spark, twice, sf).collect())
    assert [d for d, _ in out] == [0, 1, 1]  # three groups; the third one's least doc_id is that of its doubled text


def test_empty_table(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
