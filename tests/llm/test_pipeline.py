"""Each stage of the pipeline against a plain version, over a small table."""

from collections import defaultdict

import pytest

import corpus_pipeline as pipeline

from .test_dedup import LOW, brute_near, brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name: (rows before, rows after) of each stage, as dicts by id."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        after = pipeline.materialise(stage(spark, docs, SF), "stage")
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == list(stages) and pipeline.ORACLE_SQL is None
    for name, (_, _, before, after) in stages.items():
        assert before == pipeline.COLUMNS and (after == pipeline.COLUMNS or name == "best-fit packing")


def test_quality_keeps_clean_documents(spark, stages):
    before, after, *_ = stages["quality classifier"]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if good.get(r.doc_id) == 1]
    junk = [r.doc_id for r in before if good.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean) and sum(i in kept for i in junk) <= 0.2 * len(junk)


def test_exact(stages):
    before, after, *_ = stages["exact dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[(r.text or "").translate(LOW)].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(max(ids) for ids in groups.values())


def test_near(stages):
    before, after, *_ = stages["near dedup"]
    component = brute_near([(r.doc_id, r.text) for r in before], 5, (4, 5))
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in component.items() if c == i)


def test_repeats(stages):
    import hashlib

    before, after, *_ = stages["suffix-array dedup"]
    want = brute_repeats([r.text.encode() for r in before], 200)
    got = {r.doc_id: r for r in after}
    for r, (n, removed, _, sha) in zip(before, want):
        if r.doc_id not in got:
            assert removed == n
        elif removed == 0:
            assert got[r.doc_id].text == r.text
        else:
            text = got[r.doc_id].text
            assert got[r.doc_id].n_chars == len(text) and n - removed - 6 <= len(text.encode()) <= n - removed
            assert hashlib.sha256(text.encode()).hexdigest() == sha or len(text.encode()) < n - removed


def test_packing(stages):
    before, after, *_ = stages["best-fit packing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    used = defaultdict(int)
    for r in after:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) * 1.02 + 1


def test_odd_rows(spark, odd_docs, empty_docs):
    """Nulls, empty and very long texts, repeated rows and clashing columns, through every stage."""
    columns = ("doc_id", "text", "lang")
    odd = odd_docs.selectExpr(*columns, "cast(null as string) as source", "0 as n_chars", "kept", "n as cut", "1.5 as score")
    for docs in (odd, odd.where("false")):
        n = docs.count()
        for name, stage in pipeline.STAGES[1:]:  # the rows of the first stage go on as they are
            docs = pipeline.materialise(stage(spark, docs, SF), "odd")
            if name == "exact dedup":
                # both rows of id 2 stand for the prose, id 4 for the empty texts, and five texts come once
                assert n == 0 or sorted(r.doc_id for r in docs.collect()) == [2, 2, 4, 5, 6, 7, 8, 9]
        assert (docs.count() > 0) == (n > 0)
    scored = pipeline.quality(spark, odd, SF)
    assert scored.columns == pipeline.COLUMNS and scored.count() <= odd.count()
    assert pipeline.quality(spark, odd.where("false"), SF).count() == 0
