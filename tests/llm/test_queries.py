"""Every opN_ query, as the driver calls it, and its SQL."""

import pytest

from quillspark.llm.oracle import ORACLE
from quillspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op7_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_sentencepiece_viterbi": "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean",
    "op10_token_shards": "slot bigint, shard bigint, position bigint, sequence bigint, n_tokens bigint, ids_crc32 bigint, slot_is_keyed boolean",
}
PROBE = "user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types[c] for c in types if f"{c} " in TYPES[name]} == dict(x.split() for x in TYPES[name].split(", "))
    got = df.toPandas()
    table = {"op2_chat_formatting": "conversations", "op6_html_extraction": "pages"}.get(name, "documents")
    con = duckdb.connect()
    for t in {table, "labels", "documents", "conversations"}:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    if name not in ("op1_best_fit_packing", "op2_chat_formatting", "op10_token_shards"):
        assert len(got) == con.execute(f"select count(*) from {table}").fetchone()[0]
    if name == "op2_chat_formatting":
        import hashlib

        assert got[got.conv_id == -1].turns_sha256.tolist() == [hashlib.sha256(PROBE.encode()).hexdigest()]
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
        assert rows[0] == rows[1]
