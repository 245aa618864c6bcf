"""The registered queries on small tables: whole results with the columns that their contracts name."""

import hashlib
import os
import zlib

import pytest

from tramline.llm import queries as Q
from tramline.llm import webp as W

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_quality_pu": "doc_id held_out score predicted",
    "op5_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op6_rendezvous": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_jaccard_join": "doc_id class_id n_links",
    "op8_pseudonyms": "doc_id text n_found",
    "op9_divergence": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op10_curriculum": "doc_id size source_size target taken",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_minhash_dedup": "doc_id n_shingles component_id kept",
}


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries()) and set(COLUMNS) | {"op11_prefix_trie"} == set(Q.QUERIES)


def test_nodes_of_the_trie(spark):
    df = Q.op11_prefix_trie(spark, FOLDER)
    assert df.columns == "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert len({(r.conv_id, r.depth) for r in df.collect()}) == df.count()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = Q.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = [r.doc_id for r in df.collect()]
    assert set(got) == ids and (name == "op5_packing" or len(got) == len(ids))


def test_media_are_read_back(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in Q.op2_webp(spark, FOLDER).collect():
        p = W.payload_of(texts[r.doc_id])
        file = W.stored(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_media_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ä" * 1000), (3, "ä" * 1000)], "doc_id long, text string")
    rows = W.with_pixels(W.with_media(df)).collect()
    assert [r.pixels.pixels.rstrip(b"\0").decode() for r in rows] == ["", "", "ä" * 1000, "ä" * 1000]
    assert rows[0].media == rows[1].media and rows[2].media == rows[3].media
    bad = spark.createDataFrame([(None,), (b"no image",)], "media binary")
    assert [r.pixels.pixels for r in W.with_pixels(bad).collect()] == [None, None]
    with pytest.raises(ValueError):
        W.with_media(df.withColumnRenamed("doc_id", "media"))


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle", "op13_minhash_dedup"])
def test_against_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    out = con.execute(Q.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    got = Q.QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, out.fetchall()))
