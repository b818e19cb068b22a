from __future__ import annotations

import random
import re

import brute
import pytest

from edupulse.llm import token_store
from edupulse.llm.tokens import BYTE_BPE, WORD_BPE, PieceEncoder
from rows import messy_rows

ODD = ["a", "the", " ", "  ", "\n", "\n\n", ".", ",", "!", "'s", "'", "é", "é", "́", "★", "\t", " \n", "\r\n", "\xa0", "\x85", "7", "42", "Ġ", "\x1c", "<|endoftext|>",
       "日本", "\x00", "\x01", "İ", "ß", "ﬁ", "Σ", "ΑΣ", "Ⅷ", "𝔘", "\ua7cb", "\ua7da", "\U00010d52", "\U00016ea2"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
@pytest.mark.parametrize("memory", [20, 100_000])
def test_ids_are_those_of_the_whole_text(name, memory):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(1500)]
    own, mine = brute.tokenizer(name), PieceEncoder(name, memory)
    got = [x for at in range(0, len(texts), 100) for x in mine.encode(texts[at: at + 100])]
    assert got == [brute.ids(own, t)[:-1].tobytes() for t in texts]


def test_store(spark, messy, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(messy, path)
    own = brute.tokenizer("byte_bpe_50k.json")
    want = sorted((i is not None, i or 0, len(ids := brute.ids(own, t)), brute.crc(ids)) for i, t in messy_rows())
    got = token_store.checksums(token_store.read_store(spark, path)).orderBy("start").collect()
    # Ascending ids, gapless starts, nulls first.
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    # Some documents, by pushed-down filter.
    few = token_store.read_store(spark, path, doc_ids=[7, 101])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        assert re.search(r"PushedFilters: [^\n]*In\(doc_id, \[(7,101|101,7)\]\)", few._jdf.queryExecution().toString())
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    whole = {(r["doc_id"], r["start"]) for r in got if r["doc_id"] in (7, 101)}
    assert {(r["doc_id"], r["start"]) for r in few.collect()} == whole and whole
    assert token_store.read_store(spark, path, columns=["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens"]


def test_bloom_filters_and_row_indexes_are_written(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(spark.range(3000).selectExpr("id as doc_id", "concat('w', id) as text").coalesce(1), path)
    file = next(r.path for r in spark.read.format("binaryFile").load(f"{path}/data/*.orc").select("path").collect())
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    kinds = set()
    for stripe in range(reader.getStripes().size()):
        footer = reader.rows().readStripeFooter(reader.getStripes().get(stripe))
        kinds |= {footer.getStreams(k).getKind().toString() for k in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and reader.getRowIndexStride() == token_store.ROW_INDEX


def test_nothing(spark, nothing, tmp_path):
    token_store.write_store(nothing, str(tmp_path / "store"))
    assert token_store.checksums(token_store.read_store(spark, str(tmp_path / "store"))).count() == 0
