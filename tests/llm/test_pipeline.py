from __future__ import annotations

from collections import Counter

import brute
import corpus_pipeline
import pytest
from rows import as_documents, messy_rows

from edupulse.llm import simhash, surrogates


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = {i: t for i, t in messy_rows() if t}
    rows = messy_rows() + [(300, texts[15][:3000] + " jane.doe@mail7.example.com")]
    as_documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[10].split()[20:60]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_against_plain_versions(spark, folder):
    path, rows = folder
    good = [(i, t) for i, t in rows if not ((s := brute.statistics(t))[0] < 50 or 100 * s[4] > 50 * s[0])]
    parts = brute.near_copies([t for _, t in good])
    first: dict[int, tuple[int, str]] = {}
    for part, (i, t) in zip(parts, good, strict=True):
        key = (brute.LAST if i is None else i, t)
        first[part] = min(first.get(part, key), key, key=lambda x: x[0])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in first.values() if not brute.contamination(t, items)[1]]
    assert 0 < len(clean) < len(first) < len(good) < len(rows)

    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    sizes = []
    for _, function in corpus_pipeline.STAGES[:4]:
        docs = function(spark, docs, path).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == [len(good), len(first), len(clean), len(clean)]
    key, _ = surrogates.checked(surrogates.entities(docs))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert "jane.doe@" not in texts[300] and texts[300][:3000] == dict(rows)[300][:3000]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    own, want = brute.tokenizer("word_bpe_49k.json"), Counter()
    for i, t in texts.items():
        ids = brute.ids(own, t)
        for at in range(0, len(ids), 2048):
            want[i, at, brute.crc(ids[at: at + 2048])] += 1
    packed = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed) == want


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    numbers = [int(q[2:].split("_")[0]) for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert simhash.MAX_BITS == 2
