"""The pipeline against a brute-force version of its stages."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_mended import jaccard
from test_operators import DOCS, check_packing, dedup_twin, prose, stats_twin

import corpus_pipeline
from scanspark.llm.token_counts import tokenizer


@pytest.fixture
def folder(spark, tmp_path):
    shared = prose(12, 900)
    item = prose(30, 901)
    docs = [(i, "\n".join([prose(60, i), shared if i % 3 == 0 else "own line", prose(30, 100 + i)]), "en", f"s{i % 2}", 0) for i in range(40)]
    docs += [(100 + i, docs[i][1], "en", "s", 0) for i in range(5)] + [(200, docs[7][1] + " more", "en", "s", 0)]
    docs += [(300 + i, f"{prose(80, 300 + i)} {item} {prose(20, 400 + i)}", "en", "s", 0) for i in range(3)]
    docs += [(400 + i, prose(60, 500 + i).replace(" ", "### "), "en", "s", 0) for i in range(30)]
    docs += [(500, "too short", "en", "s", 0), (501, None, "en", "s", 0), (502, "", None, None, None), (503, " ".join([prose(6, 1)] * 9), "en", "s", 0), (504, prose(9000, 2), "en", "s", 0)]
    spark.createDataFrame(docs, DOCS + ", lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 400), 0) for i, *_ in docs if i < 500], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, prose(30, 902))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, item


def expected(docs, item):
    kept = []
    for doc, text, *_ in docs:
        words, _, symbols, _, repeats = stats_twin(text)
        if words >= 10 and 100 * repeats <= 20 * words and not symbols:
            kept.append((doc, text))
    texts = {d: t[0] for d, t in dedup_twin(kept).items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and jaccard(texts[a], texts[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    tok = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for d in {find(d) for d in texts}:
        if item not in texts[d]:
            ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
            for at in range(0, len(ids), 4096):
                part = ids[at : at + 4096]
                out[d, at // 4096] = (at, len(part), zlib.crc32(part.tobytes()))
    return out


def test_pipeline_equals_its_twin(spark, folder):
    path, docs, item = folder
    rows = corpus_pipeline.run(spark, path).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = expected(docs, item)
    assert got == want
    assert check_packing(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
    assert max(collections.Counter(d for d, _ in got).values()) > 1


def test_stages_return_the_columns_of_documents(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_of_nothing(spark, folder, tmp_path):
    path, *_ = folder
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
