"""The queries of the first ten operators on a small folder: columns, types, and the columns that the queries derive."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_operators import dedup_twin, prose, stats_twin

from scanspark.llm import queries, simhash, token_counts

COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_class_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_url_verdicts": "page_id host path rule verdict",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    shared = prose(12, 900)
    docs = [(i, "\n".join([prose(40 + i, i), shared if i % 3 else "Own\tline", prose(20, 100 + i)]), "en", "s", 0) for i in range(30)]
    docs += [(40, docs[3][1], "en", "s", 0), (41, None, None, "s", 0), (42, "", "fr", "s", 0), (43, "é " * 700, "fr", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 44)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(20, 77))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://Example.org/es/a?b"), (2, "x"), (3, None), (4, "https://a.example.org/en/1#f")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return str(path), [(d, t) for d, t, *_ in docs]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_filter_audit", "op12_token_alignment", "op13_secret_scan"}))
def test_queries_return_what_their_contracts_name(spark, folder, name):
    path, docs = folder
    got = queries.QUERIES[name](spark, path)
    need = COLUMNS.get(name, "").split()
    assert [c for c in need if c not in got.columns] == [] and len(set(got.columns)) == len(got.columns)
    rows = got.collect()
    if name not in ("op5_packing", "op6_license_scan", "op7_decontamination", "op9_url_verdicts"):
        assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    by = {r[0]: r for r in rows}
    if name == "op1_line_dedup":
        want = dedup_twin(docs)
        assert {d: (r.n_lines, r.n_dropped, r.kept_sha256) for d, r in by.items()} == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (t, n, k) in want.items()}
    elif name == "op2_quality_rules":
        assert {d: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for d, r in by.items()} == {d: tuple(stats_twin(t)) for d, t in docs}
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    elif name == "op3_token_counts":
        tok = token_counts.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
        n = {d: len(tok.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
        assert {d: (r.n_bytes, r.n_tokens, r.over_limit) for d, r in by.items()} == {d: (len((t or "").encode()), n[d], n[d] > 512) for d, t in docs}
    elif name == "op4_simhash":
        assert {d: r.fingerprint for d, r in by.items()} == {d: f"{simhash.fingerprint((t or '').encode()):016x}" for d, t in docs}
        assert by[40].component_id == by[3].component_id <= 3 and by[42].component_id == 41
    elif name == "op5_packing":
        tok = token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
        crc = {d: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in docs}
        assert {r.doc_id: r.ids_crc32 for r in rows} == crc and all(r.piece == r.start == 0 for r in rows)
    elif name == "op8_class_lm":
        assert {d: r.held_out for d, r in by.items()} == {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs}
        assert all(r.n_tokens == len((t or "").encode().split()) + 1 for d, t in docs for r in (by[d],)) and len({r.train_tokens for r in rows}) == 1
    elif name == "op9_url_verdicts":
        assert {p: (r.host, r.path, r.rule) for p, r in by.items()} == {1: ("example.org", "/es/a", "example.org/es/"), 2: ("", "", None), 3: ("", "", None), 4: ("a.example.org", "/en/1", "example.org/en/1")}
