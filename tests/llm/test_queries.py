"""The registered queries on the smallest driver tables: against their SQL, or against plain Python."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import pytest
from test_corpus import brute

from posegrid.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for n in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(db):
    return db.sql("SELECT doc_id, text, lang FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df, wanted = QUERIES[name](spark, SF), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    want = sorted(str([r[wanted.columns.index(c)] for c in columns]) for r in wanted.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, docs):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for i, text, _ in docs:
        ids = model.encode(text or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(model.decode(ids).encode())))
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op1_sentencepiece"](spark, SF).collect()} == want


def test_op3(spark, db):
    """The article of every page, cut out with regular expressions, which these pages allow."""
    import html
    import re

    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in QUERIES["op3_html_extract"](spark, SF).collect()}
    for i, page in db.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", article.group(1)) if article else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
        text = "\n".join(x for x in lines if x)
        assert got[i] == (text, len(text))


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_language_id"](spark, SF).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i, _, _ in docs)
    held = [(i, lang) for i, text, lang in docs if got[i]["held_out"] and lang and text]
    assert len(held) > 20 and sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)


def test_op6(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op6_media_avi"](spark, SF).collect()}
    for i, text, _ in docs:
        raw = (text or "").encode()
        payload = raw.ljust(max(-(-len(raw) // 576), 1) * 576, b"\xff")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), None)


def test_op8(spark, docs):
    got = QUERIES["op8_histogram_sort"](spark, SF).collect()
    texts = dict((i, (t or "").encode()) for i, t, _ in docs)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "bytes", None) for r in got)
    by = [[r for r in got if r["shard"] == k] for k in range(16)]
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by)
    sizes = [sum(r["size"] for r in rows) for rows in by]
    assert all(abs(n - sum(sizes) / 16) <= max(r["size"] for r in got) + 1 for n in sizes)


def test_op9(spark, docs):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["n_before"] for r in QUERIES["op9_edit_counts"](spark, SF).collect()}
    assert got == {i: len(plain.encode_ordinary(t or "")) for i, t, _ in docs}


def test_op10(spark, docs):
    got = QUERIES["op10_setsketch_neardup"](spark, SF).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"]} == {x for x in brute([(i, t) for i, t, _ in docs], 3, 85) if x[1]}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
