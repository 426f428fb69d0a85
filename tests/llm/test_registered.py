"""The registered queries, with their production parameters, against plain versions over whole tables."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_rest import plain_languages, plain_scores
from test_tokens import BYTES, WORDS, check_packing
from tokenizers import Tokenizer

from strandlake.llm import language_id, lm_score, queries
from strandlake.llm.shingles import words

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables aren't here")


def rows(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{TABLES}/{name}.parquet", columns=list(columns)).to_pylist()]


def run(spark, name):
    return queries.queries()[name](spark, TABLES).collect()


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_op1(spark):
    vectors = [(i, np.array(v, dtype=np.float64)) for i, v in rows("embeddings", "vec_id", "embedding") if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    got: dict[int, list] = {}
    for r in run(spark, "op1_nearest_neighbours"):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort()
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in found)
        hits, total = hits + len(set(best) & {v for _, v, _ in found}), total + 10
    assert hits >= 0.9 * total


def test_op2(spark):
    library, want = Tokenizer.from_file(WORDS), Counter()
    for i, text in rows("documents", "doc_id", "text"):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op2_bpe_encode")) == want


def test_op5(spark):
    library, want, start = Tokenizer.from_file(BYTES), [], 0
    for i, text in sorted(rows("documents", "doc_id", "text")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op5_token_files")) == want


def test_op6(spark):
    docs = rows("documents", "doc_id", "text")
    train = Counter(w for i, t in docs if not lm_score.held_out(i) for w in [*words(t), ""])
    n, v = sum(train.values()), len(train)
    assert v <= lm_score.FIRST_CLASS
    scores = dict(zip((i for i, _ in docs), plain_scores(docs, set(train)), strict=True))
    texts = dict(docs)
    for r in run(spark, "op6_lm_score"):
        mine = [*words(texts[r["doc_id"]]), ""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (lm_score.held_out(r["doc_id"]), len(mine), sum(train[w] > 0 for w in mine), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)
        assert math.isclose(r["score"], scores[r["doc_id"]], rel_tol=1e-9)


def test_op8(spark):
    used, least = check_packing(run(spark, "op8_best_fit_packing"), rows("documents", "doc_id", "text"), 2048)
    assert used <= 1.02 * least + 1


def test_op9(spark):
    want = Counter()
    for i, text in rows("documents", "doc_id", "text"):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    out = run(spark, "op9_media_columns")
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out) == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["media_bytes"], r["feature"]) for r in out}) == len({r["payload_sha256"] for r in out})


def test_op10(spark):
    import re

    pages = []
    for i, url, page in rows("pages", "page_id", "url", "html"):
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        declared = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", page or "")
        pages.append((i, host[1].lower() if host else None, declared[1].lower() if declared else None, language_id.plain(page)))
    model = language_id.fit(spark.read.parquet(f"{TABLES}/documents.parquet"), train_rows=4000)
    want, got = plain_languages(pages, model), {r["page_id"]: (r["lang"], r["posterior"]) for r in run(spark, "op10_language_id")}
    assert {i: v for i, (v, _) in got.items()} == {i: v for i, (v, _) in want.items()}
    assert {i: p for i, (_, p) in got.items()} == pytest.approx({i: p for i, (_, p) in want.items()}, rel=1e-3)
