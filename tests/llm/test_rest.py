import functools
import hashlib
import io
import math
import random
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import ann, chat_format, language_id, lm_score, media, suffix_tree
from strandlake.llm.shingles import words


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 24))
    base[300:600] = base[7] + rng.normal(scale=0.02, size=(300, 24))  # a dense cluster
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(2000 + i, base[8].tolist()) for i in range(400)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [None] + [1.0] * 23), (3004, [float("nan")] + [1.0] * 23), (3005, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (3006, [1.0, 2.0]), (3007, [1.0, 2.5]), (8, base[8].tolist())]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, label int").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 50 = 0 or vec_id in (8, 310, 3006)"), k=10, shortlist=60).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        if q == 3006:
            assert found == [(1, 3007, 0.5)]
            continue
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [int(i) for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, total = hits + len(set(best) & {v for _, v, _ in found}), total + 10
        assert all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in found)
    assert hits / total >= 0.9
    assert [v for _, v, _ in got[8]] == list(range(2000, 2010))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0} | {8, 310, 3006}
    empty = df.where("false")
    assert ann.search(empty, empty).collect() == []


def test_anisotropic_codes_cost_less_along_the_vector():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 16))

    def parallel(threshold):
        q = ann.Quantiser(x, width=2, stages=1, threshold=threshold)
        codes = q._codes(q.stages[0], q.parts(x), q.parts(x / np.linalg.norm(x, axis=1, keepdims=True)), sweeps=2)
        residual = (q.parts(x) - q._chosen(q.stages[0], codes)).reshape(x.shape)
        return (((residual * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert parallel(0.5) < 0.7 * parallel(0.0)


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, s int, at int")


def test_chats(spark):
    texts = ["hi", "", None, "\\", "\\h", "#<\\l", "a\x1eb", "\\r", "</turn>", "### user:\n", "x </turn>\n### assistant:\n", "é日\\\\#"]
    rng, rows = random.Random(1), []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t if t % 4 else None, rng.choice(["user", "assistant", "system", None, "odd:\n#role\\c"]), rng.choice(texts), 1, 2))
    rows += [rows[0], (None, 1, "assistant", "z", 0, 0), (99, 1, "assistant", "y" * 300_000, 0, 0)] + [(77, i, "assistant", str(i), 0, 0) for i in range(700)]
    formatted = chat_format.format_chats(chats(spark, rows).repartition(3))
    out = {r["conv_id"]: r for r in chat_format.read_chats(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append(((t is not None, t or 0), role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        want = [(r, x) for _, r, x in sorted(turns, key=lambda t: (t[0], t[1].encode(), t[2].encode()))]
        assert [(t["role"], t["text"]) for t in out[c]["turns"]] == want
        assert out[c]["loss_texts"] == [x for r, x in want if r == "assistant"]
    assert chat_format.read_chats(chat_format.format_chats(chats(spark, []))).collect() == []


def test_adjacent_turns_merge(spark):
    row = chat_format.format_chats(chats(spark, [(1, 0, "user", "a", 0, 0), (1, 1, "user", "b", 0, 0), (1, 2, "assistant", "c#", 0, 0)])).first()
    assert row["formatted"] == "### user:\na\x1eb </turn>\n### assistant:\nc\\h </turn>\n"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss_mask"]] == ["c\\h"]


def test_media(spark, awkward, awkward_rows, nothing):
    catalogue = media.store(awkward)
    out = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.features(media.with_header(catalogue)).collect())
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert out == want
    rows = catalogue.collect()
    assert len({(r["shard"], r["offset"]) for r in rows}) == len({r["digest"] for r in rows}) == len({text or "" for _, text, *_ in awkward_rows})
    for shard in {r["shard"] for r in rows}:
        with open(shard.removeprefix("file://"), "rb") as f:
            data = f.read()
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            names = {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
        for r in rows:
            if r["shard"] == shard:
                assert names[f"{r['digest']}.png"] == data[r["offset"] : r["offset"] + r["length"]]
        assert all(hashlib.sha256(v).hexdigest() == k[:-4] for k, v in names.items())
    assert media.features(media.with_header(media.store(nothing))).collect() == []
    old, media.SENT_DIGESTS = media.SENT_DIGESTS, 0
    try:
        joined = media.store(awkward)
    finally:
        media.SENT_DIGESTS = old
    assert Counter((r["doc_id"], r["digest"]) for r in joined.collect()) == Counter((r["doc_id"], r["digest"]) for r in rows)
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"a" * 576)[:-20] + b"x" * 20)


PROSE = {"en": ["the", "and", "with", "this", "thing"], "de": ["der", "und", "mit", "nicht", "schön"], "fr": ["le", "et", "avec", "être", "où"]}


def labelled(rng, n):
    return [(i, " ".join(rng.choice(PROSE[lang]) for _ in range(20)), lang) for i, lang in enumerate(rng.choice(list(PROSE)) for _ in range(n))]


def test_languages_of_held_out_rows(spark):
    rng = random.Random(3)
    model = language_id.fit(spark.createDataFrame(labelled(rng, 200), "doc_id long, text string, lang string"))
    test = labelled(rng, 200)
    rows = spark.createDataFrame([(i, None, None, None, t) for i, t, _ in test], "id long, host string, suffix string, declared string, text string")
    got = {r["id"]: r["lang"] for r in language_id.identify(rows, model).collect()}
    assert sum(got[i] == lang for i, _, lang in test) >= 196


def test_other_evidence_decides_where_there_is_no_text(spark):
    rng = random.Random(4)
    model = language_id.fit(spark.createDataFrame(labelled(rng, 200), "doc_id long, text string, lang string"))
    page = lambda i, lang, host, declared: (i, f"http://{host}/x", f"<html lang='{declared}'><p>{' '.join(rng.choice(PROSE[lang]) for _ in range(20))}</p></html>")
    rows = [page(i, "de", "a.example.de", "de-DE") for i in range(60)] + [page(100 + i, "fr", "b.example.fr", "fr") for i in range(60)] + [page(200 + i, "en", f"h{i}.example.com", "en") for i in range(200)]
    rows += [(900, "http://a.example.de/", "<p>123</p>"), (901, "https://new.other.fr:80/", "<html lang=fr>"), (902, None, None), (903, "nonsense", "")]
    out = {r["page_id"]: r for r in language_id.of_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert (out[900]["lang"], out[901]["lang"]) == ("de", "fr") and not out[900]["has_text"]
    assert out[902]["lang"] == out[903]["lang"] == "en" and out[902]["posterior"] < 0.95
    assert all(out[i]["lang"] == "de" and out[i]["posterior"] > 0.99 for i in range(60))


def plain_languages(rows, model):
    """Each page's (language, posterior) by the definition, page by page; rows: (id, host, declared, text)."""
    names, table, _ = model
    n, found = len(names), []
    for _, host, declared, text in rows:
        grams = language_id.trigrams(text)
        ll = table[:, grams].mean(axis=1) * min(len(grams), language_id.TEXT_WEIGHT) if len(grams) else None
        post = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum() if ll is not None else None
        found.append((host, ".".join(host.split(".")[-2:]) if host else None, host.rsplit(".", 1)[-1] if host else None, declared, ll, post))

    def mass(which, value):
        return sum((f[5] for f in found if f[5] is not None and f[which] == value), np.zeros(n))

    def value_logs(which, value):
        values = {f[which] for f in found if f[which] is not None}
        if value not in values:
            return np.zeros(n)
        total = sum(mass(which, v) for v in values) + language_id.VALUE_WEIGHT * len(values)
        return np.log((mass(which, value) + language_id.VALUE_WEIGHT) / total)

    base = sum((f[5] for f in found if f[5] is not None), np.ones(n))
    base = base / base.sum()
    shrunk = lambda m, parent, weight: (m + weight * parent) / (m.sum() + weight)
    out = {}
    for (i, *_), (host, domain, suffix, declared, ll, _) in zip(rows, found):
        prior = shrunk(mass(0, host), shrunk(mass(1, domain), base, language_id.DOMAIN_WEIGHT), language_id.HOST_WEIGHT) if host else base
        total = (ll if ll is not None else 0) + np.log(prior) + value_logs(3, declared) + value_logs(2, suffix)
        post = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        out[i] = (names[int(post.argmax())], float(post.max()))
    return out


@pytest.mark.parametrize("sent", [100, 0])
def test_languages_equal_a_plain_version(spark, monkeypatch, sent):
    """With tables that are sent out, and with ones that are joined by a salt."""
    monkeypatch.setattr(language_id, "SENT_VALUES", sent)
    rng = random.Random(11)
    model = language_id.fit(spark.createDataFrame(labelled(rng, 200), "doc_id long, text string, lang string"))
    hosts = ["a.one.de", "b.one.de", "www.two.info", "x.three.com", "y.three.com", "four.xn--p1ai", None]
    rows = [(i, rng.choice(hosts), rng.choice(["de", "en", "fr", None]), " ".join(rng.choice(PROSE[rng.choice(list(PROSE))]) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(120)]
    rows += [(200, "new.example.org", None, ""), (201, None, None, "the and with " * 20_000), (202, "a.one.de", "sv", "")]
    page = lambda host, declared, text: (f"https://user@{host.upper()}:80/p?q" if host else None, (f"<html lang='{declared}-X'>" if declared else "") + f"<p>{text}</p>")
    pages = spark.createDataFrame([(i, *page(h, d, t)) for i, h, d, t in rows], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: (r["lang"], r["posterior"]) for r in language_id.of_pages(pages, model).collect()}
    want = plain_languages(rows, model)
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert {i: v[1] for i, v in got.items()} == pytest.approx({i: v[1] for i, v in want.items()}, rel=1e-4)


def test_ties_between_languages_go_to_the_first_name(spark):
    model = language_id.fit(spark.createDataFrame([(1, "aaa", "fr"), (2, "bbb", "de")], "doc_id long, text string, lang string"))
    row = language_id.of_pages(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string"), model).first()
    assert row["lang"] == "de" and math.isclose(row["posterior"], 0.5)


def test_markup_of_any_kind():
    cut = lambda s: " ".join(language_id.plain(s).split())
    assert cut("a<b>c</b>d<!-- x > y -->e<SCRIPT>if (a<b) f()</script >g<style>h</style>i &amp; j") == "a c d e g i & j"
    assert cut("a <!-- open <b>c</b>") == "a c" and cut("a <script> open <b>c") == "a open c" and cut("a < b") == "a < b" and cut(None) == ""
    assert cut("a<!--b--><!--c") == "a <!--c"
    for part in ("<!--", "<script>", "<style ", "<", "<!-- <script>"):
        assert len(language_id.plain(part * 300_000)) >= 0


def test_language_stage_on_awkward_rows(awkward, nothing):
    model = language_id.fit(awkward)
    kept = language_id.accepted(awkward, model)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not {0, 1, 2} & set(ids) and {3, 5, 9, 13} <= set(ids) and ids.count(None) == 2 and ids.count(7) == 2
    assert language_id.accepted(nothing, language_id.fit(nothing)).collect() == []
    assert language_id.identify(awkward.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"), "text"), language_id.fit(nothing)).where("lang is not null").count() == 0


def test_scores_of_awkward_rows(awkward, awkward_rows, nothing):
    counts = Counter()
    for doc_id, text, *_ in awkward_rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(words(text))
            counts[""] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        tokens = [*words(text), ""]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want[doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)] += 1
    out = lm_score.score(awkward).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    assert lm_score.score(nothing).collect() == []


def test_scores_beat_the_unigrams_on_held_out_text(spark):
    rng = random.Random(5)
    tongues = [["ka", "to", "mi", "ren"], ["pod", "ek", "ush", "dra"]]  # a document is in one of two
    rows = [(i, " ".join("".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(1, 3))) for _ in range(60))) for i in range(300)]
    out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("held_out")
    row = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]


def plain_scores(rows, common):
    """Each row's score by the model's definition, word by word; ``common`` words are symbols of their own."""
    docs = [[*words(t), ""] for _, t in rows]
    train = [d for (i, _), d in zip(rows, docs) if not lm_score.held_out(i)]
    counts = Counter(w for d in train for w in d)
    digest = lambda w: lm_score.xxhash.xxh3_64_intdigest(w.encode())
    symbol = lambda w: w if w in common else digest(w) >> 64 - lm_score.CLASS_BITS
    grams = defaultdict(Counter)
    for d in train:
        s = [symbol(""), symbol(""), *map(symbol, d)]
        for k in range(2, len(s)):
            for depth in range(3):
                grams[tuple(s[k - depth : k])][s[k]] += 1
    alphabet = len(common) + lm_score.CLASSES

    @functools.cache
    def told(context):
        own, gain = grams[context], 0.0
        total, types = sum(own.values()), len(own)
        for y, n in own.items() if context and total > 1 else ():
            below, others = p(context[1:], y), types - (n == 1)
            gain += n * math.log((n - 1 + others * below) / (total - 1 + others) / below)
        return total, types, gain > 0

    @functools.cache
    def p(context, x):
        total, types, kept = told(context)
        own = grams[context][x] if x in grams[context] else 0
        if not context:
            return (own + types / alphabet) / (total + types) if types else 1 / alphabet
        parent = p(context[1:], x)
        return (own + types * parent) / (total + types) if kept else parent

    out = []
    for (i, _), d in zip(rows, docs):
        s, total = [symbol(""), symbol(""), *map(symbol, d)], 0.0
        for k, w in enumerate(d, 2):
            total += math.log10(p((s[k - 2], s[k - 1]), s[k]))
            if w not in common:
                mine = [n for u, n in counts.items() if u not in common and symbol(u) == symbol(w)]
                total += math.log10((counts[w] + 1) / (sum(mine) + len(mine) + 1))
        out.append(total)
    return out


@pytest.mark.parametrize(("common", "grams"), [(49_152, 1_000_000), (3, 1_000_000), (6, 150)])
def test_scores_are_those_of_the_plain_model(spark, common, grams):
    """With all words common, with most in classes, and with symbols that are dealt out to several buckets."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abc", "Cab", "ü"]) if rng.random() < 0.9 else f"{rng.choice('xyz')}{rng.randint(0, 99)}" for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(i, "ab ba abc x1 y2 unheard of") for i in (200, 201, 202)]
    counts = Counter(w for i, t in rows if not lm_score.held_out(i) for w in [*words(t), ""])
    chosen = set()
    for step in sorted(set(lm_score.steps(np.array(list(counts.values())))), reverse=True):
        more = {w for w in counts if lm_score.steps(np.array([counts[w]]))[0] >= step}
        if len(more) > common:
            break
        chosen = more
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, common, words=40, grams=grams).collect()}
    assert got == pytest.approx(dict(zip((i for i, _ in rows), plain_scores(rows, chosen))), rel=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 6, 400).astype(np.uint16)
    keys, n = np.unique(suffix_tree.contexts(symbols, np.array([100, 0, 300]), 0), return_counts=True)
    counts = np.bincount(symbols, minlength=suffix_tree.SYMBOLS)
    base = suffix_tree.root(counts, 10)
    every = np.array([a << 32 | b << 16 | x for a in range(6) for b in range(6) for x in range(10)], dtype=np.uint64)
    full = np.zeros(len(every), dtype=np.int64)
    full[np.searchsorted(every, keys)] = n
    tree = suffix_tree.Grams(every, full, base)
    level = np.zeros((3, suffix_tree.SYMBOLS), dtype=np.int64)
    level[:, tree.nearest] = tree.total, tree.types, tree.kept
    p = suffix_tree.probabilities(every, base, (level[0], level[1], level[2] > 0), tree.pair_count, tree.deep, tree.deep_total[tree.deep], tree.deep_types[tree.deep], tree.count[tree.deep])
    assert np.allclose(p.reshape(36, 10).sum(axis=1), 1)


def test_counts_in_steps():
    n = np.array([1, 2, 3, 63, 64, 65, 127, 128, 129, 130, 2**40, 2**40 + 2**34, 2**50 - 1])
    found = lm_score.steps(n)
    assert (np.diff(found) >= 0).all() and len(set(found.tolist())) == len(n) - 1 and found[7] == found[8]


def test_language_stage_rejects_foreign_and_garbage_text(spark):
    rng = random.Random(9)
    rows = labelled(rng, 300)
    rows += [(1000 + i, " ".join(rng.choice(PROSE[rng.choice(["en", "de"])]) for _ in range(20)), None) for i in range(30)]  # mixed
    rows += [(1100, "the", None), (1101, "und mit", None)]
    letters = lambda some: " ".join("".join(rng.choice(some) for _ in range(rng.randint(3, 9))) for _ in range(40))
    foreign = ["Вчера вечером мы долго гуляли по берегу реки и говорили", "昨天晚上我们沿着河边走了很久谈论时间过得多么快", "Wczoraj wieczorem długo spacerowaliśmy brzegiem rzeki", letters("bcdfghjklmnpqrstvwxz"), letters("abcdefghijklmnopqrstuvwxyz")]
    rows += [(2000 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in foreign for lang in (None, "de"))]
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string").repartition(3)
    model = language_id.fit(df.where("doc_id < 1000"))
    assert {r["doc_id"] for r in language_id.accepted(df, model).collect()} == {i for i, _, _ in rows if i < 2000}
