import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import line_dedup, near_dedup
from strandlake.llm.components import components
from strandlake.llm.shingles import CirculantMinHash, WordHashes, shingle_set, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, least=40, docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(doc_id)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= docs}
    out = []
    for doc_id, text, *_ in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if doc_id is None or gone.get(key(x), doc_id) == doc_id]
        out.append((doc_id, "\n".join(kept), len(split), len(split) - len(kept)))
    return Counter(out)


def test_lines_equal_a_plain_version(awkward, awkward_rows, nothing):
    assert Counter(map(tuple, line_dedup.dedup_lines(awkward).collect())) == plain_lines(awkward_rows)
    assert sum(n for *_, n in plain_lines(awkward_rows)) > 4
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_many_positions_and_texts_under_one_id(spark):
    shared = "a line that is long enough to be counted as one of many"
    rows = [(i, "\n".join([f"{i}-{j}" for j in range(90)] + [shared] * 40)) for i in range(5)] + [(2, f"{shared}\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, line_dedup.dedup_lines(docs).collect())) == plain_lines(rows)
    marks = {r["doc_id"]: (r["n_dropped"], r["keeps"]) for r in line_dedup.keep_bitmaps(docs).where("doc_id < 2").collect()}
    assert marks[0][0] == 40 and set(marks[0][1]) == {2, 3, 4}


def plain_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_groups(rows, percent, size=5):
    sets = [(d, plain_set(t, size)) for d, t, *_ in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_a_plain_version(awkward, awkward_rows, percent):
    assert Counter(map(tuple, near_dedup.groups(awkward, percent).collect())) == plain_groups(awkward_rows, percent)


def test_groups_of_near_copies_lose_no_link(spark):
    """Variants that link with some of the others only, in several families, dealt out over many small blocks."""
    rng, rows = random.Random(6), []
    for _ in range(3):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 7
    try:
        got = Counter(map(tuple, near_dedup.groups(docs, 85).collect()))
    finally:
        near_dedup.BLOCK = old
    assert got == plain_groups(rows, 85)


@pytest.mark.parametrize("percent", [60, 80, 85, 100])
def test_size_classes_keep_links_at_the_bound(spark, percent):
    """Growing prefixes of one text: each links with those up to exactly the threshold longer."""
    base = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(base[: n + 4])) for i, n in enumerate([*range(1, 60), 60, 75, 100, 125, 160, 200, 250, 250])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.shingled(docs, 5).selectExpr("doc_id as node", "0L as family", "shingles")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 3
    try:
        bands = near_dedup.signed(docs, 5).selectExpr("doc_id as node", "bands")
        links = near_dedup.family_links(sets, bands, percent).collect()
    finally:
        near_dedup.BLOCK = old
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {d: roots.get(d, d) for d, _ in rows} == {d: c for d, _, c, _ in plain_groups(rows, percent)}


def test_members_that_a_pivot_connects_do_not_meet_again(spark):
    """A family of copies around one text, and some that only a chain connects; a doc_id with a second, empty text."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:100], f"x{i}", *base[101:]])) for i in range(60)]
    rows += [(100 + i, " ".join([*(f"y{j}" for j in range(4 * i)), *base[4 * i :]])) for i in range(30)]
    rows += [(7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.shingled(docs, 5).selectExpr("doc_id as node", "0L as family", "shingles")
    bands = near_dedup.signed(docs, 5).where("bands is not null").selectExpr("doc_id as node", "bands")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 9
    try:
        links = near_dedup.family_links(sets, bands, 85).collect()
        got = Counter(map(tuple, near_dedup.groups(docs, 85).collect()))
    finally:
        near_dedup.BLOCK = old
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    plain = plain_groups(rows, 85)
    assert {d: roots.get(d, d) for d, _ in rows} == {d: c for d, n, c, _ in plain if n}
    empty = Counter({(7, 0, 0, False): 2})  # the plain version's, which has one component for all rows of a doc_id
    assert got == plain - empty + Counter({(7, 0, 7, True): 2})


def test_distinct_documents(awkward, awkward_rows, nothing):
    out = near_dedup.distinct(awkward, 80)
    assert out.columns == awkward.columns
    kept = {d for d, _, _, keep in plain_groups(awkward_rows, 80) if keep and d is not None}
    got = [r["doc_id"] for r in out.collect()]
    assert Counter(d for d in got if d is not None) == Counter(kept) and got.count(None) == 2
    assert near_dedup.distinct(nothing).collect() == []
    assert near_dedup.groups(nothing).collect() == []


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    root = {x: x for a, b in links if a is not None for x in (a, b)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] is not None and p[0] != p[1] for p in links)}


def test_signatures_estimate_similarity():
    minhash, hashes, rng = CirculantMinHash(190), WordHashes(), random.Random(3)
    a = [str(rng.random()) for _ in range(400)]
    b = a[:300] + [str(rng.random()) for _ in range(100)]
    x, y = shingle_set(a, 5, hashes), shingle_set(b, 5, hashes)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minhash.signature(x) == minhash.signature(y)).mean() - true) < 0.12
    assert words("A\x1cB　c D") == ["a\x1cb　c", "d"]
    assert hashlib.sha256(minhash.signature(x).tobytes()).digest() == hashlib.sha256(CirculantMinHash(190).signature(x).tobytes()).digest()
