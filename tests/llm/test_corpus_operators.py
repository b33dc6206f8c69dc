"""The corpus operators against brute force, round trips and held-out labels, with their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidelane.llm import bpe, gam, impact, packing, repeats, rules, similar, simhash, suffix_trees, suffixes, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "rather long " * 30_000
ODD = [
    (None, "no id here at all"), (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one two"), (6, "Same text here, twice."), (6, "Same text here, twice."),
    (7, LONG), (8, "É\x1cß \x85 \xa0 \x00 <|endoftext|> 漢字 🙂 İΣ ﬁ é it's 12½"), (9, "x\nx\n x\n\n"), (10, "a b c a b c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every trouble, and extra columns with names that operators use inside."""
    return spark.createDataFrame([(i, t, "l", "s", None, k, "b", 0, [1.0]) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, chunk int, words string, fp int, x array<double>")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "É" * 1000, "<p>a</p>"]
    urls = ["http://www.Example.com/a", None, "https://u@b.example.org:80/x?y#z", "no scheme", "http://www.example.com/a", "http://www.example.com/a"]
    rows = [(i, u, h, "k") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(None, "http://n/", "only", "k"), (9, "http://r/", "twice", "k"), (9, "http://r/", "twice", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    for k, (least, lines, roll) in enumerate(((0, 2, 200), (9, 256, 1 << 30))):
        root = f"file://{tmp_path}/w{k}"
        warc.write_archive(pages, root, min_payload=least, block_lines=lines, roll_bytes=roll)
        got = Counter(tuple(r) for r in warc.read_archive(pages, root).collect())
        want = Counter()
        for i, _, h, _ in rows:
            data = (h or "").encode()
            same = [r[0] for r in rows if (r[2] or "") == (h or "") and len(data) >= least]
            keeper = max((x for x in same if x is not None), default=None)
            revisit = keeper is not None and keeper != i
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None] += 1
        assert got == want
    root = f"file://{tmp_path}/none"
    warc.write_archive(pages.limit(0), root)
    assert warc.read_archive(pages, root.replace("none", "w0")).count() == len(rows) and warc.read_archive(pages.limit(0), root).count() == 0


def test_surt(spark):
    d = spark.createDataFrame([("http://www.example.com/a?b",), ("x",), (None,)], "u string")
    assert [r[0] for r in d.select(warc.surt(F.col("u"))).collect()] == ["com,example,www)/a?b", "x)", ""]


def test_index_reads_few_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example/{i}", "x") for i in range(300)], "page_id long, url string, html string").coalesce(1)
    root = f"file://{tmp_path}"
    warc.write_archive(pages, root, block_lines=16)
    index = warc.CaptureIndex(root)
    assert len(list(index.captures(b"example,h3)/3", 3))) == 1 and index.blocks_read <= 2
    assert list(index.captures(b"example,h3)/4", 4)) == []


# 2


def slow_print(text, words=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, radius=3):
    root = list(range(len(prints)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def test_simhash(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = texts(df)
        prints = [slow_print(t) for _, t in rows]
        of = slow_components(prints)
        least = {c: min((d for (d, _), x in zip(rows, of, strict=True) if x == c and d is not None), default=None) for c in of}
        want = Counter((d, p, least[c]) for (d, _), p, c in zip(rows, prints, of, strict=True))
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_and_components(spark):
    rnd = random.Random(3)
    centres, xs = [rnd.getrandbits(64) for _ in range(30)], set()
    for _ in range(800):
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 3)):
            x ^= 1 << rnd.randrange(64)
        xs.add(x - (1 << 64) if x >> 63 else x)
    xs = sorted(xs)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in xs], "fp long")).collect()}
    assert got == {(a, b) for i, b in enumerate(xs) for a in xs[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(chain).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[101] == 100


def test_keep_one(spark, docs):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(docs).collect()}


def slow_sets(text, words=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([" ".join(w)] if w else [])


def slow_groups(rows, similarity=0.8):
    """Smallest id of each row's group, by comparing all pairs of sets."""
    sets, root = [slow_sets(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b)):
                root[top(i)] = top(j)
    of = [top(i) for i in range(len(rows))]
    least = {c: min((d for (d, _), x in zip(rows, of, strict=True) if x == c and d is not None), default=None) for c in of}
    return [least[c] for c in of]


def edited_copies():
    """Texts of 60 to 500 words with copies of 1 to 12 changed words, and a passage that many unrelated ones share."""
    rnd, out = random.Random(5), []
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for n in (60, 100, 200, 500) * 5:
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8, 12):
            copy = list(base)
            for _ in range(changes):
                copy[rnd.randrange(n)] = word()
            out.append(" ".join(copy))
    out += [" ".join([word() for _ in range(10)] + passage + [word() for _ in range(k % 30)]) for k in range(40)]
    return list(enumerate(out))


def test_similar_matches_brute_force(spark, docs, odd, empty):
    copies = spark.createDataFrame(edited_copies(), "doc_id long, text string")
    for df in (copies, docs, odd):
        rows = texts(df)
        want = Counter((d, c) for (d, _), c in zip(rows, slow_groups(rows), strict=True))
        assert Counter((r.doc_id, r.component_id) for r in similar.near_duplicates(df).collect()) == want
    assert similar.keep_one(empty).count() == 0


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    rows = edited_copies()
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in kept.collect()} == set(slow_groups(rows))


def test_proposed_pairs_do_not_grow_with_the_square():
    """A component of 2000 nodes and 3 others on one key: only pairs of different roots are proposed, each once."""
    nodes, sizes = np.arange(2003), np.full(2003, 100)
    roots = np.where(nodes < 2000, 0, nodes)
    pairs = [p for a, b in similar.proposed(nodes, sizes, sizes, roots, np.zeros((2003, 2), np.int64), 0.8, 0) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs)) == 3 * 2000 + 3


def test_proposed_pairs_of_many_keys_are_those_of_each(monkeypatch):
    monkeypatch.setattr(similar, "MEETINGS", 50)
    draw = np.random.default_rng(3)
    lengths = np.concatenate(([0, 1, 40, 0], draw.integers(0, 7, 60)))
    n = int(lengths.sum())
    nodes, sizes = draw.permutation(10 * n)[:n], draw.integers(8, 14, n)
    rest, roots, odd = sizes - draw.integers(0, 2, n), draw.integers(0, 5, n), draw.integers(0, 2, (n, 2))
    ends = np.cumsum(lengths)
    for leader in (0, 1, 2):
        both = [[], []]
        for a, b in similar.proposed(nodes, sizes, rest, roots, odd, 0.8, leader, lengths):
            both[0] += zip(a.tolist(), b.tolist(), strict=True)
        for s, e in zip(ends - lengths, ends, strict=True):
            allowed = {tuple(sorted((int(nodes[i]), int(nodes[j])))) for i in range(s, e) for j in range(s, i) if roots[i] != roots[j]
                       and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j]) and 1.8 * min(rest[i], rest[j]) >= 0.8 * (sizes[i] + sizes[j]) - 1e-9
                       and 9 * sum(int(x).bit_count() for x in odd[i] ^ odd[j]) <= sizes[i] + sizes[j]}
            named = [p for a, b in similar.proposed(nodes[s:e], sizes[s:e], rest[s:e], roots[s:e], odd[s:e], 0.8, leader) for p in zip(a.tolist(), b.tolist(), strict=True)]
            assert len(named) == len(set(named)) and set(named) <= allowed
            if not leader:
                count = Counter(roots[s:e].tolist())
                common = min((r for r in count if count[r] == max(count.values())), default=None)
                root = dict(zip(nodes[s:e].tolist(), roots[s:e].tolist(), strict=True))
                assert {p for p in allowed if root[p[0]] != common or root[p[1]] != common} == set(named)
            both[1] += named
        assert sorted(both[0]) == sorted(both[1]) and both[0]


# 3 and 9


@pytest.fixture(scope="module")
def library():
    return bpe.WordBpe(bpe.vocabulary_path()).library


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_bpe(spark, docs, odd, empty, library):
    for df in (docs, odd):
        want = Counter()
        for d, t in texts(df):
            ids = ids_of(library, t)
            want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(library.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in bpe.digests(df).collect()) == want
    assert bpe.encode_decode(empty).count() == 0
    assert {bytes(r.ids) for r in bpe.encode_decode(odd).where("doc_id = 8").collect()} == {ids_of(library, ODD[9][1]).tobytes()}


def test_bpe_speculation_and_small_cache(library):
    rnd = random.Random(1)
    parts = ["a", "b", "th", "ing", "'s", "é", "Σ", "́", "\xa0", "\x1c", "<|endoftext|>", " ", "\n", "5", "½", "漢", "...", "THE", "µ", "ŉ", "K"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    for encoder in (bpe.WordBpe(bpe.vocabulary_path(), cache_entries=50), bpe.WordBpe(bpe.vocabulary_path(), speculate=False)):
        assert [i for k in range(0, 3000, 100) for i in encoder.encode(cases[k : k + 100])] == [ids_of(library, c).tobytes() for c in cases]


def test_bpe_of_all_scripts_and_lengths(library):
    rnd = random.Random(2)
    scripts = ["abcdefghij", "абвгд", "αβγςΣ", "漢字仮名", "한국어", "ابتثج", "İıŞßẞ", "éè́̈", "😀👍🏽", "0½٣"]
    words = ["".join(rnd.choice(rnd.choice(scripts)) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    words += ["".join(rnd.choice(s) for _ in range(n)) for s in scripts for n in (49, 300, 10_000)]
    words += ["the" * 30_000, "".join(rnd.choice("etaoin") for _ in range(90_000)), "â" * 5000, "".join(rnd.choice(scripts[3]) for _ in range(90_000))]
    texts = [*words, *(" ".join(rnd.choices(words[:300], k=20)) for _ in range(50)), "Hello\x0bWorld", "a <|endoftext|> b", "x <|ENDOFTEXT|> é", "<|EndOfText|>", "<|endoftext|><|startoftext|>x"]
    want = [ids_of(library, t).tobytes() for t in texts]
    for speculate in (True, False):
        encoder = bpe.WordBpe(bpe.vocabulary_path(), speculate=speculate)
        assert list(encoder.encode(texts)) == want
    for t, ids in zip(texts[-5:], want[-5:], strict=True):  # also each in a batch of its own
        assert list(bpe.WordBpe(bpe.vocabulary_path()).encode([t])) == [ids]


def check_packing(rows, ids, capacity):
    sequences = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * capacity and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, docs, odd, empty, library):
    ids = {d: np.append(ids_of(library, t), 1).astype("<u4") for d, t in texts(docs)}
    total = sum(map(len, ids.values()))
    for options in ({}, {"group_items": 20, "fan_in": 2, "carry": 4}):
        rows = packing.pack(packing.pieces_of(docs), **options).collect()
        assert sum(r.length for r in rows) == total and check_packing(rows, ids, 4096) <= -(-total // 4096) + 4
    rows = packing.pack(packing.pieces_of(odd)).collect()
    check_packing(rows, {d: np.append(ids_of(library, t), 1).astype("<u4") for d, t in ODD}, 4096)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows) - 1  # one row is repeated
    assert packing.pack(packing.pieces_of(empty)).count() == 0


def test_best_fit():
    where, offset, fills = packing.best_fit(np.array([5, 3, 7, 2, 5, 8]), 10)
    assert len(fills) == 3 and fills.sum() == 30
    assert all(o + n <= 10 for o, n in zip(offset, [5, 3, 7, 2, 5, 8], strict=True))
    assert packing.best_fit(np.zeros(0, np.int64), 10)[2].size == 0


# 4


def test_top_k(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 0.15, (260, 16)).astype(np.float32)
    x[10] = x[20]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + [(300, None, 0), (350, [float("nan")] * 16, 0), (400, [None] * 16, 0), (None, [0.1] * 16, 0), (450, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, box int")
    v = np.floor(256 * x.astype(np.float64)).astype(int)
    want = set()
    for q in range(0, 260, 50):
        s = v @ v[q]
        order = sorted((i for i in range(260) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(order)}
    for options in ({}, {"shard_rows": 40, "block_rows": 2}):
        assert {tuple(r) for r in impact.top_k(df, df.where("vec_id % 50 = 0"), **options).collect()} == want
    few = df.where("vec_id in (0, 1, 2)")
    assert impact.top_k(few, few.where("vec_id = 0")).count() == 2 and impact.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e5, 1e7, 6e8])
def test_top_k_of_large_components(spark, size):
    """Components beyond 32 bits, scores beyond 2^53 and near ties: brute force in Python's integers."""
    r = np.random.default_rng(1)
    x = np.round(r.normal(0, size, (120, 8)))
    x[60:] = x[:60] + r.integers(-1, 2, (60, 8)) / 256
    x[::10] = np.round(r.normal(0, 1e4, (12, 8)))  # the queries: so scores fit a long
    df = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    v = [[int(e) for e in np.floor(256 * row)] for row in x]
    want = set()
    for q in range(0, 120, 10):
        s = [sum(a * b for a, b in zip(v[q], w, strict=True)) for w in v]
        order = sorted((i for i in range(120) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, s[i]) for k, i in enumerate(order)}
    assert {tuple(r) for r in impact.top_k(df, df.where("vec_id % 10 = 0")).collect()} == want


def test_top_k_refuses_what_no_long_holds(spark):
    for rows, why in (([(0, [1 / 256, 0.0]), (1, [1e300, 0.0]), (2, [1e200, 0.0])], "component too large"), ([(0, [1e15]), (1, [1e15])], "score too large")):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=why):
            impact.top_k(df, df.where("vec_id = 0")).collect()
    edge = spark.createDataFrame([(0, [1 / 256, 0.0]), (1, [2.0**54, 0.0]), (2, [-(2.0**54), 1.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in impact.top_k(edge, edge.where("vec_id = 0")).orderBy("rank").collect()] == [2**62, -(2**62)]


def brute_top_k(v, queries, best=5):
    """The rows of ``impact.top_k`` from {vec_id: integer vector}, in Python's integers."""
    out = set()
    for q in queries:
        s = {i: sum(int(a) * int(b) for a, b in zip(v[q], w, strict=True)) for i, w in v.items() if i != q and len(w) == len(v[q])}
        out |= {(q, k + 1, i, s[i]) for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:best])}
    return out


def test_top_k_sends_no_blocks_through_the_driver(spark):
    """Every block meets every shard: broadcast, their copies would grow as the square of the input."""
    v = {i: row for i, row in enumerate(np.random.default_rng(2).integers(-200, 200, (300, 8)).tolist())}
    df = spark.createDataFrame([(i, [x / 256 for x in row]) for i, row in v.items()], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = impact.top_k(df, df.where("vec_id % 10 = 0"), shard_rows=20, block_rows=4)
        assert {tuple(r) for r in found.collect()} == brute_top_k(v, range(0, 300, 10))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "Join" not in plan


def test_top_k_with_several_shards_a_task(spark):
    """Components at the edges of 8, 16 and 32 bits, two lengths, copies; 150 shards in 75 tasks."""
    r = np.random.default_rng(3)
    edges = [-(2**31), 2**31 - 1, -(2**15), 2**15 - 1, -129, -128, 127, 128, -1, 0, 1]
    v = {i: [int(x) for x in r.choice(edges if i % 10 else edges[2:], 4 if i % 3 else 6)] for i in range(300)}  # the queries narrower: so scores fit a long
    v |= {200 + i: v[i] for i in range(20)}
    df = spark.createDataFrame([(i, [x / 256 for x in row]) for i, row in v.items()], "vec_id long, embedding array<double>")
    assert {tuple(x) for x in impact.top_k(df, df.where("vec_id % 10 = 0"), shard_rows=2, block_rows=3).collect()} == brute_top_k(v, range(0, 300, 10))


@pytest.mark.parametrize("keep", [similar.keep_one, simhash.keep_one])
def test_keep_one_of_odd_rows_and_clashing_names(spark, odd, empty, keep):
    wide = odd.withColumn("gone_id", F.lit(1)).withColumn("GONE_ID_", F.lit("x"))
    got = keep(wide)
    assert got.columns == wide.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert (None, "no id here at all") in kept and kept.count((6, "Same text here, twice.")) == 2 and (7, LONG) in kept
    assert keep(empty.withColumn("gone_id", F.lit(1))).count() == 0


# 5 and 8


def slow_repeats(rows, words):
    first, units = {}, []
    for d, t in rows:
        u = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) if words else (t or "").encode()
        d = 1 << 63 if d is None else d
        units.append((d, u))
        for i in range(len(u) - 49):
            k = tuple(u[i : i + 50]) if words else u[i : i + 50]
            first[k] = min(d, first.get(k, d))
    out = Counter()
    for (d, u), (doc, _) in zip(units, rows, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - 49):
            if first[tuple(u[i : i + 50]) if words else u[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        digest = hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()
        out[(doc, len(u), sum(gone), digest) if words else (doc, len(u), sum(gone), spans, digest)] += 1
    return out


def planted():
    rnd = random.Random(5)
    w = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 3))) for _ in range(30)]
    passages = [" ".join(rnd.choice(w) for _ in range(90)) for _ in range(6)]
    rows = [(None, passages[0]), (7, None), (8, ""), (9, passages[1]), (9, passages[1]), (10, "a" * 300), (3, "a" * 120), (11, "ab" * 200), (12, "xab" * 100)]
    return rows + [(100 + i, " \t".join([" ".join(rnd.choice(w) for _ in range(rnd.randint(0, 40))), rnd.choice(passages)[rnd.randint(0, 60) :], rnd.choice(passages)])) for i in range(50)]


@pytest.mark.parametrize(("module", "words"), [(suffixes, False), (suffix_trees, True)])
def test_repeats(spark, docs, empty, module, words):
    for rows in (planted(), [(d, t[:6000]) for d, t in texts(docs)]):
        df, want = spark.createDataFrame(rows, "doc_id long, text string"), slow_repeats(rows, words)
        for options in ({}, {"layout": (9, 3, 5)}, {"hot_chunks": 1, "layout": (9, 3, 5)}):  # several chunks; all anchors hot
            assert Counter(tuple(r) for r in module.digests(df, **options).collect()) == want
    assert module.digests(empty).count() == 0


def test_encoder_comes_after_freed_memory_is_given_back(monkeypatch):
    """A worker of an earlier stage of the pipeline returns what that freed before it loads an encoder."""
    from tidelane.llm import shared

    seen = []
    monkeypatch.setattr(bpe, "_LOADED", {})
    monkeypatch.setattr(shared, "give_back", lambda: seen.append("back"), raising=False)
    monkeypatch.setattr(bpe, "WordBpe", lambda path: seen.append("load") or path)
    assert bpe.load("v") == bpe.load("v") == "v" and seen == ["back", "load", "back"]


def test_orders_agree():
    r = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        windows = r.integers(1, 40, 12)
        lengths = windows + 9
        text, begin = r.integers(0, alphabet, lengths.sum()).astype(np.uint8), np.cumsum(lengths) - lengths
        at = repeats.spread(begin, windows)
        want = [text[a : a + 10].tobytes() for a in at]
        for order in (suffixes.order, suffix_trees.deep_nodes):
            names = order(text, begin, windows, 10)
            assert len(set(zip(names.tolist(), want, strict=True))) == len(set(want)) == len(set(names.tolist()))


def test_hashes_do_not_decide(spark, monkeypatch):
    """Thue-Morse words and their complements collide under polynomial hashes modulo 2^64; nothing may go for that. Nor
    may it where every hash of a stretch is the same."""
    bit, flipped = "a", "b"
    for _ in range(10):
        bit, flipped = bit + flipped, flipped + bit
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{bit} {rest}"), (2, f"{flipped} {rest}"), (3, f"x{bit} {rest} y{flipped}"), (4, f"{bit} {rest}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for module, words in ((suffixes, False), (suffix_trees, True)):
        got = module.digests(df).collect()
        assert Counter(tuple(r) for r in got) == slow_repeats(rows, words)
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 0, 4: 50}
    monkeypatch.setattr(repeats, "mix", lambda x: x & np.uint64(0))  # one anchor, one group, one proposal
    texts_ = [t.encode() for _, t in rows]
    for module, words in ((suffixes, False), (suffix_trees, True)):
        chunk = repeats.Chunk(module.METHOD, [1, 2, 3, 4], texts_)
        s = chunk.stretches(np.ones(len(chunk.anchors()[0]), np.uint8), 1)
        f = s["first"]
        data = chunk.content(s["start"][f], s["run"][f])
        units = repeats.word_codes(data)[0] if words else np.frombuffer(data, np.uint8)
        bits = repeats.removed_windows(module.METHOD, s["group"][f], s["doc"][f], s["run"][f], units)
        covered = chunk.covered(s, bits)
        want = {r[0]: r[2] for r in slow_repeats(rows, words)}
        assert {k + 1: int(covered[e - c : e].sum()) for k, (c, e) in enumerate(zip(chunk.counts, chunk.ends, strict=True))} == want


def test_repeats_of_odd_and_repeated_rows(spark, odd):
    """Very long texts, nulls, clashing columns, and one row that is there 3000 times."""
    for rows in (ODD + [(11, LONG + "end")], [(5, "a passage " * 40)] * 3000 + [(4, "b " + "a passage " * 40), (6, "a passage " * 30)]):
        df = spark.createDataFrame([(d, t, 1, "u") for d, t in rows], "doc_id long, text string, chunk long, others string")
        for module, words in ((suffixes, False), (suffix_trees, True)):
            assert Counter(tuple(r) for r in module.digests(df).collect()) == slow_repeats(rows, words)
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def test_maximal_repeats_are_read_off_the_tree():
    r = np.random.default_rng(4)

    def brute(found, least):
        occurs, out = {}, []
        for i, t in enumerate(found):
            for a in range(len(t)):
                for b in range(a + least, len(t) + 1):
                    occurs.setdefault(tuple(t[a:b]), []).append((i, a))
        for k, at in occurs.items():
            left = {found[i][a - 1] if a else ("start", i) for i, a in at}
            right = {found[i][a + len(k)] if a + len(k) < len(found[i]) else ("end", i) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                out.append((len(k), sorted(at)))
        return sorted(out)

    for _ in range(60):
        found = [r.integers(0, 3, r.integers(0, 15)).tolist() for _ in range(r.integers(1, 4))]
        assert sorted(suffix_trees.maximal_repeats([np.array(t, np.int64) for t in found], 2)) == brute(found, 2)


@pytest.mark.parametrize("most", [1, 3, 50, 10_000])
def test_prefix_groups_fit(most):
    """Groups have one prefix and at most so many suffixes, unless they agree to the limit; no suffix that has a partner is lost."""
    r = np.random.default_rng(6)
    units = np.concatenate([r.integers(0, 4, 500), np.zeros(80, np.int64), r.integers(0, 4, 20)])
    places, seen = np.arange(len(units) - 12), []
    for at, sizes, depths in suffix_trees.prefix_groups(units, places, 12, most):
        for a, n, d in zip(np.cumsum(sizes) - sizes, sizes, depths, strict=True):
            assert len({tuple(units[p : p + d]) for p in at[a : a + n]}) == 1 and (n <= most or d == 12)
        seen += at.tolist()
    windows = Counter(tuple(units[p : p + 12]) for p in places)
    assert len(seen) == len(set(seen)) and {p for p in places if windows[tuple(units[p : p + 12])] > 1} <= set(seen)


def test_remove_repeats_keeps_columns(spark, odd):
    text = "this passage is long enough to be found again in another row of the table, surely "
    df = odd.limit(3).unionByName(spark.createDataFrame([(50, text + "one"), (51, text + "two")], "doc_id long, text string"), allowMissingColumns=True)
    out = suffixes.remove_repeats(df)
    assert out.schema.names == df.schema.names
    got = {r.doc_id: r for r in out.collect()}
    assert got[50].text == text + "one" and got[51].text == "two" and got[51].n_chars == 3


# 7


def slow_figures(text):
    text = text or ""
    w = WORD.findall(text)
    n, counts, covered = len(w), Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(n - 2):
        if counts[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rules(spark, docs, odd, empty, monkeypatch):
    def check(df):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(df).collect())
        assert got == Counter((d, *slow_figures(t)) for d, t in texts(df))

    check(docs)
    check(odd)
    assert rules.judge(empty).count() == 0
    monkeypatch.setattr(rules, "POSITION_BITS", 4)  # places of texts over 15 words don't fit
    check(docs)
    monkeypatch.setattr(rules, "POSITION_BITS", 58)  # six bits of hash: the sort in full has to decide
    check(docs)


def test_rules_keep_and_learn(spark, docs, odd):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    long = {d for d, t in texts(docs) if not slow_figures(t)[-1]}
    assert all(d in ids for d in long if labels.get(d) == 1)
    assert rules.keep_good(odd).schema.names == odd.schema.names
    patterns = spark.createDataFrame([(1, 1, 1, 900.0), (-1, -1, 1, 80.0), (-1, -1, 0, 20.0)], "v_a int, v_b int, v_c int, n double")
    model = rules.estimate(patterns, ["a", "b", "c"])
    assert model["share"] > 0.85 and model["rules"]["a"]["bad"][1] > 0.5 > 0.05 > model["rules"]["a"]["good"][1]


# 6 and 10


def test_classifiers_edges(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    none = labels.limit(0)
    for module in (gam, toxicity):
        for df, truth in ((odd, labels), (odd, none), (empty, labels)):
            rows = module.classify(df, truth).collect()
            assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
        held = {r.doc_id: r.held_out for r in module.classify(docs, labels).collect()}
        assert all(h == (zlib.crc32(str(d).encode()) % module.FOLDS == module.HELD_FOLD) for d, h in held.items())
    assert gam.keep_good(odd, labels).schema.names == odd.schema.names


def test_quality_held_out():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair shows it
    model = gam.fit(x[:2000], y[:2000])
    assert ((gam.score(model, x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def auc(rows, truth, column="score"):
    at = np.array([r[column] for r in rows])
    y = np.array([truth[r.doc_id] for r in rows])
    ranks = np.argsort(np.argsort(at)) + 1
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_classifiers_on_held_out_labels(spark):
    """Rows of the held fold were never learnt from; the quality model also rejects and keeps what it should."""
    docs, labels = (spark.read.parquet(SMALL.replace("0.001", "0.1") + f"/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    quality = [r for r in gam.classify(some, labels).collect() if r.held_out]
    y = {k: r.quality for k, r in truth.items()}
    assert len(quality) > 500 and auc(quality, y) > 0.99
    assert np.mean([(r.score >= gam.THRESHOLD) == y[r.doc_id] for r in quality]) > 0.97
    kept = {r.doc_id for r in gam.keep_good(some, labels).select("doc_id").collect()}
    assert np.mean([(r.doc_id in kept) == (r.score >= gam.THRESHOLD) for r in quality]) == 1
    y = {k: r.toxic for k, r in truth.items()}
    toxic = [r for r in toxicity.classify(some, labels).collect() if r.held_out]
    assert auc(toxic, y) > 0.95
    found = [r for r in toxic if y[r.doc_id] == 1]
    assert np.mean([r.score >= toxicity.THRESHOLD for r in found]) > 0.8 and np.mean([r.score < toxicity.THRESHOLD for r in toxic if y[r.doc_id] == 0]) > 0.97


def test_repeated_labelled_rows_count_once(spark):
    rows = [(1, "good words here " * 30)] * 2000 + [(i, f"text number {i} " * 20) for i in range(2, 40)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    for module in (gam, toxicity):
        assert module.classify(df, labels).count() == len(rows)


def test_toxicity_learns_and_gradients():
    rnd = random.Random(0)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    made = []
    for k in range(600):
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 90))]
        if k % 3 == 0:
            t[rnd.randrange(len(t))] = rnd.choice(["zoxxan", "zoxxer", "qudrat"])
        made.append((" ".join(t), float(k % 3 == 0)))
    model = toxicity.fit([t for t, _ in made[:450]], np.array([y for _, y in made[:450]]))
    scores, truth = toxicity.score(model, [t for t, _ in made[450:]]), np.array([y for _, y in made[450:]])
    assert ((scores > 0.5) == truth).mean() > 0.9

    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs, codes, _ = toxicity.prepare(["some few words", "other"])
    ids, y = np.array([[0, 3], [1, -1], [2, -1]]), np.array([1.0, 0.0])

    def loss():
        z = net.forward(net.vectors(*inputs), ids)
        return np.mean(np.logaddexp(0, z) - y * z)

    grads = {}
    net._adam = lambda name, rows, g: grads.update({name: g})
    net.train(inputs, ids, y)
    for name in ("hf", "hb", "xf", "attend", "out"):
        i = tuple(int(k) - 1 for k in net.p[name].shape)
        net.p[name][i] += 1e-3
        up = loss()
        net.p[name][i] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(grads[name][i], rel=2e-2, abs=1e-6)
        net.p[name][i] += 1e-3


def test_windows_cover_texts():
    owner, start, length = toxicity.windows_of(np.array([0, 1, 32, 33, 100]))
    for k, n in enumerate((0, 1, 32, 33, 100)):
        assert {i for o, s, m in zip(owner, start, length, strict=True) if o == k for i in range(s, s + m)} == set(range(n))


def test_passages_of_half_a_window_lie_whole_in_one():
    for n in range(1, 200):
        _, start, length = toxicity.windows_of(np.array([n]))
        size = min(n, toxicity.WINDOW // 2 + 1)
        assert all(((start <= s) & (s + size <= start + length)).any() for s in range(n - size + 1))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_every_stage_runs_on_odd_and_empty_rows(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows and clashing names, through each stage that returns documents."""
    import corpus_pipeline

    wide = odd.withColumns({"gone_id": F.lit(7), "score": F.lit("s"), "component_id": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert len(rows) <= len(ODD) and {r.doc_id for r in rows} <= {i for i, _ in ODD}, name
        if name in ("near-duplicates", "repeated passages"):
            copies = {2, 3} if name == "near-duplicates" else set()  # without words, as the null text of 1
            assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ODD if i not in copies), name
        assert stage(spark, wide.limit(0), SMALL).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SMALL).agg(F.count_distinct("doc_id")).first()[0] == len({i for i, _ in ODD if i is not None})
