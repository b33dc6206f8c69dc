"""Conversation repair, neighbour graph and lexical search against brute force and SQL, with their edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidelane.llm import audit, lexical, neighbours

# 11


def plain_audit(rows):
    """Least (cost, audit) over all edits, by keeping whole strings."""
    best = {"": (0, "")}
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(now):
        out = dict(now)
        for _ in range(3):
            for state, (cost, text) in list(out.items()):
                to = "a" if state == "u" else "u"
                out[to] = min(out.get(to, (math.inf, "")), (cost + 5, text + "I"))
        return out

    for initial, must_go, truncated in rows:
        after = {}
        for state, (cost, text) in inserted(best).items():
            moves = [(state, 2, "D")]
            if not must_go:
                moves += [(step[state, initial], 5 * truncated, "K")] if (state, initial) in step else []
                moves.append(("a" if state == "u" else "u", 1 + 5 * truncated, "R"))
            for to, more, letter in moves:
                after[to] = min(after.get(to, (math.inf, "")), (cost + more, text + letter))
        best = after
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


@pytest.mark.parametrize("settle_at", [4, 4096])
@pytest.mark.parametrize("modulus", [2, 2**61 - 1])
def test_audit_is_the_least_of_all(monkeypatch, settle_at, modulus):
    monkeypatch.setattr(audit.Prefixes, "MODULUS", modulus)  # two hashes: letters must decide
    random.seed(settle_at)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 90] * 12:
        kinds = random.choice(["u", "ua", "sua", "ux", "aaau"])
        rows = [(random.choice(kinds), random.random() < 0.2, random.random() < 0.2) for _ in range(n)]
        program = audit.Audit(settle_at)
        for r in rows:
            program.row(*r)
        assert program.end() == plain_audit(rows), rows


def test_settled_prefixes_free_their_nodes():
    program = audit.Audit(64)
    for i in range(20_000):
        program.row("ua"[i % 2], False, i % 7 == 0)
    assert len(program.paths) < 1000
    cost, letters = program.end()
    assert cost == 5 * len(range(0, 20_000, 7)) - 5 * len(range(0, 20_000, 7)) + cost and len(letters) >= 20_000


def odd_conversations(spark):
    random.seed(5)
    rows = [(None, None, None, None, "x"), (None, 1, "user", "Hi.", "x"), (1, 2**62, "assistant", "Hello!", "x"), (1, -5, "user", "", "x"), (2, 1, "", " \t\n\x0b", "x"), (3, 1, "user", "long. " * 50_000, "x")]
    for c in range(4, 60):
        rows += [(c, random.choice([None, *range(6)]), random.choice(["user", "assistant", "system", "tool", "", None, "user"]), random.choice(["Yes.", "No", "é!", "", None, " \n", "Why? \t", "x" * 3]), "x") for _ in range(random.randrange(1, 12))]
    rows += rows[10:25]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, digest string")


@pytest.mark.parametrize("which", ["odd", "table", "empty"])
def test_conversations_match_sql(spark, which):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet") if which == "table" else odd_conversations(spark)
    df = df.limit(0) if which == "empty" else df
    got = Counter(tuple(r) for r in audit.repair(df).collect())
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    found = c.execute(audit.ORACLE_SQL["op11_conversation_audit"])
    at = [[x[0] for x in found.description].index(n) for n in ["conv_id", *audit.FIGURES, "audit", "repaired_sha256"]]
    assert got == Counter(tuple(r[i] for i in at) for r in found.fetchall())


def test_all_conversations_return(spark):
    df = spark.range(200).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'Hi.' AS text")
    rows = audit.repair(df).collect()
    assert sorted(r.conv_id for r in rows) == list(range(200))
    gone = [r for r in rows if r.audit == "" and r.cost == 0]  # dropped by damage
    assert gone and all(r.repaired_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855" for r in gone)


# 12


def brute_nearest(rows, queries, best):
    rows = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        for i, v in rows:
            if i == q:
                near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != q and len(w) == len(v))
                out[q] = near[:best]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def test_neighbours_recall(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.collect()]
    want = brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 10)
    got = answers(neighbours.nearest(v, v.where("vec_id % 20 = 0"), leaf=32))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in want)
    assert sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert neighbours.op12_neighbour_graph(spark, SMALL).columns == ["query_id", "rank", "vec_id", "score"]


def test_neighbours_of_odd_rows(spark):
    """Copies, ties, several lengths and unusable rows; few enough for the graph to hold all."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(30, 60)] + [(i, rng.integers(-2, 3, 3).tolist()) for i in range(30)]
    rows += [(60, None), (61, []), (62, [0.0, 0.0, 0.0]), (63, [1.0, None, 0.0]), (64, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (65, [float("inf"), 1.0, 1.0]), (66, [1.0]), (67, [3.0]), (68, [1e200, 1e200, -1e200])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, node long, code string")
    want = brute_nearest(rows, [*range(0, 70, 3)], 4)
    assert answers(neighbours.nearest(df, df.where("vec_id % 3 = 0"), best=4)) == want
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0


def test_queries_from_outside_start_at_seeds(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    new = v.where("vec_id < 20").select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * 1.01).alias("embedding"))
    got = answers(neighbours.nearest(v, new, best=1, leaf=32))
    assert sum(got[i + 1_000_000][0][1] == i for i in range(20)) >= 18


def test_codes_keep_distances():
    x = np.random.default_rng(0).standard_normal((50, 64)) * np.logspace(-3, 3, 50)[:, None]
    y = neighbours.decode(neighbours.encode(x))
    assert (np.abs(x - y).max(axis=1) <= np.abs(x).max(axis=1) / 254 + 1e-12).all()


# 13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best):
    found = [(i, Counter(plain_terms(t))) for i, t in docs if i is not None]
    found = [x for x in found if x[1]]
    n, length = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(plain_terms(t))
    out = Counter()
    for item, terms in wanted.items():
        scores = []
        for i, c in found:
            m = 50 + 50 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            scores += [(-s, i)] if s > 0 else []
        out.update((item, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:best], 1))
    return out


ODD_DOCS = [(None, "a b"), (1, None), (2, ""), (3, " -- \x00\x7f "), (4, "One two two THREE"), (4, "One two two THREE"), (5, "é É İ漢字x9 a_b"), (6, "two " * 30_000), (7, "one\x00two"), (8, "ÀB àb ab AB"), (9, "three one"), (10, "three one"), (11, "x" * 100_000)]


@pytest.mark.parametrize("options", [{}, {"piece_bytes": 10, "block_items": 1, "broadcast_bytes": 0}, {"best": 2, "piece_bytes": 60}])
def test_lexical_of_odd_rows(spark, options):
    items = [(None, "one"), (1, None), (2, ""), (3, "one two"), (3, "THREE one"), (4, "É漢字X9 é ab b a"), (5, "nowhere"), (6, "x" * 100_000 + " one")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in ODD_DOCS], "doc_id long, text string, term string, rank int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, df long")
    got = Counter(tuple(r) for r in lexical.top_documents(docs, bench, **options).collect())
    assert got == plain_search(ODD_DOCS, items, options.get("best", 50))
    for a, b in itertools.product((docs, docs.limit(0)), (bench, bench.limit(0))):
        if (a, b) != (docs, bench):
            assert lexical.top_documents(a, b, **options).count() == 0


def test_lexical_stops_and_stays_exact(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 3)
    assert Counter(tuple(r) for r in lexical.top_documents(docs, items, best=3, piece_bytes=50_000, block_items=7).collect()) == want


def piece_of(docs):
    made = lexical.Builder()
    for i, counts in docs:
        made.add(i, counts)
    return lexical.Piece(dict(zip(lexical.FIELDS, made.row(len(docs), sum(c.total() for _, c in docs)), strict=True)))


def test_strata_below_the_best_are_not_visited(monkeypatch):
    docs = [(i, Counter({b"x": 50})) for i in range(60)] + [(100 + i, Counter({b"x": 1, b"y%d" % i: 500})) for i in range(500)]
    part = piece_of(docs)
    seen = []
    bincount = np.bincount
    monkeypatch.setattr(lexical.np, "bincount", lambda d, *a, **k: (seen.append(len(d)), bincount(d, *a, **k))[1])
    found = part.ranked([(part.number[b"x"], 7)], 1, 50, {})
    assert [d for _, d in found] == list(range(50)) and sum(seen) == 60


def test_large_weights_add_as_integers():
    docs = [(i, Counter({b"a": i + 1, b"b": 2})) for i in range(9)]
    part = piece_of(docs)
    weights = [(part.number[b"a"], 2**36 + 1), (part.number[b"b"], 3)]
    tf = [(i + 1, 2) for i in range(9)]
    m = [50 + 50 * (sum(t)) * 9 // 63 for t in tf]
    want = sorted(((sum(w * (10**9 * t // (1000 * t + 20 * m[i])) for (_, w), t in zip(weights, tf[i], strict=True)), i) for i in range(9)), key=lambda x: (-x[0], x[1]))
    assert part.ranked(weights, 1, 9, {}) == want
