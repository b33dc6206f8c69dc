"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule looks at one text's figures and votes to keep it, to reject it, or abstains. How often each rule votes which
way for good and for bad texts, and so how accurate it is, is estimated by expectation-maximisation over all documents
that pass the base rule: votes are counted by pattern once (at most 3 to the number of rules rows, whatever the input),
and each round is one small aggregate over the patterns. A text's posterior probability of being good then replaces
all-must-pass filtering.

The figures of a text are computed in place, on arrays of its words; nothing is exploded or shuffled but the pattern
counts. Repeated three-word windows are found by sorting longs that hold 40 bits of a window's hash and its position;
neighbours are compared by the whole 64-bit hash, and a text in which 40 bits do not tell windows apart, or whose places
need more than 24 bits, is sorted anew by hash and position in full.

Defined cases: a null text is empty, and fails the base rule like all texts of under 50 words. Repeated rows are each
judged and counted. With no rows there are no patterns, and all rates stay at their start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import shared

SPACES = " \t\n\x0b\x0c\r"
POSITION_BITS = 24
MIN_WORDS, KEEP_AT = 50, 0.5
ROUNDS, SETTLED = 40, 1e-5
#: Starting rates of keep and reject votes (the rest abstains) for good and for bad texts, and share of good texts.
START = {"good": (0.8, 0.004), "bad": (0.7, 0.12)}
START_SHARE = 0.85
#: The start counts as much as this share of the documents would, so that no rule's rates leave what it is meant to see.
PRIOR = 0.02


def _without(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are not among ``characters``."""
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column, hashes: Column, packed: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text."""
    low = (1 << POSITION_BITS) - 1
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    full = lambda x: F.get(hashes, place(x))
    near = lambda x, other: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(other), POSITION_BITS) == 0, F.lit(False))
    same = lambda x, other: near(x, other) & F.coalesce(full(x) == full(other), F.lit(False))
    found = F.transform(F.filter(packed, lambda x, j: same(x, F.get(packed, j - 1)) | same(x, F.get(packed, j + 1))), place)
    mixed = F.exists(F.filter(F.transform(packed, lambda x, j: near(x, F.get(packed, j + 1)) & ~same(x, F.get(packed, j + 1))), lambda b: b), lambda b: b)
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    other = lambda p, s, j: F.coalesce(F.get(p, j)["h"] == s["h"], F.lit(False))
    twice = lambda p: F.filter(p, lambda s, j: other(p, s, j - 1) | other(p, s, j + 1))
    # The sorted array is bound to a variable, else it would be sorted again for each element.
    slow = F.element_at(F.transform(F.array(pairs), lambda p: F.transform(twice(p), lambda s: s["i"])), 1)
    return F.sort_array(F.when(mixed | (F.size(hashes) > low), slow).otherwise(found))


def figures(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id and the figures of every row of ``docs`` (doc_id, text) that the rules look at; the row itself in ``row`` on demand."""
    spaces = r"[\x20\x09-\x0D]+"
    row = [F.struct(*docs.columns).alias("row")] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row)
    inner = F.btrim("text", F.lit(SPACES))
    rows = rows.withColumn("words", F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, spaces)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0))
    n = F.size("words")
    rows = rows.select(
        "doc_id", *(["row"] if keep else []), "words", n.cast("long").alias("n_words"),
        _without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size(F.split("text", r"[#*$%&|<>]+")) - 1).cast("long").alias("n_symbol_runs"),
        F.size(F.filter(F.array(*[F.contains("text", F.lit(c)) for c in "#*$%&|<>"]), lambda b: b)).cast("long").alias("symbol_kinds"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))).cast("long").alias("n_marks"),
        (F.length("text") - _without(F.col("text"), "!?")).cast("long").alias("n_shouts"),
        (F.length("text") - _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "0123456789")).cast("long").alias("n_digits"),
        (F.length("text") - _without(F.col("text"), ".")).cast("long").alias("n_stops"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    high = ~((1 << POSITION_BITS) - 1)
    rows = rows.withColumn("packed", F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long")))))
    rows = rows.withColumn("at", _repeat_words(F.col("words"), F.col("hashes"), F.col("packed")))
    covered = F.aggregate(
        "at", F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("words", "hashes", "packed", "at")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 keep, -1 reject, 0 abstain. Without a word every rule on words abstains."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    vote = lambda reject, keep: F.when(F.col("n_words") == 0, 0).when(reject, -1).when(keep, 1).otherwise(0)
    share = lambda name, of: F.col(name) / of
    return {
        "length": vote(F.col("n_words") < MIN_WORDS, F.lit(True)),
        "word_length": vote((mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 10)),
        "symbols": vote(share("n_symbols", words) > 0.1, share("n_symbols", words) <= 0.02),
        "symbol_runs": vote(share("n_symbol_runs", words) > 0.08, share("n_symbol_runs", words) <= 0.02),
        "symbol_kinds": vote(F.col("symbol_kinds") >= 4, F.col("symbol_kinds") <= 1),
        "marks": vote(share("n_marks", words) > 0.4, share("n_marks", words) <= 0.3),
        "lines": vote(share("n_dup_lines", lines) > 0.5, share("n_dup_lines", lines) <= 0.05),
        "repeats": vote(share("n_repeat_words", words) > 0.35, share("n_repeat_words", words) <= 0.15),
        "shouts": vote(share("n_shouts", words) > 0.2, share("n_shouts", words) <= 0.05),
        "capitals": vote(share("n_capitals", F.greatest(F.col("word_chars"), F.lit(1))) > 0.4, share("n_capitals", F.greatest(F.col("word_chars"), F.lit(1))) <= 0.1),
        "distinct": vote((F.col("n_words") < 1000) & (share("n_distinct", words) < 0.25), share("n_distinct", words) >= 0.4),
        "stops": vote(F.lit(False), F.col("n_stops") * 60 >= F.col("n_words")),
    }


def posterior(model: dict) -> Column:
    """Probability of a good text given its votes (columns named ``v_<rule>``)."""
    odds = F.lit(math.log(model["share"] / (1 - model["share"])))
    for name, rates in model["rules"].items():
        (gk, gr), (bk, br) = rates["good"], rates["bad"]
        v = F.col(f"v_{name}")
        ratio = F.when(v == 1, F.lit(math.log(gk / bk))).when(v == -1, F.lit(math.log(gr / br)))
        odds = odds + ratio.otherwise(F.lit(math.log((1 - gk - gr) / (1 - bk - br))))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, names: list[str], *, rounds: int = ROUNDS, settled: float = SETTLED) -> dict:
    """Share of good texts and each rule's voting rates on good and on bad ones, from counted vote patterns (``n``)."""
    model = {"share": START_SHARE, "rules": {x: dict(START) for x in names}}
    for _ in range(rounds):
        weighed = patterns.withColumn("good", F.col("n") * posterior(model)).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
        sums += [F.sum(F.when(F.col(f"v_{x}") == v, F.col(c)).otherwise(0.0)).alias(f"{x}{v}{c}") for x in names for v in (1, -1) for c in ("good", "bad")]
        s = weighed.agg(*sums).first()
        if not s["n"]:
            break
        prior = PRIOR * s["n"] + 1
        rate = lambda x, v, c: (s[f"{x}{v}{c}"] + prior * START[c][v == -1]) / (s[c] + prior)  # noqa: B023, E731
        new = {"share": (s["good"] + prior * START_SHARE) / (s["n"] + prior), "rules": {x: {c: (rate(x, 1, c), rate(x, -1, c)) for c in START} for x in names}}
        flat = lambda m: [m["share"], *(r for x in names for c in START for r in m["rules"][x][c])]
        moved = max(abs(a - b) for a, b in zip(flat(new), flat(model), strict=True))
        model = new
        if moved < settled:
            break
    return model


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(found: DataFrame) -> dict:
    """The rates that the votes on these figures, of all texts that pass the base rule, give by themselves."""
    rules = votes()
    voted = found.where(~base_failed()).select(*[v.alias(f"v_{k}") for k, v in rules.items()])
    counted = voted.groupBy(*voted.columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return estimate(shared.materialize(counted.coalesce(1), "patterns"), list(rules))


def verdict(found: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """Adds posterior, base_failed and kept to figures."""
    rules = votes()
    judged = found.withColumns({f"v_{k}": v for k, v in rules.items()}).withColumn("posterior", posterior(model)).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).drop(*[f"v_{k}" for k in rules])


def judge(docs: DataFrame, *, keep_at: float = KEEP_AT) -> DataFrame:
    """Figures, base_failed, posterior and kept of every row of ``docs`` (doc_id, text)."""
    found = shared.materialize(figures(docs), "figures")
    return verdict(found, learn(found), keep_at)


def keep_good(docs: DataFrame, *, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; they are written once beside their figures."""
    found = shared.materialize(figures(docs, keep=True), "figures")
    return verdict(found, learn(found), keep_at).where("kept").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(shared.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
