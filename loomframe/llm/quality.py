"""Quality rules by weak supervision.

Each rule looks at a few counts of a document and votes good (1), bad (-1) or abstains (0). Expectation maximisation
over the table of vote patterns (at most 3 ** rules rows, however large the corpus) estimates how each rule votes on
good and on bad documents; the posterior probability of "good" then decides, in place of "every rule must pass".
Only DataFrame functions touch the documents; the text is read once, and its counts (a few numbers a document) are
written before the second step.
"""

import math

from pyspark.sql import functions as F

from .storage import fresh, stage
from .textops import SPACES, let, upto, words
from .weak import expectation_maximisation, log_odds

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shout")

#: name -> (bad if, good if); neither: abstain. What merely lacks a fault is no evidence of quality, so rules that look
#: for a fault vote bad or abstain; the two that know what prose looks like may vote good.
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "word_length": ("word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3.2 * n_words AND 9 * n_words"),
    "symbols": ("n_symbols > 0.1 * n_words", "false"),
    "dup_lines": ("n_dup_lines > 0.4 * n_lines", "false"),
    "repeats": ("n_repeat_words > 0.4 * n_words", "false"),
    "upper_case": ("n_upper > 0.5 * n_letters", "false"),
    "shouting": ("n_shout > 0.1 * n_words", "false"),
}
#: Where expectation maximisation starts: class -> vote -> probability, for rules that only find faults, and for the others.
START = {False: {1: {-1: 0.005, 0: 0.985, 1: 0.01}, 0: {-1: 0.25, 0: 0.74, 1: 0.01}}, True: {1: {-1: 0.02, 0: 0.08, 1: 0.9}, 0: {-1: 0.2, 0: 0.2, 1: 0.6}}}


def _repeat_words(h):
    """Positions covered by 3-word windows that occur twice or more, of an array of word hashes."""

    def covered(keys):
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s):
            same = lambda k, j: F.coalesce(F.get(s, j)["k"] == F.get(s, k)["k"], F.lit(False))
            hit = F.filter(upto(F.size(s)), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(hit, lambda k: F.get(s, k)["i"]))

        width = lambda p: F.aggregate(upto(F.size(p)), F.lit(0).cast("long"), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))))
        return let(pairs, lambda s: let(starts(s), width))

    windows = F.transform(upto(F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    return let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(covered(k)))


def counts(docs, text="text"):
    """``docs`` with one struct column of counts (see COUNTS); a null text counts as empty.

    Returns (DataFrame, name of the struct column). Windows are compared by 64-bit hashes of word hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    n = fresh("_q", docs.columns)
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    stats = let(
        F.transform(words(F.col(text)), lambda w: F.xxhash64(w)),
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _repeat_words(h).alias("n_repeat_words")),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    a, b = fresh("_a", docs.columns), fresh("_b", docs.columns)
    out = docs.withColumns({a: stats, b: by_line})
    return out.withColumn(
        n,
        F.struct(
            F.col(f"{a}.n_words"),
            F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
            less("[#*$%&|<>]").cast("long").alias("n_symbols"),
            F.col(f"{b}.n_dup_lines"),
            F.col(f"{a}.n_repeat_words"),
            F.col(f"{b}.n_lines"),
            less("\\p{Lu}+").cast("long").alias("n_upper"),
            less("\\p{L}+").cast("long").alias("n_letters"),
            less("!+").cast("long").alias("n_shout"),
        ),
    ).drop(a, b), n


def votes(rules=RULES):
    """One small integer column a rule, over columns named as in COUNTS."""
    return [F.when(F.expr(f"n_words > 0 AND ({bad})") | (F.expr("n_words = 0") if name == "length" else F.lit(False)), F.lit(-1)).when(F.expr(f"n_words > 0 AND ({good})"), F.lit(1)).otherwise(F.lit(0)).alias(name) for name, (bad, good) in rules.items()]


def fit(patterns, rules=RULES, prior_good=0.8):
    """The reliabilities of the rules from (votes..., n) rows.

    On good documents the start is held fast (a hundred times the corpus of pseudo-counts): a fault is rare in good
    text by assumption, else the two classes would settle on whichever faults occur together most often and call the
    other faults good. On bad documents the rules are estimated nearly freely.
    """
    return expectation_maximisation(patterns, {r: START[good != "false"] for r, (_, good) in rules.items()}, prior_good, {1: 100.0, 0: 0.02})


def posterior_column(model):
    z = F.lit(math.log(model["prior"]) - math.log(1 - model["prior"]))
    for r in model["rules"]:
        z = z + F.when(F.col(r) == 1, log_odds(model, r, 1)).when(F.col(r) == -1, log_odds(model, r, -1)).otherwise(log_odds(model, r, 0))
    return 1 / (1 + F.exp(-z))


def score(docs, key="doc_id", text="text", rules=RULES):
    """One row a row of ``docs``: key, the counts, the votes, ``p_good`` and ``base_failed`` and ``kept``.

    Null and empty texts have no words: the length rule votes bad, the others abstain, and the base check fails.
    Repeated rows are scored each. Other columns of ``docs`` take no part.
    """
    found, n = counts(docs.select(F.col(key), F.col(text)), text)
    base = stage(found.select(F.col(key), f"{n}.*"), "counts").select("*", *votes(rules))
    patterns = [r.asDict() for r in base.groupBy(*rules).agg(F.count("*").alias("n")).collect()]  # at most 3 ** rules rows
    model = fit(patterns, rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("p_good", posterior_column(model)).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= 0.5))


def op1_quality_rules(spark, sf_dir):
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
