"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: those of the base kinds (email, ip, card, phone) and looser ones (spelt-out addresses, phone
numbers without a plus sign, IPv6). Labelers vote on every proposal or abstain: the strict pattern with its checks, a
gazetteer (top-level domains, country codes, card issuers, reserved networks), words before it that speak for or against,
and how it stands in the text. Expectation maximisation over the table of vote patterns (bounded: kinds x 3 ** labelers)
estimates the labelers' reliabilities, and a logistic classifier trained on the posteriors decides about loose spans.
Spans that meet the base definition always stay.

Positions are in code points, ends exclusive.
"""

from pyspark.sql import functions as F

from .storage import stage
from .textops import before, let, most, total, upto
from .weak import expectation_maximisation, logistic, posterior

KINDS = ("email", "ip", "card", "phone")

#: Leftmost matches as the plain patterns find them. A run of characters is entered at its start (or where the last
#: match ended) and not given back, so a long run without a match costs one pass.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])|(?<![0-9A-Za-z+.-])00[1-9][0-9]?(?:[ .-][0-9]{2,4}){3,5}(?![0-9])",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What a text must contain for a pattern to be tried.
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_NEEDS_LOOSE = {"email": "[\\[({]at[\\])}]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f]", "phone": "[0-9][).-] ?[0-9]{3}|00[1-9]"}

LABELERS = ("strict", "gazetteer", "context_for", "context_against", "stands_alone")
_FOR = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|reach|write to",
    "ip": r"\bip\b|host|server|address|adresse|dirección|client|login|logged",
    "card": r"card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit",
    "phone": r"\btel|phone|call|fax|mobil|móvil|handy|telef|téléph|whatsapp|sms|dial",
}
_AGAINST = r"version|\bver\.?$|\bv\.?$|release|section|isbn|order|invoice|serial|sku|article|figure|table|chapter"
_GAZETTEER = {
    "email": r"(?i)(?:\.| dot |\[dot\]|\(dot\)) ?(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ch|at|be|nl|example|test)$",
    "ip": r"^(?!0\.|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)",
    "phone": r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}


def _spans(text, pattern, needs, build):
    """Matches of ``pattern`` as an array: ``build(match)`` of each, a match being a struct of hit, start, end, and what
    stands before it (up to 24 characters, back to the beginning of the match before) and after it (one character).
    Empty where ``needs`` isn't in the text. Context comes from the pieces between matches, not from the text by position."""
    hits, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<hit:string,start:int,end:int,before:string,after:string>>)")

    def walk(p):
        hit, gap = (lambda i: F.get(p["hits"], i)), (lambda i: F.get(p["gaps"], i))
        steps = F.transform(upto(F.size(p["hits"])), lambda i: F.length(gap(i)) + F.length(hit(i)))

        def match(at, i):
            start = at + F.length(gap(i))
            last = F.concat(F.right(F.coalesce(hit(i - 1), F.lit("")), F.lit(24)), F.right(gap(i), F.lit(24)))
            ahead = F.concat(F.left(gap(i + 1), F.lit(1)), F.left(F.coalesce(hit(i + 1), F.lit("")), F.lit(1)))
            return F.struct(hit(i).alias("hit"), start.alias("start"), (start + F.length(hit(i))).alias("end"), F.right(last, F.lit(24)).alias("before"), F.left(ahead, F.lit(1)).alias("after"))

        return F.transform(before(steps, total), match)

    found = let(F.struct(hits.alias("hits"), between.alias("gaps")), lambda p: F.when(F.size(p["hits"]) == 0, none).otherwise(walk(p)))
    return F.transform(F.when(text.rlike(needs), found).otherwise(none), build)


def _valid(kind, hit):
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes, no=None):
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0).cast("int")


def _proposal(kind, strict):
    def build(m):
        before, after = m["before"], m["after"]
        good = _valid(kind, m["hit"]) if strict else F.lit(False)
        votes = {
            "strict": _vote(good, F.lit(strict)),
            "gazetteer": _vote(m["hit"].rlike(_GAZETTEER[kind])),
            "context_for": _vote(before.rlike(f"(?iu)(?:{_FOR[kind]})")),
            "context_against": _vote(F.lit(False), before.rlike(f"(?iu)(?:{_AGAINST})")),
            "stands_alone": _vote(~before.rlike("[\\p{L}\\p{N}_]$") & ~after.rlike("^[\\p{L}\\p{N}_]"), before.rlike("[\\p{L}\\p{N}_]$") | after.rlike("^[\\p{L}\\p{N}_]")),
        }
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), good.alias("base"), *[v.alias(k) for k, v in votes.items()])

    return build


def proposals(text):
    """Array of structs (kind, start, end, base, a vote of each labeler) for a text column; null counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def of(t):
        every = [_spans(t, BASE[k], _NEEDS[k], _proposal(k, True)) for k in KINDS]
        every += [_spans(t, LOOSE[k], _NEEDS_LOOSE[k], _proposal(k, False)) for k in LOOSE]
        return F.concat(*every)

    return of(t)


_START = {
    "strict": {1: {1: 0.85, 0: 0.14, -1: 0.01}, 0: {1: 0.05, 0: 0.35, -1: 0.6}},
    "gazetteer": {1: {1: 0.8, 0: 0.19, -1: 0.01}, 0: {1: 0.3, 0: 0.69, -1: 0.01}},
    "context_for": {1: {1: 0.2, 0: 0.79, -1: 0.01}, 0: {1: 0.04, 0: 0.95, -1: 0.01}},
    "context_against": {1: {1: 0.01, 0: 0.98, -1: 0.01}, 0: {1: 0.01, 0: 0.84, -1: 0.15}},
    "stands_alone": {1: {1: 0.97, 0: 0.01, -1: 0.02}, 0: {1: 0.6, 0: 0.01, -1: 0.39}},
}


def _features(row):
    return {f"{k}={v}": row[k] == v for k in LABELERS for v in (-1, 1)} | {f"kind={k}": row["kind"] == k for k in KINDS}


def fit(spans):
    """Classifier weights from an array column's table: ``spans`` has one column ``spans`` as ``proposals`` gives it."""
    table = spans.select(F.explode("spans").alias("s")).select("s.kind", *[f"s.{k}" for k in LABELERS]).groupBy("kind", *LABELERS).agg(F.count("*").alias("n"))
    patterns = sorted((r.asDict() for r in table.collect()), key=lambda r: tuple(r.values()))  # at most kinds x 3 ** labelers rows
    model = expectation_maximisation(patterns, _START, 0.5, {1: 0.2, 0: 0.2})
    rows = [_features(p) | {"n": p["n"], "p": posterior(p, model)} for p in patterns]
    if not rows:  # nothing was proposed: decide as the labelers' start would
        rows = [_features(p) | {"n": 1, "p": posterior(p, model)} for k in KINDS for a in (-1, 0, 1) for b in (0, 1) for c in (0, 1) for p in [{"kind": k, "strict": a, "gazetteer": b, "context_for": c, "context_against": 0, "stands_alone": 1}]]
    return logistic(rows, [f for f in rows[0] if f not in ("n", "p")], lambda r: r["p"])


def accept(spans, weights):
    """Of an array of proposals: base spans, and loose ones that the classifier accepts and that overlap no base span."""

    def p(s):
        z = F.lit(weights["bias"])
        for k in LABELERS:
            z = z + F.when(s[k] == 1, weights[f"{k}=1"]).when(s[k] == -1, weights[f"{k}=-1"]).otherwise(0.0)
        for k in KINDS:
            z = z + F.when(s["kind"] == k, weights[f"kind={k}"]).otherwise(0.0)
        return z > 0

    def free(every):
        """Of base spans and accepted loose ones by start: all base ones, and loose ones that begin where no base span
        from before goes on and end before the next one begins."""
        ends = F.transform(every, lambda s: F.when(s["base"], s["end"]).otherwise(0))
        ahead = F.transform(F.reverse(every), lambda s: F.when(s["base"], -s["start"] - 1).otherwise(-(2**31) + 1))
        least = lambda x: F.coalesce(F.array_max(x), F.lit(-(2**31) + 1))

        def kept(p):
            apart = lambda s, i: (F.get(p["ends"], i) <= s["start"]) & (-F.get(p["next"], F.size(every) - 1 - i) - 1 >= s["end"])
            return F.filter(every, lambda s, i: s["base"] | apart(s, i))

        return let(F.struct(before(ends, most).alias("ends"), before(ahead, least).alias("next")), kept)

    def chosen(every):
        base, more = F.filter(every, lambda s: s["base"]), F.filter(every, lambda s: (s["strict"] == 0) & p(s))
        by_start = lambda x: F.array_sort(F.transform(x, lambda s: F.struct(s["start"].alias("at"), (-s["end"]).alias("to"), s.alias("s"))))
        every = lambda q: F.concat(q["base"], F.filter(let(F.transform(by_start(F.concat(q["base"], q["more"])), lambda x: x["s"]), free), lambda s: ~s["base"]))
        both = lambda q: F.when((F.size(q["base"]) == 0) | (F.size(q["more"]) == 0), F.concat(q["base"], q["more"])).otherwise(every(q))
        return let(F.struct(base.alias("base"), more.alias("more")), both)

    return F.when(F.size(spans) == 0, spans).otherwise(let(spans, chosen))


def find(docs, key="doc_id", text="text"):
    """(key, spans): all accepted spans of each row's whole text, array of (kind, start, end, base, votes).

    Null and empty texts have none; null keys and repeated rows stay rows; other columns take no part.
    """
    held = stage(docs.select(F.col(key), proposals(F.col(text)).alias("spans")), "spans")
    return held.withColumn("spans", accept(F.col("spans"), fit(held.select("spans"))))


def mask(docs, text="text"):
    """``docs``, same columns, with every accepted span of ``text`` replaced by its kind in brackets. Null stays null.

    Spans that overlap are replaced as one, by the kind of the first to begin, then the longest. Repeated rows are masked each; other columns
    stay as they are. The texts are read twice (once to learn the labelers' reliabilities) and never shuffled.
    """
    every = proposals(F.col(text))
    weights = fit(docs.select(every.alias("spans")))
    size = 4096
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def piece(blocks, a, b):
        """The characters from a to b, gathered from the blocks they lie in."""
        part = lambda j: F.substring(F.get(blocks, j), F.greatest(a - j * size, F.lit(0)) + 1, F.least(b, (j + 1) * size) - F.greatest(a, j * size))
        first = (a / size).cast("int")
        return F.when(b > a, F.array_join(F.transform(upto(((b - 1) / size).cast("int") - first + 1), lambda i: part(i + first)), "")).otherwise("")

    def rebuilt(p):
        spans = p["spans"]
        cut = lambda x: F.concat(piece(p["blocks"], x["done"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.concat(F.array_join(F.transform(spans, cut), ""), piece(p["blocks"], p["last"], F.length(F.col(text))))

    order = lambda s: F.array_sort(F.transform(s, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), x["end"].alias("end"), x["kind"].alias("kind"))))
    told = lambda o: lambda e: F.transform(o, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.get(e, i).alias("done")))
    apart = lambda o: F.filter(let(before(F.transform(o, lambda x: x["end"]), most), told(o)), lambda x: x["start"] >= x["done"])
    done = lambda s: let(F.struct(blocks.alias("blocks"), let(order(s), apart).alias("spans"), F.array_max(F.transform(s, lambda x: x["end"])).alias("last")), rebuilt)
    return docs.withColumn(text, let(accept(every, weights), lambda s: F.when(F.size(s) > 0, done(s)).otherwise(F.col(text))))


def _joined(spans, keep):
    """kind:start:end of the spans, by kind as listed, then start, joined by commas."""
    parts = []
    for k in KINDS:
        mine = F.filter(spans, lambda s: (s["kind"] == k) & (s["base"] if keep else F.lit(True)))
        parts.append(F.transform(F.array_sort(F.transform(mine, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b")))), lambda x: F.concat(F.lit(f"{k}:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string"))))
    return F.array_join(F.concat(*parts), ",")


def op7_pii(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")

    n = [count(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(_joined(F.col("spans"), True), 256).alias("base_sha256"), _joined(F.col("spans"), False).alias("spans"))
