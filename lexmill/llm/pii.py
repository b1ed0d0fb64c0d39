"""Personal data by weak supervision.

Candidates are what the base patterns find plus looser ones (card numbers whose check digit is wrong,
phone numbers without a plus). Regex, gazetteer, context and shape labelers vote on each; EM estimates how
reliable they are; a logistic span classifier learns from the posteriors and decides on the candidates that
the base rules don't already hold to be personal data. Base spans always stay.

DataFrame functions only. Starts of matches come from the lengths of the pieces between them, so a row is
handled inside itself; the driver sees only counts of vote patterns (4 kinds times 3^5).

Patterns are the leftmost non-overlapping ones of the contract. Possessive quantifiers and look-behinds that
only rule out starts inside a run keep them linear on very long runs without changing any match.

Null or empty text: no spans. Null ids are kept. Repeated rows: each by itself. Very long texts are read whole. Other columns
don't matter, whatever their names; mask() keeps them. Empty table: empty result. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import staging, weak_labels

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national": r"(?<![0-9+(])(?<![0-9][\x20().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: A cheap test that a text can hold a match at all.
HINTS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+")}
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
_CUES = {
    "email": r"(?i)e-?mail|contact|write|reach|mail",
    "ip": r"(?i)\bip\b|address|host|server|login|client",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|account",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact|dial",
}
_COUNTER_CUES = r"(?i)version|isbn|order|invoice|serial|build|sku|ticket"
_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35)"
_CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>>: start, end and string of each match."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.lit(None).cast("array<struct<s:int,e:int,m:string>>")
    both = F.zip_with(found, F.slice(parts, 1, F.greatest(F.size(found), F.lit(1))), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<s:int,e:int,m:string>>")).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc.at + F.coalesce(F.length(x.p), F.lit(0))
        e = s + F.length(x.m)
        return F.struct(e.alias("at"), F.concat(acc.out, F.array(F.struct(s.alias("s"), e.alias("e"), x.m.alias("m")))).alias("out"))

    return F.aggregate(F.filter(both, lambda x: x.m.isNotNull()), start, step, lambda acc: acc.out)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, is a multiple of 10."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def _judged(kind: str, text: Column, pattern: str) -> Column:
    """Matches with base (passes the contract's test) and the labelers' votes."""
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)

    def one(x: Column) -> Column:
        m, digits = x.m, F.regexp_replace(x.m, "[^0-9]", "")
        n = F.length(digits)
        before = F.substring(text, F.greatest(x.s - 39, F.lit(1)), F.least(x.s, F.lit(40)))
        base = {
            "email": F.lit(True),
            "ip": F.forall(F.split(m, r"\."), lambda p: p.rlike(_BYTE)),
            "card": F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False),
            "phone": (n >= 9) & (n <= 15) & m.startswith("+"),
        }[kind]
        gazetteer = {
            "email": vote(m.rlike(_DOMAINS), never),
            "ip": vote(never, m.rlike(r"^(?:0|127|255)\.")),
            "card": vote(m.rlike(_ISSUERS), ~m.rlike(_ISSUERS)),
            "phone": vote(m.rlike(_CALLING), m.startswith("+") & ~m.rlike(_CALLING)),
        }[kind]
        shape = {
            "email": vote(m.rlike(r"@[^@]*\.[A-Za-z]{2,}$"), ~m.rlike(r"[A-Za-z]{2,}$")),
            "ip": vote(F.length(m) >= 9, never),
            "card": vote((n >= 15) & (n <= 16), (n < 13) | (n > 19)),
            "phone": vote((n >= 10) & (n <= 13), (n < 9) | (n > 15)),
        }[kind]
        context = vote(before.rlike(_CUES[kind]), before.rlike(_COUNTER_CUES))
        apart = (F.substring(before, -1, 1).rlike("^[^A-Za-z0-9]?$")) & (F.substring(text, x.e + 1, 1).rlike("^[^A-Za-z0-9]?$"))
        return F.struct(
            F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"), base.alias("base"),
            vote(base, ~base).alias("v0"), gazetteer.alias("v1"), context.alias("v2"), shape.alias("v3"), vote(apart, ~apart).alias("v4"),
        )

    return F.transform(_matches(text, pattern), one)


_TYPE = "array<struct<kind:string,s:int,e:int,base:boolean,v0:int,v1:int,v2:int,v3:int,v4:int>>"
_VOTES = [f"v{j}" for j in range(5)]


def candidates(text: Column) -> Column:
    """All candidates of a text, by kind, then start."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(_TYPE)
    found = []
    for name, pattern in PATTERNS.items():
        kind = "phone" if name == "national" else name
        hint = HINTS.get(name, lambda x: x.rlike("[0-9]"))(t) & t.rlike(pattern)
        found.append(F.when(hint, _judged(kind, t, pattern).cast(_TYPE)).otherwise(none))
    return F.concat(*found)


class SpanClassifier:
    """Weights of a logistic model over kind and votes; decides as a column expression."""

    def __init__(self, weights: tuple[float, ...]):
        self.weights = weights

    @staticmethod
    def features(kind: str, votes: list[int]) -> list[float]:
        return [float(kind == k) for k in KINDS] + [float(v == s) for v in votes for s in (1, -1)]

    def accepts(self, c: Column) -> Column:
        if not self.weights:
            return c.base
        *w, bias = self.weights
        z = F.lit(bias)
        for k, x in zip(KINDS, w, strict=False):
            z = z + F.when(c.kind == k, F.lit(x)).otherwise(F.lit(0.0))
        for j, name in enumerate(_VOTES):
            yes, no = w[len(KINDS) + 2 * j : len(KINDS) + 2 * j + 2]
            z = z + F.when(c[name] > 0, F.lit(yes)).when(c[name] < 0, F.lit(no)).otherwise(F.lit(0.0))
        return c.base | (z >= 0)


def fit(found: DataFrame) -> SpanClassifier:
    """found: a column `c` of candidates. EM over all of them, then the classifier on its posteriors."""
    counts = found.select(F.explode("c").alias("x")).groupBy("x.kind", *[F.col(f"x.{v}") for v in _VOTES]).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r["kind"], [r[v] for v in _VOTES], float(r["n"])) for r in counts)
    soft: list[tuple[list[float], float, float]] = []
    for kind in KINDS:  # a labeler is not as good on each kind
        own = [(v, n) for k, v, n in rows if k == kind]
        model = weak_labels.fit(own, prior=0.6, hit=0.8, miss=0.2)
        soft += [(SpanClassifier.features(kind, v), model.posterior(v), n) for v, n in own]
    return SpanClassifier(weak_labels.fit_logistic(soft))


def accepted(c: Column, model: SpanClassifier) -> Column:
    """Base spans and accepted further ones; of the latter none that overlaps a base span of its kind."""
    base = F.filter(c, lambda x: x.base)
    more = F.filter(c, lambda x: ~x.base & model.accepts(x) & ~F.exists(base, lambda b: (b.kind == x.kind) & (b.s < x.e) & (x.s < b.e)))
    return F.when(F.size(more) == 0, base).otherwise(F.concat(base, more))


def _listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    of = lambda k: F.transform(F.sort_array(F.transform(F.filter(spans, lambda x: x.kind == k), lambda x: F.struct(x.s, x.e))), lambda x: F.concat_ws(":", F.lit(k), x.s, x.e))
    return F.when(F.size(spans) == 0, F.lit("")).otherwise(F.array_join(F.concat(*[of(k) for k in KINDS]), ","))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans."""
    rows = staging.stage(docs.select("doc_id", candidates(F.col("text")).alias("c")), "pii")
    model = fit(rows)
    base = F.filter("c", lambda x: x.base)
    n = lambda k: F.size(F.filter("c", lambda x: x.base & (x.kind == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[n(k) for k in KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(accepted(F.col("c"), model)).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The same columns; every span of text replaced by its kind in brackets, overlapping spans by one; n_chars follows."""
    model = fit(staging.stage(docs.select(candidates(F.col("text")).alias("c")), "pii"))
    c = staging.free_name(docs, "spans")
    df = docs.withColumn(c, accepted(candidates(F.col("text")), model))
    spans = F.sort_array(F.transform(c, lambda x: F.struct(x.s.alias("s"), (-x.e).alias("e"), F.upper(x.kind).alias("k"))))
    masked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x.s >= a.at, F.struct((-x.e).alias("at"), F.concat(a.out, F.col("text").substr(a.at + 1, x.s - a.at), F.lit("["), x.k, F.lit("]")).alias("out"))
        ).otherwise(F.struct(F.greatest(a.at, -x.e).alias("at"), a.out.alias("out"))),
        lambda a: F.concat(a.out, F.col("text").substr(a.at + 1, F.length("text"))),
    )
    df = df.withColumn("text", F.when(F.size(c) == 0, F.col("text")).otherwise(masked)).drop(c)
    return df.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else df


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
