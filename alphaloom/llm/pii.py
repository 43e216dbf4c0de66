"""Personal data by weak supervision (DataFrame functions only).

Patterns propose spans. For each span five labelers vote yes, no or abstain: a format
check, a gazetteer (top-level domains, issuer and country prefixes, names of keys), the
words before it, its edges, and the variety of its characters. Equal votes and features
collapse to counts, at most 3^5 * 2^5 per kind whatever the data, so the statistics cover
every span of the corpus. Expectation-maximisation estimates, per kind, how often each
labeler says what about true and false spans; the posteriors are the soft labels on which
a logistic span classifier is trained. Both run as higher-order SQL functions over the one
row of counts of a kind.

The four base kinds with their fixed rules always stay; the classifier adds spans of the
other kinds (and base-kind spans never vanish). Spans are code points, end exclusive.

Defined results: NULL and empty texts have no spans. Each row of repeated rows gets its
own equal result. Other columns are carried; `spans` and `counts` replace columns of those
names. Empty tables give no rows and a model without kinds, which adds nothing.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import let

# --- fixed values: patterns, gazetteers and trigger words ---
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Possessive and anchored at the start of a run, so that long runs cost linear time; the
#: matches are those of the plain patterns. Card runs of other lengths fail anyway.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Za-z]{24,}+",
    "local_phone": r"(?<![0-9+(] ?)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Texts without this can't hold the kind (all digits patterns need a digit).
NEEDS = {"email": "@", "phone": "+"}
GAZETTEER = {
    "email": r"\.(?i:com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)",
    "phone": r"^\+(?:1|2[07]|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])",
    "secret": r"",
    "local_phone": r"^\(?[2-9]",
}
TRIGGERS = {
    "email": r"(?i)(?:mail|contact|write to|reach)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|from)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|credit|payment|konto|carte|tarjeta)\W*\w*\W*$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*\w*\W*$",
    "secret": r"(?i)(?:token|secret|key|passw(?:or)?d|auth|bearer)\W*$",
    "local_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)\W*\w*\W*$",
}
REFUTERS = r"(?i)(?:version|order|isbn|invoice|sku|build|release|figure|commit|sha1?|md5)\W*$"
FORMAT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$",
    "card": r"",
    "phone": r"^\+[0-9]{1,3}[ .(-]",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]+|[0-9A-F]+|[0-9A-Za-z]+)$",
    "local_phone": r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^([0-9]{3})([ .-])[0-9]{3}\2[0-9]{4}$",
}
# --- end of fixed values ---

LABELERS = 5
FEATURES = 5
SMOOTH = 1.0


def _found(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches with places and surroundings, in order."""
    pattern = F.lit(PATTERNS[kind])
    none = F.array().cast("array<struct<start:int,end:int,m:string,left:string,right:string>>")

    def placed(m: Column) -> Column:
        def with_gaps(gap: Column) -> Column:
            ends = F.aggregate(
                F.sequence(F.lit(0), F.size(m) - 1), F.array().cast("array<int>"),
                lambda acc, i: F.array_append(
                    acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(F.get(gap, i)) + F.length(F.get(m, i))
                ),
            )
            return let(ends, lambda e: F.transform(m, lambda x, i: F.struct(
                (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("m"),
                F.right(F.get(gap, i), F.lit(32)).alias("left"), F.left(F.get(gap, i + 1), F.lit(4)).alias("right"),
            )))

        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), with_gaps))

    found = let(F.regexp_extract_all(text, pattern, 0), placed)
    return F.when(text.contains(NEEDS[kind]), found).otherwise(none) if kind in NEEDS else found


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column) -> Column:
    """TRUE if the digits of m pass the Luhn check."""

    def total(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            return F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0

    return let(F.reverse(_digits(m)), total)


def _valid(kind: str, m: Column) -> Column:
    """The fixed rules of the base kinds; other kinds propose all matches."""
    if kind == "ip":
        return m.rlike(FORMAT["ip"])
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, c: Column) -> Column:
    """Five votes (2 yes, 0 no, 1 abstain) as digits of a number to the base 3."""
    m, left, right = c["m"], c["left"], c["right"]

    def vote(yes: Column, no: Column) -> Column:
        return F.when(no, 0).when(yes, 2).otherwise(1)

    proper = luhn(m) if kind == "card" else m.rlike(FORMAT[kind])
    known = m.rlike(GAZETTEER[kind]) if kind != "secret" else left.rlike(TRIGGERS[kind])
    alone = (left == "") | left.rlike(r"[\s(\[{\"'<:=]$")
    ended = (right == "") | right.rlike(r"^[\s)\]}\"'>.,;:!?*#$%&|]")
    kinds_of = let(F.lower(F.regexp_replace(m, "[^0-9A-Za-z]+", "")), lambda s: F.size(F.array_distinct(F.split(s, ""))))
    votes = (
        vote(proper, ~proper), vote(known, ~known), vote(left.rlike(TRIGGERS[kind]), left.rlike(REFUTERS)),
        vote(alone & ended, ~(alone & ended)), vote(kinds_of >= 5, kinds_of <= 2),
    )
    number = votes[0]
    for k, v in enumerate(votes[1:], 1):
        number = number + v * 3**k
    return number


def _features(c: Column) -> Column:
    """Five yes-or-no features as bits."""
    m = c["m"]
    features = (
        F.length(m) >= 20, m.rlike("[A-Za-z]"), m.rlike("[^0-9A-Za-z]"), c["left"].rlike(r"[=:\"']\s*$"), c["left"].rlike(r"(?:^|\n)\s*$"),
    )
    number = F.lit(0)
    for k, f in enumerate(features):
        number = number + F.when(f, 1 << k).otherwise(0)
    return number


def candidates(text: Column) -> dict[str, Column]:
    """Per kind an array of (start, end, votes, features)."""
    return {
        kind: F.transform(
            F.filter(_found(text, kind), lambda c: _valid(kind, c["m"])),
            lambda c: F.struct(c["start"], c["end"], _votes(kind, c).alias("votes"), _features(c).alias("features")),
        )
        for kind in KINDS
    }


def _text(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


@dataclass(frozen=True)
class Model:
    """Per kind: labeler reliabilities (vote given the truth) and classifier weights."""
    reliability: dict[str, list[float]]
    weights: dict[str, list[float]]


def _votes_of(x: Column, k: int) -> Column:
    return F.floor(x["votes"] / 3**k).cast("int") % 3


def _inputs(votes: Column, features: Column) -> list[Column]:
    """Classifier inputs: 1, the votes as -1, 0, 1, and the features."""
    v = [(F.floor(votes / 3**k).cast("int") % 3 - 1).cast("double") for k in range(LABELERS)]
    f = [F.when(features.bitwiseAND(1 << k) != 0, 1.0).otherwise(0.0) for k in range(FEATURES)]
    return [F.lit(1.0), *v, *f]


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _sum(rows: Column, term) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, x: acc + term(x))


def fit(docs: DataFrame, text: str = "text", em_steps: int = 15, train_steps: int = 40) -> Model:
    """Count vote patterns over all texts, run EM, train the classifier; one row per kind returns."""
    found = candidates(_text(docs, text))
    each = F.flatten(F.array(*[
        F.transform(found[k], lambda c: F.struct(F.lit(k).alias("kind"), c["votes"].alias("votes"), c["features"].alias("features")))
        for k in KINDS
    ]))
    # explode_outer, since the filter that explode implies would search the texts twice
    counts = docs.select(F.explode_outer(each).alias("c")).where("c IS NOT NULL").groupBy("c.kind", "c.votes", "c.features").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    kinds = counts.groupBy("kind").agg(
        F.sort_array(F.collect_list(F.struct("votes", "features", "n"))).alias("rows")  # 3^5 * 2^5 at most
    )
    # EM. The parameters are one array: prior, then P(vote = v | truth y) at 1 + 6 k + 3 y + v.
    share = {0: (0.6, 0.25, 0.15), 1: (0.15, 0.25, 0.6)}
    start = F.array(F.lit(0.5), *[F.lit(share[y][v]) for _ in range(LABELERS) for y in (0, 1) for v in range(3)])

    def posterior(p: Column, x: Column) -> Column:
        def weight(y: int) -> Column:
            w = F.get(p, F.lit(0)) if y else 1.0 - F.get(p, F.lit(0))
            for k in range(LABELERS):
                w = w * F.get(p, F.lit(1 + 6 * k + 3 * y) + _votes_of(x, k))
            return w

        return let(F.struct(weight(1).alias("a"), weight(0).alias("b")), lambda s: s["a"] / (s["a"] + s["b"]))

    def with_posterior(p: Column) -> Column:
        return F.transform("rows", lambda x: F.struct(
            x["votes"].alias("votes"), x["features"].alias("features"), x["n"].alias("n"), posterior(p, x).alias("q")))

    def em(p: Column, _: Column) -> Column:
        def update(rows: Column) -> Column:
            total = _sum(rows, lambda x: x["n"])
            ones = _sum(rows, lambda x: x["n"] * x["q"])
            out = [(ones + SMOOTH) / (total + 2 * SMOOTH)]
            for k in range(LABELERS):
                for y in (0, 1):
                    def belongs(x: Column) -> Column:
                        return x["n"] * (x["q"] if y else 1.0 - x["q"])
                    whole = ones if y else total - ones
                    for v in range(3):
                        part = _sum(rows, lambda x: F.when(_votes_of(x, k) == v, belongs(x)).otherwise(0.0))
                        out.append((part + SMOOTH * share[y][v]) / (whole + SMOOTH))
            return F.array(*out)

        return let(with_posterior(p), update)

    steps = kinds.select("kind", "rows", F.aggregate(F.sequence(F.lit(1), F.lit(em_steps)), start, em).alias("p"))
    soft = steps.select("kind", "p", with_posterior(F.col("p")).alias("soft"))
    # logistic regression on the soft labels by damped gradient steps with per-input scale
    size = 1 + LABELERS + FEATURES

    def descend(w: Column, _: Column) -> Column:
        def gradient(rows: Column) -> Column:
            total = _sum(rows, lambda x: x["n"])
            return F.array(*[
                F.get(w, F.lit(j)) + 2.0 * (_sum(rows, lambda x: x["n"] * x["e"] * F.get(x["z"], F.lit(j))) / total
                                            - 0.001 * F.get(w, F.lit(j)))
                for j in range(size)
            ])

        def error(x: Column) -> Column:
            def inner(z: Column) -> Column:
                dot = F.get(w, F.lit(0))
                for j in range(1, size):
                    dot = dot + F.get(w, F.lit(j)) * F.get(z, F.lit(j))
                return F.struct(x["n"].alias("n"), z.alias("z"), (x["q"] - _sigmoid(dot)).alias("e"))

            return let(F.array(*_inputs(x["votes"], x["features"])), inner)

        return let(F.transform("soft", error), gradient)

    zero = F.array(*[F.lit(0.0)] * size)
    done = soft.select("kind", "p", F.aggregate(F.sequence(F.lit(1), F.lit(train_steps)), zero, descend).alias("w")).collect()
    return Model({r["kind"]: r["p"] for r in done}, {r["kind"]: r["w"] for r in done})


def detected(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input's columns, `spans` (kind, start, end; by kind, then start) and `counts` per base kind."""
    found = candidates(_text(docs, text))
    spans = {}
    for kind in KINDS:
        w = model.weights.get(kind)
        rows = found[kind]
        if kind not in BASE:
            if w is None:
                continue

            def likely(c: Column) -> Column:
                score = F.lit(0.0)
                for a, z in zip(w, _inputs(c["votes"], c["features"]), strict=True):
                    score = score + F.lit(a) * z
                return score >= 0.0

            rows = F.filter(rows, likely)
        spans[kind] = F.transform(
            rows, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        )
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("spans", "counts")]
    counts = F.col("spans")
    full = docs.select(*kept, F.flatten(F.array(*spans.values())).alias("spans"))
    return full.withColumn("counts", F.struct(*[
        F.size(F.filter(counts, lambda c: c["kind"] == k)).cast("bigint").alias(k) for k in BASE
    ]))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")
