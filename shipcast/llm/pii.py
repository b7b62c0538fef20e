"""Personal data by weak-supervision aggregation, in DataFrame functions only.

1. One scan of the texts finds, per kind, the base matches and looser
   candidate spans, with the text just before each.
2. Labelers (shape, gazetteer, context, checks, neighbourhood) vote on every
   candidate: for, against or abstain.
3. Candidates are counted by kind and vote pattern; expectation-maximisation
   over those few counts estimates each labeler's reliabilities and a
   posterior per pattern.
4. A logistic span classifier learns the posteriors from what a span and the
   text around it look like, not from the votes, and scores the candidates as
   a column expression.  Accepted candidates that overlap no base span of
   their kind are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcast.llm.common import staged

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that a failed run of characters
#: is tried once (same matches, linear time).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for any match (cheap screen).
SCREEN = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Candidate spans: obfuscated addresses, bare numbers, parts of longer runs.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[\x20-]?){3}[0-9]{2,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_SCREEN = SCREEN | {"email": r"@|[\[(]at[\])]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Words that speak for a kind when they stand just before a candidate.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|account|pay|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell|contact|telefon|t[ée]l[ée]fono?)\b",
}
#: Gazetteers: common top-level domains, private or reserved networks, card
#: issuer beginnings, and dialling prefixes that no subscriber has.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^\+?1?[\x20.-]?\(?[2-9][0-9]{2}",
}
TAIL = 24
LABELERS = ("shape", "gazetteer", "context", "checks", "neighbour")
#: Probability of a vote against, none and for, on real spans and on others:
#: where estimation starts, and what is known.  Real spans pass their check
#: (digit sum, range, count of digits) by definition, so that is not estimated.
MILD = ((0.2, 0.3, 0.5), (0.5, 0.3, 0.2))
KNOWN = {"checks": ((0.001, 0.001, 0.998), (0.8, 0.1, 0.1))}
#: What the span classifier sees: two properties of the value, and ``traits``.
TRAITS = ("valid", "listed", "marked", "parted", "named", "led", "joined", "closed", "followed")


def found(text: Column, pattern: str, screen: str) -> tuple[Column, Column, Column]:
    """Matches, and of the text before each: its length and its last characters."""
    has = text.rlike(screen)
    gaps = F.split(text, pattern, -1)
    return (
        F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        F.when(has, F.transform(gaps, lambda g: F.length(g))),
        F.when(has, F.transform(gaps, lambda g: F.right(g, F.lit(TAIL)))),
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def octets_fit(value: Column) -> Column:
    """Every dotted part is at most 255, leading zeros allowed."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(value: Column, least: int, most: int) -> Column:
    number = digits(value)
    return F.length(number).between(least, most) & F.call_function("luhn_check", number)


def base_passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return octets_fit(value)
    if kind == "card":
        return luhn(value, 14, 19)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def spans_of(kind: str, matches: str, gaps: str, tails: str, keep) -> Column:
    """Spans (code points) of the kept matches, from stored arrays."""
    m, g, t = F.col(matches), F.col(gaps), F.col(tails)
    order = F.lit(KINDS.index(kind))

    # where every match starts, summed up along the text
    pieces = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda gap, x: F.struct(gap.alias("gap"), F.length(x).alias("size")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        pieces,
        none,
        lambda a, x: F.struct((a["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(a["starts"], a["at"] + x["gap"]).alias("starts")),
        lambda a: a["starts"],
    )
    placed = F.zip_with(starts, F.transform(m, lambda x, i: F.struct(x.alias("v"), i.alias("i"))), lambda at, s: F.struct(at.alias("at"), s["v"].alias("v"), s["i"].alias("i")))
    kept = F.filter(placed, lambda s: keep(s["v"]))

    def span(s: Column) -> Column:
        start = s["at"]
        return F.struct(
            start.alias("start"),
            order.alias("kind"),
            (start + F.length(s["v"])).alias("stop"),
            s["v"].alias("v"),
            F.element_at(t, s["i"] + 1).alias("tail"),
            F.left(F.element_at(t, s["i"] + 2), F.lit(TAIL)).alias("next"),
        )

    return F.coalesce(F.transform(kept, span), F.array().cast(f"array<{SPAN}>"))


SPAN = "struct<start:int,kind:int,stop:int,v:string,tail:string,next:string>"


def apart(base: Column, loose: Column) -> Column:
    """Spans of ``loose`` that overlap none of ``base``: one walk over both by
    start.  Spans of either list do not overlap each other, so a base span can
    only reach into the span right before it, or into those that start before
    its end."""

    def marked(spans: Column, late: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(late).alias("late"), s.alias("s")))

    def step(a: Column, e: Column) -> Column:
        span, late, last = e["s"], e["late"] == 1, a["last"]
        met = F.coalesce(last["stop"] > span["start"], F.lit(False))
        return F.struct(
            F.when(late, a["reach"]).otherwise(F.greatest(a["reach"], span["stop"])).alias("reach"),
            F.when(late, F.when(span["start"] >= a["reach"], span)).otherwise(F.when(~met, last)).alias("last"),
            F.when(late & last.isNotNull(), F.array_append(a["out"], last)).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("reach"), F.lit(None).cast(SPAN).alias("last"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(
        F.array_sort(F.concat(marked(base, 0), marked(loose, 1))),
        start,
        step,
        lambda a: F.when(a["last"].isNotNull(), F.array_append(a["out"], a["last"])).otherwise(a["out"]),
    )


def votes(kind: str, value: Column, tail: Column) -> dict[str, Column]:
    """1 for, -1 against, 0 abstain."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    sign = lambda c: F.when(c, yes).otherwise(no)
    lone = tail.rlike(r"[0-9A-Za-z#$=._-]$")
    shape = {
        "email": value.rlike(f"^{BASE['email']}$"),
        "ip": value.rlike(r"^[1-9][0-9]{0,2}(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": value.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})$"),
        "phone": value.rlike(r"^\+|^\("),
    }[kind]
    checks = {
        "email": value.rlike(r"^[A-Za-z0-9][^@]*(?:@|[\[(]at[\])])") & ~value.rlike(r"\.\."),
        "ip": octets_fit(value),
        "card": luhn(value, 14, 19),
        "phone": F.length(digits(value)).between(10, 15),
    }[kind]
    return {
        "shape": sign(shape),
        "gazetteer": F.when(value.rlike(GAZETTEER[kind]), yes).otherwise(no if kind == "ip" else none),
        "context": F.when(tail.rlike(CONTEXT[kind]), yes).otherwise(none),
        "checks": sign(checks),
        "neighbour": F.when(lone, no).otherwise(none),
    }


def traits(kind: str, value: Column, tail: Column, after: Column) -> dict[str, Column]:
    """0 or 1 each: of the value, of the text before it and of that behind it."""
    cast = votes(kind, value, tail)
    flags = {
        "valid": cast["checks"] == 1,
        "listed": cast["gazetteer"] == 1,
        "marked": value.rlike(r"^[+(]|@"),
        "parted": value.rlike(r"[\x20()-]"),
        "named": tail.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind]),
        "led": tail.rlike(r"[:=(<\[]\x20?$"),
        "joined": tail.rlike(r"[0-9A-Za-z#$=._-]$"),
        "closed": after.rlike(r"^(?:$|[\s,;:!?)\]>]|\.(?:\s|$))"),
        "followed": after.rlike(r"^[\x20.,-]?[0-9]"),
    }
    return {name: flag.cast("int") for name, flag in flags.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: tuple[str, ...] = (), rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Posterior that a span is real, per vote pattern: two-class
    expectation-maximisation with a reliability of every labeler and class.

    Input: (votes, count), at most 3 to the number of labelers patterns, and
    the labelers' names (none: all reliabilities are estimated).
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    width = len(patterns[0][0])
    prior = 0.6
    start = [KNOWN.get(names[k] if names else "", MILD) for k in range(width)]
    # reliabilities[class][labeler][vote + 1]
    rel = [[list(start[k][c]) for k in range(width)] for c in (0, 1)]
    post: dict[tuple[int, ...], float] = {}
    # pseudo-counts keep prior and classes near their start, so that neither
    # class swaps its meaning or takes all spans
    hold = 5 + total / 4
    for _ in range(rounds):
        for pattern, _n in patterns:
            real = math.log(prior) + sum(math.log(rel[0][k][v + 1]) for k, v in enumerate(pattern))
            fake = math.log(1 - prior) + sum(math.log(rel[1][k][v + 1]) for k, v in enumerate(pattern))
            post[pattern] = 1 / (1 + math.exp(max(-50.0, min(50.0, fake - real))))
        weight = sum(n * post[p] for p, n in patterns)
        prior = (weight + hold * 0.6) / (total + hold)
        for k in range(width):
            if names and names[k] in KNOWN:
                continue
            for v in (-1, 0, 1):
                real = sum(n * post[p] for p, n in patterns if p[k] == v)
                fake = sum(n * (1 - post[p]) for p, n in patterns if p[k] == v)
                rel[0][k][v + 1] = (real + hold * start[k][0][v + 1]) / (weight + hold)
                rel[1][k][v + 1] = (fake + hold * start[k][1][v + 1]) / (total - weight + hold)
    return post


def fit_classifier(seen: dict[tuple[int, ...], tuple[int, float]]) -> list[float]:
    """Logistic weights (intercept first) of the traits, fitted to posteriors.

    Input: per pattern of traits its count and mean posterior; at most 2 to
    the number of traits patterns.
    """
    if not seen:
        return []
    width = len(next(iter(seen)))
    w, total = [0.0] * (width + 1), sum(n for n, _ in seen.values())
    for _ in range(400):
        grad = [0.0] + [1e-3 * x for x in w[1:]]
        for p, (n, mean) in seen.items():
            z = w[0] + sum(a * b for a, b in zip(w[1:], p))
            diff = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - mean)
            grad[0] += diff
            for k, v in enumerate(p):
                grad[k + 1] += diff * v
        w = [a - 1.0 * g for a, g in zip(w, grad)]
    return w


def learn(rows: list[tuple[tuple[int, ...], tuple[int, ...], int]]) -> list[float]:
    """Weights of one kind's classifier from (votes, traits, count)."""
    tally: dict[tuple[int, ...], int] = {}
    for cast, _, n in rows:
        tally[cast] = tally.get(cast, 0) + n
    post = estimate(sorted(tally.items()), LABELERS)
    seen: dict[tuple[int, ...], tuple[int, float]] = {}
    for cast, look, n in sorted(rows):
        had, mean = seen.get(look, (0, 0.0))
        seen[look] = (had + n, (had * mean + n * post[cast]) / (had + n))
    return fit_classifier(seen)


def find_personal_data(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``doc_id, text``: ``doc_id``, ``base`` and ``added``
    arrays of (start, kind, stop) with code-point offsets, end exclusive.

    Null text is empty.  Very long texts take one linear scan per pattern and
    one walk over their spans.
    Repeated rows each get a row; other columns are ignored; an empty table
    gives no rows.  Rows never leave their partition: only counts by kind and
    pattern of votes and traits (some hundreds; 3^5 x 2^9 a kind at the very
    most, whatever the table) are gathered.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = []
    for kind in KINDS:
        for family, pattern, screen in (("b", BASE[kind], SCREEN[kind]), ("l", LOOSE[kind], LOOSE_SCREEN[kind])):
            for part, value in zip(("m", "g", "t"), found(text, pattern, screen)):
                columns.append(value.alias(f"{kind}_{family}_{part}"))
    scanned = staged(spark, docs.select("doc_id", *columns), "pii-matches")

    base = [spans_of(k, f"{k}_b_m", f"{k}_b_g", f"{k}_b_t", lambda v, k=k: base_passes(k, v)) for k in KINDS]
    loose = [spans_of(k, f"{k}_l_m", f"{k}_l_g", f"{k}_l_t", lambda v: F.lit(True)) for k in KINDS]
    placed = staged(
        spark, scanned.select("doc_id", F.concat(*base).alias("base"), F.concat(*loose).alias("loose")), "pii-spans"
    )

    candidate = placed.select(F.explode("loose").alias("c")).select("c.kind", "c.v", "c.tail", "c.next")
    weights: dict[int, list[float]] = {}
    for k, kind in enumerate(KINDS):
        cast = votes(kind, F.col("v"), F.col("tail"))
        look = traits(kind, F.col("v"), F.col("tail"), F.col("next"))
        own = candidate.where(F.col("kind") == k).select(*[cast[n].alias(n) for n in LABELERS], *[look[n].alias(n) for n in TRAITS])
        rows = own.groupBy(*LABELERS, *TRAITS).count().collect()
        weights[k] = learn([(tuple(r[n] for n in LABELERS), tuple(r[n] for n in TRAITS), r["count"]) for r in rows])

    def score(c: Column) -> Column:
        out = F.lit(0.0)
        for k, kind in enumerate(KINDS):
            if weights[k]:
                look = traits(kind, c["v"], c["tail"], c["next"])
                z = F.lit(weights[k][0])
                for w, name in zip(weights[k][1:], TRAITS):
                    z = z + F.lit(w) * look[name]
                out = F.when(c["kind"] == k, 1 / (1 + F.exp(-z))).otherwise(out)
        return out

    plain = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    of_kind = lambda spans, k: F.filter(spans, lambda s: s["kind"] == k)
    beside = F.concat(*[apart(of_kind("base", k), of_kind("loose", k)) for k in range(len(KINDS))])
    fresh = F.filter(beside, lambda c: score(c) >= threshold)
    return placed.select(
        "doc_id", F.array_sort(plain(F.col("base"))).alias("base"), F.array_sort(plain(fresh)).alias("added")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )
