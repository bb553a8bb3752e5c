"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions propose spans.  Four labelers (pattern, gazetteer, context, shape) vote on each; expectation-maximisation
estimates how reliable they are, and a logistic span classifier is fitted to the resulting labels.
What it adds stands beside the spans of the base patterns, which always stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from evidence_spark.sources.tables import write_table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that every text is scanned once: what comes before a match keeps it from
#: starting inside a longer one, and repeats, that of a domain's labels too, do not backtrack: no text is deep enough to exhaust a stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider proposals; the classifier decides on them.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z./-])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9A-Za-z./-])",
    "phone": r"(?<![0-9A-Za-z+().-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: A substring that a match must contain, to skip most texts cheaply.
_NEEDS = {"email": "@", "phone": "+"}
#: Gazetteer: top-level domains; first numbers of reserved nets; first digits of card issuers; calling codes.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
RESERVED_NETS = ("0", "10", "127", "224", "240", "255")
ISSUERS = ("34", "35", "36", "37", "38", "4", "50", "51", "52", "53", "54", "55", "56", "6")
CALLING_CODES = ("1", "20", "27", "3", "4", "5", "6", "7", "8", "9")
#: Words before a span that speak for its kind, and such that speak against any.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|at)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|client|from|addr)\W*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|number|telefon|tél)\W*$",
}
AGAINST = r"(?i)(?:version|ver|v|release|build|isbn|issn|order|invoice|section|page|chapter|id|sku)[\s.:#]*$"
#: Characters of context that a labeler sees; rounds of estimation; shares from which an added span counts.
CONTEXT = 24
ROUNDS = 25
THRESHOLD = 0.9
VOTES = ("pattern", "gazetteer", "context", "shape")

#: Matches per chunk: places are summed inside chunks, then over chunks, so that no list is built match by match.
_CHUNK = 64
_Span = "struct<kind:string,begin:int,stop:int,base:boolean,surface:string,before:string,after:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(kind: str, surface: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(surface, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.call_function("luhn_check", _digits(surface))
    if kind == "phone":
        return F.length(_digits(surface)).between(9, 15)
    return F.lit(True)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Leftmost non-overlapping matches with their places: what lies between matches gives the offsets."""
    empty = F.array().cast(f"array<{_Span}>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        stop = begin + F.length(pair["hit"])
        span = F.struct(
            F.lit(kind).alias("kind"), begin.alias("begin"), stop.alias("stop"), F.lit(base).alias("base"),
            pair["hit"].alias("surface"), F.right(pair["gap"], F.lit(CONTEXT)).alias("before"), F.left(pair["next"], F.lit(2)).alias("after"),
        )
        return F.struct(stop.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    def inside(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"]

    def placed(chunks: Column) -> Column:
        wide = F.transform(
            chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
        )
        starts = F.aggregate(
            wide,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda state, n: F.struct((state["at"] + n).alias("at"), F.array_append(state["all"], state["at"]).alias("all")),
        )["all"]
        return F.flatten(F.zip_with(chunks, starts, inside))

    def chunked(pairs: Column) -> Column:
        last = F.floor((F.size(pairs) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK)))

    pairs = F.zip_with(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
        F.slice(gaps, 2, F.size(hits)),
        lambda p, n: F.struct(p["gap"].alias("gap"), p["hit"].alias("hit"), n.alias("next")),
    )
    found = _bound(pairs, lambda p: _bound(chunked(p), placed))
    wanted = text.contains(_NEEDS[kind]) & text.rlike(pattern) if base and kind in _NEEDS else text.rlike(pattern)
    return F.when(wanted, F.filter(found, lambda s: _passes(kind, s["surface"]))).otherwise(empty)


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, wider): arrays of spans in the order of the kinds, then of their places."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content.alias("_text"))
    held = rows.select(
        "doc_id",
        *(_spans(F.col("_text"), k, BASE[k], True).alias(f"base_{k}") for k in KINDS),
        *(_spans(F.col("_text"), k, WIDER[k], False).alias(f"wider_{k}") for k in KINDS),
    )
    return write_table(held, "proposals").select(
        "doc_id",
        F.concat(*(f"base_{k}" for k in KINDS)).alias("base"),
        F.concat(*(f"wider_{k}" for k in KINDS)).alias("wider"),
    )


def _votes(s: Column) -> dict[str, Column]:
    """1 for, 0 against, -1 no opinion."""
    kind, surface = s["kind"], s["surface"]
    digits = _digits(surface)
    domain = F.lower(F.regexp_extract(surface, "([A-Za-z]+)[^A-Za-z]*$", 1))
    gazetteer = (
        F.when(kind == "email", domain.isin(*DOMAINS))
        .when(kind == "ip", ~F.regexp_extract(surface, "^0*([0-9]+)", 1).isin(*RESERVED_NETS))
        .when(kind == "card", F.concat(*(F.when(digits.startswith(p), "x").otherwise("") for p in ISSUERS)) != "")
        .otherwise(F.concat(*(F.when(digits.startswith(p), "x").otherwise("") for p in CALLING_CODES)) != "")
    )
    cue = F.lit(False)
    for k in KINDS:
        cue = F.when(kind == k, s["before"].rlike(CUES[k])).otherwise(cue)
    glued = s["before"].rlike(r"[\p{L}\p{N}_]$") | s["after"].rlike(r"^[\p{L}\p{N}_]")
    return {
        "pattern": F.when(s["base"], 1).otherwise(-1),
        "gazetteer": gazetteer.cast("int"),
        "context": F.when(s["before"].rlike(AGAINST), 0).when(cue, 1).otherwise(-1),
        "shape": F.when(glued, 0).otherwise(1),
    }


def _size(s: Column) -> Column:
    return F.least(F.lit(4), F.floor(F.length(s["surface"]) / 6)).cast("int")


def reliabilities(patterns: list[Row], rounds: int = ROUNDS) -> tuple[dict[tuple[str, str], float], dict[str, float], dict[tuple, float]]:
    """Expectation-maximisation over counts of vote patterns: accuracy of each labeler per kind, share of true spans
    per kind, and the probability of each pattern."""
    sure = {(k, v): 0.8 for k in KINDS for v in VOTES}
    prior = dict.fromkeys(KINDS, 0.5)
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for row in patterns:
            yes, no = math.log(prior[row["kind"]]), math.log(1 - prior[row["kind"]])
            for v in VOTES:
                if row[v] >= 0:
                    a = sure[row["kind"], v]
                    yes += math.log(a if row[v] else 1 - a)
                    no += math.log(1 - a if row[v] else a)
            belief[tuple(row[c] for c in ("kind", *VOTES))] = 1 / (1 + math.exp(min(60.0, no - yes)))
        for k in KINDS:
            mine = [(r, belief[tuple(r[c] for c in ("kind", *VOTES))]) for r in patterns if r["kind"] == k]
            whole = sum(r["n"] for r, _ in mine)
            prior[k] = (sum(r["n"] * p for r, p in mine) + 1) / (whole + 2)
            for v in VOTES:
                cast = [(r, p) for r, p in mine if r[v] >= 0]
                right = sum(r["n"] * (p if r[v] else 1 - p) for r, p in cast)
                # a labeler is held to be better than chance, with ten votes of prior knowledge
                sure[k, v] = min(0.99, max(0.55, (right + 8) / (sum(r["n"] for r, _ in cast) + 10)))
    return sure, prior, belief


@dataclass(frozen=True)
class Classifier:
    """Weights of a logistic model over (feature, value) pairs."""

    weights: dict[tuple[str, object], float]

    def probability(self, s: Column) -> Column:
        votes = _votes(s)
        features = {"kind": s["kind"], "size": _size(s)} | {v: votes[v] for v in VOTES}
        total = F.lit(self.weights.get(("bias", 1), 0.0))
        for name, column in features.items():
            part = F.lit(0.0)
            for (owner, value), weight in sorted(self.weights.items(), key=str):
                if owner == name:
                    part = F.when(column == value, weight).otherwise(part)
            total = total + part
        return 1 / (1 + F.exp(-total))


def fit_classifier(patterns: list[Row], belief: dict[tuple, float], steps: int = 300) -> Classifier:
    """Gradient ascent on the counts, towards the estimated labels."""
    weights: dict[tuple[str, object], float] = {("bias", 1): 0.0}
    rows = []
    for r in patterns:
        keys = [("bias", 1), ("kind", r["kind"]), ("size", r["size"]), *((v, r[v]) for v in VOTES)]
        rows.append((keys, r["n"], belief[tuple(r[c] for c in ("kind", *VOTES))]))
        for key in keys:
            weights.setdefault(key, 0.0)
    whole = sum(n for _, n, _ in rows) or 1
    speed = dict.fromkeys(weights, 1e-6)
    for _ in range(steps):
        slope = {key: -1e-3 * w for key, w in weights.items()}
        for keys, n, p in rows:
            now = 1 / (1 + math.exp(-max(-60.0, min(60.0, sum(weights[k] for k in keys)))))
            for key in keys:
                slope[key] += n / whole * (p - now)
        for key, g in slope.items():
            speed[key] += g * g
            weights[key] += 0.3 * g / math.sqrt(speed[key])
    return Classifier(weights)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, added): the spans of the base patterns, and those that the classifier adds; one row per input row.

    Places are code points, the end exclusive.  An added span must reach the threshold and not overlap a base
    span.  What the driver sees are counts per vote pattern: at most (kinds x votes x sizes) rows, whatever the input.
    Null is the empty text.  Repeated rows are treated one by one.
    """
    found = proposals(docs, doc_id, text)
    one = found.select(F.explode(F.concat("base", "wider")).alias("s")).select("s.*")
    s = {c: F.col(c) for c in one.columns}
    counted = (
        one.select(s["kind"], _size(s).alias("size"), *(c.alias(v) for v, c in _votes(s).items()))
        .groupBy("kind", "size", *VOTES)
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "size", *VOTES)
        .collect()
    )
    _, _, belief = reliabilities(counted)
    model = fit_classifier(counted, belief)
    free = lambda x: ~F.exists("base", lambda b: (b["begin"] < x["stop"]) & (x["begin"] < b["stop"]))
    added = F.filter("wider", lambda x: (model.probability(x) >= threshold) & free(x))
    return found.select("doc_id", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of ``find``."""
    def line(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["stop"].cast("string"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    rank = F.lit(list(KINDS))
    ordered = F.array_sort(
        F.transform(
            F.concat("base", "added"),
            lambda s: F.struct(F.array_position(rank, s["kind"]).alias("k"), s["begin"].alias("b"), line(s).alias("line")),
        )
    )
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", F.transform("base", line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform(ordered, lambda s: s["line"])).alias("spans"),
    )
