"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. The method adds spans: wide
patterns propose candidates (secrets, local phone numbers, spelled-out addresses), and labelers vote on each: regular
expressions for known shapes and well-formed parts, gazetteers of key prefixes, of harmless words and of names, streets
and institutions, and context before and around the span. For each kind, expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is and how likely each pattern is personal data; these soft labels train a logistic span classifier (Spark ML) on votes and shape, and
its verdict decides. Vote patterns and shapes are few whatever the corpus, so training works on their counts, which
cover every candidate of every document.

Positions are code points. Regular expressions run only where a text holds a character that a match needs; patterns
are written so that no start inside a longer run is tried again (long runs stay linear).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.llm.shared import stored

#: kind: (characters one of which every match holds, pattern).
BASE = {
    "email": (("@",), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    "ip": ((".",), r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}"),
    "card": (None, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"),
    "phone": (("+",), r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Candidates of the method. A kind that is also a base kind adds spans that the base pattern cannot see.
CANDIDATES = {
    "email": (("(at)", "[at]"), r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)++"),
    "phone": (None, r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": (None, r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9+/_-]{11,}+"),
}
KINDS = ["email", "ip", "card", "phone", "secret"]
#: Fixed values of the labelers.
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "pk_live_")
CUES = "token|password|passwd|pwd|secret|apikey|api[ _-]?key|key|auth|credential|call|tel|phone|fax|mobile|mail|contact|write to"
HARMLESS = "version|license|licence|isbn|doi|figure|page|chapter|commit|checksum|sha256|md5|href|src"
#: Fixed values of the gazetteer: given names, words of streets and of institutions that stand by a person's details.
NAMES = "james|mary|john|anna|maria|peter|paul|thomas|robert|linda|david|susan|michael|laura|daniel|sarah|martin|julia|andreas|claudia|jean|marie|pierre|sophie|carlos|ana|luis|elena|marco|giulia|ivan|olga|ahmed|fatima|wei|yuki"
PLACES = "street|road|avenue|lane|boulevard|square|strasse|straße|platz|gasse|rue|place|chemin|calle|avenida|plaza|via|piazza"
BODIES = "university|hospital|clinic|bank|school|college|institute|ministry|office|embassy|hotel|universität|klinik|schule|amt|hôpital|école|banque|universidad|ospedale"
LABELERS = ("known_shape", "parts", "key_prefix", "harmless_word", "cue_before", "assigned", "gazetteer")
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _holds(text: Column, needed: tuple[str, ...] | None) -> Column:
    if needed is None:
        return F.rlike(text, F.lit("[0-9]"))
    out = F.lit(False)
    for part in needed:
        out = out | F.contains(text, F.lit(part))
    return out


def _found(text: Column, needed: tuple[str, ...] | None, pattern: str, name: str) -> tuple[Column, Column]:
    """The matches and the pieces between them; none where the text can't match."""
    some = _holds(text, needed)
    empty = F.array().cast("array<string>")
    return F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty).alias(f"{name}_m"), F.when(some, F.split(text, pattern, -1)).otherwise(empty).alias(f"{name}_p")


def _located(name: str) -> Column:
    """(start, match) of each match: what stands before it is pieces and matches."""
    matches, pieces = F.col(f"{name}_m"), F.col(f"{name}_p")

    def total(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

    return F.transform(matches, lambda m, i: F.struct((total(pieces, i + 1) + total(matches, i)).cast("int").alias("start"), m.alias("text")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = F.transform(at, lambda i: F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(2 * F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _octet)
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _span(kind: str, m: Column) -> list[Column]:
    return [m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).alias("end")]


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, "1")
    return (out.when(no, "0") if no is not None else out).otherwise("-")


def _candidate(kind: str, text: Column, m: Column) -> Column:
    """A span with its votes, in the order of LABELERS, and its shape."""
    match, length = m["text"], F.length(m["text"])
    before = F.lower(F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))))
    after = F.substring(text, m["start"] + length + 1, F.lit(1))
    n_digits = F.length(_digits(match))
    if kind == "secret":
        shape = F.rlike(match, F.lit("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Z]{4}[0-9A-Z]{16})$"))
        parts = _vote(n_digits >= 4, n_digits < 2)
    else:
        shape = F.rlike(match, F.lit(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$" if kind == "phone" else r"\[at\].*\[dot\]|\(at\).*\(dot\)"))
        # Area and exchange codes don't begin with 0 or 1; a domain ends in a label of letters.
        parts = _vote(F.rlike(match, F.lit(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]" if kind == "phone" else r"[^A-Za-z0-9-][A-Za-z]{2,}$")), F.lit(True))
    prefix = F.lit(False)
    for p in KEY_PREFIXES:
        prefix = prefix | match.startswith(p)
    votes = F.concat(
        _vote(shape),
        parts,
        _vote(prefix),
        _vote(F.lit(False), F.rlike(before, F.lit(rf"(?:{HARMLESS})\W{{0,12}}$"))),
        _vote(F.rlike(before, F.lit(rf"(?:{CUES})\W{{0,8}}$")), F.lit(True)),
        _vote(F.rlike(before, F.lit("[=:] ?[\"']?$")) | ((after == '"') & before.endswith('"'))),
        _vote(F.lit(kind != "secret") & F.rlike(before, F.lit(rf"\b(?:{NAMES}|{PLACES}|{BODIES})\b"))),
    )
    size = F.least(F.floor(F.log2(length.cast("double"))), F.lit(8)).cast("int")
    share = F.floor(10 * n_digits / length).cast("int")
    return F.struct(*_span(kind, m), votes.alias("votes"), size.alias("size"), share.alias("share"))


def spans_and_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), candidates (spans with votes and shape, clear of base spans). NULL text is empty."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wanted = {f"base_{k}": v for k, v in BASE.items()} | {f"more_{k}": v for k, v in CANDIDATES.items()}
    rows = rows.select("doc_id", "text", *[c for name, (needed, pattern) in wanted.items() for c in _found(text, needed, pattern, name)])

    def kept(kind: str) -> Column:
        valid = F.filter(_located(f"base_{kind}"), lambda m: _valid(kind, m["text"]))
        return F.transform(valid, lambda m: F.struct(*_span(kind, m)))

    def proposed(kind: str) -> Column:
        return F.transform(_located(f"more_{kind}"), lambda m: _candidate(kind, text, m))

    base, more = [kept(k) for k in BASE], [proposed(k) for k in CANDIDATES]
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*more).alias("more"))
    clear = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "base", clear.alias("candidates"))


def estimate(patterns: list[tuple[str, int]], rounds: int = 60) -> tuple[dict[str, float], list[float]]:
    """Expectation-maximisation over (votes, count): each pattern's probability, each labeler's reliability."""
    prior, right = 0.5, [0.8] * len(LABELERS)
    chance: dict[str, float] = {}
    for _ in range(rounds):
        for votes, _n in patterns:
            yes, no = math.log(prior), math.log(1 - prior)
            for r, v in zip(right, votes, strict=True):
                if v != "-":
                    yes += math.log(r if v == "1" else 1 - r)
                    no += math.log(1 - r if v == "1" else r)
            chance[votes] = 1 / (1 + math.exp(max(min(no - yes, 700), -700)))
        total = sum(n for _, n in patterns)
        prior = min(max(sum(n * chance[v] for v, n in patterns) / total, 0.02), 0.98)
        for k in range(len(LABELERS)):
            cast = sum(n for v, n in patterns if v[k] != "-")
            good = sum(n * (chance[v] if v[k] == "1" else 1 - chance[v]) for v, n in patterns if v[k] != "-")
            right[k] = min(max((good + 8) / (cast + 10), 0.55), 0.99)  # a mild belief that labelers are better than chance
    return chance, right


def _features(votes: Column, size: Column, share: Column, kind: Column) -> list[Column]:
    out = [(F.substring(votes, k + 1, 1) == v).cast("double") for k in range(len(LABELERS)) for v in ("1", "0")]
    return [*out, size.cast("double") / 8, share.cast("double") / 10, *[(kind == k).cast("double") for k in CANDIDATES]]


def train(candidates: DataFrame) -> tuple[float, list[float]] | None:
    """Intercept and weights of the span classifier, from every candidate; None without candidates.

    Labelers are judged kind by kind: one that says the same of all spans of a kind learns nothing from another kind.
    """
    counts = stored(candidates.groupBy("votes", "kind", "size", "share").count(), "pii-patterns")
    rows = counts.groupBy("kind", "votes").agg(F.sum("count").alias("n")).orderBy("kind", "votes").collect()  # kinds times 3 ** labelers at most
    if not rows:
        return None
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    soft = []
    for kind in CANDIDATES:
        if mine := [(r["votes"], r["n"]) for r in rows if r["kind"] == kind]:
            soft += [(kind, votes, chance) for votes, chance in sorted(estimate(mine)[0].items())]
    soft = counts.sparkSession.createDataFrame(soft, "kind string, votes string, chance double")
    names = [f"x{i}" for i in range(2 * len(LABELERS) + 2 + len(CANDIDATES))]
    rows = counts.join(soft, ["kind", "votes"]).select(*[c.alias(n) for c, n in zip(_features(F.col("votes"), F.col("size"), F.col("share"), F.col("kind")), names, strict=True)], "count", "chance")
    both = rows.withColumn("label", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).withColumn("weight", F.col("count") * F.when(F.col("label") == 1, F.col("chance")).otherwise(1 - F.col("chance")))
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(both.orderBy(*names, "label").coalesce(1))  # a row per pattern and shape
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=60).fit(frame)
    return float(model.intercept), [float(x) for x in model.coefficients]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: arrays of spans (start, rank, kind, end) of every row, in order.

    NULL text is empty and has no span. Repeated rows are searched each. Candidates that overlap a base span are
    none; the added ones are those to which the classifier gives more than an even chance. Texts and runs of any length
    are searched whole. An empty table gives no rows.
    """
    rows = stored(spans_and_candidates(docs), "pii")
    model = train(rows.select(F.explode("candidates").alias("c")).select("c.*"))
    if model is None:
        return rows.select("doc_id", "base", F.array().cast(SPAN).alias("added"))
    intercept, weights = model

    def logit(c: Column) -> Column:
        out = F.lit(intercept)
        for w, x in zip(weights, _features(c["votes"], c["size"], c["share"], c["kind"]), strict=True):
            out = out + w * x
        return out

    chosen = F.transform(F.filter("candidates", lambda c: logit(c) > 0), lambda c: F.struct(*[c[n].alias(n) for n in ("start", "rank", "kind", "end")]))
    return rows.select("doc_id", "base", F.array_sort(chosen).alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
