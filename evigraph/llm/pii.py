"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose candidate spans; four labelers vote on each; expectation-maximisation estimates from the votes alone how reliable each labeler is;
its posteriors train a classifier on votes and surface features, which decides on the spans that are added to the base ones.

What the driver sees of the corpus are counts by kind, votes and features: at most a few thousand numbers, whatever the corpus is."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Kinds in the order of their spans; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "secret", "name")
#: Base patterns (fixed values of the query contract), written so that a text is passed over once: possessive, and no start inside a failed run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_VALID = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Patterns of further candidates.
SECRET = r"\bAKIA[0-9A-Z]{16}\b|\b(?:[Pp]ass(?:word|wd)?|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}+|\b(?=[a-z]*+[0-9])[0-9a-z]{32,}+\b"
#: A run without a key word that is a key or a digest by its form.
HEX = r"^[0-9a-f]{32,}+$"
#: In any text with a match of SECRET: each of its alternatives needs a key word, AKIA or a digit.
SECRET_GATE = r"[0-9]|AKIA|[Pp]ass|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey"
NATIONAL = r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0?[0-9]{2,3}[ -])[0-9]{3,4}[ -][0-9]{3,4}(?![0-9-])"
NAME = r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?"
#: Gazetteers (fixed values): mail and number prefixes, given names.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|co|uk|de|fr|es|it|eu|info)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|44|49|33|34|39|7|81|86|91)\b|\(?[2-9])",
    "secret": r"^(?:AKIA|[Pp]ass|[Tt]oken|[Ss]ecret|[Aa]pi)",
    "name": r" (?:James|John|Robert|Michael|William|David|Richard|Thomas|Mary|Patricia|Linda|Barbara|Elizabeth|Jennifer|Maria|Susan|Peter|Paul|Anna|Hans|Pierre|Jean|Juan|Carlos)\b",
}
#: Words just before a span that speak for its kind (fixed values).
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|mailto|write to|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|call|tel|mobile|fax|cell|telefon|téléphone|teléfono)\b",
    "secret": r"(?i)\b(?:key|credential|login|secret|aws|auth)\b",
    "name": r"(?i)\b(?:by|with|from|patient|contact|dear|signed)\b",
}
CONTEXT_CHARS = 32
#: Texts with spans are cut into pieces of so many code points (CONTEXT_CHARS at least), so that a span's surroundings are found without passing over
#: all of the text before it.
CHUNK = 64
ROUNDS = 30
LIMIT = 0.9


def located(text: Column, pattern: str, gate: Column) -> tuple[Column, Column]:
    """The matches of a pattern and the pieces between them, for texts that pass the gate; both are null for others."""
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), F.when(gate, F.split(text, pattern, -1))


PIECE, SPAN = "struct<gap:int,m:string>", "struct<kind:int,s:int,e:int,m:string,base:boolean>"


def pieces(found: str, between: str) -> Column:
    """Each match, with the length of what lies between it and the one before."""
    piece = lambda i: F.struct(F.length(C.at(F.col(between), i)).alias("gap"), C.at(F.col(found), i).alias("m"))
    return F.transform(C.positions(F.size(found)), piece)


def placed(array: str, kind: int, base: bool, keep) -> Column:
    """The spans (kind, s, e, m, base) of an array of `pieces`, by a running sum of lengths; only those whose match passes `keep`."""
    sums = C.running(array, PIECE, lambda x: x["gap"] + F.length(x["m"]), lambda a, v: a + v, F.lit(0))

    def span(y: Column) -> Column:
        s, m = y["before"] + y["x"]["gap"], y["x"]["m"]
        return F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.lit(base).alias("base"))

    spans = F.transform(F.filter(sums, lambda y: keep(y["x"]["m"])), span)
    return F.when(F.size(array) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def events(base: str, more: str) -> Column:
    """Base spans by their starts and others by their ends, in one order, others first: (place, reach, span). reach is a base span's end."""
    told = lambda x: F.struct(x["s"].alias("place"), x["e"].alias("reach"), x.alias("span"))
    asked = lambda x: F.struct(x["e"].alias("place"), F.lit(-1).alias("reach"), x.alias("span"))
    return F.array_sort(F.concat(F.transform(base, told), F.transform(more, asked)))


def apart(array: str) -> Column:
    """The spans that overlap no base span, from an array of `events`: the largest end of the base spans that start before a span's end is not beyond its
    start."""
    kind = f"struct<place:int,reach:int,span:{SPAN}>"
    reached = C.running(array, kind, lambda x: x["reach"], lambda a, v: F.greatest(a, v), F.lit(-1))
    free = F.filter(reached, lambda y: ~y["x"]["span"]["base"] & (y["before"] <= y["x"]["span"]["s"]))
    return F.transform(free, lambda y: y["x"]["span"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def add(a: Column, i: Column) -> Column:
        v = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), F.least(F.length(d), F.lit(19))), F.lit(0), add)
    return F.length(d).between(16, 19) & (total % 10 == 0)


#: Of each proposed pattern: kind, whether it is a base one, pattern, cheap test of a whole text, test of a match.
def _patterns() -> list[tuple]:
    digits = lambda t: t.rlike("[0-9]")
    everything = lambda m: F.lit(True)
    return [
        (0, True, EMAIL, lambda t: t.contains("@"), everything),
        (1, True, IP, digits, lambda m: m.rlike(IP_VALID)),
        (2, True, CARD, digits, _luhn),
        (3, True, PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15)),
        (3, False, NATIONAL, digits, everything),
        (4, False, SECRET, lambda t: t.rlike(SECRET_GATE), everything),
        (5, False, NAME, lambda t: t.rlike(r"(?:M(?:r|rs|s)|Dr|Prof)\.? [A-Z]"), everything),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, spans: base spans in order, then further candidates that overlap no base span; each with votes v1..v4 and features f1, f2.

    A labeler votes 1 (personal), 0 (not) or -1 (it abstains). v1: the strict pattern of the kind; v2: a gazetteer (it abstains on runs without a key word); v3: words before the span; v4:
    whether the span stands by itself. f1: length in steps; f2: kinds of characters."""
    patterns = _patterns()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    cols = []
    for k, (_, _, pattern, gate, _) in enumerate(patterns):
        found, between = located(F.col("t"), pattern, gate(F.col("t")))
        cols += [found.alias(f"f{k}"), between.alias(f"b{k}")]
    rows = rows.select("doc_id", "t", *cols)
    rows = rows.select("doc_id", "t", *[F.when(F.size(f"f{k}") > 0, pieces(f"f{k}", f"b{k}")).alias(f"p{k}") for k in range(len(patterns))])
    spans = [placed(f"p{k}", kind, base, keep).alias(f"x{k}") for k, (kind, base, _, _, keep) in enumerate(patterns)]
    rows = rows.select("doc_id", "t", *spans)
    base = F.concat(*[f"x{k}" for k, p in enumerate(patterns) if p[1]])
    more = F.concat(*[f"x{k}" for k, p in enumerate(patterns) if not p[1]])
    rows = rows.select("doc_id", "t", base.alias("base"), more.alias("more"))
    meet = (F.size("base") > 0) & (F.size("more") > 0)
    rows = rows.select("doc_id", "t", "base", "more", F.when(meet, events("base", "more")).alias("events"))
    every = F.concat("base", F.when(meet, F.array_sort(apart("events"))).otherwise(F.col("more")))
    chunks = F.when((F.size("base") > 0) | (F.size("more") > 0), F.regexp_extract_all("t", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))
    rows = rows.select("doc_id", every.alias("all"), chunks.alias("chunks"))

    def by_kind(kind: Column, tests: dict[str, str], value: Column) -> Column:
        out = F.lit(False)
        for k, name in enumerate(KINDS):
            out = F.when(kind == k, value.rlike(tests[name])).otherwise(out)
        return out.cast("int")

    def voted(x: Column) -> Column:
        kind, m = x["kind"], x["m"]
        chunk = lambda k: F.coalesce(C.at(F.col("chunks"), k), F.lit(""))
        last = lambda place: F.floor(place / CHUNK).cast("int")
        before = F.right(F.concat(chunk(last(x["s"]) - 1), F.substr(chunk(last(x["s"])), F.lit(1), x["s"] % CHUNK)), F.lit(CONTEXT_CHARS))
        after = F.substr(chunk(last(x["e"])), x["e"] % CHUNK + 1, F.lit(1))
        bare = (kind == 4) & ~m.rlike(r"^AKIA|[=:]")
        strict = F.when(x["base"], 1).when(kind == 4, (~bare | m.rlike(HEX)).cast("int"))
        strict = strict.when(kind == 3, m.startswith("(").cast("int")).otherwise(m.rlike(r"\. ").cast("int"))
        listed = F.when(bare, -1).otherwise(by_kind(kind, GAZETTEER, m))
        context = F.when(by_kind(kind, CONTEXT, before) == 1, 1).otherwise(-1)
        alone = (~before.rlike(r"[A-Za-z0-9_=/]$") & ~after.rlike(r"^[A-Za-z0-9_=/]")).cast("int")
        chars = m.rlike("[0-9]").cast("int") + 2 * m.rlike("[A-Za-z]").cast("int")
        size = F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("int")
        votes = [v.alias(f"v{k}") for k, v in enumerate((strict, listed, context, alone), 1)]
        return F.struct(kind.alias("kind"), *[x[c].alias(c) for c in ("s", "e", "base")], *votes, size.alias("f1"), chars.alias("f2"))

    return rows.select("doc_id", F.transform("all", voted).alias("spans"))


VOTES, FEATURES = ("v1", "v2", "v3", "v4"), ("v1", "v2", "v3", "v4", "f1", "f2", "kind")


def reliabilities(counts: list[dict], rounds: int = ROUNDS) -> tuple[list[float], list[dict], list[dict]]:
    """(posteriors, one for each count; for either class, each labeler's vote rates) by expectation-maximisation over counts of equal votes.

    Votes are independent given the class; abstaining says nothing. The start takes the share of votes for 1; rates are smoothed by one vote each."""
    posts = []
    for row in counts:
        said = [row[v] for v in VOTES if row[v] >= 0]
        posts.append((sum(said) + 0.5) / (len(said) + 1))
    rates: list[dict] = [{}, {}]
    for _ in range(rounds if counts else 0):
        share = (sum(r["count"] * p for r, p in zip(counts, posts, strict=True)) + 1) / (sum(r["count"] for r in counts) + 2)
        for c in (0, 1):
            weights = [r["count"] * (p if c else 1 - p) for r, p in zip(counts, posts, strict=True)]
            rates[c] = {v: (sum(w for r, w in zip(counts, weights, strict=True) if r[v] == 1) + (2 if c else 1)) / (sum(w for r, w in zip(counts, weights, strict=True) if r[v] >= 0) + 3) for v in VOTES}
        for i, row in enumerate(counts):
            odds = math.log(share / (1 - share))
            for v in VOTES:
                if row[v] >= 0:
                    one, zero = rates[1][v], rates[0][v]
                    odds += math.log(one / zero) if row[v] else math.log((1 - one) / (1 - zero))
            posts[i] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return posts, rates[0], rates[1]


def train(counts: list[dict], posts: list[float]) -> tuple[float, dict[tuple[str, int], float]]:
    """(bias, weight of each feature's value) of a logistic classifier that fits the posteriors, by gradient descent over counts."""
    total = sum(r["count"] for r in counts)
    weights = {(f, r[f]): 0.0 for r in counts for f in FEATURES}
    bias, step = 0.0, 1.0
    for _ in range(300 if counts else 0):
        slope_b, slope = 0.0, dict.fromkeys(weights, 0.0)
        for row, post in zip(counts, posts, strict=True):
            z = bias + sum(weights[f, row[f]] for f in FEATURES)
            error = row["count"] / total * (1 / (1 + math.exp(-max(min(z, 30), -30))) - post)
            slope_b += error
            for f in FEATURES:
                slope[f, row[f]] += error
        bias -= step * slope_b
        for k in weights:
            weights[k] -= step * (slope[k] + 1e-4 * weights[k])
    return bias, weights


def find(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id and found (spans: kind, s, e in code points, base) for each row of docs(doc_id, text), by kind in the order of KINDS and then by start.

    Base spans always stay; others are added where the classifier gives at least `limit`. A null or empty text has none; repeated rows each give a
    row; an empty table, or one without candidates, trains nothing and adds nothing. Texts are read once and nothing is shuffled but counts."""
    rows = C.materialize(candidates(docs))
    counts = rows.select(F.explode("spans").alias("x")).groupBy(*[F.col(f"x.{f}").alias(f) for f in FEATURES]).count().collect()
    counts = sorted((r.asDict() for r in counts), key=lambda r: [r[f] for f in FEATURES])
    posts, _, _ = reliabilities(counts)
    bias, weights = train(counts, posts)

    def score(x: Column) -> Column:
        z = F.lit(bias)
        for f in FEATURES:
            part = F.lit(0.0)
            for (g, value), w in weights.items():
                if g == f:
                    part = F.when(x[f] == value, F.lit(w)).otherwise(part)
            z = z + part
        return 1 / (1 + F.exp(-z))

    chosen = F.filter("spans", lambda x: x["base"] | (score(x) >= limit))
    return rows.select("doc_id", F.array_sort(F.transform(chosen, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of the rows of `find`."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", C.at(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long")
    base = F.filter("found", lambda x: x["base"])
    return found.select("doc_id", *[n(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
