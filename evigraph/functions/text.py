"""Text functions: slugs, keys, clause numbers, token sets, labels, aliases. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words that do not count in token sets; labels that mean the rest.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "into", "are", "was", "its", "our")
OTHER_LABELS = ("other", "others", "misc", "miscellaneous", "general")
#: Spellings of edge kinds by kind, as keys of letters and digits. Spellings that would turn a direction around are left out.
EDGE_ALIASES = {
    "Influences": "influences influence drives drive",
    "Impacts": "impacts impact affects affect",
    "Causes": "causes cause",
    "CorrelatesWith": "correlateswith correlates correlate correlated",
    "DependsOn": "dependson depends depend requires require needs uses use",
    "DerivedFrom": "derivedfrom derived derivesfrom derivation aggregates aggregate",
    "Blocks": "blocks block limits limit prevents prevent",
    "Improves": "improves improve increases increase boosts boost",
    "Degrades": "degrades degrade decreases decrease reduces reduce hurts hurt",
    "OwnedBy": "ownedby owner",
    "MeasuredBy": "measuredby measures measure",
    "EvidencedBy": "evidencedby evidence",
    "MentionedIn": "mentionedin mentions mention",
    "DecidedBy": "decidedby decides decide",
    "AssignedTo": "assignedto assignee",
    "InFunction": "infunction function belongsfunction",
    "ForProduct": "forproduct product lineofbusiness lob",
    "NextAction": "nextaction action",
    "Contradicts": "contradicts contradict conflictswith disagreeswith",
    "Corroborates": "corroborates corroborate supports support confirms confirm",
}
#: Spellings of node kinds by kind.
NODE_ALIASES = {
    "Kpi": "kpi",
    "Metric": "metric measure",
    "Objective": "objective goal okr",
    "Initiative": "initiative project program",
    "Risk": "risk threat",
    "Opportunity": "opportunity",
    "Decision": "decision",
    "Insight": "insight finding learning",
    "Document": "document doc",
    "Person": "person actor individual employee",
    "Team": "team group department squad",
    "Customer": "customer client account prospect lead",
    "Function": "function businessfunction",
    "Product": "product feature",
    "Market": "market segment industry",
    "Process": "process workflow procedure",
    "System": "system platform tool application",
    "Action": "action task todo",
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def slugify(c: Column) -> Column:
    """Lower case, runs of what is neither letter nor digit to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", "_"), "^_|_$", "")


def ascii_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def canon_key(c: Column) -> Column:
    """ASCII letters and digits alone, lower-cased."""
    return F.regexp_replace(ascii_lower(c), "[^a-z0-9]", "")


def strip_clause_number(c: Column) -> Column:
    """Drops a leading run of digits and dots with at least one of each and white space after it, unless nothing would remain."""
    rest = F.trim(F.regexp_replace(F.trim(c), r"^(?=[0-9.]*[0-9])(?=[0-9.]*\.)[0-9.]+\s+", ""))
    return F.when(rest == "", F.trim(c)).otherwise(rest)


def category_label(c: Column) -> Column:
    """A label without its clause number (white space after it is not needed), with single blanks; Other if empty."""
    rest = F.regexp_replace(F.trim(c), r"^(?=[0-9.]*[0-9])(?=[0-9.]*\.)[0-9.]+\s*", "")
    rest = F.trim(F.regexp_replace(rest, r"\s+", " "))
    return F.when(rest == "", F.lit("Other")).otherwise(rest)


def label_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def is_other_label(c: Column) -> Column:
    return label_key(c).isin(*OTHER_LABELS)


def significant_tokens(c: Column) -> Column:
    """The distinct words of at least three bytes that are no stop words, lower-cased."""
    parts = F.split(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) >= 3) & ~t.isin(*STOP_WORDS)))


def names_near_match(a: Column, b: Column) -> Column:
    """Whether the smaller of two token sets has at least two tokens, lies in the larger and is not equal to it."""
    small, large = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    return (F.size(small) >= 2) & (F.size(F.array_except(small, large)) == 0) & (F.size(small) != F.size(large))


def _aliased(c: Column, aliases: dict[str, str]) -> Column:
    pairs = {w: kind for kind, words in aliases.items() for w in {*words.split(), kind.lower()}}
    table = F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    return F.try_element_at(table, canon_key(c))


def edge_kind(c: Column) -> Column:
    """The edge kind that a spelling stands for; null if there is none."""
    return _aliased(c, EDGE_ALIASES)


def node_kind(c: Column) -> Column:
    return _aliased(c, NODE_ALIASES)


def lifecycle(c: Column) -> Column:
    """A customer's stage from the spelling of its kind."""
    key = canon_key(c)
    return F.when(key.isin("prospect", "lead"), "prospect").when(key.isin("customer", "client", "account"), "active")


def query_terms(c: Column) -> Column:
    """The words of a search text without double quotes, each to be found as a phrase."""
    return F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")


def index_terms(c: Column) -> Column:
    """The terms that the text indexes hold: lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def compact_number(c: Column) -> Column:
    """1.2B, 3.4M, 5.6K, whole numbers as they are, others with two decimals."""
    size = F.abs(c)
    out = F.when(c == F.floor(c), F.format_string("%d", c.cast("long"))).otherwise(F.format_string("%.2f", c))
    for letter, scale in (("K", 1e3), ("M", 1e6), ("B", 1e9)):
        out = F.when(size >= scale, F.concat(F.format_string("%.1f", c / scale), F.lit(letter))).otherwise(out)
    return out


def column_letter(n: int) -> str:
    """A, B, ..., Z, AA, ... for 0, 1, ..."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out
