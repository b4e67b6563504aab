"""Lenses: selectors over nodes, measures over what they select, and health verdicts.

A configuration is JSON (dicts): {"summary": {"id", "name", "lenses": [ids], "period"?, "as_of"?}, "lenses": [lens]}. A lens has id, label, selector,
measure and, if it likes, health, children (ids), hidden, context. All lenses of a configuration are resolved by one plan: each node is tagged with the
lenses that select it, and measures are sums by lens."""

from __future__ import annotations

import copy
import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions.text import ascii_lower
from ..operators import graph as G
from ..operators import series
from ..schema import Graph

MOST_TOP, MOST_CHILDREN, MOST_SUPPORT = 10, 10, 20
EVIDENCE_LIMIT = {"count": 24, "sum": 32}
#: Evidence ids in a resolution's row; what facets add has no limit of its own, so that the rest is counted there and listed by `evidence`.
MOST_SHOWN = 1000
#: Facets by edge kind and kind of the node at the other end.
FACETS = {"function": ("InFunction", "Function"), "product": ("ForProduct", "Product"), "line_of_business": ("ForProduct", "Product"), "lineofbusiness": ("ForProduct", "Product"), "lob": ("ForProduct", "Product")}
MIN_CONFIDENCE, MAX_AGE_DAYS = 0.7, 30
RESOLUTION = "lens_id string, measure_type string, state string, value double, unit string, confidence double, observed_at long, evidence_ids array<string>, gaps array<string>, supporting array<string>, explanation string, lineage_at long, n_evidence long"


class LensError(ValueError):
    """A configuration that cannot be used."""


# Selectors.


def facet_frame(g: Graph) -> DataFrame:
    """id, facets: for each node, `<edge kind>=<text>` of what it is linked to, either way, by a facet's edge: name, id, and attributes name and label."""
    parts = []
    for edge_kind, node_kind in sorted(set(FACETS.values())):
        other = g.nodes.where(F.col("kind") == node_kind).select(F.col("id").alias("other"), F.explode(F.array_compact(F.array("name", "id", J.text_at(F.col("attrs"), "name"), J.text_at(F.col("attrs"), "label")))).alias("text"))
        both = G.undirected(g.edges.where(F.col("kind") == edge_kind)).select(F.col("node").alias("id"), "other")
        parts.append(both.join(other, "other").select("id", F.concat(F.lit(f"{edge_kind}="), ascii_lower(F.col("text"))).alias("facet")))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.collect_set("facet").alias("facets"))


def wide_nodes(g: Graph) -> DataFrame:
    """Nodes with their facets, for compiled selectors."""
    return g.nodes.join(facet_frame(g), "id", "left")


def compile_selector(selector) -> Column:
    """A selector as a condition on wide nodes. What is not understood selects nothing."""
    none = F.lit(False)
    if not isinstance(selector, dict):
        return none
    kind = selector.get("type")
    if kind == "kind" and isinstance(selector.get("kind"), str):
        return ascii_lower(F.col("kind")) == selector["kind"].lower()
    if kind == "attribute" and isinstance(selector.get("field"), str) and "equals" in selector:
        return J.equals(F.col("attrs"), selector["field"], selector["equals"])
    if kind == "facet" and isinstance(selector.get("facet"), str) and "equals" in selector:
        name, value = selector["facet"], selector["equals"]
        by_attr = J.equals(F.col("attrs"), name, value)
        mapped = FACETS.get(name.strip().lower())
        if mapped is None or not isinstance(value, str):
            return by_attr
        return by_attr | F.coalesce(F.array_contains("facets", f"{mapped[0]}={value.lower()}"), none)
    if kind == "composite":
        parts = F.lit(True)
        if isinstance(selector.get("and"), list):
            parts = reduce(lambda a, b: a & b, map(compile_selector, selector["and"]), F.lit(True))
        if isinstance(selector.get("or"), list):
            parts = parts & reduce(lambda a, b: a | b, map(compile_selector, selector["or"]), none)
        return parts
    if kind == "saved_query" and selector.get("query") == "all_concepts":
        return F.col("kind") != "Document"
    return none


def has_facet(selector) -> bool:
    if not isinstance(selector, dict):
        return False
    return selector.get("type") == "facet" or any(has_facet(s) for branch in ("and", "or") for s in selector.get(branch) or [])


def combined_selector(parent, child):
    """Both selectors as one flat `and`; one with an `or` stays whole within it."""
    parts = []
    for s in (parent, child):
        if s is None:
            continue
        if isinstance(s, dict) and s.get("type") == "composite" and not s.get("or") and isinstance(s.get("and"), list):
            parts += s["and"]
        else:
            parts.append(s)
    return parts[0] if len(parts) == 1 else {"type": "composite", "and": parts}


# Configurations.


def validate(config: dict) -> None:
    """Raises LensError for a configuration that breaks a rule."""
    lenses = config.get("lenses", [])
    ids = [x.get("id") for x in lenses]
    top = config.get("summary", {}).get("lenses", [])
    if len(set(ids)) != len(ids) or not all(ids):
        raise LensError("lens ids must be there and differ")
    if len(top) > MOST_TOP:
        raise LensError(f"more than {MOST_TOP} top lenses")

    def check_selector(s, where: str) -> None:
        if not isinstance(s, dict) or not s.get("type"):
            raise LensError(f"{where}: a selector needs a type")
        if s["type"] == "composite":
            if not isinstance(s.get("and"), list) and not isinstance(s.get("or"), list):
                raise LensError(f"{where}: a composite selector needs a branch")
            for branch in ("and", "or"):
                for part in s.get(branch) or []:
                    check_selector(part, where)

    for x in lenses:
        if len(x.get("children", [])) > MOST_CHILDREN:
            raise LensError(f"{x['id']}: more than {MOST_CHILDREN} children")
        for c in x.get("children", []):
            if c not in ids:
                raise LensError(f"{x['id']}: unknown child {c}")
        check_selector(x.get("selector"), x["id"])
        for part in ("measure", "health"):
            if (part == "measure" or x.get(part) is not None) and not (x.get(part) or {}).get("type"):
                raise LensError(f"{x['id']}: {part} needs a type")
    for t in top:
        if t not in ids:
            raise LensError(f"unknown lens {t}")


def contexts(config: dict) -> dict[str, dict]:
    """By lens id: the selector with what is inherited, period and as_of (own, parent's, summary's, latest), parent, depth. A lens that is reached twice
    keeps its first context; cycles are refused; hidden lenses are left out."""
    by_id = {x["id"]: x for x in config["lenses"]}
    summary, out = config["summary"], {}

    def visit(lens_id: str, parent: dict | None, trail: tuple[str, ...]) -> None:
        if lens_id in trail:
            raise LensError(f"lenses form a cycle at {lens_id}")
        lens = by_id[lens_id]
        if lens.get("hidden"):
            return
        inherit = (lens.get("context") or {}).get("inherit_selector", True)
        measure = lens.get("measure") or {}
        context = {
            "selector": combined_selector(parent["selector"], lens["selector"]) if parent and inherit else lens["selector"],
            "period": measure.get("period") or (parent or {}).get("period") or summary.get("period") or "latest",
            "as_of": measure.get("as_of") or (parent or {}).get("as_of") or summary.get("as_of") or "latest",
            "parent": trail[-1] if trail else None, "depth": len(trail),
        }
        first = lens_id not in out
        out.setdefault(lens_id, context)
        for child in lens.get("children", []):
            visit(child, context if first else out[lens_id], (*trail, lens_id))

    for lens_id in summary["lenses"]:
        visit(lens_id, None, ())
    return out


def lens_slug(label: str, index: int, used: set[str]) -> str:
    """An id from a label: ASCII, with a number if it is taken; lens_<n> if nothing is left."""
    base = re.sub("[^a-z0-9]+", "_", label.lower()).strip("_") or f"lens_{index + 1}"
    out, n = base, 1
    while out in used:
        n += 1
        out = f"{base}_{n}"
    used.add(out)
    return out


def from_categories(categories: list[dict], kinds: dict[str, str], name: str = "Default") -> dict:
    """A configuration from categories (label, members, headline), at most ten: each counts the nodes of its members' kinds."""
    used: set[str] = set()
    lenses = []
    for k, c in enumerate(categories):
        found = sorted({kinds[m] for m in c["members"] if m in kinds})
        parts = [{"type": "kind", "kind": x} for x in found]
        selector = {"type": "saved_query", "query": "all_concepts"} if not parts else parts[0] if len(parts) == 1 else {"type": "composite", "or": parts}
        lenses.append({"id": lens_slug(c["label"], k, used), "label": c["label"], "context": {"inherit_selector": True}, "selector": selector, "measure": {"type": "count", "period": "latest", "as_of": "latest"}, "health": {"type": "presence", "unknown_when": "missing_or_low_confidence"}, "children": [], "headline_node_id": c.get("headline")})
    return {"summary": {"id": "default", "name": name, "period": "latest", "as_of": "latest", "lenses": [x["id"] for x in lenses]}, "lenses": lenses}


def edit(config: dict, **changes) -> dict:
    """A changed copy: name, period, as_of, order (ids; those left out follow) of the summary; lens=<id> with label, hidden, health, measure_period,
    measure_as_of."""
    out = copy.deepcopy(config)
    for key in ("name", "period", "as_of"):
        if key in changes:
            out["summary"][key] = changes[key]
    if "order" in changes:
        old, new = out["summary"]["lenses"], list(dict.fromkeys(changes["order"]))
        if unknown := [x for x in new if x not in old]:
            raise LensError(f"unknown lens {unknown[0]}")
        out["summary"]["lenses"] = new + [x for x in old if x not in new]
    if "lens" in changes:
        lens = next((x for x in out["lenses"] if x["id"] == changes["lens"]), None)
        if lens is None:
            raise LensError(f"unknown lens {changes['lens']}")
        for key in ("label", "hidden", "health"):
            if key in changes:
                lens[key] = changes[key]
        for key in ("period", "as_of"):
            if f"measure_{key}" in changes:
                lens["measure"][key] = changes[f"measure_{key}"]
    validate(out)
    return out


def scope_key(document_ids: list[str]) -> str:
    """A name for a set of documents."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(document_ids))).encode()).hexdigest()


# Times.


def parse_as_of(text: str | None) -> int | None:
    """Unix seconds of a cutoff; None for latest. A date is its last second in UTC."""
    if text is None or text == "latest":
        return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC)
        return int(day.timestamp()) + 86399
    if re.match(r"\d{4}-\d{2}-\d{2}[Tt ]", text):
        stamp = dt.datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
        if stamp.tzinfo is not None:
            return int(stamp.timestamp())
    raise LensError(f"bad as_of: {text}")


def _in_scope(measure: dict, now: int) -> tuple[Column, bool] | str:
    """(condition on a member's time t, whether it applies), or what is wrong with as_of."""
    period, text = measure.get("period") or "latest", measure.get("as_of") or "latest"
    try:
        cutoff = parse_as_of(text)
    except (LensError, ValueError) as e:
        return str(e)
    if period == "latest" and cutoff is None:
        return F.lit(True), False
    t, anchor = F.col("t"), F.timestamp_seconds(F.lit(cutoff if cutoff is not None else now))
    ok = F.lit(True) if cutoff is None else t <= cutoff
    year = F.year(F.timestamp_seconds(t)) == F.year(anchor)
    if period in ("mtd", "month_to_date"):
        ok = ok & year & (F.month(F.timestamp_seconds(t)) == F.month(anchor))
    elif period in ("ytd", "year_to_date"):
        ok = ok & year
    return ok, True


# Measures.


def _members(g: Graph, lenses: list[tuple[str, dict, dict]]) -> DataFrame:
    """(lens_id, id, kind, attrs, t): nodes by the lenses that select them; each node is looked at once."""
    tags = F.array_compact(F.array(*[F.when(compile_selector(c["selector"]), F.lit(i)) for i, _, c in lenses]))
    rows = wide_nodes(g).select("id", "kind", "attrs", J.node_time(F.col("attrs")).alias("t"), F.explode(tags).alias("lens_id"))
    return rows.select("lens_id", "id", "kind", "attrs", "t")


def _evidence_rows(g: Graph, members: DataFrame, faceted: DataFrame | None, limits: DataFrame) -> DataFrame:
    """(lens_id, evidence_id, o): evidence of MentionedIn edges at members, each once, the first by edge and evidence ids up to the lens's limit; then,
    for faceted(lens_id), what facet edges add. o: (step, edge_id, evidence_id) of the first edge that has it."""
    ids = members.select("lens_id", F.col("id").alias("node")).distinct()

    def of(kinds: tuple[str, ...], who: DataFrame, step: int) -> DataFrame:
        ends = G.undirected(g.edges.where(F.col("kind").isin(*kinds))).select("node", "edge_id")
        o = F.struct(F.lit(step).alias("step"), "edge_id", "evidence_id").alias("o")
        return who.join(ends, "node").join(g.edge_evidence, "edge_id").select("lens_id", "evidence_id", o).groupBy("lens_id", "evidence_id").agg(F.min("o").alias("o"))

    # The bound is a literal: each task keeps that many rows of a lens before they are exchanged.
    first = of(("MentionedIn",), ids, 0).withColumn("k", F.row_number().over(Window.partitionBy("lens_id").orderBy("o"))).where(F.col("k") <= max(EVIDENCE_LIMIT.values()))
    rows = first.join(F.broadcast(limits), "lens_id").where("k <= most").select("lens_id", "evidence_id", "o")
    if faceted is None:
        return rows
    more = of(("InFunction", "ForProduct"), ids.join(F.broadcast(faceted), "lens_id", "left_semi"), 1)
    return rows.unionByName(more.join(rows.select("lens_id", "evidence_id"), ["lens_id", "evidence_id"], "left_anti"))


def _of(g: Graph, ids: DataFrame) -> DataFrame:
    """The evidence with these ids(id), a frame that is shared: few ids go to the evidence, before it is exchanged."""
    return g.evidence.join(G.sized(ids.where("id IS NOT NULL").distinct()), "id", "left_semi")


def member_evidence(g: Graph, members: DataFrame, faceted: DataFrame | None, limits: DataFrame) -> DataFrame:
    """lens_id, evidence_ids (the first MOST_SHOWN, in order), n_evidence, lineage_at (the newest time of all of the evidence)."""
    rows = _evidence_rows(g, members, faceted, limits)
    rows = G.shared(rows)
    times = _of(g, rows.select(F.col("evidence_id").alias("id"))).select(F.col("id").alias("evidence_id"), "ts")
    newest = rows.join(times, "evidence_id", "left").groupBy("lens_id").agg(F.count("*").alias("n_evidence"), F.max("ts").alias("lineage_at"))
    shown = rows.withColumn("k", F.row_number().over(Window.partitionBy("lens_id").orderBy("o"))).where(F.col("k") <= MOST_SHOWN)
    listed = shown.groupBy("lens_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["evidence_id"]).alias("evidence_ids"))
    return newest.join(listed, "lens_id")


def _in_time(g: Graph, lenses: list[tuple[str, dict, dict]], now: int) -> tuple[DataFrame, Column, dict[str, str]]:
    """(members with amount, timeless and in, the unit of a lens, what is wrong with a lens's as_of by lens)."""
    members = _members(g, lenses)
    keep, applies, amount, unit, bad = F.lit(True), F.lit(False), F.lit(None).cast("double"), F.lit("count"), {}
    for i, lens, _ in lenses:
        here, measure = F.col("lens_id") == i, lens["measure"]
        scope = _in_scope(measure, now)
        if isinstance(scope, str):
            bad[i] = scope
            continue
        keep = F.when(here, F.coalesce(scope[0], F.lit(False))).otherwise(keep)
        applies = F.when(here, F.lit(scope[1])).otherwise(applies)
        if measure["type"] == "sum":
            unit = F.when(here, F.lit(measure.get("unit") or "Count")).otherwise(unit)
            if name := measure.get("field") or measure.get("attr"):
                amount = F.when(here, J.number_at(F.col("attrs"), name)).otherwise(amount)
    rows = members.where(~F.col("lens_id").isin(*bad)) if bad else members
    rows = rows.withColumn("amount", amount).withColumn("timeless", applies & F.col("t").isNull()).withColumn("in", ~F.col("timeless") & keep)
    return rows, unit, bad


def _limits(g: Graph, lenses: list[tuple[str, dict, dict]]) -> tuple[DataFrame, DataFrame | None]:
    """(lens_id, most) of lenses, and (lens_id) of those with a facet, if any."""
    make = g.nodes.sparkSession.createDataFrame
    faceted = [(i,) for i, _, c in lenses if has_facet(c["selector"])]
    return make([(i, EVIDENCE_LIMIT[x["measure"]["type"]]) for i, x, _ in lenses], "lens_id string, most int"), make(faceted, "lens_id string") if faceted else None


def _aggregate(g: Graph, lenses: list[tuple[str, dict, dict]], now: int) -> DataFrame:
    """count and sum measures."""
    rows, unit, bad = _in_time(g, lenses, now)
    inside = lambda c: F.when(F.col("in"), c)
    sums = rows.groupBy("lens_id").agg(
        F.count(inside(F.lit(1))).alias("n"), F.count(F.when(F.col("timeless"), 1)).alias("timeless"), F.sum(inside(F.col("amount"))).alias("total"),
    )
    least = rows.where("in").select("lens_id", "id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lens_id").orderBy("id"))).where(F.col("k") <= MOST_SUPPORT)
    supporting = least.groupBy("lens_id").agg(F.array_sort(F.collect_list("id")).alias("supporting"))
    table = [(i, lens["measure"]["type"], bool(lens["measure"].get("field") or lens["measure"].get("attr")), bad.get(i)) for i, lens, _ in lenses]
    all_lenses = g.nodes.sparkSession.createDataFrame(table, "lens_id string, measure_type string, named boolean, wrong string")
    limits, faceted = _limits(g, lenses)
    evidence = member_evidence(g, rows.where("in"), faceted, limits)
    out = all_lenses.join(sums, "lens_id", "left").join(supporting, "lens_id", "left").join(evidence, "lens_id", "left")
    is_sum, none = F.col("measure_type") == "sum", F.array().cast("array<string>")
    value = F.when(F.col("wrong").isNotNull(), None).when(is_sum, F.col("total")).otherwise(F.coalesce("n", F.lit(0)).cast("double"))
    ids = F.coalesce("evidence_ids", none)
    gaps = F.when(F.col("wrong").isNotNull(), F.array(F.lit("invalid_as_of"))).otherwise(
        F.array_compact(F.array(F.when(is_sum & ~F.col("named"), F.lit("missing_sum_field")), F.when(is_sum & F.col("named") & F.col("total").isNull(), F.lit("sum_no_numeric_values")), F.when(F.size(ids) == 0, F.lit("aggregate_not_evidence_backed")), F.when(F.coalesce("timeless", F.lit(0)) > 0, F.lit("temporal_scope_partial"))))
    )
    state = F.when(value.isNull(), "unknown").otherwise("resolved")
    return out.select("lens_id", "measure_type", state.alias("state"), value.alias("value"), unit.alias("unit"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("observed_at"), ids.alias("evidence_ids"), gaps.alias("gaps"), F.coalesce("supporting", none).alias("supporting"), F.col("wrong").alias("explanation"), "lineage_at", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def ref_kpi(g: Graph, asked: DataFrame, now: int) -> DataFrame:
    """For asked(lens_id, kpi, period, cutoff): the KPI's newest value by business time in scope, with its evidence's confidence; else its attribute
    `value`, with its own confidence; else unknown. Differing values at the same time and unit are a conflict."""
    kpis = G.lookup_kpi(g.nodes, asked.select(F.col("kpi").alias("asked")).distinct())
    rows = asked.join(kpis, F.col("kpi") == F.col("asked"), "left").drop("asked")
    values = rows.where("kpi_id IS NOT NULL").join(g.metric_values.withColumnRenamed("kpi_node_id", "kpi_id"), "kpi_id").withColumn("at", series.business_time())
    anchor, at = F.timestamp_seconds(F.coalesce("cutoff", F.lit(now))), F.timestamp_seconds("at")
    year = F.year(at) == F.year(anchor)
    keep = F.when(F.col("period").isin("mtd", "month_to_date"), year & (F.month(at) == F.month(anchor))).when(F.col("period").isin("ytd", "year_to_date"), year).otherwise(F.lit(True))
    values = values.where(keep & (F.col("cutoff").isNull() | (F.col("at") <= F.col("cutoff"))))
    clash = values.groupBy("lens_id", "kpi", "at", ascii_lower(F.col("unit")).alias("u")).agg((F.max("value") - F.min("value") > series.EPSILON).alias("c")).groupBy("lens_id", "kpi").agg(F.bool_or("c").alias("conflict"))
    last = values.groupBy("lens_id", "kpi").agg(F.max(F.struct("at", "observed_at", "id", "value", "unit", "evidence_id")).alias("m"))
    last = G.shared(last)
    conf = _of(g, last.select(F.col("m.evidence_id").alias("id"))).select(F.col("id").alias("v"), F.col("confidence").alias("vc"), F.col("ts").alias("vt"))
    attrs = g.nodes.where("kind = 'Kpi'").select(F.col("id").alias("kpi_id"), J.number_at(F.col("attrs"), "value").alias("av"), F.col("confidence").alias("ac"), J.unit_text(J.text_at(F.col("attrs"), "unit")).alias("au"))
    rows = rows.join(last, ["lens_id", "kpi"], "left").join(clash, ["lens_id", "kpi"], "left").join(attrs, "kpi_id", "left")
    rows = rows.join(conf, F.col("m.evidence_id") == F.col("v"), "left")
    seen, none = F.col("m").isNotNull(), F.array().cast("array<string>")
    value = F.when(seen, F.col("m.value")).otherwise(F.col("av"))
    gaps = F.array_compact(F.array(F.when(F.col("kpi_id").isNull(), F.lit("kpi_not_found")), F.when(~seen & F.col("av").isNotNull(), F.lit("resolved_from_attrs_without_observation")), F.when(F.col("kpi_id").isNotNull() & value.isNull(), F.lit("no_observation")), F.when(F.col("conflict"), F.lit("conflicting_observations"))))
    return rows.select(
        "lens_id", "kpi", "kpi_id", F.when(value.isNull(), "unknown").otherwise("resolved").alias("state"), value.alias("value"), F.when(seen, F.col("m.unit")).otherwise(F.col("au")).alias("unit"), F.when(seen, F.col("vc")).otherwise(F.when(F.col("av").isNotNull(), F.col("ac"))).alias("confidence"),
        F.col("m.at").alias("observed_at"), F.when(seen & F.col("v").isNotNull(), F.array("v")).otherwise(none).alias("evidence_ids"), gaps.alias("gaps"), F.when(F.col("kpi_id").isNotNull(), F.array("kpi_id")).otherwise(none).alias("supporting"),
        F.when(seen, F.col("vt")).alias("lineage_at"),
    )


def _referenced(g: Graph, lenses: list[tuple[str, dict, dict]], now: int) -> DataFrame:
    """ref_kpi and derived measures. A derived one has its own KPI's value and needs all its inputs: those listed, else those it is DerivedFrom. Its
    confidence is the least; evidence of the inputs is added to its own."""
    spark = g.nodes.sparkSession
    rows, derived, explicit, wrong = [], [], [], []
    for i, lens, _ in lenses:
        m = lens["measure"]
        try:
            cutoff = parse_as_of(m.get("as_of"))
        except (LensError, ValueError) as e:
            wrong.append((i, m["type"], str(e)))
            continue
        rows.append((i, str(m.get("kpi") or ""), m.get("period") or "latest", cutoff))
        if m["type"] == "derived":
            derived.append((i,))
            explicit += [(i, str(x)) for x in m.get("inputs") or []]
    schema = "lens_id string, kpi string, period string, cutoff long"
    asked = spark.createDataFrame(rows, schema)
    target = ref_kpi(g, asked, now)
    kind = F.lit("ref_kpi")
    out = target.drop("kpi")
    if derived:
        is_derived = spark.createDataFrame(derived, "lens_id string")
        given = spark.createDataFrame(explicit, "lens_id string, input string")
        linked = target.join(F.broadcast(is_derived), "lens_id", "left_semi").join(given.select("lens_id").distinct(), "lens_id", "left_anti").join(g.edges.where("kind = 'DerivedFrom'").select(F.col("from_id").alias("kpi_id"), F.col("to_id").alias("input")), "kpi_id").select("lens_id", "input")
        inputs = given.unionByName(linked).distinct()
        parts = ref_kpi(g, inputs.join(asked.select("lens_id", "period", "cutoff"), "lens_id").select("lens_id", F.col("input").alias("kpi"), "period", "cutoff"), now)
        sums = parts.groupBy("lens_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.when(F.col("state") == "unknown", F.col("kpi")))), 1, 4).alias("open"), F.min("confidence").alias("least"), F.flatten(F.array_sort(F.collect_list("evidence_ids"))).alias("more"), F.array_sort(F.collect_set("kpi_id")).alias("ids"), F.max("lineage_at").alias("newest"))
        out = out.join(sums, "lens_id", "left").join(is_derived.withColumn("d", F.lit(True)), "lens_id", "left")
        d = F.coalesce("d", F.lit(False))
        failed = d & (F.coalesce(F.size("open"), F.lit(0)) > 0)
        out = out.select(
            "lens_id", F.when(d, "derived").otherwise("ref_kpi").alias("measure_type"), F.when(failed, "unknown").otherwise(F.col("state")).alias("state"), F.when(~failed, F.col("value")).alias("value"), "unit", F.when(d & ~failed, F.least("confidence", "least")).when(~failed, F.col("confidence")).alias("confidence"), "observed_at",
            F.when(d, F.array_distinct(F.concat("evidence_ids", F.coalesce("more", F.array().cast("array<string>"))))).otherwise(F.col("evidence_ids")).alias("evidence_ids"), F.when(failed, F.array_append("gaps", F.lit("derived_inputs_unresolved"))).otherwise(F.col("gaps")).alias("gaps"),
            F.array_distinct(F.concat("supporting", F.coalesce("ids", F.array().cast("array<string>")))).alias("supporting"), F.when(failed, F.concat(F.lit("unresolved inputs: "), F.array_join("open", ", "))).alias("explanation"),
            F.greatest("lineage_at", "newest").alias("lineage_at"),
        )
    else:
        out = out.select("lens_id", kind.alias("measure_type"), "state", "value", "unit", "confidence", "observed_at", "evidence_ids", "gaps", "supporting", F.lit(None).cast("string").alias("explanation"), "lineage_at")
    out = out.withColumn("n_evidence", F.size("evidence_ids").cast("long"))
    if wrong:
        none = F.array().cast("array<string>")
        bad = spark.createDataFrame(wrong, "lens_id string, measure_type string, explanation string")
        out = out.unionByName(bad.select("lens_id", "measure_type", F.lit("unknown").alias("state"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("observed_at"), none.alias("evidence_ids"), F.array(F.lit("invalid_as_of")).alias("gaps"), none.alias("supporting"), "explanation", F.lit(None).cast("long").alias("lineage_at"), F.lit(0).cast("long").alias("n_evidence")))
    return out


def measures(g: Graph, config: dict, now: int, only: list[str] | None = None) -> DataFrame:
    """A row in RESOLUTION for each visible lens."""
    spark = g.nodes.sparkSession
    by_id = {x["id"]: x for x in config["lenses"]}
    todo = [(i, by_id[i], c) for i, c in contexts(config).items() if only is None or i in only]
    parts = []
    groups = ((("count", "sum"), _aggregate), (("ref_kpi", "derived"), _referenced))
    for types, resolve in groups:
        if some := [x for x in todo if x[1]["measure"]["type"] in types]:
            parts.append(resolve(g, some, now))
    if other := [(i, x["measure"]["type"]) for i, x, _ in todo if not any(x["measure"]["type"] in t for t, _ in groups)]:
        none = F.array().cast("array<string>")
        rows = spark.createDataFrame(other, "lens_id string, measure_type string")
        parts.append(rows.select("lens_id", "measure_type", F.lit("unknown").alias("state"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("observed_at"), none.alias("evidence_ids"), F.array(F.lit("unsupported_measure_lineage")).alias("gaps"), none.alias("supporting"), F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("long").alias("lineage_at"), F.lit(0).cast("long").alias("n_evidence")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESOLUTION)


def evidence(g: Graph, config: dict, now: int, only: list[str] | None = None) -> DataFrame:
    """The evidence lineage of all visible lenses, a row each and none left out: lens_id, step (mention, facet or value), edge_id (null for values),
    evidence_id, and of evidence that is there source_node_id, source_node_name (else its id), source_path, source_type, row_ref, quote, ts."""
    validate(config)
    by_id = {x["id"]: x for x in config["lenses"]}
    todo = [(i, by_id[i], c) for i, c in contexts(config).items() if only is None or i in only]
    parts = [g.nodes.sparkSession.createDataFrame([], "lens_id string, step string, edge_id string, evidence_id string")]
    if counted := [x for x in todo if x[1]["measure"]["type"] in ("count", "sum")]:
        limits, faceted = _limits(g, counted)
        rows = _evidence_rows(g, _in_time(g, counted, now)[0].where("in"), faceted, limits)
        parts.append(rows.select("lens_id", F.when(F.col("o.step") == 0, "mention").otherwise("facet").alias("step"), "o.edge_id", "evidence_id"))
    if valued := [x for x in todo if x[1]["measure"]["type"] in ("ref_kpi", "derived")]:
        rows = _referenced(g, valued, now).select("lens_id", F.explode("evidence_ids").alias("evidence_id"))
        parts.append(rows.select("lens_id", F.lit("value").alias("step"), F.lit(None).cast("string").alias("edge_id"), "evidence_id"))
    known = g.evidence.select(F.col("id").alias("evidence_id"), "source_node_id", "source_type", "row_ref", "quote", "ts")
    names = g.nodes.select(F.col("id").alias("source_node_id"), "name", J.text_at(F.col("attrs"), "source_path").alias("source_path"))
    rows = reduce(DataFrame.unionByName, parts).join(known, "evidence_id", "left").join(names, "source_node_id", "left")
    return rows.withColumn("source_node_name", F.coalesce("name", "source_node_id")).drop("name")


# Health.


def unknown_tokens(rule: dict) -> set[str]:
    """What makes a verdict unknown: a list, or a text with commas."""
    said = rule.get("unknown_when")
    if isinstance(said, str):
        text = said.strip().lower()
        return {"missing_evidence", "low_confidence"} if text == "missing_or_low_confidence" else {t.strip() for t in text.split(",") if t.strip()}
    return {t.lower() for t in said if isinstance(t, str)} if isinstance(said, list) else set()


def health_column(rule: dict | None, now: int) -> Column:
    """good, watch, at_risk or unknown, from a resolution's columns. Its age is that of the observation, else of the newest evidence behind it."""
    unknown = F.lit("unknown")
    if not rule:
        return unknown
    value, confidence = F.col("value"), F.col("confidence")
    least = F.lit(float(rule.get("min_confidence", MIN_CONFIDENCE)))
    seen = F.coalesce("observed_at", "lineage_at")
    age = F.floor((F.lit(now) - seen) / 86400)
    stale = seen.isNull() | (age > int(rule.get("max_age_days", MAX_AGE_DAYS)))
    conflict = F.exists("gaps", lambda x: x.contains("conflict"))
    weak = confidence.isNull() | (confidence < least)
    tokens = unknown_tokens(rule)
    tests = [("missing", value.isNull()), ("missing_evidence", F.size("evidence_ids") == 0), ("low_confidence", weak), ("stale", stale), ("stale_source", stale), ("conflicted", conflict)]
    open_ = reduce(lambda a, b: a | b, [c for name, c in tests if name in tokens], F.col("state") == "unknown")
    kind = rule.get("type")
    if kind == "presence":
        verdict = F.lit("good")
    elif kind == "threshold":
        verdict = unknown
        for key, name, test in (("red_gte", "at_risk", lambda x: value >= x), ("watch_lt", "watch", lambda x: value < x), ("green_lt", "good", lambda x: value < x)):
            if isinstance(rule.get(key), int | float):
                verdict = F.when(test(float(rule[key])), F.lit(name)).otherwise(verdict)
    elif kind == "confidence":
        verdict = F.when(weak, unknown).otherwise(F.lit("good"))
    elif kind in ("freshness", "staleness"):
        verdict = F.when(stale, unknown).otherwise(F.lit("good"))
    elif kind == "conflict":
        verdict = F.when(conflict, unknown).otherwise(F.lit("good"))
    else:
        verdict = unknown
    return F.when(open_, unknown).otherwise(F.coalesce(verdict, unknown))


def resolve(g: Graph, config: dict, now: int, only: list[str] | None = None) -> DataFrame:
    """The measures of all visible lenses with their labels, effective contexts and health."""
    validate(config)
    rows = measures(g, config, now, only)
    health, found = F.lit("unknown"), contexts(config)
    for lens in config["lenses"]:
        if lens["id"] in found:
            health = F.when(F.col("lens_id") == lens["id"], health_column(lens.get("health"), now)).otherwise(health)
    labels = g.nodes.sparkSession.createDataFrame([(x["id"], x.get("label") or x["id"], found[x["id"]]["period"], found[x["id"]]["as_of"], found[x["id"]]["parent"]) for x in config["lenses"] if x["id"] in found], "lens_id string, label string, period string, as_of string, parent string")
    return rows.withColumn("health", health).join(F.broadcast(labels), "lens_id")
