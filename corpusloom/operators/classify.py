"""Term matching, relevance gates, multi-label classification and scores. Every operator is one narrow projection.

A whole dictionary is matched in one pass over a text: one pattern finds, at every word's start, the longest listed
term, and terms that it begins with are known beforehand. What follows works on the short array of terms that occur.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, empty_if_null, let, nfkc_lower
from ..storage import small

_WORDS = re.compile(r"[a-z0-9]+(?:[ -][a-z0-9]+)*")


@dataclass(frozen=True)
class Topic:
    id: str
    name: str
    keywords: tuple[str, ...]
    priority: int = 0


@dataclass(frozen=True)
class Topics:
    """The dictionary that records are classified by; ``gates`` maps a topic to a rule of ``Gate``."""

    topics: tuple[Topic, ...]
    priority_terms: tuple[str, ...] = ()
    strong_gate: tuple[str, ...] = ()
    physics_gate: tuple[str, ...] = ()
    ai_gate: tuple[str, ...] = ()
    ai_methods: tuple[str, ...] = ()
    gates: dict = field(default_factory=dict)
    general: str = ""
    fallback: str = "frontiers"
    source_fallbacks: tuple[tuple[tuple[str, ...], str], ...] = ()


@dataclass(frozen=True)
class Gate:
    """A topic's hits count if one is a strong term, or its context is there and it isn't excluded (K2)."""

    strong: tuple[str, ...] = ()
    context: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    core_sources: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()


def term_hit(lowered: Column, term: str) -> Column:
    """Whether a literal term is in lower-cased text; words need ``[a-z0-9]`` boundaries, other terms don't."""
    t = term.strip().lower()
    if _WORDS.fullmatch(t):
        return lowered.rlike("(?<![a-z0-9])" + t.replace(" ", r"\s+") + "(?![a-z0-9])")
    return F.contains(lowered, F.lit(t))


def match_count(lowered: Column, terms) -> Column:
    """How many of the listed terms occur."""
    return F.size(term_hits(lowered, terms))


def _norm(term: str) -> str:
    return term.strip().lower()


def _pattern(words: list[str]) -> str:
    """Words' alternatives, grouped by first letter, the longest first."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(w[1:].replace(" ", r"\s+"))
    groups = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(by_letter.items()))
    return f"(?<![a-z0-9])(?=((?:{groups})(?![a-z0-9])))"


def found_terms(lowered: Column, terms) -> Column:
    """The normalised terms that occur in lower-cased text, in no order; words by one pattern, other terms each by itself."""
    norm = sorted({_norm(t) for t in terms})
    words = [t for t in norm if _WORDS.fullmatch(t)]
    other = [F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in norm if not _WORDS.fullmatch(t)]
    parts = [F.array_compact(F.array(*other))] if other else []
    if words:
        hits = F.array_distinct(F.regexp_extract_all(lowered, F.lit(_pattern(words)), 1))
        if any(" " in w for w in words):
            hits = F.transform(hits, lambda h: F.regexp_replace(h, r"\s+", " "))
        begun = {w: [v for v in words if w != v and w.startswith(v) and w[len(v)] in " -"] for w in words}
        implied = lambda h: [F.when(F.array_contains(h, w), F.array(*map(F.lit, short))) for w, short in begun.items() if short]
        # ``let``: the text is read once, and not again for each term that begins with another
        parts.append(let(F.array_distinct(hits), lambda h: F.concat(h, F.flatten(F.array_compact(F.array(*implied(h)))))) if any(begun.values()) else hits)
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def listed(found: Column, terms) -> Column:
    """Of ``found_terms``, those of a list, in the list's order and spelling."""
    return F.array_compact(F.array(*[F.when(F.array_contains(found, _norm(t)), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def term_hits(lowered: Column, terms) -> Column:
    """The terms that occur, in the list's order; the text is read once, not once for each term."""
    return let(found_terms(lowered, terms), lambda found: listed(found, terms))


def _met(found: Column, terms) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(_norm(t)) for t in terms])) if terms else F.lit(False)


def _any(lowered: Column, terms) -> Column:
    return F.size(found_terms(lowered, terms)) > 0 if terms else F.lit(False)


def relevant(title: Column, abstract: Column, mode: Column, topics: Topics) -> Column:
    """By the source's mode. ``all`` keeps all; ``important-ai`` needs a gate term and a method; others
    need a strong term, or a priority term together with a physics term."""
    text = F.lower(F.concat_ws(" ", empty_if_null(title), empty_if_null(abstract)))
    ai = _any(text, topics.ai_gate) & _any(text, topics.ai_methods)
    other = _any(text, topics.strong_gate) | (_any(text, topics.priority_terms) & _any(text, topics.physics_gate))
    return F.when(mode == "all", True).when(mode == "important-ai", ai).otherwise(other)


def notice_relevant(title: Column, summary: Column, scope: Column, category: Column, rejected, wanted, trusted, societies) -> Column:
    """A rejected title goes; trusted categories stay with a wanted title, and else unless the details are rejected;
    other notices need clean details and a wanted title."""
    rejected, wanted, societies = ([w.lower() for w in terms] for terms in (rejected, wanted, societies))
    t = nfkc_lower(empty_if_null(title))
    detail = nfkc_lower(F.concat_ws(" ", empty_if_null(title), empty_if_null(summary), empty_if_null(scope)))
    return (
        F.when(any_of(t, rejected), False)
        .when(category.isin(*trusted) & (any_of(t, wanted) | any_of(t, societies)), True)
        .when(any_of(detail, rejected), False)
        .otherwise(F.coalesce(category.isin(*trusted), F.lit(False)) | any_of(t, wanted))
    )


def source_term_gate(records: DataFrame, sources: DataFrame) -> DataFrame:
    """C4: records whose title holds no excluded term of their source, one of its included terms if it has any, and one of
    its required ones if it has any. ``sources(source, include, exclude, require_any)`` is a small dimension."""
    has = lambda terms: F.exists(terms, lambda t: F.contains(F.col("_title"), F.lower(t)))
    r = records.withColumn("_title", F.lower(empty_if_null(F.col("title")))).join(small(sources), "source", "left")
    empty = F.array().cast("array<string>")
    inc, exc, req = (F.coalesce(F.col(c), empty) for c in ("include", "exclude", "require_any"))
    keep = ~has(exc) & ((F.size(inc) == 0) | has(inc)) & ((F.size(req) == 0) | has(req))
    return r.where(keep).drop("_title", "include", "exclude", "require_any")


def _gate(found: Column, lowered: Column, source: Column, hits: Column, gate: Gate) -> Column:
    core = any_of(source, gate.core_sources) if gate.core_sources else F.lit(False)
    strong = F.arrays_overlap(F.transform(hits, lambda h: F.lower(h)), F.array(*[F.lit(s.lower()) for s in gate.strong])) if gate.strong else F.lit(False)
    context = _met(found, gate.context)
    if gate.also:
        context = context & _met(found, gate.also)
    excluded = any_of(lowered, gate.excluded) & ~core if gate.excluded else F.lit(False)
    return strong | (~excluded & (core | context))


def dictionary(topics: Topics) -> list[str]:
    """All terms that classification looks for."""
    terms = [k for t in topics.topics for k in t.keywords] + [*EXPERIMENTAL, *THEORETICAL, *REVIEW]
    return terms + [c for g in topics.gates.values() for c in (*g.context, *g.also)]


def classify(records: DataFrame, topics: Topics, found: str, text: str, source: str, defaults: Column | None = None) -> DataFrame:
    """K1-K3: ``records`` with ``categories`` and ``tags``, out of the columns of found terms, lower-cased text and source.

    Topics whose hits pass their gate are ordered by hits, priority, name; the first four and the source's default topics
    are then ordered by priority (ties as before) and cut to four. Tags are the first three hits of each passing topic, at
    most eight. Without categories: the defaults, the source's fallback, the general fallback.
    """
    known = [t.id for t in topics.topics]
    empty = F.array().cast("array<string>")
    # Each step is a column of its own, used more than once and so computed once.
    r = records.withColumns({f"_h{i}": listed(F.col(found), t.keywords) for i, t in enumerate(topics.topics)})
    passes = {}
    for i, t in enumerate(topics.topics):
        own = F.size(f"_h{i}") > 0
        passes[i] = own & _gate(F.col(found), F.col(text), F.col(source), F.col(f"_h{i}"), topics.gates[t.id]) if t.id in topics.gates else own
    scored = [F.when(passes[i], F.struct((-F.size(f"_h{i}")).alias("h"), F.lit(-t.priority).alias("p"), F.lit(t.name).alias("n"), F.lit(t.id).alias("id"), F.slice(f"_h{i}", 1, 3).alias("tags"), F.lit(i).alias("i"))) for i, t in enumerate(topics.topics)]
    r = r.withColumn("_passing", F.array_compact(F.array(*scored))).drop(*[f"_h{i}" for i in passes])
    first = F.slice(F.array_sort("_passing"), 1, 4)
    supplied = F.filter(F.coalesce(defaults, empty), lambda c: c.isin(*known)) if defaults is not None else empty
    r = r.withColumn("_supplied", supplied)
    ids = F.array_distinct(F.concat(F.transform(first, lambda s: s["id"]), F.filter("_supplied", lambda c: c != topics.general)))
    priority = F.create_map(*[F.lit(x) for t in topics.topics for x in (t.id, t.priority)])
    ranked = F.array_sort(F.transform(ids, lambda c, i: F.struct((-F.coalesce(F.try_element_at(priority, c), F.lit(0))).alias("p"), i.alias("i"), c.alias("id"))))
    r = r.withColumn("_ids", F.slice(F.transform(ranked, lambda s: s["id"]), 1, 4))
    fallback = F.lit(topics.fallback)
    for names, category in reversed(topics.source_fallbacks):
        fallback = F.when(any_of(F.col(source), names), category).otherwise(fallback)
    categories = F.when(F.size("_ids") > 0, F.col("_ids")).when(F.size("_supplied") > 0, F.col("_supplied")).otherwise(F.array(fallback))
    tags = F.slice(F.array_distinct(F.flatten(F.transform("_passing", lambda s: s["tags"]))), 1, 8)
    return r.withColumns({"categories": categories, "tags": tags}).drop("_passing", "_supplied", "_ids")


#: Words of the methods.
EXPERIMENTAL = ("measurement", "experiment", "spectroscopy", "measured", "detector", "data acquisition", "beam time")
THEORETICAL = ("theory", "theoretical", "calculation", "shell model", "density functional", "ab initio", "simulation", "prediction")
REVIEW = ("review", "overview", "progress in", "status report")


def methods(found: Column, source: Column, experimental=EXPERIMENTAL, theoretical=THEORETICAL, review=REVIEW) -> Column:
    """K4, out of found terms and the lower-cased source."""
    return F.array_compact(
        F.array(
            F.when(F.contains(source, F.lit("nucl-ex")) | _met(found, experimental), F.lit("experimental")),
            F.when(F.contains(source, F.lit("nucl-th")) | _met(found, theoretical), F.lit("theoretical")),
            F.when(_met(found, review), F.lit("review")),
        )
    )


def importance(records: DataFrame, hits: Column, abstract: Column, weight: Column, topics: Topics) -> DataFrame:
    """K6: ``records``, which have categories, with ``importance``, up to 100, and ``score_reasons``, its parts: source weight, topic
    priority, priority terms, breadth, abstract."""
    priority = F.create_map(*[F.lit(x) for t in topics.topics for x in (t.id, t.priority)])
    r = records.withColumn(
        "_parts",
        F.struct(
            (weight * 8).alias("weight"),
            F.coalesce(F.array_max(F.transform("categories", lambda c: F.coalesce(F.try_element_at(priority, c), F.lit(0)))), F.lit(0)).alias("focus"),
            F.least(F.lit(20), hits * 8).alias("breakthrough"),
            F.when(F.size("categories") > 1, F.least(F.lit(6), (F.size("categories") - 1) * 2)).otherwise(0).alias("breadth"),
            F.when(empty_if_null(abstract) != "", 2).otherwise(0).alias("full"),
        ),
    )
    part = lambda c: F.col(f"_parts.{c}")
    score = F.least(F.lit(100), part("weight") + part("focus") + part("breakthrough") + part("breadth") + part("full"))
    reason = lambda label, n: F.when(n > 0, F.concat(F.lit(f"{label} +"), n.cast("string")))
    reasons = F.array_compact(
        F.array(F.concat(F.lit("来源权重 +"), part("weight").cast("string")), reason("核物理研究侧重", part("focus")), reason("突破性表述", part("breakthrough")), reason("跨领域关联", part("breadth")), F.when(part("full") > 0, F.lit("完整摘要 +2")))
    )
    return r.withColumns({"importance": score, "score_reasons": reasons}).drop("_parts")


def reclassify(records: DataFrame, topics: Topics, sources: DataFrame | None = None) -> DataFrame:
    """K8: categories, tags, methods, primary topic, confidence, evidence and importance of every record anew (K1-K6).

    ``sources(source, weight, default_categories)`` is a small dimension; an unknown source has weight 3.
    """
    r = records
    if sources is not None:
        r = r.join(small(sources.select("source", "weight", "default_categories")), "source", "left")
    weight = F.coalesce(F.col("weight"), F.lit(3)) if "weight" in r.columns else F.lit(3)
    defaults = F.col("default_categories") if "default_categories" in r.columns else None
    body = F.concat_ws(" ", empty_if_null(F.col("title")), empty_if_null(F.col("abstract")))
    source = F.lower(empty_if_null(F.col("source")))
    r = r.withColumns({"_body": F.lower(body), "_source": source}).withColumn("_text", F.concat_ws(" ", "_body", "_source"))
    r = r.withColumns({"_found": found_terms(F.col("_text"), dictionary(topics)), "_hits": F.size(found_terms(F.col("_body"), topics.priority_terms))})
    r = classify(r, topics, "_found", "_text", "_source", defaults)
    r = r.withColumn("methods", methods(F.col("_found"), F.col("_source")))
    r = importance(r, F.col("_hits"), F.col("abstract"), weight, topics)
    n = F.size("tags")
    return r.withColumns(
        {
            "primary_topic": F.coalesce(F.get("categories", F.lit(0)), F.lit(topics.fallback)),
            "classification_confidence": F.round(F.when(n > 0, F.least(F.lit(0.98), 0.48 + n * 0.08)).otherwise(0.38), 2),
            "classification_evidence": F.slice("tags", 1, 6),
        }
    ).drop("weight", "default_categories", "_body", "_source", "_text", "_found", "_hits")


def notice_labels(text: Column, rules) -> Column:
    """K7: the labels one of whose markers occurs, in the rules' order; ``rules``: (label, markers)."""
    t = nfkc_lower(empty_if_null(text))
    return F.array_distinct(F.array_compact(F.array(*[F.when(any_of(t, [m.lower() for m in markers]), F.lit(label)) for label, markers in rules])))
