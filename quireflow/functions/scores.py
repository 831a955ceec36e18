"""Scores as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .frames import any_of, let, lookup
from .text import normalize


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(x: Column, top: Column) -> Column:
    """x by the maximum, within 0 and 1; 0 if the maximum isn't positive."""
    return F.when(top > 0, clamp(x / top)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def match_quality(phrase: Column, alias: Column, phrase_tokens: Column, alias_tokens: Column) -> Column:
    """How well a normalised phrase fits an alias: equal 1, alias within phrase .84, phrase within alias .78, else a Jaccard of .72 or more."""
    p, a = F.array_distinct(phrase_tokens), F.array_distinct(alias_tokens)
    near = jaccard(p, a)
    return (
        F.when(phrase == alias, F.lit(1.0))
        .when((F.size(p) == 0) | (F.size(a) == 0), F.lit(0.0))
        .when((F.size(a) >= 2) & (F.size(F.array_except(a, p)) == 0), F.lit(0.84))
        .when((F.size(p) >= 2) & (F.size(F.array_except(p, a)) == 0), F.lit(0.78))
        .when(near >= 0.72, near)
        .otherwise(F.lit(0.0))
    )


def candidate_score(boundary: Column, selector: Column, bow: Column) -> Column:
    return 0.65 * boundary + 0.25 * selector + 0.10 * bow


def concept_importance(rerank: Column, evidence: Column, importance: Column) -> Column:
    return clamp(0.50 * rerank + 0.25 * evidence + 0.25 * importance)


def term_confidence(explicit: Column, corpus: Column, wikidata: Column, generic: Column) -> Column:
    """The stated confidence, else one from where a term is known."""
    built = F.lit(0.82) + F.when(F.lower(F.trim(corpus)) == "both", F.lit(0.06)).otherwise(F.lit(0.0))
    built = built + F.when(F.trim(wikidata) != "", F.lit(0.03)).otherwise(F.lit(0.0)) - F.when(generic, F.lit(0.20)).otherwise(F.lit(0.0))
    stated = F.when(F.coalesce(explicit, F.lit("")) != "", F.coalesce(explicit.try_cast("double"), F.lit(0.0)))
    return F.coalesce(stated, F.greatest(F.lit(0.35), F.least(F.lit(0.95), built)))


def contains_any(text: Column, cues: list[str]) -> Column:
    if len(cues) < 2:
        return any_of([F.contains(text, F.lit(c)) for c in cues])
    return let(text, lambda t: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(t, c)))


def required(pattern: str) -> list[str]:
    """Lower-case texts of which any match of the pattern, without case, has one; none if that isn't known."""
    try:
        parsed = re._parser.parse(pattern)
    except re.error:
        return []

    def of(items) -> list[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if str(op) == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            found, run = [*found, [run] if run else []], ""
            if str(op) == "BRANCH":
                parts = [of(x) for x in value[1]]
                found.append([x for p in parts for x in p] if all(parts) else [])
            elif str(op) == "SUBPATTERN":
                found.append(of(value[3]))
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                found.append(of(value[2]))
        return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=[])

    return of(parsed)


def met(text: Column, lists: list[list[str]]) -> Column:
    """Numbers of the lists of which the text has a member: one pass that finds the longest member at each position, of which others are beginnings."""
    every, starts = sorted({c for cues in lists for c in cues}, key=lambda c: (-len(c), c)), {}
    if not every:
        return F.array().cast("array<int>")
    for c in every:
        starts.setdefault(c[0], []).append(re.escape(c[1:]))
    part = lambda cs: f"(?=[{''.join(map(re.escape, cs))}])(?:{'|'.join(f'{re.escape(c)}(?:{"|".join(starts[c])})' for c in cs)})"
    heads = sorted(starts)
    tree = "|".join(part(heads[k : k + 5]) for k in range(0, len(heads), 5))
    numbers = lambda c: F.array(*[F.lit(k) for k, cues in enumerate(lists) if any(c.startswith(x) for x in cues)])
    table = F.create_map(*[x for c in every for x in (F.lit(c), numbers(c))])
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"(?=({tree}))"), F.lit(1)), lambda c: F.element_at(table, c)))


def matches(text: Column, low: Column, pattern: str) -> Column:
    """text.rlike(pattern) without case; the expression is run only on a text that has what each match has. ``low`` is the text in lower case."""
    hit, cues = text.rlike("(?i)" + pattern), list(dict.fromkeys(required(pattern)))
    return contains_any(low, cues) & hit if cues else hit


def role_of(sentence: Column, section: Column, patterns: list | None = None, section_roles: dict | None = None) -> Column:
    """struct(role, score): the first pattern of a role of the section (.82), else the first of any (.66), else the section's first role (.45)."""
    patterns, allowed = patterns or rules.ROLE_PATTERNS, section_roles or rules.SECTION_ROLES
    needs = [required(p) for _, p in patterns]
    of = lambda r, s: F.struct(F.lit(r).alias("role"), F.lit(s).alias("score"))
    pair = lambda role, score: F.struct(role.alias("role"), F.lit(score).alias("score"))
    first = pair(F.coalesce(lookup({k: v[0] for k, v in allowed.items()}, section), F.lit("background")), 0.45)

    def chosen(near: Column) -> Column:
        hits = [(r, (F.array_contains(near, k) if needs[k] else F.lit(True)) & sentence.rlike("(?i)" + p)) for k, (r, p) in enumerate(patterns)]
        cases = [(section.isin(own) & hit, of(r, 0.82)) for r, hit in hits if (own := [s for s, roles in allowed.items() if r in roles])]
        cases += [(hit, of(r, 0.66)) for r, hit in hits]
        out = F
        for hit, role in cases:
            out = out.when(hit, role)
        return out.otherwise(first)

    return let(met(F.lower(sentence), needs), chosen)


def importance_of(sentence: Column, role: Column, evidence: Column | float = 0.0, cues: str = rules.IMPORTANCE_CUES) -> Column:
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rules.ROLE_WEIGHTS.items() for x in kv]), role), F.lit(0.45))
    bonus = F.when(let(F.lower(sentence), lambda low: matches(sentence, low, cues)), F.lit(0.08)).otherwise(F.lit(0.0))
    return clamp(weight + bonus + 0.25 * (evidence if isinstance(evidence, Column) else F.lit(evidence)))


def evidence_of(sentence: Column, role: Column, importance: Column, cues: list | None = None) -> Column:

    def score(low: Column) -> Column:
        found = [F.when(contains_any(low, words), F.lit(score)).otherwise(F.lit(0.0)) for score, words in cues or rules.EVIDENCE_CUES]
        found.append(F.when(role.isin(rules.EVIDENCE_ROLES), F.lit(0.35)).otherwise(F.lit(0.0)))
        found.append(F.when(importance >= 0.72, F.lit(0.32)).otherwise(F.lit(0.0)))
        return F.least(F.lit(1.0), F.greatest(*found))

    return let(F.lower(sentence), score)


def noisy_phrase(phrase: Column, extra: list[str] | None = None) -> Column:
    special = lambda t: F.size(F.filter(t, lambda x: x.isin("eos", "pad"))) / F.size(t) >= 0.5
    listed = [*rules.NOISY_PHRASES, *rules.LOW_VALUE_PHRASES, *(extra or [])]
    return let(normalize(phrase), lambda n: (F.length(n) < 3) | n.endswith("-") | n.startswith("-") | n.isin(listed) | n.endswith(" gp") | let(F.split(n, " "), special))


def noisy_sentence(sentence: Column, cues: list[str] | None = None, short: list[str] | None = None) -> Column:
    cues = cues or rules.NOISE_CUES
    code = [c for c in cues if c.startswith("code")]
    plain = [c for c in cues if not c.startswith("code")]

    def noisy(n: Column, t: Column) -> Column:
        count = F.when(n == "", F.lit(0)).otherwise(F.size(t))
        marked = contains_any(n, plain) | (contains_any(n, code) & ~contains_any(n, rules.CODE_EXEMPTIONS))
        special = F.size(F.filter(t, lambda x: x.isin("eos", "pad"))) / F.greatest(count, F.lit(1)) > 0.08
        titled = n.startswith("title ") & (count <= 12) | n.startswith("title core contributors")
        such = F.contains(n, F.lit("such as and")) & n.rlike(r"\bsuch as and\b")
        return (n == "") | titled | such | ((count < 8) & ~contains_any(n, short or rules.SHORT_CUES)) | marked | special

    return let(normalize(sentence), lambda n: let(F.split(n, " "), lambda t: noisy(n, t)))


def by_section(section: Column, table: dict[str, list[str]], test) -> Column:
    """A test on the list of the row's section; false where there is none."""
    out = F.lit(False)
    for s, values in table.items():
        out = F.when(section == s, test(values)).otherwise(out)
    return out


def note_score(section: Column, sentence: Column, role: Column, importance: Column, evidence: Column, good: dict | None = None, bad: dict | None = None) -> Column:
    fits = by_section(section, rules.NOTE_ROLES, lambda v: role.isin(v))

    def scored(n: Column) -> Column:
        score = 0.46 * importance + 0.34 * evidence + F.when(fits, F.lit(0.18)).otherwise(F.lit(-0.16))
        score = score + F.when(by_section(section, good or rules.GOOD_CUES, lambda v: contains_any(n, v)), F.lit(0.12)).otherwise(F.lit(0.0))
        score = score - F.when(by_section(section, bad or rules.BAD_CUES, lambda v: contains_any(n, v)), F.lit(0.22)).otherwise(F.lit(0.0))
        return score - F.when(F.size(F.split(n, " ")) < 10, F.lit(0.10)).otherwise(F.lit(0.0))

    return let(let(normalize(sentence), scored), clamp)


def cross_note_score(target: str, sentence: Column, position: Column, role: Column, importance: Column, evidence: Column) -> Column:
    """How well a sentence of any section would serve as a note of the target section."""
    return let(normalize(sentence), lambda n: cross_score(target, n, position, role, importance, evidence))


def cross_score(target: str, n: Column, position: Column, role: Column, importance: Column, evidence: Column) -> Column:
    """cross_note_score of a normalised sentence."""
    plus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = 0.22 * importance + 0.22 * evidence + plus(role.isin(rules.NOTE_ROLES[target]), 0.26) + plus(contains_any(n, rules.BACKFILL_CUES.get(target, [])), 0.20)
    where = {"conclusion": (position >= 0.68, 0.12), "related_work": (position <= 0.45, 0.08), "experiment": (position >= 0.45, 0.08), "method": (position.between(0.15, 0.70), 0.08)}
    if target in where:
        score = score + plus(*where[target])
    if target != "intro":
        score = score - plus(n.startswith("title "), 0.50)
    score = let(score - plus(F.size(F.split(n, " ")) < 10, 0.08), clamp)
    if target == "conclusion":
        strong = any_of([n.startswith(c) for c in rules.CONCLUSION_STARTS]) | contains_any(n, rules.CONCLUSION_ANYWHERE)
        score = F.when(strong, score).otherwise(F.lit(0.0))
    return score


def keyword_matches(text: Column, keywords: Column) -> Column:
    """The keywords that a lower-cased text contains. ``text`` should be a plain column: it is read in a lambda."""
    return F.filter(keywords, lambda k: F.contains(text, k))


def relevance(keyword_share: Column, importance: Column, evidence: Column, role: Column) -> Column:
    return 0.52 * keyword_share + 0.30 * importance + 0.10 * evidence + F.when(role.isin(rules.RELEVANT_ROLES), F.lit(0.08)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def argmax(values: Column) -> Column:
    """Position of the first greatest value, from 0."""
    return F.array_position(values, F.array_max(values)) - 1


def precision(tp: Column, fp: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), precision(tp, fn)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def domain_of(text: Column, category: Column, table: list | None = None) -> Column:
    """The first domain with a cue in the normalised text; else the category or Other."""
    out = F.coalesce(F.when(category != "", category), F.lit("Other"))
    for name, cues in reversed(table or rules.DOMAINS):
        out = F.when(contains_any(text, cues), F.lit(name)).otherwise(out)
    return out
