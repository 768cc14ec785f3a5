"""Matching two schemas by similarity flooding.

A schema is a set of dotted field names with kinds.  Its graph has a node for each field, for
each object on the way to it, for each word of a name and for each kind.  Pairs of nodes of
two schemas start with the likeness of their words; likeness then flows along edges of the
same label (a field's object, words and kind) between neighbouring pairs until it no longer
changes.  Correspondences are selected from the converged likeness, relative to that of each
field with itself: best first, each field once, from half of it on.  Fields whose names say
nothing about each other correspond if they are the only ones of their kind at their place
and hold the same values.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: The least likeness of corresponding fields, 1 being that of a field with itself.
ACCEPT = 0.5
#: Without a common word: the share of their values that fields must have in common, and how
#: many different ones each must have for that to count.
SAME_VALUES, LEAST_VALUES = 0.5, 4
#: Passes at most, and the change at which flooding has converged.
MAX_PASSES, EPSILON = 100, 1e-4

Field = tuple[str, str]  # dotted name, kind


@lru_cache(maxsize=65536)
def words(name: str) -> tuple[str, ...]:
    """The words of a dotted name in lower case, without digits at their ends."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)
    return tuple(w.lower() for w in re.split(r"[^A-Za-z0-9]+", spaced) if w)


def _spell_out(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """``a`` with words that are initials of successive words of ``b`` replaced by these."""
    out: list[str] = []
    for w in a:
        hit = next((b[i : i + len(w)] for i in range(len(b) - len(w) + 1) if 1 < len(w) and "".join(x[0] for x in b[i : i + len(w)]) == w), None)
        out += hit or (w,)
    return tuple(out)


def spelled(names: list[str]) -> dict[str, tuple[str, ...]]:
    """The words of each name, initials spelled out by the words of the others."""
    out = {}
    for n in names:
        ws = words(n)
        for m in names:
            ws = _spell_out(ws, words(m))
        out[n] = ws
    return out


def _containers(name: str) -> list[str]:
    parts = name.split(".")
    return [".".join(parts[:i]) for i in range(len(parts))]  # "" is the record


@lru_cache(maxsize=65536)
def evidence(a: str, b: str) -> float:
    """How far two names say the same: the weight of common words over that of the shorter name,
    damped by that of the longer one.  Words that only enclosing objects have count a
    quarter: a field that moves keeps its content."""
    wa, wb = _spell_out(words(a), words(b)), _spell_out(words(b), words(a))
    places = {w for n in (a, b) for c in _containers(n) for w in words(c)}
    last = {w for n in (a, b) for w in words(n.rsplit(".", 1)[-1])}
    w = lambda x: 0.25 if x in places and x not in last else 1.0
    sa, sb = set(wa), set(wb)
    common = sum(w(x) for x in sa & sb)
    if not common:
        return 0.0
    ta, tb = sum(map(w, sa)), sum(map(w, sb))
    return 0.75 * common / min(ta, tb) + 0.25 * common / max(ta, tb)


def flood(old: list[Field], new: list[Field]) -> dict[tuple[str, str], float]:
    """Likeness of each pair of fields, 1 for the most alike."""
    start = {(a, b): 1.0 if a == b else evidence(a, b) for a, _ in old for b, _ in new}
    said = spelled(sorted({n for n, _ in (*old, *new)}))

    def graph(fields: list[Field]) -> dict[str, list[tuple[str, str]]]:
        edges: dict[str, list[tuple[str, str]]] = {"in": [], "word": [], "kind": []}
        for name, kind in fields:
            node = f"f:{name}"
            edges["kind"].append((node, f"k:{kind}"))
            edges["word"] += [(node, f"w:{w}") for w in said[name]]
            chain = _containers(name)
            edges["in"] += [(f"o:{c}", f"o:{p}") for p, c in zip(chain, chain[1:])] + [(node, f"o:{chain[-1]}")]
        return {k: sorted(set(v)) for k, v in edges.items()}

    g, h = graph(old), graph(new)
    sigma: dict[tuple[str, str], float] = {(f"f:{a}", f"f:{b}"): s for (a, b), s in start.items()}
    base = dict(sigma)
    for label, s in (("word", 1.0), ("kind", 0.2), ("in", 0.2)):
        for _, x in g[label]:
            for _, y in h[label]:
                base.setdefault((x, y), s if x == y else 0.0)
    sigma = dict(base)
    links: list[tuple[tuple[str, str], tuple[str, str], float]] = []
    for label in g:
        out: dict[tuple[str, str], list[tuple[str, str]]] = {}
        back: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for x, x2 in g[label]:
            for y, y2 in h[label]:
                p, q = (x, y), (x2, y2)
                if base.get(q, 0.0) > 0 or label == "in":
                    out.setdefault(p, []).append(q)
                    back.setdefault(q, []).append(p)
        links += [(p, q, 1 / len(qs)) for p, qs in out.items() for q in qs]
        links += [(q, p, 1 / len(ps)) for q, ps in back.items() for p in ps]
    for _ in range(MAX_PASSES):
        step = {k: sigma.get(k, 0.0) + base.get(k, 0.0) for k in {**base, **sigma}}
        for p, q, w in links:
            step[q] = step.get(q, 0.0) + w * (sigma.get(p, 0.0) + base.get(p, 0.0))
        top = max(step.values(), default=0.0) or 1.0
        step = {k: v / top for k, v in step.items()}
        moved = sum(abs(v - sigma.get(k, 0.0)) for k, v in step.items())
        sigma = step
        if moved < EPSILON:
            break
    return {(a, b): sigma[(f"f:{a}", f"f:{b}")] for a, b in start}


@lru_cache(maxsize=4096)
def correspondences(old: tuple[Field, ...], new: tuple[Field, ...]) -> tuple[tuple[str, str], ...]:
    """(old name, new name) of fields that go on under another name."""
    a, b = dict(old), dict(new)
    gone, came = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if not gone or not came:
        return ()
    both = [*old, *((y, b[y]) for y in came)]
    likeness = flood(both, both)
    relative = {(x, y): likeness[(x, y)] / (likeness[(x, x)] * likeness[(y, y)]) ** 0.5 for x in gone for y in came}
    out: dict[str, str] = {}
    # among near equals the names themselves decide
    for x, y in sorted(relative, key=lambda p: (-relative[p] * (1 + evidence(*p)), p)):
        if relative[(x, y)] >= ACCEPT and x not in out and y not in out.values():
            out[x] = y
    return tuple(out.items())


def _alone(fields: set[str], kinds: dict[str, str]) -> dict[tuple[str, str], str]:
    """Fields that are the only ones of their place and kind."""
    at: dict[tuple[str, str], list[str]] = {}
    for n in fields:
        at.setdefault((n.rpartition(".")[0], kinds[n]), []).append(n)
    return {k: v[0] for k, v in at.items() if len(v) == 1}


def changes(old: tuple[Field, ...], new: tuple[Field, ...], values: tuple[dict, dict] = ({}, {})) -> list[tuple[str, str, str | None]]:
    """(field_name, change_kind, new name) from one schema to the next; the name is the old one,
    for added fields the new one.  A field that keeps its name keeps its identity.  ``values``:
    for the fields of both, hashes of some of their values (the smallest ones)."""
    a, b = dict(old), dict(new)
    renamed = dict(correspondences(old, new))
    gone, came = set(a) - set(b) - set(renamed), set(b) - set(a) - set(renamed.values())
    single = _alone(came, b)
    for place, x in _alone(gone, a).items():
        y = single.get(place)
        u, v = set(values[0].get(x) or ()), set(values[1].get(y) or ())
        if y and min(len(u), len(v)) >= LEAST_VALUES and len(u & v) >= SAME_VALUES * min(len(u), len(v)) and not set(words(x)) & set(words(y)):
            renamed[x] = y
    out: list[tuple[str, str, str | None]] = []
    for x in sorted(a):
        y = renamed.get(x, x if x in b else None)
        if y is None:
            out.append((x, "removed", None))
            continue
        if y != x:
            out.append((x, "renamed", y))
        if a[x] != b[y]:
            out.append((x, "retyped", y))
    return out + [(y, "added", y) for y in sorted(set(b) - set(a) - set(renamed.values()))]
