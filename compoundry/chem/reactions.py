"""Per-row helper that applies one reaction rule to its reactants."""

from __future__ import annotations

import re
from functools import lru_cache

from compoundry.chem import graph, patterns


def _parts(side: str) -> list[str]:
    """Templates of one side, split at dots outside of brackets."""
    out, depth, cur = [], 0, ""
    for ch in side:
        depth += (ch in "[(") - (ch in "])")
        if ch == "." and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [p for p in out + [cur] if p]


@lru_cache(maxsize=4096)
def compile_rule(text: str):
    """(reactant patterns, product patterns); raises ValueError on unreadable rules."""
    sides = text.strip().split(">")
    if len(sides) != 3 or not sides[0] or not sides[2]:
        raise ValueError(f"not a reaction rule: {text!r}")
    return ([patterns.compile_pattern(p) for p in _parts(sides[0])], [patterns.compile_pattern(p) for p in _parts(sides[2])])


def readable(text: str) -> bool:
    try:
        compile_rule(text)
        return True
    except (ValueError, IndexError):
        return False


def _valence(mol: graph.Molecule, i: int) -> float:
    return sum(1.5 if mol.order(i, j) == 1.5 else mol.order(i, j) for j in mol.nbr[i]) + (mol.h[i] or 0)


def _build(mols, hits, left, right):
    """Product structure of one embedding, with the first atom of every product template."""
    wanted = {m for p in right for m in p.labels if m}
    out, at, by_label, before = graph.Molecule(), {}, {}, {}
    for r, (mol, hit) in enumerate(zip(mols, hits)):
        matched = {i: left[r].labels[k] for k, i in enumerate(hit)}
        for i in range(len(mol.el)):
            label = matched.get(i)
            if label is not None and label not in wanted:
                continue
            at[r, i] = out.add(mol.el[i], mol.arom[i], mol.chg[i], mol.iso[i], mol.h[i])
            before[at[r, i]] = _valence(mol, i)
            if label:
                by_label[label] = at[r, i]
    # A bond left open on both sides of the rule keeps its order, else it is single.
    old_orders = {}
    for r, (mol, hit) in enumerate(zip(mols, hits)):
        edges = {tuple(sorted((hit[a], hit[b]))): sym for a, b, sym in left[r].edges}
        for (i, j), o in mol.bonds.items():
            if (r, i) in at and (r, j) in at:
                key = tuple(sorted((at[r, i], at[r, j])))
                if edges.get((i, j), "") == "":
                    old_orders[key] = o
                if (i, j) not in edges:
                    out.bond(*key, o)
    heads, fixed = [], set()
    for p in right:
        place = []
        for label, text in zip(p.labels, p.texts):
            body = re.sub(r":\d+$", "", text)
            if label in by_label:
                i = by_label[label]
            else:
                sym = re.match(r"Cl|Br|[A-Za-z*]", re.sub(r"^\d+", "", body.split(",")[0].lstrip("#!")))
                el = sym.group() if sym else "C"
                i = out.add(el.capitalize(), el.islower(), 0, 0, None)
            charge = re.search(r"(\+\d+|-\d+|\++|-+)$", body.split(";")[0]) if "[" not in body and len(body) > 1 else None
            if charge:
                c = charge.group()
                out.chg[i] = int(c) if len(c) > 1 and c[1].isdigit() else c.count("+") - c.count("-")
                if out.h[i] is None:
                    hydrogens = re.search(r"H(\d*)", body)
                    out.h[i] = int(hydrogens.group(1) or 1) if hydrogens else 0
            place.append(i)
        heads.append(place[0])
        for a, b, sym in p.edges:
            key = tuple(sorted((place[a], place[b])))
            order = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5}.get(sym, old_orders.get(key, 1.0))
            if key not in out.bonds:
                out.bond(*key, order)
        fixed |= set(place)
    for i in fixed:
        if i in before:
            used = _valence(out, i) - (out.h[i] or 0)
            out.h[i] = max(0, int(round(before[i] - used)) if not out.arom[i] else out.h[i])
    # Atoms that no longer sit in an aromatic ring lose the flag.
    for i in range(len(out.el)):
        if out.arom[i] and not any(out.order(i, j) == 1.5 for j in out.nbr[i]):
            out.arom[i] = False
    graph._hydrogens(out)
    return out, heads


def run(rule: str, reactants: list[str]) -> list[str]:
    """Product texts of all embeddings, in order; parts in template order, repeats kept."""
    left, right = compile_rule(rule)
    mols = [graph.cached(t) for t in reactants]
    if len(mols) != len(left) or None in mols:
        return []
    products = []

    def choose(hits):
        if len(hits) < len(left):
            for hit in patterns.matches(mols[len(hits)], left[len(hits)]):
                choose(hits + [hit])
            return
        try:
            whole, heads = _build(mols, hits, left, right)
        except (ValueError, KeyError):
            return
        parts = []
        for head in heads:
            piece = next(f for f in whole.fragments() if head in f)
            text = graph.write(whole.part(piece))
            if graph.cached(text) is not None:
                parts.append(text)
        if parts:
            products.append(".".join(dict.fromkeys(parts) if len(set(heads)) < len(parts) else parts))

    choose([])
    return products
