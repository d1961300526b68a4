"""Per-row helper: largest connected common part of two structures."""

from __future__ import annotations

from functools import lru_cache

from compoundry.chem import graph

STEPS = 20_000


@lru_cache(maxsize=4096)
def _ring_facts(text: str):
    mol = graph.cached(text)
    if mol is None:
        return None
    rings = [[tuple(sorted(e)) for e in zip(r, r[1:] + r[:1])] for r in mol.rings()]
    return mol, {e for r in rings for e in r}, rings


def _whole_rings(bonds: set, rings: list[list[tuple]]) -> set:
    """Drop ring bonds whose rings are not completely inside."""
    ring_bonds = {e for r in rings for e in r}
    inside = {e for r in rings if all(x in bonds for x in r) for e in r}
    return {e for e in bonds if e not in ring_bonds or e in inside}


def _largest_piece(bonds: set) -> set:
    """Bonds of the connected piece with most bonds."""
    best, left = set(), set(bonds)
    while left:
        piece, atoms = set(), set(next(iter(left)))
        grown = True
        while grown:
            more = {e for e in left if e[0] in atoms or e[1] in atoms}
            grown = bool(more)
            piece |= more
            left -= more
            atoms |= {i for e in more for i in e}
        if len(piece) > len(best):
            best = piece
    return best


def largest_common(text_a: str, text_b: str, steps: int = STEPS):
    """(atoms of a, atoms of b) of the best common part found within the step budget.

    Elements and bond orders must agree, ring bonds only meet ring bonds, rings only count
    when complete; more bonds win.
    """
    fa, fb = _ring_facts(text_a), _ring_facts(text_b)
    if fa is None or fb is None:
        return None
    (a, ra, rings_a), (b, rb, rings_b) = fa, fb
    key = lambda i, j: (i, j) if i < j else (j, i)
    best: tuple[int, dict] = (0, {})
    left = [steps]
    tried = set()

    def score(m: dict) -> tuple[int, dict]:
        shared = {e for e in a.bonds if e[0] in m and e[1] in m and key(m[e[0]], m[e[1]]) in b.bonds
                  and a.bonds[e] == b.bonds[key(m[e[0]], m[e[1]])] and (e in ra) == (key(m[e[0]], m[e[1]]) in rb)}
        for _ in range(len(shared) + 1):
            kept = _whole_rings(shared, rings_a)
            image = {key(m[e[0]], m[e[1]]): e for e in kept}
            kept = {image[x] for x in _whole_rings(set(image), rings_b)}
            if kept == shared:
                break
            shared = kept
        shared = _largest_piece(shared)
        atoms = {i for e in shared for i in e}
        return len(shared), {i: m[i] for i in atoms}

    def grow(m: dict, used: set) -> None:
        nonlocal best
        state = frozenset(m.items())
        if left[0] <= 0 or state in tried:
            return
        left[0] -= 1
        tried.add(state)
        options = [(u, v) for i, p in m.items() for u in a.nbr[i] if u not in m for v in b.nbr[p]
                   if v not in used and a.el[u] == b.el[v] and a.order(i, u) == b.order(p, v) and (key(i, u) in ra) == (key(p, v) in rb)]
        if not options:
            got = score(m)
            if got[0] > best[0]:
                best = got
            return
        # Extending the first open atom in every way; the atom may also stay out.
        first = options[0][0]
        for u, v in options:
            if u == first:
                grow({**m, u: v}, used | {v})
        if best[0] < len(a.bonds) and best[0] < len(b.bonds):
            rest = [o for o in options if o[0] != first]
            if rest:
                grow({**m, rest[0][0]: rest[0][1]}, used | {rest[0][1]})

    for i in range(len(a.el)):
        for j in range(len(b.el)):
            if a.el[i] == b.el[j] and a.nbr[i] and b.nbr[j] and best[0] < min(len(a.bonds), len(b.bonds)):
                grow({i: j}, {j})
    return a, b, best[1]


def remainder(mol: graph.Molecule, inside: set[int]) -> str:
    """Text of what is left outside of the common part; ``H`` when nothing is."""
    rest = set(range(len(mol.el))) - inside
    return graph.write(mol.part(rest)) if rest else "H"


def matched(text_a: str, text_b: str, min_atoms: int = 4):
    """(shared atoms, rest of a, rest of b), or None when too little is shared or nothing differs."""
    found = largest_common(text_a, text_b)
    if found is None or len(found[2]) < min_atoms:
        return None
    a, b, m = found
    rest_a, rest_b = remainder(a, set(m)), remainder(b, set(m.values()))
    return None if rest_a == rest_b else (len(m), rest_a, rest_b)
