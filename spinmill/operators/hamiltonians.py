"""Ring and Ising Hamiltonians of a lattice, and the operators measured in their states."""

from __future__ import annotations

from itertools import permutations

from ..functions.algebra import OpSum, Term
from ..functions.couplings import axis_fields, ring_couplings
from ..sources.lattice import Lattice


def ring_terms(lat: Lattice, *, partial: bool = False, repeated: bool = True) -> list[tuple[Term, Term, int]]:
    """(O, its adjoint, sublattice) of each ring: raising where the sign is 1. Rings of other than six members only with
    `partial`; those that pass a site twice, as thin lattices have, unless `repeated` is off. Such strings may be zero."""
    out = []
    for _, sl, members, signs in lat.rings:
        if (len(members) != 6 and not partial) or (not repeated and len(set(members)) != len(members)):
            continue
        o = Term.of(["+" if g == 1 else "-" for g in signs], members)
        h = Term.of(["-" if g == 1 else "+" for g in signs[::-1]], members[::-1])
        out.append((o, h, sl))
    return out


def ring_hamiltonian(lat: Lattice, g: list[float], **rings) -> OpSum:
    """Sum over rings of g[sublattice] (O + its adjoint)."""
    out = OpSum()
    for o, h, sl in ring_terms(lat, **rings):
        out.add(g[sl], o)
        out.add(g[sl], h)
    return out


def field_hamiltonian(lat: Lattice, jpm: float, b: tuple[float, float, float], **rings) -> OpSum:
    """Rings with third-order couplings, Ising terms -4 Jpm z_i z_j on bonds, and hops listed by the lattice.

    A four-site hop comes with its adjoint.
    """
    if lat.version is None or float(lat.version) < 1.1:
        raise ValueError("field terms need a lattice of version 1.1 or later")
    out = ring_hamiltonian(lat, ring_couplings(jpm, b), **rings)
    z = [f / 3**0.5 for f in axis_fields(b)]
    for i, j, _ in lat.bonds:
        out.add(-4 * jpm * z[lat.sites[i][1]] * z[lat.sites[j][1]], Term.of("ZZ", (i, j)))
    for pair in lat.neighbour2:
        out.add(jpm / 2, Term.of("+-", pair))
        out.add(jpm / 2, Term.of("-+", pair))
    for four in lat.neighbour4:
        hop = Term.of("+-+-", four)
        out.add(jpm**2 / 4, hop)
        out.add(jpm**2 / 4, hop.dagger)
    return out


def partial_volumes(lat: Lattice, missing: int) -> list[tuple[OpSum, int]]:
    """For each volume: the sum over orders of the product of its ring operators less one."""
    rings = [o for o, _, _ in ring_terms(lat, partial=True)]
    out = []
    for _, sl, faces in lat.volumes:
        total = OpSum()
        for order in permutations([rings[f] for k, f in enumerate(faces) if k != missing]):
            product = Term()
            for t in order:
                product = product * t
            total.add(1.0, product)
        out.append((total, sl))
    return out


def flippability(o: Term, h: Term) -> OpSum:
    """O O+ + O+ O."""
    return OpSum.of((1.0, o * h), (1.0, h * o))


def spin_z(site: int) -> OpSum:
    """S^z of a site: half of Z."""
    return OpSum.of((0.5, Term.single("Z", site)))
