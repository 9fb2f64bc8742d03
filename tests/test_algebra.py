import itertools

import numpy as np
import pytest

from spinmill.functions.algebra import BadOperator, OpSum, Term
from spinmill.functions.couplings import num_cells, pattern, ring_couplings, spacing  # noqa: F401

SINGLE = {"X": [[0, 1], [1, 0]], "Z": [[-1, 0], [0, 1]], "+": [[0, 0], [1, 0]], "-": [[0, 1], [0, 0]], "P": [[0, 0], [0, 1]], "Q": [[1, 0], [0, 0]]}


def matrix(spec: str, n: int) -> np.ndarray:
    """By Kronecker products; basis state s has bit i up."""
    out = np.eye(2**n)
    for f in spec.split():
        site, kind = int(f[:-1]), f[-1].upper()
        one = np.array([[1.0]])
        for k in range(n):
            one = np.kron(np.array(SINGLE[kind]) if k == site else np.eye(2), one)
        out = out @ one
    return out


def of_term(t: Term, n: int) -> np.ndarray:
    out = np.zeros((2**n, 2**n))
    for s in range(2**n):
        to, sign = t.apply(s)
        out[to, s] += sign
    return out


@pytest.mark.parametrize("length", [1, 2, 3])
def test_strings_against_matrices(length):
    factors = [f"{s}{k}" for s in (0, 1) for k in SINGLE]
    for spec in itertools.product(factors, repeat=length):
        t = Term.parse(" ".join(spec))
        assert (of_term(t, 2) == matrix(" ".join(spec), 2)).all(), spec
        assert (of_term(t.dagger, 2) == matrix(" ".join(spec), 2).T).all(), spec


@pytest.mark.parametrize(("spec", "before", "after", "sign"), [("0+", 0, 1, 1), ("0-", 1, 0, 1), ("64-", 1 << 64, 0, 1), ("0X", 0, 1, 1), ("0X", 1, 0, 1), ("0Z", 1, 1, 1), ("0Z", 0, 0, -1), ("64Z", 0, 0, -1), ("0+ 1- 2+ 3-", 0b111010, 0b110101, 1), ("0- 1+ 2- 3+", 0b110101, 0b111010, 1), ("+", 0, 1, 1)])
def test_actions(spec, before, after, sign):
    assert Term.parse(spec).apply(before) == (after, sign)


def test_identities():
    p = Term.parse
    assert p("0Z") * p("0X") == -1 * (p("0X") * p("0Z")) and p("0Z 1X") == p("1X 0Z") and p("1Z 1Z") == Term()
    assert p("1+ 1Z") == -1 * p("1Z 1+") and p("1X 1+") == p("1- 1+") and p("0Z 0X 0Z") == -1 * p("0X") and p("0X 0Z 0X") == -1 * p("0Z")
    assert p("0+ 0X 0+") == p("0+") and p("1+ 1+").sign == 0 == p("1- 1-").sign
    assert p("0Z 1X") * p("1Z") == p("0Z 1X 1Z") and (p("0+ 1- 2+ 3-") * p("0- 1+ 4- 5+")) == p("0+ 0- 1- 1+ 2+ 3- 4- 5+")
    assert p("0P") == p("0+ 0-") and p("0Q") == p("0- 0+")
    assert p("3+ 7Z").highest == 7 and p("3Z").diagonal and not p("3+").diagonal


@pytest.mark.parametrize("spec", ["0Y", "abc", "1*"])
def test_bad_specifications(spec):
    with pytest.raises(BadOperator):
        Term.parse(spec)


def test_bad_lengths():
    with pytest.raises(BadOperator):
        Term.of("+-", [1])


def test_sums_are_linear_and_multiply():
    a, b = OpSum.of((2.0, "0+ 1-"), (1.0, "0Z"), (1.0, "0Z")), OpSum.of((3.0, "1X"))
    dense = lambda o: sum((c * of_term(t, 2) for t, c in o.parts.items()), np.zeros((4, 4)))
    assert (dense(a * b) == dense(a) @ dense(b)).all() and (dense(a + b) == dense(a) + dense(b)).all()
    assert (dense(a.dagger) == dense(a).T).all() and (dense(0.5 * a) == 0.5 * dense(a)).all()
    assert len(a.diagonal) == 1 and len(a.off_diagonal) == 1


def test_couplings():
    g = ring_couplings(0.02, (0.1, 0.1, 0.1))
    assert g[0] == pytest.approx(-2.2916667e-7, rel=1e-6) and g[1:] == pytest.approx([1.19375e-5] * 3)
    assert ring_couplings(0.3, (0, 0, 0)) == pytest.approx([1.5 * 0.3**3] * 4)


def test_spacings():
    assert spacing("linear", 0, 1, 0.25) == [0, 0.25, 0.5, 0.75] and spacing("log", 0, 2, 1) == pytest.approx([1, 100])
    assert spacing("tanh", -1, 1, 0.7) == pytest.approx([-1, 0, 1]) and num_cells([(8, 0, 0), (0, 8, 0), (0, 0, 8)]) == 4
    with pytest.raises(ValueError):
        spacing("cubic", 0, 1, 1)
