"""Cells over many steps as one node of the tape, against the plain cell."""

import numpy as np
import pytest

from seriesmend.operators import recurrent, tape
from seriesmend.operators.tape import Node


def nodes_below(top: Node) -> int:
    seen, stack = set(), [top]
    while stack:
        x = stack.pop()
        if id(x) not in seen:
            seen.add(id(x))
            stack += [p for p, _ in x.parents]
    return len(seen)


@pytest.mark.parametrize("net", [recurrent.SequenceAutoEncoder(3), recurrent.Forecaster(1, hidden=3, layers=2), recurrent.EncoderForecaster(1, hidden=3)])
def test_longer_windows_are_no_more_nodes(net):
    def size(length: int) -> int:
        p = {k: Node(v) for k, v in net.start(np.random.default_rng(0), length, 2).items()}
        return nodes_below(net.losses(p, np.random.default_rng(1).normal(size=(4, length, 2)), 0)[0][0])

    assert size(20) == size(5)


@pytest.mark.parametrize("times", [0, 6])
def test_cells_are_the_plain_cell_step_by_step(times):
    rng = np.random.default_rng(3)
    x, w, h, c = rng.normal(size=(1 if times else 6, 2, 5)), 2 * rng.normal(size=(2 + 3 + 1, 12)), rng.normal(size=(3, 5)), rng.normal(size=(3, 5))

    def plain():
        of = [Node(v) for v in (x, w, h, c)]
        state, loss = (of[2].swap(0, 1), of[3].swap(0, 1)), Node(0.0)
        for k in range(6):
            state = recurrent.cell(of[0][0 if times else k].swap(0, 1), state, of[1])
            loss = loss + tape.squares(state[0]).sum() * (k + 1)
        return of, loss + state[1].sum()

    def fused():
        of = [Node(v, ((Node(v), lambda g: g),)) if i == 0 else Node(v) for i, v in enumerate((x, w, h, c))]
        steps, _, memory = recurrent.cells(of[0], of[1], (of[2], of[3]), times)
        return of, (tape.squares(steps) * np.arange(1.0, 7.0)[:, None, None]).sum() + memory.sum()

    (a, la), (b, lb) = plain(), fused()
    tape.backward(la)
    tape.backward(lb)
    assert np.isclose(la.value, lb.value, rtol=1e-12)
    for p, q in zip(a, b, strict=True):
        np.testing.assert_allclose(p.grad, q.grad, rtol=1e-9, atol=1e-11)
