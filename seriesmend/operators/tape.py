"""Gradients of numpy expressions by reverse accumulation: what tasks use to differentiate a network on their own windows.

An expression is built of Nodes by operators and the functions below; backward() gives every Node that it hangs on its gradient. Shapes broadcast as in numpy.
"""

from __future__ import annotations

import math

import numpy as np


class Node:
    """A value, the nodes it was made of, and how its gradient goes on to each of them."""

    __slots__ = ("value", "parents", "grad")

    def __init__(self, value, parents: tuple = ()):
        self.value = np.asarray(value, float)
        self.parents = parents
        self.grad: np.ndarray | None = None

    def __add__(self, other):
        b = node(other)
        return Node(self.value + b.value, ((self, lambda g: _shaped(g, self.value.shape)), (b, lambda g: _shaped(g, b.value.shape)))[: 1 + (b is other)])

    def __sub__(self, other):
        b = node(other)
        return Node(self.value - b.value, ((self, lambda g: _shaped(g, self.value.shape)), (b, lambda g: _shaped(-g, b.value.shape)))[: 1 + (b is other)])

    def __mul__(self, other):
        b = node(other)
        return Node(self.value * b.value, ((self, lambda g: _shaped(g * b.value, self.value.shape)), (b, lambda g: _shaped(g * self.value, b.value.shape)))[: 1 + (b is other)])

    def __matmul__(self, other):
        b = node(other)
        back = lambda x: np.swapaxes(x, -1, -2)
        return Node(self.value @ b.value, ((self, lambda g: _shaped(g @ back(b.value), self.value.shape)), (b, lambda g: _shaped(back(self.value) @ g, b.value.shape))))

    def __getitem__(self, at):
        def spread(g):
            out = np.zeros_like(self.value)
            out[at] = g
            return out

        return Node(self.value[at], ((self, spread),))

    def reshape(self, *shape):
        return Node(self.value.reshape(*shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def swap(self, a: int, b: int):
        return Node(np.swapaxes(self.value, a, b), ((self, lambda g: np.swapaxes(g, a, b)),))

    def sum(self, axis: int | None = None):
        """Over one axis, or all."""
        return Node(self.value.sum(axis=axis), ((self, lambda g: np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.value.shape)),))


def _shaped(g: np.ndarray, shape: tuple) -> np.ndarray:
    """The gradient of what was broadcast from `shape`: added up along the axes that were stretched."""
    if g.shape == shape:
        return g
    g = g.sum(axis=tuple(range(g.ndim - len(shape))))
    return g.sum(axis=tuple(k for k, n in enumerate(shape) if n == 1 and g.shape[k] != 1), keepdims=True)


def node(x) -> Node:
    return x if isinstance(x, Node) else Node(x)


def _each(x: Node, value: np.ndarray, slope: np.ndarray) -> Node:
    return Node(value, ((x, lambda g: g * slope),))


def relu(x: Node) -> Node:
    return _each(x, np.maximum(x.value, 0), (x.value > 0).astype(float))


def sigmoid(x: Node) -> Node:
    y = 1 / (1 + np.exp(-np.clip(x.value, -500, 500)))
    return _each(x, y, y * (1 - y))


def tanh(x: Node) -> Node:
    y = np.tanh(x.value)
    return _each(x, y, 1 - y * y)


def exp(x: Node) -> Node:
    y = np.exp(x.value)
    return _each(x, y, y)


def over_log(x: Node) -> Node:
    """1 / log(x)."""
    y = np.log(x.value)
    return _each(x, 1 / y, -1 / (x.value * y * y))


def softmax(x: Node) -> Node:
    """Along the last axis."""
    e = np.exp(x.value - x.value.max(axis=-1, keepdims=True))
    y = e / e.sum(axis=-1, keepdims=True)
    return Node(y, ((x, lambda g: y * (g - (g * y).sum(axis=-1, keepdims=True))),))


def linear(x: Node, w: Node) -> Node:
    """Rows of x (along its last axis) times w, whose last row is added: one product for all of them, and one node."""
    flat, ways = x.value.reshape(-1, x.value.shape[-1]), w.value[:-1]
    value = flat @ ways
    value += w.value[-1]
    of = lambda g: g.reshape(len(flat), -1)

    def of_weights(g: np.ndarray) -> np.ndarray:
        return np.vstack([flat.T @ of(g), np.ones(len(flat)) @ of(g)])

    of_rows = (x, lambda g: (of(g) @ ways.T).reshape(x.value.shape))
    return Node(value.reshape(*x.value.shape[:-1], -1), ((w, of_weights), of_rows)[: 1 + bool(x.parents)])


def looked(q: Node, k: Node, v: Node, heads: int, mask: Node | None = None) -> Node:
    """What q (n, a, size) finds in v (n, b, size) by its likeness to k (n, b, size), by `heads` parts of the size, as one node. mask (m, a, b; m divides n) is added to the logits of row i in its part i % m.

    Rows are the last axis, so that each operation is over long stretches of memory: products of such small matrices cost more to call than to do."""
    n, a, size = q.value.shape
    b, part = k.value.shape[1], size // heads
    apart = lambda x: np.ascontiguousarray(x.reshape(n, -1, heads, part).transpose(2, 1, 3, 0))
    whole = lambda x: np.ascontiguousarray(x.transpose(3, 1, 0, 2)).reshape(n, -1, size)
    scale, pad = 1 / math.sqrt(part), np.empty((heads, a, b, n))
    qs, ks, vs = apart(q.value), apart(k.value), apart(v.value)

    def over_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """(heads, a, b, n): sums of products over the part."""
        out = x[:, :, None, 0] * y[:, None, :, 0]
        for d in range(1, part):
            out += np.multiply(x[:, :, None, d], y[:, None, :, d], out=pad)
        return out

    def over_rows(p: np.ndarray, x: np.ndarray, axis: int) -> np.ndarray:
        """Sums of p times x over b (axis 2; x has b rows) or over a (axis 1; x has a rows)."""
        out = np.empty((heads, b if axis == 1 else a, part, n))
        for d in range(part):
            np.multiply(p, x[:, :, None, d] if axis == 1 else x[:, None, :, d], out=pad).sum(axis=axis, out=out[:, :, d])
        return out

    p = over_parts(qs, ks)
    p *= scale
    if mask is not None:
        m = len(mask.value)
        p.reshape(heads, a, b, n // m, m)[...] += mask.value.transpose(1, 2, 0)[:, :, None]
    p -= p.max(axis=2, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=2, keepdims=True)
    found: list = []

    def gradients(top: np.ndarray) -> tuple:
        """Of q, k, v and the mask, once for all of them."""
        if found and found[0] is top:
            return found[1]
        g = apart(top)
        dv, dp = over_rows(p, g, 1), over_parts(g, vs)
        dp -= np.multiply(dp, p, out=pad).sum(axis=2, keepdims=True)
        dp *= p
        dm = None if mask is None else dp.reshape(heads, a, b, n // m, m).sum(axis=(0, 3)).transpose(2, 0, 1)
        dp *= scale
        found[:] = [top, (whole(over_rows(dp, ks, 2)), whole(over_rows(dp, qs, 1)), whole(dv), dm)]
        return found[1]

    of = [q, k, v] if mask is None else [q, k, v, mask]
    return Node(whole(over_rows(p, vs, 2)), tuple((x, lambda g, i=i: gradients(g)[i]) for i, x in enumerate(of)))


def squares(x: Node) -> Node:
    return x * x


def joined(parts: list[Node], axis: int) -> Node:
    """Concatenation."""
    ends = np.cumsum([p.value.shape[axis] for p in parts])
    cut = lambda k: (lambda g: g[(slice(None),) * (axis % g.ndim) + (slice(ends[k] - parts[k].value.shape[axis], ends[k]),)])
    return Node(np.concatenate([p.value for p in parts], axis=axis), tuple((p, cut(k)) for k, p in enumerate(parts)))


def backward(top: Node) -> None:
    """grad of every node below `top`, a single number; old gradients of these go."""
    order: list[Node] = []
    seen: set[int] = set()
    stack: list[tuple[Node, bool]] = [(top, False)]
    while stack:
        x, done = stack.pop()
        if done:
            order.append(x)
        elif id(x) not in seen:
            seen.add(id(x))
            stack.append((x, True))
            stack += [(p, False) for p, _ in x.parents]
    for x in order:
        x.grad = None
    top.grad = np.ones_like(top.value)
    for x in reversed(order):
        for p, back in x.parents:
            g = back(x.grad)
            p.grad = g if p.grad is None else p.grad + g
