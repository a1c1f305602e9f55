"""Closed-form Butterworth band-pass and its block form.

The analogue low-pass prototype has its poles on the left unit half-circle. The band-pass map sends each to two
poles around the centre frequency and adds one zero at 0 per order; the bilinear transform takes them to the
z-plane. This is textbook material; only the band-pass is provided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def bandpass_coefficients(low: float, high: float, sample_hz: float, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital filter, highest power first, ``a[0] == 1``."""
    if not 0 < low < high < sample_hz / 2:
        raise ValueError("the band must satisfy 0 < low < high < sample_hz / 2")
    rate = 2.0 * sample_hz
    edges = rate * np.tan(np.pi * np.array([low, high]) / sample_hz)
    width, centre2 = edges[1] - edges[0], edges[0] * edges[1]
    steps = np.arange(order)
    prototype = np.exp(1j * np.pi * (2 * steps + order + 1) / (2 * order)) * width / 2
    offset = np.sqrt(prototype**2 - centre2 + 0j)
    poles = np.concatenate([prototype + offset, prototype - offset])
    gain = (width**order * rate**order / np.prod(rate - poles)).real
    z_poles = (rate + poles) / (rate - poles)
    z_zeros = np.concatenate([np.ones(order), -np.ones(order)])
    return gain * np.poly(z_zeros).real, np.poly(z_poles).real


@dataclass(frozen=True)
class BlockFilter:
    """The filter as matrices over ``size`` samples: y = x·toeplitz + s·carry, s' = s·advance + x·absorb."""

    size: int
    toeplitz: np.ndarray
    carry: np.ndarray
    advance: np.ndarray
    absorb: np.ndarray

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        """Filter each row of ``x`` from its row of ``state``, or from a zero state."""
        rows, length = x.shape
        padded = -(-length // self.size) * self.size
        source = np.zeros((rows, padded))
        source[:, :length] = x
        out = np.empty((rows, padded))
        state = np.zeros((rows, self.advance.shape[0])) if state is None else state
        for at in range(0, padded, self.size):
            piece = source[:, at : at + self.size]
            out[:, at : at + self.size] = piece @ self.toeplitz + state @ self.carry
            state = state @ self.advance + piece @ self.absorb
        return out[:, :length]


    def end_state(self, x: np.ndarray) -> np.ndarray:
        """State after each row of ``x``, from a zero state. Zeros in front of a row do not matter."""
        rows, length = x.shape
        padded = -(-length // self.size) * self.size
        source = np.zeros((rows, padded))
        source[:, padded - length :] = x
        state = np.zeros((rows, self.advance.shape[0]))
        for at in range(0, padded, self.size):
            state = state @ self.advance + source[:, at : at + self.size] @ self.absorb
        return state


def state_matrices(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Transposed direct form: s' = A s + B x, y = C s + D x."""
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[np.arange(n - 1), np.arange(1, n)] = 1.0
    feed = b[1:] - a[1:] * b[0]
    read = np.zeros(n)
    read[0] = 1.0
    return step, feed, read, float(b[0])


def block_filter(b: np.ndarray, a: np.ndarray, size: int = 128) -> BlockFilter:
    step, feed, read, direct = state_matrices(b, a)
    n = len(a) - 1
    powers = [np.eye(n)]
    for _ in range(size):
        powers.append(step @ powers[-1])
    impulse = np.array([direct] + [read @ powers[i] @ feed for i in range(size - 1)])
    lag = np.arange(size)[None, :] - np.arange(size)[:, None]
    toeplitz = np.where(lag >= 0, impulse[np.clip(lag, 0, None)], 0.0)
    carry = np.stack([read @ powers[i] for i in range(size)], axis=1)
    absorb = np.stack([powers[size - 1 - i] @ feed for i in range(size)], axis=0)
    return BlockFilter(size, toeplitz, carry, powers[size].T.copy(), absorb)


def settle_length(a: np.ndarray, tolerance: float = 1e-15) -> int:
    """Samples after which the state at the start no longer matters: the norm of A^m is below ``tolerance``."""
    step = state_matrices(np.zeros(len(a)), a)[0]
    m, power = 64, np.linalg.matrix_power(step, 64)
    stride = power
    while np.linalg.norm(power, 2) > tolerance:
        power, m = power @ stride, m + 64
        if m > 100_000_000:
            raise ValueError("the filter does not settle")
    return m
