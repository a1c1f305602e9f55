"""Sequential numpy statements of the rules, used as brute-force checks on small fixtures."""

import numpy as np


def pulses(channels=4, samples=6000, per_channel=12, seed=3, low=100, high=1300, sd=5.0):
    """Noise with Gaussian pulses; the heights cross the artifact limit."""
    rng = np.random.default_rng(seed)
    data = rng.normal(0, sd, (channels, samples))
    axis = np.arange(-30, 31)
    for c in range(channels):
        for at in rng.integers(40, samples - 40, per_channel):
            data[c, at - 30 : at + 31] += rng.uniform(low, high) * np.exp(-0.5 * (axis / 4.0) ** 2)
    return data


def events_of(y, window, factor, offset, limit):
    """Kept (peak, snippet) pairs of one channel, by the written rules."""
    n = len(y)
    level = np.abs(y).sum() / n * factor
    found = []
    for p in range(window + 1, n - (window + 1)):
        if y[p] <= level:
            continue
        ahead = y[p : p + 2 * window]
        if ahead.max() < limit:
            found.append(p + int(ahead.argmax()))
    out = []
    for here, later in zip(found, found[1:]):
        stop = here + window + offset
        if later - here > 1 and stop <= n:
            out.append((here, y[here - (window - offset) : stop]))
    return out


def sequential_filter(b, a, x):
    order = len(a) - 1
    state = [0.0] * (order + 1)
    y = np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + state[0]
        for k in range(order):
            state[k] = state[k + 1] + b[k + 1] * v - a[k + 1] * y[i]
    return y
