"""A bidirectional LSTM that labels every element of a sequence, in numpy, with its training by back-propagation through time."""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
CLIP = 5.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(n_inputs: int, hidden: int, seed: int) -> Weights:
    rng = np.random.default_rng(seed)
    out: Weights = {}
    for side in ("f", "b"):
        out[f"x{side}"] = rng.normal(0, 0.1, (n_inputs, 4 * hidden)).astype(np.float32)
        out[f"h{side}"] = rng.normal(0, 0.1, (hidden, 4 * hidden)).astype(np.float32)
        out[f"c{side}"] = np.repeat([0, 1, 0, 0], hidden).astype(np.float32)
    out["out"] = rng.normal(0, 0.1, (2 * hidden, 1)).astype(np.float32)
    out["bias"] = np.zeros(1, np.float32)
    return out


def _run(gates_in: np.ndarray, w: Weights, side: str, keep: bool):
    """Hidden states (batch, time, hidden) of one direction from its projected inputs, and what the way back needs."""
    batch, time, _ = gates_in.shape
    n = w[f"h{side}"].shape[0]
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    states, trace = np.zeros((batch, time, n), np.float32), []
    for t in range(time):
        z = gates_in[:, t] + h @ w[f"h{side}"]
        gates = _sigmoid(z[:, : 3 * n])
        i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
        before, c = c, f * c + i * g
        flat = np.tanh(c)
        if keep:
            trace.append((i, f, o, g, before, flat, h))
        h = o * flat
        states[:, t] = h
    return states, trace


def _back(x: np.ndarray, w: Weights, side: str, trace, grad: np.ndarray, out: Weights) -> None:
    n = w[f"h{side}"].shape[0]
    dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    dz_all = np.zeros((*grad.shape[:2], 4 * n), np.float32)
    recurrent = np.zeros_like(w[f"h{side}"])
    for t in range(grad.shape[1] - 1, -1, -1):
        i, f, o, g, before, flat, h = trace[t]
        d = grad[:, t] + dh
        dc = dc + d * o * (1 - flat * flat)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), d * flat * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        recurrent += h.T @ dz
        dh, dc = dz @ w[f"h{side}"].T, dc * f
    out[f"h{side}"] = recurrent
    out[f"x{side}"] = np.einsum("btd,btk->dk", x, dz_all, optimize=True)
    out[f"c{side}"] = dz_all.sum(axis=(0, 1))


def _padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded batch, the order that reverses each sequence in place, and which elements are real."""
    lengths = np.array([len(s) for s in sequences])
    time = int(lengths.max())
    x = np.zeros((len(sequences), time, sequences[0].shape[1]), np.float32)
    for row, s in enumerate(sequences):
        x[row, : len(s)] = s
    steps = np.arange(time)
    real = steps < lengths[:, None]
    turned = np.where(real, lengths[:, None] - 1 - steps, steps)
    return x, turned[:, :, None], real


def _forward(sequences: list[np.ndarray], w: Weights, keep: bool):
    x, turned, real = _padded(sequences)
    forth, trace_f = _run(x @ w["xf"] + w["cf"], w, "f", keep)
    x_back = np.take_along_axis(x, turned, axis=1)
    back, trace_b = _run(x_back @ w["xb"] + w["cb"], w, "b", keep)
    found, states = _output(forth, back, turned, w)
    return found, (x, x_back, turned, real, states, trace_f, trace_b)


def _output(forth: np.ndarray, back: np.ndarray, turned: np.ndarray, w: Weights):
    states = np.concatenate([forth, np.take_along_axis(back, turned, axis=1)], axis=2)
    return _sigmoid(states @ w["out"] + w["bias"])[:, :, 0], states


def input_weights(w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Input weights and biases of both directions side by side."""
    return np.hstack([w["xf"], w["xb"]]), np.concatenate([w["cf"], w["cb"]])


def predict_projected(sequences: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """Probabilities from inputs that were already multiplied with ``input_weights``."""
    if not sequences:
        return []
    x, turned, _ = _padded(sequences)
    half = x.shape[2] // 2
    forth, _ = _run(x[:, :, :half], w, "f", False)
    back, _ = _run(np.take_along_axis(x[:, :, half:], turned, axis=1), w, "b", False)
    return [p[: len(s)] for p, s in zip(_output(forth, back, turned, w)[0], sequences)]


def predict(sequences: list[np.ndarray], w: Weights) -> list[np.ndarray]:
    """Probability of the positive label for every element of each sequence."""
    weights, bias = input_weights(w)
    return predict_projected([s @ weights + bias for s in sequences], w)


def gradients(sequences: list[np.ndarray], labels: list[np.ndarray], w: Weights) -> tuple[float, Weights]:
    """Mean cross-entropy of a batch and its gradient."""
    found, (x, x_back, turned, real, states, trace_f, trace_b) = _forward(sequences, w, True)
    truth = np.zeros_like(found)
    for row, y in enumerate(labels):
        truth[row, : len(y)] = y
    n = real.sum()
    p = np.clip(found, 1e-7, 1 - 1e-7)
    loss = -(np.where(real, truth * np.log(p) + (1 - truth) * np.log(1 - p), 0)).sum() / n
    d = (np.where(real, found - truth, 0) / n).astype(np.float32)[:, :, None]
    out: Weights = {"out": np.einsum("bth,bto->ho", states, d), "bias": d.sum(axis=(0, 1))}
    d_states = d @ w["out"].T
    hidden = w["hf"].shape[0]
    _back(x, w, "f", trace_f, d_states[:, :, :hidden], out)
    _back(x_back, w, "b", trace_b, np.take_along_axis(d_states[:, :, hidden:], turned, axis=1), out)
    return float(loss), out


def train(sequences: list[np.ndarray], labels: list[np.ndarray], hidden: int, rounds: int, batch: int, rate: float, seed: int) -> Weights:
    """Adam over batches of sequences of similar length; the same data and seed give the same weights."""
    w = initial(sequences[0].shape[1], hidden, seed)
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    rng, step = np.random.default_rng(seed), 0
    total = rounds * -(-len(sequences) // batch)
    for _ in range(rounds):
        order = np.argsort([len(s) * rng.uniform(0.8, 1.2) for s in sequences])
        for at in rng.permutation(np.arange(0, len(order), batch)):
            step += 1
            part = order[at : at + batch]
            _, grad = gradients([sequences[i] for i in part], [labels[i] for i in part], w)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - 0.9 * step / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g * min(1.0, CLIP / (size + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] -= (now * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return w
