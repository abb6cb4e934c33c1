"""A linear-chain conditional random field in numpy: training by gradient on the exact likelihood, batched Viterbi decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Chain:
    """Scores of tags by feature (`emission`, features x tags), of a tag after a tag (`step`), and of first and last tags."""

    emission: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def likelihood(parts: list[np.ndarray], ids: np.ndarray, tags: np.ndarray, mask: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """Penalised mean negative log likelihood of tagged sentences (padded to one length), and its gradient, by forward and backward sums."""
    emission, step, first, last = parts
    count, longest, width = ids.shape
    ends, rows, n_tags = mask.sum(1) - 1, np.arange(count), len(first)
    e = emission[ids].sum(2)
    alpha, beta = np.zeros((count, longest, n_tags)), np.zeros((count, longest, n_tags))
    alpha[:, 0] = first + e[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.where(mask[:, t, None], _logsum(alpha[:, t - 1, :, None] + step, 1) + e[:, t], alpha[:, t - 1])
    beta[:, longest - 1] = last
    for t in range(longest - 2, -1, -1):
        onward = _logsum(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], onward, last)
    total = _logsum(alpha[rows, ends] + last, 1)
    told = (np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] * mask).sum(1) + first[tags[:, 0]] + last[tags[rows, ends]]
    told += (step[tags[:, :-1], tags[:, 1:]] * mask[:, 1:]).sum(1)
    node = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
    gold = np.zeros_like(node)
    gold[rows[:, None], np.arange(longest), tags] = mask
    gap = node - gold
    grads = [decay * p for p in parts]
    for w in range(width):
        np.add.at(grads[0], ids[:, :, w][mask], gap[mask] / count)
    for t in range(1, longest):
        live = mask[:, t]
        joint = np.exp(alpha[live, t - 1, :, None] + step + (e[live, t] + beta[live, t])[:, None, :] - total[live, None, None])
        grads[1] += joint.sum(0) / count
        np.subtract.at(grads[1], (tags[live, t - 1], tags[live, t]), 1.0 / count)
    grads[2] += gap[:, 0].sum(0) / count
    grads[3] += gap[rows, ends].sum(0) / count
    return float((total - told).mean() + decay / 2 * sum((p * p).sum() for p in parts)), grads


def padded(sentences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, tags and mask of sentences at one length."""
    longest, count, width = max(len(t) for _, t in sentences), len(sentences), sentences[0][0].shape[1]
    ids, tags, mask = np.zeros((count, longest, width), np.int64), np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
    for k, (f, t) in enumerate(sentences):
        ids[k, : len(t)], tags[k, : len(t)], mask[k, : len(t)] = f, t, True
    return ids, tags, mask


def train(sentences: list[tuple[np.ndarray, np.ndarray]], n_features: int, n_tags: int, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Chain:
    """`sentences`: (feature ids, words x features a word; tags). Adam on the penalised negative log likelihood, all sentences at once."""
    given = padded(sentences)
    parts = [np.zeros((n_features, n_tags)), np.zeros((n_tags, n_tags)), np.zeros(n_tags), np.zeros(n_tags)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for n in range(1, rounds + 1):
        _, grads = likelihood(parts, *given, decay)
        for p, g, (m, v) in zip(parts, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
    return Chain(*parts)


def viterbi(chain: Chain, e: np.ndarray, bounds: np.ndarray, block: int = 4096) -> np.ndarray:
    """Best tags of many sequences: emissions (words x tags) in a row, `bounds` of each sequence. Sequences of like length are decoded in step."""
    out = np.zeros(len(e), np.int64)
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    for at in range(0, len(order), block):
        own = order[at : at + block]
        start, size = bounds[:-1][own], sizes[own]
        longest = int(size[-1])
        score = chain.first + e[start]
        back = np.zeros((longest, len(own), e.shape[1]), np.int8)
        final = score.copy()
        for t in range(1, longest):
            live = int(np.searchsorted(size, t, "right"))
            ways = score[live:, :, None] + chain.step
            back[t, live:] = ways.argmax(1)
            score[live:] = ways.max(1) + e[start[live:] + t]
            final[live:] = score[live:]
        tag = (final + chain.last).argmax(1)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(size, t, "right"))
            out[start[live:] + t] = tag[live:]
            if t:
                tag[live:] = back[t, np.arange(live, len(own)), tag[live:]]
    return out
