"""A linear-chain conditional random field with two labels over lines: training by likelihood, decoding by Viterbi."""

from __future__ import annotations

import numpy as np

BOILERPLATE, CONTENT = 0, 1


class LineCRF:
    """score(labels) = sum of emission[label] . features + sum of transition[label, next label]."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, step: float = 0.3, shrink: float = 1e-3) -> LineCRF:
        """Gradient ascent (Adagrad) on the mean log-likelihood of (features, labels) sequences.

        Sequences stand side by side, padded to the longest: callers bound their number and length.
        """
        documents = [d for d in documents if len(d[1])]
        width = documents[0][0].shape[1] if documents else len(FEATURES)
        e, t = np.zeros((2, width)), np.zeros((2, 2))
        if not documents:
            return cls(e, t)
        documents.sort(key=lambda d: -len(d[1]))
        longest, lines = len(documents[0][1]), sum(len(d[1]) for d in documents)
        alive = [sum(len(d[1]) > i for d in documents) for i in range(longest)]  # sequences are in order of length
        x = np.zeros((longest, len(documents), width))
        y = np.zeros((longest, len(documents)), np.int64)
        for j, (f, labels) in enumerate(documents):
            x[: len(labels), j], y[: len(labels), j] = f, labels
        seen_e, seen_t = np.zeros_like(e), np.zeros_like(t)
        for i, n in enumerate(alive):
            for label in (0, 1):
                seen_e[label] += x[i, :n][y[i, :n] == label].sum(axis=0)
            if i:
                np.add.at(seen_t, (y[i - 1, :n], y[i, :n]), 1)
        square_e, square_t = np.full_like(e, 1e-8), np.full_like(t, 1e-8)
        for _ in range(rounds):
            score = x @ e.T
            forward = np.zeros((longest, len(documents), 2))
            backward = np.zeros_like(forward)
            forward[0] = score[0]
            for i in range(1, longest):
                n = alive[i]
                forward[i, :n] = score[i, :n] + np.logaddexp(forward[i - 1, :n, :1] + t[0], forward[i - 1, :n, 1:] + t[1])
            for i in range(longest - 2, -1, -1):
                n = alive[i + 1]
                after = score[i + 1, :n] + backward[i + 1, :n]
                backward[i, :n] = np.logaddexp(after[:, :1] + t[:, 0], after[:, 1:] + t[:, 1])
            total = np.logaddexp(*(forward[0] + backward[0]).T)
            want_e, want_t = np.zeros_like(e), np.zeros_like(t)
            for i, n in enumerate(alive):
                p = np.exp(forward[i, :n] + backward[i, :n] - total[:n, None])
                want_e += p.T @ x[i, :n]
                if i:
                    pair = forward[i - 1, :n, :, None] + t + (score[i, :n] + backward[i, :n])[:, None, :] - total[:n, None, None]
                    want_t += np.exp(pair).sum(axis=0)
            for w, seen, want, square in ((e, seen_e, want_e, square_e), (t, seen_t, want_t, square_t)):
                g = (seen - want) / lines - shrink * w
                square += g * g
                w += step * g / np.sqrt(square)
        return cls(e, t)

    def decode(self, features: np.ndarray) -> list[int]:
        """The most probable labels of one document's lines."""
        if not len(features):
            return []
        (aa, ab), (ba, bb) = self.transition.tolist()
        rows = (features @ self.emission.T).tolist()
        a, b = rows[0]
        back = []
        for x, y in rows[1:]:
            a0, a1, b0, b1 = a + aa, b + ba, a + ab, b + bb
            back.append((a1 > a0, b1 >= b0))
            a, b = max(a0, a1) + x, max(b0, b1) + y
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


FEATURES = ["one", "symbols", "many symbols", "upper", "exclaims", "digits", "no letters", "short", "long", "ends a sentence", "lower", "seen before", "bars"]
SYMBOLS = b"#*$%&|<>"
_classes = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b" \t\n\x0b\x0c\r", SYMBOLS, b"!", b"0123456789", bytes(range(65, 91)), bytes([*range(97, 123), *range(128, 256)])), 1):
    _classes[list(_chars)] = _k


def line_features(lines: list[bytes], seen_before: list[bool]) -> np.ndarray:
    """Indicators by line; lines are UTF-8 and hold a word each."""
    data = np.frombuffer(b"\n".join(lines), np.uint8)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    kinds = _classes[data]
    space, symbol, exclaim, digit, upper, lower = (np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(1, 7))
    space[:-1] -= 1  # the joining line end
    full = np.maximum(lengths - space, 1)
    letters = upper + lower
    words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    bars = np.fromiter((x.count(b"|") + x.count(b"\xc2\xb7") + x.count(b"\xc2\xbb") for x in lines), np.int64, len(lines))  # what menus are parted by
    closed = np.fromiter((x.rstrip()[-1:] in b".?:;" for x in lines), bool, len(lines))
    return np.stack(
        [np.ones(len(lines)), symbol >= 0.03 * full, symbol >= 0.15 * full, (upper >= 0.5 * np.maximum(letters, 1)) & (letters >= 4), exclaim >= 0.05 * full, digit >= 0.3 * full, letters == 0,
         words < 4, words >= 8, closed, lower >= 0.75 * full, np.array(seen_before, bool),
         (bars >= 2) & (bars >= 0.15 * words)], axis=1,
    ).astype(float)


def seed_labels(features: np.ndarray) -> np.ndarray:
    """Weak labels to train from: lines of signs, shouting, numbers, menus, or a line that was there before are boilerplate."""
    f = {name: features[:, i] > 0 for i, name in enumerate(FEATURES)}
    bad = f["many symbols"] | f["upper"] | f["exclaims"] | f["digits"] | f["no letters"] | f["seen before"] | f["bars"] | (f["symbols"] & ~f["lower"])
    return np.where(bad, BOILERPLATE, CONTENT)
