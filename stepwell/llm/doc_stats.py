"""Counts of a text that rules and classifiers build on, for whole batches."""

from __future__ import annotations

import numpy as np

from .text import SPACE, words_of

_BYTES = np.arange(256)


def _any_of(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, np.frombuffer(chars, np.uint8))


_LEAD = (_BYTES & 0xC0) != 0x80  # the first byte of a character
#: Byte classes whose counts are sums over a text's histogram of bytes.
CLASSES = {
    "n_chars": _LEAD,
    "word_chars": _LEAD & ~SPACE,
    "n_symbols": _any_of(b"#*$%&|<>"),
    "n_upper": _any_of(bytes(range(65, 91))),
    "n_digits": _any_of(b"0123456789"),
    "n_ends": _any_of(b".!?"),
    "n_bangs": _any_of(b"!?"),
    "n_commas": _any_of(b",;:"),
}
_CLASS_MATRIX = np.stack([*CLASSES.values()], axis=1).astype(np.int64)
_CAPITAL = _any_of(bytes(range(65, 91)))
#: Second bytes of the capitals from À to Þ; the first is 0xC3.
_LATIN_CAPITAL = _any_of(bytes(b for b in range(0x80, 0x9F) if b != 0x97))
_BLANK = b" \t\n\x0b\x0c\r"

#: Column names that ``doc_counts`` gives, all long.
COUNTS = (*CLASSES, "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_short_words", "longest_word", "n_capital_words")


def repeated_windows(hashes: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the words that lie in a 3-word window found twice or more in their text."""
    covered = np.zeros(len(hashes), bool)
    at = np.flatnonzero(np.arange(len(hashes)) + 3 <= first[1:][owner]) if len(hashes) else np.zeros(0, np.int64)
    if len(at) > 1:
        with np.errstate(over="ignore"):
            window = (hashes[at] * np.uint64(0x9FB21C651E98DF25) ^ (hashes[at + 1] >> np.uint64(7))) * np.uint64(0xA24BAED4963EE407) + hashes[at + 2]
            window += owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(window)
        window = window[order]
        same = np.flatnonzero(window[1:] == window[:-1])
        often = at[np.concatenate([order[same], order[same + 1]])]
        for k in range(3):
            covered[often + k] = True
    return covered


def doc_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """One value of each of COUNTS per text.  Lengths of words are in bytes."""
    n = len(offsets) - 1
    words = words_of(data, offsets)
    owner, n_words = words.text_of_word(), np.diff(words.first)
    out = {"n_words": n_words, "n_lines": np.zeros(n, np.int64), "n_dup_lines": np.zeros(n, np.int64), "longest_word": np.zeros(n, np.int64)}

    sums = np.zeros((n, len(CLASSES)), np.int64)
    for i in range(n):
        own = data[offsets[i] : offsets[i + 1]]
        sums[i] = np.bincount(own, minlength=256) @ _CLASS_MATRIX
        lines = [x for x in own.tobytes().split(b"\n") if x.strip(_BLANK)]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    out |= {k: sums[:, i] for i, k in enumerate(CLASSES)}

    hashes = words.hashes()
    out["n_repeat_words"] = np.bincount(owner[repeated_windows(hashes, owner, words.first)], minlength=n)
    length = words.end - words.start
    out["n_short_words"] = np.bincount(owner[length <= 2], minlength=n)
    full = np.flatnonzero(n_words)
    if len(full):
        out["longest_word"][full] = np.maximum.reduceat(length, words.first[full])
    first, second = data[words.start], data[np.minimum(words.start + 1, max(len(data) - 1, 0))]
    out["n_capital_words"] = np.bincount(owner[_CAPITAL[first] | (first == 0xC3) & _LATIN_CAPITAL[second]], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}
