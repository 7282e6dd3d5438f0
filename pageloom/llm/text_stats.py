"""Counts over one text that the quality and toxicity operators use."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pageloom.llm.common import WORD_GAPS, windows, word_ids

#: Fixed characters that count as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"
ENDINGS = ('.', '!', '?', '"', "'", ':', ';', '…')
#: Frequent function words of English, French, German and Spanish (fixed values).
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on are as with be by at this from or an a not have "
    "le la les de des du et un une est dans que qui pour par sur pas avec au en il ce "
    "der die das und ist nicht mit ein eine zu den von im auf sich des dem für als auch "
    "el los las y que un una no por con para se su al lo del es".encode().decode().split()
)
FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)

#: Lower-cases A-Z and turns marks into gaps.
PLAIN = bytes(32 if chr(b) in ".,;:!?()" else b + 32 if 65 <= b <= 90 else b for b in range(256))

FIELDS: dict[str, pa.DataType] = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_lines": pa.int64(),
    "n_upper": pa.int64(),
    "n_lower": pa.int64(),
    "n_digits": pa.int64(),
    "n_shouts": pa.int64(),
    "n_stops": pa.int64(),
    "n_distinct": pa.int64(),
    "n_function_words": pa.int64(),
    "n_ended_lines": pa.int64(),
    "n_top_word": pa.int64(),
    "n_same_as_last": pa.int64(),
    "n_bytes": pa.int64(),
}


def repeated_positions(ids: np.ndarray, width: int = 5) -> int:
    """Words inside windows that occur at least twice, each occurrence counted, each word once."""
    found = windows(ids, width)
    if len(found) < 2:
        return 0
    order = np.argsort(found, kind="stable")
    ranked = found[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def stats_of(text: str | None) -> tuple[int, ...]:
    """The FIELDS of one whole text; a null text counts as empty, with zeros throughout."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(text.count(c) for c in SYMBOLS), *[0] * (len(FIELDS) - 4), len(raw))
    lines, seen, repeated, with_word, ended = text.split("\n"), set(), 0, 0, 0
    for line in lines:
        if bare := line.strip(WORD_GAPS):
            with_word += 1
            repeated += line in seen
            ended += bare.endswith(ENDINGS)
            seen.add(line)
    ids = word_ids(words)
    counts = np.bincount(ids)
    shouts = raw.count(b"!")
    return (
        n,
        len(text) - sum(text.count(c) for c in WORD_GAPS),
        sum(text.count(c) for c in SYMBOLS),
        repeated,
        repeated_positions(ids),
        with_word,
        len(raw) - len(raw.translate(None, UPPER)),
        len(raw) - len(raw.translate(None, LOWER)),
        len(raw) - len(raw.translate(None, DIGITS)),
        shouts,
        raw.count(b".") + raw.count(b"?") + shouts,
        len(counts),
        sum(map(FUNCTION_BYTES.__contains__, raw.translate(PLAIN).split())),
        ended,
        int(counts.max()),
        int((ids[1:] == ids[:-1]).sum()),
        len(raw),
    )


def stats_array(texts: pa.Array) -> pa.StructArray:
    rows = [stats_of(t.as_py()) for t in texts]
    columns = zip(*rows, strict=True) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))
