"""Quality rule by tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands per script."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

from stackmill.llm.common import chunks, documents

#: A public vocabulary with byte fallback. Executors need no file: the driver ships its bytes with the task.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: Per script: least and most characters per token, most byte-fallback share, least token entropy in bits.
BANDS = {
    "latin": (1.5, 9.0, 0.15, 4.0),
    "cyrillic": (1.0, 6.0, 0.20, 3.0),
    "greek": (0.8, 5.0, 0.30, 3.0),
    "arabic": (0.7, 5.0, 0.40, 3.0),
    "hebrew": (0.7, 5.0, 0.40, 3.0),
    "han": (0.3, 3.0, 0.75, 3.0),
    "kana": (0.4, 3.0, 0.60, 3.0),
    "hangul": (0.3, 3.0, 0.80, 3.0),
    "other": (0.2, 9.0, 0.90, 3.0),
}

#: First code point of each range and its script; a letter belongs to the last range that starts at or before it.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0xAC00, "hangul"), (0xD7A4, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)

SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,
kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"""

_LETTERS = re.compile(r"[^\W\d_]+")
_STARTS = np.array([c for c, _ in RANGES], np.uint32)
_PIECE = 200_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) < 1 << 20:
        key = (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]
    else:  # too many words for one number: number the pairs first
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * len(number) + ids[2:]
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]  # in order, the windows that occur twice or more
    if not len(again):
        return 0
    twice = again[np.minimum(np.searchsorted(again, key), len(again) - 1)] == key
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def script_of(text: str) -> str:
    """The script of most letters of a text, ``other`` without letters; ties go to the first name."""
    letters = _LETTERS.findall(text) if not text.isascii() else None
    if letters is None:
        return "latin" if re.search("[A-Za-z]", text) else "other"
    if not letters:
        return "other"
    codes = np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32)
    at = np.searchsorted(_STARTS, codes, side="right") - 1
    counts: dict[str, int] = {}
    for (_, name), n in zip(RANGES, np.bincount(at, minlength=len(RANGES)).tolist(), strict=True):
        counts[name] = counts.get(name, 0) + n
    return min(counts, key=lambda s: (-counts[s], s))


class Fertility:
    """Token figures of texts under one vocabulary."""

    def __init__(self, model: bytes):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.pieces.get_piece_size()
        self.fallback = np.fromiter((self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(size)), bool, size)

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """n_tokens, chars_per_token, byte_share, token_entropy; a text of 200,000 characters or more is encoded in pieces."""
        ids = self.pieces.encode([text[i : i + _PIECE] for i in range(0, len(text), _PIECE)], num_threads=1)
        tokens = np.concatenate([np.array(part, np.int64) for part in ids]) if ids else np.zeros(0, np.int64)
        n = len(tokens)
        if not n:
            return 0, 0.0, 0.0, 0.0
        share = np.unique(tokens, return_counts=True)[1] / n
        return n, len(text) / n, float(self.fallback[tokens].mean()), float(-(share * np.log2(share)).sum())


def within(script: str, n: int, chars: float, fallback: float, entropy: float, bands: dict) -> bool:
    """Whether the figures lie in the band of the script. Texts of few tokens need no more entropy than they can have."""
    low, high, most, least = bands.get(script, bands["other"])
    return n > 0 and low <= chars <= high and fallback <= most and entropy >= min(least, 0.5 * np.log2(n))


def fertility(docs: DataFrame, vocabulary: str = VOCABULARY, bands: dict | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): base counts, token figures and the verdict.

    ``kept`` is false if ``base_failed`` (fewer than 50 words, or more than half of them repeated), else true exactly if
    characters per token, byte-fallback share and token entropy lie in the band of the text's script. A null text has no
    words: it fails. Ids may be null or repeated; other columns are ignored; an empty table gives an empty table. The job
    is a map over whole texts: nothing is shuffled, and a task holds one batch and works on a million characters at a time.
    """
    model, bands = Path(vocabulary).read_bytes(), bands or BANDS

    def run(frames):
        meter = Fertility(model)
        for frame in frames:
            for part, texts in chunks(frame):
                rows = []
                for key, text in zip(part["doc_id"], texts, strict=True):
                    base = base_counts(text)
                    figures, script = meter.measure(text), script_of(text)
                    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                    rows.append((None if pd.isna(key) else int(key), *base, failed, not failed and within(script, *figures, bands), script, *figures))
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.replace("\n", " ").split(", ")])
                yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def op1(spark, folder):
    return fertility(documents(spark, folder))
