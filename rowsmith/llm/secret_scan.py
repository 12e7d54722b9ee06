"""Secret scan: fixed patterns, and Markov models of random strings against ordinary words.

The patterns find assignments, access keys and hexadecimal runs. Two models of
character pairs are counted over all documents: one from the values that the
patterns label as secrets, one from the ordinary tokens outside them. A token
is reported when its log-likelihood ratio, and its mean per character, are high.

Defined cases: a null or empty text has no spans; a null doc_id is kept;
repeated rows are scanned each alone; without any labelled value, random
strings are uniform over the alphabet.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import text as tx

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # one more for the place before a token
CODE = np.full(256, -1, dtype=np.int64)
CODE[list(ALPHABET)] = np.arange(1, SIZE)
IS_TOKEN = CODE >= 0
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", dtype=np.uint8))


@dataclass(frozen=True)
class SecretSettings:
    min_length: int = 12  # as in the base rule
    min_ratio: float = 20.0
    min_mean: float = 1.0
    smoothing: float = 0.5


def base_spans(data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """For each row (start, kind, end, value start) of the pattern matches, in code points, ordered."""
    n = len(bounds) - 1
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
    raw, lower = data.tobytes(), tx.LOWER[data].tobytes()
    for kind, words, pattern in ((0, KEYWORDS, ASSIGN), (1, (b"AKIA",), ACCESS)):
        rows = set()
        for word in words:
            text = lower if kind == 0 else raw
            at = text.find(word)
            while at >= 0:
                r = int(np.searchsorted(bounds, at, side="right")) - 1
                rows.add(r)
                at = text.find(word, int(bounds[r + 1]))
        for r in rows:
            text = raw[bounds[r] : bounds[r + 1]].decode("utf-8", "surrogateescape")
            for m in pattern.finditer(text):
                long = len(m[2]) >= ASSIGN_LEAST if kind == 0 else len(m[0]) >= ACCESS_LEAST
                if long:
                    found[r].append((m.start(), kind, m.end(), m.start(2) if kind == 0 else m.start()))
    start, end, row = tx.runs(IS_HEX[data], bounds)
    long = np.flatnonzero(end - start >= HEX_LEAST)
    if len(long):
        points = tx.code_points(data)
        for i in long:
            r, base = row[i], points[bounds[row[i]]]
            a, b = int(points[start[i]] - base), int(points[end[i]] - base)
            found[r].append((a, 2, b, a))
    for spans in found:
        spans.sort()
    return found


def tokens(data: np.ndarray, bounds: np.ndarray, spans, least: int):
    """Tokens of at least `least` characters with a mark for those that touch a pattern's span."""
    start, end, row = tx.word_spans(data, bounds, IS_TOKEN)
    long = np.flatnonzero(end - start >= least)
    start, end, row = start[long], end[long], row[long]
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    if any(spans):
        points = tx.code_points(data)
        for r, own in enumerate(spans):
            if own:
                local = points[bounds[r] : bounds[r + 1]] - points[bounds[r]]
                for a, _, b, value in own:
                    inside[bounds[r] + np.searchsorted(local, value)] += 1
                    inside[bounds[r] + np.searchsorted(local, b)] -= 1
    covered = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(inside[:-1]) > 0, out=covered[1:])
    return start, end, row, covered[end] > covered[start]


def pair_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair code of each token character with the one before it, and the bounds of each token."""
    length = end - start
    bounds = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=bounds[1:])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length) + np.repeat(start, length)
    code = CODE[data[at]]
    before = np.zeros(len(code), dtype=np.int64)
    before[1:] = code[:-1]
    before[bounds[:-1]] = 0
    return before * SIZE + code, bounds


def train(docs: DataFrame, settings: SecretSettings = SecretSettings()) -> np.ndarray:
    """Log-likelihood ratio of each character pair, from counts over all documents (a fixed-size table)."""

    def count(rows, data, bounds):
        start, end, _, labelled = tokens(data, bounds, base_spans(data, bounds), 4)
        out = {"random": [], "pair": [], "n": []}
        for random in (True, False):
            chosen = labelled == random
            codes, _ = pair_codes(data, start[chosen], end[chosen])
            n = np.bincount(codes, minlength=SIZE * SIZE)
            pair = np.flatnonzero(n)
            out["random"].append(np.full(len(pair), random))
            out["pair"].append(pair)
            out["n"].append(n[pair])
        return {k: np.concatenate(v) for k, v in out.items()}

    counted = tx.map_texts(docs.select("text"), count, "random boolean, pair long, n long")
    logs = np.zeros((2, SIZE * SIZE))
    rows = counted.groupBy("random", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 * SIZE * SIZE rows
    for r in rows:
        logs[int(r["random"]), r["pair"]] = r["n"]
    logs = logs.reshape(2, SIZE, SIZE)[:, :, 1:] + settings.smoothing
    logs = np.log(logs / logs.sum(axis=2, keepdims=True))
    ratio = np.zeros((SIZE, SIZE))
    ratio[:, 1:] = logs[1] - logs[0]
    return ratio.reshape(-1)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, ratio: np.ndarray, settings: SecretSettings = SecretSettings()) -> DataFrame:
    """All spans of every document: the patterns' and those that the models add outside them."""

    def run(rows, data, bounds):
        base = base_spans(data, bounds)
        start, end, row, labelled = tokens(data, bounds, base, settings.min_length)
        own = ~labelled
        start, end, row = start[own], end[own], row[own]
        codes, limits = pair_codes(data, start, end)
        total = tx.row_sums(ratio[codes], limits)
        odd = np.flatnonzero((total >= settings.min_ratio) & (total >= settings.min_mean * (end - start)))
        every = [[(a, kind, b) for a, kind, b, _ in spans] for spans in base]
        lists = [listed(spans) for spans in every]
        if len(odd):
            points = tx.code_points(data)
            for i in odd:
                first = points[bounds[row[i]]]
                every[row[i]].append((int(points[start[i]] - first), 3, int(points[end[i]] - first)))
        kinds = [np.bincount([kind for _, kind, _ in spans], minlength=4) for spans in every]
        return {
            "doc_id": rows.column("doc_id"),
            "n_assign": np.array([k[0] for k in kinds], dtype=np.int64),
            "n_access": np.array([k[1] for k in kinds], dtype=np.int64),
            "n_hex": np.array([k[2] for k in kinds], dtype=np.int64),
            "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in lists],
            "spans": [listed(sorted(x)) for x in every],
        }

    return tx.map_texts(
        docs.select(F.col("doc_id").cast("long"), "text"),
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )
