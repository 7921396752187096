"""Secret scans: three base patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary packs ordinary words and identifiers into few tokens; random strings fall apart into many. The
test takes every unbroken run of key characters and cuts it where no key goes on: at ``=``, and at stretches between marks
that are words (3 letters or more, packed well), numbers (4 digits or more), UUIDs, digests or inside a base span. What
lies between two cuts, with the marks within (base64 has them), is a run of its own and is reported by its own span, so
that a name or path in front of a key is not averaged with it. Its characters per token decide:

- a run whose stretches of letters have more than ``max_ratio`` letters a token is words, however joined: an identifier, a path;
- letters and digits that alternate are reported where the whole run stays at or below ``max_ratio``, too;
- letters alone, and runs that look like names with numbers (no stretch changes between letters and digits more than twice),
  are reported where their letters stay at or below a stricter ratio: SAME_CASE for letters of one case, which come close
  to unusual words (the least of 10,393 clean words of check_s is 1.6), MIXED_CASE for others;
- capitals alone are reported up to CAPITALS, if in small letters they are packed that badly, too: the vocabulary has few
  pieces in capitals, so that words in capitals have a low ratio, but a high one in small letters.

Left out: UUIDs; hexadecimal strings with the length of a common digest (32, 40, 56, 64, 96 or 128 digits), also behind
``0x``; timestamps (20240115T123045Z); sequences in the letters of nucleotides or amino acids; names with numbers that have
fewer than 4 letters (dates, card numbers); runs already inside a base span.

Spans are (kind, start, end), code points, end exclusive, over the whole text. Base spans come from leftmost
non-overlapping matches per kind; matches that are too short are dropped after matching. Defined results: a null text
is empty and has no spans; input columns named like the added ones are replaced; all other columns, null ids and
repeated rows pass through row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.common import add_columns

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of hexadecimal digits is matched whole, so the length can be asked for here
CLUES = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORTEST = 16
#: Stretches between marks; a UUID is one of them.
STRETCH = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+|0x[0-9a-fA-F]+)")
STAMP = re.compile(r"(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])T[0-9]{6,9}Z?")
SEQUENCE = re.compile(r"[ACGTUN]+|[ACDEFGHIKLMNPQRSTVWY]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
LETTERS = re.compile(r"[A-Za-z]+")
SAME_CASE, MIXED_CASE, CAPITALS = 1.5, 1.8, 1.89
PIECES = re.compile(r"[A-Za-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three base kinds."""
    low = text.lower()
    out = []
    if any(c in low for c in CLUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def looks_named(run: str) -> bool:
    """Words and numbers joined by marks: no stretch changes between letters and digits more than twice."""
    return all(len(PIECES.findall(m)) <= 3 for m in re.split(r"[+/_=-]+", run) if m)


def is_random(run: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    """Whether the vocabulary packs the run, and the letters in it, badly."""
    words = LETTERS.findall(run)
    letters = "".join(words)
    if not letters:
        return False
    of = lambda words: len(letters) / sum(len(encoding.encode_ordinary(w)) for w in words)
    ratio = of(words)
    if run == letters and run.isupper():
        least = min(max_ratio, CAPITALS)
        return not SEQUENCE.fullmatch(run) and ratio <= least and of([run.lower()]) <= least
    if looks_named(run):
        same = all(w.islower() or w.isupper() or w.istitle() for w in words)
        return len(letters) >= 4 and ratio <= min(max_ratio, SAME_CASE if same else MIXED_CASE)
    return ratio <= max_ratio and len(run) / len(encoding.encode_ordinary(run)) <= max_ratio


def is_digest(run: str) -> bool:
    """Whether a run is a UUID, a timestamp or has the form of a digest."""
    if UUID.fullmatch(run) or STAMP.fullmatch(run):
        return True
    return len(run.removeprefix("0x")) in DIGEST_LENGTHS and DIGEST.fullmatch(run) is not None


def vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_cut(stretch: str, encoding: tiktoken.Encoding, max_ratio: float) -> bool:
    """Whether a stretch is a word, a number, a UUID or a digest, and so not part of a key."""
    if is_digest(stretch):
        return True
    words = LETTERS.findall(stretch)
    if not words:
        return len(stretch) >= 4
    letters = sum(map(len, words))
    return letters >= 3 and looks_named(stretch) and letters > max_ratio * sum(len(encoding.encode_ordinary(w)) for w in words)


def parts(run: str, cut: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """(start, end) of what lies between two cuts of a run; ``cut`` tells whether a stretch is one."""
    own: list[tuple[int, int]] = []
    for m in STRETCH.finditer(run):
        if own and "=" in run[own[-1][1] : m.start()]:
            yield own[0][0], own[-1][1]
            own = []
        if not cut(*m.span()):
            own.append(m.span())
        elif own:
            yield own[0][0], own[-1][1]
            own = []
    if own:
        yield own[0][0], own[-1][1]


def random_spans(text: str, base: list[tuple[int, int, int]], encoding: tiktoken.Encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    """Parts of runs of key characters that the vocabulary packs badly."""
    out = []
    for m in RUN.finditer(text):
        at, run = m.start(), m[0]
        covered = lambda lo, hi: any(s <= at + lo and at + hi <= e for s, _, e in base)  # noqa: B023, E731
        for lo, hi in parts(run, lambda lo, hi: covered(lo, hi) or is_cut(run[lo:hi], encoding, max_ratio)):  # noqa: B023
            if hi - lo < SHORTEST:  # marks that begin or end the run can belong to the key
                lo, hi = lo if run[:lo].strip("+/_-") else 0, hi if run[hi:].strip("+/_=-") else len(run)
            part = run[lo:hi]
            # Letters and numbers of a few characters, however many are joined, are no key.
            if len(part) < SHORTEST or max(map(len, STRETCH.findall(part))) < 6:
                continue
            if is_random(part, encoding, max_ratio):
                out.append((at + lo, 3, at + hi))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, overlapping ones taken together, replaced by ``[kind]`` of its first."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


FIELDS = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_random", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def scan_secrets(docs: DataFrame, vocabulary_path: str, pattern: str, max_ratio: float = 2.2, redact: bool = False) -> DataFrame:
    """``docs`` with counts and spans of secrets; with ``redact``, ``text`` has each span replaced by its kind."""

    def start():
        encoding = vocabulary(vocabulary_path, pattern)

        def of(b: pa.RecordBatch) -> dict:
            out = {n: [] for n, _ in FIELDS} | {"text": []}
            for text in b.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, encoding, max_ratio)
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(sum(x[1] == k for x in base))
                out["n_random"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + more))
                if redact:
                    out["text"].append(redacted(text, base + more))
            return out

        return of

    return add_columns(docs, [*([("text", T.StringType())] if redact else []), *FIELDS], start)
