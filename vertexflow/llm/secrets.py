"""Secret scan: fixed patterns, and two character Markov models in comparison.

The patterns give the base spans.  For what no pattern knows, first-order Markov
models of random strings and of ordinary identifiers are compared: every character
after its predecessor adds the logarithm of the ratio of its likelihoods.  In each
run of token characters, the windows of largest total ratio are one more span each,
if they are long enough and reach a threshold; so a key inside a longer path or
assignment is found without what surrounds it.

The models are trained from labelled samples, four fifths of them.  The last fifth
sets the threshold: what hardly any ordinary sample reaches, and the odds against a
random window in running text.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import CHUNK_BYTES, column
from .worker import state

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-."
#: Kinds of spans in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "markov")

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_KEYWORD = re.compile(rb"(?:passw(?:or)?d|secret|token|api_?key)", re.I)
_LONG_HEX = re.compile(rb"[0-9a-f]{24}|AKIA[A-Z0-9]{16}")
#: Least characters of a model span; share of ordinary samples that may have a positive verdict; one of so many samples is apart.
WINDOW, FALSE, APART = 8, 0.001, 5
#: Nats that the total must have beyond that: random windows are that rare beside ordinary ones in running text.
RARE = 9.0
_CODE = np.zeros(256, np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)

# Frequent words of four languages and of programs, from which ordinary samples are put together.
_WORDS = """the and that have for not with you this but from they say she will one all would there their what out about
who get which when make can like time just him know people into year your good some could them see other than then of shed only
der die und das nicht von sie ist sich mit dem ein auch auf werden durch nach bei schon wenn zu zur zusammen zwei pfad kopf apfel
platz jetzt schutz beste gegen jahr keit heit lich schaft ung berg haus les des est pour que une dans qui par plus pas sur avec
oiseau jour nous leur ment tion eau eux elle oui ier los las una del por con para como pero sus este todo desde hasta donde entre
sobre ciento mente idad caja hoja bajo mejor hijo raza diez doy llega rr index value name list item user data file path node type
state error config server client request response session cache buffer string number object array length count total table
column page view model test main util""".split()


class MarkovModel:
    """First-order character model with add-``smooth`` transitions; state 0 begins a string."""

    def __init__(self, samples: Iterable[str], smooth: float = 0.5):
        n = len(ALPHABET) + 1
        counts = np.full((n, n), smooth)
        for text in samples:
            code = _codes(text)
            np.add.at(counts, (np.concatenate([[0], code[:-1]]), code), 1)
        self.log = np.log(counts / counts.sum(1, keepdims=True))


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def default_samples(seed: int = 0, n: int = 20_000) -> list[tuple[str, int]]:
    """Labelled strings made by rule: random ones (1) over common key alphabets, ordinary ones (0)
    in the forms that words, identifiers, paths, numbers and dates take."""
    rng = random.Random(seed)
    out = []
    alphabets = (ALPHABET[:64], ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    for i in range(n):
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randrange(WINDOW, 49))), 1))

    def words(most: int) -> list[str]:
        return rng.choices(_WORDS, k=rng.randrange(2, most))

    for i in range(n):
        parts, number = words(6), str(rng.randrange(10**6))
        dotted = ".".join(str(rng.randrange(256)) for _ in range(4))
        digits = "".join(rng.choices("0123456789", k=rng.randrange(8, 20)))
        day = f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        forms = (
            "_".join(parts), "-".join(parts), "/".join(parts), ".".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "".join(parts).upper(),
            "".join(parts), "".join(parts), "".join(parts).title(), "".join(words(9)), "".join(words(4)) + number, parts[0] + number + parts[1], "/".join(parts) + "." + parts[0] + "=" + number,
            digits, dotted, day, "--".join(parts), "=" * rng.randrange(8, 60), "-" * rng.randrange(8, 60), "_" * 12, "." * rng.randrange(8, 30), parts[0][0] * rng.randrange(8, 30),
        )
        out.append((forms[i % len(forms)], 0))
    return out


class Scanner:
    """``threshold``: least total of a window, in nats, by the samples apart if None; ``least``: its least characters."""

    def __init__(self, samples: list[tuple[str, int]], threshold: float | None = None, least: int = WINDOW):
        if len({label for _, label in samples}) < 2:
            raise ValueError("samples of both labels are needed")
        kept = [s for i, s in enumerate(samples) if i % APART]
        self.least = least
        self.ratios = MarkovModel(s for s, label in kept if label).log - MarkovModel(s for s, label in kept if not label).log
        self.ratios[:, 0] = 0.0
        if threshold is None:
            ordinary = [self.best(s) for i, (s, label) in enumerate(samples) if not label and i % APART == 0]
            threshold = RARE + (max(0.0, float(np.quantile(ordinary, 1 - FALSE, method="higher"))) if ordinary else 0.0)
        self.threshold = threshold

    def increments(self, text: str) -> np.ndarray:
        code = _codes(text)
        return self.ratios[np.concatenate([[0], code[:-1]]), code]

    def windows(self, increments: np.ndarray) -> list[tuple[int, int, float]]:
        """Windows of at least ``least`` characters that reach the threshold, from the largest total on, none touching another: start, end, total."""
        out, todo = [], [(0, len(increments))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < self.least:
                continue
            total = np.concatenate([[0.0], np.cumsum(increments[lo:hi])])
            low = np.minimum.accumulate(total[: len(total) - self.least])
            gain = total[self.least :] - low
            end = int(gain.argmax())
            if gain[end] < self.threshold:
                continue
            start = int(total[: end + 1].argmin())
            end += self.least
            out.append((lo + start, lo + end, float(gain[end - self.least])))
            todo += [(lo, lo + start), (lo + end, hi)]
        return sorted(out)

    def best(self, text: str) -> float:
        """The largest total of a window; a text without one has none that any threshold is below."""
        increments = self.increments(text)
        if len(increments) < self.least:
            return -math.inf
        total = np.concatenate([[0.0], np.cumsum(increments)])
        return float((total[self.least :] - np.minimum.accumulate(total[: len(total) - self.least])).max())

    def runs(self, data: np.ndarray) -> list[tuple[int, int]]:
        """Runs of token characters in UTF-8 bytes whose gains could add up to the threshold."""
        code = _CODE[data]
        inside = code > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return []
        before = np.concatenate([[0], code[:-1]])
        before[starts] = 0
        gains = np.concatenate([[0.0], np.cumsum(np.maximum(self.ratios[before, code], 0.0))])
        some = gains[ends] - gains[starts] >= self.threshold - 1e-6
        return list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))

    def base(self, text: str) -> list[tuple[int, int, str, int]]:
        """start, order of kind, kind, end."""
        out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
        return sorted(out)

    def more(self, text: str, runs: list[tuple[int, int]], base: list) -> list[tuple[int, int, str, int]]:
        """Model spans in the runs (code points), but for those that overlap a base span; both lists are walked once."""
        out, taken = [], _union(base)
        at = 0
        for s, e in runs:
            for a, b, _ in self.windows(self.increments(text[s:e])):
                while at < len(taken) and taken[at][1] <= s + a:
                    at += 1
                if at == len(taken) or taken[at][0] >= s + b:
                    out.append((s + a, 3, "markov", s + b))
        return out


def _union(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, _, _, end in spans:
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def scan_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", samples: list[tuple[str, int]] | None = None, threshold: float | None = None) -> DataFrame:
    """Secrets in every text: ``id_col, n_assign, n_access, n_hex, n_markov, base, spans``.

    ``base`` and ``spans`` list ``kind:start:end`` by start, then by kind as in
    KINDS, joined by commas; places are code points and ends are exclusive.  Base
    spans are leftmost and don't overlap within a kind; matches that are too short
    are dropped.  Model spans never overlap a base span or each other.  ``samples``
    are (string, 1 if random else 0).  A null text counts as empty and has no spans.
    Null and repeated ids stay; texts of any length are scanned whole, in time that
    grows with their length; other columns are not looked at.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(samples or default_samples(), threshold))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()

    def spans(body: pa.Scalar) -> tuple[list, list]:
        raw = memoryview(body.as_buffer())
        data = np.frombuffer(raw, np.uint8)
        runs = [r for lo in _blocks(data) for r in _shifted(scanner.value.runs(data[slice(*lo)]), lo[0])]
        if not runs and not _KEYWORD.search(raw) and not _LONG_HEX.search(raw):
            return [], []
        text = body.as_py()
        base = scanner.value.base(text)
        if len(text) < len(data):  # bytes to code points
            points = np.cumsum((data & 0xC0) != 0x80)
            runs = [(int(points[s]) - 1, int(points[e - 1])) for s, e in runs]
        return base, scanner.value.more(text, runs, base)

    def scan(batches):
        state("secrets")
        for batch in batches:
            found = [spans(body) if len(body.as_buffer()) else ([], []) for body in column(batch, "body")]
            counts = [[sum(s[2] == kind for s in base) for base, _ in found] for kind in KINDS[:3]]
            cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array([len(m) for _, m in found], pa.int64()), pa.array([_joined(b) for b, _ in found]), pa.array([_joined([*b, *m]) for b, m in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "n_assign", "n_access", "n_hex", "n_markov", "base", "spans"])

    return rows.mapInArrow(scan, f"id {id_type}, n_assign long, n_access long, n_hex long, n_markov long, base string, spans string").withColumnRenamed("id", id_col)


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK_BYTES that end where no token character is."""
    lo = 0
    while lo < len(data):
        hi = lo + CHUNK_BYTES
        while hi < len(data) and _CODE[data[hi]]:
            hi += 1
        yield lo, min(hi, len(data))
        lo = hi


def _shifted(runs: list[tuple[int, int]], by: int) -> list[tuple[int, int]]:
    return [(s + by, e + by) for s, e in runs]
