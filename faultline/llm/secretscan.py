"""Secrets in texts: known shapes, and strings whose characters are too evenly mixed to be words.

Known shapes are found by pattern. Beside them, a window slides over every candidate string of a character class; the counts of
its characters are kept up to date as one character enters and one leaves, and with them its Shannon entropy. Windows of high
entropy are joined to spans, unless the allow-list explains the string.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.pieces import map_texts

#: The known shapes, in this order, with the least length of the whole match or of group 2.
SHAPES = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: Characters of a window, and the part of a bit in which entropy is counted, so that sums are whole numbers without drift.
WINDOW, UNIT = 20, 1 << 20
#: Character classes: the candidate strings of each, and the bits a character from which a window is a finding. A window must
#: hold a digit and a letter, and in ``entropy_mixed`` both cases: words of any language hold no digits.
CLASSES = {
    "entropy_hex": (r"[0-9a-fA-F]", 3.0, ("digit", "letter")),
    "entropy_mixed": (r"[A-Za-z0-9+/_-]", 3.6, ("digit", "lower", "upper")),
}
#: Candidate strings that are no secrets: UUIDs, paths of words, timestamps, runs of an alphabet, documented examples.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"/?(?:[A-Za-z]+[0-9]{0,4}[/_-]+)+[A-Za-z]*[0-9]{0,4}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9-]+Z?",
    r".*(?:EXAMPLE|Example|example|placeholder|0123456789|abcdefghij|ABCDEFGHIJ).*",
)
KINDS = (*SHAPES, *CLASSES)
SPANS = "array<struct<kind:string,start:int,end:int>>"

COST = [0, *(round(UNIT * c * math.log2(c)) for c in range(1, WINDOW + 1))]
"""By how much a character that stands c times in a window lowers its entropy, times the window's length."""


def most_cost(bits: float) -> int:
    """The most that the costs of a window's characters may sum to where it has ``bits`` a character or more."""
    return math.floor(UNIT * WINDOW * (math.log2(WINDOW) - bits))


def windows(text: str, most: int, needs: tuple[str, ...]) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``text`` whose costs are within ``most`` and which hold each of ``needs``."""
    kind = lambda c: ("digit",) if "0" <= c <= "9" else ("lower", "letter") if "a" <= c <= "z" else ("upper", "letter") if "A" <= c <= "Z" else ()
    kinds = {c: kind(c) for c in set(text)}
    count = dict.fromkeys(kinds, 0)
    held = dict.fromkeys(("digit", "lower", "upper", "letter"), 0)
    cost, out = 0, []
    for i, c in enumerate(text):
        n = count[c]
        cost += COST[n + 1] - COST[n]
        count[c] = n + 1
        for x in kinds[c]:
            held[x] += 1
        if i + 1 < WINDOW:
            continue
        start = i + 1 - WINDOW
        if cost <= most and all(held[x] for x in needs):
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
        gone = text[start]
        n = count[gone]
        cost += COST[n - 1] - COST[n]
        count[gone] = n - 1
        for x in kinds[gone]:
            held[x] -= 1
    return out


def known_shapes(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each known shape that do not overlap others of their kind; those too short are dropped."""
    return [(kind, *m.span()) for kind, (pattern, group, least) in SHAPES.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


class Scanner:
    """The compiled classes and the allow-list of a task."""

    def __init__(self, allow: tuple[str, ...]):
        self.classes = [(kind, re.compile(f"{chars}{{{WINDOW},}}"), most_cost(bits), needs) for kind, (chars, bits, needs) in CLASSES.items()]
        self.allow = [re.compile(p) for p in allow]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found = known_shapes(text)
        for kind, pattern, most, needs in self.classes:
            for m in pattern.finditer(text):
                near = windows(m[0], most, needs)
                if near and not any(p.fullmatch(m[0]) for p in self.allow):
                    for a, b in near:
                        a, b = a + m.start(), b + m.start()
                        # what a span found before holds whole is not said again
                        if not any(s <= a and b <= e for _, s, e in found):
                            found.append((kind, a, b))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with ``secret_spans``: kind, start and end (code points, end exclusive) of every finding, by start, then kind.

    Texts are read whole, whatever their length; a null or empty text has no span, rows that repeat each get theirs, an empty
    table gives an empty table. A column of that name is replaced, all others pass. ``allow`` are patterns of whole candidate
    strings; known shapes are reported whatever it says. One pass, no exchange.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "secret_spans"])

    def make(texts: list[str], held: dict) -> list[tuple[str, pa.Array]]:
        scanner = held.setdefault("scanner", Scanner(allow))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return [("secret_spans", pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scanner.spans(t)] for t in texts], kind))]

    return map_texts(docs, text_col, f"secret_spans {SPANS}", make)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
