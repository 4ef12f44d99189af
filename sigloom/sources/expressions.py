"""The archive-registry pattern notation: hex, quoted text, gaps, groups - parsed to frames.

    item  := text | group | {n} | {n-m} | {n-*} | ?? | *
    text  := hex pairs, 'quoted' parts and blanks
    group := [ body ] or ( body ); alternatives are separated by | or blanks
    body  := optional ! & ~, then text, text:text (a range) or a nested group
"""

from __future__ import annotations

import re

from sigloom.functions.frames import BOF, EOF, PREV, SUCC, Frame, Signature
from sigloom.functions.patterns import Alt, AnyMask, Cat, Mask, Not, Pattern, Range, Seq

HEX = re.compile(r"[0-9A-Fa-f]{2}")
QUOTED = re.compile(r"'([^']*)'")
GAP = re.compile(r"\{\s*(\d+)\s*(?:-\s*(\d+|\*)\s*)?\}")


class NotationError(ValueError):
    """The text is not in the notation."""


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, what: str):
        raise NotationError(f"{what} at {self.at} of {self.text!r}")

    def literal(self, blanks: bool) -> bytes:
        """Hex pairs and quoted parts in a row."""
        out = b""
        while self.at < len(self.text):
            if m := QUOTED.match(self.text, self.at):
                out += m.group(1).encode()
            elif m := HEX.match(self.text, self.at):
                out += bytes.fromhex(m.group())
            elif blanks and self.text[self.at].isspace():
                self.at += 1
                continue
            else:
                break
            self.at = m.end()
        return out

    def group(self) -> Pattern:
        close = {"[": "]", "(": ")"}[self.text[self.at]]
        self.at += 1
        options: list[list[Pattern]] = [[]]
        while True:
            if self.at >= len(self.text):
                self.fail("a group is not closed")
            c = self.text[self.at]
            if c == close:
                self.at += 1
                break
            if c == "|" or c.isspace():
                self.at += 1
                if options[-1]:
                    options.append([])
                continue
            options[-1].append(self.element())
        parts = [o[0] if len(o) == 1 else Cat(tuple(o)) for o in options if o]
        if not parts:
            self.fail("an empty group")
        return parts[0] if len(parts) == 1 else Alt(tuple(parts))

    def element(self) -> Pattern:
        sign = self.text[self.at] if self.text[self.at] in "!&~" else ""
        self.at += len(sign)
        if self.at < len(self.text) and self.text[self.at] in "[(":
            got = self.group()
        else:
            low = self.literal(False)
            if not low:
                self.fail("no pattern")
            if sign in ("&", "~"):
                return (Mask if sign == "&" else AnyMask)(low[0])
            got = Seq(low)
            if self.at < len(self.text) and self.text[self.at] in ":-":
                self.at += 1
                try:
                    got = Range(low, self.literal(False))
                except ValueError:
                    self.fail("a range without order")
        return Not(got) if sign == "!" else got

    def items(self):
        """(gap before, pattern) pairs and the trailing gap; a gap is (low, high or None)."""
        out, low, high = [], 0, 0
        while self.at < len(self.text):
            c = self.text[self.at]
            if c.isspace():
                self.at += 1
            elif self.text.startswith("??", self.at):
                self.at += 2
                low, high = low + 1, None if high is None else high + 1
            elif c == "*":
                self.at += 1
                high = None
            elif c == "{":
                m = GAP.match(self.text, self.at)
                if not m:
                    self.fail("a broken gap")
                self.at = m.end()
                least, most = int(m.group(1)), m.group(2)
                low += least
                high = None if most == "*" or high is None else high + (int(most) if most else least)
            else:
                got = self.group() if c in "[(" else Seq(self.literal(True))
                if isinstance(got, Seq) and not got.data:
                    self.fail("an unknown character")
                out.append(((low, high), got))
                low, high = 0, 0
        return out, (low, high)


def parse_items(text: str):
    """(gap before, pattern) pairs of a notation text, and the gap after the last."""
    out, tail = _Parser(text).items()
    if not out:
        raise NotationError("no pattern")
    return out, tail


def from_start(text: str, low: int = 0, high: int | None = 0) -> list[Frame]:
    """Frames counted from the beginning: the first BOF at low..high (plus its own gap), the others PREV."""
    items, _ = parse_items(text)
    (gap_low, gap_high), first = items[0]
    top = None if high is None or gap_high is None else high + gap_high
    return [Frame(first, BOF, low + gap_low, top), *(Frame(p, PREV, *g) for g, p in items[1:])]


def from_end(text: str, low: int = 0, high: int | None = 0) -> list[Frame]:
    """Frames counted from the end: all but the last SUCC by the gap after them, the last EOF at low..high."""
    items, tail = parse_items(text)
    if tail != (0, 0):
        low, high = tail
    return [*(Frame(p, SUCC, *g) for (_, p), (g, _) in zip(items, items[1:])), Frame(items[-1][1], EOF, low, high)]


def number(text, default: int = 0) -> int:
    text = str(text or "").strip()
    return int(text) if re.fullmatch(r"\d+", text) else default


def placed(position: str, offset, max_offset, text: str) -> list[Frame]:
    """Frames of one byte sequence of a format report. A maximum offset counts from the offset."""
    low, more = number(offset), number(max_offset)
    position = (position or "").strip().lower()
    if position.endswith("eof"):
        return from_end(text, low, low + more)
    if position.endswith("bof"):
        return from_start(text, low, low + more)
    return from_start(text, low, low + more if more else None)


def signature_of(sequences) -> Signature:
    """One signature of (position, offset, max offset, notation) sequences; those from the beginning come first."""
    front, back = [], []
    for s in sequences:
        frames = placed(*s)
        (back if frames[-1].orient == EOF else front).extend(frames)
    return Signature(tuple(front + back))
