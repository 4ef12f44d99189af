"""Frames and signatures: patterns placed by offsets, compiled to anchored runs.

A signature is a conjunction of runs. A run from the beginning (BOF) has frames
whose offsets are counted from the end of the frame before; a run from the end
(EOF) has frames whose offsets are counted to the start of the frame after, and
for the last one to the end of the content. Each run becomes one regular
expression whose groups alternate gaps and frames, so group lengths give the
offsets; the runs of a signature are AND-ed and may overlap.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from sigloom.functions.patterns import Pattern, Seq

BOF, PREV, SUCC, EOF = "BOF", "PREV", "SUCC", "EOF"

@dataclass(frozen=True)
class Frame:
    """A pattern at ``low``..``high`` bytes (high None: any distance) from what ``orient`` names."""

    pattern: Pattern
    orient: str = BOF
    low: int = 0
    high: int | None = 0

    @property
    def kind(self) -> str:
        """fixed, window, wild or wild_min."""
        if self.high is None:
            return "wild_min" if self.low else "wild"
        return "fixed" if self.low == self.high else "window"

    def gap(self) -> str:
        if self.high is None:
            return "[\\x00-\\xFF]" + (f"{{{self.low},}}?" if self.low else "*?")
        if self.low == self.high:
            return f"[\\x00-\\xFF]{{{self.low}}}" if self.low else ""
        return f"[\\x00-\\xFF]{{{self.low},{self.high}}}?"

    def mirrored(self) -> "Frame":
        """The frame counted from the other side: a wild PREV becomes SUCC, a BOF becomes EOF."""
        other = {BOF: EOF, EOF: BOF, PREV: SUCC, SUCC: PREV}
        return Frame(self.pattern, other[self.orient], self.low, self.high)

    def starts(self, data: bytes) -> set[tuple[int, int]]:
        """(start, end) of the matches of a BOF frame, naively."""
        last = len(data) if self.high is None else self.high
        return {(at, at + n) for at in range(self.low, min(last, len(data)) + 1) for n in self.pattern.match(data, at)}


def key_rank(key: tuple[str, int, list[bytes]]) -> tuple:
    """Which of two keys narrows more: one at a fixed place, then the longer, then the one of fewer strings."""
    return key[0] in ("bof", "eof"), min(map(len, key[2])), -len(key[2])


@dataclass(frozen=True)
class Run:
    """Frames that hang together, first to last in the content."""

    frames: tuple[Frame, ...]

    @property
    def from_end(self) -> bool:
        return self.frames[-1].orient in (SUCC, EOF)

    def regex(self, groups: bool = False) -> str:
        """With ``groups`` the groups alternate gap, frame, gap, frame, ... (BOF) or frame, gap, ..., frame, gap (EOF)."""
        wrap = (lambda x: f"({x})") if groups else (lambda x: x)
        if not self.from_end:
            body = "".join(wrap(f.gap()) + wrap(f.pattern.regex()) for f in self.frames)
            wild = self.frames[0].kind == "wild" and not groups
            return body[len(self.frames[0].gap()) :] if wild else "\\A" + body
        body = "".join(wrap(f.pattern.regex()) + wrap(f.gap()) for f in self.frames)
        last = self.frames[-1]
        wild = last.orient == SUCC or last.kind == "wild"
        return body[: len(body) - len(last.gap())] if wild and not groups else body + ("" if last.orient == SUCC else "\\z")

    def search(self) -> tuple[str, int, int | None, int | None, bool]:
        """(expression, low, high, bound, from_end): how the matched part is sought in Python.

        From the beginning the part must begin at ``low`` to ``high`` (None: anywhere behind) and lies within the first
        ``bound`` bytes; from the end group 1 is the part, and all of it lies within the last ``bound`` bytes (None: no
        bound), so no more than that is read.
        """
        if not self.from_end:
            first = self.frames[0]
            part = first.pattern.regex() + "".join(f.gap() + f.pattern.regex() for f in self.frames[1:])
            return part, first.low, first.high, self.bounds(), False
        last = self.frames[-1]
        part = "".join(f.pattern.regex() + f.gap() for f in self.frames[:-1]) + last.pattern.regex()
        return "(" + part + ")" + ("" if last.orient == SUCC else last.gap() + "\\Z"), 0, None, self.bounds(), True

    def matches(self, data: bytes) -> bool:
        """Naive interpreter over the frames, the yardstick of the compiled form."""
        if not self.from_end:
            ends = {0}
            for f in self.frames:
                ends = {e + b for e in ends for _, b in Frame(f.pattern, BOF, f.low, f.high).starts(data[e:])}
            return bool(ends)
        heads = {len(data)}
        for i, f in enumerate(reversed(self.frames)):
            found = set()
            free = i == 0 and f.orient == SUCC
            for at in range(len(data) + 1):
                for n in f.pattern.match(data, at):
                    if any(free or f.low <= h - at - n and (f.high is None or h - at - n <= f.high) for h in heads):
                        found.add(at)
            heads = found
        return bool(heads)

    def literal(self) -> tuple[str, int, list[bytes]] | None:
        """(side, offset, literals): any match has one of the literals there.

        Sides: ``bof`` and ``eof`` with the fixed offset, ``head`` and ``tail`` with the number of bytes from that side
        that hold it, ``any`` for a place anywhere. A choice gives its few byte strings. Zeros are no key, as padding
        would make every file a candidate.
        """
        at, fixed, bound = 0, True, self.bounds()
        free = ("any", 0) if bound is None else ("tail" if self.from_end else "head", bound)
        best: tuple[str, int, list[bytes]] | None = None
        frames = self.frames if not self.from_end else self.frames[::-1]
        for f in frames:
            fixed = fixed and f.kind == "fixed" and f.orient != (SUCC if f is frames[0] else "")
            at += f.low
            least, most = f.pattern.lengths()
            found = f.pattern.expand()
            if found and all(any(x) for x in found):
                key = ("eof" if self.from_end else "bof", at, found) if fixed else (*free, found)
                if best is None or key_rank(key) > key_rank(best):
                    best = key
            fixed = fixed and least == most
            at += most
        return best

    def bounds(self) -> int | None:
        """How many bytes from its side the run can reach at most; None without bound."""
        total = 0
        for f in self.frames:
            if f.high is None or (f.orient == SUCC and f is self.frames[-1]):
                return None
            total += f.high + f.pattern.lengths()[1]
        return total


@dataclass(frozen=True)
class Signature:
    """Frames in the order of the content."""

    frames: tuple[Frame, ...]
    runs_: tuple[Run, ...] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        runs: list[list[Frame]] = []
        for f in self.frames:
            # a BOF frame begins a run; an EOF-side frame begins one unless it goes on from an EOF-side frame that is not the last
            if not runs or f.orient == BOF or (f.orient in (SUCC, EOF)) != (runs[-1][-1].orient in (SUCC, EOF)) or runs[-1][-1].orient == EOF:
                runs.append([f])
            else:
                runs[-1].append(f)
        object.__setattr__(self, "runs_", tuple(Run(tuple(r)) for r in runs))

    @property
    def runs(self) -> tuple[Run, ...]:
        return self.runs_

    def regexes(self, groups: bool = False) -> list[str]:
        return [r.regex(groups) for r in self.runs]

    def searches(self) -> list[tuple]:
        return [r.search() for r in self.runs]

    def matches(self, data: bytes) -> bool:
        return all(r.matches(data) for r in self.runs)

    def literal(self) -> tuple[str, int, list[bytes]] | None:
        """The best prefilter of all runs."""
        return max((x for r in self.runs if (x := r.literal())), key=key_rank, default=None)

    def phase(self) -> int:
        """Order in which the parts complete: 1 from the beginning, 3 from the end, 4 anywhere."""
        if any(f.kind in ("wild", "wild_min") for r in self.runs for f in r.frames):
            return 4
        return 3 if any(r.from_end for r in self.runs) else 1

    def limited(self, bof: int | None = None, eof: int | None = None, no_eof: bool = False) -> "Signature":
        """The signature under scan limits: windows clipped to bof and eof bytes, the EOF side left out with no_eof."""
        out = []
        for f in self.frames:
            if f.orient in (SUCC, EOF) and no_eof:
                continue
            top = bof if f.orient in (BOF, PREV) else eof
            high = f.high if top is None else top if f.high is None else min(f.high, top)
            out.append(Frame(f.pattern, f.orient, min(f.low, high) if high is not None else f.low, high))
        return Signature(tuple(out) or self.frames)

    def mirrored(self) -> "Signature | None":
        """A copy whose wild PREV tail is sought from the end, or None if there is none."""
        at = next((i for i, f in enumerate(self.frames) if i and f.orient == PREV and f.high is None), None)
        if at is None:
            return None
        tail = self.frames[at:]
        turned = [Frame(a.pattern, SUCC, b.low, b.high) for a, b in zip(tail, tail[1:])] + [Frame(tail[-1].pattern, EOF, 0, None)]
        return Signature(self.frames[:at] + tuple(turned))

    def contains(self, other: "Signature") -> bool:
        """Whether each literal frame of ``other`` lies inside a frame of this one at a place that agrees."""

        def place(sig):
            out = []
            for r in sig.runs:
                at, fixed = 0, True
                for f in r.frames if not r.from_end else r.frames[::-1]:
                    fixed = fixed and f.kind == "fixed"
                    at += f.low
                    if not isinstance(f.pattern, Seq):
                        out.append((r.from_end, None, None))
                    else:
                        out.append((r.from_end, at if fixed else None, f.pattern.data))
                    at += f.pattern.lengths()[1]
                    fixed = fixed and f.pattern.lengths()[0] == f.pattern.lengths()[1]
            return out

        mine = place(self)

        def inside(side, at, data):
            if data is None:
                return False
            for s, b, d in mine:
                if d is None or s != side:
                    continue
                where = -1
                while (where := d.find(data, where + 1)) >= 0:
                    off = where if not side else len(d) - where - len(data)
                    if at is None or b is not None and b + off == at:
                        return True
            return False

        return all(inside(*x) for x in place(other))
