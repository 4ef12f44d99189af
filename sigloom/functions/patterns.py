"""Byte patterns: a small algebra compiled to Java regular expressions over Latin-1 text.

One character of ``decode(content, 'ISO-8859-1')`` is one byte, so every pattern
becomes a regular expression that Catalyst evaluates in the JVM. Each pattern
also knows its length bounds, its expansion into literal byte strings (for
prefilters) and a naive matcher that the property tests hold the compiled form
against.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

#: Expansions beyond this are not used as literals.
MAX_EXPANSIONS = 128


def byte_regex(data: bytes) -> str:
    return "".join(f"\\x{b:02X}" for b in data)


def class_regex(values) -> str:
    """A character class of the given byte values, by runs."""
    values = sorted(set(values))
    if len(values) == 256:
        return "[\\x00-\\xFF]"
    if not values:
        return "(?!)"
    runs, begin = [], values[0]
    for a, b in zip(values, [*values[1:], None]):
        if b != a + 1:
            runs.append(f"\\x{begin:02X}" if begin == a else f"\\x{begin:02X}-\\x{a:02X}")
            begin = b
    return f"[{''.join(runs)}]"


class Pattern:
    """Base: ``regex``, ``lengths`` (least, most), ``expand`` (literal byte strings or None), ``match`` (naive)."""

    def regex(self) -> str:
        raise NotImplementedError

    def lengths(self) -> tuple[int, int]:
        raise NotImplementedError

    def count(self) -> int:
        """How many byte strings match."""
        raise NotImplementedError

    def strings(self):
        """All byte strings that match, for countable patterns."""
        raise NotImplementedError

    def match(self, data: bytes, at: int) -> set[int]:
        """Lengths of the matches that begin at ``at``."""
        least, most = self.lengths()
        return {n for n in range(least, most + 1) if at + n <= len(data) and self.accepts(data[at : at + n])}

    def accepts(self, part: bytes) -> bool:
        raise NotImplementedError

    def expand(self, limit: int = MAX_EXPANSIONS) -> list[bytes] | None:
        return sorted(set(self.strings())) if self.count() <= limit else None


@dataclass(frozen=True)
class Seq(Pattern):
    """Exact bytes."""

    data: bytes

    def regex(self):
        return byte_regex(self.data)

    def lengths(self):
        return len(self.data), len(self.data)

    def count(self):
        return 1

    def strings(self):
        yield self.data

    def accepts(self, part):
        return part == self.data


@dataclass(frozen=True)
class Alt(Pattern):
    """Any of the options."""

    options: tuple[Pattern, ...]

    def regex(self):
        return "(?:" + "|".join(p.regex() for p in self.options) + ")"

    def lengths(self):
        return min(p.lengths()[0] for p in self.options), max(p.lengths()[1] for p in self.options)

    def count(self):
        return sum(p.count() for p in self.options)

    def strings(self):
        for p in self.options:
            yield from p.strings()

    def accepts(self, part):
        return any(p.accepts(part) for p in self.options)


@dataclass(frozen=True)
class Cat(Pattern):
    """One after the other."""

    parts: tuple[Pattern, ...]

    def regex(self):
        return "".join(p.regex() for p in self.parts)

    def lengths(self):
        return sum(p.lengths()[0] for p in self.parts), sum(p.lengths()[1] for p in self.parts)

    def count(self):
        n = 1
        for p in self.parts:
            n *= p.count()
        return n

    def strings(self):
        for each in itertools.product(*(list(p.strings()) for p in self.parts)):
            yield b"".join(each)

    def accepts(self, part):
        ends = {0}
        for p in self.parts:
            ends = {e + n for e in ends for n in p.match(part, e)}
        return len(part) in ends


@dataclass(frozen=True)
class Not(Pattern):
    """As many bytes as the inner pattern has at least, unless the inner pattern matches there."""

    inner: Pattern

    def regex(self):
        if isinstance(self.inner, Bytes):
            return class_regex(set(range(256)) - self.inner.values())
        return f"(?!{self.inner.regex()})[\\x00-\\xFF]{{{self.inner.lengths()[0]}}}"

    def lengths(self):
        return self.inner.lengths()[0], self.inner.lengths()[0]

    def count(self):
        return 256 ** self.inner.lengths()[0] - sum(len(s) == self.inner.lengths()[0] for s in set(self.inner.strings())) if self.inner.count() <= 70_000 else 1 << 62

    def strings(self):
        bad = set(self.inner.strings())
        for each in itertools.product(range(256), repeat=self.inner.lengths()[0]):
            if bytes(each) not in bad:
                yield bytes(each)

    def match(self, data, at):
        n = self.inner.lengths()[0]
        return {n} if at + n <= len(data) and not self.inner.match(data, at) else set()

    def accepts(self, part):
        return len(part) == self.inner.lengths()[0] and not self.inner.match(part, 0)


class Bytes(Pattern):
    """A pattern of one byte, given by its values."""

    def values(self) -> set[int]:
        raise NotImplementedError

    def regex(self):
        return class_regex(self.values())

    def lengths(self):
        return 1, 1

    def count(self):
        return len(self.values())

    def strings(self):
        for v in sorted(self.values()):
            yield bytes([v])

    def accepts(self, part):
        return len(part) == 1 and part[0] in self.values()


@dataclass(frozen=True)
class Mask(Bytes):
    """All bits of the mask are set."""

    bits: int

    def values(self):
        return {v for v in range(256) if v & self.bits == self.bits}


@dataclass(frozen=True)
class AnyMask(Bytes):
    """Any bit of the mask is set."""

    bits: int

    def values(self):
        return {v for v in range(256) if v & self.bits}


@dataclass(frozen=True)
class Range(Pattern):
    """Byte strings of one length between two bounds, compared byte by byte from the left."""

    low: bytes
    high: bytes

    def __post_init__(self):
        if len(self.low) != len(self.high) or not self.low or self.low > self.high:
            raise ValueError("a range needs two bounds of one length, in order")

    def regex(self):
        return _between(self.low, self.high)

    def lengths(self):
        return len(self.low), len(self.low)

    def count(self):
        return int.from_bytes(self.high, "big") - int.from_bytes(self.low, "big") + 1

    def strings(self):
        for v in range(int.from_bytes(self.low, "big"), int.from_bytes(self.high, "big") + 1):
            yield v.to_bytes(len(self.low), "big")

    def accepts(self, part):
        return len(part) == len(self.low) and self.low <= part <= self.high


def _between(low: bytes, high: bytes) -> str:
    """Regex of low..high by splitting on the first byte."""
    a, b = low[0], high[0]
    if len(low) == 1:
        return class_regex(range(a, b + 1))
    rest = len(low) - 1
    if a == b:
        return byte_regex(low[:1]) + _between(low[1:], high[1:])
    options = [byte_regex(low[:1]) + _between(low[1:], b"\xff" * rest), byte_regex(high[:1]) + _between(b"\x00" * rest, high[1:])]
    if b - a > 1:
        options.append(class_regex(range(a + 1, b)) + f"[\\x00-\\xFF]{{{rest}}}")
    return "(?:" + "|".join(options) + ")"


@dataclass(frozen=True)
class IgnoreCase(Pattern):
    """Bytes whose ASCII letters match in either case."""

    data: bytes

    def _choices(self):
        return [sorted({*bytes([b]).lower(), *bytes([b]).upper()}) for b in self.data]

    def regex(self):
        return "".join(class_regex(c) if len(c) > 1 else byte_regex(bytes(c)) for c in self._choices())

    def lengths(self):
        return len(self.data), len(self.data)

    def count(self):
        n = 1
        for c in self._choices():
            n *= len(c)
        return n

    def strings(self):
        for each in itertools.product(*self._choices()):
            yield bytes(each)

    def accepts(self, part):
        return part.lower() == self.data.lower() and len(part) == len(self.data)


@dataclass(frozen=True)
class Masked(Pattern):
    """Bytes that equal the value wherever the mask has bits."""

    value: bytes
    mask: bytes

    def __post_init__(self):
        if len(self.value) != len(self.mask):
            raise ValueError("value and mask differ in length")

    def _choices(self):
        return [[v for v in range(256) if v & m == w & m] for w, m in zip(self.value, self.mask)]

    def regex(self):
        return "".join(class_regex(c) if len(c) > 1 else byte_regex(bytes(c)) for c in self._choices())

    def lengths(self):
        return len(self.value), len(self.value)

    def count(self):
        n = 1
        for c in self._choices():
            n *= len(c)
        return n

    def strings(self):
        for each in itertools.product(*self._choices()):
            yield bytes(each)

    def accepts(self, part):
        return len(part) == len(self.value) and all(p & m == w & m for p, w, m in zip(part, self.value, self.mask))

    def pieces(self) -> list[tuple[int, bytes]] | None:
        """(gap before, literal) pieces if every mask byte is all or nothing, else None."""
        if any(m not in (0, 255) for m in self.mask):
            return None
        out, gap, piece = [], 0, b""
        for w, m in zip(self.value, self.mask):
            if m:
                piece += bytes([w])
            elif piece:
                out.append((gap, piece))
                gap, piece = 1, b""
            else:
                gap += 1
        return [*out, (gap, piece)] if piece else out


def int8(v: int) -> Pattern:
    return Seq(v.to_bytes(1, "big", signed=v < 0))


def big(v: int, size: int) -> Pattern:
    return Seq(v.to_bytes(size, "big", signed=v < 0))


def little(v: int, size: int) -> Pattern:
    return Seq(v.to_bytes(size, "little", signed=v < 0))


def host(v: int, size: int) -> Pattern:
    """Either byte order."""
    a, b = big(v, size), little(v, size)
    return a if a == b else Alt((a, b))


def self_overlap(a: bytes, b: bytes) -> int:
    """How far ``b`` must move right over ``a`` until what lies over ``a`` agrees (at least 1)."""
    for n in range(1, len(a)):
        part = a[n : n + len(b)]
        if part == b[: len(part)]:
            return n
    return max(len(a), 1)


def shown(data: bytes) -> str:
    """Quoted text if the bytes are printable ASCII, else hex."""
    text = data.decode("latin-1")
    return f"'{text}'" if text.isascii() and text.isprintable() else data.hex()
