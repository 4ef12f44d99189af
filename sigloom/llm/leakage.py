"""Evaluation texts leaking into training text.

Spaced-seed hashing: over every window of 12 words, three fixed masks leave out
every third position each and hash the others, so a mask still hits where the
words it leaves out were replaced. The hashes of the test items are joined with
those of the training text; around every hit the overlap is verified word by
word: as long as each window of 12 words holds no more than the tolerated
substitutions it grows in both directions. The verified overlaps tell their
length, their substitutions and their longest run of equal words; the leaks as
TESTDATA.md states them are those whose longest run is 12 words, or the whole of
a shorter item.

The test side is broadcast only while its number of windows is below
``MAX_SEEDS``; then the join is a sorted lookup inside the scan and nothing of
the corpus is shuffled. Beyond, a bit filter of the test hashes (bounded, at
most ``MAX_BITS``) is broadcast instead, only the windows it lets through leave
the scan, each once per document, and they are joined by shuffle on the hash.

Any window with one substitution is hit by two of the masks, so nothing within
a tolerance of one is missed. With two or three, a window is hit for sure only
if one mask leaves all of them out; README has the measured recall.

Defined results: items of fewer than 12 words are sought whole, with at most a
third of their words replaced, items without a word never; null and empty texts
hold nothing; an item found more than once in a document is one row, repeated
rows of a document are one document; empty tables give no rows; other columns
are never read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.textform import words
from sigloom.session import cut, spread

SPAN = 12
STRIDE = 3
#: Substitutions a window of ``SPAN`` words may hold.
TOLERANCE = 1
#: Windows of the test side up to which it is broadcast (about 100 bytes each).
MAX_SEEDS = 1_000_000
#: Bits of the filter at most (16 MB).
MAX_BITS = 1 << 27
MAX_KEPT = 500_000
#: Mask of the low bits that are looked at first.
LOW = (1 << 18) - 1
#: Odd multipliers of the positions in a window.
FACTORS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1 for i in range(SPAN)], dtype=np.uint64)


def masks(span: int) -> list[list[int]]:
    """The positions each mask keeps; three leave out each position once. Windows of one or two words are kept whole."""
    return [[i for i in range(span) if i % STRIDE != m] for m in range(STRIDE)] if span >= STRIDE else [list(range(span))]


def tolerated(span: int, substitutions: int) -> int:
    return min(substitutions, span // STRIDE)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_KEPT:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def seeds(hashes: np.ndarray, span: int) -> list[np.ndarray]:
    """The seed hash of every window of ``span`` words under each mask: the sum over all positions less those it leaves out."""
    n = max(len(hashes) - span + 1, 0)
    left = [np.zeros(n, dtype=np.uint64) for _ in range(STRIDE)]
    for i in range(span if n else 0):
        left[i % STRIDE] += hashes[i : i + n] * FACTORS[i]
    whole = left[0] + left[1] + left[2]
    return [whole - part for part in left] if span >= STRIDE else [whole]


def grown(text: list[str], item: list[str], at: int, begin: int, span: int, most: int) -> tuple | None:
    """(from, to, first word, words, substitutions, longest equal run) of the overlap around a hit; None if the hit is not verified.

    text[at:] and item[begin:] lie on one diagonal; the overlap grows word by word while the last ``span`` words on that
    side hold at most ``most`` substitutions (from, to); it begins and ends with equal words.
    """
    shift = begin - at
    differ = lambda i: text[i] != item[i + shift]
    inside = sum(map(differ, range(at, at + span)))
    if inside > most:
        return None
    lo, hi, n = at, at + span, inside
    top, bottom = min(len(text), len(item) - shift), max(0, -shift)
    while hi < top and (n := n + differ(hi) - differ(hi - span)) <= most:
        hi += 1
    n = inside
    while lo > bottom and (n := n + differ(lo - 1) - differ(lo + span - 1)) <= most:
        lo -= 1
    first, end = lo, hi
    while differ(first):
        first += 1
    while differ(end - 1):
        end -= 1
    total = longest = run = 0
    for i in range(first, end):
        if differ(i):
            total, run = total + 1, 0
        else:
            run += 1
            longest = max(longest, run)
    return lo, hi, first, end - first, total, longest


class TestSide:
    """Seeds of all test items: by window length and mask, the sorted hashes and the windows they come from."""

    __test__ = False

    def __init__(self, items: list[tuple[int, list[str]]], substitutions: int = TOLERANCE):
        self.items, self.substitutions = items, substitutions
        found: dict = defaultdict(lambda: defaultdict(list))
        known = WordHashes()
        for at, (_, ws) in enumerate(items):
            span = min(SPAN, len(ws))
            if span:
                for k, got in enumerate(seeds(known.of(ws), span)):
                    for pos, h in enumerate(got.tolist()):
                        found[span, k][h].append((at, pos))
        self.windows = {key: dict(by) for key, by in found.items()}
        self.sorted = {key: np.array(sorted(by), dtype=np.uint64) for key, by in found.items()}
        # by the low bits of a hash: whether any seed has them, so that few hashes need the lookup
        self.low = {key: np.zeros(LOW + 1, dtype=bool) for key in found}
        for key, got in self.sorted.items():
            self.low[key][got & np.uint64(LOW)] = True

    def overlaps(self, texts: list[str | None], known: WordHashes) -> list[tuple]:
        """(index of the text, item id, word in the text, word in the item, words, substitutions, longest run, run that is a leak)."""
        split = [words(t) for t in texts]
        ends = np.cumsum([len(w) for w in split], dtype=np.int64) if split else np.zeros(0, np.int64)
        hashes = known.of([w for ws in split for w in ws])
        out, seen = [], defaultdict(list)
        for span in {s for s, _ in self.sorted}:
            for k, mine in enumerate(seeds(hashes, span)):
                test = self.sorted[span, k]
                some = np.flatnonzero(self.low[span, k][mine & np.uint64(LOW)])
                where = np.searchsorted(test, mine[some])
                where[where == len(test)] = 0
                for pos in some[test[where] == mine[some]].tolist():
                    doc = int(np.searchsorted(ends, pos, side="right"))
                    if pos + span > ends[doc]:
                        continue
                    text = split[doc]
                    place = pos - int(ends[doc]) + len(text)
                    for at, begin in self.windows[span, k][int(mine[pos])]:
                        done = seen[doc, at, begin - place]
                        if any(lo <= place and place + span <= hi for lo, hi in done):
                            continue
                        item, ws = self.items[at]
                        got = grown(text, ws, place, begin, span, tolerated(span, self.substitutions))
                        if got:
                            done.append(got[:2])
                            out.append((doc, item, got[2], got[2] + begin - place, *got[3:], span))
        return out


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((n, pa.int32()) for n in ("doc_word", "item_word", "n_words", "n_differ", "longest", "needed"))])
OVERLAPS = "doc_id bigint, item_id bigint, doc_word int, item_word int, n_words int, n_differ int, longest int, needed int"


def _broadcast_join(docs: DataFrame, items: list[tuple[int, list[str]]], substitutions: int) -> DataFrame:
    """The verified overlaps, by lookup inside the scan."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, known = TestSide(shared.value, substitutions), WordHashes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                ids = part.column(0).to_pylist()
                rows = [(ids[d], *rest) for d, *rest in side.overlaps(part.column(1).to_pylist(), known)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return spread(docs).mapInArrow(run, OVERLAPS)


def _windows(df: DataFrame, spans: list[int] | None, bits: np.ndarray | None) -> DataFrame:
    """(id, span, mask, seed, window): the windows of every text, of its own span (spans None) or of all given, that the filter lets through; each once per text."""
    schema = pa.schema([("id", pa.int64()), ("span", pa.int32()), ("mask", pa.int32()), ("seed", pa.int64()), ("window", pa.list_(pa.string()))])
    shared = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def passed(got: np.ndarray) -> np.ndarray:
        if shared is None:
            return np.arange(len(got))
        b = shared.value
        size = np.uint64(len(b) * 64 - 1)
        hit = lambda h: (b[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
        return np.flatnonzero((hit(got & size) & hit((got >> np.uint64(32)) & size)) == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                hashes = known.of(ws)
                for span in [min(SPAN, len(ws))] if spans is None else spans:
                    if not 0 < span <= len(ws):
                        continue
                    for m, got in enumerate(seeds(hashes, span)):
                        rows = list({(int(got[i]), *ws[i : i + span]) for i in passed(got).tolist()})
                        if rows:
                            n = len(rows)
                            seed = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([span] * n, pa.int32()), pa.array([m] * n, pa.int32()), pa.array(seed), pa.array([r[1:] for r in rows], pa.list_(pa.string()))], schema=schema)

    return spread(df).mapInArrow(run, "id bigint, span int, mask int, seed bigint, window array<string>")


def bit_filter(seeds_of: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """A bit filter of the seeds with two places each, about 32 bits a seed up to ``max_bits``; or-ed together where the seeds lie."""
    n = seeds_of.count()
    size = min(max_bits, max(1 << 16, 1 << (32 * n).bit_length()))
    at = F.explode(F.array(F.col("seed").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(size - 1)))).alias("at")
    each = seeds_of.select(at).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, dtype=np.uint64)
    out[each.column(0).to_numpy()] = each.column(1).to_numpy().view(np.uint64)
    return out


def _shuffled_join(docs: DataFrame, items: DataFrame, substitutions: int) -> DataFrame:
    """doc_id, item_id, exact: the verified windows, for a test side of any size."""
    test = cut(_windows(items, None, None).withColumnRenamed("id", "item_id").withColumnRenamed("window", "sought"))
    spans = [r.span for r in test.select("span").distinct().collect()]
    text = _windows(docs, sorted(spans), bit_filter(test.select("seed"))).withColumnRenamed("id", "doc_id")
    differ = F.size(F.filter(F.zip_with("window", "sought", lambda a, b: a != b), lambda d: d))
    x = text.join(test, ["span", "mask", "seed"]).withColumn("differ", differ).where(F.col("differ") <= F.least(F.lit(substitutions), F.expr(f"span div {STRIDE}")))
    return x.groupBy("doc_id", "item_id").agg((F.min("differ") == 0).alias("exact"))


def _sides(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Documents and items in slim form, and a bound of the test side's windows: a text of n characters has at most n / 2 + 1 words."""
    x = docs.where("doc_id is not null and text is not null and text != ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    y = items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").distinct()
    return x, y, y.agg(F.coalesce(F.sum(F.length("item_text") / 2 + 1), F.lit(0)).alias("n")).first().n * STRIDE


def _items(y: DataFrame) -> list[tuple[int, list[str]]]:
    return [(r.item_id, words(r.item_text)) for r in y.orderBy("item_id", "item_text").collect()]


def overlaps(docs: DataFrame, items: DataFrame, substitutions: int = TOLERANCE) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words, n_differ, longest: every verified overlap. The test side must be within ``MAX_SEEDS`` windows."""
    x, y, most = _sides(docs, items)
    if most > MAX_SEEDS:
        raise ValueError("the test side is too large to report overlaps; use leaked_items")
    return _broadcast_join(x, _items(y), substitutions).drop("needed").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, substitutions: int = TOLERANCE, exact: bool = True, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """doc_id, item_id of every test item that leaked into a document.

    ``exact``: a verified overlap holds 12 equal words in a row, or all of an item that has fewer. Otherwise every verified
    overlap counts: windows in which up to ``substitutions`` words differ, at most a third of a shorter item.
    """
    x, y, most = _sides(docs, items)
    if most > max_seeds:
        found = _shuffled_join(x, y, substitutions)
        return (found.where("exact") if exact else found).select("doc_id", "item_id")
    found = _broadcast_join(x, _items(y), substitutions)
    return (found.where("longest >= needed") if exact else found).select("doc_id", "item_id").distinct()
