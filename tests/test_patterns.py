"""Pattern algebra, frames and notation, against fixed expectations and a naive interpreter."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.operators.matchers import ByteMatcher
from sigloom.sources.catalog import Catalog
from sigloom.functions.frames import BOF, EOF, PREV, SUCC, Frame, Run, Signature
from sigloom.functions.patterns import Alt, AnyMask, Cat, IgnoreCase, Mask, Masked, Not, Range, Seq, big, host, int8, little, self_overlap, shown
from sigloom.sources.expressions import NotationError, parse_items, signature_of

T = Seq


def found(regex: str, data: bytes) -> bool:
    return re.search(regex.replace("\\z", "\\Z").replace("[\\x00-\\xFF]", "[\\s\\S]"), data.decode("latin-1"), re.S) is not None


def test_sequences_and_choices():
    assert T(b"moor").match(b"mohr", 0) == set()
    assert T(b"moors").match(b"moors", 0) == {5}
    both = Alt((T(b"moor"), T(b"moors")))
    assert both.match(b"moor", 0) == {4} and both.match(b"moors", 0) == {4, 5} and both.count() == 2
    assert Cat((T(b"moor"), T(b"hen"))).match(b"moorhens", 0) == {7}
    assert Not(T(b"hen")).match(b"hen", 0) == set() and Not(T(b"hen")).match(b"her", 0) == {3}
    assert Not(T(b"\x7f")).count() == 255


def test_masks_and_ranges():
    assert Mask(0x41).accepts(b"\xc3") and not Mask(0x41).accepts(b"\x40") and Mask(0x41).count() == 64
    assert AnyMask(0x41).accepts(b"\x40") and not AnyMask(0x41).accepts(b"\xbe") and AnyMask(0x41).count() == 192
    r = Range(b"\x20", b"\x22")
    assert [r.accepts(bytes([i])) for i in range(0x1F, 0x24)] == [False, True, True, True, False]
    wide = Range(b"\x01\xfe", b"\x02\x02")
    assert wide.match(b"\x02\x00", 0) == {2} and wide.count() == 5
    assert Not(r).match(b"\x23", 0) == {1} and Not(r).count() == 253
    assert IgnoreCase(b"MooR").match(b"mOOr", 0) == {4}
    assert IgnoreCase(b"7up").count() == 4 and IgnoreCase(b"x-y-z").count() == 8
    m = Masked(b"mo\0\0rs", bytes.fromhex("FFFF0000FFFF"))
    assert m.match(b"mo??rs", 0) == {6} and m.match(b"mO??rs", 0) == set() and m.pieces() == [(0, b"mo"), (2, b"rs")]


def test_numbers():
    assert int8(-3) == Seq(b"\xfd")
    assert big(-777, 2) == Seq((-777).to_bytes(2, "big", signed=True)) and little(987_654, 4).data == big(987_654, 4).data[::-1]
    assert host(987_654, 4).match(little(987_654, 4).data, 0) == {4} and host(987_654, 4).match(big(987_654, 4).data, 0) == {4}
    assert [self_overlap(b"abab", x) for x in (b"abab", b"ba", b"bb", b"cc")] == [2, 1, 3, 4]
    assert shown(b"hen") == "'hen'" and shown(b"\x01\xfe") == "01fe"


BIRDS = Alt((T(b"hen"), T(b"cock"), T(b"tit")))
SIGNATURES = [
    Signature((Frame(T(b"moor"), BOF), Frame(BIRDS, PREV, 2, 6), Frame(T(b"nest"), EOF, 1, 3))),
    Signature((Frame(T(b"moor"), BOF), Frame(BIRDS, PREV, 0, 1))),
    Signature((Frame(BIRDS, BOF, 0, None), Frame(T(b"egg"), PREV, 0, None))),
    Signature((Frame(BIRDS, SUCC, 0, 4), Frame(T(b"egg"), SUCC, 3, None), Frame(T(b"!"), EOF))),
    Signature((Frame(Cat((T(b"moor"), BIRDS)), BOF),)),
    Signature((Frame(T(b"moor"), BOF), Frame(T(b"egg"), BOF, 8, 20))),
]


@pytest.mark.parametrize(("data", "expected"), [(b"moor..cock egg nest!!", {0, 2, 3, 5}), (b"moorhen eggs, egg!", {1, 2, 3, 4, 5}), (b"tit egg ...!", {2, 3}), (b"egg hen", set())])
def test_signatures(data, expected):
    assert {i for i, s in enumerate(SIGNATURES) if all(found(r, data) for r in s.regexes())} == expected
    assert {i for i, s in enumerate(SIGNATURES) if s.matches(data)} == expected


LEAF = st.one_of(
    st.binary(min_size=1, max_size=2).map(lambda b: Seq(bytes(x % 3 for x in b))),
    st.sampled_from([Mask(1), AnyMask(2), Range(b"\x00", b"\x01"), Range(b"\x00\x01", b"\x01\x00"), Not(Seq(b"\x01")), IgnoreCase(b"\x02"), Masked(b"\x01\x00", b"\xff\x00")]),
)
PATTERN = st.recursive(LEAF, lambda p: st.one_of(st.lists(p, min_size=1, max_size=2).map(lambda x: Alt(tuple(x))), st.lists(p, min_size=1, max_size=2).map(lambda x: Cat(tuple(x)))), max_leaves=3)
DATA = st.binary(max_size=10).map(lambda b: bytes(x % 3 for x in b))


@settings(max_examples=300, deadline=None)
@given(PATTERN, DATA)
def test_compiled_pattern_is_the_naive_one(pattern, data):
    assert found("\\A" + pattern.regex(), data) == bool(pattern.match(data, 0))
    strings = pattern.expand(5000)
    if strings is not None:
        assert all(pattern.accepts(s) for s in strings[:50])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(LEAF, st.integers(0, 2), st.one_of(st.none(), st.integers(0, 2))), min_size=1, max_size=3), DATA, st.booleans())
def test_compiled_run_is_the_naive_one(parts, data, from_end):
    frames = [Frame(p, (SUCC if i < len(parts) - 1 else EOF) if from_end else (PREV if i else BOF), low, None if more is None else low + more) for i, (p, low, more) in enumerate(parts)]
    run = Run(tuple(frames))
    assert found(run.regex(), data) == run.matches(data)
    assert found(run.regex(True), data) == run.matches(data)
    lit = run.literal()
    if lit and run.matches(data):
        side, off, keys = lit
        part = {"head": data[:off], "tail": data[max(0, len(data) - off) :], "any": data}.get(side)
        assert any(b in part if part is not None else b == (data[off : off + len(b)] if side == "bof" else data[len(data) - off - len(b) : len(data) - off]) for b in keys)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(LEAF, st.integers(0, 2), st.one_of(st.none(), st.integers(0, 2))), min_size=1, max_size=3), DATA, st.booleans())
def test_one_pass_finds_what_the_naive_interpreter_finds(parts, data, from_end):
    frames = [Frame(p, (SUCC if i < len(parts) - 1 else EOF) if from_end else (PREV if i else BOF), low, None if more is None else low + more) for i, (p, low, more) in enumerate(parts)]
    sig = Signature(tuple(frames))
    got = list(ByteMatcher(Catalog("n", signatures=[("n", "i", sig, 0)]).compiled()).hits(data))
    assert bool(got) == sig.matches(data)


def test_zeros_are_no_key():
    assert Signature((Frame(T(b"\0\0\0\0"), BOF),)).literal() is None
    assert Signature((Frame(T(b"\0\0"), BOF), Frame(T(b"a\0"), PREV, 0, 3))).literal() == ("head", 7, [b"a\0"])
    assert Signature((Frame(Alt((T(b"ab"), T(b"cd"))), BOF, 1, 1),)).literal() == ("bof", 1, [b"ab", b"cd"])


def test_notation():
    items, _ = parse_items("02{2}[01:1C][01:1F]????[00:03]([41:5A]|[61:7A]){10}(43|4E|4C)")
    assert len(items) == 6 and items[5][0] == (10, 10) and items[3] == ((2, 2), Range(b"\x00", b"\x03"))
    assert parse_items("504B01{43-65531}504B0506{18-65531}")[1] == (18, 65531)
    assert parse_items("(FF|10[!00:10])")[0][0][1] == Alt((Seq(b"\xff"), Cat((Seq(b"\x10"), Not(Range(b"\x00", b"\x10"))))))
    assert parse_items("[10 'cats']")[0][0][1] == Alt((Seq(b"\x10"), Seq(b"cats")))
    assert parse_items("[00:10]")[0][0][1] == Range(b"\x00", b"\x10")
    assert parse_items("'office:version=' [22 27] '1.0' [22 27]")[0][0][1] == Seq(b"office:version=")
    for good in ("1991[!4001C8]", "1991(!65|[!01:02])", "1991(6500|52[01:02])", "10 00 00 00 'Word.Document.' ['6'-'7'] 00", "AB*CD", "[&01]", "[~80]"):
        parse_items(good)
    for bad in ("1991y", "19?91", "19{ABCD}91", "19[01", "", "{4}"):
        with pytest.raises(NotationError):
            parse_items(bad)


def test_placement():
    s = signature_of([("Absolute from EOF", "0", "", "AE426082"), ("Absolute from BOF", "0", "0", "89504E47")])
    assert [f.orient for f in s.frames] == [BOF, EOF] and len(s.runs) == 2
    assert s.matches(bytes.fromhex("89504E4700AE426082")) and not s.matches(bytes.fromhex("0089504E47AE426082"))
    wild = signature_of([("Variable", "", "", "4142")])
    assert wild.matches(b"xxAB") and wild.phase() == 4
    assert signature_of([("Absolute from BOF", "2", "3", "41")]).matches(b"xxxxxA") and not signature_of([("Absolute from BOF", "2", "3", "41")]).matches(b"xxxxxxA")


def test_rewrites():
    s = Signature((Frame(T(b"ab"), BOF), Frame(T(b"cd"), PREV, 0, None)))
    assert s.mirrored().matches(b"abxxcd") and s.mirrored().frames[-1].orient == EOF
    assert Signature((Frame(T(b"ab"), BOF), Frame(T(b"yz"), EOF))).limited(no_eof=True).frames == (Frame(T(b"ab"), BOF),)
    assert Signature((Frame(T(b"ab"), BOF, 0, None),)).limited(bof=4).frames[0].high == 4
    assert Signature((Frame(T(b"abcd"), BOF),)).contains(Signature((Frame(T(b"bc"), BOF, 1, 1),)))
    assert not Signature((Frame(T(b"abcd"), BOF),)).contains(Signature((Frame(T(b"bc"), BOF),)))
