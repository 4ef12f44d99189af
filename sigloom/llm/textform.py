"""One consistent form of text that looks the same, and the words of it."""

from __future__ import annotations

import re
import sys
import unicodedata

# Letters of other scripts drawn like a Latin letter, as pairs of that letter and the Latin one.
CYRILLIC = "ӀI АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԌG ԚQ ԜW ѴV аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv үy ӏl"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ͿJ οo ρp νv ϳj υu"
ARMENIAN = "ՍU ՏS ՕO ոn օo սu հh ցg զq"
CHEROKEE = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
COPTIC = "ⲀA ⲂB ⲌZ ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc"
LISU = "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ"
PHONETIC = "ɡg"
LOOKALIKES = {pair[0]: pair[1] for group in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, PHONETIC) for pair in group.split()}

#: Letters whose shape fits a second Latin letter too, as pairs of that letter and the second one.
SECOND = "Ӏl ІI Іl ӏI Ιl ꓲl Ⲓl υv"
SECONDS = {pair[0]: pair[1] for pair in SECOND.split() if pair[1] != LOOKALIKES.get(pair[0])}
#: Latin letters to the letters of other scripts drawn like them.
DRAWN_LIKE: dict[str, tuple[str, ...]] = {b: tuple(a for a, x in LOOKALIKES.items() if x == b) for b in set(LOOKALIKES.values())}

#: Format characters that are visible, so they stay.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Invisible characters without width that are not of the categories Cf and Cc.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)}
LINE_MARKS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))
        if cp in IGNORABLE or kind == "Cf" and cp not in VISIBLE_FORMAT or kind == "Cc" and cp not in LINE_MARKS:
            out[cp] = None
        elif kind == "Zs" and cp != 0x20:
            out[cp] = " "
    return out | {ord(a): b for a, b in LOOKALIKES.items()}


TABLE = _table()


def _class(codes) -> str:
    """A character class of code points, by runs."""
    codes, out, begin = sorted(codes), [], None
    for a, b in zip(codes, [*codes[1:], None]):
        begin = a if begin is None else begin
        if b != a + 1:
            out.append(re.escape(chr(begin)) + (f"-{re.escape(chr(a))}" if a > begin else ""))
            begin = None
    return "".join(out)


#: Runs of characters that the table changes: most texts have few, so only these are mapped.
CHANGED = re.compile(f"[{_class(TABLE)}]+")
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")


def mapped(text: str, table: dict = TABLE) -> str:
    """A text under the table."""
    return CHANGED.sub(lambda m: m.group().translate(table), text)


def table_form(text: str) -> str:
    """The consistent form by table: decompose, drop the ignorable, replace look-alikes, compose."""
    return unicodedata.normalize("NFKC", mapped(unicodedata.normalize("NFKD", text)))


#: The ignorable characters and special blanks alone: what a spelling loses that keeps its script.
SPECIAL = {cp: to for cp, to in TABLE.items() if chr(cp) not in LOOKALIKES}


def spelled(text: str) -> str:
    """Canonical and compatibility variants as one, ignorable characters gone, special blanks plain; letters keep their script."""
    return unicodedata.normalize("NFKC", mapped(unicodedata.normalize("NFKD", text), SPECIAL))


def letters_of(word: str) -> str:
    """A word as a sequence of decomposed letters."""
    return unicodedata.normalize("NFKD", word).translate(SPECIAL)


def readings(char: str) -> tuple[tuple[int, int, str], ...]:
    """The readings of one raw character, all at no cost: (1 for a second-best shape, letters of another script, letters).

    The character as itself, decomposed, or nothing if it is ignorable; a letter of another script also as the Latin
    letter it is drawn like; a Latin letter also as the letters of other scripts drawn like it.
    """
    own = letters_of(char)
    out = {(0, 0, own)}
    if len(own) >= 1:
        head, tail = own[0], own[1:]
        if head in LOOKALIKES:
            out.add((0, 1, LOOKALIKES[head] + tail))
        if head in SECONDS:
            out.add((1, 1, SECONDS[head] + tail))
        out.update((0, 1, d + tail) for d in DRAWN_LIKE.get(head, ()))
    return tuple(sorted(out))


def script(char: str) -> str:
    """The script of a letter, by the first word of its name; empty for what is no letter."""
    return unicodedata.name(char, "").partition(" ")[0] if unicodedata.category(char)[0] == "L" else ""


def own_script(word: str) -> bool:
    """Whether all letters of a word are of one script."""
    return len({s for c in word if (s := script(c))}) < 2


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits of the consistent form, without letter case; none for null."""
    if not text:
        return []
    if text.isascii():
        return ASCII_WORD.findall(mapped(text).lower())
    return WORD.findall(unicodedata.normalize("NFKC", table_form(text).casefold()))
