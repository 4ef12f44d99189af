"""DROID fragments are matched whole."""

import xml.etree.ElementTree as ET

from sigloom.functions.frames import Signature
from sigloom.sources import registry


def matches(reference: str, fragments: str, data: bytes) -> bool:
    seq = f'<ByteSequence Reference="{reference}"><SubSequence Position="1" SubSeqMinOffset="0" SubSeqMaxOffset="0"><Sequence>4D4D</Sequence>{fragments}</SubSequence></ByteSequence>'
    return Signature(tuple(registry.droid_frames(ET.fromstring(seq)))).matches(data)


def fragment(side: str, text: str, position: int = 1) -> str:
    return f'<{side}Fragment Position="{position}" MinOffset="1" MaxOffset="1">{text}</{side}Fragment>'


def test_fragments_of_several_items():
    right = fragment("Right", "41[42:43]44") + fragment("Right", "0D0A{2}25", 2)
    assert matches("BOFoffset", right, b"MM.ACD.\r\n..%") and matches("BOFoffset", right, b"MM.ABD.\r\n..%")
    assert not matches("BOFoffset", right, b"MM.AAD.\r\n..%") and not matches("BOFoffset", right, b"MM.ACD.\r\n.%")
    assert matches("EOFoffset", right, b"..MM.ACD.\r\n..%") and not matches("EOFoffset", right, b"..MM.ACD.\r\n..&")
    left = fragment("Left", "41[42:43]44") + fragment("Left", "25{1}26", 2)
    assert matches("BOFoffset", left, b"%.&.ABD.MM") and not matches("BOFoffset", left, b"%.'.ABD.MM") and not matches("BOFoffset", left, b"%.&.AAD.MM")
    assert matches("EOFoffset", left, b"x%.&.ACD.MM") and not matches("EOFoffset", left, b"x%.&.ACE.MM")


def test_choice_of_fragments_of_several_items():
    either = fragment("Right", "41[42:43]44") + fragment("Right", "58")
    assert matches("BOFoffset", either, b"MM.ACD") and matches("BOFoffset", either, b"MM.X")
    assert not matches("BOFoffset", either, b"MM.AED") and not matches("BOFoffset", either, b"MM.ACE")
