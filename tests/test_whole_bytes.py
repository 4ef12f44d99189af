"""The basis of every hit of the demo catalogue, and the placement of every byte sequence of the reports, by brute force."""

import hashlib
import re

import __spark_entry__ as entry
from sigloom.plans import identification
from sigloom.sources.expressions import signature_of


def test_basis_of_alternatives(spark, data):
    content = {r.path: bytes(r.content) for r in identification.doc_files(spark, data).collect()}
    sig = next(s for _, i, s, _ in identification.demo().signatures if i == "d/4")
    want = {}
    for path, c in content.items():
        if sig.matches(c):
            head = next(n for n in sig.frames[0].pattern.match(c, 0))
            least = min(at for at, _ in sig.frames[1].starts(c[head:]))
            want[path] = f"byte match at 0, {head + least + 1}"
    got = {r.path: r.basis for r in entry.queries()["byte_basis"](spark, data).where("id = 'd/4'").collect()}
    assert got == want and got


def test_byte_sequences_at_their_places(spark, data, rows):
    want = {}
    for r in rows("report_snapshots"):
        for b in (b for s in r["signatures"] or [] for b in (s or {}).get("byte_sequences") or [] if b):
            place = tuple((b[k] or "").strip(" ") for k in ("position_type", "min_offset", "max_offset", "hex_value"))
            if place[3]:
                s = signature_of([place])
                want[place] = (len(s.frames), sum(f.pattern.lengths()[0] for f in s.frames), True, hashlib.md5("\n".join(s.regexes()).encode()).hexdigest())
    got = {(r.position, r.low, r.high, r.value): (r.n_frames, r.least, r.sound, r.regexes) for r in entry.queries()["byte_notation"](spark, data).collect()}
    assert got == want
    assert {re.sub(".* ", "", p[0]).lower() for p in got} >= {"bof", "eof", "variable"}
