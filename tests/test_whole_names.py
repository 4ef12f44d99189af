"""The registry's names and types: every hit of every file, by brute force."""

from collections import defaultdict

import __spark_entry__ as entry
from sigloom.plans import identification


def test_every_extension_hit(spark, data, rows):
    ids = defaultdict(set)
    for r in rows("format_registry"):
        for e in r["exts"] or []:
            ids[e.strip().lower()].add((r["ns"], r["ident_id"]))
    want = set()
    for no, name in {(r["file_no"], r["filename"] or "") for r in rows("scan_files")}:
        base = name.replace("\\", "/").rstrip("/").split("/")[-1]
        ext = base.rpartition(".")[2].lower() if "." in base else ""
        want |= {(f"{no}/{name}", *i, f"extension match {ext}") for i in ids.get(ext, ()) if ext}
    got = [tuple(r) for r in entry.queries()["name_ext_match"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(got) > len({r[0] for r in got})  # formats that share an extension all hit


def test_every_type_hit(spark, data, rows):
    ids = defaultdict(set)
    for r in rows("format_registry"):
        if (r["mime_type"] or "").strip():
            ids[r["mime_type"].strip()].add((r["ns"], r["ident_id"]))
    want = set()
    for r in identification.named_files(spark, data, sorted(ids)).collect():
        for phase, m in enumerate([r.mime, r.mime.rpartition(";")[0]] if ";" in r.mime else [r.mime]):
            want |= {(r.path, *i, phase) for i in ids.get(m, ())}
    got = [tuple(r) for r in entry.queries()["mime_match"](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in got} == {f"{r['file_no']}/{r['filename'] or ''}" for r in rows("scan_files")}
    assert {r[3] for r in got} == {0, 1}
