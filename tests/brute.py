"""Plain-Python versions of the problems' results, written apart from the operators."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import defaultdict


def p1(rows):
    """rows: dicts of report_snapshots -> {(snap_no, report_id, change_kind)}."""
    t = lambda s: (s or "").strip()
    best = {}
    for r in rows:
        if r["report_id"] is None or r["snap_no"] is None:
            continue
        sigs = []
        for s in r["signatures"] or []:
            seq = [(t(b["position_type"]), t(b["min_offset"]), t(b["max_offset"]), t(b["endianness"]), "".join((b["hex_value"] or "").split()).upper()) for b in (s or {}).get("byte_sequences") or []]
            sigs.append(tuple(seq))
        k = (r["snap_no"], r["report_id"])
        if k not in best or r["loaded_at"] > best[k][0]:
            best[k] = (r["loaded_at"], (t(r["report_version"]), tuple(sorted(sigs))))
    snaps = sorted({r["snap_no"] for r in rows if r["snap_no"] is not None})
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        old = {k[1]: v[1] for k, v in best.items() if k[0] == a}
        new = {k[1]: v[1] for k, v in best.items() if k[0] == b}
        out |= {(b, k, "removed") for k in old.keys() - new.keys()} | {(b, k, "added") for k in new.keys() - old.keys()} | {(b, k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    return out


def csv_fields(line):
    """The fields of a CSV record, or None if its quoting is broken."""
    out, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i += 1
            buf = []
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        buf.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                buf.append(line[i])
                i += 1
            if i < len(line) and line[i] != ",":
                return None
            out.append("".join(buf))
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= len(line):
            return out
        i += 1


def p2_reason(line, width):
    line = line[:-1] if line.endswith("\r") else line
    f = csv_fields(line)
    if f is None:
        return "quoting"
    if len(f) != width:
        return "column_count"
    if not f[0].strip():
        return "filename"
    if not (f[1] in ("", "-1") or re.fullmatch("[0-9]+", f[1]) and int(f[1]) < 2**63):
        return "filesize"
    if f[2]:
        m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?", f[2])
        try:
            dt.datetime.strptime(m.group(1), "%Y-%m-%dT%H:%M:%S")
            if m.group(2) and m.group(2) != "Z":
                assert int(m.group(2)[1:3]) < 24 and int(m.group(2)[4:]) < 60
        except (AttributeError, ValueError, AssertionError):
            return "modified"
    return None


def p2(rows):
    width = {r["scan_no"]: len(csv_fields(r["raw_line"].rstrip("\r"))) for r in rows if r["line_no"] == 1}
    return {(r["scan_no"], r["line_no"], why) for r in rows if r["line_no"] != 1 and (why := p2_reason(r["raw_line"], width.get(r["scan_no"])))}


def p3(links):
    """links: {(child, parent)} with one parent per child -> {(id, root, depth, path, state)}."""
    parent = dict(links)
    out = set()
    for x in {n for link in links for n in link}:
        chain, seen = [x], {x}
        while chain[-1] in parent and parent[chain[-1]] not in seen:
            chain.append(parent[chain[-1]])
            seen.add(chain[-1])
        if chain[-1] not in parent:
            out.add((x, chain[-1], len(chain) - 1, "/".join(map(str, reversed(chain))), "tree"))
        else:
            out.add((x, -1, -1, "", "cycle" if parent[chain[-1]] == x else "below_cycle"))
    return out


def p3_links(related, reports):
    known = {r["report_id"] for r in reports} - {None}
    out = set()
    for r in related:
        typ = " ".join((r["typ"] or "").lower().split())
        a, b = r["report_id"], r["related_id"]
        if a in known and b in known:
            if typ == "is subtype of":
                out.add((a, b))
            elif typ == "is supertype of":
                out.add((b, a))
    return out


def _listed(v):
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            return []
    if isinstance(v, dict):
        return [v]
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def p4(rows):
    def bad(x):
        raise ValueError(x)

    out = set()
    for r in rows:
        try:
            o = json.loads(r["payload"], parse_constant=bad)
        except (ValueError, TypeError):
            continue
        if not isinstance(o, dict):
            continue
        for i, s in enumerate(_listed(o.get("Signatures"))):
            out.add((r["rec_no"], "signature", i, -1))
            out |= {(r["rec_no"], "byte_sequence", i, j) for j, _ in enumerate(_listed(s.get("ByteSequences")))}
        for name, kind in (("Relations", "relation"), ("Identifiers", "identifier")):
            out |= {(r["rec_no"], kind, i, -1) for i, _ in enumerate(_listed(o.get(name)))}
    return out


def p5(rows):
    ids = {r["ident_no"]: r["ident_id"].strip().lower() for r in rows if r["ident_id"] is not None}
    n = defaultdict(int)
    for v in ids.values():
        n[v] += 1
    return {(k,) for k, v in n.items() if v * 100 >= 3 * len(ids)}


def p6(rows):
    alias = {"ns": "namespace", "identifier": "id", "ID": "id", "warn": "warning"}
    heads = {r["scan_no"]: r for r in rows}
    by = defaultdict(list)
    for r in heads.values():
        by[r["collection_code"]].append(r)
    out = set()
    for scans in by.values():
        before = None
        for r in sorted(scans, key=lambda r: (r["scanned"], r["scan_no"])):
            o, now = json.loads(r["head_json"]), {}
            for m in ("program", "version", "program_version"):
                if o.get(m) is not None:
                    now["version"] = (m, type(o[m]).__name__)
            if o.get("hash_header"):
                now["hash"] = (o["hash_header"], "")
            if o.get("fields") is not None:
                now["fields"] = ("fields", type(o["fields"][0]).__name__)
                for (ns, _), names in zip(o["identifiers"], o["fields"]):
                    for f in names if isinstance(names, list) else names.split(","):
                        now[f"{ns}.{alias.get(f, f)}"] = (f, "")
            if before is not None:
                out |= {(r["scan_no"], k, "added") for k in now.keys() - before.keys()} | {(r["scan_no"], k, "removed") for k in before.keys() - now.keys()}
                for k in now.keys() & before.keys():
                    out |= {(r["scan_no"], k, "renamed")} if now[k][0] != before[k][0] else set()
                    out |= {(r["scan_no"], k, "retyped")} if now[k][1] != before[k][1] else set()
            before = now
    return out


def p7(related, reports):
    held = defaultdict(set)
    for r in reports:
        if r["report_id"] is not None and r["snap_no"] is not None:
            held[r["report_id"]].add(r["snap_no"])
    out = set()
    for r in related:
        at = held.get(r["related_id"], set())
        if r["related_id"] is not None and r["snap_no"] not in at:
            out.add((r["rel_no"], r["snap_no"], "deleted" if any(s < r["snap_no"] for s in at) else "late" if at else "missing"))
    return out
