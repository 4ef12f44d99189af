"""Queries of the data-quality problems 1 to 7 over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.operators import drift, hierarchy, hotkeys, nested, orphans, rejects, snapshots
from sigloom.session import table as T


def p4_table(child: str):
    return lambda s, d: nested.report_table(T(s, d, "report_json"), child).drop("more")


def p6_heads(s, d):
    """The unified heads; lists as text, for comparison."""
    x = drift.unified_heads(T(s, d, "scan_heads"))
    return x.select(*(F.array_join(c, "," if c == "fields" else "|").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in x.dtypes))


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {
        "p1_found": lambda s, d: snapshots.report_changes(T(s, d, "report_snapshots")),
        "p1_intervals": lambda s, d: snapshots.report_intervals(T(s, d, "report_snapshots")),
        "p2_found": lambda s, d: rejects.rejected(T(s, d, "raw_results")),
        "p2_loaded": lambda s, d: rejects.loaded(T(s, d, "raw_results")),
        "p3_found": lambda s, d: hierarchy.report_hierarchy(T(s, d, "related_formats"), T(s, d, "report_snapshots")),
        "p3_descendants": lambda s, d: hierarchy.descendants(T(s, d, "related_formats"), T(s, d, "report_snapshots")),
        "p4_found": lambda s, d: nested.report_children(T(s, d, "report_json")),
        **{f"p4_{child.removesuffix('y') + 'ies' if child.endswith('y') else child + 's'}": p4_table(child) for child in nested.MEMBERS},
        "p4_links": lambda s, d: nested.table_links(T(s, d, "report_json")),
        "p5_found": lambda s, d: hotkeys.heavy_ids(T(s, d, "identifications"), T(s, d, "scan_files")),
        "p5_id_results": lambda s, d: hotkeys.id_results(T(s, d, "identifications"), T(s, d, "scan_files")).select("ident_id", "n_rows", "n_files", "n_listed", "listed_bytes", F.col("pair_rows").cast("bigint").alias("pair_rows"), F.col("pair_bytes").cast("string").alias("pair_bytes")),
        "p5_class_rollup": lambda s, d: hotkeys.class_rollup(T(s, d, "identifications"), T(s, d, "scan_files"), T(s, d, "format_registry")).withColumn("pair_rows", F.col("pair_rows").cast("bigint")),
        "p6_found": lambda s, d: drift.head_changes(T(s, d, "scan_heads")).select("scan_no", "item", "change_kind"),
        "p6_log": lambda s, d: drift.head_changes(T(s, d, "scan_heads")).orderBy("scan_no", "item", "change_kind"),
        "p6_union_schema": lambda s, d: drift.union_schema(T(s, d, "scan_heads")),
        "p6_heads": p6_heads,
        "p7_found": lambda s, d: orphans.orphan_references(T(s, d, "related_formats"), T(s, d, "report_snapshots")),
        "p7_tables": lambda s, d: orphans.domain_orphans(*(T(s, d, n) for n in ("related_formats", "report_snapshots", "scan_files", "scan_heads", "identifications", "format_registry"))),
        "p7_counts": lambda s, d: orphans.orphan_counts(T(s, d, "related_formats"), T(s, d, "report_snapshots")),
    }


_STATES = r"""
base AS (
  SELECT snap_no, report_id, loaded_at, trim(coalesce(report_version, '')) AS v,
    list_sort(list_transform(coalesce(signatures, []), lambda s: CAST(to_json(list_transform(coalesce(s.byte_sequences, []),
      lambda b: [trim(coalesce(b.position_type, '')), trim(coalesce(b.min_offset, '')), trim(coalesce(b.max_offset, '')), trim(coalesce(b.endianness, '')),
        upper(regexp_replace(coalesce(b.hex_value, ''), '\s', '', 'g'))])) AS VARCHAR))) AS sigs
  FROM report_snapshots WHERE report_id IS NOT NULL AND snap_no IS NOT NULL),
states AS (SELECT snap_no, report_id, v, sigs FROM base QUALIFY row_number() OVER (PARTITION BY snap_no, report_id ORDER BY loaded_at DESC NULLS LAST, v, sigs) = 1),
snaps AS (SELECT snap_no, row_number() OVER (ORDER BY snap_no) AS pos, lead(snap_no) OVER (ORDER BY snap_no) AS after_no FROM (SELECT DISTINCT snap_no FROM report_snapshots WHERE snap_no IS NOT NULL))
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_LINES = rf"""
lines AS (SELECT scan_no, line_no, regexp_replace(coalesce(raw_line, ''), '\r\z', '') AS line FROM raw_results),
wide AS (SELECT *, regexp_replace(line, '"[^"]*"', '', 'g') AS bare FROM lines),
heads AS (SELECT scan_no, max(length(bare) - length(replace(bare, ',', '')) + 1) AS width FROM wide WHERE line_no = 1 GROUP BY scan_no),
parsed AS (
  SELECT w.scan_no, w.line_no, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS sound,
    coalesce(length(bare) - length(replace(bare, ',', '')) + 1 = width, false) AS wide_ok,
    regexp_extract(line, '\A({_FIELD})', 1, 's') AS a, regexp_extract(line, '\A{_FIELD},({_FIELD})', 1, 's') AS b, regexp_extract(line, '\A{_FIELD},{_FIELD},({_FIELD})', 1, 's') AS c
  FROM wide w LEFT JOIN heads h ON w.scan_no = h.scan_no WHERE w.line_no IS DISTINCT FROM 1),
plain AS (
  SELECT scan_no, line_no, sound, wide_ok,
    CASE WHEN starts_with(a, '"') THEN replace(a[2:-2], '""', '"') ELSE a END AS path,
    CASE WHEN starts_with(b, '"') THEN replace(b[2:-2], '""', '"') ELSE b END AS size,
    CASE WHEN starts_with(c, '"') THEN replace(c[2:-2], '""', '"') ELSE c END AS mod
  FROM parsed),
judged AS (
  SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN NOT wide_ok THEN 'column_count'
    WHEN regexp_full_match(path, '\s*') THEN 'filename'
    WHEN NOT (size = '' OR size = '-1' OR (regexp_full_match(size, '[0-9]+') AND try_cast(size AS BIGINT) IS NOT NULL)) THEN 'filesize'
    WHEN NOT (mod = '' OR (regexp_full_match(mod, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)?')
      AND try_strptime(mod[1:19], '%Y-%m-%dT%H:%M:%S') IS NOT NULL AND mod[18:19] < '60' AND mod[12:13] < '24')) THEN 'modified' END AS reason
  FROM plain)
"""

_CHAINS = r"""
WITH RECURSIVE known AS (SELECT DISTINCT report_id FROM report_snapshots WHERE report_id IS NOT NULL),
said AS (SELECT regexp_replace(trim(lower(typ)), '\s+', ' ', 'g') AS typ, report_id, related_id FROM related_formats),
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT report_id AS child, related_id AS parent FROM said WHERE typ = 'is subtype of'
    UNION SELECT related_id, report_id FROM said WHERE typ = 'is supertype of')
  WHERE child IN (SELECT report_id FROM known) AND parent IN (SELECT report_id FROM known) GROUP BY child),
nodes AS (SELECT child AS id FROM links UNION SELECT parent FROM links),
up(id, cur, path) AS (
  SELECT id, id, [id] FROM nodes
  UNION ALL SELECT id, parent, list_prepend(parent, path) FROM up JOIN links ON child = cur WHERE NOT list_contains(path, parent)),
ends AS (SELECT up.*, l.parent FROM up LEFT JOIN links l ON l.child = up.cur WHERE l.parent IS NULL OR list_contains(path, l.parent))
"""

_JSON = r"""
good AS (SELECT rec_no, CAST(payload AS JSON) AS o FROM report_json WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
members AS (
  SELECT rec_no, 'signature' AS kind, json_extract(o, '$.Signatures') AS m FROM good
  UNION ALL SELECT rec_no, 'relation', json_extract(o, '$.Relations') FROM good
  UNION ALL SELECT rec_no, 'identifier', json_extract(o, '$.Identifiers') FROM good),
told AS (SELECT rec_no, kind, CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN CAST(m ->> '$' AS JSON) END ELSE m END AS m FROM members),
lists AS (SELECT rec_no, kind, CASE json_type(m) WHEN 'ARRAY' THEN json_extract(m, '$[*]') WHEN 'OBJECT' THEN [m] ELSE [] END AS l FROM told),
objects AS (SELECT rec_no, kind, list_filter(l, lambda x: json_type(x) = 'OBJECT') AS l FROM lists),
rows1 AS (SELECT rec_no, kind, unnest(l) AS x, unnest(range(len(l))) AS pos FROM objects),
inner1 AS (SELECT rec_no, pos, json_extract(x, '$.ByteSequences') AS m FROM rows1 WHERE kind = 'signature'),
inner2 AS (SELECT rec_no, pos, CASE WHEN json_type(m) = 'VARCHAR' THEN CASE WHEN json_valid(m ->> '$') THEN CAST(m ->> '$' AS JSON) END ELSE m END AS m FROM inner1),
inner3 AS (SELECT rec_no, pos, list_filter(CASE json_type(m) WHEN 'ARRAY' THEN json_extract(m, '$[*]') WHEN 'OBJECT' THEN [m] ELSE [] END, lambda x: json_type(x) = 'OBJECT') AS l FROM inner2),
rows2 AS (SELECT rec_no, pos, unnest(range(len(l))) AS sub_pos, unnest(l) AS x FROM inner3)
"""

_IDS = """
once AS (SELECT ident_no, lower(trim(min(ident_id))) AS ident_id, min(file_no) AS file_no FROM identifications WHERE ident_id IS NOT NULL GROUP BY ident_no),
seen AS (SELECT ident_id, count(*) AS n_rows, count(DISTINCT file_no) AS n_files FROM once GROUP BY ident_id),
pairs AS (SELECT file_no, lower(trim(i)) AS ident_id, max(greatest(filesize, 0)) AS filesize FROM (SELECT file_no, filesize, unnest(ids) AS i FROM scan_files) WHERE i IS NOT NULL GROUP BY 1, 2),
listed AS (SELECT ident_id, count(*) AS n_listed, coalesce(sum(filesize), 0) AS listed_bytes FROM pairs GROUP BY ident_id),
results AS (SELECT coalesce(s.ident_id, l.ident_id) AS ident_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_files, 0) AS n_files, coalesce(n_listed, 0) AS n_listed, coalesce(listed_bytes, 0)::HUGEINT AS listed_bytes
  FROM seen s FULL JOIN listed l ON s.ident_id = l.ident_id)
"""

_HEADS = r"""
once AS (SELECT scan_no, collection_code AS collection, scanned, CAST(head_json AS JSON) AS o FROM scan_heads QUALIFY row_number() OVER (PARTITION BY scan_no ORDER BY arrived_at DESC) = 1),
version AS (
  SELECT scan_no, 'version' AS item, m AS name, json_type(o, '$.' || m) AS typ FROM once, (SELECT unnest(['program', 'version', 'program_version']) AS m)
  WHERE coalesce(json_type(o, '$.' || m), 'NULL') != 'NULL'),
hashed AS (SELECT scan_no, 'hash' AS item, trim(o ->> '$.hash_header') AS name, 'VARCHAR' AS typ FROM once WHERE coalesce(trim(o ->> '$.hash_header'), '') != ''),
grouped AS (SELECT scan_no, json_extract(o, '$.fields[*]') AS gs, json_extract(o, '$.identifiers[*]') AS ns, json_type(o, '$.fields') AS t FROM once),
member AS (SELECT scan_no, 'fields' AS item, 'fields' AS name, array_to_string(list_sort(list_distinct(list_transform(gs, lambda g: json_type(g)))), '|') AS typ FROM grouped WHERE t = 'ARRAY'),
each1 AS (SELECT scan_no, unnest(gs) AS g, unnest(range(len(gs))) AS i, ns FROM grouped WHERE t = 'ARRAY'),
each2 AS (SELECT scan_no, trim(ns[i + 1] ->> '$[0]') AS space, CASE WHEN json_type(g) = 'ARRAY' THEN CAST(g AS VARCHAR[]) ELSE string_split(g ->> '$', ',') END AS names FROM each1),
each3 AS (SELECT scan_no, space, trim(unnest(names)) AS name FROM each2),
field AS (SELECT scan_no, space || '.' || CASE name WHEN 'ns' THEN 'namespace' WHEN 'identifier' THEN 'id' WHEN 'ID' THEN 'id' WHEN 'warn' THEN 'warning' ELSE name END AS item, name, 'VARCHAR' AS typ FROM each3 WHERE name != ''),
items AS (SELECT * FROM version UNION ALL SELECT * FROM hashed UNION ALL SELECT * FROM member UNION ALL SELECT * FROM field),
follows AS (SELECT scan_no, lag(scan_no) OVER (PARTITION BY collection ORDER BY scanned, scan_no) AS prev FROM once),
news AS (SELECT f.scan_no, i.item, i.name, i.typ FROM follows f JOIN items i ON i.scan_no = f.scan_no WHERE prev IS NOT NULL),
olds AS (SELECT f.scan_no, i.item, i.name, i.typ FROM follows f JOIN items i ON i.scan_no = f.prev),
compared AS (SELECT coalesce(n.scan_no, p.scan_no) AS scan_no, coalesce(n.item, p.item) AS item, n.name AS new_name, p.name AS old_name, n.typ AS new_type, p.typ AS old_type, n.item IS NULL AS gone, p.item IS NULL AS fresh
  FROM news n FULL JOIN olds p ON n.scan_no = p.scan_no AND n.item = p.item)
"""

_ORPHANS = """
held AS (SELECT DISTINCT report_id, snap_no FROM report_snapshots WHERE report_id IS NOT NULL AND snap_no IS NOT NULL),
refs AS (SELECT rel_no, min(snap_no) AS snap_no, min(related_id) AS related_id FROM related_formats WHERE related_id IS NOT NULL GROUP BY rel_no),
span AS (SELECT report_id, min(snap_no) AS lo, max(snap_no) AS hi FROM held GROUP BY report_id),
orphan AS (
  SELECT r.rel_no, r.snap_no, r.related_id, CASE WHEN s.lo < r.snap_no THEN 'deleted' WHEN s.hi > r.snap_no THEN 'late' ELSE 'missing' END AS orphan_kind
  FROM refs r LEFT JOIN held h ON h.report_id = r.related_id AND h.snap_no = r.snap_no LEFT JOIN span s ON s.report_id = r.related_id WHERE h.report_id IS NULL)
"""


def _typ(c: str) -> str:
    return f"CASE {c} WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'double' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'BOOLEAN' THEN 'bool' ELSE {c} END"


def oracle_sql():
    """The same results in DuckDB's SQL, written apart from the operators."""
    return {
        "p1_found": f"""WITH {_STATES},
            old AS (SELECT b.after_no AS snap_no, report_id, v, sigs FROM states s JOIN snaps b ON s.snap_no = b.snap_no WHERE b.after_no IS NOT NULL),
            new AS (SELECT s.* FROM states s JOIN snaps b ON s.snap_no = b.snap_no WHERE b.pos > 1)
            SELECT coalesce(n.snap_no, o.snap_no) AS snap_no, coalesce(n.report_id, o.report_id) AS report_id, CASE WHEN o.report_id IS NULL THEN 'added' WHEN n.report_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
            FROM new n FULL JOIN old o ON n.snap_no = o.snap_no AND n.report_id = o.report_id
            WHERE o.report_id IS NULL OR n.report_id IS NULL OR n.v != o.v OR n.sigs != o.sigs""",
        "p1_intervals": f"""WITH {_STATES},
            marked AS (SELECT report_id, pos, s.snap_no, after_no, CASE WHEN lag(pos) OVER w + 1 = pos AND lag(v) OVER w = v AND lag(sigs) OVER w = sigs THEN 0 ELSE 1 END AS starts
              FROM states s JOIN snaps b ON s.snap_no = b.snap_no WINDOW w AS (PARTITION BY report_id ORDER BY pos)),
            islands AS (SELECT *, sum(starts) OVER (PARTITION BY report_id ORDER BY pos) AS island FROM marked)
            SELECT report_id, min(snap_no) AS first_snap, bool_or(after_no IS NULL) AS still_valid, count(*) AS n_snaps FROM islands GROUP BY report_id, island""",
        "p2_found": f"WITH {_LINES} SELECT DISTINCT scan_no, line_no, reason FROM judged WHERE reason IS NOT NULL",
        "p2_loaded": rf"""WITH {_LINES}, good AS (SELECT DISTINCT scan_no, line_no, path, size, mod FROM judged WHERE reason IS NULL)
            SELECT scan_no, line_no, path, try_cast(nullif(size, '') AS BIGINT) AS size,
              strftime(try_strptime(mod[1:19], '%Y-%m-%dT%H:%M:%S') - to_minutes(CASE WHEN regexp_matches(mod, '[+-]\d\d:\d\d$') THEN (CASE WHEN mod[-6:-6] = '-' THEN -1 ELSE 1 END) * (CAST(mod[-5:-4] AS BIGINT) * 60 + CAST(mod[-2:] AS BIGINT)) ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS mod_utc
            FROM good""",
        "p3_found": f"""{_CHAINS} SELECT id AS report_id, CASE WHEN parent IS NULL THEN cur ELSE -1 END AS root_id, CAST(CASE WHEN parent IS NULL THEN len(path) - 1 ELSE -1 END AS INTEGER) AS node_depth,
            CASE WHEN parent IS NULL THEN array_to_string(path, '/') ELSE '' END AS node_path, CASE WHEN parent IS NULL THEN 'tree' WHEN parent = id THEN 'cycle' ELSE 'below_cycle' END AS node_state FROM ends""",
        "p3_descendants": f"""{_CHAINS} SELECT path[i] AS ancestor_id, id AS report_id, CAST(len(path) - i AS INTEGER) AS distance FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM ends WHERE parent IS NULL)""",
        "p4_found": f"""WITH {_JSON} SELECT DISTINCT rec_no, kind AS child_kind, CAST(pos AS INTEGER) AS pos, -1 AS sub_pos FROM rows1 UNION ALL SELECT DISTINCT rec_no, 'byte_sequence', CAST(pos AS INTEGER), CAST(sub_pos AS INTEGER) FROM rows2""",
        "p4_byte_sequences": f"""WITH {_JSON} SELECT DISTINCT rec_no, CAST(pos AS INTEGER) AS pos, CAST(sub_pos AS INTEGER) AS sub_pos, x ->> '$.Position' AS position, x ->> '$.Offset' AS offset, x ->> '$.MaxOffset' AS maxoffset,
            x ->> '$.Endianness' AS endianness, x ->> '$.Hex' AS hex, x ->> '$.IndirectLoc' AS indirectloc FROM rows2""",
        "p4_relations": f"WITH {_JSON} SELECT DISTINCT rec_no, CAST(pos AS INTEGER) AS pos, x ->> '$.Typ' AS typ, x ->> '$.Id' AS id FROM rows1 WHERE kind = 'relation'",
        "p4_identifiers": f"WITH {_JSON} SELECT DISTINCT rec_no, CAST(pos AS INTEGER) AS pos, x ->> '$.Typ' AS typ, x ->> '$.Id' AS id FROM rows1 WHERE kind = 'identifier'",
        "p4_reports": f"WITH {_JSON} SELECT DISTINCT rec_no, o ->> '$.Id' AS id, o ->> '$.Name' AS name, o ->> '$.Version' AS version, o ->> '$.Description' AS description FROM good",
        "p4_signatures": f"WITH {_JSON} SELECT DISTINCT rec_no, CAST(pos AS INTEGER) AS pos, x ->> '$.Note' AS note FROM rows1 WHERE kind = 'signature'",
        "p4_extensions": f"""WITH {_JSON}, e AS (SELECT rec_no, json_extract(o, '$.Extensions') AS m FROM good), l AS (SELECT rec_no, CASE json_type(m) WHEN 'ARRAY' THEN json_extract(m, '$[*]') WHEN 'VARCHAR' THEN [m] ELSE [] END AS l FROM e)
            SELECT DISTINCT rec_no, CAST(pos AS INTEGER) AS pos, x ->> '$' AS value FROM (SELECT rec_no, unnest(l) AS x, unnest(range(len(l))) AS pos FROM l) WHERE x ->> '$' IS NOT NULL""",
        "p4_links": f"""WITH {_JSON}, k AS (SELECT DISTINCT rec_no, kind, pos, -1 AS sub_pos FROM rows1 UNION SELECT rec_no, 'byte_sequence', pos, sub_pos FROM rows2
              UNION SELECT rec_no, 'extension', i, -1 FROM (SELECT rec_no, unnest(range(CAST(CASE json_type(m) WHEN 'ARRAY' THEN json_array_length(m) WHEN 'VARCHAR' THEN 1 ELSE 0 END AS BIGINT))) AS i FROM (SELECT rec_no, json_extract(o, '$.Extensions') AS m FROM good)))
            SELECT t.child_table, t.parent_table, count(k.rec_no) AS n_rows, count(DISTINCT CASE WHEN parent_table = 'signature' THEN k.rec_no || '/' || pos ELSE CAST(k.rec_no AS VARCHAR) END) AS n_parents, 0::BIGINT AS n_lost
            FROM (VALUES ('signature', 'report'), ('byte_sequence', 'signature'), ('relation', 'report'), ('identifier', 'report'), ('extension', 'report')) AS t(child_table, parent_table) LEFT JOIN k ON k.kind = t.child_table GROUP BY 1, 2""",
        "p5_found": f"WITH {_IDS} SELECT ident_id FROM seen WHERE n_rows * 100 >= 3 * (SELECT count(*) FROM once)",
        "p5_id_results": f"WITH {_IDS} SELECT ident_id, n_rows, n_files, n_listed, CAST(listed_bytes AS BIGINT) AS listed_bytes, CAST(n_rows * n_listed AS BIGINT) AS pair_rows, CAST(n_rows * listed_bytes AS VARCHAR) AS pair_bytes FROM results",
        "p5_class_rollup": f"""WITH {_IDS}, reg AS (SELECT lower(trim(ident_id)) AS ident_id, min(format_class) AS format_class FROM format_registry GROUP BY 1)
            SELECT coalesce(format_class, '(none)') AS format_class, count(*) AS n_ids, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_listed) AS BIGINT) AS n_listed, CAST(sum(n_rows * n_listed) AS BIGINT) AS pair_rows
            FROM results r LEFT JOIN reg USING (ident_id) GROUP BY 1""",
        "p6_found": f"""WITH {_HEADS} SELECT DISTINCT scan_no, item, kind AS change_kind FROM (
            SELECT scan_no, item, unnest([CASE WHEN fresh THEN 'added' END, CASE WHEN gone THEN 'removed' END, CASE WHEN NOT fresh AND NOT gone AND old_name != new_name THEN 'renamed' END,
              CASE WHEN NOT fresh AND NOT gone AND old_type IS DISTINCT FROM new_type THEN 'retyped' END]) AS kind FROM compared) WHERE kind IS NOT NULL""",
        "p6_log": f"""WITH {_HEADS}, x AS (SELECT scan_no, item, unnest([CASE WHEN fresh THEN 'added' END, CASE WHEN gone THEN 'removed' END, CASE WHEN NOT fresh AND NOT gone AND old_name != new_name THEN 'renamed' END,
              CASE WHEN NOT fresh AND NOT gone AND old_type IS DISTINCT FROM new_type THEN 'retyped' END]) AS change_kind, old_name, new_name, {_typ("old_type")} AS old_type, {_typ("new_type")} AS new_type FROM compared)
            SELECT *, CASE WHEN old_type IS NULL THEN new_type WHEN new_type IS NULL OR old_type = new_type THEN old_type WHEN old_type IN ('int', 'long', 'double') AND new_type IN ('int', 'long', 'double') THEN greatest(old_type, new_type) ELSE 'text' END AS union_type FROM x WHERE change_kind IS NOT NULL""",
        "p6_union_schema": f"""WITH {_HEADS}, more AS (SELECT scan_no, 'head.' || k AS item, k AS name, json_type(o, '$.' || k) AS typ FROM (SELECT scan_no, o, unnest(json_keys(o)) AS k FROM once WHERE json_type(o) = 'OBJECT')
              WHERE k NOT IN ('program', 'version', 'program_version', 'fields', 'hash_header') AND json_type(o, '$.' || k) != 'NULL')
            SELECT item, CASE WHEN count(DISTINCT typ) = 1 THEN {_typ("min(typ)")} ELSE 'text' END AS union_type, count(DISTINCT i.scan_no) AS n_scans, count(DISTINCT name) AS n_names, min(scanned) AS first_scanned, max(scanned) AS last_scanned
            FROM (SELECT * FROM items UNION ALL SELECT * FROM more) i JOIN once USING (scan_no) GROUP BY item""",
        "p6_heads": f"""WITH {_HEADS}, v AS (SELECT scan_no, CASE WHEN typ = 'ARRAY' THEN array_to_string(CAST(json_extract(o, '$.' || name) AS VARCHAR[]), '.') ELSE o ->> ('$.' || name) END AS version FROM version JOIN once USING (scan_no)),
            listed AS (SELECT scan_no, array_to_string(list(space || '.' || CASE name WHEN 'ns' THEN 'namespace' WHEN 'identifier' THEN 'id' WHEN 'ID' THEN 'id' WHEN 'warn' THEN 'warning' ELSE name END ORDER BY i, k), ',') AS fields
              FROM (SELECT scan_no, i, trim(ns[i + 1] ->> '$[0]') AS space, trim(unnest(names)) AS name, unnest(range(len(names))) AS k FROM (SELECT scan_no, i, ns, CASE WHEN json_type(g) = 'ARRAY' THEN CAST(g AS VARCHAR[]) ELSE string_split(g ->> '$', ',') END AS names FROM each1)) WHERE name != '' GROUP BY scan_no)
            SELECT o.scan_no, collection, scanned, v.version, lower(h.name) AS hash_column, coalesce(l.fields, '') AS fields,
              o.o ->> '$.signature' AS signature, o.o ->> '$.results' AS results, o.o ->> '$.scandate' AS scandate, o.o ->> '$.created' AS created, array_to_string(CAST(json_extract(o.o, '$.identifiers[*]') AS VARCHAR[]), '|') AS identifiers FROM once o LEFT JOIN v USING (scan_no) LEFT JOIN hashed h USING (scan_no) LEFT JOIN listed l USING (scan_no)""",
        "p7_found": f"WITH {_ORPHANS} SELECT rel_no, snap_no, orphan_kind FROM orphan",
        "p7_tables": r"""WITH refs AS (
              SELECT 'related_formats' AS child_table, 'report_snapshots' AS parent_table, rel_no AS r, CAST(related_id AS VARCHAR) AS key, snap_no AS period FROM related_formats
              UNION ALL SELECT 'scan_files', 'scan_heads', file_no, CAST(scan_no AS VARCHAR), year(loaded_at) * 100 + month(loaded_at) FROM scan_files
              UNION ALL SELECT 'identifications', 'scan_files', ident_no, CAST(file_no AS VARCHAR), year(loaded_at) * 100 + month(loaded_at) FROM identifications
              UNION ALL SELECT 'identifications', 'format_registry', ident_no, nullif(lower(trim(ident_id)), 'unknown'), year(loaded_at) * 100 + month(loaded_at) FROM identifications),
            once AS (SELECT child_table, parent_table, unnest(min({'period': period, 'key': key})) FROM refs WHERE key IS NOT NULL GROUP BY child_table, parent_table, r),
            held AS (SELECT DISTINCT 'report_snapshots' AS parent_table, CAST(report_id AS VARCHAR) AS key, snap_no AS period FROM report_snapshots WHERE report_id IS NOT NULL AND snap_no IS NOT NULL
              UNION SELECT 'scan_heads', CAST(scan_no AS VARCHAR), year(arrived_at) * 100 + month(arrived_at) FROM scan_heads WHERE scan_no IS NOT NULL AND arrived_at IS NOT NULL
              UNION SELECT 'scan_files', CAST(file_no AS VARCHAR), year(loaded_at) * 100 + month(loaded_at) FROM scan_files WHERE file_no IS NOT NULL AND loaded_at IS NOT NULL
              UNION SELECT 'format_registry', lower(trim(ident_id)), 0 FROM format_registry WHERE ident_id IS NOT NULL),
            span AS (SELECT parent_table, key, min(period) AS lo, max(period) AS hi FROM held GROUP BY 1, 2),
            judged AS (SELECT o.*, h.key IS NULL AND NOT (o.parent_table != 'report_snapshots' AND coalesce(lo < o.period, false)) AS lost, CASE WHEN lo < o.period THEN 'deleted' WHEN hi > o.period THEN 'late' ELSE 'missing' END AS orphan_kind
              FROM once o LEFT JOIN held h ON h.parent_table = o.parent_table AND h.key = o.key AND h.period = o.period LEFT JOIN span s ON s.parent_table = o.parent_table AND s.key = o.key)
            SELECT child_table, parent_table, CAST(period AS INTEGER) AS period, orphan_kind, count(*) AS n_refs, count(DISTINCT key) AS n_keys FROM judged WHERE lost GROUP BY 1, 2, 3, 4""",
        "p7_counts": f"WITH {_ORPHANS} SELECT 'report_snapshots' AS parent_table, snap_no, orphan_kind, count(*) AS n_refs, count(DISTINCT related_id) AS n_keys FROM orphan GROUP BY snap_no, orphan_kind",
    }
