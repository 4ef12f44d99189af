"""From hits to results: gating, scores, dominance, modes, weak evidence, warnings.

One shuffle, on the path: the hits are partitioned by path once, and the
aggregate per (path, ns, id) and the windows per (path, ns) keep to that
partitioning. Files without hits are there by their row of matcher FILE, so
the files are not read again. A window partition holds the hits of one file,
which is bounded by the catalogue, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.matchers import BYTE, CONTAINER, FILE, MAX_SIGNATURES, MIME, NAME, RIFF, TEXT, XML, relation
from sigloom.sources.catalog import Catalog

MODES = ("single", "conclusive", "positive", "comprehensive", "exhaustive", "droid")
# What each kind of evidence scores; the n-th strong hit scores n times STRONG.
EXTENSION, MIME_TYPE, TEXT_MATCH, STRONG = 1, 2, 4, 8
UNKNOWN = "UNKNOWN"
ORDER = ("matcher", "phase", "offset", "sig_no", "id")


def wording(parts: Column) -> Column:
    """a, b and c."""
    n = F.size(parts)
    return F.when(n < 2, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(parts, -1)))


def kinds(ext: Column, mime: Column, text: Column) -> Column:
    return F.array_compact(F.array(F.when(ext, "extension"), F.when(mime, "MIME"), F.when(text, "text")))


def tagged(pairs) -> list[str]:
    return sorted(f"{ns}\x1f{i}" for ns, i in pairs)


def is_one(values: list[str]) -> Column:
    """Whether (ns, id) is among tagged pairs."""
    return F.coalesce(F.concat("ns", F.lit("\x1f"), "id").isin(values), F.lit(False)) if values else F.lit(False)


def gated(hits: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Early stop: the hits a scan would still have looked for, in the order of the matchers.

    After strong hits of one matcher the later ones are not asked. The text matcher is asked only if there is nothing
    yet, or if the plain text format itself is a candidate by its name or type.
    """
    w = Window.partitionBy("path", "ns")
    m = F.col("matcher")
    first = F.min(F.when(m.isin(CONTAINER, XML, RIFF, BYTE), m)).over(w)
    plain = F.max(F.when(m.isin(NAME, MIME) & is_one(tagged({r[:2] for c in catalogs for r in c.texts})), 1)).over(w)
    weak = F.max(F.when(m.isin(NAME, MIME), 1)).over(w)
    x = hits.withColumn("_first", first).withColumn("_plain", plain).withColumn("_weak", weak)
    asked = F.col("_first").isNull() & (F.col("_weak").isNull() | F.col("_plain").isNotNull())
    return x.where(F.when(m == TEXT, asked).when(m.isin(CONTAINER, XML, RIFF, BYTE), m == F.col("_first")).otherwise(True)).drop("_first", "_plain", "_weak")


def dominated(hits: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Set dominance: leave out hits that have a superior among the hits of their file.

    The ids of a file are gathered by a window over its hits, so the matchers run once and nothing is shuffled again.
    """
    if not any(c.priorities for c in catalogs):
        return hits
    ids = F.collect_set("id").over(Window.partitionBy("path", "ns"))
    x = hits.join(superiors(hits, catalogs), ["ns", "id"], "left").withColumn("_ids", ids)
    return x.where(~F.coalesce(F.arrays_overlap("_sups", "_ids"), F.lit(False))).select(*hits.columns)


def superiors(hits: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """(ns, id, _sups): the superiors of each id, broadcast up to the bound of catalogue rows."""
    prio = relation(hits, [c.closed_priorities() for c in catalogs], "priorities")
    n = sum(len(c.priorities) for c in catalogs)
    out = prio.groupBy("ns", "id").agg(F.collect_set("superior").alias("_sups"))
    return F.broadcast(out) if n <= MAX_SIGNATURES else out


def waiting(hits: DataFrame, catalogs: list[Catalog]) -> DataFrame:
    """Ordered dominance: after a strong hit only its superiors may still report, in the order of the hits.

    A fold over the hits of a file; the state is the list of ids that are still waited for (null: nothing seen yet).
    Candidates by weak evidence (extension, MIME) may report unless the last reporter is a superior of theirs.
    """
    strong = F.col("matcher").isin(CONTAINER, RIFF, BYTE, XML)
    weak_ids = F.collect_set(F.when(F.col("matcher").isin(NAME, MIME), F.col("id"))).over(Window.partitionBy("path", "ns"))
    x = hits.withColumn("_weak", weak_ids).join(superiors(hits, catalogs), ["ns", "id"], "left")
    has = {c.ns for c in catalogs if c.priorities}
    entry = F.struct(*ORDER, "basis", *(c for c in hits.columns if c not in ("path", "ns", "basis", *ORDER)), F.coalesce("_sups", F.expr("cast(array() as array<string>)")).alias("sups"))
    g = x.where(strong).groupBy("path", "ns").agg(F.array_sort(F.collect_list(entry)).alias("hs"), F.first("_weak").alias("_weak"))
    kept = (
        "aggregate(hs, named_struct('wait', cast(null as array<string>), 'this', '', 'out', slice(hs, 1, 0)), (s, h) -> "
        "CASE WHEN s.wait IS NULL OR array_contains(s.wait, h.id) OR (array_contains(_weak, h.id) AND NOT array_contains(h.sups, s.this)) "
        "THEN named_struct('wait', h.sups, 'this', h.id, 'out', concat(s.out, array(h))) ELSE s END, s -> s.out)"
    )
    free = g.where(~F.col("ns").isin(*has) if has else F.lit(True)).select("path", "ns", "hs")
    bound = g.where(F.col("ns").isin(*has) if has else F.lit(False)).select("path", "ns", F.expr(kept).alias("hs"))
    out = free.unionByName(bound).select("path", "ns", F.explode("hs").alias("h")).select("path", "ns", "h.*").drop("sups")
    return hits.where(~strong).unionByName(out.select(*hits.columns))


def scored(hits: DataFrame) -> DataFrame:
    """path, ns, id, confidence, has_ext, has_mime, has_text, has_strong, basis: evidence added up per candidate."""
    return _scored(hits.where(F.col("matcher") != FILE))


def _scored(hits: DataFrame, *more: Column) -> DataFrame:
    strong = F.col("matcher").isin(CONTAINER, RIFF, BYTE, XML)
    w = Window.partitionBy("path", "ns", strong).orderBy(*ORDER)
    score = F.when(F.col("matcher") == NAME, EXTENSION).when(F.col("matcher") == MIME, MIME_TYPE).when(F.col("matcher") == TEXT, TEXT_MATCH).when(strong, STRONG * F.row_number().over(w))
    x = hits.withColumn("score", score)
    has = lambda m: F.bool_or(F.col("matcher") == m)
    return x.groupBy("path", "ns", "id").agg(
        F.sum("score").cast("int").alias("confidence"),
        has(NAME).alias("has_ext"),
        has(MIME).alias("has_mime"),
        has(TEXT).alias("has_text"),
        F.bool_or(strong).alias("has_strong"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "basis"))), lambda h: h["basis"]), "; ").alias("basis"),
        *more,
    )


def of_file() -> tuple[Column, Column]:
    """What else a file's row tells: its declared type and its error."""
    return F.max("mime").alias("mime"), F.max(F.when(F.col("matcher") == FILE, F.col("basis"))).alias("error")


#: Relations that hold the strong signatures an id is judged by: of registry-style namespaces, and of the library's.
REGISTRY, LIBRARY = ("signatures", "containers"), ("signatures", "fourccs")


def strong_relations(ns: str, own: dict | None) -> tuple:
    return (own or {"loc": LIBRARY}).get(ns, REGISTRY)


def resolve(hits: DataFrame, catalogs: list[Catalog], mode: str = "conclusive", dominance: str = "set", unruled: tuple = ("wikidata",), weak_relations: dict | None = None) -> DataFrame:
    """path, ns, rank, id, confidence, basis, warning, errors: the results of the registry-style namespaces.

    hits are those of ``all_hits``. The weak rule, which does not hold in the namespaces ``unruled``: on weak evidence
    alone an id is kept only if it is the single one that owns no strong signature, else the result is UNKNOWN with the
    possibilities. ``weak_relations`` tells per namespace which relations hold strong signatures.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    hits = hits.repartition("path")
    if mode not in ("comprehensive", "exhaustive"):
        free = [c.ns for c in catalogs if mode == "droid" and strong_relations(c.ns, weak_relations) == LIBRARY]
        hits = gated(hits.where(~F.col("ns").isin(free)), catalogs).unionByName(hits.where(F.col("ns").isin(free))) if free else gated(hits, catalogs)
    if mode in ("single", "conclusive", "positive"):
        hits = waiting(hits, catalogs) if dominance == "ordered" else dominated(hits, catalogs)
    w = Window.partitionBy("path", "ns")
    x = _scored(hits, *of_file())
    x = x.withColumn("mime", F.max("mime").over(w)).withColumn("errors", F.coalesce(F.max("error").over(w), F.lit(""))).drop("error")
    by = w.orderBy(F.desc_nulls_last("confidence"), "id")
    ruled = [c.ns for c in catalogs if c.ns not in unruled]
    plain = tagged({r[:2] for c in catalogs for r in c.texts})
    x = x.withColumn("top", F.max("confidence").over(w)).withColumn("rn", F.row_number().over(by))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rn", "id"))).over(w)), lambda i: i["id"])
    any_kind = kinds(F.bool_or("has_ext").over(w), F.bool_or("has_mime").over(w), F.bool_or("has_text").over(w))
    x = x.withColumn("all_ids", listed).withColumn("all_kinds", wording(any_kind))
    weak = (F.col("top") <= TEXT_MATCH) & F.col("ns").isin(ruled) if mode != "exhaustive" else F.lit(False)
    texted = F.col("ns").isin(sorted({c.ns for c in catalogs if c.texts}))
    owners = tagged({p for c in catalogs for p in c.owners(*strong_relations(c.ns, weak_relations))})
    fits = ((F.col("top") <= MIME_TYPE) | (F.col("confidence") == F.col("top"))) & ~(is_one(plain) & (F.col("top") < TEXT_MATCH) & texted) & ~is_one(owners)
    x = x.withColumn("weak", F.coalesce(weak, F.lit(False))).withColumn("fits", F.coalesce(fits, F.lit(False)) & F.col("id").isNotNull()).withColumn("n_fit", F.sum(F.col("fits").cast("int")).over(w))
    x = x.withColumn("n_top", F.sum((F.col("confidence") == F.col("top")).cast("int")).over(w))
    lost = F.col("weak") & (F.col("n_fit") != 1)
    tied = ~F.col("weak") & (F.lit(mode) == "single") & (F.col("n_top") > 1)
    cut = {
        "single": F.col("rn") == 1,
        "conclusive": F.col("confidence") == F.col("top"),
        "positive": (F.col("confidence") >= STRONG) | (F.col("rn") == 1),
        "comprehensive": (F.col("confidence") >= STRONG) | (F.col("rn") == 1),
        "exhaustive": F.lit(True),
        "droid": (F.col("confidence") >= STRONG) | (F.col("rn") == 1),
    }[mode]
    keep = F.when(F.col("top").isNull(), True).when(F.col("id").isNull(), False).when(lost | tied, F.col("rn") == 1).when(F.col("weak"), F.col("fits")).otherwise(cut)
    tops = F.slice("all_ids", F.lit(1), F.col("n_top").cast("int"))
    note = F.when(lost, F.concat(F.lit("no match; possibilities based on "), F.col("all_kinds"), F.lit(" are "), F.array_join("all_ids", ", "))).when(tied, F.concat(F.lit("multiple matches "), F.array_join(tops, ", ")))
    x = x.withColumn("note", note).where(keep)
    if mode == "droid":
        x = dominated(x, catalogs)
    known = F.col("id").isNotNull() & F.col("note").isNull()
    only = F.when(F.col("confidence") <= TEXT_MATCH, F.concat(F.lit("match on "), wording(kinds(F.col("has_ext"), F.col("has_mime"), F.col("has_text"))), F.lit(" only")))
    owns = lambda n: is_one(tagged({p for c in catalogs for p in c.owners(n)}))
    ext = F.when(~F.col("has_ext") & owns("globs"), F.lit("extension mismatch"))
    mime = F.when(~F.col("has_mime") & (F.coalesce("mime", F.lit("")) != "") & owns("mimes"), F.lit("MIME mismatch"))
    warning = F.when(known, F.concat_ws("; ", only, ext, mime)).otherwise(F.coalesce("note", F.lit("no match")))
    return x.select(
        "path",
        "ns",
        F.row_number().over(w.orderBy("rn")).cast("int").alias("rank"),
        F.when(known, F.col("id")).otherwise(UNKNOWN).alias("id"),
        F.when(known, F.col("confidence")).otherwise(0).alias("confidence"),
        F.when(known, F.col("basis")).otherwise("").alias("basis"),
        warning.alias("warning"),
        "errors",
    )


def resolve_mime(hits: DataFrame, catalogs: list[Catalog], mode: str = "conclusive") -> DataFrame:
    """path, ns, rank, id, basis, warning, errors for MIME-info namespaces; hits are those of ``all_hits``.

    The order of candidates is one lexicographic key: XML match, several kinds of evidence, magic weight, declared MIME
    type, glob weight, text, default text. Once a candidate leads by XML or, but for plain text, by magic, the matchers
    that follow are not asked.
    """
    hits = hits.repartition("path")
    globs = relation(hits, catalogs, "globs").groupBy("ns", "id").agg(F.max("weight").alias("glob_w"))
    weights = [(r[0], r[1], r[2], r[9]) for c in catalogs for r in c.compiled()]
    magic = hits.sparkSession.createDataFrame(weights, "ns string, id string, sig_no int, magic_w int")
    magic = F.broadcast(magic) if len(weights) <= MAX_SIGNATURES else magic
    default = tagged({r[:2] for c in catalogs for r in c.texts if r[2]})
    x = hits.join(globs, ["ns", "id"], "left").join(magic, ["ns", "id", "sig_no"], "left")
    m = F.col("matcher")
    magic_of = F.max(F.when(m == BYTE, F.coalesce("magic_w", F.lit(50))))
    glob_of = F.max(F.when(m == NAME, F.coalesce("glob_w", F.lit(50))))
    w = Window.partitionBy("path", "ns")
    if mode not in ("comprehensive", "exhaustive", "droid"):
        each = Window.partitionBy("path", "ns", "id")
        zero = lambda c: F.coalesce(c.over(each), F.lit(0))
        x = x.withColumn("_m", zero(magic_of)).withColumn("_g", zero(glob_of)).withColumn("_d", zero(F.max((m == MIME).cast("int"))))
        lead = F.struct(((F.col("_m") > 0) & ((F.col("_g") > 0) | (F.col("_d") > 0))).alias("a"), F.col("_m").alias("b"))
        x = x.withColumn("_xml", F.max((m == XML).cast("int")).over(w) == 1).withColumn("_head", F.max_by("id", lead).over(w)).withColumn("_magic", F.max("_m").over(w) > 0)
        later = F.when(F.col("_xml"), m.isin(BYTE, TEXT)).otherwise((m == TEXT) & F.col("_magic") & (F.col("_head") != "text/plain"))
        x = x.where(~F.coalesce(later, F.lit(False)))
    s = x.groupBy("path", "ns", "id").agg(
        F.bool_or(m == XML).alias("xml"), F.bool_or(m == MIME).alias("mime_"), F.bool_or(m == TEXT).alias("text"), F.coalesce(magic_of, F.lit(0)).alias("magic"), F.coalesce(glob_of, F.lit(0)).alias("glob"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "basis"))), lambda h: h["basis"]), "; ").alias("basis"), *of_file(),
    )
    s = s.withColumn("mime", F.max("mime").over(w)).withColumn("errors", F.coalesce(F.max("error").over(w), F.lit(""))).drop("error")
    several = (F.col("mime_") & (F.col("magic") > 0)) | ((F.col("magic") > 0) & (F.col("glob") > 0)) | (F.col("mime_") & F.col("text")) | (F.col("text") & (F.col("glob") > 0))
    key = F.struct(F.col("xml").cast("int").alias("a"), F.when(F.col("xml"), 0).otherwise(several.cast("int")).alias("b"), F.when(F.col("xml"), 0).otherwise(F.col("magic")).alias("c"), F.col("mime_").cast("int").alias("d"), F.col("glob").alias("e"), F.col("text").cast("int").alias("f"), (F.col("text") & is_one(default)).cast("int").alias("g"))
    s = s.withColumn("key", F.when(F.col("id").isNotNull(), key)).withColumn("rn", F.row_number().over(w.orderBy(F.desc_nulls_last("key"), "id"))).withColumn("best", F.max("key").over(w))
    s = s.withColumn("second", F.max(F.when(F.col("rn") == 2, F.col("key"))).over(w)).withColumn("ids", F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("rn", "id"))).over(w)), lambda i: i["id"]))
    weak = ~(F.col("best.a") == 1) & (F.col("best.c") == 0)
    bare = F.col("id").isin("text/plain") & ~F.col("text") & F.col("ns").isin(*({c.ns for c in catalogs if c.texts} or {""}))
    beats = F.col("second").isNull() | (F.col("best") > F.col("second"))
    s = s.withColumn("weak", weak).withColumn("lost", F.max(F.when(F.col("rn") == 1, (weak & (~beats | bare)).cast("int"))).over(w) == 1)
    tied = (F.lit(mode) == "single") & ~F.col("lost") & ~beats
    strong = (F.col("key.a") == 1) | (F.col("key.c") > 0)
    cut = {"single": F.col("rn") == 1, "conclusive": F.col("key") == F.col("best"), "exhaustive": F.lit(True)}.get(mode, strong | (F.col("rn") == 1))
    note = F.when(F.col("lost"), F.concat(F.lit("no match; possibilities are "), F.array_join("ids", ", "))).when(tied, F.concat(F.lit("multiple matches "), F.array_join("ids", ", ")))
    s = s.withColumn("note", note).where(F.when(F.col("best").isNull(), True).when(F.col("id").isNull(), False).when(F.col("note").isNotNull() | F.col("weak"), F.col("rn") == 1).otherwise(cut))
    known = F.col("id").isNotNull() & F.col("note").isNull()
    owns = lambda *r: is_one(tagged({p for c in catalogs for p in c.owners(*r)}))
    words = wording(F.array_compact(F.array(F.when(F.col("glob") > 0, "filename"), F.when(F.col("mime_"), "MIME"), F.when(F.col("text"), "text"))))
    only = F.when(~strong, F.concat(F.lit("match on "), words, F.lit(" only"), F.when(owns("signatures", "xmls"), "; byte/xml signatures for this format did not match").otherwise("")))
    name = F.when((F.col("glob") == 0) & owns("globs"), "filename mismatch")
    mime = F.when(~F.col("mime_") & (F.coalesce("mime", F.lit("")) != ""), "MIME mismatch")
    return s.select(
        "path", "ns", F.row_number().over(w.orderBy("rn")).cast("int").alias("rank"),
        F.when(known, F.col("id")).otherwise(UNKNOWN).alias("id"), F.when(known, F.col("basis")).otherwise("").alias("basis"),
        F.when(known, F.concat_ws("; ", only, name, mime)).otherwise(F.coalesce("note", F.lit("no match"))).alias("warning"), "errors",
    )
