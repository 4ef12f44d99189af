"""The catalogue: signature relations of one or more namespaces, and what can be done with them.

A catalogue is built on the driver from vocabularies of a few thousand entries
and held as plain rows; ``frames`` turns it into DataFrames that are broadcast
behind a check of their size. It is saved as one parquet table per relation.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from sigloom.functions.frames import Signature
from sigloom.functions.patterns import Seq

#: relation -> columns of its rows after (ns, id)
RELATIONS = {
    "infos": "name string, version string, mime string, class string",
    "globs": "kind string, pattern string, glob_ord int, weight int",
    "mimes": "mime string",
    "xmls": "root string, xmlns string",
    "fourccs": "fourcc string",
    "texts": "is_default boolean",
    "byte_sigs": "sig_no int, sig_total int, regexes array<string>, phase int, side string, lit_off int, lits array<binary>, weight int, searches array<struct<regex: string, low: int, high: int, bound: int, from_end: boolean>>",
    "containers": "ctype string, sig_no int, sig_total int, n_parts int",
    "parts": "ctype string, sig_no int, part_no int, entry string, is_glob boolean, regexes array<string>",
    "priorities": "superior string",
}


@dataclass
class Catalog:
    """Rows per relation, each starting (ns, id). ``signatures`` keeps the byte signatures before compilation: (ns, id, Signature, weight)."""

    ns: str
    details: str = ""
    multi: str = "conclusive"
    zip_default: str | None = None
    infos: list = field(default_factory=list)
    globs: list = field(default_factory=list)
    mimes: list = field(default_factory=list)
    xmls: list = field(default_factory=list)
    fourccs: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    signatures: list = field(default_factory=list)
    containers: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    priorities: list = field(default_factory=list)
    #: (ns, id, text): what a build had to leave out
    notes: list = field(default_factory=list)
    #: byte_sigs rows of a catalogue that was saved: compiled, so they match, but can be rewritten no more
    stored: list = field(default_factory=list)

    # -- composition -------------------------------------------------------------------------------------------------
    def ids(self) -> set:
        """(ns, id) of everything the catalogue knows."""
        return {r[:2] for rel in (self.infos, self.globs, self.mimes, self.xmls, self.fourccs, self.texts, self.signatures, self.containers, self.stored) for r in rel}

    def join(self, other: "Catalog") -> "Catalog":
        """Union: the other's infos override, everything else is merged without repeats."""
        infos = {r[:2]: r for r in self.infos} | {r[:2]: r for r in other.infos}
        merged = {n: list(dict.fromkeys([*getattr(self, n), *getattr(other, n)])) for n in ("globs", "mimes", "xmls", "fourccs", "texts", "signatures", "containers", "parts", "priorities")}
        return replace(self, infos=list(infos.values()), stored=self.stored + [r for r in other.stored if r not in self.stored], **merged)

    def _where(self, keep) -> "Catalog":
        rels = ("infos", "globs", "mimes", "xmls", "fourccs", "texts", "signatures", "containers", "parts", "stored")
        return replace(self, **{n: [r for r in getattr(self, n) if keep(r[1])] for n in rels}, priorities=[r for r in self.priorities if keep(r[1]) and keep(r[2])])

    def limit(self, ids) -> "Catalog":
        ids = set(ids)
        return self._where(lambda i: i in ids)

    def exclude(self, ids) -> "Catalog":
        ids = set(ids)
        return self._where(lambda i: i not in ids)

    def without(self, *relations: str) -> "Catalog":
        """Blank relations: name, mime, xml, byte, container, riff, text, priority."""
        names = {"name": ["globs"], "mime": ["mimes"], "xml": ["xmls"], "byte": ["signatures", "stored"], "container": ["containers", "parts"], "riff": ["fourccs"], "text": ["texts"], "priority": ["priorities"]}
        return replace(self, **{n: [] for r in relations for n in names[r]})

    def no_doubles(self) -> "Catalog":
        """Drop byte signatures of the ids that own container signatures."""
        held = {r[:2] for r in self.containers}
        return replace(self, signatures=[r for r in self.signatures if r[:2] not in held], stored=[r for r in self.stored if r[:2] not in held])

    def with_mirrors(self) -> "Catalog":
        """Add the signatures whose wild tail is sought from the end."""
        return replace(self, signatures=self.signatures + [(ns, i, m, w) for ns, i, s, w in self.signatures if (m := s.mirrored())])

    def scan_limits(self, bof: int | None = None, eof: int | None = None, no_eof: bool = False) -> "Catalog":
        return replace(self, signatures=[(ns, i, s.limited(bof, eof, no_eof), w) for ns, i, s, w in self.signatures])

    def closed_priorities(self) -> "Catalog":
        """All superiors of superiors; loops are cut, nothing is its own superior."""
        direct: dict = {}
        for ns, sub, sup in self.priorities:
            if sub and sup and sub != sup:
                direct.setdefault((ns, sub), set()).add(sup)
        out = []
        for (ns, sub), first in direct.items():
            seen, todo = set(), list(first)
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo.extend(direct.get((ns, x), ()))
            out += [(ns, sub, s) for s in sorted(seen - {sub})]
        return replace(self, priorities=out)

    def implicit_priorities(self) -> list[tuple]:
        """(ns, id, superior) where a signature of id lies inside one of superior.

        A signature that lies inside another has its longest literal inside one of the other's, so only the pairs that an
        automaton over these literals finds are compared.
        """
        from sigloom.operators.matchers import Keys

        literals = [[f.pattern.data.decode("latin-1") for f in s.frames if isinstance(f.pattern, Seq)] for _, _, s, _ in self.signatures]
        by: dict[str, list[int]] = {}
        for n, own in enumerate(literals):
            if own:
                by.setdefault(max(own, key=len), []).append(n)
        keys, out = Keys(by), set()
        for n, own in enumerate(literals):
            outer = self.signatures[n]
            for m in {m for text in own for key in keys.held(text) for m in by[key]}:
                inner = self.signatures[m]
                if inner[0] == outer[0] and inner[1] != outer[1] and outer[2].contains(inner[2]) and not inner[2].contains(outer[2]):
                    out.add((inner[0], inner[1], outer[1]))
        return sorted(out)

    def missing_priorities(self) -> list[tuple]:
        known = set(self.closed_priorities().priorities)
        return [p for p in self.implicit_priorities() if p not in known]

    def compiled(self) -> list[tuple]:
        """byte_sigs rows; signatures of one id are numbered in their order, so runs of an id are contiguous."""
        total, seen, out = Counter(r[:2] for r in self.signatures), Counter(), []
        for ns, i, s, weight in sorted(self.signatures, key=lambda r: r[:2]):
            seen[ns, i] += 1
            side, off, lits = s.literal() or ("none", 0, [])
            out.append((ns, i, seen[ns, i], total[ns, i], s.regexes(), s.phase(), side, off, [bytearray(x) for x in lits], weight, s.searches()))
        return out + self.stored

    # -- inspection --------------------------------------------------------------------------------------------------
    def inspect(self, ident: str) -> dict:
        """Everything the catalogue holds on one id."""
        pick = lambda rel: [r[2:] for r in rel if r[1] == ident]
        return {n: pick(getattr(self, n)) for n in ("infos", "globs", "mimes", "xmls", "fourccs", "texts", "containers", "parts", "priorities")} | {"byte_sigs": [s.regexes() for _, i, s, _ in self.signatures if i == ident]}

    def recognise(self, relation: str, index: int) -> str:
        """What row number ``index`` of a relation stands for, as ``ns: id (signature n/m)``; ``not recognised`` beyond its end."""
        rows = self.rows(relation)
        if not 0 <= index < len(rows):
            return "not recognised"
        r = rows[index]
        return f"{r[0]}: {r[1]}" + (f" (signature {r[2]}/{r[3]})" if relation == "byte_sigs" else "")

    def blame(self, text: bytes) -> list[str]:
        """Which byte signatures are candidates for a content by their keys, and which of them match: the way to find what costs or misleads."""
        from sigloom.operators.matchers import ByteMatcher

        m = ByteMatcher(self.compiled())
        hit = {h[:3] for h in m.hits(text)}
        return [self.recognise("byte_sigs", n) + (" matches" if tuple(m.sigs[n][:3]) in hit else " is a candidate") for n in sorted(m.candidates(text.decode("latin-1")))]

    def priority_graph(self) -> str:
        """The priorities in the notation of graph drawing tools."""
        return "digraph {\n" + "".join(f'  "{sub}" -> "{sup}"\n' for _, sub, sup in sorted(self.priorities)) + "}\n"

    # -- tables ------------------------------------------------------------------------------------------------------
    def owners(self, *relations: str) -> set:
        """(ns, id) of the formats that have rows in any of the relations; ``signatures`` stands for compiled ones too."""
        return {tuple(r[:2]) for n in relations for r in (*getattr(self, n), *(self.stored if n == "signatures" else ()))}

    def rows(self, relation: str) -> list:
        return self.compiled() if relation == "byte_sigs" else getattr(self, relation)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {n: spark.createDataFrame(self.rows(n), f"ns string, id string, {cols}") for n, cols in RELATIONS.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        for n, df in self.frames(spark).items():
            df.write.mode("overwrite").parquet(f"{path}/{n}")
        spark.createDataFrame([(self.ns, self.details, self.multi, self.zip_default)], "ns string, details string, multi string, zip_default string").write.mode("overwrite").parquet(f"{path}/identifiers")


#: Rows of one relation that are taken back to the driver at most.
MAX_ROWS = 2_000_000


def load(spark: SparkSession, path: str) -> Catalog:
    """A saved catalogue, ready to identify with. Its byte signatures are compiled: what rewrites them needs the vocabulary again."""
    plain = lambda x: [plain(v) for v in x] if isinstance(x, list) else tuple(map(plain, x)) if isinstance(x, tuple) else x
    head = spark.read.parquet(f"{path}/identifiers").first()
    held = {}
    for n in RELATIONS:
        rows = spark.read.parquet(f"{path}/{n}").limit(MAX_ROWS + 1).collect()
        if len(rows) > MAX_ROWS:
            raise ValueError(f"{n} has more than {MAX_ROWS} rows")
        held["stored" if n == "byte_sigs" else n] = [tuple(map(plain, r)) for r in sorted(rows, key=lambda r: repr(tuple(r)))]
    return Catalog(head.ns, head.details, head.multi, head.zip_default, **held)


def combined(*catalogs: Catalog) -> list[Catalog]:
    """Catalogues of several namespaces side by side; names must differ."""
    names = [c.ns for c in catalogs]
    if len(set(names)) < len(names):
        raise ValueError("namespaces must differ")
    return list(catalogs)


def signature_row(ns: str, ident: str, signature: Signature, weight: int = 0) -> tuple:
    return ns, ident, signature, weight
