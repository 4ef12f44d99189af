"""Visually identical text with different characters.

The vocabulary of the corpus (its most frequent words of one script, whatever
the script) is laid out as a trie of letters. A weighted edit automaton walks
the raw characters of each token through it and follows every reading of a
character at once: itself, its variants, the letters of other scripts drawn
like it, nothing if it is ignorable - all at no cost; other edits cost one each
and the production budget is zero. Of the words it ends at, the token's
canonical spelling is the one of the fewest second-best shapes, then of the
fewest letters changed in script, then the most frequent. So a Cyrillic o in an
English word and a Latin o in a Russian word are both put right, and a letter
that could be two Latin letters becomes the one that makes a word; a table alone
can do neither. Tokens that end at no word are normalised by table: words wholly
of one script keep it, mixed ones become Latin.

Texts are compared by the folded form of their canonical spelling, in which a
letter drawn like a Latin letter is that letter, in every word; it is a key
beside the text, which keeps its scripts. Forms are compared by 128-bit hashes.
The first output is the class of each document; pairs are a view of the classes
in which only the distinct texts of a form meet, exact copies never.

Defined results: null and empty texts and texts without a visible character are
no case; repeated rows of a document count once; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.textform import letters_of, own_script, readings, spelled, table_form
from sigloom.session import cut, spread

#: Words in the trie at most; tokens of all other words go by table.
MAX_WORDS = 20_000
#: Distinct tokens a worker remembers.
MAX_KEPT = 300_000
#: Blanks that stay blanks in every form, so that the form of a text is that of its parts.
BLANK = "\t\n\r\x0b\x0c\x85\u2028\u2029" + "".join(c for c in map(chr, range(0x21, sys.maxunicode + 1)) if unicodedata.category(c) == "Zs")
#: What a text is changed in: tokens with anything but printable ASCII, and runs of special blanks. All between stays as it is.
ODD = re.compile(rf"(?<![^ {BLANK}])[!-~]*+[^!-~ {BLANK}][^ {BLANK}]*+|[{BLANK[6:]}]+")
#: Words the vocabulary may hold: of one script.
ONE_SCRIPT = r"^(?:[!-~]{2,40}|" + "|".join(rf"\p{{Is{s}}}{{2,40}}" for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu")) + ")$"


class Trie:
    """Vocabulary trie with a weighted edit automaton. Words come most frequent first."""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        self.read: dict[str, tuple] = {}
        for rank, word in enumerate(words):
            if spelled(word) != word or not own_script(word):
                continue
            node = self.root
            for c in letters_of(word):
                node = node.setdefault(c, {})
            node.setdefault("", (rank, word))

    def match(self, token: str, budget: int = 0) -> str | None:
        """The canonical spelling of a token among the words within the budget of edits."""
        states = {id(self.root): (0, 0, 0, self.root)}
        for char in token:
            got = self.read.get(char)
            if got is None:
                got = self.read[char] = readings(char)
            ahead: dict = {}
            for second, changed, letters in got:
                for s in self._walk(states, letters, budget).values():
                    self._reach(ahead, s[0], s[1] + second, s[2] + changed, s[3])
            if not ahead:
                return None
            states = ahead
        if budget:
            states = self._skip(states, budget)
        ends = [(cost, second, changed, *node[""]) for cost, second, changed, node in states.values() if "" in node]
        return min(ends)[-1] if ends else None

    @staticmethod
    def _reach(states: dict, cost: int, second: int, changed: int, node: dict) -> None:
        old = states.get(id(node))
        if old is None or old[:3] > (cost, second, changed):
            states[id(node)] = (cost, second, changed, node)

    def _walk(self, states: dict, letters: str, budget: int) -> dict:
        """The states behind a sequence of letters."""
        for c in letters:
            ahead: dict = {}
            for cost, second, changed, node in (self._skip(states, budget) if budget else states).values():
                if c in node:
                    self._reach(ahead, cost, second, changed, node[c])
                if cost < budget:
                    self._reach(ahead, cost + 1, second, changed, node)
                    for d, n in node.items():
                        if d:
                            self._reach(ahead, cost + 1, second, changed, n)
            states = ahead
        return states

    def _skip(self, states: dict, budget: int) -> dict:
        """The states and those reached by leaving out letters of a word, at one each."""
        best, queue = dict(states), list(states.values())
        while queue:
            cost, second, changed, node = queue.pop()
            if cost < budget:
                for c, n in node.items():
                    if c and (id(n) not in best or best[id(n)][:3] > (cost + 1, second, changed)):
                        best[id(n)] = (cost + 1, second, changed, n)
                        queue.append(best[id(n)])
        return best


class Former:
    """Spells texts canonically, token by token, remembering tokens; beside each spelling its folded form."""

    def __init__(self, vocabulary: Iterable[str]):
        self.trie, self.kept = Trie(vocabulary), {}

    def token(self, token: str) -> tuple[str, str]:
        """(canonical spelling, folded form) of a token."""
        if token.isascii() and token.isprintable():
            return token, token
        got = self.kept.get(token)
        if got is None:
            word = self.trie.match(token)
            if word is None:  # unmatched: by table
                folded = table_form(token)
                own = spelled(token)
                got = (own if own_script(own) else folded), folded
            else:
                got = word, table_form(word)
            if len(self.kept) >= MAX_KEPT:
                self.kept.clear()
            self.kept[token] = got
        return got

    def text(self, text: str) -> tuple[str, str]:
        """(canonical text, folded form) of a text."""
        if text.isascii() and text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
            return text, text
        out, folded, at = [], [], 0
        for m in ODD.finditer(text):
            own, key = self.token(m.group())
            out += (text[at : m.start()], own)
            folded += (text[at : m.start()], key)
            at = m.end()
        return "".join(out) + text[at:], "".join(folded) + text[at:]


def vocabulary(docs: DataFrame, max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent words of one script, counted over all documents."""
    w = docs.select(F.explode(F.split("text", r"[ \t\n\r\x0b\x0c]+")).alias("w")).where(F.col("w").rlike(ONE_SCRIPT))
    return [r.w for r in w.groupBy("w").count().orderBy(F.desc("count"), "w").limit(max_words).select("w").collect()]


def digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


FORMS = pa.schema([("doc_id", pa.int64()), ("form", pa.binary()), ("stored", pa.binary())])


def form_hashes(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, form (hash of the consistent form), stored (hash of the text) of every text with a visible character."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(shared.value)
        for batch in batches:
            ids, forms, stored = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (form := former.text(text)[1]).strip():
                    ids.append(k)
                    stored.append(digest(text))
                    forms.append(digest(form))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.binary()), pa.array(stored, pa.binary())], schema=FORMS)

    return spread(docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, form binary, stored binary")


def lookalike_groups(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, form, stored of the documents whose form is that of at least two different texts."""
    x = cut(form_hashes(docs, vocabulary(docs, max_words)))
    several = x.groupBy("form").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a != b").select("form")
    return x.join(several, "form", "left_semi").distinct()


def lookalike_classes(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, class_id, text_id of the documents that look like a document of another text: one row per document and text.

    Documents of one class look the same; those of one text_id are exact copies. As many rows as documents, however
    popular a form is.
    """
    hexed = lambda c: F.lower(F.hex(c))
    return lookalike_groups(docs, max_words).select("doc_id", hexed("form").alias("class_id"), hexed("stored").alias("text_id"))


def lookalike_pairs(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id_a, doc_id_b: all pairs of documents with different texts and equal consistent form.

    The distinct texts of a form are paired first, then each text pair is expanded to the documents that hold the texts,
    so exact copies are never compared with each other, however many there are.
    """
    g = cut(lookalike_groups(docs, max_words))
    texts = g.select("form", "stored").distinct()
    a, b = texts.alias("a"), texts.alias("b")
    pairs = a.join(b, (F.col("a.form") == F.col("b.form")) & (F.col("a.stored") < F.col("b.stored"))).select(F.col("a.stored").alias("one"), F.col("b.stored").alias("two"))
    first = pairs.join(g.select(F.col("stored").alias("one"), F.col("doc_id").alias("d1")), "one")
    both = first.join(g.select(F.col("stored").alias("two"), F.col("doc_id").alias("d2")), "two").where("d1 != d2")
    return both.select(F.least("d1", "d2").alias("doc_id_a"), F.greatest("d1", "d2").alias("doc_id_b")).distinct()


def consistent(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, text: every document in canonical spelling; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, max_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former(shared.value)
        for batch in batches:
            texts = [None if t is None else former.text(t)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, text string")
