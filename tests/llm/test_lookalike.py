"""The consistent form, the automaton against the table, and the pairs against brute force."""

import itertools
import random
import unicodedata
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import lookalike
from sigloom.llm.textform import LOOKALIKES, TABLE, table_form, words
from sigloom.session import table

ODD = "аеорсΟρɡꓮᎢ​‍﻿­  　ｅ①ﬁé́̈Ａ \nabcei"


def test_form():
    assert table_form("ｆｕｌｌ ﬁle ​Саt") == "full file Cat"
    assert table_form("é") == "é" != table_form("e") and table_form("A") != table_form("a")
    assert table_form("a  b") != table_form("a b") and table_form("a\r\n") != table_form("a\n")
    assert table_form("ё") == "ë" and table_form(" ") == " " and table_form("️‍") == ""
    assert all(table_form(a) == b for a, b in LOOKALIKES.items())
    assert all(b is None or len(b) == 1 for b in TABLE.values())
    assert words("Ünïque_ｗord's 1st—​Ｘ²") == ["ünïque", "word", "s", "1st", "x2"] and words(None) == [] == words(" ?")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(ODD), st.characters()), max_size=30))
def test_form_is_stable_and_tokens_are_the_table(text):
    form = table_form(text)
    assert table_form(form) == form
    spelling, folded = lookalike.Former(["abc", "file", "cat", "e", "a", "се", "Сор"]).text(text)
    assert folded == form == table_form(spelling)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=5), st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=6), st.integers(0, 2))
def test_automaton_is_the_edit_distance(token, vocabulary, budget):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    near = sorted((distance(token, w), w) for w in vocabulary)
    expected = near[0][1] if near and near[0][0] <= budget else None
    assert lookalike.Trie(sorted(vocabulary)).match(token, budget) == expected


def test_automaton_costs_nothing_for_lookalikes():
    trie = lookalike.Trie(["file", "cat", "ñ", "СССР"])
    assert trie.match("ﬁle") == "file" and trie.match("с\u200bａt") == "cat" and trie.match("n\u0303") == "ñ" and trie.match("dog") is None
    assert trie.match("cet") is None and trie.match("cet", 1) == "cat"


def test_automaton_decides_what_the_table_cannot():
    trie = lookalike.Trie(["привет", "hello", "cop", "сор", "Iris", "lily"])
    assert trie.match("пpивeт") == "привет"  # Latin p and e in a Russian word
    assert trie.match("he\u04c0\u04c0o") == "hello" and trie.match("\u04c0ris") == "Iris"  # one sign, two Latin letters
    assert trie.match("сор") == "сор" and trie.match("cop") == "cop" and trie.match("соp") == "сор"  # the fewest changes of script
    former = lookalike.Former(["привет", "hello"])
    assert former.token("пpивeт")[0] == "привет" != table_form("пpивeт") and former.token("пpивeт")[1] == former.token("привет")[1]
    assert former.token("слово") == ("слово", table_form("слово")) and former.token("wоrd") == ("word", "word")


#: Letters drawn like Latin ones by their names in the standard, apart from the tables of the package.
BY_NAME = {
    "CYRILLIC SMALL LETTER ": {"a": "A", "e": "IE", "o": "O", "p": "ER", "c": "ES", "y": "U", "x": "HA", "i": "BYELORUSSIAN-UKRAINIAN I", "j": "JE", "s": "DZE"},
    "CYRILLIC CAPITAL LETTER ": {"A": "A", "B": "VE", "E": "IE", "K": "KA", "M": "EM", "H": "EN", "O": "O", "P": "ER", "C": "ES", "T": "TE", "X": "HA", "S": "DZE", "J": "JE"},
    "GREEK CAPITAL LETTER ": {"A": "ALPHA", "B": "BETA", "E": "EPSILON", "Z": "ZETA", "H": "ETA", "I": "IOTA", "K": "KAPPA", "M": "MU", "N": "NU", "O": "OMICRON", "P": "RHO", "T": "TAU", "Y": "UPSILON", "X": "CHI"},
    "GREEK SMALL LETTER ": {"o": "OMICRON"},
}
TWINS = [(latin, unicodedata.lookup(prefix + name)) for prefix, names in BY_NAME.items() for latin, name in names.items()]
INVISIBLE = [unicodedata.lookup(n) for n in ("ZERO WIDTH SPACE", "ZERO WIDTH NON-JOINER", "ZERO WIDTH JOINER", "WORD JOINER", "SOFT HYPHEN", "ZERO WIDTH NO-BREAK SPACE", "LEFT-TO-RIGHT MARK", "VARIATION SELECTOR-16")]
SPACES = [unicodedata.lookup(n) for n in ("NO-BREAK SPACE", "EN SPACE", "THIN SPACE", "IDEOGRAPHIC SPACE", "NARROW NO-BREAK SPACE")]


def disguised(text, rng):
    """A text that looks the same, by rules that use no table of the package."""
    out = []
    for c in text:
        twins = [t for a, t in TWINS if a == c]
        if rng.random() < 0.2 and twins:
            c = rng.choice(twins)
        elif rng.random() < 0.1 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif rng.random() < 0.3 and c == " ":
            c = rng.choice(SPACES)
        elif rng.random() < 0.5 and ord(c) > 127:
            c = unicodedata.normalize("NFD", c)
        out.append(c + (rng.choice(INVISIBLE) if rng.random() < 0.05 else ""))
    return "".join(out)


def test_disguised_texts_are_found(spark):
    """All of 300 disguised texts are in the class of their original and no other; near texts are not."""
    rng = random.Random(11)
    words_ = ["Report", "office", "naïve", "Example", "KHz", "jpeg", "type", "café", "A", "x", "SIP", "123"]
    plain = sorted({" ".join(rng.choice(words_) for _ in range(rng.randint(1, 12))) + f" {i}" for i in range(300)})
    docs = [(i, t) for i, t in enumerate(plain)] + [(1000 + i, disguised(t, rng)) for i, t in enumerate(plain)] + [(2000 + i, t.swapcase()) for i, t in enumerate(plain)] + [(3000 + i, t.replace("é", "e").replace("ï", "i") + ".") for i, t in enumerate(plain)]
    expected = {(i, 1000 + i) for i, t in enumerate(plain) if docs[len(plain) + i][1] != t}
    assert len(expected) > 250
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert result(lookalike.lookalike_pairs(df)) == expected
    classes = defaultdict(set)
    for r in lookalike.lookalike_classes(df).collect():
        classes[r.class_id].add(r.doc_id)
    assert {tuple(sorted(c)) for c in classes.values()} == expected


def brute(docs):
    by = defaultdict(set)
    for k, text in docs:
        if k is not None and text and table_form(text).strip():
            by[table_form(text)].add((k, text))
    return {(min(a[0], b[0]), max(a[0], b[0])) for g in by.values() for a, b in itertools.combinations(g, 2) if a[1] != b[1]}


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_tables(spark, data, rows):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    expected = brute(docs)
    assert result(lookalike.lookalike_pairs(table(spark, data, "documents"))) == expected
    # the vocabulary changes only the way, not the form
    assert result(lookalike.lookalike_pairs(table(spark, data, "documents"), max_words=0)) == expected


def test_edges(spark):
    long = "word " * 100_000
    docs = [(1, "Cat"), (2, "Сat"), (3, "Cat"), (4, "C​at"), (4, "C​at"), (5, "cat"), (6, " ​"), (7, " "), (8, None), (9, ""), (10, long), (11, long.replace("o", "о", 1)), (None, "Cа t"), (12, "﻿"), (13, "Cat "), (14, "Cát"), (15, "Cát")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'f' as form", "'s' as stored", "1 as doc_id_a")
    expected = {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (10, 11), (14, 15)}
    assert result(lookalike.lookalike_pairs(df)) == expected == brute(docs)
    assert result(lookalike.lookalike_pairs(df.limit(0))) == set()
    forms = {r.doc_id: r.text for r in lookalike.consistent(df).collect()}
    assert forms[2] == "Cat" and forms[8] is None and forms[9] == "" and forms[7] == " "
