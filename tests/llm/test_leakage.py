"""Leaks against a search of every window, with and without substitutions, by broadcast and by shuffle."""

import random
import re

import pytest

from sigloom.llm import leakage
from sigloom.llm.textform import words
from sigloom.session import table
from tests.llm.test_lookalike import disguised


def brute(docs, items, substitutions=0):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(12, len(w))
        for doc, other in docs:
            o = words(other)
            if n and any(sum(a != b for a, b in zip(w[i : i + n], o[j : j + n])) <= min(substitutions, n // 3) for i in range(len(w) - n + 1) for j in range(len(o) - n + 1)):
                out.add((doc, item))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_tables(spark, data, rows):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    items = [(r["item_id"], r["item_text"]) for r in rows("eval_items")]
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(12, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault((n, *w[i : i + n]), set()).add(item)
    expected = set()
    for doc, text in docs:
        w = words(text)
        for n in {k[0] for k in windows}:
            for i in range(len(w) - n + 1):
                expected |= {(doc, x) for x in windows.get((n, *w[i : i + n]), ())}
    assert expected
    assert result(leakage.leaked_items(table(spark, data, "documents"), table(spark, data, "eval_items"))) == expected


@pytest.mark.parametrize("substitutions", [0, 1])
@pytest.mark.parametrize("max_seeds", [0, leakage.MAX_SEEDS])
def test_random_texts(spark, substitutions, max_seeds):
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "délta", "7"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 3, 11, 12, 13, 20])))) for i in range(25)] + [(90, "?!"), (91, None), (92, "")]
    docs = []
    for d in range(40):
        w = [word() for _ in range(rng.randint(0, 30))]
        part = words(items[rng.randrange(25)][1])
        if rng.random() < 0.7:
            begin = rng.randint(0, max(len(part) - 12, 0))
            part = part[begin : begin + 12]
            if rng.random() < 0.5 and part:
                part[rng.randrange(len(part))] = "zeta"
            w[len(w) // 2 : len(w) // 2] = part
        docs.append((d, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "... "), (1, docs[1][1]), (None, docs[0][1])]
    a, b = frames(spark, docs, items)
    expected = {x for x in brute([d for d in docs if d[0] is not None and d[1]], items[:26], substitutions) if x[0] is not None}
    assert result(leakage.leaked_items(a, b, substitutions, False, max_seeds)) == expected
    exact = {x for x in brute([d for d in docs if d[0] is not None and d[1]], items[:26], 0) if x[0] is not None}
    assert result(leakage.leaked_items(a, b, substitutions, True, max_seeds)) == exact


def test_forms_and_edges(spark):
    item = "The café of Zürich holds twelve words in a row and then one more"
    same = "THE café, of Zürich: ho­lds ｔｗｅｌｖｅ wоrds in a row and then one more"  # a Cyrillic o
    docs = [(1, "x " * 50_000 + same + " y" * 50_000), (2, item.replace("twelve", "ten")), (3, " ".join(item.split()[:12])), (4, " ".join(item.split()[:11]))]
    a, b = frames(spark, docs, [(5, item), (5, item)])
    assert result(leakage.leaked_items(a.selectExpr("*", "1 as item_id", "'q' as item_text"), b.selectExpr("*", "2 as doc_id", "'r' as text"))) == {(1, 5), (3, 5)}
    assert result(leakage.leaked_items(a.limit(0), b)) == set() and result(leakage.leaked_items(a, b.limit(0))) == set()


def test_one_substitution_is_always_hit():
    for span in range(leakage.STRIDE, leakage.SPAN + 1):
        kept = leakage.masks(span)
        assert all(any(place not in mask for mask in kept) for place in range(span))


def test_overlaps_grow_around_hits(spark):
    item = [f"w{i}" for i in range(40)]
    text = ["a", "b", *item[3:38], "c", *item[:5]]
    text[2 + 15], text[2 + 30] = "x", "y"
    a, b = frames(spark, [(1, " ".join(text)), (2, " ".join(item[:11])), (3, " ".join([*item[:6], "z", *item[7:13], *item[13:18]]))], [(7, " ".join(item))])
    got = result(leakage.overlaps(a, b))
    assert got == {(1, 7, 2, 3, 35, 2, 15), (3, 7, 0, 0, 18, 1, 11)}
    assert result(leakage.leaked_items(a, b)) == {(1, 7)} and result(leakage.leaked_items(a, b, exact=False)) == {(1, 7), (3, 7)}


def recall(substitutions: int, n: int, rng) -> float:
    """Share of planted passages of 24 words with so many words replaced, never more in 12 than tolerated, that are found."""
    found = 0
    for _ in range(n):
        item = [f"w{rng.randrange(10**6)}" for _ in range(24)]
        text = list(item)
        for half in (0, 12):
            for at in rng.sample(range(half, half + 12), substitutions):
                text[at] = "odd"
        found += bool(leakage.TestSide([(1, item)], substitutions).overlaps([" ".join(text)], leakage.WordHashes()))
    return found / n


def test_recall_by_substitutions():
    rng = random.Random(3)
    got = {k: recall(k, 300, rng) for k in (0, 1, 2, 3)}
    print("recall by substitutions:", got)
    assert got[0] == got[1] == 1 and got[2] > 0.8 and got[3] > 0.3, got


def test_words_of_disguised_texts():
    """The words of plain texts and of texts that look like them, against a definition of its own."""
    rng = random.Random(9)
    for i in range(300):
        plain = " ".join(rng.choice(["Report,", "OFFICE", "x-1", "jpeg's", "type;", "A", "(SIP)", "123.", "KHz"]) for _ in range(rng.randint(0, 15))) + f" {i}"
        assert words(plain) == re.findall("[a-z0-9]+", plain.lower()) == words(disguised(plain, rng))
