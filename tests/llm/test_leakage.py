import random

import pytest

from fluxspan.llm.leakage import PassageIndex, leaked_passages, words_of

VOCABULARY = [f"{a}{b}{c}" for a in ("ta", "ri", "mon", "vel", "qu", "so") for b in ("lan", "er", "is", "o", "umb") for c in ("", "t", "ing", "e")]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def carries(doc, item):
    """The definition, by plain search."""
    n, m = len(doc), len(item)
    for i in range(n - 11):
        for j in range(m - 11):
            if doc[i : i + 12] == item[j : j + 12]:
                return True
    need, window = -(-2 * m // 3), 3 * m // 2
    for s in range(n):
        row = [0] * (m + 1)
        for w in doc[s : s + window]:
            previous = 0
            for j in range(1, m + 1):
                row[j], previous = (previous + 1 if w == item[j - 1] else max(row[j], row[j - 1])), row[j]
        if row[m] >= need:
            return True
    return False


def damaged(rng, item, lost, added):
    out = []
    for w in item:
        if rng.random() < added:
            out.append(rng.choice(VOCABULARY))
        if rng.random() >= lost:
            out.append(w)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_definition(seed):
    rng = random.Random(seed)
    items = [passage(rng, rng.randint(20, 50)) for _ in range(8)]
    docs = []
    for k in range(60):
        item = rng.choice(items)
        cut = rng.randint(8, 14)
        middle = rng.choice([damaged(rng, item, 0.2, 0.1), damaged(rng, item, 0.33, 0.3), damaged(rng, item, 0.3, 0.5), item[:cut], item[-cut:], item, []])
        docs.append(passage(rng, rng.randint(0, 60)) + middle + passage(rng, rng.randint(0, 60)))
    docs.append(passage(rng, 500) + items[0] + passage(rng, 500) + items[1])
    index = PassageIndex([(100 + i, " ".join(w)) for i, w in enumerate(items)])
    assert index.search(docs) == [[100 + i for i, item in enumerate(items) if carries(d, item)] for d in docs]


def test_passages_of_short_words():
    """No q-gram need survive here; words find what carries them."""
    rng = random.Random(3)
    tiny = ["a", "to", "it", "is", "so", "we", "he", "up", "on", "at", "by", "go"]
    items = [[rng.choice(tiny) for _ in range(n)] for n in (5, 8, 20, 30)]
    docs = [[rng.choice(tiny + ["long", "words"]) for _ in range(60)] + damaged(rng, rng.choice(items), 0.2, 0.1) for _ in range(40)]
    index = PassageIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    assert index.search(docs) == [[i for i, item in enumerate(items) if carries(d, item)] for d in docs]


def test_words():
    assert words_of("Café<br/>WA­TER <b>a</b>b &amp; x​y_z STRASSE straße") == ["cafe", "water", "ab", "xy", "z", "strasse", "strasse"]
    assert words_of(None) == words_of("") == []
    assert words_of("A&NBSP;b &Eacute;") == ["a", "b", "e"]
    assert words_of("2 < 3 and 4 > 1") == ["2", "3", "and", "4", "1"]


def test_operator(spark):
    rng = random.Random(9)
    item, short = passage(rng, 30), passage(rng, 6)
    other = passage(rng, 40)
    long = passage(rng, 70_000)
    long[35_000:35_012] = item[10:22]
    texts = {1: " ".join(item).upper(), 2: "<p>" + "\n".join(item[:11]), 3: " ".join(item[5:17]) + "!", 4: None, 5: "", 6: " ".join(short), 7: " ".join(long), 8: " ".join(other[:25])}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(1, texts[1], 0), (None, texts[1], 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(short)), (12, None), (13, ""), (None, "x y"), (10, " ".join(item))], "item_id bigint, passage string")
    got = sorted(tuple(r) for r in leaked_passages(docs, items).collect())
    assert got == [(1, 10), (3, 10), (6, 11), (7, 10)]
    assert leaked_passages(docs.limit(0), items).count() == 0
    assert leaked_passages(docs, items.limit(0)).count() == 0
