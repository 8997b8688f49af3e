"""Windows of benchmark items in documents, against a search over all places."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from spoorlog.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        for at in range(max(1, len(words) - 9) if words else 0):
            windows.setdefault(tuple(words[at : at + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        spots = [(m.start(), m.end()) for m in WORD.finditer(lowered(text))]
        words = WORD.findall(lowered(text))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                if (w := tuple(words[at : at + size])) in windows:
                    hit |= set(range(at, at + size))
                    found |= windows[w]
        runs = [(a, b) for a in sorted(hit) if a - 1 not in hit for b in [next(b for b in range(a, len(words) + 1) if b + 1 not in hit)]]
        out.append((doc_id, len(words), len(hit), sorted(found), [(spots[a][0], spots[b][1]) for a, b in runs]))
    return sorted(out, key=repr)


def got(spark, docs, items, **more):
    rows = D.find(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, ITEMS), **more).collect()
    n_hit = lambda r: sum(s.last - s.first + 1 for s in r.spans)
    return sorted(((r.doc_id, r.n_words, n_hit(r), r.item_ids, [(s.start, s.end) for s in r.spans]) for r in rows), key=repr)


def data():
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "a", "Ünder", "x9", "日本", "zeta", "b", "c", "d", "İx"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "--", "\x00", "'"]) for _ in range(n))
    items = [(i, text(rng.choice([12, 25, 40]))) for i in range(12)]
    items += [(20, "Short one, with ZETA x9"), (21, ""), (22, None), (23, " \n--"), (None, text(14)), (3, text(11)), (24, items[0][1])]
    docs = []
    for i in range(60):
        words = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1] or ""
            cut = item.upper() if rng.random() < 0.3 else item[rng.randrange(20) :]
            words += [cut, text(rng.randrange(9))]
        docs.append((i, " ".join(words)))
    return docs + [(60, None), (61, ""), (62, " \t--"), (None, items[1][1]), (5, docs[5][1]), (63, "word " * 30_000 + items[2][1])], items


def test_equal_to_search(spark):
    docs, items = data()
    wanted = plain(docs, items)
    assert sum(r[2] > 0 for r in wanted) > 20
    assert got(spark, docs, items) == wanted


def test_blocks_of_items_give_the_same(spark):
    """Beyond the bound of one automaton, in several scans."""
    docs, items = data()
    assert got(spark, docs, items, max_words=60) == plain(docs, items)


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 16)
    docs, items = data()
    assert got(spark, docs, items) == plain(docs, items)


def test_no_items_or_documents(spark):
    docs, items = data()
    assert all(r[2] == 0 and r[3] == [] for r in got(spark, docs[:5], []))
    assert got(spark, [], items) == []


def test_report_and_clashing_columns(spark):
    docs, items = data()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"n": F.lit("mine"), "digest": F.lit(1), "item": F.lit(2), "spans": F.lit(3)})
    known = spark.createDataFrame(items, ITEMS).withColumns({"piece": F.lit("mine"), "n": F.lit(1)})
    rows = D.report(D.find(frame, known)).collect()
    wanted = sorted((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i, _ in plain(docs, items) if d is not None)
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == wanted
