import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spoorlog.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["a b\nc d\n\n \na b\n", "x y z w", "# a * $ %\t&|<>\x0b\x0c\r!", None, "", "A b C d E " * 30, "one two three four five"]
    got = {r.doc_id: r for r in Q.statistics(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), t


def test_learns_a_short_list():
    rng = random.Random(1)
    rows, low = [], []
    for _ in range(3000):
        r = [rng.random() for _ in Q.FEATURES]
        rows.append(tuple(r))
        low.append(r[2] > 0.8 or (r[3] > 0.7 and r[1] <= 0.3))
    rules = Q.learn(rows, low)
    assert 1 <= len(rules) <= 6
    value = lambda r, c: (r[Q.FEATURES.index(c.feature)] > c.limit) == c.above
    judged = [any(all(value(r, c) for c in rule) for rule in rules) for r in rows]
    right = sum(a == b for a, b in zip(judged, low, strict=True)) / len(rows)
    assert right > 0.93
    assert sum(j and not b for j, b in zip(judged, low, strict=True)) < 0.03 * sum(judged)


def test_no_rule_from_noise():
    rng = random.Random(2)
    rows = [tuple(rng.random() for _ in Q.FEATURES) for _ in range(2000)]
    assert Q.learn(rows, [rng.random() < 0.2 for _ in rows]) == []
    assert Q.learn([], []) == []


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3).map(float) for _ in Q.FEATURES], st.booleans()), max_size=60))
def test_any_rows_can_be_learned_from(rows):
    for rule in Q.learn([r[:-1] for r in rows], [r[-1] for r in rows]):
        assert 1 <= len(rule) <= 4


def test_verdict_is_the_first_rule(spark):
    a, b = Q.Condition("n_words", True, 5.0), Q.Condition("n_words", True, 2.0)
    df = spark.createDataFrame([(1.0,), (3.0,), (9.0,)], "n_words double")
    assert [r[0] for r in df.select(Q.verdict([(a,), (b,)])).collect()] == [0, 2, 1]
    assert [r[0] for r in df.select(Q.verdict([])).collect()] == [0, 0, 0]


def test_judge_keeps_clean_and_drops_junk(spark, docs):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(rng.choice(words) + "***" for _ in range(60)) for _ in range(150)]
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 300, 1) if i % 3], "doc_id bigint, quality int, toxic int")
    out = Q.judge(docs(clean + junk), labels)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.kept for r in out.collect()}
    assert [got[i] for i in range(300)] == [True] * 150 + [False] * 150
