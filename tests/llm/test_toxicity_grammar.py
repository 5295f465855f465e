"""The toxicity grammar against a plain reading of its rules, and edge cases of the operator."""

import random

from knotwork.llm import toxicity as tox


def plain_events(symbols):
    """The rules read off the whole clause, position by position, without a machine."""
    out = []
    for i, s in enumerate(symbols):
        if s not in (tox.I, tox.T):
            continue
        before = symbols[:i]
        if s == tox.I:
            level = int(tox.X in symbols[max(0, i - tox.NEAR) : i])
        else:
            says = tox.V in before
            level = 2 if says or (tox.S in before and tox.M in before) else int(tox.M in before)
        negated = int(tox.N in symbols[max(0, i - tox.SCOPE + 1) : i])
        aimed = 1 if tox.G in before else 2 if tox.G in symbols[i:] else 0
        out.append((s, level, negated, int(tox.R in before), aimed))
    return out


def test_machine_against_plain_rules():
    rng, machine = random.Random(3), tox.compose()
    for _ in range(3000):
        symbols = [rng.choice(tox.SYMBOLS) for _ in range(rng.randrange(12))]
        assert tox.events(machine, symbols) == plain_events(symbols)


def found(text):
    g = tox.Grammar([])
    return [e for e, n in zip(tox.EVENTS, g.features(text), strict=True) for _ in range(int(n))]


def test_phrases():
    assert found("I will destroy you.") == [(tox.T, 2, 0, 0, 2)]
    assert found("someone should destroy it") == [(tox.T, 1, 0, 0, 0)]
    assert found("You are such an idiot") == [(tox.I, 1, 0, 0, 1)]
    assert found("He said nothing. What an idiot; you know") == [(tox.I, 0, 0, 0, 0)]
    assert found("she wrote that he is not an idiot") == [(tox.I, 0, 1, 1, 1)]
    assert found("idiotic trashcan") == [] and found(None) == [] and found("") == []


def test_clauses_of_a_long_text_count_once_each():
    text = "nothing here. " * 20_000 + "you idiot. " * 3 + "no end " * 50_000 + "you moron"
    assert len(found(text)) == 4


def test_scores(spark):
    t = spark.createDataFrame([(1, "You are an idiot.", 5.0), (1, "You are an idiot.", 6.0), (2, None, 1.0), (3, "", 1.0), (None, "I will kill you", 1.0), (4, "x " * 200_000 + "you scum", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1.0), (None, 1.0), (77, 0.0)], "doc_id long, toxic double")
    rows = tox.held_out_toxicity(t, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and {r.predicted for r in rows if r.doc_id in (2, 3)} == {0}
    assert [r.predicted for r in rows if r.doc_id is None] == [1] and [r.predicted for r in rows if r.doc_id == 4] == [1]
    assert tox.held_out_toxicity(t.limit(0), labels).count() == 0
    assert sorted(tox.without_toxic(t, labels).columns) == ["doc_id", "score", "text"] and tox.without_toxic(t, labels).count() == 2


def test_held_out_accuracy(spark):
    """Learned stems carry over to rows that weren't learned from."""
    rng = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "amet", "velit", "sunt"]
    rows = [(i, " ".join(rng.choices(plain, k=40) + (["brokachte"] * 2 if i % 3 == 0 else [])) + f" n{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = [r for r in tox.held_out_toxicity(docs, labels).collect() if r.held_out]
    assert len(out) > 30 and all(r.predicted == int(r.doc_id % 3 == 0) for r in out)
