"""Wrapping, scripts, tiling and the error message in the judgement of answers."""

import random

from tessera.llm import answers as A

Q = "List the town and the number of loans of all branches that opened after the year 1990"


def test_unwrap_keeps_open_frames():
    assert A.unwrap("```sql\nSELECT 1\n```") == ("\n\nSELECT 1\n\n", [])
    assert A.unwrap("text\n~~~\nSELECT 1")[1] == ["~~~"] and A.unwrap("<sql>SELECT 1")[1] == ["sql"] and A.unwrap("<p><b>x</b></p>")[1] == []
    assert A.unwrap("> - SELECT a\n* FROM t")[0] == "SELECT a\n* FROM t"
    assert A.unwrap("SELECT a FROM t WHERE b<i AND i>c")[0] == "SELECT a FROM t WHERE b<i AND i>c"


def test_wrapped_answers():
    d = lambda text, error=None: A.defect_of(Q, text, error)
    assert d("1. SELECT a FROM t") is None and d("<answer>SELECT a FROM t</answer>") is None and d("> SELECT a FROM t") is None
    assert d("```sql\nSELECT a FROM t") == "truncated" and d("<sql>SELECT a FROM t") == "truncated"
    assert d("SELECT a FROM t", "incomplete input") == "truncated" and d("SELECT a FROM t", "no such table: t") is None
    assert d("12345") is None and d("x") is None and d("- item one") == "other_language"


def test_tongues():
    assert A.tongue("先把表连接起来") == "han" and A.tongue("Нужно соединить") == "cyrillic" and A.tongue("df.groupby('a').sum()") == "program"
    assert A.tongue("Die Werte stehen dort") == "words" and A.tongue("12 - 3") is None


def test_an_apology_needs_an_act():
    d = lambda text: A.defect_of(Q, text)
    assert d("Sorry, I won't answer that.") == "refusal" and d("Unfortunately the request was declined.") == "refusal"
    assert d("The sorry state of the roads.") == "other_language"


def test_anchors_never_exceed_the_alignment():
    rng = random.Random(3)
    for _ in range(300):
        q = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 25))]
        a = [w for w in q if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            a.insert(rng.randrange(len(a) + 1), rng.choice("abcdefgh"))
        assert A.anchored_words(q, a) <= A.longest_in_order(q, a)
        assert A.copies_question(" ".join(q), " ".join(a)) == (A.longest_in_order(q, a) >= 0.8 * len(q) - 1e-9)
    words = Q.split()
    assert A.copies_question(Q, " ".join(w for i, w in enumerate(words) if i % 6 != 2)) and not A.copies_question(Q, " ".join(words[::-1]))
