"""Large vocabularies as a tree of terms, and lemmas of unseen tokens by suffix rules."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import lexical


def test_tree_finds_what_the_alternation_finds():
    """Terms that begin with each other, in any order, with other cases, spaces, hyphens and an s at their ends."""
    r = random.Random(4)
    for case in range(400):
        terms = ["".join(r.choice("abs -S") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30))]
        terms = [t for t in terms if t.strip()] + ["ab"]
        extra = [r"b\w+", r"sa[\s\-]b"][: case % 3]
        plain, tree = re.compile(T.keyword_pattern([re.escape(t) for t in terms], extra)), re.compile(T.trie_pattern(terms, extra))
        text = "".join(r.choice("aabbss  -SA.\n") for _ in range(200))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in tree.finditer(text)], (terms, text)


def test_first_of_several_terms_counts(spark):
    df = spark.createDataFrame([("Energy mix, energies and energys MIX",), ("",), (None,), ("energy " * 5000,)], "text string")
    hits = lambda terms: [x[0] for x in df.select(T.found(F.col("text"), T.trie_pattern(terms, []))).collect()]
    assert hits(["energy", "energy mix"])[0] == ["Energy", "energys"]
    assert hits(["energy mix", "energy"])[0] == ["Energy mix", "energys"]
    assert [x if x is None else len(x) for x in hits(["energy", ""])] == [2, 0, None, 5000]
    assert T.trie_pattern([], [r"co2e?"]) == T.keyword_pattern([], [r"co2e?"])
    literal = spark.createDataFrame([("a.b axb (c) co2+",)], "text string")
    assert literal.select(T.found(F.col("text"), T.trie_pattern(["a.b", "co2"], []))).first()[0] == ["a.b", "co2"]


def test_lemmas_of_unseen_tokens(spark):
    pairs = [("companies", "company"), ("parties", "party"), ("walked", "walk"), ("talked", "talk"), ("grew", "grow"), ("walked", "walk"), ("cats", "cat"), ("dogs", "dog"), ("gas", "gas"), (None, "x"), ("y", None), ("", "z"), ("z", "")]
    table = spark.createDataFrame(pairs, "token string, lemma string")
    rules = {x["suffix"]: (x["strip"], x["append"], x["n"]) for x in lexical.lemma_rules(table).collect()}
    assert rules["ies"] == (3, "y", 2) and rules["ed"] == (2, "", 2) and rules["s"] == (1, "", 2)
    assert "ew" not in rules and "" not in rules  # one pair each; no change is shown by two
    toks = [("stories", 1), ("stories", 2), ("grew", 3), ("threw", 4), ("birds", 5), ("jumped", 6), ("gas", 7), ("s", 8), (None, 9), ("", 10), ("x" * 50_000 + "ed", 11)]
    held = spark.createDataFrame(toks, "token string, lemma long")
    got = {x["token"]: x["lemma"] for x in lexical.lemma_table(held, table).collect()}
    assert got == {"stories": "story", "grew": "grow", "threw": "threw", "birds": "bird", "jumped": "jump", "gas": "gas", "s": "s", "": "", "x" * 50_000 + "ed": "x" * 50_000}
    none = lexical.lemma_table(held.limit(3), table.where("false"))
    assert sorted(map(tuple, none.collect())) == [("grew", "grew"), ("stories", "stories")]
    assert lexical.lemma_table(held.where("false"), table).count() == 0


def test_rules_are_the_most_frequent_change(spark):
    """Against plain Python, over random pairs with ties, and lemmas of all tokens."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab") for _ in range(r.randint(1, n)))
    pairs = list({word(7): word(7) for _ in range(150)}.items())
    seen: dict = {}
    for t, m in pairs:
        same = next((i for i in range(min(len(t), len(m))) if t[i] != m[i]), min(len(t), len(m)))
        for k in range(len(t) - same, min(len(t), 6) + 1):
            changes = seen.setdefault(t[len(t) - k :], {})
            changes[len(t) - same, m[same:]] = changes.get((len(t) - same, m[same:]), 0) + 1
    best = {s: min((-n, *c) for c, n in changes.items()) for s, changes in seen.items()}
    rules = {s: (strip, app, -n) for s, (n, strip, app) in best.items() if n <= -2}
    table = spark.createDataFrame(pairs, "token string, lemma string")
    assert {x["suffix"]: (x["strip"], x["append"], x["n"]) for x in lexical.lemma_rules(table).collect()} == rules
    toks, own = {word(9) for _ in range(300)}, dict(pairs)

    def lemma(t: str) -> str:
        k = next((k for k in range(min(len(t), 6), -1, -1) if t[len(t) - k :] in rules), None)
        if t in own or k is None:
            return own.get(t, t)
        strip, app, _ = rules[t[len(t) - k :]]
        return t[: len(t) - strip] + app or t

    got = lexical.lemma_table(spark.createDataFrame([(t,) for t in toks], "token string"), table)
    assert {x["token"]: x["lemma"] for x in got.collect()} == {t: lemma(t) for t in toks}


def test_tokens_with_learned_lemmas(spark):
    docs = spark.createDataFrame([(1, "The stories, birds and walked paths")], "doc_id long, text string")
    table = spark.createDataFrame([("companies", "company"), ("parties", "party"), ("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    clean = lambda unseen: lexical.clean_text(lexical.kept_tokens(lexical.tokens(docs), ["the"], table, [], unseen)).first()["clean_text"]
    assert clean(False) == "stories birds and walked paths" and clean(True) == "story bird and walked path"
