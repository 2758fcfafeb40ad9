"""Tokens: preprocessing with stop-words and pluggable lemmas and stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, place, token): runs of letters of the lower-case text without URLs."""
    bare = F.lower(F.regexp_replace("text", T.URL, ""))
    return docs.select("doc_id", F.posexplode(T.found(bare, r"[\p{L}\p{N}]+")).alias("place", "token"))


#: Letters of the longest suffix that a rule is learned for, and the pairs a rule needs.
LONGEST_SUFFIX, LEAST_PAIRS = 6, 2


def _suffixes(df: DataFrame, longest: int) -> DataFrame:
    """df with each suffix of its token, of 0 to `longest` letters (k)."""
    upto = F.least(F.length("token"), F.lit(longest))
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), upto))).withColumn("suffix", F.right("token", F.col("k")))


def lemma_rules(pairs: DataFrame, longest: int = LONGEST_SUFFIX, least: int = LEAST_PAIRS) -> DataFrame:
    """(suffix, strip, append, n): for each suffix of tokens in (token, lemma), the change of the most of its n pairs.

    A pair's change strips the letters after the common beginning and appends the lemma's; it counts for
    the suffixes that hold all stripped letters. Ties go to the fewer letters stripped, then the lesser
    string appended; suffixes whose change has under `least` pairs have no rule. Repeated pairs count
    once; nulls and empty strings have no part. No pairs give no rules.
    """
    held = pairs.select("token", "lemma").where("token <> '' and lemma <> ''").distinct()
    same = F.filter(F.sequence(F.lit(1), F.least(F.length("token"), F.length("lemma"))), lambda i: F.left("token", i) == F.left("lemma", i))
    held = held.withColumn("_same", F.size(same))
    change = held.select("token", (F.length("token") - F.col("_same")).alias("strip"), F.expr("substring(lemma, _same + 1)").alias("append"))
    counted = _suffixes(change, longest).where("strip <= k").groupBy("suffix", "strip", "append").agg(F.count("*").alias("n"))
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("n")).alias("n"), "strip", "append")).alias("best"))
    return best.select("suffix", "best.strip", "best.append", (-F.col("best.n")).alias("n")).where(F.col("n") >= least)


def lemma_table(toks: DataFrame, pairs: DataFrame, longest: int = LONGEST_SUFFIX, least: int = LEAST_PAIRS) -> DataFrame:
    """(token, lemma) of each distinct token of toks: its lemma in pairs (the least of several), else what the rule of its longest suffix with one makes of it, else itself.

    A rule that would leave nothing isn't used. Rules are joined once for each distinct token and suffix. Null tokens have no row.
    """
    own = pairs.where("token <> '' and lemma <> ''").groupBy("token").agg(F.min("lemma").alias("_own"))
    held = toks.select("token").where("token is not null").distinct().join(own, "token", "left")
    rule = _suffixes(held.where("_own is null").select("token"), longest).join(lemma_rules(pairs, longest, least), "suffix")
    made = rule.groupBy("token").agg(F.max(F.struct("k", "strip", "append")).alias("_rule"))
    learned = F.nullif(F.concat(F.left("token", F.length("token") - F.col("_rule.strip")), F.col("_rule.append")), F.lit(""))
    return held.join(made, "token", "left").select("token", F.coalesce("_own", learned, "token").alias("lemma"))


def kept_tokens(toks: DataFrame, stop_words: list[str] | None = None, lemmas: DataFrame | None = None, custom: list[str] | None = None, unseen: bool = False) -> DataFrame:
    """toks with lemma, of alphabetic tokens of over two letters that are no stop-words, nor their lemmas custom ones.

    lemmas: (token, lemma), optional; other tokens are their own lemmas, or, with `unseen`, get theirs by
    the suffix rules that lemmas teaches (lemma_table).
    """
    out = toks.where(F.col("token").rlike(r"^\p{L}+$") & (F.length("token") > 2))
    if stop_words:
        out = out.where(~F.col("token").isin(stop_words))
    if unseen and lemmas is not None:
        lemmas = lemma_table(out, lemmas)
    out = out.join(lemmas, "token", "left").withColumn("lemma", F.coalesce("lemma", "token")) if lemmas is not None else out.withColumn("lemma", F.col("token"))
    custom = vocab.STOP_WORDS if custom is None else custom
    return out.where(~F.col("lemma").isin(custom)) if custom else out


def clean_text(toks: DataFrame) -> DataFrame:
    """(doc_id, clean_text): lemmas in order, joined by spaces."""
    held = F.array_sort(F.collect_list(F.struct("place", "lemma")))
    return toks.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda x: x["lemma"]), " ").alias("clean_text"))


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and i > 0 and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def porter_stem(w: str) -> str:
    """The suffix stripper of Porter (1980)."""
    if len(w) <= 2:
        return w
    cvc = lambda s: len(s) > 2 and _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(s := w[: -len(end)]):
                    w = s + "e" if s.endswith(("at", "bl", "iz")) else s[:-1] if double(s) and s[-1] not in "lsz" else s + "e" if _measure(s) == 1 and cvc(s) else s
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                w = w[: -len(end)] + to if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            w = s if _measure(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if _measure(w) > 1 and double(w) and w.endswith("l") else w


def with_stem(df: DataFrame, token: str = "token") -> DataFrame:
    """df with the stem of a token column, made once for each distinct token."""

    @F.pandas_udf("string")
    def stem(x: pd.Series) -> pd.Series:
        return x.map(porter_stem)

    table = df.select(token).distinct().withColumn("stem", stem(F.col(token)))
    return df.join(table, token)
