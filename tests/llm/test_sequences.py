"""Packing, conversation repair and phrases against brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import conversations, packing, phrases

DOCS = "doc_id long, text string, lang string, source string, size long, seq string"


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def placed(spark, sizes, capacity, range_rows=1 << 16):
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    got = {r["id"]: (r["sequence_id"], r["offset"]) for r in packing.packed(rows, capacity, range_rows).collect()}
    assert sorted(got) == list(range(len(sizes)))
    held = {}
    for i, (seq, offset) in got.items():
        held.setdefault(seq, []).append((offset, sizes[i]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("range_rows", [1 << 16, 7])
def test_packing_is_gapless_and_tight(spark, range_rows):
    rng = random.Random(range_rows)
    sizes = [min(100, max(1, int(rng.lognormvariate(3, 1)))) for _ in range(400)]
    assert placed(spark, sizes, 100, range_rows) <= max(sum(s > 50 for s in sizes), -(-sum(sizes) // 100)) + 4
    assert placed(spark, [30] * 200, 100, range_rows) <= 67 + 2  # a third of all rows and more of one size
    assert placed(spark, [100, 100, 50, 50], 100, range_rows) == 3


def test_packing_of_nothing_and_of_what_does_not_fit_together(spark):
    assert placed(spark, [], 10) == 0
    assert placed(spark, [6, 6, 6], 10) == 3
    assert placed(spark, [10], 10) == 1


def test_packed_documents_against_the_library(spark, bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe)
    texts = ["", None, "one two three", "x <|endoftext|> y", "long text. " * 3000, "one two three", "Ünïcödé " * 40]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "en", "s", 7, "clash") for i, t in enumerate(texts)], DOCS)
    got = packing.packed_documents(docs, bpe, 256).collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i if i != 3 else None, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(want)
    whole = packing.sequences(docs, bpe, 256).collect()
    assert Counter(x for r in whole for x in r["ids"]) == Counter(x for t in texts for x in library.encode(t or "", add_special_tokens=False).ids + [0])
    assert max(len(r["ids"]) for r in whole) <= 256
    assert packing.packed_documents(docs.limit(0), bpe).count() == 0


def repair(rows):
    """Every way to edit, by breadth: the least (cost, edits) that gives (s?(ua)+)?."""
    best = {0: (0, "", ())}

    def inserted(states):
        for _ in range(2):
            for s, (cost, edits, turns) in list(states.items()):
                to = 3 if s == 2 else 2
                way = (cost + 3, edits + "I", (*turns, ("assistant" if s == 2 else "user", "")))
                states[to] = min(states.get(to, way), way, key=lambda x: x[:2])
        return states

    for role, text, must, late in rows:
        after = {}
        for s, (cost, edits, turns) in inserted(dict(best)).items():
            ways = [(s, (cost + 4, edits + "D", turns))]
            if not must:
                to = 3 if s == 2 else 2
                ways.append((to, (cost + 3 + 3 * late, edits + "R", (*turns, ("assistant" if s == 2 else "user", text)))))
                keeps = {"s": s == 0, "u": s != 2, "a": s == 2}.get(role[:1], False)
                if keeps:
                    ways.append(({"s": 1, "u": 2, "a": 3}[role[0]], (cost + 3 * late, edits + "K", (*turns, (role, text)))))
            for to, way in ways:
                after[to] = min(after.get(to, way), way, key=lambda x: x[:2])
        best = after
    ends = inserted(best)
    return min((ends[s] for s in (0, 3) if s in ends), key=lambda x: x[:2])


def judged(rows):
    """rows: (turn, role, text) of a conversation, in order."""
    seen, out, counts = set(), [], Counter()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        counts[kind] += 1
        out.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, left = repair(out)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "", " "]
    texts = ["Hello there.", "Well", " ", "", "Is it?\n", " ", "Line\nbreak", "x" * 30]
    return [(rng.choice([None, *range(n)]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts) + str(rng.choice(["", "", "1.", "2"]))) for _ in range(n)]


@pytest.mark.parametrize("long_rows", [1024, 5])
def test_repair_against_brute_force(spark, monkeypatch, long_rows):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 4)
    rng = random.Random(7)
    held = {c: conversation(rng, rng.choice([1, 2, 3, 5, 9, 14])) for c in [None, *range(40)]}
    rows = [(c, t, r, x, 1, "clash") for c, turns in held.items() for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, blank int, c string")
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repaired(df, long_rows=long_rows).collect()}
    order = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())
    assert got == {c: judged(sorted(turns, key=order)) for c, turns in held.items()}


@pytest.mark.parametrize("long_chars", [1 << 22, 100])
def test_repaired_turns(spark, long_chars):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (1, 3, "assistant", "y" * 300 + "."), (2, 0, None, None)], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in conversations.repaired(df, keep_turns=True, long_chars=long_chars).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "Hi."), ("assistant", ""), ("user", "Hm."), ("assistant", "y" * 300 + ".")]
    assert (got[1]["audit"], got[1]["cost"], got[1]["gaps"], got[1]["illegal"]) == ("KIKK", 3, 1, 1)
    assert (got[2]["turns"], got[2]["audit"], got[2]["blank"], got[2]["repaired_sha256"]) == ([], "D", 1, hashlib.sha256(b"").hexdigest())
    assert conversations.repaired(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, 3, 4) for t in (None, *range(20))]
    got = Counter(tuple(r) for r in conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        what = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if what:
            want[c, t, "user" if what == 4 else role, "" if what == 1 else "One Two" if what == 2 else text] += 2 if what == 3 else 1
    assert got == want


def brute_phrases(rows, least, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    out = {}
    for (lang, g), a in frequent.items():
        if len(g) < 2 or any(x[0] == lang and len(x[1]) > len(g) and m >= a and any(x[1][i : i + len(g)] == g for i in range(len(x[1]))) for x, m in frequent.items()):
            continue
        cuts = [(1000 * a * total[lang] // (frequent[lang, g[:k]] * frequent[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), frequent[lang, g[:k]], frequent[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top])}


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "New", "york", "City", "é", "zu", "|", "a'b"] + [f"w{i}" for i in range(20)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(60):
        body = " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 2, 30, 200])))
        rows.append((["en", "fr", None][i % 3], re.sub(r" (w1\d) ", lambda m: f" {m[1]}{rng.choice('.,;!? ')} ", body)))
    return rows + [("en", "New York city of the"), ("en", "x" * 100_000 + " the of the"), ("en", "the of " * 2000), (None, None), ("", "the of the of the of")] * 3


@pytest.mark.parametrize(("listed", "bucket"), [(1 << 20, 1 << 18), (4, 50), (1 << 20, 20)])
def test_phrases_against_brute_force(spark, listed, bucket):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "clash") for i, (lang, t) in enumerate(rows)], DOCS).withColumnRenamed("seq", "word")
    got = {tuple(r) for r in phrases.collocations(docs, least=5, top=40, listed=listed, bucket=bucket).collect()}
    want = brute_phrases(rows, 5, 40)
    assert len(want) > 40
    assert got == want


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, " . , ", "en", "s", 1, "x")], DOCS)).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    big = 1 << 40
    grams = spark.createDataFrame([([1, 2], big)], "g array<long>, n long")
    words = spark.createDataFrame([("en", "x", 1, big + 1), ("en", "y", 2, big + 3)], "lang string, word string, h long, n long")
    row = phrases.scored(grams, words, spark.createDataFrame([("en", 1 << 55)], "lang string, total long")).first()
    assert row["score"] == 1000 * big * (1 << 55) // ((big + 1) * (big + 3))
