"""Line dedup, passages, classifiers and page extraction against plain Python and held-out labels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import learning, lines, pages, passages, quality, toxicity

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def edited(r, s, n):
    for _ in range(n):
        k = r.randrange(len(s))
        s = r.choice([s[:k] + s[k + 1 :], s[:k] + r.choice("abé") + s[k:], s[:k] + r.choice("abé") + s[k + 1 :]])
    return s


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance(spark, edits):
    r = random.Random(edits)
    pairs = []
    while len(pairs) < 300:
        a = "".join(r.choice("abcé") for _ in range(r.choice([1, 2, 3, 4, r.randrange(8, 40)])))
        b = a
        for _ in range(r.randrange(0, edits + 3)):
            b = edited(r, b, 1) if b else "a"
        if abs(len(a) - len(b)) <= edits and b:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert all(x["near"] == (distance(x["a"], x["b"]) <= edits) for x in got) and {x["near"] for x in got} == {True, False}
    rows = spark.createDataFrame([(i, -i, a, b) for i, (a, b) in enumerate(pairs)], "x long, y long, a string, b string")
    assert {x["x"] for x in lines.verified(rows, edits).collect()} == {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= edits}


def brute_lines(rows, edits=2, least=6):
    order, first, out = [], {}, {}
    for doc, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        out[doc] = [0, 0, 0, []]
        for i, line in enumerate((text or "").split("\n")):
            line = line.strip("\t\n\x0b\x0c\r ")
            if not line:
                continue
            out[doc][0] += 1
            if line in first:
                out[doc][1] += 1
                continue
            first[line] = True
            if len(line) >= least and any(abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for o in order if len(o) >= least):
                out[doc][2] += 1
            else:
                out[doc][3].append(i)
            order.append(line)
    return {k: tuple(v) for k, v in out.items()}


def test_line_decisions(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(18, 60))).strip() for _ in range(40)]
    rows = [(i, "\n".join(edited(r, r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(1, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\n\t"), (103, "sho\nshO\nsho\nlonger\nlongar"), (None, base[0] + "\nonly in the last document"), (-5, base[1]), (104, "x" * 900 + "\n" + "x" * 899 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1))
    got = {x["doc_id"]: (x["n_lines"], x["n_exact"], x["n_near"], x["kept"]) for x in lines.decisions(docs).collect()}
    assert got == brute_lines(rows)
    out = {x["doc_id"]: x["text"] for x in lines.deduplicated(docs.drop("kept")).collect()}
    assert out[100] is None and out[102] == " \n\n\t" and out[103] == "sho\nshO\nlonger"
    assert all(out[k] == "\n".join(t.split("\n")[i] for i in v[3]) for k, t in rows if t and t.strip() and k is not None and k != 102 for v in [got[k]])
    assert lines.decisions(docs.where("false")).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(None, "one line of text\nanother line of text"), (None, "one line of text\na third line, quite unlike"), (7, "the same row\n\nall of it"), (7, "the same row\n\nall of it"), (7, "another row"), (7, None), (None, "in the end\nin the emd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_row": F.lit(1), "_again": F.lit("x"), "line": F.lit(2)})
    one, two = (sorted(map(str, lines.decisions(d.repartition(n)).collect())) for d, n in ((docs, 1), (docs, 6)))
    assert one == two and len(one) == len(rows)
    got = lines.decisions(docs).collect()
    assert sum(x["n_lines"] for x in got) == 11 and sum(x["n_exact"] for x in got) == 3 and sum(x["n_near"] for x in got) == 1 and sum(len(x["kept"]) for x in got) == 7
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns
    text = sorted((x["doc_id"] or -1, x["text"] or "") for x in out.collect())
    assert [t for i, t in text if i == 7] == ["", "", "another row", "the same row\n\nall of it"] and sum(t.count("one line of text") for _, t in text) == 1


def test_no_frequent_segment_is_left_out(spark):
    same = "the same beginning of a line " + "and the same end of it"
    rows = [(i, same[:29] + f"{i:05d} " + same[29:]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_lines"], x["n_exact"], x["n_near"], x["kept"]) for x in lines.decisions(docs).collect()} == brute_lines(rows)


def brute_chain(anchors, weight, gap):
    order = sorted(set(anchors))
    score = []
    for j, (a, b) in enumerate(order):
        score.append(weight + max([0.0, *(score[i] - gap * (a - order[i][0] + b - order[i][1]) for i in range(j) if order[i][0] < a and order[i][1] < b)]))
    return max(score)


def test_chains_are_optimal():
    r = random.Random(2)
    for _ in range(60):
        anchors = [(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 30))]
        found = passages.chains(anchors, 6, 0.06)
        assert sorted(x for c in found for x in c) == sorted(set(anchors))
        assert all(p[0] < q[0] and p[1] < q[1] for c in found for p, q in zip(c, c[1:]))
        best = found[0]
        value = 6 * len(best) - 0.06 * (best[-1][0] - best[0][0] + best[-1][1] - best[0][1])
        assert value == pytest.approx(brute_chain(anchors, 6, 0.06))


def test_fuzzy_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    p, q = fill(90), fill(70)
    fuzzy = p[:20] + ["new"] + p[21:40] + p[42:60] + ["two", "more"] + p[60:]
    rows = {1: fill(100) + p + fill(50), 2: p + fill(10), 3: fill(300) + fuzzy, 4: fill(200), 5: fill(30) + p[:30] + fill(30), 10: fill(60) + q + fill(5), 11: fill(5) + q, 20: fill(40)}
    rows |= {6: list(rows[4]), 7: list(rows[20]), 8: p + fill(20), 9: []}
    data = [(k, " ".join(v)) for k, v in rows.items()] + [(12, None), (None, " ".join(p))]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("start", F.lit("x"))
    got = {(x["other_id"], x["doc_id"]): x for x in passages.repeated_passages(docs).collect()}
    group, todo = {1}, True
    while todo:
        more = {y for a, b in got for y in (a, b) if {a, b} & group} - group
        group |= more
        todo = bool(more)
    assert group == {1, 2, 3, 8} and (10, 11) in got and (4, 6) in got
    assert {x for k in got for x in k} == {1, 2, 3, 8, 10, 11, 4, 6}
    x = got[1, 2]
    assert (x["other_start"], x["other_end"], x["start"], x["end"], x["identity"]) == (100, 190, 0, 90, 1.0)
    x = got[1, 3]
    assert (x["other_start"], x["other_end"], x["start"], x["end"]) == (100, 190, 300, 390) and 0.9 < x["identity"] < 1
    assert got[4, 6]["n_words"] == 200
    assert passages.repeated_passages(docs.where("false")).count() == 0


def test_classifiers_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    for module, label, least in ((toxicity, "toxic", 0.96), (quality, "quality", 0.95)):
        model = module.train(docs, labels)
        got = module.classified(docs.select("doc_id", "text"), model).drop("text").join(labels, "doc_id").where("held_out").toPandas()
        assert len(got) > 500 and (got.predicted == got[label]).mean() >= least and learning.auc(got.score.to_numpy(), got[label].to_numpy()) > 0.97
        odd = spark.createDataFrame([(1, None), (2, ""), (None, "..."), (3, "word " * 200_000), (3, "word " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
        rows = module.classified(odd, model).collect()
        assert len(rows) == 5 and all(0 <= x["score"] <= 1 and x["predicted"] in (0, 1) for x in rows)
        assert module.classified(odd.where("false"), model).count() == 0
        nothing = module.train(docs, labels.where("false"))
        assert all(0 <= x["score"] <= 1 for x in module.classified(odd, nothing).collect())


def test_offending_sentences(spark):
    words = np.array([0, 1, 0, 2, 0, 1])
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -6.0)
    s = toxicity.Sentences(pa.array(["Fine text. You rotten thing! Bye", "", None, "é rotten"]))
    model.weights[s.bucket[0, 3]] = 9
    assert s.words.word(3) == "rotten" and len(words) == 6
    docs = spark.createDataFrame([(1, "Fine text. You rotten thing! Bye"), (2, ""), (3, None), (4, "é rotten")], "doc_id long, text string")
    assert [(x["doc_id"], x["sentence"], x["start"], x["end"], x["text"]) for x in toxicity.offending(docs, model).orderBy("doc_id").collect()] == [(1, 1, 11, 27, "You rotten thing"), (4, 0, 0, 9, "é rotten")]
    p = toxicity.Model(model.weights, 0.0)(pa.array(["a. b", "a"]))
    assert p == pytest.approx([0.75, 0.5])


def test_network_pieces_give_the_same(monkeypatch):
    net, r = quality.Network.new(), np.random.default_rng(0)
    raw = r.integers(0, 256, 5000).astype(np.uint8)
    whole = net.pooled(raw)
    monkeypatch.setattr(quality, "_PIECE", 512)
    assert np.allclose(net.pooled(raw), whole, atol=1e-5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- c <p>no</p> --><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld &lt;x&gt;<br>next&nbsp;bit<p>Two   words\n here<p><b>open<p>Last<aside>Related</aside><form><input><label>Mail</label></form>
<section class="comments"><p>First!</p></section></article><div id="sidebar"><p>Side</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert pages.main_text(PAGE, None) == "Head & line One bold <x> next bit Two words here open Last"
    assert pages.main_text(None, None) == pages.main_text("", None) == pages.main_text("<p", None) == ""
    assert pages.main_text("a<b", None) == "a" and pages.main_text("<article>x &am", None) == "x &am"
    assert pages.main_text("<div>" * 30_000 + "deep</b></p>" * 300, None).startswith("deep")


def test_hosts(spark):
    urls = {"https://u@A.example:8/x": "a.example", "//b.c/x?y//z": "b.c", "http://É.Org/": "É.org", "": "", "x": "", None: ""}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", pages.host_of(F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in rows} == urls


def test_templates_of_pages_without_marks(spark):
    page = "<html><body><div class=top>Welcome to us</div><div class=c><p>Text {0} of page<p>Shared words</div><div>All rights {1}</div></body></html>"
    rows = [(i, f"http://h{i // 40}.org/{i}", page.format(i, "reserved" if i % 40 else "kept")) for i in range(80)] + [(90, None, None), (91, "odd", "<article>A</article>"), (92, "http://one.org", page.format(1, "x")), (93, "http://h0.org/", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).withColumn("template", F.lit(3))
    out = pages.extracted(df)
    got = {x["page_id"]: x["text"] for x in out.collect()}
    assert set(out.columns) == set(df.columns) and len(got) == len(rows)
    assert got[5] == "Text 5 of page" and got[45] == "Text 45 of page" and got[40] == "Text 40 of page All rights kept"
    assert got[90] == "" and got[91] == "A" and got[92].startswith("Welcome to us Text 1 of page") and got[93].startswith("Head & line")
    held = {x["host"]: x["template"] for x in pages.templates(df).collect()}
    assert set(held) == {"h0.org", "h1.org"}
    template = pages._parsed(held["h0.org"])
    found = pages.tokens(rows[5][2])
    assert {t.text for t in found if t.key in template.valid(found)} == {"Welcome to us", "Shared words", "All rights reserved"}
    assert pages.main_text(rows[5][2], None) == "Welcome to us Text 5 of page Shared words All rights reserved"
    assert pages.extracted(df.where("false")).count() == 0
    import unittest.mock as mock

    with mock.patch.object(pages, "BROADCAST_BYTES", 0):
        assert {x["page_id"]: x["text"] for x in pages.extracted(df).collect()} == got


def test_passages_that_the_stars_miss(spark):
    r = random.Random(9)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p, line = fill(80), fill(20)
    rows = {0: p[31:], 1: p[:49], 2: p, 3: p, 4: p[:49], 5: p[31:]} | {k: line for k in range(6, 40)}
    far = fill(60)
    rows |= {40: far[:15] + fill(80) + far, 41: far}
    docs = spark.createDataFrame([(k, " ".join((k != 2) * fill(30) + v + (k != 3) * fill(40))) for k, v in rows.items()], "doc_id long, text string")
    words = {x["doc_id"]: x["text"].split() for x in docs.collect()}
    brute = set()
    for b in words:
        for a in range(b):
            seeds = [(i, j) for i, x in enumerate(zip(*(words[a][k:] for k in range(6)))) for j, y in enumerate(zip(*(words[b][k:] for k in range(6)))) if x == y]
            x, y = (np.array([hash(w) & 0xFFFFFFFF for w in words[k]], np.uint32) for k in (a, b))
            for c in passages.chains(seeds) if seeds else []:
                s, e, t, f, same, _, _ = passages.align(x, y, c)
                if min(e - s, f - t) >= 50 and same >= 0.8:
                    brute.add((b, a, t, f, s, e))
    got = {tuple(x[k] for k in ("doc_id", "other_id", "start", "end", "other_start", "other_end")) for x in passages.repeated_passages(docs).collect()}
    assert got == brute and {x[:2] for x in got} == {(3, 2), (41, 40)}


def test_passages_among_many_holders_of_their_parts(spark):
    """Each seed has more places than are all compared, and its first and last documents hold under 50 words of the passage."""
    r = random.Random(12)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p, line = fill(80), fill(20)
    parts = [p[:49], p[31:], p[15:64]]
    rows = {k: parts[k % 3] for k in range(12)} | {20: p, 21: p, 22: p[:40] + ["other"] + p[40:]} | {k: parts[k % 3] for k in range(30, 42)} | {k: line for k in range(50, 90)}
    docs = spark.createDataFrame([(k, " ".join(fill(30) + v + fill(k % 7))) for k, v in rows.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["other_id"]): x for x in passages.repeated_passages(docs).collect()}
    assert {(21, 20)} <= got.keys() <= {(21, 20), (22, 20), (22, 21)} and linked(got) == {frozenset((20, 21, 22))}
    assert [got[21, 20][k] for k in ("start", "end", "other_start", "other_end", "identity")] == [30, 110, 30, 110, 1.0]
    one = spark.createDataFrame([(k, " ".join(fill(30) + p[k : k + 50] + fill(30))) for k in range(30)], "doc_id long, text string")
    assert passages.repeated_passages(one).count() == 0  # each two share 49 words at most


def linked(pairs):
    """The sets of documents that pairs connect."""
    sets = []
    for p in pairs:
        held = [x for x in sets if x & set(p)]
        sets = [x for x in sets if not x & set(p)] + [frozenset(p).union(*held)]
    return set(sets)


def test_fuzzy_passages_among_fragments_before_and_after(spark):
    r = random.Random(31)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p = fill(80)
    parts = [p[:49], p[31:], p[15:64]]
    changed = p[:40] + ["other"] + p[40:]
    rows = {k: parts[k % 3] for k in range(12)} | {20: p, 21: p, 22: changed, 23: changed} | {k: parts[k % 3] for k in range(30, 42)}
    docs = spark.createDataFrame([(k, " ".join(fill(30) + v + fill(5 + k % 7))) for k, v in rows.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["other_id"]) for x in passages.repeated_passages(docs).collect()}
    assert linked(got) == {frozenset((20, 21, 22, 23))}


def test_copies_with_changed_words_among_fragments(spark):
    r = random.Random(32)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p = fill(90)
    rows = {}
    for k in range(100, 112):
        rows[k] = list(p)
        for at in r.sample(range(90), 3):
            rows[k][at] = fill(1)[0]
    rows |= {k: p[at : at + 45] for k, at in zip([*range(80, 92), *range(120, 132)], [r.randrange(46) for _ in range(24)])}
    docs = spark.createDataFrame([(k, " ".join(fill(30) + v + fill(30))) for k, v in rows.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["other_id"]) for x in passages.repeated_passages(docs).collect()}
    assert linked(got) == {frozenset(range(100, 112))}


def test_passages_of_several_texts_of_an_id(spark):
    r = random.Random(33)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p, q = fill(60), fill(70)
    texts = [(5, fill(30) + p + fill(9)), (5, fill(80) + q), (5, fill(60)), (7, fill(4) + p), (2, q + fill(3)), (7, fill(4)), (5, None), (None, p)]
    docs = spark.createDataFrame([(k, v and " ".join(v)) for k, v in texts] * 2, "doc_id long, text string")
    got = {tuple(x) for x in passages.repeated_passages(docs).select("doc_id", "other_id", "start", "end", "other_start", "other_end", "n_words", "identity").collect()}
    assert got == {(7, 5, 4, 64, 30, 90, 60, 1.0), (5, 2, 80, 150, 0, 70, 70, 1.0)}


def test_templates_of_marked_pages(spark):
    page = "<html><body><div class=top>Welcome</div><article><p>Text {0} of page<p>Tell your friends about us</article><div>All rights</div></body></html>"
    teasers = "<html><body><article><p>Teaser {0}</article><article><p>More {0}</article><div class=c><p>The long text of page {0} that is what it is for</div></body></html>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(20)] + [(20 + i, f"http://t.org/{i}", teasers.format(i)) for i in range(20)] + [(40 + i, f"http://copy.org/{i}", page.format(1)) for i in range(3)]
    got = {x["page_id"]: x["text"] for x in pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Text 5 of page" and got[25] == "The long text of page 5 that is what it is for"
    assert got[41] == "Text 1 of page Tell your friends about us"


def test_equivalence_classes_match_brute_force(spark):
    """Tokens with equal occurrence vectors over a host's pages, by plain counting."""
    r = random.Random(8)
    rows = []
    for i in range(40):
        notes = "".join(f"<p class=n>note {k}</p>" for k in range(3) if r.random() < 0.7)
        rows.append((i, "http://h.org/", f"<body><div class=top>Top</div>{notes}<div class=c><p>Text {i}</p>{'<ul><li>x<li>y</ul>' * r.randrange(3)}</div></body>"))
    rows += [rows[0], rows[1]]  # repeated rows
    counts = [{}for _ in rows]
    for c, (_, _, page) in zip(counts, rows):
        for t in pages.tokens(page):
            c[t.key] = c.get(t.key, 0) + 1
    vectors = {}
    for k in {k for c in counts for k in c}:
        v = tuple(c.get(k, 0) for c in counts)
        if sum(x > 0 for x in v) >= len(rows) / 2:
            vectors.setdefault(v, set()).add(k)
    held = pages.templates(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(held) == 1 and {frozenset(k for k, _ in g) for g, _ in pages._parsed(held[0]["template"]).classes} == {frozenset(g) for g in vectors.values()}


def test_templates_find_articles_without_names(spark):
    """The real tables with semantic elements turned into div and attributes removed: the texts stay the same, and only by the templates."""
    real = spark.read.parquet(f"{SF}/pages.parquet")
    plain = F.regexp_replace(F.regexp_replace("html", r"<(/?)(?:article|main|nav|header|footer|aside|section)\b", "<$1div"), r'(<div)\s[^>]*>', "$1>")
    bare = real.withColumn("html", plain)
    want = {x["page_id"]: x["text"] for x in pages.extracted(real).collect()}
    got = {x["page_id"]: (x["text"], pages.main_text(x["html"], None)) for x in pages.extracted(bare).collect()}
    assert want.keys() == got.keys() and all(want.values())
    hosts = {x["page_id"]: x["h"] for x in real.select("page_id", pages.host_of(F.col("url")).alias("h")).collect()}
    many = [k for k in want if list(hosts.values()).count(hosts[k]) >= pages.LEAST_PAGES]
    assert len(many) > 200 and all(got[k][0] == want[k] for k in many) and not any(got[k][1] == want[k] for k in many)


def test_embedded_elements_end():
    assert pages.main_text("<article>a<svg width=1 />b<p>c<object data='x'/>d<p>e<canvas>f<p>g</article>", None) == "a b c d e f g"
    assert pages.main_text("<article>a <math><mi>x</mi></math> b<svg><text>no</text></svg><p>c<noscript>no</noscript></article>", None) == "a x b c"


def test_extents_of_many_places_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    for case in range(40):
        x, y = (rng.integers(0, rng.integers(1, 4), 400).astype(np.uint32) for _ in range(2))
        y[:200] = np.where(rng.random(200) < 0.8, x[:200], y[:200])
        n, p, q = rng.integers(0, 60, 50), rng.integers(60, 340, 50), rng.integers(60, 340, 50)
        q = p if case % 2 else q
        monkeypatch.setattr(passages, "_CELLS", [1, 500, 1 << 20][case % 3])
        ahead, back = passages._extents(x, y, p, q, n, 1), passages._extents(x, y, p - 1, q - 1, n, -1)
        for i, (a, b, m) in enumerate(zip(p, q, n, strict=True)):
            to, _, out = passages._extend(x[a : a + m], y[b : b + m])
            assert (to, out) == (ahead[0][i], ahead[1][i])
            to, _, out = passages._extend(x[a - m : a][::-1], y[b - m : b][::-1])
            assert (to, out) == (back[0][i], back[1][i])


def test_chains_read_together_touch_on_both_sides():
    chain = lambda a, b: [(a, b), (a + 20, b + 20)]
    found = [chain(0, 0), chain(100, 100), chain(100, 5000), chain(9000, 100)]
    groups = passages._near(found, 120)
    assert sorted(c for _, g in groups for c in g) == sorted(found)
    assert [(box, len(g)) for box, g in groups] == [((0, 0, 120, 120), 2), ((100, 5000, 120, 5020), 1), ((9000, 100, 9020, 120), 1)]
    assert passages._near([], 120) == []


def test_seeds_of_repeated_words_are_thinned():
    """Each window's least seed is kept by its hash, but a word that is repeated does not give a place at each word."""
    rng = np.random.default_rng(3)
    for case in range(200):
        h = rng.integers(0, [2, 3, 50, 10**6][case % 4], rng.integers(14, 200)).astype(np.uint64)
        kmers = passages.shingles(h, passages.SEED)
        seeds, at = passages.minimizers(h)
        view = np.lib.stride_tricks.sliding_window_view(kmers, passages.SEED_WINDOW)
        assert set(seeds) == set(view.min(1)) and (kmers[at] == seeds).all()
        assert (np.diff(at) <= passages.SEED_WINDOW).all() and at[0] < passages.SEED_WINDOW and at[-1] >= len(kmers) - passages.SEED_WINDOW
    seeds, at = passages.minimizers(np.full(105, 7, np.uint64))
    assert at.tolist() == [*range(0, 99, 7), 99]


def test_straight_chains_are_aligned_as_others(spark):
    """Rows of chains on one diagonal, counted at once, against align."""
    r = random.Random(41)
    fill = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    p = fill(120)
    rows = {1: fill(20) + p + fill(20), 2: fill(7) + p[:60] + fill(1) + p[61:90] + fill(1) + p[91:] + fill(9), 3: p[:70]}
    words = {k: np.array([hash(w) & 0xFFFFFFFF for w in v], np.uint32) for k, v in rows.items()}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["other_id"]): x for x in passages.repeated_passages(docs).collect()}
    assert got.keys() >= {(2, 1), (3, 1)}
    for (b, a), x in got.items():
        at = next(i for i in range(x["start"], x["end"]) if rows[b][i : i + 6] == rows[a][i - x["start"] + x["other_start"] :][:6])
        s, e, t, f, same, _, _ = passages.align(words[a], words[b], [(at - x["start"] + x["other_start"], at)])
        assert (x["other_start"], x["other_end"], x["start"], x["end"]) == (s, e, t, f) and x["identity"] == pytest.approx(same)
