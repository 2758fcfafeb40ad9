"""Line dedup: exact copies, then a segment-partition edit join. DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, release, stored

EDITS = 2
_TOP = 31
_MASK = (1 << (_TOP + 1)) - 1
_SPACE = "\t\n\v\f\r "
#: Letters that are counted to tell lines of a frequent segment apart.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def lines_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no from 0, line) of lines that aren't blank, without white space around them."""
    split = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.withColumn("line", F.trim("line", F.lit(_SPACE))).where("line <> ''")


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment i of edits + 1 even ones; the last ones are longer by one."""
    n = edits + 1
    base, longer = F.floor(length / n).cast("int"), length % n
    extra = F.greatest(F.lit(0), longer - (n - 1 - i) - 1)
    return base * i + extra, base + (F.lit(n - 1 - i) < longer).cast("int")


def _offsets(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, offset) of the substrings of the longer line that can match a segment of the shorter.

    The multi-match-aware choice: with i segments before it and the rest after, an offset of more than i
    or a shift of more than the segments after it would leave another segment to match.
    """
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, d - (edits - i)), min(i, d + (edits - i))
            out += [(d, i, o) for o in range(low, high + 1)]
    return out


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: columns that a filter repeats are else worked out at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is `edits` or less: banded bit-parallel, one step for each character of b.

    a and b differ in length by `edits` at most and aren't empty. Bit _TOP of the
    vertical difference vectors is the row `edits` below the diagonal, and the band moves along the
    diagonal with each step; rows off the band count as mismatches, which no alignment within the limit
    would use. The score follows the lower edge of the band, then a's last row.
    """
    split = F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"), F.length(a).alias("m"))
    return _let(split, lambda s: _distance(s["x"], s["y"], s["m"], edits)) <= edits


def _distance(x: Column, y: Column, m: Column, edits: int) -> Column:
    """The distance of two arrays of characters, as far as it is within the edits. m: the size of x."""
    inv = lambda v: v.bitwiseXOR(F.lit(_MASK))

    def step(s: Column, i: Column) -> Column:
        vp, vn, score = s["vp"], s["vn"], s["score"]
        same = F.lit(0).cast("long")
        for k in range(-edits, edits + 1):
            same = same + F.when(F.get(x, i + k) == F.get(y, i), F.lit(1 << (_TOP - edits + k))).otherwise(F.lit(0))

        def from_match(match: Column) -> Column:
            d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(_MASK))

            def from_d0(d: Column) -> Column:
                hp, hn = vn.bitwiseOR(inv(d.bitwiseOR(vp))), d.bitwiseAND(vp)

                def done(h: Column) -> Column:
                    half = F.shiftrightunsigned(d, 1)
                    k = (F.lit(_TOP - 1) - (i - (m - edits))).cast("int")
                    more = F.when(i < m - edits, F.lit(1) - F.shiftrightunsigned(d, _TOP).bitwiseAND(F.lit(1))).otherwise(F.call_function("shiftrightunsigned", h["hp"], k).bitwiseAND(F.lit(1)) - F.call_function("shiftrightunsigned", h["hn"], k).bitwiseAND(F.lit(1)))
                    return F.struct(h["hn"].bitwiseOR(inv(half.bitwiseOR(h["hp"]))).alias("vp"), half.bitwiseAND(h["hp"]).alias("vn"), (score + more).cast("long").alias("score"))

                return _let(F.struct(hp.alias("hp"), hn.alias("hn")), done)

            return _let(d0, from_d0)

        return _let(same, from_match)

    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << (_TOP - edits)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(edits)).cast("long").alias("score"))
    return F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), start, step)["score"]


def letter_counts(line: Column) -> Column:
    """How often each of _LETTERS occurs, modulo 4, two bits each; an edit changes two of them by one at most."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(_LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(3)).cast("long"), 2 * k))
    return packed


def _apart(a: Column, b: Column) -> Column:
    """The least edit changes between two values of letter_counts: 1 for each letter that differs by an odd number, 2 for the others that differ."""
    turn = F.lit(sum(1 << 2 * k for k in range(len(_LETTERS)))).cast("long")
    unlike = a.bitwiseXOR(b)
    odd = unlike.bitwiseAND(turn)
    return F.bit_count(odd) + 2 * F.bit_count(F.shiftright(unlike, 1).bitwiseAND(turn).bitwiseAND(F.bitwise_not(odd)))


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning: a binary search over substrings."""
    n = F.least(F.length(a), F.length(b))
    longer = lambda p, s: (p + s <= n) & (F.substring(a, F.lit(1), p + s) == F.substring(b, F.lit(1), p + s))
    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda p, s: F.when(longer(p, s), p + s).otherwise(p))


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    """The (x, y) of rows (x, y, a, b) whose strings a and b are within the edits.

    Equal beginnings and ends never need an edit, so only what stands between is compared. With two
    edits, one is then spent on each end: the inner part of one string must be in the other.
    """
    two = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    rest = lambda c, p: F.substring(c, p + 1, F.length(c))
    beyond = lambda s: _let(_common(s["a"], s["b"]), lambda p: two(rest(s["a"], p), rest(s["b"], p)))
    turned = lambda s: two(F.reverse(s["a"]), F.reverse(s["b"]))

    def near(s: Column) -> Column:
        a, b = s["a"], s["b"]
        short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
        inner = F.contains(b, F.substring(a, F.lit(2), F.greatest(F.length(a) - 2, F.lit(0)))) if edits == 2 else F.lit(True)
        return F.when(long <= edits, True).when((short > 0) & inner, within(a, b, edits)).otherwise(False)

    middle = _let(_let(beyond(two(F.col("a"), F.col("b"))), turned), beyond)  # reversed, which changes no distance
    return pairs.where((F.abs(F.length("a") - F.length("b")) <= edits) & _let(middle, near)).select("x", "y")


def _keys(n: Column, wide: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """Hashes of a line's own segments, and of all its substrings that may be a segment of a line as long or shorter; the first edits + 1 of these are its own segments.

    n: its length; wide: its characters in four bytes each, which are cut without a walk from the beginning.
    """
    cut = lambda i, m, o: F.xxhash64(F.lit(i), m, F.substring(wide, (_segment(m, i, edits)[0] + o) * 4 + 1, _segment(m, i, edits)[1] * 4))
    own = [cut(i, n, 0) for i in range(edits + 1)]
    return own, own + [cut(i, n - d, o) for d, i, o in _offsets(edits) if d or o]


def _only(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines whose id is in ids (id, distinct). A bitmap of hashed ids, of a bounded size, leaves out most others, so that their texts aren't shuffled; a join decides.

    That join is an inner one: a semi join would be pushed below that with the bitmap, and all texts shuffled.
    """
    return among(lines, "id", ids, "id").join(ids, "id")


def similar_lines(distinct: DataFrame, edits: int = EDITS, least: int | None = None) -> DataFrame:
    """(x, y) ids of each pair of lines (id, line, n) within the edits, x <> y, each pair once; n: the line's length.

    If at most `edits` edits part two lines, one of edits + 1 segments of the shorter is in the longer,
    at a place that the length difference bounds. So each line puts its own segments in an index by
    length and segment number, and probes it with the substrings of _offsets for each shorter length. Most
    segments belong to one line, and a probe finds that line. Probes of segments that several lines share
    are joined with those lines again, and there pairs go whose counts of letters differ by more than
    2 * edits. Hash collisions only add candidates; `within` decides. Lines of less than `least`
    characters (2 * edits + 2, where the edits are a third of a line) are left out.
    """
    long = distinct.where(F.col("n") >= (2 * edits + 2 if least is None else max(least, 2 * edits + 2))).select("id", "n", F.encode("line", "UTF-32").alias("wide"))
    own, probe = _keys(F.col("n"), F.col("wide"), edits)
    index = long.select("id", F.explode(F.array(*own)).alias("key")).groupBy("key").agg(F.count("*").alias("lines"), F.min("id").alias("x"))
    probes = long.select(F.col("id").alias("y"), F.posexplode(F.array(*probe)).alias("k", "key")).withColumn("own", F.col("k") <= edits).drop("k")
    met = stored(probes.join(index.hint("shuffle_hash"), "key").where("lines > 1 or x <> y"), "line-probes")
    shared = met.where("lines > 1").select("key", "y", "own")
    lines = stored(_only(distinct, shared.select(F.col("y").alias("id")).distinct()).select("id", letter_counts(F.col("line")).alias("letters")), "line-letters")
    shared = stored(shared.join(lines, shared["y"] == lines["id"]).select("key", "y", "own", "letters"), "line-shared")
    held = shared.where("own").select("key", F.col("y").alias("x"), F.col("letters").alias("mx"))
    near = _apart(F.col("mx"), F.col("letters")) <= 2 * edits
    found = shared.join(held, (shared["key"] == held["key"]) & (F.col("x") != F.col("y")) & near).select("x", "y")
    found = found.union(met.where("lines = 1").select("x", "y"))
    pairs = stored(found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "line-pairs")
    release(met, lines, shared)
    needed = stored(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "line-ids")
    text = stored(_only(distinct, needed).select("id", "line"), "line-texts")
    both = pairs.join(text.select(F.col("id").alias("x"), F.col("line").alias("a")), "x").join(text.select(F.col("id").alias("y"), F.col("line").alias("b")), "y")
    out = stored(verified(both, edits), "similar")
    release(pairs, needed, text)
    return out


def _row(doc_id: Column, text: Column) -> Column:
    """A number that orders rows by doc_id, null ones last, and tells those of one doc_id (or none) apart by hashes of their texts."""
    far, part = F.lit(str(1 << 64)).cast("decimal(38,0)"), F.lit(1 << 30).cast("decimal(38,0)")
    first = F.coalesce(doc_id.cast("long").cast("decimal(38,0)"), far + F.xxhash64(text).cast("decimal(38,0)"))
    return (first * part + F.pmod(F.hash(text), F.lit(1 << 30)).cast("decimal(38,0)")).cast("decimal(38,0)")


def _again() -> Column:
    """Whether a row repeats another one of its number."""
    return F.row_number().over(Window.partitionBy("_row").orderBy("_row")) > 1


def _decided(docs: DataFrame, edits: int = EDITS, least: int | None = None) -> DataFrame:
    """decisions, with the rows' numbers and whether they repeat another row."""
    wide = F.lit(1 << 31).cast("decimal(38,0)")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row(F.col("doc_id"), F.col("text")).alias("_row"))
    every = lines_of(rows, "_row").select("line", (F.col("_row") * wide + F.col("line_no")).cast("decimal(38,0)").alias("place"))
    first = every.groupBy("line").agg(F.min("place").alias("place"))
    distinct = stored(first.withColumn("id", F.monotonically_increasing_id()).withColumn("n", F.length("line")), "lines", "zstd")
    near = similar_lines(distinct, edits, least)
    where = distinct.select("id", "place")
    ordered = near.join(where.select(F.col("id").alias("x"), F.col("place").alias("px")), "x").join(where.select(F.col("id").alias("y"), F.col("place").alias("py")), "y")
    later = ordered.select(F.when(F.col("px") < F.col("py"), F.col("y")).otherwise(F.col("x")).alias("id")).distinct()
    firsts = where.join(later.withColumn("near", F.lit(True)), "id", "left").select(F.floor(F.col("place") / wide).cast("decimal(38,0)").alias("_row"), F.pmod("place", wide).cast("int").alias("line_no"), F.coalesce("near", F.lit(False)).alias("near"))
    by_row = firsts.groupBy("_row").agg(F.count("*").alias("n_first"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("line_no")))).alias("kept"))
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    sizes = rows.select("doc_id", "_row", F.greatest(F.coalesce(F.size(filled), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    out = sizes.join(by_row, "_row", "left").withColumn("_again", _again())
    own = lambda c, none: F.when(F.col("_again"), none).otherwise(F.coalesce(c, none))
    none = F.array().cast("array<int>")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - own("n_first", F.lit(0))).alias("n_exact"), own("n_near", F.lit(0)).alias("n_near"), own("kept", none).alias("kept"), "_row", "_again")


def decisions(docs: DataFrame, edits: int = EDITS, least: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_exact, n_near, kept) of each row: line numbers that stay, and how many go.

    The order of lines is that of (doc_id, line number), rows with a null doc_id last; rows that share a
    doc_id, or have none, stand in the order of a hash of their texts. A line goes as an exact copy if
    the same line (less white space around it) stands earlier anywhere, and as a near copy if it is
    the first of its kind but an earlier line is within `edits` edits of it. Blank lines and null texts
    have no lines. All lines of a row that repeats another in doc_id and text are exact copies.
    """
    return _decided(docs, edits, least).drop("_row", "_again")


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int | None = None) -> DataFrame:
    """docs' own columns with only the lines that stay, and blank lines; null texts stay null."""
    held = _decided(docs, edits, least).where("not _again").select("_row", F.col("kept").alias("_kept"))
    lines = F.split("text", "\n")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\A[\t-\r ]*\z"), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    text = F.array_join(F.transform(F.array_sort(F.array_union(F.when(F.col("_again"), none).otherwise(F.coalesce("_kept", none)), blank)), lambda i: F.get(lines, i)), "\n")
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), "text", _row(F.col("doc_id"), F.col("text")).alias("_row"))
    made = every.join(held, "_row", "left").withColumn("_again", _again()).withColumn("_text", F.when(F.col("text").isNotNull(), text))
    return made.select(*[F.col("_text").alias("text") if c == "text" else F.col(f"_all.`{c}`") for c in docs.columns])
