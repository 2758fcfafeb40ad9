"""Conversation repair: the cheapest edits that turn a conversation's roles into an optional system turn and user-assistant pairs.

Conversations are dealt to batches by a hash of their id. In a batch, one recursive DuckDB query advances a turn of all
its conversations at a time and keeps the least (cost, audit) of each state of the grammar. A conversation that is
too long for a batch is cut into blocks of its sorted rows; the query then starts in each state, and a pass in order
over the blocks of a conversation joins them.

Rows are (conv_id, turn, role, text) in order of turn, null first; ties are ordered by role, the first 200 characters of the text, then its
SHA-256. A null role or text is one space, a null conv_id is a conversation like others, repeated rows are duplicates, other columns are
ignored. No rows give no rows.

States: 0 nothing yet, 1 after the system turn, 2 after a user's turn, 3 after an assistant's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, stored

#: Rows and bytes of text of a batch, about, and those from which a conversation is cut into blocks.
BATCH_ROWS, BATCH_CHARS = 8192, 8 << 20
LONG_ROWS, LONG_CHARS = 1024, 4 << 20
#: Most rows of a block of a long conversation; a block is within one Arrow batch too.
BLOCK_ROWS = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "array<struct<role:string,text:string>>"

#: A path's cost and edits so far; null: the state can't be reached. Structs compare by cost, then edits.
_MACROS = f"""
create temp macro plus(v, cost, edit) as case when v is not null then {{'c': v.c + cost, 'a': v.a || edit}} end;
create temp macro user_next(v0, v1, v2, v3) as list_min([v2, plus(list_min([v0, v1, v3]), {INSERT}, 'I')]);
create temp macro reply_next(v2, v3) as list_min([v3, plus(v2, {INSERT}, 'I')]);
"""
#: rows: (c, i, h, must, late): conversation, place from 0, first letter of the role, must be deleted, costs more if it stays. starts: (s) states.
_SOLVE = f"""
with recursive v(c, s, i, v0, v1, v2, v3) as (
  select c, s, cast(0 as bigint), case when s = 0 then z end, case when s = 1 then z end, case when s = 2 then z end, case when s = 3 then z end
  from (select distinct c from rows), starts, (select {{'c': cast(0 as bigint), 'a': ''}} as z)
  union all
  select c, s, i + 1, plus(v0, {DELETE}, 'D'),
    list_min([plus(v1, {DELETE}, 'D'), case when not must and h = 's' then plus(v0, {KEEP} + late, 'K') end]),
    list_min([plus(w2, {DELETE}, 'D'), case when not must then plus(list_min([v0, v1, w3]), late + case when h = 'u' then {KEEP} else {REROLE} end, case when h = 'u' then 'K' else 'R' end) end]),
    list_min([plus(w3, {DELETE}, 'D'), case when not must then plus(w2, late + case when h = 'a' then {KEEP} else {REROLE} end, case when h = 'a' then 'K' else 'R' end) end])
  from (select *, reply_next(w2, v3) as w3 from (select *, user_next(v0, v1, v2, v3) as w2 from v)) join rows using (c, i)
)
select c, s, v0, v1, v2, v3, list_min([v0, reply_next(user_next(v0, v1, v2, v3), v3)]) as best from v join (select c, count(*) as i from rows group by c) using (c, i) order by c, s
"""
#: Rows of whole conversations in order, with their faults; t: (conv_id, turn, role, text, blank, ended).
_ORDERED = """
create temp table whole as
select *, not blank and row_number() over (partition by c, role, text order by i) > 1 as duplicate from (
  select *, dense_rank() over (order by conv_id nulls first) - 1 as c, row_number() over (partition by conv_id order by turn nulls first, role, left(text, 200), sha256(text)) - 1 as i from t)
"""
_ROWS = "create temp table rows as select c, i, substr(role, 1, 1) as h, blank or duplicate as must, case when blank or duplicate or ended then 0 else {late} end as late from whole"
_FAULTS = """
select c, count(*) as n, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (not blank and not duplicate and not ended) as truncated,
  count(*) filter (i > 0 and pair not in ('su', 'ua', 'au')) as illegal, {more} from (select *, lag(substr(role, 1, 1)) over (partition by c order by i) || substr(role, 1, 1) as pair from whole) group by c order by c
"""


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows with faults put in by crc32(conv_id:turn) % 20: 0 drops one, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 makes it a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    made = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), what.alias("_w")).where("_w <> 0")
    text = F.when(F.col("_w") == 1, "").when(F.col("_w") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_w") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_w") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with blank (white space alone) and ended (its last other character ends a sentence)."""
    held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return held.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "ended": F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})


def edited(roles: list[str], texts: list[str], audit: str, state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The turns that edits leave of a conversation, or of a block of it that is met in a state, and the state after them."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = roles[i] if edit == "K" else "assistant" if state == 2 else "user"
        out.append((role, "" if edit == "I" else texts[i]))
        i += edit != "I"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
    return out, state


def _lines(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


def _connect(t: pa.Table, ordered: str, starts: list[int]):  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    con.register("t", t)
    con.execute(_MACROS + ordered + ";" + _ROWS.format(late=TRUNCATED) + f"; create temp table starts as select unnest({starts}) as s")
    return con


def _batch(t: pa.Table, keep_turns: bool) -> dict[str, list]:
    """Results of the whole conversations of a batch."""
    con = _connect(t, _ORDERED, [0])
    try:
        gaps = "any_value(conv_id) as conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps"
        out = con.sql(_FAULTS.format(more=gaps)).to_arrow_table().to_pydict()
        best = [x["best"] for x in con.sql(_SOLVE).to_arrow_table().to_pylist()]
        roles, texts = zip(*con.execute("select role, text from whole order by c, i").fetchall(), strict=True)
    finally:
        con.close()
    turns, lo = [], 0
    for n, b in zip(out["n"], best, strict=True):
        turns.append(edited(roles[lo : lo + n], texts[lo : lo + n], b["a"])[0])
        lo += n
    out |= {"cost": [b["c"] for b in best], "audit": [b["a"] for b in best], "repaired_sha256": [hashlib.sha256(_lines(x)).hexdigest() for x in turns]}
    if keep_turns:
        out["turns"] = [[{"role": a, "text": b} for a, b in x] for x in turns]
    return out


def _short(rows: DataFrame, n_batches: int, keep_turns: bool) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_COUNTS}" + f", turns {_TURNS}" * keep_turns
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(t: pa.Table) -> pa.Table:
        held = _batch(t, keep_turns)
        return pa.table([pa.array(held[f.name], f.type) for f in arrow], schema=arrow)

    return rows.withColumn("_b", F.pmod(F.xxhash64("conv_id"), F.lit(n_batches))).groupBy("_b").applyInArrow(run, schema)


def _blocks(ordered: DataFrame) -> DataFrame:
    """(conv_id, pos, n, blank, duplicate, truncated, illegal, first, last, costs, audits, roles, texts) of blocks of sorted rows: costs and audits of start state * 4 + end state, null if it can't be reached."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, pos long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
    arrow = to_arrow_schema(ordered.sparkSession.createDataFrame([], schema).schema)
    numbered = "create temp table whole as select *, row_number() over (partition by c order by pos) - 1 as i from (select *, dense_rank() over (order by conv_id nulls first) - 1 as c from t)"
    more = "any_value(conv_id) as conv_id, min(pos) as pos, first(substr(role, 1, 1) order by i) as first, last(substr(role, 1, 1) order by i) as last, list(role order by i) as roles, list(text order by i) as texts"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                con = _connect(pa.Table.from_batches([batch.slice(lo, BLOCK_ROWS)]), numbered, [0, 1, 2, 3])
                try:
                    out = con.sql(_FAULTS.format(more=more)).to_arrow_table().to_pydict()
                    ends = con.sql(_SOLVE).to_arrow_table().to_pylist()
                finally:
                    con.close()
                cells = [[x[f"v{e}"] for x in ends[k : k + 4] for e in range(4)] for k in range(0, len(ends), 4)]
                out |= {"costs": [[x and x["c"] for x in m] for m in cells], "audits": [[x and x["a"] for x in m] for m in cells]}
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return ordered.mapInArrow(run, schema)


class _Fold:
    """A conversation's blocks, joined in order: the least (cost, edits) of each state with the digest of what they leave."""

    def __init__(self, keep_turns: bool):
        self.best = {0: (0, "", hashlib.sha256(), True, ())}  # cost, edits, digest, nothing left so far, turns
        self.counts, self.last, self.keep_turns = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), "", keep_turns

    def _left(self, held: tuple, cost: int, edits: str, roles: list[str], texts: list[str], state: int) -> tuple:
        turns, _ = edited(roles, texts, edits, state)
        digest, empty = held[2], held[3]
        if turns:
            digest, empty = digest.copy(), False
            digest.update(b"\n" * (not held[3]) + _lines(turns))
        return cost, held[1] + edits, digest, empty, (*held[4], turns) if self.keep_turns else ()

    def add(self, b: dict) -> None:
        ways: dict[int, tuple] = {}
        for s, held in self.best.items():
            for e in range(4):
                if b["costs"][4 * s + e] is not None:
                    way = (held[0] + b["costs"][4 * s + e], held[1] + b["audits"][4 * s + e], s)
                    ways[e] = min(ways.get(e, way), way)
        self.best = {e: self._left(self.best[s], cost, b["audits"][4 * s + e], b["roles"], b["texts"], s) for e, (cost, _, s) in ways.items()}
        for k in self.counts:
            self.counts[k] += b[k]
        self.counts["illegal"] += bool(self.last) and self.last + b["first"] not in ("su", "ua", "au")
        self.last = b["last"] or " "

    def end(self) -> dict:
        ways = []
        for s, held in self.best.items():
            more = {0: "", 1: "II", 2: "I", 3: ""}[s]
            ways.append(self._left(held, held[0] + INSERT * len(more), more, [], [], s))
        cost, audit, digest, _, turns = min(ways, key=lambda x: x[:2])
        out = self.counts | {"cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}
        return out | ({"turns": [{"role": a, "text": b} for part in turns for a, b in part]} if self.keep_turns else {})


def _long(rows: DataFrame, keep_turns: bool) -> DataFrame:
    """Results of long conversations, whose rows are range-sorted over all partitions; first occurrences are found by grouping."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    held = stored(rows.withColumns({"_d": F.sha2("text", 256), "_id": F.monotonically_increasing_id()}), "turns")
    firsts = held.groupBy("conv_id", "role", "_d").agg(F.min(F.struct("turn", "_id"))["_id"].alias("_first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_d").alias("_k"), "_first")
    marked = held.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_d") == F.col("_k"))).withColumn("duplicate", ~F.col("blank") & (F.col("_id") != F.col("_first")))
    by = ["conv_id", "turn", "role", F.substring("text", 1, 200), "_d", "_id"]
    ordered = marked.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "role", "text", "blank", "ended", "duplicate", F.monotonically_increasing_id().alias("pos"))
    blocks = stored(_blocks(ordered), "blocks").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = f"conv_id {kind}, {_COUNTS.replace('gaps long, ', '')}" + f", turns {_TURNS}" * keep_turns
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        made = lambda: pa.RecordBatch.from_pylist([fold.end() | {"conv_id": now}], schema=arrow)
        for batch in it:
            for b in batch.to_pylist():
                if fold is not None and b["conv_id"] != now:
                    yield made()
                    fold = None
                if fold is None:
                    now, fold = b["conv_id"], _Fold(keep_turns)
                fold.add(b)
        if fold is not None:
            yield made()

    turns = held.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "_c")
    out = blocks.mapInArrow(join, schema).join(turns, F.col("conv_id").eqNullSafe(F.col("_c")))
    return out.select("conv_id", "gaps", *[c for c in out.columns if c not in ("conv_id", "gaps", "_c")])


def repaired(rows: DataFrame, keep_turns: bool = False, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations that have rows.

    keep_turns adds turns, the repaired conversation. Edits: K keeps a turn, R makes it a user's or assistant's, D deletes it,
    I inserts one without text; blank and repeated turns must go, one that breaks off costs more where it stays.
    """
    bounded_batches(rows.sparkSession)
    rows = with_faults(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    is_long = (F.col("n") > long_rows) | (F.col("chars") > long_chars)
    total = sizes.agg(F.sum(F.when(~is_long, F.col("n"))).alias("n"), F.sum(F.when(~is_long, F.col("chars"))).alias("chars"), F.count_if(is_long).alias("long")).first()
    n_batches = max(1, -(-(total["n"] or 0) // BATCH_ROWS), -(-(total["chars"] or 0) // BATCH_CHARS))
    if not total["long"]:
        return _short(rows, n_batches, keep_turns)
    ids = sizes.where(is_long).select(F.col("conv_id").alias("_c"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    return _short(rows.join(ids, same, "left_anti"), n_batches, keep_turns).union(_long(rows.join(ids, same, "left_semi"), keep_turns))
