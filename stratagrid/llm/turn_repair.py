"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by a recursive query.

Conversations are dealt into batches by a hash, and in each batch one DuckDB recursive query advances all of them by one
turn a step. For each state of the grammar it keeps the least cost, and of the audits with that cost the
ASCII-least. That is exact: two audits of one cost that have used up the same turns are never one the beginning of the
other (letters but I stand for turns, in order, and an I more costs more), so whatever follows leaves their order.

A conversation is cut where its turns pass a multiple of SPAN. Most have one segment and are done in their batch.
Of the others each segment is first solved from every state in a batch of its own; the same recursion then
advances by one segment a step, and the segments are repaired with the edits found, so no task holds a long
conversation's texts. Only their digest, which is sequential, is fed by one task, segment after segment.
"""

from __future__ import annotations

import hashlib

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written

#: Turns of a segment, and bytes of texts in a batch, about.
SPAN, BATCH = 256, 8 << 20

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What may be inserted before a turn, each letter for 5.
_OPENINGS = "(VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) AS o(origin, mid, put)"
#: What can be done with a turn: by its initial (null: any), from a state to a state, at a cost.
_EDITS = """(VALUES ('s', 0, 1, 'K', 0), ('u', 0, 2, 'K', 0), ('u', 1, 2, 'K', 0), ('u', 3, 2, 'K', 0), ('a', 2, 3, 'K', 0),
    (NULL, 0, 2, 'R', 1), (NULL, 1, 2, 'R', 1), (NULL, 3, 2, 'R', 1), (NULL, 2, 3, 'R', 1),
    (NULL, 0, 0, 'D', 2), (NULL, 1, 1, 'D', 2), (NULL, 2, 2, 'D', 2), (NULL, 3, 3, 'D', 2)) AS e(initial, mid, target, letter, price)"""
#: What ends a conversation in each state.
_ENDINGS = "(VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) AS z(state, put)"

_MOVES = f"""
CREATE TABLE moves AS SELECT c.initial, fault, origin, target, min({{'cost': price + 5 * len(put) + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': put || letter}}) AS least
FROM (VALUES ('s'), ('u'), ('a'), ('-')) AS c(initial), (VALUES ('none'), ('blank'), ('duplicate'), ('truncated')) AS f(fault), {_OPENINGS}, {_EDITS}
WHERE o.mid = e.mid AND (e.initial IS NULL OR e.initial = c.initial) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) GROUP BY ALL"""

#: The turns of a batch in order, each with its first fault; g is the segment, k the place in it.
_TURNS = r"""
CREATE TABLE turns AS SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen OR row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY g ORDER BY k) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id, segment) AS g, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM batch)"""

_FAULTS = """
CREATE TABLE faults AS SELECT g, any_value(conv_id) AS conv_id, any_value(segment) AS segment, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (coalesce(illegal, false)) AS illegal,
    arg_min(left(role, 1), k) AS opens, arg_max(left(role, 1), k) AS closes FROM turns GROUP BY g"""

#: One step advances every segment by a turn; what is kept under a key is the latest.
_BEST = """
CREATE TABLE best AS WITH RECURSIVE b(g, start, state, k, least) USING KEY (g, start, state) AS (
    SELECT g, start, start, CAST(0 AS BIGINT), {'cost': 0, 'audit': ''} FROM faults, (VALUES %s) AS s(start)
    UNION SELECT b.g, b.start, m.target, b.k + 1, min({'cost': b.least.cost + m.least.cost, 'audit': b.least.audit || m.least.audit})
    FROM b JOIN turns t ON t.g = b.g AND t.k = b.k JOIN moves m ON m.initial = t.initial AND m.fault = t.fault AND m.origin = b.state GROUP BY b.g, b.start, m.target, b.k)
SELECT b.* FROM b JOIN faults USING (g) WHERE b.k = n"""

_CHOSEN = f"""
CREATE TABLE chosen AS SELECT g, any_value(start) AS start, min({{'cost': least.cost + 5 * len(put), 'audit': least.audit || put}}) AS least
FROM best JOIN {_ENDINGS} USING (state) GROUP BY g"""

#: The repaired lines of each segment: roles alternate, from what the state before the segment asks for.
_REPAIRED = r"""
WITH l AS (SELECT g, start, unnest(string_split(least.audit, '')) AS letter, unnest(range(1, len(least.audit) + 1)) AS j FROM chosen WHERE least.audit <> ''),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY g ORDER BY j) - 1 AS k FROM l),
o AS (SELECT p.*, role, text, initial, row_number() OVER (PARTITION BY p.g ORDER BY j) AS place FROM p LEFT JOIN turns t ON t.g = p.g AND t.k = p.k AND letter <> 'I' WHERE letter <> 'D'),
h AS (SELECT *, max(CASE WHEN place = 1 AND start = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY g) AS head FROM o)
SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - head + CASE WHEN start = 2 THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS repaired
FROM h GROUP BY g"""

#: Segments of a conversation in order: one step advances by a segment, with the edits of each kept apart.
_JOINED = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, dense_rank() OVER (PARTITION BY conv_id ORDER BY segment) - 1 AS k FROM batch),
n AS MATERIALIZED (SELECT c, k, any_value(conv_id) AS conv_id, any_value(segment) AS segment, any_value(blank) AS blank, any_value(duplicate) AS duplicate, any_value(truncated) AS truncated,
    any_value(illegal) + CASE WHEN lag(any_value(closes)) OVER (PARTITION BY c ORDER BY k) || any_value(opens) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM s GROUP BY c, k),
a AS MATERIALIZED (SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, list(segment ORDER BY k) AS segments, sum(blank)::BIGINT AS blank, sum(duplicate)::BIGINT AS duplicate,
    sum(truncated)::BIGINT AS truncated, sum(illegal)::BIGINT AS illegal FROM n GROUP BY c),
b(c, state, k, least) USING KEY (c, state) AS (
    SELECT c, 0, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'audit': '', 'starts': CAST([] AS INT[]), 'audits': CAST([] AS VARCHAR[])}} FROM a
    UNION SELECT b.c, s.state, b.k + 1, min({{'cost': b.least.cost + s.cost, 'audit': b.least.audit || s.audit, 'starts': list_append(b.least.starts, b.state), 'audits': list_append(b.least.audits, s.audit)}})
    FROM b JOIN s ON s.c = b.c AND s.k = b.k AND s.start = b.state GROUP BY b.c, s.state, b.k),
e AS (SELECT c, min({{'cost': least.cost + 5 * len(put), 'audit': least.audit || put, 'starts': least.starts, 'audits': list_append(least.audits[:-2], least.audits[-1] || put)}}) AS least
    FROM b JOIN a USING (c) JOIN {_ENDINGS} USING (state) WHERE b.k = n GROUP BY c)
SELECT conv_id, blank, duplicate, truncated, illegal, least.cost AS cost, least.audit AS audit, segments, least.starts AS starts, least.audits AS audits FROM a JOIN e USING (c)"""

_COUNTS = "blank long, duplicate long, truncated long, illegal long"
_WHOLE = f"conv_id long, {_COUNTS}, cost long, audit string, repaired string"
_SEGMENTS = f"conv_id long, segment long, {_COUNTS}, opens string, closes string, start int, state int, cost long, audit string"
_CHOICES = f"conv_id long, {_COUNTS}, cost long, audit string, segments array<long>, starts array<int>, audits array<string>"
_PARTS = "conv_id long, segment long, repaired string"


def _query(batch: pa.Table, steps: list[str], last: str, ddl: str) -> pa.Table:
    """Statements on a batch in a database of its own, in memory; the rows of the last one."""
    schema = arrow_schema(ddl)
    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB"}) as db:
        db.register("batch", batch)
        for s in steps:
            db.execute(s)
        return db.sql(last).to_arrow_table().select(schema.names).cast(schema)


def _solve_whole(batch: pa.Table) -> pa.Table:
    return _query(batch, [_MOVES, _TURNS, _FAULTS, _BEST % "(0)", _CHOSEN, f"CREATE TABLE repaired AS {_REPAIRED}"],
                  "SELECT f.*, least.cost AS cost, least.audit AS audit, coalesce(repaired, '') AS repaired FROM faults f JOIN chosen USING (g) LEFT JOIN repaired USING (g)", _WHOLE)


def _solve_segments(batch: pa.Table) -> pa.Table:
    return _query(batch, [_MOVES, _TURNS, _FAULTS, _BEST % "(0), (1), (2), (3)"], "SELECT f.*, start, state, least.cost AS cost, least.audit AS audit FROM faults f JOIN best USING (g)", _SEGMENTS)


def _join_segments(batch: pa.Table) -> pa.Table:
    return _query(batch, [], _JOINED, _CHOICES)


def _repair_segments(batch: pa.Table) -> pa.Table:
    chosen = "CREATE TABLE chosen AS SELECT g, any_value(start) AS start, {'audit': any_value(audit)} AS least FROM turns GROUP BY g"
    return _query(batch, [_TURNS, chosen, f"CREATE TABLE repaired AS {_REPAIRED}"], "SELECT DISTINCT conv_id, segment, repaired FROM turns JOIN repaired USING (g)", _PARTS)


def _digests(parts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of segments' lines, fed to the digest in order; a task holds one batch of them."""
    schema = arrow_schema("conv_id long, repaired_sha256 string")

    def run(batches):
        now, digest = None, None
        for batch in batches:
            ids, out = batch.column("conv_id").to_pylist(), []
            for conv_id, lines in zip(ids, batch.column("repaired"), strict=True):
                if digest is None or conv_id != now:
                    out += [] if digest is None else [(now, digest.hexdigest())]
                    now, digest = conv_id, hashlib.sha256(lines.as_py().encode())
                else:
                    digest.update(b"\n" + lines.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()], pa.string())], schema=schema)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return ordered.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _batches(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """rows with the number of their batch, by a hash of the keys; total: their bytes."""
    return rows.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-total // BATCH)))))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` mod 20: 0 drops a turn, 1 empties its
    text, 2 removes its `.!?`, 3 repeats it, 4 gives it the role user. Nulls count as one space, also in
    the digest; conv_id and turn themselves stay null. Rows of one id and turn share their fault."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("col")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["conv_id"])


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of turns(conv_id, turn, role, text), or for each conv_id of ids: faults, cheapest edits, digest.

    A turn's first fault counts: blank (only white space), duplicate (role and text seen earlier in the conversation),
    truncated (its last sign is not `.`, `!` or `?`). Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of
    an empty user or assistant turn 5; blank and duplicate turns must go, a truncated one that stays costs 5 more.
    audit has the edits' initials; repaired_sha256 is of the repaired `role:text` lines.
    Turns are taken by number, nulls first; ties by role, then text. Null roles and texts count as one space. A null conv_id is
    a conversation. gaps counts missing numbers between the least and the largest, 0 without any. An id without
    turns has zeros, an empty audit and the digest of nothing. An empty table gives no rows. Other columns are not
    read. Turns of one conversation whose numbers lie in the same SPAN are one task's; texts of any length are read whole."""
    segment = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(1 << 62)))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), segment.alias("segment"))
    ids = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    # distinct turns first, so that a conversation of very many turns is summed in parts
    spans = rows.groupBy("conv_id", "turn", "segment").count().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), (F.min("segment") < F.max("segment")).alias("long"))
    spans = written(spans, "spans")
    long = spans.where("long").select("conv_id")
    of = _same(rows, long)
    whole = _batches(rows.join(long, of, "left_anti").withColumn("seen", F.lit(False)), total, "conv_id")
    solved = written(whole.groupBy("batch").applyInArrow(_solve_whole, _WHOLE), "repaired")
    told = solved.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")
    if long.take(1):
        told = told.unionByName(_repair_long(rows.join(long, of, "left_semi"), total))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    known = ids.join(spans.drop("long").withColumnRenamed("conv_id", "its"), F.col("conv_id").eqNullSafe(F.col("its")), "left").drop("its")
    known = known.join(told.withColumnRenamed("conv_id", "its"), F.col("conv_id").eqNullSafe(F.col("its")), "left")
    return known.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _repair_long(rows: DataFrame, total: int) -> DataFrame:
    """Conversations of several segments."""
    rows = rows.withColumn("name", F.md5(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text").cast("binary")))
    # a role and text of an earlier segment makes all of its later ones duplicates
    across = rows.groupBy("conv_id", "name").agg(F.min("segment").alias("from"), F.max("segment").alias("to")).where("from < to").drop("to").withColumnsRenamed({"conv_id": "its", "name": "same"})
    rows = rows.join(across, rows["conv_id"].eqNullSafe(across["its"]) & (rows["name"] == across["same"]), "left")
    rows = written(rows.withColumn("seen", F.coalesce(F.col("from") < F.col("segment"), F.lit(False))).drop("its", "same", "from", "name"), "long-turns")
    parts = written(_batches(rows, total, "conv_id", "segment").groupBy("batch").applyInArrow(_solve_segments, _SEGMENTS), "segments")
    chosen = written(_batches(parts, total, "conv_id").groupBy("batch").applyInArrow(_join_segments, _CHOICES), "choices")
    slices = chosen.select(F.col("conv_id").alias("its"), F.explode(F.arrays_zip("segments", "starts", "audits")).alias("s")).select("its", F.col("s.segments").alias("of"), F.col("s.starts").alias("start"), F.col("s.audits").alias("audit"))
    edited = rows.join(slices, rows["conv_id"].eqNullSafe(slices["its"]) & (rows["segment"] == slices["of"])).drop("its", "of")
    lines = written(_batches(edited, total, "conv_id", "segment").groupBy("batch").applyInArrow(_repair_segments, _PARTS), "lines")
    digests = _digests(lines).withColumnRenamed("conv_id", "its")
    # a conversation that loses all its turns has no line
    told = chosen.drop("segments", "starts", "audits").join(digests, F.col("conv_id").eqNullSafe(F.col("its")), "left").drop("its")
    return told.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
