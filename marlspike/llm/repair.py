"""Conversation structure repair by a min-plus matrix scan.

Roles of a sound conversation have the initials `(s?(ua)+)?`, an automaton of four states: nothing yet, after s, after u
and after a (the first and the last accept). What may be done with one turn is a 4x4 matrix over (cost, audit) elements:
its entry (i, j) is the cheapest way from state i to state j, turns inserted before it included (the closure), and the
letters of the edits: K keep, R give another role, D delete, I insert. Sums take the least cost, then the ASCII-least
audit; products add costs and join audits. Audits with the same ends and cost are never beginnings of each other, so the
product keeps the order and is associative: a conversation is the product of its turns in any bracketing.

Turns are sorted by range over the cluster and numbered without gaps. Units of UNIT neighbouring numbers are reduced as
trees in one task each, then FAN neighbouring units at a time, until each conversation is one matrix; going down again
gives each unit the states that it leads from and to, and each turn its edit. So one conversation may hold any share of all
turns. Its audit is one value, and a task holds up to 16 times its length; a digest of all its text in order is one task's
stream by nature.

Turns of a conversation are in the order of `turn` (nulls first), then role, then the text's SHA-256; equal rows are
adjacent, and which of them is first makes no difference. Null roles and texts count as one space. Rows without conv_id
are a conversation of their own. Faults: blank (nothing but ASCII white space), duplicate (role and text stood earlier),
truncated (the last other character is none of `.!?`); a turn counts for its first. An empty table gives no rows. Columns
beside conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table

#: Turns that one leaf task reduces; units that one task joins.
UNIT, FAN = 1024, 64
RETYPE, REMOVE, INSERT, CUT_OFF = 2, 3, 2, 1
STATES = 4
#: Where a role's initial leads from each state.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTS = (0, 3)
#: A turn's code: its role's initial (o: any other), in upper case if truncated; x if it must go.
MUST_GO = "x"
REMEMBER = 200_000
SOLID = r"[^\x20\x09-\x0D]"


# --- The algebra ---


def product(a: list, b: list) -> list:
    """Min-plus product of two matrices of (cost, audit), stored by rows; None: no way."""
    out = []
    for i in range(0, STATES * STATES, STATES):
        for j in range(STATES):
            best = None
            for k in range(STATES):
                if (x := a[i + k]) is not None and (y := b[STATES * k + j]) is not None:
                    one = (x[0] + y[0], x[1] + y[1])
                    if best is None or one < best:
                        best = one
            out.append(best)
    return out


def single(moves: dict[tuple[int, int], tuple[int, str]]) -> list:
    return [moves.get((i, j)) for i in range(STATES) for j in range(STATES)]


def closure() -> list:
    """Any number of inserted turns: the identity, one insertion, and two where two lead to a new state."""
    one = single({(i, j): (INSERT, "I") for r in "ua" for i, j in STEP[r].items()})
    here = single({(i, i): (0, "") for i in range(STATES)})
    reach = [min((x for x in xs if x is not None), default=None) for xs in zip(here, one)]
    return product(reach, reach)


def edits(code: str) -> list:
    """One turn's own edits."""
    moves = {(i, i): (REMOVE, "D") for i in range(STATES)}
    if code != MUST_GO:
        worse, initial = CUT_OFF * code.isupper(), code.lower()
        some = [((i, j), (RETYPE + worse, "R")) for r in "ua" for i, j in STEP[r].items()]
        some += [((i, j), (worse, "K")) for i, j in STEP.get(initial, {}).items()]
        for at, way in some:
            moves[at] = min(way, moves.get(at, way))
    return single(moves)


class Scan:
    """Tree reduction of turns' matrices; products of short stretches are remembered (as many as REMEMBER)."""

    def __init__(self):
        self.inserted = closure()
        self.leaf = {c: product(self.inserted, edits(c)) for c in "suaoSUAO" + MUST_GO}
        self.known: dict[str, list] = {}

    def turns(self, codes: str) -> list:
        """The product of a stretch's matrices."""
        if len(codes) == 1:
            return self.leaf[codes]
        if codes in self.known:
            return self.known[codes]
        half = 1 << ((len(codes) - 1).bit_length() - 1)
        out = product(self.turns(codes[:half]), self.turns(codes[half:]))
        if len(codes) <= 16:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[codes] = out
        return out

    @staticmethod
    def together(parts: list[list]) -> list:
        """The product of neighbouring matrices, as a tree."""
        while len(parts) > 1:
            parts = [product(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def ending(self, whole: list) -> tuple[int, str, int, str]:
        """Cost, audit, the state before the last insertions, and those insertions of the best way to an accepting state."""
        ways = ((x[0] + y[0], x[1] + y[1], k, y[1]) for k in range(STATES) for t in ACCEPTS if (x := whole[k]) is not None and (y := self.inserted[STATES * k + t]) is not None)
        return min(ways)

    @staticmethod
    def through(parts: list[list], enter: int, leave: int) -> list[tuple[int, int]]:
        """The states that the best way from enter to leave has before and after each part."""
        row, rows = [None] * STATES, []
        row[enter] = (0, "")
        for m in parts:
            rows.append(row)
            row = [min(((row[k][0] + x[0], row[k][1] + x[1]) for k in range(STATES) if row[k] is not None and (x := m[STATES * k + j]) is not None), default=None) for j in range(STATES)]
        want, out = row[leave], []
        for before, m in zip(rows[::-1], parts[::-1]):
            k = next(k for k in range(STATES) if before[k] is not None and (x := m[STATES * k + leave]) is not None and (before[k][0] + x[0], before[k][1] + x[1]) == want)
            out.append((k, leave))
            want, leave = before[k], k
        return out[::-1]


def spelled(audit: str, codes: str, state: int) -> list[tuple[str, list[str], str | None, list[str]]]:
    """For each turn: its letter, the roles inserted before it, its new role ('' : its own; None: deleted), those inserted after."""
    out, before, k = [], [], 0
    for letter in audit:
        if letter == "I":
            role = "assistant" if state == 2 else "user"
            state = STEP[role[0]][state]
            (before if k < len(codes) else out[-1][3]).append(role)
            continue
        role = None
        if letter == "K":
            role, state = "", STEP[codes[k].lower()][state]
        elif letter == "R":
            role = "assistant" if state == 2 else "user"
            state = STEP[role[0]][state]
        out.append((letter, before, role, []))
        before, k = [], k + 1
    return out


# --- Tables ---

UNIT_SCHEMA = "conv_id long, unit long, cost array<long>, audit array<string>"


def _columns(matrix: list) -> tuple[list, list]:
    return [None if x is None else x[0] for x in matrix], [None if x is None else x[1] for x in matrix]


def _matrix(cost: list, audit: list) -> list:
    return [None if c is None else (c, a) for c, a in zip(cost, audit)]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def _reduced(batches):
    """conv_id, unit, codes -> UNIT_SCHEMA."""
    scan = Scan()
    for batch in batches:
        rows = [(c, u, *_columns(scan.turns(codes))) for c, u, codes in zip(*(x.to_pylist() for x in batch.columns))]
        yield _batch(rows, ["conv_id", "unit", "cost", "audit"], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())])


def _together(batches):
    """conv_id, unit, parts (unit, cost, audit in order) -> UNIT_SCHEMA."""
    for batch in batches:
        rows = [(c, u, *_columns(Scan.together([_matrix(p["cost"], p["audit"]) for p in parts]))) for c, u, parts in zip(*(x.to_pylist() for x in batch.columns))]
        yield _batch(rows, ["conv_id", "unit", "cost", "audit"], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())])


def _ended(batches):
    """UNIT_SCHEMA of whole conversations -> their way."""
    scan = Scan()
    for batch in batches:
        rows = [(c, u, *scan.ending(_matrix(cost, audit))) for c, u, cost, audit in zip(*(x.to_pylist() for x in batch.columns))]
        rows = [(c, u, 0, leave, cost, audit, tail) for c, u, cost, audit, leave, tail in rows]
        yield _batch(rows, ["conv_id", "unit", "enter", "leave", "cost", "audit", "tail"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()])


WAY_SCHEMA = "conv_id long, unit long, enter int, leave int, tail string"


def _descended(batches):
    """conv_id, parts, enter, leave, tail -> WAY_SCHEMA of the parts; the tail goes to the last."""
    for batch in batches:
        rows = []
        for c, parts, enter, leave, tail in zip(*(x.to_pylist() for x in batch.columns)):
            ways = Scan.through([_matrix(p["cost"], p["audit"]) for p in parts], enter, leave)
            rows += [(c, p["unit"], i, j, tail if p is parts[-1] else "") for p, (i, j) in zip(parts, ways)]
        yield _batch(rows, ["conv_id", "unit", "enter", "leave", "tail"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()])


def _spelled(batches):
    """at, codes, enter, leave, tail -> one row a turn."""
    scan, names = Scan(), ["at", "edit", "before", "role_now", "after"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for at, codes, enter, leave, tail in zip(*(x.to_pylist() for x in batch.columns)):
            audit = scan.turns(codes)[STATES * enter + leave][1]
            rows += [(p, *x) for p, x in zip(at, spelled(audit + tail, codes, enter))]
            if len(rows) > 50_000:
                yield _batch(rows, names, kinds)
                rows = []
        yield _batch(rows, names, kinds)


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, initial, blank, cut_off and `at`: numbers without gaps in the order of conversations and turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    slim = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_spread"))
    slim = slim.select(
        "*", F.sha2("text", 256).alias("digest"), F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(SOLID)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "_spread"]  # the last splits equal rows, in whatever way
    sorted_rows = slim.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_spread")
    held = keep(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "turns")
    part = F.shiftrightunsigned("_id", 33)
    counts = sorted((r.part, r.n) for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a partition
    first, total = {}, 0
    for p, k in counts:
        first[p], total = total - (p << 33), total + k
    if not first:
        return held.withColumn("at", F.col("_id")).drop("_id")
    shift = held.sparkSession.createDataFrame([(p, s) for p, s in first.items()], "_part long, _shift long")
    return held.join(F.broadcast(shift), part == F.col("_part")).withColumn("at", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")  # bound: the number of shuffle partitions


def judged(turns: DataFrame) -> DataFrame:
    """Numbered turns without their text, with their first fault (or null) and code."""
    slim = turns.drop("text")
    first = slim.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("_first")).select(F.col("_first"))
    out = slim.join(first, slim["at"] == first["_first"], "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("cut_off"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(initial)).otherwise(initial)
    return out.select("conv_id", "turn", "at", "initial", fault.alias("fault"), code.alias("code"))


def illegal(units: DataFrame) -> DataFrame:
    """conv_id, illegal: neighbouring turns whose initials are not su, ua or au. Pairs within units, then pairs of units' ends."""

    def bad(a: Column, b: Column) -> Column:
        return (~F.concat(a, b).isin("su", "ua", "au")).cast("long")

    x = F.col("initials")
    inside = F.aggregate(F.sequence(F.lit(1), F.size(x)), F.lit(0).cast("long"), lambda n, k: n + F.when(k > 1, bad(F.get(x, k - 2), F.get(x, k - 1))).otherwise(F.lit(0).cast("long")))
    own = units.select("conv_id", "unit", inside.alias("n"), F.get(x, F.lit(0)).alias("head"), F.get(x, F.size(x) - 1).alias("last"))
    # the end of a unit meets the beginning of the next one of the same conversation
    pairs = own.select("conv_id", "unit", "n", F.lit(None).cast("string").alias("last"), "head").unionByName(own.select("conv_id", (F.col("unit") + 1).alias("unit"), F.lit(0).cast("long").alias("n"), "last", F.lit(None).cast("string").alias("head")))
    met = pairs.groupBy("conv_id", "unit").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("head").alias("head"))
    between = F.when(F.col("last").isNotNull() & F.col("head").isNotNull(), bad(F.col("last"), F.col("head"))).otherwise(0)
    return met.groupBy("conv_id").agg(F.sum(F.col("n") + between).alias("illegal"))


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(turns, conversations, edits) of rows (conv_id, turn, role, text).

    turns: numbered(). conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. edits: at, edit,
    before, role_now, after of every turn.
    """
    turns = numbered(rows)
    codes = keep(judged(turns), "turn-codes")
    unit = F.floor(F.col("at") / UNIT).cast("long")
    cells = F.array_sort(F.collect_list(F.struct("at", "code", "initial")))
    units = codes.groupBy("conv_id", unit.alias("unit")).agg(cells.alias("cells"))  # at most UNIT rows each
    units = units.select("conv_id", "unit", F.array_join("cells.code", "").alias("codes"), F.col("cells.initial").alias("initials"), F.col("cells.at").alias("at"))
    units = keep(units, "turn-units")

    level = keep(units.select("conv_id", "unit", "codes").mapInArrow(_reduced, UNIT_SCHEMA), "matrices")
    done, going_down = None, []
    while True:
        count = level.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("_n"))
        sized = keep(level.join(count, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"), "matrix-level")
        whole = sized.where("_n = 1").drop("_n").withColumn("_depth", F.lit(len(going_down)))
        done = whole if done is None else done.unionByName(whole)
        many = sized.where("_n > 1")
        if many.isEmpty():
            break
        parent = F.floor(F.col("unit") / FAN).cast("long")
        parts = many.groupBy("conv_id", parent.alias("parent")).agg(F.array_sort(F.collect_list(F.struct("unit", "cost", "audit"))).alias("parts"))
        parts = keep(parts, "matrix-parts")
        going_down.append(parts)
        level = keep(parts.select("conv_id", F.col("parent").alias("unit"), "parts").mapInArrow(_together, UNIT_SCHEMA), "matrices")

    ways, ended = None, []
    for depth in range(len(going_down), -1, -1):
        own = keep(done.where(F.col("_depth") == depth).drop("_depth").mapInArrow(_ended, "conv_id long, unit long, enter int, leave int, cost long, audit string, tail string"), "ways")
        ended.append(own.select("conv_id", "cost", "audit"))
        here = own.select("conv_id", "unit", "enter", "leave", "tail")
        ways = here if ways is None else ways.unionByName(here)
        if depth:
            parts = going_down[depth - 1]
            met = parts.join(ways.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("unit")))
            ways = keep(met.select("conv_id", "parts", "enter", "leave", "tail").mapInArrow(_descended, WAY_SCHEMA), "ways")

    w = ways.select(F.col("conv_id").alias("_conv"), F.col("unit").alias("_unit"), "enter", "leave", "tail")
    met = units.join(w, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("unit") == F.col("_unit")))
    edits_of = met.select("at", "codes", "enter", "leave", "tail").mapInArrow(_spelled, "at long, edit string, before array<string>, role_now string, after array<string>")

    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = codes.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    out = met_all(counts, [illegal(units), whole])
    return turns, out, edits_of


def met_all(left: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Left joins on conv_id; nulls meet."""
    for df in others:
        left = left.join(df.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return left


def repaired(turns: DataFrame, edits_of: DataFrame) -> DataFrame:
    """conv_id, at, k, role, text, edit: the turns of sound conversations, in the order of (at, k)."""
    met = turns.select("conv_id", "at", "role", "text").join(edits_of.withColumnRenamed("at", "_at"), F.col("at") == F.col("_at"))
    turn = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit") if isinstance(edit, str) else edit.alias("edit"))
    added = lambda c: F.transform(c, lambda r: turn(r, F.lit(""), "I"))
    own = F.array(turn(F.when(F.col("role_now") == "", F.col("role")).otherwise(F.col("role_now")), F.col("text"), F.col("edit")))
    all_of = F.concat(added("before"), F.when(F.col("role_now").isNull(), F.slice(own, 1, 0)).otherwise(own), added("after"))
    return met.select("conv_id", "at", F.posexplode(all_of).alias("k", "turn")).select("conv_id", "at", "k", "turn.*")


def _hashed(batches):
    """Rows of conversations in order -> conv_id, repaired_sha256. Holds one digest at a time."""
    now, digest, begun = None, None, False

    def row():
        return _batch([(now, digest.hexdigest())], ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])

    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if not begun or conv != now:
                if begun:
                    done.append((now, digest.hexdigest()))
                now, digest, begun = conv, hashlib.sha256(), True
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if done:
            yield _batch(done, ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])
    if begun:
        yield row()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: one row in five is lost, emptied, robbed of its full stops, repeated or given to the user, by the CRC-32 of conv_id:turn."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("long").cast("string"), F.lit(" ")))
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(key) % 20).alias("_kind"),
    ).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return slim.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_one")).drop("_one")


def reported(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each of convs (conv_id): gaps, faults, illegal, cost, audit and the digest of the repaired conversation."""
    turns, found, edits_of = repairs(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = repaired(turns, edits_of).repartition(n, "conv_id").sortWithinPartitions("conv_id", "at", "k").select("conv_id", "role", "text").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    out = met_all(convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), [found, said])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return reported(damaged(rows), rows)


#: The same by dynamic programming, a turn a step: DuckDB has no CRC-32, so its table and fold are written out.
ORACLE = """
WITH RECURSIVE
bits(b, k, c) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, x: xor(a >> 8, crc.t[(xor(a % 256, x) + 1)::INT])), 4294967295::BIGINT) % 20 AS kind FROM keyed, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) twice(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM rows),
faulty AS (
  SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault FROM placed),
step(r, a, b) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(a, b, cost, audit, said) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
         (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edit AS (
  SELECT f.conv_id, f.i, s.a, s.a AS b, 3 AS cost, 'D' AS audit, '' AS said FROM faulty f, (VALUES (0), (1), (2), (3)) s(a)
  UNION ALL SELECT f.conv_id, f.i, s.a, s.b, coalesce((fault = 'truncated')::INT, 0), 'K', chr(10) || f.role || ':' || f.text FROM faulty f JOIN step s ON s.r = f.c WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT f.conv_id, f.i, s.a, s.b, 2 + coalesce((fault = 'truncated')::INT, 0), 'R', chr(10) || CASE s.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text FROM faulty f, step s
            WHERE s.r <> 's' AND (fault IS NULL OR fault = 'truncated')),
walk(conv_id, i, b, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'said': ''} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.b, min({'cost': w.best.cost + n.cost + e.cost, 'audit': w.best.audit || n.audit || e.audit, 'said': w.best.said || n.said || e.said})
  FROM walk w JOIN ins n ON n.a = w.b JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.a = n.b GROUP BY w.conv_id, w.i, e.b),
lengths AS (SELECT conv_id, max(i) AS i FROM walk GROUP BY conv_id),
ends AS (
  SELECT w.conv_id, min({'cost': w.best.cost + n.cost, 'audit': w.best.audit || n.audit, 'said': w.best.said || n.said}) AS best
  FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i JOIN ins n ON n.a = w.b WHERE n.b IN (0, 3) GROUP BY w.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (p IS NOT NULL AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(substr(e.best.said, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
