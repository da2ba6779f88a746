"""Conversation structure repair by cost layers.

A conversation is sound if its roles read ``(s?(ua)+)?`` by their first letters (system, user, assistant) and no turn is
blank, a duplicate or cut off. Turns are kept (0), given another role (2), deleted (3) or added without text (2); a turn
that is cut off and stays costs 1 more. Blank and duplicate turns have to go.

Layer d holds, for each turn, the bitset of grammar states from which the turns ahead can be repaired at a cost of d.
Layers are made for d = 0, 1, 2, ...; the first one whose set before the first turn has the start state gives the cost,
and a walk over the bits that takes the least letter (D < I < K < R) that a layer admits gives the least audit.

Conversations of up to MOST_TURNS turns are repaired in one go. Longer ones are sorted by range, equal turns counted, and
cut into blocks: layers from each exit state give a block's 4 x 4 costs; these joined from the end give what each exit
costs, and joined from the start the state in which each block begins. A conversation's 16 numbers for each block, and its
digest, which is one hash over all of it, pass one task; its turns do not.

Defined cases: null roles and texts are one space, so such texts are blank; a null conv_id is a conversation; null turns
come first, equal turns go by role and text; repeated rows are duplicates; a turn counts by its first fault (blank, then
duplicate, then cut off); roles count by their first letter as it is; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm.common import keep, picked, read, slices, spread_join

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
MOST_TURNS = 1_024
#: Turns of a block of a longer conversation, as a power of two, and of the partitions that these are sorted in.
BLOCK_BITS = 7
PART_TURNS = 65_536

INITIALS = "sua"
ROLES = {1: "user", 2: "assistant"}
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. NEXT[state][initial].
NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
STATES = range(4)
#: What a conversation that ends in a state still costs: turns without text that close it.
AT_END = (0, 4, 2, 0)
#: The one role that may be added in each state, and the state after it.
ADDED = tuple(next((x, q) for x, q in NEXT[s].items() if x) for s in STATES)


def _before(moves) -> list[int]:
    """For each set of states, the set of those that ``moves`` (state -> state or None) takes into it."""
    return [sum(1 << q for q in STATES if moves(q) is not None and s >> moves(q) & 1) for s in range(16)]


KEPT = [_before(lambda q, x=x: NEXT[q].get(x)) for x in range(4)]  # 3: no role of the grammar
MOVED = _before(lambda q: ADDED[q][1])

_INK = re.compile(r"[^\x20\x09-\x0D]")


def initial(role: str) -> int:
    return INITIALS.index(role[0]) if role[:1] and role[0] in INITIALS else 3


def is_blank(text: str) -> bool:
    return _INK.search(text) is None


def is_cut_off(text: str) -> bool:
    last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
    return bool(last) and last[-1] not in ".!?"


def cost_layers(turns: list[tuple[int, int]], ends: list[int | None], want: int) -> tuple[list[bytearray], dict[int, int]]:
    """Layers over ``turns`` (initial, whether cut off) that may stay, from what each exit state costs (None: no exit), until
    every state of ``want`` stands before the first turn; and the cost of each of these. Turns are added before a turn only:
    what follows the last one belongs to the exit's cost."""
    n = len(turns)
    reach = sum(1 << q for q in STATES if ends[q] is not None)
    for x, _ in reversed(turns):
        reach |= KEPT[x][reach] | MOVED[reach]
        for _ in STATES:
            reach |= MOVED[reach]
    want &= reach
    layers, least, none = [], {}, bytes(n + 1)
    back = lambda k: layers[-k] if len(layers) >= k else none
    while want:
        d = len(layers)
        one, two, three = back(1), back(2), back(3)
        now = bytearray(n + 1)
        now[n] = s = sum(1 << q for q in STATES if ends[q] == d)
        for i in range(n - 1, -1, -1):
            x, cut = turns[i]
            s = KEPT[x][one[i + 1] if cut else s] | MOVED[three[i + 1] if cut else two[i + 1]] | three[i + 1] | MOVED[two[i]]
            now[i] = s
        layers.append(now)
        found = want & now[0]
        for q in STATES:
            if found >> q & 1:
                least[q] = d
        want &= ~found
    return layers, least


def walk(turns: list[tuple[int, int]], layers: list[bytearray], state: int, cost: int) -> tuple[list[list[tuple[str, int]]], int]:
    """The least edits from ``state``: for each turn those before it and its own, as (letter, role or -1); and the exit state."""
    out = []
    for i, (x, cut) in enumerate(turns):
        edits = []
        while True:
            role, to = ADDED[state]
            if cost >= DELETE and layers[cost - DELETE][i + 1] >> state & 1:
                edits.append(("D", -1))
                cost -= DELETE
                break
            if cost >= INSERT and layers[cost - INSERT][i] >> to & 1:
                edits.append(("I", role))
                state, cost = to, cost - INSERT
                continue
            kept = NEXT[state].get(x)
            if kept is not None and cost >= cut and layers[cost - cut][i + 1] >> kept & 1:
                edits.append(("K", -1))
                state, cost = kept, cost - cut
            else:
                edits.append(("R", role))
                state, cost = to, cost - REROLE - cut
            break
        out.append(edits)
    return out, state


def closing(state: int) -> list[int]:
    """Roles of the turns that close a conversation that ends in ``state``."""
    return {1: [1, 2], 2: [2]}.get(state, [])


EDITS = "pos long, sub int, edit string, times long, role string, text string"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SCHEMA = f"{EDITS}, {', '.join(f'{c} long' for c in REPORT)}"


@dataclass
class Turn:
    pos: int
    role: str
    text: str
    times: int
    duplicate: bool

    def __post_init__(self):
        self.blank = is_blank(self.text)
        self.cut = int(not self.blank and is_cut_off(self.text))
        self.free = not (self.blank or self.duplicate)

    @property
    def symbol(self) -> tuple[int, int]:
        return initial(self.role), self.cut


def edited(turns: list[Turn], layers: list[bytearray], state: int, cost: int, last: bool) -> tuple[list[tuple], int]:
    """Rows of EDITS of a block that begins in ``state``, and the state it ends in. Turns that have to go are deleted before
    anything is added there, as D is the least letter."""
    steps, state = walk([t.symbol for t in turns if t.free], layers, state, cost)
    out, at = [], iter(steps)
    for t in turns:
        sub = 0
        for letter, role in next(at) if t.free else []:
            if letter == "I":
                out.append((t.pos, sub, "I", 1, ROLES[role], ""))
            elif letter == "D":
                out.append((t.pos, sub, "D", 1, None, None))
            else:
                out.append((t.pos, sub, letter, 1, t.role if letter == "K" else ROLES[role], t.text))
            sub += 1
        if more := t.times - t.free:
            out.append((t.pos, sub, "D", more, None, None))
    if last:
        out += [(turns[-1].pos if turns else 0, 1_000 + i, "I", 1, ROLES[r], "") for i, r in enumerate(closing(state))]
    return out, state


def is_legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def counted(turns: list[Turn]) -> tuple[int, int, int, int, int]:
    """blank, duplicate, truncated, illegal pairs inside, and the cost of turns that have to go."""
    blank = sum(t.times for t in turns if t.blank)
    duplicate = sum(t.times - t.free for t in turns if not t.blank)
    cut = sum(1 for t in turns if t.free and t.cut)
    x = [initial(t.role) for t in turns]
    illegal = sum(t.times - 1 for t in turns) + sum(not is_legal(a, b) for a, b in zip(x, x[1:], strict=False))
    return blank, duplicate, cut, illegal, DELETE * (blank + duplicate)


def gaps_of(turns: set[int]) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def repaired(rows: list[tuple]) -> list[tuple]:
    """Rows of SCHEMA of one conversation of ``rows`` (turn, role, text, copies) in order: its report, then its edits."""
    turns, seen = [], set()
    for _, role, text, copies in rows:
        for _ in range(copies):
            turns.append(Turn(len(turns), role, text, 1, (role, text) in seen))
            seen.add((role, text))
    layers, least = cost_layers([t.symbol for t in turns if t.free], list(AT_END), 1)
    blank, duplicate, cut, illegal, gone = counted(turns)
    edits, _ = edited(turns, layers, 0, least[0], True)
    report = (gaps_of({r[0] for r in rows if r[0] is not None and r[3]}), blank, duplicate, cut, illegal, least[0] + gone)
    return [(-1, 0, None, None, None, None, *report), *[(*e, *[None] * len(REPORT)) for e in edits]]


def _batch(conv: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(REPORT)]
    names = ["pos", "sub", "edit", "times", "role", "text", *REPORT]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["conv_id", *names])


def _rows(batches):
    for batch in slices(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _short(turns: DataFrame) -> DataFrame:
    """Edits of conversations that fit in memory, one after another."""

    def run(batches):
        kind, conv, out = None, [], []

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        for c, rows in groupby(_rows(typed()), key=lambda r: r[0]):
            got = repaired([r[1:] for r in rows])
            conv += [c] * len(got)
            out += got
            if len(out) >= 1_000:
                yield _batch(conv, out, kind)
                conv, out = [], []
        if out:
            yield _batch(conv, out, kind)

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {SCHEMA}")


def _turns(pdf: pd.DataFrame) -> list[Turn]:
    return [Turn(int(p), r, t, int(m), bool(d)) for p, r, t, m, d in zip(pdf["pos"], pdf["role"], pdf["text"], pdf["times"], pdf["again"], strict=True)]


def _long(turns: DataFrame, n: int) -> DataFrame:
    """Edits of conversations of any length. ``n``: the number of rows."""
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_TURNS))
    conv = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    stand = turns.filter("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("times")).withColumn("conv", conv)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = keep(stand.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()), "conversations-sorted")
    rows = rows.withColumn("same", F.sha2(F.concat("conv", F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    first = rows.groupBy("same").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    rows = spread_join(rows, first, ["same"], "n", n).select("conv", "conv_id", "pos", "turn", "role", "text", "times", (F.col("pos") > F.col("first")).alias("again"))
    rows = keep(rows.withColumn("block", F.shiftright("pos", BLOCK_BITS)), "conversations-marked")
    blocks = ["conv", "block"]

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        """Costs from each state to each exit, and counts."""
        turns = _turns(pdf.sort_values("pos"))
        free, costs = [t.symbol for t in turns if t.free], [-1] * 16
        for e in STATES:
            for q, c in cost_layers(free, [0 if s == e else None for s in STATES], 15)[1].items():
                costs[q * 4 + e] = c
        blank, duplicate, cut, illegal, gone = counted(turns)
        return pd.DataFrame({"conv": [pdf["conv"].iat[0]], "block": [pdf["block"].iat[0]], "costs": [costs], "blank": [blank], "duplicate": [duplicate], "truncated": [cut], "illegal": [illegal], "gone": [gone], "head": [initial(turns[0].role)], "tail": [initial(turns[-1].role)]})

    of_block = keep(rows.groupBy(*blocks).applyInPandas(matrix, "conv string, block long, costs array<int>, blank long, duplicate long, truncated long, illegal long, gone long, head int, tail int"), "conversations-blocks")

    def ahead(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each exit of each block costs, less the least of them; and the conversation's illegal pairs between blocks and
        its cost from the start."""
        pdf = pdf.sort_values("block")
        ends, out, base = list(AT_END), [], 0
        for costs in reversed(pdf["costs"].tolist()):
            low = min(ends)
            base += low
            ends = [e - low for e in ends]
            out.append(ends)
            ends = [min((costs[q * 4 + e] + ends[e] for e in STATES if costs[q * 4 + e] >= 0), default=1 << 40) for q in STATES]
        odd = sum(not is_legal(a, b) for a, b in zip(pdf["tail"], pdf["head"].iloc[1:], strict=False))
        return pd.DataFrame({"conv": pdf["conv"].iat[0], "block": pdf["block"], "ends": out[::-1], "final": [False] * (len(pdf) - 1) + [True], "odd": odd, "cost": base + ends[0]})

    exits = keep(of_block.select("conv", "block", "costs", "head", "tail").groupBy("conv").applyInPandas(ahead, "conv string, block long, ends array<long>, final boolean, odd long, cost long"), "conversations-exits")

    def layered(pdf: pd.DataFrame, want: int):
        turns = _turns(pdf.sort_values("pos"))
        return turns, *cost_layers([t.symbol for t in turns if t.free], [int(e) for e in pdf["ends"].iat[0]], want)

    def exits_of(pdf: pd.DataFrame) -> pd.DataFrame:
        turns, layers, least = layered(pdf, 15)
        free = [t.symbol for t in turns if t.free]
        to = [walk(free, layers, q, least[q])[1] if q in least else -1 for q in STATES]
        return pd.DataFrame({"conv": [pdf["conv"].iat[0]], "block": [pdf["block"].iat[0]], "to": [to]})

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("block"), 0, []
        for to in pdf["to"]:
            out.append(state)
            state = int(to[state])
        return pd.DataFrame({"conv": pdf["conv"].iat[0], "block": pdf["block"], "state": out})

    marked = rows.join(exits.select("conv", "block", "ends", "final"), blocks)
    begins = marked.groupBy(*blocks).applyInPandas(exits_of, "conv string, block long, to array<int>").groupBy("conv").applyInPandas(entries, "conv string, block long, state int")

    def edits(pdf: pd.DataFrame) -> pd.DataFrame:
        state = int(pdf["state"].iat[0])
        turns, layers, least = layered(pdf, 1 << state)
        got, _ = edited(turns, layers, state, least[state], bool(pdf["final"].iat[0]))
        out = pd.DataFrame(got, columns=["pos", "sub", "edit", "times", "role", "text"])
        out.insert(0, "conv_id", [pdf["conv_id"].iat[0]] * len(out))
        return out

    done = marked.join(begins, blocks).groupBy(*blocks).applyInPandas(edits, f"conv_id {kind}, {EDITS}")
    counts = of_block.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "gone")])
    span = rows.groupBy("conv", "conv_id", "turn").agg(F.lit(1)).groupBy("conv", "conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    whole = exits.groupBy("conv").agg(F.max("odd").alias("odd"), F.max("cost").alias("cost"))
    report = span.join(counts, "conv").join(whole, "conv").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("sub"), F.col("gaps").cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("odd")).alias("illegal"), (F.col("cost") + F.col("gone")).alias("cost"))
    # a conversation may have lost all its turns, and is not empty otherwise
    gone = turns.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter("n = 0").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("sub"), *[F.lit(0).cast("long").alias(c) for c in REPORT])
    return done.unionByName(report, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def repair(conversations: DataFrame, copies: str | None = None, most_turns: int = MOST_TURNS) -> DataFrame:
    """Edits and reports of ``conversations`` (conv_id, turn, role, text), written to the shared folder. A report row (pos = -1)
    of each conversation has gaps, blank, duplicate, truncated, illegal and cost; the other rows are its edits in order of
    (pos, sub): edit (K, R, D or I), how often (times), and role and text of the turn that stays. ``copies``: a column that
    says how often a row stands; rows that stand zero times name their conversation only."""
    names = ["conv_id", "turn", "role", "text", *([copies] if copies else [])]
    turns = picked(conversations, *names).withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    turns = turns.withColumnRenamed(copies, "copies") if copies else turns.withColumn("copies", F.lit(1))
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"))
    sizes = turns.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).filter(F.greatest("n", "rows") > most_turns)
    long = keep(sizes, "conversations-long").withColumnRenamed("conv_id", "long_id")
    n, total = long.agg(F.count("*"), F.coalesce(F.sum(F.greatest("n", "rows")), F.lit(0))).first()
    if not n:
        return keep(_short(turns), "conversations-edits")
    # ids only; beyond the bound they meet the rows in a shuffle
    ids = F.broadcast(long.select("long_id")) if n <= 100_000 else long.select("long_id").hint("merge")
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _short(turns.join(ids, same, "left_anti"))
    return keep(short.unionByName(_long(turns.join(ids, same, "left_semi"), int(total))), "conversations-edits")


def repaired_turns(edits: DataFrame) -> DataFrame:
    """conv_id, pos, sub, role and text of the turns of the repaired conversations, from :func:`repair`."""
    return edits.filter("edit <> 'D'").select("conv_id", "pos", "sub", "role", "text")


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation: its report, its edits as letters (audit) and the hash of the repaired turns
    (repaired_sha256 of ``role:text``, joined by newlines). Turns stream through: a task holds one batch and an audit."""

    def run(batches):
        for batch in _digested(batches):
            yield batch

    def _digested(batches):
        out, conv, report, letters, sha, first = [], [], None, [], None, True

        def close():
            if report is not None:
                out.append((*report, "".join(letters), sha.hexdigest()))

        kind = None
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for c, pos, edit, times, role, text, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if pos < 0:  # a report comes first
                    close()
                    conv.append(c)
                    report, letters, sha, first = rest, [], hashlib.sha256(), True
                    continue
                letters.append(edit * times)
                if edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            if len(out) >= 1_000:
                yield _digest_batch(conv[: len(out)], out, kind)
                conv, out = conv[len(out) :], []
        close()
        if out:
            yield _digest_batch(conv, out, kind)

    columns = ["conv_id", "pos", "edit", "times", "role", "text", *REPORT]
    rows = edits.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select(*columns)
    return rows.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


def _digest_batch(conv: list, out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), *[pa.array(c, pa.int64()) for c in cols[:-2]], *[pa.array(c, pa.string()) for c in cols[-2:]]], names=["conv_id", *REPORT, "audit", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` damaged by a hash of conversation and turn, with how often each row stands (copies)."""
    rows = picked(conversations, "conv_id", "turn", "role", "text")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = part("text"), part("role")
    text = F.when(how == 0, "").when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("copies"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(repair(damaged(read(spark, sf_dir, "conversations")), "copies"))


QUERIES = {"op11_conversations": op11_conversations}

#: The best of all edit sequences by state and turn, one turn after another; crc32 bit by bit.
_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(id) + 1), lambda i: ascii(id[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS how FROM src
), damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS x FROM damaged
), repeated AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM numbered
), faulty AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(x) OVER (PARTITION BY conv_id ORDER BY n) || x AS pair FROM repeated
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM faulty GROUP BY conv_id
), added(q, r, cost, letters, turns) AS (VALUES
  (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
  (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), moves(r, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), best(conv_id, n, q, cost, audit, turns) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM damaged
  UNION ALL
  SELECT conv_id, n, q, (min({'c': cost, 'a': audit})).c, (min({'c': cost, 'a': audit})).a, arg_min(turns, {'c': cost, 'a': audit}) FROM (
    SELECT b.conv_id, f.n, a.r AS q, b.cost + a.cost + 3 AS cost, b.audit || a.letters || 'D' AS audit, list_concat(b.turns, a.turns) AS turns
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1 JOIN added a ON a.q = b.q
    UNION ALL
    SELECT b.conv_id, f.n, m.t, b.cost + a.cost + CAST(f.cut AS INT) + 2 * k.k, b.audit || a.letters || CASE k.k WHEN 0 THEN 'K' ELSE 'R' END,
      list_concat(list_concat(b.turns, a.turns), [CASE WHEN k.k = 0 THEN f.role WHEN m.x = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text])
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1 AND NOT f.blank AND NOT f.again JOIN added a ON a.q = b.q JOIN moves m ON m.r = a.r
    JOIN (VALUES (0), (1)) k(k) ON CASE k.k WHEN 0 THEN m.x = f.x ELSE m.x IN ('u', 'a') END)
  GROUP BY conv_id, n, q
), ended AS (
  SELECT b.conv_id, b.cost + e.cost AS cost, b.audit || e.letters AS audit, list_concat(b.turns, e.turns) AS turns
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.n
  JOIN (VALUES (0, 0, '', []), (3, 0, '', []), (2, 2, 'I', ['assistant:']), (1, 4, 'II', ['user:', 'assistant:'])) e(q, cost, letters, turns) ON e.q = b.q
), least AS (
  SELECT conv_id, min({'c': cost, 'a': audit}) AS m, arg_min(turns, {'c': cost, 'a': audit}) AS turns FROM ended GROUP BY conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(l.m.c, 0)::BIGINT AS cost, coalesce(l.m.a, '') AS audit, sha256(coalesce(array_to_string(l.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN least l ON l.conv_id IS NOT DISTINCT FROM i.conv_id
"""
ORACLE_SQL = {"op11_conversations": _SQL}
