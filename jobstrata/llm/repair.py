"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A legal conversation is empty, or a system turn at most and then pairs of user and assistant: initials `(s?(ua)+)?`. Rows are taken by turn
(nulls first), ties by role and then by the SHA-256 of the text. Faults of a row, the first that holds: blank (no character but white
space), duplicate (role and text seen earlier), truncated (the last such character is no `.`, `!` or `?`). Edits: Keep, Rerole (to user or
assistant), Delete (a must for blank and duplicate rows), Insert (an empty user or assistant turn).

The search is over the subsequence of rows that stay. From the last row to the first, `solve` holds for each state (the role before a gap)
the running minimum over all next rows to stay; prefix sums of deletions price the gap up to it, and the pair of roles tells the turns to
insert there. Of edits that cost the same the ASCII-least audit is taken: what deletes first, then what inserts first, keeps, reroles.

Rows that are the same but for the order are one row with a count. They are dealt out in order (by range), so a conversation of any
length is cut into blocks in many tasks; each block gives its costs from each state to each state, `joined` composes those from the last
block to the first, and `played` reads the blocks and texts in order and holds one block's rows at a time and no text but the present
one. What stays sequential is the digest of a conversation, since SHA-256 is.

Nulls: role and text count as one space; a null turn sorts first; rows without conv_id are one conversation. An empty table gives an
empty table; texts of any length are read once; other columns are ignored. Repeated rows are duplicates of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BLANKS = " \t\n\x0b\f\r"
ORDER = ["conv_id", "turn", "role", "digest"]
#: rows with different keys that one block holds at most.
BLOCK = 1024
#: states: before the first row that stays, then the initial of the last one that does.
START, S, U, A = range(4)
NAMES = {U: b"user", A: b"assistant"}
LEGAL = {(S, U), (U, A), (A, U)}
#: turns to insert between a state and the role of the next row that stays, and after the last one.
BETWEEN = {(START, S): 0, (START, U): 0, (START, A): 1, (S, U): 0, (S, A): 1, (U, U): 1, (U, A): 0, (A, U): 0, (A, A): 1}
AFTER = {START: 0, S: 2, U: 1, A: 0}
INFINITE = 1 << 60
#: bits of a row's code; the two lowest have its role's state, 0 for any other.
BLANK, AGAIN, CUT = 4, 8, 16


@dataclass(frozen=True)
class Costs:
    """The price of each edit; keeping costs nothing but what a truncated row that stays adds."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


# --- one block ---


def solve(codes: bytes, copies: list[int], after: list[int], costs: Costs) -> tuple[list[int], list[dict[int, tuple[int, str, int]]]]:
    """The cheapest cost from each state before the block's rows, given that from each state after them; and for each row, by the state
    before it, what is done where the row stays: turns inserted before it, K or R, its role. A state that is missing deletes."""
    n = len(codes)
    paid = [0] * (n + 1)  # prefix sums of deletions
    for i in range(n):
        paid[i + 1] = paid[i] + costs.delete * copies[i]
    least = [paid[n] + x for x in after]  # all with the deletions up to the present row added
    choices: list[dict[int, tuple[int, str, int]]] = [{} for _ in range(n)]
    for j in range(n - 1, -1, -1):
        code = codes[j]
        if code & (BLANK | AGAIN):
            continue
        own, stays = code & 3, paid[j] + (costs.truncated if code & CUT else 0) + costs.delete * (copies[j] - 1) - paid[j + 1]
        ways = [(role, "K" if role == own else "R", stays + least[role] + (0 if role == own else costs.rerole)) for role in ((own,) if own == S else ()) + (U, A)]
        before = list(least)
        for state in range(4):
            chosen = None
            for role, edit, price in ways:
                inserts = BETWEEN.get((state, role))
                if inserts is not None:
                    price += costs.insert * inserts
                    # at one cost: deleting first, then inserting first, then keeping
                    if price < before[state] or price == before[state] and chosen and (-inserts, edit) < (-chosen[0], chosen[1]):
                        before[state], chosen = price, (inserts, edit, role)
            if chosen:
                choices[j][state] = chosen
        least = before
    return least, choices


def summary(codes: bytes, copies: list[int], turns: list[int | None], costs: Costs) -> dict:
    """What a block tells the others: its costs from state to state, counts of faults, and what meets the rows next to it."""
    columns = [solve(codes, copies, [0 if s == end else INFINITE for s in range(4)], costs)[0] for end in range(4)]
    roles, known = [c & 3 for c in codes], [t for t in turns if t is not None]
    faulty = list(zip(codes, copies, strict=True))
    return {
        "matrix": [min(columns[end][s], INFINITE) for s in range(4) for end in range(4)],
        "n_blank": sum(n for c, n in faulty if c & BLANK),
        "n_again": sum(n if c & AGAIN else n - 1 for c, n in faulty if not c & BLANK),
        "n_cut": sum(1 for c, _ in faulty if c & CUT and not c & (BLANK | AGAIN)),
        "illegal": sum(copies) - len(copies) + sum(p not in LEGAL for p in zip(roles, roles[1:], strict=False)),
        "ends": [roles[0], roles[-1]],
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "n_turns": len(set(known)),
    }


# --- tables ---


def facts(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a conversation's turn: their number n, and the code of the first. No text."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    first = F.substring(role, 1, 1)
    state = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(0)
    cut = ~F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    flags = state + F.when(F.translate(text, BLANKS, "") == "", BLANK).when(cut, CUT).otherwise(0)
    own = rows.select("conv_id", "turn", role.cast("binary").alias("role"), digest_of(text).alias("digest"), flags.alias("code"))
    counted = own.groupBy(*ORDER, "code").agg(F.count(F.lit(1)).alias("n"))
    # which of the rows with one role and text is the first: said by a row of its own, so that nothing is joined by a key that may be hot
    firsts = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("f"))
    marks = firsts.select("conv_id", "f.turn", "role", "digest", F.lit(None).cast("int").alias("code"), F.lit(0).cast("long").alias("n"))
    both = counted.unionByName(marks).groupBy(*ORDER).agg(F.max("code").alias("code"), F.sum("n").alias("n"), F.max(F.col("code").isNull()).alias("first"))
    return both.select(*ORDER, F.col("code").bitwiseOR(F.when(F.col("first"), 0).otherwise(AGAIN)).alias("code"), "n")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _fields(kind: str) -> str:
    return f"conv_id {kind}, turn long, role binary, digest binary, part int, block int, codes binary, copies array<bigint>, matrix array<bigint>, n_blank long, n_again long, n_cut long, illegal long, ends array<int>, low long, high long, n_turns long"


def _arrow(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _schema(df: DataFrame, fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], fields).schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from batch.slice(at, 500).to_pylist()


def blocks(rows: DataFrame, costs: Costs, size: int = BLOCK) -> DataFrame:
    """Blocks of at most `size` rows each: the key of the first one, their codes, and the block's summary."""
    kind = dict(rows.dtypes)["conv_id"]
    like = _schema(rows, _fields(kind))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            for block, some in enumerate(_chunks(own, size)):
                codes, copies = bytes(r["code"] for r in some), [r["n"] for r in some]
                head = {k: some[0][k] for k in ("turn", "role", "digest")}
                out.append({"conv_id": conv_id, **head, "part": part, "block": block, "codes": codes, "copies": copies, **summary(codes, copies, [r["turn"] for r in some], costs)})
                if len(out) >= 256:
                    yield _arrow(out, like)
                    out = []
        if out:
            yield _arrow(out, like)

    ordered = facts(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(cut, _fields(kind))


def _chunks(rows: Iterator[dict], size: int) -> Iterator[list[dict]]:
    some: list[dict] = []
    for r in rows:
        some.append(r)
        if len(some) == size:
            yield some
            some = []
    if some:
        yield some


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def joined(table: DataFrame, costs: Costs) -> DataFrame:
    """For each block the costs after it, by state; the first block of a conversation also has the conversation's totals."""
    kind = dict(table.dtypes)["conv_id"]
    fields = f"conv_id {kind}, turn long, role binary, digest binary, codes binary, copies array<bigint>, after array<bigint>, totals array<bigint>"
    like = _schema(table, fields)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for _, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            after = [costs.insert * AFTER[s] for s in range(4)]
            seen, sums, right, low, high, turns = None, [0, 0, 0, 0], None, None, None, 0
            for r in own:  # from the last block to the first
                if seen:
                    out.append(seen)
                seen = {k: r[k] for k in ("conv_id", "turn", "role", "digest", "codes", "copies")} | {"after": after}
                m = r["matrix"]
                after = [min(INFINITE, min(m[4 * s + e] + after[e] for e in range(4))) for s in range(4)]
                sums = [a + r[k] for a, k in zip(sums, ("n_blank", "n_again", "n_cut", "illegal"), strict=True)]
                if right is not None and (r["ends"][1], right) not in LEGAL:
                    sums[3] += 1
                right = r["ends"][0]
                if r["low"] is not None:
                    turns += r["n_turns"] - (low is not None and r["high"] == low)
                    low, high = r["low"], r["high"] if high is None else high
                if len(out) >= 256:
                    yield _arrow(out, like)
                    out = []
            seen["totals"] = [0 if low is None else high - low + 1 - turns, *sums, after[START]]
            out.append(seen)
        if out:
            yield _arrow(out, like)

    order = ["conv_id", F.desc("part"), F.desc("block")]
    return table.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(compose, fields)


def _played(rows: Iterator[dict], costs: Costs) -> Iterator[tuple[dict | None, str, bytes, bytes, int | None]]:
    """The edits of one conversation in order: (block that begins or None, edit, role, text, turn)."""
    state, choices, codes, copies, i, begins, last = START, [], b"", [], 0, None, None
    for r in rows:
        if r["kind"] == 0:
            _, choices = solve(r["codes"], r["copies"], r["after"], costs)
            codes, copies, i, begins = r["codes"], r["copies"], 0, r
            continue
        if r["kind"] == 2 or (key := (r["turn"], r["role"], r["digest"])) == last:
            continue
        last, chosen = key, choices[i].get(state)
        if chosen:
            inserts, edit, role = chosen
            for _ in range(inserts):
                state = A if state == U else U
                yield begins, "I", NAMES[state], b"", None
                begins = None
            state = role
            yield begins, edit, r["role"] if edit == "K" else NAMES[role], r["text"], r["turn"]
        else:
            yield begins, "D", r["role"], r["text"], r["turn"]
        begins = None
        for _ in range(copies[i] - 1):
            yield None, "D", r["role"], r["text"], r["turn"]
        i += 1
    for _ in range(AFTER[state]):
        state = A if state == U else U
        yield None, "I", NAMES[state], b"", None


def _stream(rows: DataFrame, everyone: DataFrame, costs: Costs, block: int) -> DataFrame:
    """Blocks (kind 0), the texts of their rows (1) and a row for each conversation there ever was (2), each conversation in order."""
    found = joined(stored(blocks(rows, costs, block), "blocks"), costs).withColumn("kind", F.lit(0))
    text = F.coalesce("text", F.lit(" "))
    texts = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).cast("binary").alias("role"), digest_of(text).alias("digest"), text.cast("binary").alias("text"), F.lit(1).alias("kind"))
    known = everyone.select("conv_id").distinct().withColumn("kind", F.lit(2))
    every = found.unionByName(texts, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions(*ORDER, "kind")


def repaired(conversations: DataFrame, costs: Costs = Costs(), keep_deleted: bool = False, block: int = BLOCK) -> DataFrame:
    """The repaired turns: conv_id, position (from 0 in the audit), edit (K, R, I; D too with keep_deleted), turn (null where inserted), role, text."""
    kind = dict(conversations.dtypes)["conv_id"]
    fields = f"conv_id {kind}, position long, edit string, turn long, role string, text string"
    like = _schema(conversations, fields)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            for position, (_, edit, role, text, turn) in enumerate(_played(own, costs)):
                if edit != "D" or keep_deleted:
                    out.append({"conv_id": conv_id, "position": position, "edit": edit, "turn": turn, "role": role.decode("utf-8", "replace"), "text": text.decode("utf-8", "replace")})
                if len(out) >= 256:
                    yield _arrow(out, like)
                    out = []
        if out:
            yield _arrow(out, like)

    return _stream(conversations, conversations, costs, block).mapInArrow(play, fields)


def digest(rows: DataFrame, everyone: DataFrame | None = None, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """A row for each conversation of `everyone` (rows if None): totals, the audit, and the digest of the repaired `role:text` lines."""
    kind = dict(rows.dtypes)["conv_id"]
    fields = f"conv_id {kind}, {', '.join(t + ' long' for t in TOTALS)}, audit string, repaired_sha256 string"
    like = _schema(rows, fields)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
            totals, audit, lines, hashed = None, [], 0, hashlib.sha256()
            for begins, edit, role, text, _ in _played(own, costs):
                if begins and begins["totals"] is not None:
                    totals = begins["totals"]
                audit.append(edit)
                if edit != "D":
                    hashed.update((b"\n" if lines else b"") + role + b":")
                    hashed.update(text)
                    lines += 1
            out.append({"conv_id": conv_id, **dict(zip(TOTALS, totals or [0] * len(TOTALS), strict=True)), "audit": "".join(audit), "repaired_sha256": hashed.hexdigest()})
            if len(out) >= 1024:
                yield _arrow(out, like)
                out = []
        if out:
            yield _arrow(out, like)

    return _stream(rows, rows if everyone is None else everyone, costs, block).mapInArrow(play, fields)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults, by the CRC-32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its `.!?`,
    3 repeats it, 4 makes it the user's. Nulls count as one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    out = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("k"))
    return out.drop("k")
