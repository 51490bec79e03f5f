"""Operator 8, chat formatting: minimum-cost role repair by dynamic programming, then rendering.

Legal turns are the paths of an automaton: an optional system turn, then user and assistant in turn, the assistant last.
For every turn the program merges it into the turn before, gives it another role, or puts empty turns before it, at the
least cost in all. A turn's choices depend on its role alone and are a matrix over the automaton's states in (min, +)
arithmetic, which is associative: a conversation is cut to blocks of bounded length by position, each block's matrix is
computed where the block is, the blocks' matrices are chained to find the states between blocks, and each block then
repairs its own turns. No task holds more than a block of a conversation's turns; texts are joined by position.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled

#: States: nothing yet, after system, after user, after assistant.
STATES = "-sua"
#: Roles that may follow each state.
FOLLOW = {"-": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"s": "system", "u": "user", "a": "assistant"}
#: Other names of roles, in lower case.
ALIASES = {"system": "s", "developer": "s", "user": "u", "human": "u", "prompter": "u", "assistant": "a", "bot": "a", "gpt": "a", "model": "a"}
#: Costs: merging a turn of the same role, of another role or of an unknown one; relabelling; relabelling an unknown role; an empty turn.
MERGE, MERGE_OTHER, MERGE_UNKNOWN, RELABEL, RELABEL_UNKNOWN, INSERT = 2, 7, 4, 5, 1, 3
#: Turns in a block. One row of a conversation's chain is a block, so a chain is this much shorter than its conversation.
BLOCK = 2048

_NEVER = (1 << 30, 0)


def _fillers() -> dict[tuple[str, str], str]:
    """For each pair of states: the shortest run of roles that leads from one to the other."""
    out = {(s, s): "" for s in STATES}
    for _ in STATES:
        for (a, b), roles in list(out.items()):
            for r in FOLLOW[b]:
                if len(roles) + 1 < len(out.get((a, r), "....")):
                    out[a, r] = roles + r
    return out


FILLERS = _fillers()


def choices(role: str) -> dict[tuple[str, str], tuple[tuple[int, int], str, str]]:
    """For a turn of a role, s, u, a or x (unknown), by (state before, state after): (cost, new turns), empty turns before it, and its new role ("" to merge).

    Of equal costs the one with fewer turns holds, then the one that keeps the order of STATES.
    """
    out: dict[tuple[str, str], tuple[tuple[int, int], str, str]] = {}

    def offer(key: tuple[str, str], cost: int, before: str, to: str) -> None:
        value = (cost, len(before) + bool(to)), before, to
        if key not in out or value[0] < out[key][0]:
            out[key] = value

    for a in STATES:
        if a != "-":
            offer((a, a), MERGE if role == a else MERGE_UNKNOWN if role == "x" else MERGE_OTHER, "", "")
        for b in STATES:
            if (a, b) in FILLERS:
                for to in FOLLOW[b]:
                    before = FILLERS[a, b]
                    offer((a, to), INSERT * len(before) + (0 if to == role else RELABEL_UNKNOWN if role == "x" else RELABEL), before, to)
    return out


CHOICES = {r: choices(r) for r in "suax"}
#: Empty turns that end a conversation from each state: none, an assistant's, or both.
ENDS = {s: "" if s in "-a" else FILLERS[s, "a"] for s in STATES}

Cost = tuple[int, int]


def _plus(a: Cost, b: Cost) -> Cost:
    return a[0] + b[0], a[1] + b[1]


def block_matrix(roles: str) -> list[list[Cost]]:
    """Least (cost, new turns) from each state to each over a run of turns."""
    out = []
    for s in STATES:
        row = {t: ((0, 0) if t == s else _NEVER) for t in STATES}
        for r in roles:
            nxt = dict.fromkeys(STATES, _NEVER)
            for (a, b), (cost, _, _) in CHOICES[r].items():
                if row[a] < _NEVER:
                    nxt[b] = min(nxt[b], _plus(row[a], cost))
            row = nxt
        out.append([row[t] for t in STATES])
    return out


def chain(blocks: list[list[list[Cost]]]) -> list[tuple[str, str, int]]:
    """For each block of a conversation: the state it begins and ends in, and the new turns before it."""
    best = [[(0, 0) if s == "-" else _NEVER for s in STATES]]
    for m in blocks:
        best.append([min(_plus(best[-1][i], m[i][j]) if best[-1][i] < _NEVER and tuple(m[i][j]) < _NEVER else _NEVER for i in range(4)) for j in range(4)])
    last = min(range(4), key=lambda j: (_plus(best[-1][j], (INSERT * len(ENDS[STATES[j]]), len(ENDS[STATES[j]]))), j))
    states = [last]
    for k in range(len(blocks) - 1, -1, -1):
        j, m = states[-1], blocks[k]
        states.append(min(i for i in range(4) if best[k][i] < _NEVER and tuple(m[i][j]) < _NEVER and _plus(best[k][i], m[i][j]) == best[k + 1][j]))
    states.reverse()
    return [(STATES[states[k]], STATES[states[k + 1]], best[k][states[k]][1]) for k in range(len(blocks))]


def repair(roles: str, begin: str = "-", end: str | None = None) -> list[tuple[str, str]]:
    """For each turn: empty turns before it and its new role ("" to merge); with no end state given, the cheapest legal end."""
    rows = [{s: ((0, 0) if s == begin else _NEVER) for s in STATES}]
    for r in roles:
        nxt = dict.fromkeys(STATES, _NEVER)
        for (a, b), (cost, _, _) in CHOICES[r].items():
            if rows[-1][a] < _NEVER:
                nxt[b] = min(nxt[b], _plus(rows[-1][a], cost))
        rows.append(nxt)
    state = end or min(STATES, key=lambda s: _plus(rows[-1][s], (INSERT * len(ENDS[s]), len(ENDS[s]))))
    out = []
    for k in range(len(roles) - 1, -1, -1):
        a = next(a for a in STATES if (a, state) in CHOICES[roles[k]] and rows[k][a] < _NEVER and _plus(rows[k][a], CHOICES[roles[k]][a, state][0]) == rows[k + 1][state])
        out.append(CHOICES[roles[k]][a, state][1:])
        state = a
    return out[::-1]


def _matrix(roles: pd.Series) -> pd.Series:
    return roles.map({r: json.dumps(block_matrix(r)) for r in set(roles)})


def _chained(numbers: pd.Series, matrices: pd.Series) -> pd.Series:
    out = []
    for own, m in zip(numbers, matrices):
        found = chain([[[tuple(c) for c in row] for row in json.loads(x)] for x in m])
        out.append([{"block": int(b), "begin": a, "end": z, "before": n, "last": k + 1 == len(found)} for k, (b, (a, z, n)) in enumerate(zip(own, found))])
    return pd.Series(out)


_CHAINED = "array<struct<block:bigint,begin:string,end:string,before:bigint,last:boolean>>"
_DECISIONS = "array<struct<nth:int,role:string,opens:boolean,empty:boolean,turn:bigint,last:boolean>>"


def _decided(roles: pd.Series, begin: pd.Series, end: pd.Series, before: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for r, a, z, n, final in zip(roles, begin, end, before, last):
        own, state, n = [], a, int(n)
        for k, (fill, to) in enumerate(repair(r, a, z)):
            for f in fill:
                own.append({"nth": k, "role": f, "opens": True, "empty": True, "turn": n, "last": False})
                n += 1
            state = to or (fill[-1] if fill else state)
            own.append({"nth": k, "role": state, "opens": bool(to), "empty": False, "turn": n - (not to), "last": False})
            n += bool(to)
        if final:
            for f in ENDS[z]:
                own.append({"nth": len(r) - 1, "role": f, "opens": True, "empty": True, "turn": n, "last": False})
                n += 1
            own[-1]["last"] = True
        out.append(own)
    return pd.Series(out)


def escaped(text: Column) -> Column:
    """text with a backslash more after the < of each marker of a turn, escaped or not: to be undone by taking one away."""
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, turn, source_turn, source_role, role, action and rendered: pieces of each conversation's repaired turns.

    Turns are taken by turn, then role, then text, absent ones first; roles of other case, with spaces around or by another
    common name are known. A piece is one source turn, or an inserted empty one; its rendered text opens a turn ("keep",
    "relabel", "insert") or goes on with the one before ("merge"), so that a conversation's pieces, by part, make up its
    rendered text, and no row grows with a conversation. turn counts the repaired turns from 0. Null texts are empty; an
    unknown or null role takes whichever role is cheapest; rows with null conv_id are one conversation. Repeated rows are
    turns of their own. Markers of turns inside texts are escaped, so that no text can open or close a turn. Other columns
    aren't read. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    matrix, chained, decided = F.pandas_udf(_matrix, "string"), F.pandas_udf(_chained, _CHAINED), F.pandas_udf(_decided, _DECISIONS)
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("source_turn"), F.col(role).alias("source_role"), F.coalesce(escaped(F.col(text)), F.lit("")).alias("text"))
    order = ["conv_id", "source_turn", "source_role", "text"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    code = F.coalesce(F.try_element_at(names, F.coalesce(F.lower(F.trim("source_role")), F.lit(""))), F.lit("x"))
    rows = settled(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("code", code), "turns")
    block = F.floor(F.col("pos") / BLOCK)
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("x"))
    blocks = settled(blocks.select("conv_id", "block", F.col("x.pos").alias("pos"), F.concat_ws("", F.col("x.code")).alias("roles")), "blocks")
    matrices = blocks.select("conv_id", "block", matrix("roles").alias("m"))
    chains = matrices.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("x")).select("conv_id", F.explode(chained(F.col("x.block"), F.col("x.m"))).alias("c")).select("conv_id", "c.*")
    joined = blocks.withColumnRenamed("conv_id", "_c").join(chains.withColumnRenamed("block", "_b"), F.col("_c").eqNullSafe(F.col("conv_id")) & (F.col("block") == F.col("_b")))
    pieces = joined.select("pos", F.explode(decided("roles", "begin", "end", "before", "last")).alias("d")).select(F.get("pos", F.col("d.nth")).alias("pos"), "d.role", "d.opens", "d.empty", "d.turn", "d.last")
    out = rows.join(pieces, "pos")
    long = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    name = F.element_at(long, F.col("role"))
    opened = F.concat(F.when(F.col("turn") > 0, "<|im_end|>\n").otherwise(""), F.lit("<|im_start|>"), name, F.lit("\n"))
    rendered = F.concat(F.when(F.col("opens"), opened).otherwise("\n\n"), F.when(F.col("empty"), "").otherwise(F.col("text")), F.when(F.col("last"), "<|im_end|>\n").otherwise(""))
    action = F.when(F.col("empty"), "insert").when(~F.col("opens"), "merge").when(F.col("code") == F.col("role"), "keep").otherwise("relabel")
    part = F.struct("pos", "turn")
    return out.select("conv_id", part.alias("part"), "turn", F.when(~F.col("empty"), F.col("source_turn")).alias("source_turn"), F.when(~F.col("empty"), F.col("source_role")).alias("source_role"), name.alias("role"), action.alias("action"), rendered.alias("rendered"))
