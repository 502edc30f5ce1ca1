"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is lines of text, some with a speaker marker ("User:", "### Assistant:").
The states are a role and whether a line begins a turn.  A line shows a
marker's role or none, whether it is the first of an entry of several lines (such
entries are turns more often than lines of turns), and whether it is blank, a question or long; the most likely states of all lines (Viterbi) give the roles, and lines from one beginning
to the next are a turn.

A marker is certain if it cannot be text ("User:", "[AI]", "### Answer:"); only such
a one is cut off, where a turn begins.  What may be text ("Answer: 42", "AI - and
more") is shown as a weak marker, which the model may refuse, and stays in the
content.  A name joined to a word by a hyphen ("AI-driven") is text.  So every word
but those of certain markers is in a turn.

A conversation may be of any length.  Lines come in chunks of ``CHUNK`` entries;
each chunk is reduced to a table of the best score from every state before it to
every state at its end, these tables are chained per conversation, and then every
chunk is solved for itself between two known states.  The result is that of Viterbi
on the whole conversation, ties included: a tie goes to the state named first.

Nulls and edge cases: a null text is an empty one, which is a blank line.  Rows
that agree in conversation, place and text are read once; different texts at
one place follow each other in text order.  A null conversation is one conversation,
and a null place comes before all others.  Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import materialise

ROLES = ("system", "user", "assistant")
CHUNK = 256

# Speaker names that stand for a role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "bot", "ai", "model", "agent", "answer", "a"),
}
_NAMES = {name: role for role, names in NAMES.items() for name in names}
# Names that are also ordinary words or single letters: bare, they need not be a marker.
_WORDS = {"instruction", "instructions", "context", "question", "q", "me", "model", "agent", "answer", "a", "customer"}
_PLAIN = "|".join(sorted(_NAMES.keys() - _WORDS, key=len, reverse=True))
_ANY = "|".join(sorted(_NAMES, key=len, reverse=True))
# A certain marker is in a pair of brackets or of stars, after a heading's signs, or a name that is no other word before a colon.
MARKER = re.compile(
    rf"\s*(?:#+\s*)?(?:\[\s*({_ANY})\s*\]\s*:?|<\|?\s*({_ANY})\s*\|?>\s*:?|\*\*\s*({_ANY})\s*(?::\s*\*\*|\*\*\s*:)|({_PLAIN})\s*:)\s*"
    rf"|\s*#+\s*({_ANY})\s*(?::\s*|$)",
    re.I,
)
# One that may be text: another word before a colon, or a name before a hyphen with space on both sides.
WEAK = re.compile(rf"\s*(?:({_ANY})\s*:|({_ANY})\s+-\s)", re.I)

# States: beginning and continuation of a turn of each role, in the order of ROLES.
STATES = [(role, begins) for role in range(3) for begins in (True, False)]


SHOWN_CODES = 7 << 4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log chances: of the first state, of one state after another, of what a line shows."""
    first = np.array([0.25, 1e-9, 0.7, 1e-9, 0.05, 1e-9])
    next_role = np.array([[0.01, 0.95, 0.04], [0.01, 0.09, 0.9], [0.01, 0.94, 0.05]])
    step = np.zeros((6, 6))
    for i, (role, _) in enumerate(STATES):
        for j, (after, begins) in enumerate(STATES):
            step[i, j] = 0.45 * next_role[role, after] if begins else 0.55 * (role == after)
    # What a line shows: marker (none, certain or weak one of each role) x opens an entry of several lines x blank x question x long.
    marker = np.zeros((6, 7))
    question, long = np.array([0.05, 0.4, 0.1]), np.array([0.5, 0.3, 0.6])
    shown = np.zeros((6, SHOWN_CODES))
    for i, (role, begins) in enumerate(STATES):
        marker[i] = [0.2, 0.02, 0.02, 0.02, 0.002, 0.002, 0.002] if begins else [0.967, 0.001, 0.001, 0.001, 0.01, 0.01, 0.01]
        marker[i, 1 + role] += 0.704 if begins else 0
        marker[i, 4 + role] += 0.03 if begins else 0
        for code in range(SHOWN_CODES):
            m, opens, blank, asks, many = code >> 4, code >> 3 & 1, code >> 2 & 1, code >> 1 & 1, code & 1
            chance = marker[i, m] * ((0.02 if begins else 0.15) if blank else (0.98 if begins else 0.85))
            chance *= (0.5 if begins else 0.03) if opens else (0.5 if begins else 0.97)
            chance *= question[role] if asks else 1 - question[role]
            shown[i, code] = chance * (long[role] if many else 1 - long[role])
    with np.errstate(divide="ignore"):
        return np.log(first), np.log(step), np.log(shown)


FIRST, STEP, SHOWN = _tables()


def marker_of(line: str) -> tuple[int, str]:
    """1 + the role of a line's certain marker, 4 + that of a weak one, or 0; and the line without a certain one."""
    if found := MARKER.match(line):
        return 1 + ROLES.index(_NAMES[found[found.lastindex].lower()]), line[found.end() :]
    if found := WEAK.match(line):
        return 4 + ROLES.index(_NAMES[found[found.lastindex].lower()]), line
    return 0, line


def shows(line: str, opens: bool = False) -> int:
    """What a line shows, as a number under ``SHOWN_CODES``; ``opens``: it is the first of an entry of several lines."""
    text = line.strip()
    return marker_of(line)[0] << 4 | opens << 3 | (not text) << 2 | text.endswith("?") << 1 | (len(text) > 120)


def _onward(score: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores after one more line, and from which state."""
    ways = score[:, None] + STEP
    back = ways.argmax(axis=0)
    return ways[back, np.arange(6)] + SHOWN[:, code], back


def reduced(codes: list[int]) -> np.ndarray:
    """Best score from each state before these lines to each state at their end."""
    table = np.where(np.eye(6, dtype=bool), 0.0, -np.inf)
    for code in codes:
        table = (table[:, :, None] + STEP).max(axis=1) + SHOWN[:, code]
    return table


def solved(codes: list[int], before: int | None, end: int | None) -> list[int]:
    """Best states of these lines between two known states; ``before`` None: they are the first ones."""
    if not codes:
        return []
    if before is None:
        score = FIRST + SHOWN[:, codes[0]]
    else:
        score = STEP[before] + SHOWN[:, codes[0]]
    backs = []
    for code in codes[1:]:
        score, back = _onward(score, code)
        backs.append(back)
    states = [int(score.argmax()) if end is None else end]
    for back in reversed(backs):
        states.append(int(back[states[-1]]))
    return states[::-1]


def shown(entries: list[str]) -> tuple[list[str], list[int]]:
    """The lines of these entries and what each shows."""
    split = [e.split("\n") for e in entries]
    codes = [shows(x, k == 0 and len(lines) > 1) for lines in split for k, x in enumerate(lines)]
    return [x for lines in split for x in lines], codes


def _reduce(frames):
    for frame in frames:
        tables = []
        for entries, first in zip(frame["entries"], frame["is_first"], strict=True):
            codes = shown([e["text"] for e in entries])[1]
            # The first chunk has no state before it: one row of scores.
            table = (FIRST + SHOWN[:, codes[0]] + reduced(codes[1:]).T).T.max(axis=0)[None].repeat(6, 0) if first else reduced(codes)
            tables.append(table.ravel().tolist())
        yield pd.DataFrame({"conv": frame["conv"], "chunk": frame["chunk"], "table": tables})


def _chain(frames):
    for frame in frames:
        out = []
        for conv, chunks in zip(frame["conv"], frame["chunks"], strict=True):
            tables = [np.array(c["table"]).reshape(6, 6) for c in chunks]
            score, backs = tables[0][0], []
            for table in tables[1:]:
                ways = score[:, None] + table
                backs.append(ways.argmax(axis=0))
                score = ways.max(axis=0)
            ends = [int(score.argmax())]
            for back in reversed(backs):
                ends.append(int(back[ends[-1]]))
            ends.reverse()
            out += [(conv, c["chunk"], before, end) for c, before, end in zip(chunks, [-1, *ends], ends, strict=False)]
        yield pd.DataFrame(out, columns=["conv", "chunk", "before", "end"]).astype({"chunk": "int64", "before": "int32", "end": "int32"})


def _solve(frames):
    for frame in frames:
        out = []
        for conv, chunk, entries, before, end in zip(*(frame[c] for c in ("conv", "chunk", "entries", "before", "end")), strict=True):
            lines, codes = shown([e["text"] for e in entries])
            states = solved(codes, None if pd.isna(before) or before < 0 else int(before), None if pd.isna(end) else int(end))
            for k, (line, state) in enumerate(zip(lines, states, strict=True)):
                role, begins = STATES[state]
                out.append((conv, chunk, k, ROLES[role], begins, marker_of(line)[1] if begins else line))
        yield pd.DataFrame(out, columns=["conv", "chunk", "line", "role", "begins", "content"]).astype({"chunk": "int64", "line": "int32", "begins": bool})


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, rendered) from ``lines`` (conv_id, place, text).

    ``text`` is one or more lines; ``place`` orders the entries of a conversation.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    entries = lines.select(
        F.concat(F.when(F.col("conv_id").isNull(), "null").otherwise("id:"), key).alias("conv"),
        F.coalesce("place", F.lit(-1)).cast("long").alias("place"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    chunk = F.floor(F.col("place") / CHUNK).alias("chunk")
    chunks = entries.groupBy("conv", chunk).agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("entries"))
    chunks = materialise(chunks, "chunks")
    # Numbers only: the texts of a long conversation do not meet in one task.
    spans = chunks.groupBy("conv").agg(F.min("chunk").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = chunks.join(spans, "conv").withColumn("is_first", F.col("chunk") == F.col("head"))
    tables = several.select("conv", "chunk", "is_first", "entries")
    tables = tables.mapInPandas(_reduce, "conv string, chunk long, table array<double>")
    chained = tables.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "table"))).alias("chunks"))
    ends = chained.mapInPandas(_chain, "conv string, chunk long, before int, end int")
    known = chunks.select("conv", "chunk", "entries").join(ends, ["conv", "chunk"], "left")
    schema = "conv string, chunk long, line int, role string, begins boolean, content string"
    found = materialise(known.mapInPandas(_solve, schema), "states")
    return _turns(found)


def _turns(found: DataFrame) -> DataFrame:
    count = F.sum(F.col("begins").cast("long"))
    so_far = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = found.groupBy("conv", "chunk").agg(count.alias("own")).select("conv", "chunk", F.coalesce(F.sum("own").over(so_far), F.lit(0)).alias("begun"))
    inside = Window.partitionBy("conv", "chunk").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = found.join(begun, ["conv", "chunk"]).withColumn("turn", F.greatest(F.col("begun") + count.over(inside) - 1, F.lit(0)))
    place = F.struct("chunk", "line", "content")
    turns = numbered.groupBy("conv", "turn").agg(F.min_by("role", F.struct("chunk", "line")).alias("role"), F.sort_array(F.collect_list(place)).alias("lines"))
    content = F.trim(F.array_join("lines.content", "\n"))
    conv = F.when(F.col("conv").startswith("id:"), F.substring("conv", 4, 1 << 30))
    turns = turns.select(conv.alias("conv_id"), "turn", "role", content.alias("content"))
    return turns.withColumn("rendered", rendered(F.col("role"), F.col("content")))


def rendered(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("\n<|end|>"))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, text): turns as a log would hold them, with one of several marker styles and some markers missing."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    name = F.when(F.col("role") == "user", F.when(style < 2, "User").otherwise("Human")).when(F.col("role") == "assistant", F.when(style < 2, "Assistant").otherwise("AI"))
    name = F.coalesce(name, F.lit("System"))
    marker = F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": ")))
    marker = marker.when(style == 2, F.concat(F.lit("["), name, F.lit("] "))).otherwise(F.concat(F.lit("**"), name, F.lit("**: ")))
    left_out = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text = F.concat(F.when(left_out, "").otherwise(marker), F.coalesce("text", F.lit("")))
    return conversations.select("conv_id", F.col("turn").alias("place"), text.alias("text"))
