"""Chat formatting by transcript parsing with a hidden Markov model (operator 5).

A transcript is rows of raw text in an order; a row may hold several lines and
several turns.  Hidden states are (role, first line of a turn or a further
one).  A line is observed as its speaker marker (``User:``, ``### Response``,
``AI:`` ...), the size of the rest, whether it asks and whether it begins a row.  Viterbi recovers the
best path, turns are cut where it begins one (a line that held nothing but its
marker is left out), and each turn is rendered as

    <|role|>\\n text \\n<|end|>

Start, transition and line tables are counted over labelled conversations; how
often markers fail is a parameter.

Rows of a transcript are cut into blocks of ``BLOCK_ROWS``, so that no task
holds a whole transcript.  For transcripts of several blocks the best path is
still exact: each block gives its 6 x 6 table of best scores from state to
state, the small tables are chained per transcript, and each block is then
decoded between its fixed end states.  The pieces of a turn that block bounds
cut are joined again, and turns are numbered through the whole transcript.

Defined results: rows of a null transcript id are dropped; null texts are
empty rows and give no line, so a transcript of them gives no turn; rows of
equal order are taken by text; unknown or null roles are not counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, lean

ROLES = ("system", "user", "assistant")
BLOCK_ROWS = 512
#: Ids of transcripts of several blocks are broadcast up to this number (8 bytes each), else joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: How often the first line of a turn has its marker, none, or another role's.
MARKER_RIGHT, MARKER_NONE, MARKER_OTHER = 0.80, 0.18, 0.01
#: How often a further line looks like a marker all the same.
MARKER_STRAY = 0.002
#: How often a turn begins with a row of its own, and how often a further line begins a row.
ROW_AT_BEGIN, ROW_AT_FURTHER = 0.97, 0.03
SIZES, STATES = 8, 2 * len(ROLES)

_NAMES = {
    "system": "system|sys|instructions",
    "user": "user|human|customer|question|q|prompt|instruction|me|utilisateur|benutzer|usuario",
    "assistant": "assistant|ai|bot|agent|answer|a|response|model|gpt|assistent|asistente",
}
_MARKERS = [(i, re.compile(rf"\s*(?:#+\s*|\*\*|\[|<\|?|>\s*)?(?:{_NAMES[r]})\s*(?:\*\*\s*:|:\s*\*\*|\]\s*:?|\|?>|:|-(?=\s))\s*|\s*#+\s*(?:{_NAMES[r]})\s*$", re.I)) for i, r in enumerate(ROLES)]


def marker_of(line: str) -> tuple[int, str]:
    """Marker class (0 none, 1 + role) and the rest of the line."""
    for role, pattern in _MARKERS:
        m = pattern.match(line)
        if m:
            return role + 1, line[m.end() :]
    return 0, line


def size_of(chars: int) -> int:
    return min(SIZES - 1, max(0, chars).bit_length() // 2 if chars < 1 << 16 else SIZES - 1)


@dataclass
class Model:
    start: np.ndarray  # log p of the first line's state
    move: np.ndarray  # log p of the next state
    emit: np.ndarray  # log p of (state, marker, size, asks)


def fit(conversations: DataFrame) -> Model:
    """Count roles, moves and lines over all labelled rows (key: conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    number = {r: i for i, r in enumerate(ROLES)}
    first, move = np.ones(3), np.ones((3, 3))
    for r in rows.where("turn = 0").groupBy("role").count().collect():
        first[number[r["role"]]] += r["count"]
    ahead = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("later"))
    for r in rows.select("conv_id", "turn", "role").join(ahead, ["conv_id", "turn"]).groupBy("role", "later").count().collect():
        move[number[r["role"]], number[r["later"]]] += r["count"]
    size, asks = np.ones((STATES, SIZES)), np.ones((STATES, 2))
    lines = rows.select("role", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    chars = F.length("line")
    binned = F.least(F.lit(SIZES - 1), F.when(chars >= 1 << 16, SIZES - 1).otherwise(F.floor(F.when(chars > 0, F.floor(F.log2(chars)) + 1).otherwise(0) / 2)))
    for r in lines.groupBy("role", (F.col("at") > 0).alias("further"), binned.alias("size"), F.rtrim("line").endswith("?").alias("asks")).count().collect():
        s = 2 * number[r["role"]] + int(r["further"])
        size[s, int(r["size"])] += r["count"]
        asks[s, int(r["asks"])] += r["count"]
    size /= size.sum(axis=1, keepdims=True)
    asks /= asks.sum(axis=1, keepdims=True)
    return _assemble(first, move, size, asks, rows, lines, number)


def _assemble(first, move, size, asks, rows, lines, number) -> Model:
    turns, further = np.ones(3), np.ones(3)
    for r in lines.groupBy("role").agg(F.sum((F.col("at") == 0).cast("int")).alias("t"), F.sum((F.col("at") > 0).cast("int")).alias("f")).collect():
        turns[number[r["role"]]] += r["t"]
        further[number[r["role"]]] += r["f"]
    goes_on = further / (turns + further)
    start = np.full(STATES, -np.inf)
    start[0::2] = np.log(first / first.sum())
    table = np.full((STATES, STATES), 1e-12)
    for a in range(3):
        for state in (2 * a, 2 * a + 1):
            table[state, 2 * a + 1] = goes_on[a]
            table[state, 0::2] = (1 - goes_on[a]) * move[a] / move[a].sum()
    marker = np.empty((STATES, 4))
    for a in range(3):
        marker[2 * a] = [MARKER_NONE, *[MARKER_RIGHT if b == a else MARKER_OTHER for b in range(3)]]
        marker[2 * a + 1] = [1 - 3 * MARKER_STRAY, *[MARKER_STRAY] * 3]
    emit = np.log(marker)[:, :, None, None] + np.log(size)[:, None, :, None] + np.log(asks)[:, None, None, :]
    return Model(start, np.log(table), emit)


_ROW = np.array([ROW_AT_BEGIN, ROW_AT_FURTHER] * len(ROLES))
_ROW_START, _ROW_INSIDE = np.log(_ROW), np.log(1 - _ROW)


def observe(rows: list[str], model: Model) -> tuple[list[str | None], np.ndarray]:
    """Lines without markers (None: nothing else), and the log-likelihood of each under each state."""
    lines, seen = [], []
    for text in rows:
        if text == "":
            continue
        for at, line in enumerate(text.split("\n")):
            m, rest = marker_of(line)
            lines.append(None if m and not rest else rest)
            seen.append(model.emit[:, m, size_of(len(rest)), int(rest.rstrip().endswith("?"))] + (_ROW_START if at == 0 else _ROW_INSIDE))
    return lines, np.array(seen) if seen else np.zeros((0, STATES))


def best_path(model: Model, seen: np.ndarray, entry: int | None, leave: int | None) -> list[int]:
    """Viterbi over the lines of a block; the state before it and its last state may be fixed."""
    if not len(seen):
        return []
    score = (model.start if entry is None else model.move[entry]) + seen[0]
    back = np.zeros((len(seen), STATES), dtype=np.int64)
    for i in range(1, len(seen)):
        step = score[:, None] + model.move
        back[i] = step.argmax(axis=0)
        score = step[back[i], np.arange(STATES)] + seen[i]
    state = int(score.argmax()) if leave is None else leave
    path = [state]
    for i in range(len(seen) - 1, 0, -1):
        state = int(back[i, state])
        path.append(state)
    return path[::-1]


def chain(model: Model, seen: np.ndarray, begins: bool) -> np.ndarray:
    """Best scores from each state before a block (a start row if it begins) to each at its end."""
    table = (np.tile(model.start, (STATES, 1)) if begins else model.move) + seen[0]
    for row in seen[1:]:
        table = (table[:, :, None] + model.move[None]).max(axis=1) + row
    return table


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first ``width`` columns, across batches."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def parse(transcripts: DataFrame, model: Model, key: str = "conv_id", order: str = "turn", text: str = "text", block_rows: int | None = None) -> DataFrame:
    """``conv_id, block, turn, role, text, continued`` - one row per recovered turn.

    ``turn`` counts within the transcript; ``block`` is the one in which the
    turn begins.  Turns are whole, so ``continued`` is never set.
    """
    size = block_rows or BLOCK_ROWS
    held = transcripts.sparkSession.sparkContext.broadcast(model)
    rows = transcripts.select(F.col(key).cast("long").alias("conv_id"), F.col(order).cast("long").alias("seq"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", F.floor(F.coalesce("seq", F.lit(0)) / size).cast("long").alias("block"), "seq", "text")
    long = checkpoint(rows.where("block <> 0 and text <> ''").select("conv_id").distinct())
    n_long = long.count()
    long = F.broadcast(long) if n_long <= MAX_BROADCAST_IDS else long

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), group in _groups(batches, 2):
            _, seen = observe([t for _, t in group], held.value)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block]), pa.array([seen.ravel().tolist() if len(seen) == 1 else None], pa.list_(pa.float64())), pa.array([[x for y in (chain(held.value, seen, True), chain(held.value, seen, False)) for x in y.ravel().tolist()]], pa.list_(pa.float64()))], ["conv_id", "block", "one", "best"])

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        score, backs = None, []
        for i, flat in enumerate(pdf["best"]):
            table = np.asarray(flat).reshape(2, STATES, STATES)[0 if i == 0 else 1]
            step = table if score is None else score[:, None] + table
            backs.append(step.argmax(axis=0))
            score = step.max(axis=0) if score is not None else table[0]
        leave = [int(score.argmax())]
        for back in backs[:0:-1]:
            leave.append(int(back[leave[-1]]))
        leave = leave[::-1]
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "block": pdf["block"].to_numpy(), "entry": [-1, *leave[:-1]], "leave": leave})

    def dealt(frame: DataFrame, *more: str) -> DataFrame:
        return frame.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", *more, "seq", "text")

    fixed = dealt(rows.join(long, "conv_id", "left_semi")).mapInArrow(lean(tables), "conv_id long, block long, one array<double>, best array<double>").select("conv_id", "block", "best").groupBy("conv_id").applyInPandas(ends, "conv_id long, block long, entry int, leave int")
    short = (rows.join(long, "conv_id", "left_anti") if n_long else rows).select("conv_id", "block", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("int").alias("leave"), "seq", "text")
    cut = rows.join(long, "conv_id", "left_semi").join(fixed, ["conv_id", "block"]).select("conv_id", "block", "entry", "leave", "seq", "text")

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (conv, block, entry, leave), group in _groups(batches, 4):
            lines, seen = observe([t for _, t in group], held.value)
            path = best_path(held.value, seen, None if entry is None or entry < 0 else entry, leave)
            cuts = [i for i, s in enumerate(path) if s % 2 == 0 or i == 0] + [len(path)]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                out.append((conv, block, n, ROLES[path[a] // 2], "\n".join(kept) if (kept := [x for x in lines[a:b] if x is not None]) else None, path[a] % 2 == 1))
            if len(out) >= 2000:
                yield _turn_batch(out)
                out = []
        if out:
            yield _turn_batch(out)

    kinds = "conv_id long, block long, turn long, role string, text string, continued boolean"
    found = dealt(short, "entry", "leave").mapInArrow(lean(turns), kinds)
    if n_long:
        found = found.unionByName(_whole(checkpoint(dealt(cut, "entry", "leave").mapInArrow(lean(turns), kinds))))
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def _whole(pieces: DataFrame) -> DataFrame:
    """Whole turns from those of each block; only turns that a bound cuts are gathered."""
    along = W.partitionBy("conv_id").orderBy("block")
    per = pieces.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.max(F.col("continued").cast("long")).alias("leads"))
    before = F.coalesce(F.sum(F.col("n") - F.col("leads")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("conv_id", "block", "n", "leads", before.alias("before"), F.coalesce(F.lead("leads").over(along), F.lit(0)).alias("follows"))
    is_cut = F.col("continued") | ((F.col("turn") == F.col("n") - 1) & (F.col("follows") == 1))
    rows = pieces.join(per, ["conv_id", "block"]).select("conv_id", "block", (F.col("before") + F.col("turn") - F.col("leads")).alias("turn"), "role", "text", is_cut.alias("is_cut"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"])
    joined = rows.where("is_cut").groupBy("conv_id", "turn").agg(F.min("block").alias("block"), F.min_by("role", "block").alias("role"), F.array_join(parts, "\n").alias("text"))
    return rows.where("not is_cut").drop("is_cut").unionByName(joined).withColumn("continued", F.lit(False))


def _turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "block", "turn", "role", "text", "continued"])


def rendered(turns: DataFrame) -> DataFrame:
    """Recovered turns with their canonical rendering."""
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


#: Marker styles in which :func:`as_transcripts` writes conversations out.
STYLES = (("System:", "User:", "Assistant:"), ("System -", "Human:", "AI:"), ("### System", "### Instruction", "### Response"), ("[system]", "[user]", "[assistant]"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversation rows as raw transcript rows ``conv_id, turn, text``, without their roles.

    Each conversation has one marker style (by hash of its id); one turn in
    eight, by hash of id and turn, loses its marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    names = F.lower(F.trim("role"))
    marker = F.lit(None).cast("string")
    for i, words in enumerate(STYLES):
        for role, word in zip(ROLES, words):
            joint = "\n" if word.startswith("###") else " "
            marker = F.when((style == i) & (names == role), F.lit(word + joint)).otherwise(marker)
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select("conv_id", "turn", F.when(lost | marker.isNull(), text).otherwise(F.concat(marker, text)).alias("text"))
