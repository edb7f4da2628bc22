"""Toxicity by a weighted finite-state pattern grammar (operator 9).

Words become symbols (insult, threat, target, negation, reported speech or
other).  Five transducers rewrite the symbols of a clause: insults that follow
each other strengthen each other; a target beside a hit raises it; a threat
passes only with a target near it, before or after (its output is held back
until the target has been read); a negation or a reporting verb before a hit
lowers it.  Their composition, one table over a product of states, scores every
clause that has an insult or a threat in one pass.  A text's strength is the
sum over its clauses; words outside matched clauses don't count.  The score is
a logistic function of the strength.

The insult lexicon (whole words, and stems of ``STEM_BYTES`` bytes for
languages that build words from them), the logistic curve and the weight of a
threat are fitted on labelled rows.  ``MAX_FIT_ROWS`` bounds that sample; near
copies, told by their least shingle, count once.  Scoring covers every row and
whole texts.

Defined results: null and empty texts have strength 0; labels of null or
unknown documents don't matter, and of several labels of one document the
greatest counts; a word that fits several entries takes the heaviest; without
labelled toxic rows nothing is learnt and every score is low; a score of 0.5 is
toxic; repeated rows repeat results; an empty table gives an empty table; very
long texts are read whole; further columns, whatever their names, are not read
by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, hash_bytes, id_and_text, lean, mix64, prefix_hash, span_hash, text_buffers, word_spans

MAX_FIT_ROWS = 30_000
STEM_BYTES = (4, 5, 6, 7)
#: A lexicon entry has at least so many toxic texts, as a number and a share, and so great a lift.
MIN_TEXTS, MIN_SHARE, MIN_LIFT = 3, 0.003, 12.0
MAX_STRENGTH = 24.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = range(6)

_SEED_WORDS = {
    THREAT: "kill hurt destroy beat burn shoot töten umbringen tuer frapper matar golpear",
    TARGET: "you your he she they them him her this that these those du ihr er sie tu vous il elle ils eux usted ustedes ellos él",
    NEGATION: "not never no isn aren wasn nicht kein keine nie pas jamais aucun nunca ni",
    REPORT: "said says called wrote quoted claimed sagte nannte dit appelé dijo llamó",
}
#: Weight of a threat where no labelled row speaks for another one, and factors that the grammar applies.
THREAT_WEIGHT = 1.0
REPEATED, TARGETED, NEGATED, REPORTED = 1.1, 1.2, 0.6, 0.8


@dataclass(frozen=True)
class Transducer:
    """``arcs[state][symbol] = (next state, output symbol, factor)``; state 0 starts."""

    arcs: tuple[tuple[tuple[int, int, float], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this writes."""
        states = {(0, 0): 0}
        queue, rows = [(0, 0)], []
        for a, b in queue:
            row = []
            for symbol in SYMBOLS:
                na, out, wa = self.arcs[a][symbol]
                nb, out, wb = other.arcs[b][out]
                if (na, nb) not in states:
                    states[na, nb] = len(states)
                    queue.append((na, nb))
                row.append((states[na, nb], out, wa * wb))
            rows.append(tuple(row))
        return Transducer(tuple(rows))


def within(trigger: int, reach: int, factor: float, on: tuple[int, ...]) -> Transducer:
    """For ``reach`` symbols after ``trigger``, symbols in ``on`` are weighted by ``factor``."""
    rows = []
    for left in range(reach + 1):
        row = [(max(0, left - 1), s, factor if left and s in on else 1.0) for s in SYMBOLS]
        row[trigger] = (reach, *row[trigger][1:])
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def beside(symbol: int, needs: int, reach: int) -> Transducer:
    """``symbol`` counts only within ``reach`` symbols of ``needs``, on either side.

    A state is how long ago ``needs`` was and how long ago an unmatched
    ``symbol`` was.  After ``needs``, ``symbol`` passes; before it, ``symbol``
    becomes OTHER and is written when ``needs`` comes, in its place.
    """
    states = [(a, b) for a in range(reach + 1) for b in range(reach + 1)]
    number = {state: i for i, state in enumerate(states)}
    rows = []
    for near, open_ in states:
        aged = max(0, near - 1), max(0, open_ - 1)
        row = [(number[aged], s, 1.0) for s in SYMBOLS]
        row[symbol] = (number[aged], symbol, 1.0) if near else (number[aged[0], reach], OTHER, 1.0)
        row[needs] = (number[reach, 0], symbol if open_ else needs, 1.0)
        rows.append(tuple(row))
    return Transducer(tuple(rows))


HITS = (INSULT, THREAT)
INSULTS = within(INSULT, 3, REPEATED, (INSULT,))
TARGETS = within(TARGET, 4, TARGETED, HITS)
THREATS = beside(THREAT, TARGET, 5)
NEGATIONS = within(NEGATION, 3, NEGATED, HITS)
REPORTS = within(REPORT, 6, REPORTED, HITS)
PARTS = (INSULTS, TARGETS, THREATS, NEGATIONS, REPORTS)
GRAMMAR = INSULTS.then(TARGETS).then(THREATS).then(NEGATIONS).then(REPORTS)


@dataclass
class Model:
    """Lexicon of word and stem hashes with weights, and the logistic curve."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -2.0
    slope: float = 1.0
    threat: float = THREAT_WEIGHT

    def score(self, strength: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.bias + self.slope * strength)))


def feature_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Hash arrays over the words: whole words, then stems of each length (0: too short)."""
    prefix = prefix_hash(data)
    yield span_hash(prefix, starts, ends)
    for n in STEM_BYTES:
        stem = span_hash(prefix, starts, np.minimum(starts + n, ends)) ^ np.uint64(n)
        stem[ends - starts <= n] = 0
        yield stem


class Scanner:
    """Finds lexicon words and scores the clauses around them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        order = np.argsort(model.words)
        self.words, self.weights = model.words[order], model.weights[order]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.words >> np.uint64(44)).astype(np.int64)] = True
        self.seeds = np.array([(hash_bytes(w.encode()), s) for s, ws in _SEED_WORDS.items() for w in ws.split()], dtype=[("h", np.uint64), ("s", np.int64)])
        self.seeds.sort(order="h")

    def weights_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of each word by its heaviest entry (0: none), and the whole-word hashes."""
        out = np.zeros(len(starts))
        whole = None
        for hashes in feature_hashes(data, starts, ends):
            whole = hashes if whole is None else whole
            maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            if len(maybe) and len(self.words):
                at = np.minimum(np.searchsorted(self.words, hashes[maybe]), len(self.words) - 1)
                same = self.words[at] == hashes[maybe]
                out[maybe[same]] = np.maximum(out[maybe[same]], self.weights[at[same]])
        return out, whole

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.seeds["h"], hashes), len(self.seeds) - 1)
        return np.where(self.seeds["h"][at] == hashes, self.seeds["s"][at], OTHER)

    def matches(self, part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights of insults, and of threats, in the matched clauses of each row."""
        low = LOWER[part]
        insults, threats = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        starts, ends, row = word_spans(part, offsets)
        if not len(starts):
            return insults, threats
        weights, whole = self.weights_of(low, starts, ends)
        symbols = self.symbols(whole)
        symbols[weights > 0] = INSULT
        hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if not len(hits):
            return insults, threats
        marks = np.flatnonzero((part == 46) | (part == 33) | (part == 63) | (part == 59) | (part == 10))
        # A clause ends with a mark or a row; words of one clause share this number.
        clause = np.searchsorted(marks, starts) + row
        arcs = GRAMMAR.arcs
        for c in np.unique(clause[hits]):
            lo, hi = np.searchsorted(clause, c), np.searchsorted(clause, c, "right")
            state = 0
            for symbol, weight in zip(symbols[lo:hi].tolist(), weights[lo:hi].tolist()):
                state, symbol, factor = arcs[state][symbol]
                if symbol == INSULT:
                    insults[row[lo]] += weight * factor
                elif symbol == THREAT:
                    threats[row[lo]] += factor
        return insults, threats

    def strengths(self, part: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        insults, threats = self.matches(part, offsets)
        return np.minimum(insults + self.model.threat * threats, MAX_STRENGTH)


def _labelled_sample(labels: DataFrame, held_out: Column) -> dict[int, int]:
    """At most about ``MAX_FIT_ROWS`` labels (by hash of the id) that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out)
    n = usable.count()
    share = int((1 << 20) * min(1.0, MAX_FIT_ROWS / max(1, n)))
    rows = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()
    return {r["doc_id"]: r["toxic"] for r in rows}


def _sampled(batch: pa.RecordBatch, wanted: np.ndarray) -> pa.RecordBatch:
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(np.isin(ids, wanted)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> Model:
    """Learn the lexicon and the curve from labelled documents."""
    context = docs.sparkSession.sparkContext
    sample = _labelled_sample(labels, F.lit(False) if held_out is None else held_out)
    if not any(sample.values()):
        return Model(bias=-6.0)
    frame = id_and_text(docs)
    wanted = context.broadcast(np.array(sorted(sample), dtype=np.int64))

    def least_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _sampled(batch, wanted.value)
            data, offsets = text_buffers(batch.column(1))
            least = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, j, part, offs in blocks(data, offsets):
                starts, ends, row = word_spans(part, offs)
                if not len(starts):
                    continue
                h = span_hash(prefix_hash(LOWER[part]), starts, ends)
                two = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h
                two = mix64(two[:-1] * np.uint64(3) + h[2:]) if len(h) > 2 else h
                heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                heads = heads[heads < len(two)]
                if len(heads):
                    least[i + row[heads]] = np.minimum.reduceat(two, heads)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least.view(np.int64))], ["doc_id", "least"])

    kept = frame.mapInArrow(lean(least_shingles), "doc_id long, least long").groupBy("least").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct().collect()
    kept_ids = np.array(sorted(r["doc_id"] for r in kept), dtype=np.int64)
    toxic_ids = np.array([i for i in kept_ids.tolist() if sample[i]], dtype=np.int64)
    n_toxic, n_clean = max(1, len(toxic_ids)), max(1, len(kept_ids) - len(toxic_ids))
    some, toxic = context.broadcast(kept_ids), context.broadcast(toxic_ids)

    def features(ids, only):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = only.value if only is not None else None
            for batch in batches:
                batch = _sampled(batch, ids.value)
                marked = np.isin(batch.column(0).to_numpy(zero_copy_only=False), toxic.value)
                data, offsets = text_buffers(batch.column(1))
                for i, j, part, offs in blocks(data, offsets):
                    starts, ends, row = word_spans(part, offs)
                    if not len(starts):
                        continue
                    hashes, rows = [], []
                    for h in feature_hashes(LOWER[part], starts, ends):
                        ok = h != 0
                        if lexicon is not None:
                            ok &= np.isin(h, lexicon)
                        hashes.append(h[ok])
                        rows.append(row[ok])
                    pair = np.unique(np.rec.fromarrays([np.concatenate(hashes), np.concatenate(rows)], names="h,r"))
                    h, first = np.unique(pair.h, return_index=True)
                    n = np.diff(np.append(first, len(pair)))
                    t = np.add.reduceat(marked[i + pair.r].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "toxic", "clean"])

        return run

    counts = "h long, toxic long, clean long"
    need = max(MIN_TEXTS, int(MIN_SHARE * n_toxic))
    common = frame.mapInArrow(lean(features(toxic, None)), counts).groupBy("h").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= need).collect()
    candidates = np.array([r["h"] for r in common], dtype=np.int64).view(np.uint64)
    model = Model()
    if len(candidates):
        held = context.broadcast(candidates)
        rows = frame.mapInArrow(lean(features(some, held)), counts).groupBy("h").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).orderBy("h").collect()
        t, c = (np.array([r[k] for r in rows], dtype=float) for k in ("t", "c"))
        lift = (t + 0.5) / (n_toxic + 1) / ((c + 0.5) / (n_clean + 1))
        good = lift >= MIN_LIFT
        model.words = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)[good]
        model.weights = np.log(lift[good])
    scanner = context.broadcast(Scanner(model))

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _sampled(batch, some.value)
            marked = np.isin(batch.column(0).to_numpy(zero_copy_only=False), toxic.value)
            data, offsets = text_buffers(batch.column(1))
            for i, j, part, offs in blocks(data, offsets):
                insults, threats = scanner.value.matches(part, offs)
                columns = (np.round(np.minimum(insults, MAX_STRENGTH) * 4), np.round(np.minimum(threats, MAX_STRENGTH) * 4), marked[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["x", "t", "y"])

    bins = frame.mapInArrow(lean(curve), "x long, t long, y long").groupBy("x", "t").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("x", "t").collect()
    model.bias, model.slope, model.threat = _logistic(*(np.array([r[k] for r in bins], dtype=float) for k in ("x", "t", "y", "n")))
    return model


def _logistic(x: np.ndarray, t: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Regularised logistic fit of y positives among n at insults x / 4 and threats t / 4 (Newton).

    A threat weighs as much as ``THREAT_WEIGHT`` of insults unless labelled rows with threats say otherwise.
    """
    design = np.stack([np.ones_like(x), x / 4, t / 4], axis=1)
    w = prior = np.array([0.0, 0.0, THREAT_WEIGHT])
    w = w + np.array([-2.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - n * p) - 0.1 * (w - prior)
        hessian = (design.T * (n * p * (1 - p))) @ design + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    slope = float(max(w[1], 0.0))
    return float(w[0]), slope, float(max(w[2], 0.0)) / slope if slope else 0.0


def _strengths(batch: pa.RecordBatch, scanner: Scanner, column: int = 1) -> np.ndarray:
    data, offsets = text_buffers(batch.column(column))
    out = [scanner.strengths(part, offs) for _, _, part, offs in blocks(data, offsets)]
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scanner.value.model.score(_strengths(batch, scanner.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, columns unchanged."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(model))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scanner.value.model.score(_strengths(batch, scanner.value, at_text))
            yield batch.filter(pa.array(score < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out_fold(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
