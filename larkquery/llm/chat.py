"""Chat formatting: roles of a raw transcript by a hidden Markov model, then canonical turns.

A transcript is lines.  Each line is seen as features: the speaker-like prefix (a short name, perhaps in brackets, before
a colon or the like; none, unknown, or one of those learned from labelled conversations), and the classes of its
length, its opening and its ending.  The states are the roles, each as first line of a turn or as a further line;
Viterbi decoding gives the likeliest states of all lines, so a turn whose prefix is lost is still told from its
neighbours.  A prefix that mostly begins turns is taken for a speaker marker and left out of the text.  Turns are
rendered in one form, in which a text cannot forge the marks of a turn.  The model's tables are smoothed counts over
labelled conversations, summed by Spark over all of them.

Rows of a conversation are kept in blocks of at most ``SEGMENT`` turns: consecutive turns, and where a segment has more
rows than turns (turns that repeat or are null), parts of it, numbered by counts per turn and hash bucket, as one
conversation may hold a large share of all rows.  A conversation is one chain all the same: each block is a matrix of
best scores from the state before it to its last state, the matrices multiply (maximum for sum, sum for product) level
by level in groups of ``FAN`` neighbours, and back down the levels each block gets the scores of all that is before and
after it.  With these its own lines are decoded as the whole conversation's would be; only where two ways are equally
likely the choice may differ.

Defined cases: null texts are one empty line; null turns come first, and null roles are turns without a marker that
the model does not learn from; unknown roles likewise; null conversation ids are one conversation; repeated rows all
count; ties in turn are ordered by role and text inside a part, and dealt to the parts of a large segment by hash;
without labelled turns the tables are uniform; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, write_shared

ROLES = ["system", "user", "assistant"]
#: How the raw logs of ``raw_transcripts`` name speakers.  The reader does not know them.
STYLES = {
    "system": ["System: ", "[SYSTEM] ", "<system> ", "system> "],
    "user": ["User: ", "Human: ", "Q: ", "user> "],
    "assistant": ["Assistant: ", "AI: ", "A: ", "assistant> "],
}
SEGMENT = 256
#: Hash buckets of the rows of one turn of a large segment.
BUCKETS = 64
#: Neighbouring blocks whose matrices are multiplied in one step.
FAN = 64
#: Prefixes that the model tells apart, the most frequent ones; all others count as unknown.
MOST_PREFIXES = 1000
LENGTHS = (0, 15, 30, 50, 80, 120, 170, 230, 300, 450, 700)
_prefix = re.compile(r"([<\[(*#]{0,2}[^\W\d_][\w.'-]{0,15}(?: [\w.'-]{1,15}){0,2} ?[:>\])*]{1,3}) ")
OPENINGS, ENDINGS = 6, 7
N = 2 * len(ROLES)
#: The state before the first line.
BEGIN = N


def _opening(line: str) -> int:
    if not line:
        return 0
    c = line[0]
    return 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c.isspace() else 5


def _ending(line: str) -> int:
    line = line.rstrip()
    return 0 if not line else 1 + ".?!:,".find(line[-1]) if line[-1] in ".?!:," else 6


def split_prefix(line: str) -> tuple[str | None, str]:
    """(the speaker-like prefix in lower case or None, what follows it)."""
    m = _prefix.match(line)
    return (m[1].lower(), line[m.end() :]) if m else (None, line)


def line_classes(rest: str) -> tuple[int, int, int]:
    """(length, opening, ending) class of a line behind its prefix."""
    return sum(len(rest) > x for x in LENGTHS), _opening(rest), _ending(rest)


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    opening: np.ndarray
    ending: np.ndarray
    prefixes: dict[str, int] = field(default_factory=dict)
    #: Prefixes that mostly begin a turn.
    speakers: frozenset[str] = frozenset()

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, int], int], prefixes: list[str] = ()) -> Hmm:
        """counts: (table, state, value): how often.  Marker values: 0 none, 1 unknown, 2 and on: ``prefixes``."""

        def table(kind, rows, cols, allowed=None):
            t = np.full((rows, cols), 0.5)
            for (k, a, b), n in counts.items():
                if k == kind:
                    t[a, b] += n
            if allowed is not None:
                t *= allowed
            with np.errstate(divide="ignore"):
                return np.log(t / t.sum(1, keepdims=True))

        # states: role, and 3 + role for a further line; a further line follows a line of its own role only
        may = np.array([[1 if b < 3 or b - 3 == a % 3 else 0 for b in range(N)] for a in range(N)])
        markers = max(1 + len(ROLES), 2 + len(prefixes))
        number = {p: 2 + i for i, p in enumerate(prefixes)}
        first = lambda i, states: sum(counts.get(("marker", s, i), 0) for s in states)
        speakers = frozenset(p for p, i in number.items() if first(i, range(3)) > 9 * first(i, range(3, N)))
        return cls(
            table("start", 1, N, np.array([[1] * 3 + [0] * 3]))[0], table("step", N, N, may), table("marker", N, markers), table("length", N, len(LENGTHS) + 1),
            table("opening", N, OPENINGS), table("ending", N, ENDINGS), number, speakers,
        )

    def read(self, transcript: str) -> tuple[np.ndarray, list[str]]:
        """(scores of each state for each line, lines without the speakers' markers)."""
        codes, lines = [], []
        for line in transcript.split("\n"):
            prefix, rest = split_prefix(line)
            codes.append((0 if prefix is None else self.prefixes.get(prefix, 1), *line_classes(rest)))
            lines.append(rest if prefix in self.speakers else line)
        marker, length, opening, ending = zip(*codes, strict=True)
        return self.emissions(marker, length, opening, ending), lines

    def emissions(self, marker, length, opening=None, ending=None) -> np.ndarray:
        out = self.marker[:, list(marker)] + self.length[:, list(length)]
        for table, values in ((self.opening, opening), (self.ending, ending)):
            if values is not None:
                out = out + table[:, list(values)]
        return out

    def _steps(self) -> np.ndarray:
        """From a state or ``BEGIN`` to a state."""
        return np.concatenate([self.step, self.start[None]])

    def transfer(self, emit: np.ndarray) -> np.ndarray:
        """Best scores through these lines from the state before them (or ``BEGIN``) to the last one's state."""
        best = self._steps() + emit[:, 0]
        for i in range(1, emit.shape[1]):
            best = (best[:, :, None] + self.step[None]).max(1) + emit[:, i]
        return np.concatenate([best, np.full((N + 1, 1), -np.inf)], 1)

    def decode(self, emit: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> list[int]:
        """The likeliest states; before: scores of the states (and ``BEGIN``) up to the first line, after: of all that follows."""
        best = self.start + emit[:, 0] if before is None else (before[:, None] + self._steps()).max(0) + emit[:, 0]
        back = []
        for i in range(1, emit.shape[1]):
            paths = best[:, None] + self.step
            came = paths.argmax(0)
            back.append(came)
            best = paths[came, np.arange(N)] + emit[:, i]
        state = int((best if after is None else best + after[:N]).argmax())
        states = [state]
        for came in reversed(back):
            state = int(came[state])
            states.append(state)
        return states[::-1]

    def viterbi(self, markers: list[int], lengths: list[int]) -> list[int]:
        """The likeliest states of one whole chain of lines."""
        return self.decode(self.emissions(markers, lengths))


def raw_transcripts(conversations: DataFrame, lose_one_in: int = 5) -> DataFrame:
    """Labelled turns as raw logs: conv_id, segment, part, transcript, truth (array of role and line count).

    The style of markers depends on the conversation; one turn in ``lose_one_in`` has lost its marker.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    style = F.crc32(key.cast("binary")) % 4
    lost = F.crc32(F.concat(key, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary")) % lose_one_in == 0
    marker = F.coalesce(*[F.when(F.col("role") == r, F.get(F.array(*[F.lit(x) for x in m]), style.cast("int"))) for r, m in STYLES.items()], F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(
        "conv_id",
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / SEGMENT).alias("segment"),
        F.struct(
            "turn",
            F.when(F.col("role").isin(ROLES), F.col("role")).alias("role"),
            F.concat(F.when(lost, "").otherwise(marker), text).alias("text"),
            F.size(F.split(text, "\n", -1)).alias("lines"),
        ).alias("t"),
    )
    counts = turns.groupBy("conv_id", "segment").count().where(F.col("count") > SEGMENT)
    large = write_shared(counts.select(F.col("conv_id").alias("large_id"), F.col("segment").alias("large_segment")), "large-segments")
    in_large = F.col("conv_id").eqNullSafe(F.col("large_id")) & (F.col("segment") == F.col("large_segment"))
    small = turns.join(large, in_large, "left_anti").select("conv_id", "segment", F.lit(0).cast("long").alias("part"), "t", F.lit(1).cast("long").alias("n"))
    rows = small.unionByName(_parts(turns.join(large, in_large, "left_semi")))
    whole = rows.groupBy("conv_id", "segment", "part").agg(F.collect_list(F.struct("t", "n")).alias("all"))
    whole = whole.withColumn("ts", F.sort_array(F.flatten(F.transform("all", lambda x: F.array_repeat(x["t"], x["n"].cast("int"))))))
    return whole.select("conv_id", "segment", "part", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("transcript"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["lines"].alias("lines"))).alias("truth"))


def _parts(turns: DataFrame) -> DataFrame:
    """Rows of large segments, equal ones as one with their number n, each in its part of ``SEGMENT`` rows or in several."""
    equal = turns.groupBy("conv_id", "segment", "t").agg(F.count("*").alias("n"))
    keyed = equal.withColumns({"turn": F.col("t.turn"), "hash": F.xxhash64("t")}).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    keys = ["conv_id", "segment", "turn", "bucket"]
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = keyed.groupBy(*keys).agg(F.sum("n").alias("n"))
    offsets = counted.select(*[F.col(k).alias(f"o_{k}") for k in keys], before(W.partitionBy("conv_id", "segment").orderBy("turn", "bucket")).alias("offset"))
    inside = keyed.withColumn("inside", before(W.partitionBy(*keys).orderBy("hash", "t")))
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys]
    at = inside.join(offsets, same).withColumn("at", F.col("offset") + F.col("inside"))
    part = F.explode(F.sequence(F.floor(F.col("at") / SEGMENT), F.floor((F.col("at") + F.col("n") - 1) / SEGMENT)))
    dealt = at.select("conv_id", "segment", part.alias("part"), "t", "at", "n")
    held = F.least(F.col("at") + F.col("n"), (F.col("part") + 1) * SEGMENT) - F.greatest(F.col("at"), F.col("part") * SEGMENT)
    return dealt.select("conv_id", "segment", "part", "t", held.alias("n"))


def _counted(batch: pa.RecordBatch):
    counts: dict[tuple[str, int, int, str | None], int] = {}
    for transcript, truth in zip(batch.column("transcript").to_pylist(), batch.column("truth").to_pylist(), strict=True):
        lines, at, before = transcript.split("\n"), 0, None
        for turn in truth:
            for k in range(turn["lines"]):
                state = None if turn["role"] is None else ROLES.index(turn["role"]) + (3 if k else 0)
                prefix, rest = split_prefix(lines[at])
                length, opening, ending = line_classes(rest)
                at += 1
                seen = []
                if state is not None:
                    seen = [("marker", state, 0 if prefix is None else 1, prefix), ("length", state, length, None), ("opening", state, opening, None), ("ending", state, ending, None)]
                    if at == 1:
                        seen.append(("start", 0, state, None))
                    elif before is not None:
                        seen.append(("step", before, state, None))
                before = state
                for key in seen:
                    counts[key] = counts.get(key, 0) + 1
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*((*key, n) for key, n in counts.items()), strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["kind", "a", "b", "prefix", "n"])


def fit_hmm(transcripts: DataFrame) -> Hmm:
    """From every transcript with truth; crc32 of the conversation modulo 3 is 1: held out.

    Of prefixes the ``MOST_PREFIXES`` most frequent ones reach the driver.
    """
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    counts = arrow_map(transcripts.where(~held_out).select("transcript", "truth"), _counted, "kind string, a long, b long, prefix string, n long")
    counts = write_shared(counts.groupBy("kind", "a", "b", "prefix").agg(F.sum("n").alias("n")), "hmm-counts", files=1)
    top = counts.where("prefix IS NOT NULL").groupBy("prefix").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "prefix").limit(MOST_PREFIXES)
    prefixes = [r["prefix"] for r in top.collect()]
    known = F.when(F.col("prefix").isin(prefixes), F.col("prefix")) if prefixes else F.lit(None).cast("string")
    rows = counts.withColumn("prefix", known).groupBy("kind", "a", "b", "prefix").agg(F.sum("n").alias("n")).collect()
    number = {p: 2 + i for i, p in enumerate(prefixes)}
    return Hmm.from_counts({(r["kind"], r["a"], number.get(r["prefix"], r["b"])): r["n"] for r in rows}, prefixes)


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """The (role, text) of lines by their states; a further line at the very start continues a turn from before."""
    turns: list[tuple[str, list[str]]] = []
    for state, line in zip(states, lines, strict=True):
        if state < 3 or not turns:
            turns.append((ROLES[state % 3], [line]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(lines)) for role, lines in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """One form for all turns; in a text, "<|" gets a backslash inside, and one more where it has some."""
    return "".join(f"<|{role}|>\n{_mark.sub(_guard, text)}\n<|end|>\n" for role, text in turns)


_mark, _turn, _guarded = re.compile(r"<(\\*)\|"), re.compile(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", re.S), re.compile(r"<\\(\\*)\|")


def _guard(m: re.Match) -> str:
    return f"<\\{m[1]}|"


def parse_rendered(rendered: str) -> list[tuple[str, str]]:
    """The turns that ``render`` wrote."""
    return [(m[1], _guarded.sub(lambda x: f"<{x[1]}|", m[2])) for m in _turn.finditer(rendered)]


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices of best scores."""
    return (a[:, :, None] + b[None]).max(1)


def _matrix(values) -> np.ndarray:
    return np.array(values, np.float64).reshape(N + 1, N + 1)


_NODE = "conv_id long, a long, b long, m array<double>"


def _neighbours(nodes: DataFrame, by: str) -> DataFrame:
    """Groups of up to ``FAN`` neighbours in order, under their number one level up."""
    up = (F.floor(F.col("a") / FAN), F.lit(0)) if by == "a" else (F.col("a"), F.floor(F.col("b") / FAN))
    rows = nodes.select("conv_id", up[0].cast("long").alias("ga"), up[1].cast("long").alias("gb"), F.struct("a", "b", "m").alias("node"))
    return write_shared(rows.groupBy("conv_id", "ga", "gb").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "chain-level")


def _multiplied(batch: pa.RecordBatch):
    out = []
    for nodes in batch.column("nodes").to_pylist():
        m = _matrix(nodes[0]["m"])
        for x in nodes[1:]:
            m = _best(m, _matrix(x["m"]))
        out.append(m.ravel().tolist())
    yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("ga"), batch.column("gb"), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "a", "b", "m"])


def _spread(batch: pa.RecordBatch):
    """From a group's scores before and after it to those of each of its members."""
    rows = []
    for conv, nodes, before, after in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "nodes", "before", "after")), strict=True):
        ms = [_matrix(x["m"]) for x in nodes]
        befores, afters = [np.array(before)], [np.array(after)]
        for m in ms[:-1]:
            befores.append((befores[-1][:, None] + m).max(0))
        for m in reversed(ms[1:]):
            afters.append((m + afters[-1][None]).max(1))
        rows += [(conv, x["a"], x["b"], p.tolist(), q.tolist()) for x, p, q in zip(nodes, befores, reversed(afters), strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "a", "b", "before", "after"])


def chained(blocks: DataFrame, hmm: Hmm) -> DataFrame:
    """conv_id, a, b, before, after of blocks (conv_id, a, b, transcript) of conversations of several blocks.

    a and b number a block from 0, with gaps; before and after: best scores of all lines of the conversation before and
    after the block, by the state (or ``BEGIN``) at that end.
    """

    def transfer(batch):
        out = [hmm.transfer(hmm.read(t)[0]).ravel().tolist() for t in batch.column("transcript").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "a", "b")), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "a", "b", "m"])

    nodes, levels = arrow_map(blocks.select("conv_id", "a", "b", "transcript"), transfer, _NODE), []
    top = blocks.agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    for by in "ba":  # the parts of a segment, then the segments
        most = top[by]
        while most:
            levels.append(_neighbours(nodes, by))
            nodes = arrow_map(levels[-1], _multiplied, _NODE)
            most //= FAN
    begin, end = [-np.inf] * N + [0.0], [0.0] * (N + 1)
    scores = None
    for level in reversed(levels):
        if scores is None:
            level = level.select("conv_id", "nodes", F.array(*map(F.lit, begin)).alias("before"), F.array(*map(F.lit, end)).alias("after"))
        else:
            scores = scores.withColumnsRenamed({"conv_id": "c", "a": "sa", "b": "sb"})
            same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ga") == F.col("sa")) & (F.col("gb") == F.col("sb"))
            level = level.join(scores, same).select("conv_id", "nodes", "before", "after")
        scores = arrow_map(level, _spread, "conv_id long, a long, b long, before array<double>, after array<double>")
    return scores


def format_chats(transcripts: DataFrame, hmm: Hmm) -> DataFrame:
    """Per block: conv_id, segment, part, n_lines, roles (of its turns), line_roles, continues, rendered.

    Blocks follow one another by segment and part.  ``continues``: the first turn goes on from the block before, so
    that block's last end mark and this one's first role mark are not turns' ends when blocks are put together.
    """

    def work(batch):
        found = []
        for t, before, after in zip(*(batch.column(c).to_pylist() for c in ("transcript", "before", "after")), strict=True):
            emit, lines = hmm.read(t or "")
            states = hmm.decode(emit, None if before is None else np.array(before), None if after is None else np.array(after))
            turns = turns_of(lines, states)
            found.append((len(lines), [r for r, _ in turns], [ROLES[s % 3] for s in states], states[0] >= 3, render(turns)))
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("segment"), batch.column("part"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "segment", "part", "n_lines", "roles", "line_roles", "continues", "rendered"],
        )

    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("segment").cast("long").alias("segment"), "part", "transcript")
    several = write_shared(rows.groupBy("conv_id").agg(F.count("*").alias("k"), F.min("segment").alias("least")).where("k > 1").select(F.col("conv_id").alias("long_id"), "least"), "long-conversations")
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    none = F.lit(None).cast("array<double>")
    whole = rows.join(several, is_long, "left_anti").select("*", none.alias("before"), none.alias("after"))
    if not several.isEmpty():
        # segments from 0 in each conversation, so that few levels of neighbours suffice
        blocks = write_shared(rows.join(several, is_long).select("conv_id", "segment", "part", (F.col("segment") - F.col("least")).alias("a"), F.col("part").alias("b"), "transcript"), "blocks")
        scores = chained(blocks, hmm).withColumnsRenamed({"conv_id": "c", "a": "sa", "b": "sb"})
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))
        whole = whole.unionByName(blocks.join(scores, same).select("conv_id", "segment", "part", "transcript", "before", "after"))
    return arrow_map(whole, work, "conv_id long, segment long, part long, n_lines long, roles array<string>, line_roles array<string>, continues boolean, rendered string")
