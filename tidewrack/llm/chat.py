"""Chat transcripts to canonical turns: roles by a hidden Markov model over lines.

The states are (role, first line of a turn or later one). What a line shows is
its speaker marker, if any, whether it is the first line of its piece, whether
a blank line stands before it, whether it ends in a question mark and whether
it is short. The probabilities are counted on labelled turns, on top of fixed
prior counts. The most likely state path is found by Viterbi's algorithm.

Long conversations are cut into blocks of turns: each block is reduced to a
matrix of best path scores between its boundary states. Such matrices multiply
(max-plus, associative), so blocks are joined over a tree of bounded groups, the
states at the boundaries are handed down the same tree, and the blocks are then
decoded on their own. No task holds a whole conversation or all its matrices.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, runs, small_batches, text_of

ROLES = ("system", "user", "assistant")
#: Turns that a block spans, and blocks (or groups of them) that are joined at once; labelled turns that a fit counts, about.
BLOCK, FAN = 64, 64
SAMPLE = 20_000
# Fixed words of speaker markers by role. Those that open ordinary lines as well are weak when followed by a mere colon.
MARKERS = {"system": "system|instructions?|context", "user": "user|human|question|customer|q", "assistant": "assistant|ai|bot|model|answer|gpt|a"}
WEAK = "instructions?|context|question|customer|q|bot|model|answer|a"
FORMS = (r"^\s*<\|(?:im_start\|>\s*)?(?:{0})(?:\|>|\b)[:\s]*", r"^\s*#+\s*(?:{0})\b\s*:?\s*", r"^\s*\[(?:{0})\]\s*:?\s*", r"^\s*\*\*(?:{0})\s*:?\*\*\s*:?\s*", r"^\s*(?:{0})\s*[:>](?:\s+|$)")
MARKED = [regex.compile("|".join(f.format(words) for f in FORMS), regex.I) for words in MARKERS.values()]
WEAKLY = regex.compile(FORMS[-1].format(WEAK), regex.I)
STATES = 2 * len(ROLES)  # role r: first line 2r, later line 2r + 1
START = STATES  # the state before a conversation
CODES = (7, 2, 2, 2, 2)  # marker (none; strong by role; weak by role), blank before, question, short, first of its piece

# Fixed prior shares. Start of a conversation; next speaker after each role; a turn goes on for another line.
FIRST = np.array([0.25, 0.65, 0.10])
NEXT = np.array([[0.02, 0.90, 0.08], [0.02, 0.10, 0.88], [0.02, 0.90, 0.08]])
STAY = 0.6
#: Marker: none, own role's strong and weak, another role's strong and weak; of first and of later lines.
MARK = np.array([[0.25, 0.48, 0.23, 0.03, 0.01], [0.9, 0.003, 0.047, 0.003, 0.047]])
#: Blank line before, question, short, first of its piece; by role for first lines, then for later lines.
TRAITS = np.array([[0.6, 0.02, 0.4, 0.9], [0.6, 0.35, 0.5, 0.9], [0.6, 0.05, 0.2, 0.9], [0.05, 0.08, 0.3, 0.02]])
#: Prior counts that a table of shares stands for.
PRIOR = 50.0


@dataclass
class Model:
    """Log probabilities: move [from, to] with the row START last, shown [code of a line, state]."""

    move: np.ndarray
    shown: np.ndarray


def model(counts: dict[str, float] | None = None) -> Model:
    """The model of the prior shares and `counts` by name (see `_tally` and `fit`)."""
    n = Counter(counts or {})
    first = np.array([PRIOR * FIRST[r] + n[f"begin {r}"] for r in range(3)])
    next_ = np.array([[PRIOR * NEXT[a, b] + n[f"next {a} {b}"] for b in range(3)] for a in range(3)])
    stay = (PRIOR * STAY + n["line 1"]) / (PRIOR + n["line 0"] + n["line 1"])
    mark = np.array([[PRIOR * MARK[k, c] + n[f"mark {k} {c}"] for c in range(5)] for k in (0, 1)])
    mark /= mark.sum(1, keepdims=True)
    lines = np.array([n["row 0"], n["row 1"], n["row 2"], n["row 3"]])
    trait = np.array([[PRIOR * TRAITS[r, t] + n[f"trait {r} {t}"] for t in range(4)] for r in range(4)]) / (PRIOR + lines[:, None])
    move = np.zeros((STATES + 1, STATES))
    for r in range(3):
        move[[2 * r, 2 * r + 1], 2 * r + 1] = stay
        move[2 * r : 2 * r + 2, 0::2] = (1 - stay) * next_[r] / next_[r].sum()
    move[START, 0::2] = first / first.sum()
    shown = np.empty((*CODES, STATES))
    for code in np.ndindex(*CODES):
        for state in range(STATES):
            role, later = divmod(state, 2)
            m = code[0]
            own = m and (m - 1) % 3 == role
            kind = 0 if not m else (1 if m < 4 else 2) + (0 if own else 2)
            p = mark[later, kind] / (2 if kind > 2 else 1)
            has = trait[3 if later else role]
            shown[(*code, state)] = p * np.where(np.array(code[1:]) == 1, has, 1 - has).prod()
    with np.errstate(divide="ignore"):
        return Model(np.log(move), np.log(shown).reshape(-1, STATES))


def marker(line: str) -> tuple[int, int]:
    """(0: none, 1..3: strong, 4..6: weak marker of a role; where the text after it begins)."""
    for k, form in enumerate(MARKED):
        if m := form.match(line[:80]):
            return k + (4 if WEAKLY.match(line[:80]) else 1), m.end()
    return 0, 0


def lines_of(pieces: list[tuple[int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(turn, number in the turn, line, code, where its text begins) of all lines in order; blank lines have code -1 and only flag the next line."""
    out, number, turn = [], 0, None
    for t, raw in sorted(pieces):
        if t != turn:
            turn, number = t, 0
        blank, edge = False, True
        for line in raw.split("\n"):
            if line.strip():
                mark, at = marker(line)
                out.append((t, number, line, int(np.ravel_multi_index((mark, blank, line.rstrip().endswith("?"), len(line) < 60, edge), CODES)), at))
                blank = edge = False
            else:
                out.append((t, number, line, -1, 0))
                blank = True
            number += 1
    return out


def matrix(emissions: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score of a path through the block [state before it, START included; its last state]."""
    score = move + emissions[0]
    for e in emissions[1:]:
        score = (score[:, :, None] + move[None, :STATES]).max(1) + e
    return score


def product(matrices: list[np.ndarray]) -> np.ndarray:
    out = matrices[0]
    for m in matrices[1:]:
        out = (out[:, :, None] + m[None, :STATES]).max(1)
    return out


def boundaries(matrices: list[np.ndarray], before: int = START, last: int = -1) -> list[tuple[int, int]]:
    """(state before, last state) of each block on the best path from `before` to `last` (-1: any)."""
    score, back = matrices[0][before], []
    for m in matrices[1:]:
        step = score[:, None] + m[:STATES]
        back.append(step.argmax(0))
        score = step.max(0)
    ends = [last if last >= 0 else int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends, strict=True))


def decode(emissions: np.ndarray, move: np.ndarray, before: int = START, last: int = -1) -> list[int]:
    """The best path of a block between two boundary states."""
    score, back = move[before] + emissions[0], []
    for e in emissions[1:]:
        step = score[:, None] + move[:STATES]
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [last if last >= 0 else int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _pieces(table: pa.Table) -> list[tuple[int, str]]:
    return list(zip(table.column("turn").to_pylist(), table.column("raw").to_pylist(), strict=True))


def _reduce(m: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["conv_id", "block"]):
            codes = [x[3] for x in lines_of(_pieces(table)) if x[3] >= 0]
            if codes:
                made = matrix(m.shown[codes], m.move)
                yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().slice(0, 1) for c in ("conv_id", "block")), pa.array([made.ravel().tolist()])], names=["conv_id", "block", "matrix"])

    return run


def _matrices(blocks: list[dict]) -> list[np.ndarray]:
    return [np.array(b["matrix"]).reshape(STATES + 1, STATES) for b in blocks]


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each list of blocks."""
    for batch in batches:
        made = [product(_matrices(blocks)).ravel().tolist() for blocks in batch.column("blocks").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("over"), pa.array(made, pa.list_(pa.float64()))], names=["conv_id", "block", "matrix"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary states of each block from those of its list."""
    for batch in batches:
        rows = []
        for conv, blocks, before, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "blocks", "before", "last")), strict=True):
            rows += [(conv, b["block"], *ends) for b, ends in zip(blocks, boundaries(_matrices(blocks), before, last), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["conv_id", "block", "before", "last"])


def ends(matrices: DataFrame, scratch: Scratch, level: int = 0, fan: int = FAN) -> DataFrame:
    """(conv_id, block, before, last): the boundary states of all blocks of `matrices` (conv_id, block, matrix)."""
    matrices = scratch.save(matrices, f"matrices-{level}")
    listed = F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("blocks")  # `fan` blocks at most
    over = F.floor(F.col("block") / fan).cast("long").alias("over")
    groups = matrices.groupBy("conv_id", over).agg(listed)
    several = matrices.groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("z")).where(F.floor(F.col("a") / fan) != F.floor(F.col("z") / fan))
    if several.limit(1).count():
        above = ends(groups.mapInArrow(_up, "conv_id long, block long, matrix array<double>"), scratch, level + 1, fan)
        known = groups.join(above.withColumnRenamed("block", "over"), ["conv_id", "over"])
    else:
        known = groups.withColumns({"before": F.lit(START), "last": F.lit(-1)})
    return scratch.save(known.select("conv_id", "blocks", "before", "last").mapInArrow(_down, "conv_id long, block long, before int, last int"), f"ends-{level}")


KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())


def _decode(m: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["conv_id", "block"]):
            conv, before, last = (table.column(c)[0].as_py() for c in ("conv_id", "before", "last"))
            lines = lines_of(_pieces(table))
            codes = [x[3] for x in lines if x[3] >= 0]
            path = iter(decode(m.shown[codes], m.move, before, last) if codes else [])
            states = [next(path) if x[3] >= 0 else -1 for x in lines]
            role = next((ROLES[s // 2] for s in states if s >= 0), None)
            rows = []
            for (turn, number, line, code, at), state in zip(lines, states, strict=True):
                starts = state >= 0 and state % 2 == 0
                if state >= 0:
                    role = ROLES[state // 2]
                mark = code // 16  # a marker is one only where it opens a turn of its role
                said = line[at:] if starts and mark > 0 and (mark - 1) % 3 == state // 2 else line
                rows.append((conv, turn, number, role, starts, f"<|{role}|>\n{said}" if starts else said))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=["conv_id", "turn", "line", "role", "starts", "rendered"])

    return run


def parse(transcripts: DataFrame, fitted: Model | None = None) -> DataFrame:
    """Canonical turns of raw `transcripts` (conv_id, turn, raw), one row a line, by the `fitted` model (the prior one unless given).

    turn orders the pieces of a conversation; a piece may hold several lines and
    its speaker marker may be missing. Returns conv_id, turn, line (number in
    the turn), role (system, user or assistant), starts (a turn begins) and
    rendered: the line, under the header <|role|> if it starts a turn. The
    marker of the turn's role is left out of its first line; nothing else is:
    rendered without headers, joined by line ends, is raw without those markers.
    Blank lines have the role of the line before them in their block of turns,
    or else of the next; null if the block has no other lines. Rows without
    conv_id or turn give no lines; a null raw is empty; repeated rows count
    once; pieces of one turn follow each other by their text.
    """
    small_batches(transcripts.sparkSession)
    scratch, m = Scratch(transcripts.sparkSession), fitted or model()
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("raw").alias("raw"))
    rows = rows.where("conv_id is not null and turn is not null").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK).cast("long"))
    key = ["conv_id", "block"]
    rows = scratch.save(rows.repartition(*key), "rows")
    dealt = lambda df: df.repartition(*key).sortWithinPartitions(*key)
    known = ends(dealt(rows).mapInArrow(_reduce(m), "conv_id long, block long, matrix array<double>"), scratch)
    return dealt(rows.join(known, key, "left")).mapInArrow(_decode(m), "conv_id long, turn long, line long, role string, starts boolean, rendered string")


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what the lines of labelled turns (role number, raw) show, by name."""
    n: Counter = Counter()
    for batch in batches:
        for role, raw in zip(batch.column("role").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            codes = [x[3] for x in lines_of([(0, raw)]) if x[3] >= 0]
            for k, code in enumerate(codes):
                m, *traits = (int(x) for x in np.unravel_index(code, CODES))
                later = int(k > 0)
                n[f"mark {later} {0 if not m else (1 if m < 4 else 2) + (0 if (m - 1) % 3 == role else 2)}"] += 1
                n[f"row {3 if later else role}"] += 1
                n[f"line {int(k + 1 < len(codes))}"] += 1
                for t, has in enumerate(traits):
                    n[f"trait {3 if later else role} {t}"] += has
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([float(x) for x in n.values()])], names=["name", "n"])


def fit(turns: DataFrame, sample: int = SAMPLE) -> Model:
    """The model counted on about `sample` labelled `turns` (conv_id, turn, role, raw), chosen by hash.

    Turns of conversations whose crc32(conv_id as text) is 0 modulo 5 are held
    out, so that accuracy can be measured on them. Roles other than the three
    and null ids or turns are left out; without labelled turns the priors stay.
    """
    number = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.lower("role")) - 1
    known = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", number.cast("int").alias("role"), text_of("raw").alias("raw"))
    known = known.where((F.col("role") >= 0) & (F.crc32(F.col("conv_id").cast("string")) % 5 != 0))
    share = min(1.0, sample / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1 << 30)) < int(share * (1 << 30)))
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    moves = chosen.select("conv_id", "turn", "role").join(before, ["conv_id", "turn"], "left")
    moves = moves.select(F.when(F.col("before").isNull(), F.concat_ws(" ", F.lit("begin"), "role")).otherwise(F.concat_ws(" ", F.lit("next"), "before", "role")).alias("name"), F.lit(1.0).alias("n"))
    # a handful of names, whatever the table
    counts = chosen.select("role", "raw").mapInArrow(_tally, "name string, n double").unionByName(moves).groupBy("name").agg(F.sum("n").alias("n")).collect()
    return model({r["name"]: r["n"] for r in counts})


# Fixed marker styles of the transcripts made from clean conversations.
STYLES = (("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("### System\n", "### User\n", "### Assistant\n"), ("[system] ", "Q: ", "A: "), ("<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of `conversations` (conv_id, turn, role, text): conv_id, turn, role, raw.

    Each conversation has one of five marker styles; a fifth of its turns have
    a blank line in place of their marker. Roles go into markers alone.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    said = F.when(F.lit(False), "")
    for k, words in enumerate(STYLES):
        for role, word in zip(ROLES, words, strict=True):
            said = said.when((style == k) & (F.lower("role") == role), word)
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(5)) == 0
    return conversations.select("conv_id", "turn", "role", F.concat(F.when(bare, F.lit("\n")).otherwise(F.coalesce(said, F.lit("\n"))), text_of()).alias("raw"))
