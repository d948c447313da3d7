"""Chat formatting: raw transcripts are parsed by a hidden Markov model over speaker markers and line features; Viterbi recovers the roles, and turns are rendered in one canonical form."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, cut, held_out, table

#: Names that stand before a colon, or after ### or in <>, at the start of a turn in transcripts (fixed values); each is a value of the marker feature.
MARKERS = ["user", "human", "q", "customer", "assistant", "ai", "bot", "a", "agent", "system", "instructions", "context", "tool"]
#: Ways of naming speakers found in raw transcripts: user, assistant, system.
STYLES = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Instructions: "), ("### user\n", "### assistant\n", "### system\n"), ("Q: ", "A: ", "Context: ")]
#: Turns of a conversation that a row holds; a longer one goes on in further rows, and the chain's state goes on with it.
BLOCK_TURNS = 512
#: Blocks whose transfers are put together in one group; longer conversations take a further level.
FAN = 512

_MARKER = re.compile(r"^\s*(?:(?:###\s*|<\|?)?(" + "|".join(MARKERS) + r")\s*(?:\|?>|:)\s?|###\s*(" + "|".join(MARKERS) + r")\s*$)", re.IGNORECASE)
#: Values of each feature: marker (0: none), length class, question, after a blank line, first line.
FEATURES = (len(MARKERS) + 1, 10, 2, 2, 2)


def line_features(lines: list[str]) -> np.ndarray:
    """A row of feature values for each line of a transcript."""
    out = np.zeros((len(lines), len(FEATURES)), np.int64)
    blank = True
    for i, line in enumerate(lines):
        found = _MARKER.match(line)
        body = line[found.end() :] if found else line
        out[i] = (MARKERS.index((found[1] or found[2]).lower()) + 1 if found else 0, min(9, len(body).bit_length()), body.rstrip().endswith("?"), blank, i == 0)
        blank = not line.strip()
    return out


def raw_transcript(conv_id, turns: list[dict]) -> tuple[list[str], list[tuple[str | None, bool]]]:
    """Lines of a transcript as raw collections have them, with role and turn start of each line: speakers are named in one of the STYLES, and a quarter of the turns aren't named at all."""
    style = STYLES[zlib.crc32(str(conv_id).encode()) % len(STYLES)]
    lines, truth = [], []
    for t in turns:
        role, text = t["role"], t["text"] or ""
        names = dict(zip(("user", "assistant", "system"), style, strict=True))
        named = zlib.crc32(f"{conv_id}:{t['turn']}".encode()) % 4 != 0
        part = ((names.get(role) or f"{role}: ") if named and role else "") + text
        for k, line in enumerate(part.split("\n")):
            lines.append(line)
            truth.append((role, k == 0))
    return lines, truth


@dataclass
class Model:
    """states: (role, starts a turn); log probabilities of the first state, of moves, and of each feature's values by state."""

    states: list[tuple[str, bool]]
    start: np.ndarray
    moves: np.ndarray
    emit: list[np.ndarray]

    def emissions(self, values: np.ndarray) -> np.ndarray:
        """Log probability of each line's features by state."""
        return sum(e[:, values[:, k]].T for k, e in enumerate(self.emit)) if len(values) else np.zeros((0, len(self.states)))

    @property
    def from_any(self) -> np.ndarray:
        """moves, and as the last row the start of a conversation, where no line is before."""
        return np.vstack([self.moves, self.start])

    def transfer(self, values: np.ndarray) -> np.ndarray:
        """[a, b]: the best score of lines that follow a line of state a (the last row: no line) and end in state b."""
        out = None
        for row in self.emissions(values):
            out = (self.from_any if out is None else _onward(out, self.moves)) + row
        return out

    def viterbi(self, chains: list[np.ndarray], before: list[int | None] | None = None, last: list[int | None] | None = None) -> list[np.ndarray]:
        """Most likely states of each chain of line features; all chains of a batch move one line ahead at a time, the longest first.

        before: state of the line before a chain, None at a conversation's start; last: the state that it must end in, None where any may be.
        """
        size = np.array([len(c) for c in chains])
        order = np.argsort(-size, kind="stable")
        first = np.concatenate([[0], np.cumsum(size[order])])[:-1].astype(np.int64)
        flat = np.concatenate([chains[i] for i in order]) if len(chains) else np.zeros((0, len(FEATURES)), np.int64)
        score = self.emissions(flat)
        back = np.zeros(score.shape, np.int16)
        best = np.zeros((len(chains), len(self.states)))
        longest = int(size.max(initial=0))
        active = np.searchsorted(-size[order], -np.arange(longest), side="left")
        begin = self.from_any[[-1 if before is None or before[i] is None else before[i] for i in order]]
        for t in range(longest):
            m = active[t]
            at = first[:m] + t
            if t == 0:
                best[:m] = begin[:m] + score[at]
                continue
            step = best[:m, :, None] + self.moves
            back[at] = step.argmax(1)
            best[:m] = step.max(1) + score[at]
        out = np.zeros(len(flat), np.int64)
        now = best.argmax(1)
        for k, i in enumerate(order):
            if last is not None and last[i] is not None:
                now[k] = last[i]
        for t in range(longest - 1, -1, -1):
            m = active[t]
            at = first[:m] + t
            out[at] = now[:m]
            if t:
                now[:m] = back[at, now[:m]]
        paths: list = [None] * len(chains)
        for k, i in enumerate(order):
            paths[i] = out[first[k] : first[k] + size[i]]
        return paths


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation and block of at most BLOCK_TURNS turns: conv, block (ordered), turns in order, n_rows.

    Rows with a null turn come first; equal turn numbers go by hash, role and text. Rows that repeat conversation, turn, role and text are one turn, and count in n_rows. Blocks are cut by turn number;
    where one would hold too many turns, it is cut further by turn and hash, so neither null nor repeated turn numbers gather in one row.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    coarse = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1))
    crowded = t.groupBy("conv", coarse.alias("_coarse")).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_TURNS)  # repeated rows counted too, so a few more than needed
    t = t.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("_by", F.xxhash64("role", "text"))
    same = lambda a, b, key: F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    t = t.withColumns({"_coarse": coarse, "_turn": F.lit(0).cast("long"), "_part": F.lit(0).cast("long")})
    if not crowded.isEmpty():
        parts = t.groupBy("conv", "turn").agg(F.ceil(F.count("*") / (BLOCK_TURNS // 2)).alias("_parts"))
        parts = parts.withColumn("_coarse", coarse).alias("p").join(crowded.alias("c"), same("p", "c", "conv") & same("p", "c", "_coarse"), "left_semi")
        t = t.alias("t").join(parts.select("conv", "turn", "_parts").alias("q"), same("t", "q", "conv") & same("t", "q", "turn"), "left")
        within = F.pmod(F.xxhash64("_by"), F.col("_parts"))
        t = t.select("t.*", "_parts").withColumns({"_turn": F.when(F.col("_parts").isNotNull(), F.coalesce("turn", F.lit(-1))).otherwise(0), "_part": F.coalesce(within, F.lit(0))})
    block = F.struct("_coarse", "_turn", "_part").alias("block")
    return t.groupBy("conv", block).agg(F.array_sort(F.collect_list(F.struct("turn", "_by", "role", "text"))).alias("turns"), F.sum("n").alias("n_rows"))


def transcripts(convs: DataFrame) -> DataFrame:
    """convs as raw collections have them: conv, block, n_rows, text (lines of a transcript), truth (role and turn start of each line)."""

    def run(batches):
        for batch in batches:
            read = [raw_transcript(c, t) for c, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("role", pa.string()), ("begins", pa.bool_())]))
            truth = pa.array([[{"role": r, "begins": b} for r, b in truth] for _, truth in read], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(["\n".join(lines) for lines, _ in read], pa.string()), truth], names=["conv", "block", "n_rows", "text", "truth"])

    types = {f.name: f.dataType.simpleString() for f in convs.schema}
    return convs.select("conv", "block", "turns", "n_rows").mapInArrow(run, f"conv {types['conv']}, block {types['block']}, n_rows long, text string, truth array<struct<role:string,begins:boolean>>")


def train(raw: DataFrame) -> Model | None:
    """raw (conv, text, truth) -> the model: counts states, moves and feature values over all lines outside the held-out fifth; only the counts, a few hundred rows, come to the driver. None without a
    labelled line."""

    def run(batches):
        counts: dict[tuple, int] = {}

        def add(*key):
            counts[key] = counts.get(key, 0) + 1

        for batch in batches:
            for text, truth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = None
                for line, values in zip(truth, line_features(text.split("\n")).tolist(), strict=True):
                    if line["role"] is None:
                        before = None
                        continue
                    state = f"{int(line['begins'])}{line['role']}"
                    add("move", before or "", state, 0)
                    for k, v in enumerate(values):
                        add("emit", state, str(k), v)
                    before = state
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string() if i < 3 else pa.int64()) for i in range(4)] + [pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "a", "b", "v", "n"])

    rows = raw.where(~held_out("conv")).select("text", "truth").mapInArrow(run, "kind string, a string, b string, v long, n long").groupBy("kind", "a", "b", "v").agg(F.sum("n").alias("n")).orderBy("kind", "a", "b", "v").collect()
    names = sorted({r.b for r in rows if r.kind == "move"})
    if not names:
        return None
    index = {s: i for i, s in enumerate(names)}
    start, moves = np.full(len(names), 0.1), np.full((len(names), len(names)), 0.1)
    emit = [np.full((len(names), n), 0.5) for n in FEATURES]
    for r in rows:
        if r.kind == "emit":
            emit[int(r.b)][index[r.a], r.v] += r.n
        elif r.a:
            moves[index[r.a], index[r.b]] += r.n
        else:
            start[index[r.b]] += r.n
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model([(s[1:], s[0] == "1") for s in names], log(start), log(moves), [log(e) for e in emit])


def render(lines: list[str], states: list[tuple[str, bool]], before: tuple[str, bool] | None = None) -> tuple[list[str], str]:
    """Roles of the turns that begin in these lines, and the canonical text: <|role|>, the turn's text without its speaker marker, <|end|>. Blank lines at a turn's ends go; a turn's inner lines stay as
    they are. before: state of the line before, whose turn goes on where no new one begins."""
    turns: list[tuple[str, list[str]]] = []
    for line, (role, begins) in zip(lines, states, strict=True):
        if begins or (turns[-1][0] if turns else before and before[0]) != role:
            turns.append((role, []))
            found = _MARKER.match(line)
            line = line[found.end() :] if found else line
        elif not turns:
            turns.append(("", []))  # the rest of the turn of the block before
        turns[-1][1].append(line)
    text = "".join(f"<|{r}|>\n{'\n'.join(body).strip()}<|end|>\n" if r else f"{'\n'.join(body).strip()}<|end|>\n" for r, body in turns)
    return [r for r, _ in turns if r], text


def _onward(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores of what two transfers lead to, one after the other."""
    return (a[:, :, None] + b[None, : a.shape[1]]).max(1)


def _borders(raw: DataFrame, model: Model) -> DataFrame | None:
    """For blocks of conversations of several blocks: conv, block, before and last: the states of the line before and of the last line on the most likely path of the whole conversation. None if there are none.

    A block's transfer matrix says all that the others need to know of it. Matrices of FAN neighbours are put together, level by level, until one group is left; then states are handed down the levels.
    """
    several = raw.groupBy("conv").count().where("count > 1").select("conv")
    if several.isEmpty():
        return None
    k = len(model.states)
    kind = raw.schema["conv"].dataType.simpleString()

    def matrices(batches):
        for batch in batches:
            found = [model.transfer(line_features(t.split("\n"))).ravel().tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["conv", "block", "m"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in pdf.sort_values("nth")["m"]:
            m = np.reshape(m, (k + 1, k))
            out = m if out is None else _onward(out, m)
        return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "nth": pdf["up"].iloc[:1], "m": [out.ravel().tolist()]})

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        begin, end = int(pdf["_before"].iloc[0]), int(pdf["_last"].iloc[0])
        best, back = None, []
        for m in pdf["m"]:
            m = np.reshape(m, (k + 1, k))
            if best is None:
                best = m[begin]
            else:
                step = best[:, None] + m[:k]
                back.append(step.argmax(0))
                best = step.max(0)
        states = [end if end >= 0 else int(best.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states = states[::-1]
        return pd.DataFrame({"conv": pdf["conv"], "nth": pdf["nth"], "before": [begin, *states[:-1]], "last": states})

    same = F.col("a.conv").eqNullSafe(F.col("b.conv"))
    own = raw.alias("a").join(several.alias("b"), same, "left_semi").select("conv", "block", "text")
    blocks = f"conv {kind}, block {raw.schema['block'].dataType.simpleString()}, m array<double>"
    own = own.mapInArrow(matrices, blocks).withColumn("nth", F.row_number().over(W.partitionBy("conv").orderBy("block")).cast("long") - 1)
    levels = [cut(own.withColumn("up", F.floor(F.col("nth") / FAN)))]
    while levels[-1].where("up > 0").limit(1).count():
        above = levels[-1].groupBy("conv", "up").applyInPandas(together, f"conv {kind}, nth long, m array<double>")
        levels.append(cut(above.withColumn("up", F.floor(F.col("nth") / FAN))))
    given = None
    for level in reversed(levels):
        if given is None:
            rows = level.withColumns({"_before": F.lit(k), "_last": F.lit(-1)})
        else:
            rows = level.alias("a").join(given.alias("b"), same & (F.col("a.up") == F.col("b.nth")), "left").select("a.*", F.col("b.before").alias("_before"), F.col("b.last").alias("_last"))
        given = cut(rows.groupBy("conv", "up").applyInPandas(hand_down, f"conv {kind}, nth long, before int, last int"))
    return levels[0].alias("a").join(given.alias("b"), same & (F.col("a.nth") == F.col("b.nth"))).select("a.conv", "a.block", "before", "last")


def parse(raw: DataFrame, model: Model | None) -> DataFrame:
    """raw (conv, block, text) -> conv, block, line_roles (of each line), roles (of the turns that begin here), rendered (canonical text; a turn that goes on in the next block ends there).

    The lines of a conversation are one chain, over all its blocks. Without a model every transcript is one turn of the role "unknown". A null text is a blank line; a conversation of empty turns
    alone still gives a row. An empty table gives none. Other columns are not read.
    """
    states = model.states if model else [("unknown", False)]
    kind, block = (raw.schema[c].dataType.simpleString() for c in ("conv", "block"))
    raw = raw.select("conv", "block", F.coalesce("text", F.lit("")).alias("text"))
    borders = _borders(raw, model) if model else None
    if borders is None:
        found = raw.withColumns({"before": F.lit(None).cast("int"), "last": F.lit(None).cast("int")})
    else:
        same = F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.block") == F.col("b.block"))
        found = raw.alias("a").join(borders.alias("b"), same, "left").select("a.*", "before", "last")
    start = len(model.states) if model else -1

    def run(batches):
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            chains = [t.split("\n") for t in batch.column("text").to_pylist()]
            before = [None if b == start else b for b in batch.column("before").to_pylist()]
            paths = model.viterbi([line_features(lines) for lines in chains], before, batch.column("last").to_pylist()) if model else [np.zeros(len(lines), int) for lines in chains]
            out: tuple[list, ...] = ([], [], [])
            for lines, path, b in zip(chains, paths, before, strict=True):
                found = [states[k] for k in path]
                roles, text = render(lines, found, None if b is None else states[b])
                for x, v in zip(out, ([r for r, _ in found], roles, text), strict=True):
                    x.append(v)
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["conv", "block", "line_roles", "roles", "rendered"])

    return found.mapInArrow(run, f"conv {kind}, block {block}, line_roles array<string>, roles array<string>, rendered string")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per conversation: its rows, lines, lines of the known role, turns, and hashes of the turns' roles and of the rendered text, block by block."""
    passing = Written(spark)
    raw = passing.cut(transcripts(conversations(table(spark, sf_dir, "conversations"))))
    found = parse(raw, train(raw)).withColumnRenamed("conv", "_conv").withColumnRenamed("block", "_block")
    both = raw.join(found, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    right = F.aggregate(F.zip_with("truth", "line_roles", lambda t, r: (t["role"] == r).cast("long")), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    parts = both.select("conv", "block", "n_rows", F.size("line_roles").alias("_lines"), right.alias("_right"), F.size("roles").alias("_turns"), F.sha2(F.array_join("roles", ","), 256).alias("_roles"), F.sha2("rendered", 256).alias("_rendered"))
    whole = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda x: x[c]), ""), 256)
    digest = parts.groupBy("conv").agg(F.sum("n_rows").alias("n_rows"), F.sum("_lines").cast("long").alias("n_lines"), F.sum("_right").alias("n_right"), F.sum("_turns").cast("long").alias("n_turns"), whole("_roles").alias("roles_sha256"), whole("_rendered").alias("rendered_sha256"))
    out = cut(digest.select(F.col("conv").alias("conv_id"), held_out("conv").alias("held_out"), "n_rows", "n_lines", "n_right", "n_turns", "roles_sha256", "rendered_sha256"))
    passing.drop()
    return out
