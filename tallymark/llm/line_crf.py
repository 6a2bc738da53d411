"""Quality rules: counts of words, symbols and repeats, and a label for each line.

A linear-chain conditional random field with two labels, content and boilerplate, reads a document as
its sequence of lines. Its weights are learnt from labelled documents: every line of a good document
is content unless it repeats an earlier line, every line of a bad one is boilerplate. Viterbi decoding
gives the best sequence of labels; a document is kept if enough of its words are in content lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the learning sample: documents per label, and lines of one document.
SAMPLE_DOCUMENTS = 1000
SAMPLE_LINES = 256
STEPS = 150
RIDGE = 1e-3

N_FEATURES = 10
CONTENT, BOILERPLATE = 0, 1

_SYMBOLS = b"#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"#*$%&|<>{}[]=_~^@\\"


@dataclass(frozen=True)
class LineCrf:
    """State weights by (feature, label), transition weights by (label, next label), and scaling."""

    states: np.ndarray
    moves: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        scaled = ((features - self.mean) / self.scale).clip(-6, 6)
        return np.hstack((scaled, np.ones((len(features), 1)))) @ self.states


def line_features(lines: list[bytes]) -> tuple[np.ndarray, list[int], list[bool]]:
    """Features, words and whether it repeats an earlier line, for each line that has a word."""
    rows, sizes, repeats = [], [], []
    seen: set[bytes] = set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        again = line in seen
        seen.add(line)
        # deleting a set of bytes is one pass in C
        rows.append((
            np.log1p(n),
            size / n,
            len(set(words)) / n,
            1 - len(line.translate(None, _UPPER)) / size,
            1 - len(line.translate(None, _DIGITS)) / size,
            (1 - len(line.translate(None, _MARKS)) / size) ** 0.5,
            line.count(b"!") / n,
            line.count(b" | ") / n,
            float(line.rstrip()[-1] in b".?!:\"')"),
            float(again),
        ))
        sizes.append(n)
        repeats.append(again)
    return np.array(rows, dtype=float).reshape(-1, N_FEATURES), sizes, repeats


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best labels of one sequence; equal scores prefer content."""
    if not len(emissions):
        return []
    (cc, cb), (bc, bb) = moves.tolist()
    rows = emissions.tolist()
    content, boiler = rows[0]
    back: list[tuple[int, int]] = []
    for to_content, to_boiler in rows[1:]:
        stay, come = content + cc, boiler + bc
        leave, remain = content + cb, boiler + bb
        back.append((CONTENT if stay >= come else BOILERPLATE, CONTENT if leave >= remain else BOILERPLATE))
        content, boiler = max(stay, come) + to_content, max(leave, remain) + to_boiler
    label = CONTENT if content >= boiler else BOILERPLATE
    labels = [label]
    for pair in reversed(back):
        label = pair[label]
        labels.append(label)
    return labels[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit_crf(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS) -> LineCrf:
    """Weights of greatest regularised likelihood, by full-batch gradient ascent with momentum.

    ``sequences`` are (features, labels) of documents; without any, nothing is boilerplate.
    """
    sequences = sorted((s for s in sequences if len(s[1])), key=lambda s: -len(s[1]))
    states, moves = np.zeros((N_FEATURES + 1, 2)), np.zeros((2, 2))
    if not sequences:
        states[-1, CONTENT] = 1.0
        return LineCrf(states, moves, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    every = np.vstack([f for f, _ in sequences])
    mean, spread = every.mean(axis=0), every.std(axis=0)
    scale = np.where(spread > 1e-9, spread, 1.0)
    lengths = np.array([len(y) for _, y in sequences])
    docs, longest = len(sequences), lengths[0]
    x = np.zeros((longest, docs, N_FEATURES + 1))
    y = np.zeros((longest, docs), dtype=int)
    for i, (f, labels) in enumerate(sequences):
        x[: len(labels), i, :-1] = ((f - mean) / scale).clip(-6, 6)
        x[: len(labels), i, -1] = 1
        y[: len(labels), i] = labels
    alive = [int((lengths > t).sum()) for t in range(longest)]  # documents are sorted by length
    mask = np.arange(longest)[:, None] < lengths[None]
    seen = np.eye(2)[y] * mask[..., None]
    seen_states = np.einsum("tdf,tdl->fl", x, seen)
    seen_moves = sum((seen[t - 1, :, :, None] * seen[t, :, None, :]).sum(axis=0) for t in range(1, longest)) + moves
    total = mask.sum()
    speed = [np.zeros_like(states), np.zeros_like(moves)]
    size = [np.zeros_like(states), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        score = np.einsum("tdf,fl->tdl", x, states)
        forward = score.copy()
        for t in range(1, longest):
            n = alive[t]
            forward[t, :n] += _log_sum(forward[t - 1, :n, :, None] + moves, 1)
        backward = np.zeros_like(score)
        expected_moves = np.zeros((2, 2))
        whole = _log_sum(forward[lengths - 1, np.arange(docs)], 1)
        for t in range(longest - 2, -1, -1):
            n = alive[t + 1]
            onward = (score[t + 1, :n] + backward[t + 1, :n])[:, None, :] + moves
            backward[t, :n] = _log_sum(onward, 2)
            joint = forward[t, :n, :, None] + onward - whole[:n, None, None]
            expected_moves += np.exp(joint).sum(axis=0)
        share = np.exp(forward + backward - whole[None, :, None]) * mask[..., None]
        slopes = [
            (seen_states - np.einsum("tdf,tdl->fl", x, share)) / total - RIDGE * states,
            (seen_moves - expected_moves) / total - RIDGE * moves,
        ]
        for i, (weights, slope) in enumerate(zip((states, moves), slopes)):
            speed[i] = 0.9 * speed[i] + 0.1 * slope
            size[i] = 0.99 * size[i] + 0.01 * slope**2
            weights += 0.1 * (speed[i] / (1 - 0.9**step)) / (np.sqrt(size[i] / (1 - 0.99**step)) + 1e-6)
    return LineCrf(states, moves, mean, scale)


def learn_line_crf(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    documents: int = SAMPLE_DOCUMENTS,
    lines: int = SAMPLE_LINES,
) -> LineCrf:
    """Learn from a bounded sample: ``documents`` labelled ids per label, the first by a hash of the
    id, among texts of at most ``lines`` lines. Ids with both labels, null ids and texts are left out."""
    labelled = (
        labels.selectExpr(f"`{id_col}` AS id", f"`{label_col}` AS label")
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("id", "label", F.xxhash64("id").alias("rank"))
    )
    chosen = [
        labelled.where(F.col("label") == value).orderBy("rank", "id").limit(documents).collect()
        for value in (0, 1)
    ]
    marks = {row.id: int(row.label) for rows in chosen for row in rows}
    if not marks:
        return fit_crf([])

    def measure(texts: pa.Array) -> pa.Array:
        made = [line_features(t.as_py().encode().split(b"\n")) for t in texts]
        return pa.array(
            [{"features": f.ravel().tolist(), "repeats": r} for f, _, r in made],
            pa.struct([("features", pa.list_(pa.float64())), ("repeats", pa.list_(pa.bool_()))]),
        )

    text = F.col(text_col)
    ids = docs.sparkSession.createDataFrame([(i,) for i in marks], f"id {docs.schema[id_col].dataType.simpleString()}")
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .where(F.col("text").isNotNull())
        .where(F.length("text") - F.length(F.replace("text", F.lit("\n"))) < lines)
        # at most 2 * documents ids
        .join(F.broadcast(ids), "id", "left_semi")
        .select("id", F.arrow_udf(measure, "features array<double>, repeats array<boolean>")("text").alias("made"))
        .orderBy("id", "made")
        .limit(2 * documents)
        .collect()
    )
    return fit_crf([
        (
            np.array(row.made.features).reshape(-1, N_FEATURES),
            np.array([BOILERPLATE if again or marks[row.id] == 0 else CONTENT for again in row.made.repeats]),
        )
        for row in rows
    ])


def repeated_window_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of words which occurs at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    key = code[: n - window + 1]
    for i in range(1, window):
        if int(key.max() + 1) * len(ids) >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(ids) + code[i : n - window + 1 + i]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(window):
        covered[i : i + len(key)] |= twice
    return int(covered.sum())


def document_counts(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the lines of a text."""
    data = text.encode()
    words = data.split()
    lines = data.split(b"\n")
    worded = [line for line in lines if line.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(worded) - len(set(worded)),
        repeated_window_words(words),
        lines,
    )


RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_content_lines bigint, content_share double"
)


def judged(text: Column, crf: LineCrf) -> Column:
    """struct of the counts, the lines with a word, the content lines among them and the share of the
    words that content lines have (0 without words)."""

    def measure(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in range(8)]
        for value in texts:
            *counts, lines = document_counts(value.as_py() or "")
            features, sizes, _ = line_features(lines)
            labels = viterbi(crf.emissions(features), crf.moves)
            content = sum(n for n, label in zip(sizes, labels) if label == CONTENT)
            row = (*counts, len(sizes), labels.count(CONTENT), content / counts[0] if counts[0] else 0.0)
            for column, x in zip(columns, row):
                column.append(x)
        kinds = [pa.int64()] * 7 + [pa.float64()]
        names = [part.split()[0] for part in RESULT.split(", ")]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return F.arrow_udf(measure, RESULT)(text)


def judge_documents(
    docs: DataFrame,
    crf: LineCrf,
    least_words: int = 50,
    repeat_percent: int = 50,
    content_share: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Counts and verdict of every whole text, a row per row of ``docs``.

    base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` of the words in
    repeated windows of three. kept: not base_failed, and at least ``content_share`` of the words are
    in lines that the field labels content. A null text has no words, so it fails; null ids and
    repeated rows give rows of their own; other columns are not looked at.
    """
    failed = (F.col("n_words") < least_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    return (
        docs.select(F.col(id_col), judged(F.col(text_col), crf).alias("made"))
        .select(id_col, "made.*")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= content_share))
    )
