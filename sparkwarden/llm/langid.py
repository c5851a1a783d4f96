"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position with
language probabilities, and a document's probabilities are their mean over all its
positions. It is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled documents, on the driver; all texts are then labelled
whole, in windows, by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import small_batches, stored

UNDETERMINED = "und"

# The training sample: at most so many documents of a language and, shared evenly by many languages, in all
# (but one of each language); so many windows of each.
DOCS_PER_LANGUAGE = 1000
SAMPLE_DOCS = 16000
WINDOWS_PER_DOC = 4
# Ranges of the hash that draws the sample; so many counts of a language meet.
HASH_CELLS = 1 << 12

WINDOW = 64
HIDDEN = 8
STEPS = 300
BATCH = 256
RATE = 0.02
SEED = 11

# Texts whose language is less sure than this are not kept as text of a language.
MIN_SCORE = 0.4

# Windows that go through the network together.
_BLOCK = 2048


@dataclass
class Network:
    """Weights by name. Per direction (f, b): E, the gates' inputs by byte (rows: update, reset, candidate), U, their
    recurrent matrix, and V, the output matrix; c is the output's bias. Vectors are columns."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def _fresh(languages: list[str], hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    weights = {}
    for d in "fb":
        weights[f"{d}E"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        weights[f"{d}U"] = (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        weights[f"{d}V"] = rng.normal(0, 0.3, (len(languages), hidden)).astype(np.float32)
    weights["c"] = np.zeros((len(languages), 1), np.float32)
    return weights


def _run(w: dict, d: str, x: np.ndarray, live: np.ndarray | None, tape: list | None = None) -> np.ndarray:
    """States (time, hidden, windows) of one direction over bytes x (time, windows); dead positions keep state zero.

    `tape` gets what the gradients need of every step.
    """
    steps, n = x.shape
    inputs, recurrent = w[f"{d}E"], w[f"{d}U"]
    k = recurrent.shape[1]
    states = np.empty((steps, k, n), np.float32)
    h = np.zeros((k, n), np.float32)
    gates, a = np.empty((3 * k, n), np.float32), np.empty((3 * k, n), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        if tape is not None:
            gates, a = np.empty_like(gates), np.empty_like(a)
        np.take(inputs, x[t], axis=1, out=gates, mode="clip")
        np.matmul(recurrent, h, out=a)
        zr, m, reset = gates[: 2 * k], gates[2 * k :], a[2 * k :]
        # The logistic function by way of tanh.
        zr += a[: 2 * k]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        if tape is not None:
            tape.append((t, h, gates, reset))
            m += zr[k:] * reset
        else:
            reset *= zr[k:]
            m += reset
        np.tanh(m, out=m)
        after = states[t]
        np.subtract(h, m, out=after)
        after *= zr[:k]
        after += m
        if live is not None:
            after *= live[t]
        h = after
    return states


def _probabilities(w: dict, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """(time, languages, windows)."""
    p = np.matmul(w["fV"], forward)
    p += np.matmul(w["bV"], backward)
    p += w["c"]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def _gradients(w: dict, x: np.ndarray, live: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the live positions, and its gradients through time."""
    tapes: dict[str, list] = {"f": [], "b": []}
    states = {d: _run(w, d, x, live, tapes[d]) for d in "fb"}
    p = _probabilities(w, states["f"], states["b"])
    n = live.sum()
    at = np.broadcast_to(labels[None, None, :], (x.shape[0], 1, x.shape[1]))
    picked = np.take_along_axis(p, at, axis=1)
    loss = -(np.log(picked[:, 0] + 1e-9) * live).sum() / n
    np.put_along_axis(p, at, picked - 1, axis=1)
    p *= (live / n)[:, None, :]
    grads = {name: np.zeros_like(v) for name, v in w.items()}
    grads["c"] += p.sum(axis=(0, 2))[:, None]
    one_of = np.eye(256, dtype=np.float32)
    for d in "fb":
        k = states[d].shape[1]
        grads[f"{d}V"] += np.einsum("tlb,thb->lh", p, states[d], optimize=True)
        from_output = np.matmul(w[f"{d}V"].T, p)
        dh = np.zeros_like(states[d][0])
        for t, before, gates, reset in reversed(tapes[d]):
            z, r, m = gates[:k], gates[k : 2 * k], gates[2 * k :]
            dh = (dh + from_output[t]) * live[t]
            dm = dh * (1 - z) * (1 - m * m)
            into = np.concatenate([dh * (before - m) * z * (1 - z), dm * reset * r * (1 - r), dm])
            grads[f"{d}E"] += into @ one_of[x[t]]
            into[2 * k :] *= r
            grads[f"{d}U"] += into @ before.T
            dh = dh * z + w[f"{d}U"].T @ into
    return float(loss), grads


def train(
    windows: list[tuple[bytes, str]], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED
) -> Network:
    """A network from labelled windows of at most WINDOW bytes (Adam; languages weigh alike). Deterministic."""
    languages = sorted({language for _, language in windows})
    if not languages:
        return Network([], {})
    rng = np.random.default_rng(seed)
    w = _fresh(languages, hidden, rng)
    x = np.zeros((WINDOW, len(windows)), np.uint8)
    live = np.zeros((WINDOW, len(windows)), np.float32)
    for k, (data, _) in enumerate(windows):
        x[: len(data), k] = np.frombuffer(data[:WINDOW], np.uint8)
        live[: len(data), k] = 1
    labels = np.array([languages.index(language) for _, language in windows])
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    first, second = ({name: np.zeros_like(v) for name, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(rows, max(1, batch // len(of))) for rows in of])
        _, grads = _gradients(w, x[:, chosen], live[:, chosen], labels[chosen])
        pace = rate * min(1, step / 20) * (0.1 + 0.9 * (1 - step / steps))
        for name, g in grads.items():
            np.clip(g, -1, 1, out=g)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            w[name] -= (pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(languages, w)


def position_probabilities(network: Network, windows: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """(positions, languages, windows) for bytes (windows, positions)."""
    x = np.ascontiguousarray(windows.T)
    mask = None if live is None else np.ascontiguousarray(live.T, np.float32)
    w = network.weights
    return _probabilities(w, _run(w, "f", x, mask), _run(w, "b", x, mask))


def document_probabilities(network: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean over all positions of each text; an empty text has zeros.

    A text is cut into windows of WINDOW bytes; the last one ends with the text and
    only its positions not yet seen count. Shorter texts are one window of their own.
    """
    sums = np.zeros((len(texts), len(network.languages)))
    pending: list[tuple[int, np.ndarray, int]] = []  # text, windows, positions of the last that count
    held = 0

    def flush() -> None:
        nonlocal held
        if not pending:
            return
        p = position_probabilities(network, np.concatenate([rows for _, rows, _ in pending]))
        of = np.concatenate([np.full(len(rows), k) for k, rows, _ in pending])
        by_window = p.sum(axis=0, dtype=np.float64)
        at = -1
        for _, rows, fresh in pending:
            at += len(rows)
            if fresh < WINDOW:
                by_window[:, at] = p[WINDOW - fresh :, :, at].sum(axis=0, dtype=np.float64)
        for language, row in enumerate(by_window):
            sums[:, language] += np.bincount(of, row, len(texts))
        pending.clear()
        held = 0

    short = []
    for k, data in enumerate(texts):
        if len(data) < WINDOW:
            if data:
                short.append(k)
            continue
        raw = np.frombuffer(data, np.uint8)
        full, rest = divmod(len(raw), WINDOW)
        at = 0
        while at < full:
            to = min(full, at + _BLOCK - held)
            pending.append((k, raw[at * WINDOW : to * WINDOW].reshape(-1, WINDOW), WINDOW))
            held, at = held + to - at, to
            if held >= _BLOCK:
                flush()
        if rest:
            pending.append((k, raw[-WINDOW:][None, :], rest))
            held += 1
            if held >= _BLOCK:
                flush()
    flush()
    for at in range(0, len(short), _BLOCK):
        group = short[at : at + _BLOCK]
        x, live = np.zeros((len(group), WINDOW), np.uint8), np.zeros((len(group), WINDOW), np.float32)
        for row, k in enumerate(group):
            x[row, : len(texts[k])] = np.frombuffer(texts[k], np.uint8)
            live[row, : len(texts[k])] = 1
        p = position_probabilities(network, x, live)
        sums[group] = (p * live.T[:, None, :]).sum(axis=0, dtype=np.float64).T
    lengths = np.array([max(1, len(t)) for t in texts], float)
    return sums / lengths[:, None]


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_windows(
    docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, sample_docs: int = SAMPLE_DOCS
) -> list[tuple[bytes, str]]:
    """Windows of the training sample: of each language the documents with the lowest hashes, windows spread over their texts.

    Of a language at most `docs_per_language` documents are drawn, or an even share of
    `sample_docs` where that is less, and one at least; WINDOWS_PER_DOC windows of each.
    Counts by ranges of the hash tell which ranges the drawing of a language reaches, so a
    language of most documents sends no more rows than the others.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    mixed = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))
    size = F.length("text")
    # Only the windows of a document go on, not its text.
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(size - WINDOW // 2, F.lit(1))).cast("int") + 1 for k in range(WINDOWS_PER_DOC)]
    cut = F.array(*[F.substring(F.col("text"), s, F.lit(WINDOW)) for s in starts])
    # Ranges in the order of the hash, which is signed.
    cell = (F.shiftright(mixed, 64 - (HASH_CELLS - 1).bit_length())).alias("_cell")
    cells = stored(labelled.groupBy("lang", cell).agg(F.count(F.lit(1)).alias("_n")), "hash-cells")
    languages = cells.agg(F.countDistinct("lang")).first()[0]
    drawn = max(1, min(docs_per_language, sample_docs // max(1, languages)))
    so_far = F.sum("_n").over(Window.partitionBy("lang").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    # Each range holds a document, so a language reaches at most `drawn` ranges.
    reached = cells.withColumn("_before", so_far - F.col("_n")).where(F.col("_before") < drawn).select("lang", "_cell")
    if languages <= sample_docs:
        # At most `sample_docs` rows; with more languages both sides meet by language and range.
        reached = F.broadcast(reached)
    narrow = labelled.select("lang", "doc_id", mixed.alias("_h"), cell, cut.alias("_cut"))
    few = narrow.join(reached, ["lang", "_cell"], "left_semi")
    ranked = few.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id", "_cut")))
    rows = ranked.where(F.col("_place") <= drawn).select("lang", "_h", "doc_id", "_cut").collect()
    rows.sort(key=lambda r: (r["lang"], r["_h"], r["doc_id"] if r["doc_id"] is not None else -1, r["_cut"]))
    return [(w.encode("utf-8")[:WINDOW], r["lang"]) for r in rows for w in r["_cut"]]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _labeller(network: Network):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t and has_letter(t) else "" for t in batch.column(1).to_pylist()]
            found = [UNDETERMINED] * len(texts)
            scores = [0.0] * len(texts)
            if network.languages:
                p = document_probabilities(network, [t.encode("utf-8") for t in texts])
                for k, t in enumerate(texts):
                    if t:
                        best = int(p[k].argmax())
                        found[k], scores[k] = network.languages[best], min(1.0, float(p[k, best]))
            columns = [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang_pred", "score"])

    return label


def label_documents(docs: DataFrame, network: Network, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, lang_pred, score) per row of `docs`; `row` holds its columns, or those of `keep`, as a struct.

    `und` with score 0 for a null text or one without letters, and for any text if the
    network learned no language. Whole texts of any length are labelled; repeated rows
    get the same label.
    """
    small_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row")
    narrow = docs.select(row, F.col(f"`{text_col}`").alias("_text"))
    kind = narrow.schema["row"].dataType.simpleString()
    return narrow.mapInArrow(_labeller(network), f"row {kind}, lang_pred string, score double")


def identified(docs: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """`label_documents` by a network trained on the labelled documents that are not held out."""
    return label_documents(docs, train(training_windows(docs)), keep=keep)


def in_a_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, all columns, whose language was determined with at least `min_score`."""
    return identified(docs).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
