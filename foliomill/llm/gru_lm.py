"""A gated recurrent language model that scores whole documents.

Texts are cut into words once; chunk files hold the hashes of a chunk's distinct words
and each word's number among them. Counts of all training tokens come first: chunks
send the hashes and counts of their distinct words to parts and get the totals back. The most frequent
words are the model's own; any other word is the model's <unk> times its share of
the rest, so that the model gives every text a probability. The output softmax is
factored by class (neighbours in frequency). Its biases start at the counts, so an
untrained model gives the base score.

Training is truncated backpropagation: segments of training documents are run
window by window with the state carried on, gradients stop at the window. Spark
tasks train on their segments from the same start, and their weights are averaged,
for a few rounds; a round takes its share of the segments, so all are trained on
once. Scoring runs each document from its first to its last token and
carries the state across windows; documents follow one another in a number of lanes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import load_arrays, new_folder, pack_arrays, save_file, slices
from foliomill.session import written

CHUNK_BYTES = 6 << 20
PART_WORDS = 8 << 20
HEAD = 2046  # words the model knows; with the end and <unk> it has 2048 outputs
CLASS = 32  # words to a class
STATE = 32
EMBEDDING = 16
WINDOW = 32  # steps that gradients go back
SEGMENT = 4 * WINDOW
SHARE = 1  # one in so many segments of the training documents is trained on
ROUNDS = 3
TASK_TOKENS = 1 << 20
TASKS = 1024
LANES = 128
BLOCK = 2048  # tokens whose class logits are held at a time
END, UNK = 0, 1
FILLER = 0xFFFF  # what follows the text's end in a short segment


def is_held_out(doc_id: int | None) -> bool:
    """By the CRC-32 of the id as text; a missing id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the texts' distinct words in order, the number of each word's, and the words
    of each text (null: none), with A-Z in lower case and all else unchanged."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # just the six characters of WORD
    every = split.flatten()
    real = pc.greater(pc.binary_length(every), 0)  # white space at an end leaves an empty word
    ends = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    sizes = np.diff(before[ends], prepend=0)
    numbered = every.filter(real).dictionary_encode()
    distinct = pc.cast(numbered.dictionary, pa.large_binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    values, inverse = np.unique(hashes, return_inverse=True)
    return values, inverse.astype(np.uint32)[numbered.indices.to_numpy(zero_copy_only=False)], sizes


def save_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Pack rows of about ``chunk_bytes`` of text into files of their words' hashes and numbers; a
    row per file with its path and words."""
    folder = new_folder(docs.sparkSession, "chunks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            values, numbers, sizes = _words(pa.concat_arrays(table["text"].cast(pa.large_string()).chunks))
            content = pack_arrays(doc_ids=table["doc_id"].to_pylist(), values=values, numbers=numbers, sizes=sizes.astype("<i8"))
            path = save_file(folder, "chunk", ".arrows", content)
            return pa.RecordBatch.from_pydict({"chunk": [path], "n_words": [len(numbers)]})

        for batch in batches:
            for rows in slices(batch, "text", chunk_bytes // 4):
                held.append(rows)
                size += rows["text"].nbytes
                if size >= chunk_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return written(docs.mapInArrow(save, "chunk string, n_words long"), "chunk-list")


class Chunk:
    """A chunk's documents: the hashes of its distinct words in order, and the number of each
    word's, documents end to end."""

    def __init__(self, path: str) -> None:
        held = load_arrays(path, doc_ids="list", values="<u8", numbers="<u4", sizes="<i8")
        self.doc_ids, self.values, self.numbers, self.sizes = held["doc_ids"], held["values"], held["numbers"], held["sizes"]
        self.ends = np.cumsum(self.sizes)
        self.held_out = np.array([is_held_out(d) for d in self.doc_ids], bool)

    def training_counts(self) -> np.ndarray:
        """Of the distinct words, in training documents."""
        return np.bincount(self.numbers[np.repeat(~self.held_out, self.sizes)], minlength=len(self.values))


SENT = "part int, chunk string, hashes binary, counts binary"


def _counts(chunks: DataFrame, parts: int) -> DataFrame:
    """Rows for each chunk and part: the totals of the chunk's distinct words, in order of their
    hashes. Rows without a chunk hold a part's sums and most frequent words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["chunk"].to_pylist():
                chunk = Chunk(path)
                values, counts = chunk.values, chunk.training_counts()
                rows = [(p, values[r], counts[r]) for p, r in _rows_by_part(values, parts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([path] * len(rows), pa.string()),
                        pa.array([r[1].tobytes() for r in rows], pa.binary()),
                        pa.array([r[2].astype("<u4").tobytes() for r in rows], pa.binary()),
                    ],
                    ["part", "chunk", "hashes", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, "<u8") for h in table["hashes"].to_pylist()]
        values, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        own = np.concatenate([np.frombuffer(c, "<u4") for c in table["counts"].to_pylist()])
        totals = np.bincount(inverse, own, len(values)).astype("<u8")
        answers = np.split(totals[inverse], np.cumsum([len(h) for h in hashes])[:-1])
        top = np.lexsort((values, -totals.astype(np.int64)))[:HEAD]
        top = top[totals[top] > 0]
        part = table["part"][0].as_py()
        sums = np.array([totals.sum(), (totals > 0).sum()], "<u8")
        n = table.num_rows
        return pa.table(
            {
                "part": pa.array([part] * (n + 2), pa.int32()),
                "chunk": pa.array([*table["chunk"].to_pylist(), "sums", "top"], pa.string()),
                "hashes": pa.array([None] * (n + 1) + [values[top].tobytes()], pa.binary()),
                "counts": pa.array([a.tobytes() for a in answers] + [sums.tobytes(), totals[top].tobytes()], pa.binary()),
            }
        )

    spread = chunks.select("chunk").repartition(max(1, min(chunks.count(), 100_000)), "chunk")
    return written(spread.mapInArrow(send, SENT).groupBy("part").applyInArrow(add, SENT), "lm-counts")


def _rows_by_part(values: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Rows of sorted hashes by part; within a part they stay sorted."""
    part = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    numbers, first = np.unique(part[order], return_index=True)
    return list(zip(numbers.tolist(), np.split(order, first[1:]), strict=True)) if len(numbers) else []


def _most_frequent(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The HEAD most frequent words of several lists, ties to the smaller hash."""
    h = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in hashes)])
    n = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in counts)])
    top = np.lexsort((h, -n))[:HEAD]
    return h[top], n[top]


def _head(counts: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training words and distinct words, and the most frequent words with their counts. The
    parts' own lists are merged in groups first, so the driver gets 64 lists at most."""

    def merge(table: pa.Table) -> pa.Table:
        h, n = _most_frequent(table["hashes"].to_pylist(), table["counts"].to_pylist())
        return pa.table({"hashes": pa.array([h.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([np.frombuffer(c, "<i8") for c in batch["counts"].to_pylist()], np.int64).reshape(-1, 2).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:1]), pa.array(both[1:])], ["n", "v"])

    n, v = counts.filter("chunk = 'sums'").mapInArrow(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    lists = counts.filter("chunk = 'top'").select((F.col("part") % 64).alias("g"), "hashes", "counts")
    merged = lists.groupBy("g").applyInArrow(merge, "hashes binary, counts binary").collect()
    return n or 0, v or 0, *_most_frequent([r.hashes for r in merged], [r.counts for r in merged])


class Vocabulary:
    """Numbers of the model's words: the end, <unk>, then words by frequency."""

    def __init__(self, words: int, distinct: int, documents: int, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.tokens = words + documents
        self.end_count = documents
        self.total = self.tokens + distinct + (documents > 0) + 1  # N + 1 * (V + 1)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order + 2
        self.rest = max(1, self.total - int((counts + 1).sum()) - (documents + 1))
        p = np.concatenate([[documents + 1, self.rest], counts + 1]) / self.total
        size = -(-len(p) // CLASS) * CLASS
        self.p = np.concatenate([p, np.zeros(size - len(p))])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(hashes), UNK, np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], UNK).astype(np.uint16)

    def start(self, seed: int = 5) -> list[np.ndarray]:
        """Weights whose outputs are the counts' shares: embedding, input, bias, recurrent,
        class weights and biases, word weights and biases."""
        rng = np.random.default_rng(seed)
        size = len(self.p)
        share = self.p.reshape(-1, CLASS)
        mass = np.maximum(share.sum(axis=1), 1e-30)
        small = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        weights = [
            rng.normal(0, 0.5, (size, EMBEDDING)),
            small(EMBEDDING, 3 * STATE),
            np.zeros(3 * STATE),
            small(STATE, 3 * STATE),
            np.zeros((STATE, size // CLASS)),
            np.log(mass),
            np.zeros((size, STATE)),
            np.log(np.maximum(share / mass[:, None], 1e-30)).ravel(),
        ]
        return [w.astype(np.float32) for w in weights]


HALVED = np.repeat(np.float32([0.5, 0.5, 1]), STATE)  # a sigmoid is the tanh of half its input, halved and shifted


def _inputs(weights: list[np.ndarray], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings (steps, lanes, EMBEDDING) of (steps, lanes) tokens, and what they add to the gates
    and new states (steps, 3 * STATE, lanes), the gates' part halved."""
    emb, wx, b = weights[:3]
    embedded = emb.take(tokens, axis=0)
    x = np.matmul((wx * HALVED).T, embedded.transpose(0, 2, 1))
    x += (b * HALVED)[:, None]
    return embedded, x


def _forward(
    x: np.ndarray, u: np.ndarray, h: np.ndarray, trace: bool, resets: dict[int, list[int]] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gates with the recurrent part of new states (steps, 3 * STATE, lanes), new states, and the
    states before, between and after the steps. Lanes come last, so that a gate's values of all
    lanes lie together. Without a trace the first two hold a single step. ``resets`` are the
    lanes that begin at a step with a state of zero."""
    steps, _, lanes = x.shape
    kept, back = steps if trace else 1, (u * HALVED).T
    mixed, new = np.empty((kept, 3 * STATE, lanes), np.float32), np.empty((kept, STATE, lanes), np.float32)
    states = np.empty((steps + 1, STATE, lanes), np.float32)
    states[0] = h.T
    for t in range(steps):
        before, after, own, n = states[t], states[t + 1], mixed[t % kept], new[t % kept]
        if resets and t in resets:
            before = before.copy()
            before[:, resets[t]] = 0
        np.matmul(back, before, out=own)
        gates = own[: 2 * STATE]
        gates += x[t, : 2 * STATE]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(own[2 * STATE :], gates[:STATE], out=n)
        n += x[t, 2 * STATE :]
        np.tanh(n, out=n)
        np.subtract(before, n, out=after)
        after *= gates[STATE:]
        after += n
    return mixed, new, states


def _steps(table: np.ndarray, u: np.ndarray, inputs: np.ndarray, h: np.ndarray) -> np.ndarray:
    """States after each of the (steps, lanes) inputs; ``table`` holds each token's input part."""
    x = np.ascontiguousarray((table * HALVED)[inputs].transpose(0, 2, 1))
    return _forward(x, u, h, False)[2][1:].transpose(0, 2, 1)


def _rows(states: np.ndarray) -> np.ndarray:
    """A row for each step and lane of states whose lanes come last."""
    return states.transpose(0, 2, 1).reshape(-1, STATE)


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts targets by class, their classes and places within these in that order,
    and each class with the cuts of its targets, so that a class is a slice."""
    own_class = (targets // CLASS).astype(np.uint16)
    order = np.argsort(own_class, kind="stable")
    own_class = own_class[order].astype(np.int64)
    numbers = np.bincount(own_class)
    ends = np.cumsum(numbers).tolist()
    cuts = [(c, ends[c] - k, ends[c]) for c, k in enumerate(numbers.tolist()) if k]
    return order, own_class, targets[order] % CLASS, cuts


def _class_logits(weights: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    """(classes, tokens) for rows of states."""
    logits = np.matmul(weights[4].T, flat.T)
    logits += weights[5][:, None]
    return logits


def _word_logits(weights: list[np.ndarray], flat: np.ndarray, own_class: np.ndarray, cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """(tokens, CLASS) for rows of states that lie by class."""
    words, logits = weights[6].reshape(-1, CLASS, STATE).transpose(0, 2, 1), np.empty((len(flat), CLASS), np.float32)
    for c, a, b in cuts:
        np.dot(flat[a:b], words[c], out=logits[a:b])
    logits += weights[7].reshape(-1, CLASS).take(own_class, axis=0)
    return logits


def _exponentials(logits: np.ndarray, at: tuple[np.ndarray, np.ndarray], axis: int) -> tuple[np.ndarray, np.ndarray]:
    """The logits at one output a token, and the sums of exponentials, which replace the logits.
    A token's outputs lie along ``axis``. Only logits that might leave the range of single
    precision are shifted: no sum is below the exponential of the token's own output."""
    own = logits[at]
    if not (own.min() > -60 and logits.max() < 80):
        top = logits.max(axis=axis, keepdims=True)
        logits -= top
        own = own - top.ravel()
    np.exp(logits, out=logits)
    return own, logits.sum(axis=0) if axis == 0 else logits @ np.ones(logits.shape[1], np.float32)


def log_probabilities(weights: list[np.ndarray], states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logs, of class and then of word within its class."""
    order, own_class, place, cuts = _by_class(targets)
    flat, out = states.take(order, axis=0), np.empty(len(targets), np.float32)
    if len(targets):
        own, total = _exponentials(_word_logits(weights, flat, own_class, cuts), (np.arange(len(flat)), place), 1)
        logp = own - np.log(total)
        for at in range(0, len(targets), BLOCK):
            rows = slice(at, at + BLOCK)
            chosen = own_class[rows]
            own, total = _exponentials(_class_logits(weights, flat[rows]), (chosen, np.arange(len(chosen))), 0)
            logp[rows] += own - np.log(total)
        out[order] = logp
    return out


def _output_error(logits: np.ndarray, at: tuple[np.ndarray, np.ndarray], axis: int) -> tuple[float, np.ndarray]:
    """Loss of the outputs at one place a token, and the gradient of the loss per token by the logits."""
    n = len(at[0])
    own, total = _exponentials(logits, at, axis)
    loss = float((np.log(total) - own).sum())
    logits *= np.expand_dims(1 / (total * np.float32(n)), axis)
    logits[at] -= np.float32(1 / n)
    return loss, logits


def gradients(
    weights: list[np.ndarray], tokens: np.ndarray, h: np.ndarray, real: np.ndarray | None = None, out: list[np.ndarray] | None = None
) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Loss per token, gradients and last state over one window of (steps + 1, lanes) tokens.
    Only targets where ``real`` (steps, lanes) holds count, all without it. Gradients are put
    into ``out``, if given, which holds zeros."""
    emb, wx, _, u, cw, _, ww, _ = weights
    inputs, targets = tokens[:-1], tokens[1:].ravel()
    steps, lanes = inputs.shape
    embedded, x = _inputs(weights, inputs)
    mixed, new, states = _forward(x, u, h, True)
    grads = [np.zeros_like(w) for w in weights] if out is None else out
    counted = np.arange(len(targets)) if real is None else np.flatnonzero(real)
    order, own_class, place, cuts = _by_class(targets[counted])
    counted, n, each = counted[order], len(counted), np.arange(len(counted))
    flat = _rows(states[1:]).take(counted, axis=0)
    loss, d = _output_error(_class_logits(weights, flat), (own_class, each), 0)
    grads[4][...], grads[5][...] = flat.T @ d.T, d.sum(axis=1)
    dflat = d.T @ cw.T
    more, d = _output_error(_word_logits(weights, flat, own_class, cuts), (each, place), 1)
    loss += more
    words, by_word, from_words = ww.reshape(-1, CLASS, STATE), grads[6].reshape(-1, CLASS, STATE), np.empty_like(flat)
    for c, a, b in cuts:
        own = d[a:b]
        np.dot(own.T, flat[a:b], out=by_word[c])
        np.dot(own, words[c], out=from_words[a:b])
    dflat += from_words
    grads[7].reshape(-1, CLASS)[[c for c, _, _ in cuts]] = np.add.reduceat(d, [a for _, a, _ in cuts], axis=0)
    rows = np.zeros((steps * lanes, STATE), np.float32)
    rows[counted] = dflat
    dstates = np.ascontiguousarray(rows.reshape(steps, lanes, STATE).transpose(0, 2, 1))
    reset, keep, recurrent, before = mixed[:, :STATE], mixed[:, STATE : 2 * STATE], mixed[:, 2 * STATE :], states[:-1]
    # what multiplies the state's gradient, for all steps at once
    factors, rest = x, 1 - keep  # the inputs' part isn't needed any more
    to_reset, to_keep, to_recurrent = factors[:, :STATE], factors[:, STATE : 2 * STATE], factors[:, 2 * STATE :]
    to_new = new * new
    np.subtract(1, to_new, out=to_new)
    to_new *= rest
    np.multiply(to_new, reset, out=to_recurrent)
    np.subtract(states[1:], new, out=to_keep)  # is keep * (before - new)
    to_keep *= rest
    np.subtract(1, reset, out=to_reset)
    to_reset *= recurrent
    to_reset *= to_recurrent
    dh = np.zeros((STATE, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        dh = np.add(dh, dstates[t], out=dstates[t])
        by_part = factors[t].reshape(3, STATE, lanes)
        by_part *= dh
        dh = dh * keep[t]
        dh += u @ factors[t]
    by_lane = factors.transpose(0, 2, 1)
    grads[3][...] = np.matmul(before, by_lane).sum(axis=0)
    np.multiply(to_new, dstates, out=to_recurrent)  # the input part of a new state isn't reset
    grads[2][...] = factors.sum(axis=0).sum(axis=1)
    grads[1][...] = np.matmul(embedded.transpose(0, 2, 1), by_lane).sum(axis=0)
    by_input, ids = np.matmul(by_lane, wx.T).reshape(-1, EMBEDDING), inputs.ravel()
    order, numbers = np.argsort(ids.astype(np.uint16), kind="stable"), np.bincount(ids)
    seen = np.flatnonzero(numbers)
    first = np.cumsum(numbers[seen]) - numbers[seen]
    grads[0][seen] = np.add.reduceat(by_input.take(order, axis=0), first, axis=0)
    return loss / n, grads, states[-1].T


def _views(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays shaped as ``like`` that lie in ``flat`` one after another."""
    out, at = [], 0
    for w in like:
        out.append(flat[at : at + w.size].reshape(w.shape))
        at += w.size
    return out


def _keep_freed_memory() -> None:
    """After a large array is freed, the C library keeps smaller ones that are freed, which
    otherwise go back to the system and come again page by page in every window."""
    np.empty((32 << 20) - 8192, np.uint8)


def train_locally(weights: list[np.ndarray], segments: np.ndarray, rate: float, lanes: int = 64) -> list[np.ndarray]:
    """One pass of Adam over segments (rows of SEGMENT + 1 tokens), the state carried window by window."""
    _keep_freed_memory()
    flat = np.concatenate([w.ravel() for w in weights])
    m, v, grad, change, step = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.empty_like(flat), 0
    weights, grads = _views(flat, weights), _views(grad, weights)
    for at in range(0, len(segments), lanes):
        batch = segments[at : at + lanes].T.astype(np.int64)
        lengths = (batch != FILLER).sum(axis=0) - 1
        order = np.argsort(-lengths, kind="stable")
        batch, lengths = np.ascontiguousarray(batch[:, order]), lengths[order]
        real = batch != FILLER
        batch[~real] = END
        h = np.zeros((batch.shape[1], STATE), np.float32)
        for w0 in range(0, int(lengths[0]), WINDOW):
            live = int((lengths > w0).sum())  # the longest come first
            window = slice(w0, w0 + WINDOW + 1)
            grad.fill(0)
            _, _, h = gradients(weights, batch[window, :live], h[:live], real[window, :live][1:], grads)
            norm, step = float(np.sqrt(grad @ grad)), step + 1
            if norm > 1:
                grad /= norm
            # sums of the gradients and of their squares, a tenth and a hundredth of which are the averages
            m *= 0.9
            m += grad
            v *= 0.99
            grad *= grad
            v += grad
            root = ((1 - 0.99**step) / 0.01) ** 0.5  # both start at zero, which the powers make good
            np.sqrt(v, out=change)
            change += 1e-6 * root
            np.divide(m, change, out=change)
            change *= 0.1 * rate * root / (1 - 0.9**step)
            flat -= change
    return weights


def _segments(chunks: DataFrame, vocabulary, share: int) -> DataFrame:
    """(key, ids): segments of training documents with the token before them. Which ones is
    decided by a hash of document, row and place, so all have the same chance and copies spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["chunk"].to_pylist():
                chunk, keys, starts, lengths = Chunk(path), [], [], []
                tokens = vocabulary.value.numbers(chunk.values)[chunk.numbers]
                # what lies before a text and after it is an end
                stream = np.full(len(tokens) + 2 * len(chunk.sizes), END, "<u2")
                stream[np.arange(len(tokens)) + np.repeat(2 * np.arange(len(chunk.sizes)) + 1, chunk.sizes)] = tokens
                for row, (doc_id, size, end) in enumerate(zip(chunk.doc_ids, chunk.sizes.tolist(), chunk.ends.tolist(), strict=True)):
                    if chunk.held_out[row]:
                        continue
                    for at in range(0, size + 1, SEGMENT):
                        key = zlib.crc32(f"{doc_id} {row} {at}".encode())
                        if key % share == 0:
                            keys.append(key)
                            starts.append(end - size + 2 * row + at)
                            lengths.append(size + 2 - at)
                # filler takes up the rest of a short segment
                place = np.arange(SEGMENT + 1)
                rows = np.minimum(np.array(starts, np.int64)[:, None] + place, len(stream) - 1)
                ids = np.where(place < np.array(lengths, np.int64)[:, None], stream[rows], np.uint16(FILLER)).astype("<u2")
                out = [i.tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["key", "ids"])

    spread = chunks.select("chunk").repartition(max(1, min(chunks.count(), 100_000)), "chunk")
    return written(spread.mapInArrow(run, "key long, ids binary"), "lm-segments")


def _packed(weights: list[np.ndarray]) -> bytes:
    return np.concatenate([w.ravel() for w in weights]).astype("<f4").tobytes()


def _unpacked(content: bytes, like: list[np.ndarray]) -> list[np.ndarray]:
    return _views(np.frombuffer(content, "<f4").copy(), like)


def train(segments: DataFrame, weights: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Rounds of local training and averaging, each over its own share of the segments. Tasks hold about TASK_TOKENS tokens, more where
    there would be over TASKS of them; averages are made in two levels, so the driver gets 32 at most."""
    spark = segments.sparkSession
    n = -(-segments.count() // rounds)
    tasks = min(TASKS, max(1, -(-n * SEGMENT // TASK_TOKENS)))
    for r in range(rounds if n else 0):
        start, rate = spark.sparkContext.broadcast(weights), 0.01 * 0.5**r

        def local(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = [np.frombuffer(i, "<u2") for b in batches for i in b["ids"].to_pylist()]
            if own:
                trained = train_locally(start.value, np.array(own), rate)
                yield pa.RecordBatch.from_pydict(
                    {"g": pa.array([TaskContext.get().partitionId() % 32], pa.int32()), "n": [len(own)], "weights": [_packed(trained)]}
                )

        def average(table: pa.Table) -> pa.Table:
            counts = table["n"].to_pylist()
            mean = sum(np.frombuffer(w, "<f4").astype(np.float64) * k for w, k in zip(table["weights"].to_pylist(), counts, strict=True))
            return pa.table(
                {"g": table["g"].slice(0, 1), "n": pa.array([sum(counts)]), "weights": [(mean / sum(counts)).astype("<f4").tobytes()]}
            )

        schema = "g int, n long, weights binary"
        dealt = segments.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)
        dealt = dealt.repartition(tasks, F.col("key") * 31 + r).sortWithinPartitions("key", "ids")
        groups = dealt.mapInArrow(local, schema).groupBy("g").applyInArrow(average, schema).collect()
        total = sum(g.n for g in groups)
        if not total:  # few segments, none of them in this round
            continue
        flat = sum(np.frombuffer(g.weights, "<f4").astype(np.float64) * g.n for g in sorted(groups, key=lambda g: g.g)) / total
        weights = _unpacked(flat.astype("<f4").tobytes(), weights)
    return weights


def _dealt(sizes: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents with tokens by lane, the longest lane first: each, from the longest on, goes to
    the lane with the fewest tokens."""
    held = [(0, lane) for lane in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        if sizes[i]:
            size, lane = held[0]
            dealt[lane].append(i)
            heapq.heapreplace(held, (size + int(sizes[i]), lane))
    return [dealt[lane] for _, lane in sorted(held, key=lambda x: -x[0])]


def document_scores(weights: list[np.ndarray], documents: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log probability of each document (numbers with the end), run window by window
    from a zero state and an end before the first token. A lane runs one document after another,
    so that all stay busy; more lanes than the longest document leaves tokens for aren't taken."""
    _keep_freed_memory()
    out, sizes = np.zeros(len(documents)), np.array([len(d) for d in documents], np.int64)
    if not sizes.sum():
        return out
    dealt = _dealt(sizes, min(lanes, -(-int(sizes.sum()) // int(sizes.max()))))
    lengths = np.array([sizes[own].sum() for own in dealt])
    inputs, targets = (np.full((int(lengths[0]), len(dealt)), END, np.uint16) for _ in range(2))
    owner, starts = np.zeros(inputs.shape, np.int32), {}
    for lane, own in enumerate(dealt):
        at = 0
        for i in own:
            end = at + len(documents[i])
            inputs[at + 1 : end, lane], targets[at:end, lane], owner[at:end, lane] = documents[i][:-1], documents[i], i
            starts.setdefault(at, []).append(lane)
            at = end
    h = np.zeros((len(dealt), STATE), np.float32)
    for at in range(0, len(inputs), WINDOW):
        live = int((lengths > at).sum())  # the longest come first
        part = slice(at, at + WINDOW)
        resets = {t - at: starts[t] for t in range(at, at + WINDOW) if t in starts}
        states = _forward(_inputs(weights, inputs[part, :live])[1], weights[3], h[:live], False, resets)[2]
        h = states[-1].T
        real = np.flatnonzero(np.arange(at, at + len(states) - 1)[:, None] < lengths[:live])
        logp = log_probabilities(weights, _rows(states[1:]).take(real, axis=0), targets[part, :live].ravel()[real])
        out += np.bincount(owner[part, :live].ravel()[real], logp.astype(np.float64), len(out))
    return out


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(docs: DataFrame, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) the columns of RESULT; scores are log10 of probabilities.

    A null or empty text is its end alone. Repeated rows count and are scored each. A null
    doc_id is trained on. With no training documents every token is unknown and both
    scores rest on nothing but the smoothing.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = save_chunks(narrow, CHUNK_BYTES)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_WORDS))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    documents = narrow.select("doc_id").filter(crc % 7 != 2).count()
    counts = _counts(chunks, parts)
    words, distinct, hashes, head_counts = _head(counts)
    model = Vocabulary(words, distinct, documents, hashes, head_counts)  # HEAD words at most
    vocabulary = spark.sparkContext.broadcast(model)
    weights = train(_segments(chunks, vocabulary, share), model.start(), rounds)
    trained = spark.sparkContext.broadcast(weights)  # its size is set by HEAD and STATE

    def finish(table: pa.Table) -> pa.Table:
        chunk, known = Chunk(table["chunk"][0].as_py()), vocabulary.value
        values, inverse = chunk.values, chunk.numbers
        answers = {p: c for p, c in zip(table["part"].to_pylist(), table["counts"].to_pylist(), strict=True) if c is not None}
        count = np.zeros(len(values))
        for p, rows in _rows_by_part(values, parts):
            count[rows] = np.frombuffer(answers[p], "<u8")
        logs, numbers = np.log10((count + 1) / known.total), known.numbers(values)
        # <unk> stands for the rest, of which a word has its share
        extra = np.where(numbers == UNK, np.log10((count + 1) / known.rest), 0.0)

        def by_document(per_word: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(per_word[inverse])])
            return sums[chunk.ends] - sums[chunk.ends - chunk.sizes]

        base = by_document(logs) + np.log10((known.end_count + 1) / known.total)
        tokens = numbers[inverse]
        runs = [np.append(tokens[e - s : e], np.uint16(END)) for e, s in zip(chunk.ends.tolist(), chunk.sizes.tolist(), strict=True)]
        scores = document_scores(trained.value, runs) / np.log(10) + by_document(extra)
        n_known = np.rint(by_document((count > 0).astype(float))).astype(np.int64) + (known.end_count > 0)
        return pa.table(
            {
                "doc_id": pa.array(chunk.doc_ids, pa.int64()),
                "held_out": pa.array(chunk.held_out),
                "n_tokens": pa.array(chunk.sizes + 1),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array(np.full(len(chunk.sizes), known.tokens, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(scores),
            }
        )

    answers = counts.filter("chunk not in ('sums', 'top')").select("part", "chunk", "counts")
    every = chunks.select(F.lit(-1).alias("part"), "chunk", F.lit(None).cast("binary").alias("counts"))
    both = answers.unionByName(every).repartition(max(1, min(chunks.count(), 100_000)), "chunk")  # small rows, long work
    return both.groupBy("chunk").applyInArrow(finish, RESULT)
