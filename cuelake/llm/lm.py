"""Masked pseudo-likelihood scores of documents, by a bidirectional window network trained in numpy.

Every word of a text is hidden in turn and predicted from the `len(OFFSETS)` words around it, on both sides.
A document's score is the sum of the log-probabilities of its words, each given all its neighbours.

1. Words are counted over all documents, partly in the tasks, then by a shuffle. The most frequent ones get
   ids, as many as the root of the number of tokens, `MOST` at most; any other word falls in one of `BUCKETS` buckets
   by its hash.
2. Ids are split into `CLASSES` classes of like frequency, and each class into a Huffman tree of its words. A
   position's embeddings are added up and squashed; from them the network predicts the class by a softmax, and the
   word by a decision at each node of its path. Both depend on the context, and the probabilities of all ids add up
   to 1. Within a bucket all words have the same share.
3. Texts become ids once, 16 bits a word, in a table that all rounds and the scoring read.
4. There are `ROUNDS` rounds, each with its own part of the documents, all of them together with each document once.
   In a round each task trains the network on its documents of that part. The networks, weighted by their numbers of
   words, are averaged in a tree of tasks that each hold two of them at a time, so what is gathered grows with the
   input but no task or driver holds it whole; the next round starts from the average.
5. The averaged network is broadcast and scores every document. Its size is bounded by `MOST`.

The same files and settings give the same scores. Another split of the input into tasks changes them little: the
networks meet after each round.

Defined cases: null text and texts without words have no tokens and score 0; repeated rows are scored each and
count each in training; a null doc_id is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Memo, materialize, once_a_process, passing

#: `MOST` words, the buckets and the gap have numbers of 16 bits, which are sorted fastest.
LEAST, MOST, LONGEST, BUCKETS, CLASSES, HIDDEN, ROUNDS = 1_024, 65_000, 64, 256, 32, 8, 3
OFFSETS, REACH = (-2, -1, 1, 2), 2
RATE, BATCH, SEED = 0.15, 4_096, 5
#: Tokens that are held in arrays at a time, words that a task counts or remembers, networks that meet in a task.
CHUNK, WORDS_KEPT, FAN_IN = 100_000, 300_000, 32


@dataclass
class Words:
    """What the counts say: ids of frequent words; each id's class, its path in the class's tree (nodes, and 1 or -1 for
    the way taken), and the log of the share that one word has of it; the classes' and nodes' log-odds."""

    ids: dict[bytes, int]
    cls: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    path: np.ndarray
    nodes: np.ndarray
    ways: np.ndarray
    odds: np.ndarray

    def parts(self) -> tuple:
        """As plain values: what is broadcast is read without this module."""
        return self.ids, self.cls, self.share, self.prior, self.path, self.nodes, self.ways, self.odds

    @property
    def gap(self) -> int:
        """The id beyond a text's ends; it has no path."""
        return len(self.cls)

    def id_of(self, word: bytes) -> int:
        known = self.ids.get(word)
        return len(self.cls) - BUCKETS + xxhash.xxh32_intdigest(word) % BUCKETS if known is None else known

    def steps(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes and ways on the paths of all targets, one after another, and which target each belongs to."""
        start = self.path[target]
        size = self.path[target + 1] - start
        of = np.repeat(np.arange(len(target)), size)
        at = np.arange(len(of)) + np.repeat(start - (np.cumsum(size) - size), size)
        return self.nodes[at], self.ways[at], of


def trees(n: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start of each id's path, and two more; nodes; ways; log-odds of each node) of a Huffman tree a class."""
    odds: list[float] = []
    paths: list[list[tuple[int, int]]] = [[] for _ in n]
    for c in range(CLASSES):
        heap = [(float(n[i]), int(i), [int(i)]) for i in np.flatnonzero(cls == c)]
        heapq.heapify(heap)
        while len(heap) > 1:
            (x, i, left), (y, j, right) = heapq.heappop(heap), heapq.heappop(heap)
            for side, way in ((left, 1), (right, -1)):
                for w in side:
                    paths[w].append((len(odds), way))
            odds.append(float(np.log(x / y)))
            heapq.heappush(heap, (x + y, min(i, j), left + right))
    flat = [s for p in paths for s in p]
    start = np.concatenate(([0], np.cumsum([len(p) for p in paths]), [len(flat)]))
    return start, np.array([s[0] for s in flat], np.int64), np.array([s[1] for s in flat], np.float32), np.array(odds, np.float32)


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        buckets = [xxhash.xxh32_intdigest(w) % BUCKETS for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(buckets, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "bucket", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            counts.update((text.as_py() or b"").lower().split())
            if len(counts) > WORDS_KEPT:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, bucket, n) over all documents."""
    partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_batches, "word binary, bucket int, n long")
    return partial.groupBy("word", "bucket").agg(F.sum("n").alias("n"))


def make_words(counts: DataFrame) -> Words:
    """The vocabulary, its classes and trees. What reaches the driver is bounded: MOST short words and BUCKETS sums."""
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    size = min(MOST, max(LEAST, math.isqrt(total)))
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(size).collect()
    chosen, size = {bytes(r["word"]): i for i, r in enumerate(top)}, len(top)
    n, distinct = np.zeros(size + BUCKETS), np.ones(size + BUCKETS)
    n[:size] = [r["n"] for r in top]
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        n[size + r["bucket"]], distinct[size + r["bucket"]] = r["n"], r["words"]
    for word, i in chosen.items():  # a bucket holds what the vocabulary doesn't
        bucket = size + xxhash.xxh32_intdigest(word) % BUCKETS
        n[bucket] -= n[i]
        distinct[bucket] -= 1
    n, distinct = n + 1, np.maximum(distinct, 1)
    order = np.argsort(-n, kind="stable")
    mass = np.cumsum(np.sqrt(n[order]))
    cls = np.empty(len(n), np.int64)
    cls[order] = np.minimum((CLASSES * (mass - np.sqrt(n[order]) / 2) / mass[-1]).astype(np.int64), CLASSES - 1)
    total = np.bincount(cls, n, CLASSES)
    return Words(chosen, cls, -np.log(distinct), np.log(np.maximum(total, 1e-9) / total.sum()), *trees(n, cls))


class Network:
    """One float32 vector of parameters, and views of it. An id's row holds its embedding for each offset, side by side."""

    def __init__(self, flat: np.ndarray, ids: int, nodes: int):
        sizes = [(ids + 1) * len(OFFSETS) * HIDDEN, HIDDEN * CLASSES, CLASSES, nodes * (HIDDEN + 1)]  # one more row, for what is beyond the ends
        self.flat = flat
        a, b, self.bias, c = np.split(flat, np.cumsum(sizes)[:-1])
        # a node's last weight is its log-odds
        self.inputs, self.output, self.nodes = a.reshape(ids + 1, -1), b.reshape(HIDDEN, CLASSES), c.reshape(nodes, HIDDEN + 1)

    @staticmethod
    def of(flat: np.ndarray, words: Words) -> Network:
        return Network(flat, len(words.cls), len(words.odds))

    @staticmethod
    def start(words: Words) -> Network:
        """Small random weights, and the frequencies as biases: at first every word has its unigram probability."""
        rng = np.random.default_rng(SEED)
        size = (len(words.cls) + 1) * len(OFFSETS) * HIDDEN + HIDDEN * CLASSES
        nodes = np.zeros((len(words.odds), HIDDEN + 1))
        nodes[:, -1] = words.odds
        return Network.of(np.concatenate((rng.normal(0, 0.1, size), words.prior, nodes.ravel())).astype(np.float32), words)

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values and log-probabilities of the classes at each place, but for `REACH` places at both ends."""
        rows, n = self.inputs.take(ids, axis=0), len(ids) - 2 * REACH
        hidden = rows[REACH + OFFSETS[0] :][:n, :HIDDEN].copy()
        for k, o in enumerate(OFFSETS[1:], 1):
            hidden += rows[REACH + o : REACH + o + n, k * HIDDEN : (k + 1) * HIDDEN]
        np.tanh(hidden, out=hidden)
        z = hidden @ self.output
        z += self.bias
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))  # scores are small: no overflow
        return hidden, z

    def decide(self, hidden: np.ndarray, nodes: np.ndarray, ways: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hidden values and 1, weights of the nodes, how clearly each decision falls for the way taken)."""
        seen = np.empty((len(hidden), HIDDEN + 1), np.float32)
        seen[:, :-1], seen[:, -1] = hidden, 1
        seen, own = np.repeat(seen, np.bincount(of, minlength=len(seen)), axis=0), self.nodes.take(nodes, axis=0)
        return seen, own, ways * np.einsum("ij,ij->i", seen, own)


def _by_row(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their gradients."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[first], np.add.reduceat(grad.take(order, axis=0), first, axis=0)


class Trainer:
    """Adagrad with one rate a row of embeddings or a node."""

    def __init__(self, net: Network, words: Words):
        self.net, self.words = net, words
        self.seen, self.seen_nodes = np.ones(len(net.inputs), np.float32), np.ones(len(net.nodes), np.float32)
        self.seen_output, self.seen_bias = np.ones_like(net.output), np.ones_like(net.bias)

    def step(self, ids: np.ndarray, target: np.ndarray) -> None:
        """ids: with `REACH` more on both sides; target: the ids between."""
        net, n, at_gap = self.net, len(target), target == self.words.gap
        hidden, z = net.forward(ids)
        error = np.exp(z, out=z)
        error[np.arange(n), np.append(self.words.cls, 0)[target]] -= 1
        error[at_gap] = 0
        back = error @ net.output.T
        nodes, ways, of = self.words.steps(target)
        if len(nodes):
            seen, own, clear = net.decide(hidden, nodes, ways, of)
            slope = -ways / (1 + np.exp(np.minimum(clear, 40)))
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            own *= slope[:, None]
            seen *= slope[:, None]
            back[of[first]] += np.add.reduceat(own, first, axis=0)[:, :-1]
            rows, grad = _by_row(nodes, seen)
            self.seen_nodes[rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            grad *= (RATE / np.sqrt(self.seen_nodes[rows]))[:, None]
            net.nodes[rows] -= grad
        back *= 1 - hidden * hidden
        # the word at a place is a neighbour of the places around it, once for each offset
        grad = np.zeros((len(ids), len(OFFSETS) * HIDDEN), np.float32)
        for k, o in enumerate(OFFSETS):
            grad[REACH + o : REACH + o + n, k * HIDDEN : (k + 1) * HIDDEN] = back
        rows, grad = _by_row(ids, grad)
        self.seen[rows] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        net.inputs[rows] -= RATE * grad / np.sqrt(self.seen[rows])[:, None]
        grad = hidden.T @ error
        self.seen_output += grad * grad
        net.output -= RATE * grad / np.sqrt(self.seen_output)
        grad = error.sum(axis=0)
        self.seen_bias += grad * grad
        net.bias -= RATE * grad / np.sqrt(self.seen_bias)


def _id_batches(words):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Words(*words.value)
        mark = xxhash.xxh64_hexdigest(b"\0".join([*vocabulary.ids, vocabulary.prior.tobytes()]))
        known = once_a_process(f"lm words {mark}", lambda: Memo(vocabulary.id_of, WORDS_KEPT))
        for batch in batches:
            tokens = ((t.as_py() or b"").lower().split() for t in batch.column(2).cast(pa.binary()))
            ids = [array("H", map(known.__getitem__, t)).tobytes() for t in tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "round", "ids"])

    return run


def encode(docs: DataFrame, words: Words, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, round, ids) for every row: the round that trains on it, and the ids of its words, 16 bits each."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(text), F.lit(rounds)).cast("int").alias("round"), text.alias("text"))
    return rows.mapInArrow(_id_batches(docs.sparkSession.sparkContext.broadcast(words.parts())), "doc_id long, round int, ids binary")


def _tokens(rows: Iterable, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, start of each text among them, number of its tokens) of some texts at a time, with `REACH` gaps around each; a very long text comes whole."""
    gap = np.full(REACH, words.gap, np.int32)
    parts, counts, size = [gap], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array(counts)
        return np.concatenate(parts), np.cumsum(sizes + REACH) - sizes, sizes

    for row in rows:
        ids = np.frombuffer(row.as_buffer(), np.uint16)
        parts += [ids, gap]
        counts.append(len(ids))
        size += len(ids)
        if size >= CHUNK:
            yield out()
            parts, counts, size = [gap], [], 0
    if counts:
        yield out()


def _slices(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most `BATCH` places that cover all but the gaps at both ends."""
    for a in range(REACH, len(ids) - REACH, BATCH):
        yield a, min(a + BATCH, len(ids) - REACH)


def _train_batches(words, flat):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(*words.value)
        net = Network.of(flat.value.copy(), known)
        trainer, n = Trainer(net, known), 0
        rows = (r for batch in batches for r in batch.column(0))
        for ids, _, sizes in _tokens(rows, known):
            n += int(sizes.sum())
            for a, b in _slices(ids):
                trainer.step(ids[a - REACH : b + REACH], ids[a:b])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([net.flat.tobytes()], pa.binary())], ["weight", "net"])

    return run


def _mean_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight, mean = 0, None
    for batch in batches:
        for w, net in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(net.as_py(), np.float32).astype(np.float64)
            weight += w
            mean = values if mean is None else mean + (values - mean) * (w / weight)
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["weight", "net"])


def _mean(nets: DataFrame) -> np.ndarray | None:
    """The average of networks, made in a tree of tasks."""
    left = nets.count()
    while left > 1:
        left = -(-left // FAN_IN)
        nets = materialize(nets.repartition(left).mapInArrow(_mean_batches, "weight long, net binary"), "lm-networks")
    row = nets.first()
    return np.frombuffer(row["net"], np.float32).copy() if row else None


def train(encoded: DataFrame, words: Words, rounds: int = ROUNDS) -> Network:
    """The average of the networks that the tasks train, after all rounds; `encoded` is a written table of `encode`."""
    context = encoded.sparkSession.sparkContext
    shared, net = context.broadcast(words.parts()), Network.start(words)
    for k in range(rounds):
        part = encoded.where(F.col("round") == k).select("ids")
        flat = _mean(materialize(part.mapInArrow(_train_batches(shared, context.broadcast(net.flat)), "weight long, net binary"), "lm-networks"))
        net = net if flat is None else Network.of(flat, words)
    return net


def _score_batches(words, flat):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(*words.value)
        net, classes, share = Network.of(flat.value, known), np.append(known.cls, 0), np.append(known.share, 0.0)
        for batch in batches:
            sums, counts = [], []
            for ids, starts, sizes in _tokens(batch.column(1), known):
                logs = np.zeros(len(ids))
                for a, b in _slices(ids):
                    target = ids[a:b]
                    hidden, z = net.forward(ids[a - REACH : b + REACH])
                    nodes, ways, of = known.steps(target)
                    clear = net.decide(hidden, nodes, ways, of)[2]
                    logs[a:b] = z[np.arange(b - a), classes[target]] - np.bincount(of, np.log1p(np.exp(-np.abs(clear))) - np.minimum(clear, 0), b - a)
                logs += share[ids]
                logs[ids == known.gap] = 0
                total = np.concatenate(([0.0], np.cumsum(logs)))
                sums += (total[starts + sizes] - total[starts]).tolist()
                counts += sizes.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "n_tokens", "log_likelihood"])

    return run


def score_encoded(encoded: DataFrame, words: Words, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token): the sum of the words' conditional log-probabilities, and its mean."""
    context = encoded.sparkSession.sparkContext
    scored = encoded.select("doc_id", "ids").mapInArrow(_score_batches(context.broadcast(words.parts()), context.broadcast(net.flat)), "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def score(docs: DataFrame, words: Words, net: Network) -> DataFrame:
    """As `score_encoded`, for any documents."""
    return score_encoded(encode(docs, words), words, net)


def _fit(docs: DataFrame) -> tuple[Words, Network, DataFrame]:
    with passing(docs.sparkSession):
        words = make_words(materialize(count_words(docs), "lm-words"))
        encoded = materialize(encode(docs, words), "lm-ids", keep=True)
        return words, train(encoded, words), encoded


def fit(docs: DataFrame) -> tuple[Words, Network]:
    return _fit(docs)[:2]


def fit_and_score(docs: DataFrame) -> DataFrame:
    """The scores of the documents that the network is trained on, whose words are looked up once for both."""
    words, net, encoded = _fit(docs)
    return score_encoded(encoded, words, net)
