"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own hashed embedding plus the mean of the hashed embeddings of its character
n-grams. A bidirectional GRU reads windows of words, attention pools each window's states into one
vector, and a logistic layer gives the window's score. Windows overlap by a third and cover the whole
text; a text's score is that of its most toxic window. The network is trained on a bounded sample of
labelled rows (SAMPLE_PER_LABEL rows of each label that docs has texts of up to SAMPLE_CHARS for), first with each
text's label for all of its windows, then for its highest-scoring window. The weights, of a fixed
size, are broadcast; each worker scores its rows where they are, without a shuffle.

Defined cases: null or empty text is one window without words and gets the score of the bias alone;
a null doc_id is kept (and never trained on); repeated rows are scored each; label rows that
contradict each other count as toxic; of rows with the same labelled doc_id the least text is learned
from; without rows of both labels every score is the smoothed share
of label 1; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import io
import re
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import table, text_of

WINDOW, STRIDE = 48, 32
WORD_BUCKETS, GRAM_BUCKETS = 1 << 14, 1 << 15
GRAMS = (3, 4, 5)
INPUT, HIDDEN = 16, 8
TOXIC_FROM = 0.7
#: Bounds of the training sample: rows of each label, and code points of a text in it.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 2500, 6000
EPOCHS, BATCH, SEED = 4, 256, 7
#: Small samples are gone through again until so many batches are done.
LEAST_STEPS, MOST_EPOCHS = 200, 40
#: Words whose inputs a worker remembers, and windows it scores at once.
MEMORY, AT_ONCE = 150_000, 4096

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of all character n-grams and the first of each word's."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(chars)) - first[owner]

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    power = np.cumprod(np.full(int(sizes.max()), 1099511628211, np.uint64))
    word = mixed(np.add.reduceat((chars + np.uint64(1)) * power[place], first)) % np.uint64(WORD_BUCKETS)
    grams, of = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.zeros(len(chars) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(1099511628211) + chars[k:len(chars) - n + 1 + k] + np.uint64(n)
        ok = owner[: len(h)] == owner[n - 1:]
        grams.append(mixed(h[ok]) % np.uint64(GRAM_BUCKETS))
        of.append(owner[: len(h)][ok])
    grams, of = np.concatenate(grams).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    grams, of = grams[order], of[order]
    return word.astype(np.int64), grams, np.searchsorted(of, np.arange(len(words)))


def starts(n: int) -> list[int]:
    """Where the windows of a text of n words begin; the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[first], np.add.reduceat(values[order], first)


class Network:
    NAMES = ("words", "grams", "wx", "wh", "bx", "bn", "att", "out", "bias")

    def __init__(self, **weights: np.ndarray):
        self.__dict__.update({k: np.asarray(v, np.float32) for k, v in weights.items()})

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        g = lambda s, *shape: r.normal(0, s, shape)
        return cls(words=g(0.1, WORD_BUCKETS, INPUT), grams=g(0.1, GRAM_BUCKETS, INPUT), wx=g(0.3, 2, INPUT, 3 * HIDDEN), wh=g(0.3, 2, HIDDEN, 3 * HIDDEN), bx=np.zeros((2, 3 * HIDDEN)), bn=np.zeros((2, HIDDEN)), att=g(0.3, 2 * HIDDEN), out=g(0.3, 2 * HIDDEN), bias=np.zeros(1) - 1)

    def dump(self) -> bytes:
        np.savez(b := io.BytesIO(), **{k: getattr(self, k) for k in self.NAMES})
        return b.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as z:
            return cls(**{k: z[k] for k in cls.NAMES})

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The input of each word, and what its gradient needs."""
        w, g, first = features(words)
        n = np.diff(np.append(first, len(g)))[:, None].astype(np.float32)
        return self.words[w] + np.add.reduceat(self.grams[g], first) / n, (w, g, n)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs to the gates of both directions: (words, 2, 3 * HIDDEN). A row of zeros input stands for padding."""
        return np.einsum("vi,dig->vdg", x, self.wx).astype(np.float32) + self.bx

    def forward(self, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ids and mask (windows, WINDOW)."""
        n, steps = ids.shape
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, 2, n, HIDDEN), np.float32)  # by the step of each direction
        tape = []
        full = mask.all()
        flat = table.reshape(-1, 3 * HIDDEN)
        for t in range(steps):
            back = steps - 1 - t
            x = flat[np.stack([ids[:, t] * 2, ids[:, back] * 2 + 1])]
            a = h @ self.wh
            zr = _sigmoid(x[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            an = a[..., 2 * HIDDEN:] + self.bn[:, None]
            c = np.tanh(x[..., 2 * HIDDEN:] + r * an)
            new = c + z * (h - c)
            if keep:
                tape.append((h, zr, an, c))
            if not full:
                new *= np.stack([mask[:, t], mask[:, back]])[..., None]
            states[t] = h = new
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)  # (steps, n, 2 * HIDDEN) by place
        s = both @ self.att + np.where(mask.T, np.float32(0), np.float32(-1e9))
        p = np.exp(s - s.max(0))
        p *= mask.T
        p /= p.sum(0) + np.float32(1e-9)
        pooled = np.einsum("tn,tnh->nh", p, both)
        return pooled @ self.out + self.bias[0], (states, tape, both, p, pooled)

    def gradients(self, table, ids, mask, labels) -> dict[str, np.ndarray]:
        """Of the mean log loss of windows; 'table' is that of the projected inputs."""
        logit, (states, tape, both, p, pooled) = self.forward(table, ids, mask, keep=True)
        n, steps = ids.shape
        d = ((_sigmoid(logit) - labels) / n).astype(np.float32)
        g = {"out": d @ pooled, "bias": d.sum(keepdims=True), "wh": np.zeros_like(self.wh), "bn": np.zeros_like(self.bn)}
        dp = d[:, None] * self.out  # (n, 2H)
        inner = np.einsum("tnh,nh->tn", both, dp)
        ds = p * (inner - (p * inner).sum(0))
        g["att"] = np.einsum("tn,tnh->h", ds, both)
        dboth = p[..., None] * dp + ds[..., None] * self.att
        dstates = np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]], axis=1)
        gates = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for t in reversed(range(steps)):
            back = steps - 1 - t
            dh = (dh + dstates[t]) * np.stack([mask[:, t], mask[:, back]])[..., None]
            h, zr, an, c = tape[t]
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * an * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], -1)
            gates[t] = np.concatenate([dz, dr, dc], -1)
            g["wh"] += np.swapaxes(h, 1, 2) @ da
            g["bn"] += (dc * r).sum(1)
            dh = dh * z + da @ np.swapaxes(self.wh, 1, 2)
        at = np.stack([ids.T * 2, ids.T[::-1] * 2 + 1], axis=1)  # (steps, 2, n), as gates
        rows, sums = _summed(at.reshape(-1), gates.reshape(-1, 3 * HIDDEN))
        g["table"] = np.zeros_like(table)
        g["table"].reshape(-1, 3 * HIDDEN)[rows] = sums
        return g


def _windows(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; ids (0 is padding, else 1 + word), mask and text of each window."""
    index: dict[str, int] = {}
    coded = [np.fromiter((index.setdefault(w, len(index)) for w in t), np.int64, len(t)) + 1 for t in texts]
    return list(index), *_cut(coded)


def _cut(coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = [(k, s) for k, c in enumerate(coded) for s in starts(len(c))]
    ids = np.zeros((len(at), WINDOW), np.int64)
    for row, (k, s) in enumerate(at):
        part = coded[k][s:s + WINDOW]
        ids[row, : len(part)] = part
    return ids, ids > 0, np.array([k for k, _ in at], np.int64)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    words, ids, mask, owner = _windows([words_of(t) for t in texts])
    y = np.asarray(labels, np.float32)[owner]
    if not words:
        return net
    first = np.searchsorted(owner, np.arange(len(texts)))
    w, g, begin = features(words)
    count = np.diff(np.append(begin, len(g)))
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in ("wx", "wh", "bx", "bn", "att", "out", "bias")}
    squares = {k: np.full(len(getattr(net, k)), 1e-4, np.float32) for k in ("words", "grams")}
    step = 0

    def adam(name: str, grad: np.ndarray, rate: float) -> None:
        m, v = moments[name]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        getattr(net, name)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def adagrad(name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        own, total = _summed(rows, grad)
        squares[name][own] += (total * total).mean(1)
        getattr(net, name)[own] -= rate * total / np.sqrt(squares[name][own])[:, None]

    batch = min(BATCH, max(32, len(owner) // 20))
    for epoch in range(MOST_EPOCHS):
        if epoch >= epochs and step >= LEAST_STEPS:
            break
        if epoch == 0:
            chosen = np.arange(len(owner))
        else:  # each text's highest window, and one more of texts with label 0
            score = np.concatenate([net.forward(*_local(net, words, ids[k:k + AT_ONCE]), mask[k:k + AT_ONCE])[0] for k in range(0, len(ids), AT_ONCE)])
            best = np.lexsort((score, owner))[np.append(first[1:], len(owner)) - 1]
            last = np.append(first[1:], len(owner))
            other = first + (r.random(len(first)) * (last - first)).astype(np.int64)
            chosen = np.concatenate([best, other[np.asarray(labels) == 0]])
        r.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            step += 1
            rows = chosen[k:k + batch]
            here, small = np.unique(ids[rows], return_inverse=True)
            small = small.reshape(len(rows), WINDOW)
            real = here[here > 0] - 1
            spans = [g[begin[i]:begin[i] + count[i]] for i in real]
            flat, n = np.concatenate(spans) if spans else np.empty(0, np.int64), count[real]
            x = np.zeros((len(here), INPUT), np.float32)
            if len(real):
                x[len(here) - len(real):] = net.words[w[real]] + np.add.reduceat(net.grams[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
            grads = net.gradients(net.project(x), small, mask[rows], y[rows])
            dt = grads.pop("table")
            grads["wx"], grads["bx"] = np.einsum("vi,vdg->dig", x, dt), dt.sum(0)
            dx = np.einsum("vdg,dig->vi", dt, net.wx)[len(here) - len(real):]
            for name, grad in grads.items():
                adam(name, grad, 0.01)
            if len(real):
                adagrad("words", w[real], dx, 0.1)
                adagrad("grams", flat, np.repeat(dx / n[:, None], n, axis=0), 0.1)
    return net


def _local(net: Network, words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The projected inputs of the words in ids, and ids in that table."""
    here, small = np.unique(ids, return_inverse=True)
    x = np.zeros((len(here), INPUT), np.float32)
    real = [words[i - 1] for i in here if i]
    if real:
        x[len(here) - len(real):] = net.inputs(real)[0]
    return net.project(x), small.reshape(ids.shape)


class Scorer:
    """Scores texts; remembers the inputs of words."""

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = self.net.project(np.zeros((1, INPUT), np.float32))

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > MEMORY:
            self.forget()
        index = self.index
        known = len(index)
        out = []
        for t in texts:
            try:
                got = np.fromiter(map(index.__getitem__, t), np.int64, len(t))
            except KeyError:
                for w in t:
                    if w not in index:
                        index[w] = len(index) + 1
                got = np.fromiter(map(index.__getitem__, t), np.int64, len(t))
            out.append(got)
        if len(index) > known:
            fresh = list(index)[known:]
            if len(self.table) < len(index) + 1:
                grown = np.empty((2 * len(index) + 1, 2, 3 * HIDDEN), np.float32)
                grown[: known + 1] = self.table[: known + 1]
                self.table = grown
            for k in range(0, len(fresh), 20_000):
                part = fresh[k:k + 20_000]
                self.table[known + 1 + k:known + 1 + k + len(part)] = self.net.project(self.net.inputs(part)[0])
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        coded = self.ids([words_of(t) for t in texts])
        best = np.full(len(texts), -np.inf, np.float64)
        pending, n = [], 0
        for k, c in enumerate(coded):
            pending.append(k)
            n += len(c) // STRIDE + 1
            if n >= AT_ONCE or k == len(coded) - 1:
                ids, mask, owner = _cut([coded[i] for i in pending])
                for j in range(0, len(ids), AT_ONCE):
                    part = slice(j, j + AT_ONCE)
                    np.maximum.at(best, np.array(pending)[owner[part]], self.net.forward(self.table, ids[part], mask[part])[0])
                pending, n = [], 0
        return 1 / (1 + np.exp(-best))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_chars: int = SAMPLE_CHARS) -> DataFrame:
    """text and toxic of at most per_label labelled rows of docs for each label, chosen by a hash, one for each doc_id; held-out rows (crc32 of the id mod 3 is 1) never."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    short = docs.select("doc_id", text_of().alias("text")).where(F.length("text") <= max_chars)
    known = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    ids = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "doc_id long, toxic int")  # at most 2 * per_label rows
    found = short.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, max_chars: int = SAMPLE_CHARS) -> bytes | float:
    """The weights, trained by one task on the bounded sample; a constant score if a label is missing."""

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True))
        ys = [y for _, y in rows]
        done = train([t for t, _ in rows], ys).dump() if len(set(ys)) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary()), pa.array([(sum(ys) + 1) / (len(ys) + 2)])], ["weights", "share"])

    sample = training_sample(docs, labels, per_label, max_chars).repartition(1)
    got = sample.mapInArrow(learn, "weights binary, share double").collect()
    return (bytes(got[0].weights) if got[0].weights is not None else got[0].share) if got else 0.5


def score(docs: DataFrame, model: bytes | float) -> DataFrame:
    """doc_id and score of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if isinstance(model, float):
        return rows.select("doc_id", F.lit(model).alias("score"))
    scored = _scoring(docs.sparkSession, model, keep_rows=False)
    return rows.mapInArrow(scored, "doc_id long, score double")


def _scoring(spark: SparkSession, model: bytes, keep_rows: bool):
    shared = spark.sparkContext.broadcast(model)  # of fixed size, some 3 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network.load(shared.value))
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                s = pa.array(scorer.score([t or "" for t in part.column("text").to_pylist()]))
                yield part.filter(pa.compute.less(s, TOXIC_FROM)) if keep_rows else pa.RecordBatch.from_arrays([part.column("doc_id"), s], ["doc_id", "score"])

    return run


def reject(docs: DataFrame, model: bytes | float) -> DataFrame:
    """docs without the rows whose score is TOXIC_FROM or more; a constant model rejects none, with a warning."""
    if isinstance(model, float):
        warnings.warn("no labelled rows of both kinds to learn from: nothing is rejected", stacklevel=2)
        return docs
    return docs.mapInArrow(_scoring(docs.sparkSession, model, keep_rows=True), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
