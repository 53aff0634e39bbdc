"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (zero for words outside the vocabulary) beside the mean of the embeddings of its hashed
character n-grams. Two gated recurrent units read a window of words from both ends, attention pools their states, and the
pooled state gives the window's logit. Windows overlap and cover every word; a document scores as its highest window.
Labels are of documents, so training follows each document's windows at first all alike, then only the highest one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm.common import Numbers, held, named, ship, slices, texts_of, utf8

#: Words in a window, and from one window's start to the next; embedding sizes; states of each direction; attention's size.
WINDOW, STRIDE = 48, 24
WORD_DIMS, CHAR_DIMS, STATES, ATTENTION = 12, 20, 12, 12
NGRAMS, BUCKETS, VOCABULARY = (3, 4, 5), 1 << 14, 8_000
#: Labelled documents that training reads at most (those whose ids hash lowest), and the longest of them in characters.
SAMPLE, LONGEST = 2_500, 20_000
STEPS, WARM, BATCH, RATE = 200, 80, 32, 0.015
FOLDS = 5
#: Documents that score as much are toxic.
TOXIC = 0.5
STRIP = ".,;:!?\"'()[]{}|#*$%&<>-_/\\"
CACHED = 150_000
#: Windows that run through the network at once.
TOGETHER = 1_024


def split(text: str) -> list[str]:
    return text.lower().split()


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the bytes of each word between marks, and where each word's begin; every word has some."""
    raw = [b"\x02" + w.strip(STRIP).encode("utf-8", "replace") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw) + b"\0" * max(NGRAMS), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(raw)), lengths)
    place = np.arange(lengths.sum())
    ends = (starts + lengths)[word]
    hashes, of = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            h = np.full(len(place), n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ data[i : i + len(place)]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            ok = (place + n <= ends) | ((place == starts[word]) & (n == min(NGRAMS)))
            hashes.append(h[ok] % np.uint64(BUCKETS))
            of.append(word[ok])
    of, hashes = np.concatenate(of), np.concatenate(hashes).astype(np.int64)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(raw))
    return hashes[order], np.cumsum(counts) - counts


def windows(n: int) -> list[int]:
    """Where windows over n words start; the last one covers the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def summed(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sums of the rows of values by their places 0 to n - 1."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters: p[name]; the vocabulary: word -> row."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, d = STATES, WORD_DIMS + CHAR_DIMS
        normal = lambda *shape: (rng.standard_normal(shape) * (0.5 if len(shape) < 2 else 1 / shape[0] ** 0.5)).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"words": normal(len(vocabulary) + 1, WORD_DIMS) * 0, "grams": (rng.standard_normal((BUCKETS, CHAR_DIMS)) * 0.3).astype(np.float32)}
        for s in "fb":
            self.p |= {f"w{s}": normal(d, 3 * h), f"u{s}": normal(h, 3 * h), f"c{s}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": normal(2 * h, ATTENTION), "v": normal(ATTENTION), "o": normal(2 * h), "bias": np.full(1, -2, np.float32)}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        at, (grams, starts) = np.array([self.vocabulary.get(w.strip(STRIP), len(self.vocabulary)) for w in words]), ngrams(words)
        counts = np.diff(np.append(starts, len(grams)))
        known = (at < len(self.vocabulary))[:, None]
        x = np.concatenate([self.p["words"][at] * known, np.add.reduceat(self.p["grams"][grams], starts, axis=0) / counts[:, None]], axis=1)
        return x.astype(np.float32), (at, grams, counts, known)

    def run(self, xf: np.ndarray, xb: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. xf, xb: inputs times wf, wb by row; rows: [windows, words], -1 where a window has no word."""
        n, t = rows.shape
        h, mask = STATES, (rows >= 0).astype(np.float32)
        out, saved = np.zeros((t, n, 2 * h), np.float32), {}
        for side, (s, x) in enumerate((("f", xf), ("b", xb))):
            state, u, c = np.zeros((n, h), np.float32), self.p[f"u{s}"], self.p[f"c{s}"]
            steps = range(t) if s == "f" else range(t - 1, -1, -1)
            for i in steps:
                g, r, m = x[rows[:, i]] + c, state @ u, mask[:, i : i + 1]
                zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, reset = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + reset * r[:, 2 * h :])
                after = state + m * (1 - z) * (new - state)
                if keep:
                    saved[s, i] = (state, z, reset, new, r[:, 2 * h :])
                state = after
                out[i, :, side * h : (side + 1) * h] = state
        tall = np.tanh(out.reshape(t * n, 2 * h) @ self.p["a"])
        e = (tall @ self.p["v"]).reshape(t, n) + (mask.T - 1) * 1e9
        w = np.exp(e - e.max(0))
        w *= mask.T
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, out)
        return pooled @ self.p["o"] + self.p["bias"][0], {"out": out, "tall": tall, "w": w, "pooled": pooled, "mask": mask, "saved": saved}

    def logits(self, xf: np.ndarray, xb: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """What `run` gives, from inputs that hold the biases, with fewer passes: a sigmoid is a hyperbolic tangent of half its input."""
        n, t = rows.shape
        h, mask = STATES, (rows >= 0).astype(np.float32)
        full = mask.all(0)
        columns = np.ascontiguousarray(np.maximum(rows, 0).T)
        out, g, r = np.empty((t, n, 2 * h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
        for side, (s, x) in enumerate((("f", xf), ("b", xb))):
            state, u = np.zeros((n, h), np.float32), self.p[f"u{s}"]
            for i in range(t) if s == "f" else range(t - 1, -1, -1):
                np.take(x, columns[i], axis=0, out=g, mode="clip")
                np.matmul(state, u, out=r)
                zr, new = g[:, : 2 * h], g[:, 2 * h :]
                zr += r[:, : 2 * h]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr *= 0.5
                reset = zr[:, h:]
                reset += 0.5
                reset *= r[:, 2 * h :]
                new += reset
                np.tanh(new, out=new)
                new -= state
                move = np.subtract(0.5, zr[:, :h], out=zr[:, :h])
                move *= new
                if not full[i]:
                    move *= mask[:, i : i + 1]
                state += move
                out[i, :, side * h : (side + 1) * h] = state
        tall = out.reshape(t * n, 2 * h) @ self.p["a"]
        np.tanh(tall, out=tall)
        e = (tall @ self.p["v"]).reshape(t, n) + (mask.T - 1) * 1e9
        w = np.exp(e - e.max(0)) * mask.T
        w /= np.maximum(w.sum(0), 1e-9)
        return (w * (out @ self.p["o"])).sum(0) + self.p["bias"][0]

    def gradient(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the weighted mean cross-entropy by parameter, the one by x, and the loss."""
        h, p = STATES, self.p
        logit, k = self.run(x @ p["wf"], x @ p["wb"], rows, keep=True)
        score = sigmoid(logit)
        loss = float(-(weight * (y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9))).sum())
        d = (weight * (score - y)).astype(np.float32)
        n, t = rows.shape
        g = {"o": k["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
        dpooled = d[:, None] * p["o"]
        dout = k["w"][:, :, None] * dpooled
        dw = np.einsum("nh,tnh->tn", dpooled, k["out"])
        de = k["w"] * (dw - (k["w"] * dw).sum(0))
        dtall = de.reshape(-1, 1) * p["v"] * (1 - k["tall"] ** 2)
        g["v"] = k["tall"].T @ de.ravel()
        g["a"] = k["out"].reshape(t * n, 2 * h).T @ dtall
        dout += (dtall @ p["a"].T).reshape(t, n, 2 * h)
        dx = np.zeros_like(x)
        for side, s in enumerate("fb"):
            du, every = np.zeros_like(p[f"u{s}"]), np.zeros((t, n, 3 * h), np.float32)
            dstate = np.zeros((n, h), np.float32)
            for i in range(t - 1, -1, -1) if s == "f" else range(t):
                state, z, reset, new, rn = k["saved"][s, i]
                m = k["mask"][:, i : i + 1]
                dafter = dstate + dout[i, :, side * h : (side + 1) * h]
                dz = dafter * m * (state - new) * z * (1 - z)
                dnew = dafter * m * (1 - z) * (1 - new**2)
                dreset = dnew * rn * reset * (1 - reset)
                dr = np.concatenate([dz, dreset, dnew * reset], axis=1)
                dg = np.concatenate([dz, dreset, dnew], axis=1)
                du += state.T @ dr
                every[i] = dg
                dstate = dafter * (1 - m * (1 - z)) + dr @ p[f"u{s}"].T
            dg_x = summed(len(x), np.maximum(rows.T, 0).ravel(), every.reshape(t * n, 3 * h))
            g |= {f"u{s}": du, f"c{s}": every.sum((0, 1)), f"w{s}": x.T @ dg_x}
            dx += dg_x @ p[f"w{s}"].T
        return g, dx, loss


def train(texts: list[str], labels: list[int]) -> Network:
    """A network for the labels; without both labels its scores only say which one there is."""
    documents = [split(t) for t in texts]
    y = np.array(labels, dtype=np.float32)
    counts: dict[str, int] = {}
    for d in documents:
        for w in {x.strip(STRIP) for x in d}:
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, c in counts.items() if c > 4), key=lambda w: (-counts[w], w))[:VOCABULARY]
    net = Network({w: i for i, w in enumerate(common)})
    rng = np.random.default_rng(11)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    sides = [np.flatnonzero(y == 1), np.flatnonzero(y == 0)]
    if not len(sides[0]) or not len(sides[1]):
        net.p["o"][:] = 0
        net.p["bias"][:] = 3 if len(sides[0]) else -3
        return net
    prior = np.log(len(sides[0]) / len(sides[1]))
    for step in range(1, STEPS + 1):
        some = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        words = list(dict.fromkeys(chain.from_iterable(documents[i] for i in some))) or [""]
        at = {w: i for i, w in enumerate(words)}
        rows, of = [], []
        for k, i in enumerate(some):
            d = [at[w] for w in documents[i]]
            for s in windows(len(d)):
                part = d[s : s + WINDOW]
                rows.append(part + [-1] * (WINDOW - len(part)))
                of.append(k)
        rows, of = np.array(rows), np.array(of)
        if step <= WARM:
            pick = rng.choice(len(rows), min(len(rows), 4 * BATCH), replace=False)
            weight = np.full(len(pick), 1 / len(pick))
        else:
            x, _ = net.inputs(words)
            logit, _ = net.run(x @ net.p["wf"], x @ net.p["wb"], rows)
            order = np.lexsort((-logit, of))
            pick = order[np.searchsorted(of[order], np.arange(len(some)))]
            weight = np.full(len(pick), 1 / len(pick))
        used, rows = np.unique(np.append(rows[pick], -1), return_inverse=True)
        rows = rows[:-1].reshape(len(pick), WINDOW) - 1
        x, (row, grams, sizes, known) = net.inputs([words[i] for i in used[1:]] or [""])
        g, dx, _ = net.gradient(x, rows, y[some][of[pick]], weight.astype(np.float32))
        g["words"] = summed(len(net.p["words"]), row, dx[:, :WORD_DIMS] * known)
        g["grams"] = summed(BUCKETS, grams, np.repeat(dx[:, WORD_DIMS:] / sizes[:, None], sizes, axis=0))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, v in g.items():
            m, s = moments[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    # batches held both labels alike; the bias goes half of the way back to how often they occur
    net.p["bias"] += np.float32(prior / 2)
    return net


class Scorer:
    """Scores texts; what each word sends into both directions is kept."""

    def __init__(self, net: Network):
        self.net = net
        self._empty()

    def _empty(self) -> None:
        self.rows = Numbers()
        self.f, self.b = (np.empty((CACHED + CACHED // 2, 3 * STATES), np.float32) for _ in "fb")

    def _learn(self, words: list[str], numbers: np.ndarray) -> None:
        """The rows of words that are new; the arrays grow by halves."""
        if not len(words):
            return
        if (n := int(numbers[-1]) + 1) > len(self.f):
            more = np.zeros((n + n // 2 - len(self.f), 3 * STATES), np.float32)
            self.f = np.concatenate([self.f, more])
            self.b = np.concatenate([self.b, more])
        p = self.net.p
        for i in range(0, len(words), 5_000):
            x, _ = self.net.inputs(words[i : i + 5_000])
            at = slice(numbers[i], numbers[i] + len(x))
            self.f[at], self.b[at] = x @ p["wf"] + p["cf"], x @ p["wb"] + p["cb"]

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > CACHED:
            self._empty()
        parts = [split(t) for t in texts]
        n = np.array([len(p) for p in parts])
        flat = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=n.sum())
        self._learn(*self.rows.fresh())
        flat = np.concatenate([flat, np.full(WINDOW, -1)])
        first = np.cumsum(n) - n
        starts = [windows(k) for k in n.tolist()]
        of = np.repeat(np.arange(len(parts)), [len(s) for s in starts])
        start = np.fromiter(chain.from_iterable(starts), dtype=np.int64, count=len(of))
        place = np.arange(WINDOW)
        out = np.zeros(len(of), np.float32)
        for i in range(0, len(of), TOGETHER):
            o, s = of[i : i + TOGETHER], start[i : i + TOGETHER]
            at = np.minimum((first[o] + s)[:, None] + place, len(flat) - 1)
            rows = np.where(s[:, None] + place < n[o][:, None], flat[at], -1)
            out[i : i + TOGETHER] = self.net.logits(self.f, self.b, rows) if self.rows.next else self.net.p["bias"][0]
        best = np.maximum.reduceat(out, np.cumsum([0, *(len(s) for s in starts[:-1])])) if len(parts) else out
        return sigmoid(best.astype(np.float64))


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on at most SAMPLE labelled documents outside the held-out fold; a bounded sample goes to the driver."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= LONGEST)
    rows = texts.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def scorer(name: str, sent) -> Scorer:
    """The worker's scorer for a broadcast network."""
    return held(("toxicity", name), lambda: Scorer(sent.value))


def score(docs: DataFrame, net: Network, name: str = "toxicity") -> DataFrame:
    """The columns of docs but for any of this name, and that one: from 0 to 1, higher for likelier toxic.

    Null and empty texts get the score of a window without words. A text of any length is scored whole. Repeated rows, null ids
    and other columns stay as they are.
    """
    spark = docs.sparkSession
    ship(spark)
    sent, key = spark.sparkContext.broadcast(net), uuid.uuid4().hex

    kept = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(key, sent)
        for whole in batches:
            for b in slices(whole, whole.num_columns - 1):
                s = own.scores(texts_of(b, b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s)], [*names, name])

    # inside, columns go by number, as mapInArrow takes no names with dots
    inner = docs.select(*(named(f.name).alias(f"c{i}") for i, f in enumerate(kept)), utf8(F.col("text")).alias("text"))
    return inner.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))
