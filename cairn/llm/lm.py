"""Language-model scoring of whole documents with a gated recurrent network in numpy.

The network reads a document's words one by one (its first input is the end token) and gives
each next token a probability: a softmax over word classes times a softmax over the words of the
class. It is trained by truncated backpropagation: windows of a few words, the state carried
from window to window. Scoring carries the state through the whole document.

All training documents are read. A hash deals them into shards of about SHARD tokens; each task
trains on its shard's next run of tokens from the common weights, and the weights are averaged
(by tokens) after each of ROUNDS rounds, which together read every shard to its end.

Its vocabulary is the most frequent words; all others share one token and divide that token's
probability in the proportions of their smoothed counts, so a text has a proper probability.
Counts cover the whole training corpus: they are a table in Spark. The most frequent are
broadcast (a fixed number); the others are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, slices, text_bytes, word_hashes, word_spans

#: Words of the network, of which the first two stand for the end and for all other words.
CLASSES, PER_CLASS = 64, 64
VOCABULARY = CLASSES * PER_CLASS
END, OTHER = 0, 1
#: Counts that are broadcast, two numbers each.
FREQUENT = 1 << 17
#: Leading bits of a fingerprint, by which broadcast words are looked up.
LEADING = 20
HIDDEN = 16
#: Tokens of a shard, about (two bytes each); rounds after which the weights are averaged.
SHARD, ROUNDS = 1 << 22, 4
#: Streams side by side, words of a window, learning rate, updates over which a round's rate rises.
LANES, WINDOW, RATE, RISE = 256, 24, 0.015, 20
#: Updates that training makes at least, in fewer lanes where words are few, and words that it reads at least: a smaller corpus is read several times.
UPDATES, LEAST = 700, 1 << 20
#: Weights of a row when they are averaged.
PART = 4096
#: In scoring, documents side by side and how many of their words, at least, are judged at once.
STRIDE, TOGETHER = 24, 4096
#: Bytes of a block that, once freed, has the C library keep up to twice as many for the next arrays.
KEPT = 31 << 20
#: Rows of a softmax at a time, logits whose exponentials (and sums of them) fit single precision.
BLOCK, REACH = 1024, 40
END_KEY = 0


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of all words, A-Z lower-cased; first word of each text and the end)."""
    raw, offsets = text_bytes(text)
    starts, ends, first = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends, lower=True).view(np.int64), first


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs: fingerprints with their counts, the end under END_KEY."""

    def count(batches):
        words, counts, texts = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            col = batch.column("text")
            texts += len(col)
            for a, b in slices(col):
                w, n = np.unique(_words(col.slice(a, b - a))[0], return_counts=True)
                words, at = np.unique(np.concatenate([words, w]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(words)).astype(np.int64)
                if len(words) > 1 << 20:  # a task remembers a million words
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "c"])
                    words, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words, END_KEY)), pa.array(np.append(counts, texts))], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- network


def _keep_memory() -> None:
    """Lets a task's arrays reuse freed memory; to ask the system for it each time costs a page fault for every 4 KB."""
    np.empty(KEPT, np.uint8)


def _thirds(w: np.ndarray) -> np.ndarray:
    """The columns of update gate, reset gate and candidate as three matrices, so that each one's values lie together."""
    return np.ascontiguousarray(w.reshape(-1, 3, HIDDEN).swapaxes(0, 1))


def _sigmoid(x):
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(u, gates, h):
    """One step of the gated unit, by thirds: (new state, what the backward pass needs)."""
    inner = np.matmul(h, u)
    z, r = _sigmoid(gates[:2] + inner[:2])
    m = r * inner[2]
    m += gates[2]
    np.tanh(m, out=m)
    out = h - m
    out *= z
    out += m
    return out, (z, r, m, inner[2])


def _within_reach(x):
    """x, in place: its rows less their largest values, if an exponential might leave single precision otherwise."""
    if x.size and not -REACH < x.min() <= x.max() < REACH:
        x -= x.max(1, keepdims=True)
    return x


def _one_beside(x):
    """x with a column of ones, which a bias below the weights is multiplied by."""
    out = np.ones((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x
    return out


def _heads(p):
    """Weights of the classes and of each class's words, biases below them."""
    return np.concatenate([p["c"], p["cb"][None]]), np.concatenate([p["w"], p["wb"][:, None]], axis=1)


def _chosen(h, w, stops, goal) -> np.ndarray:
    """Log softmax at the goals, a block of rows at a time: rows stops[k] to stops[k + 1] are multiplied by w[k]."""
    out, width = np.empty(len(goal), h.dtype), w.shape[-1]
    room, ones, starts = np.empty((BLOCK, width), h.dtype), np.ones(width, h.dtype), np.arange(BLOCK) * width
    for a in range(0, len(goal), BLOCK):
        b = min(a + BLOCK, len(goal))
        for k in range(np.searchsorted(stops, a, "right") - 1, np.searchsorted(stops, b)):
            i, j = max(a, stops[k]), min(b, stops[k + 1])
            np.matmul(h[i:j], w[k], out=room[i - a : j - a])
        x = _within_reach(room[: b - a])
        found = room.reshape(-1)[goal[a:b] + starts[: b - a]]
        np.exp(x, out=x)
        out[a:b] = found - np.log(x @ ones)
    return out


def _toward(x, goal):
    """Summed loss of softmax(x) at the goals and the gradient of the mean loss, in place of x."""
    _within_reach(x)
    at = goal + np.arange(len(x)) * x.shape[1]
    flat = x.reshape(-1)
    chosen = flat[at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x *= (1 / (total * len(goal)))[:, None]
    flat[at] -= 1 / len(goal)
    return (np.log(total) - chosen).sum(), x


def _class_runs(target):
    kind = (target // PER_CLASS).astype(np.uint8)  # sorted in linear time
    order = np.argsort(kind, kind="stable")
    return order, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(kind, minlength=CLASSES))])


def log_likelihood(p, h, target) -> np.ndarray:
    """Natural log probability of each target after its state: class, then word in the class."""
    (c, w), h = _heads(p), _one_beside(h)
    out = _chosen(h, c[None], [0, len(h)], target // PER_CLASS)
    order, stops = _class_runs(target)
    out[order] += _chosen(h.take(order, axis=0), w, stops.tolist(), (target % PER_CLASS)[order])
    return out


def initial(frequency: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights, biases at the words' log frequencies."""
    rng = np.random.default_rng(seed)
    f = (frequency + 0.5).reshape(CLASSES, PER_CLASS)
    f = f / f.sum()
    draw = lambda *shape: (rng.normal(0, 0.1, shape)).astype(np.float32)
    return {
        "e": draw(VOCABULARY, HIDDEN), "x": draw(HIDDEN, 3 * HIDDEN), "xb": np.zeros(3 * HIDDEN, np.float32), "u": draw(HIDDEN, 3 * HIDDEN),
        "c": draw(HIDDEN, CLASSES), "cb": np.log(f.sum(1)).astype(np.float32),
        "w": draw(CLASSES, HIDDEN, PER_CLASS), "wb": np.log(f / f.sum(1, keepdims=True)).astype(np.float32),
    }


def gradients(p, ids: np.ndarray, target: np.ndarray, h: np.ndarray):
    """Mean loss, its gradients over one window (time, lane) and the state to carry on."""
    steps, lanes = ids.shape
    x, u, places = _thirds(p["x"]), _thirds(p["u"]), ids.ravel()
    emb = p["e"].take(places, axis=0)
    gates = np.matmul(emb, x)
    gates += _thirds(p["xb"])
    states, kept = np.empty((steps + 1, lanes, HIDDEN), h.dtype), []
    states[0] = h
    for t in range(steps):
        states[t + 1], keep = _step(u, gates[:, t * lanes : (t + 1) * lanes], states[t])
        kept.append(keep)
    flat, goal, (c, w) = _one_beside(states[1:].reshape(-1, HIDDEN)), target.ravel(), _heads(p)
    n, g = len(goal), {}
    loss, d = _toward(flat @ c, goal // PER_CLASS)
    both = flat.T @ d
    g["c"], g["cb"] = both[:-1], both[-1]
    dh = d @ p["c"].T
    order, stops = _class_runs(goal)
    near, back, both = flat.take(order, axis=0), np.empty_like(dh), np.zeros_like(w)
    runs = [(k, slice(stops[k], stops[k + 1])) for k in np.flatnonzero(np.diff(stops))]
    for k, run in runs:
        np.matmul(near[run], w[k], out=d[run])
    more, d = _toward(d, goal[order] % PER_CLASS)
    for k, run in runs:
        np.matmul(near[run].T, d[run], out=both[k])
        np.matmul(d[run], p["w"][k].T, out=back[run])
    g["w"], g["wb"] = both[:, :-1], both[:, -1]
    dh[order] += back
    # By step: gradients at the update gate, the reset gate, the candidate and the candidate's share of the state.
    inward = np.empty((4, n, HIDDEN), h.dtype)
    back, ut = np.zeros_like(h), np.ascontiguousarray(u.swapaxes(1, 2))
    for t in range(steps - 1, -1, -1):
        (z, r, m, um), rows = kept[t], slice(t * lanes, (t + 1) * lanes)
        dz, dr, dm, du = inward[:, rows]
        down = dh[rows] + back
        np.multiply(down, 1 - z, out=dm)
        dm *= 1 - m * m
        np.multiply(dm, r, out=du)
        np.multiply(du, um, out=dr)
        dr *= 1 - r
        down *= z
        np.subtract(states[t], m, out=dz)
        dz *= down
        dz *= 1 - z
        back = down
        for share, third in zip((dz, dr, du), ut):
            back += share @ third
    past = states[:-1].reshape(-1, HIDDEN)
    g["u"] = np.concatenate([past.T @ inward[k] for k in (0, 1, 3)], axis=1)
    g["x"] = np.concatenate([emb.T @ inward[k] for k in range(3)], axis=1)
    g["xb"] = (np.ones(n, h.dtype) @ inward[:3]).ravel()
    demb = np.matmul(inward[:3], x.swapaxes(1, 2)).sum(0)
    order = np.argsort(places.astype(np.uint16), kind="stable")  # in linear time
    ranked = places[order]
    begin = np.flatnonzero(np.diff(ranked, prepend=-1))
    g["e"] = np.zeros_like(p["e"])
    g["e"][ranked[begin]] = np.add.reduceat(demb.take(order, axis=0), begin)
    return (loss + more) / n, g, states[-1]


def lanes_of(count: int) -> tuple[int, int]:
    """(lanes, words of each) that hold `count` words; the last lane is filled up with the first words."""
    lanes = max(1, min(LANES, count // (WINDOW * UPDATES // ROUNDS)))
    return lanes, -(-count // lanes)


def windows(stream: np.ndarray, start: int, stop: int):
    """(inputs, targets) by time and lane, window after window: the targets start to stop of a stream that begins with END and is repeated without end."""
    n = len(stream) - 1
    lanes, length = lanes_of(stop - start)
    begin = np.arange(lanes) * length
    for t in range(0, length, WINDOW):
        at = (start + (begin + np.arange(t, min(t + WINDOW, length))[:, None]) % (stop - start)) % n
        yield stream[at].astype(np.int64), stream[at + 1].astype(np.int64)


def fit(p: dict[str, np.ndarray], stream: np.ndarray, start: int, stop: int, done: float = 0.0, share: float = 1.0) -> dict[str, np.ndarray]:
    """Weights after all windows of the stream's run, by Adam from p; done and share: of the whole training, before and in this call."""
    flat = _flat(p)
    p, first, second = _shaped(flat, p), np.zeros_like(flat), np.zeros_like(flat)  # p: views of flat
    lanes, length = lanes_of(stop - start)
    h = np.zeros((lanes, HIDDEN), np.float32)
    updates = -(-length // WINDOW)
    for update, (ids, goal) in enumerate(windows(stream, start, stop), 1):
        _, g, h = gradients(p, ids, goal, h)
        v = _flat(g)
        rate = RATE * min(1.0, 2 * (1 - done - share * update / (updates + 1))) * min(1.0, update / RISE)
        v *= np.float32(min(1.0, 1.0 / (np.sqrt(float(np.vdot(v, v))) + 1e-9)))
        step, root = np.float32(rate / (1 - 0.9**update)), np.float32(1 / np.sqrt(1 - 0.99**update))
        first += np.float32(0.1) * (v - first)
        v *= v
        second += np.float32(0.01) * (v - second)
        np.sqrt(second, out=v)
        v *= root
        v += np.float32(1e-8)
        np.divide(first, v, out=v)
        v *= step
        flat -= v
    return p


def document_log_likelihoods(p, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log probability of each document; ids holds all their tokens, ends where each one's stop.

    Documents run side by side, longest first, so that those still running are the first ones.
    """
    u, table = _thirds(p["u"]), np.matmul(p["e"], _thirds(p["x"])) + _thirds(p["xb"])
    begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    out = np.zeros(len(ends))
    order = np.argsort(-(ends - begins), kind="stable")
    for a in range(0, len(order), TOGETHER):
        rows = order[a : a + TOGETHER]
        length, begin = (ends - begins)[rows], begins[rows]
        last, sums = np.full(len(rows), END), np.zeros(len(rows))
        h = np.zeros((len(rows), HIDDEN), np.float32)
        states, goals, held, shorter = [], [], 0, -length
        for t in range(int(length[0])):
            live = int(np.searchsorted(shorter, -t))  # documents longer than t
            h, _ = _step(u, table.take(last[:live], axis=1), h[:live])
            last = ids[begin[:live] + t]
            states.append(h)
            goals.append(last)
            held += live
            if held < STRIDE * TOGETHER and t + 1 < length[0]:
                continue
            found, at = log_likelihood(p, np.concatenate(states), np.concatenate(goals)), 0
            for goal in goals:
                sums[: len(goal)] += found[at : at + len(goal)]
                at += len(goal)
            states, goals, held = [], [], 0
        out[rows] = sums
    return out


# ---------------------------------------------------------------- Spark


class Model:
    """The broadcast state: frequent words with counts and token ids, totals and the network's weights."""

    def __init__(self, words, counts, tokens, total, distinct, end):
        self.words, self.counts, self.tokens = words, counts, tokens  # sorted by fingerprint
        self.total, self.distinct, self.end, self.weights = total, distinct, end, None
        self.starts = None  # made by each worker
        inside = tokens > OTHER
        self.rest = total - int(counts[inside].sum()) - self.end + distinct - int(inside.sum()) - (self.end > 0) + 1

    def find(self, keys):
        """(place among the frequent words, whether it is one)."""
        if not len(self.words):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if self.starts is None:
            edges = np.arange(-(1 << LEADING - 1), 1 << LEADING - 1) << 64 - LEADING
            self.starts = np.append(np.searchsorted(self.words, edges), len(self.words)).astype(np.int32)
        leading = (keys >> 64 - LEADING) + (1 << LEADING - 1)
        at, stop = np.minimum(self.starts[leading], len(self.words) - 1), self.starts[leading + 1]
        known = self.words[at] == keys
        left = np.flatnonzero(~known & (at + 1 < stop))
        while len(left):  # the next words with the same leading bits
            at[left] += 1
            known[left] = self.words[at[left]] == keys[left]
            left = left[~known[left] & (at[left] + 1 < stop[left])]
        return at, known

    def ids(self, at, known):
        """Token ids of what find gives."""
        return np.where(known, self.tokens[at] if len(self.words) else OTHER, OTHER)


def _with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values with `end` behind each text's, and where each text's stop."""
    return np.insert(values, first[1:], end), first[1:] + np.arange(1, len(first))


def _frequency(model: Model) -> np.ndarray:
    """How often each token of the network occurs."""
    out = np.zeros(VOCABULARY)
    inside = model.tokens != OTHER
    out[model.tokens[inside]] = model.counts[inside]
    out[END] = model.end
    out[OTHER] = max(1, model.total - out.sum())
    return out


def _encode(shared):
    """(place, ids) of each document: its hash and its tokens, two bytes each, the end behind them."""

    def run(batches):
        for batch in batches:
            place, col = batch.column("place"), batch.column("text")
            for a, b in slices(col):
                words, first = _words(col.slice(a, b - a))
                ids, ends = _with_ends(shared.value.ids(*shared.value.find(words)).astype(np.uint16), first, END)
                rows = pa.array([x.tobytes() for x in np.split(ids, ends[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([place.slice(a, b - a), rows], names=["place", "ids"])

    return run


def _shards(batches):
    """(shard, its stream from END on) from rows sorted by shard."""
    shard, texts = None, []
    for batch in batches:
        for k, ids in zip(batch.column("shard").to_pylist(), batch.column("ids").to_pylist()):
            if k != shard and texts:
                yield shard, np.concatenate([np.array([END], np.uint16), *texts])
                texts = []
            shard = k
            texts.append(np.frombuffer(ids, np.uint16))
    if texts:
        yield shard, np.concatenate([np.array([END], np.uint16), *texts])


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out


def _fit_task(shared, turn: int, passes: int):
    """Rows (part, shard, n, weights): a round's weights of each shard in parts, and the tokens read for them."""

    def run(batches):
        _keep_memory()
        for shard, stream in _shards(batches):
            walk = (len(stream) - 1) * passes
            start, stop = walk * turn // ROUNDS, walk * (turn + 1) // ROUNDS
            if start == stop:
                continue
            flat = _flat(fit(shared.value, stream, start, stop, turn / ROUNDS, 1 / ROUNDS))
            parts = [flat[a : a + PART].tobytes() for a in range(0, len(flat), PART)]
            columns = [pa.array(range(len(parts)), pa.int32()), pa.array([shard] * len(parts), pa.int64()), pa.array([stop - start] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "n", "weights"])

    return run


def _mean(batches):
    """(part, weights): the mean by tokens of each part."""
    sums: dict[int, list] = {}
    for batch in batches:
        for part, n, weights in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "weights"))):
            held = sums.setdefault(part, [0, 0.0])
            held[0] += n
            held[1] = held[1] + n * np.frombuffer(weights, np.float32).astype(np.float64)
    if sums:
        columns = [pa.array(list(sums), pa.int32()), pa.array([(w / n).tobytes() for n, w in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "weights"])


def _fit_all(docs: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """The network's weights, trained on all of docs(doc_id, text)."""
    weights, sc = initial(_frequency(model)), docs.sparkSession.sparkContext
    if not model.total:
        return weights
    shards, passes = -(-model.total // SHARD), -(-LEAST // model.total)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("place"), "text").mapInArrow(_encode(sc.broadcast(model)), "place long, ids binary")
    rows = rows.withColumn("shard", F.pmod("place", F.lit(shards)))
    rows = cut(rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "place"))
    for turn in range(ROUNDS):
        fitted = rows.mapInArrow(_fit_task(sc.broadcast(weights), turn, passes), "part int, shard long, n long, weights binary")
        mean = fitted.repartition("part").sortWithinPartitions("part", "shard").mapInArrow(_mean, "part int, weights binary")
        parts = sorted((r.part, r.weights) for r in mean.collect())  # as many bytes as the network's weights in any case
        weights = _shaped(np.concatenate([np.frombuffer(w, np.float64) for _, w in parts]), weights)
    return weights


def _frequent(counts: DataFrame) -> DataFrame:
    """About FREQUENT words of the highest counts, by a histogram of the counts: no task sorts more than these.

    Of the words of the last interval of counts, a range of hashes fills up the number.
    """
    step = F.floor(8 * F.log2("c")).cast("int")
    left, low, share = FREQUENT, 0, 1.0
    for low, n in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # eight rows a power of two
        if n > left:
            share = left / n
            break
        left -= n
    edge = F.xxhash64("word") < min((1 << 63) - 1, int(-(2.0**63) + 2.0**64 * share))
    return counts.where((step > low) | ((step == low) & edge))


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the whole table of counts (word, c), from docs(doc_id, text)."""
    counts = cut(word_counts(docs))
    total, distinct, end = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("c"), F.lit(1), F.when(F.col("word") == END_KEY, F.col("c"))))).first()
    top = _frequent(counts.where(F.col("word") != END_KEY)).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    words, c = top.column("word").to_numpy(), top.column("c").to_numpy()
    tokens = np.full(len(words), OTHER)
    tokens[: VOCABULARY - 2] = np.arange(2, VOCABULARY)[: len(words)]
    order = np.argsort(words)
    model = Model(words[order], c[order], tokens[order], total, distinct, end)
    model.weights = _fit_all(docs, model)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text).

    A null text is empty: its only token is the end. A null doc_id keeps its row; repeated rows
    are scored each for itself. Without training texts all words are unknown.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def looked_up(col):
        """By text: tokens, known ones, sum of log10(c + 1) over the frequent, the same of the network's others, their number; token ids; words to join."""
        m = shared.value
        words, first = _words(col)
        at, known = m.find(words)
        logs = np.where(known, np.log10((m.counts[at] if len(m.words) else 0) + 1.0), 0.0)
        ids = m.ids(at, known)
        by_text = lambda v: np.diff(np.concatenate([np.zeros(1, v.dtype), np.cumsum(v)])[first])
        table = np.column_stack([np.diff(first) + 1, by_text(known.astype(np.int64)), by_text(logs), by_text(np.where(ids == OTHER, logs, 0.0)), by_text((ids == OTHER).astype(np.int64))])
        rare = [words[a:b][~known[a:b]] for a, b in zip(first[:-1], first[1:])]
        tokens, ends = _with_ends(ids.astype(np.int32), first, END)
        return table, tokens, ends, rare

    def run(batches):
        _keep_memory()
        m = shared.value
        for batch in batches:
            col = batch.column("text")
            tables, tokens, ends, rare, size = [np.zeros((0, 5))], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
            for a, b in slices(col):
                table, t, e, r = looked_up(col.slice(a, b - a))
                tables.append(table)
                tokens.append(t)
                ends.append(e + size)
                rare += r
                size += len(t)
            n, known, logs, other_logs, others = np.concatenate(tables).T
            base = logs + np.log10(m.end + 1.0) - n * np.log10(m.total + m.distinct + 1.0)
            network = document_log_likelihoods(m.weights, np.concatenate(tokens), np.concatenate(ends)) / np.log(10)
            network += other_logs - others * np.log10(m.rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64) + (m.end > 0)), pa.array(base), pa.array(network), pa.array(rare, pa.list_(pa.int64()))],
                names=["doc_id", "n_tokens", "known", "base", "network", "rare"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(run, "doc_id long, n_tokens long, known long, base double, network double, rare array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.where(F.col("word") != END_KEY), "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count("*").alias("more"))
    out = scored.drop("rare").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("network") + logs).alias("score")
    )
