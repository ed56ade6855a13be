"""Language-model scores: a bidirectional window network predicts every token from both sides (masked pseudo-likelihood)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, saved, ship
from threadloom.llm.text import pieces

#: The network's tokens: the most frequent words of the corpus (so many at least, see network_words), and buckets into which all
#: others fall by their hash. Within its bucket each word has its share of the bucket's occurrences in the corpus.
FREQUENT, RARE = 512, 512
#: Counts of so many words are held by every task; those of all others are joined. Results do not depend on it.
HELD = 1 << 18
#: Tokens on each side, values for each of them, hidden units, tokens in a step, rounds of averaging at least.
REACH, WIDTH, HIDDEN, BATCH, ROUNDS = 2, 8, 16, 4096, 2
RATE = 0.3
#: Parameters travel in runs of so many.
BLOCK = 64
#: Sums of exponentials of values up to this are far from the limits of single precision.
SAFE = 50
SEED = 11


def network_words(tokens: int) -> int:
    """Words that are tokens of their own in the network: a power of two, 8 times the cube root of the corpus's words at least."""
    return max(FREQUENT, 1 << (math.ceil(8 * tokens ** (1 / 3)) - 1).bit_length())


def rounds(tokens: int) -> int:
    """Rounds of averaging: one more for each fourfold corpus."""
    return max(ROUNDS, (tokens.bit_length() - 18) // 2)


class Layout:
    """Sizes of a network with so many words of their own. Tokens are predicted in two steps: their class, then which of its tokens."""

    def __init__(self, frequent: int = FREQUENT):
        self.frequent, self.size = frequent, frequent + RARE
        self.group = 1 << round(math.log2(self.size) / 2)
        self.classes = self.size // self.group
        self.shapes = {
            "embedding": (self.size + 1, WIDTH),  # the last row stands for places outside of the text
            "hidden": (2 * REACH * WIDTH, HIDDEN),
            "hidden_bias": (HIDDEN,),
            "classes": (HIDDEN, self.classes),
            "class_bias": (self.classes,),
            "members": (self.classes, HIDDEN, self.group),
            "member_bias": (self.classes, self.group),
        }
        self.parameters = sum(int(np.prod(s)) for s in self.shapes.values())

    def views(self, values: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of the network in an array of all its parameters."""
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = values[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out


#: The least network.
_SIZE, PARAMETERS = Layout().size, Layout().parameters


class Vocabulary:
    """Token numbers by word hash: the frequent ones first, in order of their class, then RARE buckets."""

    def __init__(self, frequent: np.ndarray, layout: Layout):
        # Dealt over the classes in turn, so that no class holds all of the most frequent words.
        number = np.arange(len(frequent)) * layout.group
        number = number % layout.frequent + number // layout.frequent
        order = np.argsort(frequent)
        self.words, self.number, self.frequent = frequent[order], number[order], layout.frequent

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = (hashes % np.uint64(RARE)).astype(np.int64) + self.frequent
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[at] == hashes, self.number[at], out)
        return out


class Network:
    """Embeddings of the tokens on both sides, one hidden layer, and a softmax over classes and over a class's members."""

    def __init__(self, values: np.ndarray | None = None, layout: Layout | None = None):
        self.layout = layout = layout or Layout()
        if values is None:
            rng = np.random.default_rng(SEED)
            values = np.concatenate([(rng.standard_normal(s) * (0 if "bias" in n else 0.2)).ravel() for n, s in layout.shapes.items()])
        self.values = values.astype(np.float32)
        self.squares = np.full(layout.parameters, 1e-2, np.float32)
        self.grad = np.zeros(layout.parameters, np.float32)
        self.parts, self.slopes = layout.views(self.values), layout.views(self.grad)
        # Arrays of a batch are kept from step to step: fresh ones of this size cost more than what is computed in them.
        self.top = np.empty((BATCH, layout.classes), np.float32)
        self.low = np.empty((BATCH, layout.group), np.float32)

    def forward(self, around: np.ndarray, targets: np.ndarray):
        """Log-probabilities of targets (sorted by class, BATCH at most) given the tokens around them, and what step() needs.

        The probabilities of all classes and of the members of a target's class are in arrays that the next call fills anew.
        """
        p, n = self.parts, len(targets)
        x = p["embedding"][around].reshape(n, -1)
        h = x @ p["hidden"]
        h += p["hidden_bias"]
        np.tanh(h, out=h)
        top, low = np.matmul(h, p["classes"], out=self.top[:n]), self.low[:n]
        top += p["class_bias"]
        group, member = np.divmod(targets, self.layout.group)
        edges = np.searchsorted(group, np.arange(self.layout.classes + 1))
        runs = [(c, int(edges[c]), int(edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]
        for c, i, j in runs:
            np.matmul(h[i:j], p["members"][c], out=low[i:j])
            low[i:j] += p["member_bias"][c]
        small = max(_largest(p["classes"], p["class_bias"]), _largest(p["members"], p["member_bias"])) < SAFE
        value = _chosen(top, group, small)
        value += _chosen(low, member, small)
        return value, (x, h, top, low, group, member, runs)

    def step(self, around: np.ndarray, targets: np.ndarray) -> float:
        """One step of Adagrad on a batch; the mean log-probability before it."""
        p, g, n = self.parts, self.slopes, len(targets)
        value, (x, h, top, low, group, member, runs) = self.forward(around, targets)
        rows = np.arange(n)
        for d, at in ((top, group), (low, member)):
            d[rows, at] -= 1
            d *= np.float32(1 / n)
        np.matmul(h.T, top, out=g["classes"])
        g["class_bias"][:] = _column_sums(top)
        d_h = top @ p["classes"].T
        g["members"][:] = 0
        g["member_bias"][:] = 0
        for c, i, j in runs:
            np.matmul(h[i:j].T, low[i:j], out=g["members"][c])
            g["member_bias"][c] = _column_sums(low[i:j])
            d_h[i:j] += low[i:j] @ p["members"][c].T
        d_h *= 1 - h * h
        np.matmul(x.T, d_h, out=g["hidden"])
        g["hidden_bias"][:] = d_h.sum(0)
        d_x = d_h @ p["hidden"].T
        cells = (around.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g["embedding"][:] = np.bincount(cells, d_x.ravel(), p["embedding"].size).reshape(-1, WIDTH)
        self.squares += self.grad * self.grad
        self.grad *= np.float32(RATE)
        self.grad /= np.sqrt(self.squares)
        self.values -= self.grad
        return float(value.mean())


def _largest(weights: np.ndarray, bias: np.ndarray) -> float:
    """No output is larger, as hidden units are between -1 and 1."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max())


def _chosen(x: np.ndarray, at: np.ndarray, small: bool) -> np.ndarray:
    """Log-probability of the chosen column of each row; x, of unscaled logarithms, becomes its softmax.

    Small ones need not be set off by the row's largest before they are raised.
    """
    if not small:
        x -= x.max(1, keepdims=True)
    value = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    x *= (1 / total)[:, None]
    return value - np.log(total)


def _column_sums(x: np.ndarray) -> np.ndarray:
    return np.ones(len(x), np.float32) @ x


def windows(tokens: np.ndarray, first: np.ndarray, outside: int = _SIZE) -> np.ndarray:
    """For each token the REACH tokens before and after it in its own text; outside stands for places beyond it."""
    n = len(tokens)
    beyond = np.full(REACH, outside)
    line = np.concatenate([beyond, tokens, beyond])
    out = np.empty((n, 2 * REACH), np.int64)
    start, end = first[:-1], first[1:]
    for k, o in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        out[:, k] = line[REACH + o : REACH + o + n]
        for j in range(abs(o)):  # the places of each text from which this one lies beyond its start or end
            at = start + j if o < 0 else end - 1 - j
            out[at[(at >= start) & (at < end)], k] = outside
    return out


def _batches(tokens: np.ndarray, group: int) -> Iterator[np.ndarray]:
    """The places of tokens, BATCH at a time, each batch in order of the tokens' classes."""
    classes = (tokens // group).astype(np.uint16)  # numpy sorts these by radix
    for a in range(0, len(tokens), BATCH):
        yield a + np.argsort(classes[a : a + BATCH], kind="stable")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of every distinct word and its occurrences over all texts. Tasks send one row for each word and block."""

    def rows(held: list) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.bincount(counts, np.concatenate([c for _, c in held])).astype(np.int64)
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], names=["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, words in pieces(batch.column(0), False):
                held.append(np.unique(words.hashes, return_counts=True))
                size += len(held[-1][0])
                if size > 1_000_000:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    counted = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return saved(counted, "words")


class Model:
    """What the corpus taught: the network, its words, occurrences of buckets, and the counts of held words (sorted by hash)."""

    def __init__(self, counts: DataFrame, held: int):
        self.tokens = counts.agg(F.sum("n")).first()[0] or 0
        self.layout = Layout(network_words(self.tokens))
        top = counts.orderBy(F.desc("n"), "word").limit(max(held, self.layout.frequent)).toArrow()
        words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
        self.frequent = words[: self.layout.frequent]
        order = np.argsort(words)
        self.words, self.logs = words[order], np.log(n[order])
        total = np.zeros(RARE)
        # RARE is a power of two: a hash's bucket is its low bits, whatever its sign.
        for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(RARE - 1)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
            total[r.bucket] = r.n
        own = self.layout.frequent
        total -= np.bincount((words[:own] % np.uint64(RARE)).astype(np.int64), n[:own], RARE)
        self.buckets = np.log(np.maximum(total, 1))
        self.values = Network(layout=self.layout).values

    def within(self, hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-shares of words in their buckets (0 for the network's own words), and where a count has to be added by a join."""
        out = np.zeros(len(hashes))
        rare = np.flatnonzero(tokens >= self.layout.frequent)
        out[rare] = -self.buckets[tokens[rare] - self.layout.frequent]
        at = np.minimum(np.searchsorted(self.words, hashes[rare]), len(self.words) - 1)
        known = self.words[at] == hashes[rare]
        out[rare[known]] += self.logs[at[known]]
        return out, rare[~known]


_BLOCKS = "k long, value binary, weight long"


def _blocks(found: dict[int, tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """Runs of parameters (of number k on) as single-precision bytes, and the tokens they stand for."""
    values = [v.astype(np.float32).tobytes() for v, _ in found.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int64()), pa.array(values, pa.binary()), pa.array([n for _, n in found.values()], pa.int64())], names=["k", "value", "weight"]
    )


def _mean_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One mean for each run of parameters; holds a sum for each, however many tasks sent it."""
    held = {}
    for batch in batches:
        for k, value, n in zip(*(c.to_pylist() for c in batch.columns)):
            total, weight = held.get(k, (0.0, 0))
            held[k] = total + np.frombuffer(value, np.float32).astype(float) * n, weight + n
    if held:
        yield _blocks({k: (total / weight, weight) for k, (total, weight) in held.items()})


def trained(docs: DataFrame, counts: DataFrame, held: int = HELD) -> Model:
    """The model of all documents. In each round a share of them trains, task by task from the same start.

    Every document is used in one round (by a hash of its text), so one pass over the whole corpus is made. A task's
    parameters count by its tokens; their means are added up where the rows are, and the driver gets one set.
    """
    spark = docs.sparkSession
    model = Model(counts, held)
    layout, turns = model.layout, rounds(model.tokens)
    for turn in range(turns):
        start = spark.sparkContext.broadcast((model.frequent, model.values))

        def run(batches, start=start):
            words, first = start.value
            vocabulary, net, seen = Vocabulary(words, layout), Network(first.copy(), layout), 0
            for batch in batches:
                for _, _, w in pieces(batch.column(0), False):
                    tokens = vocabulary.tokens(w.hashes)
                    around = windows(tokens, w.first, layout.size)
                    for at in _batches(tokens, layout.group):
                        net.step(around[at], tokens[at])
                    seen += len(tokens)
            if seen:
                yield _blocks({k: (net.values[k : k + BLOCK], seen) for k in range(0, layout.parameters, BLOCK)})

        part = docs.filter(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn).select("text")
        means = part.mapInArrow(run, _BLOCKS).repartition("k").mapInArrow(_mean_blocks, _BLOCKS).toArrow()
        for k, value in zip(means.column("k").to_pylist(), means.column("value").to_pylist()):
            model.values[k : k + BLOCK] = np.frombuffer(value, np.float32)
    return model


def score_documents(docs: DataFrame, id_column: str = "doc_id", held: int = HELD) -> DataFrame:
    """One row per document: the id, n_tokens, log_likelihood (sum of log-probabilities of its tokens given both sides), mean.

    The model is trained on all documents first. A word that is no token of the network has the probability of its bucket
    times its share of the bucket's occurrences, so every distinct word of the corpus has a probability of its own. Counts
    of the held most frequent words travel with the network; those of other words that occur twice or more are joined.

    Null and empty texts have no tokens, a sum of 0 and a null mean; repeated rows are each scored; columns other than the
    id and text are ignored; an empty table gives an empty result. Parameters depend on how rows are dealt to tasks, so
    scores of two runs agree closely, not exactly.
    """
    ship(docs.sparkSession)
    counts = word_counts(docs)
    learned = trained(docs, counts, held)
    model = docs.sparkSession.sparkContext.broadcast(learned)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        m = model.value
        layout = m.layout
        vocabulary, net = Vocabulary(m.frequent, layout), Network(m.values, layout)
        for batch in batches:
            n_tokens, sums, others = [], [], []
            for _, _, w in pieces(batch.column(2), False):
                tokens = vocabulary.tokens(w.hashes)
                around = windows(tokens, w.first, layout.size)
                value, other = m.within(w.hashes, tokens)
                for at in _batches(tokens, layout.group):
                    value[at] += net.forward(around[at], tokens[at])[0]
                total = np.concatenate([[0.0], np.cumsum(value)])
                sums.append(total[w.first[1:]] - total[w.first[:-1]])
                n_tokens.append(np.diff(w.first))
                edges = np.searchsorted(other, w.first)
                others += [w.hashes[other[a:b]].view(np.int64) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            sums = np.concatenate(sums) if sums else np.zeros(0)
            n_tokens = np.concatenate(n_tokens) if n_tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_tokens.astype(np.int64)), pa.array(sums), pa.array(others, pa.list_(pa.int64()))],
                names=["__row", id_column, "n_tokens", "value", "others"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("__row"), id_column, "text")
    scored = saved(rows.mapInArrow(run, f"__row long, `{id_column}` {kind}, n_tokens long, value double, others array<long>"), "scores")
    # A word that occurs once adds log(1).
    open_words = scored.select("__row", F.explode("others").alias("word"))
    more = open_words.join(counts.filter("n > 1"), "word").groupBy("__row").agg(F.sum(F.log("n")).alias("more"))
    out = scored.join(more, "__row", "left").withColumn("log_likelihood", F.col("value") + F.coalesce("more", F.lit(0.0)))
    out = out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
    return out.select(id_column, "n_tokens", "log_likelihood", "mean_log_likelihood")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
