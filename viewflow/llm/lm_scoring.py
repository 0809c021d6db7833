"""Document scores by masked pseudo-likelihood under a bidirectional window network.

Each word's probability given the two words before and the two after is p(class | window) * p(word | class, window):
the window's embeddings go through one hidden layer to a softmax over classes of words and, for known words, to a
softmax over the words of the class. All other words are one more class, within which each has a share by its count in
the whole corpus, and one share is left for words that the corpus doesn't have; so the probabilities of all words sum
to one. A document's score sums the logarithms over all of its words.

Words are counted over all documents in Spark, and the counts stay distributed: scoring joins them, but for the most
frequent words. Training predicts
every position of all texts once, a share of them in each round; texts are dealt out to shards by a hash of text and id and
sorted there, so that nothing depends on how the input is split. On each shard numpy trains a copy of the network,
and the copies are averaged in a tree of bounded fan-in. What is broadcast and collected is the known and other
frequent words and the network, whose sizes are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, write_table
from .wordarrays import U, Words, mix, row_numbers, slices, text_buffers

OFFSETS = (-2, -1, 1, 2)
NAMES = ("embed", "hidden", "hidden_bias", "out", "out_bias", "inner", "inner_bias")
_NEVER = -1e4
_CHUNK, _FAN_IN = 1 << 16, 64


class Places:
    """Where hashes stand in a sorted array of them, by their upper bits."""

    def __init__(self, hashes: np.ndarray):
        bits = len(hashes).bit_length() + 2
        self.hashes, self.shift = hashes, U(64 - bits)
        self.begin = np.append(np.searchsorted(hashes, np.arange(1 << bits, dtype=U) << self.shift), len(hashes)).astype(np.int32)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are there, and where."""
        slot = words >> self.shift
        at, end = self.begin[slot], self.begin[slot + U(1)]
        left, found = np.flatnonzero(at < end), []
        at, end = at[left], end[left]
        while len(left):
            hit = self.hashes[at] == words[left]
            found.append((left[hit], at[hit]))
            more = np.flatnonzero(~hit & (at + 1 < end))
            left, at, end = left[more], at[more] + 1, end[more]
        which, places = zip(*found, strict=True) if found else ([left], [at])
        return np.concatenate(which), np.concatenate(places)


@dataclass
class Network:
    """Sorted hashes of known words with their ranks by frequency, and the network's arrays.

    A word's number is its rank; then come ``rest`` groups of other words, which stand for them in windows only, then
    the edge. Ranks are dealt out to classes in runs of ``per_class``; the class after these is that of other words.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    rest: int
    net: dict[str, np.ndarray]

    @property
    def classes(self) -> int:
        return self.net["inner"].shape[0]

    @property
    def per_class(self) -> int:
        return self.net["inner"].shape[2]

    @property
    def known(self) -> int:
        return self.classes * self.per_class

    @property
    def edge(self) -> int:
        return self.known + self.rest

    @cached_property
    def _places(self) -> Places:
        return Places(self.hashes)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        out = self.known + (words % U(self.rest)).astype(np.int64)
        which, at = self._places.find(words)
        out[which] = self.ranks[at]
        return out

    def windows(self, numbers: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers around the words ``at``; the edge stands in outside of a document."""
        wide = max(map(abs, OFFSETS))
        place = np.arange(len(numbers)) + wide * (row_numbers(first) + 1)  # with edges before and after each document
        spread = np.full(len(numbers) + wide * len(first), self.edge, np.int32)
        spread[place] = numbers
        return np.stack([spread[place[at] + step] for step in OFFSETS], axis=1)

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The targets' classes, and an order that sorts by them."""
        own = np.minimum(targets // self.per_class, self.classes).astype(np.min_scalar_type(self.classes))
        return own, np.argsort(own, kind="stable")

    def runs(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, begin, end) of the known ones among sorted classes."""
        cut = np.searchsorted(own, np.arange(self.classes + 1, dtype=own.dtype)).tolist()
        return [(c, i, j) for c, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if i < j]

    def log_probabilities(self, numbers: np.ndarray, first: np.ndarray, step: int = 1 << 11) -> np.ndarray:
        """log p(word | window) of every known word; of any other one log p(not a known one | window)."""
        net, out, windows = self.net, np.empty(len(numbers)), self.windows(numbers, first, np.arange(len(numbers)))
        own, order = self.by_class(numbers)
        for a in range(0, len(numbers), step):
            at = order[a : a + step]
            x = net["embed"].take(windows[at].ravel(), axis=0).reshape(len(at), -1)
            h = np.tanh(x @ net["hidden"] + net["hidden_bias"])
            part = _log_softmax_at(net["out"].T @ h.T + net["out_bias"][:, None], own[at])
            for c, i, j in self.runs(own[at]):
                part[i:j] += _log_softmax_at(net["inner"][c].T @ h[i:j].T + net["inner_bias"][c][:, None], numbers[at[i:j]] % self.per_class)
            out[at] = part
        return out


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each column's log softmax the place ``at``."""
    _, total = _exponentials(z, 0)
    return z[at, np.arange(len(at))].astype(float) - np.log(total[0])


class Descent:
    """A copy of a network in training, each number's rate falling with the squares that it has seen.

    All numbers lie in one array, a layer's bias beside its weights, so that a step is few large operations: its
    positions are sorted by class, and a class's words are one product.
    """

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, net = network, np.float32(rate), network.net
        joined = [net["embed"]] + [np.concatenate((net[k], net[f"{k}_bias"][..., None, :]), axis=-2) for k in ("hidden", "out", "inner")]
        joined[2] = joined[2].T
        self.shapes = [v.shape for v in joined]
        self.values = np.concatenate([v.ravel() for v in joined])
        self.seen, self.change, self.scratch = (np.zeros_like(self.values) for _ in range(3))
        self.parts, self.changes = self._split(self.values), self._split(self.change)
        embed, inner = self.parts[0], self.parts[3]
        self.places = np.arange(embed.size).reshape(embed.shape)
        self.words = [(v, v[:-1].T, d) for v, d in zip(inner, self.changes[3], strict=True)]

    def _split(self, flat: np.ndarray) -> list[np.ndarray]:
        cut = np.cumsum([np.prod(shape) for shape in self.shapes])[:-1]
        return [v.reshape(shape) for v, shape in zip(np.split(flat, cut), self.shapes, strict=True)]

    def net(self) -> dict[str, np.ndarray]:
        embed, hidden, out, inner = self.parts
        found = {"embed": embed}
        for k, v in {"hidden": hidden, "out": out.T, "inner": inner}.items():
            found |= {k: v[..., :-1, :], f"{k}_bias": v[..., -1, :]}
        return found

    def steps(self, windows: np.ndarray, targets: np.ndarray, step: int) -> None:
        """Steps on ``step`` positions each, in their order; the last one may have fewer."""
        own = np.minimum(targets // self.network.per_class, self.network.classes)
        base = self.network.classes + 1
        which = np.arange(len(targets)) // step * base + own
        order = np.argsort(which.astype(np.min_scalar_type(which.max(initial=0))), kind="stable")
        windows, targets, own = windows[order], targets[order], own[order]
        cut = np.searchsorted(which[order], np.arange((len(targets) - 1) // step * base + base + 1)).tolist()
        for k, a in enumerate(range(0, len(targets), step)):
            ends = [i - a for i in cut[k * base : (k + 1) * base]]
            runs = [(c, i, j) for c, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]
            self._step(windows[a : a + step].ravel(), targets[a : a + step], own[a : a + step], runs)

    def _step(self, windows: np.ndarray, targets: np.ndarray, own: np.ndarray, runs: list[tuple[int, int, int]]) -> None:
        embed, hidden, out, _ = self.parts
        d_embed, d_hidden, d_out, d_inner = self.changes
        n, known = len(targets), runs[-1][2] if runs else 0
        x = np.empty((n, hidden.shape[0]), np.float32)
        x[:, -1], x[:, :-1] = 1, embed.take(windows, axis=0).reshape(n, -1)
        h = np.empty((n, out.shape[1]), np.float32)
        h[:, -1] = 1
        np.tanh(x @ hidden, out=h[:, :-1])
        p = out @ h.T  # a column for each position
        p, total = _exponentials(p, 0)
        p *= 1 / (n * total)
        p[own, np.arange(n)] -= np.float32(1 / n)
        back = p.T @ out[:, :-1]
        np.dot(p, h, d_out)
        q, g = np.empty((known, self.network.per_class), np.float32), np.empty((known, back.shape[1]), np.float32)
        for c, i, j in runs:
            np.dot(h[i:j], self.words[c][0], q[i:j])
        q, total = _exponentials(q, 1)
        q *= 1 / (n * total)
        q[np.arange(known), targets[:known] % self.network.per_class] -= np.float32(1 / n)
        d_inner[...] = 0
        for c, i, j in runs:
            made, (_, turned, change) = q[i:j], self.words[c]
            np.dot(made, turned, g[i:j])
            np.dot(h[i:j].T, made, change)
        back[:known] += g
        h *= h
        back *= np.subtract(1, h, out=h)[:, :-1]
        np.dot(x.T, back, d_hidden)
        into = back @ hidden[:-1].T
        d_embed[...] = np.bincount(self.places.take(windows, axis=0).ravel(), into.ravel(), embed.size).reshape(embed.shape)
        self.seen += np.multiply(self.change, self.change, out=self.scratch)
        root = np.sqrt(self.seen, out=self.scratch)
        root += np.float32(1e-6)
        self.change *= self.rate
        self.change /= root
        self.values -= self.change


def _exponentials(z: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of e and their sums along an axis, which is kept. Where these could leave the range, ``z`` is shifted first."""
    with np.errstate(over="ignore"):
        made = np.exp(z)
        total = made @ np.ones((z.shape[1], 1), np.float32) if axis else made.sum(axis=0, keepdims=True)
    if total.size and not (total.min() > 1e-20 and total.max() < 1e20):
        z -= z.max(axis=axis, keepdims=True)
        made = np.exp(z)
        total = made.sum(axis=axis, keepdims=True)
    return made, total


@dataclass
class LanguageModel:
    """A network, (word, n) of the whole corpus, and the occurrences and number of words that aren't known ones; the
    sorted hashes and the counts of the most frequent among these."""

    network: Network
    counts: DataFrame
    other_occurrences: int
    other_words: int
    common: tuple[np.ndarray, np.ndarray]

    @property
    def _log_total(self) -> float:
        return float(np.log(self.other_occurrences + self.other_words + 1))

    def common_log_shares(self) -> tuple[np.ndarray, np.ndarray]:
        """The common words' hashes, and log p(word | not a known one)."""
        return self.common[0], np.log(self.common[1] + 1.0) - self._log_total

    def log_shares(self, n: F.Column) -> F.Column:
        """log p(word | not a known one) from the word's count, null for a word that the corpus doesn't have."""
        return F.log(F.coalesce(n, F.lit(0)) + 1.0) - self._log_total


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Words]]:
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for i, j in slices(offsets):
            yield batch, i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(word hash, occurrences) over all texts."""

    def count(batches):
        held, n = [], 0
        for _, _, _, words in _texts(batches):
            held.append(words.hashes())
            n += len(held[-1])
            if n > 3_000_000:
                yield total(held)
                held, n = [], 0
        if n:
            yield total(held)

    def total(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return map_arrow(rows, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_model(docs: DataFrame, *, classes: int = 64, per_class: int = 64, rest: int = 256, dims: int = 12, hidden: int = 24, rounds: int = 2, masked: int = 2, shard_windows: int = 1 << 19, rate: float = 0.1, looked_up: int = 1 << 18, id_column: str = "doc_id", text_column: str = "text") -> LanguageModel:
    """A model of all texts of ``docs``; one word in ``masked`` is predicted in each round, another one each time; by
    default all are after the last round.

    The ``classes * per_class`` most frequent words are known ones; the counts of up to ``looked_up`` further ones are
    broadcast in scoring. Null and empty texts have no words; without any
    word the model is that of an empty corpus, under which every word is one that it doesn't have.
    """
    rows = _rows(docs, id_column, text_column)
    counts, _ = write_table(count_words(rows), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(classes * per_class).collect()  # the known words
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n = np.array([r.n for r in top], float)
    other = total - int(n.sum())
    hashes = np.array([r.word for r in top], np.int64).view(U)
    order = np.argsort(hashes)
    rng = np.random.default_rng(11)
    start = lambda *shape: (rng.standard_normal(shape) * (0.5 / np.sqrt(shape[-2]))).astype(np.float32)
    inner_bias = np.full(classes * per_class, _NEVER)
    inner_bias[: len(n)] = np.log(n)
    mass = np.bincount(np.arange(len(n)) // per_class, n, classes)
    mass = np.append(mass, other + distinct - len(n) + 1)
    net = {
        "embed": (rng.standard_normal((classes * per_class + rest + 1, dims)) * 0.3).astype(np.float32), "hidden": start(len(OFFSETS) * dims, hidden), "hidden_bias": np.zeros(hidden, np.float32),
        "out": start(hidden, classes + 1) * np.float32(0.1), "out_bias": np.where(mass > 0, np.log(np.maximum(mass, 1)), _NEVER).astype(np.float32),
        "inner": start(classes, hidden, per_class) * np.float32(0.1), "inner_bias": inner_bias.reshape(classes, per_class).astype(np.float32),
    }
    network = Network(hashes[order], order, rest, net)
    if rounds and total:
        shards = -(-total // (masked * shard_windows))
        for k in range(rounds):
            network = _round(rows, network, shards, masked, k, rate / (k + 1))
    return LanguageModel(network, counts, other, distinct - len(n), _common(counts, hashes, looked_up))


def _common(counts: DataFrame, known: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words besides known ones, ``most`` at most, down to a level of counts."""
    leveled = counts.select("word", "n", F.floor(F.log2("n") * 8).alias("level"))
    least, total = None, 0
    for level, size in sorted(map(tuple, leveled.groupBy("level").count().collect()), reverse=True):  # some hundred
        total += size
        if total > most + len(known):
            break
        least = level
    if least is None:
        return np.zeros(0, U), np.zeros(0, np.int64)
    found = leveled.where(F.col("level") >= least).select("word", "n").toArrow()
    words, n = found.column("word").to_numpy().view(U), found.column("n").to_numpy()
    keep = np.flatnonzero(~np.isin(words, known))
    keep = keep[np.argsort(words[keep])]
    return words[keep], n[keep]


def _masked(words: Words, network: Network, masked: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, windows and targets) of one round's positions. Which ones follows from the words there."""
    hashes, first = words.hashes(), words.first
    place = np.arange(len(hashes)) - first[row_numbers(first)]
    before = np.concatenate((np.zeros(1, U), hashes))[:-1] * (place > 0)
    key = mix(hashes ^ mix(before + place.astype(U)))
    at = np.flatnonzero(key % U(masked) == U(turn))
    numbers = network.numbers(hashes)
    return key[at], np.column_stack((network.windows(numbers, first, at), numbers[at].astype(np.int32)))


def _round(rows: DataFrame, network: Network, shards: int, masked: int, turn: int, rate: float, step: int = 1024, mixed: int = 1 << 16) -> Network:
    """The average of the copies that the shards train, each weighted by its windows. A shard's windows are taken by the
    order of their keys within ``mixed`` at a time, so that a step's come from many texts."""
    hashed = rows.where("text is not null").withColumn("key", F.xxhash64("text", "doc_id"))  # copies of a text go to many shards
    dealt = hashed.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    sorted_ = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "doc_id", "text").select("shard", "text")
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def train(batches):
        network = shared.value
        own, shard, n = Descent(network, rate), 0, 0
        keys, held, waiting = [], [], 0

        def take(least):
            nonlocal keys, held, waiting
            key, rows = np.concatenate(keys), np.concatenate(held)
            for a in range(0, len(key), mixed):
                if len(key) - a < least:
                    keys, held, waiting = [key[a:]], [rows[a:]], len(key) - a
                    return
                part = rows[a : a + mixed][np.argsort(key[a : a + mixed], kind="stable")]
                own.steps(part[:, :4], part[:, 4], step)
            keys, held, waiting = [], [], 0

        for batch, _, _, words in _texts(batches):
            shard = batch.column("shard")[0].as_py()
            key, rows = _masked(words, network, masked, turn)
            keys.append(key)
            held.append(rows)
            n, waiting = n + len(key), waiting + len(key)
            if waiting >= mixed:
                take(mixed)
        if not n:
            return
        if waiting:
            take(0)
        net = own.net()
        flat = np.concatenate([net[k].ravel() for k in NAMES]).astype(np.float64) * n
        for k, a in enumerate(range(0, len(flat), _CHUNK)):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "chunk": pa.array([k], pa.int32()), "weight": [n], "sums": pa.array([flat[a : a + _CHUNK].tobytes()], pa.binary())})

    parts = map_arrow(sorted_, train, _PART)
    while shards > 1:
        parts, _ = write_table(parts, "networks")
        parts = parts.groupBy("chunk", F.floor(F.col("shard") / _FAN_IN).alias("upper")).applyInArrow(_merge, _PART)
        shards = -(-shards // _FAN_IN)
    flat = np.concatenate([np.frombuffer(r.sums) / r.weight for r in sorted(parts.collect(), key=lambda r: r.chunk)])  # the network
    net, a = {}, 0
    for k in NAMES:
        size = network.net[k].size
        net[k] = flat[a : a + size].reshape(network.net[k].shape).astype(np.float32)
        a += size
    return Network(network.hashes, network.ranks, network.rest, net)


_PART = "shard long, chunk int, weight long, sums binary"


def _merge(table: pa.Table) -> pa.Table:
    """The sum of up to _FAN_IN copies' chunks, in the order of shards."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    total = np.zeros(len(rows[0]["sums"]) // 8)
    for r in rows:
        total += np.frombuffer(r["sums"])
    return pa.table({"shard": pa.array([rows[0]["shard"] // _FAN_IN], pa.int64()), "chunk": pa.array([rows[0]["chunk"]], pa.int32()), "weight": [sum(r["weight"] for r in rows)], "sums": pa.array([total.tobytes()], pa.binary())})


def score_documents(docs: DataFrame, model: LanguageModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all words) and score (mean, null without words) of every row.

    Null and empty texts have no words and log_likelihood 0. Rows of equal or null id each get a row; an empty table
    gives none; columns besides id and text are not read. Words that aren't known ones meet the corpus's counts by a
    join on the word, if they aren't among the common ones, whose counts are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.network, *model.common_log_shares()))

    def score(batches):
        own, common, shares = shared.value
        places = Places(common)
        for batch, i, j, words in _texts(batches):
            first, hashes = words.first, words.hashes()
            numbers = own.numbers(hashes)
            each, other = own.log_probabilities(numbers, first), numbers >= own.known
            rare = np.flatnonzero(other)
            which, at = places.find(hashes[rare])
            each[rare[which]] += shares[at]
            other[rare[which]] = False
            total = np.concatenate(([0.0], np.cumsum(each)))
            left = np.concatenate(([0], np.cumsum(other)))[first].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(left), pa.array(hashes[other].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]]), lists], ["doc_id", "n_tokens", "log_likelihood", "others"])

    made = map_arrow(_rows(docs, id_column, text_column), score, "doc_id long, n_tokens long, log_likelihood double, others array<long>")
    scored, _ = write_table(made.withColumn("row", F.monotonically_increasing_id()), "scores")
    others = scored.select("row", F.explode("others").alias("word")).join(model.counts, "word", "left")
    more = others.groupBy("row").agg(F.sum(model.log_shares(F.col("n"))).alias("more"))
    summed = scored.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return summed.withColumn("score", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
