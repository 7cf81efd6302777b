"""A convolutional text classifier for toxicity, trained in numpy.

A word's vector is the sum of three hashed embedding rows: of the word, of its first six
bytes and of its first four, so that unseen forms of a word share what was learnt. Filters
of several widths slide over the vectors of the whole text, each keeps its greatest answer,
and one linear layer gives the score. Training is plain gradient descent with
per-parameter steps; only the positions that won the pooling pass a gradient on.

The classifier is fitted on at most TRAIN_ROWS labelled training rows of each label, taken
in the order of a digest, less a quarter of them. All other labelled training rows calibrate:
they are counted by language, label and fine bin of their score, and the counts are weighed to the
label rates of all training rows. The score is shifted so that 0.5 maximises F1 over them; thresholds per
language do the same among rows of a language, as a column beside the score, which never sees it.

Null and empty texts have one empty position and a score like any other. Labels are read
from training rows only; repeated rows count as often as they occur; without labels of
both kinds the score is the same for all, and an empty table gives an empty result. Filters slide over the whole
of a very long text. Only doc_id, text and lang are read of the documents.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, slices
from thresher.session import pinned

TRAIN_ROWS = 2000
FOLDS = 5
BUCKET_BITS = 15
DIMENSIONS = 12
FILTERS = 16
WIDTHS = (1, 2, 3)
EPOCHS = 6
BATCH = 32
RATE = 0.05
SEGMENT = 20_000  # words that are convolved at once; longer texts are pooled piece by piece
LEAST_PER_LANGUAGE = 20
FINE = 256  # bins of the score to one unit of its logit
FARTHEST = 20  # logits beyond share the outermost bins
ANSWERS = "doc_id long, held_out boolean, lang string, logit double"
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def rows_of(text):
    """The three bucket numbers of each word of a text."""
    words = [w.encode("utf-8", "surrogatepass") for w in (v.strip(EDGE) for v in (text or "").lower().split()) if w]
    found = np.empty((len(words), 3), np.uint16)
    for i, (cut, seed) in enumerate(((None, 1), (6, 2), (4, 3))):
        found[:, i] = [xxhash.xxh32_intdigest(w[:cut], seed) >> (32 - BUCKET_BITS) for w in words]
    return found


class Network:
    """The weights, and what is done with them."""

    def __init__(self, seed=1):
        random = np.random.default_rng(seed)
        self.words = (random.standard_normal((1 << BUCKET_BITS, DIMENSIONS)) * 0.1).astype(np.float32)
        self.filters = [(random.standard_normal((w, DIMENSIONS, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.output = (random.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.float32(0)
        self.shift = 0.0

    def flat(self, texts):
        """The texts one after the other with empty rows between; vectors, starts and sizes."""
        pad = max(WIDTHS) - 1
        sizes = np.array([max(1, len(t)) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + pad)[:-1]])
        vectors = np.zeros((int(sizes.sum() + pad * len(texts)), DIMENSIONS), np.float32)
        for t, s in zip(texts, starts):
            if len(t):
                vectors[s:s + len(t)] = self.words[t[:, 0]] + self.words[t[:, 1]] + self.words[t[:, 2]]
        return vectors, starts, sizes

    def answers(self, vectors, kind):
        """The answer of each filter of a kind at each position."""
        width, count = WIDTHS[kind], len(vectors)
        out = np.tile(self.biases[kind], (count, 1))
        for j in range(width):
            out[:count - j] += vectors[j:] @ self.filters[kind][j]
        return out

    def pooled(self, texts):
        """The greatest answer of every filter to each text, whatever its length."""
        pieces, of = [], []
        step, pad = SEGMENT, max(WIDTHS) - 1
        for i, t in enumerate(texts):
            for a in range(0, max(1, len(t)), step):
                pieces.append(t[a:a + step + pad])
                of.append(i)
        done, rows, count = [], [], 0
        for i, p in enumerate(pieces):
            rows.append(p)
            count += len(p) + pad
            if count >= SEGMENT or i == len(pieces) - 1:
                vectors, starts, sizes = self.flat(rows)
                gaps = np.concatenate([np.arange(s + n, s + n + pad) for s, n in zip(starts, sizes)])
                best = []
                for kind in range(len(WIDTHS)):
                    out = self.answers(vectors, kind)
                    out[gaps] = -np.inf
                    best.append(np.maximum.reduceat(out, starts, axis=0))
                done.append(np.concatenate(best, axis=1))
                rows, count = [], 0
        found = np.concatenate(done)
        firsts = np.flatnonzero(np.diff(np.concatenate([[-1], of])))
        return np.maximum.reduceat(found, firsts, axis=0)

    def logits(self, texts):
        if not len(texts):
            return np.empty(0)
        return (np.maximum(self.pooled(texts), 0) @ self.output + self.bias).astype(float) + self.shift

    def fit(self, texts, labels):
        """Descends the mean logistic loss, in an order drawn from a fixed seed."""
        random, order = np.random.default_rng(2), np.arange(len(texts))
        state = {name: np.full(np.shape(value), 1e-6, np.float32) for name, value in self.parameters()}
        for epoch in range(EPOCHS):
            random.shuffle(order)
            for start in range(0, len(order), BATCH):
                picked = order[start:start + BATCH]
                self.descend([texts[i] for i in picked], labels[picked], state, RATE / (1 + epoch))
        return self

    def parameters(self):
        return [("words", self.words), ("output", self.output), ("bias", self.bias),
                *[(f"filter{k}", f) for k, f in enumerate(self.filters)], *[(f"bias{k}", b) for k, b in enumerate(self.biases)]]

    def descend(self, texts, labels, state, rate):
        vectors, starts, sizes = self.flat(texts)
        best, spots = [], []
        for kind in range(len(WIDTHS)):
            out = self.answers(vectors, kind)
            at = np.stack([s + out[s:s + n].argmax(axis=0) for s, n in zip(starts, sizes)])
            spots.append(at)
            best.append(np.take_along_axis(out, at, axis=0))
        pooled = np.concatenate(best, axis=1)
        seen = np.maximum(pooled, 0)
        wrong = (1 / (1 + np.exp(-(seen @ self.output + self.bias))) - labels).astype(np.float32) / len(texts)
        back = np.outer(wrong, self.output) * (pooled > 0)
        touched, pulls = [], []
        step = lambda name, value, pull: self.move(value, pull, state[name], rate)
        for kind, width in enumerate(WIDTHS):
            pull = back[:, kind * FILTERS:(kind + 1) * FILTERS]
            change = np.empty_like(self.filters[kind])
            for j in range(width):
                at = np.minimum(spots[kind] + j, len(vectors) - 1)
                change[j] = np.einsum("nfd,nf->df", vectors[at], pull)
                touched.append(at.ravel())
                pulls.append((pull[:, :, None] * self.filters[kind][j].T[None]).reshape(-1, DIMENSIONS))
            step(f"filter{kind}", self.filters[kind], change)
            step(f"bias{kind}", self.biases[kind], pull.sum(axis=0))
        step("output", self.output, seen.T @ wrong)
        self.bias = self.bias - np.float32(rate * wrong.sum())
        rows = np.full((len(vectors), 3), -1, np.int64)
        for t, s in zip(texts, starts):
            rows[s:s + len(t)] = t
        touched, pulls = np.concatenate(touched), np.concatenate(pulls)
        real = rows[touched, 0] >= 0
        buckets, pulls = rows[touched[real]].ravel(), np.repeat(pulls[real], 3, axis=0)
        some, which = np.unique(buckets, return_inverse=True)
        total = np.zeros((len(some), DIMENSIONS), np.float32)
        np.add.at(total, which, pulls)
        state["words"][some] += total * total
        self.words[some] -= rate * total / np.sqrt(state["words"][some])

    @staticmethod
    def move(value, pull, seen, rate):
        seen += pull * pull
        value -= rate * pull / np.sqrt(seen)


def best_threshold(bins, hits, misses):
    """The logit above which F1 is greatest, halfway to the next lower bin; `hits` and `misses` are weights of distinct bins."""
    order = np.argsort(-bins)
    bins, hits, misses = bins[order], np.cumsum(hits[order]), np.cumsum(misses[order])
    at = int(np.argmax(2 * hits / (hits + misses + hits[-1])))
    return float(bins[at] if at + 1 == len(bins) else (bins[at] + bins[at + 1] + 1) / 2) / FINE


def training_fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS != 0


def known_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("label")).filter(training_fold(F.col("of")))


def fitted(documents: DataFrame, labels: DataFrame, rows=TRAIN_ROWS):
    """(network, digests of the doc_ids it was fitted on) from at most `rows` rows of each label; None without both."""
    known = known_labels(labels)
    order = F.xxhash64("of", F.lit(7))
    picked = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy(order, "of").limit(rows)
        picked = some if picked is None else picked.unionByName(some)

    def run(batches):
        for one in batches:
            yield batch(arrow("label int, turn long, tokens binary"), one.column(0), one.column(1), [rows_of(t).tobytes() for t in one.column(2).to_pylist()])

    # The sample has 2 x rows rows at most.
    chosen = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("of"))
    sample = chosen.select("label", order.alias("turn"), "text").mapInArrow(run, "label int, turn long, tokens binary").collect()
    network = Network()
    if len({r["label"] for r in sample}) < 2:
        return network, None
    sample.sort(key=lambda r: (r["turn"], r["tokens"]))
    turns, places = np.unique([r["turn"] for r in sample], return_inverse=True)
    learnt = [r for r, place in zip(sample, places.tolist()) if place % 4]
    texts = [np.frombuffer(r["tokens"], np.uint16).reshape(-1, 3) for r in learnt]
    network.fit(texts, np.array([r["label"] for r in learnt], np.float32))
    return network, turns[np.arange(len(turns)) % 4 > 0].tolist()


def answers(documents: DataFrame, network) -> DataFrame:
    """doc_id, held_out, lang and the logit of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for one in slices(batches, 200):
            yield batch(arrow(ANSWERS), one.column(0), one.column(1), one.column(2), shared.value.logits([rows_of(t) for t in one.column(3).to_pylist()]))

    rows = documents.select(F.col("doc_id").cast("long"), (~training_fold(F.col("doc_id"))).alias("held_out"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, ANSWERS)


def threshold_of(counts):
    """The best threshold of counts (bin, label, used, n), and the least number of rows of a label that set it.

    `used` rows were fitted: they count for the label rates alone.
    """
    free = counts[~counts["used"]]
    table = free.pivot_table(index="bin", columns="label", values="n", aggfunc="sum", fill_value=0).reindex(columns=[0, 1], fill_value=0)
    sums, rates = table.sum(), counts.groupby("label")["n"].sum()
    least = int(sums.min())
    if not least:
        return 0.0, 0
    return best_threshold(table.index.to_numpy(np.int64), table[1].to_numpy() * (rates[1] / sums[1]), table[0].to_numpy() * (rates[0] / sums[0])), least


def calibrated(answered: DataFrame, labels: DataFrame, used):
    """(logit to decide at, logits by language) over all labelled training rows but the fitted ones."""
    spark = answered.sparkSession
    if used is None:
        return 0.0, {}
    spent = F.broadcast(spark.createDataFrame([(t,) for t in used], "spent long"))
    known = known_labels(labels).withColumn("turn", F.xxhash64("of", F.lit(7))).join(spent, F.col("turn") == F.col("spent"), "left")
    fine = F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col("logit"))) * FINE).cast("int")
    rows = answered.join(known, F.col("doc_id") == F.col("of").cast("long")).select(
        F.coalesce("lang", F.lit("")).alias("lang"), fine.alias("bin"), "label", F.col("spent").isNotNull().alias("used"))
    counts = pinned(rows.groupBy("lang", "bin", "label", "used").agg(F.count(F.lit(1)).alias("n")))
    # At most 2 x FARTHEST x FINE bins by label and use.
    cut = threshold_of(counts.groupBy("bin", "label", "used").agg(F.sum("n").alias("n")).toPandas())[0]

    def of_language(key, group):
        import pandas as pd

        return pd.DataFrame([(key[0], *threshold_of(group))], columns=["lang", "logit", "least"])

    found = counts.groupBy("lang").applyInPandas(of_language, "lang string, logit double, least long").filter(F.col("least") >= LEAST_PER_LANGUAGE)
    return cut, {r["lang"]: r["logit"] for r in found.orderBy("lang").collect()}


def train(documents: DataFrame, labels: DataFrame, rows=TRAIN_ROWS):
    """(network, thresholds by language), fitted on at most `rows` rows of each label and calibrated on all others."""
    network, used = fitted(documents, labels, rows)
    cut, cuts = calibrated(answers(documents, network), labels, used)
    network.shift = -cut
    return network, scores_at(cuts, cut)


def scores_at(cuts, cut):
    return {lang: float(1 / (1 + np.exp(cut - own))) for lang, own in cuts.items()}


def verdicts(answered: DataFrame, cut, thresholds) -> DataFrame:
    """doc_id, held_out, score, predicted, and the verdict by the language's own threshold."""
    done = answered.withColumn("score", 1 / (1 + F.exp(F.lit(cut) - F.col("logit"))))
    threshold = F.lit(0.5)
    for lang, own in thresholds.items():
        threshold = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(own)).otherwise(threshold)
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                       threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))


def scored(documents: DataFrame, network, thresholds) -> DataFrame:
    """The verdicts on documents by a calibrated network."""
    return verdicts(answers(documents, network), 0.0, thresholds)


@query()
def op9_toxicity(spark, sf_dir):
    """A score for every document."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network, used = fitted(documents, labels)
    answered = pinned(answers(documents, network))
    cut, cuts = calibrated(answered, labels, used)
    return verdicts(answered, cut, scores_at(cuts, cut))
