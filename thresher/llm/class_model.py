"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

The probability of a word after another is P(its class | class before) times
P(word | its class), both smoothed. The TOP_WORDS most frequent words have slots of their
own and all others share HASHED slots by hash at first, so the tables that are clustered have a
fixed size. Exchange clustering moves one slot after the other, the most frequent first, to
the class that raises the likelihood of the class bigrams most, given counts of what
classes precede and follow each slot; the counts come from a pass over all training
tokens before each of the ROUNDS.

Then each other word of the training texts gets a class by its own counts: blocks send what classes
follow and precede each of their words to the word's bucket, which totals them, takes the class of
the greatest likelihood by the table of class bigrams, and sends class and count back to the
blocks. There are OWN_ROUNDS of this. Only words no training text has keep the class of their slot.

Texts are first turned into blocks: documents of a task, at most BLOCK_CHARS characters, as
numbers into the block's own word list; passes read the blocks.

Null, empty and blank texts are the end token alone. Repeated doc_ids are scored (and
learnt from) each. A null doc_id is held out. With no training rows every probability comes from the
smoothing; an empty table gives an empty result. A very long text is a block of its own. Words of equal counts are
taken in the order of their hash. Only doc_id and text are read of the documents.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch, mix, slices, word_hashes, words_of
from thresher.session import fresh_path, parallelism, pinned

FOLDS = 10
DELTA = 0.1
ALPHA = 1.0
CLASSES = 48  # class 0 is the end token's
TOP_WORDS = 4096
HASHED = 4096
SLOTS = TOP_WORDS + HASHED + 1  # the last one is the end token's
END = SLOTS - 1
ROUNDS = 3
OWN_ROUNDS = 2
# Words of blocks that one bucket totals.
BUCKET_WORDS = 100_000
# Codes of a bucket that are added up at once.
HELD_CODES = 2_000_000
BLOCK_CHARS = 4_000_000
CELLS_PER_CHUNK = 8192
BLOCKS = "block long, doc_ids array<long>, sizes array<int>, held array<boolean>, tokens binary, words array<long>, counts array<long>"
SENT = "bucket int, block long, words binary, kinds binary, codes binary, counts binary"
BACK = "block long, bucket int, kinds binary, counts binary, sizes array<long>"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "perplexity double")


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def blocks_of(documents: DataFrame) -> DataFrame:
    """Blocks of documents; `words` are hashes, most frequent first, `counts` theirs in the block's training texts."""

    def pack(number, ids, hashes):
        sizes = np.array([len(h) for h in hashes], np.int32)
        held = np.array([held_out(i) for i in ids])
        words, tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order))
        tokens = place[tokens].astype("<u4")
        learnt = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
        return number, ids, sizes.tolist(), held.tolist(), packed(tokens), words[order].view(np.int64), learnt

    def run(batches):
        from pyspark import TaskContext

        schema, number = arrow(BLOCKS), TaskContext.get().partitionId() << 32
        ids, hashes, chars = [], [], 0
        for one in slices(batches):
            for doc_id, text in zip(one.column(0).to_pylist(), one.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                hashes.append(word_hashes(words_of(text)))
                chars += len(text or "") + 1
                if chars >= BLOCK_CHARS:
                    yield batch(schema, *([c] for c in pack(number, ids, hashes)))
                    ids, hashes, chars, number = [], [], 0, number + 1
        if ids:
            yield batch(schema, *([c] for c in pack(number, ids, hashes)))

    return documents.select("doc_id", "text").mapInArrow(run, BLOCKS)


def laid_out(blocks: DataFrame) -> DataFrame:
    """The blocks, written in buckets by their number.

    What buckets of words send back is joined to them round after round: only that moves then, and the
    blocks stay where they are. The name in the catalog goes at once; the files are those of the path.
    """
    spark = blocks.sparkSession
    path, name = fresh_path(spark, "blocks"), f"blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").bucketBy(parallelism(spark), "block").sortBy("block").option("path", path).saveAsTable(name)
    written = spark.table(name)
    written.schema  # resolved now
    spark.sql(f"DROP TABLE {name}")
    return written


def forgotten(spark, df) -> None:
    """Deletes the files of a written table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def listed(rows, column, i):
    """A list of a record batch as an array, without Python objects; empty for a null."""
    values = rows.column(column)[i].values
    return np.empty(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False)


def packed(values):
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unpacked(held, kind="<u4"):
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(held), kind) if held else np.empty(0, kind)


def tokens_of(held):
    return unpacked(held)


def counted(blocks: DataFrame) -> DataFrame:
    """(word, n): the training count over all blocks of every word of the training texts."""
    lists = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    return lists.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


class Slots:
    """The slot of each word hash."""

    def __init__(self, top):
        self.words = np.array(sorted(top), np.int64)
        self.slots = np.array([top[w] for w in self.words.tolist()], np.int64)

    def own(self, words):
        """Which words have a slot of their own."""
        return np.isin(words, self.words)

    def __call__(self, words):
        words = np.asarray(words, np.int64)
        shared = TOP_WORDS + (words.view(np.uint64) >> np.uint64(40)).astype(np.int64) % HASHED
        if not len(self.words):
            return shared
        spots = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[spots] == words, self.slots[spots], shared)


def gathered(parts: DataFrame, size):
    """The sum of (chunk, cells, counts) rows as one array of a fixed size."""

    def run(batches):
        totals = {}
        for one in batches:
            for chunk, cells, counts in zip(*(one.column(i).to_pylist() for i in range(3))):
                total = totals.setdefault(chunk, np.zeros(CELLS_PER_CHUNK, np.int64))
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<i8")
        yield batch(arrow("chunk int, counts binary"), list(totals), [t.tobytes() for t in totals.values()])

    whole = np.zeros(-(-size // CELLS_PER_CHUNK) * CELLS_PER_CHUNK, np.int64).reshape(-1, CELLS_PER_CHUNK)
    for row in parts.repartition("chunk").mapInArrow(run, "chunk int, counts binary").collect():
        whole[row["chunk"]] += np.frombuffer(row["counts"], np.int64)
    return whole.ravel()[:size]


def neighbours(blocks: DataFrame, slots, classes):
    """How often each class follows and precedes each slot in training texts: two tables, slots by classes."""
    shared = blocks.sparkSession.sparkContext.broadcast((slots, classes))
    size = 2 * SLOTS * CLASSES

    def run(batches):
        slots, classes = shared.value
        total = np.zeros(size, np.int64)
        for one in batches:
            for i in range(one.num_rows):
                sizes, held, words = (listed(one, c, i) for c in (0, 1, 3))
                own, packed = slots(words), one.column(2)[i].as_py()
                kept = own[tokens_of(packed)[np.repeat(~held, sizes)]]
                # One end token before the first text and one after each.
                line = np.insert(kept, np.concatenate([[0], np.cumsum(sizes[~held])]), END)
                kinds = classes[line].astype(np.int64)
                total[:size // 2] += np.bincount(line[:-1] * CLASSES + kinds[1:], minlength=size // 2)
                total[size // 2:] += np.bincount(line[1:] * CLASSES + kinds[:-1], minlength=size // 2)
        padded = np.concatenate([total, np.zeros(-size % CELLS_PER_CHUNK, np.int64)]).reshape(-1, CELLS_PER_CHUNK)
        rows = [(c, np.flatnonzero(padded[c]).astype("<u2").tobytes(), padded[c][padded[c] > 0].astype("<i8").tobytes())
                for c in np.flatnonzero(padded.any(axis=1)).tolist()]
        yield batch(arrow("chunk int, cells binary, counts binary"), *(zip(*rows) if rows else [[]] * 3))

    parts = blocks.select("sizes", "held", "tokens", "words").mapInArrow(run, "chunk int, cells binary, counts binary")
    return gathered(parts, size).reshape(2, SLOTS, CLASSES)


def by_class(after, classes):
    """The class bigrams of a table of what follows each slot."""
    table = np.zeros((CLASSES, CLASSES))
    np.add.at(table, classes, after)
    return table


def exchanged(after, before, classes):
    """Classes after each slot, the most frequent first, went where the likelihood is greatest."""
    plogp = lambda x: x * np.log(np.maximum(x, 1e-12))
    classes, bigrams = classes.copy(), by_class(after, classes)
    after, before = after.astype(float), before.astype(float)
    counts = after.sum(axis=1)
    totals = bigrams.sum(axis=1)
    for slot in np.argsort(-counts, kind="stable"):
        if slot == END or not counts[slot]:
            continue
        own, r, l, n = classes[slot], after[slot], before[slot], counts[slot]
        bigrams[own] -= r
        bigrams[:, own] -= l
        np.maximum(bigrams, 0, out=bigrams)
        totals[own] -= n
        gain = (plogp(bigrams + r) - plogp(bigrams)).sum(axis=1) + (plogp(bigrams + l[:, None]) - plogp(bigrams)).sum(axis=0)
        gain -= 2 * (plogp(totals + n) - plogp(np.maximum(totals, 0)))
        gain[0] = -np.inf
        best = int(np.argmax(gain))
        classes[slot] = best
        bigrams[best] += r
        bigrams[:, best] += l
        totals[best] += n
    return classes


def moves_of(bigrams):
    """The smoothed probabilities of a class after another."""
    share = (bigrams.sum(axis=0) + ALPHA) / (bigrams.sum() + ALPHA * CLASSES)
    return (bigrams + ALPHA * CLASSES * share) / (bigrams.sum(axis=1, keepdims=True) + ALPHA * CLASSES)


def best_classes(after, before, own, bigrams):
    """The class of the greatest likelihood for words by what classes follow and precede them.

    A word's own part is taken out of the table where its present class is weighed.
    """
    n, moves, share = after.sum(axis=1), np.log(moves_of(bigrams)), (bigrams.sum(axis=0) + ALPHA) / (bigrams.sum() + ALPHA * CLASSES)
    totals = bigrams.sum(axis=1)
    gain = after @ moves.T + before @ moves - n[:, None] * np.log(totals + ALPHA)
    rows, columns = np.maximum(bigrams[own] - after, 0), np.maximum(bigrams[:, own].T - before, 0)
    left = np.maximum(totals[own] - n, 0)
    stay = (after * np.log((rows + ALPHA * CLASSES * share) / (left + ALPHA * CLASSES)[:, None])).sum(axis=1)
    stay += (before * np.log((columns + ALPHA * CLASSES * share[own][:, None]) / (totals + ALPHA * CLASSES))).sum(axis=1)
    gain[np.arange(len(own)), own] = stay - n * np.log(left + ALPHA)
    gain[:, 0] = -np.inf
    return np.where(n > 0, gain.argmax(axis=1), own).astype(np.uint8)


def dealt(words, slots, buckets):
    """The places of a block's words without a slot of their own, by bucket, and the buckets."""
    places = np.flatnonzero(~slots.own(words))
    of = (mix(words[places].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return places[order], of[order]


def kinds_and_counts(words, back, slots, classes, known, buckets):
    """The class and training count of each word of a block; `back` is what the buckets sent, if they have."""
    kinds, n = classes[slots(words)], np.zeros(len(words), np.int64)
    if back is not None:
        places, _ = dealt(words, slots, buckets)
        back = sorted(back, key=lambda r: r["bucket"])
        if len(places):
            kinds[places] = np.concatenate([np.frombuffer(r["kinds"], np.uint8) for r in back])
            n[places] = np.concatenate([unpacked(r["counts"], "<i8") for r in back])
    own = slots.own(words)
    n[own] = known[slots(words[own])]
    return kinds, n


def with_back(blocks: DataFrame, back) -> DataFrame:
    if back is None:
        return blocks.withColumn("back", F.lit(None).cast("array<struct<bucket:int,kinds:binary,counts:binary>>"))
    lists = back.groupBy(F.col("block").alias("of")).agg(F.collect_list(F.struct("bucket", "kinds", "counts")).alias("back"))
    return blocks.join(lists, F.col("block") == F.col("of"), "left").drop("of")


def line_of(one, i, words):
    """The training tokens of a block in a row, with end tokens, which stand behind the words, around texts."""
    sizes, held = (listed(one, c, i) for c in (0, 1))
    kept = tokens_of(one.column(2)[i].as_py())[np.repeat(~held, sizes)].astype(np.int64)
    return np.insert(kept, np.concatenate([[0], np.cumsum(sizes[~held])]), len(words))


def added_up(parts, size):
    """The sums of (cells, counts) as an array; it is walked once for HELD_CODES cells, not once for each part."""
    total, held, waiting = np.zeros(size), [], 0
    for i, part in enumerate(parts, 1):
        held.append(part)
        waiting += len(part[0])
        if waiting >= HELD_CODES or i == len(parts):
            cells, counts = (np.concatenate(x) for x in zip(*held))
            total += np.bincount(cells, counts, size)
            held, waiting = [], 0
    return total


def assigned(blocks: DataFrame, back, model, bigrams, buckets) -> DataFrame:
    """(block, bucket, kinds, counts, sizes): new classes and training counts of the words of blocks, in the order of :func:`dealt`.

    `sizes`, once for a bucket, are the numbers of its words by class and of their training tokens.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((model, bigrams))

    def send(batches):
        (slots, classes, known), _ = shared.value
        for one in batches:
            for i in range(one.num_rows):
                words = listed(one, 3, i)
                kinds, _ = kinds_and_counts(words, one.column(4)[i].as_py(), slots, classes, known, buckets)
                places, of = dealt(words, slots, buckets)
                line, kinds = line_of(one, i, words), np.append(kinds, 0)
                turn = np.full(len(words) + 1, -1)
                turn[places] = np.arange(len(places))
                codes = np.concatenate([(turn[line[:-1]] * 2 * CLASSES + kinds[line[1:]])[turn[line[:-1]] >= 0],
                                        (turn[line[1:]] * 2 * CLASSES + CLASSES + kinds[line[:-1]])[turn[line[1:]] >= 0]])
                codes, counts = np.unique(codes, return_counts=True)
                firsts = np.flatnonzero(np.diff(of, prepend=-1))
                ends = np.append(firsts[1:], len(of))
                spots = np.searchsorted(codes, np.append(firsts, len(of)) * 2 * CLASSES)
                rows = [(int(of[a]), one.column(5)[i].as_py(), words[places[a:b]].tobytes(), kinds[places[a:b]].astype(np.uint8).tobytes(),
                         packed(np.diff(codes[c:d] - a * 2 * CLASSES, prepend=0).astype("<u4")), packed(counts[c:d].astype("<u4")))
                        for a, b, c, d in zip(firsts.tolist(), ends.tolist(), spots[:-1].tolist(), spots[1:].tolist())]
                yield batch(arrow(SENT), *(zip(*rows) if rows else [[]] * 6))

    def total(rows):
        bigrams = shared.value[1]
        lists = [np.frombuffer(r["words"], np.int64) for r in rows]
        words, firsts, places = np.unique(np.concatenate(lists), return_index=True, return_inverse=True)
        own = np.concatenate([np.frombuffer(r["kinds"], np.uint8) for r in rows])[firsts]
        at, parts = 0, []
        for r, some in zip(rows, lists):
            codes = np.cumsum(unpacked(r["codes"]).astype(np.int64))
            parts.append((places[at + codes // (2 * CLASSES)] * 2 * CLASSES + codes % (2 * CLASSES), unpacked(r["counts"])))
            at += len(some)
        found = added_up(parts, len(words) * 2 * CLASSES)
        after, before = found.reshape(-1, 2, CLASSES).transpose(1, 0, 2)
        n = after.sum(axis=1).astype(np.int64)
        kinds = best_classes(after, before, own, bigrams)
        sizes = np.concatenate([np.bincount(kinds[n > 0], minlength=CLASSES), np.bincount(kinds, n, CLASSES).astype(np.int64)])
        ends = np.cumsum([0] + [len(some) for some in lists])
        parts = [places[a:b] for a, b in zip(ends[:-1], ends[1:])]
        return batch(arrow(BACK), [r["block"] for r in rows], [r["bucket"] for r in rows], [kinds[p].tobytes() for p in parts],
                     [packed(n[p].astype("<i8")) for p in parts], [sizes] + [None] * (len(rows) - 1))

    def receive(batches):
        held = []
        for one in batches:
            for r in one.to_pylist():
                if held and held[0]["bucket"] != r["bucket"]:
                    yield total(held)
                    held = []
                held.append(r)
        if held:
            yield total(held)

    sent = with_back(blocks, back).select("sizes", "held", "tokens", "words", "back", "block").mapInArrow(send, SENT)
    return pinned(sent.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(receive, BACK))


def transitions(blocks: DataFrame, back, model, buckets):
    """The class bigrams of the training texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        slots, classes, known = shared.value
        table = np.zeros(CLASSES * CLASSES, np.int64)
        for one in batches:
            for i in range(one.num_rows):
                words = listed(one, 3, i)
                kinds = np.append(kinds_and_counts(words, one.column(4)[i].as_py(), slots, classes, known, buckets)[0], 0)[line_of(one, i, words)].astype(np.int64)
                table += np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=len(table))
        cells = np.flatnonzero(table)
        yield batch(arrow("chunk int, cells binary, counts binary"), [0], [cells.astype("<u2").tobytes()], [table[cells].astype("<i8").tobytes()])

    parts = with_back(blocks, back).select("sizes", "held", "tokens", "words", "back").mapInArrow(run, "chunk int, cells binary, counts binary")
    return gathered(parts, CLASSES * CLASSES).reshape(CLASSES, CLASSES).astype(float)


def modelled(blocks: DataFrame, rounds=ROUNDS, own_rounds=OWN_ROUNDS):
    """(slots, classes, counts of the slots' own words), what buckets sent back, buckets, class bigrams, sizes of classes."""
    counts = pinned(counted(blocks))
    top = counts.orderBy(F.desc("n"), "word").limit(TOP_WORDS).collect()
    slots = Slots({r["word"]: i for i, r in enumerate(top)})
    classes = (np.arange(SLOTS) % (CLASSES - 1) + 1).astype(np.uint8)
    classes[END] = 0
    for _ in range(rounds):
        classes = exchanged(*neighbours(blocks, slots, classes), classes)
    bigrams = by_class(neighbours(blocks, slots, classes)[0], classes)
    model = slots, classes, np.array([r["n"] for r in top] + [0], np.int64)
    words = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    buckets = max(parallelism(blocks.sparkSession), words // BUCKET_WORDS)
    back = None
    for _ in range(own_rounds):
        earlier, back = back, assigned(blocks, back, model, bigrams, buckets)
        if earlier is not None:
            forgotten(blocks.sparkSession, earlier)
        bigrams = transitions(blocks, back, model, buckets)
    sizes = np.zeros((CLASSES, 2), np.int64)
    np.add.at(sizes, classes[:len(top)], [(1, r["n"]) for r in top] or np.zeros((0, 2), np.int64))
    for row in back.select(F.posexplode("sizes").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
        sizes[row["at"] % CLASSES, row["at"] // CLASSES] += row["n"]
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    return model, back, buckets, bigrams, sizes, sums["n"], sums["words"]


def scores(documents: DataFrame, rounds=ROUNDS) -> DataFrame:
    """Per document its number of tokens, of known ones, and its log10 probability by the unigram and the class model."""
    blocks = laid_out(blocks_of(documents))
    texts = blocks.select(F.explode("held").alias("held")).filter("not held").count()
    model, back, buckets, bigrams, sizes, train_tokens, distinct = modelled(blocks, rounds)
    train_tokens, distinct = train_tokens + texts, distinct + (texts > 0)
    sizes[0] += (int(texts > 0), texts)
    below = sizes[:, 1] + DELTA * (sizes[:, 0] + 1)
    shared = documents.sparkSession.sparkContext.broadcast((model, np.log10(moves_of(bigrams)), below))

    def run(batches):
        (slots, classes, known), moves, below = shared.value
        whole = train_tokens + DELTA * (distinct + 1)
        for one in batches:
            for i in range(one.num_rows):
                sizes, words = (listed(one, c, i) for c in (1, 4))
                kinds, n = kinds_and_counts(words, one.column(5)[i].as_py(), slots, classes, known, buckets)
                n = np.append(n, texts)  # the end token stands last
                kinds = np.append(kinds, 0).astype(np.int64)
                base = np.log10((n + DELTA) / whole)
                emit = np.log10((n + DELTA) / below[kinds])
                tokens = tokens_of(one.column(3)[i].as_py())
                line = np.insert(tokens.astype(np.int64), np.cumsum(sizes), len(words))
                turn = kinds[line]
                steps = moves[np.concatenate([[0], turn[:-1]]), turn]
                starts = np.cumsum(sizes + 1) - (sizes + 1)
                total = lambda x: np.add.reduceat(x, starts)
                score, count = total(emit[line] + steps), sizes + 1
                yield batch(arrow(SCORES), one.column(0)[i].values, one.column(2)[i].values, count, total((n > 0)[line].astype(np.int64)), np.full(len(sizes), train_tokens),
                            total(base[line]), score, 10 ** (-score / count))

    return with_back(blocks, back).select("doc_ids", "sizes", "held", "tokens", "words", "back").mapInArrow(run, SCORES)


@query()
def op2_class_model(spark, sf_dir):
    """The scores of every document."""
    return scores(table(spark, sf_dir, "documents"))
