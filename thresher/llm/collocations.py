"""Collocations of a corpus, counted over a prefix-free parse instead of over the texts.

A text is a row of words with a mark between pieces. Where the hash of two words in a
row is divisible by EVERY a chunk begins; it goes on to the beginning of the next one
and over as many words more as the longest phrase needs, so chunks overlap and every phrase
lies whole in one of them. Cuts depend on the words alone: what texts share falls into
the same chunks. The dictionary holds each chunk once with its frequency in the parse.
Phrases are counted inside the distinct chunks and weighed; one that begins in the overlap
belongs to the next chunk, so none is counted twice.

Most phrases are rare, and only those that occur LEAST times matter. So blocks of the dictionary
first send the 32-bit hash and the capped weight of each of their phrases to the part of the
hash range it belongs to; the part answers with one bit a phrase. Only phrases that may be
frequent are then written out as text and summed exactly: a false bit costs a row, no result.
The number of parts follows the size of the dictionary.

A null text is empty, a null language is `und`; texts without words give nothing, nor
does an empty table. Repeated rows count as often as they occur. A very long text is
many chunks; a stretch without cuts is one chunk. Ties are settled by the stated orders down to
the phrase, which is unique. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import STEP, arrow, batch, mix, slices
from thresher.operators.ordering import top_per_group
from thresher.session import pinned

LEAST = 10
LONGEST = 3
CONTAINED_PERCENT = 50
FIRST = 2_000
SCORE_SCALE = 1_000_000
# Words of a chunk, about.
EVERY = 24
# Bytes of text that are worked on at a time, in a block of the dictionary and in a batch of texts.
BLOCK_BYTES = 8 << 20
# Phrases that one part of the hash range counts, at most (copies in several blocks count each).
PART_PHRASES = 4_000_000
# Rows that are handed on at a time.
ROWS = 100_000
BREAK, END = b"\n", b"\t"
# Capital letters fall, marks between pieces become one sign, a tab is a blank.
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" ")
CHUNKS = "lang string, chunk binary, tail int"
BLOCKS = "block long, lang string, tokens long, words long, size long, text binary, tails binary, weights binary"
SENT = "part long, block long, hashes binary, weights binary"
ANSWERS = "block long, part long, bits binary"
PHRASES = "lang string, phrase string, size int, n long"


def word_codes(words):
    """(codes, distinct words, their hashes) of an Arrow array of words."""
    coded = words.dictionary_encode()
    known = coded.dictionary
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known.to_pylist()), np.uint64, len(known))
    return coded.indices.to_numpy(), known, hashes


def ranges(starts, lengths):
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def parsed(documents: DataFrame, text, lang, overlap) -> DataFrame:
    """(lang, chunk, tail) of every chunk of the parse; `tail` words at its end belong to the next one."""

    def run(batches):
        schema = arrow(CHUNKS)
        for one in slices(batches, 500):
            texts = [(x or b"").translate(NORMAL).replace(BREAK, b" " + BREAK + b" ") for x in one.column(0).cast(pa.binary()).to_pylist()]
            sizes = np.cumsum([len(x) for x in texts])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK_BYTES)) + 1).tolist(), len(texts)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                yield chunks_of(schema, texts[low:high], one.column(1).slice(low, high - low))

    def chunks_of(schema, texts, langs):
        split = pc.split_pattern(pa.array(texts, pa.binary()), pattern=" ")
        words = split.values
        full = pc.greater(pc.binary_length(words), 0)
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
        codes, known, hashes = word_codes(words.filter(full))
        if not len(codes):
            return batch(schema, [], [], [])
        hashed = hashes[codes]
        begins = np.zeros(len(codes), bool)
        begins[:-1] = mix(hashed[:-1] * STEP + hashed[1:]) % np.uint64(EVERY) == 0
        lengths = np.diff(ends)
        of = np.repeat(np.arange(len(lengths)), lengths)
        last = ends[1:][of]  # where the text ends
        spots = np.arange(len(codes))
        begins &= spots + overlap <= last  # what is left of the text holds the overlap
        begins[ends[:-1][lengths > 0]] = True
        starts = np.flatnonzero(begins)
        nexts = np.append(starts[1:], len(codes))
        final = nexts >= last[starts]
        stops = np.where(final, last[starts], nexts + overlap)
        taken = pa.DictionaryArray.from_arrays(pa.array(codes[ranges(starts, stops - starts)]), known).dictionary_decode()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stops - starts)]), pa.int32()), taken)
        return batch(schema, langs.take(pa.array(of[starts])), pc.binary_join(lists, pa.scalar(b" ", pa.binary())), np.where(final, 0, overlap).astype(np.int32))

    source = documents.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    return source.mapInArrow(run, CHUNKS)


def blocks_of(dictionary: DataFrame) -> DataFrame:
    """The dictionary (lang, chunk, tail, n) packed into blocks of one language each."""

    def pack(lang, rows, number):
        chunks, tails, weights = zip(*rows)
        joined = (b" " + END + b" ").join(chunks)
        counts = np.array([1 + c.count(b" ") for c in chunks])
        owned = np.array([1 + c.count(b" ") - c.split(b" ").count(BREAK) for c in chunks])
        over = np.array([sum(w != BREAK for w in c.rsplit(b" ", t)[-t:]) if t else 0 for c, t in zip(chunks, tails)])
        words = int((np.array(weights, np.int64) * (owned - over)).sum())
        return batch(arrow(BLOCKS), [number], [lang], [int(counts.sum())], [words], [len(joined)], [pa.compress(joined, "zstd", asbytes=True)],
                     [np.array(tails, np.int32).tobytes()], [np.array(weights, np.int64).tobytes()])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, sizes = {}, {}
        for one in slices(batches, 5_000):
            for lang, chunk, tail, n in zip(*(c.to_pylist() for c in one.columns)):
                held.setdefault(lang, []).append((chunk, tail, n))
                sizes[lang] = sizes.get(lang, 0) + len(chunk) + 3
                full = lang if sizes[lang] >= BLOCK_BYTES else max(sizes, key=sizes.get) if len(sizes) > 1 and sum(sizes.values()) >= 2 * BLOCK_BYTES else None
                if full is not None:
                    yield pack(full, held.pop(full), number)
                    sizes.pop(full)
                    number += 1
        for lang, rows in held.items():
            yield pack(lang, rows, number)
            number += 1

    return dictionary.select("lang", "chunk", "tail", "n").mapInArrow(run, BLOCKS)


def phrases_in(row, longest, parts):
    """The distinct phrases of a block, sorted by part and hash: (distinct words, size, [codes by place], weights, parts, hashes), one of each size."""
    text = pa.decompress(row["text"], row["size"], codec="zstd", asbytes=True)
    codes, known, hashes = word_codes(pc.split_pattern(pa.array([text], pa.binary()), pattern=" ").values)
    place = lambda w: pc.index(known, pa.scalar(w, pa.binary())).as_py()
    breaks, ends = codes == place(BREAK), codes == place(END)
    stops = np.append(np.flatnonzero(ends), len(codes))
    starts = np.concatenate([[0], stops[:-1] + 1])
    tails, weights = np.frombuffer(row["tails"], np.int32), np.frombuffer(row["weights"], np.int64)
    spots = np.arange(len(codes))
    of = np.cumsum(ends)
    fit = ~breaks & ~ends & (spots < (stops - tails)[of])
    is_word = np.append(~breaks & ~ends, np.zeros(longest, bool))
    seed = np.uint64(xxhash.xxh3_64_intdigest(row["lang"].encode()))
    ids, hashed, total = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64), 1
    for size in range(1, longest + 1):
        fit = fit & is_word[size - 1:size - 1 + len(codes)]
        where = np.flatnonzero(fit)
        following = codes[where + size - 1].astype(np.int64)
        keys, firsts, inverse = np.unique(ids[where] * len(known) + following, return_index=True, return_inverse=True)
        at = where[firsts]
        value = hashed[at] * STEP + hashes[codes[at + size - 1]]
        counts = np.bincount(inverse, weights[of[where]], minlength=len(keys)).astype(np.int64)  # exact below 2 ** 53
        ids, hashed = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64)
        ids[where], hashed[where] = inverse, value[inverse]
        found = mix(value + seed + np.uint64(size))
        part = (found >> np.uint64(32)).astype(np.int64) % parts
        low = found.astype(np.uint32)
        order = np.lexsort((low, part))
        yield known, size, [codes[at[order] + i] for i in range(size)], counts[order], part[order], low[order]


def sent(blocks: DataFrame, longest, least, parts) -> DataFrame:
    """What each block sends to each part: hashes and capped weights of its phrases of all sizes."""
    kind = np.uint8 if least < 256 else np.int64

    def run(batches):
        schema = arrow(SENT)
        for one in slices(batches, 1):
            for row in one.to_pylist():
                sizes = [(part, low, np.minimum(counts, least).astype(kind)) for _, _, _, counts, part, low in phrases_in(row, longest, parts)]
                every = np.unique(np.concatenate([part for part, _, _ in sizes]))
                edges = [(np.searchsorted(part, every), np.searchsorted(part, every, "right")) for part, _, _ in sizes]
                for start in range(0, len(every), 1_000):
                    spots = range(start, min(start + 1_000, len(every)))
                    joined = lambda k: [b"".join(size[k][lows[i]:highs[i]].tobytes() for size, (lows, highs) in zip(sizes, edges)) for i in spots]
                    yield batch(schema, every[start:start + 1_000], np.full(len(spots), row["block"]), joined(1), joined(2))

    return blocks.select(*[f.name for f in arrow(BLOCKS)]).mapInArrow(run, SENT)


def answered(sends: DataFrame, least) -> DataFrame:
    """One bit for each hash that was sent: whether its weights may add up to `least`."""
    kind = np.uint8 if least < 256 else np.int64

    def answer(part, rows):
        hashes = [np.frombuffer(h, np.uint32) for _, h, _ in rows]
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        enough = np.bincount(inverse, np.concatenate([np.frombuffer(w, kind) for _, _, w in rows])) >= least
        told = np.split(enough[inverse], np.cumsum([len(h) for h in hashes])[:-1])
        return batch(arrow(ANSWERS), [b for b, _, _ in rows], [part] * len(rows), [np.packbits(x).tobytes() for x in told])

    def run(batches):
        current, rows = None, []
        for one in slices(batches, 100):
            for part, *row in zip(*(c.to_pylist() for c in one.columns)):
                if part != current and rows:
                    yield answer(current, rows)
                    rows = []
                current = part
                rows.append(row)
        if rows:
            yield answer(current, rows)

    return sends.repartition("part").sortWithinPartitions("part", "block").mapInArrow(run, ANSWERS)


def written_out(blocks: DataFrame, answers: DataFrame, longest, parts) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of each block that may be frequent."""
    names = [f.name for f in arrow(BLOCKS)]

    def texts(row, bits):
        """`bits` holds, by part, the answers for all sizes one after the other."""
        schema = arrow(PHRASES)
        used = {}
        for known, size, codes, counts, part, _ in phrases_in(row, longest, parts):
            keep = np.zeros(len(part), bool)
            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, int)
            for low, high in zip(begins, np.append(begins[1:], len(part))):
                p = int(part[low])
                start = used.get(p, 0)
                keep[low:high] = np.unpackbits(np.frombuffer(bits[p], np.uint8), count=start + high - low)[start:]
                used[p] = start + high - low
            spots = np.flatnonzero(keep)
            for start in range(0, len(spots), ROWS):
                some = spots[start:start + ROWS]
                words = [known.take(pa.array(c[some])) for c in codes]
                joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if size > 1 else words[0]
                yield batch(schema, pa.array([row["lang"]] * len(some), pa.string()), joined.cast(pa.string()), np.full(len(some), size, np.int32), counts[some])

    def run(batches):
        row, bits = None, {}
        for one in slices(batches, 50):
            for found in one.to_pylist():
                if found["text"] is not None:
                    if row is not None:
                        yield from texts(row, bits)
                    row, bits = found, {}
                else:
                    bits[found["part"]] = found["bits"]
        if row is not None:
            yield from texts(row, bits)

    both = blocks.select(*names).unionByName(answers, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("text").isNull(), "part").mapInArrow(run, PHRASES)


def frequencies(documents: DataFrame, text="text", lang="lang", longest=LONGEST, least=LEAST):
    """(phrases, totals): (lang, phrase, size, n) of all phrases that occur `least` times, and (lang, n_words)."""
    dictionary = parsed(documents, text, lang, longest - 1).groupBy("lang", "chunk", "tail").agg(F.count(F.lit(1)).alias("n"))
    blocks = pinned(blocks_of(dictionary))
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, -(-tokens * longest // PART_PHRASES))
    answers = answered(sent(blocks, longest, least, parts), least)
    summed = written_out(blocks, answers, longest, parts).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    totals = blocks.groupBy("lang").agg(F.sum("words").alias("n_words"))
    return pinned(summed.filter(F.col("n") >= least)), totals


def collocations(documents: DataFrame, text="text", lang="lang", longest=LONGEST, least=LEAST, first=FIRST, percent=CONTAINED_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases of each language.

    A phrase is scored by its least convincing cut into two parts, SCORE_SCALE a² / (l r). Phrases
    that a longer one holds in at least `percent` of their occurrences are left out.
    """
    known, totals = frequencies(documents, text, lang, longest, least)
    several = known.filter(F.col("size") > 1).withColumn("words", F.split("phrase", " ", -1))
    piece = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = several.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    of = lambda name: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    for name, part in (("l", "head"), ("r", "rest")):
        cuts = cuts.join(of(name), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(part) == F.col(f"{name}_phrase")))
    exact = F.expr(f"(cast({SCORE_SCALE} as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    scores = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    length = F.explode(F.sequence(F.lit(2), F.col("size") - 1))
    inner = several.filter(F.col("size") > 2).select("lang", "n", "words", "size", length.alias("length")).select(
        "lang", "n", "words", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("start"))
    held = inner.select(F.col("lang").alias("in_lang"), piece(F.col("start"), F.col("length")).alias("part"), "n").groupBy("in_lang", "part").agg(F.max("n").alias("most"))
    free = scores.join(held, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    kept = free.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = top_per_group(kept, first, ["-score", "-a", "phrase"], ["lang"], rank="rank")
    return best.join(totals.withColumnRenamed("lang", "of_lang"), F.col("lang") == F.col("of_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_words").alias("n"), "score")


SQL = r"""
WITH pieces AS (
  SELECT doc, lang, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
      regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
words AS MATERIALIZED (SELECT doc, lang, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
starts AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc, p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, w1 AS phrase, 1 AS size, count(*) AS n FROM starts GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM starts WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM starts WHERE w3 IS NOT NULL GROUP BY ALL),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND n >= 10),
named AS MATERIALIZED (SELECT lang || chr(9) || phrase AS name, n FROM f WHERE n >= 10),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, k, lang || chr(9) || array_to_string(ws[1:k], ' ') AS head, lang || chr(9) || array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT lang, phrase, n AS a, ws, unnest(range(1, size)) AS k FROM candidates)),
headed AS MATERIALIZED (SELECT c.*, x.n AS l FROM cuts c JOIN named x ON x.name = c.head),
scored AS (
  SELECT c.lang, c.phrase, a, k, l, y.n AS r, (1000000::HUGEINT * a * a) // (l::HUGEINT * y.n) AS score FROM headed c JOIN named y ON y.name = c.rest),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, part, max(n) AS most FROM (
    SELECT lang, n, ws[1] || ' ' || ws[2] AS part FROM candidates WHERE size = 3 UNION ALL SELECT lang, n, ws[2] || ' ' || ws[3] FROM candidates WHERE size = 3)
  GROUP BY ALL),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM least l LEFT JOIN held h ON h.lang = l.lang AND h.part = l.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t ON t.lang = r.lang WHERE rank <= 2000
"""


@query(SQL)
def op12_collocations(spark, sf_dir):
    """The first 2,000 collocations of each language."""
    return collocations(table(spark, sf_dir, "documents"))
