"""Conversations as token ids with a loss mask, spliced from segments encoded apart.

A turn is  START role SEP text END  where the capitals are reserved ids beyond the
vocabulary, so no text can contain them; as strings they are the MARKS below. Roles and
texts are encoded one by one and can therefore not merge with a mark. In the string form,
control strings inside a text are broken by an escape after their first character, and
escapes themselves are doubled, so texts come back exactly.

The mask is the running sum of +1 at the start of an assistant's text and -1 after the
END that closes it: a model learns the text and to stop.

Turns are streamed in order, one conversation held at a time. Null roles and texts are
empty; a null conv_id is one conversation; repeated turns stand side by side, ordered by
role and text; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.llm.texts import arrow, batch
from thresher.llm.tokens import ID_TYPE, encoder, vocabulary_path

# Reserved ids after the 50,257 of the vocabulary, and the strings they stand for.
START, SEP, END = 50257, 50258, 50259
MARKS = {START: "<|im_start|>", SEP: "<|im_sep|>", END: "<|im_end|>"}
CONTROL = (*MARKS.values(), "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
LEARNT_ROLE = "assistant"
CONTROLS = re.compile("|".join(re.escape(c) for c in CONTROL))
FORMATTED = "conv_id long, formatted string, ids binary, mask binary"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
           "n_tokens long, n_loss_tokens long")
PROBE = -7


def escape(text):
    return CONTROLS.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text):
    return re.sub(r"\\(\\?)", r"\1", text)


def assembled(turns, encode):
    """(formatted string, ids, mask) of the (role, text) pairs of a conversation."""
    segments = [escape(s) for turn in turns for s in turn]
    coded = [np.frombuffer(ids, ID_TYPE) for ids in encode(segments)]
    parts, steps, at = [], [], 0
    mark = lambda i: np.array([i], ID_TYPE)
    for (role, _), role_ids, text_ids in zip(turns, coded[::2], coded[1::2]):
        parts += [mark(START), role_ids, mark(SEP), text_ids, mark(END)]
        begin = at + len(role_ids) + 2
        at = begin + len(text_ids) + 1
        if role == LEARNT_ROLE:
            steps += [(begin, 1), (at, -1)]
    delta = np.zeros(at + 1, np.int64)
    for place, step in steps:
        delta[place] += step
    shown = "".join(MARKS[START] + r + MARKS[SEP] + t + MARKS[END] for r, t in zip(segments[::2], segments[1::2]))
    return shown, np.concatenate(parts), np.cumsum(delta)[:at].astype(np.uint8)


def format_chats(conversations: DataFrame, vocabulary=None) -> DataFrame:
    """One row per conversation: its string, its ids (2 bytes each) and its mask (1 byte each)."""
    vocabulary = vocabulary or vocabulary_path()

    def rows_of(batches):
        for one in batches:
            yield from zip(*(one.column(i).to_pylist() for i in range(3)))

    def run(batches):
        schema, encode, out = arrow(FORMATTED), encoder(vocabulary).encode_all, []
        for conv_id, turns in itertools.groupby(rows_of(batches), lambda r: r[0]):
            shown, ids, mask = assembled([(role or "", text or "") for _, role, text in turns], encode)
            out.append((conv_id, shown, ids.tobytes(), mask.tobytes()))
            if len(out) == 200:
                yield batch(schema, *zip(*out))
                out = []
        if out:
            yield batch(schema, *zip(*out))

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def read_turns(ids, mask, decode):
    """The (role, text, learnt text or None) of each turn, from ids and mask alone."""
    ids, mask = np.frombuffer(ids, ID_TYPE), np.frombuffer(mask, np.uint8)
    turns = []
    for start in np.flatnonzero(ids == START):
        sep = start + int(np.argmax(ids[start:] == SEP))
        end = sep + int(np.argmax(ids[sep:] == END))
        words = ids[sep + 1:end]
        learnt = words[mask[sep + 1:end] > 0]
        turns.append((unescape(decode(ids[start + 1:sep].tolist())), unescape(decode(words.tolist())),
                      unescape(decode(learnt.tolist())) if mask[end] else None))
    return turns


def read_back(formatted: DataFrame, vocabulary=None) -> DataFrame:
    """What a reader finds in the ids and masks, as counts and digests."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        schema, decode = arrow(DIGESTS), encoder(vocabulary).decode
        for one in batches:
            rows = []
            for conv_id, shown, ids, mask in zip(*(one.column(i).to_pylist() for i in range(4))):
                turns = read_turns(ids, mask, decode)
                told, learnt = hashlib.sha256(), "".join(t[2] for t in turns if t[2] is not None)
                for role, text, _ in turns:
                    told.update(f"{role}\n{text}\n".encode())
                rows.append((conv_id, len(turns), told.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(shown),
                             len(ids) // 2, int(np.frombuffer(mask, np.uint8).sum())))
            yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    return formatted.select("conv_id", "formatted", "ids", "mask").mapInArrow(run, DIGESTS)


@query()
def op6_chat_assembly(spark, sf_dir):
    """All conversations, and one made of control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(PROBE, 0, "user", text), (PROBE, 1, LEARNT_ROLE, text)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(given.unionByName(probe)))
