"""Token ids of whole texts from a public byte-level tokenizer file.

A text is cut before every blank that a visible ASCII character or Latin letter follows. The
tokenizer's own pre-tokenization always has a border there, so the pieces encode to
the same ids as the whole text. Most pieces are letters and the marks behind them, with
another border between the two: Arrow kernels take them apart, letters are looked up once
whatever follows them, and the ids of frequent ones are remembered.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
ID_TYPE = np.dtype("<u2")  # of the default vocabulary: 50,257 ids
KEPT_WORDS, KEPT_PIECES = 250_000, 25_000
KEPT_LENGTH = 64
KEPT_TAILS = 20_000
CUT = re.compile(r" (?=[!-~\u00a1-\u02ff])")
# A blank and another white space: no border where there is one of these.
WHITE_PAIRS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x85", " \xa0")
# The published pre-tokenization of the vocabulary, used on pieces of these characters only;
# the model alone then gives their ids, at half the cost.
LATIN = re.compile(r"[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Letters and what marks follow them, of the same characters.
LETTERS = r"^(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]{1,64})(?P<marks>[!-/:-@\[-`{-~]{0,16})$"
# Byte-level vocabularies show a byte as a visible character: itself, or one from U+0100 on.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
VISIBLE = {b: 256 + i for i, b in enumerate(HIDDEN)}


def is_simple(text):
    """Whether every blank of a text is a border."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(pair in text for pair in WHITE_PAIRS)


def vocabulary_path(name=VOCABULARY):
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered:
    """A map of bounded size: what has not been asked for while `limit` others came in is forgotten."""

    def __init__(self, limit):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, keys):
        found = list(map(self.young.get, keys))
        if self.old:
            for i, ids in enumerate(found):
                if ids is None and (ids := self.old.get(keys[i])) is not None:
                    found[i] = self.young[keys[i]] = ids
        return found

    def add(self, pairs):
        self.young.update(pairs)
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young


class Encoder:
    """Encodes texts to little-endian bytes of ids; remembers 2 x KEPT_WORDS words and 2 x KEPT_PIECES other pieces at most."""

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.tokenizer.get_vocab_size() > np.iinfo(ID_TYPE).max:
            raise ValueError("the record format holds ids below 65,536")
        self.model = Tokenizer(self.tokenizer.model)  # without its pre-tokenization
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])
        self.tails = {}
        # Without the blank they begin with.
        self.known, self.known_words = Remembered(KEPT_PIECES), Remembered(KEPT_WORDS)

    def tail(self, word):
        """The ids of one pre-token."""
        ids = self.tails.get(word)
        if ids is None:
            shown = word.encode().decode("latin-1").translate(VISIBLE)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], ID_TYPE).tobytes()
            if len(self.tails) < KEPT_TAILS:
                self.tails[word] = ids
        return ids

    def words(self, words):
        """The ids of words of letters, each with a blank in front, as a list.

        Only the first token of such a word shows the blank, which tells the words apart.
        """
        shown = ["\u0120" + (w if w.isascii() else w.encode().decode("latin-1").translate(VISIBLE)) for w in words]
        out = []
        for start in range(0, len(shown), 10_000):
            ids = np.array(self.model.encode_batch_fast([shown[start:start + 10_000]], is_pretokenized=True, add_special_tokens=False)[0].ids, ID_TYPE)
            cuts = (2 * np.flatnonzero(self.begins[ids])).tolist() + [2 * len(ids)]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def ids_of(self, pieces, blank=True):
        """A map from each of the pieces to its ids, with a blank in front of each or none."""
        found, other, plain = {}, [], {}
        for p in pieces:
            if len(p) > KEPT_LENGTH or not LATIN.fullmatch(p):
                other.append(p)
            elif blank and p.isalpha():
                plain[p] = p, b""
            else:
                first, *rest = WORD.findall(" " + p if blank else p)
                if blank and first[1:].isalpha():
                    plain[p] = first[1:], b"".join(map(self.tail, rest))
                else:
                    found[p] = b"".join(map(self.tail, [first, *rest]))
        if plain:
            found.update((p, ids + tail) for (p, (_, tail)), ids in zip(plain.items(), self.words([w for w, _ in plain.values()])))
        for start in range(0, len(other), 20_000):
            part = other[start:start + 20_000]
            whole = [" " + p for p in part] if blank else part
            for p, e in zip(part, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)):
                found[p] = np.array(e.ids, ID_TYPE).tobytes()
        return found

    def looked_up(self, pieces, known, make, counts=None):
        """The ids of distinct pieces as a list; `known` remembers them, with `counts` those that came more than once."""
        ids = known.get(pieces)
        spots = [i for i, x in enumerate(ids) if x is None]
        fresh = [pieces[i] for i in spots]
        for i, x in zip(spots, make(fresh) if fresh else []):
            ids[i] = x
        known.add((pieces[i], ids[i]) for i in spots if counts is None or (counts[i] > 1 and len(pieces[i]) < KEPT_LENGTH))
        return ids

    def others(self, pieces):
        found = self.ids_of(pieces)
        return [found[p] for p in pieces]

    def found(self, pieces, counts):
        """The ids of an Arrow array of distinct pieces, with a blank in front of each, as an Arrow array."""
        parts = pc.extract_regex(pieces, LETTERS)
        spots, rest = np.flatnonzero(pc.is_valid(parts).to_numpy(zero_copy_only=False)), np.flatnonzero(pc.is_null(parts).to_numpy(zero_copy_only=False))
        some = parts.take(pa.array(spots))
        letters, marks = (some.field(i).dictionary_encode() for i in range(2))
        heads = pa.array(self.looked_up(letters.dictionary.to_pylist(), self.known_words, self.words), pa.large_binary())
        tails = pa.array([self.tail(m) if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary())
        whole = pc.binary_join_element_wise(heads.take(letters.indices), tails.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        other = pa.array(self.looked_up(pieces.take(pa.array(rest)).to_pylist(), self.known, self.others, counts[rest]), pa.large_binary())
        place = np.empty(len(pieces), np.int64)
        place[spots], place[rest] = np.arange(len(spots)), len(spots) + np.arange(len(rest))
        return pa.concat_arrays([whole, other]).take(pa.array(place))

    def encode_all(self, texts):
        """The ids of each text, as bytes; none of an empty one or a null.

        Arrow splits the texts, tells the distinct pieces and puts their ids in place, so
        Python meets a piece once per call.
        """
        distinct = dict.fromkeys(texts)
        if len(distinct) < len(texts):
            distinct = dict(zip(distinct, self.encode_all(list(distinct))))
            return [distinct[t] for t in texts]
        simple = [is_simple(t) if t else False for t in texts]
        cut = pc.split_pattern(pa.array([t if s else None for t, s in zip(texts, simple)], pa.large_string()), " ")
        others = [None if s or not t else CUT.split(t) for t, s in zip(texts, simple)]
        pieces = cut.flatten()
        flat = pa.concat_arrays([pieces, pa.array([p for o in others if o for p in o], pa.large_string())])
        counts = pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)
        ends, extra = np.cumsum(counts), len(pieces)
        coded = flat.dictionary_encode()
        placed = self.found(coded.dictionary, np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))).take(coded.indices)
        offsets = np.frombuffer(placed.buffers()[1], np.int64)[placed.offset:placed.offset + len(placed) + 1]
        data = placed.buffers()[2].to_pybytes() if len(placed) else b""
        firsts = [t.partition(" ")[0] if s else o[0] if o else "" for t, s, o in zip(texts, simple, others)]
        head = self.ids_of({f for f in firsts if f}, blank=False)
        out = []
        for i, first in enumerate(firsts):
            end, count = (int(ends[i]), int(counts[i])) if simple[i] else (extra, 0)
            if others[i]:
                count = len(others[i])
                extra = end = extra + count
            out.append(head.get(first, b"") + data[offsets[end - count + 1]:offsets[end]] if count else b"")
        return out

    def decode(self, ids):
        return self.tokenizer.decode(list(ids), skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path) -> Encoder:
    """One per Python worker."""
    return Encoder(path)
