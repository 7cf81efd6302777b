"""Plain, slow versions of the operators, for small tables."""

import collections
import hashlib
import html
import math
import re
import zlib


def words(text):
    return (text or "").encode().lower().split()


def grams(text, size):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def overlap_components(documents, size=4, percent=85):
    """{doc_id: (set size, least linked doc_id)}; doc_ids are unique."""
    sets = {i: grams(t, size) for i, t in documents}
    by_gram, shared, groups = collections.defaultdict(list), collections.Counter(), Groups()
    for i, s in sets.items():
        for g in s:
            by_gram[g].append(i)
    for ids in by_gram.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def base_scores(documents):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in documents}
    counts, ends = collections.Counter(), 0
    for i, t in documents:
        if not held[i]:
            counts.update(words(t))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + (ends > 0)
    p = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    return {i: (held[i], len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + (ends > 0), total, sum(p(counts[w]) for w in words(t)) + p(ends))
            for i, t in documents}


def long_repeats(documents, size):
    """{doc_id: places of words that stand in a run of `size` words another document has too}."""
    owners = collections.defaultdict(set)
    for i, t in documents:
        w = words(t)
        for a in range(len(w) - size + 1):
            owners[tuple(w[a:a + size])].add(i)
    found = {}
    for i, t in documents:
        w = words(t)
        found[i] = {a + k for a in range(len(w) - size + 1) if len(owners[tuple(w[a:a + size])]) > 1 for k in range(size)}
    return found


def article(source):
    inside = source[source.index("<article>") + 9:source.index("</article>")]
    inside = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inside))
    return " ".join(html.unescape(inside).split())


def chat_digests(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) pairs."""
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(told), len(learnt), sha(learnt)


def token_ids(texts):
    from tokenizers import Tokenizer

    from thresher.llm.tokens import END_ID, vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
