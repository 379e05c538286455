"""Language-model scores from a causal self-attention model over subword ids and corpus counts.

Texts are words (ASCII white space parts them, A-Z lower-cased) and an end. A word is a string of
subword ids of a public tokenizer, of which the first is its head. A causal attention head reads
every id; at each id it gives the chance of what follows inside the word (a class of ids, or the
word's end), and, where a word ends, that of the next word's head class:

    P(word | before) = P(k | before) * ((c - D)+ / C_k + D * V_k / C_k * spelling(word | k, before))

k is the class of the word's head, c the word's count over all training texts, C_k and V_k the
tokens and distinct words of the class, D the absolute discount n1 / (n1 + 2 n2). ``spelling`` is
the head's share of its class, times the attention's chances of the further ids and of the word's end,
each id by its share of its class. Both softmaxes are adaptive: frequent ids are classes of their
own, the others are grouped. A bias holds the class of the head before; what follows an id starts from counts over
distinct words. Each factor sums to one over what it chooses from.

1. One pass over all training texts counts words and, for each head, which heads (hashed to
   ``BUCKETS``) stand around it. Counts are added up in each task before the exchange. The same
   pass writes each text's ids, so that training neither splits nor tokenizes texts again.
2. The tokenizer runs over the counted words, not over the corpus; chains come from that table.
3. Embeddings are the main directions of counts: of a head's neighbours, and of the heads' classes of the words that an
   inner id is in; classes are groups of embeddings. Both come from the whole training corpus.
4. ``SAMPLE`` texts of at most ``SAMPLE_TOKENS`` give weights to start from. Then texts are dealt to shards of about
   ``SHARD_TOKENS`` by a hash of id and text, each shard trains these weights on every window of
   its texts in the order of the hash, and the shards' weights are averaged by tokens, in whole
   numbers. So neither the files' layout nor the order of tasks changes the model.
5. Scoring cuts each text's ids into windows of ``WINDOW`` that overlap by ``CONTEXT``; each id
   is scored once, in the window that shows it at least ``CONTEXT`` ids; windows of many texts
   form batches of masked attention. Tasks know the ``HOT`` most frequent words of at most
   ``HOT_BYTES``; the counts of all other words are joined by word. What a task remembers of words is bounded in
   words and in bytes, and so is each batch that it hands on.

What is broadcast has a fixed bound: tables over the tokenizer's ids, and the ``HOT`` words.

Defined results: null, empty and blank texts are one end token; rows that repeat an id are scored
each; a null id counts as remainder 0 (training); bytes that are not UTF-8 read as U+FFFD; very long
texts are scored whole, window by window; with no training texts all counts are 0 and the attention
model is uniform; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_arrow, crc_mod, materialize, read, small_batches

WINDOW, CONTEXT, WIDTH, CLASSES = 32, 8, 12, 48
NEW = WINDOW - CONTEXT
BEGIN, END = 0, 1  # classes of what stands before a text and of its end
ALONE = 16  # heads that are classes of their own
#: Hashes of neighbours that heads are described by, and the numbers of an id's embedding (the last three mark inner ids, BEGIN and END).
BUCKETS, EMBEDDED = 64, 24
#: Classes of the ids inside words: the word's end, frequent ids, and groups of the others.
TAILS, TAILS_ALONE, BACK = 48, 31, 2.0
SAMPLE, SAMPLE_TOKENS, HOT, HOT_BYTES, KEPT, COUNTED = 800, 1 << 14, 200_000, 64, 120_000, 400_000
#: Bytes of words that a task remembers, and of words in a batch.
KEPT_BYTES, SENT_BYTES = 24 << 20, 8 << 20
SHARD_TOKENS = 1 << 20
PARTS = (("q", (EMBEDDED, WIDTH)), ("k", (EMBEDDED, WIDTH)), ("v", (EMBEDDED, WIDTH)), ("pq", (NEW, WIDTH)), ("pk", (WINDOW - 1, WIDTH)), ("out", (WIDTH, CLASSES)), ("bias", (CLASSES, CLASSES)), ("tail", (WIDTH, TAILS)))
#: Weights are averaged as multiples of this.
GRAIN = 2.0**-30
#: Which keys (window places 0 to 30) a query (places 7 to 30) may see: none after its own.
MASK = np.where(np.arange(WINDOW - 1)[None, :] <= np.arange(CONTEXT - 1, WINDOW - 1)[:, None], 0.0, -1e9).astype(np.float32)


def normal_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


# --- the attention model; weights are a dict of float32 arrays, ids index rows of embeddings ``e``
def new_weights(pairs: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """``pairs``: counts of (class, next class), which the bias starts from."""
    random = np.random.Generator(np.random.PCG64(seed))
    w = {k: (random.normal(size=s) * 0.3).astype(np.float32) for k, s in PARTS}
    w["out"] *= 0.1
    w["tail"] *= 0.1
    share = pairs + 0.5 * (pairs.sum(axis=0) + 1) / (pairs.sum() + CLASSES)
    w["bias"] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
    w["bias"][:, BEGIN] = -30
    return w


def attend(w: dict, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple:
    """What each place CONTEXT.. gathers (a row of WIDTH), the queries, keys and attention that gave it, and the sums that attention is to be divided by."""
    q = q + w["pq"]
    q *= np.float32(WIDTH**-0.5)
    k = k + w["pk"]
    a = q @ k.transpose(0, 2, 1)
    a += MASK
    np.exp(a, out=a)
    z = (a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], a.dtype)).reshape(*a.shape[:2], 1)
    h = a @ v
    h /= z
    return h, q, k, a, z


def weights_of_classes(h: np.ndarray, out: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A softmax of what is gathered and of logits that are known, before its division: exponentials, and the sums to divide them by."""
    p = h @ out
    p += known
    if p.size and not p.max() <= 60:
        np.clip(p, np.float32(-1e9), np.float32(60), out=p)  # so that no sum of exponentials overflows; with a bound below, numpy's loop is faster
    np.exp(p, out=p)
    return p, p @ np.ones(p.shape[1], p.dtype)


def chances(h: np.ndarray, out: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Chances of classes."""
    p, sums = weights_of_classes(h, out, known)
    return p / sums[:, None]


@dataclass
class Tables:
    """What attention knows of ids, of begin and of end: embeddings, classes as heads and inside words (0 for heads), logits of what follows inside words."""

    e: np.ndarray
    kinds: np.ndarray
    tail_kinds: np.ndarray
    heads: np.ndarray  # whether an id begins a word, or is the end
    after: np.ndarray

    def events(self, x: np.ndarray, last: np.ndarray, live: np.ndarray) -> tuple:
        """Of windows: the places (flat) where a head follows, with the classes before and there; and for each place whether it follows an id, what it follows and the class inside the word."""
        y, before = x[:, CONTEXT:].reshape(-1), x[:, CONTEXT - 1 : -1].reshape(-1)
        own = live.reshape(-1)
        head = np.flatnonzero(self.heads.take(y) & own)
        return head, last[:, CONTEXT - 1 : -1].reshape(-1).take(head), self.kinds.take(y.take(head)), own & (before < len(self.e) - 2), before, self.tail_kinds.take(y)

    def logits_after(self, before: np.ndarray) -> np.ndarray:
        """Of what follows inside words. Nearly all places follow an id, so none is left out; those after a begin read some id's, which nobody uses."""
        return self.after.take(before, axis=0, mode="clip")


def derivatives(some: np.ndarray, out: np.ndarray, known: np.ndarray, own: np.ndarray, share) -> tuple:
    """Of the log likelihood of the classes ``own``, weighted by ``share``, by the logits; and the chances of ``own``."""
    p, sums = weights_of_classes(some, out, known)
    places = np.arange(0, p.size, p.shape[1]) + own
    flat = p.reshape(-1)
    chance = flat.take(places) / sums
    p *= (-share / sums)[:, None]
    flat[places] += share
    return p, chance


def gradients(w: dict, t: Tables, x: np.ndarray, last: np.ndarray, live: np.ndarray) -> tuple[dict, float]:
    """Of the log likelihood a place over the ``live`` (windows x NEW) places, and that. ``last``: the class of the head at or before each place."""
    seen = t.e.take(x[:, :-1], axis=0)
    flat = lambda z: z.reshape(-1, z.shape[-1])
    of = lambda z, m: (flat(z) @ m).reshape(*z.shape[:2], WIDTH)
    v, new = of(seen, w["v"]), np.ascontiguousarray(seen[:, CONTEXT - 1 :])
    h, q, k, a, total = attend(w, of(new, w["q"]), of(seen, w["k"]), v)
    head, was, y, inner, before, z = t.events(x, last, live)
    one, every = np.float32(1 / max(np.count_nonzero(live), 1)), flat(h)
    share = inner * one
    p, chance = derivatives(every, w["tail"], t.logits_after(before), z, share)
    grown, loss = {"tail": (p.T @ every).T}, float(np.log(chance + 1e-30) @ share)
    dh = p @ w["tail"].T
    order = np.argsort(was, kind="stable")
    head, was, y = head.take(order), was.take(order), y.take(order)
    some = every.take(head, axis=0)
    p, chance = derivatives(some, w["out"], w["bias"].take(was, axis=0), y, one)
    grown["out"], grown["bias"] = (p.T @ some).T, np.zeros_like(w["bias"])
    loss += float(np.log(chance + 1e-30).sum() * one)
    dh[head] = dh.take(head, axis=0) + p @ w["out"].T
    if len(head):
        first = np.flatnonzero(np.append(True, was[1:] != was[:-1]))
        grown["bias"][was.take(first)] = np.add.reduceat(p, first, axis=0)
    dh = dh.reshape(h.shape)
    mean = ((dh * h).reshape(-1, WIDTH) @ np.ones(WIDTH, h.dtype)).reshape(total.shape)  # of the derivatives by attention, weighted by it
    dh /= total
    ds = dh @ v.transpose(0, 2, 1)
    ds -= mean / total
    ds *= a
    dq = ds @ k
    dq *= np.float32(WIDTH**-0.5)
    dk = ds.transpose(0, 2, 1) @ q
    dv = a.transpose(0, 2, 1) @ dh
    return grown | {"q": flat(new).T @ flat(dq), "k": flat(seen).T @ flat(dk), "v": flat(seen).T @ flat(dv), "pq": dq.sum(axis=0), "pk": dk.sum(axis=0)}, loss


class Adam:
    """Steps of the weights ``w``, whose arrays become parts of one, so that a step runs over all of them at once."""

    def __init__(self, w: dict, rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.all = np.concatenate([x.ravel() for x in w.values()])
        cuts = np.cumsum([x.size for x in w.values()])[:-1]
        w.update({k: part.reshape(x.shape) for (k, x), part in zip(list(w.items()), np.split(self.all, cuts), strict=True)})
        self.m, self.v = np.zeros_like(self.all), np.zeros_like(self.all)

    def step(self, g: dict) -> None:
        self.t += 1
        x = np.concatenate([g[k].ravel() for k in self.w])
        self.m += 0.1 * (x - self.m)
        self.v += 0.01 * (x * x - self.v)
        self.all += (self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def windows(stream: np.ndarray, sizes: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of stacked texts' ids (ends included; begins stand before each), the class of the head at or before each place, and, for each window and new place, its index in ``stream`` or -1."""
    before = len(t.e) - 2
    every = np.arange(len(stream))
    heads = t.heads.take(stream)
    head = np.where(heads, every, 0)  # a text begins with a head, or is the end alone
    last = t.kinds.take(stream.take(np.maximum.accumulate(head))) if len(stream) else np.zeros(0, np.uint8)
    # each text lies in room for all its windows, which are stretches of that
    count = -(-sizes // NEW)
    room = CONTEXT + count * NEW
    begin = np.cumsum(room) - room
    place = every + np.repeat(begin + CONTEXT - (np.cumsum(sizes) - sizes), sizes)
    first = np.repeat(begin, count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * NEW

    def cut(values: np.ndarray, other: int, skipped: int = 0) -> np.ndarray:
        laid = np.full(int(room.sum()) + WINDOW, other, values.dtype)
        laid[place] = values
        return np.lib.stride_tricks.sliding_window_view(laid[skipped:], WINDOW - skipped)[first]

    return cut(stream, before), cut(last, BEGIN), cut(every, -1, CONTEXT)


class Subwords:
    """The public tokenizer. Ids are its own; ``size`` stands for a text's begin and ``size + 1`` for its end."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern

    def __getstate__(self) -> dict:
        return {"data": self.data, "pattern": self.pattern}

    @cached_property
    def tokenizer(self) -> tiktoken.Encoding:
        pairs = (x.split() for x in self.data.splitlines() if x)
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})

    @cached_property
    def size(self) -> int:
        return self.tokenizer.n_vocab

    @cached_property
    def spaced(self) -> np.ndarray:
        """Whether an id begins with a space, as a word's first id does and no other."""
        return np.array([self.tokenizer.decode_single_token_bytes(i)[:1] == b" " for i in range(self.size)])

    def ids(self, word: bytes) -> list[int]:
        return self.tokenizer.encode_ordinary(" " + word.decode())

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each word has. A call takes many words, as spaces part them in any case."""
        flat, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            ids = np.array(self.tokenizer.encode_ordinary(" " + b" ".join(some).decode()), np.int64)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some):
                flat.append(ids)
                n.append(np.diff(starts, append=len(ids)))
            else:  # spaces of other kinds within words
                each = [self.ids(w) for w in some]
                flat.append(np.fromiter(chain.from_iterable(each), np.int64))
                n.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(flat), np.concatenate(n)


@dataclass
class Model:
    """All that scoring needs, but for the words' counts."""

    subwords: Subwords
    kinds: np.ndarray  # class of each id as a head, of begin and of end
    embedded: np.ndarray  # a row for each of these
    discount: float
    tokens: np.ndarray  # by class: C_k, and the distinct words V_k
    distinct: np.ndarray
    head_share: np.ndarray  # of each id within its class, as a head
    tail_kinds: np.ndarray  # class of each id inside words; class 0 is the word's end
    tail_share: np.ndarray
    followed: tuple[np.ndarray, np.ndarray]  # the counts above 0 of (id, tail class): places and values
    weights: dict = field(default_factory=dict)

    @cached_property
    def known(self) -> Tables:
        """The tables of attention; the logits of what follows an id come from counts over distinct words."""
        size = self.subwords.size
        after = np.zeros(size * TAILS, np.float32)
        after[self.followed[0]] = self.followed[1]
        after = after.reshape(-1, TAILS)
        every = after.sum(axis=0) + np.float32(0.1)
        after += BACK * every / every.sum()
        after /= after.sum(axis=1, keepdims=True)
        heads = np.append(self.subwords.spaced, [False, True])
        tails = np.where(heads, 0, np.append(self.tail_kinds, [0, 0]))
        return Tables(self.embedded, self.kinds, tails, heads, np.log(after, out=after))

    @cached_property
    def log_tail_share(self) -> np.ndarray:
        """Log10 of an inner id's share of its class; 0 for a head, where a word has ended."""
        return np.where(self.known.heads, 0, np.log10(np.append(self.tail_share, [1, 1])))

    @cached_property
    def log_weight(self) -> np.ndarray:
        """By head id: log10 of the tokens that the class keeps for spelling, and of the head's share of it."""
        k = self.kinds[: self.subwords.size]
        return np.log10(np.where(self.tokens[k] > 0, self.discount * self.distinct[k], 1.0)) + np.log10(self.head_share)

    @cached_property
    def log_tokens(self) -> np.ndarray:
        return np.log10(np.maximum(self.tokens, 1))

    @cached_property
    def projected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(self.embedded @ self.weights[k] for k in "qkv")

    def log_chances(self, x: np.ndarray, last: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows of ids, log10 chances at each place CONTEXT..: of the head class (0 where no head is), and of what follows inside the word (0 after a begin)."""
        (q, k, v), t, w = self.projected, self.known, self.weights
        one, more = (np.ones((len(x), NEW), np.float32) for _ in range(2))
        for at in range(0, len(x), 128):
            some, own = x[at : at + 128], slice(at, at + 128)
            seen, new = some[:, :-1], some[:, CONTEXT - 1 : -1]
            h = attend(w, q.take(new, axis=0), k.take(seen, axis=0), v.take(seen, axis=0))[0].reshape(-1, WIDTH)
            head, was, y, inner, before, z = t.events(some, last[own], live[own])
            one[own].reshape(-1)[head] = self.chance(h.take(head, axis=0), "out", w["bias"].take(was, axis=0), y)
            np.copyto(more[own].reshape(-1), self.chance(h, "tail", t.logits_after(before), z), where=inner)
        return tuple(np.multiply(np.log(x, out=x), 1 / np.log(10), dtype=float) for x in (one, more))  # numpy has no fast log10

    def chance(self, h: np.ndarray, name: str, known: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The chances of the classes ``own``."""
        p, sums = weights_of_classes(h, self.weights[name], known)
        return p.reshape(-1).take(np.arange(0, p.size, p.shape[1]) + own) / sums + np.float32(1e-30)

    def scores(self, stream: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts' ids and the place of each token's head among them: log10 of its head class's chance, and of its spelling's chance times the tokens that stand for it (0 for an end)."""
        x, last, at = windows(stream, sizes, self.known)
        live = at >= 0
        one, more = self.log_chances(x, last, live)
        first, inner = np.zeros(len(stream)), np.zeros(len(stream) + 1)
        first[at[live]], inner[at[live]] = one[live], more[live]
        inner[:-1] += self.log_tail_share[stream]
        # what follows a token's head: its other ids, and its end, which stands at the next token's head
        spelled = np.add.reduceat(np.append(inner[1:], 0), starts) if len(starts) else np.zeros(0)
        heads, end = stream[starts], stream[starts] > self.subwords.size
        return first[starts], np.where(end, 0, spelled + self.log_weight[np.where(end, 0, heads)])


class Lexicon(dict):
    """Words by number, with each word's ids and training count (-1: not among the frequent words).

    Number 0 is a text's end. When it is full (``kept`` words or ``KEPT_BYTES`` beside the frequent ones), only these stay.
    """

    def __init__(self, subwords: Subwords, hot: dict[bytes, int], model: Model | None = None, kept: float = KEPT):
        super().__init__()
        self.subwords, self.hot, self.model, self.kept = subwords, hot, model, kept
        self.ids, self.first, self.many, self.count = array("i", [subwords.size + 1]), array("q", [0]), array("i", [1]), array("q", [0])
        self.bytes = 0
        if hot:  # the frequent words come first, so that no other word is looked up among them
            self.take_in(list(hot), np.fromiter(hot.values(), np.int64, len(hot)))

    def take_in(self, new: list[bytes], counts: np.ndarray) -> np.ndarray:
        flat, n = self.subwords.ids_of(new)
        self.count.frombytes(counts.tobytes())
        self.first.frombytes((len(self.ids) + np.cumsum(n) - n).tobytes())
        self.many.frombytes(n.astype(np.int32).tobytes())
        self.ids.frombytes(flat.astype(np.int32).tobytes())
        self.bytes += int((np.fromiter(map(len, new), np.int64, len(new)) + 4 * n)[counts < 0].sum())
        found = np.arange(len(self.many) - len(new), len(self.many))
        self.update(zip(new, found.tolist(), strict=True))
        return found

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; new ones are taken in."""
        if len(self) > self.kept + len(self.hot) or self.bytes > KEPT_BYTES:
            self.trim()
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            found[missing] = self.take_in(new, np.full(len(new), -1))
        return found

    def trim(self) -> None:
        kept = [(w, k) for w, k in self.items() if self.count[k] >= 0]
        places = np.array([0, *(k for _, k in kept)])
        flat, n = self.ids_of(places)
        self.ids, self.first, self.many = array("i", flat.astype(np.int32).tobytes()), array("q", (np.cumsum(n) - n).tolist()), array("i", n.tolist())
        self.count = array("q", np.array(self.count)[places].tolist())
        self.clear()
        self.update((w, k) for k, (w, _) in enumerate(kept, 1))
        self.bytes = 0

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and how many each has."""
        n = np.frombuffer(self.many, np.int32)[numbers].astype(np.int64)
        first = np.frombuffer(self.first, np.int64)[numbers]
        places = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.frombuffer(self.ids, np.int32)[places].astype(np.int64), n


class Words:
    """The words of several texts as numbers into their distinct words, each text closed by number 0, the end.

    Arrow splits and numbers them, so that only distinct words become Python objects.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        flat, real = parts.flatten(), pc.not_equal(parts.flatten(), "")
        ends = np.append(0, np.cumsum(np.asarray(real.cast(pa.int64()))))[np.asarray(parts.offsets) - parts.offsets[0].as_py()]
        flat, lengths = flat.filter(real).cast(pa.binary()), np.diff(ends)
        coded = flat.dictionary_encode()
        self.dictionary = coded.dictionary
        self.distinct: list[bytes] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.lengths = lengths + 1
        self.text_start = np.cumsum(self.lengths) - self.lengths
        self.at = np.zeros(int(self.lengths.sum()), np.int64)
        last = np.zeros(len(self.at), bool)
        last[self.text_start + lengths] = True
        self.at[~last] = np.asarray(coded.indices) + 1

    def known(self, lexicon: Lexicon) -> np.ndarray:
        """The lexicon's number of the end and of each distinct word."""
        return np.append(0, lexicon.numbers(self.distinct))


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)


def embed(profile: np.ndarray, size: int) -> np.ndarray:
    """Embeddings of ids from counts of what stands around them (a row an id); the rows of begin and end come last."""
    every = profile.sum(axis=0) + 1.0
    x = profile + 4 * every / every.sum()  # ids seen seldom stay near the mean
    x = np.sqrt(x / x.sum(axis=1, keepdims=True))
    weight = np.sqrt(profile.sum(axis=1) + 1e-3)
    x -= (x * weight[:, None]).sum(axis=0) / weight.sum()
    _, main = np.linalg.eigh((x * weight[:, None]).T @ x)
    x = x @ main[:, ::-1][:, : EMBEDDED - 3]
    x /= np.sqrt((x * x).sum(axis=1) @ weight / weight.sum()) + 1e-9
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1)
    out = np.zeros((size + 2, EMBEDDED), np.float32)
    out[:size, : EMBEDDED - 3] = 2 * x
    out[size, -2] = out[size + 1, -1] = 2
    return out


def grouped(counts: np.ndarray, x: np.ndarray, first: int, alone: int, classes: int, seed: int = 3) -> np.ndarray:
    """A class from ``first`` on for each id: the ``alone`` most frequent have their own, the others are grouped by their embedding ``x``."""
    order = np.argsort(-counts, kind="stable")
    kinds, groups = np.zeros(len(counts), np.uint8), classes - first - alone
    kinds[order[:alone]] = np.arange(first, first + alone)
    rest = order[alone:]
    some, weight = x[rest], np.sqrt(counts[rest] + 1e-3)
    centre = some[: groups * 4][np.random.Generator(np.random.PCG64(seed)).permutation(groups * 4)[:groups]].astype(float)
    for _ in range(15):
        nearest = (2 * some @ centre.T - (centre * centre).sum(axis=1)).argmax(axis=1)
        for g in np.unique(nearest):
            centre[g] = np.average(some[nearest == g], axis=0, weights=weight[nearest == g])
    kinds[rest] = first + alone + nearest
    return kinds


def share_of_class(counts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The chance of each id within its class; every id has some."""
    share = counts + 0.1
    return share / np.bincount(kinds, weights=share)[kinds]


def fit_windows(w: dict, t: Tables, x: np.ndarray, last: np.ndarray, live: np.ndarray, rate: float, epochs: int = 3, batch: int = 128) -> dict:
    step = Adam(w, rate)
    order = np.random.Generator(np.random.PCG64(9))
    for _ in range(epochs):
        for some in np.array_split(order.permutation(len(x)), max(1, len(x) // batch)):
            if len(some):
                step.step(gradients(w, t, x[some], last[some], live[some])[0])
    return w


# --- Spark stages
def _slices(batches: Iterator[pa.RecordBatch], column: str = "raw", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from small_batches(whole, column, most)


def stored(size: int) -> np.dtype:
    """How the ids of a tokenizer of ``size``, begin and end are stored: in two bytes each where these hold them, else in four."""
    return np.dtype("<u2" if size + 2 <= 1 << 16 else "<i4")


def as_ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids, one after the other, and how many each text has, from their stored bytes."""
    raw, kind = column.to_pylist(), stored(size)
    return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.array([len(x) // kind.itemsize for x in raw], np.int64)


def count_corpus(texts: DataFrame, subwords: Subwords) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, c), (k, c) and (h, ids) of ``texts`` (h, raw).

    k: a head times BUCKETS plus the bucket of a head up to two words before or after; ids: a row a text, all its ids
    and the end as bytes (``stored``). Counts are added up in each task, in pieces of bounded size, before the exchange.
    """
    kind = stored(subwords.size)
    schema = pa.schema([("word", pa.binary()), ("k", pa.int64()), ("c", pa.int64()), ("h", pa.int64()), ("ids", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, near = Lexicon(subwords, {}, kept=float("inf")), np.zeros((subwords.size + 2) * BUCKETS, np.int64)
        seen = np.zeros(1, np.int64)  # by the lexicon's numbers
        for batch in _slices(batches):
            words = Words(batch.column("raw"))
            numbers = lexicon.numbers(words.distinct)
            seen = np.append(seen, np.zeros(len(lexicon.many) - len(seen), np.int64))
            seen[numbers] += np.bincount(words.at, minlength=len(words.distinct) + 1)[1:]
            tokens = np.append(0, numbers)[words.at]
            flat, n = lexicon.ids_of(tokens)
            heads = flat[np.cumsum(n) - n]
            text, bucket = np.repeat(np.arange(len(words.lengths)), words.lengths), bucket_of(heads)
            for apart in (1, 2):
                same = text[apart:] == text[:-apart]
                np.add.at(near, heads[apart:][same] * BUCKETS + bucket[:-apart][same], 1)
                np.add.at(near, heads[:-apart][same] * BUCKETS + bucket[apart:][same], 1)
            raw = flat.astype(kind).tobytes()
            ends = (kind.itemsize * np.append(np.append(0, np.cumsum(n))[words.text_start], len(flat))).tolist()
            yield rows(h=batch.column("h"), ids=[raw[a:b] for a, b in zip(ends, ends[1:], strict=False)])
            if len(lexicon) > COUNTED or lexicon.bytes > KEPT_BYTES:
                yield from counted(lexicon, seen)
                lexicon.trim()
                seen = seen[:1]
        yield from counted(lexicon, seen)
        places = np.flatnonzero(near)
        for a in range(0, len(places), 100_000):
            some = places[a : a + 100_000]
            yield rows(k=some, c=near[some])

    def counted(lexicon: Lexicon, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = list(lexicon)
        cut = np.flatnonzero(np.diff(np.cumsum([len(w) for w in known]) // SENT_BYTES)) + 1 if known else []
        bounds = [0, *map(int, cut), len(known)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b > a:
                yield rows(word=known[a:b], c=seen[1 + a : 1 + b])

    parts = materialize(texts.mapInArrow(run, "word binary, k long, c long, h long, ids binary"))
    total = F.sum("c").alias("c")
    return parts.where("word IS NOT NULL").groupBy("word").agg(total), parts.where("k IS NOT NULL").groupBy("k").agg(total), parts.where("ids IS NOT NULL").select("h", "ids")


def spelled(counts: DataFrame, subwords: Subwords) -> DataFrame:
    """(word, c, ids) of counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = subwords.ids_of(batch.column("word").to_pylist())
            ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield batch.append_column("ids", pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())))

    return counts.mapInArrow(run, "word binary, c long, ids array<int>")


def summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sum over tasks of the arrays (of ``size`` counts) that ``run`` makes of a task's batches; what isn't 0 is sent."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        found = np.flatnonzero(total)
        for a in range(0, len(found), 100_000):
            some = found[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["k", "c"])

    return dense(rows.mapInArrow(sparse, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")), size)


def dense(sums: DataFrame, size: int) -> np.ndarray:
    """An array of ``size`` from rows (k, c); a tokenizer's ids bound it."""
    out, got = np.zeros(size, np.int64), sums.toArrow()
    out[got["k"].to_numpy()] = got["c"].to_numpy()
    return out


def _id_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("ids")
    return ids.flatten().to_numpy().astype(np.int64), np.diff(np.asarray(ids.offsets)).astype(np.int64)


def head_counts(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and distinct words by head id, and distinct words by the ids inside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((3, size), np.int64)
        for batch in batches:
            flat, n = _id_lists(batch)
            if len(n):
                first = np.cumsum(n) - n
                tails = np.ones(len(flat), bool)
                tails[first] = False
                np.add.at(total[0], flat[first], batch.column("c").to_numpy())
                np.add.at(total[1], flat[first], 1)
                np.add.at(total[2], flat[tails], 1)
        return total.ravel()

    return tuple(summed(words, run, 3 * size).reshape(3, size))


def by_place(words: DataFrame, size: int, width: int, place) -> np.ndarray:
    """Counts over distinct words; ``place(flat, n)`` gives the places to count in ``size`` rows of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size * width, np.int64)
        for batch in batches:
            flat, n = _id_lists(batch)
            if len(n):
                np.add.at(total, place(flat, n), 1)
        return total

    return summed(words, run, size * width).reshape(size, width)


def frequent(words: DataFrame, most: int = HOT) -> dict[bytes, int]:
    """Words (of HOT_BYTES at most) of at least such a count that no more than ``most`` have it."""
    short = words.select("word", "c").where(F.octet_length("word") <= HOT_BYTES)
    level = F.floor(F.log2("c") * 16).cast("int")
    have, least = 0, None
    for r in sorted(short.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.l):
        have += r.n
        if have > most:
            break
        least = r.c
    return {} if least is None else {bytes(r.word): r.c for r in short.where(F.col("c") >= least).toLocalIterator()}


def train_shards(training: DataFrame, tokens: int, known: Tables, weights: dict, rate: float = 2e-3) -> dict:
    """Every shard of ``training`` (h, ids) trains ``weights`` on every window of its texts; the mean by tokens."""
    shards = min(max(1, tokens // SHARD_TOKENS), 1 << 20)
    sc = training.sparkSession.sparkContext
    sent, size = sc.broadcast(known), len(known.e) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        shard, step, n, done = None, None, 0, []
        out = np.zeros(sum(int(np.prod(s)) for _, s in PARTS), object)
        held: list[tuple] = []

        def learn(rest: bool) -> None:
            nonlocal n, held
            if not held:
                return
            x, last, live = (np.concatenate(part) for part in zip(*held, strict=True))
            upto = len(x) if rest else len(x) // 128 * 128
            for a in range(0, upto, 128):
                some = slice(a, min(a + 128, upto))
                step.step(gradients(step.w, t, x[some], last[some], live[some])[0])
            n += int(live[:upto].sum())
            held = [(x[upto:], last[upto:], live[upto:])]

        def close() -> None:
            nonlocal n, held
            if step:
                learn(True)
                flat = np.concatenate([step.w[k].ravel() for k, _ in PARTS])
                out[:] += np.rint(flat / GRAIN).astype(np.int64).astype(object) * n
                done.append(n)
            n, held = 0, []

        for batch in _slices(batches, "ids", stored(size).itemsize << 18):
            # a shard's windows are cut from its texts in order, whatever batches they come in
            marks = np.asarray(batch.column("shard"))
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if marks[a] != shard:
                    close()
                    shard, step = marks[a], Adam({k: v.copy() for k, v in weights.items()}, rate)
                x, last, at = windows(*as_ids(batch.column("ids").slice(a, b - a), size), t)
                held.append((x, last, at >= 0))
                learn(False)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out)), pa.int32()), pa.array([str(v) for v in out]), pa.array(np.full(len(out), sum(done)), pa.int64())], ["i", "x", "n"])

    dealt = training.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "ids").select("shard", "ids")
    rows = dealt.mapInArrow(run, "i int, x string, n long").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()
    sent.unpersist()
    if not rows or not rows[0].n:
        return weights
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r.i] = int(r.x) / r.n * GRAIN
    cuts = np.cumsum([0, *(int(np.prod(s)) for _, s in PARTS)])
    return {k: flat[a:b].reshape(s).astype(np.float32) for (k, s), a, b in zip(PARTS, cuts, cuts[1:], strict=False)}


def first_weights(training: DataFrame, known: Tables) -> dict:
    """Weights fitted to the ``SAMPLE`` texts of the smallest hashes (of each, one row of at most ``SAMPLE_TOKENS`` ids)."""
    size = len(known.e) - 2
    short = training.where(F.octet_length("ids") <= stored(size).itemsize * SAMPLE_TOKENS)
    least = [r.h for r in short.select("h").distinct().orderBy("h").limit(SAMPLE).collect()]
    chosen = short.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("ids").alias("ids")).orderBy("h").collect() if least else []
    if not chosen:
        return new_weights(np.ones((CLASSES, CLASSES)))
    x, last, at = windows(*as_ids(pa.array([bytes(r.ids) for r in chosen], pa.binary()), size), known)
    live = at >= 0
    _, was, y, *_ = known.events(x, last, live)
    steps = np.zeros((CLASSES, CLASSES))
    np.add.at(steps, (was, y), 1)
    return fit_windows(new_weights(steps), known, x, last, live, 1e-2)


def fit(training: DataFrame, ranks: bytes, pattern: str) -> tuple[Model, DataFrame, dict[bytes, int], int, int, int]:
    """The model of ``training`` (doc_id, raw), the table of counted words (word, c, ids), its frequent words, all tokens, distinct tokens and ends."""
    subwords = Subwords(ranks, pattern)
    size = subwords.size
    counted, around, texts = count_corpus(training.select("raw", F.xxhash64("doc_id", "raw").alias("h")), subwords)
    words = materialize(spelled(counted, subwords))
    n1, n2, total, distinct = words.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.count()

    e = embed(dense(around, (size + 2) * BUCKETS).reshape(-1, BUCKETS)[:size].astype(float), size)
    tokens, types, inside = head_counts(words, size)
    kinds = np.append(grouped(tokens, e[:size], 2, ALONE, CLASSES), [BEGIN, END]).astype(np.uint8)
    # ids inside words are grouped by the classes of the heads of their words
    by_head = by_place(words, size, CLASSES, lambda flat, n, kinds=kinds: flat * CLASSES + np.repeat(kinds[flat[np.cumsum(n) - n]], n))
    shape = np.sqrt((by_head + 0.5) / (by_head + 0.5).sum(axis=1, keepdims=True))
    tail_kinds = grouped(inside, shape, 1, TAILS_ALONE, TAILS)
    inner = ~subwords.spaced
    e[:size][inner] = embed(by_head.astype(float), size)[:size][inner]
    e[:size][inner, -3] = 1

    def steps(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        kind = np.append(tail_kinds[flat[1:]], 0).astype(np.int64)
        kind[np.cumsum(n) - 1] = 0
        return flat * TAILS + kind

    after = by_place(words, size, TAILS, steps).ravel()
    by_class = lambda x: np.bincount(kinds[:size], weights=x, minlength=CLASSES)
    followed = np.flatnonzero(after)
    model = Model(
        subwords, kinds, e, float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.95)), by_class(tokens), by_class(types),
        share_of_class(types, kinds[:size]), tail_kinds, share_of_class(inside, tail_kinds), (followed, after[followed]),
    )
    model.weights = new_weights(np.ones((CLASSES, CLASSES)))
    hot = frequent(words)
    if ends:
        ids = texts.agg(F.sum(F.expr(f"octet_length(ids) div {stored(size).itemsize}"))).first()[0]
        model.weights = train_shards(texts, ids, model.known, first_weights(texts, model.known))
    # nothing stands for a begin, nor for a class without ids
    model.weights["bias"][:, np.setdiff1d(np.arange(CLASSES), np.append(kinds[:size], END))] = -1e4
    return model, words, hot, total + ends, distinct + bool(ends), ends


SCORED = "rid long, doc_id long, n_tokens long, hot long, base double, score double, words array<binary>, weights array<double>"


def _score(lexicon_of, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, rid = lexicon_of(), TaskContext.get().partitionId() << 33
        model = lexicon.model
        for batch in _slices(batches):
            words = Words(batch.column("raw"))
            known = words.known(lexicon)
            count = np.frombuffer(lexicon.count, np.int64).take(known)
            chance = np.log10(np.maximum(np.append(ends, count[1:]), 0) + 1)  # 0 for a word that is not known
            numbers = known.take(words.at)
            flat, n = lexicon.ids_of(numbers)
            starts = np.cumsum(n) - n
            sizes = np.add.reduceat(n, words.text_start)
            score, weight = model.scores(flat, sizes, starts)
            c, end = count.take(words.at), numbers == 0
            hot = c >= 0
            score[~end] -= model.log_tokens[model.kinds[flat[starts][~end]]]
            seen = hot & ~end
            score[seen] += np.log10(np.maximum(c[seen] - model.discount, 0) + np.exp(weight[seen] * np.log(10)) + 1e-300)
            c = np.where(end, ends, c)
            base = chance.take(words.at)
            rare = np.flatnonzero(~hot)
            cut = pa.array(np.searchsorted(rare, np.append(words.text_start, len(numbers))), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, words.dictionary.take(pa.array(words.at[rare] - 1))), pa.ListArray.from_arrays(cut, pa.array(weight[rare]))]
            sums = lambda y, s=words.text_start: np.add.reduceat(y, s)
            yield pa.RecordBatch.from_arrays([pa.array(rid + np.arange(batch.num_rows)), batch.column("doc_id"), pa.array(words.lengths, pa.int64()), pa.array(sums((hot & (c > 0)).astype(np.int64))), pa.array(sums(base)), pa.array(sums(score)), *lists], ["rid", "doc_id", "n_tokens", "hot", "base", "score", "words", "weights"])
            rid += batch.num_rows

    return run


def lm_scores(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs`` (doc_id, text)."""
    rows = bounded_arrow(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary").alias("raw"))
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    model, counts, hot, total, distinct, ends = fit(rows.where(~held_out), ranks, pattern)
    sent = docs.sparkSession.sparkContext.broadcast((model.subwords, hot, model))
    lexicon_of = lambda: _lexicon(sent.value)

    scored = materialize(rows.mapInArrow(_score(lexicon_of, ends), SCORED))
    rare = scored.select("rid", F.explode(F.arrays_zip("words", "weights")).alias("r")).select("rid", F.col("r.words").alias("word"), F.col("r.weights").alias("weight"))
    joined = rare.join(counts.select("word", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # where a word was never counted its chance can be below the smallest double, so it stays a logarithm
    mixed = F.when(F.col("c") > 0, F.log10(F.col("c") - model.discount + F.pow(F.lit(10.0), F.col("weight")))).otherwise(F.col("weight"))
    more = joined.groupBy("rid").agg(F.count_if(F.col("c") > 0).alias("k"), F.sum(F.log10(F.col("c") + 1)).alias("b"), F.sum(mixed).alias("s"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = scored.drop("words", "weights").join(more, "rid", "left")
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("hot") + zero("k")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.round(F.col("base") + zero("b") - F.col("n_tokens") * float(np.log10(total + distinct + 1)), 9).alias("base_score"),
        F.round(F.col("score") + zero("s"), 6).alias("score"),
    )


_held: list = []


def _lexicon(sent: tuple) -> Lexicon:
    """The worker's lexicon of (subwords, frequent words, model or None), kept between tasks that share a broadcast."""
    if not _held or _held[0] is not sent:
        _held[:] = [sent, Lexicon(*sent[:3])]
    return _held[1]


def op4_attention_lm(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = file.read()
    return lm_scores(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
