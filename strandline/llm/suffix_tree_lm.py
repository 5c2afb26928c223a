"""Language-model scoring with a probabilistic suffix tree over words.

The root predicts a word x with (c(x) + a) / (N + a (V + 1)).  A context s of one to `depth`
words is a node if the likelihood-ratio divergence of its next-word
distribution from that of its longest retained suffix exceeds a penalty for the
children it stores, the next words seen at least `least` times there.  A
node's distribution is interpolated with its parent's,

    P(x | s) = (n(s, x) + (r(s) + mu) P(x | parent(s))) / (n(s) + mu),

where r(s) is the mass of the next words that are too rare to be stored; it
sums to one.  A text is scored from its longest suffix states: each token is
predicted by the longest retained context that ends before it.

Texts are packed once into blocks of word numbers.  The tree grows a length at a time, in messages between
blocks and hash ranges of contexts:

1. a block asks each range about its distinct contexts: the next words with their counts in training rows and
   log P(x | parent).  Held-out rows ask too, with counts of zero;
2. a range merges what the blocks sent, FAN_IN rows at a time, so that it holds a context once however many
   blocks have it, and tests every context;
3. a block gets its answers in the order that it asked in: n(s), r(s), n(s, x), whether s is retained and
   whether a longer context can be.

Two rules leave out contexts that can't be retained, without changing the tree.  A context seen less than `least` times
stores no child.  And a context's gain is at most the sum of n(s, x) (-log P(x | suffix)) over its children, so if no
child of the suffix reaches the penalty of one child, no longer context passes the test.

After contexts of CARRIED words few tokens can still gain, so a block goes on with sums per row and those tokens alone.

Nothing is broadcast and nothing but totals reaches the driver.  Words and contexts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import checkpointed, discard, gathered, id_of, parts, text_of, tidy
from .words import END, Words, cuts_of, mix, split_words

#: Bytes of text in a block, gathered from as many batches as it takes; a longer text is a block of its own.  A context is
#: sent once for each block that has it, so larger blocks send less.
BLOCK_BYTES = 12 << 20
#: Blocks whose messages to a range are merged, or answered, at once.
FAN_IN = 512
#: Length of context after which a block keeps only the tokens that a longer one can predict.
CARRIED = 2
_MULT = np.uint64(0x9E3779B97F4A7C15)
_KEPT, _OPEN = 1, 2
_NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Settings:
    """alpha: added to every count at the root.  least: occurrences of a stored succession.  mu: weight of the parent's
    distribution.  kl_min: least divergence, in nats per occurrence of the context.  depth: words in the longest context."""

    alpha: float = 0.1
    least: int = 2
    mu: float = 2.0
    kl_min: float = 0.02
    depth: int = 4


def _squeezed(*arrays: np.ndarray, by: zstandard.ZstdCompressor | None = None) -> bytes:
    """Arrays as compressed byte planes; unsigned numbers without the planes that are zero throughout.  Whoever packs many
    hands over a compressor, as a new one takes longer than a small message."""
    used = [max(1, (int(a.max()).bit_length() + 7) // 8) if a.dtype.kind == "u" and len(a) else a.itemsize for a in arrays]
    at = 16 * len(arrays)
    out = np.empty(at + sum(len(a) * k for a, k in zip(arrays, used, strict=True)), np.uint8)
    out[:at].view(np.int64)[:] = [v for a, k in zip(arrays, used, strict=True) for v in (len(a), k)]
    for a, k in zip(arrays, used, strict=True):
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
        for j in range(k):
            out[at : at + len(a)] = planes[:, j]
            at += len(a)
    return (by or zstandard.ZstdCompressor(level=1)).compress(out)


def _expanded(data: bytes, *types: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    out, at = [], 16 * len(types)
    for (n, used), t in zip(raw[:at].view(np.int64).reshape(-1, 2).tolist(), types, strict=True):
        planes = np.zeros((n, np.dtype(t).itemsize), np.uint8)
        for j in range(used):
            planes[:, j] = raw[at : at + n]
            at += n
        out.append(planes.view(t).ravel())
    return out


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where a new key begins among sorted keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and the keys in it.

    Sorting numbers is several times faster than sorting their places, so each key is sorted with its place in its lower
    bits.  Where both need more than 64 bits the key gives up its own lowest; keys that only those tell apart may come
    out of order, and then the places are sorted.
    """
    if not len(keys):
        return np.zeros(0, np.int64), keys
    low = len(keys).bit_length()
    drop = max(0, int(keys.max()).bit_length() + low - 64)
    s = keys >> np.uint64(drop) if drop else keys.copy()
    s <<= np.uint64(low)
    s |= np.arange(len(keys), dtype=np.uint64)
    s.sort()
    order = (s & np.uint64((1 << low) - 1)).view(np.int64)
    if not drop:
        s >>= np.uint64(low)
        return order, s
    s = keys[order]
    if (s[1:] < s[:-1]).any():
        order = np.argsort(keys)
        s = keys[order]
    return order, s


def _stretches(many: int, head: np.ndarray) -> np.ndarray:
    """Number of the stretch that each of many places is in."""
    step = np.zeros(many, np.int8)
    step[head[1:]] = 1
    return np.cumsum(step, dtype=np.int32)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place among them of each key."""
    order, s = _sorted(keys)
    head = _heads(s)
    rank = np.empty(len(s), np.int32)
    rank[order] = _stretches(len(s), head)
    return s[head], rank


def _totals(values: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the stretches that begin at head."""
    return np.add.reduceat(values, head, dtype=np.uint32) if len(head) else np.zeros(0, np.uint32)


def _sums(rank: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rank, weights=weights, minlength=n).astype(np.uint32)


def _sequence(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the text of each."""
    n = len(words.per_doc)
    out = np.full(len(words.h) + n, END)
    inner = np.ones(len(out), bool)
    inner[words.first[1:] + np.arange(n)] = False
    out[inner] = words.h
    return out, np.repeat(np.arange(n, dtype=np.int32), words.per_doc + 1)


@tidy
def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as blocks, named by the first row's number: identifiers, which rows are held out, tokens per row, the
    distinct words, how often each occurs, and every token as its word's place in order of that number."""
    for batch in gathered(batches, BLOCK_BYTES, 1 << 20):
        words = split_words(batch.column("text"))
        keys, word = _ranked(_sequence(words)[0])
        times = np.bincount(word, minlength=len(keys)).astype(np.uint32)
        place = np.empty(len(keys), np.uint32)
        place[_by_number(times)] = np.arange(len(keys), dtype=np.uint32)
        held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.uint8)
        payload = _squeezed(batch.column("doc_id").to_numpy().astype(np.int64), held, (words.per_doc + 1).astype(np.uint32), _steps(keys), times, place[word])
        yield pa.RecordBatch.from_arrays([batch.column("rid").slice(0, 1), pa.array([payload], pa.binary())], ["block", "payload"])


def _by_number(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times.astype(np.int64), kind="stable")


class Block:
    """Tokens of a block, and what the lengths so far say about them.

    doc: row of each token; line: stretch of tokens that runs don't leave.  p: P(token | longest retained context so far).
    rare: whether the run of the last length that begins here is known to have less than `least` occurrences; open:
    whether contexts that end in the one of the last length here can be retained.  name, count: of each word.  place, keys:
    number of the run of the present length that begins here, and the key of each number, as long as every run has one: words
    at length 1, the children of words at length 2.  A run of three can be asked about whose first two words were not.
    """

    place = keys = ready = None

    def __init__(self, payload: bytes, total: int, vocabulary: int, settings: Settings):
        self.s, self.total, self.vocabulary, self.length = settings, total, vocabulary, 0
        self.ids, held, self.n_tokens, steps, times, place = _expanded(payload, np.int64, np.uint8, np.uint32, np.uint64, np.uint32, np.uint32)
        self.held = held.astype(bool)
        self.doc = self.line = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.n_tokens)
        self.train = ~self.held[self.doc]
        self.context, self.word = np.cumsum(steps, dtype=np.uint64), _by_number(times).astype(np.uint32)[place]

    _ROWS = (("ids", np.int64), ("held", np.uint8), ("n_tokens", np.uint32), ("known", np.int64), ("base", np.float64), ("done", np.float64))
    _TOKENS = (("doc", np.int32), ("line", np.int32), ("train", np.uint8), ("id", np.uint64), ("p", np.float64), ("rare", np.uint8), ("open", np.uint8))

    def carried(self) -> bytes:
        """Sums per row, and the tokens that runs of the present length, or longer ones about them, have."""
        n, k = len(self.ids), self.length
        self.known = np.bincount(self.doc, weights=(self.count > 0)[self.word], minlength=n).astype(np.int64)
        self.base = np.bincount(self.doc, weights=np.log10(self.count + self.s.alpha)[self.word], minlength=n) - self.n_tokens * np.log10(self.total + self.s.alpha * (self.vocabulary + 1))
        wanted = np.zeros(len(self.doc), bool)
        at = self.at if k <= self.s.depth else self.at[:0]
        for j in range(k - self.s.depth, k + 1):
            to = at + j
            near = to >= 0
            near[near] = self.doc[to[near]] == self.doc[at[near]]
            wanted[to[near]] = True
        done = np.ones(len(self.doc), bool)
        done[at + k] = False  # longer contexts only predict what the longest so far does
        self.done = np.bincount(self.doc, weights=np.where(done, np.log10(self.p), 0.0), minlength=n)
        self.p[done] = 1.0
        wanted = np.flatnonzero(wanted)
        tokens = {c: getattr(self, c)[wanted] for c, _ in self._TOKENS if c not in ("line", "id")}
        tokens["id"] = self.name[self.word[wanted]]
        cut = np.ones(len(wanted), bool)
        cut[1:] = (wanted[1:] != wanted[:-1] + 1) | (tokens["doc"][1:] != tokens["doc"][:-1])
        tokens["line"] = np.cumsum(cut)
        return _squeezed(np.array([k]), *(getattr(self, c).astype(t) for c, t in self._ROWS), *(tokens[c].astype(t) for c, t in self._TOKENS))

    @classmethod
    def restored(cls, payload: bytes, total: int, vocabulary: int, settings: Settings) -> "Block":
        self = cls.__new__(cls)
        self.s, self.total, self.vocabulary = settings, total, vocabulary
        length, *held = _expanded(payload, np.int64, *(t for _, t in self._ROWS + self._TOKENS))
        for (c, t), v in zip(self._ROWS + self._TOKENS, held, strict=True):
            setattr(self, c, v.astype(bool) if t is np.uint8 else v)
        self.name, word = _ranked(self.id)
        self.word = word.astype(np.uint32)
        self.length = int(length[0])
        self._find()
        return self

    def rows(self, name: int, ranges: int, chunks: int) -> list[dict]:
        """What is asked of each range about the runs of the present length."""
        rest, sizes, *children = self._counted()
        cut, child = cuts_of(self.context, ranges), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        chunk = int(mix(np.array([name], np.int64).view(np.uint64))[0] % np.uint64(chunks))
        by = zstandard.ZstdCompressor(level=1)
        return [
            {"part": p, "chunk": chunk, "block": name, "payload": _squeezed(_steps(self.context[a:b]), sizes[a:b], rest[a:b], *(v[child[a] : child[b]] for v in children), by=by)}
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))
            if b > a
        ]

    def take(self, answers: list[dict]) -> None:
        """Answers about the present length, by range; then come the runs of the next length."""
        if self.length:
            self._runs()
        told = [_expanded(r["payload"], np.uint64, np.uint64, np.uint8, np.uint32) for r in sorted(answers, key=lambda r: r["part"])]
        whole, rest, flags, n = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint8, np.uint32))
        size = len(self.doc)
        if not self.length:  # by word, then by token
            self.count, self.name = whole.astype(np.int64), rest
            p = (self.count + self.s.alpha) / (self.total + self.s.alpha * (self.vocabulary + 1))
            self.p, self.rare = p[self.word], (self.count < self.s.least)[self.word]
            self.open = np.ones(size, bool)
            self.place, self.keys = self.word, mix(self.name * _MULT)
        else:
            n = np.append(n, 0)  # the last one stands for no child
            often = n >= self.s.least
            child = np.empty(len(self.at), np.int32)  # of each run
            child[self.order] = np.where(self.real, np.cumsum(self.real) - 1, len(n) - 1).astype(np.int32)[_stretches(len(child), self.head)]
            stored = often[child]
            kept = np.flatnonzero(((flags & _KEPT) > 0)[self.own])
            own, to = self.own[kept], self.at[kept] + self.length
            seen = (n * often)[child[kept]]
            self.p[to] = (seen + (rest.astype(float) + self.s.mu)[own] * self.p[to]) / (whole.astype(float) + self.s.mu)[own]
            self.rare[:-1] |= self.rare[1:]
            self.rare[self.at[~stored]] = True
            self.open = np.zeros(size, bool)
            self.open[self.at[((flags & _OPEN) > 0)[self.own]]] = True
            self.place = self.keys = None
            if self.length == 1:
                self.place = np.zeros(size, np.int32)
                self.place[self.at] = child
                self.keys = mix(self.context[self.pair_own[self.real]] * _MULT + self.name[self.pair_word[self.real]])
        self.length += 1
        self._find()

    def _find(self) -> None:
        """Where the runs of the present length begin that can be told apart from their suffixes."""
        k = self.length
        m = max(0, len(self.doc) - k)
        live = ~self.rare[:m] & (self.line[:m] == self.line[k : k + m])
        if k > 1:
            live &= self.open[1 : m + 1]
        self.at = np.flatnonzero(live)

    def _runs(self) -> None:
        """Distinct contexts of these runs, which each run has, and the runs in order of context and next word: where a pair
        begins, its context and word, and whether it is a child."""
        if self.ready == self.length:
            return
        self.ready = self.length
        self.context, self.own = self._contexts()
        stored = ~self.rare[self.at + 1]  # a next word seen less than `least` times even after the suffix is no child
        bits = np.uint64(len(self.name).bit_length())
        pair = self.own.astype(np.uint64)
        pair <<= bits
        pair |= np.where(stored, self.word[self.at + self.length] + np.uint32(1), np.uint32(0))
        self.order, pair = _sorted(pair)
        self.head = _heads(pair)
        pair = pair[self.head]
        word = pair & ((np.uint64(1) << bits) - np.uint64(1))
        self.real = word > 0
        self.pair_own, self.pair_word = (pair >> bits).view(np.int64), word.view(np.int64) - 1

    def _counted(self) -> tuple[np.ndarray, ...]:
        """Of each context the training rows' runs without a child and the number of children; of each child in order the
        word, how often training rows have it, and what the parent says of it."""
        if not self.length:
            none = np.zeros(0, np.uint32)
            return _sums(self.word, self.train, len(self.context)), np.zeros(len(self.context), np.uint32), none.astype(np.uint64), none, none
        self._runs()
        many, real = len(self.context), self.real
        counts = _totals(self.train[self.at][self.order], self.head)
        rest = _sums(self.pair_own[~real], counts[~real], many)
        sizes = np.bincount(self.pair_own[real], minlength=many).astype(np.uint32)
        word = self.pair_word[real]
        if self.length == 1:
            logp = self.count[word].astype(np.uint32)
        else:
            some = self.at[self.order[self.head[real]]] + self.length  # a token of each
            logp = np.log(self.p[some]).astype(np.float32).view(np.uint32)
        return rest, sizes, self.name[word], counts[real], logp

    def _contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of these runs, sorted, and which each has."""
        if self.place is None:
            key = mix(self.name[self.word[self.at]] * _MULT)
            for k in range(1, self.length):
                key = mix(key * _MULT + self.name[self.word[self.at + k]])
            return _ranked(key)
        place = self.place[self.at]
        used = np.zeros(len(self.keys), bool)
        used[place] = True
        used = np.flatnonzero(used)
        order, context = _sorted(self.keys[used])
        own = np.zeros(len(self.keys), np.int32)
        own[used[order]] = np.arange(len(used), dtype=np.int32)
        return context, own[place]

    def scores(self) -> dict[str, np.ndarray]:
        n = len(self.ids)
        score = self.done + np.bincount(self.doc, weights=np.log10(self.p), minlength=n)
        return {"doc_id": pa.array(self.ids, mask=self.ids == _NO_ID), "held_out": self.held, "n_tokens": self.n_tokens, "n_known": self.known, "train_tokens": np.full(n, self.total, np.int64), "base_score": self.base, "score": score}


@dataclass(frozen=True)
class _Run:
    """What every step knows."""

    ranges: int
    chunks: int
    total: int
    vocabulary: int
    settings: Settings

    def blocks(self, blocks: pa.Table, told: pa.Table, carried: bool, length: int) -> Iterator[tuple[int, Block]]:
        """Blocks by name, after the answers about shorter runs."""
        answers = told.to_pylist()
        for row in blocks.to_pylist():
            block = (Block.restored if carried else Block)(row["payload"], self.total, self.vocabulary, self.settings)
            for k in range(block.length, length):
                block.take([r for r in answers if r["length"] == k and r["block"] == row["block"]])
            yield row["block"], block


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


_ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_ASKED_SQL = "part int, chunk int, block long, payload binary"
_TOLD = pa.schema([("block", pa.int64()), ("length", pa.int32()), ("part", pa.int32()), ("total", pa.int64()), ("kinds", pa.int64()), ("payload", pa.binary())])
_TOLD_SQL = "block long, length int, part int, total long, kinds long, payload binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _ask(length: int, run_: _Run, carried: bool):
    @tidy
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = [row for name, block in run_.blocks(blocks, told, carried, length) for row in block.rows(name, run_.ranges, run_.chunks)]
        return pa.Table.from_pylist(out, schema=_ASKED)

    return run


def _carry(run_: _Run):
    @tidy
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{"block": name, "payload": block.carried()} for name, block in run_.blocks(blocks, told, False, min(CARRIED, run_.settings.depth) + 1)], schema=pa.schema([("block", pa.int64()), ("payload", pa.binary())]))

    return run


def _asked(payload: bytes) -> tuple[np.ndarray, ...]:
    """context, its other occurrences, context of each child, child, count, what the parent says of it (a number of
    occurrences after one word, bits of a log probability later)."""
    context, sizes, rest, x, n, logp = _expanded(payload, np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32)
    return np.cumsum(context, dtype=np.uint64), rest, np.repeat(np.arange(len(sizes)), sizes), x, n, logp


def combined(messages: list[tuple[np.ndarray, ...]]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """What several blocks ask of a range, as _asked gives it: every context and child once, its counts added; and the place
    there of each message's contexts and children, message after message."""
    context, rest, own, x, n, logp, before = [], [], [], [], [], [], 0
    for got in messages:
        for held, v in zip((context, rest, own, x, n, logp), (*got[:2], got[2] + before, *got[3:]), strict=True):
            held.append(v)
        before += len(got[0])
    context, rest, own, x, n, logp = (np.concatenate(v) for v in (context, rest, own, x, n, logp))
    context, rank = _ranked(context)
    rest = np.bincount(rank, weights=rest, minlength=len(context)).astype(np.uint32)
    own = rank[own]
    bits = np.uint64(int(x.max()).bit_length() if len(x) else 0)
    order, pair = _sorted((own.astype(np.uint64) << bits) | x)
    head = _heads(pair)
    child = np.empty(len(x), np.int32)
    child[order] = _stretches(len(x), head)
    n = _totals(n[order], head)
    head = order[head]
    return (context, rest, own[head], x[head], n, logp[head]), rank, child


def merged(table: pa.Table) -> pa.Table:
    """What several blocks ask of a range, as one row."""
    (context, rest, own, x, n, logp), _, _ = combined([_asked(payload.as_py()) for payload in table.column("payload")])
    sizes = np.bincount(own, minlength=len(context)).astype(np.uint32)
    row = {"part": table.column("part")[0].as_py(), "chunk": table.column("chunk")[0].as_py() // FAN_IN, "block": 0, "payload": _squeezed(_steps(context), sizes, rest, x, n, logp)}
    return pa.Table.from_pylist([row], schema=_ASKED)


def _paired(own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Keys that sort children within their contexts: below 2^24 contexts of a range, 2^40 words."""
    return (own.astype(np.uint64) << np.uint64(40)) | x


_merge = tidy(lambda table: merged(table))


def judged(asked: tuple[np.ndarray, ...], part: int, length: int, run_: _Run) -> tuple[np.ndarray, ...]:
    """Of a range's contexts: occurrences, those without a stored child, flags.

    At length 0 the contexts are words, and in place of the second an identifier of the word, 0 for one that training rows
    don't have; frequent words have small ones.
    """
    s, total = run_.settings, run_.total
    context, rest, own, x, n, logp = asked
    if not length:
        seen = np.flatnonzero(rest)
        order = seen[np.argsort(-rest[seen].astype(np.int64), kind="stable")]
        name = np.zeros(len(rest), np.uint64)
        name[order] = np.arange(len(order), dtype=np.uint64) * np.uint64(run_.ranges) + np.uint64(part + 1)
        return rest.astype(np.uint64), name, np.zeros(len(rest), np.uint8)
    many = len(context)
    logp = np.log((logp + s.alpha) / (total + s.alpha * (run_.vocabulary + 1))).astype(np.float32) if length == 1 else logp.view(np.float32)
    stored = n >= s.least
    total_n = np.bincount(own, weights=n, minlength=many)
    whole = rest + total_n
    rare = whole - np.bincount(own, weights=n * stored, minlength=many)
    k, parent, owner = n[stored].astype(float), logp[stored].astype(float), own[stored]
    escape = np.log((rare + s.mu) / (whole + s.mu))
    here = np.log((k + (rare + s.mu)[owner] * np.exp(parent)) / (whole + s.mu)[owner])
    gained = np.bincount(owner, weights=k * (here - parent), minlength=many) + rare * escape
    penalty = 0.5 * np.log(max(total, 2))
    kept = (gained > penalty * np.bincount(owner, minlength=many)) & (gained > s.kl_min * whole)
    hope = -k * np.where(kept[owner], here, parent) > penalty
    flags = kept * np.uint8(_KEPT) | (np.bincount(owner, weights=hope, minlength=many) > 0) * np.uint8(_OPEN)
    return whole.astype(np.uint64), rare.astype(np.uint64), flags.astype(np.uint8)


def answered(asked: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], whole_range: tuple[np.ndarray, ...], length: int, run_: _Run) -> pa.Table:
    """The answers to the message of each block, from all that is asked of its range.  found: of each message the context of
    each child within it, and where its contexts and children are in the range."""
    s, part = run_.settings, asked.column("part")[0].as_py()
    n = whole_range[4]
    whole, rest, flags = judged(whole_range, part, length, run_)
    count, kinds = (int(whole.sum()), int((whole > 0).sum())) if not length else (0, 0)
    out, by = [], zstandard.ZstdCompressor(level=1)
    for block, (own, at, child) in zip(asked.column("block").to_pylist(), found, strict=True):
        k = n[child]
        f = flags[at]
        k = np.where((f[own] & _KEPT) > 0, k, np.minimum(k, s.least)) if length else k
        told = (f & _KEPT) > 0 if length else np.ones(len(f), bool)
        out.append({"block": block, "length": length, "part": part, "total": count, "kinds": kinds, "payload": _squeezed(whole[at] * told, rest[at] * told, f, k.astype(np.uint32), by=by)})
    return pa.Table.from_pylist(out, schema=_TOLD)


def _answer(length: int, run_: _Run):
    @tidy
    def run(asked: pa.Table, row: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _TOLD.empty_table()
        whole_range = _asked(row.column("payload")[0].as_py())
        pairs = _paired(whole_range[2], whole_range[3])

        def found():
            for payload in asked.column("payload"):
                context, _, own, x, _, _ = _asked(payload.as_py())
                at = np.searchsorted(whole_range[0], context)
                yield own, at, np.searchsorted(pairs, _paired(at[own], x))

        return answered(asked, found(), whole_range, length, run_)

    return run


def _merge_and_answer(length: int, run_: _Run):
    @tidy
    def run(asked: pa.Table) -> pa.Table:
        messages = [_asked(payload.as_py()) for payload in asked.column("payload")]
        whole_range, at, child = combined(messages)
        a, b = (np.cumsum([0, *(len(got[i]) for got in messages)]) for i in (0, 2))
        found = ((got[2], at[a[i] : a[i + 1]], child[b[i] : b[i + 1]]) for i, got in enumerate(messages))
        return answered(asked, found, whole_range, length, run_)

    return run


def _scores(run_: _Run):
    @tidy
    def run(blocks: pa.Table, told: pa.Table) -> pa.Table:
        done = [pa.table(block.scores()).cast(_SCORES) for _, block in run_.blocks(blocks, told, True, run_.settings.depth + 1)]
        return pa.concat_tables(done) if done else _SCORES.empty_table()

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: F.Column | None = None, settings: Settings = Settings(), ranges: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out marks rows that the model does not learn from; by default those
    whose crc32 of the identifier as text leaves no remainder by 10 (a null
    identifier counts as the empty string there).  Null text is empty and is
    one token, the end.  A text longer than a block is a block of its own.  Rows that repeat an identifier are scored each on
    their own; contexts of equal gain don't compete, so there are no ties.  Without training rows every count is
    zero.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.coalesce(id_of(docs, id_col), F.lit(int(_NO_ID))).alias("doc_id"), text_of(docs, text_col).alias("text"), held_out.alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    blocks = checkpointed(rows.mapInArrow(_pack_blocks, "block long, payload binary"))
    many, ways = blocks.count(), parts(spark)
    run_ = _Run(ranges or max(ways, min(many, 8 * ways)), max(1, -(-many // FAN_IN)), 0, 0, settings)
    nothing = told = spark.createDataFrame([], _TOLD_SQL)
    carried, spent = False, []
    for length in range(settings.depth + 1):
        asked = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_ask(length, run_, carried), _ASKED_SQL)
        if run_.chunks == 1:
            answers = asked.groupBy("part").applyInArrow(_merge_and_answer(length, run_), _TOLD_SQL)
        else:
            row, left = asked.groupBy("part", "chunk").applyInArrow(_merge, _ASKED_SQL), run_.chunks
            while left > 1:
                row, left = row.groupBy("part", "chunk").applyInArrow(_merge, _ASKED_SQL), -(-left // FAN_IN)
            row = row.select("part", F.explode(F.sequence(F.lit(0), F.lit(run_.chunks - 1))).alias("chunk"), "block", "payload")
            answers = asked.groupBy("part", "chunk").cogroup(row.groupBy("part", "chunk")).applyInArrow(_answer(length, run_), _TOLD_SQL)
        answers = checkpointed(answers)
        told = told.unionByName(answers)
        if not carried:
            spent.append(answers)
        if not length:
            of_part = answers.groupBy("part").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"))
            total, kinds = of_part.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
            run_ = replace(run_, total=total, vocabulary=kinds)
        if length == min(CARRIED, settings.depth):
            spent.append(blocks)
            blocks = checkpointed(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_carry(run_), "block long, payload binary"))
            told, carried = nothing, True
            for df in spent:
                discard(df)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(run_), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
