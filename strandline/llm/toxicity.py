"""Toxic spans with a linear-chain conditional random field.

Labels say only whether a text is toxic.  Tokens are labelled from them: word
and prefix features are taken greedily, strongest association first, if their association with toxic texts is no chance
among all features, or if they explain toxic texts that none before them explains; the tokens of toxic
texts that carry such a feature are the toxic ones, all others are clean.  A
two-state chain (clean, toxic) is then fitted to the whole token sequences by its
conditional likelihood.  The features of a token are its word, its prefixes, its shape and the beginnings of the words beside it, hashed
into 2^BITS weights.  The sample's texts are dealt into SHARDS parts by identifier; in each round every part takes gradient
steps from the same weights; the next round starts from the mean of the changes over the parts that changed a weight.

On every whole text forward-backward gives each token's marginal; the score is the largest one (not their union,
so length does not matter), and runs of tokens at 0.5 or more are the
offending spans.  Texts are cut into lines of LINE tokens: the 2 x 2 products of the lines give the exact messages
at their ends, and all lines of a batch are passed at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tools import byte_slices, checkpointed, id_of, shared, text_of, tidy
from .words import counts_of, hash_spans, mix, shingle_sets, text_bytes

#: Prefix lengths (bytes) that are features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8)
BITS = 19
LINE = 128
SHARDS = 8
#: Bytes of text that are tagged at once.
SLICE = 1 << 20
_NONE = 1 << BITS  # index of the weight that stays 0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass(frozen=True)
class Settings:
    """sample: at most so many labelled texts are learned from, a quarter of them toxic, those with the smallest hash of the
    identifier.  least: toxic texts a feature must explain anew.  precision: share of toxic texts among those with the
    feature.  rounds, epochs, batch: rounds of mixing, passes of a part in each, texts of a gradient step.  rate: its size.  decay: pull
    of the weights to 0.  threshold: score from which a text is toxic."""

    sample: int = 6_000
    least: int = 3
    precision: float = 0.7
    rounds: int = 4
    epochs: int = 3
    batch: int = 48
    rate: float = 0.3
    decay: float = 1e-4
    threshold: float = 0.3


@dataclass
class Tokens:
    """Runs of letters and digits of a batch of texts: place and length in bytes, text of each."""

    raw: np.ndarray
    low: np.ndarray
    off: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Tokens":
        raw, off = text_bytes(column)
        low = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
        if len(raw) > 1:  # capitals of Latin-1, whose small letters are as long
            low[1:] += np.where((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97), 32, 0).astype(np.uint8)
        letter = np.concatenate([[False], _LETTER[low], [False]])
        cut = np.zeros(len(raw) + 1, bool)
        cut[off] = True
        start = np.flatnonzero(letter[1:] & (~letter[:-1] | cut) & np.append(np.ones(len(raw), bool), False))
        end = np.flatnonzero(letter[:-1] & (~letter[1:] | cut))
        return cls(raw, low, off, start, end - start, np.searchsorted(off, start, side="right") - 1)

    def words(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hash of each word, and of its prefix of each length (0 if the word is no longer)."""
        view = np.ndarray((len(self.low) + 1,), "<u8", buffer=np.concatenate([self.low, np.zeros(8, np.uint8)]), strides=(1,))[self.start]
        short = [np.where(self.length > k, mix((view & np.uint64(0xFFFFFFFFFFFFFFFF >> (64 - 8 * k))) + np.uint64(k) * _ODD), 0) for k in PREFIXES]
        return hash_spans(self.low, self.start, self.length), short

    def features(self) -> np.ndarray:
        """A row of weight indexes for each token."""
        word, short = self.words()
        upper = np.concatenate([[0], np.cumsum(self.raw != self.low)])
        capitals = upper[self.start + self.length] - upper[self.start]
        shape = (np.minimum(self.length, 15) * 4 + (self.raw[self.start] != self.low[self.start]) * 2 + (2 * capitals > self.length)).astype(np.uint64)
        before, after, begin = np.zeros_like(word), np.zeros_like(word), np.where(short[0] != 0, short[0], word)
        if len(word) > 1:
            same = self.doc[1:] == self.doc[:-1]
            before[1:][same], after[:-1][same] = begin[:-1][same], begin[1:][same]
        columns = [word, *short, shape + np.uint64(1), before, after]
        out = np.empty((len(columns), len(word)), np.int32)
        for k, h in enumerate(columns):
            out[k] = np.where(h != 0, (mix(h * _ODD + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int32), _NONE)
        return out


def marginals(odds: np.ndarray, doc: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens in texts: P(toxic), and the odds that come from the left (own odds included) and from the right.

    odds: exp of the score of toxic against clean.  move: exp of the transition scores [from][to]; before a text stands a clean token.
    """
    n = len(odds)
    if not n:
        return odds, odds, odds
    place = np.arange(n) - np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(n), 0))
    first = place % LINE == 0
    line, column = np.cumsum(first) - 1, place % LINE
    lines = int(line[-1]) + 1
    grid = np.ones((LINE, lines))
    grid[column, line] = odds
    size = np.bincount(line, minlength=lines)
    (t00, t01), (t10, t11) = move
    p = [np.ones(lines), np.zeros(lines), np.zeros(lines), np.ones(lines)]
    for t in range(int(size.max())):
        on = size > t
        e = grid[t]
        for i in (0, 2):
            x, y = p[i] * t00 + p[i + 1] * t10, (p[i] * t01 + p[i + 1] * t11) * e
            p[i], p[i + 1] = np.where(on, x, p[i]), np.where(on, y, p[i + 1])
        whole = p[0] + p[1] + p[2] + p[3]
        p = [x / whole for x in p]
    number = place[first] // LINE  # of a line within its text
    steps = [np.flatnonzero(number == k) for k in range(int(number.max()) + 1)]
    ahead, back = np.zeros(lines), np.ones(lines)
    for at in steps[1:]:
        a = ahead[at - 1]
        ahead[at] = (p[1][at - 1] + a * p[3][at - 1]) / (p[0][at - 1] + a * p[2][at - 1])
    for at in steps[:0:-1]:
        b = back[at]
        back[at - 1] = (p[2][at] + p[3][at] * b) / (p[0][at] + p[1][at] * b)
    left, right = np.ones_like(grid), np.ones_like(grid)
    a = ahead
    for t in range(int(size.max())):
        a = left[t] = grid[t] * (t01 + a * t11) / (t00 + a * t10)
    b = back
    for t in range(int(size.max()) - 1, -1, -1):
        right[t] = b
        c = grid[t] * b
        b = np.where(size > t, (t10 + t11 * c) / (t00 + t01 * c), b)
    left, right = left[column, line], right[column, line]
    both = left * right
    return both / (1.0 + both), left, right


@dataclass
class Chain:
    """weights by index, bias, log transition scores [from][to], score of a text without tokens."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    prior: float

    def odds(self, features: np.ndarray) -> np.ndarray:
        total = np.full(features.shape[1], self.bias)
        for row in features:
            total += self.weights[row]
        return np.exp(total.clip(-30, 30))

    def tag(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, Tokens]:
        """The score of each text, and the marginals of all tokens."""
        tokens = Tokens.of(column)
        m = marginals(self.odds(tokens.features()), tokens.doc, np.exp(self.transition))[0]
        score = np.full(len(tokens.off) - 1, self.prior)
        head = np.flatnonzero(np.concatenate([[True], tokens.doc[1:] != tokens.doc[:-1]])) if len(m) else np.zeros(0, int)
        if len(head):
            score[tokens.doc[head]] = np.maximum.reduceat(m, head)
        return score, m, tokens


def spans_of(m: np.ndarray, tokens: Tokens) -> list[list[dict]]:
    """For each text the runs of tokens with a marginal of 0.5 or more: start and end in characters, and the largest marginal."""
    out: list[list[dict]] = [[] for _ in range(len(tokens.off) - 1)]
    hit = np.flatnonzero(m >= 0.5)
    if not len(hit):
        return out
    chars = np.concatenate([[0], np.cumsum((tokens.raw & 0xC0) != 0x80)])
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (tokens.doc[hit[1:]] != tokens.doc[hit[:-1]])])
    head = np.flatnonzero(new)
    last = hit[np.append(head[1:], len(hit)) - 1]
    first = hit[head]
    doc = tokens.doc[first]
    base = chars[tokens.off[doc]]
    for d, a, b, p in zip(doc.tolist(), (chars[tokens.start[first]] - base).tolist(), (chars[tokens.start[last] + tokens.length[last]] - base).tolist(), np.maximum.reduceat(m[hit], head).tolist(), strict=True):
        out[d].append({"start": a, "end": b, "p": p})
    return out


def _explaining(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind (0: word, else length of the prefix) and text of every feature that can explain a text, once a text."""
    word, short = tokens.words()
    h = np.concatenate([word, *short])
    kind = np.repeat([0, *PREFIXES], len(word))
    doc = np.tile(tokens.doc, 1 + len(PREFIXES))
    some = np.flatnonzero(h != 0)
    h, kind, doc = h[some], kind[some], doc[some]
    order = np.lexsort((doc, h))
    h, kind, doc = h[order], kind[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], kind[new], doc[new]


@tidy
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hashes of each text's five-word shingles under two seeds, which near copies share; a text without words has its own."""
    for batch in byte_slices(batches):
        g, off = shingle_sets(batch.column("text"), 5)
        out = []
        for seed in (1, 2):
            least = batch.column("doc_id").to_numpy().astype(np.uint64)
            some = np.flatnonzero(np.diff(off))
            if len(some):
                least[some] = np.minimum.reduceat(mix(g ^ (np.uint64(seed) * _ODD)), off[some])
            out.append(pa.array(least.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "one", "two"])


@tidy
def _associations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by label, summed over the batch."""
    for batch in byte_slices(batches):
        h, kind, doc = _explaining(Tokens.of(batch.column("text")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
        keys, many = counts_of(h)
        first = np.searchsorted(h, keys)
        bad = np.add.reduceat(toxic, first) if len(first) else many
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(kind[first].astype(np.int32)), pa.array(bad), pa.array(many - bad)], ["feature", "kind", "toxic", "clean"])


def _explained(sent):
    """For each toxic text the candidate features that it holds."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in byte_slices(batches):
            h, _, doc = _explaining(Tokens.of(batch.column("text")))
            hit = np.isin(h, wanted)
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array([batch.column("doc_id")[int(d)].as_py() for d in doc[hit]], pa.int64())], ["feature", "doc_id"])

    return run


class _Step:
    """AdaGrad steps on the conditional likelihood of whole sequences."""

    def __init__(self, chain: Chain, s: Settings):
        self.w, self.bias, self.tr, self.s = chain.weights.astype(np.float64), chain.bias, chain.transition.copy(), s
        self.seen, self.seen_rest = np.full(len(self.w), 1e-2), np.full(5, 1e-2)

    def take(self, features: np.ndarray, doc: np.ndarray, y: np.ndarray) -> None:
        chain = Chain(self.w, self.bias, self.tr, 0.0)
        move = np.exp(self.tr)
        odds = chain.odds(features)
        m, left, right = marginals(odds, doc, move)
        off = y - m
        n = doc[-1] - doc[0] + 1
        near = np.flatnonzero(np.abs(off) > 1e-7)
        g = np.bincount(features[:, near].ravel(), weights=np.tile(off[near], len(features)), minlength=len(self.w)) / n
        g[_NONE] = 0.0
        at = np.flatnonzero(g)
        g = g[at] - self.s.decay * self.w[at]
        self.seen[at] += g * g
        self.w[at] += self.s.rate * g / np.sqrt(self.seen[at])
        # pairs: the token before the first one is clean
        new = np.concatenate([[True], doc[1:] != doc[:-1]])
        from_left = np.where(new, 0.0, np.concatenate([[0.0], left[:-1]]))
        pair = np.stack([np.full(len(odds), move[0, 0]), move[0, 1] * odds * right, from_left * move[1, 0], from_left * move[1, 1] * odds * right])
        pair /= pair.sum(axis=0)
        was = np.where(new, 0, np.concatenate([[0], y[:-1]]))
        gold = np.stack([(was == i) & (y == j) for i in (0, 1) for j in (0, 1)])
        rest = np.concatenate([(gold - pair).sum(axis=1) / n - self.s.decay * self.tr.ravel(), [off.sum() / n - self.s.decay * self.bias]])
        self.seen_rest += rest * rest
        rest = 0.3 * self.s.rate * rest / np.sqrt(self.seen_rest)
        self.tr = self.tr + rest[:4].reshape(2, 2)
        self.bias += float(rest[4])


def _fit(sent, s: Settings):
    """A part's weights after some passes over its texts."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        chain, explaining = sent.value
        table = table.sort_by("doc_id")
        tokens = Tokens.of(table.column("text"))
        features = tokens.features()
        word, short = tokens.words()
        toxic = table.column("toxic").to_numpy()[tokens.doc] == 1
        y = (toxic & np.any([np.isin(h, explaining) for h in (word, *short)], axis=0)).astype(np.int64)
        step = _Step(chain, s)
        texts = np.unique(tokens.doc)
        for k in range(s.epochs):
            order = np.random.default_rng(k).permutation(len(texts))
            for a in range(0, len(order), s.batch):
                chosen = np.sort(texts[order[a : a + s.batch]])
                lo, hi = np.searchsorted(tokens.doc, chosen), np.searchsorted(tokens.doc, chosen, side="right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi, strict=True)])
                step.take(features[:, at], np.searchsorted(chosen, tokens.doc[at]), y[at])
        moved = np.flatnonzero(step.w != chain.weights)
        return pa.table({"at": pa.array([moved.astype(np.int32).tobytes()], pa.binary()), "change": pa.array([(step.w - chain.weights)[moved].astype(np.float32).tobytes()], pa.binary()), "bias": [step.bias], "transition": pa.array([step.tr.tobytes()], pa.binary()), "texts": pa.array([len(texts)], pa.int64())})

    return run


def _taken(candidates: list, texts_of: dict[int, set[int]], tested: int, share: float, least: int) -> list[int]:
    """Features whose association is no chance among so many tested ones, and in order of association others that
    explain `least` texts that none before them does.  share: of toxic texts in the sample."""
    # among features that stand out about as much (within 3 %) the most specific comes first
    rank = lambda r: (-round(np.log(max(0.5, r["toxic"] - 4 * r["clean"])) / 0.03), r["kind"] != 0, -r["kind"], r["feature"])
    done: set[int] = set()
    taken = []
    for r in sorted(candidates, key=rank):
        t, n = r["toxic"], r["toxic"] + r["clean"]
        chance = t * np.log(t / n / share) + ((n - t) * np.log((n - t) / n / (1 - share)) if n > t else 0.0)
        new = texts_of.get(r["feature"], set()) - done
        if len(new) >= least or (chance > np.log(tested) + 3.0 and r["kind"] == 0):
            taken.append(r["feature"])
            done |= new
    return taken


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), learnable: F.Column | None = None) -> Chain:
    """Fits the chain on a bounded sample of labelled rows, chosen by the smallest hashes of the identifier.

    `learnable` marks rows of labels (doc_id, toxic) that may be learned from;
    by default those whose crc32 of doc_id as text does not leave 2 by 4.
    Null labels, and labels without a text, are ignored; of several labels of an identifier the largest counts.
    Very long texts are learned from as a whole.  Without a toxic text, or a feature that explains some, every score is 0.
    """
    spark = docs.sparkSession
    if learnable is None:
        learnable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    usable = labels.select(id_of(labels, "doc_id").alias("doc_id"), labels["toxic"].try_cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(learnable)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.join(docs.select(id_of(docs, id_col).alias("doc_id")), "doc_id", "left_semi")
    picked = []
    for label, many in ((1, settings.sample // 4), (0, settings.sample - settings.sample // 4)):
        picked += [(r[0], r[1]) for r in usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(many).collect()]
    chosen = spark.createDataFrame(picked, "doc_id long, toxic int")  # bounded by settings.sample
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    sample = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "text")
    sample = sample.mapInArrow(_sketched, "doc_id long, toxic int, shard int, text string, one long, two long")
    for sketch in ("one", "two"):  # near copies of a text are no evidence
        first = F.row_number().over(Window.partitionBy(sketch).orderBy("doc_id"))
        sample = sample.withColumn("place", first).where("place = 1").drop("place")
    sample = checkpointed(sample.drop("one", "two").repartition(SHARDS, "shard"))
    empty = Chain(np.zeros(_NONE + 1, np.float32), -30.0, np.zeros((2, 2)), 0.0)
    found = checkpointed(sample.mapInArrow(_associations, "feature long, kind int, toxic long, clean long").groupBy("feature").agg(F.min("kind").alias("kind"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    # bounded by the sample: features of its toxic texts that hardly any clean one has
    candidates = found.where((F.col("toxic") >= settings.least) & ((F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= settings.precision)).collect()
    if not candidates:
        return empty
    wanted = shared(spark, np.array([r["feature"] for r in candidates], np.int64).view(np.uint64))
    held = sample.where("toxic = 1").select("doc_id", "text").mapInArrow(_explained(wanted), "feature long, doc_id long").groupBy("feature").agg(F.collect_set("doc_id"))
    texts_of = {f: set(ids) for f, ids in held.collect()}  # bounded by the sample
    bad, clean = (sample.where(F.col("toxic") == k).count() for k in (1, 0))
    taken = _taken(candidates, texts_of, max(1, found.count()), bad / max(1, bad + clean), settings.least)
    if not taken:
        return empty
    explaining = np.array(taken, np.int64).view(np.uint64)
    done = set().union(*(texts_of[f] for f in taken))
    chain = Chain(np.zeros(_NONE + 1, np.float32), -4.0, np.zeros((2, 2)), (bad - len(done) + 0.5) / (bad - len(done) + clean + 10.0))
    for _ in range(settings.rounds):
        sent = shared(spark, (chain, explaining))
        parts = sample.groupBy("shard").applyInArrow(_fit(sent, settings), "at binary, change binary, bias double, transition binary, texts long").collect()  # SHARDS rows
        sent.destroy()
        share = np.array([r["texts"] for r in parts], float)
        share /= share.sum()
        change, by = np.zeros(_NONE + 1), np.zeros(_NONE + 1)
        for k, r in zip(share, parts, strict=True):
            at = np.frombuffer(r["at"], np.int32)
            change[at] += k * np.frombuffer(r["change"], np.float32)
            by[at] += k
        mean = lambda values: sum(k * v for k, v in zip(share, values, strict=True))
        weights = (chain.weights + change / np.maximum(by, 1e-9)).astype(np.float32)
        chain = Chain(weights, float(mean([r["bias"] for r in parts])), mean([np.frombuffer(r["transition"]).reshape(2, 2) for r in parts]), chain.prior)
    wanted.destroy()
    return chain


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _tagged(sent, threshold: float):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in byte_slices(batches, SLICE):
            score, m, tokens = chain.tag(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans_of(m, tokens), _SPANS)], ["doc_id", "score", "predicted", "spans"])

    return run


def score_texts(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted and spans (start, end, p in characters of the text) of every row.

    A text without tokens (null, empty, blank) gets the share of toxic texts among those that nothing explains.  Very long texts are
    tagged as a whole.  Equal texts have equal scores; repeated rows each give a row, other columns are not read, and an
    empty table gives none.
    """
    rows = docs.select(id_of(docs, id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_tagged(shared(docs.sparkSession, chain), settings.threshold), "doc_id long, score double, predicted int, spans array<struct<start: int, end: int, p: double>>")


def _clean_rows(sent, threshold: float, text_col: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in byte_slices(batches, SLICE, column=text_col):
            yield batch.filter(pa.array(chain.tag(batch.column(text_col))[0] < threshold, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns kept whatever their names."""
    chain = learn(docs, labels, text_col=text_col, settings=settings)
    return docs.mapInArrow(_clean_rows(shared(docs.sparkSession, chain), settings.threshold, text_col), docs.schema)
