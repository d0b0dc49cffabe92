"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

log p(word | history) = log p(class | history) + log p(member | class, history)
+ log p(word | member). The most frequent words are members of their own; all
others fall in shared members by a hash of their last letters, so that any
word, known or not, has one. Both softmax factors are maximum-entropy models
over hashed n-gram and skip features of the history, trained by gradient
updates on shards of the corpus, averaged by tokens. Within a shared member
words have their smoothed counts, and each keeps one share for words never
seen, so that the probabilities of all words sum to one.

That model is the prior of a bigram model whose counts are all kept, so that
what is learned of context grows with the corpus: p = (c(before, word) +
PRIOR * p0) / (c(before) + PRIOR). Words outside the head take part in it as
the rest of their member.

Texts are read once, as hashes of their words; then chunks of documents stand
as numbers. What a chunk needs to know of all counts (of its pairs and its
rare words, each once) it asks of buckets by hash, and scores when the answers
are back, so a pair that is frequent everywhere is one entry per chunk. Where
there are many buckets, chunks ask in groups, in two steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quiresmith.llm.common import id_crc, rows_of
from quiresmith.session import discard, materialize

FOLDS, HELD_OUT = 7, 2
#: At most so many words, the most frequent, are known to every task (and those with a member of their own); the others' counts are asked for.
HEAD_WORDS = 1 << 17
SINGLES, ENDINGS, MEMBERS = 24, 24, 16
CLASS_BITS, MEMBER_BITS = 14, 14
ROUNDS = 2
RATE = 0.5
#: Weight of the prior in the bigram model, in tokens.
PRIOR = 100.0
#: Tokens of a chunk of documents, of a shard of training, and of the corpus in a bucket.
CHUNK, SHARD, BUCKET = 1 << 20, 1 << 22, 1 << 21
#: Buckets that a chunk asks by itself; beyond them chunks ask in groups.
DIRECT = 128
#: No word has white space, so this is the end of a text.
END = b" "
_BATCH = 8192
_CACHED = 400_000
_CLASSES = SINGLES + ENDINGS
_OWN, _SHARED = SINGLES * MEMBERS, ENDINGS * MEMBERS
_LOW = 511  # bits of a code that tell the shared member


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, then its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def is_held_out() -> Column:
    """Whether a document is kept from learning; a null id counts as the empty text."""
    return F.pmod(id_crc("doc_id"), F.lit(FOLDS)) == HELD_OUT


def code_of(word: bytes) -> int:
    """What stands for a word: 55 bits of its hash, and its shared member, by its last two letters."""
    end = word[-2:]
    if not end.isascii():
        end = word.decode("utf-8", "surrogatepass")[-2:].encode("utf-8", "surrogatepass")
    return xxh64_intdigest(word) & ~_LOW | zlib.crc32(end) % _SHARED


class _Codes(dict):
    """Word -> its code as bytes, computed once while they are few enough."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _CACHED:
            self.clear()
        value = self[word] = code_of(word).to_bytes(8, "little")
        return value


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, codes (of 8 bytes each) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Codes()
        for batch in rows_of(batches):
            codes = [b"".join(map(own.__getitem__, words_of(t.as_py()))) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["doc_id", "held_out", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", is_held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, codes binary")


def count_codes(tokens: DataFrame, together: int = 1 << 21) -> DataFrame:
    """code, c over tokens(codes); each task adds up its own before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def table() -> pa.RecordBatch:
            codes, counts = np.unique(np.frombuffer(b"".join(held), "<i8"), return_counts=True)
            return pa.record_batch([pa.array(codes), pa.array(counts.astype(np.int64))], ["code", "c"])

        for batch in rows_of(batches):
            for codes in batch.column(0):
                held.append(codes.as_py())
                size += len(held[-1]) // 8
                if size >= together:
                    yield table()
                    held.clear()
                    size = 0
        if held:
            yield table()

    return tokens.select("codes").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of the head words, members, and the mass of each; plain arrays, so that it can be broadcast.

    Numbers 0, 1, ... are the head's words, the most frequent first, then come the rests of the shared members.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, tail_mass: np.ndarray, tail_tokens: np.ndarray, tokens: int, words: int) -> None:
        order = np.lexsort((codes, -counts))
        self.codes, counts = codes[order], counts[order]
        self.tokens, self.words = tokens, words
        n = len(codes)
        leaves = np.where(np.arange(n) < _OWN, np.arange(n), _OWN + (self.codes & np.uint64(_LOW)).astype(np.int64))
        self.leaves = np.concatenate((leaves, _OWN + np.arange(_SHARED))).astype(np.int32)
        mass = np.zeros(_OWN + _SHARED)
        mass[_OWN:] = tail_mass + 1.0  # one is the share of words never seen
        np.add.at(mass, leaves, counts + 1.0)
        self.log_mass = np.log10(np.maximum(mass, 1.0))
        by_class = mass.reshape(_CLASSES, MEMBERS)
        totals = by_class.sum(axis=1)
        self.class_bias = np.where(totals > 0, np.log(np.maximum(totals, 1.0) / mass.sum()), -60.0).astype(np.float32)
        self.member_bias = np.where(by_class > 0, np.log(np.maximum(by_class, 1.0) / np.maximum(totals, 1.0)[:, None]), -60.0).astype(np.float32)
        #: By number: the log of what its words have of their member, and how often it comes before a token.
        self.shares = np.log10(np.concatenate((counts + 1.0, tail_mass + 1.0)))
        self.counts = np.concatenate((counts, tail_tokens)).astype(float)
        slots = (self.codes >> np.uint64(44)).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        same = slots[order[1:]] == slots[order[:-1]]
        self.first, self.next = np.full(1 << 20, -1, np.int32), np.full(max(n, 1), -1, np.int32)
        self.first[slots[order[::-1]]] = order[::-1]
        self.next[order[:-1][same]] = order[1:][same]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of codes (uint64)."""
        n = len(self.codes)
        if not n:
            return (codes & np.uint64(_LOW)).astype(np.int32)
        out = self.first[(codes >> np.uint64(44)).astype(np.int64)]
        wrong = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(wrong):
            out[wrong] = at = self.next[out[wrong]]
            wrong = wrong[(at >= 0) & (self.codes[at] != codes[wrong])]
        rest = np.flatnonzero(out < 0)
        out[rest] = n + (codes[rest] & np.uint64(_LOW)).astype(np.int32)
        return out


def learn_vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS) -> Vocabulary:
    """The vocabulary of counts(code, c): whole levels of frequency make the head while they fit."""
    level = F.floor(4 * F.log2("c")).cast("int")
    levels = {r["level"]: (r["n"], r["c"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()}
    least, room = None, head_words
    for k in sorted(levels, reverse=True):
        room -= levels[k][0]
        if room < 0:
            break
        least = k
    in_head = level >= least if least is not None else F.lit(False)
    # The most frequent have members of their own in any case.
    top = counts.orderBy(F.col("c").desc(), "code").limit(_OWN).toArrow()
    head = pa.concat_tables([counts.where(in_head).toArrow(), top])
    codes, at = np.unique(head.column("code").to_numpy(), return_index=True)
    amounts = head.column("c").to_numpy()[at]
    mass, tokens = np.zeros(_SHARED), np.zeros(_SHARED)
    tail = counts.where(~in_head).groupBy(F.col("code").bitwiseAND(F.lit(_LOW).cast("long")).cast("int").alias("k"))
    for r in tail.agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("c")).collect():
        mass[r["k"]], tokens[r["k"]] = r["m"], r["c"]
    beyond = at >= head.num_rows - top.num_rows  # in the head by ``top`` alone
    shared = (codes[beyond] & _LOW).astype(np.int64)
    np.subtract.at(mass, shared, amounts[beyond] + 1.0)
    np.subtract.at(tokens, shared, amounts[beyond])
    return Vocabulary(codes.view(np.uint64), amounts.astype(float), mass, tokens, sum(c for _, c in levels.values()), sum(n for n, _ in levels.values()))


def _packed(numbers: np.ndarray, width: int) -> bytes:
    """Whole numbers of so many bytes, compressed by planes of bytes."""
    import zstandard

    planes = numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


class Chunk:
    """Documents as numbers: where each starts, which are held out, and the codes of words outside the head."""

    def __init__(self, numbers: bytes, lengths: bytes, held: bytes, rare: bytes = b"") -> None:
        self.numbers = _unpacked(numbers, 3).astype(np.int32)
        self.lengths, self.held = np.frombuffer(lengths, "<i4"), np.frombuffer(held, np.bool_)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.rare = np.frombuffer(rare, "<u8")

    def pairs(self, end: int) -> np.ndarray:
        """The number before each token, and its own, in one; a text starts after an end."""
        before = np.concatenate(([end], self.numbers[:-1])).astype(np.int64)
        before[self.starts] = end
        return before << 20 | self.numbers

    def by_token(self, rows: np.ndarray) -> np.ndarray:
        """Values of documents at each of their tokens."""
        return np.repeat(rows, self.lengths)


def chunked(tokens: DataFrame, vocabulary, size: int = CHUNK, most_docs: int = 50_000) -> DataFrame:
    """chunk, doc_ids, held, lengths, numbers, rare of tokens(doc_id, held_out, codes), documents together up to ``size`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        first, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        ids: list[pa.Array] = []
        held: list[bool] = []
        codes: list[bytes] = []

        def chunk() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(codes), "<u8")
            numbers = known.numbers(whole)
            columns = {
                "chunk": pa.array([first + made], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.concat_arrays(ids)),
                "held": pa.array([np.array(held, np.bool_).tobytes()], pa.binary()),
                "lengths": pa.array([np.array([len(c) // 8 for c in codes], "<i4").tobytes()], pa.binary()),
                "numbers": pa.array([_packed(numbers, 3)], pa.binary()),
                "rare": pa.array([whole[numbers >= len(known.codes)].tobytes()], pa.binary()),
            }
            return pa.record_batch(list(columns.values()), list(columns))

        waiting = 0
        for batch in rows_of(batches, 64):
            ids.append(batch.column(0))
            held += batch.column(1).to_pylist()
            codes += batch.column(2).to_pylist()
            waiting += sum(len(c) // 8 for c in codes[-batch.num_rows :])
            if waiting >= size or len(codes) >= most_docs:
                yield chunk()
                made += 1
                waiting = 0
                ids, held, codes = [], [], []
        if codes:
            yield chunk()

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "held_out", "codes").mapInArrow(run, f"chunk long, doc_ids array<{kind}>, held binary, lengths binary, numbers binary, rare binary")


_MIX = np.uint64(0x9E3779B97F4A7C15)


def histories(numbers: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Of each token's history: the word before, the two before, and the one two before; none reaches past a text's start."""
    h = numbers.astype(np.uint64) * _MIX ^ np.uint64(0xC2B2AE3D27D4EB4F)
    edge = np.uint64(0x51ED)
    one, two = np.concatenate(([edge], h[:-1])), np.concatenate(([edge, edge], h[:-2]))[: len(h)]
    one[starts] = two[starts] = edge
    after = starts + 1
    after = after[after < len(h)]
    two[after] = edge
    return [one, one * np.uint64(31) + two, two]


def _slots(features: list[np.ndarray], bits: int, also: np.ndarray | None = None) -> np.ndarray:
    """Slots of hashed features, a row each; ``also`` takes part in every hash."""
    shift = np.uint64(64 - bits)
    out = np.empty((len(features), len(features[0])), np.uint16)
    for k, x in enumerate(features):
        salted = x + np.uint64(k + 1) if also is None else x + (also + 17).astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(k + 1)
        out[k] = (salted * _MIX ^ salted >> np.uint64(31)) * _MIX >> shift
    return out


def _logits(w: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Logits of tokens, a row each, less the row's largest, so that no exponential overflows and one is 1."""
    out = w.take(slots[0], axis=0)
    for s in slots[1:]:
        out += w.take(s, axis=0)
    out += bias
    out -= out.max(axis=1, keepdims=True)
    return out


def log_p(w: np.ndarray, bias: np.ndarray, slots: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of the softmax's probability of each token's y."""
    logits = _logits(w, bias, slots)
    own = logits[np.arange(len(y)), y]
    np.exp(logits, out=logits)
    return own - np.log(logits.sum(axis=1))


def _sums(rows: np.ndarray, at: np.ndarray, firsts: np.ndarray, step: int = 16) -> np.ndarray:
    """Sums of runs of the rows at ``at``; runs start at ``firsts``. The k-th rows of all runs are added at once, and what is left of the few long ones as a whole."""
    sizes = np.diff(np.append(firsts, len(at)))
    out, live, k = rows.take(at[firsts], axis=0), np.flatnonzero(sizes > 1), 1
    while len(live) and k < step:
        out[live] += rows.take(at[firsts[live] + k], axis=0)
        k += 1
        live = live[sizes[live] > k]
    for run in live:
        out[run] += rows.take(at[firsts[run] + k : firsts[run] + sizes[run]], axis=0).sum(axis=0)
    return out


def update(w: np.ndarray, squares: np.ndarray, bias: np.ndarray, y: np.ndarray, slots: np.ndarray) -> None:
    """One gradient step on a batch of tokens; each slot's step shrinks with its past gradients."""
    p = _logits(w, bias, slots)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    n = len(y)
    p[np.arange(n), y] -= 1.0
    flat = slots.ravel()
    order = np.argsort(flat, kind="stable")
    sorted_ = flat[order]
    firsts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    gradient = _sums(p, order % n, firsts)
    at = sorted_[firsts]
    squares[at] += np.einsum("ij,ij->i", gradient, gradient)
    w[at] -= RATE * gradient / np.sqrt(squares[at] + 1.0)[:, None]


Weights = tuple[np.ndarray, np.ndarray]


def no_weights() -> Weights:
    """Weights before training: both factors have the shares of the counts."""
    return np.zeros((1 << CLASS_BITS, _CLASSES), np.float32), np.zeros((1 << MEMBER_BITS, MEMBERS), np.float32)


def _member_slots(features: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
    return _slots([features[0], features[2]], MEMBER_BITS, classes)


def train_round(chunks: DataFrame, vocabulary, shards: int, w: Weights, turn: int = 0, turns: int = 1, parts: int = 16) -> Weights:
    """Weights after every shard of chunks went on from ``w`` by itself: their mean by tokens.

    Takes the documents whose place in their chunk is ``turn`` of ``turns``;
    how many files held them changes neither shards nor steps. Moves are added
    up in two levels.
    """
    start = np.concatenate([x.ravel() for x in w])
    shared = chunks.sparkSession.sparkContext.broadcast(start)
    size, fold = -(-len(start) // parts), max(1, round(shards**0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        now, own, squares, tokens = None, None, None, 0

        def opened() -> None:
            nonlocal own, squares, tokens
            flat = shared.value.copy()
            cut = w_class_size
            own = (flat[:cut].reshape(1 << CLASS_BITS, -1), flat[cut:].reshape(1 << MEMBER_BITS, -1), flat)
            squares, tokens = (np.zeros(1 << CLASS_BITS, np.float32), np.zeros(1 << MEMBER_BITS, np.float32)), 0

        def closed() -> pa.RecordBatch:
            moved = (own[2] - shared.value).astype(np.float16)
            rows = [moved[k * size : (k + 1) * size].tobytes() for k in range(parts)]
            return pa.record_batch([pa.array(range(parts), pa.int32()), pa.array([now % fold] * parts, pa.int32()), pa.array([tokens] * parts, pa.int64()), pa.array(rows, pa.binary())], ["part", "fold", "tokens", "moved"])

        for batch in batches:
            for r in rows_of([batch], 1):
                shard = r.column("shard")[0].as_py()
                if shard != now:
                    if tokens:
                        yield closed()
                    now = shard
                    opened()
                chunk = Chunk(*(r.column(c)[0].as_py() for c in ("numbers", "lengths", "held")))
                taken = ~chunk.held & (np.arange(len(chunk.held)) % turns == turn)
                places = np.flatnonzero(chunk.by_token(taken))
                features = [x[places] for x in histories(chunk.numbers, chunk.starts)]
                leaves = known.leaves[chunk.numbers[places]]
                y, member = np.divmod(leaves, MEMBERS)
                for at in range(0, len(y), _BATCH):
                    cut = slice(at, at + _BATCH)
                    some = [x[cut] for x in features]
                    update(own[0], squares[0], known.class_bias, y[cut], _slots(some, CLASS_BITS))
                    update(own[1], squares[1], known.member_bias.take(y[cut], axis=0), member[cut], _member_slots(some, y[cut]))
                tokens += len(y)
        if tokens:
            yield closed()

    def total(level: int):
        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            moves, tokens = None, 0
            for batch in batches:
                for n, moved in zip(batch.column("tokens").to_pylist(), batch.column("moved")):
                    # A shard tells how far it moved, a sum of shards this times their tokens.
                    more = np.frombuffer(moved.as_py(), np.float16).astype(float) * n if level == 0 else np.frombuffer(moved.as_py(), np.float64)
                    moves, tokens = more if moves is None else moves + more, tokens + n
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([tokens], pa.int64()), pa.array([moves.tobytes()], pa.binary())], ["part", "tokens", "moved"])

        return add

    w_class_size = w[0].size
    # A shuffle deals chunks to shards; within a shard they come in order.
    dealt = chunks.select(F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int").alias("shard"), "chunk", "numbers", "lengths", "held")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "chunk")
    moves = dealt.mapInArrow(run, "part int, fold int, tokens long, moved binary")
    folded = moves.groupBy("part", "fold").applyInArrow(total(0), "part int, tokens long, moved binary")
    out = start.copy()
    for r in folded.groupBy("part").applyInArrow(total(1), "part int, tokens long, moved binary").collect():
        out[r["part"] * size : (r["part"] + 1) * size] += (np.frombuffer(r["moved"]) / max(r["tokens"], 1)).astype(np.float32)
    return out[:w_class_size].reshape(w[0].shape), out[w_class_size:].reshape(w[1].shape)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of distinct keys by their bucket, and where each bucket ends in it."""
    mixed = keys.astype(np.uint64) * _MIX
    bucket = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _asked(vocabulary, buckets: int, each: int = 1):
    """Kernel over chunks: a row for every ``each`` buckets with the chunk's pairs and rare words of these buckets, each once, and their counts in training."""
    lots = -(-buckets // each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        end = int(known.numbers(np.array([code_of(END)], np.uint64))[0])
        for r in rows_of(batches, 1):
            chunk = Chunk(*(r.column(c)[0].as_py() for c in ("numbers", "lengths", "held", "rare")))
            learned = ~chunk.by_token(chunk.held)
            blobs = []
            for keys, weight, width in ((chunk.pairs(end), learned, 5), (chunk.rare.view(np.int64), learned[chunk.numbers >= len(known.codes)], 8)):
                once, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at, weight, len(once)).astype(np.int64)
                order, ends = _by_bucket(once, buckets)
                ends = ends[np.minimum(np.arange(lots + 1) * each, buckets)]
                cuts = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]
                blobs += [[_packed(once[c], width) for c in cuts], [_packed(counts[c], 4) for c in cuts]]
            columns = [pa.array([r.column("chunk")[0].as_py()] * lots, pa.int64()), pa.array(range(lots), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)]
            yield pa.record_batch(columns, ["chunk", "bucket", "pairs", "pair_counts", "words", "word_counts"])

    return run


_KINDS = (("pair", 5), ("word", 8))


def _together(rows: list[dict], name: str, width: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The distinct keys of rows, where each row's keys stand among them, one row after the other, and where rows end."""
    keys = [_unpacked(r[f"{name}s"], width) for r in rows]
    once, at = np.unique(np.concatenate(keys), return_inverse=True)
    return once, at, np.cumsum([len(k) for k in keys])[:-1].tolist()


def _grouped(buckets: int, each: int):
    """Kernel over what a group of chunks asks of one lot of buckets: a row for each of these, with every key once and its counts in the group."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unit, lot, rows = key[0].as_py(), key[1].as_py(), table.to_pylist()
        first, last = lot * each, min(buckets, lot * each + each)
        out = {"chunk": [unit] * (last - first), "bucket": list(range(first, last))}
        for name, width in _KINDS:
            once, at, _ = _together(rows, name, width)
            counts = np.bincount(at, np.concatenate([_unpacked(r[f"{name}_counts"], 4) for r in rows]), len(once)).astype(np.int64)
            order, ends = _by_bucket(once, buckets)
            cuts = [order[a:b] for a, b in zip(ends[first:last], ends[first + 1 : last + 1])]
            out |= {f"{name}s": [_packed(once[c], width) for c in cuts], f"{name}_counts": [_packed(counts[c], 5) for c in cuts]}
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), kinds)], list(out))

    return run


def _handed_back(buckets: int):
    """Kernel over what a group of chunks asked of one lot of buckets, and the answers to the group: each chunk's answers."""

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, answers: pa.Table) -> pa.Table:
        rows, answers = asked.to_pylist(), answers.sort_by("bucket")
        out = {"chunk": [r["chunk"] for r in rows], "bucket": [r["bucket"] for r in rows]}
        for name, width in _KINDS:
            once, at, ends = _together(rows, name, width)
            order, _ = _by_bucket(once, buckets)
            total = np.empty(len(once), np.int64)
            total[order] = np.concatenate([_unpacked(x.as_py(), 5) for x in answers.column(f"{name}_counts")])
            out[f"{name}_counts"] = [_packed(x, 5) for x in np.split(total[at], ends)]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), kinds)], list(out))

    return run


def _answered(counts_width: int):
    """Kernel over rows of buckets, one bucket after the other: the counts over all chunks in place of the chunk's."""

    def answer(rows: list[dict]) -> pa.RecordBatch:
        out = {"chunk": [r["chunk"] for r in rows], "bucket": [r["bucket"] for r in rows]}
        for name, width in _KINDS:
            keys, counts = ([_unpacked(r[c], w) for r in rows] for c, w in ((f"{name}s", width), (f"{name}_counts", counts_width)))
            once, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, np.concatenate(counts), len(once)).astype(np.int64)[at]
            ends = np.cumsum([len(k) for k in keys])
            out[f"{name}_counts"] = [_packed(x, 5) for x in np.split(total, ends[:-1])]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(out.values(), kinds)], list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != held[-1]["bucket"]:
                    yield answer(held)
                    held = []
                held.append(r)
        if held:
            yield answer(held)

    return run


def exchange(chunks: DataFrame, vocabulary, buckets: int) -> DataFrame:
    """chunk, bucket, pair_counts, word_counts: what each chunk asks of all counts, answered, in parts whose order is that of ``bucket``.

    Up to ``DIRECT`` buckets every chunk asks each of them. Beyond, buckets
    are in lots and chunks in groups, about as many of either in one as the
    root of the buckets: a chunk asks lots, a group of chunks asks the buckets
    of a lot, with every key once, and answers come back the same way. So a
    chunk has as many rows as that root, and not as all buckets.
    """
    kind = "chunk long, bucket int, pairs binary, pair_counts binary, words binary, word_counts binary"
    back = "chunk long, bucket int, pair_counts binary, word_counts binary"
    wanted = chunks.select("chunk", "numbers", "lengths", "held", "rare")
    each = 1 if buckets <= DIRECT else round(buckets**0.5)
    asked = wanted.mapInArrow(_asked(vocabulary, buckets, each), kind)

    def answered(rows: DataFrame, width: int) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(_answered(width), back)

    if each == 1:
        return answered(asked, 4)
    lots, groups = -(-buckets // each), max(1, -(-asked.count() // (each * -(-buckets // each))))
    # A group's number and the lot make one number: a unit that asks as a chunk does.
    asked = asked.withColumn("unit", F.pmod(F.xxhash64("chunk"), F.lit(groups)) * lots + F.col("bucket"))
    grouped = asked.groupBy("unit", "bucket").applyInArrow(_grouped(buckets, each), kind)
    answers = answered(grouped, 5)
    return asked.groupBy("unit").cogroup(answers.withColumnRenamed("chunk", "unit").groupBy("unit")).applyInArrow(_handed_back(buckets), back)


def _scored(vocabulary, weights, buckets: int):
    """Kernel over a chunk and its answers: a row per document."""

    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table, answers: pa.Table) -> pa.Table:
        known: Vocabulary = vocabulary.value
        w = weights.value
        end = int(known.numbers(np.array([code_of(END)], np.uint64))[0])
        chunk = Chunk(*(chunks.column(c)[0].as_py() for c in ("numbers", "lengths", "held", "rare")))
        answers = answers.sort_by("bucket")

        def counted(keys: np.ndarray, column: str) -> np.ndarray:
            once, at = np.unique(keys, return_inverse=True)
            order, _ = _by_bucket(once, buckets)
            counts = np.empty(len(once), np.int64)
            counts[order] = np.concatenate([_unpacked(x.as_py(), 5) for x in answers.column(column)])
            return counts[at]

        numbers = chunk.numbers
        pairs = chunk.pairs(end)
        seen = counted(pairs, "pair_counts")
        tail = np.flatnonzero(numbers >= len(known.codes))
        own = known.counts[numbers]
        own[tail] = counted(chunk.rare.view(np.int64), "word_counts")
        # What a word has of its number's share: all of it, but for rare words.
        within = np.zeros(len(numbers))
        within[tail] = np.log10(own[tail] + 1) - known.shares[numbers[tail]]
        leaves = known.leaves[numbers]
        y, member = np.divmod(leaves, MEMBERS)
        features = histories(numbers, chunk.starts)
        logs = np.empty(len(y))
        for at in range(0, len(y), _BATCH):
            cut = slice(at, at + _BATCH)
            some = [x[cut] for x in features]
            logs[cut] = log_p(w[0], known.class_bias, _slots(some, CLASS_BITS), y[cut])
            logs[cut] += log_p(w[1], known.member_bias.take(y[cut], axis=0), _member_slots(some, y[cut]), member[cut])
        prior = logs / np.log(10) + known.shares[numbers] - known.log_mass[leaves]
        model = np.log10(seen + PRIOR * 10.0**prior) - np.log10(known.counts[pairs >> 20] + PRIOR) + within
        base = np.log10(own + 1) - np.log10(known.tokens + known.words + 1)
        sums = [np.add.reduceat(x, chunk.starts) for x in (own > 0, base, model)]
        ids = chunks.column("doc_ids").combine_chunks().flatten()
        columns = [ids, pa.array(chunk.held), pa.array(chunk.lengths, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def learn(docs: DataFrame, head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> tuple[Vocabulary, Weights, DataFrame]:
    """Vocabulary and weights from docs(doc_id, text) that are not held out, and all documents in chunks."""
    tokens = materialize(tokens_of(docs), "lm-tokens")
    counts = materialize(count_codes(tokens.where(~F.col("held_out"))), "lm-counts")
    known = learn_vocabulary(counts, head_words)
    vocabulary = docs.sparkSession.sparkContext.broadcast(known)
    chunks = materialize(chunked(tokens, vocabulary), "lm-chunks")
    discard(tokens, counts)
    w = no_weights()
    for k in range(rounds):
        w = train_round(chunks, vocabulary, known.tokens // SHARD + 1, w, k, rounds)
    return known, w, chunks


def score(docs: DataFrame, head_words: int = HEAD_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text), a row each.

    Counts and gradients come from all documents that are not held out; the
    rounds of training share them, one pass over each. A null text counts as
    empty: one token, its end. Whole texts of any length are scored. Null ids
    and repeated rows stay; an empty table gives no rows. Words are told apart
    by 55 bits of their hash and their last letters.
    """
    known, w, chunks = learn(docs, head_words, rounds)
    context, buckets = docs.sparkSession.sparkContext, known.tokens // BUCKET + 1
    vocabulary, weights = context.broadcast(known), context.broadcast(w)  # of fixed size
    answers = exchange(chunks, vocabulary, buckets)
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    rows = both.applyInArrow(_scored(vocabulary, weights, buckets), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")
