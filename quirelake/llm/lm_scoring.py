"""Language-model scores: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Tokens are the words between ASCII white space, A-Z lower-cased, and one end a text. A context of two tokens predicts a
vector, the sum of their vectors times position weights, and the next token is drawn in up to three steps:

1. an output: one of the ``words`` most frequent words (the end among them), or one of ``classes`` classes of all
   other words by their last two characters;
2. in a class, a slot: one of the class's ``inner`` words (the next most frequent ones over all classes) or its rest;
3. in a rest, a word by its smoothed share (c + 0.1) / (N_rest + 0.1 (V_rest + 1)).

Steps 1 and 2 are log-bilinear, with vectors of their own for outputs and slots: a logit is the product of the predicted
vector with that of the output or slot plus a bias, and batched matrix products, over all outputs and over the slots of
a class, give normalised log-probabilities. So the probabilities of all words seen and of one unseen word a class sum to
1, and normalising costs some 300 products a token instead of one a word. In a context each of the ``words`` and
``inner`` words has a vector, other words have that of their class.

Corpus statistics come from all training texts: word counts by an aggregate, stored in the shared folder. Training
passes once over all training tokens: every task trains on its own texts from common parameters with noise-contrastive
estimation (noise by frequency, outputs shared by a batch and slots by a class in it; normalisers fixed at 1), and the tasks' parameters are averaged by an aggregate, weighted by tokens; a first round sees a quarter of the
texts, a second the others. So scores depend on how the table is split into tasks; runs over the same splits agree.
Scoring knows the ``frequent`` most frequent words in the task; the other words of a text are joined to the counts.

Defined results: a null text counts as empty and has the end alone; very long texts are scored whole; repeated rows each
get a row; ids may be null; without training texts N = 0 and the model is uniform over its outputs; an empty table gives
no rows; columns beyond the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, id_crc, splits_of, stored
from .words import SHORT, Table, distinct_keys, lowered, short_bytes, short_keys, spans, text_buffer, word_places

#: The end of a text among the words; no word can hold a space.
END = " "
CONTEXT, WIDTH, NOISE, SLOT_NOISE, BATCH = 2, 15, 64, 8, 4096
RATES = (0.1, 0.1)
ROUNDS = 4  # the hash of a text's id by this: 0 trains in the first round, the others in the second
#: Tokens whose logits are held at once in scoring: few enough to stay in the processor's cache.
ROWS = 1024
#: Distinct words that a task counts before it passes the counts on.
COUNTED_WORDS = 500_000
#: Parameters in a row on their way to the average.
_PART = 1 << 14


# --- counts and the vocabulary --------------------------------------------------------------------------------------


def count_words(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(word, c) over all texts, the end among the words. Tasks count their own words before any is shuffled."""
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        table, low, high, counts, long, ends = Table(), [], [], np.zeros(0, np.int64), {}, 0

        def held():
            flat, lengths = short_bytes(np.concatenate(low), np.concatenate(high))
            words = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(flat))
            yield pa.RecordBatch.from_arrays([words, pa.array(counts)], ["word", "c"])

        for batch in batches:
            data, bounds = text_buffer(batch.column(0))
            data, ends = lowered(data), ends + batch.num_rows
            starts, lengths = word_places(data, bounds)
            short = lengths <= SHORT
            a, b = short_keys(data, starts[short], lengths[short])
            found = table.find(a, b)
            missing = np.flatnonzero(found < 0)
            if len(missing):
                first, number = distinct_keys(a[missing], b[missing])
                first = missing[first]
                table.add(a[first], b[first], table.count + np.arange(len(first)))
                found[missing] = table.count - len(first) + number
                low.append(a[first])
                high.append(b[first])
            counts = np.bincount(found, minlength=table.count) + np.pad(counts, (0, table.count - len(counts)))
            for at, n in zip(starts[~short].tolist(), lengths[~short].tolist(), strict=True):
                word = data[at : at + n].tobytes()
                long[word] = long.get(word, 0) + 1
            if table.count > COUNTED_WORDS:
                yield from held()
                table, low, high, counts = Table(), [], [], np.zeros(0, np.int64)
            if len(long) > COUNTED_WORDS // 10 or sum(map(len, long)) > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in long], pa.string()), pa.array(list(long.values()), pa.int64())], ["word", "c"])
                long = {}
        if table.count:
            yield from held()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END, *[w.decode() for w in long]], pa.string()), pa.array([ends, *long.values()], pa.int64())], ["word", "c"])

    counted = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "word string, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The frequent words by rank, and where words stand among outputs, slots and context symbols."""

    known: list[bytes]  # by rank; the end first, if there are training texts
    counts: np.ndarray  # by rank
    words: int  # how many of them are outputs
    inner: int  # how many more are slots
    suffixes: list[bytes]  # the classes but the last, which has all other endings
    class_mass: np.ndarray  # words counted in a class
    rest_norm: np.ndarray  # log10 of the denominator of a class's rest
    slot_starts: np.ndarray  # first slot of each class, its rest, and the end of the last class
    slot_mass: np.ndarray  # words counted in a slot
    output: np.ndarray  # by rank
    slot: np.ndarray  # by rank; -1 for outputs
    symbol: np.ndarray  # by rank
    total: int
    distinct: int

    @property
    def outputs(self) -> int:
        return self.words + len(self.suffixes) + 1

    @property
    def symbols(self) -> int:
        return self.words + self.inner + len(self.suffixes) + 1

    def lookup(self) -> tuple[Table, dict[bytes, int], np.ndarray, np.ndarray]:
        """(table of short words, ranks of long ones, sorted suffix numbers, their classes)."""
        lengths = np.array([len(w) for w in self.known], np.int64)
        short = np.flatnonzero(lengths <= SHORT)
        short = short[short > 0] if self.known and self.known[0] == END.encode() else short
        data, starts = np.frombuffer(b"".join(self.known), np.uint8), np.cumsum(lengths) - lengths
        table = Table()
        if len(short):
            table.add(*short_keys(data, starts[short], lengths[short]), short)
        numbers = np.array([int.from_bytes(s, "little") for s in self.suffixes], np.uint64)
        order = np.argsort(numbers)
        return table, {w: k for k, w in enumerate(self.known) if len(w) > SHORT}, numbers[order], order


def suffix_of(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The last two characters of words as numbers, from their ends and lengths in a buffer."""
    found, number, going = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.uint64), np.ones(len(ends), bool)
    for k in range(1, 9):
        going &= (lengths >= k) & (found < 2)
        byte = data[np.maximum(ends - k, 0)]
        number = np.where(going, (number << np.uint64(8)) | byte, number)
        found += going & ((byte & 0xC0) != 0x80)
    return number


def build_vocabulary(counts: DataFrame, *, words: int = 96, classes: int = 64, inner: int = 8_000, frequent: int = 60_000) -> Vocabulary:
    """From (word, c): three aggregates, of which bounded parts reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.filter(F.col("word") == END).collect()
    others = counts.filter(F.col("word") != END)
    own = end + others.orderBy(F.desc("c"), "word").limit(words - len(end)).collect()
    # The frequent words by a threshold from a histogram of counts: a top-k would send as many rows from every partition.
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    held, least = len(own), None
    for row in sorted(others.groupBy(level.alias("level")).count().collect(), reverse=True):
        if held + row["count"] > frequent:
            break
        held, least = held + row["count"], row["level"]
    taken = {r["word"] for r in own}
    more = [] if least is None else [r for r in others.filter(level >= least).collect() if r["word"] not in taken]
    top = own + sorted(more, key=lambda r: (-r["c"], r["word"]))
    inner = min(inner, len(top) - len(own))
    split = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r["word"],) for r in own] or [("",)], "w string")), F.col("word") == F.col("w"), "left_anti")
    sums = split.groupBy(F.right("word", F.lit(2)).alias("suffix")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    named = sums.orderBy(F.desc("n"), "suffix").limit(classes - 1).collect()
    suffixes = [r["suffix"].encode("utf-8", "surrogatepass") for r in named]
    mass, kinds = [r["n"] for r in named], [r["v"] for r in named]
    mass, kinds = [*mass, total - sum(r["c"] for r in own) - sum(mass)], [*kinds, distinct - len(own) - sum(kinds)]
    place = {s: k for k, s in enumerate(suffixes)}
    known = [r["word"].encode("utf-8", "surrogatepass") for r in top]
    top_counts = np.array([r["c"] for r in top], np.int64)
    group = np.array([place.get(r["word"][-2:].encode("utf-8", "surrogatepass"), len(suffixes)) for r in top], np.int64)
    slotted = np.arange(len(own), len(own) + inner)
    sizes = np.bincount(group[slotted], minlength=len(mass)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    slot, order = starts[group], slotted[np.argsort(group[slotted], kind="stable")]
    within = np.arange(inner) - np.searchsorted(group[order], group[order]) + 1
    slot[order] = starts[group[order]] + within
    slot[: len(own)] = -1
    slot_mass, inner_mass = np.zeros(starts[-1]), np.bincount(group[slotted], weights=top_counts[slotted], minlength=len(mass))
    slot_mass[slot[order]] = top_counts[order]
    rest = np.array(mass) - inner_mass
    slot_mass[starts[:-1]] = rest
    norm = np.log10(rest + 0.1 * (np.array(kinds) - (sizes - 1) + 1.0))
    output, ranks = len(own) + group, np.arange(len(top))
    output[: len(own)] = np.arange(len(own))
    symbol = np.where(ranks < len(own) + inner, ranks, inner + output)
    return Vocabulary(known, top_counts, len(own), inner, suffixes, np.array(mass, np.float64), norm, starts, slot_mass, output, slot, symbol, int(total), int(distinct))


# --- the model ------------------------------------------------------------------------------------------------------


def shapes(vocabulary: Vocabulary) -> list[tuple[int, int]]:
    """Context vectors; vectors and biases of outputs; of slots; position weights."""
    return [(vocabulary.symbols, WIDTH), (vocabulary.outputs, WIDTH + 1), (len(vocabulary.slot_mass), WIDTH + 1), (CONTEXT, WIDTH)]


def unpack(flat: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    found, at = [], 0
    for rows, columns in shapes(vocabulary):
        found.append(flat[at : at + rows * columns].reshape(rows, columns))
        at += rows * columns
    return found


def initial(vocabulary: Vocabulary, seed: int = 11) -> np.ndarray:
    """Parameters in one flat vector; biases are log frequencies, those of slots within their class."""
    draw = np.random.default_rng(seed)
    flat = np.concatenate([draw.normal(0, 0.1, rows * columns) for rows, columns in shapes(vocabulary)]).astype(np.float32)
    _, outputs, slots, positions = unpack(flat, vocabulary)
    positions[:] = 1.0
    outputs[:, -1], slots[:, -1] = np.log(output_noise(vocabulary)), np.log(slot_noise(vocabulary))
    return flat


def output_noise(vocabulary: Vocabulary) -> np.ndarray:
    mass = np.concatenate([vocabulary.counts[: vocabulary.words], vocabulary.class_mass]) + 0.1
    return mass / mass.sum()


def slot_noise(vocabulary: Vocabulary) -> np.ndarray:
    """Each slot's share in its class."""
    mass, starts = vocabulary.slot_mass + 0.1, vocabulary.slot_starts
    return mass / np.repeat(np.add.reduceat(mass, starts[:-1]), np.diff(starts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; far below zero exp gives infinity, and this 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1.0
    return np.divide(1.0, x, out=x)


class Trainer:
    """Noise-contrastive estimation with AdaGrad on minibatches; only the rows that a batch names change."""

    def __init__(self, flat: np.ndarray, vocabulary: Vocabulary, rate: float = 0.05, seed: int = 5):
        self.flat, self.rate, self.draw, self.seen = flat.copy(), rate, np.random.default_rng(seed), 0
        self.parts, self.squares = unpack(self.flat, vocabulary), unpack(np.full(len(flat), 1.0, np.float32), vocabulary)
        noise = output_noise(vocabulary)
        self.output_steps, self.output_logs = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)
        share, self.starts = slot_noise(vocabulary), vocabulary.slot_starts
        # Class k's shares add up to 1 and stand in (k, k + 1), so that one search draws from any class.
        self.slot_steps = np.cumsum(share)
        self.slot_steps[self.starts[1:] - 1] = np.arange(1, len(self.starts))
        self.slot_logs, self.words = np.log(share * SLOT_NOISE).astype(np.float32), vocabulary.words

    def push(self, part: int, rows: np.ndarray, gradients: np.ndarray) -> None:
        """Sum the gradients by row, the rows being in order, and take a step."""
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        summed, rows = np.add.reduceat(gradients, first, axis=0), rows[first]
        squares = self.squares[part][rows] + summed * summed
        self.squares[part][rows] = squares
        self.parts[part][rows] -= self.rate * summed / np.sqrt(squares)

    def step(self, read: Read, at: np.ndarray) -> None:
        contexts, outputs, slots, weights = self.parts
        # By output, and in a class by slot: slots are numbered class by class, and classes come after the words.
        slot = read.slots[at]
        at = at[np.argsort(np.where(slot < 0, read.outputs[at], self.words + slot))]
        target, slot, n = read.outputs[at], read.slots[at], len(at)
        before = read.symbols[read.places[at] - np.arange(1, CONTEXT + 1)[:, None]]
        vectors = contexts[before]
        guess = np.ones((n, WIDTH + 1), np.float32)
        guess[:, :-1] = (vectors * weights[:, None]).sum(0)
        drawn = np.sort(np.minimum(np.searchsorted(self.output_steps, self.draw.random(NOISE)), len(outputs) - 1))
        # d(-log likelihood)/d(logit) of the data and of the noise.
        own, other = outputs[target], outputs[drawn]
        up = sigmoid(np.einsum("ij,ij->i", guess, own) - self.output_logs[target]) - 1
        down = sigmoid(guess @ other.T - self.output_logs[drawn])
        pull = up[:, None] * own + down @ other
        self.push(1, drawn, down.T @ guess)
        self.push(1, target, up[:, None] * guess)
        # Slots by class: the tokens are in the order of their outputs, and the classes come last.
        inside = int(np.searchsorted(target, self.words))
        if inside < n:
            near, held, kind = guess[inside:], slot[inside:], target[inside:] - self.words
            own = slots[held]
            up = sigmoid(np.einsum("ij,ij->i", near, own) - self.slot_logs[held]) - 1
            turn = up[:, None] * own
            edges = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
            present = kind[edges]
            noise = np.searchsorted(self.slot_steps, present[:, None] + self.draw.random((len(present), SLOT_NOISE)), side="right")
            noise = np.sort(np.clip(noise, self.starts[present][:, None], self.starts[present + 1][:, None] - 1))
            rows, logs, away = slots[noise], self.slot_logs[noise], np.empty((len(present), SLOT_NOISE, WIDTH + 1), np.float32)
            for k, (i, j) in enumerate(zip(edges.tolist(), [*edges[1:].tolist(), n - inside], strict=True)):
                down = sigmoid(near[i:j] @ rows[k].T - logs[k])
                turn[i:j] += down @ rows[k]
                away[k] = down.T @ near[i:j]
            pull[inside:] += turn
            self.push(2, noise.ravel(), away.reshape(-1, WIDTH + 1))
            self.push(2, held, up[:, None] * near)
        pull = pull[:, :-1]
        steps = (pull * vectors).sum(1)
        rows = before.ravel()
        order = np.argsort(rows)
        self.push(0, rows[order], (pull * weights[:, None]).reshape(-1, WIDTH)[order])
        self.push(3, np.arange(CONTEXT), steps)
        self.seen += n


@dataclass
class Read:
    """The tokens of some texts: symbols with CONTEXT ends before each text; for each token its place there, its output,
    slot (or -1), rank (or -1) and text; and the unknown words in their order, as bytes and lengths."""

    symbols: np.ndarray
    places: np.ndarray
    outputs: np.ndarray
    slots: np.ndarray
    ranks: np.ndarray
    owner: np.ndarray
    tails: np.ndarray  # how many unknown words a text has
    tail: tuple[np.ndarray, np.ndarray]


class Reader:
    """Texts to tokens by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.table, self.long, self.suffix_numbers, self.suffix_classes = vocabulary.lookup()

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> Read:
        v, texts = self.vocabulary, len(bounds) - 1
        data = lowered(data)
        starts, lengths = word_places(data, bounds)
        ranks = np.full(len(starts), -1, np.int64)
        short = lengths <= SHORT
        ranks[short] = self.table.find(*short_keys(data, starts[short], lengths[short]))
        long = np.flatnonzero(~short)
        if len(long) and self.long:
            ranks[long] = [self.long.get(data[a : a + n].tobytes(), -1) for a, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
        rare = np.flatnonzero(ranks < 0)
        group = np.full(len(rare), len(v.suffixes), np.int64)
        if v.suffixes:
            numbers = suffix_of(data, starts[rare] + lengths[rare], lengths[rare])
            at = np.minimum(np.searchsorted(self.suffix_numbers, numbers), len(v.suffixes) - 1)
            group = np.where(self.suffix_numbers[at] == numbers, self.suffix_classes[at], group)
        if len(v.known):
            outputs, slots, symbols = (x.astype(np.int32)[ranks] for x in (v.output, v.slot, v.symbol))
        else:
            outputs, slots, symbols = (np.zeros(len(ranks), np.int32) for _ in range(3))
        outputs[rare], slots[rare], symbols[rare] = v.words + group, v.slot_starts[group], v.words + v.inner + group
        # The end after the words of every text, and CONTEXT ends before them.
        has_end = len(v.known) > 0
        end = (0, -1, 0, 0) if has_end else (v.words + len(v.suffixes), v.slot_starts[-2], v.words + v.inner + len(v.suffixes), -1)
        upto = np.searchsorted(starts, bounds[1:])
        tails = np.bincount(np.searchsorted(upto, rare, side="right"), minlength=texts)
        outputs, slots, symbols, ranks = (np.insert(x, upto, e) for x, e in zip((outputs, slots, symbols, ranks), end, strict=True))
        sizes = np.diff(np.concatenate([[0], upto])) + 1
        owner = np.repeat(np.arange(texts), sizes)
        places = np.arange(len(owner)) + (owner + 1) * CONTEXT
        row = np.full(len(owner) + texts * CONTEXT, end[2], np.int32)
        row[places] = symbols
        return Read(row, places, outputs, slots, ranks, owner, tails, (data[spans(starts[rare], lengths[rare])], lengths[rare]))


def groups_of(bounds: np.ndarray, most: int = 400_000):
    """(first, stop) of runs of texts of about so many bytes; a text is never cut."""
    marks = np.searchsorted(bounds, np.arange(most, int(bounds[-1]) + most, most)) if len(bounds) > 1 else []
    edges = np.unique(np.concatenate([[0], np.minimum(marks, len(bounds) - 1), [len(bounds) - 1]])).astype(int).tolist()
    return zip(edges[:-1], edges[1:], strict=True)


def train(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Two rounds of training over all texts; what reaches the driver has the size of the model."""
    flat = initial(vocabulary)
    bound_batches(docs.sparkSession)
    turn = F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(ROUNDS))
    for chosen, rate in ((turn == 0, RATES[0]), (turn != 0, RATES[1])):
        start = flat

        def run(batches, start=start, rate=rate):
            import pyarrow as pa

            trainer, reader = Trainer(start, vocabulary, rate), Reader(vocabulary)
            for batch in batches:
                data, bounds = text_buffer(batch.column(0))
                for i, j in groups_of(bounds):
                    read = reader(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                    order = trainer.draw.permutation(len(read.places))
                    for at in range(0, len(order), BATCH):
                        trainer.step(read, order[at : at + BATCH])
            if trainer.seen:
                parts = [trainer.flat[at : at + _PART].tobytes() for at in range(0, len(trainer.flat), _PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([float(trainer.seen)] * len(parts)), pa.array(parts, pa.binary())], ["part", "weight", "values"])

        def average(key, rows):
            import pyarrow as pa

            weights, total = rows.column("weight").to_pylist(), 0.0
            for weight, values in zip(weights, rows.column("values"), strict=True):
                total = total + weight * np.frombuffer(values.as_buffer(), np.float32).astype(np.float64)
            whole = sum(weights)
            return pa.table({"part": [key[0].as_py()], "task": [key[1].as_py()], "weight": [whole], "values": pa.array([(total / whole).astype(np.float32).tobytes()], pa.binary())})

        texts = docs.filter(chosen).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        trained = texts.mapInArrow(run, "part long, weight double, values binary").withColumn("task", F.spark_partition_id().cast("long"))
        tasks = splits_of(texts)
        while True:  # at most 256 tasks' parameters meet at once
            trained = trained.withColumn("task", F.floor(F.col("task") / 256)).groupBy("part", "task").applyInArrow(average, "part long, task long, weight double, values binary")
            tasks = -(-tasks // 256)
            if tasks == 1:
                break
        found = trained.select("part", "values").collect()
        if found:
            flat = np.frombuffer(b"".join(r["values"] for r in sorted(found, key=lambda r: r["part"])), np.float32)
    return flat


def _normalised(guess: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 of the own outputs' shares among all that have vectors, row by row."""
    logits = guess @ vectors.T
    # No logit can exceed the product of the lengths; beyond this exp might leave single precision.
    if len(guess) and np.einsum("ij,ij->i", guess, guess).max() * np.einsum("ij,ij->i", vectors, vectors).max() > 60.0**2:
        logits -= logits.max(1, keepdims=True)
    picked = logits[np.arange(len(own)), own].astype(np.float64)
    sums = np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32)
    return (picked - np.log(sums.astype(np.float64))) / np.log(10.0)


def log_probabilities(read: Read, flat: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the normalised probabilities of every token's output, and of its slot in its class (0 without)."""
    contexts, outputs, slots, weights = unpack(flat, vocabulary)
    first, second = np.empty(len(read.places)), np.zeros(len(read.places))
    starts = vocabulary.slot_starts
    guess = np.zeros((len(read.places), WIDTH + 1), np.float32)
    guess[:, -1] = 1.0
    for at in range(0, len(read.places), ROWS):
        here = slice(at, at + ROWS)
        for k in range(CONTEXT):
            guess[here, :-1] += weights[k] * contexts[read.symbols[read.places[here] - 1 - k]]
        first[here] = _normalised(guess[here], outputs, read.outputs[here])
    inside = np.flatnonzero(read.slots >= 0)
    inside = inside[np.argsort(read.outputs[inside], kind="stable")]
    edges = np.searchsorted(read.outputs[inside], vocabulary.words + np.arange(len(starts)))
    for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if starts[k + 1] - starts[k] > 1:
            for at in range(i, j, ROWS):
                here = inside[at : min(at + ROWS, j)]
                second[here] = _normalised(guess[here], slots[starts[k] : starts[k + 1]], read.slots[here] - starts[k])
    return first, second


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        reader, log_counts = Reader(vocabulary), np.log10(np.append(vocabulary.counts, 0) + 0.1)
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            for i, j in groups_of(bounds):
                read = reader(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                first, second = log_probabilities(read, flat, vocabulary)
                # Of unknown words the count comes later; without training texts the end is one too, but not in the tail.
                plain = np.where(read.ranks >= 0, log_counts[read.ranks], 0.0)
                if not len(vocabulary.known):
                    plain[np.diff(read.owner, append=j - i) > 0] = log_counts[-1]
                # In the rest of a class: the word's count over the rest's.
                kind = np.maximum(read.outputs - vocabulary.words, 0)
                rest = (read.slots >= 0) & (read.slots == vocabulary.slot_starts[kind])
                own = first + second + np.where(rest, plain - vocabulary.rest_norm[kind], 0.0)
                n = np.bincount(read.owner, minlength=j - i)
                sums = [np.bincount(read.owner, weights=w, minlength=j - i) for w in (own, plain)]
                flat_words, lengths = read.tail
                words = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(flat_words))
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(read.tails)]).astype(np.int32)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(n - read.tails), pa.array(sums[0]), pa.array(sums[1]), tail], ["id", "n_tokens", "known", "own", "plain", "tail"])

    partial = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, known long, own double, plain double, tail array<string>")
    partial = stored(partial.withColumn("row", F.monotonically_increasing_id()), "lm-partial")
    rare = partial.select("row", F.explode("tail").alias("t"))
    seen = rare.join(counts, F.col("t") == F.col("word"), "left").groupBy("row").agg(F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("tail_log"))
    whole = partial.select("id", "n_tokens", "known", "own", "plain", "row").join(seen.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    tail_log, base_norm = F.coalesce("tail_log", F.lit(0.0)), float(np.log10(vocabulary.total + 0.1 * (vocabulary.distinct + 1)))
    known = F.col("known") + F.coalesce("tail_known", F.lit(0)) - (0 if len(vocabulary.counts) else 1)
    return whole.select(
        F.col("id").alias(id_col), "n_tokens", known.cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("plain") + tail_log - F.col("n_tokens") * base_norm).alias("base_score"), (F.col("own") + tail_log).alias("score"),
    )


def score_held_out(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows whose id has a crc32 that 10 doesn't divide, and score all rows."""
    fold = docs.filter(id_crc(F.col(id_col)) % 10 != 0)
    counts = stored(count_words(fold, text_col=text_col), "lm-counts")
    vocabulary = build_vocabulary(counts)
    flat = train(fold, vocabulary, id_col=id_col, text_col=text_col)
    return score(docs, counts, vocabulary, flat, id_col=id_col, text_col=text_col)
