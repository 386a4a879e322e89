"""Scores of a class-based bigram model: exchange clustering of words, class transitions, word emissions.

``fit`` counts words, places the most frequent ones and gives the others a class by their ending; ``count_words``, ``encode`` and ``cluster`` do the same
where the texts are needed as numbers anyway. ``encode`` writes texts as numbers; from there ``place`` goes on exchanging all words of the training texts, and
``score_encoded`` scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import Scratch, bound_batches, map_text, releasing

END = b" "  # the end of a text; no word holds a space
CLASSES = 64
ENDINGS = 32  # classes in which all other words start, by their last two bytes; words never seen stay there
SWEEPS = 6
ROUNDS = 3  # sweeps over all words at once
TURNS = 64  # the remainder of a word's id says when it moves if not all may move at once, and which empty class is open to it
LONGEST = 64  # bytes of a word that tasks know beforehand; longer ones are looked up
STRENGTH = 50.0  # weight of the class frequency in a transition
N_CLASSES = CLASSES + 1 + ENDINGS
KEYS = 2 * N_CLASSES + 1  # of a word's profile: the class before, the class after, the word itself after
RARE = 64  # counts up to this have their changes of the likelihood in a table
UNKNOWN = 255  # in place of a class: whoever counted does not know it
SPLIT = 32  # parts in which the tasks' counts of class bigrams are added up
LINKS = 1_000_000  # neighbours of rare words in one record


PAIRS = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])


class Sizes(NamedTuple):
    clustered: int = 1024  # most frequent words, which exchange clustering places
    near: int = 200_000  # about as many of the most frequent words are known to every task; the others are looked up by a join
    flush: int = 300_000  # words a task counts before it hands them on
    group: int = 2_000_000  # about as many training tokens belong to the words that a task places at once
    entries: int = 3_000_000  # profile entries a task holds before it hands them on

    @property
    def units(self) -> int:
        return self.clustered + 1 + ENDINGS


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of words of each text, all words) of UTF-8 texts; the same words as ``tokens``, without the end."""
    valid = pc.fill_null(texts, b"")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(valid.cast(pa.large_string())))
    words, many = lists.flatten(), lists.value_lengths().to_numpy()
    keep = pc.greater(pc.binary_length(words), 0)  # a space at a text's start or end makes an empty one
    row = np.repeat(np.arange(len(many)), many)[keep.to_numpy(zero_copy_only=False)]
    return np.bincount(row, minlength=len(many)), words.filter(keep).cast(pa.large_binary())


def _endings(words: pa.Array) -> np.ndarray:
    """``ending`` of each of many words, none of which is empty."""
    _, offsets, data = words.cast(pa.large_binary()).buffers()
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    upto = np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    letters = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    return (letters[upto[1:] - 1] * 131 + np.where(np.diff(upto) > 1, letters[np.maximum(upto[1:] - 2, 0)], 0) * 7) % ENDINGS


def ending(word: bytes) -> int:
    return (word[-1] * 131 + (word[-2] if len(word) > 1 else 0) * 7) % ENDINGS


def unit(word: bytes, rank: dict[bytes, int], clustered: int) -> int:
    """What bigrams are counted of: a clustered word, the end, or the ending of another word."""
    at = rank.get(word)
    if at is not None:
        return at
    return clustered if word == END else clustered + 1 + ending(word)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, n_words: int, n_classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of the first ``n_words`` units, from bigram counts of all units (square matrix).

    Words start in turn in each class. Each sweep takes every word out of its class, most frequent first, and puts it where the
    likelihood of the class bigrams is largest; it ends early if no word moved. Units after the words each keep a class of their own.
    """
    n = len(pairs)
    of = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(n - n_words)])
    total = n_classes + n - n_words
    own = np.diag(pairs).astype(float)
    member = np.zeros((n, total))
    member[np.arange(n), of] = 1
    right, left = pairs @ member, pairs.T @ member  # of each unit: how often before, after each class
    matrix = member.T @ right
    size = np.maximum(pairs.sum(axis=1), pairs.sum(axis=0)).astype(float)
    weight = member.T @ size
    for _ in range(sweeps):
        moved = 0
        for w in range(n_words):
            a = of[w]
            r, l, s = right[w].copy(), left[w].copy(), own[w]
            r[a] -= s  # without itself
            l[a] -= s
            matrix[a] -= r
            matrix[:, a] -= l
            matrix[a, a] -= s
            weight[a] -= size[w]
            m = matrix
            base = _xlogx(m)
            gain = (_xlogx(m[:n_classes] + r) - base[:n_classes]).sum(axis=1) + (_xlogx(m[:, :n_classes] + l[:, None]) - base[:, :n_classes]).sum(axis=0)
            d = np.arange(n_classes)
            diag = m[d, d]
            gain += _xlogx(diag + r[d] + l[d] + s) - _xlogx(diag + r[d]) - _xlogx(diag + l[d]) + _xlogx(diag)
            gain -= 2 * (_xlogx(weight[d] + size[w]) - _xlogx(weight[d]))
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            matrix[b] += r
            matrix[:, b] += l
            matrix[b, b] += s
            weight[b] += size[w]
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return of[:n_words]


class Model(NamedTuple):
    vocabulary: DataFrame  # word, n, id: of all training tokens
    near: list[tuple[bytes, int]]  # the most frequent ones, in order
    tokens: int
    distinct: int
    classes: np.ndarray  # of each unit
    transition: np.ndarray  # log10 probability by (class before, class)
    sizes: Sizes
    mass: np.ndarray  # training tokens and distinct words of each class, plus one: what emissions are divided by
    kinds: np.ndarray  # class of each of ``near``
    placed: DataFrame | None = None  # id, n, class of the other trained words; where there is none, they are in the class of their ending


def frequent(vocabulary: DataFrame, wanted: int) -> list[tuple[bytes, int]]:
    """About ``wanted`` of the most frequent words of at most ``LONGEST`` bytes with their counts, most frequent first.

    A histogram of the counts' logarithms (a few thousand steps, whatever the input) names the step in which the last ones lie; of its
    words, whose counts are equal or within 1.1 %, those of small hash are taken. So nothing is sorted, and the driver gets the
    chosen words only, not candidates of every partition.
    """
    step, parts = F.floor(F.log2("n") * 64), 1 << 20
    short = vocabulary.where(F.length("word") <= LONGEST)
    left, chosen = wanted, F.lit(True)
    for at, n in sorted(map(tuple, short.groupBy(step).count().collect()), reverse=True):
        if n > left:
            chosen = (step > at) | ((step == at) & (F.pmod(F.xxhash64("word"), F.lit(parts)) < left * parts // n))
            break
        left -= n
    got = short.where(chosen).select("word", "n").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))


def transitions(matrix: np.ndarray) -> np.ndarray:
    """log10 probabilities from counts by (class before, class)."""
    share = (matrix.sum(axis=0) + 1) / (matrix.sum() + N_CLASSES)
    return np.log10((matrix + STRENGTH * share) / (matrix.sum(axis=1, keepdims=True) + STRENGTH))


def count_words(rows: DataFrame, scratch: Scratch, text: str = "text", sizes: Sizes = Sizes()) -> Model:
    """All words of ``rows`` and the most frequent ones; no word has been placed. Counts stay a table; the driver gets about ``sizes.near`` words."""
    words = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    bound_batches(rows.sparkSession)

    def added(tables):
        got = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": got.column("word"), "n": got.column("n_sum")})

    def count(batches):
        held, size, merged = [], 0, 0
        for batch in batches:
            many, found = _words_of(batch.column(0))
            if len(many):
                each = found.value_counts()
                held.append(pa.table({"word": pa.concat_arrays([each.field("values").cast(pa.binary()), pa.array([END])]),
                                      "n": pa.concat_arrays([each.field("counts"), pa.array([len(many)], pa.int64())])}))
                size += len(held[-1])
            if size > max(sizes.flush, 2 * merged):  # sum up what is held; if that doesn't make it small, hand it on
                held = [added(held)]
                size = merged = len(held[0])
                if size > sizes.flush:
                    yield from held[0].to_batches()
                    held, size, merged = [], 0, 0
        if held:
            yield from added(held).to_batches()

    counted = rows.select(F.encode(text, "UTF-8")).mapInArrow(releasing(count), words).groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = scratch.write(counted.withColumn("id", F.monotonically_increasing_id() * TURNS + F.pmod(F.xxhash64("word"), F.lit(TURNS))), "vocabulary")
    distinct, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    near = frequent(vocabulary, sizes.near)
    classes = np.concatenate([np.zeros(sizes.clustered, dtype=int), CLASSES + np.arange(1 + ENDINGS)])
    return Model(vocabulary, near, total, distinct, classes, np.zeros((N_CLASSES, N_CLASSES)), sizes, np.ones(N_CLASSES), np.zeros(len(near), dtype=int))


def _rank(model: Model) -> dict[bytes, int]:
    return {w: i for i, (w, _) in enumerate([x for x in model.near if x[0] != END][:model.sizes.clustered])}


def _clustered(counted: DataFrame, model: Model) -> Model:
    """The model whose most frequent words are placed by bigrams of units; ``counted`` has ``pair`` and ``n`` of each task."""
    clustered, units, rank = model.sizes.clustered, model.sizes.units, _rank(model)
    got = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(units * units)
    pairs[got.column(0).to_numpy()] = got.column(1).to_numpy()
    pairs = pairs.reshape(units, units)

    placed = exchange(pairs[:len(rank), :len(rank)] if len(rank) < clustered else pairs, len(rank))
    classes = np.concatenate([placed, np.zeros(clustered - len(rank), dtype=int), CLASSES + np.arange(1 + ENDINGS)])
    member = np.zeros((units, N_CLASSES))
    member[np.arange(units), classes] = 1
    transition = transitions(member.T @ pairs @ member)
    shared = model.vocabulary.sparkSession.sparkContext.broadcast(rank)

    def weigh(batches):
        rank = shared.value
        mass = np.zeros((N_CLASSES, 2), dtype=np.int64)
        for batch in batches:
            c = classes[[unit(w, rank, clustered) for w in batch.column(0).to_pylist()]]
            mass[:, 0] += np.bincount(c, weights=batch.column(1).to_numpy(), minlength=N_CLASSES).astype(np.int64)
            mass[:, 1] += np.bincount(c, minlength=N_CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_CLASSES)), pa.array(mass.sum(axis=1))], names=["pair", "n"])

    mass = np.ones(N_CLASSES)
    for c, n in model.vocabulary.select("word", "n").mapInArrow(releasing(weigh), PAIRS).groupBy("pair").agg(F.sum("n")).collect():
        mass[c] += n
    kinds = classes[[unit(w, rank, clustered) for w, _ in model.near]].astype(int) if model.near else np.zeros(0, dtype=int)
    return model._replace(classes=classes, transition=transition, mass=mass, kinds=kinds)


def fit(rows: DataFrame, scratch: Scratch, text: str = "text", sizes: Sizes = Sizes()) -> Model:
    """Learn from all of ``rows``. Word counts stay a table; the driver gets about ``sizes.near`` of the most frequent words and the bigram counts
    of at most ``sizes.units`` units, whatever the input's size."""
    model, clustered, units = count_words(rows, scratch, text, sizes), sizes.clustered, sizes.units
    shared = rows.sparkSession.sparkContext.broadcast(_rank(model))

    def bigrams(batches):
        rank, seen = shared.value, np.zeros(units * units, dtype=np.int64)
        for batch in batches:
            codes = [clustered]
            for t in batch.column(0).to_pylist():
                codes += [unit(w, rank, clustered) for w in tokens(t)]
            c = np.array(codes)
            seen += np.bincount(c[:-1] * units + c[1:], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    return _clustered(rows.select(F.encode(text, "UTF-8")).mapInArrow(releasing(bigrams), PAIRS), model)


def cluster(encoded: DataFrame, model: Model) -> Model:
    """What ``fit`` makes of the rows, from ``count_words`` of them and what ``encode`` wrote of them."""
    clustered, units, rank = model.sizes.clustered, model.sizes.units, _rank(model)
    shared = encoded.sparkSession.sparkContext.broadcast(np.array([unit(w, rank, clustered) for w, _ in model.near], dtype=np.int64))

    def bigrams(batches):
        unit_of, seen = shared.value, np.zeros(units * units, dtype=np.int64)
        for batch in _pieces(batches):
            codes, _, other, (start,) = _codes(batch, "start")
            u = np.zeros(len(codes), dtype=np.int64)
            if len(unit_of):
                unit_of.take(codes, out=u, mode="clip")
            u[other] = start + clustered - CLASSES  # classes of endings follow CLASSES as their units follow the clustered
            np.add.at(seen, np.concatenate([[clustered], u[:-1]]) * units + u, 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    return _clustered(encoded.select("__codes", "__far").mapInArrow(releasing(bigrams), PAIRS), model)


def _first_far(model: Model) -> int:
    """Where the ids of words begin that are not among the most frequent ones, whose ids are their positions."""
    return -(-len(model.near) // TURNS) * TURNS


def _by_row(values: DataFrame, name: str) -> DataFrame:
    """``values`` put together by ``__row``: one row for each, with the list ``name`` of structs of all other columns."""
    kind = T.StructType([f for f in values.schema.fields if f.name != "__row"])
    schema = T.StructType([values.schema["__row"], T.StructField(name, T.ArrayType(kind))])

    def listed(table):
        table = table.combine_chunks()
        row = table.column("__row").to_numpy()
        edge = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
        structs = pa.StructArray.from_arrays([pa.concat_arrays(table.column(x).chunks) for x in kind.names], kind.names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(row)).astype(np.int32)), structs)
        return pa.RecordBatch.from_arrays([pa.array(row[edge]), lists], names=schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                row = batch.column("__row").to_numpy()
                last = int(np.searchsorted(row, row[-1]))  # the last row may go on in the next batch
                if last or held and held[-1].column("__row")[0].as_py() != row[0]:
                    whole = [*held, batch.slice(0, last)]
                    yield listed(pa.Table.from_batches(whole))
                    held = []
                held.append(batch.slice(last))
        if held:
            yield listed(pa.Table.from_batches(held))

    return values.repartition("__row").sortWithinPartitions("__row").mapInArrow(releasing(run), schema)


def encode(docs: DataFrame, model: Model, keep: list[str], scratch: Scratch, text: str = "text") -> DataFrame:
    """``keep`` columns of each row, written, with ``__row``, ``__codes`` (32 bits for each word and the end) and ``__far``.

    A code is the position among the most frequent words, which every task knows, or -1 - k for the row's k-th other word. ``__far`` has k, the class of
    the word's ending, and its id and count, null if never seen. They come from a join by word, so no vocabulary is held whole.
    """
    near = docs.sparkSession.sparkContext.broadcast([w for w, _ in model.near])
    n_clustered, classes = model.sizes.clustered, model.classes

    def make():
        index = pa.array(near.value, pa.large_binary())

        def run(texts):
            many, words = _words_of(pa.array(texts, pa.binary()))
            ends = np.cumsum(many + 1) - 1
            at = np.zeros(len(words) + len(many), dtype=bool)
            at[ends] = True
            order = np.empty(len(at), dtype=np.int64)  # where each token, ends included, is among the words; the end comes after them
            order[~at], order[at] = np.arange(len(words)), len(words)
            words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
            codes = pc.index_in(words, value_set=index).fill_null(-1).to_numpy()[order].astype(np.int32)
            other = np.flatnonzero(codes < 0)
            row = np.repeat(np.arange(len(many)), many + 1)[other]
            named = words.take(pa.array(order[other])).dictionary_encode()
            pairs, to = np.unique(row * (len(named.dictionary) + 1) + named.indices.to_numpy(), return_inverse=True)
            row, name = np.divmod(pairs, len(named.dictionary) + 1)
            upto = np.searchsorted(row, np.arange(len(many) + 1))
            codes[other] = -1 - (to - upto[row[to]])
            starts = classes[n_clustered + 1 + _endings(named.dictionary)]
            starts[pc.equal(named.dictionary, pa.scalar(END, pa.large_binary())).to_numpy(zero_copy_only=False)] = classes[n_clustered]
            values = pa.StructArray.from_arrays([named.dictionary.take(pa.array(name)).cast(pa.binary()), pa.array(starts[name].astype(np.int32))], ["word", "start"])
            cuts = np.concatenate([[0], ends + 1]) * 4
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(codes.tobytes())])
            return [packed.cast(pa.binary()), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), values)]

        return run

    out = [T.StructField("__codes", T.BinaryType()), T.StructField("__words", T.ArrayType(T.StructType([
        T.StructField("word", T.BinaryType()), T.StructField("start", T.IntegerType())])))]
    rows = scratch.write(map_text(docs, keep, F.col(text), make, out).withColumn("__row", F.monotonically_increasing_id()), "codes", "zstd")
    words = rows.select("__row", F.posexplode("__words").alias("k", "w")).select("__row", "k", "w.word", "w.start")
    known = words.join(model.vocabulary.select("word", (F.col("id") + _first_far(model)).alias("id"), "n").hint("merge"), "word", "left")
    found = _by_row(known.select("__row", "k", "start", "id", "n"), "__far")
    encoded = scratch.write(rows.drop("__words").join(found.hint("merge"), "__row", "left"), "encoded", "zstd")
    scratch.drop(rows)
    return encoded


def _classified(encoded: DataFrame, model: Model) -> DataFrame:
    """``__found``: k and class of each row's words that are neither among the most frequent nor in the class of their ending."""
    if model.placed is None:
        return encoded.withColumn("__found", F.expr("CAST(NULL AS array<struct<k:int,class:int>>)"))
    words = encoded.select("__row", F.explode("__far").alias("f")).select("__row", "f.k", "f.id")
    found = _by_row(words.join(model.placed.select("id", "class").hint("merge"), "id").select("__row", "k", "class"), "__found")
    return encoded.join(found.hint("merge"), "__row", "left")


def _spread(lists: pa.ListArray, at: np.ndarray, into: dict[str, np.ndarray]) -> None:
    """Put fields of structs that have a place ``k`` where the row's places start (``at``), in flat arrays."""
    flat = lists.flatten()
    place = np.repeat(at, lists.value_lengths().fill_null(0).to_numpy()) + flat.field("k").to_numpy()
    for name, values in into.items():
        values[place] = flat.field(name).fill_null(-1).to_numpy()


def _pieces(batches, most: int = 1 << 20):
    """Slices of batches of about as many bytes of codes, or of one row."""
    for batch in batches:
        if batch.num_rows:
            upto = np.cumsum(pc.binary_length(batch.column("__codes")).to_numpy().astype(np.int64)) // most
            cuts = [*np.flatnonzero(np.diff(upto, prepend=-1)), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def _codes(batch: pa.RecordBatch, *fields: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(codes of all tokens of a batch, places of the texts' ends, places of words that are not among the most frequent, ``fields`` of those)."""
    texts, far = batch.column("__codes").to_pylist(), batch.column("__far")
    codes, upto = np.frombuffer(b"".join(texts), dtype=np.int32), np.cumsum([len(x) // 4 for x in texts])
    many = far.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    at = np.cumsum(many) - many
    held = {name: np.zeros(many.sum(), dtype=np.int64) for name in fields}
    _spread(far, at, held)
    other = np.flatnonzero(codes < 0)
    place = at[np.searchsorted(upto, other, side="right")] - 1 - codes[other]
    return codes, upto - 1, other, [held[name][place] for name in fields]


def _sequences(batch: pa.RecordBatch, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first token of each row, codes, class, id, count) of all tokens of a batch, one text after the other; counts of the most frequent words are 0."""
    texts = [np.frombuffer(x, dtype=np.int32) for x in batch.column("__codes").to_pylist()]
    starts = np.cumsum([0] + [len(x) for x in texts])
    codes = np.concatenate(texts).astype(np.int64)
    far = batch.column("__far")
    many = far.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    at = np.cumsum(many) - many
    held = {name: np.zeros(many.sum(), dtype=np.int64) for name in ("start", "id", "n")}
    _spread(far, at, held)
    if "__found" in batch.schema.names:
        _spread(batch.column("__found"), at, {"class": held["start"]})
    other = codes < 0
    place = (np.repeat(at, np.diff(starts)) - 1 - codes)[other]
    kind, ids, counts = np.zeros(len(codes), dtype=np.int64), codes.copy(), np.zeros(len(codes), dtype=np.int64)
    kind[~other] = kinds[codes[~other]]
    kind[other], ids[other], counts[other] = held["start"][place], held["id"][place], held["n"][place]
    return starts[:-1], codes, kind, ids, counts


def likelihood(matrix: np.ndarray, weight: np.ndarray) -> float:
    """What exchange raises: of class bigrams, given each class's size."""
    return float(_xlogx(matrix).sum() - 2 * _xlogx(weight).sum())


class Costs(NamedTuple):
    """What counts of class bigrams say to all words: each side's cells, x log x of them, and what adding 1 to ``RARE`` to a cell changes."""
    matrix: np.ndarray
    sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, matrix: np.ndarray) -> Costs:
        sides = []
        for cells in (matrix, matrix.T):  # cells[x, d] meets the word's count of x on that side
            base = _xlogx(cells)
            sides.append((cells, base, np.concatenate([_xlogx(cells + m) - base for m in range(1, RARE + 1)])))
        return cls(matrix, sides)


def gains(costs: Costs, now: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the likelihood gains by putting each word, taken out of its class ``now``, into each class (words by classes).

    The words' profiles are entries ordered by ``word``: ``key`` is a class before, a class after (from N_CLASSES on) or, the last one, the word itself after;
    ``n`` says how often. The same sums as in ``exchange``, but of cells that change only.
    """
    size, c, matrix = len(now), N_CLASSES, costs.matrix
    profile = np.zeros((size, KEYS))
    profile[word, key] = n
    left, right, own = profile[:, :c], profile[:, c:-1], profile[:, -1]
    of = np.arange(size)
    left[of, now] -= own  # without itself
    right[of, now] -= own
    total = left.sum(axis=1) + own
    weight = matrix.sum(axis=0)
    out, here = np.zeros((size, c)), np.zeros(size)  # here: of the class the word is in
    for side, other, (cells, base, table) in ((left, right, costs.sides[0]), (right, left, costs.sides[1])):
        inside = np.flatnonzero(side[of, now])  # words that have a neighbour in the row or column they are taken out of
        k = now[inside]
        less = np.maximum(cells[k] - other[inside], 0)
        out[inside] += _xlogx(less + side[inside, k][:, None]) - _xlogx(less)
        rest = side.copy()
        rest[inside, k] = 0
        w, x = np.nonzero(rest)
        m, k = rest[w, x], now[w]
        here += np.bincount(w, base[x, k] - _xlogx(np.maximum(cells[x, k] - m, 0)), size)
        often = m > RARE
        step = np.where(often, 0, m).astype(np.int64)
        for at in np.flatnonzero(np.bincount(step)[1:9] > 2 * size) + 1:  # counts that many entries have: one product for all of them
            out += (rest == at).astype(float) @ table[(at - 1) * c:at * c]
            step[step == at] = -1
        left_over = np.flatnonzero(step >= 0)
        for at in range(0, len(left_over), 1 << 11):
            e = left_over[at:at + (1 << 11)]
            i, j = w[e], x[e]
            change = table[np.maximum(step[e] - 1, 0) * c + j]
            odd = np.flatnonzero(often[e])
            change[odd] = _xlogx(cells[j[odd]] + m[e[odd], None]) - base[j[odd]]
            edge = np.flatnonzero(np.diff(i, prepend=-1))
            out[i[edge]] += np.add.reduceat(change, edge, axis=0)
    both = np.flatnonzero((own > 0) | ((left > 0) & (right > 0)).any(axis=1))
    diag, l, r, s = np.diag(matrix), left[both], right[both], own[both, None]
    out[both] += _xlogx(diag + r + l + s) - _xlogx(diag + r) - _xlogx(diag + l) + _xlogx(diag)
    core = matrix[now, now]
    took = left[of, now] + right[of, now] + own
    sizes, at = np.unique(total, return_inverse=True)
    out -= (2 * (_xlogx(weight + sizes[:, None]) - _xlogx(weight)))[at]
    out[of, now] = here + _xlogx(core) - _xlogx(np.maximum(core - took, 0)) - 2 * (_xlogx(weight[now]) - _xlogx(weight[now] - total))
    return out


def _best(costs: Costs, now: np.ndarray, turn: np.ndarray, word: np.ndarray, key: np.ndarray, n: np.ndarray, block: int = 512) -> np.ndarray:
    """Class of largest likelihood for each word; the one it has if none is better. No word joins the end's; of the empty classes, one is open to each word."""
    empty = np.setdiff1d(np.flatnonzero(costs.matrix.sum(axis=0) == 0), [CLASSES])
    out, edges = now.copy(), np.searchsorted(word, np.arange(0, len(now) + block, block))
    for at, (i, j) in zip(range(0, len(now), block), zip(edges, edges[1:])):
        mine = now[at:at + block]
        gain = gains(costs, mine, word[i:j] - at, key[i:j], n[i:j]).round(7)  # equal ones stay equal, in whatever order they were added up
        of = np.arange(len(mine))
        if len(empty):
            opened = empty[turn[at:at + block] % len(empty)]
            value = gain[of, opened]
            gain[:, empty] = -np.inf
            gain[of, opened] = value
        gain[:, CLASSES] = -np.inf
        best = gain.argmax(axis=1)
        out[at:at + block] = np.where(gain[of, best] > gain[of, mine] + 1e-9, best, mine)
    return out


def _numbers(batch, name: str, at: int, kind) -> np.ndarray:
    return np.frombuffer(batch.column(name)[at].as_py(), dtype=kind)


def _records(rows: list[tuple], schema: T.StructType):
    """Batches of packed rows: a part and binary values."""
    for at in range(0, len(rows), 64):
        some = list(zip(*rows[at:at + 64]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(some)], names=schema.names)


def _packed(*names: str) -> T.StructType:
    return T.StructType([T.StructField("part", T.IntegerType())] + [T.StructField(x, T.BinaryType()) for x in names])


PROFILES, LINKED = _packed("ids", "many", "kinds", "keys", "n"), _packed("ids", "many", "kinds", "others", "n")


def _dealt(ids: np.ndarray, many: np.ndarray, groups: int):
    """(part, words of it, entries of it) for words with so many entries each."""
    part = ids // TURNS % groups
    order = np.argsort(part, kind="stable")
    upto = np.cumsum(many[order])
    entry = np.repeat((np.cumsum(many) - many)[order] - (upto - many[order]), many[order]) + np.arange(many.sum())
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=groups))
    for a, b in zip(cuts, cuts[1:]):
        yield int(part[order[a]]), order[a:b], entry[upto[a - 1] if a else 0:upto[b - 1]]


class _Entries:
    """Profile entries a task holds, and its counts of class bigrams."""

    def __init__(self, groups: int, most: int):
        self.groups, self.most, self.matrix = groups, most, np.zeros(N_CLASSES * N_CLASSES, dtype=np.int64)
        self.held, self.counts, self.kinds, self.size = [], [], [], 0

    def add(self, entries: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.held.append(entries)
        self.counts.append(counts)
        self.size += len(entries)

    def take(self, last: bool = False):
        if self.size > self.most or last and (self.size or self.kinds):
            yield from _records([*self._pack()], PROFILES)
            self.held, self.counts, self.kinds, self.size = [], [], [], 0

    def _pack(self):
        """Entries by part, then the classes of rare words, which come without entries."""
        held = np.concatenate(self.held) if self.held else np.zeros(0, dtype=np.int64)
        if all(x is None for x in self.counts):
            entries, n = np.unique(held, return_counts=True)
        else:
            order = np.argsort(held)
            entries, counts = held[order], np.concatenate(self.counts)[order]
            first = np.flatnonzero(np.diff(entries, prepend=-1))
            entries, n = entries[first], np.add.reduceat(counts, first) if len(first) else counts
        ids, key = np.divmod(entries.astype(np.int64), KEYS)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        many, ids = np.diff(first, append=len(key)), ids[first]
        key, n = key.astype(np.uint8), n.astype(np.int32)
        for part, w, e in _dealt(ids, many, self.groups):
            yield part, ids[w].tobytes(), many[w].astype(np.uint8).tobytes(), np.full(len(w), UNKNOWN, np.uint8).tobytes(), key[e].tobytes(), n[e].tobytes()
        for part, of, kinds in self.kinds:
            yield part, of.tobytes(), bytes(len(of)), kinds.tobytes(), b"", b""

    def end(self):
        yield from self.take(True)
        yield from _records([(-1 - TaskContext.get().partitionId() % SPLIT, self.matrix.tobytes(), b"", b"", b"", b"")], PROFILES)


def _links(encoded: DataFrame, model: Model, scratch: Scratch, groups: int) -> DataFrame:
    """Neighbours of all words that are not among the most frequent, written once, packed by ``part`` of the word with the class of its ending.

    ``others`` is twice the neighbour's id (-1 for a text's end), plus 1 where it comes after. A part's records are put together in bounded ones.
    """
    most, end = model.sizes.entries, int(model.classes[model.sizes.clustered])

    def pack(held):
        ids, other, kind = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((other, ids))
        ids, other, kind = ids[order], other[order], kind[order]
        new = np.flatnonzero((np.diff(ids, prepend=-1) != 0) | (np.diff(other, prepend=-9) != 0))
        n = np.diff(new, append=len(ids)).astype(np.int32)
        ids, other, kind = ids[new], other[new], kind[new].astype(np.uint8)
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        many, ids, kind = np.diff(first, append=len(ids)), ids[first], kind[first]
        for part, w, e in _dealt(ids, many, groups):
            yield part, ids[w].tobytes(), many[w].astype(np.int32).tobytes(), kind[w].tobytes(), other[e].tobytes(), n[e].tobytes()

    def run(batches):
        held, size = [], 0
        for batch in _pieces(batches):
            codes, ends, i, (found, kind) = _codes(batch, "id", "start")
            ids = codes.astype(np.int64)
            ids[i] = found
            ids[ends] = -1
            mine = (found >= 0) & (kind != end)
            i, kind = i[mine], kind[mine]
            held.append((np.tile(ids[i], 2), np.concatenate([np.where(i > 0, ids[i - 1], -1) * 2, ids[i + 1] * 2 + 1]), np.tile(kind, 2)))
            size += 2 * len(i)
            if size > most:
                yield from _records([*pack(held)], LINKED)
                held, size = [], 0
        if size:
            yield from _records([*pack(held)], LINKED)

    def together(batches):
        held, part, size = [], None, 0

        def joined():
            return _records([(part, *map(b"".join, zip(*held)))], LINKED) if held else ()

        for batch in batches:
            for p, *values in zip(*(x.to_pylist() for x in batch.columns)):
                if p != part or size + len(values[4]) // 4 > LINKS:
                    yield from joined()
                    held, part, size = [], p, 0
                held.append(values)
                size += len(values[4]) // 4
        yield from joined()

    found = encoded.select("__codes", "__far").mapInArrow(releasing(run), LINKED)
    return scratch.write(found.repartition("part").sortWithinPartitions("part").mapInArrow(releasing(together), LINKED), "links")


def _near_profiles(encoded: DataFrame, model: Model, groups: int, full: bool) -> DataFrame:
    """What bigrams of the most frequent words and text ends give to ``_profiles``."""
    shared, fixed = encoded.sparkSession.sparkContext.broadcast(model.kinds), _fixed(model)
    end, most = int(model.classes[model.sizes.clustered]), model.sizes.entries

    def run(batches):
        kinds = np.append(shared.value, end).astype(np.int32)  # the last one, -1, is a text's end
        moves = (kinds != end) & (np.arange(len(kinds)) >= fixed)
        wide = np.int32 if len(kinds) * KEYS < 1 << 31 else np.int64
        base = np.arange(len(kinds), dtype=wide) * KEYS  # of each word's entries
        found = _Entries(groups, most)
        for batch in _pieces(batches):
            texts = batch.column("__codes").to_pylist()
            b = np.frombuffer(b"".join(texts), dtype=np.int32).copy()
            far = b < 0
            ends = np.cumsum([len(x) // 4 for x in texts]) - 1
            b[ends], far[ends] = len(kinds) - 1, False
            a = np.concatenate([b[-1:], b[:-1]])  # the last token of a batch is an end, as the one before the first
            if far.any():
                keep = np.flatnonzero(~(far | np.concatenate([[False], far[:-1]])))
                a, b = a.take(keep), b.take(keep)
            before, after = kinds.take(a), kinds.take(b)
            found.matrix += np.bincount(before * N_CLASSES + after, minlength=len(found.matrix))
            if full:
                left, right = np.flatnonzero(moves.take(b)), np.flatnonzero(moves.take(a))
                found.add(base.take(b.take(left)) + before.take(left))
                found.add(base.take(a.take(right)) + (after.take(right) + N_CLASSES))
                same = left[a.take(left) == b.take(left)]
                found.add(base.take(b.take(same)) + (KEYS - 1))
                yield from found.take()
        yield from found.end()

    return encoded.select("__codes").mapInArrow(releasing(run), PROFILES)


def _far_profiles(links: DataFrame, chosen: DataFrame | None, model: Model, groups: int, full: bool) -> DataFrame:
    """What bigrams with a word that is not among the most frequent give to ``_profiles``, and the classes of these words.

    Who has a rare word's neighbours knows its class, and of the neighbours those that are among the most frequent. So it tells the word of those, and tells all
    neighbours of the word's class.
    """
    shared, fixed, n_near = links.sparkSession.sparkContext.broadcast(model.kinds), _fixed(model), len(model.near)
    end, most = int(model.classes[model.sizes.clustered]), model.sizes.entries
    placed = chosen is not None
    if placed:
        links = links.join(chosen.select("part", F.col("ids").alias("known"), F.col("kinds").alias("class")).hint("merge"), "part")

    def run(batches):
        kinds = np.append(shared.value, end)
        moves = (kinds != end) & (np.arange(len(kinds)) >= fixed)
        found = _Entries(groups, most)
        for batch in batches:
            for at in range(batch.num_rows):
                ids, many, kind, others, n = (_numbers(batch, x, at, t) for x, t in (("ids", np.int64), ("many", np.int32), ("kinds", np.uint8), ("others", np.int64), ("n", np.int32)))
                if placed:
                    kind = _numbers(batch, "class", at, np.uint8)[np.searchsorted(_numbers(batch, "known", at, np.int64), ids)]
                found.kinds.append((batch.column("part")[at].as_py(), ids, kind))
                word, mine = np.repeat(ids, many), np.repeat(kind, many).astype(np.int64)
                other, after = others >> 1, (others & 1).astype(bool)
                near = other < n_near
                of = kinds[np.where(near, other, -1)]
                i = np.flatnonzero(near & after)
                found.matrix += np.bincount(mine[i] * N_CLASSES + of[i], n[i], len(found.matrix)).astype(np.int64)
                tell = after & ~near if not full else ~near | moves[np.where(near, other, -1)]
                i = np.flatnonzero(tell)
                found.add(other[i] * KEYS + mine[i] + np.where(after[i], 0, N_CLASSES), n[i])
                i = np.flatnonzero(near & (full | ~after))
                found.add(word[i] * KEYS + of[i] + np.where(after[i], N_CLASSES, 0), n[i])
                if full:
                    i = np.flatnonzero(after & (other == word))
                    found.add(word[i] * KEYS + KEYS - 1, n[i])
                yield from found.take()
        yield from found.end()

    return links.mapInArrow(releasing(run), PROFILES)


def _profiles(encoded: DataFrame, links: DataFrame, chosen: DataFrame | None, model: Model, groups: int, full: bool) -> DataFrame:
    """Counts of class bigrams (cells in parts below 0), and the profiles of all words that may move, one record for each ``part`` of them.

    Cells of rare words are only known where their profiles are put together: what stands before a rare word is counted there, all else by who reads it.
    Unless ``full``, nothing else is gathered.
    """
    kinds_near, n_near, first_far = encoded.sparkSession.sparkContext.broadcast(model.kinds), len(model.near), _first_far(model)

    def merge(table):
        part = table.column("part")[0].as_py()
        values = {x: table.column(x).to_pylist() for x in PROFILES.names[1:]}
        if part < 0:
            total = np.sum([np.frombuffer(x, dtype=np.int64) for x in values["ids"]], axis=0)
            return pa.table([pa.array([x], t) for x, t in zip((part, total.tobytes(), b"", b"", b"", b""), [pa.int32()] + [pa.binary()] * 5)], names=PROFILES.names)
        all_ids, many, kinds, keys, n = (np.frombuffer(b"".join(values[x]), dtype=t) for x, t in zip(PROFILES.names[1:], (np.int64, np.uint8, np.uint8, np.uint8, np.int32)))
        ids, word = np.unique(all_ids, return_inverse=True)
        now = np.full(len(ids), UNKNOWN, dtype=np.uint8)
        now[word[kinds != UNKNOWN]] = kinds[kinds != UNKNOWN]
        near = np.searchsorted(ids, n_near)
        now[:near] = kinds_near.value[ids[:near]]
        entries = np.repeat(word, many) * KEYS + keys
        order = np.argsort(entries)
        entries = entries[order]
        first = np.flatnonzero(np.diff(entries, prepend=-1))
        n = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else n.astype(np.int64)
        word, key = np.divmod(entries[first], KEYS)
        i = np.flatnonzero((ids[word] >= first_far) & (key < N_CLASSES))
        matrix = np.bincount(key[i] * N_CLASSES + now[word[i]], n[i], N_CLASSES * N_CLASSES).astype(np.int64)
        rows = [(-1 - part, matrix.tobytes(), b"", b"", b"", b"")]
        if full:
            rows.append((part, ids.tobytes(), np.bincount(word, minlength=len(ids)).astype(np.uint8).tobytes(), now.tobytes(), key.astype(np.uint8).tobytes(), n.tobytes()))
        return pa.Table.from_batches(_records(rows, PROFILES))

    far = _far_profiles(links, chosen, model, groups, full)
    return _near_profiles(encoded, model, groups, full).union(far).groupBy("part").applyInArrow(merge, PROFILES)


def _fixed(model: Model) -> int:
    """Words of smaller ids have been placed one by one."""
    one_by_one = [i for i, (w, _) in enumerate(model.near) if w != END][:model.sizes.clustered]
    return one_by_one[-1] + 1 if one_by_one else 0


def _matrix(packed: DataFrame) -> np.ndarray:
    """Counts by (class before, class) of all of ``_profiles``."""
    def run(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                matrix = np.frombuffer(x, dtype=np.int64)
                at = np.flatnonzero(matrix)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(matrix[at])], names=["cell", "n"])

    out = np.zeros(N_CLASSES * N_CLASSES)
    for at, n in packed.where("part < 0").select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[at] = n
    return out.reshape(N_CLASSES, N_CLASSES)


def _words(chosen: DataFrame, first: int, before: int | None = None) -> DataFrame:
    """id, n and class of the packed words with ids from ``first`` on, ``before`` another."""
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids, n, kinds = (_numbers(batch, x, at, t) for x, t in (("ids", np.int64), ("n", np.int64), ("kinds", np.uint8)))
                i = slice(np.searchsorted(ids, first), None if before is None else np.searchsorted(ids, before))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(n[i]), pa.array(kinds[i].astype(np.int32))], names=["id", "n", "class"])

    return chosen.mapInArrow(run, "id long, n long, class int")


def place(encoded: DataFrame, model: Model, scratch: Scratch, rounds: int = ROUNDS) -> Model:
    """The model after sweeps of exchange over all words of ``encoded``, the rows it was fitted on, that ``fit`` has not placed one by one.

    A sweep gathers each word's profile, how often it stands before and after each class. Words are dealt into parts; every task knows the counts of
    class bigrams at the sweep's start and puts each of its words, however rare, into the class (of all but the end's) in which the likelihood is largest,
    all others left where they are. So classes do not depend on how rows and words are dealt. As many words move at once, a sweep may also lose; it is then
    taken back, and from there on an eighth of the words moves in each, then a 64th; if these lose, too, it ends.

    Texts stay where they are: classes of the most frequent words are known to every task, and neighbours of the others are written once, by word. Of those only
    profiles and classes move.
    """
    groups, n_near, first_far = 1 + model.tokens // model.sizes.group, len(model.near), _first_far(model)
    end, fixed = int(model.classes[model.sizes.clustered]), _fixed(model)
    links = _links(encoded, model, scratch, groups)
    packing = _packed("ids", "n", "kinds")

    def gathered(model, chosen, full):
        packed = scratch.write(_profiles(encoded, links, chosen, model, groups, full), "profiles")
        matrix = _matrix(packed)
        return packed, matrix, likelihood(matrix, matrix.sum(axis=0))

    def moved(model, packed, matrix, parts, at):
        def choose(batches):
            costs = Costs.of(matrix)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, many, now, key, n = (_numbers(batch, x, i, t) for x, t in zip(PROFILES.names[1:], (np.int64, np.uint8, np.uint8, np.uint8, np.int64)))
                    word, now = np.repeat(np.arange(len(ids)), many), now.astype(np.int64)
                    total = np.bincount(word, np.where(key < N_CLASSES, n, 0), len(ids)).astype(np.int64)
                    best = np.where((ids < fixed) | (ids % parts != at % parts), now, _best(costs, now, ids % TURNS, word, key, n))
                    yield from _records([(batch.column("part")[i].as_py(), ids.tobytes(), total.tobytes(), best.astype(np.uint8).tobytes())], packing)

        chosen = scratch.write(packed.where("part >= 0").mapInArrow(releasing(choose), packing), "classes")
        kinds = model.kinds.copy()
        got = _words(chosen, 0, n_near).toArrow()
        kinds[got.column(0).to_numpy()] = got.column(2).to_numpy()
        return model._replace(kinds=kinds, placed=_words(chosen, first_far)), chosen

    packed, matrix, reached = gathered(model, None, True)
    chosen, done, parts = None, 0, 1
    while done < rounds and parts <= TURNS:
        tried, classes = moved(model, packed, matrix, parts, done)
        after = gathered(tried, classes, done < rounds - 1)
        if after[2] > reached:
            scratch.drop(packed)
            if chosen is not None:
                scratch.drop(chosen)
            model, chosen, (packed, matrix, reached), done = tried, classes, after, done + 1
        else:
            scratch.drop(after[0])
            scratch.drop(classes)
            parts *= 8
    scratch.drop(packed)
    scratch.drop(links)
    if model.placed is None:
        return model
    mass = np.ones(N_CLASSES)
    np.add.at(mass, model.kinds, [n + 1 for _, n in model.near])
    for c, n in model.placed.groupBy("class").agg(F.sum("n") + F.count("*")).collect():
        mass[c] += n
    if END not in {w for w, _ in model.near}:
        mass[end] = model.mass[end]
    return model._replace(transition=transitions(matrix), mass=mass)


def score_encoded(encoded: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``score`` of rows that ``encode`` wrote, with a model that has its most frequent words from the same ``fit``."""
    shared = encoded.sparkSession.sparkContext.broadcast((model.kinds, np.log10(np.array([n for _, n in model.near], dtype=float) + 1)))
    n_all, end = float(np.log10(model.tokens + model.distinct + 1)), int(model.classes[model.sizes.clustered])
    transition, log_mass = model.transition, np.log10(model.mass)
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(*f) for f in fields])

    def run(batches):
        kinds, logs = shared.value
        for batch in _pieces(batches):
            starts, codes, kind, _, counts = _sequences(batch, kinds)
            near = codes >= 0
            base = np.log10(np.maximum(counts, 0) + 1.0)
            base[near] = logs[codes[near]]
            before = np.concatenate([[end], kind[:-1]])
            lengths = np.diff(starts, append=len(codes))
            base_score = np.add.reduceat(base, starts)
            step = np.add.reduceat(base + transition[before, kind] - log_mass[kind], starts)
            known = np.add.reduceat((near | (counts > 0)).astype(np.int64), starts)
            made = [pa.array(lengths), pa.array(known), pa.array(base_score - lengths * n_all), pa.array(step)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=schema.names)

    scored = _classified(encoded, model).select(*keep, "__codes", "__far", "__found").mapInArrow(releasing(run), schema)
    return scored.select(*keep, "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: Model, keep: list[str], scratch: Scratch, text: str = "text") -> DataFrame:
    """``keep`` columns of each row with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is the model's log10 probability of the words and the end: of each one's class after the class before (the
    end before the first), times the word's share of its class with one added. Words never seen have a class, too,
    by their ending. ``base_score`` is the sum of log10((count + 1) / (all tokens + distinct + 1)).

    Null texts are empty and consist of the end alone. Repeated rows are scored each; null values in other columns do not matter; columns of
    ``keep`` named like the results are replaced.
    """
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    return score_encoded(encode(docs, model, keep, scratch, text), model, keep)
