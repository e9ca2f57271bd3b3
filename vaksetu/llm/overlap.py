"""Problem 5: evaluation records that also stand in the training split.

Passages of the evaluation texts are searched in all training texts by Aho-Corasick automata over sharded, normalised passages:

1. A passage is a run of three words. The passages of each text are ordered by rarity, by their counts over all evaluation texts, which stand
   in a table of bounded size in the shared folder. Two texts are near the same only if they have ``o = 0.375 (n + m)`` of their n and m passages
   in common. Of those, the first ``LEAST_SHARED`` in this order stand so early in both texts that o can still follow (prefix and position filter):
   only these fronts are searched, and a passage late in the front of one text counts only for shorter texts.
2. The fronts of both sides are sent to shards by passage: each passage once, whatever the number of shards. What no evaluation text has is not sent.
3. A shard's task builds the automaton of its evaluation passages in memory and runs it over the symbols of its training passages (two a word,
   from two alphabets, so that a match is always aligned with words). Of two texts that both have a passage late nothing can follow; they
   are not even paired, so that a phrase of many texts costs nothing where it is frequent. Pairs with too few matches in all shards end here.
4. The others are checked exactly on all their runs.

Coverage has all runs of the evaluation texts in its automata, at all their positions, and no least number of matches: what any training
text has is marked, and the marked intervals are merged into the covered words of each evaluation record. Its automata are sharded by text and
written to the shared folder; each task runs all of them over its training texts, without stretches that a bit table rules out.

With the pairs whose id numbers are equal, and those whose summaries have the same words in the same order, at least eight, this
gives all overlaps.

Nulls: a null text or summary overlaps nothing; a null id or one without a number at its end has no number; a row whose split is none of
train, validation and test is left out. Equal texts of fewer than three words overlap as the same. Copies are one text until the end.
"""

from __future__ import annotations

import io
import pickle
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .joins import met
from .neardup import BLOCK, THRESHOLD, blocks, keyed, list_array, verified
from .store import file_system, new_folder, remove
from .words import GOLDEN, U64, WordHasher, mix, words

RUN, SUMMARY_WORDS = 3, 8
EVALUATION = ("validation", "test")
#: Passages that two texts near the same must share at the front, where they have ten times as many; fewer in shorter texts.
LEAST_SHARED = 6
#: Entries of the table of counts that orders the fronts: as many as the evaluation texts have passages, but at most so many; collisions only change the order.
MOST_COUNTS, COUNTS_A_FILE = 1 << 26, 1 << 20
#: Passages that a task gathers before it sends them, and pairs that it looks at together; both bound a worker's memory only.
GATHERED, TOGETHER = 1 << 20, 1 << 20
#: Passages of one automaton: bounds a worker's memory (about 150 bytes a passage), not the number of passages.
SHARD_PASSAGES = 1_500_000
#: Entries of the table of counts that orders passages by rarity; a fixed size, collisions only change the order.
COUNT_BUCKETS = 1 << 21
#: Bits of the table that tells which stretches of a training text can hold a passage of a shard at all; a fixed size.
FILTER_BITS = 1 << 24
#: Share of an evaluation text's runs that must be matched in addition to what the threshold allows to miss.
SPARE = 0.1
#: Two symbols stand for a word; they come from alphabets of 256 characters, in the private-use area and behind it.
FIRST, SECOND = 0xE000, 0xE100


def _passage_key(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits of the three words from each position, as their six symbols have them."""
    h = hashes >> U64(48)
    return ((h[at] << U64(32)) | (h[at + 1] << U64(16)) | h[at + 2]).view(np.int64)


def _run_hash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the three whole words from each position; passage keys have 16 bits of a word only."""
    out = np.zeros(len(at), U64)
    for k in range(RUN):
        out = mix(out * GOLDEN + hashes[at + k])
    return out


def _key_symbols(key: int) -> str:
    return "".join(chr((FIRST, SECOND)[n % 2] + (key >> (40 - 8 * n) & 0xFF)) for n in range(2 * RUN))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64)) & U64(COUNT_BUCKETS - 1)).astype(np.int64)


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(keys, word hashes, offsets) of the texts of each block that the task has not seen yet, by the last column if there are three."""
    hasher, seen = WordHasher(), set()
    for batch in batches:
        for block in blocks(batch, BLOCK):
            keys = block.column(0).to_pylist()
            names = block.column(2).to_pylist() if block.num_columns > 2 else keys
            fresh = [n for n, name in enumerate(names) if name not in seen and not seen.add(name)]
            yield [keys[n] for n in fresh], *hasher.batch(block.column(1).take(pa.array(fresh, pa.int64())).to_pylist())


def passage_counts(texts: DataFrame) -> np.ndarray:
    """How many texts have the passages of each bucket; COUNT_BUCKETS entries, summed up by the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BUCKETS, np.int32)
        for keys, hashes, offsets in _fresh(batches):
            each = [np.unique(_passage_key(hashes, np.arange(a, b))) for a, b in zip(offsets[:-1], offsets[1:] - RUN + 1, strict=True) if b > a]
            if each:
                some, times = np.unique(_bucket(np.concatenate(each)), return_counts=True)
                total[some] += times.astype(np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["b", "n"])

    rows = texts.select("k", "text").mapInArrow(count, "b int, n int").groupBy("b").agg(F.sum("n").cast("int").alias("n")).toArrow()
    out = np.zeros(COUNT_BUCKETS, np.int32)
    out[rows["b"].to_numpy()] = rows["n"].to_numpy()
    return out


def _standing(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a block's texts begin, and the number of the text of each."""
    size = np.maximum(np.diff(offsets) - RUN + 1, 0)
    return np.repeat(offsets[:-1] - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def count_passages(texts: DataFrame, folder: str) -> int:
    """Write how many texts have the passages of each bucket, up to 255, to the shared folder; returns the number of buckets."""
    letters = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 << min(MOST_COUNTS.bit_length() - 1, max(10, (letters // 5).bit_length()))
    width = min(buckets, COUNTS_A_FILE)
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, hashes, offsets in _fresh(batches):
            at, doc = _standing(offsets)
            run = _run_hash(hashes, at)
            order = np.lexsort((run, doc))
            run, doc = run[order], doc[order]
            run = run[np.append(True, (run[1:] != run[:-1]) | (doc[1:] != doc[:-1]))[: len(run)]]
            bucket = np.sort((run & U64(buckets - 1)).astype(np.int64))
            part, first = np.unique(bucket // width, return_index=True)
            bodies = [(x % width).astype(np.uint32).tobytes() for x in np.split(bucket, first[1:])] if len(part) else []
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(bodies, pa.binary())], names=["part", "body"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                some, times = np.unique(np.frombuffer(body, np.uint32), return_counts=True)
                table = total.setdefault(part, np.zeros(width, np.uint8))
                table[some] = np.minimum(table[some] + times, 255)
        files, path = file_system(folder)
        for part, table in total.items():
            _write_arrays(files, path, f"counts-{part}", n=table)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(total), pa.int32())], names=["part"])

    texts.select("k", "text", "d").mapInArrow(send, "part int, body binary").repartition(buckets // width, "part").mapInArrow(write, "part int").count()
    return buckets


def _counts(folder: str, buckets: int) -> np.ndarray:
    from pyarrow import fs

    files, path = file_system(folder)
    width, out = min(buckets, COUNTS_A_FILE), np.zeros(buckets, np.uint8)
    for part in range(buckets // width):
        name = f"{path}/counts-{part}.npz"
        if files.get_file_info(name).type != fs.FileType.NotFound:
            with files.open_input_stream(name) as source:
                out[part * width : (part + 1) * width] = np.load(io.BytesIO(source.read()))["n"]
    return out


def _least_shared(n: np.ndarray) -> np.ndarray:
    return np.clip(n // 10, 1, LEAST_SHARED)


def _front(hashes: np.ndarray, offsets: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(text, run, passage, passages of its text, longest, count) of the passages at the front of each text of a block.

    A text near the same with m passages has at least ``share * (n + m)`` in common with one of n. If the passage of rank i is one of the first c in
    common, at most ``n - i + c - 1`` are: m is at most longest. Passages with no m left are not of the front."""
    at, doc = _standing(offsets)
    run = _run_hash(hashes, at)
    count = counts[(run & U64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((run, doc * 256 + count))
    order = order[np.append(True, (run[order[1:]] != run[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]))[: len(order)]]
    doc, run, at, count = doc[order], run[order], at[order], count[order]
    n = np.bincount(doc, minlength=len(offsets) - 1)
    rank, n = np.arange(len(doc)) - (np.cumsum(n) - n)[doc], n[doc]
    share = threshold / (1 + threshold)
    longest = np.floor((n - rank + _least_shared(n) - 1) / share - n + 1e-6).astype(np.int64)
    front = longest >= threshold * n - 1e-6
    return doc[front], run[front], _passage_key(hashes, at[front]), n[front], longest[front], count[front]


def fronts(texts: DataFrame, folder: str, buckets: int, shards: int, side: int, threshold: float = THRESHOLD) -> DataFrame:
    """(shard, side, task, body) of the passages at the fronts of the texts: side 0 are evaluation texts, 1 training texts, of which only passages that
    evaluation texts may have are sent. A body has the columns of ``_opened``, one behind the other."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, task = _counts(folder, buckets), TaskContext.get().partitionId()
        gathered: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            shard, *columns = map(np.concatenate, zip(*gathered, strict=True))
            gathered.clear()
            order = np.argsort(shard, kind="stable")
            some, first = np.unique(shard[order], return_index=True)
            bodies = [b"".join(p.tobytes() for p in parts) for parts in zip(*(np.split(c[order], first[1:]) for c in columns), strict=True)] if len(some) else []
            size = len(some)
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(size, side, np.int32)), pa.array(np.full(size, task, np.int32)), pa.array(bodies, pa.binary())], names=["shard", "side", "task", "body"])

        for keys, hashes, offsets in _fresh(batches):
            text, run, passage, n, longest, count = _front(hashes, offsets, counts, threshold)
            if side:
                some = count > 0
                text, run, passage, n, longest = text[some], run[some], passage[some], n[some], longest[some]
            words_ = np.stack([(passage >> b & 0xFFFF).astype(np.uint16) for b in (32, 16, 0)], axis=1)
            k = np.array(keys, np.int64)[text]
            gathered.append(((run >> U64(32)) % U64(shards), words_, k, n.astype(np.int32), np.minimum(longest, 2**31 - 1).astype(np.int32)))
            if sum(len(g[0]) for g in gathered) > GATHERED:
                yield sent()
        if gathered:
            yield sent()

    return texts.select("k", "text", "d").mapInArrow(send, "shard int, side int, task int, body binary")


def _opened(body: bytes) -> tuple[np.ndarray, ...]:
    """(words: 16 bits of each of the three, k, n, longest) of the passages of a body."""
    size = len(body) // 22
    return (
        np.frombuffer(body, np.uint16, 3 * size).reshape(-1, 3), np.frombuffer(body, np.int64, size, 6 * size),
        np.frombuffer(body, np.int32, size, 14 * size), np.frombuffer(body, np.int32, size, 18 * size),
    )


def _symbols(words_: np.ndarray) -> str:
    """Six symbols and a space for each passage."""
    code = np.full((len(words_), 2 * RUN + 1), 0x20, np.uint32)
    code[:, 0:-1:2] = FIRST + (words_ >> 8)
    code[:, 1:-1:2] = SECOND + (words_ & 0xFF)
    return code.tobytes().decode("utf-32-le")


class _Shard:
    """The automaton of a shard's evaluation passages, and the texts that have each: those that have it early first."""

    def __init__(self, bodies: list[bytes]) -> None:
        import ahocorasick

        words_, k, n, longest = (np.concatenate(c) for c in zip(*map(_opened, bodies), strict=True))
        key = (words_.astype(np.int64) << np.array([32, 16, 0])).sum(axis=1)
        order = np.lexsort((longest, k, longest < n, key))
        key, k, n, longest = key[order], k[order], n[order], longest[order]
        once = np.append(True, (key[1:] != key[:-1]) | (k[1:] != k[:-1]) | (longest[1:] != longest[:-1]) | (n[1:] != n[:-1]))  # several tasks may have one text
        key, self.n, self.longest = key[once], n[once].astype(np.int64), longest[once]
        self.k, self.owner = np.unique(k[once], return_inverse=True)
        distinct, self.starts = np.unique(key, return_index=True)
        self.starts = np.append(self.starts, len(key))
        self.late = self.starts[:-1] + np.add.reduceat((self.longest >= self.n).astype(np.int64), self.starts[:-1])
        symbols = _symbols(np.stack([(distinct >> b & 0xFFFF).astype(np.uint16) for b in (32, 16, 0)], axis=1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at in range(len(distinct)):
            self.automaton.add_word(symbols[7 * at : 7 * at + 6], at)
        self.automaton.make_automaton()

    def matches(self, task: int, body: bytes, threshold: float) -> Iterator[pa.RecordBatch]:
        """(task, kt, ke, n, need) of the training texts of a body: how many passages of the fronts two texts have in common here, and have at least."""
        words_, k, n, longest = _opened(body)
        k, text = np.unique(k, return_inverse=True)
        n = n.astype(np.int64)
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(_symbols(words_))), np.int64).reshape(-1, 2)
        entry, passage = hits[:, 0] // (2 * RUN + 1), hits[:, 1]
        # two texts that both have a passage late, so that only shorter ones are left for either, have nothing to do with each other
        early = longest[entry] >= n[entry]
        size = np.where(early, self.starts[passage + 1], self.late[passage]) - self.starts[passage]
        ends = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOGETHER, side="right")))
            some = size[a:b]
            e = np.repeat(self.starts[passage[a:b]] - np.cumsum(some) + some, some) + np.arange(some.sum())
            t = np.repeat(entry[a:b], some)
            a = b
            n_t, n_e = n[t], self.n[e]
            fits = (n_t <= self.longest[e]) & (n_e <= longest[t]) & (n_t >= threshold * n_e - 1e-6) & (n_e >= threshold * n_t - 1e-6)
            t, e = t[fits], e[fits]
            pair, first, times = np.unique(text[t] * len(self.k) + self.owner[e], return_index=True, return_counts=True)
            if len(pair):
                columns = (np.full(len(pair), task), k[pair // len(self.k)], self.k[pair % len(self.k)], times, np.minimum(_least_shared(n[t[first]]), _least_shared(self.n[e[first]])))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(kind)) for c, kind in zip(columns, (np.int32, np.int64, np.int64, np.int32, np.int32), strict=True)], names=["task", "kt", "ke", "n", "need"])


def passage_matches(train: DataFrame, evaluation: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kt, ke), once each: training and evaluation texts that share enough passages at their fronts, all those near the same among them."""
    spark = train.sparkSession
    folder = new_folder(spark, "counts")
    buckets = count_passages(evaluation, folder)
    shards = max(1, -(-buckets // SHARD_PASSAGES), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies, built = None, [], None
        for batch in batches:
            for n in range(batch.num_rows):
                shard, side, task, body = (batch.column(c)[n].as_py() for c in range(4))
                if shard != now:
                    now, bodies, built = shard, [], None
                if side == 0:
                    bodies.append(body)
                elif bodies:
                    built = built or _Shard(bodies)
                    yield from built.matches(task, body, threshold)

    sent = fronts(evaluation, folder, buckets, shards, 0, threshold).union(fronts(train, folder, buckets, shards, 1, threshold))
    found = sent.repartition(shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(search, "task int, kt bigint, ke bigint, n int, need int")
    # a text that several tasks sent counts in each alone
    pairs = cut(found.groupBy("task", "kt", "ke").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need AND kt <> ke").select("kt", "ke").distinct())
    remove(folder)
    return pairs


def all_passages(texts: DataFrame, counts: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(k, words, need, keys, runs, rare): the passages at all positions of each evaluation text, the hashes of their whole words, and
    whether a passage is one of the rarest, at its first position: a text near the same has at least need of these."""
    rarity = texts.sparkSession.sparkContext.broadcast(counts)  # COUNT_BUCKETS entries

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        for keys, hashes, offsets in _fresh(batches):
            if not keys:
                continue
            needs, stands, rares = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                stand = np.arange(a, max(a, b - RUN + 1))
                passage, first = np.unique(_passage_key(hashes, stand), return_index=True)
                needs.append(max(1, int(SPARE * len(passage))))
                rare = np.zeros(len(stand), bool)
                rare[first[np.lexsort((passage, table[_bucket(passage)]))[: int((1 - threshold) * len(passage) + 1e-9) + needs[-1]]]] = True
                stands.append(stand)
                rares.append(rare)
            at, sizes = np.concatenate(stands), np.array([len(x) for x in stands])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(np.diff(offsets)), pa.array(needs, pa.int32()), list_array(_passage_key(hashes, at), sizes),
                    list_array(_run_hash(hashes, at).view(np.int64), sizes), list_array(np.concatenate(rares), sizes),
                ],
                names=["k", "words", "need", "keys", "runs", "rare"],
            )

    return texts.select("k", "text").mapInArrow(every, "k bigint, words bigint, need int, keys array<bigint>, runs array<bigint>, rare array<boolean>")


def _filter_bit(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U64) ^ U64(0x5BD1E995)) & U64(FILTER_BITS - 1)).astype(np.int64)


def _filter_bits(hashes: np.ndarray) -> np.ndarray:
    """The place of each run of words in the bit table of any shard."""
    return _filter_bit(_passage_key(hashes, np.arange(max(len(hashes) - RUN + 1, 0)))).astype(np.int32)


def _stretches(hashes: np.ndarray, offsets: np.ndarray, at: np.ndarray, bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of each text, without the words that no passage of the shard can reach; a space stands in each gap. With them the words
    that are left, where the symbols of each end, and where those of each text begin."""
    words_ = len(hashes)
    cover = np.zeros(words_ + 2, bool)
    if words_ >= RUN:
        some = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        # a run that reaches into the next text starts in this one's last two words
        text = np.searchsorted(offsets, some, side="right")
        some = some[some + RUN <= offsets[text]]
        for k in range(RUN):
            cover[some + k] = True
    kept = np.flatnonzero(cover[:words_])
    text = np.searchsorted(offsets, kept, side="right")
    gap = np.ones(len(kept), np.int64)
    gap[1:] = (np.diff(kept) > 1) | (np.diff(text) > 0)
    ends = np.cumsum(2 + gap)
    code = np.full(ends[-1] if len(ends) else 0, 0x20, np.uint32)
    code[ends - 2] = FIRST + (hashes[kept] >> U64(56)).astype(np.uint32)
    code[ends - 1] = SECOND + ((hashes[kept] >> U64(48)) & U64(0xFF)).astype(np.uint32)
    symbols = code.tobytes().decode("utf-32-le")
    stops = np.concatenate([[0], ends])[np.searchsorted(kept, offsets)]
    return [symbols[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)], kept, ends, stops


def _write_arrays(files, path: str, name: str, **arrays: np.ndarray) -> None:
    holds = io.BytesIO()
    np.savez(holds, **arrays)
    unique = f"{path}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(unique) as out:
        out.write(holds.getvalue())
    files.move(unique, f"{path}/{name}.npz")


def _write(files, path: str, shard: int, distinct: np.ndarray, **arrays: np.ndarray) -> None:
    """The automaton of a shard's distinct passages, the bit table of them, and the arrays that belong to it."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, key in enumerate(distinct.tolist()):
        automaton.add_word(_key_symbols(key), n)
    automaton.make_automaton()
    at = _filter_bit(distinct)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    _write_arrays(files, path, str(shard), bits=bits, **arrays)
    local = f"{path}/{shard}.{uuid.uuid4().hex}"
    if files.type_name == "local":
        automaton.save(local)
    else:
        with files.open_output_stream(local) as out:
            out.write(pickle.dumps(automaton))
    files.move(local, f"{path}/{shard}")


def build_whole_automata(chosen: DataFrame, folder: str, shards: int) -> None:
    """Write each shard's automaton of the passages at all positions, and which texts have the rare ones, to the shared folder; a file beside it
    has the texts as numbers of their runs, in order. A shard has about SHARD_PASSAGES passages. A task that is run again writes the same files again."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for n, (shard, k, need) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True)):
                parts.setdefault(shard, {})[k] = (need, *(batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5)))
        files, path = file_system(folder)
        for shard, texts in parts.items():
            sizes = np.array([len(t[1]) for t in texts.values()])
            keys, hashes, rare = (np.concatenate([t[c] for t in texts.values()]) for c in (1, 2, 3))
            distinct, passage = np.unique(keys, return_inverse=True)
            full, run = np.unique(hashes, return_inverse=True)  # as signed numbers
            at = np.flatnonzero(rare)
            at = at[np.argsort(passage[at], kind="stable")]
            offsets = np.append(0, np.cumsum(sizes))
            text = np.searchsorted(offsets, at, side="right") - 1
            _write_arrays(files, path, f"{shard}.texts", k=np.array(list(texts)), offsets=offsets, run=run.astype(np.int32))
            _write(
                files, path, shard, distinct, starts=np.searchsorted(passage[at], np.arange(len(distinct) + 1)), owner=text, ats=at - offsets[text],
                k=np.array(list(texts)), need=np.array([t[0] for t in texts.values()]), full=full,
            )
        yield pa.RecordBatch.from_arrays([pa.array(sorted(parts), pa.int32())], names=["shard"])

    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    sharded = chosen.where(F.size("keys") > 0).select(F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int").alias("shard"), "k", "need", "keys", "runs", "rare")
    sharded.repartition(shards, "shard").mapInArrow(build, "shard int").count()


#: The shards that a worker read last, kept for its next task.
_HELD: dict[tuple[str, int], object] = {}
HELD_SHARDS = 2


def _load(folder: str, shard: int):
    """The automaton of a shard and what belongs to it, or None where no text fell into it."""
    if (folder, shard) not in _HELD:
        for old in list(_HELD)[: max(0, len(_HELD) - HELD_SHARDS + 1)]:
            del _HELD[old]
        _HELD[folder, shard] = _read(folder, shard)
    return _HELD[folder, shard]


def _read(folder: str, shard: int):
    import ahocorasick
    from pyarrow import fs

    files, path = file_system(folder)
    name = f"{path}/{shard}"
    if files.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{name}.npz") as source:
        holds = dict(np.load(io.BytesIO(source.read())))
    if files.type_name == "local":
        return ahocorasick.load(name, pickle.loads), holds
    with files.open_input_stream(name) as source:
        return pickle.loads(source.read()), holds


def _hits(automaton, strings: list[str]) -> list[np.ndarray]:
    """(symbol it ends with, passage) of every match in each text."""
    return [np.fromiter(chain.from_iterable(automaton.iter(string)), np.int64).reshape(-1, 2) for string in strings]


def _matches(holds: dict[str, np.ndarray], keys: list[int], hits: list[np.ndarray]) -> pa.RecordBatch | None:
    """Pairs of the texts and the shard's evaluation texts that have enough passages in common."""
    count = len(holds["k"])
    found = [np.unique(h) for h in hits]
    hit, owner_text = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    size = holds["starts"][hit + 1] - holds["starts"][hit]
    if not size.sum():
        return None
    where = np.repeat(holds["starts"][hit] - np.cumsum(size) + size, size) + np.arange(size.sum())
    pair = np.repeat(owner_text, size) * count + holds["owner"][where]
    order = np.argsort(pair, kind="stable")
    pair, where = pair[order], where[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    times = np.diff(np.append(first, len(pair)))
    some = np.repeat(times >= holds["need"][pair[first] % count], times)
    if not some.any():
        return None
    pair, at = pair[some], holds["ats"][where[some]]
    order = np.lexsort((at, pair))
    pair, at = pair[order], at[order]
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    # intervals [at, at + RUN) of a pair, merged: each adds what the one before does not reach
    gap = np.append(RUN + 1, np.diff(at))
    gap[first] = RUN + 1
    names = pair[first]
    columns = (
        np.array(keys)[names // count], holds["k"][names % count], np.diff(np.append(first, len(pair))),
        np.add.reduceat(np.minimum(gap, RUN), first), np.add.reduceat((gap > RUN).astype(np.int64), first),
    )
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["kt", "ke", "matched", "covered", "intervals"])


def text_overlaps(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(members (id, k, d, split), links (kt, ke, dt, de, similarity) of near-same texts of a training and an evaluation row)."""
    part = F.when(F.col(split_col).isin(*EVALUATION), "e").otherwise("t")
    known = df.where(F.col(split_col).isin("train", *EVALUATION))
    train = keyed(known.where(part == "t"), id_col, text_col)
    evaluation = keyed(known.where(part == "e"), id_col, text_col)
    texts = keyed(known, id_col, text_col)
    pairs = passage_matches(train, evaluation).select(F.col("kt").alias("ka"), F.col("ke").alias("kb"))
    links = verified(texts, pairs).select(F.col("ka").alias("kt"), F.col("kb").alias("ke"), F.col("da").alias("dt"), F.col("db").alias("de"), "similarity")
    members = known.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("k"), F.unhex(F.md5(text_col)).alias("d"), F.col(split_col).alias("split"))
    return cut(members), links


def summary_keys(df: DataFrame, id_col: str, summary_col: str, split_col: str) -> DataFrame:
    """(id, s, split): digest of the words of each summary that has at least eight."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) if len(w) >= SUMMARY_WORDS else None for w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(2)], names=["id", "s", "split"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, summary_col, split_col).mapInArrow(digest, f"id {kind}, s binary, split string").where("s IS NOT NULL")


def _equal(keys: DataFrame, key: str) -> DataFrame:
    """(t, e): training and evaluation rows of one key. Keys that only one side has are dropped before rows meet; a key with many rows meets in
    parts."""
    both = keys.groupBy(key).agg(F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("e")).where("t AND e").select(key)
    rows = cut(keys.join(both, key, "left_semi"))
    train = rows.where("split = 'train'").select(key, F.col("id").alias("t"))
    evaluation = rows.where("split <> 'train'").select(key, F.col("id").alias("e"))
    return met(train, evaluation, key, "t", "e").select("t", "e")


def overlaps(df: DataFrame, id_col: str = "row_id", name_col: str = "id", text_col: str = "text", summary_col: str = "summary", split_col: str = "split") -> DataFrame:
    """(t, e): every pair of a training and an evaluation row that overlap by id number, text or summary, once."""
    known = df.where(F.col(split_col).isin("train", *EVALUATION))
    members, links = text_overlaps(df, id_col, text_col, split_col)
    train = members.where("split = 'train'").select(F.col("d").alias("dt"), F.col("id").alias("t"))
    evaluation = members.where("split <> 'train'").select(F.col("d").alias("de"), F.col("id").alias("e"))
    links = cut(links.select("dt", "de").withColumn("_link", F.monotonically_increasing_id()))
    near = met(evaluation, cut(met(train, links, "dt", "t", "_link").select("t", "de")), "de", "e", "t").select("t", "e")
    same = _equal(members.select("id", "d", "split"), "d")
    number = F.regexp_extract(name_col, r"-0*([0-9]+)$", 1)
    # both are read three times each
    numbers = cut(known.select(F.col(id_col).alias("id"), number.alias("n"), F.col(split_col).alias("split")).where("n <> ''"))
    summaries = cut(summary_keys(known, id_col, summary_col, split_col))
    return near.union(same).union(_equal(numbers, "n")).union(_equal(summaries, "s")).distinct()


def overlap_counts(pairs: DataFrame, df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(split, source, eval_rows, train_rows, pairs): overlaps of the evaluation rows by their split and source."""
    rows = df.select(F.col(id_col).alias("e"), "split", "source")
    return pairs.join(rows, "e").groupBy("split", "source").agg(F.countDistinct("e").alias("eval_rows"), F.countDistinct("t").alias("train_rows"), F.count("*").alias("pairs"))


def _marked(holds: dict[str, np.ndarray], hashes: np.ndarray, hits: list[np.ndarray], kept: np.ndarray, ends: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers of the shard's runs that the matches are: the three words must be the same as a whole."""
    stop = np.concatenate([h[:, 0] + 1 + a for h, a in zip(hits, stops[:-1], strict=True)])
    runs = _run_hash(hashes, kept[np.searchsorted(ends, stop)] - (RUN - 1))
    at = np.minimum(np.searchsorted(holds["full"], runs.view(np.int64)), len(holds["full"]) - 1)
    return at[holds["full"][at] == runs.view(np.int64)]


def scan_whole(texts: DataFrame, folder: str, shards: int) -> DataFrame:
    """(shard, run) of the runs of evaluation texts that stand in a training text, and (kt, ke) of the pairs that have enough rare passages in common."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(keys, hashes, offsets, _filter_bits(hashes)) for keys, hashes, offsets in _fresh(batches) if keys]
        for shard in sorted(range(shards), key=lambda s: (folder, s) not in _HELD):
            loaded = _load(folder, shard) if held else None
            if not loaded:
                continue
            automaton, holds = loaded
            marks = np.zeros(len(holds["full"]), bool)
            for keys, hashes, offsets, at in held:
                strings, kept, ends, stops = _stretches(hashes, offsets, at, holds["bits"])
                hits = _hits(automaton, strings)
                marks[_marked(holds, hashes, hits, kept, ends, stops)] = True
                if (found := _matches(holds, keys, [h[:, 1] for h in hits])) is not None:
                    none = pa.nulls(found.num_rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([none, none, found.column(0), found.column(1)], names=["shard", "run", "kt", "ke"])
            run = np.flatnonzero(marks).astype(np.int32)
            none = pa.nulls(len(run), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(run), shard, np.int32)), pa.array(run), none, none], names=["shard", "run", "kt", "ke"])

    return texts.select("k", "text").mapInArrow(search, "shard int, run int, kt bigint, ke bigint")


def merged(found: DataFrame, folder: str, shards: int) -> DataFrame:
    """(ke, covered, intervals): the words of each evaluation text that the marked runs (shard, run) cover, as merged intervals."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        texts: dict[int, dict[str, np.ndarray]] = {}
        marks: dict[int, np.ndarray] = {}
        for batch in batches:
            shard, run = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for one in np.unique(shard).tolist():
                if one not in texts:
                    with files.open_input_stream(f"{path}/{one}.texts.npz") as source:
                        texts[one] = dict(np.load(io.BytesIO(source.read())))
                    marks[one] = np.zeros(texts[one]["run"].max() + 1, bool)
                marks[one][run[shard == one]] = True
        for shard, of in texts.items():
            sizes = np.diff(of["offsets"])
            # words of all texts in a row: a text has RUN - 1 more than runs
            begin = np.append(0, np.cumsum(sizes + RUN - 1))
            start = np.flatnonzero(marks[shard][of["run"]])
            start += (RUN - 1) * (np.searchsorted(of["offsets"], start, side="right") - 1)
            cover = np.zeros(begin[-1], bool)
            for k in range(RUN):
                cover[start + k] = True
            opens = cover.copy()
            opens[1:] &= ~cover[:-1]
            opens[begin[:-1]] = cover[begin[:-1]]
            covered, intervals = (np.add.reduceat(x.astype(np.int64), begin[:-1]) for x in (cover, opens))
            yield pa.RecordBatch.from_arrays([pa.array(of["k"]), pa.array(covered), pa.array(intervals)], names=["ke", "covered", "intervals"])

    return found.repartition(shards, "shard").mapInArrow(merge, "ke bigint, covered bigint, intervals bigint")


def coverage(df: DataFrame, id_col: str = "row_id", text_col: str = "text", split_col: str = "split") -> DataFrame:
    """(id_col, matched_texts, covered_words, intervals) of each evaluation row: the training texts that hold enough of its rare passages,
    and the words, as merged intervals, of all its passages that stand in any training text. A text of fewer than three words is covered
    by an equal one."""
    known = df.where(F.col(split_col).isin("train", *EVALUATION))
    train, evaluation = keyed(known.where(F.col(split_col) == "train"), id_col, text_col), keyed(known.where(F.col(split_col) != "train"), id_col, text_col)
    chosen = cut(all_passages(evaluation, passage_counts(evaluation)))
    folder = new_folder(train.sparkSession, "automata")
    total = chosen.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-total // SHARD_PASSAGES))
    build_whole_automata(chosen, folder, shards)
    found = cut(scan_whole(train, folder, shards))
    covered = merged(found.where("run IS NOT NULL").select("shard", "run"), folder, shards)
    matched = found.where("kt IS NOT NULL").groupBy("ke").agg(F.countDistinct("kt").alias("matched"))
    short = chosen.where(F.col("words").between(1, RUN - 1)).select("k", "words").distinct()
    equal = evaluation.join(short, "k").join(train.select("d").distinct(), "d", "left_semi").select(F.col("k").alias("ke"), "words").distinct()
    rows = evaluation.select(F.col("id").alias(id_col), F.col("k").alias("ke"))
    return rows.join(covered, "ke", "left").join(matched, "ke", "left").join(equal, "ke", "left").select(
        id_col,
        F.coalesce("matched", F.when(F.col("words").isNotNull(), F.lit(1)), F.lit(0)).cast("bigint").alias("matched_texts"),
        F.coalesce("covered", "words", F.lit(0)).alias("covered_words"),
        F.coalesce("intervals", F.when(F.col("words").isNotNull(), F.lit(1)), F.lit(0)).cast("bigint").alias("intervals"),
    )
