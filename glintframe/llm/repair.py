"""Token ids in a grammar-compressed file format: Re-Pair for each shard, decoded from any document on."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from glintframe.llm.common import octets, partitions, sole_memory

END = 2
SHARD_TOKENS = 1 << 20
ROUNDS = 8
LEAST_USES = 24
LIMIT = 1 << 16  # symbols of a shard, ids and nonterminals, so that one takes two octets
CACHE = 800_000  # words whose ids a worker remembers, besides those of the batch at hand
_SLOTS = 1 << 18
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE, _OTHER, _SIGN, _ALNUM = range(4)
_KIND = bytes(_SPACE if x in b" \t\n\v\f\r" else _SIGN if x in _SIGNS else _ALNUM if x in b"0123456789abcdefghijklmnopqrstuvwxyz" else _OTHER
              for x in range(256))


class Encoder:
    """Ids of texts, by way of a memory of words: white space always parts tokens, so a text is the sum of its words.

    So does the place between a letter or digit and a sign, and a space there changes nothing. The words of many
    texts are told apart at once, and each distinct one is looked up once. Unknown words of letters alone are
    encoded as one long text and told apart by the word ends in the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {b"": b""}, {}
        self.size = self.tokenizer.get_vocab_size()
        if self.size >= LIMIT:
            raise ValueError(f"{self.size} ids do not fit two octets")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        # words whose lower case, too, is letters alone: one run of letters, and one word end
        letters, rest = [], []
        for w in words:
            (letters if w.isalpha() or w.decode().lower().isalpha() else rest).append(w)
        for i in range(0, len(letters), 250):
            part = letters[i:i + 250]
            ids, = self._encoded([b" ".join(part).decode()])
            stop = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
            if len(stop) == len(part):
                octet = ids.tobytes()
                self.known.update((w, octet[a:b]) for w, a, b in zip(part, [0, *stop], stop))
            else:
                rest += part
        for i in range(0, len(rest), 2000):
            part = rest[i:i + 2000]
            self.known.update((w, ids.tobytes()) for w, ids in zip(part, self._encoded([w.decode() for w in part])))

    def _words(self, texts: list[bytes]) -> tuple[list[bytes], pa.Array, np.ndarray]:
        """The distinct words; their places for every word of the texts, one text after the other; words before the end of each text."""
        whole = b"".join(texts)
        stop = np.cumsum([len(t) for t in texts])
        lower = whole.lower()  # joins the forms of a word
        octet, kind = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(_KIND), np.uint8)
        begin = np.ones(len(octet), bool)
        begin[1:] = (kind[:-1] == _SPACE) | (kind[:-1] == _ALNUM) & (kind[1:] == _SIGN)
        if b"<|" in whole:
            # a text that may hold a special token, which is told by case, is left as it is
            octet = octet.copy()
            for t, b in zip(texts, stop.tolist()):
                if b"<|" in t:
                    a = b - len(t)
                    octet[a:b] = np.frombuffer(t, np.uint8)
                    begin[a + 1:b] = kind[a:b - 1] == _SPACE
        begin[[b - len(t) for t, b in zip(texts, stop.tolist()) if t]] = True
        ink = kind != _SPACE
        first = np.flatnonzero(begin[ink])
        buffers = [None, pa.py_buffer(np.append(first, np.count_nonzero(ink))), pa.py_buffer(octet[ink])]
        found = pa.Array.from_buffers(pa.large_binary(), len(first), buffers).dictionary_encode()
        if not len(first):
            return [], found.indices, np.zeros(len(texts), np.int64)
        _, ends, data = found.dictionary.buffers()
        cut, data = np.frombuffer(ends, np.int64)[:len(found.dictionary) + 1].tolist(), data.to_pybytes()
        return [data[a:b] for a, b in zip(cut, cut[1:])], found.indices, np.searchsorted(np.flatnonzero(begin & ink), stop)

    def _recall(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, as octets. When the newer half of the memory is full it becomes the older, whose words go unless met again."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE // 2:
            self.known, self.older, new = {b"": b""}, self.known, words
        known, older = self.known, self.older
        known.update((w, older[w]) for w in new if w in older)
        new = {w for w in new if w not in known}
        tails = []
        for w in [w for w in new if w[-1] < 0x80 and not w[-1:].isalnum()]:
            core = w.rstrip(_SIGNS)
            if core and b"<|" not in w and core.decode()[-1].lower().isalpha():
                tails.append((w, core, w[len(core):]))
                new.discard(w)
        self._learn(list(new))
        self._learn(list({x for _, *both in tails for x in both if x not in known}))
        known.update((w, known[core] + known[tail]) for w, core, tail in tails)
        return [known[w] for w in words]

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        words, places, before = self._words(texts)
        _, ends, ids = pa.array(self._recall(words), pa.large_binary()).take(places).buffers()
        cut = (np.frombuffer(ends, np.int64)[before] // 2).tolist()
        ids = np.frombuffer(ids or b"", np.uint16)
        return [ids[a:b] for a, b in zip([0, *cut], cut)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(ids: np.ndarray, first: int, end: int = END, rounds: int = ROUNDS, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: ``(sequence, rules)``; symbol ``first + i`` stands for the pair ``rules[i]``.

    Every round counts the neighbouring pairs, takes those at least an eighth as frequent as the most frequent one,
    and replaces their occurrences, from the left and never overlapping, each pair by its own nonterminal. No pair
    begins with the end id, so a document is a whole number of symbols. Two pairs may share a slot of the counting
    table; the later one then waits for a later round. A round that shortens the sequence by less than a hundredth
    is the last.
    """
    seq, rules = ids.astype(np.uint32), np.empty((0, 2), np.uint32)
    for _ in range(rounds):
        if len(seq) < 2 or first + len(rules) >= LIMIT:
            break
        pair = seq[:-1] << np.uint32(16) | seq[1:]
        slot = ((pair * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.intp)
        held = np.zeros(_SLOTS, np.uint32)
        held[slot] = pair
        open_ = (held[slot] == pair) & (seq[:-1] != end)
        count = np.bincount(slot[open_], minlength=_SLOTS)
        top = np.flatnonzero(count >= max(least, count.max() // 8))
        if not len(top):
            break
        top = top[np.argsort(-count[top], kind="stable")][:LIMIT - first - len(rules)]
        weight = np.zeros(_SLOTS, np.int32)
        weight[top] = len(top) - np.arange(len(top))
        here = weight[slot] * open_
        sole = here > 0
        sole[1:] &= here[1:] > here[:-1]
        sole[:-1] &= here[:-1] >= here[1:]
        at = np.flatnonzero(sole)
        rules = np.concatenate([rules, np.stack([held[top] >> np.uint32(16), held[top] & np.uint32(0xFFFF)], axis=1)])
        seq = seq.copy()
        seq[at] = first + len(rules) - weight[slot[at]].astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        if len(at) * 100 < len(keep):
            break
    return seq.astype(np.uint16), rules.astype(np.uint16)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    out = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[first + i] = out[a] + out[b]
    return out[first:]


def expand(seq: np.ndarray, rules: np.ndarray, first: int, length: np.ndarray) -> np.ndarray:
    """The ids of a sequence of symbols: every nonterminal is copied from the table of all expansions."""
    size = np.r_[np.ones(first, np.int64), length]
    start = np.r_[0, np.cumsum(size)[:-1]]
    flat = np.empty(int(size.sum()), np.uint16)
    flat[:first] = np.arange(first)
    for i, (a, b) in enumerate(rules.tolist()):
        s = start[first + i]
        flat[s:s + size[a]] = flat[start[a]:start[a] + size[a]]
        flat[s + size[a]:s + size[a] + size[b]] = flat[start[b]:start[b] + size[b]]
    n = size[seq]
    before = np.cumsum(n) - n
    return flat[np.repeat(start[seq] - before, n) + np.arange(int(n.sum()))]


def random_access(seq: np.ndarray, rules: np.ndarray, first: int, length: np.ndarray, begin: int, stop: int) -> np.ndarray:
    """Ids ``begin`` up to ``stop`` of a shard, expanding only the symbols that hold them."""
    ends = np.cumsum(np.r_[np.ones(first, np.int64), length][seq])
    a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, stop, side="left") + 1
    from_ = int(ends[a - 1]) if a else 0
    return expand(seq[a:b], rules, first, length)[begin - from_:stop - from_]


_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("first", pa.int32()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])
_SHARD_DDL = ("part int, shard int, before long, n_tokens long, first int, doc_ids array<long>, doc_tokens array<int>, "
              "rules binary, rule_lengths binary, symbols binary")


def _write_shards(path: str, end: int, per_shard: int):
    def run(batches):
        sole_memory("repair", _ENCODERS.clear)
        encode, part = encoder(path), TaskContext.get().partitionId()
        number = before = 0
        ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def close():
            seq, rules = compress(np.concatenate(held), encode.size, end)
            size = np.array([len(x) for x in held], np.int32)
            row = [part, number, before, total, encode.size, ids, size, rules.astype("<u2").tobytes(), lengths(rules, encode.size).astype("<u4").tobytes(), seq.astype("<u2").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), encode(octets(batch.column(1)))):
                ids.append(doc), held.append(np.append(got, np.uint16(end)))
                total += len(got) + 1
                if total >= per_shard:
                    yield close()
                    number, before, ids, held, total = number + 1, before + total, [], [], 0
        if held:
            yield close()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, per_shard: int = SHARD_TOKENS) -> None:
    """Encode all documents and write the shards to ``path``, in ascending order of ``doc_id``.

    A file holds the shards of one range of ids. A shard is a row: its place (``part, shard``), the ids of the part
    before it, its documents with their numbers of ids, the rules, the length of every rule's expansion, and the
    symbols, two octets each. A task holds one shard at a time.

    Null and empty texts are the end id alone; null ids come first; rows that share an id stand next to each other;
    further columns are not written; no rows give no shards.
    """
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id"))
    placed.mapInArrow(_write_shards(tokenizer, end, per_shard), _SHARD_DDL).write.option("compression", "zstd").parquet(path)


_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read_shards(digest: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"], "<u2"), rules, row["first"], np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)).astype("<u4")
                size = np.array(row["doc_tokens"], np.int64)
                stop = np.cumsum(size)
                octet = memoryview(ids).cast("B")
                pieces = [octet[4 * (b - n):4 * b] for b, n in zip(stop.tolist(), size.tolist())]
                last = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest else pa.array([bytes(p) for p in pieces], pa.binary())
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(stop - size + row["start"]), pa.array(size), last]
                yield pa.RecordBatch.from_arrays(columns, schema=_DIGEST if digest else _DOC)

    return run


def read_tokens(spark, path: str, digest: bool = False) -> DataFrame:
    """Documents of a written set: ``doc_id, start, n_tokens`` and ``ids`` (little-endian 32-bit) or their ``ids_crc32``.

    ``start`` counts the ids of all documents before; only one sum for each file part is gathered for it.
    """
    shards = spark.read.schema(_SHARD_DDL).parquet(path)
    sums = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    bases, total = [], 0
    for part in sorted(sums):
        bases.append((part, total))
        total += sums[part]
    base = spark.createDataFrame(bases, "part int, base long")
    placed = shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))  # one row for each part written
    kind = "ids_crc32 long" if digest else "ids binary"
    return placed.mapInArrow(_read_shards(digest), f"doc_id long, start long, n_tokens long, {kind}")
