"""Language-model scores: a trigram model in Elias-Fano tries, dealt over shards.

Documents are cut into chunks of about two million tokens. A chunk sends its different words,
pairs and triples of words, with their training counts, to shards of the first word's hash
range. A shard sums the counts of all chunks, builds its trie with quantised smoothed
probabilities in one memory map, answers the chunks' pairs and triples from it, and sends one
byte for each back. So the model may grow with the corpus: no task or driver ever holds more
than one shard of it. Words that alone would outgrow a shard are split by successor, and pairs
of two such words by theirs.

The model is P(x | v, w) = (c(vwx) + nu P(x | w)) / (c(vw) + nu), over
P(x | w) = (c(wx) + mu P(x)) / (c(w) + mu), P(x) being the base. The fractions c / (c + mu)
and mu / (c + mu) are kept as codes of 1/25 decade, so a word's log10 probability is off by at
most 0.04 from the unquantised one, down to 1e-10.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardsieve.llm.common import (
    SLICE_BYTES,
    by_value,
    dictionary_hashes,
    input_parts,
    keep,
    mix,
    sorted_groups,
    split_words,
    text_slices,
)
from cardsieve.llm.elias_fano import ABSENT, Trie, numbers
from cardsieve.llm.token_store import decode_numbers, encode_numbers

by_value(__name__)

# The end token and the context of a first word: hashes that no word is given.
_END, _BEGIN = np.uint64(1), np.uint64(2)
# Keys that are looked up at one time; this bounds memory only.
_LOOKUP = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """Settings: `mu` is the weight of the base, `nu` that of pairs; sizes bound a task's memory."""

    mu: float = 20.0
    nu: float = 20.0
    chunk_tokens: int = 2_000_000
    shard_tokens: int = 2_500_000


def _chunks(docs: DataFrame, how: LanguageModel) -> DataFrame:
    """Runs of documents: their tokens as numbers of the chunk's words, by frequency."""
    schema = pa.schema(
        [
            ("chunk", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("held", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int64())),
            ("words", pa.binary()),
            ("counts", pa.binary()),
            ("control", pa.binary()),
            ("data", pa.binary()),
        ]
    )

    def work(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held, parts = [], []

        def flush():
            sizes = np.array([len(p) for p in parts])
            words, tokens = np.unique(np.append(np.concatenate(parts), _BEGIN), return_inverse=True)
            tokens = tokens[:-1]
            learned = np.repeat(np.array([not h for _, h in held]), sizes)
            counts = np.bincount(tokens[learned], minlength=len(words))
            # Frequent words get small numbers, which take one byte.
            order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            values = [
                chunk,
                [d for d, _ in held],
                [h for _, h in held],
                sizes.tolist(),
                words[order].tobytes(),
                counts[order].astype("<u4").tobytes(),
                *encode_numbers(rank[tokens]),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema
            )

        waiting = 0
        for batch in batches:
            names = zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist())
            for some in text_slices(batch["text"], SLICE_BYTES):
                found, starts = split_words(some, lower=True)
                hashes = dictionary_hashes(found)
                hashes[hashes <= _BEGIN] += np.uint64(16)
                for start, end in zip(starts[:-1], starts[1:]):
                    held.append(next(names))
                    parts.append(np.append(hashes[start:end], _END))
                    waiting += end - start + 1
                    if waiting >= how.chunk_tokens:
                        yield flush()
                        chunk, waiting = chunk + 1, 0
                        held, parts = [], []
        if held:
            yield flush()

    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return docs.select(
        F.col("doc_id").cast("long"), (rest == 1).alias("held"), "text"
    ).mapInArrow(
        work,
        "chunk long, doc_ids array<long>, held array<boolean>, sizes array<long>,"
        " words binary, counts binary, control binary, data binary",
    )


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hash space; higher hashes never lie in lower shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_shards: np.ndarray, shards: int):
    """(shard, begin, end) of each run in sorted shard numbers."""
    found = np.flatnonzero(np.diff(sorted_shards, prepend=-1))
    for begin, end in zip(found, np.append(found[1:], len(sorted_shards))):
        yield int(sorted_shards[begin]), int(begin), int(end)


def _pack(*arrays: np.ndarray) -> bytes:
    """Numbers of fixed sizes, byte by byte of all of an array, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) for a in arrays]
    return pa.Codec("zstd").compress(b"".join(p.tobytes() for p in planes), asbytes=True)


def _unpack(data: bytes, sizes: list[int], kinds: str) -> list[np.ndarray]:
    """The arrays again; `kinds` has a NumPy letter for each."""
    kinds = [np.dtype(f"<{kind}") for kind in kinds.split()]
    whole = sum(size * kind.itemsize for size, kind in zip(sizes, kinds))
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, whole), np.uint8)
    out, at = [], 0
    for size, kind in zip(sizes, kinds):
        planes = raw[at : at + size * kind.itemsize].reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _rows(batch: pa.RecordBatch):
    """Each row by itself, since a chunk's row is large."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def _steps(hashes: np.ndarray) -> np.ndarray:
    """What each of some ascending hashes adds to the one before; `np.cumsum` undoes it."""
    return np.diff(hashes, prepend=np.uint64(0))


def _dealt(requests: DataFrame) -> DataFrame:
    """One shard's requests side by side."""
    parts = input_parts(requests.sparkSession)
    return requests.repartition(parts, "shard").sortWithinPartitions("shard")


def _word_counts(chunks: DataFrame, shards: int, hot: int) -> DataFrame:
    """Per chunk and shard, the training counts of the chunk's words, in their order.

    Rows with a null chunk carry a shard's number of different training words, and its words
    of at least `hot` occurrences.
    """

    def ask(batches):
        for batch in batches:
            for chunk, words, counts in zip(*(batch[c].to_pylist() for c in ("chunk", "words", "counts"))):
                words, counts = np.frombuffer(words, np.uint64), np.frombuffer(counts, "<u4")
                order = np.argsort(words)
                words, counts = words[order], counts[order]
                rows = [
                    (s, chunk, e - b, _pack(_steps(words[b:e]), counts[b:e]))
                    for s, b, e in _cuts(_shard_of(words, shards), shards)
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["shard", "chunk", "n", "data"]
                )

    def answer(batches):
        for group in sorted_groups(batches, ["shard"]):
            words, counts = [], []
            for n, data in zip(group["n"].to_pylist(), group["data"].to_pylist()):
                steps, own = _unpack(data, [n, n], "u8 u4")
                words.append(np.cumsum(steps))
                counts.append(own)
            known, place = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
            many = total >= hot
            ends = np.cumsum([len(w) for w in words])[:-1]
            own = [total[p].astype("<i8").tobytes() for p in np.split(place, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*group["chunk"].to_pylist(), None], pa.int64()),
                    pa.array([group["shard"][0].as_py()] * (len(own) + 1), pa.int64()),
                    pa.array([*own, total[many].astype("<i8").tobytes()], pa.binary()),
                    pa.array([*[None] * len(own), known[many].tobytes()], pa.binary()),
                    pa.array([*[None] * len(own), int((total > 0).sum())], pa.int64()),
                ],
                ["chunk", "shard", "totals", "hot_words", "different"],
            )

    requests = chunks.select("chunk", "words", "counts").mapInArrow(
        ask, "shard long, chunk long, n long, data binary"
    )
    return _dealt(requests).mapInArrow(
        answer, "chunk long, shard long, totals binary, hot_words binary, different long"
    )


class Ngrams:
    """The different pairs and triples of a chunk's tokens, as they are dealt over shards.

    `pair` are the pairs by shard, context and word. A pair of two hot words is there once for
    each shard that its triples are split over; every chunk sends it to all of those, so each
    has its whole count. `triple` are the triples in the order of their pairs in `pair`, and
    `runs` says how many each of those has.
    """

    def __init__(self, row: dict, shards: int, hot: dict[int, int], hot_size: int):
        words = np.frombuffer(row["words"], np.uint64)
        self.sizes = np.array(row["sizes"])
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words = words[order]
        tokens = place[decode_numbers(row["control"], row["data"], int(self.sizes.sum()))]
        self.tokens = tokens.astype(np.uint32)
        learned = np.repeat(~np.array(row["held"], bool), self.sizes)
        firsts = np.cumsum(self.sizes) - self.sizes
        keys = np.empty_like(tokens)
        keys[1:] = tokens[:-1]
        keys[firsts] = np.searchsorted(self.words, _BEGIN)
        keys *= len(self.words)
        keys += tokens
        keys, pair_of = np.unique(keys, return_inverse=True)
        self.pair_of = pair_of.astype(np.uint32)
        self.context, self.word = (x.astype(np.uint32) for x in np.divmod(keys, len(self.words)))
        self.pair_counts = np.bincount(pair_of[learned], minlength=len(keys)).astype(np.uint32)
        # A text's first token has no pair before it, so it ends no triple.
        self.later = np.ones(len(self.tokens), bool)
        self.later[firsts] = False
        third = np.flatnonzero(self.later)
        keys = pair_of[third - 1]
        keys *= len(self.words)
        keys += tokens[third]
        del tokens, pair_of
        keys, place = np.unique(keys, return_inverse=True)
        self.triple_of = place.astype(np.uint32)
        counts = np.bincount(place[learned[third]], minlength=len(keys))
        self.triple_counts = counts.astype(np.uint32)
        owner, self.third = (x.astype(np.uint32) for x in np.divmod(keys, len(self.words)))
        del keys, place, counts, third

        ways = np.ones(len(self.words), np.int64)
        for word, count in hot.items():
            at = np.searchsorted(self.words, np.uint64(word))
            if at < len(self.words) and self.words[at] == word:
                ways[at] = min(shards, -(-count // hot_size))
        spread = mix(self.words)
        shard = _shard_of(self.words, shards)[self.context]
        shard += (spread[self.word] % ways.astype(np.uint64)[self.context]).astype(np.int64)
        times = np.minimum(ways[self.context], ways[self.word])
        begin = np.cumsum(times) - times
        copies = np.repeat(np.arange(len(times)), times)
        shard = (shard[copies] + np.arange(len(copies)) - begin[copies]) % shards
        order = np.argsort(shard, kind="stable")
        self.pair, self.shard = copies[order].astype(np.uint32), shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        way = (spread[self.third] % times.astype(np.uint64)[owner]).astype(np.int64)
        place = place[begin[owner] + way]
        self.triple = np.argsort(place, kind="stable").astype(np.uint32)
        self.runs = np.bincount(place, minlength=len(order))


def _ngram_codes(
    chunks: DataFrame, shards: int, hot: dict[int, int], hot_size: int, how: LanguageModel
) -> DataFrame:
    """Per chunk and shard: codes of its pairs and triples and of what their contexts leave."""

    def ask(batches):
        for batch in batches:
            for row in _rows(batch):
                own = Ngrams(row, shards, hot, hot_size)
                ends = np.append(0, np.cumsum(own.runs))
                for shard, b, e in _cuts(own.shard, shards):
                    pair, triple = own.pair[b:e], own.triple[ends[b] : ends[e]]
                    heads = np.flatnonzero(np.diff(own.context[pair], prepend=-1))
                    used, which = np.unique(
                        np.append(own.word[pair], own.third[triple]), return_inverse=True
                    )
                    numbers_of = (
                        np.diff(np.append(heads, e - b)),
                        own.runs[b:e],
                        which[: e - b],
                        which[e - b :],
                        own.pair_counts[pair],
                        own.triple_counts[triple],
                    )
                    coded = (
                        _steps(own.words[own.context[pair[heads]]]),
                        _steps(own.words[used]),
                        *(x.astype("<u4") for x in numbers_of),
                    )
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": pa.array([shard], pa.int64()),
                            "chunk": pa.array([row["chunk"]], pa.int64()),
                            "sizes": pa.array([[len(c) for c in coded]], pa.list_(pa.int64())),
                            "data": [_pack(*coded)],
                        }
                    )

    def answer(batches):
        for group in sorted_groups(batches, ["shard"]):
            yield from _answers(group, hot, how)

    requests = chunks.select("chunk", "sizes", "held", "words", "control", "data").mapInArrow(
        ask,
        "shard long, chunk long, sizes array<long>, data binary",
    )
    return _dealt(requests).mapInArrow(
        answer, "chunk long, shard long, sizes array<long>, data binary"
    )


def _answers(group: pa.Table, hot: dict[int, int], how: LanguageModel):
    """Builds one shard's trie from all requests, then answers each."""
    asked, lists = [], []
    for sizes, data in zip(group["sizes"].to_pylist(), group["data"].to_pylist()):
        context, word, *rest = _unpack(data, sizes, "u8 u8 u4 u4 u4 u4 u4 u4")
        lists.append((np.cumsum(context), np.cumsum(word)))
        asked.append(rest)
    contexts, words = (np.unique(np.concatenate(x)) for x in zip(*lists))
    width = len(words)
    for i, (context, word) in enumerate(lists):
        runs, later, second, third, n_pairs, n_triples = asked[i]
        heads, place = np.searchsorted(contexts, context), np.searchsorted(words, word)
        heads, place = heads.astype(np.uint32), place.astype(np.uint32)
        asked[i] = (heads, np.repeat(heads, runs), place[second], later, place[third], n_pairs, n_triples)
    del lists
    pairs, pair_of = _different([(a[1], a[2]) for a in asked], width)
    total = np.zeros(len(pairs), np.int64)
    for of, a in zip(pair_of, asked):
        total[of] += a[5]
    triples, triple_of = _different([(np.repeat(of, a[3]), a[4]) for of, a in zip(pair_of, asked)], width)
    counts = np.zeros(len(triples), np.int64)
    for of, a in zip(triple_of, asked):
        counts[of] += a[6]
    base = np.bincount(pairs // width, total, len(contexts)).astype(np.int64)
    for word, count in hot.items():
        at = np.searchsorted(contexts, np.uint64(word))
        if at < len(contexts) and contexts[at] == word:
            base[at] = count
    trie = _build(contexts, base, words, pairs, total, triples, counts, how).mapped()
    del base, total, counts

    root, word = numbers(contexts, trie.roots), numbers(words, trie.words)
    weights = _at(trie.root_weights, root, 0)
    place = _places(trie.pairs, pairs, root, word)
    codes = [_at(trie.pair_codes, place, ABSENT), _at(trie.pair_weights, place, 0)]
    triple_codes = _at(trie.triple_codes, _places(trie.triples, triples, place, word), ABSENT)
    del pairs, triples, place
    for chunk, shard, a, of, last in zip(
        group["chunk"].to_pylist(), group["shard"].to_pylist(), asked, pair_of, triple_of
    ):
        own = weights[a[0]], codes[0][of], codes[1][of], triple_codes[last]
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([chunk], pa.int64()),
                "shard": pa.array([shard], pa.int64()),
                "sizes": pa.array([[len(x) for x in own]], pa.list_(pa.int64())),
                "data": [_pack(*own)],
            }
        )


def _different(asked: list[tuple], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different (context, word) numbers of all lists as single numbers, and each list's places."""
    ends = np.cumsum([len(word) for _, word in asked])
    keys = np.empty(ends[-1], np.int64)
    for (context, word), end in zip(asked, ends):
        keys[end - len(word) : end] = context
        keys[end - len(word) : end] *= width
        keys[end - len(word) : end] += word
    found, place = np.unique(keys, return_inverse=True)
    return found, np.split(place.astype(np.uint32), ends[:-1])


def _build(contexts, base, words, pairs, total, triples, counts, how: LanguageModel) -> Trie:
    """The trie of what has training counts; keys are (number, word number) in one number."""
    width = len(words)
    roots, learned = np.flatnonzero(base), np.flatnonzero(total)
    pairs, total = pairs[learned], total[learned]
    third = np.flatnonzero(counts)
    triples, counts = triples[third], counts[third]
    used = np.unique(np.append(pairs % width, triples % width))
    owner = np.searchsorted(learned, triples // width)
    root = np.searchsorted(roots, pairs // width)
    return Trie.build(
        contexts[roots],
        words[used],
        (root, np.searchsorted(used, pairs % width)),
        (owner, np.searchsorted(used, triples % width)),
        (
            _code(how.mu / (base[roots] + how.mu)),
            _code(total / (base[roots][root] + how.mu)),
            _code(how.nu / (total + how.nu)),
            _code(counts / (total[owner] + how.nu)),
        ),
    )


def _places(level, keys: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of ascending keys, -1 where the context, the word or the entry is unknown.

    `contexts` and `words` give the trie's numbers for those in the keys. Keys are looked up
    some at a time, to bound what is held.
    """
    out = np.full(len(keys), -1, np.int64)
    for begin in range(0, len(keys), _LOOKUP):
        own = keys[begin : begin + _LOOKUP]
        context, word = contexts[own // len(words)], words[own % len(words)]
        known = np.flatnonzero((context >= 0) & (word >= 0))
        out[begin + known] = level.places(context[known], word[known])
    return out


def _at(codes: np.ndarray, place: np.ndarray, absent: int) -> np.ndarray:
    out = np.full(len(place), absent, np.uint8)
    out[place >= 0] = codes[place[place >= 0]]
    return out


def _code(share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-25 * np.log10(share)), 0, 254).astype(np.uint8)


def _back(order: np.ndarray, values: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Values that came in some order of n-grams, for the n-gram of each token."""
    out = np.empty(int(order.max()) + 1 if len(order) else 0, values.dtype)
    out[order] = values
    return out[which]


def score_documents(docs: DataFrame, how: LanguageModel = LanguageModel()) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts are their end token alone. Rows that repeat count each for itself,
    in training too; a null doc_id has the remainder of an empty text, which is for
    training. Other columns are not looked at. An empty table gives an empty result.
    """
    chunks = keep(_chunks(docs, how), "chunks")
    learned = "aggregate(zip_with(sizes, held, (s, h) -> CASE WHEN h THEN 0L ELSE s END), 0L, (a, b) -> a + b)"
    sums = chunks.select(
        F.expr("aggregate(sizes, 0L, (a, b) -> a + b)").alias("n"),
        F.expr(learned).alias("learned"),
        F.expr("size(filter(held, h -> NOT h))").alias("texts"),
    ).agg(F.sum("n"), F.sum("learned"), F.sum("texts")).first()
    tokens, train_tokens, train_texts = (int(x or 0) for x in sums)
    shards = max(1, -(-tokens // how.shard_tokens))
    hot_size = max(1, train_tokens // shards)
    counts = keep(_word_counts(chunks, shards, hot_size), "words", release=True)
    # At most as many hot words as shards: each has a shard's share of all training tokens.
    extra = counts.where("chunk IS NULL").select("totals", "hot_words", "different")
    different, hot = 0, {}
    if train_texts >= hot_size:
        hot[int(_BEGIN)] = train_texts
    for row in extra.toLocalIterator():
        different += row["different"]
        words = np.frombuffer(row["hot_words"], np.uint64).tolist()
        hot.update(zip(words, np.frombuffer(row["totals"], "<i8").tolist()))
    codes = keep(_ngram_codes(chunks, shards, hot, hot_size, how), "codes", release=True)
    scale = train_tokens + 0.5 * (different + 1)

    def work(batches):
        decoded = np.append(10.0 ** (-np.arange(255) / 25), 0.0)
        for batch in batches:
            for row in _rows(batch):
                own = Ngrams(row, shards, hot, hot_size)
                known = np.frombuffer(b"".join(x["totals"] for x in row["known"]), "<i8")
                coded = [_unpack(x["data"], x["sizes"], "u1 u1 u1 u1") for x in row["coded"]]
                weights, pairs, pair_weights, triples = map(np.concatenate, zip(*coded))
                # One weight came for each context of each shard, one code for each pair.
                context = own.context[own.pair]
                fresh = np.diff(context, prepend=-1) != 0
                fresh |= np.diff(own.shard, prepend=-1) != 0
                base = ((known + 0.5) / scale)[own.tokens]
                chance = decoded[_back(own.pair, weights[np.cumsum(fresh) - 1], own.pair_of)]
                chance *= base
                chance += decoded[_back(own.pair, pairs, own.pair_of)]
                third = np.flatnonzero(own.later)
                before = decoded[_back(own.pair, pair_weights, own.pair_of[third - 1])]
                before *= chance[third]
                before += decoded[_back(own.triple, triples, own.triple_of)]
                chance[third] = before
                score = np.log10(chance)
                starts = np.cumsum(own.sizes) - own.sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(own.sizes, pa.int64()),
                        pa.array(np.add.reduceat((known > 0)[own.tokens].astype(np.int64), starts)),
                        pa.array(np.full(len(starts), train_tokens), pa.int64()),
                        pa.array(np.add.reduceat(np.log10(base), starts)),
                        pa.array(np.add.reduceat(score, starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    known = counts.where("chunk IS NOT NULL").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("known")
    )
    coded = codes.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("shard", "sizes", "data"))).alias("coded")
    )
    joined = chunks.join(known, "chunk").join(coded, "chunk")
    return joined.select("doc_ids", "held", "sizes", "words", "control", "data", "known", "coded").mapInArrow(
        work,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )
