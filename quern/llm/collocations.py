"""Phrase collocations: suffix automata of shards, counts of phrases reduced over all of them, the best of each language.

A text is cut into pieces at `. , ; : ! ?` and line ends, a piece into words at blanks. A phrase that occurs `least` times is made
of words, pairs and triples that do, so one pass counts the hashes of all of these, and the next feeds the automata only
with runs all of whose pairs and triples are frequent. Each shard (a bounded number of words) has a generalised suffix automaton whose endpos counts
give the occurrences of every substring; those of at most LONGEST words are listed state by state: a state's
phrases are as long as its suffix link's longest plus one, up to its own. Counts are summed over all shards by phrase.
The same links tell what a longer phrase subsumes: itself less its first word (or less its last).

Defined cases: a null text is empty; a null lang is `und`; repeated rows count each; an empty table, or one in which
nothing is frequent, gives an empty table; other columns are not read; a very long text is taken in parts of PART
bytes, cut between pieces (a single piece is never cut); a long run goes in overlapping blocks whose overlap is
taken off again; the bit table of hashes has false hits, which cost runs and no result. Ties stand in the order of the phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrow import slices, small_batches
from quern.runtime import hot_keys, replicate_join, stage

#: Words of a phrase at most; words of a shard's automaton; words of a block of a long run; bytes taken up at a time.
LONGEST, SHARD, BLOCK, PART = 5, 250_000, 32_768, 2 << 20
#: Distinct words that a shard's task remembers from one automaton to the next.
NAMES = 400_000
#: Bits of the table of frequent words, pairs and triples: for each, and at most (128 MB); bits of a hash.
BITS_A_GRAM, TABLE_BITS, HASH_BITS = 32, 30, 48
#: Rows of a language that are ranked in one task, beside the best of as many such parts as MERGE.
RANKED, MERGE = 20_000, 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_APART = _BREAK.copy()
_APART[[32, 9]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts in order: lists of distinct (lang, word), and of each occurrence its place there and its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        rows = (offsets - offsets[0])[:-1]
        first = rows[rows < len(data)]
        word = ~_APART[data]
        before, after = np.concatenate([[False], word[:-1]])[: len(data)], np.concatenate([word[1:], [False]])[: len(data)]
        before[first] = False
        after[first[first > 0] - 1] = False
        begins, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        pieces = _BREAK[data].astype(np.int32)
        pieces[first] += 1  # rows part pieces too
        self.piece = np.cumsum(pieces, dtype=np.int32)[begins]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)), pa.py_buffer(data[word])]).dictionary_encode()
        spoken = langs.fill_null("und").dictionary_encode()
        lang = np.repeat(spoken.indices.to_numpy(zero_copy_only=False), np.diff(np.searchsorted(begins, np.append(rows, len(data)))))
        n = max(1, len(spoken.dictionary))
        both, self.ids = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + lang, return_inverse=True)
        self.texts = coded.dictionary.cast(pa.binary()).take(pa.array(both // n))
        self.langs = spoken.dictionary.take(pa.array(both % n))

    def follows(self, n: int) -> np.ndarray:
        """Whether the words at each place and the n - 1 after it lie in one piece."""
        return self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1] if len(self.piece) >= n else np.zeros(0, bool)

    def hashes(self) -> np.ndarray:
        """A hash of each distinct (lang, word)."""
        if not len(self.texts):
            return np.zeros(0, np.uint64)
        spoken = self.langs.dictionary_encode()
        by_lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in spoken.dictionary.to_pylist()], np.uint64)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.texts.to_pylist()), np.uint64, len(self.texts))
        return _mix(own + by_lang[spoken.indices.to_numpy(zero_copy_only=False)] * np.uint64(3))

    def grams(self, most: int = 3) -> list[np.ndarray]:
        """Hashes of HASH_BITS bits: of the distinct words, and for n from 2 of the n words from each place on (whether or not in one piece)."""
        h = self.hashes()
        each = [h]
        last = h[self.ids]
        for n in range(2, most + 1):
            last = _mix(last[: max(0, len(self.ids) - n + 1)] * np.uint64(5) + h[self.ids[n - 1 :]]) if len(h) else last
            each.append(last)
        return [(x >> np.uint64(64 - HASH_BITS)).astype(np.int64) for x in each]


def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(langs, texts) of at most PART bytes; a longer text is cut at the first break after each PART bytes."""
    for part in slices(batch, 1, PART):
        langs, texts = part.column(0), part.column(1)
        text = texts[0].as_py() if len(texts) == 1 else None
        if text is None or len(text) < PART // 4:
            yield langs, texts
            continue
        raw, start = text.encode(), 0
        while start < len(raw):
            end = min(len(raw), start + PART)
            while end < len(raw) and not _BREAK[raw[end]]:
                end += 1
            yield langs, pa.array([raw[start:end].decode()])
            start = end


def frequent_hashes(docs: DataFrame, least: int, lang: str, text: str) -> DataFrame:
    """Staged (gram): hashes of the words, pairs and triples of each lang that occur `least` times, and those that share one with such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, texts in parts(batch):
                w = Words(langs, texts)
                words, *longer = w.grams()
                own = [(words, np.bincount(w.ids, minlength=len(words)))]
                own += [np.unique(x[w.follows(n)], return_counts=True) for n, x in enumerate(longer, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in own])), pa.array(np.concatenate([n for _, n in own]).astype(np.int64))], names=["gram", "n"])

    made = small_batches(docs).select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(run, "gram long, n long")
    return stage(made.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("gram"), "frequent")


def bit_table(hashes: DataFrame, column: str, keys: int) -> np.ndarray:
    """Bits of some hashes: BITS_A_GRAM for each, 2^TABLE_BITS at most."""
    bits = min(TABLE_BITS, max(15, (keys * BITS_A_GRAM - 1).bit_length()))
    place = hashes.select(F.shiftright(column, HASH_BITS - bits).alias("p")).select(F.floor(F.col("p") / 32768).alias("block"), (F.col("p") % 32768).alias("bit"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in place.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        table[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return table


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes >> (HASH_BITS + 1 - (len(table) * 8).bit_length())
    return (table[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


class Automaton:
    """The suffix automaton of several sequences, with weights.

    State 0 is the root. follow: transitions; link: suffix links; length: of a state's longest sequence; ends: a place in
    `words` where that ends; weight: of the sequences' prefixes that end in the state. A state's occurrences
    (its endpos count) are its weight and that of all states whose links lead to it.
    """

    def __init__(self):
        self.follow, self.link, self.length, self.ends, self.weight = [{}], [-1], [0], [-1], [0]
        self.words: list[int] = []

    def _state(self, length: int, link: int, follow: dict, end: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(end)
        self.weight.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's sequences with the word, which so far shares q with longer ones."""
        follow, link = self.follow, self.link
        made = self._state(self.length[p] + 1, link[q], follow[q].copy(), self.ends[q])
        link[q] = made
        while p >= 0 and follow[p].get(word) == q:
            follow[p][word] = made
            p = link[p]
        return made

    def add(self, sequence: list[int], weight: int) -> None:
        """Adds a sequence that occurs `weight` times."""
        follow, link, length, last = self.follow, self.link, self.length, 0
        for place, word in enumerate(sequence, len(self.words)):
            q = follow[last].get(word)
            if q is None:
                p, new = last, self._state(length[last] + 1, 0, {}, place)
                while p >= 0 and word not in follow[p]:
                    follow[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = follow[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
                last = new
            else:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
            self.weight[last] += weight
        self.words += sequence

    def phrases(self, longest: int, shortest: int = 2) -> Iterator[tuple[int, int, int]]:
        """(end, length, occurrences) of every distinct substring of so many words."""
        count, link, length = list(self.weight), self.link, self.length
        for v in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            count[link[v]] += count[v]
            for n in range(max(shortest, length[link[v]] + 1), min(longest, length[v]) + 1):
                yield self.ends[v], n, count[v]


def blocks(run: list[int], weight: int, block: int, longest: int) -> Iterator[tuple[list[int], int]]:
    """A run in blocks that overlap by what a phrase may reach over; what lies in an overlap is taken off once."""
    over = longest - 1
    for start in range(0, max(1, len(run) - over), block):
        yield run[start : start + block + over], weight
        if start:
            yield run[start : start + over], -weight


class Shard:
    """Gathers words' counts and distinct runs; lists the phrases of an automaton of the runs when they have `size` words."""

    def __init__(self, longest: int, size: int):
        self.longest, self.size = longest, size
        self._fresh()

    def _fresh(self) -> None:
        self.numbers, self.names, self.counts, self.spoken = {}, [], np.zeros(1 << 12, np.int64), Counter()
        self.runs, self.held = Counter(), 0

    def number(self, key: tuple[str, bytes]) -> int:
        if (found := self.numbers.get(key)) is None:
            found = self.numbers[key] = len(self.names)
            self.names.append((key[0], key[1].decode()))
        return found

    def add(self, w: Words, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts words that are in the table, and runs of words of which each pair and triple is too.

        A pair lies in one run alone; runs share a word where the triple around it isn't frequent.
        """
        words, pairs, triples = w.grams()
        of_word, told = np.bincount(w.ids, minlength=len(words)), has(table, words)
        spoken = w.langs.dictionary_encode()
        self.spoken.update(dict(zip(spoken.dictionary.to_pylist(), np.bincount(spoken.indices.to_numpy(zero_copy_only=False), of_word, len(spoken.dictionary)).astype(np.int64).tolist())))
        if len(self.names) > NAMES:
            yield from self.flush()
            yield from self.words()
        often = np.flatnonzero(told)
        own = np.zeros(len(words), np.int64)
        own[often] = [self.number(key) for key in zip(w.langs.take(pa.array(often)).to_pylist(), w.texts.take(pa.array(often)).to_pylist())]
        if len(self.counts) < len(self.names):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.names), np.int64)])
        self.counts[own[often]] += of_word[often]
        first = np.flatnonzero(w.follows(2) & has(table, pairs))
        first = first[told[w.ids[first]] & told[w.ids[first + 1]]]
        if not len(first):
            return
        goes_on = np.diff(first) == 1
        goes_on[goes_on] = has(table, triples[first[:-1][goes_on]])
        starts, ends = first[np.concatenate([[True], ~goes_on])], first[np.append(~goes_on, True)] + 2
        numbers, short = own[w.ids], ends - starts == 2
        both, counts = np.unique(numbers[starts[short]] * len(self.names) + numbers[starts[short] + 1], return_counts=True)
        flat, both = numbers.tobytes(), np.stack([both // len(self.names), both % len(self.names)], axis=1).tobytes()
        own_runs = Counter([flat[8 * s : 8 * e] for s, e in zip(starts[~short].tolist(), ends[~short].tolist())])
        own_runs.update({both[16 * i : 16 * i + 16]: n for i, n in enumerate(counts.tolist())})
        for run, n in own_runs.items():
            if run not in self.runs:
                self.held += len(run) // 8
            self.runs[run] += n
            if self.held >= self.size:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The phrases of the runs so far."""
        names, automaton, rows = self.names, Automaton(), []
        for run, n in self.runs.items():
            for part, weight in blocks(np.frombuffer(run, np.int64).tolist(), n, BLOCK, self.longest):
                automaton.add(part, weight)
        for end, length, n in automaton.phrases(self.longest):
            some = automaton.words[end - length + 1 : end + 1]
            rows.append((names[some[0]][0], " ".join([names[x][1] for x in some]), length, n))
            if len(rows) >= 50_000:
                yield self.batch(rows)
                rows = []
        yield self.batch(rows)
        self.runs, self.held = Counter(), 0

    def words(self) -> Iterator[pa.RecordBatch]:
        """Words that were counted, and all words of each lang."""
        rows = [(lang, None, 0, n) for lang, n in self.spoken.items()]
        yield self.batch(rows + [(*key, 1, n) for key, n in zip(self.names, self.counts.tolist())])
        self._fresh()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "k", "n"])


def counted(docs: DataFrame, hashes: DataFrame, least: int, lang: str, text: str, longest: int = LONGEST, size: int = SHARD) -> DataFrame:
    """Staged (lang, phrase, k, a): all phrases of 1 to `longest` words that occur `least` times, and all words of each lang (phrase null, k 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(hashes, "gram", hashes.count()))  # 128 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, table = Shard(longest, size), shared.value
        for batch in batches:
            for langs, texts in parts(batch):
                yield from shard.add(Words(langs, texts), table)
        yield from shard.flush()
        yield from shard.words()

    made = small_batches(docs).select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(run, "lang string, phrase string, k int, n long")
    return stage(made.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("a")).where((F.col("a") >= least) | (F.col("k") == 0)), "phrases")


def scored(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Adds n and, of the cut with the least score, l, r and score to the wanted phrases; of equal scores the earliest cut.

    found: of counted(). A common word stands in very many cuts, so the look-ups deal the rows of such keys out.
    """
    grams = found.where("k > 0").select(F.struct("lang", "phrase").alias("gram"), F.col("a").alias("f"))
    cuts = wanted.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cuts = stage(cuts.select("lang", "phrase", "k", "a", "j", F.struct("lang", F.expr("substring_index(phrase, ' ', j)").alias("phrase")).alias("head"), F.struct("lang", F.expr("substring_index(phrase, ' ', j - k)").alias("phrase")).alias("rest")), "cuts")
    hot = hot_keys(cuts, ["head", "rest"])
    for key, count in (("head", "l"), ("rest", "r")):
        cuts = replicate_join(cuts, grams.select(F.col("gram").alias(key), F.col("f").alias(count)), key, "phrase", hot)
    by_lang = hot_keys(cuts.select("lang"), ["lang"])
    cuts = replicate_join(cuts, found.where("k = 0").select("lang", F.col("a").alias("n")), "lang", "phrase", by_lang)
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "j", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "k", "a", "n", "b.l", "b.r", "b.score")


def unsubsumed(phrases: DataFrame, share: int) -> DataFrame:
    """Phrases of which no longer one that holds them occurs at least `share` hundredths as often.

    One more word is enough to look at: what lies between a phrase and a longer one is a candidate as frequent as the longer.
    """
    shorter = F.array(F.expr("substring_index(phrase, ' ', 1 - k)"), F.expr("substring_index(phrase, ' ', k - 1)"))
    longer = phrases.where("k > 2").select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    kept = F.coalesce(F.lit(100) * F.col("over") < F.lit(share) * F.col("a"), F.lit(True))
    return phrases.join(longer, ["lang", "phrase"], "left").where(kept).drop("over")


def best_of(df: DataFrame, group: str, order: list, spread: str, most: int) -> DataFrame:
    """Adds rank: the first `most` rows of each group; a large group is first ranked in parts, MERGE of which are then ranked together."""
    rows = df.groupBy(group).count().agg(F.max("count")).collect()[0][0] or 0
    deal = -(-rows // RANKED)
    while deal > 1:
        some = Window.partitionBy(group, F.pmod(F.xxhash64(spread), F.lit(deal))).orderBy(*order)
        df = df.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most).drop("rank")
        deal = 0 if deal <= MERGE else -(-deal // MERGE)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 100, share: int = 100, most: int = 2000, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `most` best phrases of 2 to `longest` words.

    a: occurrences; l, r: of the parts of the cut with the least score; n: of all words; score: floor(1000 a n / (l r)).
    """
    found = counted(docs, frequent_hashes(docs, least, lang, text), least, lang, text, longest)
    kept = stage(scored(unsubsumed(found.where("k > 1"), share), found), "scored")
    best = best_of(kept, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "phrase", most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
