"""Quality rules: repetition statistics, and perplexity bands under an n-gram model of each language.

A text is told as a row of words: the model over pairs of words (``wordpairs``) says what each word costs after the one
before it; words that have no name there, and white space, are spelled by a model over bytes.

The byte model is a modified Kneser-Ney model over bytes, ``order`` long. Spark counts the n-grams of
every text: a task folds its own counts per language first, so what is shuffled is distinct n-grams
per task. Below the top order, counts are continuation counts; each order has three discounts from its
counts of counts; the last back-off is uniform over 256 bytes. Contexts at the start of a text are newlines.
Probabilities are kept as sorted arrays of n-gram keys with their values.

A language can have at most ``256 ** order`` n-grams, 16.8 million for the default of 3, whatever the corpus;
that bounds the byte model that every task reads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .langid import GRAMS, _count, windows
from .textbytes import Texts, Words, blocks, count_in, mix, small_batches, span_hashes, sums_by
from .wordpairs import ID_BITS, pair_keys, train_pairs, words_of

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: How many times further out than the quartiles of a normal curve its 95th percentile lies.
TAIL = 2.4387

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeats(keys: np.ndarray) -> np.ndarray:
    """True where a key stands twice or more."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def text_statistics(texts: Texts, window: int = 5) -> list[np.ndarray]:
    """The columns of ``STATS`` for each text of the block."""
    data = texts.data
    words = Words(texts)
    n_words = words.counts
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    chars = count_in(heads, texts) - count_in(np.flatnonzero(spaces), texts)
    symbols = count_in(np.flatnonzero(_SYMBOL[data]), texts)

    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    filled = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begins)
    begins, ends = begins[filled], ends[filled]
    owner = np.searchsorted(texts.starts, begins, "right") - 1
    keys = mix(span_hashes(data, begins, ends) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, first = np.unique(keys, return_index=True)
    dup = np.bincount(owner, minlength=texts.n) - np.bincount(owner[first], minlength=texts.n)

    h = span_hashes(data, words.start, words.end)
    repeat = np.zeros(texts.n, np.int64)
    if len(h) >= window:
        who = np.repeat(np.arange(texts.n), n_words)
        inside = np.flatnonzero(who[: len(h) - window + 1] == who[window - 1 :])
        odd = [np.uint64((0xE7037ED1A0B428DB * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(window)]
        key = sum((h[inside + i] * odd[i] for i in range(window)), np.uint64(0))
        key = mix(key + who[inside].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        twice = inside[_repeats(key)]
        cover = np.zeros(len(h) + 1, np.int64)
        cover[twice] += 1
        cover[twice + window] -= 1
        repeat = sums_by((np.cumsum(cover[:-1]) > 0).astype(np.int64), words.bounds)
    return [n_words, chars, symbols, dup, repeat]


@dataclass
class _Order:
    """One order of a language's model: known n-grams with their log2 probability, and the contexts' back-off."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


class KneserNey:
    """Modified Kneser-Ney of one language from its ``order`` byte n-grams and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        levels = [(grams, counts)]
        for k in range(order - 1, 0, -1):  # continuation counts: distinct bytes before
            low = np.unique(levels[0][0]) & np.uint64((1 << (8 * k)) - 1)
            keys, n = np.unique(low, return_counts=True)
            levels.insert(0, (keys, n.astype(float)))
        self.levels: list[_Order] = []
        for keys, c in levels:
            ones, two, three, four = (np.count_nonzero(c == i) for i in (1, 2, 3, 4))
            y = ones / (ones + 2 * two) if ones + two else 0.0
            drop = np.array([0.0] + [max(0.0, min(i, i - (i + 1) * y * b / a)) if a else 0.0 for i, a, b in ((1, ones, two), (2, two, three), (3, three, four))])
            off = drop[np.minimum(c, 3).astype(int)]
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(owner, c, len(contexts))
            gamma = np.bincount(owner, off, len(contexts)) / total
            lower = self._probability(len(self.levels), keys)
            p = (c - off) / total[owner] + gamma[owner] * lower
            self.levels.append(_Order(keys, np.log2(p), contexts, gamma))

    def _probability(self, k: int, grams: np.ndarray) -> np.ndarray:
        """Under the ``k`` lowest orders."""
        if k == 0:
            return np.full(len(grams), 1 / 256)
        keys = grams & np.uint64((1 << (8 * k)) - 1)
        level = self.levels[k - 1]
        at = np.minimum(np.searchsorted(level.grams, keys), len(level.grams) - 1)
        known = level.grams[at] == keys
        p = np.exp2(level.logp[at])
        rest = np.flatnonzero(~known)
        if len(rest):
            context = keys[rest] >> np.uint64(8)
            c = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            weight = np.where(level.contexts[c] == context, level.backoff[c], 1.0)
            p[rest] = weight * self._probability(k - 1, keys[rest])
        return p

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """``-log2`` of the probability of the last byte of each window."""
        level = self.levels[-1]
        at = np.minimum(np.searchsorted(level.grams, grams), len(level.grams) - 1)
        out = -level.logp[at]
        rest = np.flatnonzero(level.grams[at] != grams)
        if len(rest):
            p = self._probability(self.order, grams[rest].astype(np.uint64))
            out[rest] = -np.log2(np.maximum(p, 1e-300))
        return out


def count_ngrams(rows: DataFrame, order: int) -> DataFrame:
    """``(lang, gram, n)``: byte n-grams of all texts ``(text, lang)``."""
    return rows.select("text", "lang").mapInArrow(_count(order - 1), GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, order: int = 3) -> dict[str | None, KneserNey]:
    """A model for each value of ``lang`` (null included) from every text of ``rows``."""
    got = count_ngrams(rows.filter(F.length("text") > 0), order).toArrow()
    langs = np.array(got["lang"].to_pylist(), object)
    gram = got["gram"].to_numpy().view(np.uint64)
    n = got["n"].to_numpy().astype(float)
    out = {}
    for lang in set(langs):
        mine = langs == lang
        by = np.argsort(gram[mine])
        out[lang] = KneserNey(gram[mine][by], n[mine][by], order)
    return out


def _score(models, order: int, window: int):
    def run(batches):
        spelling, naming = models.value
        for batch in blocks(batches, "text"):
            h, who, langs, texts, words = words_of(batch)
            stats = text_statistics(texts, window)
            w, first, length = windows(batch.column("text"), order - 1)
            owner = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + first[owner]
            cost = np.zeros(len(texts.data) + 1)  # of each byte, spelled; the newlines between texts cost nothing
            named = np.zeros(len(h))
            spelled = np.zeros(len(h), bool)
            for lang in set(langs):
                mine = np.flatnonzero((langs == lang)[owner])
                if len(mine):
                    cost[mine + owner[mine] + 1] = spelling[lang].bits(w[at[mine]].astype(np.uint64))
                mine = np.flatnonzero((langs == lang)[who])
                if len(mine):
                    keys = pair_keys(naming[lang].known, h[mine], who[mine])
                    named[mine] = naming[lang].bits(keys)
                    spelled[mine] = keys & np.uint64((1 << ID_BITS) - 1) == 0
            sums = np.bincount(owner, cost[np.arange(len(owner)) + owner + 1], len(length))
            upto = np.cumsum(cost)
            named -= np.where(spelled, 0.0, upto[words.end] - upto[words.start])
            sums += np.bincount(who, named, len(length))
            bits = np.full(len(langs), np.nan)
            np.divide(sums, length, out=bits, where=length > 0)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(s.astype(np.int64)) for s in stats), pa.array(bits, pa.float64(), mask=np.isnan(bits)), pa.array(length.astype(np.int64))],
                [*keep, *(x.split()[0] for x in STATS.split(", ")), "bits", "n_bytes"],
            )

    return run


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = 3,
    window: int = 5,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    spread: float = 4.0,
    slack: float = 10.0,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, the columns of ``STATS``, ``base_failed``, ``perplexity``,
    ``lower``, ``upper``, ``kept``.

    Words are runs of other than ``[\\x20\\x09-\\x0D]``. ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat_percent`` of 100 words lie in ``window``-word runs found twice or more. ``perplexity`` is 2 to
    the mean bits per byte under the models of the row's language, over pairs of words and over bytes, learned from all texts of that language.
    A language's band in bits is its median plus and minus ``spread`` times ``TAIL`` times the median distance from the median,
    over the distinct texts that pass the base rules; no percentile near an end is used, as it would lie in the junk that
    is to be found, so less than half of a language may be junk. For a text of n bytes the band is wider by
    ``slack / sqrt(n)``, as means over few bytes scatter. A row outside its band is not kept.

    Null and empty texts have zeros, no perplexity, and fail the base rules. Null languages are a language of
    their own. A language none of whose rows passes has no band and rejects nothing more. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast((train(rows, order), train_pairs(rows)))
    kind = rows.schema["__id"].dataType.simpleString()
    scored = rows.mapInArrow(_score(shared, order, window), f"__id {kind}, lang string, {STATS}, bits double, n_bytes long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    with small_batches(docs.sparkSession):
        scored = cut(scored.withColumn("base_failed", failed))
    passed = cut(scored.filter(~F.col("base_failed")).select(F.col("lang").alias("__lang"), "bits", "n_bytes").distinct())
    middle = F.percentile_approx("bits", 0.5, 10_000)
    centres = cut(passed.groupBy(F.col("__lang").alias("__of")).agg(middle.alias("mid")))
    off = passed.join(centres, F.col("__lang").eqNullSafe(F.col("__of"))).withColumn("bits", F.abs(F.col("bits") - F.col("mid")))
    bands = off.groupBy("__lang", "mid").agg((spread * TAIL * middle).alias("reach"))
    bands = bands.select("__lang", (F.col("mid") - F.col("reach")).alias("lo"), (F.col("mid") + F.col("reach")).alias("hi"))
    out = scored.join(bands, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    wider = slack / F.sqrt(F.greatest(F.col("n_bytes"), F.lit(1)))
    out = out.withColumn("lo", F.col("lo") - wider).withColumn("hi", F.col("hi") + wider)
    inside = F.coalesce(F.col("bits").between(F.col("lo"), F.col("hi")), F.lit(True))
    return out.select(
        F.col("__id").alias(id_col),
        *(x.split()[0] for x in STATS.split(", ")),
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        F.pow(2.0, "bits").alias("perplexity"),
        F.pow(2.0, "lo").alias("lower"),
        F.pow(2.0, "hi").alias("upper"),
    )
