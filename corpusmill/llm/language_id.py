"""Language identification by interpolated Kneser-Ney character models, stored in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_back, id_key, materialize

#: Letters that follow one another; ``isalpha`` then drops other numerals.
RUNS = re.compile(r"[^\W\d_]+")
#: Stand before and after every word.
BEGIN, END = "\x02", "\x03"
#: Characters of the longest gram.
ORDER = 5
#: Characters of text that are scored at once, and words a task remembers the scores of.
CHUNK, MOST_KNOWN = 1 << 22, 200_000
_FACTORS = np.random.default_rng(17).integers(0, 2**63, size=ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return RUNS.findall(text.lower())


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` codes that end at each place; the first ``order - 1`` places hold no gram."""
    out = codes * _FACTORS[0]
    for j in range(1, order):
        out[j:] += codes[:-j] * _FACTORS[j]
    return out + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted hashes in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """Models of all languages in common arrays, an entry an order: sorted gram hashes with a row of log probabilities,
    sorted history hashes with a row of log back-off weights; a column a language."""

    languages: list[str]
    grams: list[np.ndarray]
    logs: list[np.ndarray]
    histories: list[np.ndarray]
    weights: list[np.ndarray]
    unknown: np.ndarray  # log probability of a character that no language has shown
    scale: float = 1.0
    power: float = 0.5
    least_score: float = 0.0
    most_entropy: float = float("inf")

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log probabilities of each word and its end, a column a language, and how many characters they are."""
        clean = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
        total, length = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        rows = [i for i, w in enumerate(clean) if w]
        if not rows or not self.languages:
            return total, length
        sizes = np.array([len(clean[i]) + 2 for i in rows])
        codes = codes_of("".join(BEGIN + clean[i] + END for i in rows))
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.arange(len(codes)) - first
        hashes = {k: gram_hashes(codes, k) for k in range(1, ORDER + 1)}
        logs = np.zeros((len(codes), len(self.languages)))
        open_ = np.flatnonzero(place > 0)
        for k in range(ORDER, 0, -1):
            may = open_[place[open_] >= k - 1]
            at = find(self.grams[k - 1], hashes[k][may])
            seen, missing = may[at >= 0], may[at < 0]
            logs[seen] += self.logs[k - 1][at[at >= 0]]
            # no language has this gram: all back off from its history
            before = find(self.histories[k - 1], hashes[k - 1][missing - 1]) if k > 1 else np.zeros(len(missing), np.int64)
            known = missing[before >= 0]
            logs[known] += self.weights[k - 1][before[before >= 0]]
            open_ = np.concatenate([missing, open_[place[open_] < k - 1]])
        logs[open_] += self.unknown
        logs[place == 0] = 0
        total[rows] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0)
        length[rows] = sizes - 1
        return total, length

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character of each text under each language, in nats, and the characters scored."""
        return Scorer(self).entropies(texts)

    def judge(self, entropy: np.ndarray, length: np.ndarray) -> pd.DataFrame:
        """Best language of each text, calibrated score, entropy, and whether it is accepted; ``und`` without letters."""
        n = len(entropy)
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * n, "score": 0.0, "entropy": np.nan, "accepted": False}, index=range(n))
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(n), best]
        away = (entropy - least[:, None]) * self.scale * np.maximum(length, 1)[:, None] ** self.power
        score = np.where(length > 0, 1 / np.exp(-np.minimum(away, 700)).sum(axis=1), 0.0)
        names = np.where(length > 0, np.array(self.languages, object)[best], "und")
        accepted = (length > 0) & (score >= self.least_score) & (least <= self.most_entropy)
        return pd.DataFrame({"lang_pred": names, "score": score, "entropy": np.where(length > 0, least, np.nan), "accepted": accepted})


class Scorer:
    """Scores texts by their distinct words, each scored once while it is remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.total = np.zeros((0, len(model.languages)))
        self.length = np.zeros(0, np.int64)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = [Counter(words_of(t)) for t in texts]
        if len(self.known) > MOST_KNOWN:
            self.known, self.total, self.length = {}, self.total[:0], self.length[:0]
        new = list(dict.fromkeys(w for c in counts for w in c if w not in self.known))
        if new:
            total, length = self.model.score_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.total, self.length = np.concatenate([self.total, total]), np.concatenate([self.length, length])
        out, sizes = np.zeros((len(texts), len(self.model.languages))), np.zeros(len(texts), np.int64)
        for i, c in enumerate(counts):
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            times = np.fromiter(c.values(), np.int64, len(c))
            sizes[i] = times @ self.length[at]
            out[i] = -(times @ self.total[at]) / max(1, sizes[i])
        return out, sizes


def chunked(texts: list[str]) -> Iterator[slice]:
    """Slices of texts of about ``CHUNK`` characters; a longer text is one slice, whole."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of rows ``(lang, text)``, summed in tasks before they move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(pdf["lang"], pdf["text"]):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            made = pd.DataFrame(rows, columns=["lang", "word", "n"])
            kept = made["word"].map(lambda w: w if w.isalpha() else "".join(c for c in w if c.isalpha()))
            yield made.assign(word=kept)[kept != ""]

    return docs.select("lang", "text").mapInPandas(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` for all orders: times for the longest grams and those that begin a word, and for others the
    number of different characters that stand before them (continuation counts)."""
    padded = F.concat(F.lit(BEGIN), "word", F.lit(END))
    ends = F.sequence(F.lit(2), F.length("word") + 2)
    longest = words.select("lang", "n", padded.alias("w"), F.explode(ends).alias("e"))
    begin = F.greatest(F.col("e") - (ORDER - 1), F.lit(1))
    longest = longest.select("lang", F.substring(F.col("w"), begin, F.col("e") - begin + 1).alias("gram"), "n")
    longest = materialize(longest.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "longest-grams")
    tables = [longest.filter(F.length("gram") == ORDER)]
    for k in range(ORDER - 1, 0, -1):
        shorter = tables[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        tables.append(shorter.unionByName(longest.filter(F.length("gram") == k)) if k > 1 else shorter)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def build(grams: pd.DataFrame) -> Model:
    """Interpolated Kneser-Ney models from ``lang, gram, n``.

    An order's discount is ``n1 / (n1 + 2 n2)`` of its language; what it takes from the grams of a history is dealt by
    the next lower order, and by an even share of all characters below the first. Every gram that any language
    shows gets the probability of each language, backed off where that language has not shown it.
    """
    languages = sorted(grams["lang"].unique())
    column = {x: i for i, x in enumerate(languages)}
    n_lang = len(languages)
    sizes = grams["gram"].str.len().to_numpy()
    chars = 1 + grams.loc[sizes == 1, "gram"].nunique()
    lower = np.full((1, n_lang), 1.0 / chars)  # by an even share
    model = Model(languages, [], [], [], [], np.log(lower[0]))
    lower_keys = None
    for k in range(1, ORDER + 1):
        part = grams[sizes == k]
        codes = codes_of("".join(part["gram"])).reshape(-1, k)
        flat = gram_hashes(codes.ravel(), k)[k - 1 :: k] if len(codes) else np.zeros(0, np.uint64)
        keys, row = np.unique(flat, return_inverse=True)
        lang = part["lang"].map(column).to_numpy(int)
        n = part["n"].to_numpy(float)
        # what precedes the last character, and what follows the first
        before = gram_hashes(np.ascontiguousarray(codes[:, :-1]).ravel(), k - 1)[k - 2 :: k - 1] if k > 1 else np.zeros(len(part), np.uint64)
        after = gram_hashes(np.ascontiguousarray(codes[:, 1:]).ravel(), k - 1)[k - 2 :: k - 1] if k > 1 else None
        histories, h_row = np.unique(before, return_inverse=True)
        once, twice = np.bincount(lang[n == 1], minlength=n_lang), np.bincount(lang[n == 2], minlength=n_lang)
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        discount = np.clip(discount, 0.05, 0.95)
        sums, kinds = np.zeros((len(histories), n_lang)), np.zeros((len(histories), n_lang))
        np.add.at(sums, (h_row, lang), n)
        np.add.at(kinds, (h_row, lang), 1)
        weight = np.where(sums > 0, discount * kinds / np.maximum(sums, 1), 1.0)
        first = np.zeros(len(keys), np.int64)
        first[row] = np.arange(len(part))  # any row of the gram: history and lower gram are the same in all
        base = lower[find(lower_keys, after[first])] if k > 1 else np.repeat(lower, len(keys), axis=0)
        p = weight[h_row[first]] * base
        np.add.at(p, (row, lang), np.maximum(n - discount[lang], 0) / sums[h_row, lang])
        model.grams.append(keys)
        model.logs.append(np.log(p).astype(np.float32))
        model.histories.append(histories)
        model.weights.append(np.log(weight).astype(np.float32))
        lower, lower_keys = p, keys
    return model


def calibrate(model: Model, truth: np.ndarray, entropy: np.ndarray, length: np.ndarray, error: float) -> Model:
    """Set the steepness of scores, and what is rejected, by texts that the model has not seen.

    Scores are odds of languages, ``scale * length ** power`` times their difference in entropy, with the likeliest pair
    of a grid; one wrong text is added, so that scores stay below one where all are right. A text is accepted at a score
    above which at most a share of ``error`` of the texts is wrong, and at an entropy that all but that share keep to.
    """
    if not len(truth):
        return model
    best = entropy.argmin(axis=1)
    gaps = entropy - entropy.min(axis=1, keepdims=True)
    own = gaps[np.arange(len(truth)), truth]
    median_gap = np.median(np.sort(gaps, axis=1)[:, 1]) if gaps.shape[1] > 1 else 0.0
    found = []
    for power in (0.0, 0.25, 0.5, 0.75, 1.0):
        reach = length**power
        for scale in 2.0 ** np.arange(-4, 9, 0.5):
            away = gaps * (scale * reach)[:, None]
            lost = (own * scale * reach + np.log(np.exp(-np.minimum(away, 700)).sum(axis=1))).sum()
            found.append((lost + scale * np.median(reach) * median_gap, power, scale))  # as if one typical text were wrong
    _, model.power, model.scale = min(found)
    score = model.judge(entropy, length)["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(best[order] != truth[order]) / np.arange(1, len(order) + 1)
    right = np.flatnonzero(wrong <= error)
    model.least_score = float(score[order][right[-1]]) if len(right) else 1.0
    model.most_entropy = float(np.quantile(entropy.min(axis=1), 1 - error, method="higher"))
    return model


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep``, entropies as an array and the characters scored, for rows with ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in chunked(texts):
                entropy, length = scorer.entropies(texts[part])
                yield pdf.iloc[part][list(keep)].assign(entropies=list(entropy), length=length)

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "entropies array<double>", "length long"]))


def fit(docs: DataFrame, rows_per_language: int = 4000, most_cells: int = 16_000_000, most_languages: int = 1000, error: float = 0.01) -> Model:
    """Models of the languages of labelled rows ``(doc_id, text, lang)``; rows without text or language do not count.

    A bounded sample is learned from: about ``rows_per_language`` whole texts of each language, drawn by a hash of id and
    text; of these a fifth only sets scores and rejection. The chance is halved until grams times languages are
    ``most_cells`` at most, which bounds what the driver builds and sends. More than ``most_languages`` languages are an
    error. No rows give a model without languages, which calls every text ``und``. Repeated rows are drawn alike.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return build(pd.DataFrame({"lang": pd.Series([], dtype=str), "gram": pd.Series([], dtype=str), "n": pd.Series([], dtype=int)}))
    part = 1.0
    at = F.xxhash64("doc_id", "text", F.lit(23))
    u = (F.pmod(at, F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    while True:
        rates = spark.createDataFrame([(r["lang"], min(1.0, part * rows_per_language / r["n"])) for r in sizes], "lang string, rate double")
        drawn = rows.join(F.broadcast(rates), "lang").filter(u < F.col("rate"))
        drawn = materialize(drawn.select("lang", "text", (F.pmod(F.shiftright(at, 32), F.lit(5)) == 0).alias("aside")), "language-sample")
        grams = materialize(gram_counts(word_counts(drawn.filter("not aside"))), "grams")
        if grams.count() * len(sizes) <= most_cells or part < 1e-9:
            break
        part /= 2
    model = build(grams.toPandas())
    if not model.languages:
        return model
    tested = scores(drawn.filter("aside"), model, "lang").filter("length > 0").toPandas()
    tested = tested[tested["lang"].isin(model.languages)]
    truth = tested["lang"].map({x: i for i, x in enumerate(model.languages)}).to_numpy(int)
    entropy = np.stack(tested["entropies"].tolist()) if len(tested) else np.zeros((0, len(model.languages)))
    return calibrate(model, truth, entropy, tested["length"].to_numpy(), error)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, accepted`` for every row, by its whole text alone. No shuffle.

    ``lang_pred`` is the language of the lowest cross-entropy a character (ties: the first in code-point order);
    ``score`` its calibrated chance; ``accepted`` is false where score or entropy miss their bounds. A null, empty or
    letterless text is ``und`` with score 0, null entropy, not accepted. Equal texts get equal results; null ids stay;
    other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in chunked(texts):
                made = shared.value.judge(*scorer.entropies(texts[part]))
                yield made.assign(doc_key=pdf["doc_key"].iloc[part].to_numpy())[["doc_key", "lang_pred", "score", "entropy", "accepted"]]

    rows = documents(docs).select(id_key().alias("doc_key"), "text")
    made = rows.mapInPandas(run, "doc_key long, lang_pred string, score double, entropy double, accepted boolean")
    entropy = F.when(~F.isnan("entropy"), F.col("entropy"))
    return made.select(id_back("doc_key").alias("doc_id"), "lang_pred", "score", entropy.alias("entropy"), "accepted")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the crc32 of its id as text, mod 3, is 1. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(3)) == 1, F.lit(False))
