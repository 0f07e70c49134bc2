"""Language identification by interpolated Kneser-Ney character models.

One model a language over lower-cased words (a run of letters between two boundary signs), orders 1
to 5: raw counts at the highest order, continuation counts below, one absolute discount an order,
interpolated down to a uniform floor. N-grams are 64-bit hashes in one sorted array an order; each has a
list of the languages that know it, with log probability and log back-off weight, so one search serves all
languages and the arrays grow with the n-grams, not with their product with the languages. The language
with the lowest cross-entropy a character wins.

Rejection: a text is rejected when its best cross-entropy exceeds what that language's calibration
documents (a quarter of the training sample, not counted) show: mean + `z` * sqrt(between + within / signs), where
`mean` is the documents' median, `within` the variance of a sign and `between` that of documents' cross-entropies
beyond what their lengths explain, from a quantile. Short texts thus need stronger evidence.

Training takes at most `per_lang` documents a language (one from each of that many hash buckets), so
its cost doesn't grow with the table; everything else reads all rows and whole texts.

Defined results: a null text or one without a letter is `und`, score 0, rejected; without any
labelled row every text is `und`; repeated rows and ties (the alphabetically first language) give
equal results; extra columns are kept, except that a column with the name of a new one is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table, texts_of, without

ORDER = 5
BEGIN, END = 1, 2
FLOOR = 1.0 / 4096
WORDS = re.compile(r"[^\W\d_]+")
MAX_LANGUAGES = 1000
CACHE_WORDS = 300_000
#: Nats a sign: documents of one language differ by at least so much, however alike the calibration documents are (lines in another language, names, lists).
LEAST_SPREAD = 0.16
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, each with its boundary signs; and where a sign is to be predicted."""
    text = "".join("\x01" * (ORDER - 1) + w + "\x02" for w in words)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return a, np.flatnonzero(a != BEGIN)


def _grams(a: np.ndarray) -> list[np.ndarray]:
    """For n = 1 .. ORDER the hash of the n signs that end at each place (wrapped at the start, where nothing is predicted)."""
    out = []
    g = np.zeros(len(a), np.uint64)
    for n in range(1, ORDER + 1):
        g = (g * K1) ^ ((a + np.uint64(n << 40)) * K2)
        g ^= g >> K3
        g *= K1
        out.append(g)
        g = np.roll(g, 1)
    return out


@dataclass
class Model:
    """Of one language: for each order the sorted hashes, log probabilities (NaN: only a context), log back-off weights; floor for unseen signs."""

    keys: list[np.ndarray]
    logp: list[np.ndarray]
    gamma: list[np.ndarray]
    unseen: float


def train(words: dict[str, int]) -> Model:
    """Interpolated Kneser-Ney from word counts."""
    names = list(words)
    a, at = _flat(names)
    weight = np.repeat(np.fromiter(words.values(), np.float64), [len(w) + 1 for w in names])
    g = _grams(a)
    keys, logp, gamma, below = [], [], [], None
    unseen = 0.0
    for n in range(1, ORDER + 1):
        own = g[n - 1][at]
        if n == ORDER:
            uniq, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            count = np.bincount(inverse, weight)
        else:  # in how many different signs' company it follows
            _, longer = np.unique(g[n][at], return_index=True)
            uniq, first, inverse = np.unique(own, return_index=True, return_inverse=True)
            count = np.bincount(inverse[longer], minlength=len(uniq)).astype(np.float64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = g[n - 2][at - 1][first] if n > 1 else np.zeros(len(uniq), np.uint64)
        ctx, where = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(where, count), np.bincount(where)
        back = discount * kinds / total
        if n == 1:
            p = np.maximum(count - discount, 0) / total[where] + back[where] * FLOOR
            unseen = float(np.log(back[0] * FLOOR))
        else:
            low = below[np.searchsorted(keys[-1], g[n - 2][at][first])]
            p = np.maximum(count - discount, 0) / total[where] + back[where] * low
            known = np.union1d(keys[-1], ctx)  # contexts of boundary signs are predicted nowhere
            wide = np.full(len(known), np.nan)
            wide[np.searchsorted(known, keys[-1])] = logp[-1]
            slot = np.zeros(len(known))
            slot[np.searchsorted(known, ctx)] = np.log(back)
            keys[-1], logp[-1], gamma[-1] = known, wide, slot
        below = p
        keys.append(uniq)
        logp.append(np.log(p))
        gamma.append(np.zeros(len(uniq)))
    return Model(keys, logp, gamma, unseen)


@dataclass
class LanguageModels:
    """All languages' models in common sorted arrays, and the rejection limits."""

    langs: list[str]
    keys: list[np.ndarray]
    first: list[np.ndarray]  # of key i the entries first[i] to first[i + 1]
    lang: list[np.ndarray]
    logp: list[np.ndarray]
    gamma: list[np.ndarray]
    unseen: np.ndarray
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    z: float = 9.0

    @classmethod
    def combine(cls, langs: list[str], models: list[Model]) -> LanguageModels:
        keys, first, lang, logp, gamma = [], [], [], [], []
        for n in range(ORDER if models else 0):
            every = np.concatenate([m.keys[n] for m in models])
            of = np.repeat(np.arange(len(models), dtype=np.int16), [len(m.keys[n]) for m in models])
            by = np.argsort(every, kind="stable")
            uniq, at = np.unique(every[by], return_index=True)
            keys.append(uniq)
            first.append(np.append(at, len(by)).astype(np.int32))
            lang.append(of[by])
            logp.append(np.concatenate([m.logp[n] for m in models])[by].astype(np.float32))
            gamma.append(np.concatenate([m.gamma[n] for m in models])[by].astype(np.float32))
        n = len(models)
        return cls(langs, keys, first, lang, logp, gamma, np.array([m.unseen for m in models], np.float32), np.zeros(n), np.zeros(n), np.ones(n))

    def _entries(self, n: int, slot: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places whose n-gram is known: where each of its entries goes in a table of places by languages, and the entries."""
        at = np.flatnonzero(hit)
        low = self.first[n][slot[at]].astype(np.int64)
        many = self.first[n][slot[at] + 1] - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum())) if len(at) else low
        return np.repeat(at * len(self.langs), many) + self.lang[n][entry], entry

    def signs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each predicted sign under each language, and each word's number of signs."""
        a, at = _flat(words)
        g = _grams(a)
        shape = len(at), len(self.langs)
        out, before = np.broadcast_to(self.unseen, shape).copy(), None
        for n in range(ORDER):
            slot = np.minimum(np.searchsorted(self.keys[n], g[n]), len(self.keys[n]) - 1)
            hit = self.keys[n][slot] == g[n]
            if n:  # what the shorter n-gram gives, times the weight of its context
                to, entry = self._entries(n - 1, before[0][at - 1], before[1][at - 1])
                out.ravel()[to] += self.gamma[n - 1][entry]
            to, entry = self._entries(n, slot[at], hit[at])
            p = self.logp[n][entry]
            some = ~np.isnan(p)
            out.ravel()[to[some]] = p[some]
            before = slot, hit
        return out, np.fromiter((len(w) + 1 for w in words), np.int64)

    def limit(self, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest cross-entropy that n signs of a language may have."""
        return self.mean[lang] + self.z * np.sqrt(self.between[lang] + self.within[lang] / np.maximum(n, 1))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Rows of log probability by language, then the number of signs."""
        p, sizes = self.signs(words)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.concatenate([np.add.reduceat(p, starts, axis=0), sizes[:, None]], axis=1).astype(np.float32)


class Identifier:
    """Scores texts; keeps the rows of space-separated words it has met."""

    def __init__(self, models: LanguageModels):
        self.m = models
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(models.langs) + 1), np.float32)

    def learn(self, new: list[str]) -> None:
        found = [[w for w in WORDS.findall(x) if any(map(str.isalpha, w))] for x in new]
        words = list({w for f in found for w in f})
        number = {w: i for i, w in enumerate(words)}
        scores = np.zeros((len(words) + 1, len(self.m.langs) + 1), np.float32)
        at = 0
        while at < len(words):  # by signs, so that one very long word is no reason for large arrays beside it
            end, size = at, 0
            while end < len(words) and (end == at or (size + len(words[end]) + ORDER) * len(self.m.langs) < 1_000_000):
                size += len(words[end]) + ORDER
                end += 1
            scores[at:end] = self.m.word_scores(words[at:end])
            at = end
        flat = np.fromiter((number[w] if w else len(words) for f in found for w in (f or ("",))), np.int64)
        sizes = np.fromiter((max(1, len(f)) for f in found), np.int64)
        rows = np.add.reduceat(scores[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
        first = len(self.at)
        if len(self.rows) < first + len(new):
            grown = np.zeros((max(2 * len(self.rows), first + len(new)), self.rows.shape[1]), np.float32)
            grown[: len(self.rows)] = self.rows
            self.rows = grown
        self.rows[first : first + len(new)] = rows
        self.at.update(zip(new, range(first, first + len(new)), strict=True))

    def totals(self, texts: list[str]) -> np.ndarray:
        """Per text: log probability by language, then the number of signs."""
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
            self.rows = self.rows[:0]
        split = [t.lower().split() for t in texts]
        flat = list(itertools.chain.from_iterable(split))
        ids = list(map(self.at.get, flat))
        if None in ids:
            unknown = [i for i, x in enumerate(ids) if x is None]
            self.learn(list({flat[i] for i in unknown}))
            for i in unknown:
                ids[i] = self.at[flat[i]]
        out = np.zeros((len(texts), len(self.m.langs) + 1))
        ids, end = np.array(ids, np.int64), 0
        for i, words in enumerate(split):
            begin, end = end, end + len(words)
            if words:
                out[i] = self.rows[ids[begin:end]].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str]) -> tuple[list, list, list, list]:
        """Language, score, cross-entropy a sign (None: no letter), rejected."""
        if not self.m.langs:
            n = len(texts)
            return ["und"] * n, [0.0] * n, [None] * n, [True] * n
        t = self.totals(texts)
        n = t[:, -1]
        some = n > 0
        ce = -t[:, :-1] / np.maximum(n, 1)[:, None]
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(best)), best]
        post = 1 / np.exp(np.maximum((low[:, None] - ce) * n[:, None], -700)).sum(axis=1)
        over = low > self.m.limit(best, n)
        return (
            [self.m.langs[b] if s else "und" for b, s in zip(best, some, strict=True)],
            np.where(some, post, 0).clip(0, 1).tolist(),
            [float(c) if s else None for c, s in zip(low, some, strict=True)],
            (over | ~some).tolist(),
        )


def _fit_one(sample: pa.Table) -> pa.Table:
    """One language's model from its sample, as one row; none if the sample has no word."""
    texts = [x or "" for x in sample.column("text").to_pylist()]
    held = np.array(sample.column("calibrate").to_pylist(), bool)
    schema = pa.schema([("lang", pa.string()), ("model", pa.binary())])
    if held.all() or (~held).sum() < 6:
        held[:] = False
    words: dict[str, int] = {}
    for t, h in zip(texts, held, strict=True):
        if not h:
            for w in WORDS.findall(t.lower()):
                if any(map(str.isalpha, w)):
                    words[w] = words.get(w, 0) + 1
    if not words:
        return schema.empty_table()
    model = train(words)
    one = LanguageModels.combine(["x"], [model])
    ces, sizes, sds = [], [], []
    for t, h in zip(texts, held, strict=True):
        if (h or not held.any()) and (w := [w for w in WORDS.findall(t.lower()) if any(map(str.isalpha, w))]):
            p, _ = one.signs(w)
            ces.append(-float(p.mean()))
            sizes.append(len(p))
            sds.append(float(p.var()))
    ce, size = np.array(ces), np.array(sizes, float)
    within = max(float(np.mean(sds)), 0.01)
    # quantiles, so that a few mislabelled or mixed documents don't widen the limit: four fifths of a normal law lie within 1.2816 deviations
    mean = float(np.median(ce))
    spread = float(np.quantile(np.abs(ce - mean), 0.8)) / 1.2816
    between = max(spread**2 - within * float(np.mean(1 / size)), 0.0) + LEAST_SPREAD**2
    buf = io.BytesIO()
    arrays = {f"{kind}{n}": getattr(model, kind)[n] for kind in ("keys", "logp", "gamma") for n in range(ORDER)}
    np.savez(buf, unseen=model.unseen, mean=mean, between=between, within=within, **arrays)
    return pa.table([[sample.column("lang")[0].as_py()], [buf.getvalue()]], schema=schema)


def train_language_models(docs: DataFrame, per_lang: int = 256, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModels:
    """Models from a bounded sample of rows whose lang is known and whose crc32(id as text) mod 5 is not 0.

    At most `per_lang` documents a language (of equal ids, all) are read for it: the one with the
    smallest hash in each of `per_lang` buckets. Only the finished models come to the driver.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), h.alias("h"), (F.crc32(F.col(id_col).cast("string")) % 5).alias("fold"))
    rows = rows.where("lang is not null and fold <> 0").drop("fold")
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(per_lang)).alias("bucket")).agg(F.min("h").alias("h"))
    if len(chosen.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # at most MAX_LANGUAGES * per_lang short rows
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "text", (F.col("bucket") % 4 == 0).alias("calibrate"))
    found = sample.groupBy("lang").applyInArrow(_fit_one, "lang string, model binary").orderBy("lang").collect()
    langs, models, limits = [], [], []
    for row in found:
        z = np.load(io.BytesIO(row.model))
        models.append(Model(*([z[f"{kind}{n}"] for n in range(ORDER)] for kind in ("keys", "logp", "gamma")), float(z["unseen"])))
        langs.append(row.lang)
        limits.append([float(z[k]) for k in ("mean", "between", "within")])
    out = LanguageModels.combine(langs, models)
    out.mean, out.between, out.within = np.array(limits).reshape(-1, 3).T
    return out


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of docs (one with a new one's name is replaced) and {prefix}lang_pred, {prefix}score, {prefix}cross_entropy, {prefix}rejected."""
    names = [f"{prefix}{x}" for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    docs = without(docs, names)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())

    def factory():
        own = Identifier(shared.value)

        def run(batch):
            for name, kind, values in zip(names, kinds, own.predict(texts_of(batch, text_col)), strict=True):
                batch = batch.append_column(name, pa.array(values, kind))
            return batch

        return run

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return map_batches(docs, docs.columns, factory, schema, rows=512)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = train_language_models(docs)
    rows = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    return identify(rows, models).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
