"""Language ID by sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 4 code points, within words and with their edges marked, are
hashed to BUCKETS features. A feature's value is its per cent of the text's n-grams
times its inverse document frequency. Weights are trained by follow-the-
regularised-leader (proximal, per coordinate) with an elastic net, which leaves
most of them zero; the logits are then divided by a temperature fitted on rows
kept apart.

The fit takes PER_LANGUAGE documents of each of the MAX_LANGUAGES most frequent languages, and at
most SAMPLE in all, by a hash of their ids: those below a bound that about twice
as many of a language reach, of them the first. They are found without reading
texts, and their ids are broadcast; one task fits them, and only the model comes to the driver. Document frequencies are counted over all
learnable rows, added up in each task before they are shuffled. As the values are linear in the words, a
text's logits are the mean of its words' sums; a task keeps those of up to
CACHE words and works each new word out once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table

BUCKETS, LONGEST = 1 << 16, 4
PER_LANGUAGE, MAX_LANGUAGES, SAMPLE = 400, 500, 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.2, 1.0, 0.02, 1e-4
CACHE = 200_000
#: Bytes of a row in which a part of a model goes to the driver.
PART = 1 << 24
_WORD = re.compile(r"[^\W\d_]+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all n-grams of the words, and for each the word it comes from."""
    text = " " + " ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = np.flatnonzero(code == 32)
    word = np.cumsum(code == 32) - 1  # the word after or under each place
    index, owner = [], []
    h = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            m = len(code) - n + 1
            if m <= 0:
                break
            h = (h[:m] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            at = np.arange(m)
            last = at + n - 1
            # within " word ": starts at its left edge or inside, ends inside or at its right edge
            ok = last <= edge[np.minimum(word[at] + 1, len(edge) - 1)]
            ok &= word[at] < len(words)
            if n == 1:
                ok &= code != 32
            index.append(((h[at[ok]] ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
            owner.append(word[at[ok]])
    return np.concatenate(index), np.concatenate(owner)


def letters(text: str | None) -> list[str]:
    """The words of a text that are made of letters; none if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    return _WORD.findall(text.lower())


class Model:
    """weights: a row for each bucket, with the document frequency worked in; bias and temperature; seen: buckets that came in training.

    As n-grams share buckets, one that never came counts as seen by chance; known() takes that off.
    """

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, seen: np.ndarray):
        self.languages, self.weights, self.bias, self.temperature, self.seen = languages, weights, bias, temperature, seen

    def sums(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its n-grams' weights, how many of them came in training, and their number."""
        out = np.zeros((len(words), len(self.languages) + 2))
        index, owner = grams(words)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.weights[index, k], len(words))
        out[:, -2] = np.bincount(owner, self.seen[index], len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def known(self, sums: np.ndarray) -> np.ndarray:
        """The share of n-grams that came in training, beyond the share of buckets that did."""
        chance = self.seen.mean()
        return np.clip((sums[:, -2] / np.maximum(sums[:, -1], 1) - chance) / max(1 - chance, 1e-9), 0, 1)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums[:, :-2] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(rows: pd.DataFrame, idf: np.ndarray, seed: int = 1) -> Model:
    """rows: lang, index and n (the features of a text and how often each comes), apart (kept for the temperature); idf: a number for each bucket."""
    languages = sorted(rows["lang"].unique())
    y = rows["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    index = [np.asarray(x, np.int64) for x in rows["index"]]
    share = [100 * np.asarray(x, float) / sum(x) for x in rows["n"]]
    seen = np.zeros(BUCKETS, bool)
    for x in index:
        seen[x] = True
    value = [s * idf[x] for s, x in zip(share, index, strict=True)]
    apart = rows["apart"].to_numpy(bool)
    shape = (BUCKETS, len(languages))
    z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    zb, nb, b = np.zeros(shape[1]), np.zeros(shape[1]), np.zeros(shape[1])
    order = np.random.default_rng(seed)

    def step(z, n, g, w):
        s = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        z, n = z + g - s * w, n + g * g
        return z, n, np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in order.permutation(np.flatnonzero(~apart) if (~apart).any() else np.arange(len(rows))):
            x, v = index[i], value[i]
            p = np.exp((logit := v @ w[x] + b) - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            z[x], n[x], w[x] = step(z[x], n[x], np.outer(v, p), w[x])
            zb, nb, b = step(zb, nb, p, b)
    held = np.flatnonzero(apart)
    temperature = 1.0
    if len(held):
        logits = np.array([value[i] @ w[index[i]] + b for i in held])

        doubt = 1 / (len(held) + 2)  # Platt's target: rows that all fit don't make the model certain
        target = np.full(logits.shape, doubt / max(1, len(languages) - 1))
        target[np.arange(len(held)), y[held]] = 1 - doubt

        def loss(t: float) -> float:
            a = logits / t
            top = a.max(axis=1)
            return float(np.mean(top + np.log(np.exp(a - top[:, None]).sum(axis=1)) - (target * a).sum(axis=1)))

        temperature = min(np.exp(np.linspace(-4, 2, 121)), key=loss)
    return Model(languages, 100 * w * idf[:, None], b, float(temperature), seen)


def _features(frames):
    for f in frames:
        out = []
        for text in f["text"]:
            words = letters(text)
            found = np.unique(grams(words)[0], return_counts=True) if words else ([], [])
            out.append((list(map(int, found[0])), list(map(int, found[1]))))
        yield pd.DataFrame({"doc_id": f["doc_id"], "lang": f["lang"], "apart": f["apart"], "index": [a for a, _ in out], "n": [b for _, b in out]})


def _fitted(idf: np.ndarray):
    """Fits in a task, so that the features of the sample never come to the driver; gives the pickled model in parts."""

    def run(frames):
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames).sort_values(["doc_id", "lang"], kind="stable").reset_index(drop=True)  # alike at any number of partitions
        model = pickle.dumps(fit(rows, idf))
        for i, low in enumerate(range(0, len(model), PART)):
            yield pd.DataFrame({"part": [i], "model": [model[low : low + PART]]})

    return run


def _frequencies(batches):
    """(bucket, n): in how many texts of the task a bucket comes; bucket -1: how many texts have letters."""
    total, here, cache = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, bool), {}
    for batch in batches:
        for text in batch.column(0):  # one text at a time becomes a string
            words = list(dict.fromkeys(letters(text.as_py())))
            if not words:
                continue
            if len(cache) > CACHE:
                cache = {}
            fresh = [w for w in words if w not in cache]
            if fresh:
                index, owner = grams(fresh)
                order = np.argsort(owner, kind="stable")
                ends = (2 * np.searchsorted(owner[order], np.arange(len(fresh) + 1))).tolist()
                packed = index[order].astype(np.uint16).tobytes()  # a bucket in two bytes: an array of each word's would take several times as much
                cache.update((w, packed[a:b]) for w, a, b in zip(fresh, ends, ends[1:]))
            here[np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint16)] = True
            at = np.flatnonzero(here)
            total[at] += 1
            total[-1] += 1
            here[at] = False
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.where(at < BUCKETS, at, -1).astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """For each bucket the inverse document frequency over all docs(text) that have letters."""
    counts = docs.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows
    found = np.zeros(BUCKETS + 1)
    found[counts["bucket"].to_numpy()] = counts["n"].to_numpy()  # -1 is the last
    return np.log((1 + found[-1]) / (1 + found[:-1])) + 1


def train(docs: DataFrame, learnable, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on docs(doc_id, text, lang) where learnable (a condition); None if no such row has letters and a language."""
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return None
    most = max(1, min(per_language, SAMPLE // len(sizes)))
    bounds = [(r.lang, min(2**63 - 1, int((2 * most + 100) / r.n * 2**64) - 2**63)) for r in sizes]  # hashes are even over all longs
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))  # MAX_LANGUAGES rows
    low = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(bounds, "lang").where("h <= bound").select("lang", "doc_id", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    chosen = chosen.select("doc_id", (F.pmod("h", F.lit(5)) == 0).alias("apart")).distinct()
    rows = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang", "apart").agg(F.min("text").alias("text"))  # repeated rows come once
    rows = rows.mapInPandas(_features, "doc_id long, lang string, apart boolean, index array<int>, n array<int>").where("size(n) > 0")
    parts = rows.repartition(1).mapInPandas(_fitted(inverse_frequencies(known)), "part int, model binary").toArrow()  # at most SAMPLE rows, in one task
    parts = sorted(zip(parts["part"].to_pylist(), parts["model"].to_pylist(), strict=True))
    return pickle.loads(b"".join(m for _, m in parts)) if parts else None


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and known (the share of the text's n-grams that came in training) added, for every whole text; `und` with 0 and 0 where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, cache, sums = shared.value, {}, None
        for texts in batches:
            if not model:
                yield pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts), "known": [0.0] * len(texts)})
                continue
            total = np.zeros((len(texts), len(model.languages) + 2))
            for r, text in enumerate(texts):  # the words of one text at a time are in memory
                words = letters(text)
                fresh = [w for w in dict.fromkeys(words) if w not in cache]
                if fresh:
                    if sums is None or len(cache) + len(fresh) > CACHE:
                        fresh = list(dict.fromkeys(words))
                        cache, sums = {}, np.zeros((max(CACHE, len(fresh)), total.shape[1]))
                    n = len(cache)
                    if n + len(fresh) > len(sums):
                        sums = np.concatenate([sums, np.zeros((len(fresh), total.shape[1]))])
                    sums[n : n + len(fresh)] = model.sums(fresh)
                    cache.update(zip(fresh, range(n, n + len(fresh)), strict=True))
                if words:
                    total[r] = sums[[cache[w] for w in words]].sum(axis=0)
            p = model.probabilities(total)
            some = total[:, -1] > 0
            names = np.array(model.languages, object)[p.argmax(axis=1)]
            yield pd.DataFrame({"lang": np.where(some, names, "und"), "score": np.where(some, p.max(axis=1), 0.0), "known": np.where(some, model.known(total), 0.0)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judge = F.pandas_udf(run, "lang string, score double, known double")
    return docs.withColumn("__judged", judge(text)).select(*docs.columns, F.col("__judged.lang").alias("lang_pred"), F.col("__judged.score").alias("score"), F.col("__judged.known").alias("known"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> one row per input row: doc_id, held_out, lang_pred, score (calibrated probability of lang_pred), known (share of n-grams met in training).

    Learns from rows that are not held out and have a doc_id, a text and a
    language; where there are none, every text is `und`. A null or empty text,
    or one without letters, is `und` with score 0. Repeated rows are predicted
    each. An empty table gives an empty table. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = train(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
