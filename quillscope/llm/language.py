"""Language of each text and of each of its segments, by a mixture of n-gram models.

1. A model of hashed letter n-grams (of 3 and 5, within words) is fitted on a bounded sample of labelled texts,
   with the share ``train_rows`` a language. Labels may be wrong: after the first fit, each sentence of the sample is
   given to the language the model finds likeliest, and the model is fitted again. The executors count, and
   only the sums (5 MB, whatever the sample) reach the driver.
2. A text is cut into sentences (longer runs into pieces of 8 words). Links, mentions and tags are left out, and a word counts
   once a text, so that loops weigh no more than what they repeat.
3. Expectation-maximisation estimates the shares of the languages in each text from the likelihoods of its
   sentences. The set of languages is chosen by penalised likelihood of the mixture, log L(set) - languages x penalty x
   (1 + log sentences): from the full set, the language whose loss is least is taken away, and the shares of the
   others are estimated again, as long as the penalised likelihood rises; at least one stays.
4. Sentences get the likeliest of the languages left; neighbours with the same language are a segment.

All texts of an Arrow batch are handled at once in arrays; no state is kept between rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship
from .quality import is_no_prose

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pt", "ru"]
# Other names of the languages in labels.
NAMES = {
    "de": ["deu", "ger", "german", "deutsch"], "en": ["eng", "english"], "es": ["spa", "spanish", "español"], "fr": ["fra", "fre", "french", "français"],
    "it": ["ita", "italian", "italiano"], "nl": ["nld", "dut", "dutch", "nederlands"], "pt": ["por", "portuguese", "português"], "ru": ["rus", "russian", "русский"],
}
#: Labelled texts of each language from which the model is fitted, at most (about; chosen by hash).
TRAIN_ROWS = 2_000
#: A sentence has at least so many words; shorter ones (a signature, a tag) tell nothing of their language.
LEAST_WORDS = 3
#: The most by which one word may speak for a language.
WORD_LIMIT = 12.0
#: Loss of log-likelihood that is put up with to name a language less, in a text of one sentence; grows with the log of their number.
PENALTY = 15.0
#: Tasks that count the sample.
FIT_TASKS = 8
BITS3, BITS5 = 15, 17
#: Characters handled at once.
BATCH_CHARS = 1 << 20

_SKIP = re.compile(r"\S*://\S+|\bnostr:\S+|[#@][\w-]+|\S{30,}")
_SENTENCE = re.compile(r"[.!?…。]+[\"”»')\]]*(?=\s|$)|\n\s*\n|\n\s*-{2,}\s*\n|\s[/|]\s")
_LETTER: np.ndarray | None = None


def normal_label(label: Column) -> Column:
    """The code of the language a label names, or null: ``en``, ``EN``, ``en-GB``, ``eng``, ``English`` are one."""
    head = F.get(F.split(F.lower(F.regexp_replace(label, r"^\s+|\s+$", "")), "[-_]"), F.lit(0))
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(code, *names), code).otherwise(out)
    return out


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
    return _LETTER


class _Batch:
    """Arrays over all texts: letters, their words, sentences and texts."""

    def __init__(self, texts: list[str]):
        clean = []
        for t in texts:
            low = t.lower()
            low = low if len(low) == len(t) else "".join(c if len(c.lower()) != 1 else c.lower() for c in t)
            clean.append(_SKIP.sub(lambda m: " " * len(m.group()), low))
        self.sizes = np.array([len(t) + 1 for t in clean], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        joined = "\n".join([*clean, ""])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(code, 0xFFFF)] & (code < 0x10000)
        c = np.where(letter, code, 0).astype(np.uint64)
        pad = np.concatenate([[0, 0], c, [0, 0]]).astype(np.uint64)
        l2, l1, r1, r2 = pad[:-4], pad[1:-3], pad[3:-1], pad[4:]
        l2, r2 = l2 * (l1 > 0), r2 * (r1 > 0)  # nothing across the ends of a word
        at = np.flatnonzero(letter)
        self.at = at
        k3 = (l1[at] * np.uint64(0x9E3779B1) + c[at]) * np.uint64(0x85EBCA77) + r1[at]
        k5 = (k3 * np.uint64(0xC2B2AE3D) + l2[at]) * np.uint64(0x27D4EB2F) + r2[at]
        self.h3, self.h5 = _mix(k3, BITS3), _mix(k5, BITS5)
        starts = np.flatnonzero(letter & (l1 == 0))
        self.word_at, self.word_first = starts, np.searchsorted(at, starts)
        self.word_text = np.searchsorted(self.first, starts, side="right") - 1
        rolling = np.add.reduceat(_scramble(k5), self.word_first) if len(at) else np.zeros(0, np.uint64)
        # The first occurrence of each word of each text.
        key = rolling * np.uint64(0x9E3779B97F4A7C15) + self.word_text.astype(np.uint64)
        self.fresh = np.zeros(len(starts), bool)
        self.fresh[np.unique(key, return_index=True)[1]] = True
        # Sentences, and pieces of 8 words of what has no ends.
        ends = np.array([m.end() for m in _SENTENCE.finditer(joined)], np.int64)
        new = np.zeros(len(starts) + 1, bool)
        new[np.searchsorted(starts, np.concatenate([ends, self.first]))] = True
        new = new[:-1]
        if len(new):
            new[0] = True
        run = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        length = np.diff(np.append(np.flatnonzero(new), len(new)))
        long = np.repeat(length, length) > 24 if len(new) else np.zeros(0, bool)
        self.unit_first = np.flatnonzero(new | (long & (run % 8 == 0)))
        self.unit_text = self.word_text[self.unit_first]
        self.unit_of_word = np.repeat(np.arange(len(self.unit_first)), np.diff(np.append(self.unit_first, len(new))))


def _scramble(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return k ^ (k >> np.uint64(29))


def _mix(k: np.ndarray, bits: int) -> np.ndarray:
    return (_scramble(k) >> np.uint64(64 - bits)).astype(np.int64)


class LanguageModel:
    """Log-likelihoods of hashed n-grams for each language, less their mean; 5 MB whatever the data."""

    def __init__(self, t3: np.ndarray, t5: np.ndarray):
        self.t3, self.t5 = t3, t5

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> LanguageModel:
        """From the counts of n-grams by language, those of 3 first."""
        n = len(LANGUAGES)
        c3, c5 = counts[: n << BITS3].reshape(-1, n), counts[n << BITS3 :].reshape(-1, n)
        return cls(cls._table(c3.astype(float)), cls._table(c5.astype(float)))

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], rounds: int = 3) -> LanguageModel:
        """On the texts of one process."""
        model, truth = None, np.array([LANGUAGES.index(x) for x in labels], np.int64)
        for _ in range(rounds):
            model = cls.from_counts(count_grams(_Batch(texts), truth, model))
        return model

    @staticmethod
    def _table(counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=0), 1)
        rate = counts / total * total.mean() + 0.3  # as if all languages had the same amount of text
        logs = np.log(rate)
        return (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def units(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each sentence for each language: of words that are new in the text, and of all its words."""
        if not len(b.at):
            nothing = np.zeros((len(b.unit_first), len(LANGUAGES)))
            return nothing, nothing
        words = np.add.reduceat(self.t3[b.h3] + self.t5[b.h5], b.word_first, axis=0)
        words = np.maximum(words, words.max(axis=1, keepdims=True) - WORD_LIMIT * 2)
        every = np.add.reduceat(words, b.unit_first, axis=0).astype(float) * 0.5
        words[~b.fresh] = 0
        fresh = np.add.reduceat(words, b.unit_first, axis=0).astype(float) * 0.5
        short = np.bincount(b.unit_of_word, minlength=len(every)) < LEAST_WORDS
        fresh[short] = every[short] = 0
        return fresh, every

    def infer(self, texts: list[str], penalty: float = PENALTY) -> list[dict]:
        """For each text: languages (the largest share first), shares, confidence, and segments (start, end, language, confidence)."""
        b = _Batch(texts)
        n, k = len(texts), len(LANGUAGES)
        ll, whole = self.units(b)
        doc = b.unit_text
        seen = np.bincount(b.unit_of_word[b.fresh], minlength=len(doc)).astype(float) + 1e-3 if len(doc) else np.zeros(0)
        total = np.maximum(np.bincount(doc, seen, n), 1e-9)

        def sums(x: np.ndarray) -> np.ndarray:
            return np.stack([np.bincount(doc, x[:, j], n) for j in range(k)], axis=1)

        def post(share: np.ndarray, ll: np.ndarray = ll) -> np.ndarray:
            z = ll + np.log(np.maximum(share, 1e-12))[doc]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            return z / z.sum(axis=1, keepdims=True)

        def em(share: np.ndarray, steps: int) -> np.ndarray:
            for _ in range(steps):
                share = sums(post(share) * seen[:, None]) / total[:, None]
            return share

        share = em(np.full((n, k), 1 / k), 12)
        allowed = share > 1e-6
        allowed[np.arange(n), share.argmax(axis=1)] = True
        share = np.where(allowed, share, 0)
        share = _select(ll, doc, seen, share, allowed, penalty)
        allowed &= share > 0
        chosen = post(np.where(allowed, share, 0), whole)  # what a sentence repeats still tells its language
        # Confidence: the posterior among all languages, each sentence's likelihood taken by the word.
        free = whole / np.sqrt(np.bincount(b.unit_of_word, minlength=len(doc)))[:, None] if len(doc) else whole
        free = np.exp(free - free.max(axis=1, keepdims=True)) if len(doc) else free
        free = free / free.sum(axis=1, keepdims=True) if len(doc) else free
        lang = chosen.argmax(axis=1)
        sure = free[np.arange(len(doc)), lang]
        word_ends = np.append(b.word_at[b.unit_first[1:]], b.first[-1] + b.sizes[-1] if n else 0)
        out: list[dict] = [{"langs": [], "shares": [], "confidence": 0.0, "segments": []} for _ in range(n)]
        for i in range(n):
            order = [j for j in np.argsort(-share[i], kind="stable") if allowed[i, j] and share[i, j] > 0]
            out[i]["langs"], out[i]["shares"] = [LANGUAGES[j] for j in order], [float(share[i, j]) for j in order]
        mean = np.bincount(doc, sure * seen, n) / total
        for u in range(len(doc)):
            d, o = int(doc[u]), out[int(doc[u])]
            start, end = int(b.word_at[b.unit_first[u]] - b.first[d]), int(min(word_ends[u], b.first[d] + b.sizes[d] - 1) - b.first[d])
            name, last = LANGUAGES[lang[u]], o["segments"][-1] if o["segments"] else None
            if last and last["lang"] == name:
                last["confidence"] = (last["confidence"] * last["w"] + sure[u] * seen[u]) / (last["w"] + seen[u])
                last["w"], last["end"] = last["w"] + seen[u], end
            else:
                o["segments"].append({"start": start, "end": end, "lang": name, "confidence": float(sure[u]), "w": seen[u]})
        for i, o in enumerate(out):
            o["confidence"] = float(mean[i]) if o["segments"] else 0.0
            o["langs"] = o["langs"] if o["segments"] else []
            o["shares"] = o["shares"] if o["segments"] else []
        return out


def _select(ll: np.ndarray, doc: np.ndarray, seen: np.ndarray, share: np.ndarray, allowed: np.ndarray, penalty: float) -> np.ndarray:
    """The shares of each text's languages after those are taken away whose loss of mixture log-likelihood is below the penalty.

    ``ll``: log-likelihood of each sentence (of text ``doc``) by language; ``seen``: its new words. Texts of one language left are done.
    """
    share, allowed = share.copy(), allowed.copy()
    n, k = share.shape
    price = penalty * (1 + np.log(np.maximum(np.bincount(doc, minlength=n), 1)))
    while True:
        open_docs = np.flatnonzero(allowed.sum(axis=1) > 1)
        if not len(open_docs):
            return share
        place = np.full(n, -1, np.int64)
        place[open_docs] = np.arange(len(open_docs))
        rows = np.flatnonzero(place[doc] >= 0)
        own, part, w = ll[rows], place[doc[rows]], seen[rows]
        total, m = np.maximum(np.bincount(part, w, len(open_docs)), 1e-9), len(open_docs)

        def refine(s: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            """Shares after some steps of expectation-maximisation, and the log-likelihood of each text's mixture."""
            for step in range(steps + 1):
                z = own + np.where(s > 0, np.log(np.maximum(s, 1e-300)), -np.inf)[part]
                top = z.max(axis=1, keepdims=True)
                e = np.exp(z - top)
                mass = e.sum(axis=1, keepdims=True)
                if step == steps:
                    return s, np.bincount(part, (top + np.log(mass))[:, 0], m)
                s = np.stack([np.bincount(part, e[:, j] / mass[:, 0] * w, m) for j in range(k)], axis=1) / total[:, None]

        # A share that has come down to nothing is gone; while a set is refined no language comes back.
        now, whole = refine(np.where(allowed[open_docs], share[open_docs], 0), 4)
        now = np.where(now > 1e-9, now, 0)
        loss, without = np.full((m, k), np.inf), {}
        for j in range(k):
            if not allowed[open_docs, j].any():
                continue
            s = now.copy()
            s[:, j] = 0
            rest = s.sum(axis=1, keepdims=True)
            flat = (now > 0).astype(float)
            flat[:, j] = 0
            s = np.where(rest > 1e-9, s / np.maximum(rest, 1e-9), flat / np.maximum(flat.sum(axis=1, keepdims=True), 1))
            without[j], reached = refine(0.99 * s + 0.01 * flat / np.maximum(flat.sum(axis=1, keepdims=True), 1), 4)
            loss[:, j] = np.where(allowed[open_docs, j] & (now[:, j] > 0) & (flat.sum(axis=1) > 0), whole - reached, np.inf)
        weakest = loss.argmin(axis=1)
        drop = loss[np.arange(m), weakest] < price[open_docs]
        share[open_docs] = now
        for i in np.flatnonzero(drop):
            share[open_docs[i]] = without[weakest[i]][i]
            share[open_docs[i], weakest[i]] = 0
            allowed[open_docs[i], weakest[i]] = False
        # Sets that cannot be made smaller are settled.
        allowed[open_docs[~drop]] = False


def count_grams(b: _Batch, truth: np.ndarray, model: LanguageModel | None) -> np.ndarray:
    """Counts of the n-grams of all texts by language: by the texts' labels, or by the likeliest language of each sentence."""
    n = len(LANGUAGES)
    sizes = np.diff(np.append(b.word_first, len(b.at)))
    unit = truth[b.unit_text] if model is None else model.units(b)[1].argmax(axis=1)
    weight = np.repeat(b.fresh, sizes)
    lang = np.repeat(unit[b.unit_of_word], sizes)[weight]
    return np.concatenate([np.bincount(h[weight] * n + lang, minlength=n << bits) for h, bits in ((b.h3, BITS3), (b.h5, BITS5))]).astype(np.int64)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about :data:`BATCH_CHARS` characters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_CHARS or i == len(texts) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def fit_model(labelled: DataFrame, text: Column, label: Column, train_rows: int = TRAIN_ROWS, seed: int = 3, rounds: int = 3) -> LanguageModel:
    """Fit on about ``train_rows`` different texts a language, chosen by hash; rows of no known label are not used.

    The sample is written and stays with the executors: they count its n-grams, slices of the counts are summed by shuffle,
    and 64 of them (5 MB in all) come to the driver in each round.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(text.alias("text"), normal_label(label).alias("lang")).where("lang is not null and length(text) between 40 and 20000")
    rows = rows.withColumn("u", F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        raise ValueError("no labelled texts to fit on")
    test = F.lit(False)
    for lang, count in counts.items():
        test = test | ((F.col("lang") == lang) & (F.col("u") < int(min(1.0, train_rows / count) * (1 << 30))))
    few = rows.where(test).groupBy("text").agg(F.min("lang").alias("lang")).repartition(FIT_TASKS)
    scratch = Scratch(spark, "language")
    sample = scratch.write(few.where(~is_no_prose(F.col("text"))), "sample").repartition(FIT_TASKS)
    model: LanguageModel | None = None
    for _ in range(rounds):
        model = LanguageModel.from_counts(_summed(sample, model))
    scratch.drop()
    return model


def _summed(sample: DataFrame, model: LanguageModel | None, slices: int = 64) -> np.ndarray:
    """The counts of :func:`count_grams` over a table of (text, lang)."""
    size = len(LANGUAGES) * ((1 << BITS3) + (1 << BITS5))
    width = -(-size // slices)
    shared = None if model is None else sample.sparkSession.sparkContext.broadcast((model.t3, model.t5))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = None if shared is None else LanguageModel(*shared.value), np.zeros(size, np.int64)
        for batch in batches:
            texts, truth = batch.column("text").to_pylist(), np.array([LANGUAGES.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in _slices(texts):
                total += count_grams(_Batch(texts[lo:hi]), truth[lo:hi], own)
        parts = [total[i : i + width].astype(np.int32).tobytes() for i in range(0, size, width)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.astype(np.int32).tobytes()], pa.binary())})

    summed = sample.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    parts = sorted((r["part"], bytes(r["counts"])) for r in summed.collect())
    return np.concatenate([np.frombuffer(x, np.int32) for _, x in parts]).astype(np.int64)


def infer_languages(records: DataFrame, keys: dict[str, Column], text: Column, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """The keys' columns with ``langs`` (largest share first), ``shares``, ``confidence`` and ``segments``.

    A segment: start and end in characters, lang, confidence. One row a record, also of repeated ones; null and empty texts and
    those without letters have no languages, no segments and confidence 0. Other columns are ignored. Texts are taken whole; each
    task handles about a million characters at once.
    """
    ship(records.sparkSession)
    shared = records.sparkSession.sparkContext.broadcast((model.t3, model.t5))
    rows = records.select(*[c.alias(n) for n, c in keys.items()], text.alias("__text"))
    names = list(keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for lo, hi in _slices(texts):
                got = own.infer(texts[lo:hi], penalty)
                keys_part = [batch.column(j).slice(lo, hi - lo) for j in range(len(names))]
                segments = [[{f: s[f] for f in ("start", "end", "lang", "confidence")} for s in g["segments"]] for g in got]
                arrays = [*keys_part, pa.array([g["langs"] for g in got], pa.list_(pa.string())), pa.array([g["shares"] for g in got], pa.list_(pa.float64())), pa.array([g["confidence"] for g in got], pa.float64()), pa.array(segments, pa.list_(segment))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "langs", "shares", "confidence", "segments"])

    return rows.mapInArrow(run, f"{types}, langs array<string>, shares array<double>, confidence double, segments array<struct<start: int, end: int, lang: string, confidence: double>>")
