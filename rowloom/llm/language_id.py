"""Language ID by multilingual mixture inference.

Training counts hashed byte trigrams of lower-cased words per labelled language, over all training
documents. A document is a mixture: each word comes from one language, with the likelihood its trigrams
have there; expectation-maximisation estimates the proportions. The set of languages is selected by
penalised likelihood: sets grow in order of the proportions as long as the gain in log-likelihood
exceeds PENALTY * log(words + 1). The prediction is the largest proportion.

Cases: a text that is null, empty or without a letter is `und` with score 0, as is everything if nothing was
learned; ties go to the language that sorts first; a null id counts as the empty text for the held-out rule;
rows that repeat an id are judged separately; an empty table gives an empty result; a null label is
not learned from. Texts beyond STRETCH characters are read whole, in stretches that end at a space (or, where there is none, after STRETCH
characters): their sums are added up, and each round of expectation-maximisation goes over them again. Only id, text and lang are read,
under names of their own, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import BATCH, id_text, numbered, placed, record, sending, settled, slices, table, those_not_in, unpacked, written

#: Hashed trigrams; the model has languages * BUCKETS numbers.
BUCKETS = 1 << 15
#: Languages that a model may hold: a bound on what is broadcast (4 * BUCKETS bytes each).
MAX_LANGUAGES = 400
PENALTY = 2.0
#: Bytes of text worked on at once.
STRETCH = 1 << 20

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram around each letter byte, first such place of each word, text of each word)."""
    parts = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = _KEEP[np.frombuffer(b"".join(parts), np.uint8)]
    at = np.flatnonzero(b != 32)
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    w = b.astype(np.uint32)
    h = (w[at - 1] * np.uint32(0x9E3779B1)) ^ (w[at] * np.uint32(0x85EBCA6B)) ^ (w[at + 1] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h = ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64) % BUCKETS
    first = np.flatnonzero(np.diff(at, prepend=-9) > 1)
    ends = np.cumsum([len(p) for p in parts])
    return h, first, np.searchsorted(ends, at[first], side="right")


def pieces(text: str, size: int = STRETCH) -> Iterator[str]:
    """A long text in stretches of about size characters."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size, at + 2 * size)
        if end < 0:
            end = at + size if at + 2 * size < len(text) else len(text)
        yield text[at:end]
        at = end


def stretches(texts: list[str], size: int = STRETCH) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about size characters: (place of the first, the texts)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, BUCKETS x languages log-probabilities) from all rows of docs with text and label."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in (some for b in batches for some in slices(b)):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).extend(pieces(text) if len(text) > STRETCH else [text])
            for lang, texts in by.items():
                for _, some in stretches(texts):
                    n = np.bincount(trigrams(some)[0], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(settled(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = [r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs.sort()
    n = np.zeros((BUCKETS, len(langs)))
    with sending(docs.sparkSession, BATCH):
        got = counts.toPandas()  # at most languages * BUCKETS rows
    n[got["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), got["lang"].to_numpy(object)) if langs else []] = got["n"]
    return langs, np.log((n + 0.1) / (n.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32)


def word_likelihoods(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x languages log-likelihoods, text of each word)."""
    h, first, doc = trigrams(texts)
    out = np.empty((len(first), logp.shape[1]), np.float32)
    for i in range(0, len(first), 100_000):
        j = min(i + 100_000, len(first))
        lo, hi = first[i], first[j] if j < len(first) else len(h)
        out[i:j] = np.add.reduceat(logp[h[lo:hi]], first[i:j] - lo, axis=0)
    return out, doc


def em(p: np.ndarray, starts: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions per text, log of the mixture's likelihood per word). starts: first word of each text."""
    n = np.diff(np.append(starts, len(p)))
    for _ in range(rounds):
        r = p * np.repeat(pi, n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
    return pi, np.log(np.maximum((p * np.repeat(pi, n, axis=0)).sum(axis=1), 1e-30))


def infer(texts: list[str], logp: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language or -1, its proportion, size of the selected set) for each text."""
    best, score, size = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    ll, doc = word_likelihoods(texts, logp)
    if not len(ll) or not logp.shape[1]:
        return best, score, size
    n_lang = logp.shape[1]
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    ids = doc[starts]
    n = np.diff(np.append(starts, len(doc)))
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    pi, _ = em(p, starts, np.full((len(ids), n_lang), 1 / n_lang, np.float32), 8)
    order = np.argsort(-pi, axis=1, kind="stable")
    single = np.add.reduceat(ll - top, starts, axis=0)
    first = np.argmax(single, axis=1)
    best[ids], score[ids], size[ids] = first, pi[np.arange(len(ids)), first], 1
    reached = single.max(axis=1).astype(float)
    growing = np.arange(len(ids))
    for m in range(2, n_lang + 1):
        growing = growing[pi[growing, order[growing, m - 1]] > 0.01]
        if not len(growing):
            break
        words = np.concatenate([np.arange(starts[g], starts[g] + n[g]) for g in growing])
        s = np.concatenate([[0], np.cumsum(n[growing])[:-1]])
        allowed = np.zeros((len(growing), n_lang), np.float32)
        np.put_along_axis(allowed, order[growing, :m], 1, axis=1)
        of, per_word = em(p[words], s, (lambda x: x / x.sum(axis=1, keepdims=True))(allowed * pi[growing]), 6)
        total = np.add.reduceat(per_word, s)
        better = total - reached[growing] > penalty * np.log(n[growing] + 1)
        growing, of, total = growing[better], of[better], total[better]
        reached[growing] = total
        best[ids[growing]], score[ids[growing]], size[ids[growing]] = of.argmax(axis=1), of.max(axis=1), m
    return best, np.clip(score, 0, 1), size


def infer_long(text: str, logp: np.ndarray, penalty: float = PENALTY, size: int = STRETCH) -> tuple[int, float, int]:
    """The same as infer() for one text, a stretch at a time."""
    def likelihoods() -> Iterator[np.ndarray]:
        for piece in pieces(text, size):
            ll, _ = word_likelihoods([piece], logp)
            if len(ll):
                yield (ll - ll.max(axis=1, keepdims=True)).astype(float)

    n_lang, n, single = logp.shape[1], 0, 0.0
    if n_lang:
        for ll in likelihoods():
            n, single = n + len(ll), single + ll.sum(axis=0)
    if not n:
        return -1, 0.0, 0

    def mixed(pi: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        for _ in range(rounds):
            total = np.zeros(n_lang)
            for ll in likelihoods():
                r = np.exp(ll) * pi
                total += (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-30)).sum(axis=0)
            pi = total / n
        return pi, sum(np.log(np.maximum((np.exp(ll) * pi).sum(axis=1), 1e-30)).sum() for ll in likelihoods())

    pi, _ = mixed(np.full(n_lang, 1 / n_lang), 8)
    order = np.argsort(-pi, kind="stable")
    best = int(single.argmax())
    score, chosen, reached = float(pi[best]), 1, float(single.max())
    for m in range(2, n_lang + 1):
        if pi[order[m - 1]] <= 0.01:
            break
        of = np.zeros(n_lang)
        of[order[:m]] = pi[order[:m]]
        of, total = mixed(of / of.sum(), 6)
        if total - reached <= penalty * np.log(n + 1):
            break
        best, score, chosen, reached = int(of.argmax()), float(of.max()), m, total
    return best, min(1.0, max(0.0, score)), chosen


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """carry (the id by default), lang_pred, score and n_langs (size of the selected set) of every row."""
    langs, logp = model
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))  # at most MAX_LANGUAGES * BUCKETS * 4 bytes
    lettered = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))

    @settled
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, table = shared.value
        names = np.array([*names, "und"], object)
        for texts in batches:
            texts = [t or "" for t in texts]
            parts = [infer(some, table) for _, some in stretches(["" if len(t) > STRETCH else t for t in texts])]
            best, score, size = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [])
            for i, t in enumerate(texts):
                if len(t) > STRETCH:
                    best[i], score[i], size[i] = infer_long(t, table)
            yield pd.DataFrame({"lang": names[best] if len(best) else [], "score": score, "n_langs": size})

    @F.pandas_udf("lang string, score double, n_langs int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from judged(batches)

    out = docs.select(*(carry or [F.col(id_col)]), judge(lettered).alias("__judged"))
    kept = [c for c in out.columns if c != "__judged"]
    return out.select(*kept, F.col("__judged.lang").alias("lang_pred"), F.col("__judged.score").alias("score"), F.col("__judged.n_langs").alias("n_langs"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(id_text(id_col).cast("binary")) % folds == 0


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known, with all their columns. What has none is stored by its place: a verdict goes to
    workers in small batches, and texts are written once."""
    names = docs.columns
    docs, files = placed(docs)
    model = train(docs.filter(~held_out()))
    judged = predict(numbered(docs, files, "text"), model, carry=[F.col("uid")])
    unknown = written(judged.filter("lang_pred = 'und'").select("uid"), batch=BATCH)
    return those_not_in(numbered(docs, files, record(names)), "uid", unknown, "uid").select(*unpacked(names))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return predict(docs, model, carry=[F.col("doc_id"), held_out().alias("held_out")])
