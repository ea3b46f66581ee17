"""Language ID with segmentation-marginalised unigrams.

Every language has its own probabilities over one fixed public piece
vocabulary. A word's probability is the sum over all its segmentations into
pieces (forward algorithm); a text's is the product over its words, so distinct
words are scored once per slice and the text is a sum of their logarithms.

Fit: piece probabilities are the classifier, so they may come from a bounded
sample: at most ``fit_rows`` labelled training rows per language, chosen by a hash
of the row and its place, so a key on many rows decides nothing; every word of the sampled rows counts, however long (a line of a
script without spaces is one word). The E-steps run as Spark tasks over the sample's word table; only
the (language, piece) sums (languages x vocabulary) reach the driver.

Cases: a text that is null or has no letter gets ``und`` with score 0; without
any labelled training row every text is ``und``. Equal likelihoods go to the
alphabetically first language. Repeated rows are scored each by itself; columns
of the input other than the named ones are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tokenmill.llm.common import (PIECE_MODEL, as_text, dictionary, free_name, group_sums, held_out, map_arrow, prefixed, quoted, sample_rows,
                                  slices, split_words, text_batches, with_fields, worker_store)
from tokenmill.llm.pieces import SPACE, PieceTable, by_length, code_points, load_pieces

FIT_CELLS = 200_000  # characters that one E-step call works on (a longer word is one call)
CACHE_WORDS = 150_000
MAX_LANGUAGES = 1024  # the piece probabilities are a (pieces x languages) array
UND = "und"


def letters(words: pa.Array) -> pa.Array:
    """Lower-cased letters of every word ('' if it has none)."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pM]+", "")


def fit(train: DataFrame, key: str, text: str, lang: str, model_path: str = PIECE_MODEL, fit_rows: int = 1500,
        rounds: int = 3, smooth: float = 0.05) -> dict:
    """Piece probabilities per language from ``train`` (rows with a null text or
    language are ignored). Returns {languages, prob [pieces, languages], unk}."""
    spark = train.sparkSession
    pieces = load_pieces(model_path)[0]
    known = train.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("lang")) \
        .where(F.col("t").isNotNull() & F.col("lang").isNotNull())
    if known.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    sample = sample_rows(known, "lang", fit_rows, ("k", "t"))
    word = F.regexp_replace(F.lower(F.col("w")), r"[^\p{L}\p{M}]+", "")
    words = (sample.select("lang", F.explode(F.split("t", r"[\x09-\x0D\x20]+")).alias("w"))
             .select("lang", word.alias("w")).where(F.col("w") != "")
             .groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))).checkpoint()
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    if not langs:
        return {"languages": [], "prob": np.zeros((len(pieces), 0)), "unk": 0.0, "pieces": pieces}
    usable = np.array([bool(p) for p in pieces])
    prob = np.where(usable, 1.0 / usable.sum(), 0.0)[:, None].repeat(len(langs), 1)
    unk = 1e-7
    schema = "lang string, piece int, n double"
    shared, store = spark.sparkContext.broadcast(pieces), f"langid-fit-{uuid.uuid4()}"
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(prob)

        def e_step(batches, now=now):
            kept = worker_store(store)
            if "table" not in kept:
                kept["table"] = PieceTable(shared.value)
            names = {x: i for i, x in enumerate(langs)}
            total = np.zeros((len(usable), len(langs)))
            for b in batches:
                w = prefixed(SPACE, as_text(b.column("w")))
                weight = b.column("n").to_numpy(zero_copy_only=False).astype(float)
                of = np.array([names[x] for x in b.column("lang").to_pylist()], dtype=int)
                for i in range(len(langs)):
                    mine = np.flatnonzero(of == i)
                    own = w.take(pa.array(mine))
                    for n, idx in by_length(own):
                        for part in np.array_split(idx, max(1, len(idx) * n // FIT_CELLS)):
                            total[:, i] += kept["table"].expected(code_points(own.take(pa.array(part)), n),
                                                                 now.value[:, i], unk, weight[mine[part]])
            for i, name in enumerate(langs):
                at = np.flatnonzero(total[:, i])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()),
                                                  "piece": at.astype(np.int32), "n": total[at, i]})

        got = (words.mapInArrow(e_step, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n"))).toArrow()
        count = np.zeros_like(prob)
        col = {x: i for i, x in enumerate(langs)}
        li = np.array([col[x] for x in got.column("lang").to_pylist()], dtype=int)
        count[got.column("piece").to_numpy(), li] = got.column("n").to_numpy()
        count = np.where(usable[:, None], count + smooth, 0)
        prob = count / count.sum(axis=0)
        now.unpersist()
    return {"languages": langs, "prob": prob, "unk": unk, "pieces": pieces}


class Scorer:
    """Scores words with a fitted model; distinct words are kept in a bounded
    per-worker cache."""

    def __init__(self, model: dict, cache: dict | None = None):
        self.langs, self.prob, self.unk = model["languages"], model["prob"], model["unk"]
        self.cache = {} if cache is None else cache
        if "table" not in self.cache:
            self.cache |= {"table": PieceTable(model["pieces"]), "rows": {}}
        self.table = self.cache["table"]

    def words(self, words: pa.Array) -> np.ndarray:
        """log probability per word and language (0 for '')."""
        out = np.zeros((len(words), len(self.langs)))
        rows = self.cache["rows"]
        if len(rows) > CACHE_WORDS:
            rows.clear()
        miss, names = [], words.to_pylist()
        for i, w in enumerate(names):
            if w:
                hit = rows.get(w)
                if hit is None:
                    miss.append(i)
                else:
                    out[i] = hit
        if miss:
            todo = prefixed(SPACE, words.take(pa.array(miss)))
            at = np.array(miss)
            for n, idx in by_length(todo):
                for part in np.array_split(idx, max(1, len(idx) * n // 200_000)):
                    got = self.table.forward(code_points(todo.take(pa.array(part)), n), self.prob, self.unk)
                    out[at[part]] = got
                    if n <= 40:
                        for j, row in zip(at[part], got):
                            rows[names[j]] = row
        return out

    def texts(self, texts: pa.Array):
        """(language, score) of every text."""
        flat, n = split_words(texts, lower=False)
        dic, code = dictionary(flat)
        clean = letters(dic)
        stem, to_stem = dictionary(clean)
        ll = self.words(stem)
        code = to_stem[code]
        lettered = pc.match_substring_regex(stem, r"\pL").to_numpy(zero_copy_only=False)
        has = group_sums(lettered.astype(np.int64)[code], n) > 0
        total = np.stack([group_sums(ll[:, k][code], n) for k in range(len(self.langs))], axis=1) \
            if self.langs else np.zeros((len(texts), 0))
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        best = total.argmax(axis=1)
        rel = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0))
        score = 1 / rel.sum(axis=1)
        return [self.langs[b] if h else UND for b, h in zip(best, has)], np.where(has, score, 0.0)


def predict(docs: DataFrame, model: dict, text: str = "text", keep=("doc_id",), lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``keep`` columns plus language and score of every row (``keep`` may hold
    the text itself)."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    shared, key = sc.broadcast(model), f"langid-{uuid.uuid4()}"
    keep = list(keep)
    read = text if text in keep else free_name(keep, "worked")
    src = docs.select(*[F.col(quoted(c)) for c in keep], *([] if text in keep else [F.col(quoted(text)).alias(read)]))
    fields = with_fields(docs, keep, {lang_out: StringType(), score_out: DoubleType()})

    def run(batches):
        scorer = Scorer(shared.value, worker_store(key))
        for b in batches:
            texts = as_text(b.column(read))
            for at, n in slices(texts):
                lang, score = scorer.texts(texts.slice(at, n))
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(at, n) for c in keep] + [pa.array(lang, pa.string()), pa.array(score)],
                    names=[*keep, lang_out, score_out])

    return map_arrow(src, run, fields)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **fit_args) -> DataFrame:
    """Fit on the rows that are not held out (crc32 of the key modulo 3 is not
    1), predict every row: key, held_out, lang_pred, score. ``key`` only splits
    the rows; ``lang`` is only read for the fit."""
    model = fit(docs.where(~held_out(key, 3)), key, text, lang, **fit_args)
    marked = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out(key, 3).alias("held_out"))
    return predict(marked, model, "t", ["k", "held_out"]).withColumnRenamed("k", key)


def keep_recognised(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    least: float = 0.5, **fit_args) -> DataFrame:
    """The rows, unchanged, whose language is recognised: not ``und`` and a score
    of at least ``least``."""
    model = fit(docs.where(~held_out(key, 3)), key, text, lang, **fit_args)
    named, sure = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    seen = predict(docs, model, text, docs.columns, named, sure)
    return seen.where((F.col(quoted(named)) != UND) & (F.col(quoted(sure)) >= least)).drop(named, sure)
