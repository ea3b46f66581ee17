"""Decoding over score tables.

The network is not part of the engine: a decoder reads a table
``next_scores(ctx..., prev, nxt, logp)`` (or one a user scorer produced via
U1). All keys advance together, one bounded join per step. Per-(context, prev)
tables (best next token, top-k, sampling CDF) are derived once; their size is
bounded by contexts x vocabulary and is checked before they are broadcast.
Beam ranking is a window per key over at most beam*beam + beam rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.constants import BOS_ID, EOS_ID, MAX_SRC_LEN, PAD_ID
from tokenmill.functions import clean_ids, strip_text, wrap_pad_fixed, wrap_truncate
from tokenmill.session import cut_lineage

BROADCAST_BYTES = 64 << 20  # of a table shipped to every task


def _bytes(df: DataFrame) -> int:
    """Measured size of a table's values."""
    def size(f):
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind == "string":
            return F.coalesce(F.octet_length(c), F.lit(0))
        if kind == "array<string>":
            return F.coalesce(F.octet_length(F.array_join(c, "")) + 16 * F.size(c), F.lit(0))
        if kind.startswith("array"):
            return F.coalesce(48 * F.size(c), F.lit(0))
        return F.lit(8)
    total = df.agg(F.sum(sum((size(f).cast("bigint") for f in df.schema.fields), F.lit(16))).alias("b")).first()["b"]
    return int(total or 0)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """Materialise a derived per-(context, prev) table once (it is read at
    every step) and broadcast it only while its measured size is bounded; above
    that the planner shuffles it like any other join side."""
    df = cut_lineage(df)
    return F.broadcast(df) if _bytes(df) <= BROADCAST_BYTES else df


def best_next(scores: DataFrame, ctx=("lang",)) -> DataFrame:
    """D1 on the long form: best next token per (context, prev); ties -> the
    smallest token."""
    ctx = list(ctx)
    w = Window.partitionBy(*ctx, "prev").orderBy(F.col("logp").desc(), F.col("nxt"))
    return scores.select(*ctx, "prev", "nxt", "logp", F.row_number().over(w).alias("rk")).where("rk = 1").drop("rk")


def top_next(scores: DataFrame, k: int, ctx=("lang",)) -> DataFrame:
    """D2 on the long form: k best next tokens per (context, prev)."""
    ctx = list(ctx)
    w = Window.partitionBy(*ctx, "prev").orderBy(F.col("logp").desc(), F.col("nxt"))
    return scores.select(*ctx, "prev", "nxt", "logp", F.row_number().over(w).alias("rk")).where(F.col("rk") <= k)


def _by_distinct_start(starts: DataFrame, key: str, ctx, run) -> DataFrame:
    """Decoding is a deterministic function of (context, start sequence):
    decode each distinct start state once and join the result back to the
    keys (on the state's own columns, nulls included), so per-step work scales
    with distinct states, not rows."""
    ctx = list(ctx)
    state = [*ctx, "seq"]
    uniq = cut_lineage(starts.select(*state).distinct().withColumn("_sk", F.monotonically_increasing_id()))
    done = cut_lineage(run(uniq, "_sk").drop(*ctx))
    named = uniq.select("_sk", *[F.col(c).alias(f"_{c}") for c in state])
    same = None
    for c in state:
        eq = starts[c].eqNullSafe(F.col(f"_{c}"))
        same = eq if same is None else same & eq
    side = F.broadcast(named) if _bytes(named) <= BROADCAST_BYTES else named
    keyed = starts.select(key, *state).join(side, same).select(key, *ctx, "_sk")
    side = F.broadcast(done) if _bytes(done) <= BROADCAST_BYTES else done
    return keyed.join(side, "_sk").drop("_sk")


def _local(st: DataFrame, table: DataFrame, key: str, ctx, more: str, step_fn) -> DataFrame:
    """Decodes every start state of a batch in its task, all steps at once, with
    the next-token table as a lookup (the caller has measured that it is small).
    ``step_fn(seq, successors)`` gives the output values after key and ctx;
    ``successors(ctx, prev)`` lists (nxt, logp), best first."""
    ctx = list(ctx)
    lookup: dict = {}
    for r in table.orderBy(F.col("logp").desc(), "nxt").collect():  # at most BROADCAST_BYTES
        lookup.setdefault(tuple(r[c] for c in [*ctx, "prev"]), []).append((r["nxt"], r["logp"]))
    shared = st.sparkSession.sparkContext.broadcast(lookup)
    src = st.select(key, *ctx, "seq")
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    fields = ", ".join(f"`{c}` {types[c]}" for c in [key, *ctx])
    names = [f.split()[0] for f in more.split(", ")]

    def run(batches):
        import pyarrow as pa
        nexts = shared.value
        kinds = {"double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
        for b in batches:
            c_cols = [b.column(c).to_pylist() for c in ctx]
            rows = [step_fn(seq, lambda prev, c=tuple(c): nexts.get((*c, prev), ()))
                    for *c, seq in zip(*c_cols, b.column("seq").to_pylist())]
            seq_type = b.schema.field("seq").type
            cols = [pa.array(v, seq_type if f.split()[0] == "seq" else kinds[f.split()[1]])
                    for f, v in zip(more.split(", "), zip(*rows))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [key, *ctx]], *cols], names=[key, *ctx, *names])

    return src.mapInArrow(run, f"{fields}, {more.replace('seq SEQ', 'seq ' + types['seq'])}")


def greedy_decode(starts: DataFrame, scores: DataFrame, max_len: int, eos: str = "</s>",
                  key: str = "key", ctx=("lang",), checkpoint_every: int = 8, dedupe: bool = True,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """D3: each distinct start state is decoded once; while the best-next table
    is small (measured) in one pass, beyond that by a join per step."""
    if dedupe:
        return _by_distinct_start(starts, key, ctx, lambda u, k: greedy_decode(
            u, scores, max_len, eos, k, ctx, checkpoint_every, False, broadcast_bytes))
    best = cut_lineage(best_next(scores, ctx).select(*ctx, "prev", "nxt", "logp"))
    if _bytes(best) > broadcast_bytes:
        return _greedy(starts, scores, max_len, eos, key, ctx, checkpoint_every)

    def decode(seq, successors):
        seq, score, ended, logps = list(seq), 0.0, False, []
        while seq and not ended and len(logps) < max_len:
            best = successors(seq[-1])
            if not best:
                ended = True
                break
            seq.append(best[0][0])
            score += best[0][1]
            logps.append(best[0][1])
            ended = best[0][0] == eos
        return seq, score, ended, logps

    return _local(starts, best, key, ctx, "seq SEQ, score double, ended boolean, logps array<double>", decode)


def _greedy(starts: DataFrame, scores: DataFrame, max_len: int, eos: str = "</s>",
            key: str = "key", ctx=("lang",), checkpoint_every: int = 8) -> DataFrame:
    """D3: from each start sequence append the best next token until eos or
    ``max_len`` steps (eos kept). ``starts``: key, ctx..., seq array<string>.
    Output adds ``score`` (sum of logp), ``ended`` and the per-step ``logps``."""
    ctx = list(ctx)
    best = _maybe_broadcast(best_next(scores, ctx).select(*ctx, "prev", "nxt", "logp"))
    st = starts.select(key, *ctx, "seq", F.lit(0.0).alias("score"), F.lit(False).alias("ended"),
                       F.array().cast("array<double>").alias("logps"))
    for step in range(1, max_len + 1):
        open_ = st.withColumn("prev", F.element_at("seq", -1))
        joined = open_.join(best, [*ctx, "prev"], "left")
        adv = F.col("ended") | F.col("nxt").isNull()
        st = joined.select(
            key, *ctx,
            F.when(adv, F.col("seq")).otherwise(F.concat("seq", F.array("nxt"))).alias("seq"),
            F.when(adv, F.col("score")).otherwise(F.col("score") + F.col("logp")).alias("score"),
            (F.col("ended") | (F.col("nxt") == eos) | F.col("nxt").isNull()).alias("ended"),
            F.when(adv, F.col("logps")).otherwise(F.concat("logps", F.array("logp"))).alias("logps"))
        if step % checkpoint_every == 0:
            st = cut_lineage(st)
            if st.where(~F.col("ended")).isEmpty():
                break
    return st


def length_norm(score, length, alpha: float = 0.6):
    """Score / ((5 + L) / 6) ** alpha."""
    return score / F.pow((F.lit(5.0) + length) / F.lit(6.0), F.lit(float(alpha)))


def rerank(cands: DataFrame, key: str = "key", alpha: float = 0.6) -> DataFrame:
    """Best candidate per key by length-normalised score (L counts every
    token of the sequence); ties -> higher rounded score, then tokens asc."""
    norm = F.round(length_norm(F.col("score"), F.size("seq"), alpha), 9)
    w = Window.partitionBy(key).orderBy(F.col("_norm").desc(), F.array_join("seq", "\u0001"))
    return (cands.withColumn("_norm", norm).withColumn("_rk", F.row_number().over(w))
            .where("_rk = 1").drop("_rk").withColumnRenamed("_norm", "norm"))


def beam_decode(starts: DataFrame, scores: DataFrame, beam: int = 4, max_len: int = 128, alpha: float = 0.6,
                eos: str = "</s>", key: str = "key", ctx=("lang",), checkpoint_every: int = 4,
                dedupe: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each distinct start state is decoded once; while the top-next table is
    small (measured) in one pass, beyond that by a join and a window per step."""
    if dedupe:
        return _by_distinct_start(starts, key, ctx, lambda u, k: beam_decode(
            u, scores, beam, max_len, alpha, eos, k, ctx, checkpoint_every, False, broadcast_bytes))
    top = cut_lineage(top_next(scores, beam, ctx).select(*ctx, "prev", "nxt", "logp"))
    if _bytes(top) > broadcast_bytes:
        return _beam(starts, scores, beam, max_len, alpha, eos, key, ctx, checkpoint_every)

    def norm(score, n):
        return round(score / ((5.0 + n) / 6.0) ** alpha, 9)

    def decode(seq, successors):
        beams = [(list(seq), 0.0, False, "\u0001".join(map(str, seq)))]
        for _ in range(max_len):
            cand = []
            for s, score, ended, name in beams:
                after = () if ended or not s else successors(s[-1])
                if not after:
                    cand.append((s, score, True, name))
                cand += [([*s, t], score + p, t == eos, f"{name}\u0001{t}") for t, p in after]
            beams = sorted(cand, key=lambda c: (-norm(c[1], len(c[0])), c[3]))[:beam]
            if all(b[2] for b in beams):
                break
        s, score, ended, _ = min(beams, key=lambda c: (-norm(c[1], len(c[0])), c[3]))
        return s, score, ended, norm(score, len(s))

    return _local(starts, top, key, ctx, "seq SEQ, score double, ended boolean, norm double", decode)


def _beam(starts: DataFrame, scores: DataFrame, beam: int = 4, max_len: int = 128, alpha: float = 0.6,
          eos: str = "</s>", key: str = "key", ctx=("lang",), checkpoint_every: int = 4) -> DataFrame:
    """Expand every open beam by its top-``beam`` next tokens, carry ended
    beams unexpanded, keep the best ``beam`` per key by normalised score
    (rounded to 9 places, then joined tokens asc); stop when every beam has
    ended or after ``max_len`` steps; return the best beam per key."""
    ctx = list(ctx)
    top = _maybe_broadcast(top_next(scores, beam, ctx).select(*ctx, "prev", "nxt", "logp"))
    st = starts.select(key, *ctx, "seq", F.lit(0.0).alias("score"), F.lit(False).alias("ended"))
    for step in range(1, max_len + 1):
        ended = st.where("ended")
        # an open beam whose state has no successors ends as it is
        none = F.col("nxt").isNull()
        grown = (st.where(~F.col("ended")).withColumn("prev", F.element_at("seq", -1))
                 .join(top, [*ctx, "prev"], "left")
                 .select(key, *ctx, F.when(none, F.col("seq")).otherwise(F.concat("seq", F.array("nxt"))).alias("seq"),
                         F.when(none, F.col("score")).otherwise(F.col("score") + F.col("logp")).alias("score"),
                         (none | (F.col("nxt") == eos)).alias("ended")))
        cand = ended.unionByName(grown)
        norm = F.round(length_norm(F.col("score"), F.size("seq"), alpha), 9)
        w = Window.partitionBy(key).orderBy(F.col("_n").desc(), F.array_join("seq", "\u0001"))
        st = (cand.withColumn("_n", norm).withColumn("_rk", F.row_number().over(w))
              .where(F.col("_rk") <= beam).drop("_n", "_rk"))
        if step % checkpoint_every == 0 or step == max_len:
            st = cut_lineage(st)
            if st.where(~F.col("ended")).isEmpty():
                break
    return rerank(st, key, alpha)


def sampling_cdf(scores: DataFrame, k: int = 50, temperature: float = 0.8, ctx=("lang",)) -> DataFrame:
    """D6 on the long form: one row per (context, prev) with the top-k tokens of
    softmax(logp / T), renormalised, in order (prob desc, token asc): ``nxts`` and
    their running probabilities ``his``."""
    ctx = list(ctx)
    g = Window.partitionBy(*ctx, "prev")
    w = g.orderBy(F.col("logp").desc(), F.col("nxt"))
    m = F.max("logp").over(g)
    s = scores.select(*ctx, "prev", "nxt", "logp", F.exp((F.col("logp") - m) / F.lit(float(temperature))).alias("e"))
    s = s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    hi = F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("e").over(g)
    s = s.select(*ctx, "prev", F.struct("rk", hi.alias("hi"), "nxt").alias("c"))
    c = s.groupBy(*ctx, "prev").agg(F.array_sort(F.collect_list("c")).alias("c"))  # k entries at most
    return c.select(*ctx, "prev", F.col("c.nxt").alias("nxts"), F.col("c.hi").alias("his"))


def generate(starts: DataFrame, scores: DataFrame, steps: int, seed: int = 1337, k: int = 50,
             temperature: float = 0.8, key: str = "key", ctx=("lang",), checkpoint_every: int = 8,
             broadcast_bytes: int = BROADCAST_BYTES, window: int = 64, recent: float = 1.0) -> DataFrame:
    """Seeded continuation over the last ``window`` ids.

    Of the last id's top-k tokens each has weight exp(logp / T) * (1 + recent *
    times it followed that id within the window); a step draws u =
    hash(seed:key:step) and takes the first token whose running share of the
    weights exceeds u (the last one when rounding leaves u beyond all). A state
    without successors stays as it is. ``recent`` 0 forgets all but the last id.

    While the table is small (measured) every task gets it and all steps of a
    batch of keys run there, all keys of the batch together; beyond that each
    step is one join, one row to one row."""
    ctx = list(ctx)
    weights = cut_lineage(sampling_weights(scores, k, temperature, ctx))
    st = starts.select(key, *ctx, "seq")
    if _bytes(weights) <= broadcast_bytes:
        return _generate_batches(st, weights, steps, seed, key, ctx, window, recent)
    from tokenmill.functions import uniform_hash
    for step in range(1, steps + 1):
        cur = st.withColumn("prev", F.element_at("seq", -1)).withColumn("u", uniform_hash(seed, key, F.lit(step)))
        tail = F.slice("seq", -F.least(F.size("seq"), F.lit(window)), F.least(F.size("seq"), F.lit(window)))
        cur = cur.withColumn("tail", F.when(F.size("seq") > 0, tail))
        after = F.filter(F.transform("tail", lambda x, i: F.when(x == F.col("prev"), F.get("tail", i + 1))), lambda x: x.isNotNull())
        cur = cur.withColumn("after", after)
        j = cur.join(weights, [*ctx, "prev"], "left")
        w = F.transform("nxts", lambda t, i: F.get("ws", i) * (
            F.lit(1.0) + F.lit(float(recent)) * F.size(F.filter("after", lambda x: x == t)).cast("double")))
        j = j.withColumn("w", w)
        total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
        j = j.withColumn("total", total)
        # places whose running share does not exceed u
        run = F.aggregate("w", F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct(
            (a["s"] + x).alias("s"), (a["n"] + ((a["s"] + x) / F.col("total") <= F.col("u")).cast("int")).alias("n")))
        nxt = F.get("nxts", F.least(run["n"], F.size("nxts") - 1))
        st = j.select(key, *ctx, F.when(F.col("nxts").isNull(), F.col("seq"))
                      .otherwise(F.concat("seq", F.array(nxt))).alias("seq"))
        if step % checkpoint_every == 0:
            st = cut_lineage(st)
    return st


def sampling_weights(scores: DataFrame, k: int = 50, temperature: float = 0.8, ctx=("lang",)) -> DataFrame:
    """One row per (context, prev): the top-k tokens ``nxts`` (logp descending,
    token ascending) and their weights exp((logp - best) / T), ``ws``."""
    ctx = list(ctx)
    g = Window.partitionBy(*ctx, "prev")
    e = F.exp((F.col("logp") - F.max("logp").over(g)) / F.lit(float(temperature)))
    s = scores.select(*ctx, "prev", "nxt", e.alias("w"), F.row_number().over(g.orderBy(F.col("logp").desc(), F.col("nxt"))).alias("rk"))
    c = s.where(F.col("rk") <= k).groupBy(*ctx, "prev").agg(F.array_sort(F.collect_list(F.struct("rk", "nxt", "w"))).alias("c"))
    return c.select(*ctx, "prev", F.col("c.nxt").alias("nxts"), F.col("c.w").alias("ws"))


def _generate_batches(st: DataFrame, weights: DataFrame, steps: int, seed: int, key: str, ctx, window: int, recent: float) -> DataFrame:
    rows = weights.collect()  # at most BROADCAST_BYTES, measured by the caller
    tokens = sorted({t for r in rows for t in (r["prev"], *r["nxts"])}, key=repr)
    place = {t: i for i, t in enumerate(tokens)}
    state = {tuple(r[c] for c in [*ctx, "prev"]): i for i, r in enumerate(rows)}
    shared = st.sparkSession.sparkContext.broadcast((tokens, state, [[place[t] for t in r["nxts"]] for r in rows], [r["ws"] for r in rows]))
    # what uniform_hash hashes, but for the step
    src = st.withColumn("_k", F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":")).cast("binary"))

    def run(batches):
        from hashlib import md5

        import numpy as np
        import pyarrow as pa
        numbers = [str(i).encode() for i in range(1, steps + 1)]

        def draws(keys):
            """uniform_hash of every key and step; beyond all shares without a key."""
            u = np.full((len(keys), steps), np.inf)
            for i, k in enumerate(keys):
                if k is not None and steps:
                    u[i] = np.frombuffer(b"".join([md5(k + x).digest() for x in numbers]), ">u4")[::4] / 4294967296.0
            return u

        tokens, state, nxts, ws = shared.value
        wide, n_state = max(map(len, nxts), default=1), len(nxts)
        nxt, weight = np.full((n_state + 1, wide), -1), np.zeros((n_state + 1, wide))
        for i, (t, w) in enumerate(zip(nxts, ws)):
            nxt[i, :len(t)], weight[i, :len(w)] = t, w
        last = np.array([len(t) - 1 for t in nxts] + [0])
        places = {t: i for i, t in enumerate(tokens)}
        of_context: dict = {}
        for (*c, prev), i in state.items():
            of_context.setdefault(tuple(c), np.full(len(tokens) + 1, n_state))[places[prev]] = i
        context = {c: i for i, c in enumerate(of_context)}
        table = np.stack([*of_context.values(), np.full(len(tokens) + 1, n_state)])  # the last: an unknown context
        # a token's place among the successors of a state, while such a table is small
        rank = None
        if (n_state + 1) * (len(tokens) + 1) <= 1 << 24 and all(len(set(t)) == len(t) for t in nxts):
            rank = np.full((n_state + 1, len(tokens) + 1), wide, dtype=np.int32)
            for i, t in enumerate(nxts):
                rank[i, t] = np.arange(len(t))
        for whole in batches:
            for cut in range(0, whole.num_rows, 1024):
                b = whole.slice(cut, 1024)
                n = b.num_rows
                seqs = b.column("seq").to_pylist()
                u = draws(b.column("_k").to_pylist())
                # the window of every key, newest last; -1 where it is not filled or not a known token
                hist = np.full((n, window + steps), -1, dtype=np.int32)
                for i, s in enumerate(seqs):
                    tail = [places.get(t, -1) for t in (s or ())[-window:]]
                    hist[i, window - len(tail):window] = tail
                of_key = np.array([context.get(c, len(context)) for c in
                                   (zip(*(b.column(c).to_pylist() for c in ctx)) if ctx else [()] * n)], dtype=np.int64)
                grown = np.zeros(n, dtype=np.int64)
                live = np.flatnonzero([bool(s) for s in seqs])
                for step in range(steps):
                    prev = hist[live, window + step - 1]
                    at = table[of_key[live], prev]
                    live, prev, at = live[at < n_state], prev[at < n_state], at[at < n_state]
                    if not len(live):
                        break
                    w = weight[at]
                    if recent:
                        seen = hist[live, step:window + step]
                        row, j = np.nonzero(seen[:, :-1] == prev[:, None])
                        if rank is None:
                            r, c = np.nonzero(nxt[at[row]] == seen[row, j + 1][:, None])
                            row = row[r]
                        else:
                            c = rank[at[row], seen[row, j + 1]]
                            row, c = row[c < wide], c[c < wide]
                        w = w * (1.0 + recent * np.bincount(row * wide + c, minlength=w.size).reshape(w.shape))
                    share = np.cumsum(w, axis=1)
                    total = share[np.arange(len(live)), last[at]]
                    inside = np.arange(wide) <= last[at][:, None]
                    pick = np.minimum(((share / total[:, None] <= u[live, step][:, None]) & inside).sum(axis=1), last[at])
                    hist[live, window + step] = nxt[at, pick]
                    grown[live] = step + 1
                out = [None if s is None else [*s, *[tokens[t] for t in hist[i, window:window + grown[i]].tolist()]] for i, s in enumerate(seqs)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (key, *ctx)], pa.array(out, b.schema.field("seq").type)],
                                                 names=[key, *ctx, "seq"])

    return src.mapInArrow(run, st.schema)


# ------------------------------------------------------------------ D8, U1
def translation_scores(enc):
    """A toy conditional bigram "translator" learned from the parallel corpus:
    P(next target piece | previous target piece, first piece of the wrapped
    source; eos for an empty one)."""
    t = enc.select(F.element_at(wrap_pad_fixed("src_raw", MAX_SRC_LEN), 2).alias("ctx"),
                   wrap_truncate("tgt_raw", 128).alias("t"))
    p = t.select("ctx", F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("prev"),
                                               F.slice("t", F.lit(2), F.size("t") - 1).alias("nxt"))).alias("p"))
    c = p.groupBy("ctx", F.col("p.prev").alias("prev"), F.col("p.nxt").alias("nxt")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("ctx", "prev", "nxt", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("ctx", "prev"))).alias("logp"))


def bulk_translate(src_df, vocab, scores, decode="beam", max_len=128, beam=4):
    """Strip -> (blank gives "") -> BPE encode -> serving wrap/pad ->
    decode over the score table -> clean -> BPE decode."""
    s = src_df.select("pair_id", strip_text("src").alias("clean"))
    blank = s.where(F.col("clean") == "").select("pair_id", F.lit("").alias("hyp"))
    from tokenmill.operators import bpe as BP
    e = BP.bpe_encode(s.where(F.col("clean") != ""), "clean", vocab, "ids")
    # the scorer's source is the wrapped, fixed-length row: bos, pieces, eos, pad
    fixed = wrap_pad_fixed("ids", MAX_SRC_LEN)
    starts = e.select(F.col("pair_id").alias("key"), F.element_at(fixed, 2).alias("ctx"),
                      F.array(F.lit(BOS_ID).cast("bigint")).alias("seq"))
    if decode == "beam":
        out = beam_decode(starts, scores, beam, max_len, 0.6, eos=EOS_ID, key="key", ctx=("ctx",))
    else:
        out = greedy_decode(starts, scores, max_len, eos=EOS_ID, key="key", ctx=("ctx",))
    hyp = out.select(F.col("key").alias("pair_id"), BP.bpe_decode(clean_ids("seq"), vocab).alias("hyp"))
    return hyp.unionByName(blank)


def table_scores(padded, bigram, key: str = "pair_id", tin: str = "tgt_in_pad", tout: str = "tgt_out_pad",
                 floor: float = -20.0):
    """A table-backed scorer for U1: (key, pos, target, logp) of every target
    that is not padding, by a join on (previous piece, piece); ``floor`` for pairs
    the table does not have."""
    cells = padded.select(key, F.posexplode(F.arrays_zip(F.col(tin).alias("prev"), F.col(tout).alias("nxt"))).alias("pos", "c"))
    cells = cells.select(key, "pos", F.col("c.prev").alias("prev"), F.col("c.nxt").alias("nxt")).where(F.col("nxt") != PAD_ID)
    return cells.join(bigram.select("prev", "nxt", "logp"), ["prev", "nxt"], "left").select(
        key, "pos", F.col("nxt").alias("target"), F.coalesce("logp", F.lit(float(floor))).alias("logp"))
